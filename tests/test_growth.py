"""Steps whose work must follow their input: rows that plans make, and expressions that are evaluated where few rows are."""

from pyspark.sql import functions as F

from tessera.functions.text import let
from tessera.operators import audit, contracts, entities


def nodes(plan):
    """All nodes of an executed plan, through its query stages."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from nodes(plan.executedPlan())
    elif kind.endswith("QueryStageExec"):
        yield from nodes(plan.plan())
    else:
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))


def most_rows(df, word):
    """(rows, most rows that a node named so made)."""
    rows = df.collect()
    made = [n.metrics().apply("numOutputRows").value() for n in nodes(df._jdf.queryExecution().executedPlan()) if word in n.nodeName() and n.metrics().contains("numOutputRows")]
    return rows, max(made)


def test_pooled_meets_each_chunk_of_a_question_once(spark):
    snapshot = spark.range(3000).select(F.concat(F.lit("q"), F.col("id") % 3).alias("question_id"), F.col("id").cast("int").alias("rank"), F.concat(F.lit("c"), F.col("id") % 9).alias("chunk_id"), F.lit("x").alias("content"))
    sources = spark.range(40).select(F.col("id").alias("case_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("nth")).withColumn("question_id", F.concat(F.lit("q"), (F.col("case_id") + F.col("nth")) % 3))
    rows, made = most_rows(contracts.pooled(sources, snapshot), "Join")
    assert len(rows) == 40 * 6 and made == 40 * 6
    first = sorted((r.position, r.chunk_id) for r in rows if r.case_id == 0)
    assert first == [(1, "c1"), (2, "c4"), (3, "c7"), (4, "c2"), (5, "c5"), (6, "c8")]


def size_of(column):
    """Nodes of a column's expression, as text; what stands at several uses counts at each."""
    return str(column._jc).count("regexp_")


def test_audit_computes_normal_forms_once(spark):
    assert size_of(audit.span_matches(F.col("span"), F.col("answer"))) < 50
    assert size_of(audit.numeric_coverage(F.col("answer"))) < 20


def test_let_binds_nested_values(spark):
    row = spark.sql("SELECT 'ab' AS x, array('a', 'c') AS ys")
    got = row.select(let(F.upper("x"), lambda u: let(F.length(u), lambda n: F.concat(u, n.cast("string"), u))).alias("a"), let(F.struct("x", F.lit("c").alias("z")), lambda s: F.filter("ys", lambda y: ~F.contains(s["x"], y) & F.contains(s["z"], y))).alias("b")).collect()[0]
    assert (got.a, got.b) == ("AB2AB", ["c"])


def test_questions_are_planned_once_each(spark):
    """The lanes are stored for distinct questions, so no filter on them reaches the table below."""
    from tessera.plans import catalog

    plan = catalog.queries()["rank_lanes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "part.parquet" not in plan and "p_partkey" not in plan


def test_match_score_searches_each_place_once(spark):
    score, matched = entities.match_score(F.col("asked"), {f: F.lit("") for f in ("source", "title", "parent_document", "section_path", "content")})
    assert str(score._jc).lower().count("rlike") <= 5 * len(entities.ENTITIES)


def test_source_conflicts_meet_in_groups_that_grow(spark):
    """Groups are the 71 of the contract, not runs of 20 keys, so a group's rows grow with the table."""
    from tessera.plans import catalog

    rows = catalog.queries()["record_source_conflicts"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all((r.doc_b - r.doc_a) % 71 == 0 and r.group_id == r.doc_a % 71 for r in rows)


def test_rows_of_equal_words_meet_as_blocks(spark, monkeypatch):
    """Joins make pairs of blocks, not of rows; tasks follow the pairs, not the bytes; rows and order of words as by brute force."""
    import collections

    from tessera.operators import conflicts

    words = [["and", "is", "red"], ["red", "is", "and", "is"], ["and", "big", "is"], ["zz"], [], None, ["is", None]]
    rows = [(g, k, words[k % 7], k % 3) for g in (1, 2) for k in range(150)] + [(1, 7, ["zz"], 5), (None, 1, ["zz"], 0), (None, 2, ["zz"], 1), (1, None, ["zz"], 0)]
    d = spark.createDataFrame(rows, "g long, k long, w array<string>, n long")
    want = collections.Counter()
    for g, k, w, n in rows:
        for g2, k2, w2, n2 in rows:
            both = {*(w or [])} & {*(w2 or [])} - {None}
            if g and g == g2 and None not in (k, k2) and k < k2 and n != n2 and both:
                want[g, k, k2, tuple(sorted(both))] += 1
    got, made = most_rows(conflicts.sharing_pairs(d, "g", "k", "w", F.col("x.n") != F.col("y.n")), "Join")
    assert collections.Counter((r.g, r.a, r.b, tuple(r.shared)) for r in got) == want
    assert made < 200 < len(got)
    monkeypatch.setattr(conflicts, "MEET", 1000)
    shown = conflicts.sharing_pairs(d, "g", "k", "w", F.col("x.n") != F.col("y.n"), shown=F.size)
    assert shown.rdd.getNumPartitions() > 20 and shown.agg(F.sum("shared")).first()[0] == sum(len(w) * n for (*_, w), n in want.items())


def test_dense_holds_bounded_scores(spark, monkeypatch):
    """A task computes a bounded number of scores at once, and blocks of any size give the brute-force lists, ties included."""
    import numpy as np

    from tessera.operators import retrieval

    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 4))
    v[40:60] = v[0]
    v /= np.linalg.norm(v, axis=1)[:, None]
    seen = []
    whole = retrieval._merge
    monkeypatch.setattr(retrieval, "_merge", lambda best, own, stored, ids, matrix, k: seen.append(len(own) * len(ids)) or whole(best, own, stored, ids, matrix, k))
    monkeypatch.setattr(retrieval, "SCORES", 64)
    run = {}
    frame = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>").coalesce(1)
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, f, schema: run.update(f=f, rows=self) or self.sparkSession.createDataFrame([], schema))
    asked = frame.where("vec_id % 7 = 0").withColumnRenamed("vec_id", "question_id")
    retrieval.dense(frame, asked, 5)
    got = {}
    for batch in run["f"](iter(run["rows"].toArrow().to_batches(max_chunksize=90))):
        for q, i, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            got.setdefault(q, []).append((-round(s, 9), i))
    assert max(seen) <= 64
    for q in range(0, 300, 7):
        want = sorted((-round((float(v[i] @ v[q]) + 1) / 2, 9), i) for i in range(300) if i != q)[:5]
        assert sorted(got[q]) == want


ODD = ["a b Abc. --x/y ._9 aa AA K1", None, "", "标准 ab中文检测一二三四五六 z 标", "İx Ky straße", "a\nb\tcd\x0bef\x0cgh ij kl", "see GB/T 26158 - 2010, gb_t16252-2023 GB 4806.7 gb48067-2023 10000-2023-GBT pp 3486_01 tx-1001", "g b / t 3326-2016 gb\n/ t 3326 2016 gb t 4806 2023", "p p c 30\t4 triTAN", "--", "./a ./ab"]


def test_index_deals_documents_once_and_whole(spark):
    """No posting is a row of a shuffle: documents are dealt by shard, and nothing else is."""
    from tessera.operators import postings

    docs = spark.createDataFrame([(i, t, "src") for i, t in enumerate(ODD)], "doc_id long, content string, source string")
    plan = postings.blocks(postings.terms(docs, postings.Layout()), postings.Layout())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan


def test_terms_of_batches_are_the_lexical_terms(spark):
    from tessera.functions.text import lexical_terms
    from tessera.operators import postings

    docs = spark.createDataFrame([(i, t, ODD[-i]) for i, t in enumerate(ODD)], "doc_id long, content string, source string").coalesce(1)
    whole = F.lower(F.concat_ws(" ", F.coalesce("source", F.lit("")), F.coalesce("content", F.lit(""))))
    want = docs.select("doc_id", lexical_terms(F.coalesce("content", F.lit(""))).alias("a"), lexical_terms(F.coalesce("source", F.lit(""))).alias("b"), entities.canonical_ids(whole).alias("c"))
    squeezed = {i: ["".join(x for x in (t or "").lower() if x not in " \t\n\x0b\x0c\r") for t in (ODD[i], ODD[-i])] for i in range(len(ODD))}
    got = {r.id: r for r in postings.terms(docs, postings.Layout()).collect()}
    for r in want.collect():
        tf = {t: (t in r.a) * 1.0 + (t in r.b) * 3.0 for t in {*r.a, *r.b}}
        tf |= {"": 0.0} | {postings.CANONICAL + c: 0.0 for c in r.c} | {postings.EXACT + n: 0.0 for n in postings.NAMED if any(n in t for t in squeezed[r.doc_id])}
        assert got[r.doc_id].len == len(r.a) + len(r.b)
        assert dict(zip(got[r.doc_id].terms.split("\n"), got[r.doc_id].tfs, strict=True)) == tf
    assert sum(len(r.c) for r in want.collect()) >= 6
