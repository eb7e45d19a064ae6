"""Contracts of multi-hop questions: validation, lint, composite cases, reachability, verdicts, staleness, excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .audit import normal, without_noise

# Fixed values.
CASE_TYPES, RISK_LEVELS = ("ambiguous", "fact", "multi_hop", "refusal"), ("high", "low", "medium")
SHORTEST, TRUNCATED_AT, RADIUS = 2, 5, 140
HEAVY = ("retrieval_candidate_audit", "bm25_query_hits", "entity_plan")
# End of fixed values.


def _problems(rows: DataFrame, key: str, checks: list[tuple[Column, str]]) -> DataFrame:
    return rows.select(key, F.explode(_found(checks)).alias("problem"))


def _found(checks: list[tuple[Column, str]]) -> Column:
    return F.filter(F.array(*[F.when(c, F.lit(p)) for c, p in checks]), lambda x: x.isNotNull())


def require(rows: DataFrame, key: str, checks: list[tuple[Column, str]], what: str) -> DataFrame:
    """The rows, which fail in whatever pass uses them as soon as one has a problem; no scan of its own.

    The test is a filter, so it stays when columns are pruned.
    """
    found = _found(checks)
    told = F.concat(F.lit(f"{what} "), F.coalesce(F.col(key).cast("string"), F.lit("without id")), F.lit(": "), F.array_join(found, ", "))
    return rows.where(F.when(F.size(found) > 0, F.raise_error(told)).otherwise(F.lit(True)))


def require_size(rows: DataFrame, expected: int | None, what: str) -> DataFrame:
    """The rows of one document, which fail when used if there are none, or not as many as expected; counted in the same pass."""
    n = F.size("rows")
    wrong = (n == 0) if expected is None else (n != expected)
    told = F.concat(F.lit(f"{what} has "), n.cast("string"), F.lit(f" rows, not {'any' if expected is None else expected}"))
    whole = rows.agg(F.collect_list(F.struct(*rows.columns)).alias("rows"))
    return whole.where(F.when(wrong, F.raise_error(told)).otherwise(F.lit(True))).select(F.inline("rows"))


def _slice_checks() -> list[tuple[Column, str]]:
    bad = lambda c, known: F.col(c).isNotNull() & ~F.col(c).isin(*known)
    return [
        (F.col("question_id").isNull(), "missing_id"), (F.col("case_type").isNull(), "missing_case_type"), (F.col("risk_level").isNull(), "missing_risk_level"),
        (bad("case_type", CASE_TYPES), "unknown_case_type"), (bad("risk_level", RISK_LEVELS), "unknown_risk_level"),
        (F.coalesce(F.size("slice_tags"), F.lit(0)) <= 0, "no_tags"), (F.col("flaky").isNull(), "flaky_not_boolean"), (F.col("twice"), "repeated_id"),
    ]


def _twice(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn("twice", F.count(F.lit(1)).over(W.partitionBy(key)) > 1)


def slice_problems(slices: DataFrame) -> DataFrame:
    """(question_id, problem): missing fields, unknown values, empty tags and repeated ids of slice definitions; empty if all is well."""
    return _problems(_twice(slices, "question_id"), "question_id", _slice_checks()).distinct()


def valid_slices(slices: DataFrame) -> DataFrame:
    """Slice definitions, which fail when used if any has a problem."""
    return require(_twice(slices, "question_id"), "question_id", _slice_checks(), "slice").drop("twice")


def needle(term: Column) -> Column:
    """The form in which a declared term is looked for."""
    return normal(without_noise(term, labels=False))


def spec_problems(cases: DataFrame, hops: DataFrame) -> DataFrame:
    """(case_id, problem) of multi-hop specifications; empty if all can be built.

    ``cases`` (case_id, question, sources, coverage, unsupported_needs), ``hops`` (case_id, hop_id, from_question, chunk_id, groups: arrays of terms).
    """
    n = hops.groupBy("case_id").agg(F.count("*").alias("n_hops"))
    twice = F.count(F.lit(1)).over(W.partitionBy("case_id")) > 1
    rows = cases.join(n, "case_id", "left").withColumn("twice", twice)
    blank = lambda c: F.length(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) == 0
    coverage = F.coalesce("coverage", F.lit("complete"))
    of_case = _problems(rows, "case_id", [
        (blank("case_id"), "missing_id"), (F.col("twice"), "repeated_id"), (blank("question"), "missing_question"), (F.coalesce(F.size("sources"), F.lit(0)) <= 0, "missing_sources"),
        (F.coalesce("n_hops", F.lit(0)) < 2, "fewer_than_two_hops"), (~coverage.isin("complete", "partial"), "unknown_coverage"),
        ((coverage == "partial") & (F.coalesce(F.size("unsupported_needs"), F.lit(0)) <= 0), "partial_without_needs"),
    ])
    each = hops.join(cases.select("case_id", "sources"), "case_id")
    of_hop = _problems(each, "case_id", [
        (blank("hop_id") | blank("from_question") | blank("chunk_id"), "hop_without_fields"), (F.coalesce(F.size("groups"), F.lit(0)) <= 0, "hop_without_terms"),
        (F.exists("groups", lambda g: F.exists(g, lambda x: needle(x) == "")), "term_normalises_to_nothing"), (~F.array_contains("sources", F.col("from_question")), "source_not_declared"),
    ])
    return of_case.union(of_hop).distinct()


def lint_terms(terms: DataFrame) -> DataFrame:
    """(case_id, place, raw, finding): empty, vacuous, shadowed and echoed elements of contracts.

    ``terms`` (case_id, place, kind, raw, question): rows of one case and place are alternatives; a term is shadowed by another that holds it.
    """
    form = F.when(F.col("kind") == "span", normal(without_noise(F.col("raw")))).otherwise(needle(F.col("raw")))
    rows = terms.select("case_id", "place", "raw", form.alias("x"), normal(F.col("question")).alias("q")).distinct()
    own = F.filter(F.array(F.when(F.col("x") == "", "empty-needle"), F.when((F.length("x") > 0) & (F.length("x") < SHORTEST), "vacuous-needle"), F.when((F.col("q") != "") & (F.length("x") >= SHORTEST) & F.contains("q", "x"), "echoed")), lambda f: f.isNotNull())
    a, b = rows.alias("a"), rows.alias("b")
    held = a.join(b, (F.col("a.case_id") == F.col("b.case_id")) & (F.col("a.place") == F.col("b.place")) & (F.col("a.raw") != F.col("b.raw")) & (F.col("a.x") != "") & (F.col("a.x") != F.col("b.x")) & F.contains(F.col("b.x"), F.col("a.x")))
    return rows.select("case_id", "place", "raw", F.explode(own).alias("finding")).union(held.select("a.case_id", "a.place", "a.raw", F.lit("shadowed"))).distinct()


def pooled(sources: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(case_id, chunk_id, position, within): whole source cases in order, each chunk once, with its place.

    ``sources`` (case_id, nth, question_id), ``snapshot`` (question_id, rank, chunk_id, content).
    """
    # a chunk stands in a question's snapshot at its first rank alone, so repeats don't meet the cases
    found = snapshot.groupBy("question_id", "chunk_id").agg(F.min("rank").alias("rank"), F.min_by("content", "rank").alias("content"))
    rows = sources.join(found, "question_id").repartition("case_id")
    first = rows.groupBy("case_id", "chunk_id").agg(F.min(F.struct("nth", "rank")).alias("at"), F.min_by("content", F.struct("nth", "rank")).alias("content"))
    place = F.row_number().over(W.partitionBy("case_id").orderBy("at", "chunk_id"))
    return first.withColumn("position", place).select("case_id", "chunk_id", "content", "position", (place <= TRUNCATED_AT).alias("within"))


def resolve_hops(hops: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(case_id, hop_id, chunk_id, problem): each hop's chunk, found by a prefix of its id, and what keeps it from being answered.

    The prefix must fit exactly one chunk of the source question, and the chunk must hold the span and a term of every group.
    """
    squeezed = lambda c: F.regexp_replace(F.lower(c), "\\s+", "")
    chunks = snapshot.select(F.col("question_id").alias("from_question"), F.col("chunk_id").alias("found"), "content").distinct()
    known = snapshot.select(F.col("question_id").alias("from_question")).distinct().withColumn("known", F.lit(True))
    rows = hops.join(known, "from_question", "left").join(chunks, (hops["from_question"] == chunks["from_question"]) & F.col("found").startswith(F.col("prefix")), "left").select(hops["*"], "known", "found", "content")
    each = rows.groupBy("case_id", "hop_id").agg(F.count("found").alias("n"), F.bool_or("known").alias("known"), F.min("found").alias("chunk_id"), F.min_by("content", "found").alias("content"), F.first("span").alias("span"), F.first("groups").alias("groups"))
    body = squeezed(F.col("content"))
    no_span = (F.coalesce("span", F.lit("")) != "") & ~F.contains(body, squeezed(F.col("span")))
    no_term = F.exists("groups", lambda g: ~F.exists(g, lambda x: F.contains(body, squeezed(x))))
    problem = F.when(F.col("known").isNull(), "unknown_source").when(F.col("n") == 0, "chunk_not_found").when(F.col("n") > 1, "prefix_not_unique").when(no_span, "span_not_in_chunk").when(no_term, "term_not_in_chunk")
    return each.select("case_id", "hop_id", F.when(F.col("n") == 1, F.col("chunk_id")).alias("chunk_id"), problem.alias("problem"))


def reachable(observations: DataFrame, packs: DataFrame) -> DataFrame:
    """``observations`` with chunk_in_pack: whether the hop's chunk was among the evidence of its question."""
    have = packs.select("question_id", "chunk_id").distinct().withColumn("here", F.lit(True))
    return observations.join(have, ["question_id", "chunk_id"], "left").withColumn("chunk_in_pack", F.col("here").isNotNull()).drop("here")


def verdicts(observations: DataFrame, table: DataFrame) -> DataFrame:
    """verdict and overridden: hops whose chunk never reached the model are refusals whatever the table says; missing rows have no verdict."""
    rows = observations.join(table.select("question_id", "hop_id", F.col("verdict").alias("said")), ["question_id", "hop_id"], "left")
    final = F.when(~F.col("chunk_in_pack"), "correct_refusal").otherwise(F.col("said"))
    return rows.withColumn("verdict", final).withColumn("overridden", F.coalesce(F.col("said") != final, F.lit(False))).drop("said")


def verdict_totals(judged: DataFrame) -> DataFrame:
    """One row: audited, credited, unmeasurable, incorrect, missing and overridden observations."""
    n = lambda *v: F.count_if(F.col("verdict").isin(*v))
    return judged.agg(F.count("*").alias("audited"), n("correct_paraphrase", "damaged_span").alias("credited"), n("correct_refusal").alias("unmeasurable"), n("incorrect").alias("incorrect"), F.count_if(F.col("verdict").isNull()).alias("missing"), F.count_if("overridden").alias("overridden"))


def stale(built: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows that a regenerated table has and the stored one lacks, and the other way round, with the side; empty if they agree."""
    return built.exceptAll(stored).withColumn("side", F.lit("built")).unionByName(stored.exceptAll(built).withColumn("side", F.lit("stored")))


def excerpt(text: Column, hits: Column) -> Column:
    """140 characters on either side of where the first found hit begins, else the first 280."""
    at = F.get(F.filter(F.transform(hits, lambda h: F.position(h, text)), lambda p: p > 0), F.lit(0))
    start = F.greatest(F.lit(1), at - RADIUS)
    return F.when(at.isNotNull(), F.substring(text, start, at + RADIUS - start)).otherwise(F.substring(text, 1, 2 * RADIUS))


def demote(hops: DataFrame, replacements: DataFrame) -> DataFrame:
    """Hops whose span is listed lose it and take the listed terms; ``demoted`` tells which."""
    rows = hops.join(replacements.select(F.col("span").alias("old"), F.col("groups").alias("new")), F.col("span") == F.col("old"), "left")
    hit = F.col("old").isNotNull()
    return rows.withColumn("span", F.when(~hit, F.col("span"))).withColumn("groups", F.coalesce("new", "groups")).withColumn("demoted", hit).drop("old", "new")


def slim(metadata: Column) -> Column:
    """A document's metadata map without heavy diagnostics."""
    return F.map_filter(metadata, lambda k, v: ~k.isin(*HEAVY))


def with_snapshot(rows: DataFrame, snapshot: DataFrame) -> DataFrame:
    """``rows`` with status missing_snapshot where no snapshot has their question."""
    have = snapshot.select("question_id").distinct().withColumn("here", F.lit(True))
    return rows.join(have, "question_id", "left").withColumn("status", F.when(F.col("here").isNull(), "missing_snapshot").otherwise(F.col("status"))).drop("here")


def first_values(runs: DataFrame, value: str) -> DataFrame:
    """(question_id, before, after, diff) of questions that both runs have, each side by its first value."""
    first = runs.where(F.col(value).isNotNull()).groupBy("question_id", "run").agg(F.min_by(value, "seq").alias("v"))
    wide = first.groupBy("question_id").agg(F.max(F.when(F.col("run") == "before", F.col("v"))).alias("before"), F.max(F.when(F.col("run") == "after", F.col("v"))).alias("after"))
    return wide.where("before IS NOT NULL AND after IS NOT NULL").withColumn("diff", F.col("after") - F.col("before"))


def agenda(questions: DataFrame, arms: tuple[str, str], rounds: int, seed: int) -> DataFrame:
    """(round, place, question_id, first, second): each round's questions in an order drawn by hash, with the arm that goes first.

    The order depends on nothing but seed, round and id, so it is the same on any cluster.
    """
    rows = questions.select("question_id", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    draw = F.sha2(F.concat_ws("|", F.lit(seed), "round", "question_id"), 256)
    heads = F.substring(F.sha2(F.concat_ws("|", F.lit(seed), "round", "question_id", F.lit("coin")), 256), 1, 1) < "8"
    place = F.row_number().over(W.partitionBy("round").orderBy(draw, "question_id"))
    return rows.select("round", place.alias("place"), "question_id", F.when(heads, arms[0]).otherwise(arms[1]).alias("first"), F.when(heads, arms[1]).otherwise(arms[0]).alias("second"))
