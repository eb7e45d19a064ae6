"""The ten operators against brute force, with nulls, blanks, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import bitcodes, chat, jaccard_join, mixing, perplexity, quality_rules, queries, sentencepiece_codec, sharding, sstable, textscan, toxicity, unitmemo

DIR = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, v long, n string"
LONG = "alpha beta gamma delta " * 3000


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{DIR}/documents.parquet")
    odd = [(9001, None, None, None), (9002, "", "en", "src0"), (9003, " \n\t", None, None), (9004, "one two", "en", "s"), (9005, "one two", "en", "s"), (9005, "one two", "en", "s"), (9006, LONG, "en", "s"), (9007, "日本語 🙂 \u2581 é", "ja", "s"), (9008, "One TWO", "en", "s")]
    extra = spark.createDataFrame([(i, t, la, s, len(t or ""), 0, 0, "x") for i, t, la, s in odd], SCHEMA)
    return base.withColumn("size", F.lit(0).cast("long")).withColumn("v", F.lit(0).cast("long")).withColumn("n", F.lit("x")).unionByName(extra).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text, r.source) for r in docs.collect()]


def empty(docs):
    return docs.where("false")


def test_sharding(docs, rows):
    got = sharding.assign(docs).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    sizes = [len(by[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    want = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    shards, count = collections.defaultdict(set), collections.Counter()
    for r in got:
        shards[r.text_crc32].add(r.shard)
        count[r.text_crc32] += 1
    assert sum(len(shards[k]) > 1 for k, n in count.items() if 1 < n <= min(sizes)) <= 1
    assert sharding.assign(empty(docs)).count() == 0


def test_hot_group_fills_whole_shards(spark):
    d = spark.range(2400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    per = collections.Counter((r.shard, r.text_crc32 == zlib.crc32(b"same")) for r in sharding.assign(d).collect())
    assert {n for n in (per[s, True] + per[s, False] for s in range(24))} == {100}
    assert sum(per[s, True] == 100 for s in range(24)) >= 7


def test_sstable(docs, rows):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    folder = sstable.new_folder(docs)
    manifest = sstable.write(docs, path, 2, folder, shard_bytes=1 << 16)
    got = sstable.digest(manifest, 3).collect()
    start, want = 0, []
    for i, text, _ in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in got) == sorted(want)
    shards = manifest.collect()
    assert len(shards) > 1
    hits = [v for s in shards for v in sstable.Reader(s.path).get(sstable.key_bytes(9005))]
    assert len(hits) == 2
    assert not [v for s in shards for v in sstable.Reader(s.path).get(sstable.key_bytes(123456789))]
    assert sstable.digest(sstable.write(empty(docs), path, 2, sstable.new_folder(docs)), 2).count() == 0


def test_toxicity(spark, docs):
    texts = ["the people are idiot scum"] * 12 + ["the people are kind"] * 40 + ["idiot proof design"] * 12
    rows = spark.createDataFrame([(t, int("scum" in t)) for t in texts], "text string, toxic int")
    m = toxicity.train(rows, toxicity.Settings(min_z=2.0))
    got = {r.doc_id: r for r in toxicity.score(docs, m).collect()}
    assert 0 <= got[9001].score < 0.7 and got[9001].score == got[9002].score
    bad = spark.createDataFrame([(1, "word " * 5000 + "idiot scum!")], "doc_id long, text string")
    assert toxicity.score(bad, m).collect()[0].predicted == 1
    assert toxicity.score(empty(docs), m).count() == 0
    none = toxicity.train(rows.where("false"))
    assert toxicity.score(bad, none).collect()[0].score < 0.01


def test_machine_learns_a_pair_that_weights_miss():
    y = np.array([0, 0, 0, 1] * 50, float)
    rows, feats = [], []
    for i in range(200):
        for f in range(2):
            if i % 4 & (1 << f):
                rows.append(i)
                feats.append(f)
    m = toxicity._fit(np.arange(2), np.array(rows), np.array(feats), y, toxicity.Settings())
    p = m.score(np.array(rows), np.array(feats), 200)
    assert p[3] > 0.7 and max(p[0], p[1], p[2]) < 0.3
    assert m.v[0] @ m.v[1] > 0


def test_chat(spark):
    turns = [(1, 0, "user", "a|b\\c <|turn|> <|end|>\n</s>[INST]"), (1, 1, "assistant", "\\|\n"), (2, 0, None, None), (2, 0, "we\nird", "x"), (None, 0, "user", "n"), (3, 1, "assistant", "b"), (3, 0, "assistant", "<<SYS>>a")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("record", F.lit(1)).withColumn("turns", F.lit(2))
    out = chat.render(chat.canonical(chat.rows_to_records(table), "conv_id", rename_roles=False), "conv_id").cache()
    assert not [r for r in out.collect() if "[INST]" in r.formatted or "</s>" in r.formatted or "<<SYS>>" in r.formatted]
    by = collections.defaultdict(list)
    for c, t, r, x in turns:
        by[c].append((t, r or "", x or ""))
    for r in chat.digest(out).collect():
        want = sorted(by[r.conv_id])
        loss = "".join(x for _, role, x in want if role == "assistant")
        assert r.n_turns == len(want)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in want).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digest(chat.render(chat.canonical(chat.rows_to_records(table.where("false")), "conv_id"), "conv_id")).count() == 0


def test_chat_layouts(spark):
    records = ['{"instruction":"do","input":"x","output":"y"}', '{"conversations":[{"value":"q","from":"human"},{"from":"gpt","value":"a"}]}', '{"response":null,"prompt":"p"}', '{"other":1}', '{"messages":[{"role":"user","content":"m"}]}']
    t = spark.createDataFrame(list(enumerate(records)), "id int, j string").select("id", F.parse_json("j").alias("record"))
    got = {r.id: (r.layout, r.turns and [tuple(x) for x in r.turns]) for r in chat.canonical(t, "id").collect()}
    assert got[0] == ("instruction_input", [("user", "do\n\nx"), ("assistant", "y")])
    assert got[1] == ("share", [("user", "q"), ("assistant", "a")])
    assert got[2] == ("prompt_response", [("user", "p"), ("assistant", "")])
    assert got[3] == (None, None)
    assert got[4] == ("messages", [("user", "m")])


def test_mixing(docs, rows):
    got = mixing.plan(docs).collect()
    size = {(i, t): len(WORD.findall(t or "")) for i, t, _ in rows}
    assert collections.Counter((r.doc_id, r.size) for r in got) == collections.Counter((i, size[i, t]) for i, t, _ in rows)
    total = collections.Counter()
    for i, t, s in rows:
        total[s] += size[i, t]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    capped: set = set()
    while True:
        rest = sum(total.values()) - sum(3 * total[s] for s in capped)
        w = sum(weight[s] for s in total if s not in capped)
        target = {s: 3.0 * total[s] if s in capped else weight[s] * rest / w for s in total}
        more = {s for s in total if s not in capped and target[s] > 3 * total[s]}
        if not more:
            break
        capped |= more
    taken = collections.Counter()
    for r in got:
        assert r.source_size == total[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
        assert r.taken <= 3 * r.size
        taken[r.source] += r.taken
    largest = max(size.values())
    assert all(abs(taken[s] - target[s]) <= min(largest, max(1, total[s])) for s in total)
    again = mixing.plan(docs.repartition(7)).collect()
    assert collections.Counter((r.doc_id, r.taken) for r in got) == collections.Counter((r.doc_id, r.taken) for r in again)
    assert mixing.plan(empty(docs)).count() == 0


def test_sentencepiece(docs, rows):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    ref = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sentencepiece_codec.tokenise(docs, path).collect()
    assert all(r.parity for r in got)
    want = collections.Counter((i, tuple(ref.encode(t or ""))) for i, t, _ in rows)
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    codec = sentencepiece_codec.Codec(path)
    assert all(codec.decode(np.array(r.ids)) == ref.decode(list(r.ids)) for r in got[::5])
    assert sentencepiece_codec.round_trip(empty(docs), path).count() == 0


def test_perplexity(spark, docs):
    good = spark.createDataFrame([("the cat sat on the mat and the dog sat too.",)] * 40, "text string")
    m = perplexity.train(good, perplexity.Settings(alphabet=40))
    assert np.allclose(np.exp(m.logp).sum(-1), 1, atol=1e-4)
    p = perplexity.log_perplexity(["the cat sat", "$$$### %%%", "", None], m)
    assert p[0] < 1.5 < p[1] and p[2] == p[3]
    one = perplexity.log_perplexity(["the dog"], m)[0]
    assert abs(perplexity.log_perplexity(["x" * 50, "the dog", "y"], m)[1] - one) < 1e-9
    scores = perplexity.score(docs, m, ["doc_id", "lang"])
    judged = perplexity.verdicts(scores, perplexity.fences(scores, perplexity.Settings()), perplexity.Settings())
    assert judged.count() == docs.count() and judged.where("n_chars_scored = 0 AND NOT kept").count() == 0
    untrained = perplexity.train(good.where("false"), perplexity.Settings(alphabet=40))
    assert perplexity.reject(docs, untrained).count() == docs.count()
    assert perplexity.reject(empty(docs), m).columns == docs.columns


def brute_kneser_ney(texts):
    """log P(c0 | c2 c1) over all symbols of the texts, without any bound."""
    tri = collections.Counter()
    for t in texts:
        c = ["", "", *t, ""]
        tri.update(zip(c, c[1:], c[2:]))

    def order(counts):
        n1, n2, n3, n4 = (max(1, sum(n == k for n in counts.values())) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [min(max(x, 0.1), m - 0.1) for x, m in ((1 - 2 * y * n2 / n1, 1), (2 - 3 * y * n3 / n2, 2), (3 - 4 * y * n4 / n3, 3))]
        total, left = collections.Counter(), collections.Counter()
        for g, n in counts.items():
            total[g[:-1]] += n
            left[g[:-1]] += d[min(n, 3) - 1]
        return {g: (n - d[min(n, 3) - 1]) / total[g[:-1]] for g, n in counts.items()}, {h: left[h] / total[h] for h in total}

    two = collections.Counter(g[1:] for g in tri)
    one = collections.Counter(g[1:] for g in two)
    own3, back3 = order(tri)
    own2, back2 = order(two)
    total, size = sum(one.values()), max(128, len(one) + 1)

    def log_p(a, b, c):
        p = max(0, one[c,] - 0.5) / total + 0.5 * len(one) / total / size
        p = own2.get((b, c), 0) + back2.get((b,), 1) * p
        return np.log(own3.get((a, b, c), 0) + back3.get((a, b), 1) * p)

    return log_p


def test_perplexity_counts_everything(spark):
    """More trusted rows and code points than any fixed table holds; each counts."""
    rng = random.Random(3)
    texts = ["".join(chr(0x4E00 + int(rng.paretovariate(0.4)) % 3000) for _ in range(30)) for _ in range(400)] + ["plain latin text", "\0\ud7ff\U0010ffff"]
    m = perplexity.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    log_p = brute_kneser_ney(texts)
    for t in [*texts[::40], texts[-1], "\u0416\u0417 latin \u4e00\u4e01", ""]:
        c = ["", "", *t, ""]
        want = -sum(log_p(*g) for g in zip(c, c[1:], c[2:])) / (len(t) + 1)
        assert abs(perplexity.log_perplexity([t], m)[0] - want) < 1e-9
    ids = spark.range(21_000).select(F.col("id").alias("doc_id"))
    docs = ids.withColumn("text", F.lit("x"))
    assert perplexity.trusted_rows(docs, ids.withColumn("quality", F.lit(1))).count() == 21_000


def test_perplexity_tables_in_many_shards(spark, monkeypatch):
    texts = spark.createDataFrame([("the cat sat on the mat and the dog sat too.",), ("zebra quilt, vexing jump",)], "text string")
    whole = perplexity.train(texts)
    monkeypatch.setattr(perplexity, "SHARD_ROWS", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        cut = perplexity.train(texts)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(cut.shards[0]) > 4 > len(whole.shards[0])
    says = ["the cat", "jumping zebras!", ""]
    assert np.allclose(perplexity.log_perplexity(says, cut), perplexity.log_perplexity(says, whole), atol=1e-12)


def brute_quality(t):
    w = WORD.findall(t or "")
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    chars = max(1, sum(map(len, w)))
    bad = False
    for n, limit in quality_rules.NGRAM_LIMITS.items():
        known, hit = set(), set()
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            if g in known:
                hit |= set(range(i, i + n))
            known.add(g)
        bad |= sum(len(w[j]) for j in hit) / chars > limit
    seen, inside = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            inside += sum(map(len, WORD.findall(line))) if line in seen else 0
            seen.add(line)
    failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t or "")), dup, len(cover), failed, not failed and not bad and inside / chars <= 0.2


def test_quality_rules(docs, rows):
    got = quality_rules.profile(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = collections.Counter((i, *brute_quality(t)) for i, t, _ in rows)
    assert collections.Counter(tuple(r) for r in got) == want
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(v for k, v in want.items() if k[-1])
    assert quality_rules.profile(empty(docs)).count() == 0


def test_neighbours(spark):
    rng = np.random.RandomState(0)
    x = rng.normal(size=(400, 16))
    rows = [(i, [float(c) for c in v], 0.0) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[0][1], 1.0) for i in range(30)] + [(2000, None, 1.0), (2100, [0.0] * 16, 1.0), (2200, [float("nan")] * 16, 1.0), (2300, [1.0, None], 1.0), (2400, [1.0, 2.0], 1.0), (3000, rows[5][1], 1.0), (3000, rows[5][1], 1.0)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double")
    got = collections.defaultdict(list)
    for r in bitcodes.neighbours(t, F.col("vec_id") % 100 == 0, bitcodes.Settings(per_cell=100, probes=99)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    valid = sorted({(i, tuple(v)) for i, v, _ in rows if v and len(v) == 16 and all(np.isfinite(c) for c in v) and any(v)})
    hit = n = 0
    for q, v in valid:
        if q % 100 == 0:
            near = sorted((np.sqrt(sum((a - b) ** 2 for a, b in zip(v, u, strict=True))), i) for i, u in valid if i != q)[:10]
            assert [s for _, s in got[q]] == sorted(s for _, s in got[q])
            hit += len({i for _, i in near} & {i for i, _ in got[q]})
            n += 10
    assert hit >= 0.97 * n and set(got) == {q for q, _ in valid if q % 100 == 0}
    assert [i for i, _ in got[0]] == [1000 + i for i in range(10)]
    assert bitcodes.neighbours(t.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def brute_components(rows):
    sets = {}
    for i, t, _ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard(docs, rows):
    got = jaccard_join.cluster(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)
    assert jaccard_join.cluster(empty(docs)).count() == 0


def test_jaccard_hot_columns_and_copies(spark, docs, rows):
    """The same result where columns and copies are dealt over many tasks."""
    got = jaccard_join.cluster(docs, jaccard_join.Join(wide=1, copies=1)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows) and len(got) == len(rows)


def test_jaccard_names_that_sets_share(spark):
    """Where different sets have one short name, longer names keep them apart."""
    texts = [edited("a"), edited("a", 0), edited("b"), edited("b"), "one two", "three four", "five six seven eight nine ten", ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    base = d.selectExpr("doc_id AS id", "xxhash64(text) AS t", "text")
    _, vertices, shared = jaccard_join._vertices(base, jaccard_join.Join(name_bits=1))
    assert len(shared) == 2 and vertices.count() == 6
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.cluster(d, jaccard_join.Join(name_bits=1)).collect()}
    assert got == brute_components([(i, t, None) for i, t in enumerate(texts)])


def test_jaccard_family(spark):
    """Copies at the limit: edits of one text link through it and through each other."""
    rng = np.random.RandomState(1)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(60):
        w = list(base)
        for p in rng.choice(120, rng.randint(0, 4), replace=False):
            w[p] = f"x{rng.randint(1000)}"
        texts.append(" ".join(w[: 120 - rng.randint(0, 15)]))
    rows = [(i, t, None) for i, t in enumerate(texts)]
    d = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.cluster(d).collect()} == brute_components(rows)


def edited(name, *at):
    """A text of 100 words, some replaced."""
    w = [f"{name}{i}" for i in range(100)]
    for i in at:
        w[i] = f"edit{i}"
    return " ".join(w)


def test_jaccard_without_ids(spark):
    """A text found only under null ids links, and is the bridge between two that don't link with each other."""
    rows = [(5, edited("a", 70, 99)), (None, edited("a")), (7, edited("a", 0, 20)), (None, edited("b")), (None, edited("b", 0)), (None, edited("c"))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.component_id) for r in jaccard_join.cluster(d).collect())
    assert got == {(5, 5): 1, (7, 5): 1, (None, 5): 1, (None, None): 3}


def test_first_copies_of_null_and_repeated_ids(spark):
    import corpus_pipeline

    rows = [(None, edited("a"), "x"), (None, edited("b"), "x"), (None, edited("b", 0), "x"), (None, edited("b"), "x"), (1, edited("c"), "x"), (1, edited("d"), "x"), (1, edited("d"), "w"), (2, edited("d"), "a"), (3, edited("e"), "x"), (None, edited("e", 0), "a"), (4, " ", "x"), (5, "", "x"), (None, None, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = corpus_pipeline.keep_first_copies(spark, d, DIR)
    assert out.columns == d.columns
    got = sorted(map(repr, map(tuple, out.collect())))
    again = corpus_pipeline.keep_first_copies(spark, d.repartition(5), DIR)
    assert got == sorted(map(repr, map(tuple, again.collect())))
    b = [t for t in (edited("b"), edited("b", 0)) if repr((None, t, "x")) in got]
    assert len(b) == 1
    want = [(None, edited("a"), "x"), (None, b[0], "x"), (1, edited("c"), "x"), (1, edited("d"), "w"), (3, edited("e"), "x"), (4, " ", "x"), (5, "", "x"), (None, None, "x")]
    assert got == sorted(map(repr, want))


@pytest.mark.parametrize("name", ["op4_chat", "op10_jaccard"])
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = queries.queries()[name](spark, DIR)
    rel = c.sql(queries.oracle_sql()[name])
    at = [rel.columns.index(x) for x in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in rel.fetchall())


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    raw = {r.doc_id: (r.doc_id, r.text, r.source) for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    first = stages["quality rules"](spark, docs, DIR)
    assert {r.doc_id for r in first.collect()} == {i for i, t, _ in raw.values() if brute_quality(t)[-1]}
    second = stages["quality classifier"](spark, first, DIR).cache()
    third = stages["n-gram Jaccard join"](spark, second, DIR).cache()
    firsts = brute_components([raw[r.doc_id] for r in second.collect()])
    assert {r.doc_id for r in third.collect()} == {i for i, (_, c) in firsts.items() if c == i}
    fourth = stages["mixing sources"](spark, third, DIR)
    assert max(collections.Counter(r.doc_id for r in fourth.collect()).values()) <= 3
    assert third.columns == fourth.columns == docs.columns
    assert corpus_pipeline.run(spark, DIR).count() == fourth.count()


def test_token_table_forgets_and_grows():
    edge = re.compile("(?<=[!-~À-ÖØ-öø-ÿ])(?= [!-~À-ÖØ-öø-ÿ])|(?<=[A-Za-zÀ-ÖØ-öø-ÿ])(?=[!-&(-/:-@\\[-`{-~])")
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "Z", "9", " ", ".", "'", "é", "×", "÷", "日", "\n", "-"]) for _ in range(rng.randrange(40))) for _ in range(800)] + ["", "x" * 70]
    table = unitmemo.TokenTable(lambda units: [f"<{u}>".encode("utf-16-le") for u in units], np.dtype("<u2"), slots=64, most_ids=500)
    want = ["".join(f"<{u}>" for u in edge.split(x) if x).encode("utf-16-le") for x in texts]
    for step in (7, 802):
        got = []
        for at in range(0, len(texts), step):
            for _, _, s in textscan.slices(pa.array(texts[at : at + step])):
                got += table(s, sstable.unit_edges(s.data, s.offsets))
        assert got == want
