"""Postings against loops over all documents, their upkeep, and what a search reads."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import containment, postings, retrieval
from tessera.operators.postings import Index, Layout

DOCS = "doc_id long, content string, source string"


def words(text):
    return list(dict.fromkeys(w.lower() for w in re.findall("[A-Za-z0-9][A-Za-z0-9._/-]+", text or "")))


def brute(docs, questions, k):
    """BM25 of every pair, without identifiers."""
    fields = {i: (words(c), words(s)) for i, c, s in docs}
    length = {i: len(a) + len(b) for i, (a, b) in fields.items()}
    mean = max(sum(length.values()) / max(len(docs), 1), 1)
    df = collections.Counter(t for a, b in fields.values() for t in {*a, *b})
    out = {}
    for q, text in questions:
        scores = []
        for i, (a, b) in fields.items():
            s = 0.0
            for t in words(text):
                tf = (t in a) * 1.0 + (t in b) * 3.0
                if tf:
                    s += math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * 2.5 * tf / (tf + 1.5 * (0.25 + 0.75 * length[i] / mean))
            if s > 0:
                scores.append((-round(s, 9), i, s))
        for r, (_, i, s) in enumerate(sorted(scores)[:k], 1):
            out[q, r] = (i, round(s, 8))
    return out


def found(df):
    return {(r.question_id, r["rank"]): (r.doc_id, round(r.score, 8)) for r in df.collect()}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(rng.choices(vocab, weights, k=rng.choice([0, 1, 3, 10, 40]))), f"src{i % 5} {rng.choice(vocab)}") for i in range(400)]
    docs += [(1000 + i, "w7 w8 w9", "same") for i in range(60)]  # ties
    questions = [(q, " ".join(rng.choices(vocab, k=rng.choice([1, 2, 6, 15])))) for q in range(25)] + [(100, "w7 w8"), (101, "nothing known"), (102, "?"), (103, " ".join(vocab))]
    return docs, questions


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory, corpus):
    i = Index(spark, str(tmp_path_factory.mktemp("index") / "i"), Layout(shards=3, block=8))
    i.build(spark.createDataFrame(corpus[0], DOCS))
    return i


@pytest.fixture(params=[0, 1 << 60], ids=["pruned", "direct"])
def path(request, monkeypatch):
    monkeypatch.setattr(postings, "DIRECT", request.param)


@pytest.mark.parametrize("k", [3, 1000])
def test_search(spark, index, corpus, path, k):
    asked = spark.createDataFrame(corpus[1], "question_id long, question string")
    assert found(index.search(asked, k)) == brute(*corpus, k)


def test_pruning_drops_most(spark, index, corpus, monkeypatch):
    """Long questions open fewer candidates than they have matches."""
    asked = spark.createDataFrame([(103, corpus[1][-1][1])], "question_id long, question string")
    seen = {}
    monkeypatch.setattr(postings, "DIRECT", 0)
    plain = postings.written

    def watch(df, name):
        out = plain(df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(postings, "written", watch)
    index.search(asked, 3).collect()
    every = len(brute(corpus[0], [corpus[1][-1]], 10_000))
    assert 3 <= seen["alive"] <= seen["opening"] < every


def test_texts_are_not_read(spark, index, corpus, tmp_path):
    path = str(tmp_path / "documents")
    spark.createDataFrame(corpus[0], DOCS).write.parquet(path)
    asked = spark.createDataFrame(corpus[1], "question_id long, question string")
    got = index.search(asked, 5, spark.read.parquet(path))
    assert found(got) == brute(*corpus, 5)
    assert path not in got._jdf.queryExecution().toString()


def test_upserts_equal_a_new_index(spark, tmp_path, corpus):
    docs, questions = corpus
    index = Index(spark, str(tmp_path / "i"), Layout(shards=3, block=8))
    index.build(spark.createDataFrame(docs, DOCS))
    asked = spark.createDataFrame(questions, "question_id long, question string")
    before = brute(docs, questions, 7)
    changed = [(3, "w1 w2 entirely new words", "src9"), (5, None, None), (2000, "w1 w59", "late"), (4, "", ""), (1001, "gone", "")]
    rows = spark.createDataFrame(changed, DOCS)
    index.upsert(rows, F.col("doc_id").isin(4, 1001), batch=("b", 0))
    index.upsert(rows, F.col("doc_id").isin(4, 1001), batch=("b", 0))
    assert index.table.version().number == 1
    after = [d for d in docs if d[0] not in {c[0] for c in changed}] + [c for c in changed if c[0] not in (4, 1001)]
    assert found(index.search(asked, 7)) == brute(after, questions, 7)
    # the version before still answers as it did
    assert found(index.search(asked, 7, version=0)) == before
    fresh = Index(spark, str(tmp_path / "j"), Layout(shards=3, block=8))
    fresh.build(spark.createDataFrame(after, DOCS))
    assert sorted(map(tuple, index.table.read().collect())) == sorted(map(tuple, fresh.table.read().collect()))


def test_average_length_counts_every_document(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"), Layout(("content",), 2))
    index.build(spark.createDataFrame([(1, "alpha beta"), (2, "")], "doc_id long, content string"))
    r = index.search(spark.createDataFrame([(1, "alpha")], "question_id long, question string"), 5).collect()
    want = math.log(1 + 1.5 / 1.5) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / 1))
    assert len(r) == 1 and abs(r[0].score - want) < 1e-12


def test_identifier_bonuses(spark, tmp_path):
    docs = spark.createDataFrame([(1, "an apple", "s"), (2, "see 26158-2010-gbt", "s"), (3, "see GB/T 26158 - 2010", "s"), (4, "grade TX1001", "x.pdf"), (5, "plain", "s")], DOCS)
    asked = spark.createDataFrame([(1, "happy tx1001 x.pdf"), (2, "GB/T 26158-2010 and GB/T 26158-2010"), (3, "?")], "question_id long, question string")
    index = Index(spark, str(tmp_path / "i"))
    index.build(docs)
    got = {(r.question_id, r.doc_id): r.score for r in index.search(asked, 10, docs).collect()}
    # "pp" inside words adds 2; a grade adds 6; a file name adds 2 beside its term
    assert got[1, 1] == 2.0 and got[1, 4] > 8.0 and (1, 5) not in got
    # both spellings of a standard have its stable number, once an occurrence, and its id, once
    assert got[2, 2] >= 18.0 and got[2, 3] >= 18.0 and not [k for k in got if k[0] == 3]


def test_empty(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    index.build(spark.createDataFrame([], DOCS))
    asked = spark.createDataFrame([(1, "alpha")], "question_id long, question string")
    assert index.search(asked, 5).count() == 0
    index.upsert(spark.createDataFrame([(1, "alpha", "s")], DOCS))
    assert found(index.search(asked, 5))[1, 1][0] == 1
    assert index.search(asked.where("false"), 5).count() == 0


@pytest.mark.parametrize("most", [1 << 20, 8])
def test_occurrences(spark, most):
    texts = [(1, "abcabc", None), (2, "bc", "x"), (3, None, "zabc"), (4, "", ""), (1, "again bc", None), (5, None, None)]
    patterns = ["abc", "bc", "c", "x", "", None, "none", "abc", "日本"]
    got = containment.occurrences(spark.createDataFrame(texts, "id long, a string, b string"), "id", ["a", "b"], spark.createDataFrame([(p,) for p in patterns], "pattern string"), most)
    want = collections.Counter((i, p) for i, a, b in texts for p in {p for p in patterns if p is not None and any(c is not None and p in c for c in (a, b))})
    assert collections.Counter(map(tuple, got.collect())) == want


NAMES = ["a b.pdf", "", "dir/", "n_1 (2).md", "p/q.md", "X\\AB.pdf", "x", "my/dir", "q/N12.MD", "z/q.md", "/", None, "deep/a b.pdf/more", "x", "日/本.md"]


@pytest.mark.parametrize("kind", list(containment.FORMS))
def test_match_pairs_are_those_of_the_predicate(spark, kind):
    e = spark.createDataFrame([(n,) for n in NAMES], "source string")
    want = e.withColumnRenamed("source", "expected").distinct().join(e.withColumnRenamed("source", "actual").distinct(), F.lit(True), "cross").where(retrieval.matches(kind, F.col("expected"), F.col("actual")))
    got = containment.match_pairs(kind, e, e)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
