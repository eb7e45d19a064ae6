"""Decontamination and the audit of filters against loops."""

import collections
import hashlib
import itertools
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination, filter_audit, queries, textscan

DIR = "/root/testdata/sf0.001"
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SPAN = " ".join(f"w{i}" for i in range(30))
ITEMS = [(1, SPAN), (2, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 then more"), (3, "short item"), (4, ""), (5, None), (None, "nameless rows hit too"), (6, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"), (6, "second row of six"), (10, "é日本 ONE-two"), (7, "x " * 9000 + "the end of a very long item comes only here at last")]
TEXTS = [(1, f"before {SPAN.upper()} after"), (2, "w0, w1; w2-w3 w4 (w5) w6 w7 w8 w9"), (3, "w1 w2 w3 w4 w5 w6 w7 w8 w9"), (4, "a short item and a short\nitem"), (5, None), (6, ""), (7, "!?"), (8, "nameless rows hit too"), (9, "É日本 one TWO é日本 one two"), (9, "é日本 one two"), (9, "é日本 one two"), (None, SPAN), (None, None), (10, "of a very long item comes only here at last"), (11, SPAN + " gap " + SPAN), (12, "Kelvin K short item"), (13, "clean text without any hit at all, of more than ten words in all"), (14, "short item " * 5000)]


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORDS.findall(low)


def brute(texts, items):
    known = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(len(w), 10)
        for k in range(len(w) - n + 1 if n else 0):
            known[tuple(w[k : k + n])].add(i)
    sizes = {len(k) for k in known}
    out = []
    for i, t in texts:
        w = words(t)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in known:
                    hit |= set(range(k, k + n))
                    found |= {str(x) for x in known[tuple(w[k : k + n])] if x is not None}
        out.append((i, len(w), len(hit), sorted(found), hit))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("items", F.lit("clash")).withColumn("n_words", F.lit(0)).withColumn("t", F.lit(None).cast("binary"))
    return docs.cache(), spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("piece", F.lit(1)).cache()


@pytest.mark.parametrize("round_bytes", [8 << 20, 4000, 300])
def test_scan(tables, round_bytes):
    docs, items = tables
    got = decontamination.scan(docs, items, decontamination.Settings(round_bytes=round_bytes)).collect()
    flat = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], [x for a, b in zip(r.starts, r.ends, strict=True) for x in range(a, b)]) for r in got), key=repr)
    assert flat == sorted(((i, n, k, x, sorted(h)) for i, n, k, x, h in brute(TEXTS, ITEMS)), key=repr)


@pytest.mark.parametrize("round_bytes", [8 << 20, 300])
def test_removal(tables, round_bytes):
    docs, items = tables
    cfg = decontamination.Settings(round_bytes=round_bytes)
    kept = decontamination.remove_documents(docs, items, cfg=cfg)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(((i, t) for (i, t), r in zip(TEXTS, brute(TEXTS, ITEMS), strict=True) if not r[2]), key=repr)
    cut = decontamination.remove_spans(docs, items, cfg=cfg)
    assert cut.columns == docs.columns
    by = {r.doc_id: r.text for r in cut.collect() if r.doc_id not in (9, None)}
    assert by[1] == "before  after" and by[4] == "a  and a " and by[11] == " gap " and by[5] is None and by[6] == "" and by[3] == TEXTS[2][1] and by[2] == ""
    assert by[13] == TEXTS[16][1]
    assert decontamination.remove_documents(docs, items, max_hit=0.95, cfg=cfg).where("doc_id = 1").count() == 1


def test_windows_that_share_a_hash(spark, tables, monkeypatch):
    found = decontamination.WindowSet(pa.array([t or "" for _, t in ITEMS]), [None if i is None else str(i) for i, _ in ITEMS], 10)
    monkeypatch.setattr(textscan.Slice, "span_hash", lambda self, a, b, seed=0: np.full(len(a), 7, np.uint64))
    same = decontamination.WindowSet(pa.array([t or "" for _, t in ITEMS[:7]]), [str(i) for i, _ in ITEMS[:7]], 10)
    assert len(set(same.hash.tolist())) < len(same.hash) < len(found.hash)
    for _, _, s in textscan.slices(pa.array([t for _, t in TEXTS[:4]]), True, decontamination.GAP):
        at, entry = same.find(s)
        hit = collections.defaultdict(set)
        for w, e in zip(at.tolist(), entry.tolist(), strict=True):
            text = int(np.searchsorted(s.bounds, w, "right")) - 1
            hit[text] |= set(range(w - int(s.bounds[text]), w - int(s.bounds[text]) + int(same.length[e])))
        assert [hit[k] for k in range(4)] == [r[4] for r in brute(TEXTS[:4], ITEMS[:7])]


def test_no_rows(tables):
    docs, items = tables
    assert decontamination.scan(docs.where("false"), items).count() == 0
    assert {(r.n_hit, tuple(r["items"])) for r in decontamination.scan(docs, items.where("false")).collect()} == {(0, ())}
    assert decontamination.remove_spans(docs, items.where("false")).count() == len(TEXTS)


LONG = "word other " * 20000
DOCS = [(1, "en", "a b"), (2, "en", "a b"), (2, "en", "a b"), (3, None, "a b"), (None, "en", "a b"), (None, None, None), (4, "de", None), (5, "de", ""), (6, "de", "ABC def"), (7, "fr", LONG), (8, "fr", LONG), (9, "fr", " ".join(f"w{i}" for i in range(300))), (10, "fr", "x # y"), (9, "en", "a b"), (0, "es", "x # y"), (None, "es", LONG)]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (4, 1, None), (7, 1, 1), (None, 1, 1), (9, 1, 1), (99, 1, 1)]


def audit_loop(docs, labels):
    out = collections.Counter()
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    rows = []
    for i, lang, text in docs:
        t = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t)}
        fails["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, _, u in docs)
        rows.append((lang or "", fails, i in good, i in toxic))
    keys = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    for part in {r[0] for r in rows}:
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order):
                x = dict.fromkeys(keys, 0)
                for p, fails, g, tx in rows:
                    if p != part:
                        continue
                    gone = any(fails[o] for o in order[:step])
                    x["kept"] += not gone and not fails[f]
                    x["removed"] += not gone and fails[f]
                    x["redundant"] += gone and fails[f]
                    x["unique_fails"] += fails[f] and sum(fails.values()) == 1
                    x["good_lost"] += not gone and fails[f] and g
                    x["toxic_lost"] += not gone and fails[f] and tx
                out[part, order, step + 1] = tuple(x[k] for k in keys)
    total = collections.Counter()
    for (part, order, step), x in out.items():
        total[part, order[step - 1]] += x[1]
    return {(p, o, s, *x, total[p, o[s - 1]]) for (p, o, s), x in out.items()}


def test_audit(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, lang string, text string").withColumn("part", F.lit("clash")).withColumn("A", F.lit(1)).withColumn("n", F.lit("x"))
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("good", F.lit(7))
    got = filter_audit.audit(filter_audit.failures(docs, labels), list("ABCDE"))
    assert set(map(tuple, got.collect())) == audit_loop(DOCS, LABELS)
    assert filter_audit.audit(filter_audit.failures(docs.where("false"), labels), list("ABCDE")).count() == 0
    assert sum(r.removed for r in filter_audit.audit(filter_audit.failures(docs, labels.where("false")), list("AB")).where("filter_order = 'AB'").collect()) > 0


def test_audit_of_two_filters(spark):
    counted = spark.createDataFrame([("p", True, False, 3, 1, 0), ("p", True, True, 2, 0, 2), ("q", False, False, 5, 5, 5)], "part string, x boolean, y boolean, n long, good long, toxic long")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.audit(counted, ["x", "y"]).collect()}
    assert got["p", "xy", 1] == (0, 5, 0, 3, 1, 2, 8) and got["p", "xy", 2] == (0, 0, 2, 0, 0, 0, 2)
    assert got["p", "yx", 1] == (3, 2, 0, 0, 0, 2, 2) and got["p", "yx", 2] == (0, 3, 2, 3, 1, 0, 8)
    assert got["q", "yx", 2] == (5, 0, 0, 0, 0, 0, 0)
    with pytest.raises(ValueError):
        filter_audit.audit(counted, [])


@pytest.mark.parametrize("name", ["op12_decontamination", "op13_filter_audit"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = queries.queries()[name](spark, DIR)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(want.select(*cols).fetchall())
