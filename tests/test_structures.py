"""Trees of hashes and pairs that share words, on small tables."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import conflicts, merkle

ROWS = [(i, f"text {i % 37}") for i in range(600)] + [(600, None), (None, "no id"), (None, "no id"), (601, "twice"), (601, "twice"), (601, "again")]
SCHEMA = "id long, text string"


def nodes(df, **kw):
    return merkle.tree(df, "id", ["text"], **({"leaf": 16, "fan": 4} | kw))


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_layout_does_not_matter(spark):
    first = nodes(spark.createDataFrame(ROWS, SCHEMA).coalesce(1))
    again = nodes(spark.createDataFrame(random.Random(1).sample(ROWS, len(ROWS)), SCHEMA).repartition(7))
    assert same(first, again)
    by = collections.defaultdict(list)
    for r in first.collect():
        by[r.level].append(r)
    top = max(by)
    assert top >= 2 and len(by[top]) == 1 and all(sum(r.n for r in by[k]) == len(ROWS) for k in by)
    assert max(r.n for r in by[0]) < 200 and len(by[0]) > 10


@pytest.mark.parametrize("change", ["swap", "repeat", "insert"])
def test_changes_show_and_are_found(spark, change):
    rows = list(ROWS)
    if change == "swap":
        rows[100], rows[101] = (100, rows[101][1]), (101, rows[100][1])
    elif change == "drop":
        del rows[300]
    elif change == "repeat":
        rows.append(rows[5])
    elif change == "insert":
        rows.append((250, "another of that id"))
    else:
        rows[7] = (7, None)
    a, b = nodes(spark.createDataFrame(ROWS, SCHEMA)), nodes(spark.createDataFrame(rows, SCHEMA))
    assert merkle.root(a) != merkle.root(b)
    got = merkle.changed_ranges(a, b).collect()
    # few of many ranges
    assert 0 < len([r for r in got if r.side == "before"]) <= 3 and 0 < len([r for r in got if r.side == "after"]) <= 3
    keys = sorted({r.key for r in got if r.key is not None})
    lost = {100: "swap", 300: "drop", 5: "repeat", 250: "insert", 7: "null"}
    at = next(k for k, v in lost.items() if v == change)
    assert not keys or keys[0] <= at


def test_equal_and_empty_trees(spark):
    a = nodes(spark.createDataFrame(ROWS, SCHEMA))
    assert merkle.changed_ranges(a, a).count() == 0
    none = nodes(spark.createDataFrame([], SCHEMA))
    assert len(merkle.root(none)) == 64 and merkle.root(none) != merkle.root(a)
    one = nodes(spark.createDataFrame([(1, "x")], SCHEMA))
    assert [r.n for r in one.collect()] == [1, 1]
    got = merkle.changed_ranges(none, one).collect()
    assert [(r.side, r.key, r.n) for r in got] == [("after", 1, 1)]


def pairs(rows, differ):
    out = set()
    for g, k, w, n in rows:
        for g2, k2, w2, n2 in rows:
            if g == g2 and k < k2 and set(w) & set(w2) and differ((k, n), (k2, n2)):
                out.add((g, k, k2, tuple(sorted(set(w) & set(w2)))))
    return out


@pytest.mark.parametrize("wide", [500, 3])
def test_sharing_pairs(spark, wide):
    rng = random.Random(2)
    vocab = ["hot"] + [f"w{i}" for i in range(12)]
    rows = [(g, k, ["hot", *rng.sample(vocab, rng.randint(0, 4))] if k % 3 else rng.sample(vocab, 2), k % 4) for g in range(3) for k in range(30)]
    rows += [(9, 1, [], 0), (9, 2, ["a"], 1)]
    d = spark.createDataFrame(rows, "g long, k long, w array<string>, n long")
    got = conflicts.sharing_pairs(d, "g", "k", "w", F.col("x.n") != F.col("y.n"), wide).collect()
    flat = [(r.g, r.a, r.b, tuple(r.shared)) for r in got]
    assert len(flat) == len(set(flat)) and set(flat) == pairs(rows, lambda a, b: a[1] != b[1])
    plan = conflicts.sharing_pairs(d, "g", "k", "w", F.lit(True), wide)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert conflicts.sharing_pairs(d.where("false"), "g", "k", "w", F.lit(True)).count() == 0


def test_containing_terms(spark):
    rows = [(1, "abc"), (1, "b"), (1, "b"), (2, "abc"), (2, "zz"), (3, "zz"), (3, "z"), (1, None)]
    got = conflicts.containing_terms(spark.createDataFrame(rows, "g long, t string"), "g", "t").collect()
    assert {tuple(r) for r in got} == {(1, "abc", "b"), (3, "zz", "z")}
