"""Which of many strings stand in which texts: one pass over the texts by an automaton, in place of a test of every pair.

All patterns are sent to every task as one Aho-Corasick automaton, after their bytes were counted; more than ``MOST_BYTES`` of
them are dealt into several automata, each with a pass of its own. Rows are distinct (id, pattern) pairs. Null texts and
patterns meet nothing; the empty pattern stands in every text, as in SQL.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Bytes of patterns in one automaton; it takes some tens of times as much memory.
MOST_BYTES = 4 << 20


def _automaton(patterns: list[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for p in patterns:
        if p:
            a.add_word(p, p)
    if len(a):
        a.make_automaton()
    return a


def _pass(texts: DataFrame, id_col: str, columns: list[str], patterns: list[str]) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(patterns)
    kind = dict(texts.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = sent.value
        a, empty = _automaton(given), "" in given
        for batch in batches:
            at, found = [], []
            columns_ = [c.to_pylist() for c in batch.columns[1:]]
            for i in range(len(batch)):
                seen: set[str] = set()
                for c in columns_:
                    if c[i] is not None:
                        if empty:
                            seen.add("")
                        if len(a):
                            seen.update(p for _, p in a.iter(c[i]))
                at += [i] * len(seen)
                found += sorted(seen)
                # a batch of texts may meet many patterns
                if len(found) > 1 << 16:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], [id_col, "pattern"])
                    at, found = [], []
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], [id_col, "pattern"])

    return texts.select(id_col, *columns).mapInArrow(run, f"{id_col} {kind}, pattern string")


def occurrences(texts: DataFrame, id_col: str, columns: list[str], patterns: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(id, pattern): the strings of ``patterns`` (pattern) that stand in any of the columns of a text."""
    known = written(patterns.select("pattern").where("pattern IS NOT NULL").distinct(), "patterns")
    n = max(1, -(-(known.agg(F.sum(F.octet_length("pattern") + 1)).collect()[0][0] or 0) // most_bytes))
    out = None
    for r in range(n):
        # about most_bytes, by the number of rounds
        some = [x[0] for x in known.where(F.pmod(F.xxhash64("pattern"), F.lit(n)) == r).collect()]
        got = _pass(texts, id_col, columns, some)
        out = got if out is None else out.unionAll(got)
    return out


def _slashed(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "\\\\", "/"))


def _name(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


#: Of each matcher: the normal form of a path, and which tests hold. ``within``: the expected form stands in the actual one.
FORMS = {
    "basename": (_slashed, ("name",)),
    "basename_or_contains": (lambda c: F.regexp_replace(_slashed(c), "\\s+", ""), ("name", "within")),
    "bidirectional": (lambda c: F.regexp_replace(_slashed(c), "/+$", ""), ("name", "within", "around", "filled")),
    "stripped": (lambda c: F.regexp_replace(_slashed(c), "[\\s_+\\-()\\[\\]{}（）【】]", ""), ("name", "within", "name_within")),
    "substring": (lambda c: c, ("within",)),
}


def match_pairs(kind: str, expected: DataFrame, actual: DataFrame, expected_col: str = "source", actual_col: str = "source") -> DataFrame:
    """(expected, actual): all pairs of distinct strings of the two sides that the named matcher takes, as ``retrieval.matches`` does.

    Names meet by an equi-join and containment by automata, so no pair is formed that does not match by itself.
    """
    form, tests = FORMS[kind]
    e = written(expected.select(F.col(expected_col).alias("expected")).distinct().withColumn("e", form(F.col("expected"))), "expected").where("e IS NOT NULL")
    a = written(actual.select(F.col(actual_col).alias("actual")).distinct().withColumn("a", form(F.col("actual"))), "actual").where("a IS NOT NULL")
    if "filled" in tests:
        e, a = e.where("e <> ''"), a.where("a <> ''")
    pairs = []
    if "name" in tests:
        pairs.append(e.withColumn("n", _name(F.col("e"))).join(a.withColumn("n", _name(F.col("a"))), "n"))
    if "within" in tests:
        pairs.append(occurrences(a, "a", ["a"], e.select(F.col("e").alias("pattern"))).withColumnRenamed("pattern", "e").join(a, "a").join(e, "e"))
    if "around" in tests:
        pairs.append(occurrences(e, "e", ["e"], a.select(F.col("a").alias("pattern"))).withColumnRenamed("pattern", "a").join(a, "a").join(e, "e"))
    if "name_within" in tests:
        named = e.withColumn("n", _name(F.col("e")))
        pairs.append(occurrences(a, "a", ["a"], named.select(F.col("n").alias("pattern"))).withColumnRenamed("pattern", "n").join(a, "a").join(named, "n"))
    out = pairs[0].select("expected", "actual")
    for p in pairs[1:]:
        out = out.union(p.select("expected", "actual"))
    return out.distinct()


def match_join(kind: str, expected: DataFrame, actual: DataFrame, on: list[str], column: str = "source") -> DataFrame:
    """Rows of ``expected`` with the rows of ``actual`` of the same ``on`` whose column matches; both sides' columns beside ``on`` differ in name but for ``column``."""
    pairs = match_pairs(kind, expected, actual, column, column)
    left = expected.withColumnRenamed(column, "expected").join(pairs, "expected")
    return left.join(actual.withColumnRenamed(column, "actual"), [*on, "actual"])
