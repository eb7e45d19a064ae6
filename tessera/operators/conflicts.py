"""Pairs of rows of a group that share a word, by an inverted index of words.

Rows of a group with the same words stand in blocks, so what words share is found once for two blocks, not for all pairs of their
rows. Blocks meet at words, rarest first: a pair is made once, at the rarest word that it shares, so common words add only pairs
that share nothing rarer. A word of many rows is split: its blocks are dealt into parts, and parts meet part by part. The number
of tasks follows from the pairs that can meet, since few bytes of rows make many pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .retrieval import join_small

#: Rows of one word of a group that meet in one task.
WIDE = 2000
#: Rows of a block, about.
BLOCK = 64
#: Pairs of rows that meet in a task, about, and tasks in which they meet, at most.
MEET, TASKS = 2_000_000, 10_000


def sharing_pairs(rows: DataFrame, group: str, key: str, words: str, differ: Column, wide: int = WIDE, shown: Callable[[Column], Column] = F.array_sort) -> DataFrame:
    """(group, a, b, shared): pairs of rows of a group with a < b that share words and for which ``differ`` holds.

    ``rows`` has one row a group and key; ``differ`` is a condition on structs ``x`` and ``y`` with the columns of both rows but
    group and words, alike in either order. Rows without words meet nothing. ``shown`` makes ``shared`` of the array of shared words.
    """
    base = written(rows.where(F.col(key).isNotNull()).withColumn(words, F.array_sort(F.array_distinct(words))), "rows")
    alike = base.groupBy(group, words).agg(F.count("*").alias("__n"))
    nth = F.pmod(F.xxhash64(key), F.ceil(F.col("__n") / BLOCK)).alias("nth")
    dealt = base.join(alike, [group, words]).select(F.col(group), F.col(words).alias("words"), nth, F.struct(*[c for c in base.columns if c not in (group, words)]).alias("r"))
    # written, since the ids are of one computation
    blocks = written(dealt.groupBy(group, "words", "nth").agg(F.collect_list("r").alias("rs")).withColumn("id", F.monotonically_increasing_id()), "blocks")
    each = blocks.select(group, "id", F.size("rs").alias("n"), F.explode("words").alias("word"))
    often = each.groupBy(group, "word").agg(F.sum("n").alias("often"))
    # a row costs some pairs by itself
    meet = often.agg(F.sum(F.col("often") * (F.col("often") + 8.0))).first()[0] or 0
    tasks = max(min(math.ceil(meet / MEET), TASKS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # each block's words, rarest first
    ordered = each.join(often, [group, "word"]).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("often", "word"))).alias("o"))
    listed = blocks.join(ordered, "id").select(group, "id", "rs", F.transform("o", lambda x: x["word"]).alias("ws"), F.explode("o").alias("w"))
    post = listed.select(group, F.struct("id", "rs", "ws").alias("r"), "w.word", F.ceil(F.col("w.often") / wide).cast("int").alias("parts"))
    own = post.withColumn("i", F.pmod(F.xxhash64("r.id"), F.col("parts")).cast("int"))
    # a part meets every later part and itself
    left = own.select(group, "word", "i", F.explode(F.sequence("i", F.col("parts") - 1)).alias("j"), F.col("r").alias("x"))
    right = own.select(group, "word", F.col("i").alias("j"), F.explode(F.sequence(F.lit(0), "i")).alias("i"), F.col("r").alias("y"))
    at = [group, "word", "i", "j"]
    if meet > MEET:  # else Spark sees from the bytes what is best
        left, right = left.repartition(tasks, *at), right.repartition(tasks, *at)
    met = left.join(right, at).where((F.col("i") < F.col("j")) | (F.col("x.id") <= F.col("y.id")))
    shared = F.array_intersect("x.ws", "y.ws")
    kept = met.where(F.element_at(shared, 1) == F.col("word")).select(group, shown(shared).alias("shared"), (F.col("x.id") == F.col("y.id")).alias("same"), F.col("x.rs").alias("xs"), F.col("y.rs").alias("ys"))
    pairs = kept.select(group, "shared", "same", "ys", F.explode("xs").alias("x")).select(group, "shared", "same", "x", F.explode("ys").alias("y"))
    got = pairs.where(~F.col("same") | (F.col(f"x.{key}") < F.col(f"y.{key}"))).where(f"x.{key} <> y.{key}").where(differ)
    return got.select(group, F.least(f"x.{key}", f"y.{key}").alias("a"), F.greatest(f"x.{key}", f"y.{key}").alias("b"), "shared")


def containing_terms(terms: DataFrame, group: str, term: str) -> DataFrame:
    """(group, term, part): terms of a group that hold another term of it; strings meet in an automaton, groups by a join."""
    from . import containment

    once = written(terms.select(group, term).distinct(), "terms")
    names = once.select(F.col(term).alias("t")).distinct()
    pairs = containment.occurrences(names, "t", ["t"], names.select(F.col("t").alias("pattern"))).where("t <> pattern")
    outer = join_small(once.withColumnRenamed(term, "t"), pairs, ["t"])
    return outer.join(once.withColumnRenamed(term, "pattern"), [group, "pattern"]).select(group, F.col("t").alias("term"), F.col("pattern").alias("part"))
