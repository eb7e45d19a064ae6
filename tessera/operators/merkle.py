"""A tree of hashes over a table in the order of its keys: one root whatever the layout, and ranges that differ between two states.

Rows are ordered by key and row hash. A row whose hash is divisible by ``leaf`` begins a range, so ranges follow from the rows
themselves: an insertion changes the range that it falls in and none after it. A range's hash is the SHA-256 of its ordered rows'
keys, hashes and numbers of repeats. The next levels do the same with ranges in place of rows, until one is left. Ranges have
``leaf`` or ``fan`` members on average, so none is gathered that grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.shared import written

FIELD, NULL = "\u001f", "\u0000"
#: Ranges that the root covers at most; their one row is put together in a task.
TOP = 4096


def row_hash(columns: list[str]) -> Column:
    return F.sha2(F.concat_ws(FIELD, *[F.coalesce(F.col(c).cast("string"), F.lit(NULL)) for c in columns]), 256)


def begins(hash_: Column, every: int) -> Column:
    """Whether a hash, by its first 60 bits, begins a range of ``every`` members on average."""
    return F.conv(F.substring(hash_, 1, 15), 16, 10).cast("long") % every == 0


def _ranges(rows: DataFrame, every: int) -> DataFrame:
    """``rows`` (key, hash, n) with ``first`` and ``first_hash``: the member that begins the range of each; null before any.

    Rows are sorted in partitions by range of keys. The last beginning of earlier partitions is one small row a partition.
    """
    spark = rows.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = written(rows.withColumn("b", begins(F.col("hash"), every)).repartitionByRange(n, "key", "hash").withColumn("p", F.spark_partition_id()), "ranges")
    mark = F.when(F.col("b"), F.struct("key", "hash"))
    last = dealt.groupBy("p").agg(F.max(mark).alias("last"))
    before = last.withColumn("carried", F.max("last").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1))).select("p", "carried")
    run = F.max(mark).over(W.partitionBy("p").orderBy("key", "hash").rowsBetween(W.unboundedPreceding, 0))
    # a row a partition on the right
    placed = dealt.withColumn("own", run).join(F.broadcast(before), "p").withColumn("at", F.coalesce("own", "carried"))
    return placed.select("key", "hash", "n", F.col("at.key").alias("first"), F.col("at.hash").alias("first_hash"))


def _fold(members: DataFrame) -> DataFrame:
    """A range's row from its members: first key, number of rows and hash."""
    listed = F.sort_array(F.collect_list(F.struct("key", "hash", "n")))
    text = F.array_join(F.transform("m", lambda x: F.concat_ws(FIELD, F.coalesce(x["key"].cast("string"), F.lit(NULL)), x["hash"], x["n"].cast("string"))), "\n")
    return members.groupBy("first", "first_hash").agg(listed.alias("m"), F.sum("n").alias("rows")).select(F.element_at("m", 1)["key"].alias("key"), F.sha2(text, 256).alias("hash"), F.col("rows").alias("n"))


def tree(rows: DataFrame, key: str, columns: list[str], leaf: int = 1024, fan: int = 64, levels: int | None = None) -> DataFrame:
    """(level, key, hash, n, parent): every range with its first key, hash and number of rows; level 0 are ranges of rows, the root is last.

    ``levels``: how many levels stand below the root; without it as many as leave at most ``fan`` ranges. ``parent``: first key of the range above.
    Equal rows count; null keys come first. An empty table has a root over nothing.
    """
    spark = rows.sparkSession
    base = rows.select(F.col(key).alias("key"), row_hash([key, *columns]).alias("hash")).groupBy("key", "hash").agg(F.count("*").alias("n"))
    done, level, each = None, 0, base
    while True:
        members = written(_ranges(each, leaf if level == 0 else fan), "members")
        nodes = written(_fold(members), "nodes")
        if level:
            above = members.select(F.col("key"), F.col("hash"), "first", "first_hash")
            starts = members.groupBy("first", "first_hash").agg(F.min(F.struct("key", "hash"))["key"].alias("parent"))
            linked = above.join(starts, above["first"].eqNullSafe(starts["first"]) & above["first_hash"].eqNullSafe(starts["first_hash"])).select("key", "hash", "parent")
            named = each.join(linked, each["key"].eqNullSafe(linked["key"]) & (each["hash"] == linked["hash"])).select(F.lit(level - 1).alias("level"), each["key"], each["hash"], "n", "parent")
            done = named if done is None else done.unionByName(named)
        each, level = nodes, level + 1
        count = nodes.count()
        if (count <= fan if levels is None else level >= levels) or count <= 1:
            if count > TOP:
                raise ValueError("too many ranges for one root: more levels or a greater fan")
            break
    last = each.select(F.lit(level - 1).alias("level"), "key", "hash", "n", F.first("key").over(W.orderBy("key", "hash")).alias("parent"))
    done = last if done is None else done.unionByName(last)
    # at most TOP rows
    root = _fold(each.withColumn("first", F.lit(None).cast(each.schema["key"].dataType)).withColumn("first_hash", F.lit(None).cast("string")))
    none = spark.createDataFrame([(None, None, 0)], root.schema).withColumn("hash", F.sha2(F.lit(""), 256))
    root = root.unionByName(none) if count == 0 else root
    return written(done.unionByName(root.select(F.lit(level).alias("level"), "key", "hash", "n", F.lit(None).cast(each.schema["key"].dataType).alias("parent"))), "tree")


def root(nodes: DataFrame) -> str:
    return nodes.orderBy(F.desc("level")).first().hash


def changed_ranges(before: DataFrame, after: DataFrame) -> DataFrame:
    """(side, key, n): ranges of rows of either tree that the other lacks; only ranges below a changed one are compared."""
    top = max(before.agg(F.max("level")).first()[0], after.agg(F.max("level")).first()[0])
    if root(before) == root(after):
        return before.where("false").select(F.lit("").alias("side"), "key", "n")

    def walk(own: DataFrame, other: DataFrame, side: str) -> DataFrame:
        open_ = None
        for level in range(top, -1, -1):
            nodes = own.where(F.col("level") == level)
            if open_ is not None:
                up = open_.select(F.col("key").alias("up")).distinct()
                nodes = nodes.join(up, nodes["parent"].eqNullSafe(up["up"]), "left_semi")
            known = other.where(F.col("level") == level).select(F.col("key").alias("k"), F.col("hash").alias("h")).distinct()
            lacking = nodes.join(known, nodes["key"].eqNullSafe(known["k"]) & (nodes["hash"] == known["h"]), "left_anti")
            # trees of unlike height agree on nothing above the lower one
            open_ = lacking if open_ is not None or not nodes.isEmpty() else None
        return open_.select(F.lit(side).alias("side"), "key", "n")

    return walk(before, after, "before").unionByName(walk(after, before, "after"))
