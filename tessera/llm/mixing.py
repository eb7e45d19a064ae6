"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its weight's part of all words; what exceeds ``most`` times its size is shared out again by
weight. Whole epochs come first; the rest of a target is filled by documents in order of exponential keys scaled
by quality weights (smallest first), as far as the running sum of sizes stays within the rest. A last document
is taken if that brings the sum nearer to the target.

Keys come from a hash of the row, so reruns agree. Where a source's rest ends is found by narrowing: sums of sizes by
ever finer parts of the key, each over the rows of the part before in which the rest ends. Only that last part, at most
``per_bucket`` rows, is ranked row by row, so no source is gathered in one task whatever its keys. Every other row is
decided where it is read. Null texts have size 0; a null source is a source, last in order. Empty sources have target 0.
Rows alike share a key and are ordered by a row number, so each is planned on its own and which is taken
does not matter. Extra columns, of any name, are ignored (``plan``) or kept (``mix``). DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import discard, join_small, materialise


@dataclass(frozen=True)
class Settings:
    #: Weights of the sources in code point order, repeating.
    weights: tuple[int, ...] = (1, 2, 3)
    share: float = 1.0
    most: int = 3
    #: Rows of a source that one task may rank together.
    per_bucket: int = 2_000


#: Ever finer parts of the order of rows: bits of the key, then of the row number.
PARTS = (("k", 46), ("k", 34), ("k", 22), ("k", 10), ("k", 0), ("rid", 33), ("rid", 21), ("rid", 9), ("rid", 0))


def word_count(text: str) -> Column:
    return F.coalesce(F.expr(f"regexp_count({text}, '[^\\\\x20\\\\x09-\\\\x0D]+')"), F.lit(0)).cast("long")


def quality(text: str) -> Column:
    """A weight from 0.05 to 1: less for texts full of symbols."""
    marks = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.coalesce(F.greatest(F.lit(0.05), 1 - 4 * marks / F.greatest(F.length(text), F.lit(1))), F.lit(0.05))


def targets(sizes: DataFrame, cfg: Settings) -> DataFrame:
    """(source, source_size, target): shares by weight with the excess over ``most`` sizes filled up elsewhere.

    In order of cap over weight the capped sources come first; the level of the others follows from running sums.
    One row a source.
    """
    w = F.element_at(F.array(*map(F.lit, cfg.weights)), (F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(cfg.weights))) + 1).cast("int"))
    base = sizes.withColumn("w", w.cast("double")).withColumn("cap", (cfg.most * F.col("source_size")).cast("double"))
    order = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = cfg.share * F.sum("source_size").over(whole)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest_w = F.sum("w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    level = base.withColumn("level", (total - before) / rest_w).withColumn("k", F.row_number().over(order))
    level = level.withColumn("full", F.col("w") * F.col("level") >= F.col("cap"))
    free = F.min(F.when(~F.col("full"), F.struct("k", "level"))).over(whole)
    level = level.withColumn("free", free)
    target = F.when(F.col("free").isNull() | (F.col("k") < F.col("free.k")), F.col("cap")).otherwise(F.col("w") * F.col("free.level"))
    return level.select("source", "source_size", target.alias("target"))


def _keyed(docs: DataFrame, keep: Column) -> DataFrame:
    """(doc, source, size, k, rid) in the shared folder: what is kept of a row, and its place in the order of its source."""
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "source", "size", F.xxhash64("text")), 11) + 0.5) / float(1 << 53)
    rows = docs.select(keep.alias("doc"), "doc_id", "source", "text", word_count("text").alias("size"), quality("text").alias("quality"))
    # an exponential key of at most 37 / 0.05, as a whole number
    rows = rows.select("doc", "source", "size", (-F.log(u) / F.col("quality") * float(1 << 52)).cast("long").alias("k"), F.monotonically_increasing_id().alias("rid"))
    return materialise(rows, "keyed")


def _goals(rows: DataFrame, cfg: Settings) -> DataFrame:
    """(src, source_size, target, epochs, rest, done, k0, k1, rid0, rid1), one row a source: the part in which its rest ends and what comes before."""
    sizes = materialise(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("open")), "sizes")
    goal = targets(sizes, cfg).join(sizes.select(F.col("source").alias("s"), "open"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "src")
    edges = [F.lit(x).cast("long").alias(n) for n, x in (("done", 0), ("k0", 0), ("k1", (1 << 63) - 1), ("rid0", 0), ("rid1", (1 << 63) - 1))]
    kept = ["src", "source_size", "target", "epochs", "rest"]
    goal = materialise(goal.select(*kept, "open", *edges), "goal")
    for c, shift in PARTS:
        wide = goal.where(F.col("open") > cfg.per_bucket)
        if wide.isEmpty():
            break
        inside = _with_goal(rows.select("source", "size", "k", "rid"), wide, "inner").where(_inside())
        sums = inside.groupBy("src", F.expr(f"shiftright({c}, {shift})").alias("b")).agg(F.sum("size").alias("v"), F.count(F.lit(1)).alias("n"))
        sums = sums.withColumn("upto", F.sum("v").over(W.partitionBy("src").orderBy("b")))
        sums = join_small(sums, wide.select(F.col("src").alias("s"), "rest", "done"), F.col("src").eqNullSafe(F.col("s")), "inner")
        # if rounding leaves the rest beyond the last part, it ends there
        at = F.struct((F.col("done") + F.col("upto") <= F.col("rest")).alias("beyond"), F.when(F.col("done") + F.col("upto") <= F.col("rest"), -F.col("b")).otherwise(F.col("b")).alias("o"), "b", "n", (F.col("upto") - F.col("v")).alias("before"))
        edge = sums.groupBy(F.col("src").alias("s")).agg(F.min(at).alias("e"))
        tight = goal.join(edge, F.col("src").eqNullSafe(F.col("s")), "left")
        low = F.expr(f"shiftleft(e.b, {shift})")
        new = {c + "0": low, c + "1": low + (1 << shift), "open": F.col("e.n"), "done": F.col("done") + F.col("e.before")}
        old, goal = goal, materialise(tight.select(*[F.when(F.col("e").isNotNull(), new[n]).otherwise(F.col(n)).alias(n) if n in new else F.col(n) for n in goal.columns]), "goal")
        discard(old)
    discard(sizes)
    return goal.drop("open")


def _inside() -> Column:
    return (F.col("k") >= F.col("k0")) & (F.col("k") < F.col("k1")) & (F.col("rid") >= F.col("rid0")) & (F.col("rid") < F.col("rid1"))


def _with_goal(rows: DataFrame, goal: DataFrame, how: str) -> DataFrame:
    """Rows with their source's goal: one row a source, so rows stay where they are unless there are over a million sources."""
    return join_small(rows, goal, F.col("source").eqNullSafe(F.col("src")), how)


def _copies(rows: DataFrame, cfg: Settings) -> DataFrame:
    """``rows`` with source_size, target and copies."""
    goal = _goals(rows, cfg)
    slim = _with_goal(rows.select("source", "size", "k", "rid"), goal, "inner").where(_inside())
    per = W.partitionBy("src")
    order = per.orderBy("k", "rid")
    mid = slim.withColumn("upto", F.col("done") + F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    mid = mid.withColumn("r", F.row_number().over(order)).withColumn("in", F.col("upto") <= F.col("rest"))
    mid = mid.withColumn("gap", F.col("rest") - F.coalesce(F.max(F.when(F.col("in"), F.col("upto"))).over(per), F.col("done")))
    off = F.abs(F.col("gap") - F.col("size"))
    pick = F.min(F.when(~F.col("in") & (off < F.col("gap")), F.struct(off.alias("o"), F.col("r").alias("r")))).over(per)
    mid = mid.withColumn("pick", pick).where(F.col("in") | (F.col("r") == F.col("pick.r"))).select(F.col("rid").alias("picked"))
    mid = materialise(mid, "picked")
    out = join_small(_with_goal(rows, goal, "inner"), mid, F.col("rid") == F.col("picked"))
    before = (F.col("k") < F.col("k0")) | ((F.col("k") < F.col("k1")) & (F.col("rid") < F.col("rid0")))
    return out.withColumn("copies", F.col("epochs") + (before | F.col("picked").isNotNull()).cast("long"))


def plan(docs: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies) of every row; copies of a document are whole."""
    rows = _copies(_keyed(docs, F.col("doc_id")), cfg)
    return rows.select(F.col("doc").alias("doc_id"), "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix(docs: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. Ids need not be unique: rows are numbered, not joined by id."""
    rows = _copies(_keyed(docs, F.struct(*docs.columns)), cfg).where("copies > 0")
    return rows.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")
