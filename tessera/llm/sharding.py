"""Balanced label propagation: linked documents move to their neighbours' shards under exact quotas.

Documents with equal texts are linked. Every document starts in a shard by hash. In each round the members of a
group ask for the shard that already holds most of them, among shards with room; requests are admitted, largest
gain first, up to the room left; rounds go on until nobody moves. Equal members of a group in one shard are one row with a count, so a group of any
size costs at most one row a shard, and rounds join and sum these rows only. Documents without links fill what
is left: a last pass pours what exceeds a shard's quota into the free slots, so that row counts differ by one at most.

Null texts count as empty and as equal to each other. Ties go to the lower shard. Repeated rows are documents
of their own. Extra columns are ignored. An empty table gives an empty result. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import discard, materialise, running_sum


@dataclass(frozen=True)
class Settings:
    shards: int = 24
    #: Rows that one task may rank together.
    per_bucket: int = 50_000


GROUP = ["g1", "g2"]


def _at(values: list[int], index) -> F.Column:
    return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), (index + 1).cast("int"))


def prepare(docs: DataFrame, cfg: Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 8
    crc = F.crc32(text.cast("binary")).cast("long")
    key = F.xxhash64(F.col(id_col), crc)
    return docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), F.xxhash64(text).alias("g1"), F.xxhash64(F.lit(7), text).alias("g2"), F.pmod(key, F.lit(cfg.shards)).cast("int").alias("s0"), F.shiftrightunsigned(key, 20).alias("h"))


def propagate(state: DataFrame, quota: list[int], cfg: Settings) -> DataFrame:
    """Rounds over (g1, g2, shard, c) until no member can move to more of its kind; returns the last state.

    Each move makes the sum of squares of c larger, so the rounds end.
    """
    per = W.partitionBy(*GROUP)
    deal = max(64, -(-state.count() // (cfg.shards * cfg.per_bucket)))
    while True:
        load = dict(state.groupBy("shard").agg(F.sum("c").alias("c")).collect())
        free = [q - load.get(s, 0) for s, q in enumerate(quota)]
        room = _at(free, F.col("shard"))
        best = F.max(F.when(room > 0, F.struct("c", (-F.col("shard")).alias("s")))).over(per)
        asked = state.withColumn("best", best).withColumn("to", -F.col("best.s"))
        moves = (F.col("best.c") > F.col("c")) | ((F.col("best.c") == F.col("c")) & (F.col("to") < F.col("shard")))
        wish = asked.where(F.col("best").isNotNull() & moves).select(*GROUP, "shard", "c", "to", F.col("best.c").alias("gain"))
        # larger gains in earlier buckets: powers of two, each dealt over many
        bucket = (64 - F.floor(F.log2(F.col("gain") + 1))) * deal + F.pmod(F.col("g1"), F.lit(deal))
        prior = running_sum(wish, ["to"], bucket.cast("int"), [F.desc("gain"), *[F.col(g) for g in GROUP], F.col("shard")], F.col("c"), "prior")
        moved = prior.withColumn("m", F.least("c", F.greatest(F.lit(0), _at(free, F.col("to")) - F.col("prior")))).where("m > 0")
        moved = materialise(moved.select(*GROUP, "shard", "to", "m"), "moves")
        if moved.isEmpty():
            discard(moved)
            return state
        parts = state.select(*GROUP, "shard", "c").union(moved.select(*GROUP, "shard", -F.col("m"))).union(moved.select(*GROUP, F.col("to"), "m"))
        old, state = state, materialise(parts.groupBy(*GROUP, "shard").agg(F.sum("c").alias("c")).where("c > 0"), "state")
        discard(old, moved)


def cut_edges(assigned: DataFrame, group: list[str]) -> DataFrame:
    """(groups, split, edges, cut): groups of linked rows, those in several shards, pairs of linked rows and pairs apart."""
    per = assigned.groupBy(*group, "shard").agg(F.count(F.lit(1)).alias("c"))
    each = per.groupBy(*group).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("shards"), F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("inside")).where("n > 1")
    edges = F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0))
    return each.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("shards") > 1).alias("split"), edges.cast("long").alias("edges"), (edges - F.coalesce(F.sum("inside"), F.lit(0.0))).cast("long").alias("cut"))


def assign(docs: DataFrame, cfg: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row."""
    slim = materialise(prepare(docs, cfg, id_col, text_col), "slim")
    n = slim.count()
    quota = [n // cfg.shards + (s < n % cfg.shards) for s in range(cfg.shards)]
    salts = max(1, -(-n // cfg.per_bucket))
    slim = slim.withColumn("salt", F.pmod("h", F.lit(salts)).cast("int"))
    keys = [*GROUP, "s0", "salt"]
    per = W.partitionBy(*GROUP)
    parts = slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).withColumn("all", F.sum("c").over(per)).where("all > 1")
    parts = materialise(parts.withColumn("before", F.sum("c").over(per.orderBy("s0", "salt")) - F.col("c")), "parts")
    start = parts.groupBy(*GROUP, F.col("s0").alias("shard")).agg(F.sum("c").alias("c"))
    state = propagate(materialise(start, "state"), quota, cfg)
    # each group's members in order fill its shards in order
    ends = state.withColumn("end", F.sum("c").over(per.orderBy("shard"))).groupBy(*GROUP).agg(F.sort_array(F.collect_list(F.struct("end", "shard"))).alias("ends"))
    plan = parts.join(ends, GROUP).select(*keys, "before", "ends")
    ranked = slim.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy("doc_id", "size")))
    placed = ranked.join(plan, keys, "left")
    label = F.when(F.col("ends").isNull(), F.col("s0")).otherwise(F.expr("filter(ends, e -> e.end >= before + rn)[0].shard"))
    placed = placed.select("doc_id", "size", "text_crc32", "h", label.alias("label"), F.col("ends").isNull().alias("single"))
    placed = materialise(placed, "placed")
    held = dict(placed.groupBy("label").count().collect())
    held = [held.get(s, 0) for s in range(cfg.shards)]
    deal = max(32, -(-n // (cfg.shards * cfg.per_bucket)))
    bucket = F.when(F.col("single"), deal).otherwise(0) + F.pmod("h", F.lit(deal)).cast("int")
    slots = running_sum(placed, ["label"], bucket, [F.col("doc_id"), F.col("size"), F.col("text_crc32")], F.lit(1), "at")
    spare, over = [0], [0]
    for s in range(cfg.shards):
        over.append(over[-1] + max(0, held[s] - quota[s]))
        spare.append(spare[-1] + max(0, quota[s] - held[s]))
    stays = F.col("at") < _at(quota, F.col("label"))
    r = F.col("at") - _at(quota, F.col("label")) + _at(over, F.col("label"))
    free_shard = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in spare[1:]]), lambda e: e <= r)).cast("int")
    out = slots.withColumn("shard", F.when(stays, F.col("label")).otherwise(free_shard))
    slot = F.when(stays, F.col("at")).otherwise(_at(held, F.col("shard")) + r - _at(spare, F.col("shard")))
    return out.select("doc_id", "size", "text_crc32", "shard", slot.cast("long").alias("slot"))
