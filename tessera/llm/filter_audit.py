"""Filter interaction audit: what each filter of a chain removes, for every order of the filters.

Documents are counted by part and by which filters they fail. SQL CUBE over the failure flags and the part gives, from
the grouping sets whose chosen flags are all false, how many documents survive each subset of filters. A step of an order
leads from one subset to the next: what it removes is the difference of the two, so joins of pairs of subsets give every step.

Texts are compared by SHA-256. A null text counts as empty, a null language as the empty part. Only a document with an
id can fail for a copy, and only of a smaller id: rows that repeat one id and text are no copies of each other, and null
ids neither fail nor count. A document has a label if any row of ``labels`` with its id has it. Repeated rows count
each, texts are read whole, extra columns are ignored. An empty table has no parts and gives an empty result.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import discard, materialise

#: Characters that divide words, as a class of a regular expression.
SPACE = "[\\x20\\x09-\\x0D]+"
MAX_FILTERS = 6


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """Filters that look at one text: too few words, repeated words, capitals, symbols."""
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A to E, n, good, toxic): numbers of documents by part and failed filters, with those that have each label.

    Rows meet by text and id together, counted before they are dealt, so a text with many copies is no hot key; its
    least id is an aggregate. Where an id is null there is nothing to join, and its rows are dealt by text.
    """
    read = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("t"))
    worded = read.withColumn("w", F.array_remove(F.split("t", SPACE), ""))
    flags = text_failures(F.col("t"), F.col("w"))
    rows = worded.select("doc_id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), *[c.alias(k) for k, c in flags.items()])
    slim = materialise(rows.groupBy("doc_id", "part", "digest", *flags).agg(F.count("*").alias("n")), "flags")
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(0)
    least = slim.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("first", F.lit(True)).withColumn("salt", F.lit(0).cast("long"))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).withColumn("salt", F.lit(0).cast("long"))
    met = slim.withColumn("salt", salt).join(least, ["digest", "doc_id", "salt"], "left").join(known, ["doc_id", "salt"], "left")
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    out = met.groupBy("part", *flags, copy.alias("E")).agg(F.sum("n").alias("n"), *[F.coalesce(F.sum(F.when(F.col(k) == 1, F.col("n"))), F.lit(0)).alias(k) for k in ("good", "toxic")])
    counted = materialise(out, "failures")
    discard(slim)
    return counted


def survivors(counted: DataFrame, names: list[str]) -> DataFrame:
    """(part, subset, n, good, toxic): documents that pass every filter of the subset; bit i stands for ``names[i]``."""
    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    cube = counted.cube(*names, "part").agg(*sums, F.grouping("part").alias("all_parts"), *[F.grouping(f).alias(f"g_{f}") for f in names])
    chosen = F.lit(True)
    subset = F.lit(0)
    for i, f in enumerate(names):
        chosen = chosen & ((F.col(f"g_{f}") == 1) | ~F.col(f))
        subset = subset + F.when(F.col(f"g_{f}") == 0, 1 << i).otherwise(0)
    found = cube.where((F.col("all_parts") == 0) & chosen).select("part", subset.alias("subset"), "n", "good", "toxic")
    every = counted.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(names)) - 1))).alias("subset"))
    return every.join(found, ["part", "subset"], "left").na.fill(0, ["n", "good", "toxic"])


def audit(counted: DataFrame, names: list[str]) -> DataFrame:
    """One row a part, order of the filters and step; ``counted`` as ``failures`` returns it, with a flag column a name.

    ``kept``, ``removed``, ``good_lost``, ``toxic_lost``: after and by this step. ``redundant``: failing its filter, but
    removed before. ``unique_fails``: failing no other filter. ``shapley``: removed by its filter, summed over all orders.
    """
    if not 0 < len(names) <= MAX_FILTERS:
        raise ValueError(f"between 1 and {MAX_FILTERS} filters")
    spark = counted.sparkSession
    bit = {f: 1 << i for i, f in enumerate(names)}
    steps = [("".join(o), k + 1, o[k], sum(bit[f] for f in o[:k]), sum(bit[f] for f in o[: k + 1])) for o in itertools.permutations(names) for k in range(len(names))]
    # a number of rows that the number of filters fixes
    plan = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, f string, before int, after int"))
    alive = materialise(survivors(counted, names), "survivors")
    full = sum(bit.values())

    def at(subset: int) -> Column:
        return F.sum(F.when(F.col("subset") == subset, F.col("n")).otherwise(0))

    single = F.array(*[F.struct(F.lit(f).alias("f"), (at(0) - at(b)).alias("failing"), (at(full - b) - at(full)).alias("unique_fails")) for f, b in bit.items()])
    each = alive.groupBy("part").agg(single.alias("x")).select("part", F.inline("x"))
    start = alive.select("part", F.col("subset").alias("before"), *[F.col(c).alias(f"{c}0") for c in ("n", "good", "toxic")])
    end = alive.withColumnRenamed("subset", "after")
    step = start.join(plan, "before").join(end, ["part", "after"]).join(each, ["part", "f"])
    removed = F.col("n0") - F.col("n")
    return step.select(
        "part", "filter_order", "step", F.col("n").alias("kept"), removed.alias("removed"), (F.col("failing") - removed).alias("redundant"), "unique_fails",
        (F.col("good0") - F.col("good")).alias("good_lost"), (F.col("toxic0") - F.col("toxic")).alias("toxic_lost"), F.sum(removed).over(W.partitionBy("part", "f")).alias("shapley"),
    )
