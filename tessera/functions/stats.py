"""Percentile conventions and small-sample tests, each under its own name. All are native expressions and joins."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Each convention's place, from 0, in n sorted values for a share p.
PLACES: dict[str, Callable[[Column, float], Column]] = {
    "nearest": lambda n, p: F.bround(p * (n - 1)),
    "floored": lambda n, p: F.floor(p * (n - 1)),
    "cut": lambda n, p: F.greatest(F.lit(0), F.floor(p * n) - 1),
    "lower_median": lambda n, p: F.floor((n - 1) / 2),
}
#: Groups below this size are looked at whole; in larger ones only values near the share are told apart.
WHOLE, NEAR, ACCURACY = 20_000, 5e-4, 10_000


def values_at(rows: DataFrame, by: list[str], value: str, picks: dict[str, tuple[str, float]]) -> DataFrame:
    """(by, names of picks): exact values at the places of conventions and shares, e.g. ``{"p95": ("nearest", .95)}``.

    Quantile sketches bracket each place; what lies below a bracket is only counted, so no group's values meet in one task.
    Nulls are left out; a group without values has no row.
    """
    known = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("v"))
    shares = {k: 0.5 if kind == "lower_median" else p for k, (kind, p) in picks.items()}
    sketch = [F.percentile_approx("v", [max(0.0, p - NEAR), min(1.0, p + NEAR)], ACCURACY).alias(f"q_{k}") for k, p in shares.items()]
    bounds = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sketch)

    def pick(k: str) -> Column:
        whole = F.col("n") < WHOLE
        lo, hi = (F.when(~whole, F.col(f"q_{k}")[i]) for i in (0, 1))
        return F.struct(F.lit(k).alias("name"), lo.alias("lo"), hi.alias("hi"), PLACES[picks[k][0]](F.col("n"), picks[k][1]).cast("long").alias("place"))

    small = bounds.select(*[F.col(c).alias(f"g_{c}") for c in by], F.array(*map(pick, picks)).alias("k"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"g_{c}"))
    each = known.join(small, same).select(*by, "v", F.explode("k").alias("k")).where("k.hi IS NULL OR v <= k.hi")
    counts = each.groupBy(*by, "k.name", "k.place", F.when(F.col("k.lo").isNull() | (F.col("v") >= F.col("k.lo")), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(W.partitionBy(*by, "name").orderBy(F.col("v").asc_nulls_first())))
    return upto.where("upto > place").groupBy(*by).agg(*[F.min(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in picks])


def average_ranks(rows: DataFrame, by: list[str], value: str, out: str = "avg_rank") -> DataFrame:
    """Ranks from 1 with ties at their mean rank."""
    ties = W.partitionBy(*by, value)
    return rows.withColumn(out, F.rank().over(W.partitionBy(*by).orderBy(value)) + (F.count("*").over(ties) - 1) / 2)


def normal_cdf(z: Column) -> Column:
    """The normal distribution by a polynomial of the error function, good to 1e-7."""
    x = F.abs(z) / math.sqrt(2)
    k = 1 / (1 + 0.3275911 * x)
    erf = 1 - k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429)))) * F.exp(-x * x)
    return 0.5 * (1 + F.signum(z) * erf)


def signed_rank_counts(n: int = 20) -> list[tuple[int, int, int]]:
    """(n, sum, ways): how many sign patterns of ranks 1..n reach at most each sum, for every n up to 20."""
    ways, out = [1], []
    for k in range(1, n + 1):
        ways = [(ways[s] if s < len(ways) else 0) + (ways[s - k] if s >= k else 0) for s in range(len(ways) + k)]
        total = 0
        for s, w in enumerate(ways):
            total += w
            out.append((k, s, total))
    return out


def wilcoxon(pairs: DataFrame, by: str, diff: str) -> DataFrame:
    """(by, n, statistic, p_value, significant) of non-zero differences.

    Up to 20 of them p counts sign patterns of the ranks 1..n whatever the ties, with the statistic cut to a whole number;
    beyond, the normal approximation without correction for ties.
    """
    ranked = average_ranks(pairs.where(f"{diff} <> 0").withColumn("__a", F.abs(diff)), [by], "__a")
    half = lambda c: F.coalesce(F.sum(F.when(c, F.col("avg_rank"))), F.lit(0.0))
    sums = ranked.groupBy(by).agg(F.count("*").alias("n"), half(F.col(diff) > 0).alias("plus"), half(F.col(diff) < 0).alias("minus"))
    sums = sums.withColumn("statistic", F.least("plus", "minus")).withColumn("whole", F.floor("statistic"))
    # a fixed table of 1,560 rows
    known = pairs.sparkSession.createDataFrame(signed_rank_counts(), "m int, s int, ways long")
    got = sums.join(F.broadcast(known), (F.col("n") == F.col("m")) & (F.col("whole") == F.col("s")), "left")
    n = F.col("n").cast("double")
    z = (F.col("statistic") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    p = F.least(F.lit(1.0), F.when(n <= 20, 2 * F.col("ways") / F.pow(F.lit(2.0), n)).otherwise(2 * normal_cdf(z)))
    return got.select(by, "n", F.round("statistic", 3).alias("statistic"), F.round(p, 4).alias("p_value"), (p < 0.05).alias("significant"))


def binomial_tail(n: Column, k: Column) -> Column:
    """P(at most k of n fair coins); n up to 1000."""
    first = F.pow(F.lit(2.0), -n.cast("double"))
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    step = lambda s, i: F.struct((s["t"] * (n - i + 1) / i).alias("t"), (s["sum"] + s["t"] * (n - i + 1) / i).alias("sum"))
    return F.aggregate(steps, F.struct(first.alias("t"), first.alias("sum")), step)["sum"]


def mcnemar(pairs: DataFrame, by: str, before: str, after: str) -> DataFrame:
    """(by, b, c, p_value, method): exact two-sided binomial on discordant pairs; chi-square with continuity beyond 1000."""
    counts = pairs.groupBy(by).agg(F.count_if(F.col(before) & ~F.col(after)).alias("b"), F.count_if(~F.col(before) & F.col(after)).alias("c"))
    n, low = F.col("b") + F.col("c"), F.least("b", "c")
    chi = F.pow(F.abs(F.col("b") - F.col("c")) - 1, F.lit(2)) / n
    p = F.when(n == 0, 1.0).when(n > 1000, 2 * (1 - normal_cdf(F.sqrt(chi)))).otherwise(F.least(F.lit(1.0), 2 * binomial_tail(n, low)))
    method = F.when(n == 0, "none").when(n > 1000, "chi2_approx").otherwise("exact")
    return counts.select(by, "b", "c", F.round(p, 4).alias("p_value"), method.alias("method"))


def choose_test(kind: Column) -> Column:
    """The paired test that a metric of this kind can support."""
    return F.when(kind == "binary", "mcnemar_exact").otherwise("wilcoxon")
