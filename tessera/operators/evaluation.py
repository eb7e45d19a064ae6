"""Ranked-list metrics, run summaries, slices, stability, gates and paired statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.stats import values_at


def ir_metrics(ranked: DataFrame, relevant: DataFrame, cuts: tuple[int, ...] = (5, 10), ndcg_at: int = 10) -> DataFrame:
    """Precision (over what is returned), recall at cuts, reciprocal rank over the whole list and nDCG (log2), to 4 places.

    ``ranked`` (question_id, rank, source) may name a source often; each row counts, as in a list of chunks.
    """
    n = relevant.groupBy("question_id").agg(F.countDistinct("source").alias("n_rel"))
    hit = relevant.select("question_id", "source", F.lit(1).alias("hit")).distinct()
    rows = ranked.join(hit, ["question_id", "source"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    at = lambda c, v: F.sum(F.when(F.col("rank") <= c, v))
    got = rows.groupBy("question_id").agg(*[at(c, F.lit(1)).alias(f"r{c}") for c in cuts], *[at(c, F.col("hit")).alias(f"h{c}") for c in cuts], F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), at(ndcg_at, F.col("hit") / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(ndcg_at)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    out = n.join(got, "question_id", "left")
    four = lambda c, name: F.round(F.coalesce(c, F.lit(0.0)), 4).alias(name)
    return out.select("question_id", *[four(F.col(f"h{c}") / F.col(f"r{c}"), f"precision_at_{c}") for c in cuts], *[four(F.col(f"h{c}") / F.col("n_rel"), f"recall_at_{c}") for c in cuts], four(1 / F.col("first"), "mrr"), four(F.col("dcg") / ideal, f"ndcg_at_{ndcg_at}"))


def source_ranking(ranked: DataFrame) -> DataFrame:
    got = ranked.groupBy("question_id", "source").agg(F.min("rank").alias("first_rank"), F.count("*").alias("chunk_count"))
    return got.withColumn("source_rank", F.row_number().over(W.partitionBy("question_id").orderBy("first_rank", "source")))


def recall_curve(expected: DataFrame, sources: DataFrame, cuts: tuple[int, ...] = (5, 10, 20, 30)) -> DataFrame:
    """Micro recall by source and the rate of questions with all sources, at each cut."""
    rows = expected.join(sources, ["question_id", "source"], "left")
    each = rows.groupBy("question_id").agg(*[F.bool_and(F.coalesce(F.col("first_rank") <= c, F.lit(False))).alias(f"all_{c}") for c in cuts], *[F.count_if(F.coalesce(F.col("first_rank") <= c, F.lit(False))).alias(f"n_{c}") for c in cuts], F.count("*").alias("n"))
    return each.agg(*[F.round(F.sum(f"n_{c}") / F.sum("n"), 4).alias(f"recall_at_{c}") for c in cuts], *[F.round(F.avg(F.col(f"all_{c}").cast("int")), 4).alias(f"all_present_at_{c}") for c in cuts])


def run_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Status rates, latency percentiles and means with their own denominators."""
    rate = {s: F.round(F.avg((F.col("status") == s).cast("int")), 4) for s in ("completed", "provider_timeout", "provider_error")}
    got = rows.groupBy(*by).agg(F.count("*").alias("n"), *[v.alias(f"{s}_rate") for s, v in rate.items()], F.round(F.max("latency"), 3).alias("latency_max"), F.round(F.avg("metric"), 3).alias("metric_mean"), F.count("metric").alias("metric_n"))
    lat = values_at(rows, by, "latency", {"latency_p50": ("nearest", 0.5), "latency_p95": ("nearest", 0.95)})
    return got.join(lat, by, "left").select(*by, "n", *[f"{s}_rate" for s in rate], *[F.round(c, 3).alias(c) for c in ("latency_p50", "latency_p95")], "latency_max", "metric_mean", "metric_n")


def slice_metrics(rows: DataFrame, dims: list[str], metrics: list[str], unstable: DataFrame | None = None) -> DataFrame:
    """One grouping set a dimension and metric: mean, observations and distinct questions.

    ``unstable`` (question_id): questions left out of question_count and of mean_excluding_flaky, not of mean and sample_size.
    """
    if unstable is not None:
        rows = rows.join(unstable.select("question_id", F.lit(True).alias("out")).distinct(), "question_id", "left").withColumn("out", F.coalesce("out", F.lit(False)))
    else:
        rows = rows.withColumn("out", F.lit(False))
    long = rows.unpivot(["question_id", "out", *dims], metrics, "metric", "value")
    known = F.when(F.col("value").isNotNull() & ~F.col("out"), F.col("question_id"))
    got = long.groupingSets([[F.col(d), F.col("metric")] for d in dims], *dims, "metric").agg(F.round(F.avg("value"), 3).alias("mean"), F.count("value").alias("sample_size"), F.countDistinct(known).alias("question_count"), F.round(F.avg(F.when(~F.col("out"), F.col("value"))), 3).alias("mean_excluding_flaky"), *[F.grouping(d).alias(f"g_{d}") for d in dims])
    kind, group = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d in dims:
        kind, group = F.when(F.col(f"g_{d}") == 0, F.lit(d)).otherwise(kind), F.when(F.col(f"g_{d}") == 0, F.col(d)).otherwise(group)
    return got.select(kind.alias("dimension"), group.alias("group"), "metric", "mean", "mean_excluding_flaky", "sample_size", "question_count")


def flaky(rows: DataFrame, verdict: str) -> DataFrame:
    """Questions whose verdicts disagree: flips t * f of n (n - 1) / 2 pairs; nulls are no verdict."""
    got = rows.groupBy("question_id").agg(F.count_if(F.col(verdict)).alias("t"), F.count_if(~F.col(verdict)).alias("f"))
    n = F.col("t") + F.col("f")
    return got.where(n >= 2).select("question_id", (F.col("t") * F.col("f")).alias("flips"), (n * (n - 1) / 2).cast("long").alias("pairs"), F.round(F.col("t") * F.col("f") / (n * (n - 1) / 2), 4).alias("share"), (F.col("t") * F.col("f") > 0).alias("flaky"))


def comparability(runs: DataFrame, limit: float = 0.10) -> DataFrame:
    """Spread of each metric over runs; unstable beyond the limit with two values or more."""
    got = runs.groupBy("metric").agg(F.count("value").alias("n"), F.round(F.max("value") - F.min("value"), 6).alias("spread"))
    return got.withColumn("unstable", (F.col("n") >= 2) & (F.col("spread") > limit))


def gates(deltas: DataFrame, groups: DataFrame) -> DataFrame:
    """A verdict a group and metric: ok, breach, no_baseline or not_evaluated; a group passes if nothing is a breach.

    ``groups`` (group_name, metric, allowed_change, direction, declared). A group that was not declared must not move at
    all; a declared one may move within a band, or as far down as it likes where lower is better. A metric without a row
    in ``deltas`` is not evaluated, one with a null delta has no baseline.
    """
    rows = groups.join(deltas.withColumn("here", F.lit(True)), ["metric"], "left")
    still = F.col("delta") == 0
    within = F.when(F.col("direction") == "lower_is_better", F.col("delta") <= F.col("allowed_change")).when(F.col("declared"), F.abs("delta") <= F.col("allowed_change")).otherwise(still)
    scope = F.col("declared") | still
    verdict = F.when(F.col("here").isNull(), "not_evaluated").when(F.col("delta").isNull(), "no_baseline").when(within & scope, "ok").otherwise("breach")
    rows = rows.withColumn("verdict", verdict).withColumn("reason", F.when(F.col("verdict") == "breach", F.when(~scope, "out_of_scope").otherwise("beyond_tolerance")))
    passed = lambda w: F.bool_and(F.col("verdict") != "breach").over(w)
    return rows.select("group_name", "metric", F.round("delta", 4).alias("delta"), "verdict", "reason", passed(W.partitionBy("group_name")).alias("group_passed"))


CELL = ["case_set", "question_id", "round"]


def paired(rows: DataFrame, arms: tuple[str, str]) -> DataFrame:
    """One row a cell (case set, question, round): both arms' values, last attempt first.

    ``complete``: whether both arms completed; cells without are the dropped ones and have null values.
    """
    last = rows.groupBy(*CELL, "arm").agg(F.max_by(F.struct("status", "metric"), "seq").alias("r"))
    done = lambda a: F.bool_or((F.col("arm") == a) & (F.col("r.status") == "completed"))
    wide = last.groupBy(*CELL).agg(*[F.max(F.when(F.col("arm") == a, F.col("r.metric"))).alias(n) for a, n in zip(arms, ("x", "y"), strict=True)], (done(arms[0]) & done(arms[1])).alias("complete"))
    wide = wide.select(*CELL, "complete", F.when(F.col("complete"), F.col("x")).alias("before"), F.when(F.col("complete"), F.col("y")).alias("after"))
    return wide.withColumn("diff", F.col("after") - F.col("before"))


def unit_statistics(pairs: DataFrame) -> DataFrame:
    """Mean of a question first, then over questions: mean, sample deviation, error, interval, detectable effect.

    A unit is a question of a case set. Counts of better and tied pairs are over cells.
    """
    known = pairs.where("diff IS NOT NULL")
    unit = known.groupBy("case_set", "question_id").agg(F.avg("diff").alias("d"), F.avg("before").alias("x"), F.avg("after").alias("y"))
    got = unit.agg(F.count("*").alias("units"), F.avg("d").alias("m"), F.stddev_samp("d").alias("sd"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    se = F.col("sd") / F.sqrt("units")
    cells = pairs.agg(F.count("diff").alias("pairs"), F.count_if(~F.col("complete")).alias("dropped"), F.round(F.avg("diff"), 3).alias("mean_by_pair"), F.count_if(F.col("diff") > 0).alias("wins"), F.count_if(F.col("diff") < 0).alias("losses"), F.count_if(F.col("diff") == 0).alias("ties"))
    # one row on either side
    return got.select("units", F.round("x", 3).alias("before_mean"), F.round("y", 3).alias("after_mean"), F.round("m", 3).alias("mean"), F.round("sd", 4).alias("sd"), F.round(se, 4).alias("se"), F.round(F.col("m") - 1.96 * se, 4).alias("low"), F.round(F.col("m") + 1.96 * se, 4).alias("high"), F.round(1.96 * se, 4).alias("mde")).join(F.broadcast(cells), F.lit(True))


def pair_statistics(pairs: DataFrame) -> DataFrame:
    """The same over cells as if they were independent, for contrast; a single cell has deviation 0."""
    got = pairs.where("diff IS NOT NULL").agg(F.count("*").alias("pairs"), F.avg("diff").alias("m"), F.coalesce(F.stddev_samp("diff"), F.lit(0.0)).alias("sd"))
    se = F.col("sd") / F.sqrt("pairs")
    return got.select("pairs", F.round("m", 3).alias("mean"), F.round("sd", 4).alias("sd"), F.round(se, 4).alias("se"), F.round(1.96 * se, 4).alias("mde"))


def round_stability(rows: DataFrame) -> DataFrame:
    """Cells (case set, question, arm) with several observations and how many of them changed."""
    cell = rows.where("metric IS NOT NULL").groupBy("case_set", "question_id", "arm").agg(F.count("*").alias("seen"), F.countDistinct("metric").alias("values"))
    return cell.groupBy("arm").agg(F.count("*").alias("cells"), F.count_if(F.col("seen") > 1).alias("multi_round"), F.count_if(F.col("values") > 1).alias("changed"))


def provider_gate(rows: DataFrame, pairs: DataFrame, max_error: float = 0.10, max_timeout: float = 0.10, min_share: float = 0.60) -> DataFrame:
    """Strict limits on errors and timeouts, a least share of cells that both arms completed, and no empty round."""
    each = rows.groupBy("round").agg(F.count("*").alias("n"), *[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "provider_error", "provider_timeout")])
    got = each.agg(F.sum("n").alias("n"), F.sum("provider_error").alias("e"), F.sum("provider_timeout").alias("t"), F.count_if(F.col("completed") == 0).alias("empty_rounds"))
    cells = pairs.agg(F.count_if("complete").alias("paired"), F.count("*").alias("cells"))
    got = got.join(F.broadcast(cells), F.lit(True)).select((F.coalesce("e", F.lit(0)) / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))).alias("error"), (F.coalesce("t", F.lit(0)) / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))).alias("timeout"), F.coalesce(F.col("paired") / F.nullif("cells", F.lit(0)), F.lit(0.0)).alias("share"), "empty_rounds")
    checks = {"paired_cell_share": F.col("share") >= min_share, "provider_error_rate": F.col("error") < max_error, "provider_timeout_rate": F.col("timeout") < max_timeout, "rounds_with_no_completions": F.col("empty_rounds") == 0}
    failed = F.filter(F.array(*[F.when(~c, F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull())
    return got.select(F.round("error", 6).alias("error"), F.round("timeout", 6).alias("timeout"), F.round("share", 3).alias("share"), "empty_rounds", F.array_join(failed, ",").alias("failed"), (F.size(failed) == 0).alias("passed"))


def pooled_hops(rows: DataFrame) -> DataFrame:
    """(question_id, matched, total, ratio): hops counted, not a mean of ratios; the whole has a null question.

    ``rows`` (question_id, matched): one row a hop of an applicable answer.
    """
    hit = F.count_if("matched")
    return rows.rollup("question_id").agg(hit.alias("matched"), F.count("*").alias("total"), F.round(hit / F.count("*"), 3).alias("ratio"))


def latency_by_arm(rows: DataFrame) -> DataFrame:
    return rows.groupBy("arm").agg(F.round(F.avg("latency"), 3).alias("mean"), F.round(F.expr("percentile(latency, 0.5)"), 3).alias("median"), F.round(F.max("latency"), 3).alias("longest"))
