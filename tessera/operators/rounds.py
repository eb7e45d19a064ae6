"""Summaries of evaluation rounds: span-level retrieval metrics, delivery and refusal rates, validity of experiments, attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.stats import values_at

#: What a text loses before spans are looked for (fixed value).
NOISE = "\\s+|[，。；：、（）()【】\\[\\],.:;]"


def plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOISE, "")


def span_metrics(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """(question_id, recall and precision at 5 and 10, mrr, ndcg_at_10): ranks at which spans are first contained in documents.

    ``spans`` (question_id, n, span) in contract order, ``docs`` (question_id, rank, text). The reciprocal rank is of the first span in
    contract order that is found; gains fall with the root of the rank.
    """
    size = docs.groupBy("question_id").agg(F.count("*").alias("docs"))
    asked = spans.where("span <> ''").select("question_id", "n", plain(F.col("span")).alias("s"))
    hit = asked.join(docs.select("question_id", "rank", plain(F.col("text")).alias("t")), "question_id").where(F.contains("t", "s")).groupBy("question_id", "n").agg(F.min("rank").alias("rank"))
    rows = asked.join(hit, ["question_id", "n"], "left").groupBy("question_id").agg(F.count("*").alias("spans"), *[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in (5, 10)], F.min_by("rank", F.when(F.col("rank").isNotNull(), F.col("n"))).alias("first"), F.sum(F.when(F.col("rank") <= 10, 1 / F.sqrt("rank"))).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("spans", F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.sqrt(i))
    three = lambda c, name: F.round(F.coalesce(c, F.lit(0.0)), 3).alias(name)
    got = rows.join(size, "question_id", "left")
    shown = lambda k: F.greatest(F.lit(1), F.least(F.lit(k), F.coalesce("docs", F.lit(0))))
    return got.select("question_id", *[three(F.col(f"h{k}") / F.col("spans"), f"recall_at_{k}") for k in (5, 10)], *[three(F.col(f"h{k}") / shown(k), f"precision_at_{k}") for k in (5, 10)], three(1 / F.col("first"), "mrr"), three(F.col("dcg") / ideal, "ndcg_at_10"))


def round_summary(rows: DataFrame) -> DataFrame:
    """One row of delivery, refusal, degradation, evidence and latency over judged answers.

    Needs rule, deliverable, delivery_status, requirement_coverage, route, timeout_stage, errors (text), issues (array), direct, indirect,
    mismatch (counts), duration.
    """
    refuse = F.col("rule") == "must_refuse"
    late = (F.coalesce("timeout_stage", F.lit("")) != "") | F.lower(F.coalesce("errors", F.lit(""))).rlike("timeout|超时|超过|deadline|锁|加载")
    stuck = (F.coalesce("timeout_stage", F.lit("")) != "") | F.lower(F.coalesce("errors", F.lit(""))).rlike("timeout|超时|锁|加载")
    short = ~refuse & ~F.col("deliverable") & ~stuck & (F.size("issues") > 0)
    delivered = ~refuse & F.col("deliverable") & ((F.coalesce("requirement_coverage", F.lit(0.0)) > 0) | (F.col("route") == "calculation"))
    refused = refuse & ~F.col("deliverable") & (F.col("delivery_status") == "degraded_insufficient_evidence")
    sums = rows.agg(F.count("*").alias("n"), F.count_if(~refuse).alias("normal"), F.count_if(refuse).alias("refusals"), F.count_if(delivered).alias("delivered"), F.count_if(refused).alias("refused"), F.count_if(short).alias("short"), F.count_if(late).alias("late"), F.count_if(~F.array_contains("issues", "citation_invalid")).alias("cited"), F.count_if(F.col("direct") > 0).alias("with_direct"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"n_{c}") for c in ("direct", "indirect", "mismatch")])
    lat = values_at(rows.withColumn("duration", F.coalesce("duration", F.lit(0.0))), [], "duration", {"p50": ("floored", 0.5), "p95": ("floored", 0.95)}).agg(F.max("p50").alias("p50"), F.max("p95").alias("p95"))
    rate = lambda a, b, name: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 3).alias(name)
    n, docs = F.col("n"), F.greatest(F.lit(1), F.col("n_direct") + F.col("n_indirect") + F.col("n_mismatch"))
    # one row on either side
    return sums.join(F.broadcast(lat), F.lit(True)).select(n.alias("sample_size"), (n >= 30).alias("stable"), rate(F.col("delivered"), F.col("normal"), "normal_delivery"), rate(F.col("refused"), F.col("refusals"), "correct_refusal"), rate(F.col("short"), F.col("normal"), "evidence_degraded"), rate(F.col("late"), n, "infra_timeout"), rate(F.col("short") + F.col("late"), n, "degraded"), rate(F.col("cited"), n, "citation_validity"), rate(F.col("with_direct"), n, "direct_evidence"), *[rate(F.col(f"n_{c}"), docs, f"{c}_share") for c in ("direct", "indirect", "mismatch")], F.round(F.coalesce("p50", F.lit(0.0)), 3).alias("p50"), F.round(F.coalesce("p95", F.lit(0.0)), 3).alias("p95"))


def counter_failures(counters: DataFrame) -> DataFrame:
    """(question_id, failure): call counters whose sums do not agree, and calls that a local single-pass profile forbids."""
    wrong = (F.col("scheduled") != F.col("attempted") + F.col("skipped")) | (F.col("attempted") != F.col("completed") + F.col("timeout") + F.col("failed") + F.col("cancelled"))
    name = F.col("name")
    found = F.array(F.when(wrong, F.concat(name, F.lit(" counter invariant failed"))), F.when((name == "planner_calls") & (F.col("attempted") != 0), "planner called"), F.when((name == "web_search_calls") & (F.col("attempted") != 0), "web called"), F.when((name == "retrieval_calls") & (F.col("attempted") > 1), "retrieval attempts > 1"))
    return counters.select("question_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("failure"))


def source_diagnostics(expected: DataFrame, audit: DataFrame) -> DataFrame:
    """(question_id, source, doc_id, disposition, ...): the best audited candidate of each expected source, or not_in_candidate_pool.

    Best by rerank_rank, then fallback_rank, then pre_rank, missing ones last.
    """
    last = lambda c: F.col(c).asc_nulls_last()
    rows = expected.join(audit, ["question_id", "source"], "left")
    best = rows.withColumn("k", F.row_number().over(W.partitionBy("question_id", "source").orderBy(last("rerank_rank"), last("fallback_rank"), last("pre_rank"), "doc_id"))).where("k = 1")
    return best.select("question_id", "source", "doc_id", "rerank_rank", F.coalesce("disposition", F.lit("not_in_candidate_pool")).alias("disposition"), F.coalesce("guarded", F.lit(False)).alias("guarded"))


def attribution(diagnostics: DataFrame, first_hits: DataFrame) -> DataFrame:
    """(question_id, first_hit, category): why the first expected source stands where it does."""
    each = diagnostics.groupBy("question_id").agg(F.bool_or(F.col("disposition") == "source_cap_filtered").alias("capped"), F.bool_or("guarded").alias("promoted"))
    rows = each.join(first_hits, "question_id", "left")
    kind = F.when(F.col("first_hit") == 1, "first_hit_rank_1").when(F.col("first_hit").isNull(), "expected_source_not_in_final").when(F.col("capped"), "source_cap_or_final_diversity").when(F.col("promoted"), "entity_guard_promoted").otherwise("first_hit_rank_gt_1")
    return rows.select("question_id", "first_hit", kind.alias("category"))


def span_bracket(rows: DataFrame) -> DataFrame:
    """Bounds on recall where some spans are damaged: lower over all, upper over undamaged ones, and both counts of undamaged ones alone."""
    n = lambda c: F.count_if(c)
    got = rows.agg(F.count("*").alias("total"), n(F.col("clean")).alias("clean_total"), n(F.col("matched")).alias("matched"), n(F.col("matched") & F.col("clean")).alias("clean_matched"))
    rate = lambda a, b: F.round(F.col(a) / F.nullif(b, F.lit(0)), 3)
    return got.select("total", "clean_total", "matched", rate("matched", "total").alias("lower"), rate("matched", "clean_total").alias("upper"), rate("clean_matched", "clean_total").alias("clean_only"))


def fact_depth(facts: DataFrame) -> DataFrame:
    """(question_id, depth, budget): how deep in its text the last number of a question's facts stands, and characters that would hold it.

    ``facts`` (question_id, fact, text); numbers that the text lacks are left out.
    """
    each = facts.select("question_id", "text", F.explode(F.regexp_extract_all("fact", F.lit("(\\d+(?:\\.\\d+)?)"), 1)).alias("number"))
    at = F.position("number", "text")
    got = each.where(at > 0).groupBy("question_id").agg(F.max(at - 1 + F.length("number")).alias("depth"))
    return got.select("question_id", "depth", (F.ceil(F.col("depth") * 12 / 1000) * 100).cast("int").alias("budget"))


def node_summary(nodes: DataFrame) -> DataFrame:
    """(run_id, nodes, total, slowest, errors) of timed steps."""
    return nodes.groupBy("run_id").agg(F.count("*").alias("nodes"), F.round(F.sum("seconds"), 3).alias("total"), F.max_by("node", F.struct("seconds", "node")).alias("slowest"), F.count_if(F.col("status") == "error").alias("errors"))
