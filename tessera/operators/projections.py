"""Flat rows and short texts out of recorded states: routes, seconds by stage, fallback and refusal texts, gap searches, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import basename
from .planning import degradation

# Node names, statuses and bounds that decide the results.
ANSWERING = ("generate", "aggregate_results", "validate_delivery")
SHORT_OF_EVIDENCE = ("indirect_evidence", "unsupported", "unreferenced", "scope_mismatch", "evidence_insufficient")
MOST_DOCS, MOST_ISSUES, SNIPPET, MOST_GAP_DOCS = 12, 8, 280, 3
PERMANENT = "invalid api key|authentication|unauthorized|401|403|insufficient balance|quota"
# End of fixed values.


def state_rows(states: DataFrame) -> DataFrame:
    """One flat row a state: route, exit reason, degradation, seconds by stage, evidence and calls.

    Needs state_id, deliverable, route, timeout_stage, tool_calls (tool, success, error), planner_completed, trace (node, seconds),
    issues (array of statuses), documents (source_type, evidence_status).
    """
    n = lambda tool, keep: F.size(F.filter("tool_calls", lambda c: (c["tool"] == tool) & keep(c)))
    late = lambda c: F.lower(F.coalesce(c["error"], F.lit(""))).rlike("timeout|超时|超过|deadline|timed out")
    done = lambda c: c["success"]
    failed = lambda c: ~c["success"]
    rows = states.withColumns({
        "retrievals": n("local_retrieval", done), "web_searches": n("web_search", done), "failed_calls": n("local_retrieval", failed) + n("web_search", failed),
        "timeouts": n("local_retrieval", lambda c: failed(c) & late(c)) + n("web_search", lambda c: failed(c) & late(c)),
    })
    audit = F.when(F.exists("issues", lambda x: x.isin(*SHORT_OF_EVIDENCE)), "insufficient_evidence")
    reason = degradation(F.col("deliverable"), F.col("timeout_stage"), F.col("failed_calls") > 0, (F.col("planner_completed") > 0) & (F.col("retrievals") > 0), F.coalesce(audit, F.lit("")))
    route = F.when(F.col("web_searches") > 0, "web_fallback").when(F.col("retrievals") > 0, "local_retrieval").otherwise(F.coalesce("route", F.lit("degraded")))
    seconds = lambda keep: F.round(F.aggregate(F.filter("trace", keep), F.lit(0.0), lambda s, t: s + t["seconds"]), 3)
    docs = lambda keep: F.size(F.filter("documents", keep))
    rows = rows.withColumn("reason", reason)
    out = F.when(F.col("deliverable"), "success").when(F.col("reason") == "infra_timeout", "timeout").otherwise("failed")
    return rows.select("state_id", route.alias("route"), "deliverable", "reason", out.alias("exit_reason"), "retrievals", "web_searches", "failed_calls", "timeouts", seconds(lambda t: t["node"] == "analyze_question").alias("planner_seconds"), seconds(lambda t: t["node"].isin(*ANSWERING)).alias("generation_seconds"), seconds(lambda t: F.lit(True)).alias("total_seconds"), F.get("trace", F.size("trace") - 1)["node"].alias("last_node"), docs(lambda x: x["evidence_status"] == "direct").alias("direct"), docs(lambda x: x["evidence_status"] == "indirect").alias("indirect"), docs(lambda x: x["source_type"] == "web").alias("web_sources"), F.size("issues").alias("issues"))


def fallback_summary(docs: DataFrame) -> DataFrame:
    """(question_id, summary, shown): the first twelve documents by rank, each source and page once, with the start of their text."""
    first = docs.where(F.col("rank") <= MOST_DOCS)
    once = first.groupBy("question_id", F.concat_ws("|", F.coalesce("source", F.lit("")), F.coalesce(F.col("page").cast("string"), F.lit(""))).alias("key")).agg(F.min(F.struct("rank", "source", "page", "text")).alias("d"))
    flat = lambda t: F.substring(F.trim(F.regexp_replace(t, "\\s+", " ")), 1, SNIPPET)
    line = lambda x: F.concat(F.lit("- "), F.coalesce(x["source"], F.lit("")), F.when(x["page"].isNotNull(), F.concat(F.lit(" p."), (x["page"] + 1).cast("string"))).otherwise(""), F.lit(": "), flat(F.coalesce(x["text"], F.lit(""))))
    got = once.groupBy("question_id").agg(F.sort_array(F.collect_list("d")).alias("ds"))
    return got.select("question_id", F.array_join(F.transform("ds", line), "\n").alias("summary"), F.size("ds").alias("shown"))


def issue_text(issues: Column) -> Column:
    """The first eight distinct issues as lines."""
    return F.array_join(F.transform(F.slice(F.array_distinct(issues), 1, MOST_ISSUES), lambda x: F.concat(F.lit("- "), x)), "\n")


def gap_queries(gaps: DataFrame) -> DataFrame:
    """(plan_id, query, tasks): the distinct search texts of gaps with the tasks they serve; requirements follow the task's own text."""
    text = F.concat_ws("；", F.nullif("query", F.lit("")), F.array_join("requirements", "；"))
    return gaps.withColumn("q", text).groupBy("plan_id", F.col("q").alias("query")).agg(F.sort_array(F.collect_set("task_id")).alias("tasks"))


def gap_documents(queries: DataFrame, results: DataFrame) -> DataFrame:
    """(plan_id, task_id, doc_id, place): at most three results a query, given back to every task of it."""
    kept = results.withColumn("k", F.row_number().over(W.partitionBy("query").orderBy("rank", "doc_id"))).where(F.col("k") <= MOST_GAP_DOCS)
    rows = queries.join(kept, "query").select("plan_id", F.explode("tasks").alias("task_id"), "doc_id", "rank").distinct()
    return rows.withColumn("place", F.row_number().over(W.partitionBy("plan_id", "task_id").orderBy("rank", "doc_id"))).drop("rank")


def lane_rank(hits: Column, canonical: Column) -> Column:
    """The best rank among hits (canonical_id, rank) of one entity; null without any."""
    return F.array_min(F.transform(F.filter(hits, lambda h: h["canonical_id"] == canonical), lambda h: h["rank"]))


def numeric(value: Column) -> Column:
    """A number out of text, with true and false as 1 and 0; what is neither is 0."""
    low = F.lower(F.trim(value))
    return F.when(low == "true", 1.0).when(low == "false", 0.0).otherwise(F.coalesce(value.try_cast("double"), F.lit(0.0)))


def contains_squeezed(text: Column, part: Column) -> Column:
    """Containment whatever the white space and case; an empty part is nowhere."""
    squeeze = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "\\s+", "")
    return (squeeze(part) != "") & F.contains(squeeze(text), squeeze(part))


def source_names(docs: DataFrame) -> DataFrame:
    """Distinct base names of sources."""
    return docs.select(basename(F.col("source")).alias("name")).distinct()


def is_permanent(message: Column) -> Column:
    """Whether no retry can mend an error."""
    return F.lower(F.coalesce(message, F.lit(""))).rlike(PERMANENT)


def profile_counts(profiles: DataFrame) -> DataFrame:
    """One row: observations of retrieval, how many were cached, cold and timed out."""
    return profiles.agg(F.count("*").alias("observations"), F.count_if("cache_hit").alias("cache_hits"), F.count_if(~F.col("cache_hit")).alias("cold"), F.count_if(F.coalesce("timeout_stage", F.lit("")) != "").alias("timeouts"))


def hit_levels(rows: DataFrame) -> DataFrame:
    """One row: questions whose expected sources are found in full, in part and not at all; ``rows`` (question_id, hit)."""
    each = rows.groupBy("question_id").agg(F.avg(F.col("hit").cast("int")).alias("r"))
    return each.agg(F.count_if(F.col("r") == 1).alias("full"), F.count_if((F.col("r") > 0) & (F.col("r") < 1)).alias("partial"), F.count_if(F.col("r") == 0).alias("none"))


def between(questions: DataFrame, key: str, start: int, limit: int | None) -> DataFrame:
    """Questions from place ``start`` (0 first) in order of key, ``limit`` of them."""
    place = F.row_number().over(W.orderBy(key)) - 1
    rows = questions.withColumn("place", place).where(F.col("place") >= start)
    return rows if limit is None else rows.where(F.col("place") < start + limit)
