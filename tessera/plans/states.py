"""Queries over recorded states and short projections, composed from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import planning, projections
from .catalog import _TERMS, _post, _lexical, _t, register

# composed rows; the text is both Spark SQL and DuckDB SQL
_STATE = "SELECT user_id AS state_id, event_id % 5 AS k, event_id, CASE event_id % 4 WHEN 0 THEN 'analyze_question' WHEN 1 THEN 'generate' WHEN 2 THEN 'retrieve' ELSE 'validate_delivery' END AS node, value AS seconds, CASE event_id % 3 WHEN 0 THEN 'local_retrieval' WHEN 1 THEN 'web_search' ELSE 'other' END AS tool, event_id % 6 > 0 AS success, CASE WHEN event_id % 12 = 0 THEN 'timed out' END AS error, CASE event_id % 4 WHEN 0 THEN 'direct' WHEN 1 THEN 'indirect' ELSE 'scope_mismatch' END AS evidence_status, CASE WHEN event_id % 7 = 0 THEN 'web' ELSE 'local' END AS source_type, CASE event_id % 9 WHEN 0 THEN 'unsupported' WHEN 1 THEN 'citation_invalid' END AS issue FROM {0}"


@register(f"""WITH e AS (SELECT *, tool IN ('local_retrieval', 'web_search') AS counted FROM ({_STATE.format("events")})),
g AS (SELECT state_id, state_id % 3 = 0 AS deliverable, count(*) FILTER (tool = 'local_retrieval' AND success) AS retrievals, count(*) FILTER (tool = 'web_search' AND success) AS web_searches, count(*) FILTER (counted AND NOT success) AS failed_calls, count(*) FILTER (counted AND NOT success AND error IS NOT NULL) AS timeouts,
 round(coalesce(sum(seconds) FILTER (node = 'analyze_question'), 0), 3) AS planner_seconds, round(coalesce(sum(seconds) FILTER (node IN ('generate', 'validate_delivery')), 0), 3) AS generation_seconds, round(sum(seconds), 3) AS total_seconds, arg_max(node, event_id) AS last_node, count(*) FILTER (evidence_status = 'direct') AS direct, count(*) FILTER (evidence_status = 'indirect') AS indirect, count(*) FILTER (source_type = 'web') AS web_sources, count(issue) AS issues, bool_or(coalesce(issue = 'unsupported', false)) AS short FROM e GROUP BY 1),
r AS (SELECT *, CASE WHEN deliverable THEN 'none' WHEN state_id % 8 = 0 OR failed_calls > 0 THEN 'infra_timeout' WHEN state_id % 2 > 0 AND retrievals > 0 AND short THEN 'evidence_insufficient' ELSE 'infra_timeout' END AS reason FROM g)
SELECT state_id, CASE WHEN web_searches > 0 THEN 'web_fallback' WHEN retrievals > 0 THEN 'local_retrieval' WHEN state_id % 5 = 0 THEN 'calculation' ELSE 'degraded' END AS route, deliverable, reason, CASE WHEN deliverable THEN 'success' WHEN reason = 'infra_timeout' THEN 'timeout' ELSE 'failed' END AS exit_reason, retrievals, web_searches, failed_calls, timeouts, planner_seconds, generation_seconds, total_seconds, last_node, direct, indirect, web_sources, issues FROM r""")
def state_rows(spark: SparkSession, d: str) -> DataFrame:
    """Flat rows of recorded states."""
    e = spark.sql(_STATE.format("{events}"), events=_t(spark, d, "events"))
    at = F.sort_array(F.collect_list(F.struct("event_id", "node", "seconds", "tool", "success", "error", "evidence_status", "source_type", "issue"))).alias("a")
    s = e.groupBy("state_id").agg(at)
    part = lambda *names: F.transform("a", lambda x: F.struct(*[x[n].alias(n) for n in names]))
    states = s.select("state_id", (F.col("state_id") % 3 == 0).alias("deliverable"), F.when(F.col("state_id") % 5 == 0, "calculation").alias("route"), F.when(F.col("state_id") % 8 == 0, "planner").alias("timeout_stage"), part("tool", "success", "error").alias("tool_calls"), (F.col("state_id") % 2).alias("planner_completed"), part("node", "seconds").alias("trace"), F.filter(F.transform("a", lambda x: x["issue"]), lambda x: x.isNotNull()).alias("issues"), part("source_type", "evidence_status").alias("documents"))
    return projections.state_rows(states)


@register(f"""WITH {_post(20)}, d AS (SELECT question_id, rank, source, CAST(doc_id % 3 AS INT) AS page, coalesce(text, '') AS t FROM lex JOIN documents USING (doc_id) WHERE rank <= 12), o AS (SELECT question_id, min(rank) AS k, arg_min((source, page, t), rank) AS x FROM d GROUP BY question_id, source, page),
l AS (SELECT question_id, k, concat('- ', coalesce(x[1], ''), ' p.', x[2] + 1, ': ', substr(trim(regexp_replace(x[3], '\\s+', ' ', 'g')), 1, 280)) AS line FROM o)
SELECT question_id, sha256(string_agg(line, chr(10) ORDER BY k)) AS summary, count(*) AS shown FROM l GROUP BY 1""")
def state_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    """What is said where no model answers: sources and pages once with their texts' start (O1)."""
    docs = _lexical(spark, d, 20).join(_t(spark, d, "documents").select("doc_id", "source", "text"), "doc_id").withColumn("page", (F.col("doc_id") % 3).cast("int"))
    return projections.fallback_summary(docs).withColumn("summary", F.sha2("summary", 256))


@register(f"""WITH {_post(20)}, qt AS (SELECT item_id AS question_id, {_TERMS.format("text")} AS terms FROM benchmark),
c AS (SELECT question_id, doc_id, rank, CASE (question_id + doc_id) % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'indirect' ELSE 'scope_mismatch' END AS st, lower(coalesce(text, '')) AS t, terms FROM lex JOIN documents USING (doc_id) JOIN qt USING (question_id)),
u AS (SELECT *, CAST(coalesce(list_sum(list_transform(terms, lambda x: (length(t) - length(replace(t, x, ''))) // length(x))), 0) AS INT) AS times FROM c WHERE st <> 'scope_mismatch'),
v AS (SELECT *, max(times) OVER (PARTITION BY question_id) AS best, row_number() OVER (PARTITION BY question_id ORDER BY rank, doc_id) AS fst FROM u)
SELECT question_id, doc_id, times, row_number() OVER (PARTITION BY question_id ORDER BY st <> 'direct' AND best > 0, times DESC, rank, doc_id) AS place FROM v WHERE times > 0 OR (best = 0 AND fst = 1)""")
def state_graded(spark: SparkSession, d: str) -> DataFrame:
    """Candidates as graded without a model."""
    docs, asked = _t(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), _t(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    rows = _lexical(spark, d, 20).join(docs, "doc_id").join(asked, "question_id")
    kind = (F.col("question_id") + F.col("doc_id")) % 3
    return planning.fallback_grade(rows.withColumn("evidence_status", F.when(kind == 0, "direct").when(kind == 1, "indirect").otherwise("scope_mismatch"))).select("question_id", "doc_id", "times", "place")


_GAPS = "SELECT l_orderkey % 400 AS plan_id, l_partkey % 30 AS task_id, CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE concat('q', CAST(l_suppkey % 6 AS VARCHAR(9))) END AS query, concat('r', CAST(l_suppkey % 2 AS VARCHAR(9))) AS need FROM {0}"
_FOUND = "SELECT DISTINCT concat('q', CAST(p_partkey % 6 AS VARCHAR(9)), '；r', CAST(p_partkey % 2 AS VARCHAR(9))) AS query, p_partkey % 40 AS doc_id, CAST(p_partkey % 40 % 9 AS INT) AS rank FROM {0}"


@register(f"""WITH g AS (SELECT DISTINCT plan_id, task_id, concat_ws('；', nullif(query, ''), need) AS query FROM ({_GAPS.format("lineitem")})), k AS (SELECT query, doc_id, rank FROM ({_FOUND.format("part")}) QUALIFY row_number() OVER (PARTITION BY query ORDER BY rank, doc_id) <= 3),
j AS (SELECT DISTINCT plan_id, task_id, doc_id, rank FROM g JOIN k USING (query)) SELECT plan_id, task_id, doc_id, row_number() OVER (PARTITION BY plan_id, task_id ORDER BY rank, doc_id) AS place FROM j""")
def state_gap_documents(spark: SparkSession, d: str) -> DataFrame:
    """What searches for gaps give back to their tasks."""
    gaps = spark.sql(_GAPS.format("{li}"), li=_t(spark, d, "lineitem")).withColumn("requirements", F.array("need"))
    return projections.gap_documents(projections.gap_queries(gaps), spark.sql(_FOUND.format("{p}"), p=_t(spark, d, "part")))


_SHORT = "SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'True' WHEN 1 THEN '0.25' WHEN 2 THEN 'n/a' WHEN 3 THEN NULL WHEN 4 THEN ' false ' ELSE '7' END AS raw, CASE p_partkey % 4 WHEN 0 THEN 'Invalid API key' WHEN 1 THEN 'HTTP 503' WHEN 2 THEN NULL ELSE 'Quota exceeded' END AS message, p_name AS text, CASE p_partkey % 3 WHEN 0 THEN upper(substr(p_name, 2, 6)) WHEN 1 THEN ' ' ELSE p_brand END AS part FROM {0}"


@register(f"""WITH s AS ({_SHORT.format("part")}) SELECT id, CASE lower(trim(raw)) WHEN 'true' THEN 1 WHEN 'false' THEN 0 ELSE coalesce(TRY_CAST(raw AS DOUBLE), 0) END AS value, regexp_matches(lower(coalesce(message, '')), '{projections.PERMANENT}') AS permanent,
 regexp_replace(part, '\\s+', '', 'g') <> '' AND contains(regexp_replace(lower(text), '\\s+', '', 'g'), regexp_replace(lower(part), '\\s+', '', 'g')) AS held, CASE WHEN id % 4 = 0 THEN id % 3 + 1 END AS lane_rank FROM s""")
def state_values(spark: SparkSession, d: str) -> DataFrame:
    """Coerced metrics, permanent errors, squeezed containment and lane ranks."""
    s = spark.sql(_SHORT.format("{p}"), p=_t(spark, d, "part"))
    hit = lambda c, k: F.struct(F.lit(c).alias("canonical_id"), k.alias("rank"))
    hits = F.when(F.col("id") % 4 == 0, F.array(hit("a", F.lit(9).cast("long")), hit("a", (F.col("id") % 3 + 1).cast("long")), hit("b", F.lit(0).cast("long")))).otherwise(F.array(hit("b", F.lit(0).cast("long"))))
    return s.select("id", projections.numeric(F.col("raw")).alias("value"), projections.is_permanent(F.col("message")).alias("permanent"), projections.contains_squeezed(F.col("text"), F.col("part")).alias("held"), projections.lane_rank(hits, F.lit("a")).alias("lane_rank"))


@register("""WITH p AS (SELECT event_id % 3 = 0 AS cache_hit, CASE WHEN event_id % 17 = 0 THEN 'dense' END AS timeout_stage FROM events) SELECT count(*) AS observations, count(*) FILTER (cache_hit) AS cache_hits, count(*) FILTER (NOT cache_hit) AS cold, count(timeout_stage) AS timeouts FROM p""")
def state_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Observations of retrieval, cached, cold and timed out."""
    return projections.profile_counts(_t(spark, d, "events").selectExpr("event_id % 3 = 0 AS cache_hit", "CASE WHEN event_id % 17 = 0 THEN 'dense' END AS timeout_stage"))


@register("""WITH r AS (SELECT o_custkey AS q, avg((o_orderkey % 3 > 0)::INT) AS r FROM orders GROUP BY 1) SELECT count(*) FILTER (r = 1) AS "full", count(*) FILTER (r > 0 AND r < 1) AS partial, count(*) FILTER (r = 0) AS none FROM r""")
def state_hit_levels(spark: SparkSession, d: str) -> DataFrame:
    """Questions with all, some and none of their sources."""
    return projections.hit_levels(_t(spark, d, "orders").selectExpr("o_custkey AS question_id", "o_orderkey % 3 > 0 AS hit"))


@register("SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS place FROM benchmark QUALIFY place BETWEEN 5 AND 14")
def state_range(spark: SparkSession, d: str) -> DataFrame:
    """A range of the question list, as asked for."""
    return projections.between(_t(spark, d, "benchmark").select("item_id"), "item_id", 5, 10)


@register("SELECT DISTINCT lower(split_part(replace(source, chr(92), '/'), '/', -1)) AS name FROM documents")
def state_source_names(spark: SparkSession, d: str) -> DataFrame:
    """Distinct base names of sources."""
    return projections.source_names(_t(spark, d, "documents"))
