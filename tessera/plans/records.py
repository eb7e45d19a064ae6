"""Queries over recorded runs, audits of retrieval, coverage of requirements and synchronised sets, composed from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus, evaluation, retrieval, summaries
from .catalog import _BLEND, _CHANNELS, _EXP, _SRC, _TERMS, OBS, _by_source, _expected, _obs, _t, _union, register

# composed rows; the text is both Spark SQL and DuckDB SQL
_ROWS = "SELECT event_id AS seq, user_id % 24 AS question_id, event_id % 3 AS round, CASE WHEN user_id % 5 < 2 THEN 's1' ELSE 's2' END AS case_set, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS arm, CASE WHEN event_id % 7 < 3 THEN 'v4' ELSE 'v5' END AS prompt, CASE event_id % 10 WHEN 0 THEN 'provider_timeout' WHEN 1 THEN 'provider_error' WHEN 2 THEN 'provider_rate_limit' ELSE 'completed' END AS status, value AS latency, CASE WHEN event_id % 9 = 0 THEN event_id % 4 END AS failed_attempts, event_id % 13 AS n_rules, CASE WHEN event_id % 29 = 0 THEN 2 ELSE 0 END AS lost_facts, CASE WHEN event_id % 5 > 0 THEN (event_id * 37 % 11) / 10e0 END AS metric, event_id % 3 > 0 AS applies FROM {0}"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    r = spark.sql(_ROWS.format("{events}"), events=_t(spark, d, "events"))
    rules = F.when(F.col("n_rules") == 0, F.array(F.lit("tag"), F.lit("space"))).when(F.col("n_rules") == 1, F.array(F.lit("tag"))).otherwise(F.array().cast("array<string>"))
    return r.withColumn("rules", rules)


@register(f"""WITH r AS (SELECT *, status = 'completed' AS done FROM ({_ROWS.format("events")})), l AS (SELECT arm, round, list_sort(list(latency) FILTER (done AND latency IS NOT NULL)) AS v, count(latency) FILTER (done) AS n FROM r GROUP BY ALL),
g AS (SELECT arm, round, count(*) AS total, count(*) FILTER (done) AS completed, round(avg(done::INT), 3) AS success_rate, round(avg((status = 'provider_timeout')::INT), 3) AS timeout_rate, round(avg((status = 'provider_rate_limit')::INT), 3) AS rate_limit_rate, round(avg((status IN ('provider_rate_limit', 'provider_error'))::INT), 3) AS hard_error_rate,
 count(*) FILTER (done AND coalesce(failed_attempts, 0) = 0) AS first_try, count(*) FILTER (done AND failed_attempts > 0) AS retried, CAST(coalesce(sum(failed_attempts) FILTER (done), 0) AS BIGINT) AS failed_attempts, count(*) FILTER (done AND n_rules < 2) AS malformed, CAST(sum(lost_facts) AS BIGINT) AS lost_facts, round(max(latency) FILTER (done), 3) AS latency_max, round(avg(metric) FILTER (done AND applies), 3) AS metric_mean, count(metric) FILTER (done AND applies) AS metric_n FROM r GROUP BY ALL)
SELECT g.*, timeout_rate <= 0.1 AND hard_error_rate <= 0.1 AS stable, round(v[CAST(floor((n - 1) / 2) AS BIGINT) + 1], 3) AS latency_p50, round(v[CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) + 1], 3) AS latency_p95 FROM g JOIN l USING (arm, round)""")
def record_quality(spark: SparkSession, d: str) -> DataFrame:
    """Availability, retries, truncation and means of every run with denominators."""
    return summaries.run_quality(_rows(spark, d), ["arm", "round"], {"metric": "applies"})


@register(f"""WITH r AS ({_ROWS.format("events")}), u AS (SELECT arm, unnest(CASE n_rules WHEN 0 THEN ['tag', 'space'] WHEN 1 THEN ['tag'] ELSE [] END) AS rule FROM r WHERE status = 'completed')
SELECT arm, 'rule' AS kind, rule AS name, count(*) AS n FROM u GROUP BY ALL UNION ALL SELECT arm, 'status', status, count(*) FROM r GROUP BY ALL""")
def record_histograms(spark: SparkSession, d: str) -> DataFrame:
    """Rules and statuses of every arm."""
    r = _rows(spark, d)
    rules = summaries.rule_histogram(r, ["arm"]).select("arm", F.lit("rule").alias("kind"), F.col("rule").alias("name"), "n")
    return rules.union(summaries.status_histogram(r, ["arm"]).select("arm", F.lit("status"), "status", "n"))


@register(f"""WITH r AS ({_ROWS.format("events")}), c AS (SELECT latency / 2 AS v FROM r WHERE status = 'completed' AND event_id_ok AND latency IS NOT NULL), v AS (SELECT list_sort(list(v)) AS v, count(*) AS n, max(v) AS m FROM c)
SELECT n, round(v[CAST(round_even(0.5 * (n - 1), 0) AS BIGINT) + 1], 3) AS p50, round(v[CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) + 1], 3) AS p95, round(m, 3) AS longest, round(120 - m, 3) AS headroom FROM v""".replace("event_id_ok", "seq % 2 = 0"))
def record_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Latency of single calls and what is left to the ceiling."""
    call = lambda s, v: F.struct(F.lit(s).alias("status"), v.alias("latency"))
    tried = F.when(F.col("seq") % 2 == 0, F.array(call("provider_timeout", F.col("latency")), call("completed", F.col("latency") / 2))).otherwise(F.array().cast("array<struct<status:string,latency:double>>"))
    return summaries.attempt_latency(_rows(spark, d).withColumn("attempts", tried), 120.0)


_RUNS = "SELECT 'm' AS model, CASE WHEN s_suppkey % 5 = 0 THEN 'x' ELSE 'y' END AS snapshot, 'p' AS prompt, 0 AS retrieval_calls, s_suppkey % 7 = 0 AS dry_run, s_suppkey % 8 AS repetition FROM {0}"


@register(f"""WITH r AS ({_RUNS.format("supplier")}) SELECT unnest(list_filter([CASE WHEN count(DISTINCT model) > 1 THEN 'model differs' END, CASE WHEN count(DISTINCT snapshot) > 1 THEN 'snapshot differs' END, CASE WHEN count(DISTINCT prompt) > 1 THEN 'prompt differs' END,
 CASE WHEN bool_or(retrieval_calls <> 0 OR dry_run) THEN 'not a real replay' END, CASE WHEN count(*) > count(DISTINCT repetition) THEN 'repeated repetition' END], lambda x: x IS NOT NULL)) AS problem FROM r""")
def record_identity(spark: SparkSession, d: str) -> DataFrame:
    """What keeps runs from being averaged."""
    return summaries.identity_problems(spark.sql(_RUNS.format("{s}"), s=_t(spark, d, "supplier")), ["model", "snapshot", "prompt"])


@register(f"""WITH r AS ({_ROWS.format("events")}), c AS (SELECT question_id, round, arm, arg_max(latency, seq) AS v FROM r WHERE status = 'completed' GROUP BY ALL), p AS (SELECT question_id, round, max(v) FILTER (arm = 'b') - max(v) FILTER (arm = 'a') AS d FROM c GROUP BY ALL)
SELECT count(d) AS pairs, round(avg(d), 2) AS mean, round(quantile_cont(d, 0.5), 2) AS median, count(*) FILTER (d > 0) AS slower, count(*) FILTER (d < 0) AS faster FROM p""")
def record_latency_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Paired latency of two arms in a question and round."""
    return summaries.latency_pairs(_rows(spark, d), ("a", "b"))


@register(f"""WITH r AS ({_ROWS.format("events")}), c AS (SELECT case_set, question_id, CASE WHEN question_id IN (1, 2, 3) THEN 'target' WHEN question_id IN (4, 5) THEN 'control' ELSE 'other' END AS grp, avg(metric) FILTER (prompt = 'v5') - avg(metric) FILTER (prompt = 'v4') AS d FROM r WHERE status = 'completed' GROUP BY ALL)
SELECT grp AS "group", count(*) AS cells, round(avg(d), 4) AS mean, round(quantile_cont(d, 0.5), 4) AS median, round(coalesce(stddev_samp(d), 0), 4) AS sd, round(coalesce(stddev_samp(d), 0) / sqrt(count(*)), 4) AS se, count(*) FILTER (d > 0) AS better, count(*) FILTER (d < 0) AS worse, count(*) FILTER (d = 0) AS tied FROM c WHERE d IS NOT NULL GROUP BY ROLLUP (grp)""")
def record_prompt_effect(spark: SparkSession, d: str) -> DataFrame:
    """Effect of a prompt on targets, controls, others and all cells."""
    group = F.when(F.col("question_id").isin(1, 2, 3), "target").when(F.col("question_id").isin(4, 5), "control").otherwise("other")
    return summaries.prompt_effect(_rows(spark, d), ("v4", "v5"), group)


@register(f"""WITH r AS (SELECT *, status = 'completed' AS done FROM ({_ROWS.format("events")})) SELECT case_set, arm, round, count(*) AS calls, count(*) FILTER (done) AS completed, round(avg(latency) FILTER (done), 1) AS latency_mean, round(max(latency) FILTER (done), 1) AS latency_max, round(avg(metric) FILTER (done), 3) AS metric_mean, count(metric) FILTER (done) AS metric_n FROM r GROUP BY GROUPING SETS ((case_set, arm, round), (case_set, arm))""")
def record_arm_grains(spark: SparkSession, d: str) -> DataFrame:
    """Quality by run and pooled over a set's arm."""
    return summaries.arm_grains(_rows(spark, d))


_AUDIT = "SELECT l_orderkey % 200 AS question_id, CASE l_partkey % 3 WHEN 0 THEN 'bm25_only' WHEN 1 THEN 'dense_only' ELSE 'dense_and_bm25' END AS retrieval_stage, CASE WHEN l_quantity < 45 THEN CAST(l_quantity AS INT) END AS rerank_rank, CASE WHEN l_suppkey % 4 > 0 THEN l_partkey % 40 END AS model_rank, l_suppkey % 35 AS combined_rank, CASE WHEN l_suppkey % 3 > 0 THEN l_linenumber * 3 END AS fallback_rank, CASE l_suppkey % 3 WHEN 0 THEN 'selected' ELSE 'outside_final_top10' END AS disposition, l_partkey % 17 = 0 AS guarded, l_partkey % 19 = 0 AS process_prior FROM {0}"


@register(f"""WITH a AS (SELECT *, retrieval_stage = 'bm25_only' AS lex, disposition = 'selected' AS fin FROM ({_AUDIT.format("lineitem")})) SELECT count(*) FILTER (lex) AS bm25_only_union, count(*) FILTER (lex AND coalesce(rerank_rank, 999) <= 20) AS bm25_only_top20, count(*) FILTER (lex AND fin) AS bm25_only_final, count(*) FILTER (lex AND model_rank > 20 AND combined_rank <= 20) AS bm25_only_promoted_to_top20, count(*) FILTER (lex AND fin AND fallback_rank > 10) AS bm25_only_promoted_to_final, count(*) FILTER (guarded) AS guards, count(*) FILTER (process_prior) AS process_priors FROM a""")
def record_retrieval_audit(spark: SparkSession, d: str) -> DataFrame:
    """How far lexical-only candidates come, and what guards and priors do."""
    return summaries.retrieval_summary(spark.sql(_AUDIT.format("{li}"), li=_t(spark, d, "lineitem")))


@register(f"""WITH {_SRC}, e AS ({_EXP}) SELECT concat('c', e.question_id % 3) AS category, count(DISTINCT e.question_id) AS questions, count(*) AS expected, count(first_rank) AS found FROM e LEFT JOIN sr USING (question_id, source) GROUP BY 1""")
def record_recall_by_category(spark: SparkSession, d: str) -> DataFrame:
    """Expected sources found a category."""
    e = _expected(spark, d)
    kinds = e.select("question_id", F.concat(F.lit("c"), F.col("question_id") % 3).alias("category")).distinct()
    return summaries.recall_by_category(e, evaluation.source_ranking(_by_source(spark, d)), kinds)


@register("""WITH f AS (SELECT event_type AS category, CASE event_id % 3 WHEN 0 THEN 'source_hit' WHEN 1 THEN 'correctness' ELSE 'other' END AS key, CASE WHEN event_id % 11 > 0 THEN value / 100 END AS score FROM events)
SELECT category, round(avg(score) FILTER (key = 'correctness'), 3) AS correctness, round(avg(score) FILTER (key = 'source_hit'), 3) AS source_hit, NULL::DOUBLE AS absent FROM f GROUP BY 1""")
def record_feedback(spark: SparkSession, d: str) -> DataFrame:
    """Mean scores of evaluators a category."""
    f = _t(spark, d, "events").selectExpr("event_type AS category", "CASE event_id % 3 WHEN 0 THEN 'source_hit' WHEN 1 THEN 'correctness' ELSE 'other' END AS key", "CASE WHEN event_id % 11 > 0 THEN value / 100 END AS score")
    return summaries.feedback_means(f, ["correctness", "source_hit", "absent"])


@register("""WITH a AS (SELECT c_custkey AS k, c_name AS n, CASE WHEN c_custkey % 9 > 0 THEN c_nationkey END AS t FROM customer WHERE c_custkey % 10 > 0), b AS (SELECT c_custkey AS k, c_name AS n, CASE WHEN c_custkey % 9 > 0 THEN c_nationkey + CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END END AS t FROM customer WHERE c_custkey % 7 > 0)
SELECT k, CASE WHEN b.n IS NULL THEN 'create' WHEN a.n IS NULL THEN 'delete' WHEN a.n = b.n AND a.t IS NOT DISTINCT FROM b.t THEN 'keep' ELSE 'update' END AS action FROM a FULL JOIN b USING (k)""")
def record_sync(spark: SparkSession, d: str) -> DataFrame:
    """What to create, update, delete and keep of a synchronised set."""
    c = _t(spark, d, "customer")
    a = c.where("c_custkey % 10 > 0").selectExpr("c_custkey AS k", "c_name AS n", "CASE WHEN c_custkey % 9 > 0 THEN c_nationkey END AS t")
    b = c.where("c_custkey % 7 > 0").selectExpr("c_custkey AS k", "c_name AS n", "CASE WHEN c_custkey % 9 > 0 THEN c_nationkey + CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END END AS t")
    return summaries.sync_diff(a, b, "k", ["n", "t"])


@register(f"""WITH {_CHANNELS}, m AS (SELECT question_id, doc_id, min((part, rank)) AS k FROM (SELECT question_id, doc_id, CASE WHEN rank <= 12 THEN 0 ELSE 2 END AS part, rank FROM lex UNION ALL SELECT question_id, doc_id, 1, rank FROM sec) GROUP BY ALL)
SELECT question_id, doc_id, row_number() OVER (PARTITION BY question_id ORDER BY k, doc_id) AS place FROM m QUALIFY place <= 12""")
def retrieval_merge_ordered(spark: SparkSession, d: str) -> DataFrame:
    """Lexical hits first, then the second channel, each document once."""
    u = _union(spark, d)
    side = lambda c: u.where(F.col(c).isNotNull()).select("question_id", "doc_id", F.col(c).alias("rank"))
    return summaries.merge_ordered(side("bm25_rank"), side("dense_rank"), 12)


_MODE = {"reranker_only": "sem", "reranker_entity": "0.90 * sem + 0.10 * explicit"}


@register("WITH " + _BLEND.split("ba AS")[0].rstrip().rstrip(",") + ", " + ", ".join(f"b{i} AS (SELECT *, '{m}' AS mode, {x} AS base, {x} + CASE WHEN doc_id % 11 = 0 THEN 0.025 ELSE 0 END AS raised FROM nm)" for i, (m, x) in enumerate(_MODE.items())) + """, z AS (SELECT * FROM b0 UNION ALL SELECT * FROM b1), y AS (SELECT *, max(CASE WHEN NOT low THEN raised END) OVER (PARTITION BY question_id, mode) AS best FROM z)
SELECT question_id, doc_id, mode, round(CASE WHEN low AND best IS NOT NULL THEN least(raised - 0.12, best - 0.001) ELSE raised END, 6) AS combined FROM y""")
def retrieval_blend_modes(spark: SparkSession, d: str) -> DataFrame:
    """The other mixes of scores, with priors, penalty and ceiling."""
    docs = _t(spark, d, "documents").select("doc_id", "source")
    cand = _union(spark, d).join(docs, "doc_id").selectExpr("*", "(doc_id * 13 % 97) / 97e0 AS rerank_score", "CAST(doc_id % 5 = 0 AS INT) AS explicit", "CAST(doc_id % 7 = 0 AS INT) AS weak", "source IN ('src0', 'src1') AS low_authority", "CASE WHEN doc_id % 11 = 0 THEN 0.025D ELSE 0D END AS prior")
    out = [retrieval.blend(cand, m).select("question_id", "doc_id", F.lit(m).alias("mode"), F.round("combined", 6).alias("combined")) for m in _MODE]
    return out[0].union(out[1])


_NEED = "SELECT item_id AS task_id, 1 AS n, substr(text, 1, 30) AS text FROM {0} UNION ALL SELECT item_id, 2, 'zzqx yyqw' FROM {0} UNION ALL SELECT item_id, 3, substr(text, 40, 8) FROM {0} UNION ALL SELECT item_id, 4, '' FROM {0}"
_HAVE = "SELECT item_id AS task_id, item_id * 10 + k AS doc_id, CASE k WHEN 0 THEN text WHEN 1 THEN substr(text, 20, 60) ELSE 'nothing' END AS text, CASE (item_id + k) % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'indirect' ELSE 'scope_mismatch' END AS evidence_status FROM {0}, (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) AS ks WHERE item_id % 6 > 0"
_NEEDED = f"""a AS (SELECT task_id, n, {_TERMS.format("text")} AS terms FROM ({_NEED.format("benchmark")})), h AS ({_HAVE.format("benchmark")}),
j AS (SELECT a.task_id, n, doc_id, evidence_status, doc_id IS NOT NULL AND len(list_filter(terms, lambda x: contains(lower(text), x))) >= least(2, len(terms)) AS fits FROM a LEFT JOIN h USING (task_id)),
s AS (SELECT task_id, n, count(*) FILTER (fits) AS supporting, CASE WHEN count(*) FILTER (fits AND evidence_status = 'direct') > 0 THEN 'covered' WHEN count(*) FILTER (fits AND evidence_status = 'scope_mismatch') > 0 THEN 'conflict' WHEN count(*) FILTER (fits) > 0 THEN 'partial' ELSE 'missing' END AS status FROM j GROUP BY ALL)"""


def _needed(spark: SparkSession, d: str) -> DataFrame:
    b = _t(spark, d, "benchmark")
    return summaries.requirement_status(spark.sql(_NEED.format("{b}"), b=b), spark.sql(_HAVE.format("{b}"), b=b))


@register(f"WITH {_NEEDED} SELECT task_id, n, status, supporting FROM s")
def record_requirements(spark: SparkSession, d: str) -> DataFrame:
    """Whether each requirement of a task is covered, in conflict, partial or missing."""
    return _needed(spark, d)


@register(f"WITH {_NEEDED} SELECT task_id, count(*) AS requirements, count(*) FILTER (status = 'covered') AS covered, CASE WHEN count(*) FILTER (status = 'covered') = count(*) THEN 'covered' WHEN count(*) FILTER (supporting > 0) > 0 THEN 'partial' ELSE 'missing' END AS coverage FROM s GROUP BY 1")
def record_task_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of every task by its requirements."""
    return summaries.task_coverage(_needed(spark, d))


_HITS = "SELECT l_orderkey AS question_id, l_linenumber AS doc_id, CASE WHEN l_partkey % 4 > 0 THEN l_quantity / 100e0 END AS relevance, CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey % 17 / 400e0 END AS rrf_score, CASE WHEN l_partkey % 5 > 0 THEN l_partkey % 3 END AS lexical, CASE WHEN l_suppkey % 7 > 0 THEN l_suppkey % 23 = 0 END AS exact FROM {0}"


@register(f"""WITH h AS ({_HITS.format("lineitem")}) SELECT question_id, doc_id, coalesce(relevance IS NULL OR exact OR relevance >= 0.25 OR rrf_score >= 0.55 * max(rrf_score) OVER (PARTITION BY question_id) OR (rrf_score IS NULL AND lexical > 0), false) AS passes FROM h""")
def retrieval_thresholded(spark: SparkSession, d: str) -> DataFrame:
    """Which hits pass the score thresholds."""
    return retrieval.thresholded(spark.sql(_HITS.format("{li}"), li=_t(spark, d, "lineitem"))).select("question_id", "doc_id", "passes")


_CHUNKS = "SELECT p_partkey % 71 AS group_id, p_partkey AS doc_id, concat('s', CAST(p_partkey % 5 AS VARCHAR(9))) AS source, concat(p_name, ' is ', CAST(p_size % 4 AS VARCHAR(9)), ' and ', CAST(p_partkey % 3 AS VARCHAR(9))) AS text FROM {0}"


@register(f"""WITH c AS (SELECT *, list_distinct(regexp_extract_all(text, '([一-鿿A-Za-z]{{2,}})')) AS w, list_sort(list_distinct(regexp_extract_all(text, '(\\d+(?:\\.\\d+)?)'))) AS n FROM ({_CHUNKS.format("part")}))
SELECT a.group_id, a.doc_id AS doc_a, b.doc_id AS doc_b, array_to_string(list_sort(list_intersect(a.w, b.w))[1:12], ',') AS shared FROM c a JOIN c b ON a.group_id = b.group_id AND a.doc_id < b.doc_id AND a.source <> b.source AND a.n <> b.n AND len(list_intersect(a.w, b.w)) > 0""")
def record_source_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Documents of different sources in one evidence set that share words but not numbers."""
    c = spark.sql(_CHUNKS.format("{part}"), part=_t(spark, d, "part"))
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("([一-鿿A-Za-z]{2,})"), 1))
    return corpus.source_conflicts(c.withColumn("words", words), lambda shared: F.array_join(shared, ","))


@register(f"WITH {OBS} SELECT status, count(*) AS n FROM (SELECT CASE WHEN message IS NULL OR message = '' THEN NULL WHEN regexp_matches(lower(message), 'timeout|timed out|deadline|超时') THEN 'provider_timeout' WHEN regexp_matches(lower(message), 'rate limit|rate_limit|429|限流|too many requests') THEN 'provider_rate_limit' ELSE 'provider_error' END AS status FROM (SELECT CASE seq % 8 WHEN 0 THEN 'Request timed out' WHEN 1 THEN 'HTTP 429' WHEN 2 THEN '限流' WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN 'Deadline' WHEN 6 THEN '已超时' ELSE 'boom' END AS message FROM obs)) GROUP BY 1")
def record_error_classes(spark: SparkSession, d: str) -> DataFrame:
    """Failures of recorded calls by class."""
    from ..functions import text

    said = _obs(spark, d).selectExpr("CASE seq % 8 WHEN 0 THEN 'Request timed out' WHEN 1 THEN 'HTTP 429' WHEN 2 THEN '限流' WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN 'Deadline' WHEN 6 THEN '已超时' ELSE 'boom' END AS message")
    return said.groupBy(text.error_class(F.col("message")).alias("status")).agg(F.count("*").alias("n"))
