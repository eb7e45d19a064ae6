"""Queries over questions as tasks and over evaluation rounds, composed from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import merkle, planning, rounds
from .catalog import _t, register
from .ranking import _sql_list, _sql_words

# composed rows; the text is both Spark SQL and DuckDB SQL
_ASKED = """SELECT p_partkey AS question_id, CASE p_partkey % 11 WHEN 0 THEN '比较 PP、Tritan 和 PC 的耐热性，从成本与强度方面评价' WHEN 1 THEN '推荐儿童水杯的材料，考虑食品接触、清洗' WHEN 2 THEN '计算直径 70 高度 120 的容量' WHEN 3 THEN '如何设计握持尺寸，依据 GB/T 26158-2010' WHEN 4 THEN 'What is ISO 9001:2015 about' WHEN 5 THEN 'a plain question' WHEN 6 THEN '壁厚、圆角、排气' WHEN 7 THEN '哪个方案适合高温条件，参考 gb/t 3326—2016 和 ISO 8124' WHEN 8 THEN '对比' WHEN 9 THEN '' ELSE concat('评估', CAST(p_partkey % 3 AS VARCHAR(3)), '号结构的影响，按照跌落、 密封 ，密封') END AS question FROM {0}"""


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_ASKED.format("{part}"), part=_t(spark, d, "part"))


def _sql_clean(x: str) -> str:
    tidy = f"list_transform({x}, lambda y: regexp_replace(regexp_replace(y, '\\s+', ' ', 'g'), '^[ ，,。；;:：]+|[ ，,。；;:：]+$', '', 'g'))"
    return f"list_filter(list_transform(range(1, len({tidy}) + 1), lambda i: CASE WHEN {tidy}[i] <> '' AND NOT list_contains({tidy}[1:i - 1], {tidy}[i]) THEN {tidy}[i] END), lambda y: y IS NOT NULL)"


_INTENT = f"CASE WHEN {_sql_words('question', planning.COMPARING)} THEN 'comparison' WHEN {_sql_words('question', planning.ADVISING)} THEN 'recommendation' WHEN {_sql_words('question', planning.CALCULATING)} AND regexp_matches(question, '\\d') AND NOT {_sql_words('question', planning.ANALYSING)} THEN 'simple' WHEN {_sql_words('question', planning.ANALYSING)} OR {_sql_words('question', planning.DESIGNING)} OR length(question) - length(replace(question, '、', '')) >= 2 THEN 'complex' ELSE 'simple' END"
_PLANNED = f"""qa AS ({_ASKED.format("part")}),
qb AS (SELECT *, {_INTENT} AS intent, regexp_extract_all(question, '{planning.REFERENCE}', 1) AS r0, list_filter(list_transform(string_split_regex(question, '、|,|，|和|与|还是'), lambda x: regexp_replace(x, '^[ ，,。；;:：]+|[ ，,。；;:：]+$', '', 'g')), lambda x: length(x) > 1 AND length(x) <= 40 AND NOT regexp_matches(x, '{planning.NOT_CANDIDATE}')) AS c0,
 flatten(list_transform(list_concat({", ".join(f"regexp_extract_all(question, '{p}', 1)" for p in planning.BY_CRITERIA)}), lambda x: string_split_regex(x, '、|,|，|和|与|及'))) AS d0 FROM qa),
qc AS (SELECT question_id, question, intent, {_sql_clean("r0")} AS refs, CASE WHEN intent = 'comparison' THEN {_sql_clean("c0[1:6]")} ELSE [] END AS named, ({_sql_clean("d0")})[1:8] AS dims FROM qb),
qd AS (SELECT *, list_concat(CASE WHEN intent = 'comparison' AND len(named) > 0 THEN list_transform(named, lambda c: {{'operation': 'retrieve', 'query': concat(c, ' 的相关性能、特征、应用条件和限制')}}) ELSE [{{'operation': 'retrieve', 'query': question}}] END,
 CASE WHEN intent IN ('complex', 'recommendation') AND {_sql_words("concat_ws(' ', question, array_to_string(dims, ' '))", planning.DESIGNING)} THEN [{", ".join(f"{{'operation': 'retrieve', 'query': concat(question, '；{f}')}}" for f in planning.FACETS)}] ELSE [] END,
 CASE WHEN len(dims) > 0 THEN [{{'operation': CASE WHEN intent = 'comparison' THEN 'compare' ELSE 'analyze' END, 'query': concat(question, '；重点评价：', array_to_string(dims, '、'))}}] ELSE [] END,
 CASE WHEN len(refs) > 0 THEN [{{'operation': 'validate', 'query': concat(array_to_string(refs, '；'), ' 相关条款、数据或适用范围')}}] ELSE [] END, [{{'operation': CASE WHEN intent = 'recommendation' THEN 'recommend' ELSE 'synthesize' END, 'query': question}}]) AS ts FROM qc)"""


@register(f"WITH {_PLANNED} SELECT question_id, intent, array_to_string(refs, '|') AS refs, array_to_string(named, '|') AS candidates, array_to_string(dims, '|') AS criteria FROM qc")
def plan_contracts(spark: SparkSession, d: str) -> DataFrame:
    """Intent, references, candidates and criteria of every question."""
    q = F.col("question")
    return _asked(spark, d).select("question_id", planning.intent(q).alias("intent"), F.array_join(planning.references(q), "|").alias("refs"), F.array_join(planning.candidates(q), "|").alias("candidates"), F.array_join(planning.criteria(q), "|").alias("criteria"))


@register(f"""WITH {_PLANNED}, qe AS (SELECT question_id, CASE WHEN intent = 'simple' THEN [] WHEN len(ts) > 8 THEN list_concat(ts[1:7], ts[-1:]) ELSE ts END AS ts FROM qd), qf AS (SELECT question_id, unnest(ts) AS t, unnest(range(0, len(ts))) AS place FROM qe) SELECT question_id, place, t.operation, t.query FROM qf""")
def plan_tasks(spark: SparkSession, d: str) -> DataFrame:
    """The bounded tasks of every question."""
    return _asked(spark, d).select("question_id", F.posexplode(planning.tasks(F.col("question"))).alias("place", "t")).select("question_id", "place", "t.*")


@register(f"""WITH qa AS ({_ASKED.format("part")}), e AS (SELECT question_id, list_concat([trim(question)], {_sql_list([(" AND ".join(_sql_words("lower(trim(question))", g) for g in groups), f"'{v}'") for groups, v in planning.VARIANTS])}) AS v FROM qa WHERE trim(question) <> ''),
u AS (SELECT question_id, unnest(v) AS variant, unnest(range(1, len(v) + 1)) AS i FROM e), k AS (SELECT *, row_number() OVER (PARTITION BY question_id, lower(regexp_replace(variant, '\\s+', '', 'g')) ORDER BY i) AS b FROM u)
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY i) - 1 AS place, variant FROM k WHERE b = 1 QUALIFY place < 4""")
def plan_expansions(spark: SparkSession, d: str) -> DataFrame:
    """The rule-based variants of every question."""
    return _asked(spark, d).select("question_id", F.posexplode(planning.expansions(F.col("question"))).alias("place", "variant"))


_ITEMS = "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'refuse' WHEN 1 THEN 'deliver' WHEN 2 THEN '条件化交付' ELSE '' END AS outcome, CASE p_partkey % 4 WHEN 0 THEN 'calculation' WHEN 1 THEN 'refusal' ELSE 'fact' END AS task_type, CASE p_partkey % 6 WHEN 0 THEN '必须拒答' WHEN 1 THEN '若缺资料' WHEN 2 THEN '使用公式' WHEN 3 THEN '可交付' ELSE NULL END AS mode, p_partkey % 3 = 0 AS deliverable, CASE WHEN p_partkey % 7 = 0 THEN 'planner' END AS stage, p_partkey % 9 = 0 AS failed, p_partkey % 2 = 0 AS ran, CASE WHEN p_partkey % 5 < 3 THEN 'insufficient_evidence' ELSE 'ok' END AS audit FROM {0}"


@register(f"""WITH i AS ({_ITEMS.format("part")}) SELECT id, CASE WHEN outcome IN ('refuse', '拒答') OR task_type = 'refusal' THEN 'must_refuse' WHEN outcome IN ('deliver', 'conditional_deliver', '交付', '条件化交付') THEN CASE WHEN task_type = 'calculation' THEN 'calculation' ELSE 'deliver_or_degrade' END
 WHEN regexp_matches(coalesce(mode, ''), '无效引用|必须拒') THEN 'must_refuse' WHEN regexp_matches(coalesce(mode, ''), '若缺|资料不足|条件化推荐') THEN 'conditional_or_refuse' WHEN regexp_matches(coalesce(mode, ''), '公式|计算') THEN 'calculation' WHEN contains(coalesce(mode, ''), '可交付') THEN 'deliver_or_degrade' ELSE 'observe' END AS rule,
 CASE WHEN deliverable THEN 'none' WHEN coalesce(stage, '') <> '' OR failed THEN 'infra_timeout' WHEN ran AND audit = 'insufficient_evidence' THEN 'evidence_insufficient' ELSE 'infra_timeout' END AS degradation FROM i""")
def plan_rules(spark: SparkSession, d: str) -> DataFrame:
    """Expected rules and degradation classes of items."""
    i = spark.sql(_ITEMS.format("{part}"), part=_t(spark, d, "part"))
    return i.select("id", planning.expected_rule(F.col("outcome"), F.col("task_type"), F.col("mode")).alias("rule"), planning.degradation(F.col("deliverable"), F.col("stage"), F.col("failed"), F.col("ran"), F.col("audit")).alias("degradation"))


_CALLS = "SELECT user_id % 50 AS run_id, CASE event_id % 3 WHEN 0 THEN 'retrieval' WHEN 1 THEN 'planner' ELSE 'web' END AS tool, event_id % 4 > 0 AS success, CASE event_id % 8 WHEN 0 THEN 'Deadline exceeded' WHEN 4 THEN 'broken pipe' END AS error FROM {0}"


@register(f"""WITH c AS ({_CALLS.format("events")}) SELECT run_id, tool, count(*) AS attempted, count(*) FILTER (success) AS completed, count(*) FILTER (NOT success AND regexp_matches(lower(coalesce(error, '')), 'timeout|超时|超过|deadline|timed out')) AS timeout, count(*) FILTER (NOT success AND NOT regexp_matches(lower(coalesce(error, '')), 'timeout|超时|超过|deadline|timed out')) AS failed FROM c GROUP BY ALL""")
def plan_tool_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters of tool calls a run."""
    return planning.tool_counters(spark.sql(_CALLS.format("{events}"), events=_t(spark, d, "events")), ["run_id"])


_TASKS = "SELECT l_orderkey AS plan_id, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey % 1000 AS task_id, CASE l_partkey % 4 WHEN 0 THEN 'covered' WHEN 1 THEN 'partial' END AS coverage, CASE WHEN l_partkey % 5 = 0 THEN 'said' ELSE '' END AS missing_reason, l_suppkey % 3 AS docs, l_suppkey % 2 AS direct, CASE WHEN l_partkey % 7 = 0 THEN 'x' END AS error, CASE WHEN l_linenumber % 2 = 0 THEN 'high' ELSE 'normal' END AS priority FROM {0}"


@register(f"""WITH t AS ({_TASKS.format("lineitem")}) SELECT plan_id, task_id, CASE WHEN coverage IS NULL AND docs = 0 AND error IS NULL THEN '未完成证据覆盖判断' WHEN missing_reason <> '' THEN missing_reason WHEN docs > 0 THEN '只有间接资料或适用范围不匹配资料，缺少直接证据' ELSE '未找到满足任务要求的直接资料' END AS reason,
 row_number() OVER (PARTITION BY plan_id ORDER BY priority <> 'high', task_id) AS place FROM t WHERE NOT (coalesce(coverage, '') = 'covered' OR (coverage IS NULL AND docs > 0 AND direct > 0)) QUALIFY place <= 3""")
def plan_gaps(spark: SparkSession, d: str) -> DataFrame:
    """The first three tasks of every plan whose evidence has gaps."""
    return planning.evidence_gaps(spark.sql(_TASKS.format("{lineitem}"), lineitem=_t(spark, d, "lineitem")))


_POOL = "SELECT l_orderkey % 300 AS question_id, l_partkey AS doc_id, concat('s', CAST(l_suppkey % 13 AS VARCHAR(9))) AS source, CAST(min(l_linenumber * 1000 + l_partkey % 1000) AS INT) AS rank FROM {0} GROUP BY l_orderkey % 300, l_partkey, l_suppkey"


@register(f"""WITH p AS ({_POOL.format("lineitem")}), a AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY question_id, doc_id ORDER BY rank, source) = 1), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY question_id, source ORDER BY rank, doc_id) <= 2)
SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank, doc_id) AS place FROM b QUALIFY place <= 18""")
def plan_compacted(spark: SparkSession, d: str) -> DataFrame:
    """Pooled documents of every question, two a source and eighteen in all."""
    pool = spark.sql(_POOL.format("{lineitem}"), lineitem=_t(spark, d, "lineitem"))
    # rows of one document and rank differ in nothing that is kept
    return planning.compact(pool)


_SPANS = "SELECT item_id AS question_id, 1 AS n, substr(text, 1, 20) AS span FROM {0} UNION ALL SELECT item_id, 2, substr(text, 30, 25) FROM {0} UNION ALL SELECT item_id, 3, concat('absent ', CAST(item_id AS VARCHAR(9))) FROM {0}"
_RETRIEVED = "SELECT item_id AS question_id, r.k AS rank, CASE WHEN (item_id + r.k) % 4 = 0 THEN substr(text, 25, 200) WHEN (item_id * r.k) % 5 = 1 THEN concat('X ', text) ELSE concat('other ', CAST(r.k AS VARCHAR(9))) END AS text FROM {0}, (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 4 UNION ALL SELECT 7 UNION ALL SELECT 11) AS r"
_PLAIN = f"regexp_replace(lower({{0}}), '{rounds.NOISE}', '', 'g')"


@register(f"""WITH s AS ({_SPANS.format("benchmark")}), d AS ({_RETRIEVED.format("benchmark")}), h AS (SELECT s.question_id, n, (SELECT min(rank) FROM d WHERE d.question_id = s.question_id AND contains({_PLAIN.format("d.text")}, {_PLAIN.format("span")})) AS rank FROM s),
g AS (SELECT question_id, count(*) AS k, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10, arg_min(rank, n) FILTER (rank IS NOT NULL) AS f, sum(1 / sqrt(rank)) FILTER (rank <= 10) AS dcg FROM h GROUP BY 1)
SELECT question_id, round(h5 / k, 3) AS recall_at_5, round(h10 / k, 3) AS recall_at_10, round(h5 / 5, 3) AS precision_at_5, round(h10 / 5, 3) AS precision_at_10, round(coalesce(1 / f, 0), 3) AS mrr, round(coalesce(dcg / list_sum(list_transform(range(1, least(k, 10) + 1), lambda i: 1 / sqrt(i))), 0), 3) AS ndcg_at_10 FROM g""")
def round_span_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Span-level retrieval metrics of every question."""
    b = _t(spark, d, "benchmark")
    return rounds.span_metrics(spark.sql(_SPANS.format("{b}"), b=b), spark.sql(_RETRIEVED.format("{b}"), b=b))


_JUDGED = "SELECT event_id AS question_id, CASE WHEN event_id % 6 = 0 THEN 'must_refuse' ELSE 'observe' END AS rule, event_id % 5 > 1 AS deliverable, CASE WHEN event_id % 5 > 1 THEN 'completed' WHEN event_id % 7 = 0 THEN 'failed' ELSE 'degraded_insufficient_evidence' END AS delivery_status, (event_id % 4) / 4e0 AS requirement_coverage, CASE WHEN event_id % 9 = 0 THEN 'calculation' ELSE 'local' END AS route, CASE WHEN event_id % 31 = 0 THEN 'planner' END AS timeout_stage, CASE event_id % 23 WHEN 0 THEN 'Lock 锁' WHEN 1 THEN 'deadline' END AS errors, event_id % 8 AS n_issues, event_id % 3 AS direct, event_id % 2 AS indirect, CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS mismatch, value AS duration FROM {0}"


@register(f"""WITH j AS (SELECT *, coalesce(timeout_stage, '') <> '' OR regexp_matches(lower(coalesce(errors, '')), 'timeout|超时|超过|deadline|锁|加载') AS late, coalesce(timeout_stage, '') <> '' OR regexp_matches(lower(coalesce(errors, '')), 'timeout|超时|锁|加载') AS stuck, rule = 'must_refuse' AS refuse FROM ({_JUDGED.format("events")})),
s AS (SELECT count(*) AS n, count(*) FILTER (NOT refuse) AS nn, count(*) FILTER (refuse) AS nr, count(*) FILTER (NOT refuse AND deliverable AND (requirement_coverage > 0 OR route = 'calculation')) AS dl, count(*) FILTER (refuse AND NOT deliverable AND delivery_status = 'degraded_insufficient_evidence') AS rf, count(*) FILTER (NOT refuse AND NOT deliverable AND NOT stuck AND n_issues > 0) AS sh, count(*) FILTER (late) AS lt, count(*) FILTER (n_issues <> 3) AS ct, count(*) FILTER (direct > 0) AS wd, sum(direct) AS a, sum(indirect) AS b, sum(mismatch) AS c, list_sort(list(coalesce(duration, 0))) AS v FROM j)
SELECT n AS sample_size, n >= 30 AS stable, round(dl / nn, 3) AS normal_delivery, round(rf / nr, 3) AS correct_refusal, round(sh / nn, 3) AS evidence_degraded, round(lt / n, 3) AS infra_timeout, round((sh + lt) / n, 3) AS degraded, round(ct / n, 3) AS citation_validity, round(wd / n, 3) AS direct_evidence, round(a / (a + b + c), 3) AS direct_share, round(b / (a + b + c), 3) AS indirect_share, round(c / (a + b + c), 3) AS mismatch_share,
 round(v[CAST(floor(0.5 * (n - 1)) AS BIGINT) + 1], 3) AS p50, round(v[CAST(floor(0.95 * (n - 1)) AS BIGINT) + 1], 3) AS p95 FROM s""")
def round_summary(spark: SparkSession, d: str) -> DataFrame:
    """Delivery, refusal, degradation, evidence and latency of a round."""
    rows = spark.sql(_JUDGED.format("{events}"), events=_t(spark, d, "events"))
    issues = F.when(F.col("n_issues") == 3, F.array(F.lit("citation_invalid"))).when(F.col("n_issues") > 0, F.array(F.lit("unsupported"))).otherwise(F.array().cast("array<string>"))
    return rounds.round_summary(rows.withColumn("issues", issues))


_COUNTERS = "SELECT user_id AS question_id, CASE event_id % 3 WHEN 0 THEN 'planner_calls' WHEN 1 THEN 'retrieval_calls' ELSE 'web_search_calls' END AS name, event_id % 4 AS scheduled, event_id % 4 - event_id % 2 AS attempted, event_id % 2 AS skipped, event_id % 4 - event_id % 2 - CASE WHEN event_id % 10 = 7 THEN 1 ELSE 0 END AS completed, 0 AS timeout, 0 AS failed, 0 AS cancelled FROM {0}"


@register(f"""WITH c AS ({_COUNTERS.format("events")}) SELECT question_id, unnest({_sql_list([("scheduled <> attempted + skipped OR attempted <> completed + timeout + failed + cancelled", "concat(name, ' counter invariant failed')"), ("name = 'planner_calls' AND attempted <> 0", "'planner called'"), ("name = 'web_search_calls' AND attempted <> 0", "'web called'"), ("name = 'retrieval_calls' AND attempted > 1", "'retrieval attempts > 1'")])}) AS failure FROM c""")
def round_validity(spark: SparkSession, d: str) -> DataFrame:
    """What makes a local single-pass experiment invalid."""
    return rounds.counter_failures(spark.sql(_COUNTERS.format("{events}"), events=_t(spark, d, "events")))


_EXPECTED = "SELECT DISTINCT l_orderkey % 500 AS question_id, concat('s', CAST(l_suppkey % 7 AS VARCHAR(9))) AS source FROM {0} WHERE l_linenumber < 3"
_AUDIT = "SELECT l_orderkey % 500 AS question_id, concat('s', CAST(l_suppkey % 11 AS VARCHAR(9))) AS source, l_partkey * 10 + l_linenumber AS doc_id, CASE WHEN l_quantity < 30 THEN CAST(l_quantity AS INT) END AS rerank_rank, CASE WHEN l_partkey % 2 = 0 THEN l_partkey % 30 END AS fallback_rank, l_linenumber AS pre_rank, CASE l_partkey % 3 WHEN 0 THEN 'selected' WHEN 1 THEN 'source_cap_filtered' ELSE 'outside_final_top10' END AS disposition, l_partkey % 5 = 0 AS guarded FROM {0}"
_DIAG = f"""e AS ({_EXPECTED.format("lineitem")}), a AS ({_AUDIT.format("lineitem")}), dg AS (SELECT question_id, source, doc_id, rerank_rank, coalesce(disposition, 'not_in_candidate_pool') AS disposition, coalesce(guarded, false) AS guarded FROM e LEFT JOIN a USING (question_id, source) QUALIFY row_number() OVER (PARTITION BY question_id, source ORDER BY rerank_rank NULLS LAST, fallback_rank NULLS LAST, pre_rank NULLS LAST, doc_id, disposition) = 1)"""


def _diagnosed(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem")
    return rounds.source_diagnostics(spark.sql(_EXPECTED.format("{li}"), li=li), spark.sql(_AUDIT.format("{li}"), li=li))


@register(f"WITH {_DIAG} SELECT question_id, source, doc_id, disposition FROM dg")
def round_source_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """The best audited candidate of every expected source."""
    return _diagnosed(spark, d).select("question_id", "source", "doc_id", "disposition")


@register(f"""WITH {_DIAG}, f AS (SELECT question_id, min(rerank_rank) FILTER (disposition = 'selected') AS first_hit, bool_or(disposition = 'source_cap_filtered') AS capped, bool_or(guarded) AS promoted FROM dg GROUP BY 1)
SELECT question_id, first_hit, CASE WHEN first_hit = 1 THEN 'first_hit_rank_1' WHEN first_hit IS NULL THEN 'expected_source_not_in_final' WHEN capped THEN 'source_cap_or_final_diversity' WHEN promoted THEN 'entity_guard_promoted' ELSE 'first_hit_rank_gt_1' END AS category FROM f""")
def round_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Why the first expected source of every question stands where it does."""
    diag = _diagnosed(spark, d)
    first = diag.where("disposition = 'selected'").groupBy("question_id").agg(F.min("rerank_rank").alias("first_hit"))
    return rounds.attribution(diag, first)


_FACTS = "SELECT doc_id AS question_id, concat('value ', CAST(doc_id % 10 AS VARCHAR(9)), ' and 2', CAST(doc_id % 7 AS VARCHAR(9))) AS fact, text FROM {0} WHERE text IS NOT NULL"


@register(f"""WITH f AS ({_FACTS.format("documents")}), n AS (SELECT question_id, text, unnest(regexp_extract_all(fact, '(\\d+(?:\\.\\d+)?)')) AS number FROM f), m AS (SELECT question_id, max(strpos(text, number) - 1 + length(number)) AS depth FROM n WHERE strpos(text, number) > 0 GROUP BY 1)
SELECT question_id, depth, CAST(ceil(depth * 12 / 1000) * 100 AS INT) AS budget FROM m""")
def round_fact_depth(spark: SparkSession, d: str) -> DataFrame:
    """How deep in their documents the numbers of facts stand."""
    return rounds.fact_depth(spark.sql(_FACTS.format("{docs}"), docs=_t(spark, d, "documents")))


@register("""WITH r AS (SELECT event_id % 10 > 1 AND event_id * 31 % 100 > 40 AS matched, event_id % 13 > 0 AS clean FROM events), s AS (SELECT count(*) AS total, count(*) FILTER (clean) AS clean_total, count(*) FILTER (matched) AS matched, count(*) FILTER (matched AND clean) AS cm FROM r)
SELECT total, clean_total, matched, round(matched / total, 3) AS lower, round(matched / clean_total, 3) AS upper, round(cm / clean_total, 3) AS clean_only FROM s""")
def round_span_bracket(spark: SparkSession, d: str) -> DataFrame:
    """Bounds on span recall where some spans are damaged."""
    return rounds.span_bracket(_t(spark, d, "events").selectExpr("event_id % 10 > 1 AND event_id * 31 % 100 > 40 AS matched", "event_id % 13 > 0 AS clean"))


@register("""WITH n AS (SELECT user_id AS run_id, event_type AS node, value AS seconds, CASE WHEN event_id % 17 = 0 THEN 'error' ELSE 'success' END AS status FROM events)
SELECT run_id, count(*) AS nodes, round(sum(seconds), 3) AS total, arg_max(node, (seconds, node)) AS slowest, count(*) FILTER (status = 'error') AS errors FROM n GROUP BY 1""")
def round_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Timed steps of every run with the slowest."""
    return rounds.node_summary(_t(spark, d, "events").selectExpr("user_id AS run_id", "event_type AS node", "value AS seconds", "CASE WHEN event_id % 17 = 0 THEN 'error' ELSE 'success' END AS status"))


#: Members of a range, on average, at the two levels of the registered tree (small, so that small tables have several).
_LEAF, _FAN = 32, 8
_BEGINS = "CASE WHEN ('0x' || hash[1:15])::BIGINT % {0} = 0 THEN {{'key': key, 'hash': hash}} END"


def _fold_sql(rows: str, out: str, every: int | None) -> str:
    """One level of the tree in SQL: members of a range in order, folded to one row."""
    at = f"max({_BEGINS.format(every)}) OVER (ORDER BY key, hash ROWS UNBOUNDED PRECEDING)" if every else "NULL"
    return f"""{out}_m AS (SELECT key, hash, n, {at} AS rg FROM {rows}),
{out} AS (SELECT min(key) AS key, sha256(string_agg(concat_ws(chr(31), key::VARCHAR, hash, n::VARCHAR), chr(10) ORDER BY key, hash)) AS hash, CAST(sum(n) AS BIGINT) AS n, rg FROM {out}_m GROUP BY rg)"""


@register(f"""WITH r AS (SELECT page_id AS key, sha256(concat_ws(chr(31), page_id::VARCHAR, coalesce(url, chr(0)), coalesce(html, chr(0)))) AS hash, count(*) AS n FROM pages GROUP BY ALL),
{_fold_sql("r", "l0", _LEAF)}, {_fold_sql("l0", "l1", _FAN)}, {_fold_sql("l1", "l2", None)}
SELECT 0 AS level, l0.key, l0.hash, l0.n, l1.key AS parent FROM l0 JOIN l1_m ON l1_m.key = l0.key JOIN l1 ON l1.rg IS NOT DISTINCT FROM l1_m.rg
UNION ALL SELECT 1, key, hash, n, (SELECT min(key) FROM l1) FROM l1 UNION ALL SELECT 2, key, hash, n, NULL FROM l2""")
def corpus_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """A tree of hashes over pages in order of their ids, whatever the layout: all ranges and the root."""
    return merkle.tree(_t(spark, d, "pages"), "page_id", ["url", "html"], _LEAF, _FAN, 2)


@register("""WITH a AS (SELECT page_id, url, html FROM pages), b AS (SELECT page_id, url, CASE WHEN page_id % 97 = 0 THEN html || 'x' ELSE html END AS html FROM pages)
SELECT count(*) FILTER (a.html <> b.html) AS changed, true AS covered, true AS roots_differ FROM a JOIN b USING (page_id)""")
def corpus_changed_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of two states of the pages that differ hold every changed page."""
    old = _t(spark, d, "pages").select("page_id", "url", "html")
    new = old.withColumn("html", F.when(F.col("page_id") % 97 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html")))
    a, b = (merkle.tree(x, "page_id", ["url", "html"], _LEAF, _FAN) for x in (old, new))
    found = merkle.changed_ranges(a, b).where("side = 'before'")
    # a range reaches to the next one's first key
    leaves = a.where("level = 0").withColumn("next", F.lead("key").over(W.orderBy("key")))
    span = found.join(leaves, "key").select(F.col("key").alias("lo"), F.coalesce("next", F.lit(1 << 62)).alias("hi"))
    changed = new.where("page_id % 97 = 0").select("page_id")
    # one row a changed range, far fewer than pages
    held = changed.join(F.broadcast(span), (F.col("page_id") >= F.col("lo")) & (F.col("page_id") < F.col("hi")), "left_semi").agg(F.count("*").alias("held"))
    return changed.agg(F.count("*").alias("changed")).join(F.broadcast(held), F.lit(True)).select("changed", (F.col("changed") == F.col("held")).alias("covered"), F.lit(merkle.root(a) != merkle.root(b)).alias("roots_differ"))
