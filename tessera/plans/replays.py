"""Queries over replays, composed from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import audit, replays
from .catalog import _TERMS, _lexical, _post, _t, register
from .ranking import _sql_list

# composed rows; the text is both Spark SQL and DuckDB SQL
_JSON = """CASE event_id % 4 WHEN 0 THEN concat('{"a": ', CAST(event_id % 7 AS VARCHAR(9)), ', "ok": true, "name": "x"}') WHEN 1 THEN concat('{"summary": {"b": ', CAST(event_id % 5 AS VARCHAR(9)), '.5, "s": "t", "n": null}, "c": 3}') WHEN 2 THEN '{"z": false}' ELSE '{"d": 12, "list": [1]}' END"""


@register(f"""WITH j AS (SELECT event_id AS id, {_JSON} AS doc FROM events) SELECT id, 'a' AS name, CAST(id % 7 AS DOUBLE) AS value FROM j WHERE id % 4 = 0 AND json_type(doc, '$.a') = 'UBIGINT' UNION ALL SELECT id, 'b', CAST(json_extract_string(doc, '$.summary.b') AS DOUBLE) FROM j WHERE json_type(doc, '$.summary') = 'OBJECT' UNION ALL SELECT id, 'd', CAST(json_extract_string(doc, '$.d') AS DOUBLE) FROM j WHERE json_type(doc, '$.d') = 'UBIGINT'""")
def replay_metric_views(spark: SparkSession, d: str) -> DataFrame:
    """The numbers of result documents, of their summaries where they have one."""
    return replays.metric_view(_t(spark, d, "events").selectExpr("event_id AS id", f"{_JSON} AS doc"), "id", "doc")


_SCORED = "SELECT o_orderkey AS row_id, concat('s', CAST(o_orderkey % 3 AS VARCHAR(3))) AS case_set, o_custkey % 50 AS question_id, CASE o_orderkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS arm, concat('the answer has t', CAST(o_custkey % 6 AS VARCHAR(3)), ' and t', CAST(o_orderkey % 5 AS VARCHAR(3))) AS answer FROM {0}"
_ARMS = "SELECT 'a' AS arm, 3 AS max_items UNION ALL SELECT 'b', 8"
_CONTRACT = "SELECT DISTINCT concat('s', CAST(c_custkey % 2 AS VARCHAR(3))) AS case_set, c_custkey % 50 AS question_id, concat('h', CAST(c_custkey % 3 AS VARCHAR(3))) AS hop_id, concat('t', CAST(c_custkey % 7 AS VARCHAR(3))) AS term, c_custkey % 20 AS chunk_id FROM {0}"
_PACK = "SELECT c_custkey % 50 AS question_id, c_custkey % 20 AS chunk_id, CAST(min(c_custkey % 12) AS INT) AS rank FROM {0} GROUP BY c_custkey % 50, c_custkey % 20"


@register(f"""WITH r AS ({_SCORED.format("orders")}), a AS ({_ARMS}), c AS ({_CONTRACT.format("customer")}), p AS ({_PACK.format("customer")})
SELECT row_id, count(*) AS hops, count(*) FILTER (contains(answer, term)) AS matched, round(avg(contains(answer, term)::INT), 3) AS hop_recall, count(*) FILTER (rank <= max_items) AS reachable FROM r JOIN a USING (arm) JOIN c USING (case_set, question_id) LEFT JOIN p USING (question_id, chunk_id) GROUP BY 1""")
def replay_rescored(spark: SparkSession, d: str) -> DataFrame:
    """Recorded answers scored again under today's contracts."""
    c = _t(spark, d, "customer")
    return replays.rescore(spark.sql(_SCORED.format("{o}"), o=_t(spark, d, "orders")), spark.sql(_ARMS), spark.sql(_CONTRACT.format("{c}"), c=c), spark.sql(_PACK.format("{c}"), c=c))


_HOPS = "SELECT p_partkey % 300 AS case_id, concat('h', CAST(p_partkey AS VARCHAR(9))) AS hop_id, concat('q', CAST(p_partkey % 9 AS VARCHAR(3))) AS from_question, p_brand AS term FROM {0}"


@register(f"""WITH h AS ({_HOPS.format("part")}) SELECT case_id, string_agg(concat_ws(':', hop_id, from_question, term), ';' ORDER BY hop_id) AS hops, CASE WHEN count(*) > 1 THEN 'multi_hop' ELSE 'fact' END AS case_type FROM h GROUP BY 1""")
def replay_contracts(spark: SparkSession, d: str) -> DataFrame:
    """Contracts and slices generated from hops (M4)."""
    got = replays.build_contracts(spark.sql(_HOPS.format("{p}"), p=_t(spark, d, "part")))
    return got.select("case_id", F.array_join(F.transform("hops", lambda h: F.concat_ws(":", h["hop_id"], h["from_question"], h["term"])), ";").alias("hops"), "case_type")


_RECORDED = "SELECT event_id AS row_id, user_id AS question_id, CASE event_id % 6 WHEN 0 THEN 'provider_timeout' WHEN 1 THEN 'provider_error' ELSE 'completed' END AS status, CASE WHEN event_id % 5 = 0 THEN 'v7' ELSE 'v8' END AS audit_version FROM {0}"


@register(f"""WITH r AS (SELECT * FROM ({_RECORDED.format("events")}) WHERE audit_version = 'v8'), f AS (SELECT question_id, status, min(row_id) AS row_id FROM r GROUP BY ALL), n AS (SELECT question_id, unnest(['provider_timeout', 'provider_rate_limit']) AS status FROM (SELECT DISTINCT question_id FROM r))
SELECT *, false AS synthetic FROM f UNION ALL SELECT question_id, status, NULL, true FROM n ANTI JOIN f USING (question_id, status)""")
def replay_fixtures(spark: SparkSession, d: str) -> DataFrame:
    """One fixture a question and status of one audit version, and made-up failures."""
    return replays.fixtures(spark.sql(_RECORDED.format("{e}"), e=_t(spark, d, "events")), "v8", ("provider_timeout", "provider_rate_limit"))


@register("""SELECT s_suppkey AS id, sha256(concat_ws(chr(31), concat('{"k":', s_suppkey % 4, ',"mode":"', s_name, '"}'), sha256(s_name)))[1:16] AS snapshot_id FROM supplier""")
def replay_snapshot_ids(spark: SparkSession, d: str) -> DataFrame:
    """Names of frozen snapshots by configuration and index."""
    s = _t(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), replays.snapshot_id(F.struct((F.col("s_suppkey") % 4).alias("k"), F.col("s_name").alias("mode")), F.sha2("s_name", 256)).alias("snapshot_id"))


@register("SELECT p_partkey AS case_id FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 = 0 AND p_partkey % 5 = 0")
def replay_thin_contracts(spark: SparkSession, d: str) -> DataFrame:
    """Contracts with nothing to check."""
    some = lambda k: F.when(F.col("p_partkey") % k > 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("case_id"), some(2).alias("expected_answer_spans"), some(3).alias("required_terms"), F.when(F.col("p_partkey") % 5 > 0, F.array(F.lit("s"))).alias("expected_sources"))
    return replays.thin_contracts(p).select("case_id")


_SETTINGS = "SELECT p_brand AS strategy, p_size % 4 AS source_cap, p_type AS mode FROM {0}"


@register(f"""WITH r AS ({_SETTINGS.format("part")}), n AS (SELECT strategy, source_cap, mode, count(*) AS n FROM r GROUP BY ALL)
SELECT strategy, source_cap, mode, coalesce(n, 0) AS runs FROM (SELECT * FROM (SELECT DISTINCT strategy FROM r), (SELECT DISTINCT source_cap FROM r), (SELECT DISTINCT mode FROM r)) LEFT JOIN n USING (strategy, source_cap, mode)""")
def replay_grid(spark: SparkSession, d: str) -> DataFrame:
    """The cells of an ablation over settings of recorded runs, with those that no run covers."""
    return replays.grid(spark.sql(_SETTINGS.format("{part}"), part=_t(spark, d, "part")), ["strategy", "source_cap", "mode"])


_TRIED = "SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'provider_error' ELSE 'completed' END AS status, event_id % 3 AS bad, value AS metric FROM {0}"


@register(f"WITH t AS ({_TRIED.format('events')}) SELECT id, bad + CASE WHEN status = 'completed' THEN 1 ELSE 0 END AS attempts_made, bad AS failed_attempts, status = 'completed' AND bad > 0 AS retried, CASE WHEN status = 'completed' THEN metric END AS metric FROM t")
def replay_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Attempts of recorded calls; content metrics are null where none completed."""
    t = spark.sql(_TRIED.format("{e}"), e=_t(spark, d, "events"))
    call = lambda s: F.struct(F.lit(s).alias("status"))
    tried = F.concat(F.array_repeat(call("provider_timeout"), F.col("bad").cast("int")), F.when(F.col("status") == "completed", F.array(call("completed"))).otherwise(F.array().cast("array<struct<status:string>>")))
    return replays.attempt_fields(t.withColumn("attempts", tried)).select("id", "attempts_made", "failed_attempts", "retried", "metric")


@register(f"""WITH {_post(20)}, qt AS (SELECT item_id AS question_id, {_TERMS.format("text")} AS qs FROM benchmark), s AS (SELECT question_id, doc_id, round(len(list_intersect(qs, {_TERMS.format("coalesce(text, '')")})) / greatest(1, len(qs)), 6) AS rerank_score FROM lex JOIN qt USING (question_id) JOIN documents USING (doc_id))
SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rerank_score DESC, doc_id) AS model_rank FROM s""")
def replay_reranked(spark: SparkSession, d: str) -> DataFrame:
    """Lexical candidates ranked again by a deterministic scorer (L3)."""
    docs, asked = _t(spark, d, "documents").select("doc_id", "text"), _t(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return replays.reranked(_lexical(spark, d, 20).join(docs, "doc_id").join(asked, "question_id")).select("question_id", "doc_id", "rerank_score", "model_rank")


@register()
def replay_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all documents by a deterministic stand-in model, in batches; tested for length and norm (L2)."""
    return _t(spark, d, "documents").select("doc_id", replays.hashed_embedding("text").alias("embedding"))


_JUDGED = "SELECT o_orderkey AS id, o_custkey % 4 AS e, o_orderkey % 3 AS s, o_orderkey % 5 = 0 AS must_refuse, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 2 = 0 END AS deliverable, o_orderkey % 3 AS n FROM {0}"


@register(f"""WITH j AS ({_JUDGED.format("orders")}), k AS (SELECT *, list_filter([CASE WHEN e IN (1, 3) THEN 'x' END, CASE WHEN e > 1 THEN 'y' END], lambda v: v IS NOT NULL) AS expected, list_filter([CASE WHEN s > 0 THEN 'x' END, CASE WHEN s = 2 THEN 'z' END], lambda v: v IS NOT NULL) AS sources FROM j)
SELECT id, 'source_hit' AS name, CASE WHEN len(expected) = 0 THEN (len(sources) = 0)::INT ELSE len(list_intersect(expected, sources)) / len(expected) END AS score FROM k UNION ALL SELECT id, 'refusal', CASE WHEN must_refuse THEN (NOT deliverable)::INT ELSE 1 END FROM k
UNION ALL SELECT id, 'contract', (deliverable IS NOT NULL)::INT FROM k UNION ALL SELECT id, 'diagnosis', (deliverable OR n > 0)::INT FROM k""")
def replay_evaluators(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the deterministic evaluators."""
    j = spark.sql(_JUDGED.format("{o}"), o=_t(spark, d, "orders"))
    some = lambda *pairs: F.filter(F.array(*[F.when(c, F.lit(v)) for c, v in pairs]), lambda x: x.isNotNull())
    rows = j.withColumns({"expected": some((F.col("e").isin(1, 3), "x"), (F.col("e") > 1, "y")), "sources": some((F.col("s") > 0, "x"), (F.col("s") == 2, "z")), "issues": F.array_repeat(F.lit("i"), F.col("n").cast("int"))})
    return replays.evaluate(rows, "id")


_SLICED = "SELECT user_id AS question_id, event_type AS case_type, CASE WHEN event_id % 6 > 0 THEN CASE event_id % 2 WHEN 0 THEN 'low' ELSE 'high' END END AS risk_level, event_id % 3 > 0 AS cited FROM {0}"


@register(f"""WITH s AS ({_SLICED.format("events")}) SELECT CASE WHEN GROUPING(case_type) = 0 THEN 'case_type' WHEN GROUPING(risk_level) = 0 THEN 'risk_level' END AS dimension, CASE WHEN GROUPING(case_type) = 0 THEN case_type WHEN GROUPING(risk_level) = 0 THEN risk_level END AS "group", count(*) AS observations, count(DISTINCT question_id) AS questions, CAST(sum(cited::INT) AS BIGINT) AS citations FROM s GROUP BY GROUPING SETS ((case_type), (risk_level), ())""")
def replay_denominators(spark: SparkSession, d: str) -> DataFrame:
    """What stands under a report's means, by slice and in all."""
    return replays.slice_denominators(spark.sql(_SLICED.format("{e}"), e=_t(spark, d, "events")), ["case_type", "risk_level"])


_KEYED = "SELECT p_partkey AS id, concat(' ', upper(p_name), '  x', chr(10), p_brand, ' ') AS q, concat(CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN concat('intro', chr(10), '  ## Part ', p_brand, ' ', chr(10)) ELSE concat('# ', p_name, chr(10), '# no') END, 'body') AS body, p_size AS secs FROM {0}"
_HEADED = "list_filter(string_split(body, chr(10))[1:20], lambda x: starts_with(ltrim(x), '#'))[1]"


@register(f"""WITH k AS ({_KEYED.format("part")}) SELECT id, concat_ws('|', regexp_replace(trim(lower(q)), '\\s+', ' ', 'g'), 'c', id % 5, 10, 'F') AS cache_key, regexp_replace(lower(q), '[^a-z0-9]+', '', 'g') AS compact, trim(regexp_replace(ltrim({_HEADED}), '^#+', '')) AS heading, TIMESTAMP '2024-03-01 00:00:10' - to_seconds(secs) AS started, greatest(100, 130 - greatest(0, secs)) AS deadline FROM k""")
def text_keys(spark: SparkSession, d: str) -> DataFrame:
    """Cache keys, compact forms, first headings, starts by end and duration, local deadlines."""
    from ..operators.entities import compact

    k = spark.sql(_KEYED.format("{p}"), p=_t(spark, d, "part"))
    return k.select("id", replays.cache_key(F.col("q"), F.lit("c"), F.col("id") % 5, F.lit(10), F.lit("F")).alias("cache_key"), compact(F.col("q")).alias("compact"), text.first_heading(F.col("body")).alias("heading"), replays.started_at(F.lit("2024-03-01 00:00:10").cast("timestamp_ntz"), F.col("secs")).alias("started"), text.local_deadline(F.lit(130), F.col("secs"), F.lit(100)).cast("int").alias("deadline"))


@register(f"""WITH {_post(20)}, x AS (SELECT question_id, rank, concat('[L', rank, '] 标题：t', doc_id, chr(10), '来源：', coalesce(source, ''), CASE WHEN doc_id % 2 = 0 THEN concat('，第 ', doc_id % 7 + 1, ' 页') ELSE '' END, chr(10), '原始检索排名：', rank, chr(10), '证据状态：direct', chr(10), coalesce(text, '')) AS s FROM lex JOIN documents USING (doc_id) WHERE rank <= 3)
SELECT item_id AS question_id, sha256(coalesce((SELECT concat('本次允许引用：', string_agg(concat('L', rank), '、' ORDER BY rank), chr(10), chr(10), '---', chr(10), chr(10), '只能使用以下证据回答；没有证据支持的内容必须明确说明无法确认。', chr(10), chr(10), '---', chr(10), chr(10), string_agg(s, concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY rank)) FROM x WHERE x.question_id = item_id), '（无可用本地证据）')) AS context FROM benchmark""")
def corpus_contexts(spark: SparkSession, d: str) -> DataFrame:
    """The evidence of every question as a prompt shows it."""
    docs = _lexical(spark, d, 20).where("rank <= 3").join(_t(spark, d, "documents").select("doc_id", "source", "text"), "doc_id")
    page = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 7)
    item = F.struct("rank", F.concat(F.lit("L"), F.col("rank")).alias("citation_id"), F.concat(F.lit("t"), F.col("doc_id")).alias("title"), F.coalesce("source", F.lit("")).alias("source"), page.alias("page"), F.lit("direct").alias("status"), F.coalesce("text", F.lit("")).alias("content"))
    packs = docs.groupBy("question_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    rows = _t(spark, d, "benchmark").select(F.col("item_id").alias("question_id")).join(packs, "question_id", "left").withColumn("items", F.coalesce("items", F.array().cast(packs.schema["items"].dataType)))
    return rows.select("question_id", F.sha2(audit.context_text(F.transform("items", lambda x: x["citation_id"]), F.col("items")), 256).alias("context"))
