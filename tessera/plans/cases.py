"""Queries over contracts of multi-hop questions and their audit, composed from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import audit, contracts
from .audits import _sql_bare, _sql_normal, _without
from .catalog import _t, register
from .ranking import _sql_list

# composed rows; the text is both Spark SQL and DuckDB SQL
_SLICES = "SELECT CASE WHEN p_partkey % 50 > 0 THEN p_partkey - CASE WHEN p_partkey % 20 = 3 THEN 1 ELSE 0 END END AS question_id, CASE p_partkey % 9 WHEN 0 THEN 'odd' WHEN 1 THEN NULL WHEN 2 THEN 'refusal' ELSE 'fact' END AS case_type, CASE p_partkey % 7 WHEN 0 THEN 'none' ELSE 'low' END AS risk_level, p_partkey % 6 AS n_tags, CASE WHEN p_partkey % 8 > 0 THEN p_partkey % 2 = 0 END AS flaky FROM {0}"


@register(f"""WITH s AS ({_SLICES.format("part")}), t AS (SELECT *, count(*) OVER (PARTITION BY question_id) > 1 AS twice FROM s)
SELECT DISTINCT question_id, unnest({_sql_list([("question_id IS NULL", "'missing_id'"), ("case_type IS NULL", "'missing_case_type'"), ("case_type NOT IN ('ambiguous', 'fact', 'multi_hop', 'refusal')", "'unknown_case_type'"), ("risk_level NOT IN ('high', 'low', 'medium')", "'unknown_risk_level'"), ("n_tags = 0", "'no_tags'"), ("flaky IS NULL", "'flaky_not_boolean'"), ("twice", "'repeated_id'")])}) AS problem FROM t""")
def case_slice_problems(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with slice definitions (M1)."""
    s = spark.sql(_SLICES.format("{part}"), part=_t(spark, d, "part"))
    return contracts.slice_problems(s.withColumn("slice_tags", F.array_repeat(F.lit("x"), F.col("n_tags").cast("int"))))


_SNAPSHOT = "SELECT concat('q', CAST(doc_id % 40 AS VARCHAR(9))) AS question_id, CAST(doc_id AS INT) AS rank, concat('c', CAST(doc_id % 90 AS VARCHAR(9)), 'x') AS chunk_id, concat('chunk ', CAST(doc_id % 90 AS VARCHAR(9)), ' holds P50 and 座高 ', CAST(doc_id % 90 % 4 AS VARCHAR(9)), '0 mm') AS content FROM {0}"
_HOPS = "SELECT p_partkey AS case_id, concat('h', CAST(h.k AS VARCHAR(3))) AS hop_id, concat('q', CAST((p_partkey + h.k) % 43 AS VARCHAR(9))) AS from_question, CASE WHEN p_partkey % 5 = 0 THEN 'c' ELSE concat('c', CAST((p_partkey + h.k) % 43 + 40 * (p_partkey % 3) AS VARCHAR(9)), CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE '' END) END AS prefix, CASE p_partkey % 4 WHEN 0 THEN '座高 00 mm' WHEN 1 THEN 'chunk' ELSE '' END AS span, CASE p_partkey % 3 WHEN 0 THEN 'P50' WHEN 1 THEN '座 高' ELSE '（）' END AS term, CASE WHEN p_partkey % 6 = 0 THEN 'P95' ELSE 'holds' END AS other FROM {0}, (SELECT 1 AS k UNION ALL SELECT 2) AS h WHERE NOT (p_partkey % 10 = 7 AND h.k = 2)"
_CASES = "SELECT p_partkey AS case_id, CASE WHEN p_partkey % 12 = 0 THEN ' ' ELSE 'how P50?' END AS question, concat('q', CAST((p_partkey + 1) % 43 AS VARCHAR(9))) AS s1, CASE WHEN p_partkey % 8 > 0 THEN concat('q', CAST((p_partkey + 2) % 43 AS VARCHAR(9))) ELSE 'q0' END AS s2, CASE p_partkey % 9 WHEN 0 THEN 'partial' WHEN 1 THEN 'some' WHEN 2 THEN NULL ELSE 'complete' END AS coverage, p_partkey % 2 AS needs FROM {0}"


def _hops(spark: SparkSession, d: str) -> DataFrame:
    h = spark.sql(_HOPS.format("{part}"), part=_t(spark, d, "part"))
    return h.withColumn("groups", F.array(F.array("term"), F.array("other")))


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_CASES.format("{part}"), part=_t(spark, d, "part")).withColumn("sources", F.array("s1", "s2"))


def _snapshot(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_SNAPSHOT.format("{docs}"), docs=_t(spark, d, "documents"))


def _sql_needle(x: str) -> str:
    return _sql_normal(_without(audit.PARENTHETICAL, _without(audit.LABEL, x)))


@register(f"""WITH c AS ({_CASES.format("part")}), h AS ({_HOPS.format("part")}), n AS (SELECT case_id, count(*) AS n FROM h GROUP BY 1),
a AS (SELECT case_id, unnest({_sql_list([("trim(question) = ''", "'missing_question'"), ("coalesce(n, 0) < 2", "'fewer_than_two_hops'"), ("coalesce(coverage, 'complete') NOT IN ('complete', 'partial')", "'unknown_coverage'"), ("coverage = 'partial' AND needs = 0", "'partial_without_needs'")])}) AS problem FROM c LEFT JOIN n USING (case_id)),
b AS (SELECT case_id, unnest({_sql_list([(f"{_sql_needle('term')} = '' OR {_sql_needle('other')} = ''", "'term_normalises_to_nothing'"), ("from_question NOT IN (s1, s2)", "'source_not_declared'")])}) AS problem FROM h JOIN c USING (case_id))
SELECT DISTINCT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def case_spec_problems(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with multi-hop specifications (M2)."""
    cases = _cases(spark, d).withColumn("unsupported_needs", F.array_repeat(F.lit("x"), F.col("needs").cast("int")))
    return contracts.spec_problems(cases, _hops(spark, d).withColumn("chunk_id", F.col("prefix")))


@register(f"""WITH h AS ({_HOPS.format("part")}), s AS ({_SNAPSHOT.format("documents")}), u AS (SELECT DISTINCT question_id, chunk_id, content FROM s),
j AS (SELECT case_id, hop_id, h.from_question IN (SELECT question_id FROM s) AS known, count(chunk_id) AS n, min(chunk_id) AS chunk_id, regexp_replace(lower(arg_min(content, chunk_id)), '\\s+', '', 'g') AS body, any_value(regexp_replace(lower(span), '\\s+', '', 'g')) AS span, any_value(regexp_replace(lower(term), '\\s+', '', 'g')) AS term, any_value(regexp_replace(lower(other), '\\s+', '', 'g')) AS other
  FROM h LEFT JOIN u ON u.question_id = h.from_question AND starts_with(u.chunk_id, h.prefix) GROUP BY case_id, hop_id, from_question)
SELECT case_id, hop_id, CASE WHEN n = 1 THEN chunk_id END AS chunk_id, CASE WHEN NOT known THEN 'unknown_source' WHEN n = 0 THEN 'chunk_not_found' WHEN n > 1 THEN 'prefix_not_unique' WHEN span <> '' AND NOT contains(body, span) THEN 'span_not_in_chunk' WHEN NOT contains(body, term) OR NOT contains(body, other) THEN 'term_not_in_chunk' END AS problem FROM j""")
def case_hops(spark: SparkSession, d: str) -> DataFrame:
    """Every hop's chunk by its prefix, and why a hop can't be answered."""
    return contracts.resolve_hops(_hops(spark, d), _snapshot(spark, d))


_SOURCES = "SELECT case_id, 1 AS nth, s1 AS question_id FROM c UNION ALL SELECT case_id, 2, s2 FROM c"


@register(f"""WITH c AS ({_CASES.format("part")}), s AS ({_SNAPSHOT.format("documents")}), f AS (SELECT case_id, chunk_id, min((nth, rank)) AS k FROM ({_SOURCES}) JOIN s USING (question_id) GROUP BY ALL)
SELECT case_id, chunk_id, row_number() OVER (PARTITION BY case_id ORDER BY k, chunk_id) AS position, row_number() OVER (PARTITION BY case_id ORDER BY k, chunk_id) <= 5 AS within FROM f""")
def case_pooled(spark: SparkSession, d: str) -> DataFrame:
    """Whole source cases pooled in order with the place of every chunk."""
    c = _cases(spark, d)
    sources = c.select("case_id", F.posexplode("sources").alias("k", "question_id")).select("case_id", (F.col("k") + 1).alias("nth"), "question_id")
    return contracts.pooled(sources, _snapshot(spark, d)).drop("content")


_TERMS = "SELECT p_partkey % 60 AS case_id, concat('t', CAST(p_partkey % 3 AS VARCHAR(3))) AS place, CASE WHEN p_partkey % 2 = 0 THEN 'span' ELSE 'term' END AS kind, CASE p_partkey % 8 WHEN 0 THEN 'P5' WHEN 1 THEN p_name WHEN 2 THEN '（）' WHEN 3 THEN lower(p_name) WHEN 4 THEN substr(p_name, 1, 4) WHEN 5 THEN '9' ELSE p_brand END AS raw, concat('what is ', CASE WHEN p_partkey % 60 % 2 = 0 THEN 'P5 almond' ELSE 'Brand' END) AS question FROM {0}"


@register(f"""WITH t AS (SELECT DISTINCT case_id, place, raw, CASE WHEN kind = 'span' THEN {_sql_normal(_sql_bare(_without(audit.PARENTHETICAL, _without(audit.LABEL, "raw"))))} ELSE {_sql_needle("raw")} END AS x, {_sql_normal("question")} AS q FROM ({_TERMS.format("part")}))
SELECT DISTINCT * FROM (SELECT case_id, place, raw, unnest({_sql_list([("x = ''", "'empty-needle'"), ("length(x) = 1", "'vacuous-needle'"), ("q <> '' AND length(x) >= 2 AND contains(q, x)", "'echoed'")])}) AS finding FROM t
 UNION ALL SELECT a.case_id, a.place, a.raw, 'shadowed' FROM t a JOIN t b ON a.case_id = b.case_id AND a.place = b.place AND a.raw <> b.raw AND a.x <> '' AND a.x <> b.x AND contains(b.x, a.x))""")
def case_lint(spark: SparkSession, d: str) -> DataFrame:
    """Empty, vacuous, shadowed and echoed elements of contracts (M6)."""
    return contracts.lint_terms(spark.sql(_TERMS.format("{part}"), part=_t(spark, d, "part")))


_OBSERVED = "SELECT l_orderkey AS row_id, l_linenumber AS n, l_partkey % 100 AS question_id, concat('h', CAST(l_linenumber % 3 AS VARCHAR(3))) AS hop_id, l_suppkey % 40 AS chunk_id FROM {0}"
_PACKS = "SELECT DISTINCT l_partkey % 100 AS question_id, l_suppkey % 20 AS chunk_id FROM {0}"
_SAID = "SELECT q AS question_id, concat('h', CAST(h AS VARCHAR(3))) AS hop_id, CASE (q + h) % 4 WHEN 0 THEN 'incorrect' WHEN 1 THEN 'correct_paraphrase' WHEN 2 THEN 'damaged_span' ELSE 'correct_refusal' END AS verdict FROM (SELECT DISTINCT l_partkey % 100 AS q, l_linenumber % 3 AS h FROM {0}) AS a WHERE q % 11 > 0"
_JUDGED = f"""o AS ({_OBSERVED.format("lineitem")}), p AS ({_PACKS.format("lineitem")}), s AS ({_SAID.format("lineitem")}),
j AS (SELECT o.*, p.question_id IS NOT NULL AS chunk_in_pack, CASE WHEN p.question_id IS NULL THEN 'correct_refusal' ELSE s.verdict END AS final, s.verdict AS said FROM o LEFT JOIN p USING (question_id, chunk_id) LEFT JOIN s USING (question_id, hop_id))"""


def _judged(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem")
    seen = contracts.reachable(spark.sql(_OBSERVED.format("{li}"), li=li), spark.sql(_PACKS.format("{li}"), li=li))
    return contracts.verdicts(seen, spark.sql(_SAID.format("{li}"), li=li))


@register(f"WITH {_JUDGED} SELECT row_id, n, question_id, hop_id, chunk_in_pack, final AS verdict, coalesce(said <> final, false) AS overridden FROM j")
def case_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Human verdicts with mechanical overrides for chunks that never reached the model."""
    return _judged(spark, d).select("row_id", "n", "question_id", "hop_id", "chunk_in_pack", "verdict", "overridden")


@register(f"WITH {_JUDGED} SELECT count(*) AS audited, count(*) FILTER (final IN ('correct_paraphrase', 'damaged_span')) AS credited, count(*) FILTER (final = 'correct_refusal') AS unmeasurable, count(*) FILTER (final = 'incorrect') AS incorrect, count(*) FILTER (final IS NULL) AS missing, count(*) FILTER (coalesce(said <> final, false)) AS overridden FROM j")
def case_verdict_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the audit by verdict."""
    return contracts.verdict_totals(_judged(spark, d))


@register("""WITH a AS (SELECT p_partkey, p_name FROM part), b AS (SELECT p_partkey, CASE WHEN p_partkey % 90 = 0 THEN upper(p_name) ELSE p_name END AS p_name FROM part WHERE p_partkey % 70 > 0)
SELECT *, 'built' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'stored' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def case_stale(spark: SparkSession, d: str) -> DataFrame:
    """Rows in which a regenerated table and the stored one differ (M5)."""
    p = _t(spark, d, "part")
    return contracts.stale(p.select("p_partkey", "p_name"), p.where("p_partkey % 70 > 0").selectExpr("p_partkey", "CASE WHEN p_partkey % 90 = 0 THEN upper(p_name) ELSE p_name END AS p_name"))


@register("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, split_part(coalesce(text, ''), ' ', 60) AS w FROM documents), p AS (SELECT doc_id, t, CASE WHEN w <> '' AND strpos(t, w) > 0 THEN strpos(t, w) END AS k FROM d)
SELECT doc_id, sha256(CASE WHEN k IS NULL THEN t[1:280] ELSE substr(t, greatest(1, k - 140), k + 140 - greatest(1, k - 140)) END) AS excerpt FROM p""")
def case_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """Text around the first found hit."""
    t = F.coalesce("text", F.lit(""))
    docs = _t(spark, d, "documents").select("doc_id", t.alias("t"), F.split_part(t, F.lit(" "), F.lit(60)).alias("w"))
    hits = F.filter(F.array(F.lit("no such hit"), F.col("w")), lambda x: x != "")
    return docs.select("doc_id", F.sha2(contracts.excerpt(F.col("t"), hits), 256).alias("excerpt"))


_ENDS = "SELECT p_partkey AS id, concat('答案 ', p_name, CASE p_partkey % 7 WHEN 0 THEN ' .calc' WHEN 1 THEN '。.final.END ' WHEN 2 THEN '</answer>' WHEN 3 THEN concat('.analysis', chr(10), '<final> ') WHEN 4 THEN '  ' WHEN 5 THEN '.calculator' ELSE '' END) AS answer, concat(' ', p_brand, ' / ', p_name, '! ') AS name, p_size / 50e0 AS share FROM {0}"


@register(f"""WITH r AS ({_ENDS.format("part")}), a AS (SELECT *, regexp_replace(answer, '{text.CONTROL}', '') AS one FROM r), b AS (SELECT *, regexp_replace(one, '{text.TAG}', '') AS two FROM a), c AS (SELECT *, regexp_replace(two, '\\s+$', '') AS three FROM b)
SELECT id, three AS text, array_to_string({_sql_list([("one <> answer", "'remove_trailing_control_token'"), ("two <> one", "'remove_trailing_tag'"), ("three <> two", "'rstrip_trailing_whitespace'")])}, ',') AS rules, regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9._]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, printf('%.1f%%', 100 * share) AS pct, sha256(concat_ws(chr(31), id::VARCHAR, name))[1:16] AS run_id FROM c""")
def text_sanitised(spark: SparkSession, d: str) -> DataFrame:
    """Answers without what models append, slugs, percentages and composite ids."""
    r = spark.sql(_ENDS.format("{part}"), part=_t(spark, d, "part")).withColumn("s", text.sanitised(F.col("answer")))
    return r.select("id", "s.text", F.array_join("s.rules", ",").alias("rules"), text.slug(F.col("name")).alias("slug"), text.percent(F.col("share")).alias("pct"), text.composite_id(F.col("id"), F.col("name")).alias("run_id"))


_AGENDA = "sha256(concat_ws('|', '7', round::VARCHAR, question_id::VARCHAR{0}))"


@register(f"""WITH q AS (SELECT c_custkey AS question_id, unnest([0, 1, 2]) AS round FROM customer)
SELECT round, row_number() OVER (PARTITION BY round ORDER BY {_AGENDA.format("")}, question_id) AS place, question_id, CASE WHEN {_AGENDA.format(", 'coin'")}[1] < '8' THEN 'a' ELSE 'b' END AS first, CASE WHEN {_AGENDA.format(", 'coin'")}[1] < '8' THEN 'b' ELSE 'a' END AS second FROM q""")
def case_agenda(spark: SparkSession, d: str) -> DataFrame:
    """Each round's questions in a drawn order with the arm that goes first."""
    return contracts.agenda(_t(spark, d, "customer").select(F.col("c_custkey").alias("question_id")), ("a", "b"), 3, 7)


@register("""WITH r AS (SELECT event_id AS seq, user_id % 60 AS question_id, CASE WHEN event_id % 3 = 0 THEN 'before' ELSE 'after' END AS run, CASE WHEN event_id % 4 > 0 THEN value END AS v FROM events), f AS (SELECT question_id, run, arg_min(v, seq) AS v FROM r WHERE v IS NOT NULL GROUP BY ALL)
SELECT question_id, a.v AS before, b.v AS after, round(b.v - a.v, 6) AS diff FROM f a JOIN f b USING (question_id) WHERE a.run = 'before' AND b.run = 'after'""")
def case_first_values(spark: SparkSession, d: str) -> DataFrame:
    """Questions of two runs by the first value of each."""
    runs = _t(spark, d, "events").selectExpr("event_id AS seq", "user_id % 60 AS question_id", "CASE WHEN event_id % 3 = 0 THEN 'before' ELSE 'after' END AS run", "CASE WHEN event_id % 4 > 0 THEN value END AS v")
    return contracts.first_values(runs, "v").withColumn("diff", F.round("diff", 6))


@register("""WITH r AS (SELECT o_orderkey AS id, o_custkey AS question_id, 'ready' AS status FROM orders), s AS (SELECT DISTINCT c_custkey AS question_id FROM customer WHERE c_custkey % 3 > 0)
SELECT id, question_id, CASE WHEN question_id IN (SELECT question_id FROM s) THEN status ELSE 'missing_snapshot' END AS status FROM r""")
def case_with_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose question has no snapshot."""
    rows = _t(spark, d, "orders").selectExpr("o_orderkey AS id", "o_custkey AS question_id", "'ready' AS status")
    return contracts.with_snapshot(rows, _t(spark, d, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("question_id"))).select("id", "question_id", "status")


@register(f"""WITH h AS ({_HOPS.format("part")}) SELECT case_id, hop_id, CASE WHEN span = 'chunk' THEN NULL ELSE span END AS span, CASE WHEN span = 'chunk' THEN 'chunk;number' ELSE concat(term, ';', other) END AS terms, span = 'chunk' AS demoted FROM h""")
def case_demoted(spark: SparkSession, d: str) -> DataFrame:
    """Hops that lose a span which only asks for wording."""
    swap = spark.createDataFrame([("chunk", [["chunk"], ["number"]])], "span string, groups array<array<string>>")
    return contracts.demote(_hops(spark, d), swap).select("case_id", "hop_id", "span", F.array_join(F.flatten("groups"), ";").alias("terms"), "demoted")
