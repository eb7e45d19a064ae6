"""Queries over answers and their evidence: claims, citations, conflicts, delivery. Answers are composed from the part table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import claims
from .catalog import _t, register

# composed answers and evidence; the text is both Spark SQL and DuckDB SQL
_N = "chr(10)"
_ANSWER = f"""concat(CASE WHEN p_partkey % 5 < 4 THEN concat('## 直接结论', {_N}) ELSE '' END,
 CASE p_partkey % 7 WHEN 0 THEN '座深为 340 mm～460 mm，依据 GB/T 3326—2016。杯径 65 mm 适合成年人。[L1]' WHEN 1 THEN '建议选择 Tritan 材料，耐热更好。[L2]' WHEN 2 THEN '资料不足，无法给出确定数值。'
  WHEN 3 THEN '未成年人的手长为 150 mm，杯径应为 60 mm。[L9]' WHEN 4 THEN '手宽 P95 为 90 mm，因此推荐外径 70 mm。[W1]' WHEN 5 THEN '如果环境温度为 80℃，杯体需要验证。[L3]' ELSE '有效容量为 500 mL，容积占比为 80%。[L1][L2]' END, {_N},
 CASE p_partkey % 3 WHEN 0 THEN concat('| 参数 | 建议值 |', {_N}, '|---|---|', {_N}, '| 座高 | 400 mm [L2] |', {_N}, '| 座宽 | 建议 380 mm，更好 |', {_N}) WHEN 1 THEN '' ELSE concat('- 第一项要求：壁厚 2.5 mm。[L2]', {_N}, '- 第二项说明：圆角 3 mm。', {_N}) END, {_N},
 CASE p_partkey % 4 WHEN 0 THEN concat('## 风险与限制', {_N}, '材料牌号可能不同，需要进一步验证。') WHEN 1 THEN concat('## 推导过程', {_N}, '综合计算，总高度为 120 mm。[L1]') WHEN 2 THEN concat('## 设计建议', {_N}, '不涉及设计建议。') ELSE concat('## 条件', {_N}, '在高温场景的要求下，存在风险，需要测试核实。[L2]；尺寸为 45 mm；但是杯径不一致') END)"""
_ANSWERS = f"SELECT p_partkey AS answer_id, {_ANSWER} AS answer FROM {{0}}"
_EVIDENCE = """SELECT p_partkey AS answer_id, pos, CASE WHEN pos = 3 THEN 'web' ELSE 'local' END AS source_type, CASE (p_partkey + pos) % 4 WHEN 2 THEN 'indirect' WHEN 3 THEN 'scope_mismatch' ELSE 'direct' END AS evidence_status,
 CASE WHEN (p_partkey + pos) % 4 > 1 THEN 'said by the retrieval' END AS evidence_reason, CASE (p_partkey + pos) % 3 WHEN 0 THEN '成年人' WHEN 1 THEN '未成年人' ELSE '' END AS scope, CASE WHEN p_partkey * pos % 3 = 0 THEN 'Tritan TX1001' ELSE 'unknown' END AS material_grade,
 concat('GB/T 3326—2016 座深 ', CAST(300 + p_partkey % 50 AS VARCHAR(9)), ' mm', CASE WHEN pos = 1 THEN ' P95' ELSE '' END) AS content
 FROM {0}, (SELECT 0 AS pos UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) AS places WHERE NOT (pos = 3 AND p_partkey % 2 = 1) AND p_partkey % 11 > 0"""


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_ANSWERS.format("{part}"), part=_t(spark, d, "part"))


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    return claims.number_citations(spark.sql(_EVIDENCE.format("{part}"), part=_t(spark, d, "part")))


def _quoted(p: str) -> str:
    return p.replace("'", "''")


def _when(x: str, rules: tuple[tuple[str, str], ...], default: str) -> str:
    return f"CASE {' '.join(f"WHEN regexp_matches({x}, '{_quoted(p)}') THEN '{n}'" for n, p in rules)} ELSE '{default}' END"


_STRIP = "regexp_replace(regexp_replace({0}, '^\\s+', ''), '\\s+$', '')"
_ADVICE_ROLE = f"CASE WHEN {' OR '.join(f"regexp_matches({_STRIP.format('text')}, '{_quoted(p)}')" for p in claims.STRUCTURAL)} THEN 'structural' WHEN regexp_matches(text, '{claims.REFUSAL}|需要.*验证') THEN 'refusal' WHEN regexp_matches(text, '待验证|限制|风险|尚需|仍需') THEN 'limitation' ELSE 'substantive' END"
_CLAIMS = f"""an AS ({_ANSWERS.format("part")}),
li AS (SELECT answer_id, list_transform(string_split(answer, chr(10)), lambda x: trim(x)) AS t, string_split(answer, chr(10)) AS l FROM an),
kp AS (SELECT answer_id, array_to_string(list_filter(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN regexp_matches(t[i], '{claims.SEPARATOR}') OR (starts_with(ltrim(l[i]), '|') AND i < len(l) AND regexp_matches(t[i + 1], '{claims.SEPARATOR}')) THEN NULL ELSE l[i] END), lambda x: x IS NOT NULL), chr(10)) AS txt FROM li),
bl AS (SELECT answer_id, list_filter(string_split_regex(regexp_replace(txt, '(?m)^[ \t]*(\\|.*?)[ \t]*$', chr(10) || '\\1' || chr(10), 'g'), '\n\\s*\n'), lambda x: length(regexp_replace(x, '\\s', '', 'g')) > 0) AS b FROM kp),
be AS (SELECT answer_id, unnest(b) AS block, unnest(range(1, len(b) + 1)) AS pos FROM bl),
bh AS (SELECT *, nullif(regexp_extract({_STRIP.format("block")}, '{claims.HEADING}', 1), '') AS heading FROM be),
bs AS (SELECT *, count(heading) OVER (PARTITION BY answer_id ORDER BY pos) AS section FROM bh),
bt AS (SELECT *, max(heading) OVER w AS title, bool_or(heading IS NULL AND regexp_matches(block, '{claims.CITATION}')) OVER w AS cites FROM bs WINDOW w AS (PARTITION BY answer_id, section)),
bb AS (SELECT * FROM bt WHERE heading IS NULL AND (title IS NULL OR (NOT regexp_matches(title, '{claims.UNVERIFIED}') AND cites))),
s0 AS (SELECT answer_id, pos, regexp_extract_all(block, '{claims.CITATION}', 1) AS ofb, list_filter(string_split_regex(regexp_replace(block, '([。！？!?；;])\\s*', '\\1' || chr(10), 'g'), '\n+'), lambda x: length({_STRIP.format("x")}) >= 6) AS s FROM bb),
s1 AS (SELECT answer_id, pos, ofb, regexp_replace(unnest(s), '^[ \\-*•\t]+|[ \\-*•\t]+$', '', 'g') AS text, unnest(range(1, len(s) + 1)) AS k FROM s0),
s2 AS (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY pos, k) AS claim_no, {_ADVICE_ROLE} AS role, regexp_extract_all(text, '{claims.CITATION}', 1) AS own FROM s1),
cl AS (SELECT answer_id, claim_no, text, {_when("text", claims.TYPES, "unsupported")} AS type, role, CASE WHEN len(own) > 0 THEN own ELSE ofb END AS citations, regexp_extract_all(regexp_replace(text, '{claims.STANDARD}', ' ', 'g'), '{claims.NUMBER}', 1) AS numbers FROM s2 WHERE role <> 'structural')"""


@register(f"WITH {_CLAIMS} SELECT answer_id, claim_no, text, type, role, array_to_string(citations, ',') AS citations, array_to_string(numbers, ';') AS numbers FROM cl")
def claims_extract(spark: SparkSession, d: str) -> DataFrame:
    """Claims of composed answers with type, role, citations and numbers."""
    got = claims.extract(_answers(spark, d))
    return got.select("answer_id", "claim_no", "text", "type", "role", F.array_join("citations", ",").alias("citations"), F.array_join("numbers", ";").alias("numbers"))


_ASSESSED = f"""{_CLAIMS}, ev AS (SELECT *, CASE WHEN source_type = 'web' THEN 'W' ELSE 'L' END || row_number() OVER (PARTITION BY answer_id, source_type ORDER BY pos) AS citation FROM ({_EVIDENCE.format("part")})),
cc AS (SELECT answer_id, claim_no, text, unnest(citations) AS citation, unnest(range(0, len(citations))) AS nth FROM cl),
cd AS (SELECT cc.answer_id, claim_no, text, citation, nth, pos IS NOT NULL AS found, ev.* EXCLUDE (answer_id, citation), lower(concat_ws(' ', scope, material_grade, content)) AS src, list_transform(regexp_extract_all(text, '{claims.REFERENCE}', 1), lambda r: replace(lower(r), ' ', '')) AS refs FROM cc LEFT JOIN ev USING (answer_id, citation)),
az AS (SELECT *, CASE WHEN NOT found THEN 'missing' WHEN evidence_status = 'scope_mismatch' THEN 'mismatch' WHEN evidence_status = 'indirect' THEN 'indirect'
  WHEN (len(refs) > 0 AND len(list_filter(refs, lambda r: contains(replace(src, ' ', ''), r))) = 0) OR (contains(text, '成年人') AND contains(src, '未成年人') AND NOT contains(src, '成年人')) OR (contains(text, '未成年人') AND contains(src, '成年人') AND NOT contains(src, '未成年人')) THEN 'mismatch' ELSE 'full' END AS status FROM cd)"""


@register(f"WITH {_ASSESSED} SELECT answer_id, claim_no, nth, citation, pos, status FROM az")
def claims_assess(spark: SparkSession, d: str) -> DataFrame:
    """Every citation of every claim with its document and whether that applies."""
    return claims.assess(claims.extract(_answers(spark, d)), _evidence(spark, d)).select("answer_id", "claim_no", "nth", "citation", "pos", "status")


_CALC = "(regexp_matches(answer, '(?i)H\\s*/\\s*D') AND contains(answer, '有效液高') AND contains(answer, '总高度') AND contains(answer, '内径') AND contains(answer, '外径') AND NOT regexp_matches(answer, '两个口径|分别定义|不同口径|不得混用'))::INT + (regexp_matches(answer, '有效容量|额定容量') AND regexp_matches(answer, '容积占比|利用率') AND NOT contains(answer, '几何容量') AND NOT regexp_matches(answer, '除以|折算|换算'))::INT"
_RULES = [
    ("missing", "citation_invalid"), ("indirect", "indirect_evidence"), ("web", "web_evidence_unverified"),
    (f"regexp_matches(text, '{claims.PERCENTILE}') AND NOT regexp_matches(coalesce(src, ''), '{claims.PERCENTILE_SOURCE}')", "indirect_evidence"),
    (f"regexp_matches(text, '{claims.HAND}') AND regexp_matches(text, '{claims.CUP}') AND NOT regexp_matches(text, '{claims.NOT_DIRECT}')", "indirect_evidence"),
    (f"regexp_matches(text, '{claims.MATERIAL}') AND regexp_matches(text, '{claims.MATERIAL_ADVICE}') AND docs AND NOT graded", "indirect_evidence"),
    (f"type = 'design_inference' AND regexp_matches(text, '{claims.ADVICE}') AND NOT regexp_matches(text, '{claims.CONDITIONED}')", "recommendation_unconditional"),
    ("mismatch", "scope_mismatch"),
]
_AUDITED = f"""{_ASSESSED},
ag AS (SELECT answer_id, claim_no, bool_or(status = 'missing') AS missing, bool_or(status = 'mismatch') AS mismatch, bool_or(status = 'indirect') AS indirect, bool_or(found) AS docs, bool_or(found AND source_type = 'web') AS web, bool_or(coalesce(material_grade, 'unknown') <> 'unknown') AS graded, string_agg(concat_ws(' ', scope, material_grade, content), ' ') AS src, count(*) AS assessed FROM az GROUP BY ALL),
au AS (SELECT cl.*, ag.* EXCLUDE (answer_id, claim_no), {_CALC} AS wrong FROM cl JOIN an USING (answer_id) LEFT JOIN ag USING (answer_id, claim_no)),
aw AS (SELECT *, list_filter([{", ".join(f"CASE WHEN coalesce({c}, false) THEN '{s}' END" for c, s in _RULES)}], lambda x: x IS NOT NULL) AS warnings FROM au),
st AS (SELECT *, CASE WHEN role = 'refusal' THEN 'supported' {" ".join(f"WHEN list_contains(warnings, '{s}') THEN '{s}'" for s in ("citation_invalid", "scope_mismatch", "recommendation_unconditional", "indirect_evidence"))}
  WHEN type IN ('direct_fact', 'derived_result', 'compliance_claim') AND assessed IS NULL THEN 'unsupported' WHEN assessed > 0 THEN 'supported' ELSE 'unreferenced' END AS s0 FROM aw),
es AS (SELECT *, CASE WHEN claim_no = min(CASE WHEN wrong > 0 AND len(numbers) > 0 AND s0 = 'supported' THEN claim_no END) OVER (PARTITION BY answer_id) THEN 'calculation_inconsistent' ELSE s0 END AS evidence_status FROM st)"""
_UNSUP = "(evidence_status IN ('citation_invalid', 'scope_mismatch', 'calculation_inconsistent', 'recommendation_unconditional', 'indirect_evidence', 'unsupported') OR (evidence_status = 'unreferenced' AND (type = 'unsupported' OR (len(numbers) > 0 AND type <> 'assumption'))))"


@register(f"WITH {_AUDITED} SELECT answer_id, claim_no, array_to_string(warnings, ',') AS warnings, evidence_status FROM es")
def claims_audit(spark: SparkSession, d: str) -> DataFrame:
    """Warnings and evidence status of every claim."""
    return claims.audit(_answers(spark, d), _evidence(spark, d)).select("answer_id", "claim_no", F.array_join("warnings", ",").alias("warnings"), "evidence_status")


@register(f"""WITH {_AUDITED}, g AS (SELECT answer_id, count(*) AS n, count(*) FILTER (evidence_status = 'supported') AS s, count(*) FILTER {_UNSUP.replace("(", "(", 1)} AS u, count(*) FILTER (len(citations) > 0) AS t, sum(len(warnings)) AS w FROM es GROUP BY 1)
SELECT answer_id, coalesce(n, 0) AS claims, round(coalesce(s / n, 1), 3) AS support_rate, round(coalesce(u / n, 0), 3) AS unsupported_rate, round(coalesce(t / n, 1), 3) AS traceability, CAST(coalesce(w, 0) + {_CALC} AS BIGINT) AS severe, coalesce(u, 0) AS unsupported FROM an LEFT JOIN g USING (answer_id)""")
def claims_quality(spark: SparkSession, d: str) -> DataFrame:
    """Support, unsupported and traceability rates of every answer."""
    a = _answers(spark, d)
    return claims.quality(claims.audit(a, _evidence(spark, d)), a)


@register(f"""WITH {_CLAIMS}, c AS (SELECT answer_id, claim_no, list_sort(list_distinct(numbers)) AS n, list_distinct(regexp_extract_all(text, '{claims.WORD}', 1)) AS w FROM cl WHERE len(numbers) > 0)
SELECT x.answer_id, x.claim_no AS a, y.claim_no AS b, array_to_string(list_sort(list_intersect(x.w, y.w)), ',') AS shared FROM c x JOIN c y ON x.answer_id = y.answer_id AND x.claim_no < y.claim_no AND x.n <> y.n AND len(list_intersect(x.w, y.w)) > 0""")
def claims_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Claims of an answer that share a word but not all numbers."""
    return claims.conflicts(claims.extract(_answers(spark, d))).withColumn("shared", F.array_join("shared", ","))


@register(f"""WITH {_AUDITED}, du AS (SELECT answer_id, {" AND ".join(f"bool_or(regexp_matches(text, '{p}'))" for p in claims.DUTIES)} AS duties FROM es GROUP BY 1), e2 AS (SELECT es.*, duties FROM es JOIN du USING (answer_id)),
dv AS (SELECT answer_id, claim_no, bool_or(found) AS valid, bool_or(found AND evidence_status = 'direct') AS direct FROM az GROUP BY ALL),
iss AS (SELECT DISTINCT answer_id, 'citation_invalid' AS status, 0 AS claim_no FROM (SELECT answer_id, unnest(regexp_extract_all(answer, '{claims.CITATION}', 1)) AS citation FROM an) u ANTI JOIN ev USING (answer_id, citation)
 UNION SELECT answer_id, CASE WHEN NOT (coalesce(valid, false) AND duties) THEN 'recommendation_unconditional' WHEN NOT coalesce(direct, false) THEN 'indirect_evidence' END AS s, claim_no FROM e2 LEFT JOIN dv USING (answer_id, claim_no) WHERE type IN ('design_inference', 'derived_result') AND regexp_matches(text, '{claims.ADVICE}') AND s IS NOT NULL
 UNION SELECT answer_id, evidence_status, claim_no FROM e2 WHERE role <> 'refusal' AND evidence_status <> 'supported' AND NOT (evidence_status IN ('unsupported', 'unreferenced') AND len(numbers) = 0 AND type NOT IN ('direct_fact', 'compliance_claim', 'design_inference', 'derived_result')) AND NOT (evidence_status = 'recommendation_unconditional' AND duties)
 UNION SELECT answer_id, w, claim_no FROM (SELECT answer_id, unnest(warnings) AS w, claim_no, duties FROM e2) WHERE NOT (w = 'recommendation_unconditional' AND duties)
 UNION SELECT answer_id, 'calculation_inconsistent', 0 FROM an WHERE {_CALC} > 0),
ig AS (SELECT answer_id, count(*) AS issues, array_to_string(list_sort(list(DISTINCT status)), ',') AS statuses FROM iss GROUP BY 1)
SELECT answer_id, coalesce(issues, 0) AS issues, coalesce(statuses, '') AS statuses, issues IS NULL AND answer_id IN (SELECT answer_id FROM ev) AS deliverable FROM an LEFT JOIN ig USING (answer_id)""")
def claims_delivery(spark: SparkSession, d: str) -> DataFrame:
    """Distinct blocking issues of every answer and whether it can be delivered."""
    a, e = _answers(spark, d), _evidence(spark, d)
    return claims.delivery(a, claims.audit(a, e), e)


@register(f"""WITH {_AUDITED} SELECT answer_id, claim_no, text AS recommendation, array_to_string(citations, ',') AS evidence_ids, evidence_status FROM es WHERE type IN ('design_inference', 'derived_result') AND regexp_matches(text, '{claims.ADVICE}')""")
def claims_recommendations(spark: SparkSession, d: str) -> DataFrame:
    """Advice as conditional decisions."""
    got = claims.recommendations(claims.audit(_answers(spark, d), _evidence(spark, d)))
    return got.withColumn("evidence_ids", F.array_join("evidence_ids", ","))
