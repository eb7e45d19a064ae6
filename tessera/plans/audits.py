"""Queries of the answer audit over composed answers and contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit
from .answers import _ANSWER
from .catalog import _t, register

# composed rows; the text is both Spark SQL and DuckDB SQL
_ROWS = f"""SELECT p_partkey AS id, CASE WHEN p_partkey % 13 = 0 THEN '{audit.FALLBACKS[0]}' WHEN p_partkey % 19 = 0 THEN '' ELSE concat({_ANSWER}, CASE WHEN p_partkey % 6 = 0 THEN concat(chr(10), chr(10), '主要尺寸：', chr(10), chr(10), '1. 座高 410 mm', chr(10), '2. 无法确认 2025 年的数值', chr(10), '- 表1-1 推导得到 55 mm') ELSE '' END) END AS answer,
 CASE p_partkey % 4 WHEN 0 THEN '座深：340 mm～460 mm' WHEN 1 THEN '座高（T1）400 mm' WHEN 2 THEN '目标年龄段的百分位数' ELSE '手宽 P95 90mm' END AS span1,
 CASE p_partkey % 3 WHEN 0 THEN '杯径 65毫米' WHEN 1 THEN '第 3 项不小于 2.5 mm' ELSE 'V = D1² + 12 / 1000' END AS span2,
 p_partkey % 11 > 0 AS has_items, p_partkey % 7 <> 2 AS has_sources, p_partkey % 7 = 2 AS has_refusals, p_partkey % 17 = 0 AS has_ambiguities, p_partkey % 4 = 1 AS has_hops FROM {{0}}"""
_CONTENT = ("座深 340 mm 至 460 mm", "耐热 80℃，壁厚 2.5 mm，座高 400", "杯径 65 mm")


def _rows(spark: SparkSession, d: str) -> DataFrame:
    r = spark.sql(_ROWS.format("{part}"), part=_t(spark, d, "part"))
    items = F.array(*[F.struct(F.lit(f"L{i + 1}").alias("citation_id"), F.lit(f"src/L{i + 1}.md").alias("source"), F.lit(c).alias("content")) for i, c in enumerate(_CONTENT)])
    words = lambda *w: F.array(*map(F.lit, w)).cast("array<string>")
    none = F.lit(None).cast("array<string>")
    group = lambda alt=none, neg=none, obj=none: F.struct(alt.alias("alternatives"), neg.alias("negation"), obj.alias("object"))
    hops = F.array(*[F.struct(F.lit(n).alias("hop_id"), F.lit(s).alias("span"), words(*a).alias("alternatives"), F.array(group(words(*t))).alias("groups")) for n, s, a, t in (("h1", "座深 340～460 mm", [], ["座深"]), ("h2", "总高度 125 mm", ["总高度为 120 mm"], ["P50", "总高度"]))])
    return r.select("id", "answer", "span1", "span2", F.when(F.col("has_items"), items).alias("items"), F.array("span1", "span2").alias("spans"), F.when(F.col("has_sources"), words("L1.md", "other.pdf")).alias("sources"), F.array(group(words("座深", "座高")), group(obj=words("直接"), neg=words())).alias("terms"), F.when(F.col("has_refusals"), F.array(group(words("无法", "资料不足")))).alias("refusals"), F.when(F.col("has_ambiguities"), F.array(group(neg=words(), obj=words()))).alias("ambiguities"), F.when(F.col("has_hops"), hops).alias("hops"))


def _sql_normal(x: str) -> str:
    out = f"lower(coalesce({x}, ''))"
    for a, b in audit.REPLACED:
        out = f"replace({out}, '{a}', '{b}')"
    return f"regexp_replace(regexp_replace(regexp_replace({out}, '\\s+', '', 'g'), '{audit.RANGE_UNITS}', '\\1~\\3\\2', 'g'), '{audit.NOT_KEPT}', '', 'g')"


def _sql_bare(x: str) -> str:
    # twice, for labels that share a boundary
    once = lambda y: f"regexp_replace({y}, '(^|[^A-Za-z0-9])[A-Za-z]\\d{{1,2}}($|[^A-Za-z0-9])', '\\1\\2', 'g')"
    return f"CASE WHEN regexp_matches({x}, '{audit.MATH}') THEN {x} ELSE {once(once(x))} END"


def _without(pattern: str, x: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '', 'g')"


def _sql_span(rows: str) -> str:
    """CTEs from ``rows`` (id, n, span, answer) to ``mt`` (id, n, matched)."""
    en, an = f"regexp_extract_all(e, '{audit.DIGITS}')", f"regexp_extract_all(a, '{audit.DIGITS}')"
    concept = " AND ".join(f"(NOT contains(e, '{t}') OR {' OR '.join(f"contains(a, '{w}')" for w in ws)})" for t, ws in audit.SYNONYMS.items())
    return f"""sp AS (SELECT id, n, {_without(audit.LABEL, "coalesce(span, '')")} AS s, {_without(audit.LABEL, "coalesce(answer, '')")} AS w FROM {rows}),
sq AS (SELECT id, n, unnest([{_without(audit.PARENTHETICAL, "s")}, s]) AS s, w FROM sp),
sr AS (SELECT id, n, {_sql_normal(_sql_bare("s"))} AS e, {_sql_normal(_sql_bare("w"))} AS a FROM sq),
su AS (SELECT *, {en} AS en, {an} AS an, regexp_extract_all(e, '{audit.TOKEN}') AS et, regexp_extract_all(a, '{audit.TOKEN}') AS ta FROM sr),
sv AS (SELECT *, list_transform(en, lambda x: list_position(an, x)) AS fp, array_to_string(et, '') AS ej, regexp_replace(regexp_replace(e, '{audit.UNIT_NUMBER}', '', 'g'), '{audit.FILLER}', '', 'g') AS wd FROM su),
sw AS (SELECT *, regexp_extract(ej, '{audit.LAST_NUMBER}', 1) AS nm, regexp_replace(ej, '{audit.LAST_NUMBER}', '') AS pf, array_to_string(et[greatest(1, len(et) - 2):], '') AS lt FROM sv),
sx AS (SELECT id, n, e <> '' AND (contains(a, e) OR (NOT regexp_matches(e, '\\d') AND regexp_matches(e, '{"|".join(audit.SYNONYMS)}') AND {concept})
  OR (len(en) > 1 AND len(list_filter(fp, lambda x: x IS NULL)) = 0 AND fp = list_sort(fp)) OR (len(en) = 1 AND fp[1] IS NOT NULL AND (wd = '' OR contains(a, right(wd, 4))))
  OR (len(en) >= 2 AND regexp_matches(concat(',', array_to_string(an, ','), ','), concat(',', array_to_string(en, ',(?:[0-9]+,)*'), ',')))
  OR (len(et) > 0 AND ((len(ta) >= len(et) AND len(list_filter(range(1, len(ta) - len(et) + 2), lambda i: ta[i:i + len(et) - 1] = et)) > 0) OR (nm <> '' AND length(concat(right(pf, 4), nm)) >= 5 AND contains(a, concat(right(pf, 4), nm))) OR (length(lt) >= 4 AND contains(array_to_string(ta, ''), lt))))) AS m FROM sw),
mt AS (SELECT id, n, bool_or(m) AS matched FROM sx GROUP BY ALL)"""


@register(f"""WITH r AS ({_ROWS.format("part")}), two AS (SELECT id, 1 AS n, span1 AS span, answer FROM r UNION ALL SELECT id, 2, span2, answer FROM r), {_sql_span("two")} SELECT id, n, matched FROM mt""")
def audit_spans(spark: SparkSession, d: str) -> DataFrame:
    """Declared spans found in answers through all fall-backs."""
    r = _rows(spark, d).select("id", "answer", F.posexplode(F.array("span1", "span2")).alias("k", "span"))
    return r.select("id", (F.col("k") + 1).alias("n"), audit.span_matches(F.col("span"), F.col("answer")).alias("matched"))


def _sql_refuses(text: str, at: str, value: str) -> str:
    return f"regexp_matches(concat(regexp_extract({text}[1:{at}], '([^{audit.STOPS}]*)$', 1), {value}, regexp_extract({text}[{at} + length({value}) + 1:], '^(\\s*[^{audit.STOPS}]*)', 1)), '{audit.REFUSAL}')"


_BLOCKS = f"""bp AS (SELECT id, list_filter(list_transform(string_split_regex(answer, '\\n\\s*\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS p FROM r),
bq AS (SELECT id, p[i] AS x, i, i > 1 AND coalesce(regexp_matches(p[i - 1], '：$'), false) AND regexp_matches(p[i], '^(?:\\s*{audit.LIST_MARK}[^\\n]*(?:\\n|$)|\\s*\\n)+$') AS follows, regexp_replace(split_part(p[i], chr(10), 1), '^\\s+|\\s+$', '', 'g') AS head FROM (SELECT id, p, unnest(range(1, len(p) + 1)) AS i FROM bp)),
br AS (SELECT id, string_agg(concat(CASE WHEN i = 1 THEN '' WHEN follows THEN chr(1) ELSE concat(chr(10), chr(10)) END, CASE WHEN follows OR (regexp_matches(head, '：$') AND NOT regexp_matches(head, '^{audit.LIST_MARK}')) THEN replace(x, chr(10), chr(1)) ELSE x END), '' ORDER BY i) AS t FROM bq GROUP BY id),
bu AS (SELECT id, unnest(string_split(regexp_replace(replace(t, concat(chr(10), chr(10)), chr(2)), '\\n(\\s*{audit.LIST_MARK})', chr(2) || '\\1', 'g'), chr(2))) AS b FROM br),
bv AS (SELECT id, regexp_replace(replace(b, chr(1), chr(10)), '^\\s+|\\s+$', '', 'g') AS b FROM bu),
bw AS (SELECT id, b, regexp_replace(regexp_replace(b, '(?m)^[ \t]*{audit.LIST_MARK}[ \t]*', '', 'g'), '{audit.DESIGNATION}', ' ', 'g') AS t FROM bv WHERE b <> ''),
bx AS (SELECT id, b, string_split_regex(t, '{audit.DIGITS}') AS ps, regexp_extract_all(t, '{audit.DIGITS}') AS vs FROM bw),
by_ AS (SELECT id, b, list_filter(list_transform(range(1, len(vs) + 1), lambda k: {{'v': vs[k], 'at': (list_sum(list_transform(ps[1:k], lambda q: length(q))) + coalesce(list_sum(list_transform(vs[1:k - 1], lambda q: length(q))), 0))::BIGINT}}), lambda z: NOT {_sql_refuses("b", "z.at", "z.v")}) AS told FROM bx),
bz AS (SELECT id, count(*) FILTER (len(told) > 0) AS claims, count(*) FILTER (len(told) > 0 AND (regexp_matches(b, '\\[L\\d+\\]') OR regexp_matches(b, '{audit.NOT_FACT}'))) AS attributed FROM by_ GROUP BY id),
cv AS (SELECT r.id, coalesce(claims, 0) AS claims, coalesce(attributed, 0) AS attributed, CASE WHEN claims > 0 THEN round(attributed / claims, 3) END AS coverage FROM r LEFT JOIN bz USING (id))"""
_ALL_CONTENT = " ".join(_CONTENT)
_NUMBERS = f"""nb AS (SELECT id, answer, has_items, string_split_regex(answer, '{audit.ANSWER_NUMBER}') AS ps, regexp_extract_all(answer, '{audit.ANSWER_NUMBER}', 0) AS fs, regexp_extract_all(answer, '{audit.ANSWER_NUMBER}', 1) AS vs FROM r),
nc AS (SELECT id, answer, has_items, list_transform(range(1, len(vs) + 1), lambda k: {{'v': vs[k], 'at': (list_sum(list_transform(ps[1:k], lambda q: length(q))) + list_sum(list_transform(fs[1:k], lambda q: length(q))) - length(vs[k]))::BIGINT}}) AS z FROM nb),
nd AS (SELECT id, list_transform(list_filter(z, lambda y: NOT list_contains(CASE WHEN has_items THEN regexp_extract_all('{_ALL_CONTENT}', '{audit.DIGITS}') ELSE [] END, regexp_extract(y.v, '{audit.DIGITS}')) AND NOT {_sql_refuses("answer", "y.at", "y.v")}), lambda y: y.v) AS bad FROM nc)"""


@register(f"""WITH r AS ({_ROWS.format("part")}), {_BLOCKS}, {_NUMBERS} SELECT cv.*, array_to_string(bad, ';') AS unsupported FROM cv JOIN nd USING (id)""")
def audit_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numeric claims with their attribution, and numbers that no evidence has."""
    r = _rows(spark, d)
    context = F.when(F.col("items").isNotNull(), F.lit(_ALL_CONTENT)).otherwise("")
    return r.select("id", audit.numeric_coverage(F.col("answer")).alias("c"), F.array_join(audit.unsupported_numbers(F.col("answer"), context), ";").alias("unsupported")).select("id", "c.*", "unsupported")


def _sql_has(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(fd, {_sql_normal(f"'{w}'")})" for w in words) + ")"


_SOFT = f"""WITH r AS ({_ROWS.format("part")}), two AS (SELECT id, 1 AS n, span1 AS span, answer FROM r UNION ALL SELECT id, 2, span2, answer FROM r UNION ALL SELECT id, 3, '座深 340～460 mm', answer FROM r WHERE has_hops UNION ALL SELECT id, 4, '总高度 125 mm', answer FROM r WHERE has_hops UNION ALL SELECT id, 4, '总高度为 120 mm', answer FROM r WHERE has_hops),
{_sql_span("two")}, {_BLOCKS}, {_NUMBERS},
sg AS (SELECT id, count(*) FILTER (n < 3 AND matched) AS spans, bool_or(n = 3 AND matched) AS s3, bool_or(n = 4 AND matched) AS s4 FROM mt GROUP BY 1),
k AS (SELECT r.*, list_sort(list_distinct(regexp_extract_all(answer, '{audit.CITATION}', 1))) AS used, CASE WHEN has_items THEN ['L1', 'L2', 'L3'] ELSE [] END AS allowed, {_sql_normal(_without(audit.LABEL, "answer"))} AS fd, trim(answer) <> '' AND trim(answer) NOT IN ('{audit.FALLBACKS[0]}', '{audit.FALLBACKS[1]}') AS present, has_refusals OR has_ambiguities AS declared FROM r),
v AS (SELECT k.*, list_filter(used, lambda x: NOT list_contains(allowed, x)) AS invalid, has_sources AND list_contains(used, 'L1') AND has_items AS hit,
  {_sql_has(("座深", "座高"))} AS t1, {_sql_has(audit.NEGATIONS)} AND {_sql_has(("直接",))} AS t2,
  CASE WHEN present THEN CASE WHEN has_refusals THEN {_sql_has(("无法", "资料不足"))} WHEN NOT has_sources THEN regexp_matches(answer, '{audit.REFUSAL}') END END AS refusal_correctness,
  CASE WHEN present AND has_ambiguities THEN {_sql_has(audit.NEGATIONS)} AND {_sql_has(audit.OBJECTS)} END AS ambiguity_safety, {_sql_has(("座深",))} AND s3 AS h1, {_sql_has(("P50", "总高度"))} AND s4 AS h2, spans FROM k JOIN sg USING (id)),
w AS (SELECT v.*, cv.* EXCLUDE (id), bad, declared OR refusal_correctness IS NOT NULL OR ambiguity_safety IS NOT NULL AS boundary, has_hops AND present AND NOT declared AS ha, present AND claims > 0 AND NOT declared AS na FROM v JOIN cv USING (id) JOIN nd USING (id))
SELECT id, array_to_string(used, ',') AS used, array_to_string(invalid, ',') AS invalid, CASE WHEN len(invalid) > 0 THEN 'fail' WHEN len(used) > 0 THEN 'pass' ELSE 'not_applicable' END AS citation_status, NOT boundary AS citation_applicable,
 CASE WHEN has_items THEN round(len(used) / 3, 3) END AS citation_usage, round(spans / 2, 3) AS span_recall, NOT boundary AS span_applicable, round((t1::INT + t2::INT) / 2, 3) AS term_recall, CASE WHEN has_sources THEN round(hit::INT / 2, 3) ELSE 1 END AS source_coverage,
 array_to_string(bad, ';') AS unsupported_numbers, len(invalid) + len(bad) AS unsupported_claims, refusal_correctness, ambiguity_safety, CASE WHEN ha THEN round((h1::INT + h2::INT) / 2, 3) END AS hop_recall, ha AS hop_applicable,
 claims AS numeric_claims, attributed AS attributed_claims, CASE WHEN na THEN coverage END AS numeric_coverage, na AS numeric_applicable, length(answer) AS answer_length,
 array_to_string(list_filter([CASE WHEN len(invalid) > 0 THEN 'citation_invalid' END, CASE WHEN len(used) = 0 AND has_items AND answer <> '' AND NOT regexp_matches(answer, '{audit.REFUSAL}') THEN 'citation_missing' END, CASE WHEN NOT has_items AND answer <> '' AND NOT regexp_matches(answer, '{audit.NO_EVIDENCE}') THEN 'answer_without_evidence' END,
  CASE WHEN len(bad) > 0 THEN 'unsupported_number' END, CASE WHEN length(answer) > {audit.LONGEST} THEN 'answer_too_long' END, CASE WHEN has_sources AND NOT hit THEN 'source_not_cited' END], lambda x: x IS NOT NULL), ',') AS warnings FROM w"""


@register(_SOFT)
def audit_soft(spark: SparkSession, d: str) -> DataFrame:
    """The whole deterministic audit of composed answers against contracts."""
    got = audit.soft_audit(_rows(spark, d))
    joined = {c: F.array_join(c, ";" if c == "unsupported_numbers" else ",").alias(c) for c in ("used", "invalid", "unsupported_numbers", "warnings")}
    return got.drop("hop_hits").select(*[joined.get(c, F.col(c)) for c in got.columns if c != "hop_hits"])


_LOST = ("座深 340", "壁厚 2.5 mm", "没有的事实")


@register(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lower(split_part(trim(coalesce(text, '')), ' ', 1)) AS a, lower(split_part(trim(coalesce(text, '')), ' ', 80)) AS b FROM documents),
n AS (SELECT doc_id, {_sql_normal("t")} AS f, {_sql_normal("t[1:300]")} AS c, {_sql_normal("a")} AS a, {_sql_normal("b")} AS b FROM d)
SELECT doc_id, array_to_string(list_filter([CASE WHEN NOT contains(c, a) AND contains(f, a) THEN 'span:1' END, CASE WHEN NOT contains(c, b) AND contains(f, b) THEN 'term:1' END, CASE WHEN NOT contains(c, {_sql_normal("'" + _LOST[2] + "'")}) AND contains(f, {_sql_normal("'" + _LOST[2] + "'")}) THEN 'hop:h1:span' END], lambda x: x IS NOT NULL), ',') AS lost FROM n""")
def audit_truncation(spark: SparkSession, d: str) -> DataFrame:
    """Declared facts that a budget of 300 characters takes out of the evidence."""
    t = F.coalesce("text", F.lit(""))
    docs = _t(spark, d, "documents").select("doc_id", t.alias("t"), F.lower(F.split_part(F.trim(t), F.lit(" "), F.lit(1))).alias("a"), F.lower(F.split_part(F.trim(t), F.lit(" "), F.lit(80))).alias("b"))
    fact = lambda name, c: F.struct(F.lit(name).alias("label"), F.array(c).alias("alternatives"))
    facts = F.array(fact("span:1", F.col("a")), fact("term:1", F.col("b")), fact("hop:h1:span", F.lit(_LOST[2])))
    return docs.select("doc_id", F.array_join(audit.lost_to_truncation(facts, F.array("t"), 300), ",").alias("lost"))
