"""Queries over entities, source roles, priors, protected unions and guards; questions and candidates are composed from the part table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import let
from ..operators import entities, guards
from ..sources import shared
from .catalog import _sql_canonical, _t, register

# composed rows; the text is both Spark SQL and DuckDB SQL
_QUESTIONS = """SELECT DISTINCT p_partkey % 48 AS question_id, CASE p_partkey % 48 % 12 WHEN 0 THEN 'GB/T 16252-2023 的手部尺寸' WHEN 1 THEN 'PP 与 PC 材料比较后选择，注塑 干燥 成型' WHEN 2 THEN '儿童杯最佳握持直径，知识库缺少数据' WHEN 3 THEN '水杯 材料 筛选' WHEN 4 THEN 'Tritan TX1001 TDS from Eastman'
 WHEN 5 THEN 'PP 3486-01 成型 壁厚' WHEN 6 THEN '5岁 手掌 尺寸' WHEN 7 THEN 'a plain question' WHEN 8 THEN '比较 PP 和 Tritan 的水杯 安全，gb_4806.7-2023，GB/T 10000-2023' WHEN 9 THEN '食品接触 合规 注塑 未成年人' WHEN 10 THEN ' ' ELSE 'GB/T3326 and GB/T 26158—2010 tds' END AS question FROM {0}"""
_CANDIDATES = """SELECT p_partkey AS doc_id, p_partkey % 48 AS question_id,
 CASE p_partkey % 7 WHEN 0 THEN 'standards/GB_T 16252-2023.pdf' WHEN 1 THEN 'tds/PP 3486-01 tds.pdf' WHEN 2 THEN concat('lists', chr(92), '资料来源清单.md') WHEN 3 THEN 'guides/pp drying injection molding gate.pdf' WHEN 4 THEN 'children/hand 26158-2010-gbt.pdf' WHEN 5 THEN concat('notes/n', CAST(p_partkey % 5 AS VARCHAR(9)), '.md') ELSE 'iso/tritan_tx-1001.pdf' END AS source,
 CASE p_partkey % 5 WHEN 0 THEN 'README.md' WHEN 1 THEN 'Technical Data Sheet' ELSE '' END AS title,
 CASE p_partkey % 7 WHEN 0 THEN 'standard' WHEN 3 THEN 'process_guide' WHEN 4 THEN 'anthropometry' ELSE 'unknown' END AS category,
 CASE p_partkey % 6 WHEN 0 THEN 'see GB/T 26158-2010 and GB 4806.7-2023' WHEN 1 THEN 'tritan tx1001 by eastman' WHEN 2 THEN 'drying guide for pp' WHEN 3 THEN 'pp 3486-01 sheet' WHEN 4 THEN 'food contact GB/T 10000-2023' ELSE '人体 children' END AS content,
 CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 41 + 1 END AS dense_rank, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 37 + 1 END AS bm25_rank, (p_partkey * 13 % 97) / 97e0 AS combined FROM {0}"""
_FIELDS = ("source", "title", "parent_document", "section_path", "content")
_ASKED_IDS = ("gb_26158_2010", "gb_4806_7_2023", "gb_10000_2023", "gb_16252_2023", "pp_3486_01", "tritan_tx1001")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    q = spark.sql(_QUESTIONS.format("{part}"), part=_t(spark, d, "part"))
    # written, since Spark would infer from an exploded plan a filter that plans every row of the table anew
    return shared.written(q.withColumn("lanes", entities.lanes(F.col("question"))), "questions")


def _fields() -> dict:
    return {f: F.col(f) if f in ("source", "title", "content") else F.lit("") for f in _FIELDS}


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    c = spark.sql(_CANDIDATES.format("{part}"), part=_t(spark, d, "part"))
    place = F.concat_ws(" ", "source", "title")
    c = c.withColumn("place", place).withColumn("role", entities.source_role(F.lit(""), F.col("category"), place, F.col("content"))).withColumn("low", entities.low_authority(F.col("source"), F.col("title")))
    ids = entities.canonical_ids(F.concat_ws(" ", "source", "title", "content"))
    lane = F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") % 9 + 1).alias("lane_rank")
    priority = lambda i, by: let(entities.named_in(i, by, _fields()), lambda places: entities.authority(i, F.col("role"), places, F.col("low")))
    stand = lambda by: F.transform("ids", lambda i: F.struct(i.alias("canonical_id"), priority(i, by).alias("priority"), lane))
    return c.withColumn("ids", ids).withColumn("guards", let(entities.ids_by_field(_fields()), stand))


def _sql_words(x: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def _sql_entity(x: str, name: str) -> str:
    core = f"regexp_matches({x}, '(^|[^a-z0-9])(?:{dict(entities.ENTITIES)[name]})($|[^a-z0-9])')"
    return f"({core} OR regexp_matches({x}, '{entities.DATA_SHEET}'))" if name == "tds" else core


def _sql_list(pairs: list[tuple[str, str]]) -> str:
    return f"list_filter([{', '.join(f'CASE WHEN {c} THEN {v} END' for c, v in pairs)}], lambda x: x IS NOT NULL)"


_CANON = {"gb/t 26158-2010": "gb_26158_2010", "gb 4806.7-2023": "gb_4806_7_2023", "gb/t 10000-2023": "gb_10000_2023", "gb/t 16252-2023": "gb_16252_2023", "gb/t 3326-2016": "gb_3326_2016", "pp 3486-01": "pp_3486_01"}
_NAMES = _sql_list([(_sql_entity("lower(question)", n), f"'{n}'") for n, _ in entities.ENTITIES] + [(_sql_words("question", w), f"'{n}'") for n, w in entities.ROLE_WORDS])
_MAT = {m: f"regexp_matches(lower(question), '(^|[^a-z0-9]){m}($|[^a-z0-9])')" for m in entities.MATERIALS}


def _sql_lane(cond: str, query: str, kind: str, entity: str, cid: str, origin: str, rule: str, guard: bool) -> tuple[str, str]:
    return cond, f"{{'query': {query}, 'kind': '{kind}', 'entity': '{entity}', 'cid': {cid}, 'origin': '{origin}', 'rule': '{rule}', 'guard': {guard}}}"


_LANE_LIST = [
    *[_sql_lane(f"list_contains(names, '{n}')", f"'{q}'", "entity", n, f"'{_CANON[n]}'", "explicit", "explicit_identifier", True) for n, q in entities.ALIASES.items() if n in _CANON],
    _sql_lane(f"({_sql_words('question', entities.CHILD)} OR regexp_matches(question, '{entities.CHILD_AGE}')) AND {_sql_words('question', entities.CHILD_SIZE)}", "'GB/T 26158-2010'", "entity", "gb/t 26158-2010", "'gb_26158_2010'", "deterministic", "child_hand_dimensions", True),
    _sql_lane(f"{_sql_words('question', entities.CUP)} AND {_sql_words('question', entities.COMPLIANCE)}", "'GB 4806.7-2023'", "entity", "gb 4806.7-2023", "'gb_4806_7_2023'", "deterministic", "cup_food_contact_compliance", True),
    *[_sql_lane(f"{' + '.join(f'{c}::INT' for c in _MAT.values())} + contains(question, '玻璃')::INT >= 2 AND {_sql_words('question', entities.DECIDING)} AND {_MAT[m]}", f"'{q}'", "entity", e, f"'{c}'", "deterministic", f"material_comparison_{m}_tds", True) for m, (e, q, c) in entities.MATERIAL_SHEETS.items()],
    _sql_lane("len(mats) > 0 AND len(terms) > 0", "concat(array_to_string(mats, ' '), ' ', array_to_string(terms, ' '), ' processing guide')", "process", "process_guide", "NULL", "deterministic", "material_process_guide", False),
]
_LANES = f"""q0 AS ({_QUESTIONS.format("part")}),
q1 AS (SELECT question_id, question, {_NAMES} AS names, {_sql_list([(c, f"'{m}'") for m, c in _MAT.items()])} AS mats, {_sql_list([(f"contains(question, '{zh}')", f"'{en}'") for zh, en in entities.PROCESS_TERMS])} AS terms FROM q0),
q2 AS (SELECT *, CASE WHEN trim(question) = '' THEN [] ELSE {_sql_list(_LANE_LIST)} END AS ls FROM q1),
q3 AS (SELECT question_id, question, names, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS i FROM q2),
q4 AS (SELECT *, row_number() OVER (PARTITION BY question_id, coalesce(l.cid, l.query) ORDER BY i) AS a, row_number() OVER (PARTITION BY question_id, lower(l.query) ORDER BY i) AS b FROM q3 WHERE lower(l.query) <> lower(trim(question))),
q5 AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY i) AS place FROM q4 WHERE a = 1 AND b = 1),
lanes AS (SELECT question_id, 0 AS place, trim(question) AS query, 'original' AS kind, NULL AS entity, NULL AS canonical_id, 'explicit' AS origin, NULL AS rule_id, false AS guardable FROM q0 WHERE trim(question) <> ''
 UNION ALL SELECT question_id, place, l.query, l.kind, l.entity, l.cid, l.origin, l.rule, l.guard FROM q5 WHERE place <= {entities.MAX_LANES})"""


@register(f"WITH {_LANES} SELECT * FROM lanes")
def rank_lanes(spark: SparkSession, d: str) -> DataFrame:
    """The lexical query plan of every question."""
    return _questions(spark, d).select("question_id", F.posexplode("lanes").alias("place", "l")).select("question_id", "place", "l.*")


_ROLES_OF = _sql_list([("list_contains(names, 'anthropometry_minors')", "'anthropometry'"), (f"len(list_intersect(names, [{', '.join(f"'{n}'" for n in entities.TDS_NAMES)}])) > 0", "'material_tds'"), ("list_contains(names, 'process_guide')", "'process_guide'"), ("list_contains(names, 'food_contact') OR len(list_filter(names, lambda e: starts_with(e, 'gb/') OR starts_with(e, 'gb '))) > 0", "'standard'")])


@register(f"""WITH {_LANES} SELECT question_id, array_to_string(names, ',') AS entities, array_to_string(list_filter(list_transform(names, lambda n: map {{{', '.join(f"'{a}': '{b}'" for a, b in _CANON.items())}}}[n]), lambda x: x IS NOT NULL), ',') AS canonical_ids, array_to_string({_ROLES_OF}, ',') AS roles FROM q1""")
def rank_question_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities, stable ids and roles of every question."""
    e = entities.query_entities(F.col("question"))
    ids = F.filter(F.transform(e, entities.canonical_id), lambda x: x.isNotNull())
    return _questions(spark, d).select("question_id", F.array_join(e, ",").alias("entities"), F.array_join(ids, ",").alias("canonical_ids"), F.array_join(entities.query_roles(e), ",").alias("roles"))


@register(f"""WITH {_LANES}, own AS (SELECT question_id, unnest(names) AS entity, unnest(range(1, len(names) + 1)) AS i FROM q1),
ow AS (SELECT question_id, entity, CASE entity {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _CANON.items())} END AS canonical_id, i FROM own),
ox AS (SELECT ow.*, 'explicit' AS origin, 'explicit_query' AS rule_id, coalesce((SELECT bool_or(l.origin = 'explicit' AND l.guardable) FROM lanes l WHERE l.question_id = ow.question_id AND l.canonical_id = ow.canonical_id), false) AS guardable FROM ow),
fx AS (SELECT question_id, entity, canonical_id, 100 + place AS i, origin, rule_id, guardable AND canonical_id IS NOT NULL AS guardable FROM lanes l WHERE origin = 'deterministic' AND NOT EXISTS (SELECT 1 FROM ow WHERE ow.question_id = l.question_id AND (ow.entity = l.entity OR ow.canonical_id = l.canonical_id))),
un AS (SELECT question_id, entity, canonical_id, i, origin, rule_id, guardable FROM ox UNION ALL SELECT * FROM fx)
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY i) - 1 AS place, entity, canonical_id, origin, rule_id, guardable FROM un""")
def rank_entity_plan(spark: SparkSession, d: str) -> DataFrame:
    """The planned entities of every question: its own, then those of deterministic lanes."""
    plan = guards.entity_plan(F.col("question"), F.col("lanes"), F.lit(""))
    return _questions(spark, d).select("question_id", F.posexplode(plan).alias("place", "p")).select("question_id", "place", "p.*")


_ROLE = f"CASE WHEN category IN ({', '.join(f"'{r}'" for r in entities.ROLES)}) THEN category " + " ".join(f"WHEN {' OR '.join(f"regexp_matches(lower(place), '{p}')" for p in ([q] if '(?<' not in q else ['(^|[^a-z0-9])gb(?:[/_ ]?t)?($|[^a-z0-9])', '(^|[^a-z0-9])iso($|[^a-z0-9])']))} THEN '{n}'" for n, q in entities.ROLE_PATHS) + " " + " ".join(f"WHEN regexp_matches(lower(content), '{q}') THEN '{n}'" for n, q in entities.ROLE_TEXTS) + " ELSE 'unknown' END"
_LOW = " OR ".join(f"split_part(replace(lower(trim({c})), chr(92), '/'), '/', -1) IN ({', '.join(f"'{m}'" for m in entities.LOW_AUTHORITY)})" for c in ("source", "title"))
_CAND = f"""c0 AS ({_CANDIDATES.format("part")}), c1 AS (SELECT *, concat_ws(' ', source, title) AS place FROM c0),
c2 AS (SELECT *, {_ROLE} AS role, {_LOW} AS low, {_sql_canonical("lower(concat_ws(' ', source, title, content))")} AS ids, {_sql_canonical("lower(source)")} AS ids_s, {_sql_canonical("lower(title)")} AS ids_t FROM c1),
cg AS (SELECT c2.*, i.canonical_id, CASE WHEN doc_id % 5 > 0 THEN doc_id % 9 + 1 END AS lane_rank, CASE WHEN low OR NOT (list_contains(ids_s, i.canonical_id) OR list_contains(ids_t, i.canonical_id) OR list_contains({_sql_canonical("lower(content)")}, i.canonical_id)) THEN -1
  WHEN starts_with(i.canonical_id, 'gb_') AND NOT (role IN ('standard', 'reference_handbook', 'process_guide') OR (i.canonical_id = 'gb_26158_2010' AND role = 'anthropometry')) THEN -1
  WHEN NOT starts_with(i.canonical_id, 'gb_') AND role NOT IN ('material_tds', 'standard', 'process_guide', 'reference_handbook') THEN -1
  WHEN starts_with(i.canonical_id, 'gb_') AND role = 'standard' THEN CASE WHEN list_contains(ids_s, i.canonical_id) THEN 100 WHEN list_contains(ids_t, i.canonical_id) THEN 95 ELSE 90 END
  WHEN i.canonical_id = 'gb_26158_2010' AND role = 'anthropometry' THEN CASE WHEN list_contains(ids_s, i.canonical_id) THEN 88 WHEN list_contains(ids_t, i.canonical_id) THEN 84 ELSE 80 END
  WHEN NOT starts_with(i.canonical_id, 'gb_') AND role = 'material_tds' THEN CASE WHEN list_contains(ids_s, i.canonical_id) OR list_contains(ids_t, i.canonical_id) THEN 100 ELSE 90 END
  ELSE CASE WHEN list_contains(ids_s, i.canonical_id) OR list_contains(ids_t, i.canonical_id) THEN 70 ELSE 60 END END AS priority FROM c2, unnest(ids) AS i(canonical_id))"""


@register(f"WITH {_CAND} SELECT doc_id, role, low, array_to_string(ids, ',') AS ids, coalesce((SELECT string_agg(canonical_id || ':' || priority, ',' ORDER BY canonical_id) FROM cg WHERE cg.doc_id = c2.doc_id), '') AS priorities FROM c2")
def rank_source_roles(spark: SparkSession, d: str) -> DataFrame:
    """Source role, authority and the entities that each candidate may stand for."""
    rows = _candidates(spark, d)
    return rows.select("doc_id", "role", "low", F.array_join("ids", ",").alias("ids"), F.array_join(F.transform("guards", lambda g: F.concat(g["canonical_id"], F.lit(":"), g["priority"])), ",").alias("priorities"))


def _sql_worth(name: str) -> str:
    inner = 0.6 if name in entities.STRICT else 0.3
    squeezed = "".join(ch for ch in name if ch.isascii() and ch.isalnum())
    return f"CASE WHEN {_sql_entity('lower(source)', name)} OR {_sql_entity('lower(title)', name)} THEN 1.0 WHEN {_sql_entity('lower(content)', name)} OR contains(sq, '{squeezed}') THEN {inner} END"


_WORTH = [(n, _sql_worth(n)) for n, _ in entities.ENTITIES] + [(n, f"CASE WHEN {_sql_words('tx', w)} OR contains(sq, '{n.replace('_', '')}') THEN 0.3 END") for n, w in entities.ROLE_EVIDENCE.items()]


@register(f"""WITH {_LANES}, {_CAND}, j AS (SELECT question_id, doc_id, names, source, title, content, lower(concat_ws(' ', source, title, '', '', content)) AS tx, regexp_replace(lower(concat_ws(' ', source, title, content)), '[^a-z0-9]+', '', 'g') AS sq FROM c2 JOIN q1 USING (question_id)),
w AS (SELECT question_id, doc_id, list_filter([{", ".join(f"CASE WHEN list_contains(names, '{n}') THEN {x} END" for n, x in _WORTH)}], lambda v: v IS NOT NULL) AS v FROM j)
SELECT question_id, doc_id, len(v) AS matched, CASE WHEN len(v) = 0 THEN 0 ELSE round(least(1, list_max(v) + 0.15 * (len(v) - 1)), 6) END AS score FROM w""")
def rank_entity_scores(spark: SparkSession, d: str) -> DataFrame:
    """How well every candidate matches its question's entities."""
    # entities are sought once a question, before candidates multiply them
    asked = _questions(spark, d).select("question_id", entities.query_entities(F.col("question")).alias("asked"))
    rows = _candidates(spark, d).join(asked, "question_id")
    score, matched = entities.match_score(F.col("asked"), _fields())
    return rows.select("question_id", "doc_id", F.size(matched).alias("matched"), F.round(score, 6).alias("score"))


_PROC_WORDS = sorted({en for _, en in entities.PROCESS_TERMS})


@register(f"""WITH {_LANES}, {_CAND}, b AS (SELECT c2.*, question, row_number() OVER (PARTITION BY question_id ORDER BY combined DESC, doc_id) AS base_rank, coalesce((SELECT lower(query) FROM lanes l WHERE l.question_id = c2.question_id AND kind = 'process'), '') AS asked FROM c2 JOIN q0 USING (question_id)),
n AS (SELECT *, list_filter([{", ".join(f"'{w}'" for w in _PROC_WORDS)}], lambda w: contains(lower(place), w)) AS named FROM b),
m AS (SELECT *, list_filter(named, lambda w: contains(asked, w)) AS two FROM n)
SELECT question_id, doc_id, base_rank,
 CASE WHEN base_rank > 22 THEN 'outside_near_cutoff' WHEN asked = '' OR role <> 'process_guide' THEN 'no_deterministic_process_lane_or_role_mismatch' WHEN NOT regexp_matches(lower(place), '(^|[^a-z0-9])(?:pp|pc|tritan|ppsu)($|[^a-z0-9])') THEN 'material_not_in_metadata' WHEN len(named) < 2 OR len(two) = 0 THEN 'fewer_than_two_metadata_process_terms' ELSE 'deterministic_process_lane_exact_metadata_match' END AS process_reason,
 CASE WHEN base_rank > 35 THEN 'outside_bounded_window' WHEN NOT ({" AND ".join(_sql_words("question", w) for w in (guards.CHILDREN, guards.EXACT_VALUE, guards.GRIP, guards.GAP))}) THEN 'query_intent_not_matched' WHEN role <> 'anthropometry' THEN 'source_role_mismatch' WHEN NOT {_sql_words("lower(place)", ("儿童", "child"))} THEN 'no_child_anthropometry_evidence' ELSE 'exact_value_request_with_corpus_evidence_gap' END AS child_reason FROM m""")
def rank_priors(spark: SparkSession, d: str) -> DataFrame:
    """Whether process guides and studies of children get a bonus near the cut-off, and why."""
    rows = _candidates(spark, d).join(_questions(spark, d), "question_id").withColumn("base_rank", F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("combined"), "doc_id")))
    process = guards.process_prior(F.col("lanes"), F.col("role"), F.col("place"), F.col("base_rank"))
    child = guards.child_prior(F.col("question"), F.col("role"), F.col("place"), F.col("base_rank"))
    return rows.select("question_id", "doc_id", "base_rank", process["reason"].alias("process_reason"), child["reason"].alias("child_reason"))


_UNION = f"""{_LANES}, {_CAND}, u AS (SELECT c2.*, row_number() OVER (PARTITION BY question_id ORDER BY combined DESC, doc_id) AS union_rank, count(*) OVER (PARTITION BY question_id) AS n FROM c2),
pr AS (SELECT DISTINCT question_id, doc_id FROM (SELECT cg.question_id, cg.doc_id, row_number() OVER (PARTITION BY cg.question_id, canonical_id ORDER BY priority DESC, lane_rank, coalesce(bm25_rank, 1000000000), coalesce(dense_rank, 1000000000), cg.doc_id) AS b FROM cg JOIN (SELECT question_id, doc_id, n FROM u) USING (question_id, doc_id) WHERE n > 25 AND priority >= 0 AND lane_rank IS NOT NULL AND (bm25_rank IS NOT NULL OR dense_rank IS NOT NULL)) WHERE b = 1)"""


@register(f"""WITH {_UNION} SELECT question_id, doc_id, union_rank, (question_id, doc_id) IN (SELECT (question_id, doc_id) FROM pr) AS protected, row_number() OVER (PARTITION BY question_id ORDER BY (question_id, doc_id) IN (SELECT (question_id, doc_id) FROM pr) DESC, union_rank) AS union_place, n > 25 AS union_truncated FROM u QUALIFY union_place <= 25""")
def rank_union_limit(spark: SparkSession, d: str) -> DataFrame:
    """A limited union with one protected representative of each entity."""
    return guards.limit_union(_ordered(spark, d), 25).select("question_id", "doc_id", "union_rank", "protected", "union_place", "union_truncated")


def _ordered(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).withColumn("union_rank", F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("combined"), "doc_id")))


def guarded(spark: SparkSession, d: str) -> DataFrame:
    """Ranked candidates with guards applied, before seats are reserved."""
    ids = F.transform(F.filter(guards.entity_plan(F.col("question"), F.col("lanes"), F.lit("")), lambda p: p["guardable"]), lambda p: p["canonical_id"])
    q = _questions(spark, d).select("question_id", ids.alias("guardable"))
    rows = guards.limit_union(_ordered(spark, d), 60).join(q, "question_id").withColumn("rank", F.col("union_rank").cast("int")).withColumn("model_rank", (F.col("doc_id") % 50).cast("int"))
    only = F.filter("guards", lambda g: F.array_contains("guardable", g["canonical_id"]))
    return guards.guard(rows.withColumn("guards", only))


@register()
def rank_guarded(spark: SparkSession, d: str) -> DataFrame:
    """Final lists after guards and reserved seats; tested against a brute-force version."""
    return guards.reserve(guarded(spark, d)).select("question_id", "doc_id", "source", "rank", "combined_rank", "guarded", "disposition", "final_rank", "reserved")


@register(f"""WITH {_LANES}, {_CAND}, p AS (SELECT question_id, entity, canonical_id, origin FROM ({{PLAN}})), f AS (SELECT c2.*, row_number() OVER (PARTITION BY question_id ORDER BY combined DESC, doc_id) AS combined_rank FROM c2),
g AS (SELECT f.*, CASE WHEN combined_rank <= 10 THEN combined_rank END AS final_rank FROM f),
j AS (SELECT p.*, g.doc_id, g.low, combined_rank, final_rank, coalesce((SELECT priority FROM cg WHERE cg.doc_id = g.doc_id AND cg.canonical_id = p.canonical_id), -1) AS pri, coalesce((SELECT lane_rank FROM cg WHERE cg.doc_id = g.doc_id AND cg.canonical_id = p.canonical_id), 1000000000) AS lane, CASE WHEN p.canonical_id IS NOT NULL THEN list_contains(ids, p.canonical_id) ELSE contains(lower(place), p.entity) END AS raw FROM p LEFT JOIN g USING (question_id)),
k AS (SELECT *, coalesce(raw, false) AND CASE WHEN canonical_id IS NOT NULL THEN pri >= 0 ELSE NOT low END AS fits FROM j),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id, entity, canonical_id, origin ORDER BY fits DESC, final_rank IS NULL, combined_rank > 20, CASE WHEN canonical_id IS NOT NULL THEN -pri ELSE 0 END, combined_rank, CASE WHEN canonical_id IS NOT NULL THEN lane ELSE 1000000000 END, doc_id) AS b, count(*) FILTER (raw) OVER w AS nraw, count(*) FILTER (fits) OVER w AS nfit FROM k WINDOW w AS (PARTITION BY question_id, entity, canonical_id, origin))
SELECT question_id, entity, canonical_id, origin, nfit AS matched, nraw - nfit AS filtered, CASE WHEN fits THEN doc_id END AS representative, CASE WHEN NOT fits THEN 'not_in_union' WHEN final_rank IS NOT NULL THEN 'selected' WHEN combined_rank <= 20 THEN 'outside_final_top10' ELSE 'outside_rerank_top20' END AS disposition FROM r WHERE b = 1""".replace("{PLAN}", "SELECT question_id, unnest(names) AS entity, CASE unnest(names) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _CANON.items()) + " END AS canonical_id, 'explicit' AS origin FROM q1"))
def rank_entity_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """The representative of every explicit entity in the union and its fate."""
    plan = _questions(spark, d).select("question_id", F.explode(guards.entity_plan(F.col("question"), F.array().cast("array<" + entities._LANE + ">"), F.lit(""))).alias("p")).select("question_id", "p.entity", "p.canonical_id", "p.origin")
    names = F.filter(F.array(*[F.lit(n) for n, _ in entities.ENTITIES], *[F.lit(n) for n, _ in entities.ROLE_WORDS]), lambda n: F.contains(F.lower("place"), n))
    rows = _ordered(spark, d).withColumn("names", names).withColumn("combined_rank", F.col("union_rank")).withColumn("final_rank", F.when(F.col("union_rank") <= 10, F.col("union_rank"))).withColumn("disposition", F.lit(None).cast("string"))
    return guards.diagnostics(plan, rows)
