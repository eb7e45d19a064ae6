"""Standards, grades and roles named in questions and documents: extraction, canonical ids, matches, source roles, lanes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let

# Names, patterns and weights that decide the results.
_L, _R = "(?<![a-z0-9])", "(?![a-z0-9])"
ENTITIES = (
    ("gb/t 26158-2010", "gb\\s*[/_]?\\s*t\\s*26158(?:[-—_ ]?2010)?"),
    ("gb 4806.7-2023", "gb[_ ]?4806[.]?7(?:[-—_ ]?2023)?"),
    ("gb/t 10000-2023", "gb\\s*[/_]?\\s*t\\s*10000(?:[-—_ ]?2023)?"),
    ("gb/t 16252-2023", "gb\\s*[/_]?\\s*t\\s*16252(?:[-—_ ]?2023)?"),
    ("gb/t 3326-2016", "gb\\s*[/_]?\\s*t\\s*3326(?:[-—_ ]?2016)?"),
    ("pp 3486-01", "(?:pp[_ ]*)?3486[-_ ]?01"),
    ("tritan tx1001", "(?:tritan[_ ]*)?tx[-_ ]?1001"),
    ("tritan", "tritan"),
    ("pp", "pp"),
    ("pc", "pc"),
    ("ppsu", "ppsu"),
    ("tds", "tds"),
    ("eastman", "eastman"),
    ("lyondellbasell", "lyondellbasell"),
)
DATA_SHEET = "technical\\s+data\\s+sheet"
ROLE_WORDS = (("food_contact", ("食品接触", "食品安全", "合规")), ("process_guide", ("注塑", "加工", "干燥", "浇口", "排气")), ("anthropometry_minors", ("儿童", "幼儿", "未成年人")))
ROLE_EVIDENCE = {
    "food_contact": ("食品接触", "食品安全", "food contact", "gb 4806.7", "gb4806.7"),
    "process_guide": ("processing", "mold", "mould", "drying", "注塑", "加工", "工艺"),
    "anthropometry_minors": ("儿童", "未成年人", "children", "anthropometry", "26158"),
}
STRICT = ("gb/t 26158-2010", "gb 4806.7-2023", "gb/t 10000-2023", "gb/t 16252-2023", "gb/t 3326-2016", "pp 3486-01", "tritan tx1001", "tds", "eastman", "lyondellbasell")
ROLES = ("standard", "anthropometry", "material_tds", "process_guide", "internal_rule", "paper", "reference_handbook")
ROLE_PATHS = (
    ("material_tds", "tds|technical[ _-]*data|data[ _-]*sheet|datasheet"),
    ("process_guide", "processing|mold|mould|drying|extrusion|工艺|注塑"),
    ("standard", "(?<![a-z0-9])gb(?:[/_ ]?t)?(?![a-z0-9])|(?<![a-z0-9])iso(?![a-z0-9])"),
    ("anthropometry", "anthropometry|人体|手部|握力"),
)
ROLE_TEXTS = (("material_tds", "tds|technical\\s+data\\s+sheet"), ("process_guide", "processing guide|drying guide|加工指南|工艺指南"))
LOW_AUTHORITY = ("资料来源清单.md", "知识库目录说明.md", "readme.md", "index.md", "catalog.md", "source_list.md")
TDS_NAMES = ("pp", "pc", "tritan", "ppsu", "pp 3486-01", "tritan tx1001", "tds", "eastman", "lyondellbasell", "food_contact")
IDENTIFIER = "(gb\\s*/?\\s*t?\\s*[0-9][0-9./-]*|iso\\s*[0-9][0-9./-]*|tritan|ppsu|pc|pp|304|316|[A-Za-z0-9_]+\\.(?:pdf|md|txt))"
STABLE = "\\d{4,}(?:[._/-]\\d+)+|tx\\d{3,}|\\d{4}-\\d{2}"
IDENTIFIER_BONUS, STABLE_BONUS, CANONICAL_BONUS = 2.0, 6.0, 6.0
NUMBERED = ("gb\\s*[/_]?\\s*t\\s*(\\d{4,6})\\s*[-—_ ]?\\s*(20\\d{2})", "gb\\s*[_ ]?\\s*(4806)[._]?7\\s*[-—_ ]?\\s*(20\\d{2})?", "(\\d{4,6})\\s*[-_ ]\\s*(20\\d{2})\\s*[-_ ]?\\s*gbt")
GRADED = (("pp_3486_01", "(?:pp[ _-]*)?3486[ _-]*01"), ("tritan_tx1001", "(?:tritan[ _-]*)?tx[ _-]*1001"))
ALIASES = {
    "gb/t 26158-2010": "GB/T 26158-2010",
    "gb 4806.7-2023": "GB 4806.7-2023",
    "gb/t 10000-2023": "GB/T 10000-2023",
    "gb/t 16252-2023": "GB/T 16252-2023",
    "gb/t 3326-2016": "GB/T 3326-2016",
    "pp 3486-01": "PP 3486-01 TDS",
    "tritan tx1001": "Tritan TX1001 TDS",
}
MATERIAL_SHEETS = {"pp": ("pp 3486-01", "LyondellBasell PP 3486-01 TDS", "pp_3486_01"), "tritan": ("tritan tx1001", "Eastman Tritan TX1001 TDS", "tritan_tx1001")}
PROCESS_TERMS = (("干燥", "drying"), ("挤出", "extrusion"), ("注塑", "injection molding"), ("成型", "molding"), ("浇口", "gate"), ("壁厚", "wall thickness"), ("排气", "venting"), ("圆角", "corner radius"), ("残余应力", "residual stress"))
CHILD, CHILD_AGE, CHILD_SIZE = ("儿童", "孩子", "幼儿", "未成年人", "未成年"), "\\d+\\s*(?:[-—~至到]\\s*\\d+\\s*)?岁", ("手部", "手掌", "手指", "握", "直径", "尺寸")
CUP, COMPLIANCE = ("水杯", "饮用容器", "杯体", "食品容器", "可重复使用"), ("材料", "材质", "筛选", "选择", "安全", "合规", "食品接触")
MATERIALS = ("pp", "pc", "tritan", "ppsu")
DECIDING = ("比较", "对比", "选择", "筛选", "哪个", "决定", "决策")
MAX_LANES = 3
# End of fixed values.


def entity_pattern(name: str) -> str:
    whole = _L + dict(ENTITIES)[name] + _R
    return whole + "|" + DATA_SHEET if name == "tds" else whole


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    return _or([F.contains(text, F.lit(w)) for w in words])


def _or(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def present(pairs: list[tuple[Column, Column | str]]) -> Column:
    """The values whose condition holds, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(v) if isinstance(v, str) else v) for c, v in pairs]), lambda x: x.isNotNull())


def query_entities(question: Column) -> Column:
    """Names of standards, grades, materials and roles in a question, in a fixed order."""
    low = F.lower(question)
    return present([(low.rlike(entity_pattern(n)), n) for n, _ in ENTITIES] + [(any_of(question, w), n) for n, w in ROLE_WORDS])


def canonical_id(name: Column) -> Column:
    """The stable id of a standard (either spelling) or grade; null for other names."""
    c = compact(name)
    forward, back = "(?:gbt|gb)(\\d{4,6})(\\d{4})$", "(\\d{4,6})(20\\d{2})gbt$"
    number = lambda p: F.concat(F.lit("gb_"), F.regexp_extract(c, p, 1), F.lit("_"), F.regexp_extract(c, p, 2))
    grade = F.regexp_extract(c, "(?:pp)?(\\d{3,5})0?1$", 1) == "3486"
    return F.when(c.isin("gb480672023", "gb48067"), "gb_4806_7_2023").when(c.rlike(forward), number(forward)).when(c.rlike(back), number(back)).when(c.isin("pp348601", "348601") | grade, "pp_3486_01").when(c.isin("tritanx1001", "tx1001"), "tritan_tx1001")


def canonical_ids(text: Column) -> Column:
    """All stable ids that a text names, sorted."""
    low, found = F.lower(text), []
    for p in NUMBERED:
        a, b = (F.regexp_extract_all(low, F.lit(p), F.lit(k)) for k in (1, 2))
        found.append(F.zip_with(a, b, lambda x, y: F.when(x == "4806", F.concat(F.lit("gb_4806_7_"), F.when(F.coalesce(y, F.lit("")) == "", "2023").otherwise(y))).otherwise(F.concat(F.lit("gb_"), x, F.lit("_"), y))))
    found.append(present([(low.rlike(p), n) for n, p in GRADED]))
    return F.array_sort(F.array_distinct(F.concat(*found)))


def identifiers(question: Column) -> tuple[Column, Column]:
    """Compact forms of exact and of stable identifiers of a question, one an occurrence."""
    low = F.lower(question)
    exact = F.transform(F.regexp_extract_all(low, F.lit(IDENTIFIER), 1), lambda x: F.regexp_replace(x, "\\s+", ""))
    stable = F.transform(F.regexp_extract_all(low, F.lit(f"{_L}({STABLE}){_R}"), 1), lambda x: F.regexp_replace(x, "[^a-z0-9]", ""))
    return exact, stable


def match_score(entities: Column, fields: dict[str, Column]) -> tuple[Column, Column]:
    """(score, matched): each entity counts by the best place that names it; further ones add 0.15, 1 at most.

    ``fields``: source, title, parent_document, section_path and content.
    """
    found = let(F.struct(*[F.lower(F.coalesce(v, F.lit(""))).alias(k) for k, v in fields.items()]), lambda low: let(F.concat_ws(" ", *[low[k] for k in fields]), lambda text: _worths(entities, low, text)))
    best = lambda x: F.array_max(F.transform(x, lambda y: y["worth"]))
    score = let(found, lambda x: F.when(F.size(x) > 0, F.least(F.lit(1.0), best(x) + 0.15 * (F.size(x) - 1))).otherwise(0.0))
    return score, F.transform(found, lambda x: x["name"])


def _worths(entities: Column, low: Column, text: Column) -> Column:
    """(name, worth) of the entities that a candidate names; the places of others are not searched."""
    squeezed = lambda name: F.contains(compact(text), F.lit("".join(ch for ch in name if ch.isascii() and ch.isalnum())))
    worth = []
    for name, _ in ENTITIES:
        inner = 0.6 if name in STRICT else 0.3
        here = None
        for field, score in (("source", 1.0), ("title", 1.0), ("parent_document", 0.8), ("section_path", 0.8), ("content", inner)):
            at = low[field].rlike(entity_pattern(name))
            here = F.when(at, score) if here is None else here.when(at, score)
        worth.append((name, here.when(squeezed(name), inner)))
    for name, words in ROLE_EVIDENCE.items():
        worth.append((name, F.when(any_of(text, words) | squeezed(name), 0.3)))
    # asked first: Spark computes a branch only where its condition holds
    each = [let(F.when(F.array_contains(entities, n), w), lambda v, n=n: F.when(v.isNotNull(), F.struct(F.lit(n).alias("name"), v.alias("worth")))) for n, w in worth]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def source_role(role: Column, category: Column, place: Column, content: Column) -> Column:
    """A given role, else the category, else what path and titles say, else what the text says."""
    low, body = F.lower(place), F.lower(content)
    out = F.when(F.lower(role).isin(*ROLES), F.lower(role)).when(F.lower(category).isin(*ROLES), F.lower(category))
    for name, p in ROLE_PATHS:
        out = out.when(low.rlike(p), name)
    for name, p in ROLE_TEXTS:
        out = out.when(body.rlike(p), name)
    return out.otherwise("unknown")


def low_authority(*places: Column) -> Column:
    """Whether a path or title is that of an index or catalogue; the text is never asked."""
    names = [F.element_at(F.split(F.regexp_replace(F.lower(F.trim(F.coalesce(p, F.lit("")))), "\\\\", "/"), "/"), -1) for p in places]
    return _or([n.isin(*LOW_AUTHORITY) for n in names])


def query_roles(entities: Column) -> Column:
    """Source roles that a question's entities ask for, sorted."""
    standard = F.exists(entities, lambda e: e.startswith("gb/") | e.startswith("gb ")) | F.array_contains(entities, "food_contact")
    pairs = [(F.array_contains(entities, "anthropometry_minors"), "anthropometry"), (F.arrays_overlap(entities, F.array(*map(F.lit, TDS_NAMES))), "material_tds"), (F.array_contains(entities, "process_guide"), "process_guide"), (standard, "standard")]
    return present(pairs)


def authority(canonical: Column, role: Column, places: Column, low: Column) -> Column:
    """Priority of a candidate that names an entity in ``places``; -1 where it may not stand for it."""
    standard = canonical.startswith("gb_")
    allowed = F.when(standard, role.isin("standard", "reference_handbook", "process_guide") | (canonical == "gb_26158_2010") & (role == "anthropometry")).otherwise(role.isin("material_tds", "standard", "process_guide", "reference_handbook"))
    named, by_source = F.arrays_overlap(places, F.array(F.lit("source"), F.lit("title"))), F.array_contains(places, "source")
    rank = lambda a, b, c: F.when(by_source, a).when(named, b).otherwise(c)
    ok = ~low & (F.size(places) > 0) & allowed
    score = F.when(standard & (role == "standard"), rank(100, 95, 90)).when((canonical == "gb_26158_2010") & (role == "anthropometry"), rank(88, 84, 80)).when(~standard & (role == "material_tds"), rank(100, 100, 90)).otherwise(rank(70, 70, 60))
    return F.when(ok, score).otherwise(-1)


def named_in(canonical: Column, ids: Column, fields: dict[str, Column]) -> Column:
    """The fields that name an entity; ``ids``: of ``ids_by_field``."""
    return present([(F.array_contains(ids[k], canonical), k) for k in sorted(fields)])


def ids_by_field(fields: dict[str, Column]) -> Column:
    """struct of the stable ids that each field names."""
    return F.struct(*[canonical_ids(F.coalesce(v, F.lit(""))).alias(k) for k, v in sorted(fields.items())])


_LANE = "struct<query:string,kind:string,entity:string,canonical_id:string,origin:string,rule_id:string,guardable:boolean>"


def _lane(query: Column | str, kind: str, entity: str | None, origin: str, rule: str | None, guard: bool, cid: Column | str | None = None) -> Column:
    canonical = canonical_id(F.lit(entity)) if cid is None and entity else F.lit(cid)
    q = F.lit(query) if isinstance(query, str) else query
    return F.struct(q.alias("query"), F.lit(kind).alias("kind"), F.lit(entity).alias("entity"), canonical.alias("canonical_id"), F.lit(origin).alias("origin"), F.lit(rule).alias("rule_id"), (F.lit(guard) & canonical.isNotNull()).alias("guardable")).cast(_LANE)


def lanes(question: Column, limit: int = MAX_LANES) -> Column:
    """The lexical query plan: the question, then explicit standards, deterministic ones, data sheets and a process lane.

    At most ``limit`` lanes beside the question; an id and a query occur once.
    """
    text = F.trim(question)
    word = lambda w: text.rlike(f"(?i)(?<![A-Za-z0-9]){w}(?![A-Za-z0-9])")
    asked = {m: word(m) for m in MATERIALS}
    names = query_entities(text)
    explicit = [(F.array_contains(names, n) & canonical_id(F.lit(n)).isNotNull(), _lane(q, "entity", n, "explicit", "explicit_identifier", True)) for n, q in ALIASES.items()]
    child = (any_of(text, CHILD) | text.rlike(CHILD_AGE)) & any_of(text, CHILD_SIZE)
    fixed = [(child, _lane("GB/T 26158-2010", "entity", "gb/t 26158-2010", "deterministic", "child_hand_dimensions", True)), (any_of(text, CUP) & any_of(text, COMPLIANCE), _lane("GB 4806.7-2023", "entity", "gb 4806.7-2023", "deterministic", "cup_food_contact_compliance", True))]
    several = sum([c.cast("int") for c in asked.values()], F.contains(text, F.lit("玻璃")).cast("int")) >= 2
    sheets = [(several & any_of(text, DECIDING) & asked[m], _lane(q, "entity", e, "deterministic", f"material_comparison_{m}_tds", True, c)) for m, (e, q, c) in MATERIAL_SHEETS.items()]
    terms = present([(F.contains(text, F.lit(zh)), en) for zh, en in PROCESS_TERMS])
    mats = present([(c, m) for m, c in asked.items()])
    query = F.concat(F.array_join(mats, " "), F.lit(" "), F.array_join(terms, " "), F.lit(" processing guide"))
    process = [((F.size(mats) > 0) & (F.size(terms) > 0), _lane(query, "process", "process_guide", "deterministic", "material_process_guide", False))]
    # explicit lanes first, then those with an id; the order above is that order already
    found = F.filter(F.array(*[F.when(c, x) for c, x in explicit + fixed + sheets + process]), lambda x: x.isNotNull())
    key = lambda q: F.trim(F.regexp_replace(F.lower(q), "\\s+", " "))

    def add(done: Column, x: Column) -> Column:
        again = F.exists(done, lambda y: (key(y["query"]) == key(x["query"])) | (y["canonical_id"].isNotNull() & (y["canonical_id"] == x["canonical_id"])))
        return F.when(F.coalesce(again, F.lit(False)) | (F.size(done) > limit), done).otherwise(F.concat(done, F.array(x)))

    first = F.array(_lane(text, "original", None, "explicit", None, False))
    return F.when(F.length(text) > 0, F.aggregate(found, first, add)).otherwise(F.array().cast(f"array<{_LANE}>"))
