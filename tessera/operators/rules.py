"""Document metadata from path, title and text, question profiles, and the evidence decision list.

Rules are ordered tables of words, evaluated as native column expressions: the first rule that holds decides.
Null paths, titles and texts count as empty.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import designation_key, first_heading

UNKNOWN = "unknown"

# Words of the source categories, in the order of their rules.
CATEGORY_WORDS = [
    ("material_tds", ("tds", "technical_data", "technical data", "product_data", "data_sheet", "datasheet")),
    ("process_guide", ("processing", "processing_guide", "molding", "mould", "dfm", "drying", "extrusion", "制造工艺", "注塑", "吹塑", "工艺指南")),
    ("standard", ("法规与标准", "gb4806", "gb/t", "iso", "astm", "en_", "iec")),
    ("anthropometry", ("anthropometry", "人体工程学", "hand_", "hand dimensions", "nist")),
    ("internal_rule", ("08_设计决策", "设计规则", "decision")),
    ("paper", ("paper", "论文", "journal", "research", "study")),
    ("reference_handbook", ("handbook", "手册", "guide", "指南")),
]
STANDARD_TEXT = ("中华人民共和国国家标准", "national standard")
LEVEL_OF = {"material_tds": "supplier_data", "paper": "paper", "internal_rule": "internal_rule", "reference_handbook": "reference_handbook", "process_guide": "supplier_or_process_guide"}
STANDARD_BODIES = "(?iU)\\b(?:GB|ISO|IEC|ASTM|EN|DIN|JIS)"
MINORS, ELDERLY = ("未成年人", "儿童", "children", "minors", "juvenile"), ("老年", "elderly", "older adult")
ADULT_STANDARD, ADULTS = "(?:16252|10000)[ _+—-]*2023", ("成人", "成年人", "adult anthropometry", "adult dimensions")
NAMED_GRADE = "(?iU)\\b((?:LEXAN|RADEL|TX|TRITAN|PPSU|PP|PC|PET|HDPE)[ _-]+[A-Z0-9]+)"
GRADE_TAIL = "(?i)( (?:TDS|DATA|GUIDE|SHEET))+$"
GRADES = ("Tritan", "PC", "PP", "PPSU", "PET", "HDPE", "Silicone", "304", "316", "Glass", "Ceramic")
SCOPE = ("(?i)(?:适用范围|适用于|适用条件)[:： ]*([^。\\n]{4,160})", "(?i)(?:scope|applicable to|service condition)\\s*[:：]\\s*([^.\\n]{4,160})")
FAMILIES = [("pc", ("pc", "lexan", "聚碳酸酯")), ("pp", ("pp", "聚丙烯")), ("tritan", ("tritan",)), ("ppsu", ("ppsu", "radel")), ("304", ("304",)), ("316", ("316",)), ("silicone", ("silicone", "硅胶")), ("glass", ("glass", "玻璃")), ("ceramic", ("ceramic", "陶瓷"))]
REFERENCE = "(?i)((?:GB/T|GB|ISO|IEC|ASTM|EN|DIN|JIS)\\s*[A-Za-z0-9./—-]+)"
ASKED_MATERIALS = ("PC", "PP", "Tritan", "PPSU", "PET", "HDPE", "304", "316", "硅胶", "Silicone", "玻璃", "陶瓷")
TOPICS = {
    "dimension": ("尺寸", "直径", "杯径", "握持", "人体工学", "手部", "高度", "容量", "尺寸建议"),
    "material": ("材料", "材质", "牌号", "耐热", "抗冲击", "食品接触", "选材", "合规"),
    "food_contact": ("食品接触", "迁移", "饮用水", "食品安全", "food contact"),
    "process": ("注塑", "吹塑", "冲压", "焊接", "工艺", "加工", "dfm", "成型"),
    "testing": ("测试", "验证", "跌落", "泄漏", "耐久", "洗碗机", "可靠性"),
}
ASKED_ADULT, ASKED_MINORS = ("成人", "成年人", "adult"), ("未成年人", "儿童", "children", "minors")
NO_ADULT = ("未成年人", "儿童", "children")
GRIP = ("握持", "grip", "杯径", "cup diameter", "圆柱握持", "操作实验")
PRODUCT = ("水杯", "饮水容器", "cup", "container", "杯口", "密封")
REASONS = {
    "adult": "目标问题面向成人，但资料范围为未成年人",
    "minors": "目标问题面向未成年人，但资料范围为成人",
    "grade": "材料牌号与问题指定材料不匹配",
    "low": "向量相关性 %.3f 低于直接证据阈值 %.3f",
    "grip": "资料包含目标产品的握持、操作或直接尺寸关系",
    "body": "人体或一般尺寸资料不能直接证明目标产品尺寸",
    "product": "资料包含目标产品尺寸或接口相关内容",
    "food": "资料属于法规或材料合规数据",
    "material": "资料包含材料、牌号、法规或加工限制",
    "background": "资料属于材料相关背景，但缺少具体牌号",
    "process": "资料包含制造工艺或成型限制",
    "testing": "资料包含测试、验证或失效相关内容",
    "reference": "资料命中用户指定标准或参考编号",
    "related": "资料与问题领域相关，但未形成直接支持",
    "unknown": "资料适用范围或证据类别未知",
}
# End of fixed values.


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    return F.lower(text).rlike("|".join(re.escape(w.lower()) for w in words))


def first_of(rules: list[tuple[Column, Column]], default: Column) -> Column:
    out = default
    for holds, value in reversed(rules):
        out = F.when(holds, value).otherwise(out)
    return out


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _where(path: str, title: str) -> Column:
    return F.translate(F.concat_ws(" ", _text(path), _text(title)), "\\", "/")


def source_category(path: str, title: str, content: str) -> Column:
    at = _where(path, title)
    rules = [(has_any(at, words), F.lit(name)) for name, words in CATEGORY_WORDS]
    return first_of([*rules, (has_any(F.substring(_text(content), 1, 3000), STANDARD_TEXT), F.lit("standard"))], F.lit(UNKNOWN))


def evidence_level(path: str, title: str, category: Column) -> Column:
    rules = [((category == "standard") | _where(path, title).rlike(STANDARD_BODIES), F.lit("standard"))]
    return first_of([*rules, *((category == c, F.lit(v)) for c, v in LEVEL_OF.items())], F.lit(UNKNOWN))


def population(path: str, title: str, content: str) -> Column:
    t = F.concat_ws(" ", _where(path, title), F.substring(_text(content), 1, 2500))
    return first_of([(has_any(t, MINORS), F.lit("minors")), (has_any(t, ELDERLY), F.lit("elderly")), (t.rlike(ADULT_STANDARD) | has_any(t, ADULTS), F.lit("adults"))], F.lit(UNKNOWN))


def _word(text: Column, name: str) -> Column:
    return text.rlike(f"(?i)(?<![A-Za-z]){re.escape(name)}(?![A-Za-z])")


def material_grade(path: str, title: str) -> Column:
    at = _where(path, title)
    named = F.trim(F.regexp_replace(F.translate(F.regexp_extract(at, NAMED_GRADE, 1), "_", " "), "\\s+", " "))
    named = F.regexp_replace(named, GRADE_TAIL, "")
    return first_of([(F.contains(named, F.lit(" ")), named), *((_word(at, g), F.lit(g)) for g in GRADES)], F.lit(UNKNOWN))


def applicability(content: str) -> Column:
    t = F.trim(F.regexp_replace(F.substring(_text(content), 1, 4000), "\\s+", " "))
    found = [F.nullif(F.trim(F.regexp_extract(t, p, 1)), F.lit("")) for p in SCOPE]
    return F.coalesce(*found, F.lit(UNKNOWN))


def document_metadata(docs: DataFrame, path: str = "path", title: str = "title", content: str = "content") -> DataFrame:
    """The documents with the inferred metadata columns."""
    out = docs.withColumn("source_category", source_category(path, title, content))
    by_path = F.col("source_category").isin("material_tds", "process_guide", "standard")
    return out.withColumns({
        "source_role_rule": F.when(by_path, "path_keyword").otherwise("content_or_fallback"),
        "source_role_confidence": F.when(by_path, 0.95).otherwise(0.55),
        "section": F.coalesce(F.nullif(first_heading(content), F.lit("")), F.lit(UNKNOWN)),
        "evidence_level": evidence_level(path, title, F.col("source_category")),
        "population": population(path, title, content),
        "material_grade": material_grade(path, title),
        "applicability": applicability(content),
    })


def question_profile(questions: DataFrame, text: str = "question") -> DataFrame:
    """The questions with topic flags, references and materials asked for."""
    q = _text(text)
    flags = {name: has_any(q, words) for name, words in TOPICS.items()}
    named = F.filter(F.array(*[F.when(_word(q, m), F.lit(m)) for m in ASKED_MATERIALS]), lambda x: x.isNotNull())
    return questions.withColumns(flags | {"adult": has_any(q, ASKED_ADULT) & ~has_any(q, NO_ADULT), "minors": has_any(q, ASKED_MINORS), "references": F.regexp_extract_all(q, F.lit(REFERENCE), 1), "materials": named})


def material_family(text: Column) -> Column:
    return first_of([(has_any(text, words), F.lit(name)) for name, words in FAMILIES], F.lit(UNKNOWN))


def classify_evidence(rows: DataFrame, min_relevance: float = 0.25) -> DataFrame:
    """Profiled questions joined to documents with metadata, with ``evidence_status`` and ``evidence_reason``.

    Needs ``content``, ``path``, ``title``, ``section``, ``applicability`` and ``relevance`` (null: not known). The
    relevance in a reason is rounded from its decimal digits, so a tie such as 0.2165 goes up.
    """
    body = F.concat_ws(" ", *map(_text, ("path", "title", "title", "section", "applicability", "content")))
    category, grade = F.col("source_category"), F.col("material_grade")
    families = F.transform("materials", material_family)
    fits = F.exists(families, lambda f: (f != UNKNOWN) & ((f == material_family(grade)) | (f == material_family(body))))
    cited = F.exists("references", lambda r: (designation_key(r) != "") & F.contains(designation_key(body), designation_key(r)))
    sized = F.col("dimension") & category.isin("anthropometry", "standard", "paper", "internal_rule", "process_guide")
    stuff = F.col("material") & category.isin("material_tds", "standard", "reference_handbook", "internal_rule", "process_guide")

    def verdict(status: str, reason: str | Column) -> Column:
        return F.struct(F.lit(status).alias("s"), (F.lit(REASONS[reason]) if isinstance(reason, str) else reason).alias("r"))

    rules = [
        (F.col("adult") & (F.col("population") == "minors"), verdict("scope_mismatch", "adult")),
        (F.col("minors") & (F.col("population") == "adults"), verdict("scope_mismatch", "minors")),
        ((F.size("materials") > 0) & (grade != UNKNOWN) & (category == "material_tds") & ~fits, verdict("scope_mismatch", "grade")),
        (F.coalesce(F.col("relevance") < min_relevance, F.lit(False)), verdict("indirect", F.format_string(REASONS["low"], F.col("relevance").cast("double"), F.lit(float(min_relevance))))),
        (sized & has_any(body, GRIP), verdict("direct", "grip")),
        (sized & ((category == "anthropometry") | ~has_any(body, PRODUCT)), verdict("indirect", "body")),
        (sized, verdict("direct", "product")),
        (F.col("food_contact") & category.isin("standard", "material_tds"), verdict("direct", "food")),
        (stuff & ((grade != UNKNOWN) | (category == "standard")), verdict("direct", "material")),
        (stuff, verdict("indirect", "background")),
        (F.col("process") & category.isin("process_guide", "material_tds", "internal_rule"), verdict("direct", "process")),
        (F.col("testing") & category.isin("standard", "paper", "process_guide", "internal_rule", "material_tds"), verdict("direct", "testing")),
        (cited, verdict("direct", "reference")),
        (category != UNKNOWN, verdict("indirect", "related")),
    ]
    return rows.withColumn("__v", first_of(rules, verdict("indirect", "unknown"))).withColumns({"evidence_status": F.col("__v.s"), "evidence_reason": F.col("__v.r")}).drop("__v")
