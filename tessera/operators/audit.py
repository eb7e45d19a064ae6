"""Answers against contracts: normal forms, span and term matching, numeric claims, truncation losses, the soft audit of a row.

All are column expressions over one row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

# Replacements in their order, patterns and word lists that decide the results.
REPLACED = (
    ("不小于", "ge"), ("不低于", "ge"), ("至少", "ge"), ("大于等于", "ge"), ("不少于", "ge"), ("不超过", "le"), ("不大于", "le"), ("至多", "le"), ("小于等于", "le"),
    (">=", "ge"), ("≤", "le"), ("≥", "ge"), ("<=", "le"), ("毫米", "mm"), ("厘米", "cm"), ("²", "2"), ("³", "3"), ("～", "~"), ("至", "~"), ("到", "~"), ("−", "-"), ("–", "-"), ("—", "-"),
)
RANGE_UNITS = "(\\d+(?:\\.\\d+)?)(mm|ml|℃|%)~(\\d+(?:\\.\\d+)?)(mm|ml|℃|%)"
NOT_KEPT = "[^0-9a-z一-鿿~%-]+"
CITATION = "[\\[【〔]([LW]\\d+)[\\]】〕]"
LABEL, PARENTHETICAL, MATH = "[\\[【〔][LWlw]\\d+[\\]】〕]", "[（(][^）)]{1,12}[）)]", "[×÷=^²³]|\\d\\s*[+/]\\s*\\d"
BARE_LABEL = "(?<![A-Za-z0-9])[A-Za-z]\\d{1,2}(?![A-Za-z0-9])"
SYNONYMS = {"年龄段": ("年龄段", "年龄", "目标年龄"), "百分位数": ("百分位数", "百分位"), "推算": ("推算", "换算", "计算", "确定")}
DIGITS, UNIT_NUMBER, TOKEN = "(\\d+(?:\\.\\d+)?)", "\\d+(?:\\.\\d+)?(?:mm|ml|cm|℃|%|岁|年|项)?", "(\\d+(?:\\.\\d+)?(?:mm|ml|℃|%)?|[一-鿿A-Za-z]+)"
FILLER, LAST_NUMBER = "(?:ge|le|为|最大|最小|标准|要求|分别|的)+", "(\\d+(?:\\.\\d+)?(?:mm|ml|℃|%)?)$"
NEGATIONS = ("不能", "不应", "不宜", "不可", "不得", "无法", "勿", "禁止")
OBJECTS = ("直接", "简单", "无条件", "套用", "照搬", "等同", "当成", "当作")
REFUSAL = "无法|不能|没有|未找到|缺少|不具备|未提供"
NO_EVIDENCE = "无法|没有|不足|不能确认"
STOPS = "。！？\\n;"
LIST_MARK = "(?:[-*+]|\\d+[.、)])"
DESIGNATION = "(?i)(?:GB/T|ISO|IEC|ASTM|EN|DIN|JIS)\\s*[\\d.]+(?:[—\\-]\\d{4})?|表\\s*\\d+(?:[.\\-]\\d+)?|图\\s*\\d+(?:[.\\-]\\d+)?"
NOT_FACT = "推导|推算依据|并非资料原文|并非标准原文|不是资料原文|不是标准原文|非资料原文|非标准原文|无直接证据|没有直接证据|无法确认|未能确认|缺少|不具备|未提供"
ANSWER_NUMBER = "(?i)(?:^|[^A-Za-z])(\\d+(?:\\.\\d+)?(?:\\s*(?:mm|mL|℃|%|年|岁|页))?)"
FALLBACKS = ("当前生成模型不可用，无法生成正式回答；冻结证据已保留，请稍后重试。", "当前资料无法确认，冻结证据包中没有可用的本地证据。")
LONGEST = 800
# End of fixed values.

GROUP = "struct<alternatives:array<string>,negation:array<string>,object:array<string>>"
HOP = f"struct<hop_id:string,span:string,alternatives:array<string>,groups:array<{GROUP}>>"


def _text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def normal(text: Column) -> Column:
    """Comparators, units, ranges and dashes in one spelling; only digits, Latin, CJK, ``~``, ``%`` and ``-`` stay."""
    out = F.lower(_text(text))
    for a, b in REPLACED:
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(F.regexp_replace(out, "\\s+", ""), RANGE_UNITS, "$1~$3$2")
    return F.regexp_replace(out, NOT_KEPT, "")


def without_noise(text: Column, parens: bool = True, labels: bool = True) -> Column:
    """Without citation marks; of spans also without short parentheses and, unless they hold mathematics, bare labels."""
    out = F.regexp_replace(_text(text), LABEL, "")
    if parens:
        out = F.regexp_replace(out, PARENTHETICAL, "")
    return let(out, lambda o: F.when(o.rlike(MATH), o).otherwise(F.regexp_replace(o, BARE_LABEL, ""))) if labels else out


def is_fallback(answer: Column) -> Column:
    return F.trim(_text(answer)).isin(*FALLBACKS)


def _span_in(expected: Column, answer: Column) -> Column:
    """Whether one normal form of a span is brought out by an answer's normal form; ``answer``: struct of ``_parts``."""
    return (expected != "") & (F.contains(answer["a"], expected) | let(_parts(expected), lambda e: _fallback(e, answer)))


def _parts(form: Column) -> Column:
    """struct(a, n, t): a normal form with its numbers and its tokens."""
    return F.struct(form.alias("a"), F.regexp_extract_all(form, F.lit(DIGITS), 1).alias("n"), F.regexp_extract_all(form, F.lit(TOKEN), 1).alias("t"))


def _fallback(expected: Column, answer: Column) -> Column:
    e, en, et, a, an, at = expected["a"], expected["n"], expected["t"], answer["a"], answer["n"], answer["t"]
    every = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(a, w))
    concept = ~e.rlike("\\d") & e.rlike("|".join(SYNONYMS))
    for term, words in SYNONYMS.items():
        concept = concept & (~F.contains(e, F.lit(term)) | every(words))
    known = (F.size(en) > 0) & (F.size(F.array_except(en, an)) == 0)
    ordered = known & (F.size(en) > 1) & let(F.transform(en, lambda n: F.array_position(an, n)), lambda first: first == F.array_sort(first))
    words = F.regexp_replace(F.regexp_replace(e, UNIT_NUMBER, ""), FILLER, "")
    single = known & (F.size(en) == 1) & let(words, lambda w: (w == "") | F.contains(a, F.right(w, F.lit(4))))
    # the numbers in order, each after the one before
    next_ = lambda at, n: let(F.array_position(F.slice(an, at + 1, F.greatest(F.lit(1), F.size(an))), n).cast("int"), lambda k: F.when(k > 0, at + k).otherwise(-1))
    step = lambda at, n: F.when(at < 0, at).otherwise(next_(at, n))
    sequence = (F.size(en) >= 2) & (F.aggregate(en, F.lit(0), step) >= 0)
    window = (F.size(at) >= F.size(et)) & F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(at) - F.size(et) + 1)), lambda i: F.slice(at, i, F.size(et)) == et)
    end = lambda joined: let(F.regexp_extract(joined, LAST_NUMBER, 1), lambda number: (number != "") & let(F.concat(F.right(F.regexp_replace(joined, LAST_NUMBER, ""), F.lit(4)), number), lambda tail: (F.length(tail) >= 5) & F.contains(a, tail)))
    by_number = let(F.array_join(et, ""), end)
    last = F.array_join(F.slice(et, F.greatest(F.lit(1), F.size(et) - 2), F.lit(3)), "")
    by_tail = let(last, lambda x: (F.length(x) >= 4) & F.contains(F.array_join(at, ""), x))
    rest = (F.size(et) > 0) & (window | by_number | by_tail)
    return concept | ordered | single | sequence | rest


def span_matches(span: Column, answer: Column, alternatives: Column | None = None) -> Column:
    """Whether an answer brings a span out as declared, with or without its parentheses, or in an accepted wording.

    The answer keeps its parentheses, which hold facts there and units in a span.
    """
    return let(answer_parts(answer), lambda found: _span_found(span, found, alternatives))


def answer_parts(answer: Column) -> Column:
    """The numbers and tokens of an answer's normal form, that many spans are held to."""
    return let(normal(without_noise(answer, parens=False)), _parts)


def _span_found(span: Column, found: Column, alternatives: Column | None = None) -> Column:
    spans = F.array(span) if alternatives is None else F.concat(F.array(span), F.coalesce(alternatives, F.array().cast("array<string>")))
    spans = F.filter(spans, lambda x: F.length(F.trim(_text(x))) > 0)
    forms = lambda x: F.array_distinct(F.array(normal(without_noise(x)), normal(without_noise(x, parens=False))))
    return F.exists(spans, lambda x: F.exists(forms(x), lambda e: _span_in(e, found)))


def group_matches(group: Column, answer: Column) -> Column:
    """Whether an answer meets a requirement: any alternative, or a negation and an object.

    ``answer``: its normal form with labels kept. A group with a negation or object list is composite; the list it lacks is the built-in one.
    """
    hit = lambda terms: F.exists(terms, lambda t: let(normal(without_noise(t, labels=False)), lambda x: (x != "") & F.contains(answer, x)))
    or_else = lambda given, words: F.when(F.size(F.coalesce(given, F.array().cast("array<string>"))) > 0, given).otherwise(F.array(*map(F.lit, words)))
    composite = group["negation"].isNotNull() | group["object"].isNotNull()
    both = hit(or_else(group["negation"], NEGATIONS)) & hit(or_else(group["object"], OBJECTS))
    return F.when(composite, both).otherwise(hit(F.coalesce(group["alternatives"], F.array().cast("array<string>"))))


def refuses(text: Column, start: Column, end: Column) -> Column:
    """Whether the sentence around characters start to end (from 0) says that something can't be said."""
    left = F.regexp_extract(F.substring(text, F.lit(1), start), f"([^{STOPS}]*)$", 1)
    right = F.regexp_extract(F.substring(text, end + 1, F.length(text)), f"^(\\s*[^{STOPS}]*)", 1)
    return F.concat(left, F.substring(text, start + 1, end - start), right).rlike(REFUSAL)


def _places(found: Column, text: Column) -> Column:
    """(value, at) of values that occur in a text one after the other; at counts from 0."""
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<value:string,at:int>>").alias("got"))

    def step(done: Column, x: Column) -> Column:
        at = F.position(x, text, done["end"] + 1)
        return F.struct((at - 1 + F.length(x)).alias("end"), F.concat(done["got"], F.array(F.struct(x.alias("value"), (at - 1).alias("at")))).alias("got"))

    return F.aggregate(found, start, step)["got"]


def unsupported_numbers(answer: Column, context: Column) -> Column:
    """Numbers of an answer, with units, that the context lacks and that no refusal surrounds."""
    known = F.regexp_extract_all(_text(context), F.lit(DIGITS), 1)
    places = _places(F.regexp_extract_all(answer, F.lit(ANSWER_NUMBER), 1), answer)
    bad = let(known, lambda k: F.filter(places, lambda p: ~F.array_contains(k, F.regexp_extract(p["value"], DIGITS, 1)) & ~refuses(answer, p["at"], p["at"] + F.length(p["value"]))))
    return F.transform(bad, lambda p: p["value"])


def blocks(answer: Column) -> Column:
    """Paragraphs and list items; a lead-in that ends in a colon keeps the list that follows, even after a blank line."""
    trim = lambda x: F.regexp_replace(x, "^\\s+|\\s+$", "")
    paras = F.filter(F.transform(F.split(_text(answer), "\\n\\s*\\n"), trim), lambda x: x != "")
    listed = lambda x: x.rlike(f"^(?:\\s*{LIST_MARK}[^\\n]*(?:\\n|$)|\\s*\\n)+$")
    head = lambda x: trim(F.substring_index(x, "\n", 1))
    lead = lambda x: head(x).endswith("：") & ~head(x).rlike(f"^{LIST_MARK}")
    follows = lambda ps, x, i: (i > 0) & F.coalesce(F.get(ps, i - 1), F.lit("")).endswith("：") & listed(x)
    # lines that stay together are joined by a mark that no text holds
    one = lambda x, i, f: F.concat(F.when(i == 0, "").when(f, "\u0001").otherwise("\n\n"), F.when(f | lead(x), F.replace(x, F.lit("\n"), F.lit("\u0001"))).otherwise(x))
    held = let(paras, lambda ps: F.transform(ps, lambda x, i: let(follows(ps, x, i), lambda f: one(x, i, f))))
    parts = F.split(F.array_join(held, ""), f"\\n\\n|\\n(?=\\s*{LIST_MARK})")
    return F.filter(F.transform(parts, lambda x: trim(F.replace(x, F.lit("\u0001"), F.lit("\n")))), lambda x: x != "")


def is_numeric_claim(block: Column) -> Column:
    """Whether a block measures something: list marks and names of standards, tables and figures don't count, nor do refusals."""
    text = F.regexp_replace(F.regexp_replace(block, f"(?m)^[ \\t]*{LIST_MARK}[ \\t]*", ""), DESIGNATION, " ")
    places = let(text, lambda t: _places(F.regexp_extract_all(t, F.lit(DIGITS), 1), t))
    return F.exists(places, lambda p: ~refuses(block, p["at"], p["at"] + F.length(p["value"])))


def numeric_coverage(answer: Column) -> Column:
    """struct(claims, attributed, coverage): blocks that measure something, and those of them that cite or say that they derive."""
    good = lambda claims: F.filter(claims, lambda b: b.rlike("\\[L\\d+\\]") | b.rlike(NOT_FACT))
    share = lambda n, m: F.struct(n.alias("claims"), m.alias("attributed"), F.when(n > 0, F.round(m / n, 3)).alias("coverage"))
    return let(F.filter(blocks(answer), is_numeric_claim), lambda claims: let(F.size(good(claims)), lambda m: share(F.size(claims), m)))


def _share(flags: Column) -> Column:
    return let(flags, lambda fs: F.when(F.size(fs) > 0, F.round(F.size(F.filter(fs, lambda x: x)) / F.size(fs), 3)))


def soft_audit(rows: DataFrame) -> DataFrame:
    """The deterministic audit of answers, one row each.

    Needs id, answer, items (array of citation_id, source, content), spans (array of string), sources, terms, refusals, ambiguities
    (arrays of GROUP) and hops (array of HOP). Verdicts on behaviour are null where there is no answer of the system's own.
    """
    from .retrieval import matches

    empty = lambda kind: F.array().cast(f"array<{kind}>")
    r = rows.select("id", _text(F.col("answer")).alias("answer"), F.coalesce("items", empty("struct<citation_id:string,source:string,content:string>")).alias("items"), F.filter(F.coalesce("spans", empty("string")), lambda x: x.isNotNull()).alias("spans"), F.filter(F.coalesce("sources", empty("string")), lambda x: x != "").alias("sources"), *[F.coalesce(c, empty(GROUP)).alias(c) for c in ("terms", "refusals", "ambiguities")], F.coalesce("hops", empty(HOP)).alias("hops"))
    r = r.withColumn("used", F.array_sort(F.array_distinct(F.regexp_extract_all("answer", F.lit(CITATION), 1)))).withColumn("allowed", F.transform("items", lambda x: x["citation_id"]))
    r = r.withColumn("found", normal(without_noise(F.col("answer"), parens=False, labels=False))).withColumn("said", answer_parts(F.col("answer")))
    r = r.withColumn("invalid", F.array_except("used", "allowed")).withColumn("cited", F.array_sort(F.array_distinct(F.transform(F.filter("items", lambda x: F.array_contains("used", x["citation_id"])), lambda x: x["source"]))))
    r = r.withColumn("hits", F.filter("sources", lambda s: F.exists("cited", lambda c: matches("bidirectional", s, c))))
    met = lambda c: F.transform(c, lambda g: group_matches(g, F.col("found")))
    r = r.withColumn("span_hits", F.transform("spans", lambda s: _span_found(s, F.col("said")))).withColumn("term_hits", met("terms")).withColumn("refusal_hits", met("refusals")).withColumn("ambiguity_hits", met("ambiguities"))
    span_of = lambda h: F.when((F.length(F.trim(_text(h["span"]))) > 0) | (F.size(F.coalesce(h["alternatives"], empty("string"))) > 0), _span_found(h["span"], F.col("said"), h["alternatives"]))
    hop = lambda h: (F.size(h["groups"]) > 0) & F.forall(h["groups"], lambda g: group_matches(g, F.col("found"))) & F.coalesce(span_of(h), F.lit(True))
    r = r.withColumn("hop_hits", F.transform("hops", hop)).withColumn("numbers", unsupported_numbers(F.col("answer"), F.array_join(F.transform("items", lambda x: x["content"]), " "))).withColumn("coverage", numeric_coverage(F.col("answer")))
    present = (F.length(F.trim("answer")) > 0) & ~is_fallback(F.col("answer"))
    refused = F.when(present, F.when(F.size("refusals") > 0, F.forall("refusal_hits", lambda x: x)).when(F.size("sources") == 0, F.col("answer").rlike(REFUSAL)))
    safe = F.when(present & (F.size("ambiguities") > 0), F.forall("ambiguity_hits", lambda x: x))
    declared = (F.size("refusals") > 0) | (F.size("ambiguities") > 0)
    r = r.withColumn("refusal_correctness", refused).withColumn("ambiguity_safety", safe).withColumn("declared", declared).withColumn("present", present)
    boundary = F.col("declared") | F.col("refusal_correctness").isNotNull() | F.col("ambiguity_safety").isNotNull()
    hops_apply = (F.size("hops") > 0) & F.col("present") & ~F.col("declared")
    numbers_apply = F.col("present") & (F.col("coverage.claims") > 0) & ~F.col("declared")
    answered, items = F.length("answer") > 0, F.size("items") > 0
    status = F.when(F.size("invalid") > 0, "fail").when(F.size("used") > 0, "pass").otherwise("not_applicable")
    warnings = [
        (F.size("invalid") > 0, "citation_invalid"),
        ((F.size("used") == 0) & items & answered & ~F.col("answer").rlike(REFUSAL), "citation_missing"),
        (~items & answered & ~F.col("answer").rlike(NO_EVIDENCE), "answer_without_evidence"),
        (F.size("numbers") > 0, "unsupported_number"),
        (F.length("answer") > LONGEST, "answer_too_long"),
        ((F.size("sources") > 0) & (F.size("hits") == 0), "source_not_cited"),
    ]
    return r.select(
        "id", "used", "invalid", status.alias("citation_status"), (~boundary).alias("citation_applicable"),
        F.when(F.size("allowed") > 0, F.round(F.size("used") / F.size("allowed"), 3)).alias("citation_usage"),
        _share(F.col("span_hits")).alias("span_recall"), (~boundary).alias("span_applicable"), _share(F.col("term_hits")).alias("term_recall"),
        F.when(F.size("sources") > 0, F.round(F.size("hits") / F.size("sources"), 3)).otherwise(1.0).alias("source_coverage"),
        F.col("numbers").alias("unsupported_numbers"), (F.size("invalid") + F.size("numbers")).alias("unsupported_claims"), "refusal_correctness", "ambiguity_safety",
        "hop_hits", F.when(hops_apply, _share(F.col("hop_hits"))).alias("hop_recall"), hops_apply.alias("hop_applicable"),
        F.col("coverage.claims").alias("numeric_claims"), F.col("coverage.attributed").alias("attributed_claims"), F.when(numbers_apply, F.col("coverage.coverage")).alias("numeric_coverage"), numbers_apply.alias("numeric_applicable"),
        F.length("answer").alias("answer_length"), F.filter(F.array(*[F.when(c, F.lit(s)) for c, s in warnings]), lambda x: x.isNotNull()).alias("warnings"),
    )


def lost_to_truncation(facts: Column, contents: Column, chars: int) -> Column:
    """Labels of facts (array of label, alternatives) that whole contents have and contents cut to ``chars`` have not."""
    full = normal(F.array_join(contents, "\n"))
    cut = normal(F.array_join(F.transform(contents, lambda c: F.substring(c, 1, chars)), "\n"))
    has = lambda f, text: F.exists(f["alternatives"], lambda a: F.contains(text, normal(a)))
    return F.transform(F.filter(facts, lambda f: ~has(f, cut) & has(f, full)), lambda f: f["label"])


def context_text(allowed: Column, items: Column) -> Column:
    """The evidence as a prompt shows it; items have citation_id, title, source, page (from 0), rank, status, content."""
    page = lambda x: F.when(x["page"].isNotNull(), F.concat(F.lit("，第 "), (x["page"] + 1).cast("string"), F.lit(" 页"))).otherwise("")
    one = lambda x: F.concat(F.lit("["), x["citation_id"], F.lit("] 标题："), x["title"], F.lit("\n来源："), x["source"], page(x), F.lit("\n原始检索排名："), x["rank"].cast("string"), F.lit("\n证据状态："), x["status"], F.lit("\n"), x["content"])
    head = F.array(F.concat(F.lit("本次允许引用："), F.array_join(allowed, "、")), F.lit("只能使用以下证据回答；没有证据支持的内容必须明确说明无法确认。"))
    return F.when(F.size(items) == 0, "（无可用本地证据）").otherwise(F.array_join(F.concat(head, F.transform(items, one)), "\n\n---\n\n"))
