"""Claims of answers: splitting into sections, blocks and sentences, types, citations, applicability, warnings, conflicts, delivery.

Answers are (answer_id, answer); evidence is (answer_id, pos, citation_id, source_type, evidence_status, evidence_reason, scope,
material_grade, content). Everything is a column expression or a join within an answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.shared import written
from .conflicts import sharing_pairs

# Patterns that decide the results.
CITATION = "\\[([LW]\\d+)\\]"
NUMBER = "(?i)([-+]?\\d+(?:\\.\\d+)?(?:\\s*[~～至到-]\\s*[-+]?\\d+(?:\\.\\d+)?)?\\s*(?:mm|cm|mL|℃|°|%|MPa|kJ/m²)?)"
STANDARD = "(?:GB/T|GBT|GB|ISO|ASTM|EN|FDA|EU)\\s*\\+?\\s*[\\d.]+\\s*[—–-]?\\s*\\d{0,4}"
REFERENCE = "(?i)((?:GB/T|ISO|IEC|ASTM|EN|DIN|JIS|RFC)\\s*[A-Za-z0-9./—\\-]+)"
SEPARATOR = "^\\|?\\s*:?-{2,}\\s*(?:\\|\\s*:?-{2,}\\s*)*\\|?$"
HEADING = "^#{1,6}\\s*(.+?)\\s*$"
UNVERIFIED = "证据不足|冲突|风险|验证|参考|局限|限制|待验证|不确定"
TABLE_WORDS = "方案|材料|结论|证据|来源|状态|风险|验证|推荐"
STRUCTURAL = (
    "^#{1,6}\\s*",
    "^```",
    "^(?:---|\\*\\*\\*|___)$",
    "^\\s*(?:不涉及|不适用|无需|无额外|未发现|没有发现|无冲突|无相关|略)",
    "^\\s*\\[[LW]\\d+\\]\\s*[《\"']?.*(?:来源|第\\s*\\d+\\s*页|\\.pdf|\\.md|\\.txt|\\.csv)",
    "^\\|\\s*:?-{3,}",
    f"^\\|+\\s*(?:(?:{TABLE_WORDS})\\s*)?(?:\\|\\s*(?:(?:{TABLE_WORDS})\\s*)?)*$",
    "^[【\\[]?(?:资料事实|设计建议|待验证项|验证建议|结论|限制与风险)[】\\]]?[:：]?$",
    "^(?:\\[[LW]\\d+\\]\\s*)+$",
)
REFUSAL = "无法(?:科学地)?给出|资料不足|不能依据|无法支持|不应定案"
TYPES = (
    ("refusal_claim", REFUSAL),
    ("direct_fact", "资料事实|直接资料|原文指出"),
    ("derived_result", "设计推断|综合推导|推导结果"),
    ("compliance_claim", "合规待验证|待验证|需要验证"),
    ("assumption", "假设|假定|如果|在[^。！？]*情况下|前提"),
    ("compliance_claim", "符合|合规|法规|标准要求|安全认证|食品接触|不得|必须"),
    ("design_inference", "建议|推荐|适合|优先|更好|应当|应该|因此|综合来看|说明"),
    ("direct_fact", "\\[[LW]\\d+\\]"),
    ("derived_result", "推算|计算|由此|意味着|综合"),
)
ADVICE = "推荐|建议|优先|更适合|选择|应当|应该"
DUTIES = ("条件|场景|要求|如果|前提|适用|取决于", "风险|限制|局限|注意|不确定|代价|成本", "验证|核实|确认|测试|补充资料|待查")
PERCENTILE, PERCENTILE_SOURCE = "(?i)P\\s*(?:5|50|95)|覆盖[^。；]{0,20}百分位", "(?i)P\\s*(?:5|50|95)|百分位"
HAND, CUP, NOT_DIRECT = "手宽|手长", "杯径|外径|直径", "不能直接|不能仅|无法直接|不得直接"
MATERIAL, MATERIAL_ADVICE = "(?i)(?:^|[^A-Za-z])(?:Tritan|PC|PP|PPSU|304|316)(?:$|[^A-Za-z])", "推荐|建议|选择|耐热|抗冲击|适合|更好"
CONDITIONED = "在[^。；]{1,80}(?:条件|场景|要求)|如果|前提|需验证|风险|限制|适用"
CONFLICT_WORDS = "但是|然而|相反|不一致|冲突|分别"
WORD = "([一-鿿A-Za-z]{2,})"
SEVERE = ("citation_invalid", "scope_mismatch", "calculation_inconsistent", "indirect_evidence", "web_evidence_unverified", "recommendation_unconditional")
# End of fixed values.


def drop_table_headers(answer: Column) -> Column:
    """The answer's lines without separator rows of tables and the rows above them."""
    lines = F.split(F.coalesce(answer, F.lit("")), "\r?\n")
    separator = lambda x: F.trim(x).rlike(SEPARATOR)
    keep = F.transform(lines, lambda x, i: F.when(separator(x) | (F.ltrim(x).startswith("|") & separator(F.coalesce(F.get(lines, i + 1), F.lit("")))), None).otherwise(x))
    return F.array_join(F.filter(keep, lambda x: x.isNotNull()), "\n")


def blocks(text: Column) -> Column:
    """Paragraphs, and each table row on its own."""
    apart = F.regexp_replace(text, "(?m)^[ \t]*(\\|.*?)[ \t]*$", "\n$1\n")
    return F.filter(F.split(apart, "\n\\s*\n"), lambda x: F.length(F.trim(F.regexp_replace(x, "\\s", ""))) > 0)


def sentences(block: Column) -> Column:
    """Parts of six characters or more that end at a stop or a line, without list marks."""
    parts = F.split(F.regexp_replace(block, "([。！？!?；;])\\s*", "$1\n"), "\n+")
    return F.transform(F.filter(parts, lambda x: F.length(_strip(x)) >= 6), lambda x: F.regexp_replace(x, "^[ \\-*•\t]+|[ \\-*•\t]+$", ""))


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, "^\\s+|\\s+$", "")


def claim_type(text: Column) -> Column:
    out = F.when(text.rlike(TYPES[0][1]), TYPES[0][0])
    for name, p in TYPES[1:]:
        out = out.when(text.rlike(p), name)
    return out.otherwise("unsupported")


def is_structural(text: Column) -> Column:
    out = F.lit(False)
    for p in STRUCTURAL:
        out = out | _strip(text).rlike(p)
    return out


def claim_role(text: Column) -> Column:
    return F.when(is_structural(text), "structural").when(text.rlike(REFUSAL + "|需要.*验证"), "refusal").when(text.rlike("待验证|限制|风险|尚需|仍需"), "limitation").otherwise("substantive")


def numbers(text: Column) -> Column:
    """Measured values, without those of standards' names."""
    return F.regexp_extract_all(F.regexp_replace(text, STANDARD, " "), F.lit(NUMBER), 1)


def extract(answers: DataFrame) -> DataFrame:
    """(answer_id, claim_no, text, type, role, citations, numbers): the claims of every answer.

    Sections named as unknown, to verify or sources, and named sections that cite nothing, hold no claims. A sentence
    without a citation has those of its block. Structural sentences count in claim_no and are left out.
    """
    each = answers.select("answer_id", F.posexplode(blocks(drop_table_headers(F.col("answer")))).alias("pos", "block"))
    each = each.withColumn("heading", F.nullif(F.regexp_extract(_strip(F.col("block")), HEADING, 1), F.lit("")))
    run = W.partitionBy("answer_id").orderBy("pos")
    each = each.withColumn("section", F.count("heading").over(run))
    per = W.partitionBy("answer_id", "section")
    each = each.withColumn("title", F.max("heading").over(per)).withColumn("cites", F.bool_or(F.col("heading").isNull() & F.col("block").rlike(CITATION)).over(per))
    body = each.where("heading IS NULL").where(F.col("title").isNull() | (~F.col("title").rlike(UNVERIFIED) & F.col("cites")))
    rows = body.select("answer_id", "pos", F.regexp_extract_all("block", F.lit(CITATION), 1).alias("of_block"), F.posexplode(sentences(F.col("block"))).alias("k", "text"))
    rows = rows.withColumn("claim_no", F.row_number().over(W.partitionBy("answer_id").orderBy("pos", "k"))).withColumn("role", claim_role(F.col("text"))).where("role <> 'structural'")
    own = F.regexp_extract_all("text", F.lit(CITATION), 1)
    return rows.select("answer_id", "claim_no", "text", claim_type(F.col("text")).alias("type"), "role", F.when(F.size(own) > 0, own).otherwise(F.col("of_block")).alias("citations"), numbers(F.col("text")).alias("numbers"))


def number_citations(evidence: DataFrame) -> DataFrame:
    """``evidence`` with citation_id: L1, L2, ... for local documents and W1, ... for web ones, in order of pos."""
    kind = F.when(F.col("source_type") == "web", "web").otherwise("local")
    rank = F.row_number().over(W.partitionBy("answer_id", "source_type").orderBy("pos"))
    return evidence.withColumn("source_type", kind).withColumn("citation_id", F.concat(F.when(F.col("source_type") == "web", "W").otherwise("L"), rank))


def cited(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(answer_id, claim_no, nth, citation, found, doc columns): each citation's document, by id, else by place within its type."""
    asked = claims.select("answer_id", "claim_no", F.posexplode("citations").alias("nth", "citation"))
    cols = ["pos", "source_type", "evidence_status", "evidence_reason", "scope", "material_grade", "content"]
    doc = F.struct(*cols)
    by_id = evidence.where("citation_id IS NOT NULL").groupBy("answer_id", F.col("citation_id").alias("citation")).agg(F.min_by(doc, "pos").alias("d"))
    rank = F.row_number().over(W.partitionBy("answer_id", "kind").orderBy("pos"))
    placed = evidence.withColumn("kind", F.when(F.coalesce("source_type", F.lit("local")) == "web", "W").otherwise("L")).withColumn("rank", rank)
    placed = placed.select("answer_id", F.concat("kind", "rank").alias("citation"), doc.alias("p"))
    got = asked.join(by_id, ["answer_id", "citation"], "left").join(placed, ["answer_id", "citation"], "left")
    got = got.withColumn("doc", F.coalesce("d", "p"))
    return got.select("answer_id", "claim_no", "nth", "citation", F.col("doc").isNotNull().alias("found"), *[F.col(f"doc.{c}").alias(c) for c in cols])


def assess(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """``cited`` with status: missing, mismatch, indirect or full, by references, populations and the retrieval's verdict."""
    rows = cited(claims, evidence).join(claims.select("answer_id", "claim_no", "text"), ["answer_id", "claim_no"])
    # the first 4000 characters of a source count (fixed value)
    source = F.lower(F.concat_ws(" ", "scope", "material_grade", F.substring("content", 1, 4000)))
    squeezed = F.regexp_replace(source, " ", "")
    refs = F.transform(F.regexp_extract_all("text", F.lit(REFERENCE), 1), lambda x: F.regexp_replace(F.lower(x), " ", ""))
    # 未成年人 holds 成年人: a text for minors names both
    adult, minor = F.contains(F.col("text"), F.lit("成年人")), F.contains(F.col("text"), F.lit("未成年人"))
    s_adult, s_minor = F.contains(source, F.lit("成年人")), F.contains(source, F.lit("未成年人"))
    mismatch = ((F.size(refs) > 0) & ~F.exists(refs, lambda r: F.contains(squeezed, r))) | (adult & s_minor & ~s_adult) | (minor & s_adult & ~s_minor)
    status = F.when(~F.col("found"), "missing").when(F.col("evidence_status") == "scope_mismatch", "mismatch").when(F.col("evidence_status") == "indirect", "indirect").when(mismatch, "mismatch").otherwise("full")
    return rows.withColumn("status", status)


def calculation_issues(answer: Column) -> Column:
    """How many of the two unit and definition mistakes an answer makes."""
    has = lambda p: answer.rlike(p)
    one = has("(?i)H\\s*/\\s*D") & has("有效液高") & has("总高度") & has("内径") & has("外径") & ~has("两个口径|分别定义|不同口径|不得混用")
    two = has("有效容量|额定容量") & has("容积占比|利用率") & ~has("几何容量") & ~has("除以|折算|换算")
    return one.cast("int") + two.cast("int")


def audit(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """The claims of ``extract`` with warnings (in the order of the rules) and evidence_status."""
    # written: citations, their assessment and the rules each read the claims
    claims = written(extract(answers), "claims")
    seen = assess(claims, evidence).groupBy("answer_id", "claim_no").agg(*[F.bool_or(F.col("status") == s).alias(s) for s in ("missing", "mismatch", "indirect")], F.bool_or("found").alias("docs"), F.bool_or(F.col("found") & (F.col("source_type") == "web")).alias("web"), F.bool_or(F.coalesce(F.col("material_grade"), F.lit("unknown")) != "unknown").alias("graded"), F.array_join(F.collect_list(F.concat_ws(" ", "scope", "material_grade", F.substring("content", 1, 4000))), " ").alias("source"), F.count("*").alias("assessed"))
    rows = claims.join(seen, ["answer_id", "claim_no"], "left").join(answers.select("answer_id", calculation_issues(F.col("answer")).alias("wrong")), "answer_id")
    text, on = F.col("text"), lambda c: F.coalesce(F.col(c), F.lit(False))
    rules = [
        (on("missing"), "citation_invalid"),
        (on("indirect"), "indirect_evidence"),
        (on("web"), "web_evidence_unverified"),
        (text.rlike(PERCENTILE) & ~F.coalesce("source", F.lit("")).rlike(PERCENTILE_SOURCE), "indirect_evidence"),
        (text.rlike(HAND) & text.rlike(CUP) & ~text.rlike(NOT_DIRECT), "indirect_evidence"),
        (text.rlike(MATERIAL) & text.rlike(MATERIAL_ADVICE) & on("docs") & ~on("graded"), "indirect_evidence"),
        ((F.col("type") == "design_inference") & text.rlike(ADVICE) & ~text.rlike(CONDITIONED), "recommendation_unconditional"),
        (on("mismatch"), "scope_mismatch"),
    ]
    rows = rows.withColumn("warnings", F.filter(F.array(*[F.when(c, F.lit(s)) for c, s in rules]), lambda x: x.isNotNull()))
    warned = lambda s: F.array_contains("warnings", s)
    cites = F.coalesce("assessed", F.lit(0)) > 0
    status = F.when(F.col("role") == "refusal", "supported")
    for s in ("citation_invalid", "scope_mismatch", "recommendation_unconditional", "indirect_evidence"):
        status = status.when(warned(s), s)
    status = status.when(F.col("type").isin("direct_fact", "derived_result", "compliance_claim") & ~cites, "unsupported").when(cites, "supported").otherwise("unreferenced")
    rows = rows.withColumn("evidence_status", status)
    # a wrong calculation falls on the first supported claim with numbers
    could = (F.col("wrong") > 0) & (F.size("numbers") > 0) & (F.col("evidence_status") == "supported")
    first = F.min(F.when(could, F.col("claim_no"))).over(W.partitionBy("answer_id"))
    rows = rows.withColumn("evidence_status", F.when(F.col("claim_no") == first, "calculation_inconsistent").otherwise(F.col("evidence_status")))
    return rows.select("answer_id", "claim_no", "text", "type", "role", "citations", "numbers", "warnings", "evidence_status")


def unsupported() -> Column:
    """Whether an audited claim is listed as unsupported."""
    bad = F.col("evidence_status").isin("citation_invalid", "scope_mismatch", "calculation_inconsistent", "recommendation_unconditional", "indirect_evidence", "unsupported")
    return bad | ((F.col("evidence_status") == "unreferenced") & ((F.col("type") == "unsupported") | ((F.size("numbers") > 0) & (F.col("type") != "assumption"))))


def quality(audited: DataFrame, answers: DataFrame) -> DataFrame:
    """(answer_id, claims, support_rate, unsupported_rate, traceability, severe, unsupported): an answer without claims has rates 1, 0 and 1."""
    severe = F.sum(F.size(F.filter("warnings", lambda w: w.isin(*SEVERE))))
    each = audited.groupBy("answer_id").agg(F.count("*").alias("n"), F.count_if(F.col("evidence_status") == "supported").alias("s"), F.count_if(unsupported()).alias("u"), F.count_if(F.size("citations") > 0).alias("t"), severe.alias("w"))
    rows = answers.select("answer_id", calculation_issues(F.col("answer")).alias("wrong")).join(each, "answer_id", "left")
    rate = lambda c, empty: F.round(F.coalesce(F.col(c) / F.col("n"), F.lit(empty)), 3)
    none = lambda c: F.coalesce(c, F.lit(0))
    return rows.select("answer_id", none("n").alias("claims"), rate("s", 1.0).alias("support_rate"), rate("u", 0.0).alias("unsupported_rate"), rate("t", 1.0).alias("traceability"), (none("w") + F.col("wrong")).cast("long").alias("severe"), none("u").alias("unsupported"))


def conflicts(claims: DataFrame) -> DataFrame:
    """(answer_id, a, b, shared): claims of an answer that share a word but not all numbers; words in order."""
    c = claims.where(F.size("numbers") > 0).select("answer_id", "claim_no", F.array_sort(F.array_distinct("numbers")).alias("n"), F.regexp_extract_all("text", F.lit(WORD), 1).alias("w"))
    return sharing_pairs(c, "answer_id", "claim_no", "w", F.col("x.n") != F.col("y.n"))


def duties_met(audited: DataFrame) -> DataFrame:
    """(answer_id, duties): whether the claims together state conditions, risks and verification."""
    each = [F.bool_or(F.col("text").rlike(p)) for p in DUTIES]
    return audited.groupBy("answer_id").agg((each[0] & each[1] & each[2]).alias("duties"))


def delivery(answers: DataFrame, audited: DataFrame, evidence: DataFrame) -> DataFrame:
    """(answer_id, issues, statuses, deliverable): distinct blocking issues by status and claim, and the verdict."""
    # written, since five branches read the audited claims
    audited = written(audited, "audited")
    used = answers.select("answer_id", F.explode(F.array_distinct(F.regexp_extract_all("answer", F.lit(CITATION), 1))).alias("citation_id"))
    wrong = used.join(evidence.select("answer_id", "citation_id").distinct(), ["answer_id", "citation_id"], "left_anti").select("answer_id", F.lit("citation_invalid").alias("status"), F.lit(0).alias("claim_no"))
    rows = audited.join(duties_met(audited), "answer_id")
    docs = cited(audited, evidence).groupBy("answer_id", "claim_no").agg(F.bool_or("found").alias("valid"), F.bool_or(F.col("found") & (F.col("evidence_status") == "direct")).alias("direct"))
    advice = rows.where(F.col("type").isin("design_inference", "derived_result") & F.col("text").rlike(ADVICE)).join(docs, ["answer_id", "claim_no"], "left")
    ok = F.coalesce("valid", F.lit(False)) & F.col("duties")
    told = advice.select("answer_id", F.when(~ok, "recommendation_unconditional").when(~F.coalesce("direct", F.lit(False)), "indirect_evidence").alias("status"), "claim_no").where("status IS NOT NULL")
    stated = F.col("evidence_status").isin("unsupported", "unreferenced", "citation_invalid", "scope_mismatch", "calculation_inconsistent", "recommendation_unconditional", "indirect_evidence")
    terse = F.col("evidence_status").isin("unsupported", "unreferenced") & (F.size("numbers") == 0) & ~F.col("type").isin("direct_fact", "compliance_claim", "design_inference", "derived_result")
    excused = (F.col("evidence_status") == "recommendation_unconditional") & F.col("duties")
    by_claim = rows.where((F.col("role") != "refusal") & stated & ~terse & ~excused).select("answer_id", F.col("evidence_status").alias("status"), "claim_no")
    warned = rows.select("answer_id", F.explode("warnings").alias("status"), "claim_no", "duties").where("NOT (status = 'recommendation_unconditional' AND duties)").drop("duties")
    summed = answers.where(calculation_issues(F.col("answer")) > 0).select("answer_id", F.lit("calculation_inconsistent").alias("status"), F.lit(0).alias("claim_no"))
    issues = wrong.unionByName(told).unionByName(by_claim).unionByName(warned).unionByName(summed).distinct()
    each = issues.groupBy("answer_id").agg(F.count("*").alias("issues"), F.array_join(F.sort_array(F.collect_set("status")), ",").alias("statuses"))
    have = evidence.select("answer_id", F.lit(True).alias("docs")).distinct()
    out = answers.select("answer_id").join(each, "answer_id", "left").join(have, "answer_id", "left")
    return out.select("answer_id", F.coalesce("issues", F.lit(0)).alias("issues"), F.coalesce("statuses", F.lit("")).alias("statuses"), (F.col("issues").isNull() & F.col("docs").isNotNull()).alias("deliverable"))


def recommendations(audited: DataFrame) -> DataFrame:
    """(answer_id, claim_no, recommendation, evidence_ids, evidence_status): advice as conditional decisions."""
    return audited.where(F.col("type").isin("design_inference", "derived_result") & F.col("text").rlike(ADVICE)).select("answer_id", "claim_no", F.col("text").alias("recommendation"), F.col("citations").alias("evidence_ids"), "evidence_status")
