"""Questions as task contracts: intent, references, criteria, bounded tasks, expansions, gaps, degradation, compaction, fallback grading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import lexical_terms
from .entities import any_of, present

# Word lists, texts and bounds that decide the results.
COMPARING = ("对比", "比较", "区别", "优劣", "差异")
ADVISING = ("推荐", "选择", "适合", "应该用", "怎么选", "方案")
ANALYSING = ("分析", "评估", "如何", "为什么", "要求", "影响", "需要考虑")
DESIGNING = ("设计", "尺寸", "材料", "结构", "工艺", "验证", "测试", "选型", "选材")
CALCULATING = ("计算", "估算", "容量", "体积", "面积", "换算")
FACETS = ("人体工学 手部尺寸 握持直径 杯径 杯体高度 杯口尺寸", "材料 牌号 食品接触 性能 限制", "结构 接口 密封 开合 装配", "制造工艺 成型 加工 DFM 工艺限制", "测试 验证 可靠性 风险 失效")
REFERENCE = "(?i)((?:GB/T|ISO|IEC|ASTM|EN|DIN|JIS|RFC)\\s*[A-Za-z0-9./—\\-]+)"
NOT_CANDIDATE = "对比|比较|哪个|哪些|请|是否"
BY_CRITERIA = ("(?:从|按|按照|根据|考虑|比较|评价|关注)([^。！？?！]*)", "(?:在|以)([^。！？?！]*?)(?:方面|条件|要求)")
MOST_TASKS, MOST_CANDIDATES, MOST_CRITERIA, MOST_VARIANTS, MOST_GAPS = 8, 6, 8, 4, 3
VARIANTS = (
    ((("儿童", "幼儿", "未成年"), ("水杯", "握持", "握力", "手部", "杯径")), "儿童手部尺寸 握力 握持直径 GB/T 26158-2010 儿童人体尺寸"),
    ((("26158",),), "GB/T 26158-2010 未成年人人体尺寸 儿童"),
    ((("pp", "tritan"),), "PP LyondellBasell 3486-01 TDS Tritan TX1001 TDS 食品接触 GB 4806.7"),
    ((("tritan",),), "Eastman Tritan TX1001 Technical Data Sheet"),
    ((("pp",),), "LyondellBasell PP 3486-01 Technical Data Sheet"),
    ((("食品接触", "食品安全", "材料最安全", "合规"),), "GB 4806.7-2023 塑料 食品接触 材料合规"),
    ((("标准冲突", "适用层级", "证据边界"),), "GB/T 26158-2010 儿童手部尺寸 握持 适用范围"),
)
# End of fixed values.


def intent(question: Column) -> Column:
    """comparison, recommendation, complex or simple, by words alone; a calculation with numbers stays simple."""
    has = lambda words: any_of(question, words)
    lists = F.length(question) - F.length(F.replace(question, F.lit("、"), F.lit(""))) >= 2
    return (
        F.when(has(COMPARING), "comparison")
        .when(has(ADVISING), "recommendation")
        .when(has(CALCULATING) & question.rlike("\\d") & ~has(ANALYSING), "simple")
        .when(has(ANALYSING) | has(DESIGNING) | lists, "complex")
        .otherwise("simple")
    )


def _clean(parts: Column) -> Column:
    """Distinct parts in order, without white space runs and punctuation around."""
    tidy = F.transform(parts, lambda x: F.regexp_replace(F.regexp_replace(x, "\\s+", " "), "^[ ，,。；;:：]+|[ ，,。；;:：]+$", ""))
    return F.array_distinct(F.filter(tidy, lambda x: x != ""))


def references(question: Column) -> Column:
    return _clean(F.regexp_extract_all(question, F.lit(REFERENCE), 1))


def candidates(question: Column) -> Column:
    """Explicit alternatives of a comparison: the first six parts of 2 to 40 characters that aren't words of asking."""
    parts = F.transform(F.split(question, "、|,|，|和|与|还是"), lambda x: F.regexp_replace(x, "^[ ，,。；;:：]+|[ ，,。；;:：]+$", ""))
    fit = F.filter(parts, lambda x: (F.length(x) > 1) & (F.length(x) <= 40) & ~x.rlike(NOT_CANDIDATE))
    return F.when(intent(question) == "comparison", _clean(F.slice(fit, 1, MOST_CANDIDATES))).otherwise(F.array().cast("array<string>"))


def criteria(question: Column) -> Column:
    """At most eight dimensions that a question asks to judge by."""
    said = F.concat(*[F.regexp_extract_all(question, F.lit(p), 1) for p in BY_CRITERIA])
    return F.slice(_clean(F.flatten(F.transform(said, lambda x: F.split(x, "、|,|，|和|与|及")))), 1, MOST_CRITERIA)


def tasks(question: Column) -> Column:
    """array<struct<operation, query>>: the bounded tasks of a question; simple ones have none, long plans keep the first seven and the last."""
    what, named, dims, refs = intent(question), candidates(question), criteria(question), references(question)
    task = lambda op, q: F.struct(op if isinstance(op, Column) else F.lit(op), q)
    kind = "array<struct<operation:string,query:string>>"
    one = lambda op, q: F.array(task(op, q)).cast(kind)
    none = F.array().cast(kind)
    by_candidate = F.transform(named, lambda c: task("retrieve", F.concat(c, F.lit(" 的相关性能、特征、应用条件和限制")))).cast(kind)
    first = F.when((what == "comparison") & (F.size(named) > 0), by_candidate).otherwise(one("retrieve", question))
    designs = any_of(F.concat_ws(" ", question, F.array_join(dims, " ")), DESIGNING) & what.isin("complex", "recommendation")
    facets = F.when(designs, F.array(*[task("retrieve", F.concat(question, F.lit("；" + f))) for f in FACETS]).cast(kind)).otherwise(none)
    judged = F.when(F.size(dims) > 0, one(F.when(what == "comparison", "compare").otherwise("analyze"), F.concat(question, F.lit("；重点评价："), F.array_join(dims, "、")))).otherwise(none)
    checked = F.when(F.size(refs) > 0, one("validate", F.concat(F.array_join(refs, "；"), F.lit(" 相关条款、数据或适用范围")))).otherwise(none)
    last = one(F.when(what == "recommendation", "recommend").otherwise("synthesize"), question)
    every = F.concat(first, facets, judged, checked, last)
    cut = F.when(F.size(every) > MOST_TASKS, F.concat(F.slice(every, 1, MOST_TASKS - 1), F.slice(every, -1, 1))).otherwise(every)
    return F.when(what == "simple", none).otherwise(cut)


def expansions(question: Column) -> Column:
    """The question and its rule-based variants, distinct but for white space and case, four at most."""
    text, low = F.trim(question), F.lower(F.trim(question))
    fits = lambda groups: [any_of(low, g) for g in groups]
    both = lambda conds: conds[0] if len(conds) == 1 else conds[0] & conds[1]
    found = F.concat(F.array(text), present([(both(fits(groups)), v) for groups, v in VARIANTS]))
    key = lambda x: F.lower(F.regexp_replace(x, "\\s+", ""))
    once = F.filter(found, lambda x, i: (key(x) != "") & ~F.exists(F.slice(found, F.lit(1), i), lambda y: key(y) == key(x)))
    return F.when(F.length(text) > 0, F.slice(once, 1, MOST_VARIANTS)).otherwise(F.array().cast("array<string>"))


def expected_rule(outcome: Column, task_type: Column, mode: Column) -> Column:
    """The rule that an item is judged by: from its outcome, else from the words of its mode."""
    o, m = F.lower(F.coalesce(outcome, F.lit(""))), F.coalesce(mode, F.lit(""))
    said = F.when(m.rlike("无效引用|必须拒"), "must_refuse").when(m.rlike("若缺|资料不足|条件化推荐"), "conditional_or_refuse").when(m.rlike("公式|计算"), "calculation").when(F.contains(m, F.lit("可交付")), "deliver_or_degrade").otherwise("observe")
    delivers = F.when(F.coalesce(task_type, F.lit("")) == "calculation", "calculation").otherwise("deliver_or_degrade")
    return F.when(o.isin("refuse", "拒答") | (F.coalesce(task_type, F.lit("")) == "refusal"), "must_refuse").when(o.isin("deliver", "conditional_deliver", "交付", "条件化交付"), delivers).otherwise(said)


def degradation(deliverable: Column, timeout_stage: Column, any_failed: Column, both_completed: Column, audit: Column) -> Column:
    """none, evidence_insufficient where planner and retrieval ran and the audit found too little, else infra_timeout."""
    broken = (F.length(F.coalesce(timeout_stage, F.lit(""))) > 0) | any_failed
    return F.when(deliverable, "none").when(broken, "infra_timeout").when(both_completed & (audit == "insufficient_evidence"), "evidence_insufficient").otherwise("infra_timeout")


def tool_counters(calls: DataFrame, by: list[str]) -> DataFrame:
    """(by, tool, attempted, completed, timeout, failed) of tool calls with success and error."""
    late = F.lower(F.coalesce("error", F.lit(""))).rlike("timeout|超时|超过|deadline|timed out")
    return calls.groupBy(*by, "tool").agg(F.count("*").alias("attempted"), F.count_if("success").alias("completed"), F.count_if(~F.col("success") & late).alias("timeout"), F.count_if(~F.col("success") & ~late).alias("failed"))


def evidence_gaps(results: DataFrame) -> DataFrame:
    """(plan_id, task_id, reason, place): the three first tasks, high priority before others, whose evidence has gaps.

    Needs coverage, missing_reason, docs (number), direct (number), error, priority.
    """
    docs, open_ = F.col("docs") > 0, F.col("coverage").isNull()
    covered = (F.coalesce("coverage", F.lit("")) == "covered") | (open_ & docs & (F.col("direct") > 0))
    given = F.coalesce(F.nullif("missing_reason", F.lit("")), F.when(docs, "只有间接资料或适用范围不匹配资料，缺少直接证据").otherwise("未找到满足任务要求的直接资料"))
    reason = F.when(open_ & ~docs & (F.coalesce("error", F.lit("")) == ""), "未完成证据覆盖判断").otherwise(given)
    place = F.row_number().over(W.partitionBy("plan_id").orderBy(F.col("priority") != "high", "task_id"))
    return results.where(~covered).select("plan_id", "task_id", reason.alias("reason"), place.alias("place")).where(F.col("place") <= MOST_GAPS)


def compact(docs: DataFrame, per_source: int = 2, total: int = 18) -> DataFrame:
    """Distinct documents of a question in order, at most ``per_source`` a source and ``total`` in all, with their place."""
    once = docs.withColumn("k", F.row_number().over(W.partitionBy("question_id", "doc_id").orderBy("rank", "source"))).where("k = 1").drop("k")
    capped = once.withColumn("k", F.row_number().over(W.partitionBy("question_id", "source").orderBy("rank", "doc_id"))).where(F.col("k") <= per_source).drop("k")
    return capped.withColumn("place", F.row_number().over(W.partitionBy("question_id").orderBy("rank", "doc_id"))).where(F.col("place") <= total)


def fallback_grade(candidates_: DataFrame, question: str = "question", text: str = "text") -> DataFrame:
    """Candidates that hold terms of their question, direct ones first, then by how often; without any, the first usable one.

    Needs question_id, doc_id, rank, evidence_status. Documents out of scope never pass.
    """
    low = F.lower(F.col(text))
    times = F.aggregate(lexical_terms(F.col(question)), F.lit(0), lambda s, t: s + ((F.length(low) - F.length(F.replace(low, t, F.lit("")))) / F.length(t)).cast("int"))
    rows = candidates_.where("evidence_status <> 'scope_mismatch'").withColumn("times", times)
    per = W.partitionBy("question_id")
    rows = rows.withColumn("best", F.max("times").over(per)).withColumn("first", F.row_number().over(per.orderBy("rank", "doc_id")))
    kept = rows.where("times > 0 OR (best = 0 AND first = 1)")
    return kept.withColumn("place", F.row_number().over(per.orderBy((F.col("evidence_status") != "direct") & (F.col("best") > 0), F.desc("times"), "rank", "doc_id"))).drop("best", "first")
