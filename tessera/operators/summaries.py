"""Summaries of recorded runs: quality with denominators, attempts, identity, latency pairs, prompt effects, retrieval audits, syncs, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.stats import values_at
from ..functions.text import lexical_terms

#: Failure classes, by what helps against them (fixed values).
LATE, LIMITED = ("provider_timeout",), "provider_rate_limit"
HARD = ("provider_rate_limit", "provider_error")
STABLE_UP_TO = 0.10


def run_quality(rows: DataFrame, by: list[str], metrics: dict[str, str | None]) -> DataFrame:
    """Availability, retries and means of runs, each with its own denominator.

    Needs status, latency, failed_attempts, rules (array), lost_facts (number). ``metrics``: a metric's column and the flag that tells whether
    it applies, or None. Means are over completed rows with a value; what a budget cut away is counted over all rows.
    """
    done = F.col("status") == "completed"
    share = lambda c: F.round(F.avg(c.cast("int")), 3)
    retried = done & (F.coalesce("failed_attempts", F.lit(0)) > 0)
    aggs = [F.count("*").alias("total"), F.count_if(done).alias("completed"), share(done).alias("success_rate"), share(F.col("status").isin(*LATE)).alias("timeout_rate"), share(F.col("status") == LIMITED).alias("rate_limit_rate"), share(F.col("status").isin(*HARD)).alias("hard_error_rate"), F.count_if(done & ~retried).alias("first_try"), F.count_if(retried).alias("retried"), F.sum(F.when(done, F.coalesce("failed_attempts", F.lit(0))).otherwise(0)).alias("failed_attempts"), F.count_if(done & (F.size("rules") > 0)).alias("malformed"), F.sum("lost_facts").alias("lost_facts"), F.round(F.max(F.when(done, F.col("latency"))), 3).alias("latency_max")]
    for name, flag in metrics.items():
        v = F.when(done & (F.coalesce(F.col(flag), F.lit(False)) if flag else F.lit(True)), F.col(name).cast("double"))
        aggs += [F.round(F.avg(v), 3).alias(f"{name}_mean"), F.count(v).alias(f"{name}_n")]
    got = rows.groupBy(*by).agg(*aggs)
    stable = (F.col("timeout_rate") <= STABLE_UP_TO) & (F.col("hard_error_rate") <= STABLE_UP_TO)
    lat = values_at(rows.where(done), by, "latency", {"latency_p50": ("lower_median", 0.5), "latency_p95": ("nearest", 0.95)})
    return got.withColumn("stable", stable).join(lat.withColumns({c: F.round(c, 3) for c in ("latency_p50", "latency_p95")}), by, "left")


def rule_histogram(rows: DataFrame, by: list[str]) -> DataFrame:
    """How often each rule changed an answer."""
    return rows.where("status = 'completed'").select(*by, F.explode("rules").alias("rule")).groupBy(*by, "rule").agg(F.count("*").alias("n"))


def status_histogram(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by, "status").agg(F.count("*").alias("n"))


def attempt_latency(rows: DataFrame, ceiling: float | None) -> DataFrame:
    """(n, p50, p95, longest, headroom) of single completed calls; runs without any recorded attempt use their rows' latency.

    ``rows`` (status, latency, attempts: array of status and latency).
    """
    done = rows.where("status = 'completed'")
    calls = done.select(F.explode("attempts").alias("a")).where("a.status = 'completed' AND a.latency IS NOT NULL").select(F.col("a.latency").alias("v"), F.lit(True).alias("call"))
    both = calls.union(done.where("latency IS NOT NULL").select("latency", F.lit(False)))
    one = both.agg(F.coalesce(F.bool_or("call"), F.lit(False)).alias("any"))
    kept = both.join(F.broadcast(one), F.lit(True)).where(F.col("call") == F.col("any"))
    got = kept.agg(F.count("*").alias("n"), F.max("v").alias("longest"))
    places = values_at(kept, [], "v", {"p50": ("nearest", 0.5), "p95": ("nearest", 0.95)}).agg(F.max("p50").alias("p50"), F.max("p95").alias("p95"))
    return got.join(F.broadcast(places), F.lit(True)).select("n", F.round("p50", 3).alias("p50"), F.round("p95", 3).alias("p95"), F.round("longest", 3).alias("longest"), F.round(F.lit(ceiling).cast("double") - F.col("longest"), 3).alias("headroom"))


def identity_problems(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(problem) for each key in which runs differ, runs that retrieved or only pretended to run, and repeated repetition numbers."""
    got = runs.agg(*[F.countDistinct(F.coalesce(F.col(k).cast("string"), F.lit("None"))).alias(k) for k in keys], F.bool_or((F.coalesce("retrieval_calls", F.lit(-1)) != 0) | F.coalesce("dry_run", F.lit(False))).alias("unreal"), (F.count("repetition") - F.countDistinct("repetition")).alias("again"), F.count("*").alias("n"))
    found = F.array(*[F.when(F.col(k) > 1, F.lit(f"{k} differs")) for k in keys], F.when(F.col("unreal"), "not a real replay"), F.when(F.col("again") > 0, "repeated repetition"), F.when(F.col("n") == 0, "no runs"))
    return got.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("problem"))


def latency_pairs(rows: DataFrame, arms: tuple[str, str]) -> DataFrame:
    """(pairs, mean, median, slower, faster) of the second arm's latency minus the first's in a question and round, completed calls only."""
    last = rows.where("status = 'completed'").groupBy("question_id", "round", "arm").agg(F.max_by("latency", "seq").alias("v"))
    wide = last.groupBy("question_id", "round").agg(*[F.max(F.when(F.col("arm") == a, F.col("v"))).alias(c) for a, c in zip(arms, ("x", "y"), strict=True)])
    d = wide.select((F.col("y") - F.col("x")).alias("d")).where("d IS NOT NULL")
    # the true median, of one value a cell
    return d.agg(F.count("*").alias("pairs"), F.round(F.avg("d"), 2).alias("mean"), F.round(F.expr("percentile(d, 0.5)"), 2).alias("median"), F.count_if(F.col("d") > 0).alias("slower"), F.count_if(F.col("d") < 0).alias("faster"))


def prompt_effect(rows: DataFrame, versions: tuple[str, str], group: Column) -> DataFrame:
    """(group, cells, mean, median, sd, se, better, worse, tied) of a cell's mean under the second prompt minus that under the first.

    A cell is a question of a case set that both prompts completed; the null group is all of them; one cell has deviation 0.
    """
    each = rows.where("status = 'completed' AND metric IS NOT NULL").withColumn("grp", group)
    cell = each.groupBy("case_set", "question_id", "grp").agg(*[F.avg(F.when(F.col("prompt") == v, F.col("metric"))).alias(c) for v, c in zip(versions, ("x", "y"), strict=True)])
    d = cell.select("grp", (F.col("y") - F.col("x")).alias("d")).where("d IS NOT NULL")
    sd = F.coalesce(F.stddev_samp("d"), F.lit(0.0))
    got = d.rollup("grp").agg(F.count("*").alias("cells"), F.round(F.avg("d"), 4).alias("mean"), F.round(F.expr("percentile(d, 0.5)"), 4).alias("median"), F.round(sd, 4).alias("sd"), F.round(sd / F.sqrt(F.count("*")), 4).alias("se"), F.count_if(F.col("d") > 0).alias("better"), F.count_if(F.col("d") < 0).alias("worse"), F.count_if(F.col("d") == 0).alias("tied"))
    return got.withColumnRenamed("grp", "group")


def arm_grains(rows: DataFrame) -> DataFrame:
    """Quality by run and pooled over a set's arm, as grouping sets; ``round`` is null where pooled."""
    done = F.col("status") == "completed"
    sets = [["case_set", "arm", "round"], ["case_set", "arm"]]
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], "case_set", "arm", "round").agg(F.count("*").alias("calls"), F.count_if(done).alias("completed"), F.round(F.avg(F.when(done, F.col("latency"))), 1).alias("latency_mean"), F.round(F.max(F.when(done, F.col("latency"))), 1).alias("latency_max"), F.round(F.avg(F.when(done, F.col("metric"))), 3).alias("metric_mean"), F.count(F.when(done, F.col("metric"))).alias("metric_n"))


def retrieval_summary(audit: DataFrame) -> DataFrame:
    """Counts over all questions' candidate audits: how far lexical-only candidates come, and what guards and priors do."""
    lex, top, final = F.col("retrieval_stage") == "bm25_only", F.coalesce("rerank_rank", F.lit(999)) <= 20, F.col("disposition") == "selected"
    up = (F.col("model_rank") > 20) & (F.col("combined_rank") <= 20)
    return audit.agg(F.count_if(lex).alias("bm25_only_union"), F.count_if(lex & top).alias("bm25_only_top20"), F.count_if(lex & final).alias("bm25_only_final"), F.count_if(lex & up).alias("bm25_only_promoted_to_top20"), F.count_if(lex & final & (F.col("fallback_rank") > 10)).alias("bm25_only_promoted_to_final"), F.count_if("guarded").alias("guards"), F.count_if("process_prior").alias("process_priors"))


def macro_means(rows: DataFrame, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """Means over questions to four places, a metric without value left out of its own mean."""
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("questions"), *[F.round(F.avg(m), 4).alias(f"{m}_mean") for m in metrics])


def recall_by_category(expected: DataFrame, sources: DataFrame, categories: DataFrame) -> DataFrame:
    """(category, questions, expected, found): expected sources found at all."""
    rows = expected.join(sources.select("question_id", "source", "first_rank"), ["question_id", "source"], "left").join(categories, "question_id")
    return rows.groupBy("category").agg(F.countDistinct("question_id").alias("questions"), F.count("*").alias("expected"), F.count("first_rank").alias("found"))


def feedback_means(feedback: DataFrame, keys: list[str]) -> DataFrame:
    """Mean score of each key a category, as columns; a key without scores is null."""
    return feedback.groupBy("category").pivot("key", keys).agg(F.round(F.avg("score"), 3))


def sync_diff(local: DataFrame, remote: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, action): create, update, delete or keep, by a null-safe comparison of the columns."""
    a = local.select(key, F.struct(*columns).alias("x"))
    b = remote.select(key, F.struct(*columns).alias("y"))
    both = a.join(b, key, "full_outer")
    return both.select(key, F.when(F.col("y").isNull(), "create").when(F.col("x").isNull(), "delete").when(F.col("x").eqNullSafe(F.col("y")), "keep").otherwise("update").alias("action"))


def merge_ordered(lexical: DataFrame, dense: DataFrame, k: int) -> DataFrame:
    """(question_id, doc_id, place): the lexical list's first ``k``, then the dense list, then the rest, each document once, ``k`` in all."""
    first = F.when(F.col("rank") <= k, 0).otherwise(2)
    rows = lexical.select("question_id", "doc_id", first.alias("part"), "rank").union(dense.select("question_id", "doc_id", F.lit(1), "rank"))
    once = rows.groupBy("question_id", "doc_id").agg(F.min(F.struct("part", "rank")).alias("at"))
    return once.withColumn("place", F.row_number().over(W.partitionBy("question_id").orderBy("at", "doc_id"))).where(F.col("place") <= k).select("question_id", "doc_id", "place")


def requirement_status(requirements: DataFrame, docs: DataFrame) -> DataFrame:
    """(task_id, n, status, supporting): covered, conflict, partial or missing by documents that hold enough of a requirement's terms.

    ``requirements`` (task_id, n, text), ``docs`` (task_id, doc_id, text, evidence_status). Two terms are enough, or all of fewer; a requirement
    without terms is supported by any document. Documents of a task are few, as they are what it retrieved.
    """
    asked = requirements.select("task_id", "n", lexical_terms(F.col("text")).alias("terms"))
    rows = asked.join(docs.select("task_id", "doc_id", F.lower("text").alias("t"), "evidence_status"), "task_id", "left")
    found = F.size(F.filter("terms", lambda x: F.contains(F.col("t"), x)))
    fits = F.col("doc_id").isNotNull() & (found >= F.least(F.lit(2), F.size("terms")))
    got = rows.groupBy("task_id", "n").agg(F.count_if(fits).alias("supporting"), *[F.count_if(fits & (F.col("evidence_status") == s)).alias(s) for s in ("direct", "scope_mismatch")])
    status = F.when(F.col("direct") > 0, "covered").when(F.col("scope_mismatch") > 0, "conflict").when(F.col("supporting") > 0, "partial").otherwise("missing")
    return got.select("task_id", "n", status.alias("status"), "supporting")


def task_coverage(statuses: DataFrame) -> DataFrame:
    """(task_id, requirements, covered, coverage): a task is covered if all its requirements are, partial if some are."""
    got = statuses.groupBy("task_id").agg(F.count("*").alias("requirements"), F.count_if(F.col("status") == "covered").alias("covered"), F.count_if(F.col("supporting") > 0).alias("supported"))
    return got.select("task_id", "requirements", "covered", F.when(F.col("covered") == F.col("requirements"), "covered").when((F.col("covered") > 0) | (F.col("supported") > 0), "partial").otherwise("missing").alias("coverage"))


def report(title: str, sections: dict[str, DataFrame], rows: int = 200) -> str:
    """Markdown of small results, a table a section; nulls are dashes, and a longer result says how many rows it has."""
    lines = [f"# {title}"]
    for name, df in sections.items():
        got = df.limit(rows + 1).collect()
        lines += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        lines += ["| " + " | ".join("—" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in got[:rows]]
        if len(got) > rows:
            lines.append(f"\n{df.count()} rows in all.")
    return "\n".join(lines) + "\n"
