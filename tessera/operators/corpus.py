"""Chunks, ids, snapshot differences, evidence packs, claims and contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.stats import values_at
from ..functions.text import numbers
from .conflicts import containing_terms, sharing_pairs


def chunk_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def chunk_statistics(chunks: DataFrame, text_col: str) -> DataFrame:
    """(chunk_count, mean_chars, p95_chars): one row, zeros where there is no chunk."""
    n = chunks.select(F.length(text_col).cast("long").alias("n"))
    p95 = values_at(n, [], "n", {"p": ("cut", 0.95)}).agg(F.max("p").alias("p"))
    got = n.agg(F.count("*").alias("chunk_count"), F.coalesce(F.round(F.avg("n"), 2), F.lit(0.0)).alias("mean_chars"))
    return got.join(F.broadcast(p95), F.lit(True)).select("chunk_count", "mean_chars", F.coalesce("p", F.lit(0)).alias("p95_chars"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): added or changed files are ``changed``, gone ones ``removed``, equal ones ``unchanged``."""
    b, a = before.select("path", F.col("sha256").alias("old")), after.select("path", F.col("sha256").alias("new"))
    change = F.when(F.col("new").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed")
    return b.join(a, "path", "full_outer").select("path", change.alias("change"))


def upsert(store: DataFrame, diff: DataFrame, fresh: DataFrame) -> DataFrame:
    """The store without rows of changed and removed paths, plus the fresh rows of changed paths."""
    gone = diff.where("change <> 'unchanged'").select("path")
    new = fresh.join(diff.where("change = 'changed'").select("path"), "path", "left_semi")
    return store.join(gone, "path", "left_anti").unionByName(new.select(*store.columns))


def evidence_pack(docs: DataFrame, n: int, chars: int) -> DataFrame:
    """The first ``n`` distinct documents a question in rank order, cut to ``chars`` with flags, named L1, L2, ..."""
    once = docs.withColumn("__k", F.row_number().over(W.partitionBy("question_id", "doc_id").orderBy("rank"))).where("__k = 1")
    w = W.partitionBy("question_id").orderBy("rank", "doc_id")
    got = once.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)
    return got.select("question_id", "doc_id", F.concat(F.lit("L"), F.col("pos")).alias("citation_id"), F.expr(f"substring(text, 1, {chars})").alias("content"), (F.length("text") > chars).alias("truncated"))


def citation_sets(rows: DataFrame) -> DataFrame:
    """Used, allowed and invalid citations of answers such as ``[L2]``."""
    used = F.array_sort(F.array_distinct(F.regexp_extract_all("answer", F.lit("\\[([LW]\\d+)\\]"), 1)))
    return rows.select("question_id", used.alias("used"), F.array_except(used, "allowed").alias("invalid"), F.round(F.size(F.array_intersect(used, "allowed")) / F.greatest(F.size("allowed"), F.lit(1)), 4).alias("usage"))


def source_conflicts(docs: DataFrame, shown: Callable[[Column], Column] = lambda words: words) -> DataFrame:
    """Pairs of documents of different sources that share words but differ in numbers; first 12 shared words.

    ``docs`` (group_id, doc_id, source, words, text) compares within a group, one row a document. ``shown`` makes ``shared`` of those words.
    """
    d = docs.select("group_id", "doc_id", "source", "words", F.array_sort(numbers(F.col("text"))).alias("nums")).where(F.size("nums") > 0)
    pairs = sharing_pairs(d, "group_id", "doc_id", "words", (F.col("x.source") != F.col("y.source")) & (F.col("x.nums") != F.col("y.nums")), shown=lambda words: shown(F.slice(F.array_sort(words), 1, 12)))
    return pairs.select("group_id", F.col("a").alias("doc_a"), F.col("b").alias("doc_b"), "shared")


def requirement_coverage(requirements: DataFrame, docs: DataFrame) -> DataFrame:
    """Best share of a requirement's tokens found in one document of its question: covered, partial or missing."""
    r = requirements.select("question_id", "requirement_id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    d = docs.select("question_id", "doc_id", F.explode("tokens").alias("token"))
    hit = r.join(d, ["question_id", "token"]).groupBy("question_id", "requirement_id", "doc_id").agg(F.count("*").alias("k"))
    best = hit.groupBy("question_id", "requirement_id").agg(F.max("k").alias("k"))
    out = requirements.select("question_id", "requirement_id", F.size("tokens").alias("n")).join(best, ["question_id", "requirement_id"], "left")
    need = F.greatest(F.lit(1), F.least(F.lit(2), F.col("n")))
    return out.select("question_id", "requirement_id", F.when(F.coalesce("k", F.lit(0)) >= need, "covered").when(F.col("k") > 0, "partial").otherwise("missing").alias("status"))


def consistency(contract: DataFrame, slices: DataFrame, key: str = "question_id") -> DataFrame:
    """Ids that one side lacks; empty if the two agree."""
    a, b = contract.select(key).distinct(), slices.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("problem", F.lit("missing_slice")).unionByName(b.join(a, key, "left_anti").withColumn("problem", F.lit("extra_slice")))


def shadowed_terms(terms: DataFrame) -> DataFrame:
    """Terms of a case that hold another term of the same case."""
    return containing_terms(terms, "case_id", "term").withColumnRenamed("part", "shadowed_by")


def delivery(issues: DataFrame, docs: DataFrame) -> DataFrame:
    """Distinct issues a question by status and whether it can be delivered: documents and no issue."""
    n = issues.dropDuplicates(["question_id", "status", "claim_id"]).groupBy("question_id").agg(F.count("*").alias("issues"))
    return docs.join(n, "question_id", "left").select("question_id", F.coalesce("issues", F.lit(0)).alias("issues"), ((F.coalesce("issues", F.lit(0)) == 0) & (F.col("n_docs") > 0)).alias("deliverable"))
