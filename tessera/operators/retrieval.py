"""Many questions at once: field-weighted BM25, exact dense search, fusion, blending, caps and audit columns.

Questions are a small table. Lexical search reads postings (``postings``), dense search multiplies vectors where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import lexical_terms
from . import entities

#: Field weights of the term frequency (fixed values); a field that is absent here counts in length only.
FIELD_WEIGHTS = {"content": 1.0, "source": 3.0, "title": 3.0, "section_path": 3.0, "parent_document": 2.0}
RRF_K, DENSE_WEIGHT, LEXICAL_WEIGHT = 60, 0.55, 0.45
#: Rows of a question table's terms, or of another slim table, that may be sent to every task.
SMALL = 1_000_000
#: First characters of what is not a term: exact, stable and canonical identifiers.
EXACT, STABLE, CANONICAL = "\u0001", "\u0002", "\u0003"


def join_small(rows: DataFrame, small: DataFrame, on: Column | list[str], how: str = "inner", most: int = SMALL) -> DataFrame:
    """Join with a slim table: sent to every task once its rows are counted to be few, else dealt by key."""
    return rows.join(F.broadcast(small) if small.count() <= most else small, on, how)


def question_terms(questions: DataFrame) -> DataFrame:
    """(question_id, term, bonus): a question's terms, and its identifiers with what an occurrence adds."""
    exact, stable = entities.identifiers(F.col("question"))
    named = F.array_distinct(F.filter(F.transform(entities.query_entities(F.col("question")), entities.canonical_id), lambda x: x.isNotNull()))
    mark = lambda arr, m, worth: F.transform(F.filter(arr, lambda x: x != ""), lambda x: F.struct(F.concat(F.lit(m), x).alias("term"), F.lit(worth).alias("bonus")))
    plain = F.transform(lexical_terms(F.col("question")), lambda x: F.struct(x.alias("term"), F.lit(None).cast("double").alias("bonus")))
    # a question without terms asks nothing
    rows = questions.select("question_id", plain.alias("p"), F.concat(mark(exact, EXACT, entities.IDENTIFIER_BONUS), mark(stable, STABLE, entities.STABLE_BONUS), mark(named, CANONICAL, entities.CANONICAL_BONUS)).alias("m")).where(F.size("p") > 0)
    each = rows.select("question_id", F.explode(F.concat("p", "m")).alias("x")).select("question_id", "x.term", "x.bonus")
    return each.groupBy("question_id", "term").agg(F.sum("bonus").alias("bonus"))


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    return rows.withColumn(out, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(out) <= k)


#: Bytes of question vectors that are sent to every task at once.
QUERY_BYTES = 64 << 20
#: Scores that a task computes at once; what it holds beside its vectors follows from this, not from the number of questions.
SCORES = 2 << 20


def dense(vectors: DataFrame, queries: DataFrame, k: int, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(question_id, vec_id, relevance, rank): exact cosine of unit vectors, shifted to 0..1; a vector is not its own neighbour.

    Vectors are multiplied a batch at a time with a matrix of the questions, and a task keeps the k best a question before
    the shuffle. Questions are counted first: more than ``query_bytes`` of them take several passes. Null vectors meet nothing.
    """
    asked = queries.select(F.col("question_id").cast("long"), F.col("embedding").cast("array<double>").alias("q")).where("q IS NOT NULL")
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("d")).collect()[0]
    rounds = max(1, -(-(size.n * (size.d or 0) * 8) // query_bytes))
    stored = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where("embedding IS NOT NULL")
    hits = None
    for r in range(rounds):
        # about query_bytes, by the number of rounds
        part = asked.where(F.pmod(F.xxhash64("question_id"), F.lit(rounds)) == r).toArrow()
        got = _nearest(stored, part.column("question_id").to_numpy(), _matrix(part.column("q").combine_chunks(), size.d or 0), k)
        hits = got if hits is None else hits.unionAll(got)
    return top_k(hits, ["question_id"], [F.desc(F.round("relevance", 9)), F.col("vec_id")], k)


def _matrix(lists: pa.Array, d: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), d)


def _merge(best: list[np.ndarray] | None, own: np.ndarray, stored: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int) -> list[np.ndarray]:
    """[place of the question, vec_id, relevance] of the k best so far and those of one more block of vectors."""
    score = (stored @ matrix.T + 1) / 2
    score[own[:, None] == ids[None, :]] = -np.inf
    # all that reach the k-th best, ties included
    least = np.partition(score, len(own) - k, axis=0)[len(own) - k] if len(own) > k else np.full(len(ids), -np.inf)
    if best is not None:
        # nor can what stays below the k best so far
        full = np.bincount(best[0], minlength=len(ids)) >= k
        low = np.full(len(ids), np.inf)
        np.minimum.at(low, best[0], best[2])
        least = np.where(full, np.maximum(least, low), least)
    v, q = np.nonzero((score >= least - 1e-8) & (score > -np.inf))
    rows = [q, own[v], score[v, q]]
    if best is not None:
        rows = [np.concatenate(x) for x in zip(best, rows, strict=True)]
    order = np.lexsort((rows[1], -np.round(rows[2], 9), rows[0]))
    rows = [x[order] for x in rows]
    place = np.arange(len(order)) - np.searchsorted(rows[0], rows[0])
    return [x[place < k] for x in rows]


def _nearest(vectors: DataFrame, ids: np.ndarray, matrix: np.ndarray, k: int) -> DataFrame:
    sent = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = sent.value
        if not len(ids):
            return
        rows = min(1024, max(1, SCORES // k))
        step = max(1, SCORES // max(rows, k))
        best: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            own, stored = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1), matrix.shape[1])
            # a bounded block of vectors by a bounded block of questions
            for a in range(0, len(own), rows):
                for b in range(0, len(ids), step):
                    best[b] = _merge(best.get(b), own[a : a + rows], stored[a : a + rows], ids[b : b + step], matrix[b : b + step], k)
        for b, (q, v, score) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(ids[b + q], pa.int64()), pa.array(v, pa.int64()), pa.array(score, pa.float64())], ["question_id", "vec_id", "relevance"])

    return vectors.mapInArrow(run, "question_id long, vec_id long, relevance double")


def rrf(dense_hits: DataFrame, lexical_hits: DataFrame, key: list[str], dw: float = DENSE_WEIGHT, lw: float = LEXICAL_WEIGHT) -> DataFrame:
    """Full outer fusion of two ranked channels: rrf_score, union_rank and the stage label."""
    a = dense_hits.select(*key, F.col("rank").alias("dense_rank"))
    b = lexical_hits.select(*key, F.col("rank").alias("bm25_rank"))
    both = a.join(b, key, "full_outer")
    score = F.coalesce(dw / (RRF_K + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(lw / (RRF_K + F.col("bm25_rank")), F.lit(0.0))
    stage = F.when(F.col("dense_rank").isNotNull() & F.col("bm25_rank").isNotNull(), "dense_and_bm25").when(F.col("dense_rank").isNotNull(), "dense_only").otherwise("bm25_only")
    out = both.withColumn("rrf_score", score).withColumn("retrieval_stage", stage)
    order = W.partitionBy(key[0]).orderBy(F.desc(F.round("rrf_score", 12)), *key[1:])
    return out.withColumn("union_rank", F.row_number().over(order))


def fuse_fields(first: DataFrame, second: DataFrame, key: list[str], scalars: list[str] = [], arrays: list[str] = [], distinct: list[str] = [], maps: list[str] = [], flags: list[str] = []) -> DataFrame:
    """One row a candidate of two channels, both channels' columns merged.

    Scalars of the first channel are filled from the second where they are null or empty; arrays follow each other, ``distinct``
    ones without repeats; maps keep the least value of a key; flags hold if either does. A channel without a candidate adds nothing.
    """
    both = first.alias("a").join(second.alias("b"), key, "full_outer")
    of = lambda side, c: F.col(f"{side}.{c}")
    kinds = dict(first.dtypes)
    filled = lambda c: F.when(of("a", c).cast("string") != "", of("a", c))
    listed = lambda side, c: F.coalesce(of(side, c), F.array().cast(kinds[c]))
    mapped = lambda side, c: F.coalesce(of(side, c), F.create_map().cast(kinds[c]))
    return both.select(
        *key,
        *[F.coalesce(filled(c), of("b", c), of("a", c)).alias(c) for c in scalars],
        *[F.concat(listed("a", c), listed("b", c)).alias(c) for c in arrays],
        *[F.array_distinct(F.concat(listed("a", c), listed("b", c))).alias(c) for c in distinct],
        *[F.map_zip_with(mapped("a", c), mapped("b", c), lambda k, x, y: F.least(x, y)).alias(c) for c in maps],
        *[(F.coalesce(of("a", c), F.lit(False)) | F.coalesce(of("b", c), F.lit(False))).alias(c) for c in flags],
    )


def min_max(col: str, by: str) -> Column:
    """Normal form within a question: all equal gives 1, missing stays missing."""
    w = W.partitionBy(by)
    lo, hi = F.min(col).over(w), F.max(col).over(w)
    return F.when(F.col(col).isNull(), None).when(hi == lo, 1.0).otherwise((F.col(col) - lo) / (hi - lo))


MODES = ("reranker_only", "reranker_entity", "reranker_entity_rrf")
PENALTY, CEILING = 0.12, 0.001


def blend(candidates: DataFrame, mode: str = "reranker_entity_rrf") -> DataFrame:
    """base and combined: the mode's mix of semantic, explicit, weak and fused scores, then priors, penalty and ceiling.

    Needs question_id, rerank_score, explicit, weak, rrf_score, low_authority; ``prior``, if there is such a column, is added to the base.
    Without any rerank score the fused one stands in. The penalty holds only where a question has an authoritative candidate; no
    low-authority one may pass the best of those.
    """
    if mode not in MODES:
        raise ValueError(mode)
    fused = min_max("rrf_score", "question_id")
    c = candidates.withColumn("fused", F.coalesce(fused, F.lit(0.0))).withColumn("sem", F.coalesce(min_max("rerank_score", "question_id"), fused, F.lit(0.0)))
    base = {
        "reranker_only": F.col("sem"),
        "reranker_entity": 0.90 * F.col("sem") + 0.10 * F.col("explicit"),
        "reranker_entity_rrf": 0.82 * F.col("sem") + 0.10 * F.col("explicit") + 0.03 * F.col("weak") + 0.05 * F.col("fused"),
    }[mode]
    c = c.withColumn("base", base).withColumn("raised", base + (F.col("prior") if "prior" in c.columns else F.lit(0.0)))
    best = F.max(F.when(~F.col("low_authority"), F.col("raised"))).over(W.partitionBy("question_id"))
    c = c.withColumn("best", best)
    held = F.least(F.col("raised") - PENALTY, F.col("best") - CEILING)
    return c.withColumn("combined", F.when(F.col("low_authority") & F.col("best").isNotNull(), held).otherwise(F.col("raised"))).drop("best", "raised")


def diversify(ranked: DataFrame, cap: int, k: int, rank: str = "rank") -> DataFrame:
    """disposition: selected, source_cap_filtered or outside_final_top_k; one source alone is never capped."""
    w = W.partitionBy("question_id")
    nth = F.row_number().over(W.partitionBy("question_id", "source").orderBy(rank))
    out = ranked.withColumn("nth", nth).withColumn("sources", F.size(F.collect_set("source").over(w)))
    out = out.withColumn("passes", (F.col("nth") <= cap) | (F.col("sources") == 1))
    place = F.sum(F.col("passes").cast("int")).over(w.orderBy(rank))
    return out.withColumn("disposition", F.when(~F.col("passes"), "source_cap_filtered").when(place <= k, "selected").otherwise("outside_final_top_k")).drop("nth", "sources", "passes")


def thresholded(hits: DataFrame, least: float = 0.25, share: float = 0.55) -> DataFrame:
    """Rows that pass: no score, exact, relevant enough, fused score near the best, or lexical alone."""
    best = F.max("rrf_score").over(W.partitionBy("question_id"))
    keep = F.col("relevance").isNull() | F.col("exact") | (F.col("relevance") >= least) | (F.col("rrf_score") >= share * best) | (F.col("rrf_score").isNull() & (F.col("lexical") > 0))
    return hits.withColumn("passes", F.coalesce(keep, F.lit(False)))


def confidence(hits: DataFrame, score: str = "score") -> DataFrame:
    """low, uncertain, high or unknown from the two best scores of a question."""
    top = hits.groupBy("question_id").agg(F.slice(F.sort_array(F.collect_list(score), False), 1, 2).alias("t"))
    a, margin = F.get("t", F.lit(0)), F.get("t", F.lit(0)) - F.coalesce(F.get("t", F.lit(1)), F.lit(0.0))
    return top.select("question_id", F.when(a.isNull(), "unknown").when(a < 0.25, "low").when((a < 0.5) & (margin < 0.04), "uncertain").otherwise("high").alias("confidence"))


def merge_lanes(hits: DataFrame) -> DataFrame:
    """One row a candidate: best score with its lane, all lanes, every lane's hit in order of rank, exact if any lane is."""
    got = hits.groupBy("question_id", "doc_id").agg(F.max("score").alias("score"), F.max_by("lane", F.struct(F.col("score"), -F.col("rank"))).alias("best_lane"), F.sort_array(F.collect_set("lane")).alias("lanes"), F.sort_array(F.collect_list(F.struct("rank", "lane", "score"))).alias("hits"), F.min("rank").alias("best_rank"), F.bool_or("exact").alias("exact"))
    return got.withColumn("rank", F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("score"), "best_rank", "doc_id")))


def add_unseen(first: DataFrame, more: DataFrame, cap: int) -> DataFrame:
    """``first`` and those rows of ``more`` whose key and source it lacks, at most ``cap`` a source."""
    keys = first.select("question_id", "doc_id").distinct()
    sources = first.select("question_id", "source").distinct()
    new = more.join(keys, ["question_id", "doc_id"], "left_anti").join(sources, ["question_id", "source"], "left_anti")
    new = top_k(new, ["question_id", "source"], [F.col("rank"), F.col("doc_id")], cap, "nth").drop("nth")
    return first.withColumn("origin", F.lit("first")).unionByName(new.withColumn("origin", F.lit("sub")), allowMissingColumns=True)


def matches(kind: str, expected: Column, actual: Column) -> Column:
    """Named source matchers; they give different hits on purpose."""
    slashed = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "\\\\", "/"))
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    if kind == "basename":
        return name(slashed(expected)) == name(slashed(actual))
    if kind == "basename_or_contains":
        e, a = (F.regexp_replace(slashed(c), "\\s+", "") for c in (expected, actual))
        return (name(e) == name(a)) | F.contains(a, e)
    if kind == "bidirectional":
        e, a = (F.regexp_replace(slashed(c), "/+$", "") for c in (expected, actual))
        return (e != "") & (a != "") & (F.contains(a, e) | F.contains(e, a) | (name(e) == name(a)))
    if kind == "stripped":
        e, a = (F.regexp_replace(slashed(c), "[\\s_+\\-()\\[\\]{}（）【】]", "") for c in (expected, actual))
        return F.contains(a, e) | (name(e) == name(a)) | F.contains(a, name(e))
    if kind == "substring":
        return F.contains(actual, expected)
    raise ValueError(kind)
