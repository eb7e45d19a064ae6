"""Replays of recorded answers: metric views, rescoring, contracts, fixtures, snapshots, parameter grids, stand-in models, evaluators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window as W

from ..functions.text import lexical_terms

#: What a row of a contract must have (fixed values).
CONTRACT_FIELDS = ("expected_answer_spans", "required_terms", "expected_sources")
CONTENT_METRICS = ("metric", "recall")
VECTOR_SIZE = 16


def metric_view(rows: DataFrame, key: str, json: str) -> DataFrame:
    """(key, name, value): the numbers of a JSON document, of its ``summary`` where it has one; truth values and texts are left out."""
    v = F.parse_json(json)
    inner = F.expr(f"try_variant_get(parse_json({json}), '$.summary', 'map<string,variant>')")
    outer = F.expr(f"try_variant_get(parse_json({json}), '$', 'map<string,variant>')")
    each = rows.where(v.isNotNull()).select(key, F.explode(F.map_entries(F.coalesce(inner, outer))).alias("e"))
    kind = F.schema_of_variant(F.col("e.value"))
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return each.where(number).select(key, F.col("e.key").alias("name"), F.expr("variant_get(e.value, '$', 'double')").alias("value"))


def rescore(rows: DataFrame, arms: DataFrame, contracts: DataFrame, packs: DataFrame) -> DataFrame:
    """(row_id, hops, matched, hop_recall, reachable): recorded answers scored again under today's contracts.

    ``rows`` (row_id, case_set, question_id, arm, answer), ``arms`` (arm, max_items), ``contracts`` (case_set, question_id, hop_id, term, chunk_id),
    ``packs`` (question_id, rank, chunk_id). A row of an unregistered set or arm is left out.
    """
    known = rows.join(arms, "arm").join(contracts, ["case_set", "question_id"])
    have = packs.select("question_id", "chunk_id", "rank")
    seen = known.join(have, ["question_id", "chunk_id"], "left")
    hit = F.contains("answer", "term")
    return seen.groupBy("row_id").agg(F.count("*").alias("hops"), F.count_if(hit).alias("matched"), F.round(F.avg(hit.cast("int")), 3).alias("hop_recall"), F.count_if(F.col("rank") <= F.col("max_items")).alias("reachable"))


def build_contracts(hops: DataFrame) -> DataFrame:
    """(case_id, hops, case_type): a case's hops in order as one array, and the slice it falls into."""
    rows = hops.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("hop_id", "from_question", "term"))).alias("hops"))
    return rows.withColumn("case_type", F.when(F.size("hops") > 1, "multi_hop").otherwise("fact"))


def fixtures(rows: DataFrame, version: str, failures: tuple[str, ...]) -> DataFrame:
    """(question_id, status, row_id, synthetic): the first row of each question and status of one audit version, and made-up failures.

    A question that no recorded row fails with one of ``failures`` gets a row without id that does.
    """
    kept = rows.where(F.col("audit_version") == version)
    first = kept.groupBy("question_id", "status").agg(F.min("row_id").alias("row_id")).withColumn("synthetic", F.lit(False))
    need = kept.select("question_id").distinct().select("question_id", F.explode(F.array(*map(F.lit, failures))).alias("status"))
    made = need.join(first.select("question_id", "status"), ["question_id", "status"], "left_anti").select("question_id", "status", F.lit(None).cast("long").alias("row_id"), F.lit(True).alias("synthetic"))
    return first.unionByName(made)


def snapshot_id(config: Column, fingerprint: Column) -> Column:
    """Sixteen hex digits that name a configuration over an index."""
    return F.substring(F.sha2(F.concat_ws("\u001f", F.to_json(config), fingerprint), 256), 1, 16)


def thin_contracts(cases: DataFrame) -> DataFrame:
    """(case_id, missing): contracts that lack fields, which would pass every check by having nothing to check."""
    lacking = F.filter(F.array(*[F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, F.lit(c)) for c in CONTRACT_FIELDS]), lambda x: x.isNotNull())
    return cases.select("case_id", lacking.alias("missing")).where(F.size("missing") == len(CONTRACT_FIELDS))


def grid(runs: DataFrame, settings: list[str]) -> DataFrame:
    """(settings, runs): every combination of the values that recorded runs have of each setting, with how many runs had it.

    Values of a setting are few, and so are their combinations; those never run have 0.
    """
    values = runs.agg(*[F.collect_set(s).alias(s) for s in settings])
    for s in settings:
        values = values.withColumn(s, F.explode(s))
    return values.join(runs.groupBy(*settings).agg(F.count("*").alias("runs")), settings, "left").na.fill(0, ["runs"])


def attempt_fields(rows: DataFrame) -> DataFrame:
    """attempts_made, retried and metrics of rows with an attempts array: content metrics are null unless the row completed."""
    bad = F.size(F.filter("attempts", lambda a: a["status"] != "completed"))
    out = rows.withColumns({"attempts_made": F.size("attempts"), "failed_attempts": bad, "retried": (F.col("status") == "completed") & (bad > 0)})
    return out.withColumns({m: F.when(F.col("status") == "completed", F.col(m)) for m in CONTENT_METRICS if m in rows.columns})


@F.pandas_udf(ArrayType(FloatType()))
def hashed_embedding(texts: pd.Series) -> pd.Series:
    """A deterministic stand-in for a model: unit vectors of hashed words; a real one is called the same way, in batches."""
    import zlib

    import numpy as np

    def one(text: str | None) -> list[float]:
        v = np.zeros(VECTOR_SIZE)
        for word in (text or "").lower().split():
            h = zlib.crc32(word.encode())
            v[h % VECTOR_SIZE] += 1 if h & 1 << 16 else -1
        n = np.sqrt((v * v).sum())
        return (v / n if n else v).tolist()

    return texts.map(one)


def overlap_score(question: Column, passage: Column) -> Column:
    """A deterministic stand-in for a cross encoder: the share of a question's terms that a passage has, to six places."""
    asked, told = lexical_terms(question), lexical_terms(passage)
    return F.round(F.size(F.array_intersect(asked, told)) / F.greatest(F.lit(1), F.size(asked)), 6)


def reranked(candidates: DataFrame, question: str = "question", text: str = "text") -> DataFrame:
    """``candidates`` with rerank_score and model_rank a question."""
    rows = candidates.withColumn("rerank_score", overlap_score(F.col(question), F.coalesce(F.col(text), F.lit(""))))
    return rows.withColumn("model_rank", F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("rerank_score"), "doc_id")))


#: Deterministic evaluators: a score in 0 to 1 of a run's and an example's columns.
EVALUATORS = {
    "source_hit": lambda: F.when(F.size("expected") == 0, (F.size("sources") == 0).cast("double")).otherwise(F.size(F.array_intersect("expected", "sources")) / F.size("expected")),
    "refusal": lambda: F.when(F.col("must_refuse"), (~F.col("deliverable")).cast("double")).otherwise(1.0),
    "contract": lambda: (F.col("deliverable").isNotNull() & F.col("issues").isNotNull()).cast("double"),
    "diagnosis": lambda: (F.col("deliverable") | (F.size("issues") > 0)).cast("double"),
}


def evaluate(rows: DataFrame, key: str, names: tuple[str, ...] = tuple(EVALUATORS)) -> DataFrame:
    """(key, name, score) of the named evaluators."""
    scores = F.array(*[F.struct(F.lit(n).alias("name"), EVALUATORS[n]().alias("score")) for n in names])
    return rows.select(key, F.explode(scores).alias("s")).select(key, "s.name", "s.score")


def slice_denominators(rows: DataFrame, dims: list[str]) -> DataFrame:
    """(dimension, group, observations, questions, citations): what stands under a report's means, by slice and in all (null)."""
    sets = [[F.col(d)] for d in dims] + [[]]
    got = rows.groupingSets(sets, *dims).agg(F.count("*").alias("observations"), F.countDistinct("question_id").alias("questions"), F.coalesce(F.sum(F.col("cited").cast("int")), F.lit(0)).alias("citations"), *[F.grouping(d).alias(f"g_{d}") for d in dims])
    kind, group = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d in dims:
        kind, group = F.when(F.col(f"g_{d}") == 0, F.lit(d)).otherwise(kind), F.when(F.col(f"g_{d}") == 0, F.col(d)).otherwise(group)
    return got.select(kind.alias("dimension"), group.alias("group"), "observations", "questions", "citations")


def cache_key(question: Column, collection: Column, count: Column, k: Column, strategy: Column) -> Column:
    """What decides whether a retrieval is the same: the question without white space runs and case, and where and how it was asked."""
    return F.concat_ws("|", F.regexp_replace(F.trim(F.lower(question)), "\\s+", " "), collection, count, k, strategy)


def started_at(ended: Column, seconds: Column) -> Column:
    """When a call began, by its end and duration."""
    return ended - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
