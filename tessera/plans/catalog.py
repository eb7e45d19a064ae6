"""Registered queries over the test tables, with SQL that states the same results."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import stats, text
from ..operators import chunking, corpus, entities, evaluation, postings, retrieval, rules, sections
from ..sources import shared, tablelog
from ..streaming import budget

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Recorded rows of repeated runs, read out of the events table; the text is both Spark SQL and DuckDB SQL.
_OBS_COLUMNS = [
    "event_id AS seq",
    "user_id % 24 AS question_id",
    "CASE WHEN user_id % 5 < 2 THEN 's1' ELSE 's2' END AS case_set",
    "event_id % 3 AS round",
    "CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS arm",
    "CASE event_id % 10 WHEN 0 THEN 'provider_timeout' WHEN 1 THEN 'provider_error' ELSE 'completed' END AS status",
    "value AS latency",
    "CASE WHEN event_id % 10 > 1 THEN (event_id * 37 % 11) / 10e0 END AS metric",
    "CASE WHEN event_id % 10 > 1 THEN (event_id * 53 % 7) / 8e0 END AS recall",
    "CASE WHEN event_id % 10 > 1 THEN user_id % 24 % 4 = 0 OR (event_id * 31 % 100) > 4 END AS verdict",
    "CASE user_id % 24 % 3 WHEN 0 THEN 'fact' WHEN 1 THEN 'refusal' ELSE 'multi_hop' END AS case_type",
    "CASE user_id % 24 % 2 WHEN 0 THEN 'low' ELSE 'high' END AS risk_level",
]
OBS = f"obs AS (SELECT {', '.join(_OBS_COLUMNS)} FROM events)"


def _obs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").selectExpr(*_OBS_COLUMNS)


_TERMS = "list_distinct(list_transform(list_filter(regexp_extract_all({0}, '[A-Za-z0-9][A-Za-z0-9._/-]*'), lambda t: length(t) > 1), lambda t: lower(t)))"
_EDGE = "($|[^a-z0-9])"


def _sql_named(x: str) -> str:
    """The stable ids of the entities that a question names."""
    known = {"gb/t 26158-2010": "gb_26158_2010", "gb 4806.7-2023": "gb_4806_7_2023", "gb/t 10000-2023": "gb_10000_2023", "gb/t 16252-2023": "gb_16252_2023", "gb/t 3326-2016": "gb_3326_2016", "pp 3486-01": "pp_3486_01"}
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower({x}), '(^|[^a-z0-9])(?:{p}){_EDGE}') THEN '{known[n]}' END" for n, p in entities.ENTITIES if n in known) + "], lambda x: x IS NOT NULL)"


def _sql_canonical(x: str) -> str:
    """The stable ids that a text names, sorted."""
    parts = [f"list_transform(list_zip(regexp_extract_all({x}, '{p}', 1), regexp_extract_all({x}, '{p}', 2)), lambda z: CASE WHEN z[1] = '4806' THEN 'gb_4806_7_' || coalesce(nullif(z[2], ''), '2023') ELSE 'gb_' || z[1] || '_' || z[2] END)" for p in entities.NUMBERED]
    parts.append("list_filter([" + ", ".join(f"CASE WHEN regexp_matches({x}, '{p}') THEN '{n}' END" for n, p in entities.GRADED) + "], lambda x: x IS NOT NULL)")
    return f"list_sort(list_distinct(list_concat({', '.join(parts)})))"


_POST = rf"""
tm AS (SELECT doc_id, {_TERMS.format("coalesce(text, '')")} AS a, {_TERMS.format("coalesce(source, '')")} AS b, lower(coalesce(source, '')) AS meta, lower(coalesce(text, '')) AS body FROM documents),
ln AS (SELECT doc_id, a, b, len(a) + len(b) AS len, regexp_replace(meta, '\s+', '', 'g') AS ca, regexp_replace(body, '\s+', '', 'g') AS cb, concat(meta, ' ', body) AS whole FROM tm),
pt AS (SELECT doc_id, term, sum(w) AS tf FROM (SELECT doc_id, unnest(a) AS term, 1.0 AS w FROM ln UNION ALL SELECT doc_id, unnest(b), 3.0 FROM ln) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM pt GROUP BY term),
q AS (SELECT item_id AS question_id, unnest({_TERMS.format("text")}) AS term FROM benchmark),
qi AS (SELECT question_id, kind, x, count(*) AS times FROM (
  SELECT item_id AS question_id, 'e' AS kind, regexp_replace(unnest(regexp_extract_all(lower(text), '{entities.IDENTIFIER}')), '\s+', '', 'g') AS x FROM benchmark
  UNION ALL SELECT item_id, 's', regexp_replace(unnest(regexp_extract_all(concat(' ', replace(lower(text), ' ', '  '), ' '), '[^a-z0-9]({entities.STABLE})[^a-z0-9]', 1)), '[^a-z0-9]', '', 'g') FROM benchmark
  UNION ALL SELECT item_id, 'c', unnest(list_distinct({_sql_named("text")})) FROM benchmark) WHERE question_id IN (SELECT question_id FROM q) GROUP BY ALL),
xs AS (SELECT DISTINCT kind, x FROM qi),
xh AS (SELECT kind, x, doc_id FROM xs, ln WHERE CASE kind WHEN 'e' THEN contains(ca, x) OR contains(cb, x) WHEN 's' THEN contains(regexp_replace(whole, '[^a-z0-9]', '', 'g'), x) ELSE list_contains({_sql_canonical("whole")}, x) END),
bm AS (SELECT question_id, doc_id, sum(part) AS score FROM (
  SELECT question_id, doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.5 * tf / (tf + 1.5 * (0.25 + 0.75 * len / greatest(al, 1))) AS part
  FROM q JOIN df USING (term) JOIN pt USING (term) JOIN ln USING (doc_id), (SELECT avg(len) AS al, count(*) AS n FROM ln)
  UNION ALL SELECT question_id, doc_id, times * CASE kind WHEN 'e' THEN 2.0 ELSE 6.0 END FROM qi JOIN xh USING (kind, x)) GROUP BY ALL),
lex AS (SELECT question_id, doc_id, score, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm QUALIFY rank <= @K@)"""


def _post(k: int) -> str:
    return _POST.replace("@K@", str(k))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.col("text").alias("content"), "source")


#: Documents that one shard of an index should have, about.
SHARD_DOCUMENTS = 20_000


def _shards(spark: SparkSession, d: str) -> int:
    return max(8, -(-_t(spark, d, "documents").count() // SHARD_DOCUMENTS))


def _index(spark: SparkSession, d: str) -> postings.Index:
    """The index of the documents: built at first use, kept in the shared folder under the state of the table's files."""
    path = f"{d}/documents.parquet"
    shards = _shards(spark, d)
    name = f"tessera-index-{postings.FORMAT}-{shards}-{shared.fingerprint(spark, path)[:24]}"
    index = postings.Index(spark, f"{shared.shared_dir(spark)}/{name}", postings.Layout(("content", "source"), shards))
    if index.table.version() is None:
        try:
            index.build(_documents(spark, d))
        except tablelog.Conflict:
            pass  # another session has built it
    return index


def _lexical(spark: SparkSession, d: str, k: int) -> DataFrame:
    questions = _t(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return _index(spark, d).search(questions, k, _documents(spark, d))


@register(f"WITH {_post(20)} SELECT question_id, doc_id, round(score, 6) AS score, rank FROM lex")
def retrieval_bm25(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: all benchmark questions against the persisted postings of all documents, field-weighted BM25 and identifiers."""
    return _lexical(spark, d, 20).select("question_id", "doc_id", F.round("score", 6).alias("score"), "rank")


FLAGSHIP = retrieval_bm25

_DENSE = """dn AS (SELECT q.vec_id AS question_id, v.vec_id, (list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) + 1) / 2 AS relevance,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round((list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) + 1) / 2, 9) DESC, v.vec_id) AS rank
  FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0 QUALIFY rank <= 10)"""


def _dense(spark: SparkSession, d: str) -> DataFrame:
    v = _t(spark, d, "embeddings")
    return retrieval.dense(v, v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "question_id"), 10)


@register(f"WITH {_DENSE} SELECT question_id, vec_id, round(relevance, 6) AS relevance, rank FROM dn")
def retrieval_dense(spark: SparkSession, d: str) -> DataFrame:
    """Exact cosine search of every fiftieth vector."""
    return _dense(spark, d).select("question_id", "vec_id", F.round("relevance", 6).alias("relevance"), "rank")


# a dense channel over the same keys: documents have the vectors of their ids, questions those of theirs
_CHANNELS = f"""{_post(30)},
sec AS (SELECT item_id AS question_id, v.vec_id AS doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round((list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) + 1) / 2, 9) DESC, v.vec_id) AS rank
  FROM benchmark JOIN embeddings q ON q.vec_id = item_id JOIN embeddings v ON v.vec_id <> q.vec_id WHERE v.vec_id IN (SELECT doc_id FROM documents) QUALIFY rank <= 30),
fu AS (SELECT question_id, doc_id, sec.rank AS dense_rank, lex.rank AS bm25_rank, coalesce(0.55 / (60 + sec.rank), 0) + coalesce(0.45 / (60 + lex.rank), 0) AS rrf_score,
  CASE WHEN sec.rank IS NOT NULL AND lex.rank IS NOT NULL THEN 'dense_and_bm25' WHEN sec.rank IS NOT NULL THEN 'dense_only' ELSE 'bm25_only' END AS retrieval_stage
  FROM sec FULL JOIN lex USING (question_id, doc_id)),
un AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(rrf_score, 12) DESC, doc_id) AS union_rank FROM fu)"""


def _dense_documents(spark: SparkSession, d: str, k: int) -> DataFrame:
    v = _t(spark, d, "embeddings")
    asked = v.join(_t(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    stored = v.join(_t(spark, d, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    return retrieval.dense(stored, asked.withColumnRenamed("vec_id", "question_id"), k).withColumnRenamed("vec_id", "doc_id")


def _union(spark: SparkSession, d: str) -> DataFrame:
    # ranked lists of a few rows a question, written so that what reads the union more than once searches once
    return shared.written(retrieval.rrf(_dense_documents(spark, d, 30), _lexical(spark, d, 30), ["question_id", "doc_id"]), "union")


@register(f"WITH {_CHANNELS} SELECT question_id, doc_id, dense_rank, bm25_rank, round(rrf_score, 9) AS rrf_score, retrieval_stage, union_rank FROM un")
def retrieval_rrf_union(spark: SparkSession, d: str) -> DataFrame:
    """Full outer fusion of two channels with stage labels and union ranks."""
    return _union(spark, d).withColumn("rrf_score", F.round("rrf_score", 9))


_FIELDS = """(SELECT sec.*, CASE WHEN doc_id % 4 = 0 THEN '' ELSE source END AS title, ['d' || rank] AS hits, [source] AS exact, map([source, 'e' || doc_id % 3], [rank, rank + 5]) AS ranks, doc_id % 11 = 0 AS is_exact FROM sec JOIN documents USING (doc_id))"""


@register(f"""WITH {_CHANNELS}, a AS {_FIELDS}, b AS {_FIELDS.replace("sec", "lex").replace("'d'", "'b'").replace("% 11", "% 7").replace("'' ELSE source", "source ELSE lang")},
j AS (SELECT coalesce(a.question_id, b.question_id) AS question_id, coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(nullif(a.title, ''), b.title, a.title) AS title, list_concat(coalesce(a.hits, []), coalesce(b.hits, [])) AS hits,
  list_distinct(list_concat(coalesce(a.exact, []), coalesce(b.exact, []))) AS exact, a.ranks AS ar, b.ranks AS br, coalesce(a.is_exact, false) OR coalesce(b.is_exact, false) AS is_exact FROM a FULL JOIN b ON a.question_id = b.question_id AND a.doc_id = b.doc_id)
SELECT question_id, doc_id, title, array_to_string(hits, ',') AS hits, array_to_string(exact, ',') AS exact, array_to_string(list_sort(list_transform(list_distinct(list_concat(coalesce(map_keys(ar), []), coalesce(map_keys(br), []))), lambda k: k || '=' || least(ar[k], br[k]))), ',') AS ranks, is_exact FROM j""")
def retrieval_rrf_fields(spark: SparkSession, d: str) -> DataFrame:
    """Columns of both channels on fusion: filled scalars, concatenated arrays, maps by least rank, flags."""
    docs = _t(spark, d, "documents").select("doc_id", "source", "lang")

    def channel(rows: DataFrame, mark: str, title: str, exact: int) -> DataFrame:
        ranks = F.create_map("source", "rank", F.concat(F.lit("e"), F.col("doc_id") % 3), F.col("rank") + 5)
        return rows.select("question_id", "doc_id", "rank").join(docs, "doc_id").select("question_id", "doc_id", F.expr(title).alias("title"), F.array(F.concat(F.lit(mark), "rank")).alias("hits"), F.array("source").alias("exact"), ranks.alias("ranks"), (F.col("doc_id") % exact == 0).alias("is_exact"))

    a = channel(_dense_documents(spark, d, 30), "d", "CASE WHEN doc_id % 4 = 0 THEN '' ELSE source END", 11)
    b = channel(_lexical(spark, d, 30), "b", "CASE WHEN doc_id % 4 = 0 THEN source ELSE lang END", 7)
    got = retrieval.fuse_fields(a, b, ["question_id", "doc_id"], ["title"], ["hits"], ["exact"], ["ranks"], ["is_exact"])
    listed = F.array_sort(F.transform(F.map_entries("ranks"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return got.select("question_id", "doc_id", "title", F.array_join("hits", ",").alias("hits"), F.array_join("exact", ",").alias("exact"), F.array_join(listed, ",").alias("ranks"), "is_exact")


_BLEND = f"""{_CHANNELS},
cand AS (SELECT un.*, source, (doc_id * 13 % 97) / 97e0 AS rerank_score, CAST(doc_id % 5 = 0 AS INT) AS explicit, CAST(doc_id % 7 = 0 AS INT) AS weak, source IN ('src0', 'src1') AS low FROM un JOIN documents USING (doc_id)),
nm AS (SELECT *, CASE WHEN max(rerank_score) OVER w = min(rerank_score) OVER w THEN 1 ELSE (rerank_score - min(rerank_score) OVER w) / (max(rerank_score) OVER w - min(rerank_score) OVER w) END AS sem,
  CASE WHEN max(rrf_score) OVER w = min(rrf_score) OVER w THEN 1 ELSE (rrf_score - min(rrf_score) OVER w) / (max(rrf_score) OVER w - min(rrf_score) OVER w) END AS fused FROM cand WINDOW w AS (PARTITION BY question_id)),
ba AS (SELECT *, 0.82 * sem + 0.10 * explicit + 0.03 * weak + 0.05 * fused AS base FROM nm),
co AS (SELECT *, CASE WHEN low AND max(CASE WHEN NOT low THEN base END) OVER (PARTITION BY question_id) IS NOT NULL THEN least(base - 0.12, max(CASE WHEN NOT low THEN base END) OVER (PARTITION BY question_id) - 0.001) ELSE base END AS combined FROM ba),
rk AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(combined, 9) DESC, rerank_score DESC, doc_id) AS rank FROM co),
nt AS (SELECT *, row_number() OVER (PARTITION BY question_id, source ORDER BY rank) AS nth, count(DISTINCT source) OVER (PARTITION BY question_id) AS ns FROM rk),
dp AS (SELECT *, CASE WHEN nth > 2 AND ns > 1 THEN 'source_cap_filtered' WHEN sum(CASE WHEN nth <= 2 OR ns = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY question_id ORDER BY rank) <= 10 THEN 'selected' ELSE 'outside_final_top_k' END AS disposition FROM nt)"""


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select("doc_id", "source")
    cand = _union(spark, d).join(docs, "doc_id").selectExpr("*", "(doc_id * 13 % 97) / 97e0 AS rerank_score", "CAST(doc_id % 5 = 0 AS INT) AS explicit", "CAST(doc_id % 7 = 0 AS INT) AS weak", "source IN ('src0', 'src1') AS low_authority")
    mixed = retrieval.blend(cand)
    order = W.partitionBy("question_id").orderBy(F.desc(F.round("combined", 9)), F.desc("rerank_score"), "doc_id")
    return retrieval.diversify(mixed.withColumn("rank", F.row_number().over(order)), 2, 10)


@register(f"WITH {_BLEND} SELECT question_id, doc_id, source, round(combined, 6) AS combined, rank, disposition FROM dp")
def retrieval_blend_audit(spark: SparkSession, d: str) -> DataFrame:
    """Min-max blend, authority penalty and ceiling, source cap, top k, with each candidate's fate."""
    return _ranked(spark, d).select("question_id", "doc_id", "source", F.round("combined", 6).alias("combined"), "rank", "disposition")


@register(f"""WITH {_DENSE}, s AS (SELECT question_id, relevance, rank FROM dn),
t AS (SELECT question_id, max(CASE WHEN rank = 1 THEN relevance END) AS a, max(CASE WHEN rank = 2 THEN relevance END) AS b FROM s GROUP BY 1)
SELECT question_id, CASE WHEN a IS NULL THEN 'unknown' WHEN a < 0.25 THEN 'low' WHEN a < 0.5 AND a - coalesce(b, 0) < 0.04 THEN 'uncertain' ELSE 'high' END AS confidence FROM t""")
def retrieval_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Confidence from the two best scores."""
    return retrieval.confidence(_dense(spark, d), "relevance")


_HITS = "SELECT event_id % 40 AS question_id, user_id AS doc_id, event_type AS lane, max((event_id * 17 % 1000) / 1000e0) AS score, CAST(min(event_id % 50) AS INT) AS rank, bool_or(event_id % 9 = 0) AS exact FROM {0} GROUP BY event_id % 40, user_id, event_type"


@register(f"""WITH h AS ({_HITS.format("events")}), g AS (SELECT question_id, doc_id, max(score) AS score, array_sort(list(DISTINCT lane)) AS lanes, array_to_string(list_transform(list_sort(list({{'rank': rank, 'lane': lane, 'score': score}})), lambda x: x.lane || ':' || x.rank), ',') AS hits, min(rank) AS best_rank, bool_or(exact) AS exact FROM h GROUP BY ALL)
SELECT question_id, doc_id, round(score, 6) AS score, array_to_string(lanes, ',') AS lanes, hits, exact, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, best_rank, doc_id) AS rank FROM g""")
def retrieval_merge_lanes(spark: SparkSession, d: str) -> DataFrame:
    """Several query lanes merged on the candidate."""
    _t(spark, d, "events").createOrReplaceTempView("__events")
    got = retrieval.merge_lanes(spark.sql(_HITS.format("__events")))
    return got.select("question_id", "doc_id", F.round("score", 6).alias("score"), F.array_join("lanes", ",").alias("lanes"), F.array_join(F.transform("hits", lambda x: F.concat_ws(":", x["lane"], x["rank"])), ",").alias("hits"), "exact", "rank")


_SIDES = "SELECT {2} AS question_id, l_partkey % 200 AS doc_id, concat('s', {3} % 9) AS source, CAST(min(l_linenumber) AS INT) AS rank FROM {0} WHERE l_orderkey % 2 = {1} GROUP BY ALL"


@register(f"""WITH a AS ({_SIDES.format("lineitem", 0, "l_orderkey % 30", "(l_orderkey % 30 + l_suppkey % 3)")}), b AS ({_SIDES.format("lineitem", 1, "l_orderkey % 90", "l_suppkey")}),
af AS (SELECT * FROM a), nb AS (SELECT *, row_number() OVER (PARTITION BY question_id, source ORDER BY rank, doc_id) AS nth FROM b
 WHERE NOT EXISTS (SELECT 1 FROM af WHERE af.question_id = b.question_id AND (af.doc_id = b.doc_id OR af.source = b.source)) QUALIFY nth <= 2)
SELECT question_id, doc_id, source, rank, 'first' AS origin FROM af UNION ALL SELECT question_id, doc_id, source, rank, 'sub' FROM nb""")
def retrieval_add_unseen(spark: SparkSession, d: str) -> DataFrame:
    """Sub-query documents of unseen sources, capped a source."""
    _t(spark, d, "lineitem").createOrReplaceTempView("__lineitem")
    a = spark.sql(_SIDES.format("__lineitem", 0, "l_orderkey % 30", "(l_orderkey % 30 + l_suppkey % 3)"))
    return retrieval.add_unseen(a, spark.sql(_SIDES.format("__lineitem", 1, "l_orderkey % 90", "l_suppkey")), 2)


_EXP = "SELECT item_id AS question_id, concat('src', item_id % 20) AS source FROM benchmark UNION SELECT item_id, concat('src', (item_id * 7 + 3) % 20) FROM benchmark"


def _expected(spark: SparkSession, d: str) -> DataFrame:
    b = _t(spark, d, "benchmark")
    return b.selectExpr("item_id AS question_id", "concat('src', item_id % 20) AS source").union(b.selectExpr("item_id", "concat('src', (item_id * 7 + 3) % 20)")).distinct()


def _by_source(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d, 30).join(_t(spark, d, "documents").select("doc_id", "source"), "doc_id")


_IR = ", ".join(f"coalesce(sum(hit::INT) FILTER (rank <= {c}), 0) AS h{c}, count(*) FILTER (rank <= {c}) AS r{c}" for c in (5, 10))


@register(f"""WITH {_post(30)}, e AS ({_EXP}), n AS (SELECT question_id, count(*) AS n FROM e GROUP BY 1),
r AS (SELECT lex.question_id, rank, e.source IS NOT NULL AS hit FROM lex JOIN documents d USING (doc_id) LEFT JOIN e ON e.question_id = lex.question_id AND e.source = d.source),
g AS (SELECT question_id, {_IR}, min(CASE WHEN hit THEN rank END) AS m, sum(hit::INT / log2(rank + 1)) FILTER (rank <= 10) AS dcg FROM r GROUP BY 1)
SELECT question_id, {", ".join(f"round(coalesce(h{c} / r{c}, 0), 4) AS precision_at_{c}, round(coalesce(h{c} / n, 0), 4) AS recall_at_{c}" for c in (5, 10))}, round(coalesce(1 / m, 0), 4) AS mrr,
 round(coalesce(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 0), 4) AS ndcg_at_10 FROM n LEFT JOIN g USING (question_id)""")
def eval_ir_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall at cuts, reciprocal rank and nDCG of the lexical channel."""
    return evaluation.ir_metrics(_by_source(spark, d), _expected(spark, d))


_SRC = f"""{_post(30)}, sr AS (SELECT question_id, source, min(rank) AS first_rank, count(*) AS chunk_count FROM lex JOIN documents USING (doc_id) GROUP BY ALL)"""


@register(f"WITH {_SRC} SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY first_rank, source) AS source_rank FROM sr")
def eval_source_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Sources by their first hit."""
    return evaluation.source_ranking(_by_source(spark, d))


@register(f"""WITH {_SRC}, e AS ({_EXP}), j AS (SELECT e.question_id, first_rank FROM e LEFT JOIN sr USING (question_id, source)),
g AS (SELECT question_id, count(*) AS n, {", ".join(f"count(*) FILTER (first_rank <= {c}) AS n{c}, bool_and(coalesce(first_rank <= {c}, false)) AS a{c}" for c in (5, 10, 20, 30))} FROM j GROUP BY 1)
SELECT {", ".join(f"round(sum(n{c}) / sum(n), 4) AS recall_at_{c}, round(avg(a{c}::INT), 4) AS all_present_at_{c}" for c in (5, 10, 20, 30))} FROM g""")
def eval_recall_curve(spark: SparkSession, d: str) -> DataFrame:
    """Source recall and all-present rates at cuts."""
    return evaluation.recall_curve(_expected(spark, d), evaluation.source_ranking(_by_source(spark, d)))


def _nearest(p: float) -> str:
    return f"list_sort(list(latency) FILTER (latency IS NOT NULL))[CAST(round_even({p} * (count(latency) - 1), 0) AS INT) + 1]"


@register(f"""WITH {OBS} SELECT arm, round, count(*) AS n, {", ".join(f"round(avg((status = '{s}')::INT), 4) AS {s}_rate" for s in ("completed", "provider_timeout", "provider_error"))},
round({_nearest(0.5)}, 3) AS latency_p50, round({_nearest(0.95)}, 3) AS latency_p95, round(max(latency), 3) AS latency_max, round(avg(metric), 3) AS metric_mean, count(metric) AS metric_n FROM obs GROUP BY arm, round""")
def eval_run_summary(spark: SparkSession, d: str) -> DataFrame:
    """Run aggregates with explicit denominators and nearest-rank percentiles."""
    return evaluation.run_summary(_obs(spark, d), ["arm", "round"])


@register(f"""WITH {OBS}, fl AS (SELECT question_id FROM obs GROUP BY 1 HAVING count(*) FILTER (verdict) * count(*) FILTER (NOT verdict) > 0),
u AS (SELECT question_id, case_type, risk_level, 'metric' AS metric, metric AS value FROM obs UNION ALL SELECT question_id, case_type, risk_level, 'recall', recall FROM obs),
l AS (SELECT 'case_type' AS dimension, case_type AS "group", * FROM u UNION ALL SELECT 'risk_level', risk_level, * FROM u)
SELECT dimension, "group", metric, round(avg(value), 3) AS mean, round(avg(value) FILTER (question_id NOT IN (FROM fl)), 3) AS mean_excluding_flaky, count(value) AS sample_size,
  count(DISTINCT CASE WHEN value IS NOT NULL AND question_id NOT IN (FROM fl) THEN question_id END) AS question_count FROM l GROUP BY ALL""")
def eval_slice_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Two dimensions by metric as grouping sets, with and without flaky questions."""
    obs = _obs(spark, d)
    return evaluation.slice_metrics(obs, ["case_type", "risk_level"], ["metric", "recall"], evaluation.flaky(obs, "verdict").where("flaky"))


@register(f"""WITH {OBS}, g AS (SELECT question_id, count(*) FILTER (verdict) AS t, count(*) FILTER (NOT verdict) AS f FROM obs GROUP BY 1)
SELECT question_id, t * f AS flips, (t + f) * (t + f - 1) // 2 AS pairs, round(t * f / ((t + f) * (t + f - 1) / 2), 4) AS share, t * f > 0 AS flaky FROM g WHERE t + f >= 2""")
def eval_flaky(spark: SparkSession, d: str) -> DataFrame:
    """Disagreeing verdict pairs a question."""
    return evaluation.flaky(_obs(spark, d), "verdict")


_RUNS = """ru AS (SELECT round, 'metric' AS metric, avg(metric) AS value FROM obs GROUP BY 1 UNION ALL SELECT round, 'recall', avg(recall) FROM obs GROUP BY 1 UNION ALL SELECT round, 'latency', avg(latency) FROM obs GROUP BY 1)"""


@register(f"WITH {OBS}, {_RUNS} SELECT metric, count(value) AS n, round(max(value) - min(value), 6) AS spread, count(value) >= 2 AND round(max(value) - min(value), 6) > 0.1 AS unstable FROM ru GROUP BY metric")
def eval_comparability(spark: SparkSession, d: str) -> DataFrame:
    """Spread of a metric over runs."""
    runs = _obs(spark, d).groupBy("round").agg(F.avg("metric").alias("metric"), F.avg("recall").alias("recall"), F.avg("latency").alias("latency"))
    return evaluation.comparability(runs.unpivot("round", ["metric", "recall", "latency"], "metric", "value"))


_GATES = [("quality", "metric", 0.02, "higher_is_better", True), ("quality", "recall", 0.0001, "higher_is_better", True), ("speed", "latency", 5.0, "lower_is_better", False), ("calls", "retrieval_calls", 0.0, "lower_is_better", True), ("empty", "nothing", 0.0, "higher_is_better", True)]


@register(f"""WITH {OBS}, a AS (SELECT arm, avg(metric) AS metric, avg(recall) AS recall, avg(latency) AS latency FROM obs GROUP BY 1), x AS (SELECT * FROM a WHERE arm = 'a'), y AS (SELECT * FROM a WHERE arm = 'b'),
dl AS (SELECT 'metric' AS metric, round(y.metric - x.metric, 4) AS delta FROM x, y UNION ALL SELECT 'recall', round(y.recall - x.recall, 4) FROM x, y UNION ALL SELECT 'latency', round(y.latency - x.latency, 4) FROM x, y UNION ALL SELECT 'nothing', NULL),
gr(group_name, metric, allowed, direction, declared) AS (VALUES {", ".join(f"('{g}', '{m}', {a}, '{r}', {c})" for g, m, a, r, c in _GATES)}),
s AS (SELECT *, metric IN (SELECT metric FROM dl) AS here, declared OR delta = 0 AS scope, CASE WHEN direction = 'lower_is_better' THEN delta <= allowed WHEN declared THEN abs(delta) <= allowed ELSE delta = 0 END AS within FROM gr LEFT JOIN dl USING (metric)),
v AS (SELECT *, CASE WHEN NOT here THEN 'not_evaluated' WHEN delta IS NULL THEN 'no_baseline' WHEN scope AND within THEN 'ok' ELSE 'breach' END AS verdict FROM s)
SELECT group_name, metric, delta, verdict, CASE WHEN verdict = 'breach' THEN CASE WHEN NOT scope THEN 'out_of_scope' ELSE 'beyond_tolerance' END END AS reason, bool_and(verdict <> 'breach') OVER (PARTITION BY group_name) AS group_passed FROM v""")
def eval_gates(spark: SparkSession, d: str) -> DataFrame:
    """Deltas between arms against declared bands; what has no delta is said to be not evaluated."""
    m = _obs(spark, d).groupBy("arm").agg(F.avg("metric").alias("metric"), F.avg("recall").alias("recall"), F.avg("latency").alias("latency")).unpivot("arm", ["metric", "recall", "latency"], "name", "value")
    deltas = m.groupBy(F.col("name").alias("metric")).agg(F.round(F.max(F.when(F.col("arm") == "b", F.col("value"))) - F.max(F.when(F.col("arm") == "a", F.col("value"))), 4).alias("delta"))
    deltas = deltas.union(spark.createDataFrame([("nothing", None)], "metric string, delta double"))
    return evaluation.gates(deltas, spark.createDataFrame(_GATES, "group_name string, metric string, allowed_change double, direction string, declared boolean"))


_PAIRS = """ls AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY case_set, question_id, round, arm ORDER BY seq DESC) = 1),
p0 AS (SELECT case_set, question_id, round, max(CASE WHEN arm = 'a' THEN metric END) AS x, max(CASE WHEN arm = 'b' THEN metric END) AS y,
  bool_or(arm = 'a' AND status = 'completed') AND bool_or(arm = 'b' AND status = 'completed') AS complete FROM ls GROUP BY ALL),
pd AS (SELECT case_set, question_id, round, complete, CASE WHEN complete THEN x END AS before, CASE WHEN complete THEN y END AS after, CASE WHEN complete THEN y - x END AS diff FROM p0)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.paired(_obs(spark, d), ("a", "b"))


@register(f'WITH {OBS}, {_PAIRS} SELECT case_set, question_id, round, complete, before, after, round(diff, 6) AS diff FROM pd')
def eval_paired_cells(spark: SparkSession, d: str) -> DataFrame:
    """Paired arms a cell, last attempt first; cells that an arm did not complete are marked."""
    return _pairs(spark, d).withColumn("diff", F.round("diff", 6))


@register(f"""WITH {OBS}, {_PAIRS}, un AS (SELECT avg(diff) AS d, avg(before) AS x, avg(after) AS y FROM pd WHERE diff IS NOT NULL GROUP BY case_set, question_id),
s AS (SELECT count(*) AS units, avg(x) AS x, avg(y) AS y, avg(d) AS m, stddev_samp(d) AS sd, stddev_samp(d) / sqrt(count(*)) AS se FROM un),
w AS (SELECT count(diff) AS pairs, count(*) FILTER (NOT complete) AS dropped, round(avg(diff), 3) AS mean_by_pair, count(*) FILTER (diff > 0) AS wins, count(*) FILTER (diff < 0) AS losses, count(*) FILTER (diff = 0) AS ties FROM pd)
SELECT units, round(x, 3) AS before_mean, round(y, 3) AS after_mean, round(m, 3) AS mean, round(sd, 4) AS sd, round(se, 4) AS se, round(m - 1.96 * se, 4) AS low, round(m + 1.96 * se, 4) AS high, round(1.96 * se, 4) AS mde, w.* FROM s, w""")
def eval_unit_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Effect over independent questions, with interval and detectable effect; counts over cells."""
    return evaluation.unit_statistics(_pairs(spark, d))


@register(f"""WITH {OBS}, {_PAIRS}, s AS (SELECT count(*) AS pairs, avg(diff) AS m, coalesce(stddev_samp(diff), 0) AS sd FROM pd WHERE diff IS NOT NULL)
SELECT pairs, round(m, 3) AS mean, round(sd, 4) AS sd, round(sd / sqrt(pairs), 4) AS se, round(1.96 * sd / sqrt(pairs), 4) AS mde FROM s""")
def eval_pair_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The effect over cells as if they were independent, for contrast."""
    return evaluation.pair_statistics(_pairs(spark, d))


_SIGNED = """nz AS (SELECT round, round(diff, 6) AS diff FROM pd WHERE diff IS NOT NULL AND round(diff, 6) <> 0),
rk AS (SELECT *, rank() OVER (PARTITION BY round ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY round, abs(diff)) - 1) / 2 AS k FROM nz),
st AS (SELECT round, count(*) AS n, least(coalesce(sum(k) FILTER (diff > 0), 0), coalesce(sum(k) FILTER (diff < 0), 0)) AS statistic FROM rk GROUP BY 1)"""
_CDF = "(0.5 * (1 + sign({z}) * (1 - {k} * (0.254829592 + {k} * (-0.284496736 + {k} * (1.421413741 + {k} * (-1.453152027 + {k} * 1.061405429)))) * exp(-({z}) * ({z}) / 2))))"


def _sql_cdf(z: str) -> str:
    return _CDF.format(z=z, k=f"(1 / (1 + 0.3275911 * abs({z}) / sqrt(2)))")


@register(f"""WITH RECURSIVE {OBS}, {_PAIRS}, {_SIGNED},
dp AS (SELECT 0 AS m, 0 AS s, 1::HUGEINT AS ways UNION ALL SELECT m + 1, s + p * (m + 1), sum(ways) FROM dp, (VALUES (0), (1)) AS v(p) WHERE m < 20 GROUP BY m, s + p * (m + 1)),
tl AS (SELECT m, s, sum(ways) OVER (PARTITION BY m ORDER BY s) AS ways FROM dp),
z AS (SELECT *, (statistic - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24) AS z FROM st),
p AS (SELECT z.*, least(1, CASE WHEN n <= 20 THEN 2 * ways::DOUBLE / pow(2, n) ELSE 2 * {_sql_cdf("z")} END) AS p FROM z LEFT JOIN tl ON m = n AND s = floor(statistic))
SELECT round, n, round(statistic, 3) AS statistic, round(p, 4) AS p_value, p < 0.05 AS significant FROM p""")
def eval_wilcoxon(spark: SparkSession, d: str) -> DataFrame:
    """Signed-rank test a round, on the differences of all its questions."""
    unit = _pairs(spark, d).where("diff IS NOT NULL").withColumn("diff", F.round("diff", 6))
    return stats.wilcoxon(unit, "round", "diff")


@register(f"WITH {OBS}, {_PAIRS}, {_SIGNED} SELECT round, n, round(statistic, 3) AS statistic FROM st")
def eval_signed_ranks(spark: SparkSession, d: str) -> DataFrame:
    """The rank sums of the signed-rank test."""
    unit = _pairs(spark, d).where("diff IS NOT NULL").withColumn("diff", F.round("diff", 6))
    return stats.wilcoxon(unit, "round", "diff").select("round", "n", "statistic")


@register(f"WITH {OBS}, {_PAIRS} SELECT round, count(*) FILTER (before >= 0.5 AND NOT after >= 0.5) AS b, count(*) FILTER (NOT before >= 0.5 AND after >= 0.5) AS c FROM pd GROUP BY 1")
def eval_mcnemar_counts(spark: SparkSession, d: str) -> DataFrame:
    """Discordant pairs of a binary verdict."""
    return stats.mcnemar(_pairs(spark, d).withColumn("x", F.col("before") >= 0.5).withColumn("y", F.col("after") >= 0.5), "round", "x", "y").drop("p_value", "method")


@register(f"""WITH {OBS}, {_PAIRS}, c AS (SELECT round, count(*) FILTER (before >= 0.5 AND NOT after >= 0.5) AS b, count(*) FILTER (NOT before >= 0.5 AND after >= 0.5) AS c FROM pd GROUP BY 1),
p AS (SELECT *, b + c AS n, list_sum(list_transform(range(0, least(b, c) + 1), lambda k: exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2)))) AS tail, sqrt(pow(abs(b - c) - 1, 2) / greatest(b + c, 1)) AS z FROM c)
SELECT round, b, c, round(CASE WHEN n = 0 THEN 1 WHEN n > 1000 THEN 2 * (1 - {_sql_cdf("z")}) ELSE least(1, 2 * tail) END, 4) AS p_value, CASE WHEN n = 0 THEN 'none' WHEN n > 1000 THEN 'chi2_approx' ELSE 'exact' END AS method FROM p""")
def eval_mcnemar(spark: SparkSession, d: str) -> DataFrame:
    """Exact McNemar test a round."""
    return stats.mcnemar(_pairs(spark, d).withColumn("x", F.col("before") >= 0.5).withColumn("y", F.col("after") >= 0.5), "round", "x", "y")


@register(f"""WITH {OBS}, c AS (SELECT case_set, question_id, arm, count(*) AS r, count(DISTINCT metric) AS v FROM obs WHERE metric IS NOT NULL GROUP BY ALL)
SELECT arm, count(*) AS cells, count(*) FILTER (r > 1) AS multi_round, count(*) FILTER (r > 1 AND v > 1) AS changed FROM c GROUP BY 1""")
def eval_round_stability(spark: SparkSession, d: str) -> DataFrame:
    """Cells with several observations that change."""
    return evaluation.round_stability(_obs(spark, d))


@register(f"""WITH {OBS}, {_PAIRS}, e AS (SELECT count(*) FILTER (ok = 0) AS empty_rounds FROM (SELECT round, count(*) FILTER (status = 'completed') AS ok FROM obs GROUP BY 1)),
s AS (SELECT count(*) FILTER (complete) / count(*) AS share FROM pd),
g AS (SELECT avg((status = 'provider_error')::INT) AS error, avg((status = 'provider_timeout')::INT) AS timeout FROM obs),
f AS (SELECT *, array_to_string(list_filter([CASE WHEN share < 0.6 THEN 'paired_cell_share' END, CASE WHEN error >= 0.1 THEN 'provider_error_rate' END, CASE WHEN timeout >= 0.1 THEN 'provider_timeout_rate' END, CASE WHEN empty_rounds > 0 THEN 'rounds_with_no_completions' END], lambda x: x IS NOT NULL), ',') AS failed FROM g, e, s)
SELECT round(error, 6) AS error, round(timeout, 6) AS timeout, round(share, 3) AS share, empty_rounds, failed, failed = '' AS passed FROM f""")
def eval_provider_gate(spark: SparkSession, d: str) -> DataFrame:
    """Provider thresholds, paired cells and empty rounds."""
    return evaluation.provider_gate(_obs(spark, d), _pairs(spark, d))


@register(f"""WITH {OBS} SELECT question_id, count(*) FILTER (verdict) AS matched, count(*) AS total, round(count(*) FILTER (verdict) / count(*), 3) AS ratio FROM obs WHERE verdict IS NOT NULL GROUP BY ROLLUP (question_id)""")
def eval_pooled_hops(spark: SparkSession, d: str) -> DataFrame:
    """Hops counted over all answers and a question, not a mean of ratios."""
    return evaluation.pooled_hops(_obs(spark, d).where("verdict IS NOT NULL").select("question_id", F.col("verdict").alias("matched")))


@register(f"WITH {OBS} SELECT arm, round(avg(latency), 3) AS mean, round(quantile_cont(latency, 0.5), 3) AS median, round(max(latency), 3) AS longest FROM obs GROUP BY 1")
def eval_latency_by_arm(spark: SparkSession, d: str) -> DataFrame:
    """Mean, true median and longest latency."""
    return evaluation.latency_by_arm(_obs(spark, d))


@register(f"""WITH {OBS}, l AS (SELECT arm, list_sort(list(latency) FILTER (latency IS NOT NULL)) AS v, count(latency) AS n FROM obs GROUP BY 1)
SELECT arm, v[CAST(round_even(0.95 * (n - 1), 0) AS INT) + 1] AS nearest, v[CAST(floor(0.95 * (n - 1)) AS INT) + 1] AS floored, v[CAST(greatest(1, floor(0.95 * n)) AS INT)] AS cut, v[CAST(floor((n - 1) / 2) AS INT) + 1] AS lower_median FROM l""")
def stats_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Four percentile conventions side by side (T4)."""
    return stats.values_at(_obs(spark, d), ["arm"], "latency", {"nearest": ("nearest", 0.95), "floored": ("floored", 0.95), "cut": ("cut", 0.95), "lower_median": ("lower_median", 0.5)})


_FIXED = """s AS (SELECT doc_id, substr(text, b + 1, 800) AS raw, b FROM (SELECT doc_id, text, unnest(range(0, greatest(0, length(text) - 151) + 1, 650)) AS b FROM documents WHERE regexp_matches(text, '\\S'))),
fc AS (SELECT doc_id, b + length(raw) - length(regexp_replace(raw, '^\\s+', '')) AS start_index, regexp_replace(regexp_replace(raw, '^\\s+', ''), '\\s+$', '') AS chunk FROM s WHERE regexp_matches(raw, '\\S'))"""


@register(f"""WITH {_FIXED} SELECT doc_id, start_index, length(chunk) AS n, sha256(concat_ws(chr(31), doc_id::VARCHAR, '', 'F', 'v1', start_index::VARCHAR, chunk)) AS chunk_id FROM fc""")
def corpus_fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Fixed windows with overlap and content-addressed ids."""
    return chunking.split(_t(spark, d, "documents"), "F").select("doc_id", "start_index", F.length("chunk").alias("n"), "chunk_id")


@register()
def corpus_recursive_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by the first separator that occurs, then finer ones; tested on small cases."""
    return chunking.split(_t(spark, d, "documents"), "R").select("doc_id", "start_index", F.length("chunk").alias("n"), "chunk_id")


_LINES = rf"""li AS (SELECT doc_id, line, i, regexp_matches(line, '{sections.FENCE}') AS fence FROM (SELECT doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) AS i FROM documents)),
lf AS (SELECT *, sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY i) AS fences FROM li),
lk AS (SELECT *, CASE WHEN fence OR fences % 2 = 1 THEN 'code' WHEN regexp_matches(line, '{sections.TABLE_ROW}') THEN 'table' WHEN NOT regexp_matches(line, '\S') THEN 'blank' WHEN regexp_matches(line, '{sections.HEADING}') THEN 'heading' ELSE 'paragraph' END AS kind FROM lf),
lp AS (SELECT *, CASE WHEN kind = 'code' THEN (fences + 1) // 2 ELSE 0 END AS part FROM lk),
ln2 AS (SELECT *, kind = 'heading' OR lag(kind) OVER w IS DISTINCT FROM kind OR lag(part) OVER w <> part AS fresh FROM lp WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
lr AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM ln2),
bk AS (SELECT * FROM (SELECT doc_id, n, kind, regexp_replace(regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\s+', ''), '\s+$', '') AS block FROM lr WHERE kind <> 'blank' GROUP BY ALL) WHERE block <> '')"""


@register(f"WITH {_LINES} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) AS INT) AS n, kind, length(block) AS chars, sha256(block) AS block FROM bk")
def corpus_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Headings, tables, fenced code and paragraphs of every document, by windows over its lines."""
    got = sections.blocks(_t(spark, d, "documents"))
    return got.select("doc_id", F.row_number().over(W.partitionBy(sections.KEY).orderBy("n")).alias("n"), "kind", F.length("block").alias("chars"), F.sha2("block", 256).alias("block"))


@register()
def corpus_section_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs, tables and code packed under their headings, long chunks cut at sentences; tested on small cases."""
    return chunking.split(_t(spark, d, "documents"), "P").select("doc_id", "start_index", "end_index", "section_path", F.length("chunk").alias("n"), "chunk_id")


@register(f"""WITH {_FIXED}, n AS (SELECT length(chunk) AS n FROM fc)
SELECT count(*) AS chunk_count, round(avg(n), 2) AS mean_chars, list_sort(list(n))[CAST(floor(0.95 * count(*)) AS INT)] AS p95_chars FROM n""")
def corpus_chunk_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Count, mean and 95th percentile of chunk lengths."""
    return corpus.chunk_statistics(chunking.split(_t(spark, d, "documents"), "F"), "chunk")


_SNAP = """old AS (SELECT url AS path, sha256(html) AS sha256 FROM pages WHERE page_id % 7 <> 0), new AS (SELECT url AS path, CASE WHEN page_id % 5 = 0 THEN sha256(html || 'x') ELSE sha256(html) END AS sha256 FROM pages WHERE page_id % 11 <> 0),
df AS (SELECT path, CASE WHEN new.sha256 IS NULL THEN 'removed' WHEN old.sha256 = new.sha256 THEN 'unchanged' ELSE 'changed' END AS change FROM old FULL JOIN new USING (path))"""


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = _t(spark, d, "pages").select("page_id", F.col("url").alias("path"), "html")
    old = p.where("page_id % 7 <> 0").select("path", F.sha2("html", 256).alias("sha256"))
    new = p.where("page_id % 11 <> 0").select("path", F.sha2(F.when(F.col("page_id") % 5 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html")), 256).alias("sha256"))
    return old, new


@register(f"WITH {_SNAP} SELECT * FROM df")
def corpus_snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """Added, changed, removed and unchanged files between two manifests (H1, K1)."""
    return corpus.snapshot_diff(*_snapshots(spark, d))


@register(f"WITH {_SNAP} SELECT * FROM old WHERE path NOT IN (SELECT path FROM df WHERE change <> 'unchanged') UNION ALL SELECT * FROM new WHERE path IN (SELECT path FROM df WHERE change = 'changed')")
def corpus_incremental_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The store after deleting what changed or went and appending what is new (B2)."""
    old, new = _snapshots(spark, d)
    return corpus.upsert(old, corpus.snapshot_diff(old, new), new)


@register(f"""WITH {_post(20)} SELECT question_id, doc_id, 'L' || row_number() OVER (PARTITION BY question_id ORDER BY rank, doc_id) AS citation_id, length(substr(text, 1, 300)) AS n, length(text) > 300 AS truncated FROM lex JOIN documents USING (doc_id) WHERE rank <= 5""")
def corpus_evidence_pack(spark: SparkSession, d: str) -> DataFrame:
    """The first five documents a question, cut with flags."""
    docs = _lexical(spark, d, 20).join(_t(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return corpus.evidence_pack(docs, 5, 300).select("question_id", "doc_id", "citation_id", F.length("content").alias("n"), "truncated")


_ANS = "SELECT event_id AS question_id, concat('see [L', event_id % 7, '] and [W', event_id % 4, '], [L', event_id % 3, ']') AS answer FROM {0}"


@register(f"""WITH a AS ({_ANS.format("events")}), u AS (SELECT question_id, list_sort(list_distinct(regexp_extract_all(answer, '\\[([LW]\\d+)\\]', 1))) AS used, ['L1', 'L2', 'L3', 'W1'] AS ok FROM a)
SELECT question_id, array_to_string(used, ',') AS used, array_to_string(list_filter(used, lambda x: NOT list_contains(ok, x)), ',') AS invalid, round(len(list_filter(used, lambda x: list_contains(ok, x))) / 4, 4) AS usage FROM u""")
def audit_citations(spark: SparkSession, d: str) -> DataFrame:
    """Citations used, not allowed, and the share of allowed ones used (H3)."""
    _t(spark, d, "events").createOrReplaceTempView("__events")
    rows = spark.sql(_ANS.format("__events")).withColumn("allowed", F.array(*map(F.lit, ("L1", "L2", "L3", "W1"))))
    got = corpus.citation_sets(rows)
    return got.select("question_id", F.array_join("used", ",").alias("used"), F.array_join("invalid", ",").alias("invalid"), "usage")


@register("""WITH t AS (SELECT p_partkey % 100 AS case_id, lower(p_name) AS term FROM part UNION SELECT p_partkey % 100, lower(split_part(p_name, ' ', 1)) FROM part)
SELECT a.case_id, a.term, b.term AS shadowed_by FROM t a JOIN t b ON a.case_id = b.case_id AND a.term <> b.term AND contains(a.term, b.term)""")
def lint_shadowed_terms(spark: SparkSession, d: str) -> DataFrame:
    """Contract terms that hold another term of their case (M6)."""
    p = _t(spark, d, "part")
    terms = p.selectExpr("p_partkey % 100 AS case_id", "lower(p_name) AS term").union(p.selectExpr("p_partkey % 100", "lower(split_part(p_name, ' ', 1))")).distinct()
    return corpus.shadowed_terms(terms)


@register("""WITH a AS (SELECT DISTINCT c_custkey AS question_id FROM customer), b AS (SELECT DISTINCT o_custkey AS question_id FROM orders WHERE o_custkey % 3 > 0 UNION SELECT -1)
SELECT question_id, 'missing_slice' AS problem FROM a WHERE question_id NOT IN (SELECT question_id FROM b) UNION ALL SELECT question_id, 'extra_slice' FROM b WHERE question_id NOT IN (SELECT question_id FROM a)""")
def lint_contract_slices(spark: SparkSession, d: str) -> DataFrame:
    """Ids that contract or slices lack."""
    a = _t(spark, d, "customer").select(F.col("c_custkey").alias("question_id"))
    b = _t(spark, d, "orders").where("o_custkey % 3 > 0").select(F.col("o_custkey").alias("question_id")).union(a.sparkSession.range(1).select(F.lit(-1).cast("long")))
    return corpus.consistency(a, b)


@register("""SELECT doc_id, round(length(regexp_replace(text, '[^一-鿿]', '', 'g')) / length(text), 6) AS cjk, length(trim(text)) >= 20 AND length(regexp_replace(text, '[^一-鿿]', '', 'g')) = 0 AND length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / length(text) < 0.55 AS garbled,
greatest(1, length(text) // 4) AS tokens, sha256(regexp_replace(lower(text), '[^0-9a-z一-鿿]', '', 'g')) AS designation FROM documents WHERE length(text) > 0""")
def text_flags(spark: SparkSession, d: str) -> DataFrame:
    """Garbled pages, CJK share, token estimates, designation keys."""
    docs = _t(spark, d, "documents").where("length(text) > 0")
    return docs.select("doc_id", F.round(text.cjk_ratio("text"), 6).alias("cjk"), text.looks_garbled("text").alias("garbled"), text.token_estimate(F.col("text")).alias("tokens"), F.sha2(text.designation_key(F.col("text")), 256).alias("designation"))


@register(f"SELECT doc_id, len({_TERMS.format('text')}) AS n_terms, array_to_string(list_sort({_TERMS.format('text')}), ' ') AS terms FROM documents")
def text_lexical_terms(spark: SparkSession, d: str) -> DataFrame:
    """Distinct lexical terms of every document."""
    t = text.lexical_terms(F.coalesce("text", F.lit("")))
    return _t(spark, d, "documents").select("doc_id", F.size(t).alias("n_terms"), F.array_join(F.array_sort(t), " ").alias("terms"))


_PATHS = "SELECT p_partkey AS id, p_name AS expected, concat('/data', chr(92), CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat(p_name, '.pdf') WHEN 2 THEN replace(p_name, ' ', '_') WHEN 3 THEN concat(p_name, '/') ELSE p_brand END) AS actual FROM {0}"
_PARTS = {
    "sl": "lower(replace(coalesce({0}, ''), '\\', '/'))",
    "sq": "regexp_replace(lower(replace(coalesce({0}, ''), '\\', '/')), '\\s+', '', 'g')",
    "rt": "rtrim(lower(replace(coalesce({0}, ''), '\\', '/')), '/')",
    "st": "regexp_replace(lower(replace(coalesce({0}, ''), '\\', '/')), '[\\s_+\\-()\\[\\]{{}}（）【】]', '', 'g')",
}


@register(f"""WITH p AS ({_PATHS.format("part")}), n AS (SELECT id, expected, actual, {", ".join(f"{v.format(x)} AS {k}{x[0]}" for k, v in _PARTS.items() for x in ("expected", "actual"))} FROM p)
SELECT id, split_part(sle, '/', -1) = split_part(sla, '/', -1) AS basename, split_part(sqe, '/', -1) = split_part(sqa, '/', -1) OR contains(sqa, sqe) AS basename_or_contains,
rte <> '' AND rta <> '' AND (contains(rta, rte) OR contains(rte, rta) OR split_part(rte, '/', -1) = split_part(rta, '/', -1)) AS bidirectional,
contains(sta, ste) OR split_part(ste, '/', -1) = split_part(sta, '/', -1) OR contains(sta, split_part(ste, '/', -1)) AS stripped, contains(actual, expected) AS substring FROM n""")
def match_sources(spark: SparkSession, d: str) -> DataFrame:
    """Five named source matchers."""
    _t(spark, d, "part").createOrReplaceTempView("__part")
    p = spark.sql(_PATHS.format("__part"))
    return p.select("id", *[retrieval.matches(k, F.col("expected"), F.col("actual")).alias(k) for k in ("basename", "basename_or_contains", "bidirectional", "stripped", "substring")])


@register("SELECT p_partkey AS id, round(pi() * p_size * p_size / 4 * 20 / 1000, 3) AS ml FROM part WHERE p_size > 0")
def calc_cylinder(spark: SparkSession, d: str) -> DataFrame:
    """Cylinder volumes in millilitres."""
    return _t(spark, d, "part").where("p_size > 0").select(F.col("p_partkey").alias("id"), text.cylinder_ml(F.col("p_size"), F.lit(20)).alias("ml"))


@register("SELECT user_id, ts::DATE AS day, round(sum(value), 4) AS used, sum(value) > 500 AS over_budget FROM events GROUP BY ALL")
def budget_daily(spark: SparkSession, d: str) -> DataFrame:
    """Use of a daily budget that starts anew each day, a user (K3)."""
    used = budget.daily_usage(_t(spark, d, "events"), "ts", "value", 500, by=["user_id"])
    return used.select("user_id", "day", F.round("used", 4).alias("used"), F.col("over").alias("over_budget"))


@register("SELECT event_type, count(*) AS n, count(*) FILTER (trim(coalesce(props, '')) = '') AS empty_props, round(avg(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)), 4) AS mean_k FROM events GROUP BY 1")
def inspect_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Category histogram, missing fields, values out of JSON."""
    k = F.get_json_object(text.json_object(F.col("props")), "$.k").try_cast("double")
    return _t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.trim(F.coalesce("props", F.lit(""))) == "").alias("empty_props"), F.round(F.avg(k), 4).alias("mean_k"))


@register("SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS pos FROM documents QUALIFY pos <= 5")
def sample_balanced(spark: SparkSession, d: str) -> DataFrame:
    """The first five documents a category."""
    return retrieval.top_k(_t(spark, d, "documents").select("lang", "doc_id"), ["lang"], [F.col("doc_id")], 5, "pos")


_ISSUES = "SELECT l_orderkey - l_orderkey % 2 AS question_id, l_returnflag AS status, l_linenumber % 2 AS claim_id FROM {0}"


@register(f"""WITH i AS (SELECT DISTINCT * FROM ({_ISSUES.format("lineitem")})), n AS (SELECT question_id, count(*) AS n FROM i GROUP BY 1)
SELECT o_orderkey AS question_id, coalesce(n, 0) AS issues, coalesce(n, 0) = 0 AND o_custkey % 2 > 0 AS deliverable FROM orders LEFT JOIN n ON question_id = o_orderkey""")
def audit_delivery(spark: SparkSession, d: str) -> DataFrame:
    """Distinct issues a question and the delivery verdict."""
    _t(spark, d, "lineitem").createOrReplaceTempView("__lineitem")
    docs = _t(spark, d, "orders").selectExpr("o_orderkey AS question_id", "o_custkey % 2 AS n_docs")
    return corpus.delivery(spark.sql(_ISSUES.format("__lineitem")), docs)



# documents of the test tables under paths and with openings that the rules know; the text is both Spark SQL and DuckDB SQL
_NAMED = """doc_id, CASE doc_id % 9 WHEN 0 THEN 'tds/PC_LEXAN 943 TDS' WHEN 1 THEN 'molding/drying' WHEN 2 THEN 'norms/GB/T 16252_2023' WHEN 3 THEN 'hand_size' WHEN 4 THEN 'study' WHEN 5 THEN 'guide' WHEN 6 THEN 'decision 316' WHEN 7 THEN 'PP-H tds' ELSE 'notes' END AS path,
  coalesce(source, '') AS title,
  concat(CASE doc_id % 8 WHEN 0 THEN 'children' WHEN 1 THEN 'older adult' WHEN 2 THEN '适用范围：饮水容器与杯口。' WHEN 3 THEN 'Scope: cups for hot drinks. ' WHEN 4 THEN 'National Standard' WHEN 5 THEN '握持' ELSE '' END, ' ', coalesce(text, '')) AS content"""
_ASKED = """item_id AS question_id, text AS asked,
  concat(text, CASE length(text) % 9 WHEN 0 THEN ' 成人 杯径' WHEN 1 THEN ' 儿童 尺寸' WHEN 2 THEN ' PC 选材' WHEN 3 THEN ' 食品接触' WHEN 4 THEN ' 注塑 成型' WHEN 5 THEN ' 跌落 测试' WHEN 6 THEN ' GB/T 16252—2023' WHEN 7 THEN ' Tritan 牌号' ELSE '' END) AS question"""


def _sql_any(expr: str, words: tuple[str, ...]) -> str:
    return f"regexp_matches(lower({expr}), '{'|'.join(re.escape(w.lower()) for w in words)}')"


def _sql_word(expr: str, word: str) -> str:
    return f"regexp_matches({expr}, '(?i)(^|[^A-Za-z]){word}($|[^A-Za-z])')"


def _sql_case(rules_: list[tuple[str, str]], default: str) -> str:
    return f"CASE {' '.join(f'WHEN {a} THEN {b}' for a, b in rules_)} ELSE {default} END"


_PLACE = "concat(path, ' ', title)"
_GRADE = r"regexp_replace(trim(regexp_replace(replace(regexp_extract(concat(path, ' ', title), '(?i)\b((?:LEXAN|RADEL|TX|TRITAN|PPSU|PP|PC|PET|HDPE)[ _-]+[A-Z0-9]+)', 1), '_', ' '), '\s+', ' ', 'g')), '(?i)( (?:TDS|DATA|GUIDE|SHEET))+$', '')"
_FLAT = r"trim(regexp_replace(left(content, 4000), '\s+', ' ', 'g'))"
_META = f"""nd AS (SELECT {_NAMED} FROM documents),
md AS (SELECT *, {_sql_case([(f"source_category = 'standard' OR regexp_matches({_PLACE}, '(?i)\\b(?:GB|ISO|IEC|ASTM|EN|DIN|JIS)')", "'standard'"), *((f"source_category = '{c}'", f"'{v}'") for c, v in rules.LEVEL_OF.items())], "'unknown'")} AS evidence_level FROM (SELECT *,
  {_sql_case([*((_sql_any(_PLACE, w), f"'{c}'") for c, w in rules.CATEGORY_WORDS), (_sql_any("left(content, 3000)", rules.STANDARD_TEXT), "'standard'")], "'unknown'")} AS source_category,
  {_sql_case([(_sql_any(f"concat({_PLACE}, ' ', left(content, 2500))", rules.MINORS), "'minors'"), (_sql_any(f"concat({_PLACE}, ' ', left(content, 2500))", rules.ELDERLY), "'elderly'"), (f"regexp_matches(concat({_PLACE}, ' ', left(content, 2500)), '{rules.ADULT_STANDARD}') OR " + _sql_any(f"concat({_PLACE}, ' ', left(content, 2500))", rules.ADULTS), "'adults'")], "'unknown'")} AS population,
  {_sql_case([(f"contains({_GRADE}, ' ')", _GRADE), *((_sql_word(_PLACE, g), f"'{g}'") for g in rules.GRADES)], "'unknown'")} AS material_grade,
  coalesce({', '.join(f"nullif(trim(regexp_extract({_FLAT}, '{p}', 1)), '')" for p in rules.SCOPE)}, 'unknown') AS applicability FROM nd))"""


def _documents_with_metadata(spark: SparkSession, d: str) -> DataFrame:
    return rules.document_metadata(_t(spark, d, "documents").selectExpr(_NAMED.split(",", 1)[0], *_split_columns(_NAMED)))


def _split_columns(text_: str) -> list[str]:
    """The columns after the first, cut at commas that end a line or follow the first column."""
    head, *rest = re.split(r",\n\s*", text_)
    return [head.split(",", 1)[1], *rest]


@register(f"WITH {_META} SELECT doc_id, source_category, evidence_level, population, material_grade, applicability FROM md")
def rules_document_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Metadata inferred from path, title and text of every document."""
    return _documents_with_metadata(spark, d).select("doc_id", "source_category", "evidence_level", "population", "material_grade", "applicability")


_FAMILY = {x: _sql_case([(_sql_any(x, w), f"'{f}'") for f, w in rules.FAMILIES], "'unknown'") for x in ("material_grade", "body", "m")}
_CATS = {"sized": "'anthropometry', 'standard', 'paper', 'internal_rule', 'process_guide'", "stuff": "'material_tds', 'standard', 'reference_handbook', 'internal_rule', 'process_guide'"}
_KEY = "regexp_replace(lower({0}), '[^0-9a-z一-鿿]', '', 'g')"
_EVIDENCE_RULES = [
    (f"{_sql_any('question', rules.ASKED_ADULT)} AND NOT {_sql_any('question', rules.NO_ADULT)} AND population = 'minors'", "scope_mismatch", "adult"),
    (f"{_sql_any('question', rules.ASKED_MINORS)} AND population = 'adults'", "scope_mismatch", "minors"),
    ("len(materials) > 0 AND material_grade <> 'unknown' AND source_category = 'material_tds' AND NOT (list_contains(fams, fg) OR list_contains(fams, fb))", "scope_mismatch", "grade"),
    ("relevance < 0.25", "indirect", "low"),
    (f"{_sql_any('question', rules.TOPICS['dimension'])} AND source_category IN ({_CATS['sized']}) AND {_sql_any('body', rules.GRIP)}", "direct", "grip"),
    (f"{_sql_any('question', rules.TOPICS['dimension'])} AND source_category IN ({_CATS['sized']}) AND (source_category = 'anthropometry' OR NOT {_sql_any('body', rules.PRODUCT)})", "indirect", "body"),
    (f"{_sql_any('question', rules.TOPICS['dimension'])} AND source_category IN ({_CATS['sized']})", "direct", "product"),
    (f"{_sql_any('question', rules.TOPICS['food_contact'])} AND source_category IN ('standard', 'material_tds')", "direct", "food"),
    (f"{_sql_any('question', rules.TOPICS['material'])} AND source_category IN ({_CATS['stuff']}) AND (material_grade <> 'unknown' OR source_category = 'standard')", "direct", "material"),
    (f"{_sql_any('question', rules.TOPICS['material'])} AND source_category IN ({_CATS['stuff']})", "indirect", "background"),
    (f"{_sql_any('question', rules.TOPICS['process'])} AND source_category IN ('process_guide', 'material_tds', 'internal_rule')", "direct", "process"),
    (f"{_sql_any('question', rules.TOPICS['testing'])} AND source_category IN ('standard', 'paper', 'process_guide', 'internal_rule', 'material_tds')", "direct", "testing"),
    (f"len(list_filter(refs, lambda r: {_KEY.format('r')} <> '' AND contains({_KEY.format('body')}, {_KEY.format('r')}))) > 0", "direct", "reference"),
    ("source_category <> 'unknown'", "indirect", "related"),
]
_EVIDENCE = f"""WITH {_post(20)}, {_META},
aq AS (SELECT {_ASKED} FROM benchmark),
jd AS (SELECT question_id, doc_id, question, md.* EXCLUDE (doc_id), round(score, 6) / (round(score, 6) + 20) AS relevance,
  concat_ws(' ', path, title, title, 'unknown', applicability, content) AS body,
  list_filter([{', '.join(f"CASE WHEN {_sql_word('question', m)} THEN '{m}' END" for m in rules.ASKED_MATERIALS)}], lambda x: x IS NOT NULL) AS materials,
  regexp_extract_all(question, '{rules.REFERENCE}', 1) AS refs
  FROM lex JOIN md USING (doc_id) JOIN aq USING (question_id)),
jf AS (SELECT *, {_FAMILY['material_grade']} AS fg, {_FAMILY['body']} AS fb, list_filter(list_transform(materials, lambda m: {_FAMILY['m']}), lambda f: f <> 'unknown') AS fams FROM jd)
SELECT question_id, doc_id, round(relevance, 6) AS relevance, {_sql_case([(a, f"'{s_}'") for a, s_, _ in _EVIDENCE_RULES], "'indirect'")} AS evidence_status,
  {_sql_case([(a, "printf('" + rules.REASONS['low'] + "', relevance, 0.25)" if r == 'low' else f"'{rules.REASONS[r]}'") for a, _, r in _EVIDENCE_RULES], "'" + rules.REASONS['unknown'] + "'")} AS evidence_reason FROM jf"""


@register(_EVIDENCE)
def rules_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The evidence decision list over each question's lexical candidates."""
    asked = rules.question_profile(_t(spark, d, "benchmark").selectExpr("item_id AS question_id", *_split_columns(_ASKED)))
    docs = _documents_with_metadata(spark, d).drop("section").withColumn("section", F.lit("unknown"))
    score = F.round("score", 6)
    rows = _lexical(spark, d, 20).join(asked, "question_id").join(docs, "doc_id").withColumn("relevance", score / (score + 20))
    return rules.classify_evidence(rows).select("question_id", "doc_id", F.round("relevance", 6).alias("relevance"), "evidence_status", "evidence_reason")


# further queries register themselves
from . import answers, audits, cases, ranking, records, replays, states, stores, tasks  # noqa: E402, F401


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
