"""The operators applied to whole tables with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bitcodes, chat, decontamination, filter_audit, jaccard_join, mixing, perplexity, quality_rules, sentencepiece_codec, sharding, sstable, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of equal row counts, equal texts together."""
    out = sharding.assign(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as sorted-string tables and read back."""
    docs = _table(spark, sf_dir, "documents")
    manifest = sstable.write(docs, tokenizer_path("byte_bpe_50k.json"), 2, sstable.new_folder(docs))
    return sstable.digest(manifest, max(8, spark.sparkContext.defaultParallelism))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factorization machine scores of all documents; the model never sees a held-out label."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    cfg = toxicity.Settings()
    model = toxicity.train(toxicity.labelled_rows(docs, labels, cfg), cfg)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    return toxicity.score(docs, model, cfg).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all formatted conversations, stored in several layouts, read back from template and loss mask."""
    table = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    says = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], table.schema)
    records = chat.rows_to_records(table.union(probe))
    return chat.digest(chat.render(chat.canonical(records, "conv_id", rename_roles=False), "conv_id"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document, decoded again and checked."""
    return sentencepiece_codec.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document and whether its language's quantiles keep it."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    cfg = perplexity.Settings()
    model = perplexity.train(perplexity.trusted_rows(docs, labels), cfg)
    scores = perplexity.materialise(perplexity.score(docs, model, ["doc_id", "lang"]), "scores")
    judged = perplexity.verdicts(scores, perplexity.fences(scores, cfg), cfg)
    return judged.select("row.doc_id", "row.lang", "n_chars_scored", F.exp("log_ppl").alias("perplexity"), F.exp("limit").alias("perplexity_limit"), "kept")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document and the verdict of the repetition rules."""
    got = quality_rules.profile(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth vector."""
    return bitcodes.neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets have similarity 0.8 or more."""
    return jaccard_join.cluster(_table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers over every document, with corpus-wide counts of linked ids."""
    a, b = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    aligned = alignment.materialise(alignment.align(_table(spark, sf_dir, "documents"), a, b), "aligned")
    scored = alignment.score(aligned, alignment.pair_counts(aligned, len(alignment.vocabularies(a, b)[1].size)))
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside a window of the benchmark, and the items that occur."""
    got = decontamination.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    named = F.sha2(F.array_join("items", ","), 256)
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), named.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes, by part, for all orders of the filters."""
    counted = filter_audit.failures(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return filter_audit.audit(counted, ["A", "B", "C", "D", "E"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_sharding, op2_sstable, op3_toxicity, op4_chat, op5_mixing, op6_sentencepiece, op7_perplexity, op8_quality_rules, op9_neighbours, op10_jaccard, op11_alignment, op12_decontamination, op13_filter_audit)
    return {f.__name__: f for f in found}


_MARKS = " + ".join(f"(length({{0}}) - length(replace({{0}}, '{m}', ''))) // {len(m)}" for m in ("\\", "|", "[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>"))

OP4_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS all_turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
    sum(17 + length(role) + length(text) + {_MARKS.format("text")} + {_MARKS.format("role")} + length(role) - length(replace(role, chr(10), ''))) AS formatted
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(all_turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted AS BIGINT) AS formatted_chars FROM g
"""

OP10_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS c FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v WHERE r.c < e.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.v = w.doc_id GROUP BY ALL
"""


_GRAMS = [n for n, _ in quality_rules.Rules().ngram_limits]
OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d),
c AS (SELECT r, doc_id, t, w, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars FROM w),
a3 AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM (SELECT r, unnest(range(1, len(w) - 1)) AS i, array_to_string(w[i:i + 2], ' ') AS g FROM c)),
p3 AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM a3 WHERE k > 1) GROUP BY r),
{"".join(f"""a{n} AS (SELECT r, i, row_number() OVER (PARTITION BY r, g ORDER BY i) AS k FROM (SELECT r, unnest(range(1, len(w) - {n - 2})) AS i, array_to_string(w[i:i + {n - 1}], ' ') AS g FROM c)),
p{n} AS (SELECT r, sum(length(w[j])) AS m{n} FROM (SELECT DISTINCT r, unnest(range(i, i + {n})) AS j FROM a{n} WHERE k > 1) JOIN c USING (r) GROUP BY r),
""" for n in _GRAMS)}l AS (SELECT r, i, l, row_number() OVER (PARTITION BY r, l ORDER BY i) AS k FROM (SELECT r, unnest(string_split(t, chr(10))) AS l, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM c) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
q AS (SELECT r, count(*) AS n_dup_lines, sum(length(regexp_replace(l, '[\\x20\\x09-\\x0D]+', '', 'g'))) AS lc FROM l WHERE k > 1 GROUP BY r),
j AS (SELECT c.*, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(lc, 0) AS lc, {", ".join(f"coalesce(m{n}, 0) AS m{n}" for n in _GRAMS)}
  FROM c LEFT JOIN p3 USING (r) LEFT JOIN q USING (r) {" ".join(f"LEFT JOIN p{n} USING (r)" for n in _GRAMS)}),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM j)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND lc / greatest(word_chars, 1) <= {quality_rules.Rules().max_dup_line_chars} AND {" AND ".join(f"m{n} / greatest(word_chars, 1) <= {x}" for n, x in quality_rules.Rules().ngram_limits)} AS kept FROM b
"""

OP9_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, min(sqrt(list_reduce(list_transform(list_zip(q.e, v.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda x, y: x + y))) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 100 = 0 GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INT) AS rank, vec_id, score FROM p QUALIFY rank <= 10
"""


_SIMPLE = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SIMPLE} AS w FROM documents),
b AS (SELECT item_id, {_SIMPLE} AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS g FROM (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0)),
g AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS k, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS g FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n),
m AS (SELECT r, k, g.n, item_id FROM g JOIN i ON i.g = g.g AND i.n = g.n),
h AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS j FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""

OP13_SQL = """
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
n AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(t),
   'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)} AS x FROM w LEFT JOIN n USING (doc_id)),
fl AS (SELECT part, good, toxic, map(['A', 'B', 'C', 'D', 'E'], [x.A, x.B, x.C, x.D, x.E]) AS x FROM f),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
o AS (SELECT [a.l, b.l, c.l, d.l, e.l] AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
s AS (SELECT o, unnest(range(1, 6)) AS step FROM o),
r AS (SELECT part, array_to_string(o, '') AS filter_order, step, o[step] AS l, good, toxic, x[o[step]] AS fails, len(list_filter(o[1:step - 1], lambda y: x[y])) > 0 AS gone, len(list_filter(o, lambda y: x[y])) AS failed FROM s, fl),
a AS (SELECT part, filter_order, step, l, count(*) FILTER (NOT gone AND NOT fails) AS kept, count(*) FILTER (NOT gone AND fails) AS removed, count(*) FILTER (gone AND fails) AS redundant,
  count(*) FILTER (fails AND failed = 1) AS unique_fails, count(*) FILTER (NOT gone AND fails AND good = 1) AS good_lost, count(*) FILTER (NOT gone AND fails AND toxic = 1) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, l) AS BIGINT) AS shapley FROM a
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_chat": OP4_SQL, "op8_quality_rules": OP8_SQL, "op9_neighbours": OP9_SQL, "op10_jaccard": OP10_SQL, "op12_decontamination": OP12_SQL, "op13_filter_audit": OP13_SQL}
