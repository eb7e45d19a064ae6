"""A persisted inverted index: postings in blocks of documents, maintained by upserts and searched with pruning.

The index is a versioned table. Documents are dealt into shards by id; within a shard they stand in blocks of like length. A row
holds the postings of one term in one block: ids, weighted frequencies and lengths in arrays, with their number, sum of
lengths, greatest frequency and least length beside them. The empty term has every document, so counts of documents and
their mean length are read from it. An upsert rewrites the shards of the changed documents from their present postings and
the terms of the new texts alone. Documents are dealt by shard once, as whole rows of terms; postings are not dealt by themselves.

Search keeps the k best exactly. Bounds of what a term adds in a block follow from the block's greatest frequency and least length. A
question's rarest terms give first candidates, whose full scores give a threshold. Terms that together stay below the
threshold open no candidates. Candidates whose score so far and blocks' bounds stay below it are dropped, and only
the rest are completed. Unless the postings of the questions are very many, they are all added up, a shard in a task; the results are the same. Texts are not read at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import CJK
from ..sources.shared import written
from ..sources.tablelog import Table, Version
from . import containment, entities
from .retrieval import CANONICAL, EXACT, FIELD_WEIGHTS, SMALL, STABLE, join_small, question_terms, top_k

#: Names the form of stored rows; another one after a change of what terms or blocks mean.
FORMAT = 1
#: Identifiers without a number of their own, which the index can hold as terms (the words of ``entities.IDENTIFIER``).
NAMED = ("tritan", "ppsu", "pc", "pp", "304", "316")
#: A part of every text that ``entities.canonical_ids`` finds an id in.
MAY = "gb\\s*[/_]?\\s*t\\s*\\d{4}|gb\\s*[_ ]?\\s*4806|20\\d{2}\\s*[-_ ]?\\s*gbt|3486|1001"
#: Terms of a question that give the first candidates.
SEED_TERMS = 3
#: Postings of all questions together up to which adding all of them up, shard by shard, costs less than the passes that prune.
DIRECT = 30_000_000_000
#: Texts whose terms are found at once.
TEXTS = 256
#: Two scores closer than this count as one when something is pruned; ranks compare nine decimals.
SLACK = 1e-8


@dataclass(frozen=True)
class Layout:
    fields: tuple[str, ...] = ("content", "source")
    shards: int = 8
    block: int = 128


def squeezed_fields(fields: tuple[str, ...]) -> tuple[Column, Column, Column]:
    """What identifiers are looked for in: fields beside the content and the content without white space, and letters and digits of all."""
    other = [F.coalesce(f, F.lit("")) for f in fields if f != "content"]
    meta = F.lower(F.concat_ws(" ", *other)) if other else F.lit("")
    body = F.lower(F.coalesce("content", F.lit("")) if "content" in fields else F.lit(""))
    # what \\s stands for
    bare = lambda c: F.translate(c, " \t\n\x0b\f\r", "")
    return bare(meta), bare(body), F.regexp_replace(F.concat_ws(" ", meta, body), "[^a-z0-9]", "")


def _split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(place of the text, term): the terms of ``lexical_terms`` of many texts at once, with repeats."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    runs = pc.split_pattern_regex(texts, "[^A-Za-z0-9._/-]+")
    found = pc.ascii_lower(pc.utf8_ltrim(runs.flatten(), "._/-"))
    at, long = pc.list_parent_indices(runs).to_numpy(), pc.greater(pc.binary_length(found), 1)
    at, found = at[long.to_numpy(zero_copy_only=False)], found.filter(long)
    more_at, more = [], []
    for i in np.flatnonzero(pc.match_substring_regex(texts, "[\\x{4e00}-\\x{9fff}]").to_numpy(zero_copy_only=False)):
        for run in re.findall(f"[{CJK}]+", texts[i].as_py()):
            some = [*([run] if len(run) <= 8 else []), *(run[j : j + 2] for j in range(len(run) - 1))]
            more_at += [i] * len(some)
            more += some
    return np.concatenate([at, np.array(more_at, np.int64)]), pa.concat_arrays([found, pa.array(more, pa.large_string())])


def _weighed(fields: list[pa.Array], weights: list[float], marks: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(len, terms, tfs) of many documents: distinct terms of each field add up, marks have weight 0. Terms hold no line break, so one parts them."""
    n, at, found, field = len(marks), [], [], []
    for f, texts in enumerate(fields):
        where, some = _split(texts)
        at.append(where)
        found.append(some)
        field.append(np.full(len(where), f))
    at.append(pc.list_parent_indices(marks).to_numpy())
    found.append(marks.flatten().cast(pa.large_string()))
    field.append(np.full(len(found[-1]), len(fields)))
    coded = pa.concat_arrays(found).dictionary_encode()
    words = max(len(coded.dictionary), 1)
    key = np.concatenate(at) * words + coded.indices.to_numpy()
    # a term counts once a field
    once = np.unique(key * (len(fields) + 1) + np.concatenate(field))
    key, of = once // (len(fields) + 1), once % (len(fields) + 1)
    length = np.bincount(key[of < len(fields)] // words, minlength=n)
    key, start = np.unique(key, return_index=True)
    tf = np.add.reduceat(np.array([*weights, 0.0])[of], start) if len(start) else np.zeros(0)
    bounds = np.searchsorted(key // words, np.arange(n + 1))
    listed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), coded.dictionary.cast(pa.string()).take(pa.array(key % words)))
    return pa.array(length, pa.int32()), pc.binary_join(listed, "\n"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(tf))


def terms(docs: DataFrame, layout: Layout, id_col: str = "doc_id") -> DataFrame:
    """(id, len, terms, tfs) of every document: its terms, named identifiers as marked terms of weight 0, and the empty term, in one text by lines."""
    other = [f for f in layout.fields if f != "content"]
    meta, body, _ = squeezed_fields(layout.fields)
    whole = F.concat_ws(" ", F.lower(F.concat_ws(" ", *[F.coalesce(f, F.lit("")) for f in other])), F.lower(F.coalesce("content", F.lit(""))))
    # every pattern of an id holds one of these, and a part of this shape
    may = F.contains("__whole", F.lit("gb")) | F.contains("__whole", F.lit("3486")) | F.contains("__whole", F.lit("1001"))
    ids = F.when(may & F.col("__whole").rlike(MAY), F.transform(entities.canonical_ids(F.col("__whole")), lambda x: F.concat(F.lit(CANONICAL), x))).otherwise(F.array().cast("array<string>"))
    read = docs.select("*", F.lower(whole).alias("__whole"))
    fields = [f for f in layout.fields if f == "content"] + other
    parts = read.select(F.col(id_col).alias("id"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)], meta.alias("m"), body.alias("b"), ids.alias("c"))
    # one test a name, not a function over names: in that, the columns of squeezed text would be computed anew for each
    named = F.array_compact(F.array(*[F.when(F.contains("m", F.lit(x)) | F.contains("b", F.lit(x)), EXACT + x) for x in NAMED]))
    rows = parts.select("id", *[f"f{i}" for i in range(len(fields))], F.concat(F.array(F.lit("")), "c", named).alias("marks"))
    weights = [FIELD_WEIGHTS["content"] if f == "content" else FIELD_WEIGHTS.get(f, 0.0) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), TEXTS):
                ids, *texts, marks = batch.slice(i, TEXTS).columns
                yield pa.RecordBatch.from_arrays([ids, *_weighed(texts, weights, marks)], ["id", "len", "terms", "tfs"])

    return rows.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, len int, terms string, tfs array<double>")


def shard_of(layout: Layout, key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(layout.shards)).cast("int")


def _schema(id_type: str) -> str:
    return f"shard int, block int, term string, n int, max_tf double, min_len int, sum_len long, ids array<{id_type}>, tfs array<double>, lens array<int>"


def _rows(shard: int, block: np.ndarray, ids: pa.Array, lens: np.ndarray, at: np.ndarray, found: pa.Array, tfs: np.ndarray, names: list[str]) -> pa.Table:
    """Rows of the index of a shard's documents, which are given in order of ids, and of their postings (place of the document, term, tf)."""
    coded = found.dictionary_encode()
    word = coded.indices.to_numpy()
    order = np.lexsort((at, block[at], word))
    at, word, tfs = at[order], word[order], tfs[order]
    of, length = block[at], lens[at]
    start = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (of[1:] != of[:-1])]) if len(at) else np.zeros(0, np.int64)
    bounds = pa.array(np.r_[start, len(at)], pa.int32())
    each = lambda f, x: f.reduceat(x, start) if len(start) else x
    columns = [
        pa.array(np.full(len(start), shard), pa.int32()), pa.array(of[start], pa.int32()), coded.dictionary.take(pa.array(word[start])), pa.array(np.diff(np.r_[start, len(at)]), pa.int32()),
        pa.array(each(np.maximum, tfs), pa.float64()), pa.array(each(np.minimum, length), pa.int32()), pa.array(each(np.add, length.astype(np.int64)), pa.int64()),
        pa.ListArray.from_arrays(bounds, ids.take(pa.array(at))), pa.ListArray.from_arrays(bounds, pa.array(tfs)), pa.ListArray.from_arrays(bounds, pa.array(length, pa.int32())),
    ]
    return pa.Table.from_arrays(columns, names)


def _one(column: pa.ChunkedArray) -> pa.Array:
    out = column.combine_chunks()
    return pa.concat_arrays(out.chunks) if isinstance(out, pa.ChunkedArray) else out


def _postings(docs: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(place of the document, term, tf) of the documents of ``terms``."""
    found = pc.split_pattern(_one(docs["terms"]), "\n")
    return pc.list_parent_indices(found).to_numpy(), found.flatten(), _one(docs["tfs"]).flatten().to_numpy()


def blocks(docs: DataFrame, layout: Layout) -> DataFrame:
    """Postings by term and block from (id, len, terms, tfs). A shard's documents are numbered by length; a shard is a bounded number of documents.

    Documents are dealt once, by shard; a block's postings are put by terms where its documents are.
    """
    place = (F.row_number().over(W.partitionBy("shard").orderBy("len", "id")) - 1) / layout.block
    at = docs.withColumn("shard", shard_of(layout, F.col("id"))).withColumn("block", place.cast("int"))
    names = [f.split(" ")[0] for f in _schema("").split(", ")]

    def turn(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        lens = rows["len"].to_numpy()
        return _rows(key[0].as_py(), np.full(len(lens), key[1].as_py()), _one(rows["id"]), lens, *_postings(rows), names)

    return at.groupBy("shard", "block").applyInArrow(turn, _schema(dict(docs.dtypes)["id"]))


def changed(present: DataFrame, changes: DataFrame, layout: Layout) -> DataFrame:
    """The rows of shards after ``changes`` (id, shard, len, terms, tfs; null terms: only gone), from their present ones. A task holds one shard."""
    names = [f.split(" ")[0] for f in _schema("").split(", ")]

    def turn(key: tuple, old: pa.Table, new: pa.Table) -> pa.Table:
        ids, lens, tfs = (_one(old[c]).flatten() for c in ("ids", "lens", "tfs"))
        whole = old.filter(pc.equal(old["term"], ""))
        known = _one(whole["ids"]).flatten()
        found = _one(old["term"]).dictionary_encode().take(pc.list_parent_indices(_one(old["ids"]))).dictionary_decode()
        stays = pc.invert(pc.is_in(ids, value_set=_one(new["id"])))
        ids, tfs, found = (x.filter(stays) for x in (ids, tfs, found))
        new = new.filter(pc.is_valid(new["terms"]))
        at, more, weights = _postings(new)
        added = pa.array(at)
        ids = pa.concat_arrays([ids, _one(new["id"]).take(added)])
        found, tfs = pa.concat_arrays([found, more]), np.concatenate([tfs.to_numpy(), weights])
        every = pc.unique(ids)
        every = every.take(pc.sort_indices(every))
        at = pc.index_in(ids, value_set=every).to_numpy()
        length = np.zeros(len(every), np.int64)
        for some, long in ((known, lens), (_one(new["id"]), _one(new["len"]))):
            place = pc.index_in(some, value_set=every)
            here = place.is_valid().to_numpy(zero_copy_only=False)
            length[place.drop_null().to_numpy()] = long.to_numpy(zero_copy_only=False)[here]
        block = np.empty(len(every), np.int64)
        # in order of ids already, so a stable order by length is one by both
        block[np.argsort(length, kind="stable")] = np.arange(len(every)) // layout.block
        return _rows(key[0].as_py(), block, every, length, at, found, tfs, names)

    kind = dict(changes.dtypes)["id"]
    # lengths are sent once a document, with the empty term
    present = present.select("shard", "term", "ids", "tfs", F.when(F.col("term") == "", F.col("lens")).alias("lens"))
    return present.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(turn, _schema(kind))


class Index:
    """An index at a path. ``shards`` should grow with the documents: some ten thousand of them a shard."""

    def __init__(self, spark: SparkSession, path: str, layout: Layout = Layout()):
        self.spark, self.layout = spark, layout
        self.table = Table(spark, path, "shard", layout.shards)

    def build(self, docs: DataFrame, id_col: str = "doc_id") -> Version:
        """Index all of ``docs`` (one row an id, not null) anew."""
        n = self.spark.sparkContext.defaultParallelism
        # a small table may be stored in fewer splits than there are cores
        dealt = docs if docs.rdd.getNumPartitions() >= n else docs.repartition(n)
        return self.table.replace(blocks(terms(dealt, self.layout, id_col), self.layout).sortWithinPartitions("shard", "term", "block"), bucket=F.col("shard"), dealt=True)

    def upsert(self, changes: DataFrame, deleted: Column | None = None, id_col: str = "doc_id", batch: tuple[str, int] | None = None) -> Version:
        """Documents of the ids in ``changes`` are replaced by its rows; where ``deleted`` holds they only go."""
        gone = F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))
        marked = changes.withColumn("__gone", gone)
        new = terms(marked.where("NOT __gone"), self.layout, id_col).unionByName(marked.where("__gone").select(F.col(id_col).alias("id")), allowMissingColumns=True)
        new = written(new.withColumn("shard", shard_of(self.layout, F.col("id"))), "terms")
        # at most ``shards`` rows
        touched = [r.shard for r in new.select("shard").distinct().collect()]

        def change(present: DataFrame) -> DataFrame:
            return changed(present, new, self.layout).sortWithinPartitions("shard", "term", "block")

        return self.table.rewrite(change, touched, bucket=F.col("shard"), batch=batch, dealt=True)

    def search(self, questions: DataFrame, k: int, docs: DataFrame | None = None, id_col: str = "doc_id", version: int | None = None) -> DataFrame:
        """(question_id, id, score, rank): the k best documents a question by BM25 and identifiers; ties to the smaller id.

        Numbered identifiers may be any text, so no term stands for them. If a question names one, ``docs`` are read for it once, by an automaton.
        """
        asked = written(question_terms(questions), "asked")
        rows = self.table.read(version)
        rows = rows.where("term IS NOT NULL")
        heads = ["shard", "block", "term", "n", "max_tf", "min_len", "sum_len"]
        vocabulary = asked.select("term").union(self.spark.range(1).select(F.lit(""))).distinct()
        few = join_small(rows, vocabulary, ["term"])
        # all that is read of the index: rows of the asked terms
        held = written(few.select(*heads, "ids", "tfs", "lens").unionByName(self._open(asked, docs, id_col, few)), "held")
        return _best(held, heads, asked, k, id_col)

    def _open(self, asked: DataFrame, docs: DataFrame | None, id_col: str, held: DataFrame) -> DataFrame:
        """Postings of the asked identifiers that the index has no terms for."""
        numbered = asked.where("bonus IS NOT NULL").where(F.col("term").startswith(EXACT) | F.col("term").startswith(STABLE)).where(~F.col("term").isin([EXACT + n for n in NAMED])).select("term").distinct()
        none = held.where("false")
        if docs is None or numbered.isEmpty():
            return none
        meta, body, letters = squeezed_fields(self.layout.fields)
        text = docs.select(F.col(id_col).alias("id"), meta.alias("m"), body.alias("b"), letters.alias("c"))
        value = F.substring(F.col("term"), F.lit(2), F.length("term"))
        exact, stable = (numbered.where(F.col("term").startswith(mark)).select(value.alias("pattern")) for mark in (EXACT, STABLE))
        found = containment.occurrences(text, "id", ["m", "b"], exact).select("id", F.concat(F.lit(EXACT), "pattern").alias("term"))
        found = found.union(containment.occurrences(text, "id", ["c"], stable).select("id", F.concat(F.lit(STABLE), "pattern").alias("term"))).distinct()
        at = held.where("term = ''").select("shard", "block", F.explode(F.arrays_zip("ids", "lens")).alias("x")).select("shard", "block", F.col("x.ids").alias("id"), F.col("x.lens").alias("len"))
        met = found.join(at, "id").groupBy("shard", "block", "term").agg(F.sort_array(F.collect_list(F.struct("id", "len"))).alias("p"))
        zero = F.transform("p", lambda x: F.lit(0.0))
        return met.select("shard", "block", "term", F.size("p").alias("n"), F.lit(0.0).alias("max_tf"), F.array_min(F.transform("p", lambda x: x["len"])).alias("min_len"), F.lit(0).cast("long").alias("sum_len"), F.transform("p", lambda x: x["id"]).alias("ids"), zero.alias("tfs"), F.transform("p", lambda x: x["len"]).alias("lens")).unionByName(none)


def _part(tf: Column, length: Column) -> Column:
    """What a term adds to a document's score; grows with tf and falls with the length."""
    return F.coalesce("bonus", F.when(tf > 0, F.col("idf") * 2.5 * tf / (tf + 1.5 * (0.25 + 0.75 * length / F.col("avg_len")))).otherwise(0.0))


def _each(pairs: DataFrame, id_col: str) -> DataFrame:
    """A row a posting, with what it adds."""
    each = pairs.select("question_id", "shard", "block", "bonus", "idf", "avg_len", F.explode(F.arrays_zip("ids", "tfs", "lens")).alias("x"))
    return each.select("question_id", "shard", "block", F.col("x.ids").alias(id_col), _part(F.col("x.tfs"), F.col("x.lens")).alias("part"))


def _added(held: DataFrame, known: DataFrame, k: int, id_col: str) -> DataFrame:
    """(question_id, id, score): the k best of each shard a question, with all its postings added up. A task holds the asked postings of one shard."""
    asked = known.select("question_id", "term", "bonus", "idf", "avg_len").orderBy("question_id", "term").toArrow()
    words = pc.unique(_one(asked["term"]))
    ask = [pc.index_in(_one(asked["term"]), value_set=words).to_numpy(), *[pc.fill_null(_one(asked[c]), np.nan).to_numpy() for c in ("bonus", "idf")]]
    new = pc.not_equal(_one(asked["question_id"])[1:], _one(asked["question_id"])[:-1]).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.r_[True, new]) if len(asked) else np.zeros(0, np.int64)
    mean = asked["avg_len"][0].as_py() if len(asked) else 1.0
    sent = held.sparkSession.sparkContext.broadcast((words, ask, np.r_[first, len(asked)], _one(asked["question_id"]).take(pa.array(first))))

    def turn(key: tuple, rows: pa.Table) -> pa.Table:
        words, (word, bonus, idf), bounds, questions = sent.value
        rows = rows.append_column("w", pc.index_in(rows["term"], value_set=words)).sort_by("w")
        # where the postings of each word begin
        ends = np.r_[0, np.cumsum(pc.list_value_length(_one(rows["ids"])).to_numpy())]
        begin = ends[np.searchsorted(rows["w"].to_numpy(), np.arange(len(words) + 1))]
        ids, tf, length = (_one(rows[c]).flatten() for c in ("ids", "tfs", "lens"))
        every = pc.unique(ids)
        every = every.take(pc.sort_indices(every))
        at, tf = pc.index_in(ids, value_set=every).to_numpy(), tf.to_numpy()
        value = np.where(tf > 0, 2.5 * tf / np.where(tf > 0, tf + 1.5 * (0.25 + 0.75 * length.to_numpy() / mean), 1.0), 0.0)
        q, d, score = [], [], []
        for i in range(len(questions)):
            total = np.zeros(len(every))
            for j in range(bounds[i], bounds[i + 1]):
                a, b = begin[word[j]], begin[word[j] + 1]
                # a document is once among the postings of a word
                total[at[a:b]] += idf[j] * value[a:b] if np.isnan(bonus[j]) else bonus[j]
            hit = np.flatnonzero(total > 0)
            near = np.round(total[hit], 9)
            if len(hit) > k:
                best = near >= np.partition(near, len(hit) - k)[len(hit) - k]
                hit, near = hit[best], near[best]
            hit = hit[np.lexsort((hit, -near))[:k]]
            q.append(np.full(len(hit), i))
            d.append(hit)
            score.append(total[hit])
        q, d, score = (np.concatenate([np.zeros(0, t), *x]) for x, t in ((q, np.int64), (d, np.int64), (score, np.float64)))
        return pa.Table.from_arrays([questions.take(pa.array(q)), every.take(pa.array(d)), pa.array(score)], ["question_id", id_col, "score"])

    kinds = dict(known.dtypes)["question_id"], dict(held.dtypes)["ids"][len("array<") : -1]
    return held.where("term <> ''").select("shard", "term", "ids", "tfs", "lens").groupBy("shard").applyInArrow(turn, f"question_id {kinds[0]}, {id_col} {kinds[1]}, score double")


def _best(held: DataFrame, heads: list[str], asked: DataFrame, k: int, id_col: str) -> DataFrame:
    header = held.select(*heads)
    counted = header.groupBy("term").agg(F.sum("n").alias("df"), F.sum("sum_len").alias("total"), F.max("max_tf").alias("most_tf"), F.min("min_len").alias("least_len"))
    whole = counted.where("term = ''").select(F.col("df").alias("n_docs"), F.greatest(F.col("total") / F.col("df"), F.lit(1.0)).alias("avg_len"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # one row on the right
    known = asked.join(counted.where("term <> ''"), "term").join(F.broadcast(whole), F.lit(True)).withColumn("idf", idf)
    known = known.withColumn("bound", _part(F.col("most_tf"), F.col("least_len"))).select("question_id", "term", "bonus", "idf", "avg_len", "bound", "df")
    by_rarity = W.partitionBy("question_id").orderBy(F.desc("bound"), "df", "term")
    after = W.partitionBy("question_id").orderBy(F.asc("bound"), F.desc("df"), F.desc("term")).rowsBetween(W.unboundedPreceding, 0)
    known = written(known.withColumn("nth", F.row_number().over(by_rarity)).withColumn("upto", F.sum("bound").over(after)), "known")

    def scores(pairs: DataFrame) -> DataFrame:
        return _each(pairs, id_col).groupBy("question_id", "shard", "block", id_col).agg(F.sum("part").alias("score"))

    key = ["question_id", "shard", "block", id_col]
    size = known.agg(F.sum("df").alias("postings"), F.count("*").alias("terms")).collect()[0]
    if (size.postings or 0) <= DIRECT and size.terms <= SMALL:
        return top_k(_added(held, known, k, id_col), ["question_id"], [F.desc(F.round("score", 9)), F.col(id_col)], k)
    # 1. the best documents by the rarest terms, and their full scores
    seeds = top_k(scores(join_small(held, known.where(F.col("nth") <= SEED_TERMS), ["term"])), ["question_id"], [F.desc("score"), F.col(id_col)], k).select(*key)
    near = written(join_small(seeds, known, ["question_id"]), "seeds")
    full = near.join(held, ["term", "shard", "block"]).withColumn("at", F.array_position("ids", F.col(id_col)).cast("int")).where("at > 0")
    part = _part(F.get("tfs", F.col("at") - 1), F.get("lens", F.col("at") - 1))
    exact = full.select(*key, part.alias("part")).groupBy(*key).agg(F.sum("part").alias("score"))
    ranked = exact.withColumn("r", F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("score"))))
    threshold = ranked.where(F.col("r") == k).select("question_id", (F.col("score") - SLACK).alias("least"))
    # 2. terms that can't lift a document to the threshold by themselves open no candidates
    judged = written(join_small(known, threshold, ["question_id"], "left").withColumn("opens", F.col("least").isNull() | (F.col("upto") >= F.col("least"))), "judged")
    opening = written(scores(join_small(held, judged.where("opens"), ["term"])), "opening")
    # 3. what the other terms may add, block by block
    rest = judged.where("NOT opens")
    may = join_small(header, rest, ["term"]).groupBy("question_id", "shard", "block").agg(F.sum(_part(F.col("max_tf"), F.col("min_len"))).alias("may"))
    open_ = join_small(join_small(opening, threshold, ["question_id"], "left"), may, ["question_id", "shard", "block"], "left")
    alive = written(open_.where(F.col("least").isNull() | (F.col("score") + F.coalesce("may", F.lit(0.0)) >= F.col("least"))).select(*key, "score"), "alive")
    # 4. the survivors are completed
    wanted = alive.select("question_id", "shard", "block").distinct()
    pairs = join_small(held, rest, ["term"]).join(wanted, ["question_id", "shard", "block"], "left_semi")
    added = _each(pairs, id_col).join(alive.select(*key), key, "left_semi").groupBy(*key).agg(F.sum("part").alias("more"))
    total = alive.join(added, key, "left").select("question_id", id_col, (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score")).where("score > 0")
    return top_k(total, ["question_id"], [F.desc(F.round("score", 9)), F.col(id_col)], k)
