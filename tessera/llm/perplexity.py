"""Quality classifier: interpolated modified Kneser-Ney n-gram model of characters, trained on trusted text.

Trigrams are counted over every trusted text, shard by shard, and joined on shared contexts into shares of the
n-grams and weights of the contexts. Symbols are all code points and a text boundary, so the tables grow with the
trusted text; nothing collects them. They stay in the shared folder as shards sorted by n-gram, and scoring looks up
the distinct trigrams of each slice of text in the shards that hold them. Perplexity is per character. A document is
rejected when its log perplexity lies beyond a fence of its language's quantiles, taken over all documents.

Code points that no trusted text holds share the mass that the unigrams leave. Null and empty texts score the
boundary alone, have 0 characters and are kept: the length rules judge them. Null languages form a language of their
own; languages with few documents use the quantiles of all. Ties at the fence are kept. Repeated rows score alike.
Extra columns of any name pass through ``reject`` untouched. Without trusted text every text has perplexity ``alphabet`` and
nothing is rejected.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import arrow_path, discard, fresh_path, join_small, materialise

SLICE_CHARS = 1 << 18
#: A symbol is 0, the boundary, or a code point plus one; an n-gram packs symbols of this many bits.
BITS = 21
#: Rows of a shard of a table.
SHARD_ROWS = 1 << 18
#: Tables: shares of trigrams, bigrams and unigrams, and what bigrams and unigrams as contexts leave to lower orders.
OWN3, BACK3, OWN2, BACK2, OWN1 = range(5)


@dataclass(frozen=True)
class Settings:
    #: Symbols that the mass left by the unigrams is spread over, where fewer are seen; seen ones are never dropped.
    alphabet: int = 128
    #: Reject beyond the median plus this many times the spread between the median and the upper quantile ...
    upper: float = 0.75
    fence: float = 6.0
    #: ... but never below this distance in nats above the median.
    least_gap: float = 0.35
    #: A text of n characters may exceed the fence by this over the root of n: means of few characters scatter more.
    short_slack: float = 4.0
    min_documents: int = 50


@lru_cache(32)
def _shard(path: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted n-grams of a shard and their values, mapped, not loaded, where the shared folder is a local path."""
    system, name = arrow_path(path)
    if isinstance(system, fs.LocalFileSystem):
        raw = np.memmap(name, np.int64, "r")
    else:
        with system.open_input_file(name) as f:
            raw = np.frombuffer(f.read(), np.int64)
    return raw[:n], raw[n:].view(np.float64)


@dataclass(frozen=True)
class Model:
    """``shards``: (first n-gram, path, rows) of each table's shards in order; ``size`` symbols, seen and unseen;
    ``floor``: probability of an unseen symbol."""

    shards: tuple[tuple[tuple[int, str, int], ...], ...]
    size: int
    floor: float

    def find(self, table: int, grams: np.ndarray, default: float) -> np.ndarray:
        """The values of n-grams; ``default`` where the table has none."""
        out = np.full(len(grams), default)
        shards = self.shards[table]
        of = np.searchsorted(np.array([s[0] for s in shards], np.int64), grams, "right") - 1
        for k in np.unique(of[of >= 0]).tolist():
            keys, values = _shard(*shards[k][1:])
            mine = np.flatnonzero(of == k)
            at = np.minimum(np.searchsorted(keys, grams[mine]), len(keys) - 1)
            hit = keys[at] == grams[mine]
            out[mine[hit]] = values[at[hit]]
        return out

    def log_p(self, grams: np.ndarray) -> np.ndarray:
        """Natural log of P(c0 | c2 c1) of packed trigrams."""
        one, two = (1 << BITS) - 1, (1 << 2 * BITS) - 1
        p = self.find(OWN1, grams & one, 0.0) + self.floor
        p = self.find(OWN2, grams & two, 0.0) + self.find(BACK2, (grams & two) >> BITS, 1.0) * p
        p = self.find(OWN3, grams, 0.0) + self.find(BACK3, grams >> BITS, 1.0) * p
        return np.log(np.maximum(p, 1e-12))

    @property
    def logp(self) -> np.ndarray:
        """The dense table [c2, c1, c0] of a small model: seen symbols, then unseen ones."""
        seen = [_shard(*s[1:])[0] for s in self.shards[OWN1]]
        c = np.concatenate([*seen, np.arange(self.size) + 0x110001]).astype(np.int64)[: self.size]
        grams = (((c[:, None, None] << BITS) | c[:, None]) << BITS) | c
        return self.log_p(grams.ravel()).reshape(grams.shape)


def trusted_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts of all rows labelled good. Up to a million ids are sent to the texts; beyond, both sides are dealt by id."""
    ids = materialise(labels.where("quality = 1").select("doc_id").distinct(), "trusted_ids")
    return join_small(docs.select("doc_id", "text"), ids, ["doc_id"], "left_semi").select("text")


def _encode(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts, each after two boundaries and before one; the bounds of the texts in them."""
    joined = "\0\0" + "\0\0\0".join(t or "" for t in texts) + "\0"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    bounds = np.concatenate([[0], np.cumsum([len(t or "") + 3 for t in texts])])
    for k in (0, 1):
        code[bounds[:-1] + k] = 0
    code[bounds[1:] - 1] = 0
    return code, bounds


def _pack(code: np.ndarray) -> np.ndarray:
    return (((code[:-2] << BITS) | code[1:-1]) << BITS) | code[2:]


def _chunks(column: pa.Array) -> Iterator[list]:
    part, size = [], 0
    for t in column.to_pylist():
        part.append(t)
        size += len(t or "") + 3
        if size >= SLICE_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def train(texts: DataFrame, cfg: Settings = Settings()) -> Model:
    """Count trigrams of symbols in shards and join them into the tables of the Kneser-Ney model."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch.column(0)):
                code, bounds = _encode(part)
                inside = np.ones(len(code), bool)
                inside[bounds[1:-1] - 1] = False
                inside[bounds[1:-1] - 2] = False
                g, n = np.unique(_pack(code)[inside[:-2]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n)], ["g", "n"])

    tri = materialise(texts.mapInArrow(grams, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")), "trigrams")
    return _tables(tri, cfg)


def _discounts(counts: DataFrame) -> list[F.Column]:
    """Modified Kneser-Ney discounts D1, D2, D3+ from the counts of counts (four numbers)."""
    row = counts.agg(*[F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]).collect()[0]
    n1, n2, n3, n4 = (max(x, 1) for x in row)
    y = n1 / (n1 + 2 * n2)
    d = [min(max(x, 0.1), m - 0.1) for x, m in ((1 - 2 * y * n2 / n1, 1), (2 - 3 * y * n3 / n2, 2), (3 - 4 * y * n4 / n3, 3))]
    return F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])


def _order(counts: DataFrame, context: str) -> tuple[DataFrame, DataFrame]:
    """(g, own): discounted share of each n-gram; (context, back): the mass left for the lower order."""
    cut = counts.withColumn("cut", _discounts(counts))
    total = cut.groupBy(context).agg(F.sum("n").alias("total"), F.sum("cut").alias("left"))
    own = cut.join(total, context).select("g", ((F.col("n") - F.col("cut")) / F.col("total")).alias("own"))
    return own, total.select(context, (F.col("left") / F.col("total")).alias("back"))


def _tables(tri: DataFrame, cfg: Settings) -> Model:
    """Sharded count joins: continuation counts and contexts are keyed by the packed n-gram."""
    own3, back3 = _order(tri.withColumn("h", F.expr(f"shiftright(g, {BITS})")), "h")
    two = materialise(tri.groupBy(F.expr(f"g & {(1 << 2 * BITS) - 1}L").alias("g")).agg(F.count("*").alias("n")), "bigrams")
    own2, back2 = _order(two.withColumn("h", F.expr(f"shiftright(g, {BITS})")), "h")
    one = two.groupBy(F.expr(f"g & {(1 << BITS) - 1}L").alias("g")).agg(F.count("*").alias("n"))
    seen, total = one.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).collect()[0]
    own1 = one.select("g", ((F.col("n") - 0.5) / max(total, 1)).alias("x"))
    rows = None
    for kind, t in ((OWN3, own3), (BACK3, back3), (OWN2, own2), (BACK2, back2), (OWN1, own1)):
        t = t.toDF("g", "x").select(F.lit(kind).alias("kind"), "g", F.col("x").cast("double"))
        rows = t if rows is None else rows.union(t)
    size = max(cfg.alphabet, seen + 1)
    model = Model(_write(rows), size, (0.5 * seen / total if total else 1.0) / size)
    discard(tri, two)
    return model


def _write(rows: DataFrame) -> tuple[tuple[tuple[int, str, int], ...], ...]:
    """(kind, g, x) as sorted shards in the shared folder; each file holds all n-grams, then all values."""
    folder = fresh_path(rows.sparkSession, "model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = arrow_path(folder)
        system.create_dir(root, recursive=True)

        def put(kind: int, g: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            name = uuid.uuid4().hex
            with system.open_output_stream(f"{root}/{name}") as sink:
                sink.write(g.tobytes() + x.tobytes())
            return pa.RecordBatch.from_pydict({"kind": [kind], "first": [int(g[0])], "path": [f"{folder}/{name}"], "n": [len(g)]})

        held: list[tuple[np.ndarray, ...]] = []

        def empty_out() -> Iterator[pa.RecordBatch]:
            if held:
                kind, g, x = (np.concatenate(c) for c in zip(*held))
                held.clear()
                for k in np.unique(kind).tolist():
                    yield put(k, g[kind == k], x[kind == k])

        for batch in batches:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            if sum(len(h[0]) for h in held) >= SHARD_ROWS:
                yield from empty_out()
        yield from empty_out()

    written = rows.repartitionByRange("kind", "g").sortWithinPartitions("kind", "g").mapInArrow(run, "kind long, first long, path string, n long").collect()
    return tuple(tuple(sorted((r["first"], r["path"], r["n"]) for r in written if r["kind"] == k)) for k in range(5))


def log_perplexity(texts: list, model: Model) -> np.ndarray:
    """Mean negative log probability a character (the closing boundary counts) of each text."""
    code, bounds = _encode(texts)
    at, grams = pd.factorize(_pack(code))
    lp = np.zeros(len(code))
    lp[2:] = model.log_p(grams)[at]
    lp[bounds[:-1]] = 0
    lp[bounds[:-1] + 1] = 0
    total = np.concatenate([[0], np.cumsum(lp)])
    return -(total[bounds[1:]] - total[bounds[:-1]]) / (np.diff(bounds) - 2)


def score(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """(row, n_chars_scored, log_ppl): ``columns`` of docs as one struct, so that their names clash with nothing."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select(F.struct(*columns).alias("row"), *([] if "text" in columns else ["text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            at = 0
            for texts in _chunks(rows.field("text") if "text" in columns else batch.column(1)):
                part = rows.slice(at, len(texts))
                at += len(texts)
                size = pa.array([len(t or "") for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part, size, pa.array(log_perplexity(texts, known.value))], ["row", "n_chars_scored", "log_ppl"])

    schema = StructType([given.schema["row"], StructField("n_chars_scored", LongType()), StructField("log_ppl", DoubleType())])
    return given.mapInArrow(run, schema)


def fences(scores: DataFrame, cfg: Settings) -> DataFrame:
    """(lang, limit): each language's limit on log_ppl from quantiles over all its documents; ``scores`` has row.lang."""
    q = F.percentile_approx("log_ppl", [0.5, cfg.upper], 10_000).alias("q")
    full = scores.where("n_chars_scored > 0").select(F.col("row.lang").alias("lang"), "log_ppl")
    limit = F.col("q")[0] + F.greatest(F.lit(cfg.least_gap), cfg.fence * (F.col("q")[1] - F.col("q")[0]))
    whole = full.agg(q).select(limit.alias("all_limit"))
    by = full.groupBy("lang").agg(q, F.count("*").alias("n")).select("lang", "n", limit.alias("limit"))
    # one row on the right: the quantiles of all documents
    fenced = by.join(F.broadcast(whole), F.lit(True), "left").select("lang", F.when(F.col("n") >= cfg.min_documents, F.col("limit")).otherwise(F.col("all_limit")).alias("limit"))
    return materialise(fenced, "fences")


def verdicts(scores: DataFrame, limits: DataFrame, cfg: Settings) -> DataFrame:
    """``scores`` with limit and kept; one row a language is sent to them."""
    judged = join_small(scores, limits, F.col("row.lang").eqNullSafe(F.col("lang"))).drop("lang")
    return judged.withColumn("kept", F.coalesce(F.col("log_ppl") <= F.col("limit") + cfg.short_slack / F.sqrt(F.col("n_chars_scored") + 1), F.lit(True)) | (F.col("n_chars_scored") == 0))


def reject(docs: DataFrame, model: Model, cfg: Settings = Settings()) -> DataFrame:
    """The documents within their language's fence, with all their columns; they are not shuffled.

    Slim scores of all documents give the fences; a second pass scores each document where it is read.
    """
    slim = materialise(score(docs, model, ["lang"]), "scores")
    limits = fences(slim, cfg)
    discard(slim)
    return verdicts(score(docs, model, docs.columns), limits, cfg).where("kept").select("row.*")
