"""Toxicity: a factorization machine over hashed terms.

Terms are lower-cased words without surrounding punctuation, hashed. On a bounded sample of labelled rows, terms that go with the
label (z score of their share among toxic texts), alone or with another frequent term, become features; the machine learns a weight and a factor
vector each, so pairs such as an insult with a mention of a group score beyond the sum of their weights. The
model is small and bounded by its parameters; scoring reads every text whole, where it is stored.

Null and empty texts have no terms and score the bias. Repeated rows score alike. Texts of any length are scored by
which features they hold, so clean words do not dilute them. Extra columns are ignored. An empty table gives an
empty result; without labelled rows of both kinds every score is the share of toxic rows (0 without rows).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .textscan import U, Slice, slices


@dataclass(frozen=True)
class Settings:
    #: Bounds on the distinct labelled rows of each kind that the model is fitted on, and on the bytes of their texts.
    max_toxic: int = 8_000
    max_clean: int = 16_000
    max_bytes: int = 128 << 20
    hash_bits: int = 22
    min_z: float = 4.0
    min_toxic_rows: int = 4
    #: Pairs of these most frequent terms are looked at too, so that terms count that tell something only together.
    pair_terms: int = 2_048
    pair_z: float = 8.0
    factors: int = 8
    epochs: int = 40
    rate: float = 0.1
    l2: float = 1e-4


@dataclass(frozen=True)
class Model:
    """``slots``: sorted hashed terms; ``w``, ``v``: their weights and factors; ``bias``."""

    slots: np.ndarray
    w: np.ndarray
    v: np.ndarray
    bias: float

    def score(self, rows: np.ndarray, feats: np.ndarray, n: int) -> np.ndarray:
        """Probabilities of n texts from their distinct (row, feature) pairs."""
        z = np.full(n, self.bias) + np.bincount(rows, weights=self.w[feats], minlength=n)
        for k in range(self.v.shape[1]):
            x = self.v[feats, k]
            s = np.bincount(rows, weights=x, minlength=n)
            z += 0.5 * (s * s - np.bincount(rows, weights=x * x, minlength=n))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


_EDGE = np.zeros(256, bool)
_EDGE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def terms(s: Slice, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, hashed term) pairs of a slice; ASCII punctuation around a word is not part of its term."""
    # the next offset with another character, and the end of the last one before
    n = len(s.data)
    at = np.arange(n)
    inner = ~_EDGE[s.data]
    following = np.minimum.accumulate(np.where(inner, at, n)[::-1])[::-1]
    preceding = np.maximum.accumulate(np.where(inner, at + 1, 0))
    starts = np.minimum(following[s.starts], s.ends)
    ends = np.maximum(preceding[s.ends - 1], starts)
    h = (s.span_hash(starts, ends) >> U(64 - bits)).astype(np.int64)
    key = np.unique((s.word_text()[ends > starts] << bits) | h[ends > starts])
    return key >> bits, key & ((1 << bits) - 1)


def labelled_rows(docs: DataFrame, labels: DataFrame, cfg: Settings) -> DataFrame:
    """(text, toxic) of the bounded training sample: never rows held out.

    Rows are drawn, not ids: each distinct id and text with its labels once, in the order of a hash within each kind, as many as both bounds allow.
    """
    known = labels.where("toxic IN (0, 1)").where("coalesce(crc32(cast(doc_id as string)), 0) % 3 <> 1").select("doc_id", "toxic").distinct()
    body = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    digest = F.sha2("text", 256)
    slim = body.select("doc_id", digest.alias("h"), F.octet_length("text").cast("long").alias("size")).distinct().join(known, "doc_id")
    before = W.orderBy("z", "doc_id", "h").rowsBetween(W.unboundedPreceding, 0)
    kinds = []
    for kind, most in ((1, cfg.max_toxic), (0, cfg.max_clean)):
        drawn = slim.where(F.col("toxic") == kind).withColumn("z", F.xxhash64("h", "doc_id")).orderBy("z", "doc_id", "h").limit(most)
        # the limit bounds the rows of this window
        kinds.append(drawn.withColumn("upto", F.sum("size").over(before)).where(F.col("upto") <= cfg.max_bytes).select("doc_id", "h", "toxic"))
    # at most max_toxic + max_clean rows; a row that is repeated comes back once
    picked = body.withColumn("h", digest).join(F.broadcast(kinds[0].union(kinds[1])), ["doc_id", "h"])
    return picked.groupBy("doc_id", "h", "toxic").agg(F.first("text").alias("text")).select("text", "toxic")


def train(rows: DataFrame, cfg: Settings = Settings()) -> Model:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, s in slices(batch.column(0), fold_case=True):
                r, t = terms(s, cfg.hash_bits)
                bounds = np.searchsorted(r, np.arange(s.n + 1))
                ts = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(t, pa.int32()))
                yield pa.RecordBatch.from_arrays([ts, batch.column(1).slice(i, j - i).cast(pa.int32())], ["t", "y"])

    # at most max_toxic + max_clean rows, and fewer bytes than max_bytes for each kind
    got = rows.mapInArrow(run, "t array<int>, y int").toArrow()
    y = got.column("y").to_numpy().astype(float)
    lists = got.column("t").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    flat = lists.flatten().to_numpy()
    at = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
    share = y.mean() if len(y) else 0.0
    if not len(y) or share in (0.0, 1.0):
        share = min(max(share, 1e-9), 1 - 1e-9)
        return Model(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, cfg.factors)), float(np.log(share / (1 - share))))
    # of each kind of term: toxic rows with it against what its frequency predicts
    n = np.bincount(flat, minlength=1 << cfg.hash_bits)
    hit = np.bincount(flat, weights=y[at], minlength=1 << cfg.hash_bits)
    z = (hit - n * share) / np.sqrt(np.maximum(n * share * (1 - share), 1e-9))
    slots = np.flatnonzero(((z > cfg.min_z) & (hit >= cfg.min_toxic_rows)) | ((z < -cfg.min_z) & (n >= 30)))
    slots = np.union1d(slots, _pairs(flat, at, y, n, share, cfg))
    where = np.searchsorted(slots, flat)
    keep = (where < len(slots)) & (slots[np.minimum(where, max(len(slots) - 1, 0))] == flat) if len(slots) else np.zeros(len(flat), bool)
    return _fit(slots, at[keep], where[keep], y, cfg)


def _pairs(flat: np.ndarray, at: np.ndarray, y: np.ndarray, n: np.ndarray, share: float, cfg: Settings) -> np.ndarray:
    """Terms whose pair goes with toxic texts beyond chance, though neither need do so alone, among the most frequent terms."""
    common = np.flatnonzero(n >= cfg.min_toxic_rows)
    common = np.sort(common[np.argsort(-n[common], kind="stable")[: cfg.pair_terms]])
    where = np.searchsorted(common, flat)
    known = np.flatnonzero((where < len(common)) & (common[np.minimum(where, len(common) - 1)] == flat)) if len(common) else np.zeros(0, int)
    both, hit = (np.zeros((len(common), len(common)), np.float32) for _ in range(2))
    bounds = np.searchsorted(at[known], np.arange(0, len(y) + 2048, 2048))
    for k, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        x = np.zeros((2048, len(common)), np.float32)
        x[at[known[i:j]] - 2048 * k, where[known[i:j]]] = 1
        both += x.T @ x
        toxic = x[: len(y) - 2048 * k][y[2048 * k : 2048 * k + 2048] > 0]
        hit += toxic.T @ toxic
    z = (hit - both * share) / np.sqrt(np.maximum(both * share * (1 - share), 1e-9))
    # beyond what the better of the two shows alone
    one = np.diagonal(z)
    strong = (z > cfg.pair_z) & (hit >= 2 * cfg.min_toxic_rows) & (z > np.maximum(one[:, None], one[None, :]) + cfg.min_z)
    np.fill_diagonal(strong, False)
    return common[np.unique(np.concatenate(np.nonzero(strong)))]


def _fit(slots: np.ndarray, rows: np.ndarray, feats: np.ndarray, y: np.ndarray, cfg: Settings) -> Model:
    """Full-gradient Adam on logistic loss with L2 decay; kinds are weighted back to even odds of mistakes."""
    m, n, rng = len(slots), len(y), np.random.RandomState(7)
    share = y.mean()
    w, v, b = np.zeros(m), rng.normal(0, 0.05, (m, cfg.factors)), float(np.log(share / (1 - share)))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(v), np.zeros_like(v), 0.0, 0.0]
    for step in range(1, cfg.epochs * 5 + 1):
        p = Model(slots, w, v, b).score(rows, feats, n)
        e = (p - y) / n
        er = e[rows]
        gw = np.bincount(feats, weights=er, minlength=m) + cfg.l2 * w / 10
        gv = np.empty_like(v)
        for k in range(cfg.factors):
            x = v[feats, k]
            s = np.bincount(rows, weights=x, minlength=n)
            gv[:, k] = np.bincount(feats, weights=er * (s[rows] - x), minlength=m) + cfg.l2 * v[:, k]
        grads = (gw, gv, e.sum())
        new = []
        for i, (param, g) in enumerate(zip((w, v, b), grads, strict=True)):
            state[2 * i] = 0.9 * state[2 * i] + 0.1 * g
            state[2 * i + 1] = 0.999 * state[2 * i + 1] + 0.001 * g * g
            new.append(param - cfg.rate * (state[2 * i] / (1 - 0.9**step)) / (np.sqrt(state[2 * i + 1] / (1 - 0.999**step)) + 1e-8))
        w, v, b = new[0], new[1], float(new[2])
    return Model(slots, w, v, b)


def score(docs: DataFrame, model: Model, cfg: Settings = Settings(), threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) of every document."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        feature = np.full(1 << cfg.hash_bits, -1, np.int32)
        feature[m.slots] = np.arange(len(m.slots))
        for batch in batches:
            for i, j, s in slices(batch.column(1), fold_case=True):
                r, t = terms(s, cfg.hash_bits)
                f = feature[t]
                p = m.score(r[f >= 0], f[f >= 0], s.n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
