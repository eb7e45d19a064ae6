"""Benchmark decontamination: a broadcast hash set of the benchmark's n-grams, against which every document is scanned.

Words are maximal runs of ASCII letters and digits and of characters beyond ASCII, with A-Z in lower case. A window is ten
words of an item in a row; an item with fewer words is one window. Windows of documents are found by hash and held to
their words byte by byte, then documents or the hit words can be removed.

The set is sent to every task, so its size is bounded: items are cut into pieces that overlap by a window less one word, and
pieces are dealt into rounds of at most ``round_bytes`` of text. A benchmark of more than one round is scanned in as many
passes; only documents that were hit are then joined, by id and hash of the text, so that no document is gathered.

A null text has no words; an item without words has no window. Items are told apart by id: rows that repeat an id are one
item; windows of items without an id hit, and no item is named for them. Documents of one id are judged one by one, repeated
rows alike. Texts are read whole. Extra columns are ignored (``scan``) or passed on (``remove_*``). Without documents the result is empty; without items nothing is hit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .textscan import U, Slice, mix, same_bytes, slices, wide_view

#: Bytes that divide words: all of ASCII but digits and letters (capitals are in lower case by then).
GAP = np.zeros(256, bool)
GAP[[b for b in range(128) if not chr(b).isalnum()]] = True
PIECE_WORDS = 4096


@dataclass(frozen=True)
class Settings:
    window: int = 10
    #: Benchmark text of one broadcast; its set takes about eight times as much.
    round_bytes: int = 8 << 20


class WindowSet:
    """All windows of some pieces: sorted hashes with the words that they stand for and the items that hold them."""

    def __init__(self, pieces: pa.Array, items: list[str | None], window: int):
        names = sorted({i for i in items if i is not None})
        number = {i: k for k, i in enumerate(names)} | {None: -1}
        self.names = pa.array(names, pa.string())
        of = np.array([number[i] for i in items], np.int64)
        parts = list(slices(pieces, True, GAP))
        size = sum(len(s.data) for _, _, s in parts)
        self.text, self.starts, self.ends, h, first, length, item = np.zeros(size + 8, np.uint8), [], [], [], [], [], []
        at = words = 0
        for i, j, s in parts:
            self.text[at : at + len(s.data)] = s.data
            self.starts.append(s.starts + at)
            self.ends.append(s.ends + at)
            counts = np.diff(s.bounds)
            for n in np.unique(np.minimum(counts, window)).tolist():
                if n:
                    w, k = windows(s, n)
                    text = np.searchsorted(s.bounds, w, "right") - 1
                    whole = (counts[text] == n) | (n == window)
                    h.append(k[whole])
                    first.append(w[whole] + words)
                    length.append(np.full(int(whole.sum()), n))
                    item.append(of[i:j][text[whole]])
            at, words = at + len(s.data), words + len(s.starts)

        def joined(x: list, kind=np.int64) -> np.ndarray:
            return np.concatenate([np.zeros(0, kind), *x])

        self.starts, self.ends = joined(self.starts), joined(self.ends)
        h, first, length, item = joined(h, U), joined(first), joined(length), joined(item)
        order = np.lexsort((item, length, h))
        h, first, length, item = h[order], first[order], length[order], item[order]
        # equal windows in a row are one entry; unlike ones with one hash stay apart
        new = np.ones(len(h), bool)
        again = np.flatnonzero((h[1:] == h[:-1]) & (length[1:] == length[:-1])) + 1
        new[again] = ~self._same(self, first[again], first[again - 1], length[again])
        entry = np.cumsum(new) - 1
        self.hash, self.first, self.length = h[new], first[new], length[new]
        pairs = np.unique(np.stack([entry, item], 1)[item >= 0], axis=0) if len(h) else np.zeros((0, 2), np.int64)
        self.items, self.item_from = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.hash) + 1))
        self.lengths = np.unique(self.length).tolist()
        self.bits = max(16, int(len(self.hash)).bit_length() + 4)
        self._maybe = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_maybe": None}

    @property
    def wide(self) -> np.ndarray:
        return wide_view(self.text)

    def _same(self, other: WindowSet | Slice, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether ``length`` words from ``a`` on are those of ``other`` from ``b`` on."""
        if not len(a):
            return np.zeros(0, bool)
        upto = np.cumsum(length) - length
        k = np.arange(int(length.sum())) - np.repeat(upto, length)
        i, j = np.repeat(a, length) + k, np.repeat(b, length) + k
        size = self.ends[i] - self.starts[i]
        equal = size == other.ends[j] - other.starts[j]
        equal[equal] = same_bytes(self.wide, self.starts[i[equal]], other.wide, other.starts[j[equal]], size[equal])
        return np.logical_and.reduceat(equal, upto)

    def find(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """(word, entry) of every occurrence of a window in a slice."""
        if self._maybe is None:
            self._maybe = np.zeros(1 << self.bits, bool)
            self._maybe[(self.hash >> U(64 - self.bits)).astype(np.int64)] = True
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for n, at, h in all_windows(s, self.lengths):
            near = np.flatnonzero(self._maybe[(h >> U(64 - self.bits)).astype(np.int64)])
            at, h = at[near], h[near]
            entry = np.searchsorted(self.hash, h)
            while len(at):
                there = (entry < len(self.hash)) & (self.hash[np.minimum(entry, len(self.hash) - 1)] == h)
                at, h, entry = at[there], h[there], entry[there]
                hit = self.length[entry] == n
                hit[hit] = self._same(s, self.first[entry[hit]], at[hit], self.length[entry[hit]])
                found.append((at[hit], entry[hit]))
                entry = entry + 1
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def items_of(self, text: np.ndarray, entry: np.ndarray, n: int) -> pa.Array:
        """The names of the items of each of ``n`` texts, sorted, from its (text, entry) pairs."""
        pairs = np.unique(text * len(self.hash) + entry) if len(self.hash) else np.zeros(0, np.int64)
        text, entry = np.divmod(pairs, max(len(self.hash), 1))
        count = self.item_from[entry + 1] - self.item_from[entry] if len(entry) else np.zeros(0, np.int64)
        upto = np.cumsum(count) - count
        which = self.items[np.repeat(self.item_from[entry] - upto, count) + np.arange(int(count.sum()))] if len(entry) else np.zeros(0, np.int64)
        keys = np.unique(np.repeat(text, count) * max(len(self.names), 1) + which)
        text, which = np.divmod(keys, max(len(self.names), 1))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)), pa.int32()), self.names.take(pa.array(which, pa.int64())))


def all_windows(s: Slice, lengths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, first word, hash) of the windows of each length of a slice; a longer window's hash goes on from a shorter one's."""
    words = s.words()
    room = np.repeat(s.bounds[1:], np.diff(s.bounds)) - np.arange(len(words))
    at, h = np.arange(len(words)), words
    with np.errstate(over="ignore"):
        for n in range(1, max(lengths, default=0) + 1):
            if n > 1:
                fits = room[at] >= n
                if not fits.all():
                    at, h = at[fits], h[fits]
                h = mix(h * U(0xA0761D6478BD642F) + words[at + n - 1])
            if n in lengths:
                yield n, at, mix(h + U(n))


def windows(s: Slice, n: int) -> tuple[np.ndarray, np.ndarray]:
    for _, at, h in all_windows(s, [n]):
        return at, h
    return np.zeros(0, np.int64), np.zeros(0, U)


def _runs(at: np.ndarray, length: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The hit words of each text as runs, from and to word numbers of the text."""
    edge = np.zeros(int(bounds[-1]) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    hit = np.cumsum(edge[:-1]) > 0
    inner = bounds[(bounds > 0) & (bounds < len(hit))]
    turn = hit.copy()
    turn[1:] &= ~hit[:-1]
    turn[inner] = hit[inner]
    stop = hit.copy()
    stop[:-1] &= ~hit[1:]
    stop[inner - 1] = hit[inner - 1]
    first, last = np.flatnonzero(turn), np.flatnonzero(stop) + 1
    offsets = np.searchsorted(first, bounds)
    base = np.repeat(bounds[:-1], np.diff(offsets))
    ends = pa.array(offsets, pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(first - base, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(last - base, pa.int32()))


def pieces(benchmark: DataFrame, cfg: Settings) -> DataFrame:
    """(item, piece): the words of each item, cut where it has more than PIECE_WORDS so that each window lies in one piece."""
    step = PIECE_WORDS - cfg.window + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, s in slices(batch.column(1), True, GAP):
                rows: tuple[list, list] = [], []
                for t, (a, b) in enumerate(zip(s.bounds[:-1].tolist(), s.bounds[1:].tolist(), strict=True)):
                    for x in range(a, max(b - cfg.window + 1, a + 1) if b > a else a, step):
                        rows[0].append(i + t)
                        rows[1].append(b" ".join(s.data[p:q].tobytes() for p, q in zip(s.starts[x : min(x + PIECE_WORDS, b)], s.ends[x : min(x + PIECE_WORDS, b)], strict=True)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.binary()).cast(pa.string())], ["item", "piece"])

    return benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(run, "item string, piece string")


WORDS, STARTS, ENDS, ITEMS, KEY, TEXT = (f"__leak_{x}" for x in ("words", "starts", "ends", "items", "key", "text"))
FOUND = f"{STARTS} array<int>, {ENDS} array<int>, {ITEMS} array<string>"


def _pass(docs: DataFrame, found: WindowSet, carry: list[str], keyed: bool = False, hits_only: bool = False) -> DataFrame:
    """Columns ``carry`` of every document, or of those that are hit, with the number of words, runs of hit words and items."""
    sent = docs.sparkSession.sparkContext.broadcast(found)
    read = docs.select(*carry, *([F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias(KEY)] if keyed else []), F.col("text").alias(TEXT))
    names = [*read.columns[:-1], WORDS, STARTS, ENDS, ITEMS]
    fields = ", ".join(f"`{c}` {k}" for c, k in read.dtypes[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for i, j, s in slices(batch.column(batch.num_columns - 1), True, GAP):
                at, entry = known.find(s)
                starts, ends = _runs(at, known.length[entry], s.bounds)
                items = known.items_of(np.searchsorted(s.bounds, at, "right") - 1, entry, s.n)
                out = pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[:-1]), pa.array(np.diff(s.bounds), pa.int64()), starts, ends, items], names)
                yield out.filter(pa.array(np.asarray(starts.value_lengths()) > 0)) if hits_only else out

    return read.mapInArrow(run, f"{fields}, {WORDS} long, {FOUND}".removeprefix(", "))


def _merged(rows: DataFrame) -> DataFrame:
    """One row an id and text from one row each of the rounds that hit them: the union of runs and of items."""
    id_type = dict(rows.dtypes)["doc_id"]

    def union(r: dict) -> dict:
        runs: list[list[int]] = []
        for a, b in sorted((a, b) for h in r["hits"] for a, b in zip(h[STARTS], h[ENDS], strict=True)):
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        return {"doc_id": r["doc_id"], KEY: r[KEY], STARTS: [a for a, _ in runs], ENDS: [b for _, b in runs], ITEMS: sorted({i for h in r["hits"] for i in h[ITEMS]})}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([batch.schema.field("doc_id"), batch.schema.field(KEY), (STARTS, pa.list_(pa.int32())), (ENDS, pa.list_(pa.int32())), (ITEMS, pa.list_(pa.string()))])
            yield pa.RecordBatch.from_pylist(list(map(union, batch.to_pylist())), schema)

    one = rows.groupBy("doc_id", KEY, "round").agg(*[F.first(c).alias(c) for c in (STARTS, ENDS, ITEMS)])
    each = one.groupBy("doc_id", KEY).agg(F.collect_list(F.struct(STARTS, ENDS, ITEMS)).alias("hits"))
    return each.mapInArrow(run, f"doc_id {id_type}, {KEY} binary, {FOUND}")


def _rounds(benchmark: DataFrame, cfg: Settings) -> tuple[int, Iterator[WindowSet]]:
    cut = materialise(pieces(benchmark, cfg).distinct(), "pieces")
    n = -(-(cut.agg(F.sum(F.octet_length("piece") + 16)).collect()[0][0] or 0) // cfg.round_bytes) or 1
    dealt = cut.withColumn("round", F.pmod(F.xxhash64("piece", "item"), F.lit(n)))

    def sets() -> Iterator[WindowSet]:
        for r in range(n):
            # about round_bytes, by the number of rounds
            got = dealt.where(F.col("round") == r).select("item", "piece").toArrow()
            yield WindowSet(got.column("piece").combine_chunks(), got.column("item").to_pylist(), cfg.window)

    return n, sets()


def _marked(docs: DataFrame, benchmark: DataFrame, cfg: Settings, carry: list[str]) -> DataFrame:
    n, sets = _rounds(benchmark, cfg)
    if n == 1:
        return _pass(docs, next(sets), carry)
    hits = None
    for r, found in enumerate(sets):
        some = materialise(_pass(docs, found, ["doc_id"], True, True).withColumn("round", F.lit(r)), "hits")
        hits = some if hits is None else hits.union(some)
    merged = _merged(hits).withColumnRenamed("doc_id", "__leak_id")
    nothing = WindowSet(pa.array([], pa.string()), [], cfg.window)
    left = _pass(docs, nothing, list(dict.fromkeys(["doc_id", *carry])), True).drop(STARTS, ENDS, ITEMS).withColumnRenamed(KEY, "__leak_own")
    joined = left.join(merged, F.col("doc_id").eqNullSafe(F.col("__leak_id")) & (F.col("__leak_own") == F.col(KEY)), "left")
    kinds = {STARTS: "array<int>", ENDS: "array<int>", ITEMS: "array<string>"}
    return joined.select(*carry, WORDS, *[F.coalesce(c, F.array().cast(k)).alias(c) for c, k in kinds.items()])


def _total(column: str) -> Column:
    return F.aggregate(column, F.lit(0).cast("long"), lambda a, x: a + x)


def scan(docs: DataFrame, benchmark: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """(doc_id, n_words, n_hit, starts, ends, items) of every document: runs of hit words, from and to, and the ids of items with occurring windows."""
    found = _marked(docs, benchmark, cfg, ["doc_id"])
    return found.select("doc_id", F.col(WORDS).alias("n_words"), (_total(ENDS) - _total(STARTS)).alias("n_hit"), F.col(STARTS).alias("starts"), F.col(ENDS).alias("ends"), F.col(ITEMS).alias("items"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, max_hit: float = 0.0, cfg: Settings = Settings()) -> DataFrame:
    """The documents of whose words at most this share is hit, with all their columns."""
    found = _marked(docs, benchmark, cfg, docs.columns)
    return found.where(_total(ENDS) - _total(STARTS) <= max_hit * F.col(WORDS)).select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """All documents with their columns; hit words are cut out of ``text``, each run with what stands between its words."""
    names = docs.columns
    found, where = _marked(docs, benchmark, cfg, names), names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = batch.column(batch.num_columns - 3), batch.column(batch.num_columns - 2)
            texts = batch.column(where).to_pylist()
            hit = np.flatnonzero(np.asarray(starts.value_lengths())).tolist()
            for i in hit:
                for _, _, s in slices(pa.array([texts[i]]), True, GAP):
                    raw, at, kept = texts[i].encode(), 0, []
                    for a, b in zip(starts[i].as_py(), ends[i].as_py(), strict=True):
                        kept.append(raw[at : s.starts[a]])
                        at = int(s.ends[b - 1])
                    texts[i] = b"".join([*kept, raw[at:]]).decode()
            out = [batch.column(k) if k != where else pa.array(texts, batch.column(where).type) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(out, names)

    return found.mapInArrow(run, docs.schema)
