"""Cross-tokenizer alignment by an event sweep.

Two tokenizers, a byte-level BPE (A) and a SentencePiece model (B), encode every text. The end of each token is an event
at its byte offset. Events travel in runs, a row of up to RUN tokens of one side, since the ids fix the bytes and with
them all offsets of a run. Runs of both sides are dealt by document and sorted by offset within partitions; a machine that
holds no more than the open group, the counts and the digest so far streams over them. Offsets where both sides end close
a group. Between two neighbouring events lies just one token of each side: that is a link.

How many documents link a pair of ids is counted over all documents. If the pairs are few enough, each document's links
are scored against the broadcast counts, else by a join; both give the same.

A text is encoded as it is, special strings in it too. Texts that are null or empty, or that a side's tokens don't spell
byte by byte with the space before (such as those with U+2581), have no tokens: their counts are 0, their digest is ''. Every
row of ``docs`` is a document, so repeated ids and rows are aligned one by one and count each. Texts of any length are
read whole; memory holds the longest group and a document's distinct pairs. Extra columns are ignored. Without documents the result is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise
from .sentencepiece_codec import BYTE, CONTROL, MARK, codec_for
from .sstable import byte_bpe_encoder

RUN = 1 << 15
#: Tokens that are swept at once, and from how many on a document is streamed.
SWEEP = 1 << 19
#: Pairs of a table that is sent to every task, about 13 bytes each.
BROADCAST_PAIRS = 4_000_000


def byte_level_bytes(pieces: dict[str, int]) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary: printable Latin-1 stands for itself, other bytes for U+0100 and on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    table = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
    out = [b""] * (max(pieces.values(), default=-1) + 1)
    for piece, i in pieces.items():
        out[i] = bytes(table[c] for c in piece) if all(c in table for c in piece) else piece.encode()
    return out


@dataclass(frozen=True)
class Vocabulary:
    """Bytes of all ids of one side."""

    flat: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, pieces: list[bytes]) -> Vocabulary:
        return cls(np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces], np.int64))

    @property
    def kind(self) -> np.dtype:
        return np.dtype("<u2" if len(self.size) <= 1 << 16 else "<u4")

    def spell(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The joined bytes of ids, and where each ends."""
        size = self.size[ids]
        ends = np.cumsum(size)
        start = (np.cumsum(self.size) - self.size)[ids]
        return self.flat[np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes(), ends


def vocabularies(a_path: str, b_path: str) -> tuple[Vocabulary, Vocabulary]:
    from tokenizers import Tokenizer

    with codec_for(b_path) as codec:
        pieces = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else p.replace(MARK, " ").encode() for p, _, k in codec.model.pieces]
    return Vocabulary.of(byte_level_bytes(Tokenizer.from_file(a_path).get_vocab())), Vocabulary.of(pieces)


def events(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(task, row, at, side, doc_id, ids): runs of tokens; a document without tokens is one empty run.

    A document is named by the task and row it was read from, which stay the same when a task is repeated over files.
    """
    vocab = vocabularies(a_path, b_path)
    id_type = dict(docs.dtypes)["doc_id"]
    names = ["task", "row", "at", "side", "doc_id", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row = TaskContext.get().partitionId(), 0
        encode, width = byte_bpe_encoder(a_path)
        with codec_for(b_path) as codec:
            for batch in batches:
                for begin in range(0, len(batch), 256):
                    part = batch.slice(begin, 256)
                    given = part.column(1).to_pylist()
                    spaced = [" " + t if t else "" for t in given]
                    want = [t.encode() for t in spaced]
                    sides = [[np.frombuffer(x, f"<u{width}") for x in encode(pa.array(spaced, pa.large_string()))], codec.encode([t or "" for t in given])[0]]
                    whole = [bool(t) for t in want]
                    spans = []
                    for ids, v in zip(sides, vocab, strict=True):
                        bounds = np.cumsum([0, *map(len, ids)])
                        raw, ends = v.spell(np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int64))
                        edge = np.concatenate([[0], ends])
                        spans.append((bounds, edge))
                        cut = edge[bounds].tolist()
                        whole = [w and raw[i:j] == t for w, t, i, j in zip(whole, want, cut[:-1], cut[1:], strict=True)]
                    out: tuple[list, ...] = ([], [], [], [], [])
                    for i, good in enumerate(whole):
                        runs = [(s, k) for s in (0, 1) for k in range(0, len(sides[s][i]), RUN)] if good else [(0, 0)]
                        for s, k in runs:
                            bounds, edge = spans[s]
                            out[0].append(row + i)
                            out[1].append(int(edge[bounds[i] + k] - edge[bounds[i]]))
                            out[2].append(s)
                            out[3].append(i)
                            out[4].append(sides[s][i][k : k + RUN].astype(vocab[s].kind).tobytes() if good else b"")
                    row += len(part)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out[0]), task), pa.int32()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int8()), part.column(0).take(pa.array(out[3], pa.int64())), pa.array(out[4], pa.binary())], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"task int, row long, at long, side byte, doc_id {id_type}, ids binary")


@dataclass
class Swept:
    """Groups and links of whole groups of some documents, in order; ``*_from`` bound each document's."""

    group_end: np.ndarray
    groups_from: np.ndarray
    link_end: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    links_from: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray


def sweep(a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray, doc_ends: np.ndarray) -> Swept:
    """Both sides' tokens and sizes; ``doc_ends``: the offsets where documents end, at which both sides end too."""
    at_a, at_b = np.cumsum(a_size), np.cumsum(b_size)
    event = np.zeros(int(doc_ends[-1]) + 1 if len(doc_ends) else 1, np.uint8)
    event[at_a] = 1
    event[at_b] |= 2
    ends = np.flatnonzero(event)
    kind = event[ends]
    # the token of each side that covers what lies before an event: as many as ended earlier
    is_a, is_b = kind & 1, kind >> 1
    link_a, link_b = a[np.cumsum(is_a, dtype=np.int64) - is_a], b[np.cumsum(is_b, dtype=np.int64) - is_b]
    both_a, both_b = event[at_a] == 3, event[at_b] == 3
    shut = ends[kind == 3]
    starts = np.concatenate([[0], doc_ends])
    return Swept(shut, np.searchsorted(shut, starts, "right"), ends, link_a, link_b, np.searchsorted(ends, starts, "right"), np.cumsum(both_a) - both_a, np.cumsum(both_b) - both_b)


class Digits:
    """Decimal spellings of all ids, one row each."""

    def __init__(self, n: int):
        self.size = np.array([len(str(i)) for i in range(max(n, 1))], np.int8)
        width = int(self.size.max())
        self.rows = np.frombuffer("".join(str(i).ljust(width) for i in range(max(n, 1))).encode(), np.uint8).reshape(-1, width)

    def groups(self, a: np.ndarray, b: np.ndarray, s: Swept) -> tuple[bytes, np.ndarray]:
        """``a1,a2|b1;`` for every group, and where each document's begin and end."""
        n = len(s.group_end)
        a_upto, b_upto = np.searchsorted(s.a_group, np.arange(n + 1)), np.searchsorted(s.b_group, np.arange(n + 1))
        ids, sep = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        where_a, where_b = np.arange(len(a)) + b_upto[s.a_group], np.arange(len(b)) + a_upto[s.b_group + 1]
        ids[where_a], ids[where_b] = a, b
        sep[where_a[a_upto[1:] - 1]] = ord("|")
        sep[where_b[b_upto[1:] - 1]] = ord(";")
        size = self.size[ids].astype(np.int64)
        ends = np.cumsum(size + 1)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
        begin = ends - size - 1
        for k in range(self.rows.shape[1]):
            some = slice(None) if k == 0 else np.flatnonzero(size > k)
            out[begin[some] + k] = self.rows[ids[some], k]
        out[ends - 1] = sep
        edge = np.concatenate([[0], ends])
        return out.tobytes(), edge[(a_upto + b_upto)[s.groups_from]]


def count_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


class Machine:
    """Takes runs in order of document and offset; ``out`` gets the rows of each document once its last run is in."""

    def __init__(self, vocab: tuple[Vocabulary, Vocabulary]):
        self.vocab, self.n_b = vocab, len(vocab[1].size)
        self.digits = Digits(max(len(v.size) for v in vocab))
        self.key = self.doc = None
        self.runs: list[list[np.ndarray]] = [[], []]
        self.held = 0
        self.waiting: list[tuple] = []
        self.waits = 0
        self.long = False
        self.out: list[tuple] = []

    def feed(self, key: tuple[int, int], doc: object, side: int, raw: bytes) -> None:
        if key != self.key:
            self.close()
            self.key, self.doc = key, doc
        self.runs[side].append(np.frombuffer(raw, self.vocab[side].kind))
        self.held += len(self.runs[side][-1])
        if self.held >= SWEEP:
            self._advance()

    def _tokens(self) -> list[np.ndarray]:
        return [np.concatenate([np.zeros(0, np.int64), *r]).astype(np.int64) for r in self.runs]

    def _advance(self) -> None:
        """Sweep a long document as far as both sides are known, up to the last common end."""
        if not self.long:
            self.long, self.counts, self.digest, self.pairs, self.gathered = True, np.zeros(4, np.int64), hashlib.sha256(), [], 0
        tokens = self._tokens()
        ends = [np.cumsum(v.size[t]) for v, t in zip(self.vocab, tokens, strict=True)]
        shared = np.intersect1d(*ends, assume_unique=True)
        if len(shared):
            cut = [int(np.searchsorted(e, shared[-1], "right")) for e in ends]
            self._piece([t[:c] for t, c in zip(tokens, cut, strict=True)], shared[-1:])
            self.runs = [[t[c:].astype(v.kind)] for t, c, v in zip(tokens, cut, self.vocab, strict=True)]
        self.held = 0

    def _piece(self, tokens: list[np.ndarray], end: np.ndarray) -> None:
        s = sweep(*tokens, *(v.size[t] for v, t in zip(self.vocab, tokens, strict=True)), end)
        text, _ = self.digits.groups(*tokens, s)
        self.digest.update((b";" if self.counts[2] else b"") + text[:-1])
        self.counts += [len(tokens[0]), len(tokens[1]), len(s.group_end), len(s.link_end)]
        self.pairs.append(count_keys(s.link_a * self.n_b + s.link_b))
        self.gathered += len(self.pairs[-1][0])
        if self.gathered > SWEEP:
            self._gather()

    def _gather(self) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(x) for x in zip(*self.pairs, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.pairs, self.gathered = [(keys[first], np.add.reduceat(n, first))], 0
        return self.pairs[0]

    def close(self) -> None:
        """The document that was fed last is complete."""
        if self.key is None:
            return
        if self.long:
            self.flush()
            tokens = self._tokens()
            if len(tokens[0]):
                self._piece(tokens, np.cumsum(self.vocab[0].size[tokens[0]])[-1:])
            self.out.append((self.key, self.doc, self.counts.tolist(), self.digest.hexdigest(), *self._gather()))
        else:
            tokens = self._tokens()
            self.waiting.append((self.key, self.doc, *tokens))
            self.waits += len(tokens[0]) + len(tokens[1])
            if self.waits >= SWEEP:
                self.flush()
        self.key, self.runs, self.held, self.long = None, [[], []], 0, False

    def flush(self) -> None:
        """Sweep the complete documents that wait, all at once."""
        if not self.waiting:
            return
        a, b = np.concatenate([w[2] for w in self.waiting]), np.concatenate([w[3] for w in self.waiting])
        n_a, n_b = np.array([len(w[2]) for w in self.waiting]), np.array([len(w[3]) for w in self.waiting])
        size = self.vocab[0].size[a]
        doc_ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(n_a)]
        s = sweep(a, b, size, self.vocab[1].size[b], doc_ends)
        text, edge = self.digits.groups(a, b, s)
        links = np.diff(s.links_from)
        base = len(self.vocab[0].size) * self.n_b
        keys, n = count_keys(np.repeat(np.arange(len(links)), links) * base + s.link_a * self.n_b + s.link_b)
        pair_from = np.searchsorted(keys, np.arange(len(links) + 1) * base)
        counts = np.stack([n_a, n_b, np.diff(s.groups_from), links], 1).tolist()
        for i, (key, doc, *_) in enumerate(self.waiting):
            own = slice(pair_from[i], pair_from[i + 1])
            sha = hashlib.sha256(text[edge[i] : edge[i + 1] - 1]).hexdigest() if links[i] else ""
            self.out.append((key, doc, counts[i], sha, keys[own] - i * base, n[own]))
        self.waiting, self.waits = [], 0

    def take(self) -> list[tuple]:
        got, self.out = self.out, []
        return got


def _sorted_runs(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    return events(docs, a_path, b_path).repartition("task", "row").sortWithinPartitions("task", "row", "at", "side")


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A document a row: (task, row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times); pair = A id * number of B ids + B id."""
    vocab = vocabularies(a_path, b_path)
    id_type = dict(docs.dtypes)["doc_id"]
    names = ["task", "row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, kind = Machine(vocab), None

        def rows() -> Iterator[pa.RecordBatch]:
            got = machine.take()
            for k in range(0, len(got), 1024):
                part = got[k : k + 1024]
                edge = pa.array(np.cumsum([0, *(len(r[4]) for r in part)]), pa.int32())
                lists = [pa.ListArray.from_arrays(edge, pa.array(np.concatenate([r[c] for r in part]), t)) for c, t in ((4, pa.int64()), (5, pa.int32()))]
                cols = [pa.array([r[0][0] for r in part], pa.int32()), pa.array([r[0][1] for r in part], pa.int64()), pa.array([r[1] for r in part], kind), *(pa.array([r[2][c] for r in part], pa.int64()) for c in range(4))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([r[3] for r in part], pa.string()), *lists], names)

        for batch in batches:
            kind = batch.column(4).type
            for task, row, side, doc, raw in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4)), batch.column(5), strict=True):
                machine.feed((task, row), doc, side, raw.as_buffer())
            yield from rows()
        machine.close()
        machine.flush()
        yield from rows()

    return _sorted_runs(docs, a_path, b_path).mapInArrow(run, f"task int, row long, doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")


def groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, start, end, a_ids, b_ids): every group with its byte range of space and text."""
    vocab = vocabularies(a_path, b_path)
    id_type = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, base = None, [np.zeros(0, np.int64)] * 2, 0
        for batch in batches:
            for task, row, side, doc, raw in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4, 5)), strict=True):
                if key != (task, row):
                    key, held, base = (task, row), [np.zeros(0, np.int64)] * 2, 0
                held[side] = np.concatenate([held[side], np.frombuffer(raw, vocab[side].kind).astype(np.int64)])
                ends = [np.cumsum(v.size[t]) for v, t in zip(vocab, held, strict=True)]
                shared = np.intersect1d(*ends, assume_unique=True)
                if not len(shared):
                    continue
                cut = [np.searchsorted(e, shared, "right") for e in ends]
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], c]), pa.int32()), pa.array(t[: c[-1]], pa.int32())) for c, t in zip(cut, held, strict=True)]
                start = np.concatenate([[0], shared[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(shared), batch.column(4).type), pa.array(start + base, pa.int64()), pa.array(shared + base, pa.int64()), *lists], ["doc_id", "start", "end", "a_ids", "b_ids"])
                held, base = [t[c[-1] :] for c, t in zip(cut, held, strict=True)], base + int(shared[-1])

    return _sorted_runs(docs, a_path, b_path).mapInArrow(run, f"doc_id {id_type}, start long, end long, a_ids array<int>, b_ids array<int>")


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """(pair, docs, best): in how many documents a pair of ids is linked, and whether no other pair of its A id is in more."""
    counted = materialise(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs")), "pairs")
    keyed = counted.withColumn("a", F.expr(f"pair div {n_b}"))
    most = keyed.groupBy("a").agg(F.max("docs").alias("most"))
    out = materialise(keyed.join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")), "pair_counts")
    discard(counted)
    return out


def score(aligned: DataFrame, counts: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``aligned`` without pairs, with n_best and count_sum over a document's links."""
    kept = [c for c in aligned.columns if c not in ("pairs", "times", "task", "row")]
    if counts.count() > broadcast_pairs:
        each = aligned.select("task", "row", F.arrays_zip("pairs", "times").alias("z")).select("task", "row", F.inline("z")).withColumnRenamed("pairs", "pair")
        summed = each.join(counts, "pair").groupBy("task", "row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
        return aligned.select("task", "row", *kept).join(summed, ["task", "row"], "left").select(*kept, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")])
    got = counts.toArrow()  # at most broadcast_pairs rows
    pair = got.column("pair").to_numpy()
    order = np.argsort(pair)
    sent = aligned.sparkSession.sparkContext.broadcast((pair[order], got.column("docs").to_numpy()[order], got.column("best").to_numpy()[order]))
    schema = ", ".join(f"{c} {k}" for c, k in aligned.dtypes if c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, docs, best = sent.value
        for batch in batches:
            n = len(batch)
            lists = batch.column(n_kept := len(kept))
            bounds = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
            times = batch.column(n_kept + 1).flatten().to_numpy().astype(np.int64)
            of = np.repeat(np.arange(n), np.diff(bounds))
            # ascending keys are looked up faster, and one key of many documents only once
            keys, back = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            where = np.searchsorted(pairs, keys)[back]
            total = [np.concatenate([[0], np.cumsum(x)]) for x in (np.where(best[where], times, 0), times * docs[where])] if len(of) else [np.zeros(1, np.int64)] * 2
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], *(pa.array(t[bounds[1:]] - t[bounds[:-1]], pa.int64()) for t in total)], [*kept, "n_best", "count_sum"])

    return aligned.select(*kept, "pairs", "times").mapInArrow(run, f"{schema}, n_best long, count_sum long")
