"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here: pieces with scores and kinds, trainer and normaliser settings. From it are
rebuilt the normaliser, the metaspace marker, the model (unigram scores, or merges by piece score where the file
holds a BPE model) and byte fallback. Where no piece holds the marker after another character, text falls into units that
start at the marker or at punctuation after a letter; each distinct unit is encoded once a worker, in multithreaded
batches, and checked against the sentencepiece library, so ``parity`` covers every unit of every text. It is null
for models that put no marker before a text, as nothing is compared there.

Null and empty texts have no ids. Repeated rows are encoded alike. Extra columns are ignored. Very long texts are
encoded whole. An empty table gives an empty result.
"""

from __future__ import annotations

import contextlib
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textscan import give_back, slices
from .unitmemo import TokenTable

MARK = "▁"
LETTERS, PUNCTUATION = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?#*$%&|"
_CODECS: dict = {}
#: What the tokenizers library reads before each batch.
THREADS = "TOKENIZERS_PARALLELISM"
#: Piece kinds of the format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    i = 0

    def varint() -> int:
        nonlocal i
        n = shift = 0
        while True:
            c = b[i]
            i += 1
            n |= (c & 127) << shift
            shift += 7
            if c < 128:
                return n

    while i < len(b):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value = b[i : i + size]
            i += size
        yield key >> 3, value


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    bpe: bool = False
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        m = cls()
        for f, v in _fields(data):
            if f == 1:
                piece = {1: b"", 2: struct.pack("<f", 0), 3: NORMAL} | dict(_fields(v))
                m.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
            elif f == 2:
                t = dict(_fields(v))
                if t.get(3, 1) not in (1, 2):
                    raise ValueError("only unigram and BPE models are read")
                m.bpe, m.byte_fallback = t.get(3, 1) == 2, bool(t.get(35, 0))
            elif f == 3:
                n = dict(_fields(v))
                m.charsmap = n.get(2, b"")
                m.add_dummy_prefix, m.remove_extra_whitespaces, m.escape_whitespaces = (bool(n.get(k, 1)) for k in (3, 4, 5))
        return m

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def edges(self) -> re.Pattern | None:
        """Where a text may be cut: between characters that stand side by side in no piece."""
        live = [p for p, _, k in self.pieces if k in (NORMAL, USER_DEFINED)]
        if not self.escape_whitespaces or any(re.search(f"[^{MARK}]{MARK}", p) for p in live):
            return None
        free = self.free_marks()
        return re.compile(f"(?<=[^{MARK}])(?={MARK})" + (f"|(?<=[{LETTERS}])(?=[{re.escape(free)}])" if free else ""))

    def free_marks(self) -> str:
        """Punctuation that no piece holds after a letter."""
        live = [p for p, _, k in self.pieces if k in (NORMAL, USER_DEFINED)]
        return "".join(c for c in PUNCTUATION if not any(re.search(f"[{LETTERS}]{re.escape(c)}", p) for p in live))

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that make a piece, best piece first."""
        live = {p: s for p, s, k in self.pieces if k in (NORMAL, USER_DEFINED)}
        at = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        found = []
        for p, s in live.items():
            halves = [(p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in live and p[i:] in live]
            found += [(-s, at[p], at[a], at[b], a, b) for a, b in halves]
        return [x[4:] for x in sorted(found)]


class Codec:
    """``encode`` and ``decode`` for one model file."""

    def __init__(self, path: str, verify: bool = True):
        from tokenizers import Tokenizer, models, normalizers

        with open(path, "rb") as f:
            self.model = m = PieceModel.parse(f.read())
        if m.bpe:
            vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
            self.core = Tokenizer(models.BPE(vocab, m.merges(), unk_token=m.pieces[m.unknown][0], fuse_unk=True, byte_fallback=m.byte_fallback))
        else:
            self.core = Tokenizer(models.Unigram([(p, s) for p, s, _ in m.pieces], m.unknown, m.byte_fallback))
        steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
        self.charsmap = normalizers.Sequence(steps) if steps else None
        self.edges = m.edges()
        self.reference = None
        if verify:
            import sentencepiece

            self.reference = sentencepiece.SentencePieceProcessor(model_file=path)
        # a model that puts no marker before a text shows no unit of its own
        self.compares = self.reference is not None and m.add_dummy_prefix
        self.letter_ids = self.reference.encode("a") if self.compares else []
        self.failed: set[str] = set()
        self.memo = TokenTable(self._units, np.dtype("<u4"), slots=1 << 21, most_ids=1 << 22)
        pieces = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else p.replace(MARK, " ").encode() for p, _, k in m.pieces]
        self.raw, self.raw_size = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(x) for x in pieces])
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        # what `edges` says, by bytes: a letter before and one of these after
        self.letter = np.array([bool(re.match(f"[{LETTERS}]", chr(b))) and b < 128 for b in range(256)])
        free = m.free_marks()
        self.mark = np.array([chr(b) in free for b in range(256)])

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """The offsets that ``edges`` finds in UTF-8 bytes, and perhaps starts of texts."""
        n = len(data)
        if n < 4 or self.edges is None:
            return np.zeros(0, np.int64)
        marker = np.zeros(n + 3, bool)  # offset 3 and on: where a marker begins
        marker[3 : n + 1] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
        edge = marker[3:] & ~marker[:-3]
        latin = np.zeros(n, bool)  # whether a Latin-1 letter other than the signs of multiplication and division ends here
        latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0xBF) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        edge[1:] |= (self.letter[data[:-1]] | latin[:-1]) & self.mark[data[1:]]
        return np.flatnonzero(edge)

    def normalise(self, text: str) -> str:
        m = self.model
        if self.charsmap is not None:
            text = self.charsmap.normalize_str(text)
        if m.remove_extra_whitespaces:
            text = re.sub(" {2,}", " ", text.strip(" "))
        if not text:
            return ""
        if m.add_dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK) if m.escape_whitespaces else text

    def _units(self, units: list[str]) -> list[bytes]:
        ids = [e.ids for e in self.core.encode_batch(units, add_special_tokens=False)]
        if self.compares:
            # the reference puts a marker before what it is given; a unit without one is compared behind a letter, where it was cut
            bare = [u.startswith(MARK) and u != MARK for u in units]
            given = [(u[1:] if b else "a" + u).replace(MARK, " ") for u, b in zip(units, bare, strict=True)]
            for u, b, got, want in zip(units, bare, ids, self.reference.encode(given, num_threads=1), strict=True):
                if got != (want if b else want[len(self.letter_ids) :]) or not b and want[: len(self.letter_ids)] != self.letter_ids:
                    self.failed.add(u)
        return [np.array(x, "<u4").tobytes() for x in ids]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool | None]]:
        """Ids of each text and whether all its units agree with the reference; null where it can't be compared."""
        plain = list(map(self.normalise, texts))
        ids: list[np.ndarray] = []
        for _, _, part in slices(pa.array(plain, pa.large_string())):
            ids += [np.frombuffer(b, "<u4") for b in self.memo(part, self.cuts(part.data))]
        if not self.failed:
            return ids, [True if self.compares else None] * len(ids)
        return ids, [self.failed.isdisjoint(self.edges.split(t) if self.edges else [t]) for t in plain]

    def decode_all(self, rows: list[np.ndarray]) -> list[str]:
        """The text of each row of ids."""
        ids = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
        size = self.raw_size[ids]
        upto = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=upto[1:])
        data = self.raw[np.repeat(self.raw_at[ids] - upto[:-1], size) + np.arange(upto[-1])].tobytes()
        ends = upto[np.cumsum([0, *map(len, rows)])].tolist()
        texts = [data[i:j].decode("utf-8", "replace") for i, j in zip(ends[:-1], ends[1:], strict=True)]
        return [t[1:] if self.model.add_dummy_prefix and t.startswith(" ") else t for t in texts]

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_all([ids])[0]


@contextlib.contextmanager
def codec_for(path: str) -> Iterator[Codec]:
    """The worker's codec; the units that it learns are forgotten after the task, since workers outlive stages."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    before = os.environ.get(THREADS)
    os.environ[THREADS] = "true"
    try:
        yield _CODECS[path]
    finally:
        if before is None:
            del os.environ[THREADS]
        else:
            os.environ[THREADS] = before
        _CODECS[path].memo.forget()
        give_back()


def tokenise(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, parity) of every document."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec_for(model_path) as codec:
            for batch in batches:
                for at in range(0, len(batch), 256):
                    part = batch.slice(at, 256)
                    ids, parity = codec.encode([t or "" for t in part.column(1).to_pylist()])
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(parity, pa.bool_())], [id_col, "ids", "parity"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, ids array<int>, parity boolean")


def detokenise(tokens: DataFrame, model_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text) from ids."""
    kind = dict(tokens.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec_for(model_path) as codec:
            for batch in batches:
                texts = codec.decode_all([np.array(x or [], np.int64) for x in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return tokens.select(id_col, "ids").mapInArrow(run, f"{id_col} {kind}, text string")


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """A digest of ``tokenise`` and ``detokenise`` a document, without moving ids or texts between tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec_for(model_path) as codec:
            for batch in batches:
                for at in range(0, len(batch), 256):
                    part = batch.slice(at, 256)
                    texts = [t or "" for t in part.column(1).to_pylist()]
                    ids, parity = codec.encode(texts)
                    back = codec.decode_all(ids)
                    cols = {
                        "doc_id": part.column(0).cast(pa.int64()),
                        "n_ids": pa.array([len(x) for x in ids], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                        "decoded_crc32": pa.array([zlib.crc32(x.encode()) for x in back], pa.int64()),
                        "round_trip": pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_()),
                        "parity": pa.array(parity, pa.bool_()),
                    }
                    yield pa.RecordBatch.from_pydict(cols)

    return docs.select(F.col("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_crc32 long, round_trip boolean, parity boolean")
