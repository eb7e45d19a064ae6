"""Sorted-string-table shards of token ids: prefix-compressed blocks, sparse index, Bloom filter and footer.

File: header, data blocks, index block, Bloom filter, footer. A block holds entries
``varint shared, varint unshared, varint value bytes, key suffix, value`` in key order, a restart (shared = 0)
every ``RESTART`` entries, then the restart offsets as u32 and their number. The index has, a block, its last key,
offset and length. The footer of fixed size locates index and filter and counts keys and ids. Keys are
identifiers as 8 big-endian bytes with the sign bit flipped, so byte order is number order; a null identifier is
the empty key and sorts first. Repeated identifiers are kept, in the order of their ids. Null and empty texts hold the end
id alone. An empty table makes no shard. Extra columns are ignored. A task writes to a name of its own and
renames, so a repeated or speculative task leaves one whole file.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import arrow_path, fresh_path, materialise
from .textscan import slices
from .unitmemo import TokenTable

MAGIC, RESTART, BLOCK_BYTES, BLOOM_BITS, BLOOM_HASHES = b"TSST0002", 16, 1 << 16, 10, 7
FOOTER = struct.Struct("<QQQQQQI8s")
#: Bytes of visible ASCII, of ASCII letters, and of ASCII punctuation other than an apostrophe.
VISIBLE, LETTER, MARK = (np.array([bool(re.match(p, chr(b))) and b < 128 for b in range(256)]) for p in ("[!-~]", "[A-Za-z]", "[!-&(-/:-@\\[-`{-~]"))
#: Second bytes of Latin-1 letters, which follow byte 0xC3 in UTF-8; 0x97 and 0xB7 are the signs of multiplication and division.
LATIN = np.array([0x80 <= b <= 0xBF and b not in (0x97, 0xB7) for b in range(256)])
#: A unit that is one pre-token, with the only space at its start.
PLAIN = re.compile(" [A-Za-zÀ-ÖØ-öø-ÿ]+")
_ENCODERS: dict = {}


def unit_edges(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Boundaries of byte-level BPE's pre-tokens that two bytes on either side decide.

    A single space between visible ASCII or Latin-1 letters starts one, and so does ASCII punctuation other than
    an apostrophe after a letter. ``starts``: where a text begins, for what follows a text decides nothing in it.
    """
    n = len(data)
    if n < 2:
        return np.zeros(0, np.int64)
    pair = np.zeros(n + 1, bool)  # whether a Latin-1 letter ends before this offset
    pair[2:] = (data[:-1] == 0xC3) & LATIN[data[1:]]
    opens = VISIBLE[data].copy()  # whether such a character begins at this offset
    opens[:-1] |= pair[2:]
    opens[starts[starts < n]] = False
    seen = VISIBLE[data[:-1]] | pair[1:n]  # for offsets 1 to n - 1, the character before
    edge = (LETTER[data[:-1]] | pair[1:n]) & MARK[data[1:]]
    edge[:-1] |= seen[:-1] & (data[1:-1] == 32) & opens[2:]
    return np.flatnonzero(edge) + 1


def key_bytes(key: int | None) -> bytes:
    return b"" if key is None else struct.pack(">Q", (key + (1 << 63)) & (2**64 - 1))


def key_value(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, i: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = b[i]
        i += 1
        n |= (c & 127) << shift
        if c < 128:
            return n, i
        shift += 7


def _bloom_bits(key: bytes, bits: int) -> Iterator[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    b |= 1
    return ((a + k * b) % bits for k in range(BLOOM_HASHES))


class Writer:
    """Append entries in key order, then ``close``; only one block and the keys' hashes are held."""

    def __init__(self, sink, width: int):
        self.sink, self.at, self.keys, self.ids = sink, 0, [], 0
        self.index, self.width = [], width
        self._put(MAGIC + bytes([width]))
        self._clear()

    def _put(self, b: bytes) -> None:
        self.sink.write(b)
        self.at += len(b)

    def _clear(self) -> None:
        self.block, self.restarts, self.n, self.last, self.size = [], [], 0, b"", 0

    def add(self, key: bytes, value: bytes) -> None:
        if self.n % RESTART == 0:
            self.restarts.append(self.size)
            shared = 0
        else:
            shared = len(os.path.commonprefix([key, self.last]))
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.block.append(entry)
        self.size += len(entry)
        self.n, self.last = self.n + 1, key
        self.keys.append(key)
        self.ids += len(value) // self.width
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.n:
            body = b"".join(self.block) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
            self.index.append(_varint(len(self.last)) + self.last + _varint(self.at) + _varint(len(body)))
            self._put(body)
            self._clear()

    def close(self) -> None:
        self._flush()
        at = self.at
        self._put(b"".join(self.index))
        bits = max(64, len(self.keys) * BLOOM_BITS)
        bloom = bytearray((bits + 7) // 8)
        for k in self.keys:
            for i in _bloom_bits(k, bits):
                bloom[i >> 3] |= 1 << (i & 7)
        bloom_at = self.at
        self._put(bytes(bloom))
        self._put(FOOTER.pack(at, bloom_at - at, bloom_at, bits, len(self.keys), self.ids, self.width, MAGIC))


class Reader:
    """Random and sequential access to one shard."""

    def __init__(self, path: str):
        system, name = arrow_path(path)
        self.file = system.open_input_file(name)
        size = self.file.size()
        tail = self.file.read_at(FOOTER.size, size - FOOTER.size)
        at, length, self.bloom_at, self.bits, self.n_keys, self.n_ids, self.width, magic = FOOTER.unpack(tail)
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        index, i = self.file.read_at(length, at), 0
        self.last_keys, self.blocks = [], []
        while i < len(index):
            n, i = _read_varint(index, i)
            self.last_keys.append(index[i : i + n])
            offset, i = _read_varint(index, i + n)
            n, i = _read_varint(index, i)
            self.blocks.append((offset, n))
        self.bloom = None

    def may_hold(self, key: bytes) -> bool:
        if self.bloom is None:
            self.bloom = self.file.read_at((self.bits + 7) // 8, self.bloom_at)
        return all(self.bloom[i >> 3] >> (i & 7) & 1 for i in _bloom_bits(key, self.bits))

    def _entries(self, block: int, start: int = 0) -> Iterator[tuple[bytes, bytes]]:
        offset, n = self.blocks[block]
        b = self.file.read_at(n, offset)
        (count,) = struct.unpack_from("<I", b, n - 4)
        end, key, i = n - 4 - 4 * count, b"", start
        while i < end:
            shared, i = _read_varint(b, i)
            rest, i = _read_varint(b, i)
            size, i = _read_varint(b, i)
            key = key[:shared] + b[i : i + rest]
            i += rest
            yield key, b[i : i + size]
            i += size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.blocks)):
            yield from self._entries(k)

    def get(self, key: bytes) -> list[bytes]:
        """Values of a key: Bloom filter, binary search of the index, then of the block's restarts."""
        if not self.may_hold(key):
            return []
        lo, hi = 0, len(self.last_keys)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.last_keys[mid] < key else (lo, mid)
        found = []
        while lo < len(self.blocks):
            for k, v in self._entries(lo, self._restart_before(lo, key)):
                if k == key:
                    found.append(v)
                elif k > key:
                    return found
            lo += 1
        return found

    def _restart_before(self, block: int, key: bytes) -> int:
        offset, n = self.blocks[block]
        b = self.file.read_at(n, offset)
        (count,) = struct.unpack_from("<I", b, n - 4)
        starts = struct.unpack_from(f"<{count}I", b, n - 4 - 4 * count)
        lo, hi = 0, count
        while lo < hi:
            mid = (lo + hi) // 2
            _, i = _read_varint(b, starts[mid])
            rest, i = _read_varint(b, i)
            _, i = _read_varint(b, i)
            lo, hi = (mid + 1, hi) if b[i : i + rest] < key else (lo, mid)
        return starts[max(lo - 1, 0)]


def byte_bpe_encoder(tokenizer_path: str):
    """(encode, width): ids of a column's texts as little-endian bytes, by the tokenizers library; special strings are plain text.

    A worker keeps its encoder, and with it the units it knows, for all its tasks.
    """
    if tokenizer_path in _ENCODERS:
        return _ENCODERS[tokenizer_path]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path)
    t.encode_special_tokens = True
    width = 2 if t.get_vocab_size() <= 1 << 16 else 4
    kind = np.dtype(f"<u{width}")
    pre = t.pre_tokenizer
    splits = type(pre).__name__ == "ByteLevel" and pre.use_regex and not pre.add_prefix_space and t.normalizer is None
    opens = np.zeros(t.get_vocab_size(), bool)
    opens[[i for p, i in t.get_vocab().items() if p.startswith("Ġ")]] = True

    def encode(units: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(units)
        plain = [i for i, u in enumerate(units) if PLAIN.fullmatch(u)] if splits else []
        # plain units are encoded as running text, cut again where a piece begins with their space
        for at in range(0, len(plain), 512):
            part = plain[at : at + 512]
            ids = np.array(t.encode("".join([units[i] for i in part]), add_special_tokens=False).ids, kind)
            cuts = [*np.flatnonzero(opens[ids]).tolist(), len(ids)]
            if len(cuts) != len(part) + 1:
                raise ValueError("a piece crosses a pre-token")
            raw = ids.tobytes()
            for k, i in enumerate(part):
                out[i] = raw[cuts[k] * width : cuts[k + 1] * width]
        seen = set(plain)
        rest = [i for i in range(len(units)) if i not in seen]
        for i, e in zip(rest, t.encode_batch([units[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, kind).tobytes()
        return out

    known = TokenTable(encode, kind)

    def encode_column(column: pa.Array) -> list[bytes]:
        out = []
        for _, _, s in slices(column):
            out += known(s, unit_edges(s.data, s.offsets) if splits else s.offsets[:-1])
        return out

    _ENCODERS[tokenizer_path] = encode_column, width
    return _ENCODERS[tokenizer_path]


def write(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, shard_bytes: int = 128 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards under ``path`` and return their manifest (shard, path, first_key, n_docs, n_ids)."""
    base = docs.select(F.col(id_col).cast("long").alias("k"), F.coalesce(text_col, F.lit("")).alias("t"))
    total = base.agg(F.sum(F.octet_length("t")).alias("b")).collect()[0].b or 0
    n = max(8, -(-total // shard_bytes))
    # rows of one id are split by text, so that a null id with many rows does not meet in one shard
    order = [F.col("k").asc_nulls_first(), F.xxhash64("t")]
    dealt = base.repartitionByRange(n, *order).sortWithinPartitions(*order, "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, width = byte_bpe_encoder(tokenizer_path)
        end = end_id.to_bytes(width, "little")
        system, root = arrow_path(path)
        part_id = TaskContext.get().partitionId()
        writer = first = temp = None
        try:
            for batch in batches:
                for at in range(0, len(batch), 256):
                    part = batch.slice(at, 256)
                    for key, ids in zip(part.column(0).to_pylist(), encode(part.column(1)), strict=True):
                        if writer is None:
                            first = key
                            name = f"{part_id:06d}-{'null' if key is None else f'{key + (1 << 63):020d}'}.sst"
                            system.create_dir(root, recursive=True)
                            temp = f"{root}/.{uuid.uuid4().hex}.tmp"
                            sink = system.open_output_stream(temp)
                            writer = Writer(sink, width)
                        writer.add(key_bytes(key), ids + end)
            if writer is not None:
                writer.close()
                sink.close()
                system.move(temp, f"{root}/{name}")
                temp = None
                yield pa.RecordBatch.from_pydict({"shard": [name], "path": [f"{path}/{name}"], "first_key": pa.array([first], pa.int64()), "n_docs": [len(writer.keys)], "n_ids": [writer.ids]})
        finally:
            if temp is not None:
                system.delete_file(temp)

    return materialise(dealt.mapInArrow(run, "shard string, path string, first_key long, n_docs long, n_ids long"), "manifest")



def offsets(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``: ids in the shards before, whose names are in order. One row a shard of ``shard_bytes`` of text."""
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(manifest: DataFrame, n_tasks: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every entry, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, start, ids in _stored(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(key, pa.int64()), "start": pa.array(start, pa.int64()), "n_tokens": pa.array(list(map(len, ids)), pa.int64()), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return offsets(manifest).select("path", "start").repartition(n_tasks).mapInArrow(run, "doc_id long, start long, n_tokens long, ids array<int>")


def digest(manifest: DataFrame, n_tasks: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every entry, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, start, ids in _stored(batches):
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(key, pa.int64()), "start": pa.array(start, pa.int64()), "n_tokens": pa.array(list(map(len, ids)), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return offsets(manifest).select("path", "start").repartition(n_tasks).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _stored(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
    for batch in batches:
        for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            reader = Reader(path)
            kind = np.dtype(f"<u{reader.width}")
            keys, starts, ids, size = [], [], [], 0
            for k, v in reader:
                keys.append(key_value(k))
                starts.append(at)
                ids.append(np.frombuffer(v, kind))
                at += len(ids[-1])
                size += len(v)
                if size > 1 << 22:
                    yield keys, starts, ids
                    keys, starts, ids, size = [], [], [], 0
            if keys:
                yield keys, starts, ids


def new_folder(docs: DataFrame) -> str:
    return fresh_path(docs.sparkSession, "sst")
