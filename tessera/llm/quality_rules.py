"""Quality rules: characters inside repeated n-grams and repeated lines, by rolling hashes in numpy.

Null and empty texts have no words: all counts are 0, every share is 0 and they fail the base rule. Repeated
rows are judged one by one. An empty table gives an empty result. Extra columns are ignored (``profile``) or
passed on untouched (``filter_documents``). Very long texts are read whole, in a slice of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textscan import U, Slice, mix, ngrams, same_bytes, slices

#: Limits on the share of a text's word characters inside repeated word n-grams, by n (fixed values).
NGRAM_LIMITS = {5: 0.15, 7: 0.13, 10: 0.10}


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    repeat_window: int = 3
    max_repeat_percent: int = 50
    ngram_limits: tuple[tuple[int, float], ...] = tuple(NGRAM_LIMITS.items())
    max_dup_line_chars: float = 0.20


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags: the key occurs more than once; the key occurred earlier."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    many, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    many[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return many, later


def _repeated_lines(s: Slice, starts: np.ndarray, ends: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """Whether an earlier line of the same text has the same bytes: found by hash, held to by the bytes."""
    with np.errstate(over="ignore"):
        keys = s.span_hash(starts, ends) ^ mix(text_of.astype(U) + U(0x2545F491))
    order = np.argsort(keys, kind="stable")
    met = np.flatnonzero(keys[order][1:] == keys[order][:-1]) + 1
    a, b = order[met - 1], order[met]
    same = (text_of[a] == text_of[b]) & (ends[a] - starts[a] == ends[b] - starts[b])
    same[same] = same_bytes(s.wide, starts[a[same]], s.wide, starts[b[same]], (ends - starts)[b[same]])
    later = np.zeros(len(starts), bool)
    if same.all():
        later[b] = True
        return later
    # unlike lines that share a hash
    seen: set[tuple[int, bytes]] = set()
    for i in range(len(starts)):
        line = int(text_of[i]), s.data[starts[i] : ends[i]].tobytes()
        later[i] = line in seen
        seen.add(line)
    return later


def _covered(at: np.ndarray, n: int, total: int) -> np.ndarray:
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(s: Slice, rules: Rules) -> dict[str, np.ndarray]:
    """Counts and shares of each text of a slice."""
    words, of = s.words(), s.word_text()
    with np.errstate(over="ignore"):
        salt = mix(of.astype(U) + U(0x51ED270B))
    points = np.zeros(len(s.data) + 1, np.int64)
    np.cumsum((s.data & 0xC0) != 0x80, out=points[1:])
    chars = points[s.ends] - points[s.starts]
    out = {"n_words": np.diff(s.bounds), "word_chars": _per_text(chars, s.bounds), "n_symbols": _per_text(_SYMBOL[s.data], s.offsets)}
    at, h = ngrams(words, s.bounds, rules.repeat_window)
    many, _ = _again(h ^ salt[at]) if len(at) else (np.zeros(0, bool), None)
    out["n_repeat_words"] = _per_text(_covered(at[many], rules.repeat_window, len(words)), s.bounds)
    whole = np.maximum(out["word_chars"], 1)
    for n, _ in rules.ngram_limits:
        at, h = ngrams(words, s.bounds, n)
        _, later = _again(h ^ salt[at]) if len(at) else (None, np.zeros(0, bool))
        hit = at[later]
        out[f"dup_{n}gram_chars"] = _per_text(np.where(_covered(hit, n, len(words)), chars, 0), s.bounds) / whole if len(hit) else np.zeros(s.n)
    # lines that hold a word
    breaks = np.flatnonzero(s.data == 10)
    starts = np.concatenate([s.offsets[:-1], breaks + 1])
    text_of = np.concatenate([np.arange(s.n), np.searchsorted(s.offsets, breaks, "right") - 1])
    order = np.lexsort((starts, text_of))
    starts, text_of = starts[order], text_of[order]
    ends = np.empty_like(starts)
    ends[:-1] = np.where(text_of[1:] == text_of[:-1], starts[1:] - 1, s.offsets[text_of[:-1] + 1])
    ends[-1:] = s.offsets[text_of[-1:] + 1]
    full = np.searchsorted(s.starts, ends) > np.searchsorted(s.starts, starts)
    starts, ends, text_of = starts[full], ends[full], text_of[full]
    if len(starts):
        later = _repeated_lines(s, starts, ends, text_of)
    else:
        later = np.zeros(0, bool)
    out["n_dup_lines"] = np.bincount(text_of[later], minlength=s.n)[: s.n]
    n_lines = np.bincount(text_of, minlength=s.n)[: s.n]
    first, last = np.searchsorted(s.starts, starts), np.searchsorted(s.starts, ends)
    total = np.concatenate([[0], np.cumsum(chars)])
    line_chars = total[last] - total[first]
    out["dup_line_share"] = out["n_dup_lines"] / np.maximum(n_lines, 1)
    out["dup_line_chars"] = np.bincount(text_of[later], weights=line_chars[later], minlength=s.n)[: s.n] / whole
    out["base_failed"] = (out["n_words"] < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_percent * out["n_words"])
    bad = out["dup_line_chars"] > rules.max_dup_line_chars
    for n, limit in rules.ngram_limits:
        bad |= out[f"dup_{n}gram_chars"] > limit
    out["kept"] = ~out["base_failed"] & ~bad
    return out


def profile(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts, shares of characters inside repetitions, ``base_failed`` and ``kept``."""
    shares = [f"dup_{n}gram_chars" for n, _ in rules.ngram_limits] + ["dup_line_share", "dup_line_chars"]
    id_type = dict(docs.dtypes)[id_col]
    schema = f"{id_col} {id_type}, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in shares) + ", base_failed boolean, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, j, s in slices(batch.column(1)):
                m = measure(s, rules)
                cols = [pa.array(m[c], pa.int64()) for c in COUNTS] + [pa.array(m[c], pa.float64()) for c in shares] + [pa.array(m[c]) for c in ("base_failed", "kept")]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), *cols], [id_col, *COUNTS, *shares, "base_failed", "kept"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def filter_documents(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, with all their columns; decided where they are read, without a join."""
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, s in slices(batch.column(where)):
                yield batch.slice(i, j - i).filter(pa.array(measure(s, rules)["kept"]))

    return docs.mapInArrow(run, docs.schema)
