"""Encoding of texts that fall into units which a tokenizer encodes one by one: each distinct unit is encoded once."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd

from .textscan import Slice, U, same_bytes, wide_view


class TokenTable:
    """``encode``: list of units to their ids as bytes. Units are named by 64-bit hashes and their ids gathered in numpy;
    the bytes of every unit are compared with those that its name was first met with, and a unit that differs is encoded by itself.

    Names stand in a table of ``slots`` places, found by linear probing of whole arrays. When more than half of it
    is taken, or about ``most_ids`` ids are remembered, all is forgotten.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], kind: np.dtype, slots: int = 1 << 22, most_ids: int = 1 << 23):
        self.encode, self.kind, self.slots, self.most_ids = encode, kind, slots, most_ids
        self.forget()

    def forget(self) -> None:
        self.name, self.place = np.zeros(self.slots, U), np.zeros(self.slots, np.int32)
        self.n = self.used = 0
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, self.kind)
        # the bytes of each unit
        self.text_start, self.text_size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.text, self.text_used = np.zeros(1 << 18, np.uint8), 0
        self.wide = wide_view(self.text)

    def _room(self, units: int, ids: int, text: int) -> None:
        while self.n + units > len(self.start):
            self.start, self.length, self.text_start, self.text_size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.text_start, self.text_size))
        while self.text_used + text + 8 > len(self.text):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
            self.wide = wide_view(self.text)
        while self.used + ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])

    def _find(self, names: np.ndarray) -> np.ndarray:
        """The unit of each name, or -1."""
        out, left = np.full(len(names), -1, np.int64), np.arange(len(names))
        slot = (names & U(self.slots - 1)).astype(np.int64)
        while len(left):
            there = self.name[slot]
            hit = there == names[left]
            out[left[hit]] = self.place[slot[hit]]
            more = ~hit & (there != 0)
            left, slot = left[more], (slot[more] + 1) & (self.slots - 1)
        return out

    def _enter(self, names: np.ndarray, units: np.ndarray) -> None:
        """Place distinct new names."""
        slot = (names & U(self.slots - 1)).astype(np.int64)
        while len(names):
            free = self.name[slot] == 0
            self.name[slot[free]] = names[free]
            won = self.name[slot] == names
            self.place[slot[won]] = units[won]
            names, units, slot = names[~won], units[~won], (slot[~won] + 1) & (self.slots - 1)

    def _learn(self, units: list[bytes], names: np.ndarray) -> None:
        for at in range(0, len(units), 4096):
            some = units[at : at + 4096]
            raw = list(self.encode([u.decode("utf-8", "replace") for u in some]))
            flat, text = np.frombuffer(b"".join(raw), self.kind), np.frombuffer(b"".join(some), np.uint8)
            sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // self.kind.itemsize
            spans = np.fromiter(map(len, some), np.int64, len(some))
            self._room(len(raw), len(flat), len(text))
            new = slice(self.n, self.n + len(raw))
            self.ids[self.used : self.used + len(flat)] = flat
            self.text[self.text_used : self.text_used + len(text)] = text
            self.start[new], self.length[new] = self.used + np.cumsum(sizes) - sizes, sizes
            self.text_start[new], self.text_size[new] = self.text_used + np.cumsum(spans) - spans, spans
            if at < len(names):
                self._enter(names[at : at + 4096], np.arange(self.n, self.n + len(raw), dtype=np.int32))
            self.n, self.used, self.text_used = self.n + len(raw), self.used + len(flat), self.text_used + len(text)

    def __call__(self, s: Slice, cuts: np.ndarray) -> list[bytes]:
        """The joined encodings of each text of a slice; units begin at the offsets ``cuts`` and at each text's start."""
        first = np.zeros(len(s.data) + 1, bool)
        first[cuts] = first[s.offsets] = True
        begin = np.flatnonzero(first[:-1])
        end = np.append(begin[1:], len(s.data))[: len(begin)]
        code, names = pd.factorize(np.maximum(s.span_hash(begin, end), U(1)))
        # a slice may bring more units than the table should take
        if self.n + len(names) > self.slots // 2 or max(self.used, self.text_used >> 2) > self.most_ids:
            self.forget()
            while len(names) > self.slots // 2:
                self.slots *= 2
                self.forget()
        where = self._find(names)
        fresh = np.flatnonzero(where < 0)
        raw = s.data.tobytes() if len(fresh) else b""
        if len(fresh):
            first = np.zeros(len(names), np.int64)
            first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
            base = self.n
            self._learn([raw[i:j] for i, j in zip(begin[first[fresh]].tolist(), end[first[fresh]].tolist(), strict=True)], names[fresh])
            where[fresh] = np.arange(base, self.n)
        where = where[code]
        # a unit must have the bytes that its name stands for; others are encoded under no name
        span = end - begin
        odd = span != self.text_size[where]
        odd[~odd] = ~same_bytes(s.wide, begin[~odd], self.wide, self.text_start[where[~odd]], span[~odd])
        if odd.any():
            base, other = self.n, np.flatnonzero(odd)
            self._learn([s.data[i:j].tobytes() for i, j in zip(begin[other], end[other], strict=True)], np.zeros(0, U))
            where[other] = np.arange(base, self.n)
        size = self.length[where]
        upto = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=upto[1:])
        out = self.ids[np.repeat(self.start[where] - upto[:-1], size) + np.arange(upto[-1])].tobytes()
        edges = (upto[np.searchsorted(begin, s.offsets)] * self.kind.itemsize).tolist()
        return [out[edges[i] : edges[i + 1]] for i in range(s.n)]
