"""Byte-level BPE over ragged numpy arrays, and memos for texts that are cut at spaces."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import regex

from plumbline.llm.wordhash import BASES, BYTE_VALUES, ranges

#: The pre-tokenizer's pattern of the byte-level vocabularies (a fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.iinfo(np.int32).max


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class RankMerger:
    """Counts the BPE symbols of many byte strings at once, by rank-synchronous merging.

    The strings lie in one flat array of symbol ids. Each round finds every string's
    lowest-rank adjacent pair and merges all its occurrences, left to right, in all
    strings at once; strings without a mergeable pair leave the array with their count.
    """

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.symbols = np.array([vocab[s] for s in _byte_symbols()], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def counts(self, strings: list[bytes]) -> np.ndarray:
        sizes = np.array([len(s) for s in strings], np.int64)
        out = np.zeros(len(strings), np.int64)
        owner = np.repeat(np.arange(len(strings)), sizes)
        ids = self.symbols[np.frombuffer(b"".join(strings), np.uint8)]
        while len(ids):
            first = np.ones(len(ids), bool)
            first[1:] = owner[1:] != owner[:-1]
            start = np.flatnonzero(first)
            rank = np.full(len(ids), NONE, np.int32)  # of the pair that begins here
            rank[:-1] = np.where(first[1:], NONE, self.rank(ids[:-1], ids[1:]))
            lowest = np.minimum.reduceat(rank, start)
            length = np.diff(np.append(start, len(ids)))
            done = lowest == NONE
            out[owner[start[done]]] = length[done]
            hit = (rank == np.repeat(lowest, length)) & (rank != NONE)
            if (hit[1:] & hit[:-1]).any():  # a run of one symbol: take every other pair
                run = np.arange(len(hit))
                run -= np.maximum.accumulate(np.where(hit, 0, run + 1))
                hit &= run % 2 == 0
            ids[hit] = self.merged[rank[hit]]
            keep = np.repeat(~done, length)
            keep[1:] &= ~hit[:-1]
            ids, owner = ids[keep], owner[keep]
        return out


_OTHER, _LETTER, _SIGN, _SPACE, _NEWLINE, _WHITE = range(6)
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = _SIGN
for _range in ((65, 91), (97, 123)):
    _KIND[slice(*_range)] = _LETTER
_KIND[48:58] = _OTHER
_KIND[[9, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F]] = _WHITE
_KIND[0x20], _KIND[0x0A] = _SPACE, _NEWLINE
_PLAIN = np.zeros(256, bool)  # ASCII other than white space and control characters
_PLAIN[0x21:0x7F] = True
#: Bytes that can come second to last, and third to last, in white space beyond ASCII.
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0x80, 0x81, 0x9A]] = True


def units(texts: pa.Array, added: Iterable[str] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts texts where the pre-tokenizer cuts whatever stands around.

    Such places are before a space after no white space, between an ASCII letter and an
    ASCII sign, and around a newline between plain ASCII characters. A text with white space
    next to white space, or with an added token, is one unit. Returns start and end of all units, the first unit of
    each text (and one more), which texts are one unit, and all bytes. Null is as empty.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    n = len(data)
    whole = np.zeros(len(texts), bool)
    cut = np.zeros(n + 1, bool)
    if n > 1:
        kind, plain = _KIND[data], _PLAIN[data]
        white = kind >= _SPACE
        spaces = np.flatnonzero(kind == _SPACE)
        cut[spaces] = True
        cut[1:n] |= (kind[1:] == _SIGN) & (kind[:-1] == _LETTER)
        lines = np.flatnonzero(kind == _NEWLINE)
        lines = lines[(lines > 0) & (lines < n - 1)]
        lines = lines[plain[lines - 1] & plain[lines + 1]]
        cut[lines] = cut[lines + 1] = True
        double = np.flatnonzero(white[1:] & white[:-1]) + 1
        beyond = spaces[(spaces > 1)]
        beyond = beyond[(data[beyond - 1] > 0x7F) & _LEAD[data[beyond - 2]]]
        there = [m.start() for a in added for m in re.finditer(re.escape(a.encode()), data)]
        odd = np.concatenate([double, beyond, np.array(there, np.int64)])
        whole[np.searchsorted(offsets, odd, side="right") - 1] = True
        if whole.any():
            size = np.diff(offsets)
            cut[:n] &= ~np.repeat(whole, size)
    some = np.flatnonzero(np.diff(offsets) > 0)
    cut[offsets[some]] = True
    cut[n] = False
    start = np.flatnonzero(cut)
    return start, np.append(start[1:], n), np.searchsorted(start, offsets), whole, data


class Memo:
    """Values of texts put together from remembered values of their units.

    values_of gives, for unit strings, all their values in a row and how many each has;
    whole_of does so for texts that are one unit, by default alike. Units are known by a 64-bit hash of
    their bytes, in an open-addressing table of numpy arrays. The memo is only a cache:
    emptied when it holds most units, it never changes a value.
    """

    def __init__(self, values_of: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype: type, added: Iterable[str] = (), most: int = 1 << 19, whole_of: Callable[[list[str]], tuple[np.ndarray, np.ndarray]] | None = None):
        self.values_of, self.whole_of, self.dtype, self.added, self.most = values_of, whole_of or values_of, dtype, tuple(added), most
        self.slots = 1 << (4 * most - 1).bit_length()
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)
        self.entry = np.zeros(self.slots, np.int32)
        self.first, self.size, self.known = np.zeros(1024, np.int64), np.zeros(1024, np.int32), 0
        self.pool, self.used = np.zeros(1 << 14, self.dtype), 0

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        out, left = np.full(len(keys), -1, np.int32), np.arange(len(keys))
        at = (keys & np.uint64(self.slots - 1)).astype(np.int64)
        while len(left):
            there = self.keys[at]
            hit = there == keys[left]
            out[left[hit]] = self.entry[at[hit]]
            on = ~hit & (there != 0)
            left, at = left[on], (at[on] + 1) & (self.slots - 1)
        return out

    def _add(self, keys: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        n, to = self.known, self.known + len(keys)
        if to > len(self.first):
            self.first = np.append(self.first[:n], np.zeros(max(to, 2 * n) - n, np.int64))
            self.size = np.append(self.size[:n], np.zeros(max(to, 2 * n) - n, np.int32))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.append(self.pool[: self.used], np.zeros(max(2 * self.used, len(flat) + 1024), self.dtype))
        self.pool[self.used : self.used + len(flat)] = flat
        self.first[n:to], self.size[n:to] = self.used + np.cumsum(sizes) - sizes, sizes
        self.known, self.used = to, self.used + len(flat)
        left, at = np.arange(len(keys)), (keys & np.uint64(self.slots - 1)).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.keys[at] == 0)
            take = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[take]], self.entry[at[take]] = keys[left[take]], n + left[take]
            on = np.ones(len(left), bool)
            on[take] = False
            left, at = left[on], (at[on] + 1) & (self.slots - 1)

    def gather(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All values of the texts in order, and the first of each text (and one more)."""
        start, end, first, whole, data = units(texts, self.added)
        keys = ranges(BYTE_VALUES[data], BASES[0], start, end)
        keys[keys == 0] = 1
        once = np.zeros(len(keys), bool)  # units that aren't remembered
        once[first[:-1][whole]] = True
        entry = self._find(keys)
        new = np.flatnonzero((entry < 0) & ~once)
        raw = data.tobytes()
        if len(new):
            unique, at = np.unique(keys[new], return_index=True)
            if self.known + len(unique) > self.most:
                self._clear()
                unique, at = np.unique(keys[~once], return_index=True)
                new = np.flatnonzero(~once)
            at = new[at]
            for k in range(0, len(at), 1_000):
                some = at[k : k + 1_000]
                self._add(unique[k : k + 1_000], *self.values_of([raw[a:b].decode() for a, b in zip(start[some].tolist(), end[some].tolist(), strict=True)]))
            entry[new] = self._find(keys[new])
        own = np.flatnonzero(once)
        begin, size, pool = self.first[entry], self.size[entry].astype(np.int64), self.pool
        if len(own):
            extra, sizes = self.whole_of([raw[a:b].decode() for a, b in zip(start[own].tolist(), end[own].tolist(), strict=True)])
            begin[own], size[own] = self.used + np.cumsum(sizes) - sizes, sizes
            pool = np.concatenate([self.pool[: self.used], extra])
        total = np.append(0, np.cumsum(size))
        at = np.arange(total[-1]) + np.repeat(begin - total[:-1], size)
        return pool[at], total[first]


class TokenCounter:
    """Token counts under a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        odd = spec["normalizer"] or pre.get("add_prefix_space") or model.get("ignore_merges") or model.get("byte_fallback") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")
        strange = any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word"))
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or odd or strange:
            raise ValueError(f"{path} isn't a plain byte-level BPE vocabulary")
        self.merger = RankMerger(model["vocab"], model["merges"])
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.pattern = regex.compile(PIECES)
        self.memo = Memo(self._count, np.int64, added)

    def _count(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut, extra = [], []
        for part in parts:
            if self.added and (n := len(self.added.findall(part))):
                extra.append(n)
                cut.append([p for s in self.added.split(part) for p in self.pattern.findall(s)])
            else:
                extra.append(0)
                cut.append(self.pattern.findall(part))
        unique = list({p for c in cut for p in c})
        known: dict[str, int] = {}
        at = 0
        while at < len(unique):  # at most about 1 MB of pieces at once
            to, size = at, 0
            while to < len(unique) and size < 1 << 20:
                size += len(unique[to])
                to += 1
            known.update(zip(unique[at:to], self.merger.counts([p.encode() for p in unique[at:to]]).tolist(), strict=True))
            at = to
        return np.array([n + sum(map(known.__getitem__, c)) for n, c in zip(extra, cut, strict=True)], np.int64), np.ones(len(cut), np.int64)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text; 0 for null."""
        values, first = self.memo.gather(texts)
        total = np.append(0, np.cumsum(values))
        return np.diff(total[first])
