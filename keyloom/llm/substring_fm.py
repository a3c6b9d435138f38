"""Substring dedup of words with compressed FM-indexes.

Windows of `k` words meet in shards (see `routing`). A shard keeps its distinct segments in an FM-index: the
Burrows-Wheeler transform of their words in a wavelet matrix, and prefix sums of how many places in the corpus each
suffix stands for. The segments are streamed against it by backward search, all at once: a matching statistic is the
longest stretch to the left of an end that has at least two places. A failed search rules out every window that holds
the stretch and one word more, so the next search starts behind it; matching statistics of at least `k` words are
intervals to remove.

Defined cases: null and blank texts have no words; texts under `k` words have no window; a window that occurs twice in
one document is repeated; rows with the same doc_id (null too) are separate documents; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
from pyspark.sql import DataFrame

from keyloom.llm.routing import Segments, Units, route


class WaveletMatrix:
    """Rank of symbols in a sequence: a bit vector for each bit of the symbols, the highest first."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.words, self.sums, self.zeros = [], [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            padded = np.zeros((len(packed) // 8 + 2) * 8, np.uint8)
            padded[: len(packed)] = packed
            words = padded.view("<u8")
            self.words.append(words)
            self.sums.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]).astype(np.int32))
            self.zeros.append(int(len(symbols) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def walk(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where the symbols before `place` end up that take the path of `symbol`."""
        for i, (words, sums, zeros) in enumerate(zip(self.words, self.sums, self.zeros)):
            at = place >> 6
            ones = sums[at] + np.bitwise_count(words[at] & ((np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)))
            place = np.where((symbol >> (self.bits - 1 - i)) & 1, zeros + ones, place - ones)
        return place


def suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array by prefix doubling; equal prefixes of `depth` symbols stay in any order."""
    n = len(text)
    rank, step = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 2) + ahead
        order = np.argsort(key)
        new = np.empty(n, np.int64)
        ranked = key[order]
        new[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])]) if n else 0
        rank, step = new, 2 * step
        if n == 0 or rank.max() == n - 1 or step >= depth:
            return order


class FmIndex:
    def __init__(self, segments: list[np.ndarray], places: np.ndarray, top: int, depth: int):
        """Symbols are 1 to `top`; 0 ends a segment. Matches of up to `depth` symbols are found."""
        size = np.array([len(s) + 1 for s in segments], np.int64)
        self.text = np.zeros(int(size.sum()), np.int32)
        self.start = np.cumsum(size) - size
        inner = np.ones(len(self.text), bool)
        inner[self.start + size - 1] = False
        self.text[inner] = np.concatenate(segments)
        order = suffixes(self.text, depth)
        before = self.text[order - 1]
        self.matrix = WaveletMatrix(before, top)
        counts = np.bincount(self.text, minlength=top + 1)
        self.first = np.cumsum(counts) - counts
        symbols = np.arange(top + 1)
        self.base = self.first - self.matrix.walk(symbols, np.zeros(top + 1, np.int64))
        self.weight = np.concatenate([[0], np.cumsum(np.where(inner, np.repeat(places, size), 0)[order])])

    def match(self, ends: np.ndarray, most: np.ndarray) -> np.ndarray:
        """For each end in the text, how many symbols before it (at most `most`) stand in two places or more."""
        length = np.zeros(len(ends), np.int64)
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), len(self.text), np.int64)
        live = np.flatnonzero(most > 0)
        while len(live):
            symbol = self.text[ends[live] - length[live] - 1]
            base = self.base[symbol]
            a, b = base + self.matrix.walk(symbol, low[live]), base + self.matrix.walk(symbol, high[live])
            found = self.weight[b] - self.weight[a] >= 2
            live = live[found]
            low[live], high[live] = a[found], b[found]
            length[live] += 1
            live = live[length[live] < most[live]]
        return length


def repeated(texts: list[bytes], places: np.ndarray, least: np.ndarray, u: Units) -> np.ndarray:
    """1 for each window of each text that has two places or more, else 0."""
    k = u.k
    ids: dict[bytes, int] = {}
    words = [np.array([ids.setdefault(w, len(ids) + 1) for w in t.split(b" ")], np.int64) for t in texts]
    size = np.array([len(w) for w in words], np.int64)
    index = FmIndex(words, places, len(ids), int(size.max()) + 1)
    windows = size - k + 1
    base = np.cumsum(windows) - windows
    marks = np.zeros(int(windows.sum()) + 1, np.int64)  # +1 and -1 at the ends of marked runs

    def mark(seg: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        np.add.at(marks, base[seg] + a, 1)
        np.add.at(marks, base[seg] + b, -1)

    all_segs = np.arange(len(texts))
    length = index.match(index.start + size, size)
    long = length >= k
    mark(all_segs[long], (size - length)[long], windows[long])
    # What is left begins before the matched end; a shorter match rules the last window out.
    bound = np.where(long, size - length, windows - 1)
    at, run = np.zeros(len(texts), np.int64), np.ones(len(texts), np.int64)
    live = np.flatnonzero(at < bound)
    while len(live):
        run[live] = np.minimum(run[live], bound[live] - at[live])
        want = k + run[live] - 1
        end = at[live] + want
        length = index.match(index.start[live] + end, want)
        whole = length == want
        done = live[whole]
        mark(done, at[done], at[done] + run[done])
        at[done] += run[done]
        run[done] *= 2
        rest, got, stop = live[~whole], length[~whole], end[~whole]
        tried = run[rest] == 1
        at[rest[tried]] = (stop - got)[tried]
        run[rest] = 1
        live = live[at[live] < bound[live]]
    return (np.cumsum(marks)[:-1] > 0).astype(np.int64)


def covered(size: int, where: np.ndarray, k: int) -> np.ndarray:
    """Units that a window starting at one of the places covers."""
    starts = np.zeros(size + k + 1, np.int32)
    starts[where] = 1
    starts[k:] -= starts[:-k].copy()
    return np.cumsum(starts, dtype=np.int32)[:size] > 0


def dedup_words(docs: DataFrame, k: int = 35, m: int = 8, **sizes) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by a space, as bytes) for every row."""

    def finish(s: Segments, ids: np.ndarray, where: np.ndarray, value: np.ndarray) -> dict[str, list]:
        gone = covered(int(s.size.sum()), where[value == 1], k)
        ends = np.cumsum(s.size)
        lost, kept = [], []
        for a, b in zip((ends - s.size).tolist(), ends.tolist()):
            part = gone[a:b]
            lost.append(int(part.sum()))
            text = s.content(a, b) if b > a else b""
            kept.append(b" ".join(compress(text.split(b" "), (~part).tolist())) if lost[-1] else text)
        return {"n_words": s.size, "n_removed": lost, "kept": kept}

    frequent = {"frequent": sizes.pop("frequent")} if "frequent" in sizes else {}
    return route(docs, Units(k, m, True, **frequent), repeated, lambda places, least: (places >= 2).astype(np.int64), finish, "n_words long, n_removed long, kept binary", **sizes)
