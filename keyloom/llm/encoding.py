"""Texts to token ids with the library a vocabulary file belongs to, with a bounded cache of pieces.

A byte-level BPE splits a text by a pattern before it merges. At a single space between two visible characters that
pattern always splits: no alternative of it continues over a space that follows a visible character, and the match
that begins at the space looks at nothing before it. A single line end between visible characters is a match of its own,
and no alternative joins a letter with a stop or comma behind it. So the ids of a text are those of its pieces between
such places, joined, and each different piece needs the library once. Pieces are found by hashes of all of a batch at once,
and then compared byte by byte with what the cache holds. Vocabularies for which the split is not proven are encoded
whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from keyloom.llm.hashing import BYTES, INVERSE, ODD, mixed, powers

#: White space within a piece, which then is encoded alone.
JOINT = re.compile(r"\s")
#: Bytes beside a space at which no cut is made: white space and control characters, and what white space of several
#: bytes may begin with.
WIDE = (0xC2, 0xE1, 0xE2, 0xE3)
_AFTER = np.arange(256) > 32
_AFTER[list(WIDE)] = False
_STOP, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True
_LETTER[list(range(65, 91)) + list(range(97, 123))] = True
_U = np.uint64


def is_cut(text: str, p: int) -> bool:
    """Whether the pattern surely splits `text` before `p`."""
    return 0 < p < len(text) - 1 and text[p] == " " and not text[p - 1].isspace() and not text[p + 1].isspace()


def cuts(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces begin in texts that lie one after the other: at each text; at single spaces, and at and behind single
    line ends, between visible characters (beside what might be wide white space none is taken); and at a stop or comma
    behind an ASCII letter."""
    blank = np.flatnonzero((buf == 32) | (buf == 10))
    edge = np.zeros(len(buf) + 1, bool)
    edge[starts] = edge[ends - 1] = True
    blank = blank[~edge[blank]]
    before = buf[blank - 1]
    good = (before > 32) & _AFTER[buf[blank + 1]]
    high = np.flatnonzero(good & (before >= 0x80))
    # A text's first character may be what stands before: then the bytes before it are not looked at, or do no harm.
    for back in (2, 3):
        good[high] &= ~np.isin(buf[np.maximum(blank[high] - back, 0)], WIDE)
    blank = blank[good]
    stops = np.flatnonzero(_STOP[buf])
    stops = stops[stops > 0]
    keep = np.zeros(len(buf), bool)
    keep[blank] = True
    keep[blank[buf[blank] == 10] + 1] = True
    keep[stops[_LETTER[buf[stops - 1]]]] = True
    keep[starts] = True
    return np.flatnonzero(keep)


def piece_hashes(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    h = BYTES[buf]
    h *= powers(ODD, len(h))
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(h)])
    return mixed((sums[end] - sums[begin]) * powers(INVERSE, len(h))[begin] + (end - begin).astype(_U))


def _reach(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... n times for each."""
    ends = np.cumsum(n, dtype=np.int64)
    return np.repeat(first - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)


class Encoder:
    """ids and counts of texts, as the library gives them without begin, end or added special tokens."""

    def __init__(self, path: str, max_pieces: int = 1_000_000, max_bytes: int = 64 << 20):
        self.max_pieces, self.max_bytes, self.path = max_pieces, max_bytes, path
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._whole = lambda texts: model.encode(texts, num_threads=1)
            self.by_piece = False
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
            self._whole = lambda texts: [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            with open(path, encoding="utf-8") as f:
                made = json.load(f)
            pre = made.get("pre_tokenizer") or {}
            plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not made.get("normalizer")
            opens = [i for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items() if t.startswith("Ġ")]  # how a space is written
            self.opens = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True) + 1, bool)
            self.opens[opens] = True
            self.by_piece = plain and all(" " not in t["content"] and not t["lstrip"] and not t["rstrip"] for t in made.get("added_tokens") or [])
        self._clear()

    def _clear(self) -> None:
        """The cache: hashes in order, and for each the place of its piece; of each piece its bytes and its ids."""
        self.known, self.place = np.zeros(0, _U), np.zeros(0, np.int64)
        self.data, self.data_start, self.data_n = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.start, self.n = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encoded(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces' places in a new order, how many ids each has, and the ids one after the other. Pieces with no
        white space but the one they begin with are encoded many at a time: that space is where each one's ids begin."""
        texts = [p.decode() for p in pieces]
        plain = np.fromiter((t[:1] == " " and not JOINT.search(t, 1) for t in texts), bool, len(texts))
        alone = np.flatnonzero(~plain).tolist()
        order, sizes, ids = [], [], []
        joined = np.flatnonzero(plain)
        groups = [joined[a : a + 256] for a in range(0, len(joined), 256)]
        for own, found in zip(groups, self._whole(["".join([texts[i] for i in g.tolist()]) for g in groups])):
            flat = np.array(found, np.uint32)
            at = np.flatnonzero(self.opens[flat])
            if len(at) == len(own) and at[0] == 0:
                order.append(own)
                sizes.append(np.diff(at, append=len(flat)))
                ids.append(flat)
            else:
                alone += own.tolist()
        if alone:
            found = self._whole([texts[i] for i in alone])
            order.append(np.array(alone, np.int64))
            sizes.append(np.array([len(x) for x in found], np.int64))
            ids.append(np.array([i for x in found for i in x], np.uint32))
        return np.concatenate(order), np.concatenate(sizes), np.concatenate(ids)

    def _add(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        own, n, flat = self._encoded(pieces)
        pieces, hashes = [pieces[i] for i in own.tolist()], hashes[own]
        size = np.array([len(p) for p in pieces], np.int64)
        first = len(self.n)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(n) - n])
        self.data_start = np.concatenate([self.data_start, len(self.data) + np.cumsum(size) - size])
        self.n, self.data_n = np.concatenate([self.n, n]), np.concatenate([self.data_n, size])
        self.flat = np.concatenate([self.flat, flat])
        self.data = np.concatenate([self.data, np.frombuffer(b"".join(pieces), np.uint8)])
        order = np.argsort(hashes, kind="stable")
        spot = np.searchsorted(self.known, hashes[order])
        self.known, self.place = np.insert(self.known, spot, hashes[order]), np.insert(self.place, spot, first + order)

    def _pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cache places of all pieces of the texts one after the other, and how many each text has."""
        raw = [t.encode() for t in texts]
        size = np.array([len(t) for t in raw], np.int64)
        ends = np.cumsum(size)
        data = b"".join(raw)
        if not data:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        buf, some = np.frombuffer(data, np.uint8), size > 0
        begin = cuts(buf, (ends - size)[some], ends[some])
        end = np.append(begin[1:], len(buf))
        if len(self.known) > self.max_pieces or len(self.data) > self.max_bytes:
            self._clear()
        u, which = np.unique(piece_hashes(buf, begin, end), return_inverse=True)
        spot = np.searchsorted(self.known, u)
        new = np.flatnonzero(spot == len(self.known)) if not len(self.known) else np.flatnonzero(self.known[np.minimum(spot, len(self.known) - 1)] != u)
        if len(new):
            one = np.empty(len(u), np.int64)
            one[which] = np.arange(len(which))
            self._add(u[new], [data[begin[i] : end[i]] for i in one[new].tolist()])
            spot = np.searchsorted(self.known, u)
        at = self.place[spot][which]
        n = end - begin
        same = np.array_equal(self.data_n[at], n) and np.array_equal(self.data[_reach(self.data_start[at], n)], buf)
        if not same:  # two pieces with one hash: place the batch's pieces by themselves
            self._clear()
            parts = [data[a:b] for a, b in zip(begin.tolist(), end.tolist())]
            seen = {p: i for i, p in enumerate(dict.fromkeys(parts))}
            self._add(np.arange(len(seen), dtype=_U), list(seen))
            at = self.place[[seen[p] for p in parts]]
            self.known, self.place = self.known[:0], self.place[:0]  # not to be found again
        many = np.diff(np.searchsorted(begin, np.concatenate([ends - size, [len(buf)]])))
        return at, many

    def counts(self, texts: list[str]) -> np.ndarray:
        if not self.by_piece:
            return np.array([len(x) for x in self._whole(texts)], np.int64)
        at, many = self._pieces(texts)
        ends = np.concatenate([[0], np.cumsum(self.n[at], dtype=np.int64)])
        last = np.concatenate([[0], np.cumsum(many)])
        return ends[last[1:]] - ends[last[:-1]]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_piece:
            return [np.array(x, np.uint32) for x in self._whole(texts)]
        at, many = self._pieces(texts)
        n = self.n[at]
        ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        flat = self.flat[_reach(self.start[at], n)]
        return np.split(flat, ends[np.cumsum(many)][:-1]) if len(texts) else []


_made: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, max_pieces: int = 1_000_000) -> Encoder:
    """One encoder a Python worker, kept between tasks; its cache is bounded by pieces and bytes (about 150 MB)."""
    if (path, max_pieces) not in _made:
        _made[path, max_pieces] = Encoder(path, max_pieces)
    return _made[path, max_pieces]


def in_groups(texts: list, chars: int = 1_000_000):
    """Consecutive (from, to) of the list with about so many characters, to bound memory."""
    a = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= chars:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)
