"""Splitting whole texts into pretokens in numpy, with a cache of what each distinct pretoken encodes to.

The pattern is the public one of byte-level vocabularies:
's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
Pretokens never share tokens, so each distinct one is encoded once and its result is used again.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from itertools import chain

import numpy as np
import regex

from millrace.llm.common import BETWEEN_WORDS, parts_of, prefix_hash, ragged, span_hash

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    if not _classes:
        out = np.full(0x110000, OTHER, np.uint8)
        text = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000))
        for k, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, text):
                out[m.start() : m.end()] = k
        _classes.append(out)
    return _classes[0]


def split(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts one after the other, where pretokens start (plus the end), and pretokens per text."""
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    sizes = np.array([len(t) for t in texts], np.int64)
    bounds = np.cumsum(sizes)
    first = np.zeros(n + 1, bool)
    first[np.append(0, bounds[:-1])[sizes > 0]] = True
    first[n] = True
    if not n:
        return points, np.zeros(1, np.int64), np.zeros(len(texts), np.int64)
    kind = classes()[points]
    start = np.empty(n + 1, bool)
    start[:-1] = True
    start[1:-1] = kind[1:] != kind[:-1]
    start[n] = True
    # the last of a run of white space before something else: on its own, or one blank joined to what follows
    tail = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:-1])
    start[tail] = True
    start[tail[points[tail] == 32] + 1] = False
    # contractions, where the apostrophe starts a pretoken
    q = np.flatnonzero(points == 39)
    q = q[start[q] | first[q]]
    if len(q):
        padded = np.append(points, [0, 0]).astype(np.int64)
        one, two = padded[q + 1], padded[q + 2]
        inside1 = ~first[np.minimum(q + 1, n)]
        inside2 = inside1 & ~first[np.minimum(q + 2, n)]
        short = inside1 & np.isin(one, [ord(c) for c in "stmd"])
        pair = one * 0x110000 + two
        long = inside2 & ~short & np.isin(pair, [ord(a) * 0x110000 + ord(b) for a, b in ("re", "ve", "ll")])
        hit = q[short | long]
        start[hit + 1] = False
        start[hit + np.where(long[short | long], 3, 2)] = True
    start |= first
    at = np.flatnonzero(start)
    return points, at, np.diff(np.searchsorted(at[:-1], np.append(0, bounds)))


def strings(points: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> list[str]:
    """The spans of a row of code points as texts."""
    whole = points.tobytes().decode("utf-32-le", "surrogatepass")
    return [whole[a : a + n] for a, n in zip(first.tolist(), lengths.tolist(), strict=True)]


class Cache:
    """What distinct pretokens encode to, kept by a Python worker from batch to batch; bounded, then begun anew."""

    def __init__(self, encode: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], limit: int = 1_000_000, split: Callable = split, kind: type = np.uint16, skip: int = 0):
        """skip: characters that `split` puts before each text itself, so a text cut there is given without them."""
        self.encode, self.limit, self.split, self.kind, self.skip = encode, limit, split, kind, skip
        self.clear()

    def clear(self) -> None:
        self.keys, self.first, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32)
        self.values, self.used = np.empty(1 << 16, self.kind), 0

    def look_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per pretoken of the texts the index of its distinct one, pretokens per text, where each distinct one's values
        start, how many they are, and how often it occurs."""
        points, at, per_text = self.split(texts)
        hashes = span_hash(prefix_hash(points), at[:-1], at[1:])
        keys, example, which, often = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        spot = np.searchsorted(self.keys, keys)
        known = spot < len(self.keys)
        known[known] = self.keys[spot[known]] == keys[known]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            if len(self.keys) + len(fresh) > self.limit:
                self.clear()
                fresh, spot = np.arange(len(keys)), np.zeros(len(keys), np.int64)
            e = example[fresh]
            values, sizes = self.encode(points, at[e], at[e + 1] - at[e])
            while self.used + len(values) > len(self.values):
                self.values = np.append(self.values, np.empty_like(self.values))
            self.values[self.used : self.used + len(values)] = values
            where = spot[fresh]
            self.keys = np.insert(self.keys, where, keys[fresh])
            self.first = np.insert(self.first, where, self.used + np.cumsum(sizes) - sizes)
            self.size = np.insert(self.size, where, sizes)
            self.used += len(values)
            spot = np.searchsorted(self.keys, keys)
        return which, per_text, self.first[spot], self.size[spot], often

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Values of all texts one after the other, and values per text. Long texts are encoded in parts."""
        total, out = np.zeros(len(texts), np.int64), [np.empty(0, self.kind)]
        for owner, part in parts_of(texts, BETWEEN_WORDS, skip=self.skip):
            values, sizes = self._ids(part)
            out.append(values)
            np.add.at(total, owner, sizes)
        return np.concatenate(out), total

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        which, per_text, first, size, _ = self.look_up(texts)
        sizes = size[which].astype(np.int64)
        ends = np.append(0, np.cumsum(sizes))
        edge = np.append(0, np.cumsum(per_text))
        return self.values[ragged(first[which], sizes)], np.diff(ends[edge])


_workers: dict[str, tuple] = {}


def library(path: str):
    """The tokenizers library's encoder of a vocabulary file, one per Python worker."""
    if path not in _workers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        kind = np.uint16 if tokenizer.get_vocab_size() <= 1 << 16 else np.uint32

        lines = tokenizer.encode("\n", add_special_tokens=False).ids

        def apart(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            found = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(found), kind), np.fromiter(map(len, found), np.int64, len(found))

        def together(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """One text of a line per pretoken, none of which holds or ends on white space: lines end where the line feed's id stands."""
            ids = np.array(tokenizer.encode_batch_fast(["\n".join(texts)], add_special_tokens=False)[0].ids, kind)
            end = ids == lines[0]
            if int(end.sum()) != len(texts) - 1:
                return apart(texts)
            edge = np.append(np.flatnonzero(end), len(ids))
            return ids[~end], np.diff(edge, prepend=-1) - 1

        def encode(points: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            blank = (classes()[points[first + lengths - 1]] == SPACE) | (len(lines) != 1)
            sizes, parts = np.zeros(len(first), np.int64), []
            some = np.flatnonzero(~blank)
            for at, way in [(np.flatnonzero(blank), apart), *((some[k : k + 8192], together) for k in range(0, len(some), 8192))]:
                if len(at):
                    ids, sizes[at] = way(strings(points, first[at], lengths[at]))
                    parts.append((at, ids))
            begin = np.cumsum(sizes) - sizes
            out = np.empty(int(sizes.sum()), kind)
            for at, ids in parts:
                out[ragged(begin[at], sizes[at])] = ids
            return out, sizes.astype(np.int32)

        special = sorted(t.content for t in tokenizer.get_added_tokens_decoder().values())
        _workers[path] = (tokenizer, Cache(encode, kind=kind), special)
    return _workers[path]


def encode_texts(path: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts as the tokenizers library gives them, one after the other, and ids per text.

    Texts that hold the string of a special token go to the library whole, as it treats them its own way.
    """
    tokenizer, cache, special = library(path)
    odd = [k for k, t in enumerate(texts) if any(s in t for s in special)]
    plain = list(texts)
    for k in odd:
        plain[k] = ""
    ids, sizes = cache.ids(plain)
    if odd:
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        for k in odd:
            parts[k] = np.array(tokenizer.encode(texts[k], add_special_tokens=False).ids, cache.kind)
        ids, sizes = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
    return ids, sizes
