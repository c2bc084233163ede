"""Exact byte-pair encoding by dynamic programming over prefixes, batched in numpy.

A sequence of tokens is the encoding of its text exactly when each two neighbours, taken alone,
encode to themselves. So each prefix of a word has one last token: the piece that ends there and
is compatible with the last token of the prefix before it. That gives, in one pass from left to right,
the encoding and the token count of every prefix.

Words of equal length advance together: hashes of their substrings probe sorted piece keys, and
array operations keep the back-pointers and counts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np

from millrace.llm.common import U64, mixed, powers, symbol_values

_NONE = np.int64(1) << 40
#: Symbols in one block of equal-length words.
BLOCK = 1 << 19


class Pieces:
    """Pieces of a vocabulary, numbered by the order in which merges make them (single symbols first)."""

    def __init__(self, symbols: list[tuple[int, ...]], ids: list[int], joins: np.ndarray, splits: np.ndarray, reachable: np.ndarray | bool = True):
        """symbols: each piece's symbols, in order of rank; ids: their ids in the vocabulary.

        joins: rows (left rank, right rank, joined rank), splits: rows (left, right) of each piece.
        reachable: whether a piece, as a text, encodes to itself; others never come up.
        """
        self.ids = np.asarray(ids, np.int64)
        self.left, self.right = splits[:, 0].copy(), splits[:, 1].copy()
        key = (joins[:, 0] << 32) | joins[:, 1]
        order = np.argsort(key, kind="stable")
        self.join_key, self.joined = key[order], joins[order, 2].copy()
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        lengths = np.array([len(s) for s in symbols])
        for n in np.unique(lengths):
            at = np.flatnonzero((lengths == n) & reachable)
            if not len(at):
                continue
            rows = np.array([symbols[i] for i in at], np.int64).reshape(len(at), int(n))
            raw = (symbol_values(rows) * powers(int(n))[0][None, :-1]).sum(axis=1, dtype=U64)
            order = np.argsort(raw)
            maybe = np.zeros(1 << 18, bool)  # tells most hashes that are no piece's, before the search
            maybe[raw >> U64(46)] = True
            self.by_length[int(n)] = (raw[order], at[order], maybe)
        self.seen, self.verdict = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        self.unknown = len(symbols)  # the rank of symbols that no piece holds
        self.left = np.append(self.left, self.unknown)
        self.right = np.append(self.right, self.unknown)

    def joined_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.join_key, key), len(self.join_key) - 1)
        return np.where(self.join_key[at] == key, self.joined[at], _NONE)

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether the two pieces, put together, encode to just these two; remembers pairs seen lately."""
        key = (first << 32) | second
        slot = (mixed(key.view(U64)) >> U64(44)).astype(np.int64)
        good = self.verdict[slot]
        new = np.flatnonzero(self.seen[slot] != key)
        if len(new):
            good[new] = self._compatible(first[new], second[new])
            # of several new pairs for a slot the same one must win in both tables
            slots, one = np.unique(slot[new], return_index=True)
            self.seen[slots], self.verdict[slots] = key[new[one]], good[new[one]]
        return good

    def _compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether the two pieces, put together, encode to just these two.

        Undoes, step by step, whichever of the two merges next to the seam came later; a merge across the
        seam that ranks before the step just undone would have come first, so the pair can't stand.
        """
        a, b = first.copy(), second.copy()
        limit = np.full(len(a), _NONE)
        good, live = np.zeros(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            stays = self.joined_rank(x, y) >= limit[live]
            live, x, y = live[stays], x[stays], y[stays]
            later_left = x > y
            cap = np.where(later_left, x, y + 1)
            x2, y2 = np.where(later_left, self.right[x], x), np.where(later_left, y, self.left[y])
            stuck_left, stuck_right = later_left & (x2 == x), ~later_left & (y2 == y)
            # A single symbol can't be undone: the other side goes on.
            y2 = np.where(stuck_left, self.left[y], y2)
            x2 = np.where(stuck_right, self.right[x], x2)
            cap = np.where(stuck_left, y + 1, np.where(stuck_right, x, cap))
            done = (stuck_left & (y2 == y)) | (stuck_right & (x2 == x))
            good[live[done]] = True
            a[live], b[live], limit[live] = x2, y2, cap
            live = live[~done]
        return good

    def prefixes(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For words of one length (rows of symbols): last piece, its start and the count, of every prefix.

        Column i stands for the prefix of i symbols; column 0 for the empty one.
        """
        n, width = rows.shape
        value = symbol_values(rows)
        ahead, back_power = powers(width)
        prefix = np.zeros((n, width + 1), U64)
        np.cumsum(value * ahead[None, :-1], axis=1, out=prefix[:, 1:])
        found = {}
        for length, (keys, ranks, maybe) in self.by_length.items():
            if length > width:
                continue
            h = (prefix[:, length:] - prefix[:, : width + 1 - length]) * back_power[None, : width + 1 - length]
            flat = h.T.ravel()  # by position, then word
            spot = np.flatnonzero(maybe[flat >> U64(46)])
            at = np.searchsorted(keys, flat[spot])
            at[at == len(keys)] = 0
            hit = keys[at] == flat[spot]
            spot, rank = spot[hit], ranks[at[hit]]
            if length == 1 and len(spot) < n * width:
                every = np.full(n * width, self.unknown)
                every[spot] = rank
                spot, rank = np.arange(n * width), every
            if len(spot):
                found[length] = (spot % n, rank, np.searchsorted(spot, n * np.arange(width + 2 - length)))
        last = np.full((n, width + 1), -1, np.int64)
        start = np.zeros((n, width + 1), np.int32)
        count = np.zeros((n, width + 1), np.int32)
        for end in range(1, width + 1):
            who, rank, frm = [], [], []
            for length, (word, ranks, edge) in found.items():
                if length <= end and edge[end - length] < edge[end - length + 1]:
                    here = slice(edge[end - length], edge[end - length + 1])
                    who.append(word[here])
                    rank.append(ranks[here])
                    frm.append(np.full(here.stop - here.start, end - length, np.int32))
            w, r, f = np.concatenate(who), np.concatenate(rank), np.concatenate(frm)
            before = last[w, f]
            fits = before < 0
            test = np.flatnonzero(~fits)
            fits[test] = self.compatible(before[test], r[test])
            w, r, f = w[fits], r[fits], f[fits]
            last[w, end], start[w, end], count[w, end] = r, f, count[w, f] + 1
        return last, start, count

    def encode(self, symbols: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For words, which are spans of a row of symbols: ranks of all words' tokens one after the other, where in the
        row each token starts, and tokens per word."""
        amount = np.zeros(len(first), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (word, rank, start) of tokens, from the last to the first
        for at, n in self._blocks(lengths):
            last, start, count = self.prefixes(symbols[first[at][:, None] + np.arange(n)])
            amount[at] = count[:, n]
            live, pos = np.arange(len(at)), np.full(len(at), n)
            while len(live):
                rank, pos = last[live, pos], start[live, pos]
                parts.append((at[live], rank, first[at[live]] + pos))
                live, pos = live[pos > 0], pos[pos > 0]
        offset = np.cumsum(amount) - amount
        ranks, places = np.empty(int(amount.sum()), np.int64), np.empty(int(amount.sum()), np.int64)
        left = amount.copy()
        for who, rank, place in parts:
            left[who] -= 1
            spot = offset[who] + left[who]
            ranks[spot], places[spot] = rank, place
        return ranks, places, amount

    def counts(self, symbols: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For words, which are spans of a row of symbols: tokens of each prefix but the empty one, one word after the other."""
        offset = np.cumsum(lengths) - lengths
        out = np.empty(int(lengths.sum()), np.int32)
        for at, n in self._blocks(lengths):
            out[offset[at][:, None] + np.arange(n)] = self.prefixes(symbols[first[at][:, None] + np.arange(n)])[2][:, 1:]
        return out

    @staticmethod
    def _blocks(lengths: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """Words of one length, in blocks of bounded size."""
        order = np.argsort(lengths, kind="stable")
        edges = np.flatnonzero(np.diff(lengths[order], prepend=-1, append=-1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            n = int(lengths[order[a]])
            step = max(1, BLOCK // max(n, 1))
            for k in range(a, b if n else a, step):
                yield order[k : min(b, k + step)], n


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes.

    Printable Latin-1 bytes stand for themselves; the rest, in order, for the code points from 256 on.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def byte_level(path: str) -> Pieces:
    """Pieces of a byte-level vocabulary file (.json); symbols are bytes."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    byte_of, vocab = byte_symbols(), model["vocab"]
    rank = {c: k for k, c in enumerate(byte_of)}
    joins, order, splits = [], list(byte_of), [(k, k) for k in range(len(byte_of))]
    for pair in model["merges"]:
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        k = rank.setdefault(a + b, len(order))
        if k == len(order):
            order.append(a + b)
            splits.append((rank[a], rank[b]))
        joins.append((rank[a], rank[b], k))
    symbols = [tuple(byte_of[c] for c in s) for s in order]
    return Pieces(symbols, [vocab[s] for s in order], np.array(joins, np.int64), np.array(splits, np.int64))


def scored(pieces: list[tuple[str, float, int]]) -> Pieces:
    """Pieces of a scored vocabulary (text, score, id): any two pieces join if their text is a piece; higher scores first.

    Symbols are code points.
    """
    single = [p for p in pieces if len(p[0]) == 1]
    longer = sorted((p for p in pieces if len(p[0]) > 1), key=lambda p: -p[1])
    order = single + longer
    rank = {p[0]: k for k, p in enumerate(order)}
    joins, splits, reachable = [], [(k, k) for k in range(len(single))], [True] * len(single)
    for text, _, _ in longer:
        joins += [(rank[text[:i]], rank[text[i:]], rank[text]) for i in range(1, len(text)) if text[:i] in rank and text[i:] in rank]
        parts = _merged(text, rank)
        reachable.append(len(parts) == 2 and parts[0] + parts[1] == text and text in rank)
        splits.append((rank[parts[0]], rank[parts[1]]) if reachable[-1] else (rank[text], rank[text]))
    symbols = [tuple(map(ord, p[0])) for p in order]
    return Pieces(symbols, [p[2] for p in order], np.array(joins, np.int64), np.array(splits, np.int64), np.array(reachable))


def _merged(text: str, rank: dict[str, int]) -> list[str]:
    """The parts that merging in order of rank leads to, just before the last merge if that makes the whole text."""
    parts = list(text)
    while len(parts) > 2:
        best = min(((rank.get(parts[i] + parts[i + 1], _NONE), i) for i in range(len(parts) - 1)))
        if best[0] == _NONE:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts
