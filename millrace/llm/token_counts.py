"""Token counts by prefix dynamic programming: the exact count at every prefix of a text.

One pass from left to right gives the number of tokens of every prefix, so questions about truncation and
budgets are look-ups: no text is encoded again. Tokens never cross pretokens, so each distinct pretoken goes
through the dynamic programme once per worker and its counts are used wherever it occurs.

Null and empty texts have no tokens. Very long texts are read whole, in pieces of bounded memory. Repeated rows
stay as they are; an empty table gives an empty result. Columns of `docs` other than the id and the text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import bpe, pretokens
from millrace.llm.common import BETWEEN_WORDS, lean, parts_of, pieces_of, ragged, texts_of

_workers: dict[str, tuple] = {}


def _counter(path: str) -> tuple[pretokens.Cache, list[str], bpe.Pieces]:
    if path not in _workers:
        pieces = bpe.byte_level(path)

        def counts(points: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            own = points[ragged(first, lengths)]
            raw = np.frombuffer(own.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
            width = np.append(0, np.cumsum(1 + (own > 0x7F) + (own > 0x7FF) + (own > 0xFFFF)))
            edge = width[np.append(0, np.cumsum(lengths))]
            return pieces.counts(raw, edge[:-1], np.diff(edge)), np.diff(edge)

        special = sorted(t.content for t in pretokens.library(path)[0].get_added_tokens_decoder().values())
        _workers[path] = (pretokens.Cache(counts, kind=np.int32), special, pieces)
    return _workers[path]


def _parts(text: str, special: list[str]) -> list[tuple[str, bool]]:
    """The text cut at the strings of special tokens, which are one token each; the leftmost and longest first."""
    if not special:
        return [(text, False)]
    cut = re.split("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")", text)
    return [(part, k % 2 == 1) for k, part in enumerate(cut)]


def _measured(path: str, texts: list[str], limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per text, and per text the UTF-8 bytes of all leading pretokens that `limit` tokens hold. Long texts are counted in parts."""
    cache, special, _ = _counter(path)
    cut = [_parts(t, special) if any(s in t for s in special) else [(t, False)] for t in texts]
    whose = np.repeat(np.arange(len(texts)), [len(parts) for parts in cut])
    flat = [p for parts in cut for p in parts]
    is_special = np.array([s for _, s in flat], bool)
    total, fit = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for part, group in parts_of([t for t, _ in flat], BETWEEN_WORDS):
        # special strings stand as one pretoken of one token
        which, per_part, first, size, _ = cache.look_up([t if not s else "" for t, s in zip(group, is_special[part].tolist(), strict=True)])
        at = np.cumsum(per_part)[is_special[part]]
        tokens = np.insert(cache.values[first + size - 1].astype(np.int64)[which], at, 1)
        sizes = np.insert(size.astype(np.int64)[which], at, [len(t.encode()) for t, s in zip(group, is_special[part].tolist(), strict=True) if s])
        owner = np.repeat(whose[part], per_part + is_special[part])
        so_far = np.cumsum(tokens)
        start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))[: len(owner)]
        before = np.repeat((so_far - tokens)[start], np.diff(np.append(start, len(owner)))) if len(owner) else so_far
        fits_in = so_far - before + total[owner] <= limit
        np.add.at(fit, owner[fits_in], sizes[fits_in])
        np.add.at(total, owner, tokens)
    return total, fit


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens), and fit_bytes: the bytes of the
    leading pretokens that fit into `limit` tokens, which is where a text may be cut without encoding it again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces_of(batch, text_col):
                texts = texts_of(piece.column(text_col))
                n, fit = _measured(path, texts, limit)
                bytes_ = np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64)
                yield pa.RecordBatch.from_arrays([piece.column(id_col), pa.array(bytes_), pa.array(n), pa.array(n > limit), pa.array(fit)], names=[id_col, "n_bytes", "n_tokens", "over_limit", "fit_bytes"])

    chosen = docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return chosen.mapInArrow(lean(run), f"{id_col} bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_bytes bigint")


def prefix_counts(texts: list[str], path: str) -> list[np.ndarray]:
    """For each text the exact token count of each of its prefixes of 0, 1, 2, ... code points."""
    cache, special, pieces = _counter(path)
    out = []
    for text in texts:
        counts, base = [np.zeros(1, np.int64)], 0
        for part, is_special in _parts(text, special):
            if is_special:
                # before its last character, the string is ordinary text
                inner = [base + len(pretokens.library(path)[0].encode(part[:k], add_special_tokens=False).ids) for k in range(1, len(part))]
                base += 1
                counts.append(np.array([*inner, base], np.int64))
                continue
            points, at, _ = pretokens.split([part])
            which, _, first, size, _ = cache.look_up([part])
            before = 0  # tokens before the white space that leads up to a blank joined to a word
            for k, w in enumerate(which):
                word = part[at[k] : at[k + 1]]
                own = cache.values[first[w] : first[w] + size[w]].astype(np.int64)
                ends = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in word]) - 1
                row = base + own[ends]
                if len(word) == 3 and word in ("'re", "'ve", "'ll"):
                    row[1] = base + 2  # cut short, these are an apostrophe and a letter
                lead = part[at[k - 1] : at[k]] if k else ""
                if all(pretokens.classes()[ord(c)] == pretokens.SPACE for c in (lead or "x")[-1] + word[0]):
                    # a text that ends on this white space has it in one run with that before it
                    run = np.frombuffer((lead + word[0]).encode(), np.uint8)
                    row[0] = before + int(pieces.counts(run, np.zeros(1, np.int64), np.array([len(run)]))[-1])
                before = base
                base += int(own[-1])
                counts.append(row)
        out.append(np.concatenate(counts))
    return out


def fits(counts: np.ndarray, budget: int) -> int:
    """The longest prefix, in code points, that has at most `budget` tokens; counts as of prefix_counts."""
    return int(np.flatnonzero(counts <= budget)[-1])
