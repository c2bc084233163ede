"""SentencePiece encoding and decoding in batched numpy.

Words of equal length advance together: hashes of all their substrings probe the sorted piece keys, and array
operations keep, per position, the best piece that ends there and its back-pointer. The vocabulary is a scored BPE
model with byte fallback, where the best path isn't the one of the largest sum of scores but the one that merges in
order of score; a piece may therefore follow another only if the pair, taken alone, encodes to itself, which leaves
one way per prefix (see bpe.py). So ids equal those of the sentencepiece library. Words with runs of blanks, whose
pieces tie in score, are encoded by the library itself.

Null and empty texts give no ids. A text decodes to itself, but for U+2581, which the format uses for the blank.
Very long texts are read whole; repeated rows stay; an empty table gives an empty result; extra columns stay.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import bpe
from millrace.llm.common import free_names, lean, pieces_of, ragged, texts_of
from millrace.llm.pretokens import Cache, strings

BLANK = "▁"
_workers: dict = {}


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts with blanks marked, where words start (plus the end), and words per text."""
    marked = [BLANK + t.replace(" ", BLANK) if t else "" for t in texts]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.cumsum([len(t) for t in marked], dtype=np.int64)
    blank = points == ord(BLANK)
    start = np.ones(len(points) + 1, bool)
    start[:-1] = blank
    start[1:-1] &= ~blank[:-1]
    start[np.append(0, bounds)] = True
    at = np.flatnonzero(start)
    return points, at, np.diff(np.searchsorted(at[:-1], np.append(0, bounds)))


def _merges(model) -> bool:
    """Whether the model is of the BPE type: its scores are places in the order of merges, whole numbers, not log probabilities."""
    return all(model.get_score(i).is_integer() for i in range(model.get_piece_size()))


class SentencePieces:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        if not _merges(sp):
            raise ValueError(f"{path}: only models of the BPE type are supported")
        plain = [i for i in every if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = bpe.scored([(sp.id_to_piece(i), sp.get_score(i), i) for i in plain])
        byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in every if sp.is_byte(i)}
        self.byte_id = np.array([byte_ids.get(b, sp.unk_id()) for b in range(256)], np.int64)
        content = [b"" if sp.is_control(i) or sp.is_unknown(i) else bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(BLANK, " ").encode() for i in every]
        self.size = np.array([len(c) for c in content], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(content), np.uint8)
        self.cache = Cache(self.encode_words, split=_words, kind=np.uint16 if len(content) <= 1 << 16 else np.uint32, skip=1)

    def encode_words(self, points: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, spans of code points that begin with the blank mark, and ids per word."""
        blanks = np.append(0, np.cumsum(points == ord(BLANK)))
        rare = np.flatnonzero(blanks[first + lengths] - blanks[first] > 1)
        plain = lengths.copy()
        plain[rare] = 0
        ranks, places, sizes = self.pieces.encode(points, first, plain)
        ids = np.append(self.pieces.ids, -1)[ranks]
        lost = np.flatnonzero(ids < 0)  # characters without a piece are their bytes
        if len(lost):
            chars, which = np.unique(points[places[lost]], return_inverse=True)
            in_bytes = [self.byte_id[list(chr(c).encode("utf-8", "replace"))] for c in chars.tolist()]
            amount = np.array([len(b) for b in in_bytes])
            per_id = np.ones(len(ids), np.int64)
            per_id[lost] = amount[which]
            word = np.repeat(np.arange(len(sizes)), sizes)
            sizes = np.bincount(word, per_id, len(sizes)).astype(np.int64)
            ids = np.repeat(ids, per_id)
            ids[ragged((np.cumsum(per_id) - per_id)[lost], amount[which])] = np.concatenate([in_bytes[k] for k in which.tolist()])
        if len(rare):
            found = [self.library.encode(w[1:].replace(BLANK, " ")) for w in strings(points, first[rare], lengths[rare])]
            at = np.cumsum(sizes)[rare]
            ids = np.insert(ids, np.repeat(at, [len(x) for x in found]), np.array([i for x in found for i in x], np.int64))
            sizes[rare] = [len(x) for x in found]
        return ids, sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and ids per text."""
        return self.cache.ids(texts)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """Texts of runs of ids; bytes that aren't UTF-8 become U+FFFD."""
        ids = ids.astype(np.int64)
        raw = self.bytes[ragged(self.first[ids], self.size[ids])].tobytes()
        ends = np.append(0, np.cumsum(self.size[ids]))[np.append(0, np.cumsum(sizes))]
        texts = (raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
        return [t[1:] if t[:1] == " " else t for t in texts]


def codec(path: str) -> SentencePieces:
    """The model's codec, one per Python worker."""
    if path not in _workers:
        _workers[path] = SentencePieces(path)
    return _workers[path]


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """The rows with the column of ids (array of int) added; a column of that name is replaced."""
    kept = free_names(docs, ids_col).withColumn(text_col, F.col(text_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces_of(batch, text_col):
                ids, sizes = codec(path).encode(texts_of(piece.column(text_col)))
                column = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*piece.columns, column], names=[*piece.schema.names, ids_col])

    return kept.mapInArrow(lean(run), T.StructType([*kept.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """The rows with the decoded text added; a column of that name is replaced. Null ids give an empty text."""
    kept = free_names(tokens, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.array(x or [], np.int64) for x in batch.column(ids_col).to_pylist()]
            texts = codec(path).decode(np.concatenate([np.empty(0, np.int64), *ids]), np.array([len(x) for x in ids], np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text_col])

    return kept.mapInArrow(lean(run), T.StructType([*kept.schema.fields, T.StructField(text_col, T.StringType())]))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_crc32 (ids as little-endian unsigned 32-bit integers), text_crc32 of the decoded text's
    UTF-8, and whether it equals the text. Encodes and decodes in one pass, so no ids are shuffled or stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces_of(batch, text_col):
                texts = texts_of(piece.column(text_col))
                ids, sizes = codec(path).encode(texts)
                back = codec(path).decode(ids, sizes)
                ends = 4 * np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[b - 4 * n : b]) for n, b in zip(sizes.tolist(), ends.tolist(), strict=True)]
                crc_text = [zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in back]
                same = [a == b for a, b in zip(texts, back, strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column(id_col), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64()), pa.array(crc_text, pa.int64()), pa.array(same)], names=[id_col, "n_tokens", "ids_crc32", "text_crc32", "same"])

    chosen = docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return chosen.mapInArrow(lean(run), f"{id_col} bigint, n_tokens bigint, ids_crc32 bigint, text_crc32 bigint, same boolean")
