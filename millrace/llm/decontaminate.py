"""Benchmark decontamination by latent semantic retrieval and longest common subsequences.

Benchmark items are passages of words (runs of letters, in lower case), weighted by TF-IDF, with document frequencies
counted over all documents. A distributed randomised SVD of the items' matrix gives the latent space: tasks hold some rows
each and send sums of their products with a narrow random matrix. (The space is that of the items, as the leading
directions of the corpus are those of its commonest words and would lose what tells items apart.) Documents are cut
into overlapping windows; a window whose latent cosine with an item is `min_cosine` or more is a candidate; windows without any word of the items have none. Of
candidates that have enough of the item's words around them at all, the longest common subsequence of the item's words with the words around the window decides: `min_overlap` of the item's
words in order make a leak; with `min_paraphrase`, which a rewording may leave, the item's answer (its last sentence, or
the last quarter of its words if there is one sentence) must be there to min_overlap as well.

Null and empty texts and items leak nothing. Items whose words occur nowhere else work like others. Items are indexed in
slices of bounded size, each kept in the shared folder; documents are read once to count words and once to be searched, whatever the number of
slices: a task holds a bounded share of its texts and one slice's index at a time. What comes to the driver is one slice's items at a
time, and the benchmark's vocabulary. Texts are read whole. Rows without
an id are judged, with a null id in the result; rows that repeat give their results again. Items of equal id count as one by the
best of them. An empty table on either side gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import U64, lean, mixed, pieces_of, ragged, shared_dir, texts_of, trim
from millrace.llm.toxicity import words

#: Words of a window, which starts every HALF words.
WINDOW = 32
HALF = WINDOW // 2
#: Bits of the hash of an item and a term.
PAIR_BITS = 24
#: Terms whose occurrences are multiplied as a matrix.
COMMON = 256
#: Items of a slice, and bytes of texts that a task searches with one slice's index before the next (it holds that many).
SLICE = 4096
HELD_BYTES = 8 << 20


@dataclass
class Index:
    """Latent space of a slice of items."""

    ids: list
    item_words: list[np.ndarray]
    answers: list[np.ndarray]
    terms: np.ndarray  # sorted hashes
    idf: np.ndarray
    space: np.ndarray  # term -> latent coordinates
    items: np.ndarray  # unit latent vectors of the items

    def __post_init__(self):
        #: Coordinates times weights; the commonest terms, and each term's place among them (-1: none).
        self.weighted = (self.idf[:, None] * self.space).astype(np.float32)
        self.common = np.argsort(self.idf, kind="stable")[:COMMON]
        self.often = np.full(len(self.terms), -1)
        self.often[self.common] = np.arange(len(self.common))


def _answer(text: str) -> str:
    """The last sentence; without a second one the last quarter of the words."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", text) if re.search(r"\w", s)]
    if len(sentences) > 1:
        return sentences[-1]
    parts = text.split()
    return " ".join(parts[-max(1, len(parts) // 4) :])


def _tfidf(h: np.ndarray, row: np.ndarray, n: int, terms: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of unit TF-IDF rows over the terms."""
    at = np.searchsorted(terms, h)
    key, tf = np.unique(row * len(terms) + at, return_counts=True)
    row, term = key // len(terms), key % len(terms)
    w = tf * idf[term]
    return row, term, w / np.sqrt(np.bincount(row, w * w, n))[row]


def randomised_svd(items: DataFrame, terms: np.ndarray, idf: np.ndarray, rank: int, text_col: str, rounds: int = 2, extra: int = 16, seed: int = 7) -> np.ndarray:
    """Leading right singular vectors (terms x rank) of the rows' TF-IDF matrix A.

    Each round multiplies by A'A: tasks send, for the terms of their rows, sums of A'(A Q); the driver orthonormalises
    (terms x (rank + extra) numbers, bounded by the slice's words).
    """
    width = min(rank + extra, len(terms))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(terms), width)))[0]

    def product(q: np.ndarray) -> np.ndarray:
        shared = items.sparkSession.sparkContext.broadcast(q)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = texts_of(batch.column(text_col))
                h, row = words(texts)
                row, term, w = _tfidf(h, row, len(texts), terms, idf)
                left = np.zeros((len(texts), width))
                np.add.at(left, row, w[:, None] * shared.value[term])
                own, where = np.unique(term, return_inverse=True)
                out = np.zeros((len(own), width))
                np.add.at(out, where, w[:, None] * left[row])
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([x.tobytes() for x in out], pa.binary())], names=["term", "sums"])

        total = np.zeros((len(terms), width))
        for r in items.select(text_col).mapInArrow(lean(run), "term bigint, sums binary").toLocalIterator():
            total[r.term] += np.frombuffer(r.sums)
        shared.destroy()
        return total

    for _ in range(rounds):
        q = np.linalg.qr(product(q))[0]
    # Rayleigh-Ritz in the space found
    small = q.T @ product(q)
    value, vector = np.linalg.eigh((small + small.T) / 2)
    keep = np.argsort(-value)[: min(rank, width)]
    keep = keep[value[keep] > 1e-9 * max(value.max(), 1e-300)]
    return q @ vector[:, keep]


def _frequencies(docs: DataFrame, terms: np.ndarray, text_col: str) -> np.ndarray:
    """Inverse document frequencies of the terms over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        total, n = np.zeros(len(terms), np.int64), 0
        for batch in batches:
            for piece in pieces_of(batch, text_col):
                term, doc, _ = _known(texts_of(piece.column(text_col)), terms)
                pair = np.unique(doc * len(terms) + term)
                total += np.bincount(pair % len(terms), minlength=len(terms))
                n += piece.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["term", "n"])

    found = docs.select(text_col).mapInArrow(lean(run), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    shared.destroy()
    df = np.zeros(len(terms) + 1, np.int64)
    df[found["term"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return np.log((1 + df[-1]) / (1 + df[:-1])) + 0.1


def _known(texts: list[str], terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Term and text of each word that is a term; hash and text of all words, and where among them the terms are."""
    h, doc = words(texts)
    maybe = np.zeros(1 << 20, bool)
    maybe[terms >> U64(44)] = True
    near = np.flatnonzero(maybe[h >> U64(44)])
    at = np.minimum(np.searchsorted(terms, h[near]), len(terms) - 1)
    hit = terms[at] == h[near]
    return at[hit], doc[near[hit]], (h, doc, near[hit])


def vocabulary(items: DataFrame, text_col: str) -> np.ndarray:
    """Hashes of all words of the items, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(words(texts_of(batch.column(text_col)))[0]).view(np.int64))], names=["term"])

    found = items.select(text_col).mapInArrow(lean(run), "term bigint").distinct().toPandas()
    return np.sort(found["term"].to_numpy(np.int64).view(U64))


def index(items: DataFrame, every: np.ndarray, idf_of: np.ndarray, rank: int = 256, id_col: str = "item_id", item_text: str = "text") -> Index | None:
    """The index of one slice of items (a bounded table), with the inverse document frequencies of every word; None if no item has words."""
    # rows' order doesn't matter, but must not change between reads
    rows = items.select(F.col(id_col).alias("id"), F.col(item_text).cast("string").alias(item_text)).orderBy("id", item_text).toPandas()
    texts = [t or "" for t in rows[item_text].tolist()]
    h, row = words(texts)
    terms = np.unique(h)
    if not len(terms):
        return None
    idf = idf_of[np.searchsorted(every, terms)]
    full = np.flatnonzero(np.bincount(row, minlength=len(texts)))
    cut = np.split(h, np.searchsorted(row, np.arange(1, len(texts))))
    space = randomised_svd(items.select(F.col(item_text).cast("string").alias(item_text)).repartition(4), terms, idf, rank, item_text)
    r, t, w = _tfidf(h, row, len(texts), terms, idf)
    latent = np.zeros((len(texts), space.shape[1]))
    np.add.at(latent, r, w[:, None] * space[t])
    norm = np.sqrt((latent**2).sum(axis=1))
    full = full[norm[full] > 0]
    return Index(
        [int(x) if x == x and x is not None else None for x in rows["id"].iloc[full].tolist()],
        [cut[i] for i in full],
        [words([_answer(texts[i])])[0] for i in full],
        terms,
        idf,
        space.astype(np.float32),
        (latent[full] / norm[full][:, None]).astype(np.float32),
    )


def common_length(masks: dict[int, int], size: int, row: list[int]) -> int:
    """Length of the longest common subsequence of a row with the words whose places `masks` has, bits in parallel."""
    full = (1 << size) - 1
    v = full
    for x in row:
        m = masks.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def _masks(row: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, x in enumerate(row.tolist()):
        out[x] = out.get(x, 0) | 1 << k
    return out


def _candidates(index: Index, texts: list[str], min_cosine: float) -> tuple[np.ndarray, ...]:
    """(window's first half-block, item) of candidates, the half-blocks' first words and texts, the words' hashes, words per
    text, and places and numbers of the words that are terms."""
    term, _, (h, doc, place) = _known(texts, index.terms)
    count = np.bincount(doc, minlength=len(texts))
    halves = -(-count // HALF)
    first_half = np.cumsum(halves) - halves
    first_word = np.cumsum(count) - count
    block = first_half[doc[place]] + (place - first_word[doc[place]]) // HALF
    total = int(halves.sum())
    starts = np.repeat(first_word, halves) + HALF * (np.arange(total) - np.repeat(first_half, halves))
    owner = np.repeat(np.arange(len(texts)), halves)
    known = np.bincount(block, minlength=total)
    joined = np.zeros(total, bool)  # whether the next half-block is of the same text
    joined[:-1] = owner[1:] == owner[:-1]
    # a window without any word of the items has no cosine
    live = np.flatnonzero(known + np.where(joined, np.append(known[1:], 0), 0))
    none = np.empty(0, np.int64)
    if not len(live):
        return none, none, starts, owner, h, count, place, term
    edge = np.searchsorted(block, np.arange(total + 1))
    need = np.unique(np.concatenate([live, live[joined[live]] + 1]))
    size = edge[need + 1] - edge[need]
    at = ragged(edge[need], size)
    out_w, out_i = [none], [none]
    sums = np.zeros((len(need) + 1, index.space.shape[1]), np.float32)
    ends = np.append(0, np.cumsum(size))
    for a in range(0, len(need), 4096):
        b = min(len(need), a + 4096)
        part = at[ends[a] : ends[b]]
        own, where = term[part], np.repeat(np.arange(b - a), size[a:b])
        # the commonest terms, which most occurrences are of, by a matrix of counts; the others one by one
        row = index.often[own]
        many = row >= 0
        counts = np.bincount(where[many] * len(index.common) + row[many], minlength=(b - a) * len(index.common))
        sums[a:b] = counts.reshape(b - a, -1).astype(np.float32) @ index.weighted[index.common]
        few = np.flatnonzero(~many)
        if len(few):
            first = np.flatnonzero(np.append(True, where[few][1:] != where[few][:-1]))
            sums[a + where[few][first]] += np.add.reduceat(index.weighted[own[few]], first, axis=0)
    spot = np.searchsorted(need, live)
    after = np.where(joined[live], np.searchsorted(need, live + 1), len(need))
    for a in range(0, len(live), 8192):
        v = sums[spot[a : a + 8192]] + sums[after[a : a + 8192]]
        norm = np.sqrt((v * v).sum(axis=1))
        cosine = v @ index.items.T
        w, i = np.nonzero(cosine >= min_cosine * np.maximum(norm, 1e-20)[:, None])
        out_w.append(live[a + w])
        out_i.append(i)
    return np.concatenate(out_w), np.concatenate(out_i), starts, owner, h, count, place, term


def _pair_bits(index: Index) -> np.ndarray:
    """Whether an item has a term, by a hash of both; it may say yes wrongly, never no."""
    out = np.zeros(1 << PAIR_BITS, bool)
    for i, row in enumerate(index.item_words):
        out[_pair(i, np.searchsorted(index.terms, row))] = True
    return out


def _pair(item: np.ndarray | int, term: np.ndarray) -> np.ndarray:
    return mixed((np.asarray(item, U64) << U64(32)) + term.astype(U64)) >> U64(64 - PAIR_BITS)


def _shared_words(bits: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray, place: np.ndarray, term: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For some candidates at a time: their numbers, the terms between places low and high that the item has too (and a few that it may
    not have), one candidate after the other, and how many each has. No common subsequence is longer."""
    first, last = np.searchsorted(place, low), np.searchsorted(place, high)
    for a in range(0, len(item), 8192):
        size = (last - first)[a : a + 8192]
        near = term[ragged(first[a : a + 8192], size)]
        hit = bits[_pair(np.repeat(item[a : a + 8192], size), near)]
        yield np.arange(a, a + len(size)), near[hit], np.bincount(np.repeat(np.arange(len(size)), size)[hit], minlength=len(size))


def leaks(docs: DataFrame, benchmark: DataFrame, min_cosine: float = 0.4, min_overlap: float = 0.8, min_paraphrase: float = 0.65, rank: int = 256, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item id, overlap) of all documents and items that leak into them; overlap: share of the item's words found in order."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    items = benchmark.select(F.col(item_id).cast("bigint").alias(item_id), F.col(item_text).cast("string").alias(item_text))
    slices = max(1, -(-items.count() // SLICE))
    every = vocabulary(items, item_text)
    idf = _frequencies(docs, every, text_col) if len(every) else np.zeros(0)
    folder, files = shared_dir(spark, "leak-index"), []
    for k in range(slices):
        found = index(items.where(F.pmod(F.xxhash64(item_text), F.lit(slices)) == k), every, idf, rank, item_id, item_text)
        if found is not None:
            files.append(_kept(folder, k, found))
    trim()
    out = docs.mapInArrow(lean(_search(files, min_cosine, min_overlap, min_paraphrase, id_col, text_col, item_id)), f"{id_col} bigint, {item_id} bigint, overlap double")
    return out if slices == 1 else out.groupBy(id_col, item_id).agg(F.max("overlap").alias("overlap"))


def _kept(folder: str, number: int, index: Index) -> str:
    """The file that holds a slice's index."""
    fs, inner = pafs.FileSystem.from_uri(folder)
    fs.create_dir(inner, recursive=True)
    with fs.open_output_stream(f"{inner}/{number}.index") as f:
        f.write(pickle.dumps(index))
    return f"{folder}/{number}.index"


def _loaded(file: str) -> tuple:
    """A slice's index, and what the checks need of its items."""
    fs, inner = pafs.FileSystem.from_uri(file)
    with fs.open_input_stream(inner) as f:
        index: Index = pickle.loads(f.read())
    numbers = [[np.searchsorted(index.terms, x) for x in rows] for rows in (index.item_words, index.answers)]  # an answer's words are its item's
    masks = [(_masks(w), len(w), _masks(a), len(a)) for w, a in zip(*numbers, strict=True)]
    return index, masks, _pair_bits(index), np.array([len(w) for w in index.item_words])


def _search(files: list[str], min_cosine: float, min_overlap: float, min_paraphrase: float, id_col: str, text_col: str, item_id: str):
    def found(loaded: tuple, piece: pa.RecordBatch, memo: dict[tuple[bytes, int], float]) -> pa.RecordBatch:
        index, masks, bits, sizes = loaded
        texts = texts_of(piece.column(text_col))
        window, item, starts, owner, h, count, place, term = _candidates(index, texts, min_cosine)
        ends = np.cumsum(count)
        doc = owner[window]
        low = np.maximum((ends - count)[doc], starts[window] - sizes[item])
        high = np.minimum(ends[doc], starts[window] + WINDOW + sizes[item])
        best: dict[tuple[int, int], float] = {}
        for who, near, n in _shared_words(bits, low, high, item, place, term):
            ends_of = np.cumsum(n)
            for k in np.flatnonzero(n >= min_paraphrase * sizes[item[who]]).tolist():
                i, row = int(item[who[k]]), near[ends_of[k] - n[k] : ends_of[k]]
                key = (row.tobytes(), i)
                if key not in memo:
                    if len(memo) > 20_000:
                        memo.clear()
                    own, size, answer, answer_size = masks[i]
                    words_in_order = row.tolist()
                    share = common_length(own, size, words_in_order) / size
                    if share < min_paraphrase or (share < min_overlap and common_length(answer, answer_size, words_in_order) < min_overlap * answer_size):
                        share = 0.0
                    memo[key] = share
                if memo[key]:
                    d = int(doc[who[k]])
                    best[d, i] = max(best.get((d, i), 0.0), memo[key])
        ids = piece.column(id_col).to_pylist()
        merged: dict[tuple[int, int | None], float] = {}
        for (d, i), share in best.items():
            merged[d, index.ids[i]] = max(merged.get((d, index.ids[i]), 0.0), share)
        return pa.RecordBatch.from_pydict({id_col: pa.array([ids[d] for d, _ in merged], pa.int64()), item_id: pa.array([i for _, i in merged], pa.int64()), "overlap": pa.array(list(merged.values()), pa.float64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        loaded: tuple | None = None  # the last slice's index: the only one where there is one slice
        number, memo = -1, {}

        def searched() -> Iterator[pa.RecordBatch]:
            nonlocal loaded, number
            for k in range(len(files)):
                if number != k:
                    loaded, number = None, k
                    memo.clear()
                    loaded = _loaded(files[k])
                for piece in held:
                    yield found(loaded, piece, memo)

        for batch in batches:
            for piece in pieces_of(batch, text_col):
                held.append(piece)
                size += piece.nbytes
                if size >= HELD_BYTES or len(files) == 1:
                    yield from searched()
                    held, size = [], 0
        yield from searched()

    return run


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of documents into which no item leaks, with all their columns, whatever their names. Rows without an id stay, as no
    result can name them."""
    bad = leaks(docs, benchmark, id_col=id_col, text_col=text_col, **settings).select(F.col(id_col).alias("__leaking")).distinct()
    joined = docs.alias("d").join(bad.alias("b"), F.col(f"d.{id_col}").cast("bigint") == F.col("b.__leaking"), "left_anti")
    return joined.select("d.*")
