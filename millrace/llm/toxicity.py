"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Learning takes a bounded sample of labelled rows (`max_examples`, those of the smallest hashes of ids) and all their
words. Document frequencies are counted over all documents. A word's weight is its TF-IDF times sqrt(1 + its chi-square with the
label), so what tells labels apart counts the more the better the labels show it, and no word is left out. Words that no example has only scale a text's cosines alike, so
they are left out of its length too.
The examples' vectors go into an inverted index whose postings are cut into blocks of examples; each word keeps its
largest weight per block. Words that very many examples have are multiplied first, as a matrix; of the others, blocks
whose best possible cosine can't reach the k-th so far are skipped without loss. The neighbours vote, each with its cosine as weight; an
isotonic fit of the examples' own leave-one-out votes turns votes into probabilities. Neighbours' ids are the evidence.

Null and empty texts, and texts without any of the examples' words, get the rate among such examples. Ties between
neighbours go to the earlier example. Rows that repeat are scored alike, one by one; rows of a null id are scored and never
held out. Null labels and labels without a document teach nothing. Without any usable label every score is 0.
Extra columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import pretokens
from millrace.llm.common import U64, lean, parts_of, pieces_of, prefix_hash, ragged, span_hash, texts_of, trim

FOLDS = 5
BLOCK = 64
#: Texts that are compared with the examples at a time, and their words (those of one text at least).
GROUP = 64
ENTRIES = 4096
#: Terms that more than one in COMMON examples have are multiplied as a matrix.
COMMON = 16
#: Where long texts may be cut (every such character isn't a letter).
NOT_A_LETTER = re.compile(r"[\W\d_]")
_lower: list[np.ndarray] = []


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row takes no part in learning: crc32 of the id as text, modulo FOLDS, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _lower_table() -> np.ndarray:
    if not _lower:
        out = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x30000):
            if not 0xD800 <= c < 0xE000 and len(x := chr(c).lower()) == 1:
                out[c] = ord(x)
        _lower.append(out)
    return _lower[0]


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of letters, in lower case, and the number of the text that each is in. Long texts are taken in parts."""
    found = [(owner, *_words(part)) for owner, part in parts_of(texts, NOT_A_LETTER)]
    return np.concatenate([np.empty(0, U64), *(h for _, h, _ in found)]), np.concatenate([np.empty(0, np.int64), *(owner[doc] for owner, _, doc in found)])


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    points = _lower_table()[points]
    letter = np.zeros(len(points) + 1, np.int8)
    letter[:-1] = pretokens.classes()[points] == pretokens.LETTER
    step = np.diff(letter, prepend=0)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    edges = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    return span_hash(prefix_hash(points), start, end), np.searchsorted(edges, start, side="right")


@dataclass
class Model:
    """Terms (sorted hashes), their idf (times what the labels say of them), examples' ids and labels, postings by term and example, and the calibration."""

    terms: np.ndarray
    idf: np.ndarray
    ids: np.ndarray
    label: np.ndarray
    cells: np.ndarray  # term -> its first cell; a cell is a term's postings within a block of examples. One more entry closes it
    block: np.ndarray  # of each cell
    start: np.ndarray  # cell -> its first posting; one more entry closes it
    most: np.ndarray  # cell -> largest weight
    posting: np.ndarray  # example of each posting
    weight: np.ndarray
    common: np.ndarray  # term -> its row in table, or -1
    table: np.ndarray  # weights of the terms that very many examples have, by example
    k: int
    votes: np.ndarray
    chance: np.ndarray
    rest: float  # probability of texts without neighbours

    def vectors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit vectors of texts over the terms, as (text, term, weight), by text."""
        doc, term, tf = term_counts(texts, self.terms)
        return self.weighted(doc, term, tf, len(texts))

    def weighted(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = (1 + np.log(np.maximum(tf, 1))) * self.idf[term]
        norm = np.sqrt(np.bincount(doc, w * w, n))
        return doc, term, w / norm[doc]

    def neighbours(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest cosine for n texts, and these cosines (0 and -1: none). without: an example of each
        text to leave out."""
        best, who = np.zeros((n, self.k)), np.full((n, self.k), -1, np.int64)
        edge = np.searchsorted(doc, np.arange(n + 1))
        a = 0
        while a < n:
            b = max(a + 1, min(n, a + GROUP, int(np.searchsorted(edge, edge[a] + ENTRIES, side="right")) - 1))
            part = slice(edge[a], edge[b])
            self._nearest(doc[part] - a, term[part], weight[part], best[a:b], who[a:b], None if without is None else without[a:b])
            a = b
        return who, best

    def _nearest(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, best: np.ndarray, who: np.ndarray, without: np.ndarray | None) -> None:
        n, size = len(best), len(self.ids)
        blocks = -(-size // BLOCK)
        score = np.zeros((n, blocks * BLOCK))
        row = self.common[term]
        many = row >= 0
        query = np.zeros((n, len(self.table)))
        query[doc[many], row[many]] = weight[many]
        score[:, :size] = query @ self.table
        few = np.flatnonzero(~many)
        cells = self.cells[term[few] + 1] - self.cells[term[few]]
        cell, entry = ragged(self.cells[term[few]], cells), np.repeat(few, cells)
        at = doc[entry] * blocks + self.block[cell]
        # no score in a block exceeds its best so far by more than the block's largest weights allow
        bound = np.bincount(at, weight[entry] * self.most[cell], n * blocks).reshape(n, blocks) + score.reshape(n, blocks, BLOCK).max(axis=2)
        least = self._least(score, without)
        keep = (bound >= least[:, None] - 1e-11).reshape(-1)[at]
        cell, entry = cell[keep], entry[keep]
        held = self.start[cell + 1] - self.start[cell]
        where = ragged(self.start[cell], held)
        score += np.bincount(np.repeat(doc[entry] * (blocks * BLOCK), held) + self.posting[where], np.repeat(weight[entry], held) * self.weight[where], score.size).reshape(score.shape)
        score = np.round(score, 12)
        least = self._least(score, without)
        text, example = np.nonzero((score >= least[:, None]) & (score > 0))
        found = score[text, example]
        order = np.lexsort((example, -found, text))
        text, example, found = text[order], example[order], found[order]
        rank = np.arange(len(text)) - np.searchsorted(text, text)
        top = rank < self.k
        best[text[top], rank[top]], who[text[top], rank[top]] = found[top], example[top]

    def _least(self, score: np.ndarray, without: np.ndarray | None) -> np.ndarray:
        """The k-th score of each row; what is to be left out becomes 0."""
        if without is not None:
            score[np.arange(len(score)), without] = 0
        if score.shape[1] <= self.k:
            return np.zeros(len(score))
        return np.partition(score, -self.k, axis=1)[:, -self.k]

    def raw_votes(self, who: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        """Share of the weight that votes for label 1; nan without neighbours."""
        w = np.where(who >= 0, cosine, 0)
        total = w.sum(axis=1)
        return np.where(total > 0, (w * self.label[who]).sum(axis=1) / np.maximum(total, 1e-300), np.nan)

    def scores(self, texts: list[str]) -> tuple[np.ndarray, list[list[int]]]:
        if not len(self.ids):
            return np.full(len(texts), self.rest), [[] for _ in texts]
        who, cosine = self.neighbours(*self.vectors(texts), len(texts))
        vote = self.raw_votes(who, cosine)
        score = np.interp(np.nan_to_num(vote), self.votes, self.chance)
        evidence = [[int(self.ids[i]) for i in row if i >= 0] for row in who.tolist()]
        return np.where(np.isnan(vote), self.rest, score), evidence


def term_counts(texts: list[str], terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, times) of the given terms (sorted hashes), by text and term."""
    h, doc = words(texts)
    if not len(terms):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    maybe = np.zeros(1 << 18, bool)
    maybe[terms >> U64(46)] = True
    near = np.flatnonzero(maybe[h >> U64(46)])
    at = np.minimum(np.searchsorted(terms, h[near]), len(terms) - 1)
    hit = terms[at] == h[near]
    key, times = np.unique(doc[near[hit]] * len(terms) + at[hit], return_counts=True)
    return key // len(terms), key % len(terms), times


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the best non-decreasing step fit of y over x (pooled neighbours), with one success and failure of
    pseudo-counts spread over the whole so that no chance is exactly 0 or 1."""
    order = np.argsort(x, kind="stable")
    prior = (y.sum() + 1) / (len(y) + 2)
    pools: list[list[float]] = []  # sum, weight, sum of x
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        pools.append([b, 1.0, a])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, w, c = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += w
            pools[-1][2] += c
    return np.array([c / w for _, w, c in pools]), np.array([(s + prior) / (w + 1) for s, w, _ in pools])


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = 4096, k: int = 15, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from labelled rows that aren't held out. What comes to the driver is bounded by the words of max_examples texts."""
    docs = docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    usable = labels.select(F.col(id_col).cast("bigint").alias(id_col), F.col(label_col).cast("int").alias("label")).where(F.col(id_col).isNotNull() & F.col("label").isin(0, 1) & ~held_out(id_col))
    drawn = usable.groupBy(id_col).agg(F.max("label").alias("label")).orderBy(F.xxhash64(id_col), id_col).limit(max_examples).toPandas()
    label_of = dict(zip(drawn[id_col].tolist(), drawn["label"].tolist(), strict=True))
    few = docs.sparkSession.createDataFrame([(i,) for i in label_of], f"{id_col} bigint")
    sample = docs.join(F.broadcast(few), id_col, "left_semi").groupBy(id_col).agg(F.min(text_col).alias(text_col))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces_of(batch, text_col):
                h, doc = words(texts_of(piece.column(text_col)))
                parts = np.split(h, np.searchsorted(doc, np.arange(1, piece.num_rows)))
                own = [np.unique(part, return_counts=True) for part in parts]
                yield pa.RecordBatch.from_arrays([piece.column(id_col), pa.array([t.tobytes() for t, _ in own], pa.binary()), pa.array([n.astype(np.int32).tobytes() for _, n in own], pa.binary())], names=[id_col, "terms", "times"])

    found = sample.mapInArrow(lean(vectors), f"{id_col} bigint, terms binary, times binary").toArrow()
    ids = found.column(id_col).to_numpy()
    label_of = {i: label_of[i] for i in ids.tolist()}
    times = [np.frombuffer(x, np.int32) for x in found.column("times").to_pylist()]
    owner, tf = np.repeat(ids, [len(x) for x in times]), np.concatenate([np.empty(0, np.int32), *times])
    terms, which = np.unique(np.frombuffer(b"".join(found.column("terms").to_pylist()), U64), return_inverse=True)
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        total, n = np.zeros(len(terms), np.int64), 0
        for batch in batches:
            for piece in pieces_of(batch, text_col):
                total += np.bincount(term_counts(texts_of(piece.column(text_col)), terms)[1], minlength=len(terms))
                n += piece.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["term", "n"])

    df = docs.select(text_col).mapInArrow(lean(frequencies), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    count = np.zeros(len(terms) + 1, np.int64)
    count[df.column("term").to_numpy()] = df.column("n").to_numpy()
    idf = np.log((1 + count[-1]) / (1 + count[:-1])) + 1
    model = _indexed(terms, idf * np.sqrt(1 + association(owner, which, len(terms), label_of)), owner, which, tf, label_of, k)
    del found, owner, which, tf, times
    trim()
    return model


def association(owner: np.ndarray, term: np.ndarray, n: int, label_of: dict[int, int]) -> np.ndarray:
    """Chi-square of each of n terms with the label, from the terms (once each) of the examples."""
    ids, whose = np.unique(owner, return_inverse=True)
    label = np.array([label_of[i] for i in ids.tolist()], np.float64)[whose]
    n1, n_all = sum(label_of.values()), max(1, len(label_of))
    seen = np.bincount(term, minlength=n) / n_all
    spread = n1 * (1 - n1 / n_all) * seen * (1 - seen)
    return np.where(spread > 0, (np.bincount(term, label, n) - n1 * seen) ** 2 / np.maximum(spread, 1e-9), 0)


def _indexed(terms: np.ndarray, idf: np.ndarray, owner: np.ndarray, term: np.ndarray, tf: np.ndarray, label_of: dict[int, int], k: int) -> Model:
    """The index over examples that have any term, and the calibration by their leave-one-out votes."""
    ids, doc = np.unique(owner, return_inverse=True)
    none, whole = np.zeros(0), np.zeros(0, np.int64)
    model = Model(terms, idf, ids, none, whole, whole, whole, none, whole, none, whole, np.zeros((0, 0)), k, np.zeros(1), np.zeros(1), 0.0)
    bare = [v for i, v in label_of.items() if i not in set(ids.tolist())]
    model.rest = (sum(bare) + 0.5 * bool(label_of)) / (len(bare) + 2) if label_of else 0.0
    if not len(ids):
        return model
    _, _, w = model.weighted(doc, term, tf, len(ids))
    # examples that share their heaviest term stand together, which tightens the blocks' bounds
    heavy = np.zeros(len(ids), np.int64)
    by_weight = np.argsort(w, kind="stable")
    heavy[doc[by_weight]] = term[by_weight]
    order = np.lexsort((ids, heavy))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    doc, model.ids = place[doc], ids[order]
    model.label = np.array([label_of[i] for i in model.ids.tolist()], np.float64)
    blocks = -(-len(ids) // BLOCK)
    by_term = np.lexsort((doc, term))
    model.posting, model.weight = doc[by_term].astype(np.int32), w[by_term]
    cell, model.start = np.unique(term[by_term] * blocks + model.posting // BLOCK, return_index=True)
    model.most = np.maximum.reduceat(model.weight, model.start)
    model.start = np.append(model.start, len(model.posting)).astype(np.int32)
    model.cells, model.block = np.searchsorted(cell, np.arange(len(terms) + 1) * blocks), (cell % blocks).astype(np.int32)
    often = np.flatnonzero(np.bincount(term, minlength=len(terms)) > len(ids) // COMMON)
    model.common = np.full(len(terms), -1)
    model.common[often] = np.arange(len(often))
    model.table = np.zeros((len(often), len(ids)))
    held = model.common[term] >= 0
    model.table[model.common[term[held]], doc[held]] = w[held]
    by_doc = np.lexsort((term, doc))
    d, t, v = doc[by_doc], term[by_doc], w[by_doc]
    votes = np.empty(len(ids))
    for a in range(0, len(ids), 512):
        b = min(len(ids), a + 512)
        part = slice(*np.searchsorted(d, [a, b]))
        votes[a:b] = model.raw_votes(*model.neighbours(d[part] - a, t[part], v[part], b - a, without=np.arange(a, b)))
    known = ~np.isnan(votes)
    if known.any():
        model.votes, model.chance = isotonic(votes[known], model.label[known])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score (0 to 1), predicted (score of 0.5 or more), evidence (ids of the nearest examples)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces_of(batch, text_col):
                scores, evidence = shared.value.scores(texts_of(piece.column(text_col)))
                columns = [piece.column(id_col), piece.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(evidence, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "held_out", "score", "predicted", "evidence"])

    chosen = docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).cast("string").alias(text_col), held_out(id_col).alias("held_out"))
    return chosen.mapInArrow(lean(run), f"{id_col} bigint, held_out boolean, score double, predicted int, evidence array<bigint>")


def clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose texts aren't predicted toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces_of(batch, text_col):
                scores, _ = shared.value.scores(texts_of(piece.column(text_col)))
                yield piece.filter(pa.array(scores < 0.5))

    return docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(lean(run), docs.withColumn(text_col, F.col(text_col).cast("string")).schema)
