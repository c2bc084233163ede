"""Exact top-k search by inner product: a ball tree per shard, branch and bound with a shared k-th score.

Candidates are dealt to cells by their nearest pivot (a bounded number of vectors, those of the smallest hashes), and cells that
hold more than a shard may are split into several, so neighbours lie together and a shard's size is bounded. A
shard's ball tree is built once and kept: a node has a centre c and a radius r, so no vector below it has an inner product with q
over q.c + |q| r. Nodes are visited in the order of that bound, and only while it reaches a query's current k-th score.

Cells have balls too. A query visits them in the order of their bounds, in waves of 1, 2, 4, ... cells; its
k best so far are merged after each wave, and the k-th score goes with it to the next, which leaves out all cells whose bound doesn't reach it.
A task holds one shard's tree and one block of queries, both of bounded size. What is broadcast are the pivots and their balls, CELLS at most.

Components become floor(scale * x). Scores are exact integers: sums that 53 or 63 bits can't hold are done in integers
of any length, and a score that doesn't fit a 64-bit integer, or a component beyond it, is an error. Equal scores go
to the smaller id. Vectors that are null or hold null or non-finite components take no part, as do rows without an id;
shorter vectors count as padded with zeros. Rows that repeat an id are all candidates, though never for a query of that
id; the smallest of their vectors is the query. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, lean, saved

LEAF = 64
#: Cells at most (their pivots are broadcast), and vectors that a cell is worth making for.
CELLS = 1024
CELL_ROWS = 4096
#: Numbers that a shard and a block of queries hold at most.
NUMBERS = 1 << 22
LEAST = np.iinfo(np.int64).min


class BallTree:
    """Vectors of a shard in nested balls; nodes are spans of the reordered rows."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        order = np.arange(len(vectors))
        self.nodes: list[tuple[int, int, int, int]] = []  # first row, end, left child, right child (0: a leaf)
        todo = [(0, len(vectors), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            me = len(self.nodes)
            self.nodes.append((a, b, 0, 0))
            if parent >= 0:
                p = list(self.nodes[parent])
                p[2 + side] = me
                self.nodes[parent] = tuple(p)
            if b - a > LEAF:
                part = vectors[order[a:b]]
                axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, axis], mid)]
                todo += [(a, a + mid, me, 0), (a + mid, b, me, 1)]
        self.vectors, self.ids = vectors[order], ids[order]
        self.centre = np.array([self.vectors[a:b].mean(axis=0) for a, b, _, _ in self.nodes])
        self.radius = np.array([np.sqrt(((self.vectors[a:b] - c) ** 2).sum(axis=1).max()) for (a, b, _, _), c in zip(self.nodes, self.centre, strict=True)])

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        small = np.abs(self.vectors).max(initial=0) < 1 << 15
        np.savez(out, nodes=np.array(self.nodes, np.int64).reshape(-1, 4), vectors=self.vectors.astype(np.int16) if small else self.vectors, ids=self.ids, centre=self.centre, radius=self.radius)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> BallTree:
        held, out = np.load(io.BytesIO(raw)), cls.__new__(cls)
        out.nodes = [tuple(x) for x in held["nodes"].tolist()]
        out.vectors, out.ids, out.centre, out.radius = held["vectors"].astype(np.float64), held["ids"], held["centre"], held["radius"]
        return out

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of each query's k best here that reach its floor (LEAST: none), best first."""
        n = len(queries)
        ids, scores = np.zeros((n, k), np.int64), np.full((n, k), LEAST, np.int64)
        kth = floor.copy()
        size = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        reach = float(np.abs(self.vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * queries.shape[1]
        kind = np.float64 if reach < 2**53 else np.int64 if reach < 2**63 else object
        # doubles that are whole numbers become integers without loss
        left, right = (x if kind is np.float64 else x.astype(np.int64).astype(kind) for x in (queries, self.vectors))

        def bound(node: int, who: np.ndarray) -> np.ndarray:
            b = queries[who] @ self.centre[node] + size[who] * self.radius[node]
            return b + 1e-9 * np.abs(b) + 1e-3

        heap = [(0.0, 0, np.arange(n))]
        while heap:
            _, node, who = heapq.heappop(heap)
            who = who[bound(node, who) >= kth[who]]
            if not len(who):
                continue
            a, b, one, two = self.nodes[node]
            if one:
                for child in (one, two):
                    of_child = bound(child, who)
                    live = of_child >= kth[who]
                    if live.any():
                        heapq.heappush(heap, (-float(of_child[live].max()), child, who[live]))
                continue
            found = left[who] @ right[a:b].T
            found[self.ids[a:b][None, :] == query_ids[who][:, None]] = LEAST
            if kind is object and any(not LEAST <= x < -LEAST for x in found.ravel().tolist()):
                raise OverflowError("a score doesn't fit a 64-bit integer")
            found = found.astype(np.int64)
            better = (found >= kth[who][:, None]) & (found > LEAST)
            some = np.flatnonzero(better.any(axis=1))
            who, found = who[some], np.where(better[some], found[some], LEAST)
            all_scores = np.concatenate([scores[who], found], axis=1)
            all_ids = np.concatenate([ids[who], np.broadcast_to(self.ids[a:b], found.shape)], axis=1)
            best = np.lexsort((all_ids, ~all_scores), axis=1)[:, :k]
            scores[who], ids[who] = np.take_along_axis(all_scores, best, 1), np.take_along_axis(all_ids, best, 1)
            kth[who] = np.maximum(floor[who], scores[who, -1])
        return ids, scores


def quantised(column: str, scale: int) -> Column:
    """Components as floor(scale * x), x as double; null if the vector takes no part."""
    x = F.transform(F.col(column), lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(x, lambda v: F.when(F.abs(v * scale) < 2.0**63, F.floor(v * scale).cast("bigint")).otherwise(F.raise_error(F.lit("a component doesn't fit a 64-bit integer")).cast("bigint")))
    return F.when(~F.coalesce(bad, F.lit(True)), whole)


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows of doubles, padded with zeros. Whole numbers that came of doubles stay exact."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def _nearest(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Rows (vec_id, v) with cell, the number of the nearest pivot."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (shared.value**2).sum(axis=1) / 2
        for batch in batches:
            x = _matrix(batch.column("v"), shared.value.shape[1])
            cell = np.concatenate([np.empty(0, np.int64), *((half - x[a : a + 4096] @ shared.value.T).argmin(axis=1) for a in range(0, len(x), 4096))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int64))], names=["vec_id", "v", "cell"])

    return rows.select("vec_id", "v").mapInArrow(lean(run), "vec_id bigint, v array<bigint>, cell bigint")


def _trees(placed: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(cell, shard, tree, reach): a shard's ball tree, and how far from the cell's pivot its vectors lie."""
    width = pivots.shape[1]

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((len(rows), width))
        for k, v in enumerate(rows["v"]):
            x[k, : len(v)] = v
        order = np.argsort(rows["vec_id"].to_numpy(), kind="stable")
        x = x[order]
        far = np.sqrt(((x - pivots[key[0]]) ** 2).sum(axis=1).max())
        return pd.DataFrame([{"cell": key[0], "shard": key[1], "tree": BallTree(x, rows["vec_id"].to_numpy()[order]).to_bytes(), "reach": float(far)}])

    return saved(placed.groupBy("cell", "shard").applyInPandas(build, "cell bigint, shard bigint, tree binary, reach double"), "topk-trees")


BEST = "array<struct<less:bigint,vec_id:bigint>>"


def _visits(state: DataFrame, pivots: np.ndarray, reach: np.ndarray, k: int, first: int, last: int) -> DataFrame:
    """(query_id, v, floor, cell): the cells from place `first` to `last` in the order of a query's bounds which may still hold one
    of its k best; floor is its k-th score (LEAST: none)."""
    shared = state.sparkSession.sparkContext.broadcast((pivots, reach))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, reach = shared.value
        for batch in batches:
            x = _matrix(batch.column("v"), pivots.shape[1])
            floor = batch.column("floor").to_numpy()
            bound = x @ pivots.T + np.sqrt((x**2).sum(axis=1))[:, None] * reach[None, :]
            bound += 1e-9 * np.abs(bound) + 1e-3
            cells = np.argsort(-bound, axis=1, kind="stable")[:, first:last]
            who, place = np.nonzero(np.take_along_axis(bound, cells, 1) >= floor[:, None])
            here = cells[who, place]
            some = np.isfinite(bound[who, here])
            who = pa.array(who[some])
            yield pa.RecordBatch.from_arrays([batch.column(c).take(who) for c in ("query_id", "v", "floor")] + [pa.array(here[some])], names=["query_id", "v", "floor", "cell"])

    floor = F.when(F.size("best") >= k, -F.element_at("best", k)["less"]).otherwise(F.lit(LEAST)).alias("floor")
    return state.select("query_id", "v", floor).mapInArrow(lean(run), "query_id bigint, v array<bigint>, floor bigint, cell bigint")


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, shard_rows: int = 65536, query_rows: int = 16384, cell_rows: int = CELL_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each vector whose id is divisible by `every`: query_id, rank (from 1), vec_id, score of its k best others."""
    rows = saved(vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), quantised(vector_col, scale).alias("v")).where("vec_id is not null and v is not null"), "topk-vectors")
    n, width, asked = rows.agg(F.count("*"), F.max(F.size("v")), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    width = max(1, width or 0)
    shard_rows, query_rows = (max(1, min(x, NUMBERS // width)) for x in (shard_rows, query_rows))
    cells = max(1, min(CELLS, NUMBERS // width, -(-n // cell_rows)))
    drawn = [r.v for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(cells).collect()]
    pivots = np.zeros((max(1, len(drawn)), width))
    for i, v in enumerate(drawn):
        pivots[i, : len(v)] = v

    placed = saved(_nearest(rows, pivots), "topk-cells")
    shards = placed.groupBy("cell").agg(F.ceil(F.count("*") / shard_rows).cast("bigint").alias("shards"))  # a row per cell
    trees = _trees(placed.join(F.broadcast(shards), "cell").withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("shards"))), pivots)
    reach = np.full(len(pivots), -np.inf)  # cells without vectors are never visited
    for r in trees.groupBy("cell").agg(F.max("reach").alias("reach")).collect():
        reach[r.cell] = r.reach

    lanes = max(1, -(-asked // query_rows))
    blocks = trees.select("cell", "shard", "tree", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"))

    def search(tree: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(tree) or not len(asking):
            return pd.DataFrame()
        q = np.zeros((len(asking), width))
        for i, v in enumerate(asking["v"]):
            q[i, : len(v)] = v
        ids, scores = BallTree.from_bytes(tree["tree"].iloc[0]).search(q, asking["query_id"].to_numpy(), k, asking["floor"].to_numpy())
        real = scores > LEAST
        return pd.DataFrame({"query_id": np.repeat(asking["query_id"].to_numpy(), real.sum(axis=1)), "vec_id": ids[real], "score": scores[real]})

    queries = rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    state, seen, step = saved(queries.withColumn("best", F.array().cast(BEST)), "topk-state"), 0, 1
    while seen < len(pivots):
        visits = _visits(state, pivots, reach, k, seen, seen + step)
        visits = visits.join(F.broadcast(shards), "cell").select("query_id", "v", "floor", "cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1)).alias("shard")).withColumn("lane", F.pmod(F.xxhash64("query_id"), F.lit(lanes)).cast("int"))
        found = blocks.groupBy("cell", "shard", "lane").cogroup(visits.groupBy("cell", "shard", "lane")).applyInPandas(search, "query_id bigint, vec_id bigint, score bigint")
        # a shard sends k rows of a query at most
        lists = found.groupBy("query_id").agg(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id")).cast(BEST).alias("found"))
        merged = F.slice(F.array_sort(F.concat("best", F.coalesce("found", F.array().cast(BEST)))), 1, k)
        last, state = state, saved(state.join(lists, "query_id", "left").select("query_id", "v", merged.alias("best")), "topk-state")
        discard(last)
        seen, step = seen + step, 2 * step
    discard(rows, placed, trees)
    return state.select("query_id", F.posexplode("best")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.vec_id").alias("vec_id"), (-F.col("col.less")).alias("score"))
