"""N-gram Jaccard self-join by R-trees over count vectors, exact and without quadratic groups.

A text's set holds its distinct n-word shingles. Tokens (shingles) are hashed into groups; the counts of a set's groups are
a point. The summed coordinate minima of two points bound the sets' overlap from above, and so do those of a point and the upper
corner of a box: an R-tree of points skips whole boxes that can't reach the threshold. All candidates come from R-trees,
and pairs that survive are verified on the sets. Boxes and first comparisons sum neighbouring coordinates; what they let pass is compared
by all of them, as a pair is found in every bucket that it shares and large groups of copies just short of the threshold would
otherwise be named over and over.

Blocks only deal the work to machines: two linked sets differ in at most d places, so of d + 1 blocks of token groups one has
equal counts in both, and sets with an equal block share a bucket, without loss of a link. d follows from the sizes: sets are
banded by size so that linked sets lie in the same band or in neighbouring ones, and a set joins in both (see Bands).
Blocks that are empty count only where too few others are left.

Equal sets are one class from the start (a class is known by the 64-bit sum of its mixed shingle hashes), so copies are never paired.
Buckets come in pieces of bounded size, and each piece has an R-tree of its classes' points. First, centres chosen one after the
other ask the tree, until every class of the piece has been met or has asked: at most two pairs per class. Their links make
components. Then, in buckets that still hold several components, every class asks the trees of its bucket's pieces for classes of other
components; nodes within its own component are skipped. Keys that many classes of one task share are
gathered into a piece on the spot, and only one class of it goes on to the exchange, so no key is gathered whole anywhere.

Words are what lies between blanks, tabs, line feeds, vertical tabs, form feeds and carriage returns, with A-Z in lower case.
Texts of fewer than n words have their whole sequence as one shingle; null texts and texts without words have an empty set and are
linked with nothing. Texts are read whole, very long ones in parts. Rows without an id take no part in links and have no component. Rows that repeat
an id are each judged by their own text. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import U64, discard, lean, mixed, parts_of, pieces_of, prefix_hash, ragged, saved, shuffle_parts, span_hash, texts_of

#: Coordinates of points; boxes of an R-tree hold them coarser, each COARSE of them summed, and rows are first compared by sums of MIDDLE.
POINT = 1024
MIDDLE = 8
COARSE = 32
#: Rows or nodes below a node.
FAN = 16
#: Token groups within each block.
GROUPS = 1 << 16
#: Classes of a piece of a bucket, at most.
PIECE = 2048
#: Keys that a task gathers before it deals them out, and keys that one task receives on average.
CHUNK = 1 << 20
#: Classes of one key within a chunk that make a piece on the spot.
LOCAL = 64
#: Bits of the map that spares shuffling sets that aren't asked for.
MAP_BITS = 26

#: Where long texts may be cut.
BLANKS = re.compile(r"[ \t-\r]")
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 1


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, one after the other, and words per text."""
    found = [(owner, *_words(part)) for owner, part in parts_of(texts, BLANKS)]
    count = np.zeros(len(texts), np.int64)
    for owner, _, n in found:
        np.add.at(count, owner, n)
    return np.concatenate([np.empty(0, U64), *(h for _, h, _ in found)]), count


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"\n".join([t.encode("utf-8", "surrogatepass") for t in texts] + [b""]), np.uint8)
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    blank = np.ones(len(raw) + 1, np.int8)
    blank[:-1] = _KIND[raw]
    step = np.diff(blank, prepend=1)
    start, end = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
    edge = np.cumsum([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts], dtype=np.int64)
    return span_hash(prefix_hash(raw), start, end), np.diff(np.searchsorted(start, np.append(0, edge)))


def shingle_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one text after the other, and set sizes."""
    words, count = word_hashes(texts)
    first = np.cumsum(count) - count
    number = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    at = ragged(first, number)
    doc = np.repeat(np.arange(len(texts)), number)
    length = np.minimum(count, n)[doc]
    h = mixed(length.astype(U64))
    for k in range(n):
        has = length > k
        step = mixed(h[has] * U64(3) + words[at[has] + k])
        h = step if has.all() else _put(h, has, step)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(texts)).astype(np.int64)


def _put(a: np.ndarray, where: np.ndarray, values: np.ndarray) -> np.ndarray:
    a = a.copy()
    a[where] = values
    return a


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of 64-bit values, modulo 2**64."""
    total = np.append(U64(0), np.cumsum(values, dtype=U64))
    ends = np.append(0, np.cumsum(sizes))
    return total[ends[1:]] - total[ends[:-1]]


def digests(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Class of each set, as signed 64-bit."""
    return mixed(sums(mixed(h + U64(0x51ED270B)), sizes) + sizes.astype(U64)).view(np.int64)


@dataclass(frozen=True)
class Bands:
    """Bands of set sizes for the threshold num/den: linked sets lie in the same band or in neighbouring ones.

    Scheme k serves pairs whose smaller set lies in band k: sets of bands k and k + 1 join in it.
    """

    num: int
    den: int

    def starts(self, largest: int) -> np.ndarray:
        out = [1]
        while out[-1] <= largest:
            out.append(out[-1] * self.den // self.num + 1)
        return np.array([*out, out[-1] * self.den // self.num + 1], np.int64)

    def scheme(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per band: how many places linked sets may differ in, and the number of blocks."""
        small = starts[1:] - 1
        apart = (small + small * self.den // self.num) * (self.den - self.num) // (self.den + self.num)
        return apart, apart + 1 + np.where(apart > 0, np.maximum(1, apart // 20), 0)

    def enough(self, overlap: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether sets of sizes a and b with this overlap are linked."""
        return self.den * overlap >= self.num * (a + b - overlap)


def block_keys(h: np.ndarray, sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all sets' blocks, and the number of the set that each belongs to."""
    starts = bands.starts(int(sizes.max(initial=0)))
    apart, blocks = bands.scheme(starts)
    own = np.searchsorted(starts, sizes, side="right") - 1
    out_key, out_set = [], []
    ends = np.cumsum(sizes)
    for shift in (0, 1):
        band = own - shift
        some = np.flatnonzero((sizes > 0) & (band >= 0))
        some = some[apart[band[some]] > 0]  # else linked sets are equal
        if not len(some):
            continue
        n, m = sizes[some], blocks[band[some]]
        at = ragged((ends - sizes)[some], n)
        who = np.repeat(np.arange(len(some)), n)
        salt = mixed((band[some] + 1).astype(U64))
        x = mixed(h[at] ^ salt[who])
        block = ((x >> U64(32)) * m[who].astype(U64) >> U64(32)).astype(np.int64)
        base = np.cumsum(m) - m
        slot = base[who] + block
        # the block's point: counts of its groups, as the sum of a random value per group
        group = mixed((x & U64(GROUPS - 1)) + U64(0xA5A5))
        order = np.argsort(slot, kind="stable")
        held = np.bincount(slot, minlength=int(m.sum()))
        content = sums(group[order], held)
        owner = np.repeat(np.arange(len(some)), m)
        number = np.arange(len(owner)) - base[owner]
        empty = np.bincount(owner, held == 0, len(some))
        # equal blocks are m - apart at least; if all may be empty, the empty ones must count
        keep = (held > 0) | (empty >= (m - apart[band[some]]))[owner]
        key = mixed(content[keep] + salt[owner[keep]] + mixed(number[keep].astype(U64)))
        out_key.append(key)
        out_set.append(some[owner[keep]])
    if not out_key:
        return np.empty(0, U64), np.empty(0, np.int64)
    return np.concatenate(out_key), np.concatenate(out_set)


def points(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Counts of POINT token groups per set."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = (h >> U64(64 - POINT.bit_length() + 1)).astype(np.int64)
    return np.bincount(owner * POINT + place, minlength=len(sizes) * POINT).reshape(-1, POINT)


WIDTHS = {1: "u1", 2: "<u2", 4: "<u4"}


def _point_bytes(h: np.ndarray, sizes: np.ndarray, step: int = 1024) -> list[bytes]:
    """Points of sets as bytes: how many bytes each coordinate takes (1, 2 or 4, as the largest needs), then the compressed coordinates."""
    zstd, out = pa.Codec("zstd"), []
    ends = np.append(0, np.cumsum(sizes))
    for a in range(0, len(sizes), step):
        b = min(a + step, len(sizes))
        p = points(h[ends[a] : ends[b]], sizes[a:b])
        for x, m in zip(p, p.max(axis=1, initial=0).tolist(), strict=True):
            width = 1 if m < 1 << 8 else 2 if m < 1 << 16 else 4
            out.append(bytes([width]) + zstd.compress(x.astype(WIDTHS[width]).tobytes(), asbytes=True))
    return out


def _points(column: list[bytes]) -> np.ndarray:
    """Points from their bytes, of the narrowest type that holds them all."""
    zstd = pa.Codec("zstd")
    out = np.empty((len(column), POINT), WIDTHS[max((x[0] for x in column), default=1)])
    for k, x in enumerate(column):
        out[k] = np.frombuffer(zstd.decompress(memoryview(x)[1:], POINT * x[0]), WIDTHS[x[0]])
    return out


def _summed(points: np.ndarray, n: int) -> np.ndarray:
    """Points with each n neighbouring coordinates summed."""
    return np.add.reduce(points.reshape(len(points), -1, n), axis=2, dtype=np.int32)


class Forest:
    """An R-tree for each group of points, in shared arrays.

    A level's node spans FAN nodes of the level below (rows at the lowest), all of its group, and holds the upper corner of their
    box, the least and the largest size, and the least and the largest component below.
    """

    def __init__(self, points: np.ndarray, group: np.ndarray, component: np.ndarray, bands: Bands):
        """group: numbers from 0 on without gaps, in any order; component: what a row belongs to, for queries that skip their own."""
        self.bands = bands
        size = points.sum(axis=1, dtype=np.int64)
        # near points lie side by side: by component, size, and place along a fixed direction
        direction = (mixed(np.arange(POINT // MIDDLE, dtype=U64)) >> U64(40)).astype(np.float64)
        middle = _summed(points, MIDDLE)
        self.order = np.lexsort((middle @ direction, size, component, group))
        self.points, self.middle, self.component = points[self.order], middle[self.order], component[self.order]
        self.group = group[self.order]
        coarse = _summed(self.middle, COARSE // MIDDLE)
        level = (coarse, size[self.order], size[self.order], self.component, self.component, self.group)
        self.levels, self.first = [level], []
        while True:
            owner = level[5]
            start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.empty(0, np.int64)
            rank = np.arange(len(owner)) - np.repeat(start, np.diff(np.append(start, len(owner))))
            cut = np.flatnonzero(rank % FAN == 0)
            self.first.append(np.append(cut, len(owner)))
            if not len(cut):
                break
            level = (np.maximum.reduceat(level[0], cut), np.minimum.reduceat(level[1], cut), np.maximum.reduceat(level[2], cut), np.minimum.reduceat(level[3], cut), np.maximum.reduceat(level[4], cut), owner[cut])
            self.levels.append(level)
            if len(cut) == len(start):
                break

    def reach(self, points: np.ndarray, group: np.ndarray, component: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all rows of the queries' groups whose bound lets them be linked with the query; with component,
        only rows of other components. Rows are numbered as given at the start."""
        out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        step = 256
        for a in range(0, len(points), step):
            own = None if component is None else component[a : a + step]
            q, row = self._reach(points[a : a + step], group[a : a + step], own)
            out.append((a + q, self.order[row]))
        return np.concatenate([q for q, _ in out]), np.concatenate([r for _, r in out])

    def _reach(self, points: np.ndarray, group: np.ndarray, component: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        middle = _summed(points, MIDDLE)
        coarse = _summed(middle, COARSE // MIDDLE)
        size = points.sum(axis=1, dtype=np.int64)
        query, node = np.arange(len(points)), group.copy()  # the top level has one node per group
        for k in range(len(self.levels) - 1, -1, -1):
            upper, least, largest, low, high, _ = self.levels[k]
            if component is not None:
                other = (low[node] != component[query]) | (high[node] != component[query])
                query, node = query[other], node[other]
            most = np.minimum(_overlap(upper, node, coarse, query), largest[node])
            # with the least size below the node, the union is as small as it may be
            fits = self.bands.enough(most, np.maximum(least[node], most), size[query])
            query, node = query[fits], node[fits]
            if k:
                first = self.first[k - 1]
                n = first[node + 1] - first[node]
                query, node = np.repeat(query, n), ragged(first[node], n)
        for own, asking in ((self.middle, middle), (self.points, points)):
            fits = self.bands.enough(_overlap(own, node, asking, query), self.levels[0][1][node], size[query])
            query, node = query[fits], node[fits]
        return query, node


def _overlap(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Summed minima of rows i of a and rows j of b, in steps of bounded size."""
    out = np.empty(len(i), np.int64)
    step = (1 << 22) // max(1, a.shape[1])
    for k in range(0, len(i), step):
        out[k : k + step] = np.minimum(a[i[k : k + step]], b[j[k : k + step]]).sum(axis=1, dtype=np.int64)
    return out


def cover(points: np.ndarray, group: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, within groups, that the bound lets be linked, until each row was met by a centre or was one itself.

    A group's first centre is the row nearest to the group's mean, the next ones are the first that weren't met. A centre is paired with
    all rows it meets that weren't met before, and with the best of the others, which ties neighbourhoods together.
    """
    none = np.zeros(len(points), np.int64)
    forest = Forest(points, group, none, bands)
    n = int(group.max(initial=-1)) + 1
    count = np.bincount(group, minlength=n)
    order = np.argsort(group, kind="stable")
    start = np.cumsum(count) - count
    middle = _summed(points, MIDDLE)
    mean = np.add.reduceat(middle[order], start).astype(np.float32) / count[:, None].astype(np.float32)
    apart = np.empty(len(points), np.float32)
    for a in range(0, len(points), 1 << 14):
        apart[a : a + (1 << 14)] = np.abs(middle[a : a + (1 << 14)] - mean[group[a : a + (1 << 14)]]).sum(axis=1)
    by = np.lexsort((apart, group))
    centre = by[start]
    met = np.zeros(len(points), bool)
    out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    at = start.copy()  # how far each group's rows, by distance from the mean, are known to be met
    ends = start + count
    while len(centre):
        met[centre] = True
        q, row = forest.reach(points[centre], group[centre])
        asking = centre[q]
        real = asking != row
        q, row, asking = q[real], row[real], asking[real]
        new = ~met[row]
        old = np.flatnonzero(~new)
        if len(old):
            shared = _overlap(points, asking[old], points, row[old])
            best = old[np.lexsort((-shared, q[old]))]
            best = best[np.append(True, q[best][1:] != q[best][:-1])]
            out.append((asking[best], row[best]))
        out.append((asking[new], row[new]))
        met[row] = True
        # the next row of each group that wasn't met
        live = np.flatnonzero(at < ends)
        while True:
            done = live[met[by[at[live]]]]
            if not len(done):
                break
            at[done] += 1
            live = live[at[live] < ends[live]]
        centre = by[at[live]]
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _set_rows(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, cls of rows, and the point of classes (null where the task had the class already)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            for piece in pieces_of(batch, "text"):
                h, sizes = shingle_sets(texts_of(piece.column("text")), n)
                cls = digests(h, sizes)
                fresh = seen.fresh(cls, (sizes > 0) & piece.column("doc_id").is_valid().to_numpy(zero_copy_only=False))
                own = h[ragged((np.cumsum(sizes) - sizes)[fresh], sizes[fresh])]
                cells: list[bytes | None] = [None] * len(cls)
                for i, x in zip(fresh.tolist(), _point_bytes(own, sizes[fresh]), strict=True):
                    cells[i] = x
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(sizes), pa.array(cls), pa.array(cells, pa.binary())], names=["doc_id", "n_shingles", "cls", "point"])

    return docs.mapInArrow(lean(run), "doc_id bigint, n_shingles bigint, cls bigint, point binary")


class Seen:
    """Classes that a task has had lately; bounded, then begun anew (a class may come again, which is only more work)."""

    def __init__(self, limit: int = 500_000):
        self.held: set[int] = set()
        self.limit = limit

    def fresh(self, cls: np.ndarray, usable: np.ndarray) -> np.ndarray:
        """Places of the first rows of classes not had yet."""
        _, one = np.unique(cls, return_index=True)
        out = np.array([i for i in np.sort(one).tolist() if usable[i] and int(cls[i]) not in self.held], np.int64)
        lost = np.flatnonzero(usable & ~np.isin(cls, cls[out]))
        if len(lost):  # the first row of a class may be the one that can't be used
            _, first = np.unique(cls[lost], return_index=True)
            out = np.sort(np.append(out, [i for i in lost[first].tolist() if int(cls[i]) not in self.held])).astype(np.int64)
        if len(self.held) > self.limit:
            self.held.clear()
        self.held.update(cls[out].tolist())
        return out


PLAIN, FORWARDED, GATHERED = 0, 1, 2


def _keyed(docs: DataFrame, n: int, bands: Bands, parts: int) -> DataFrame:
    """Keys and classes of all sets, packed by the partition they belong to: plain ones, ones that stand for a gathered piece, and the
    pieces themselves (their key, and their classes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = Seen(), [], 0
        for batch in batches:
            for piece in pieces_of(batch, "text"):
                h, sizes = shingle_sets(texts_of(piece.column("text")), n)
                cls = digests(h, sizes)
                fresh = seen.fresh(cls, sizes > 0)
                if not len(fresh):
                    continue
                key, who = block_keys(h[ragged((np.cumsum(sizes) - sizes)[fresh], sizes[fresh])], sizes[fresh], bands)
                held.append((key.view(np.int64), cls[fresh][who]))
                size += len(key)
                if size > CHUNK:
                    yield _dealt(held, parts)
                    held, size = [], 0
        if size:
            yield _dealt(held, parts)

    return docs.mapInArrow(lean(run), "part int, kind int, keys binary, classes binary")


def _grouped(key: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, class) in order, where each key starts, and how many classes it has."""
    order = np.lexsort((cls, key))
    key, cls = key[order], cls[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
    key, cls = key[new], cls[new]
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    return key, cls, edge, np.diff(np.append(edge, len(key)))


def _dealt(held: list[tuple[np.ndarray, np.ndarray]], parts: int) -> pa.RecordBatch:
    """A chunk of keys by partition; keys of LOCAL classes or more become pieces, which their first class stands for."""
    key, cls, edge, size = _grouped(*(np.concatenate(x) for x in zip(*held, strict=True)))
    often = np.repeat(size >= LOCAL, size)
    out: list[tuple[int, int, bytes, bytes]] = []
    for k in np.flatnonzero(size >= LOCAL).tolist():
        for a in range(int(edge[k]), int(edge[k] + size[k]), PIECE):
            own = cls[a : min(a + PIECE, int(edge[k] + size[k]))]
            at = int(mixed(own[:1].view(U64) ^ key[edge[k] : edge[k] + 1].view(U64))[0] % U64(parts))
            out.append((at, GATHERED, key[edge[k] : edge[k] + 1].tobytes(), own.tobytes()))
    first = np.concatenate([np.empty(0, np.int64), *(np.arange(edge[k], edge[k] + size[k], PIECE) for k in np.flatnonzero(size >= LOCAL).tolist())]).astype(np.int64)
    for kind, keys, classes in ((PLAIN, key[~often], cls[~often]), (FORWARDED, key[first], cls[first])):
        part = (mixed(keys.view(U64)) % U64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        raw_keys, raw_classes = memoryview(keys[order].tobytes()), memoryview(classes[order].tobytes())
        for p in np.flatnonzero(np.diff(cut)).tolist():
            here = slice(8 * int(cut[p]), 8 * int(cut[p + 1]))
            out.append((p, kind, bytes(raw_keys[here]), bytes(raw_classes[here])))
    return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["part", "kind", "keys", "classes"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (bucket, piece, members) of a partition's buckets of two classes or more, from packed rows.

    A bucket is known by the digest of its members, so equal ones of other partitions have the same number; those of which
    pieces were gathered, by their key. Gathered pieces pass through."""

    def pieces(bucket: np.ndarray, members: np.ndarray, edge: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        cuts = -(-size // PIECE)
        first = np.repeat(edge, cuts) + PIECE * (np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts))
        n = np.minimum(first + PIECE, np.repeat(edge + size, cuts)) - first
        held = members[ragged(first, n)]
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(held))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(bucket, cuts)), pa.array(sums(mixed(held.view(U64)), n).view(np.int64)), lists], names=["bucket", "piece", "members"])

    keys, classes, by_key = [], [], []
    for batch in batches:
        for kind, k, c in zip(batch.column("kind").to_pylist(), batch.column("keys").to_pylist(), batch.column("classes").to_pylist(), strict=True):
            key, cls = np.frombuffer(k, np.int64), np.frombuffer(c, np.int64)
            if kind == GATHERED:
                yield pieces(key, cls, np.zeros(1, np.int64), np.array([len(cls)]))
                continue
            keys.append(key)
            classes.append(cls)
            if kind == FORWARDED:
                by_key.append(key)
    if not keys:
        return
    key, cls, edge, size = _grouped(np.concatenate(keys), np.concatenate(classes))
    edge, size = edge[size > 1], size[size > 1]
    if not len(edge):
        return
    at = ragged(edge, size)
    name = sums(mixed(cls[at].view(U64)), size).view(np.int64)
    kept = np.isin(key[edge], np.concatenate(by_key)) if by_key else np.zeros(len(edge), bool)
    name[kept] = key[edge[kept]]
    _, one = np.unique(name, return_index=True)
    yield pieces(name[one], cls, edge[one], size[one])


def components(edges: DataFrame, what: str = "components") -> DataFrame:
    """(node, component) of all nodes of the edges (a, b); the component is its smallest node. Alternates large and small
    stars until nothing changes; each round is written to the shared folder, nothing is collected."""
    now = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), what)
    before = None
    while True:
        # a < b throughout
        both = now.select(F.col("b").alias("u"), F.col("a").alias("v")).unionByName(now.select(F.col("a").alias("u"), F.col("b").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        lower = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(lower, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).where("a < b")
        last, now = now, saved(small.unionByName(lower.select(F.col("m").alias("a"), "b")).distinct(), what)
        discard(last)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    tops = now.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(tops)


def _sets(docs: DataFrame, rows: DataFrame, n: int, pairs: DataFrame) -> DataFrame:
    """cls and members (sorted shingle hashes, as bytes) of the classes of pairs (a, b). Only documents that a class is known by are
    read into shingles again; no text is shuffled. A map of bits of bounded size says which: what passes by
    chance is removed by the exact join that follows."""
    asked = saved(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "ngram-asked")
    first = saved(rows.where("point is not null").join(asked.hint("merge"), "cls", "left_semi").groupBy("cls").agg(F.min("doc_id").alias("doc_id")), "ngram-first")
    bits = 1 << min(MAP_BITS, max(12, (16 * first.count()).bit_length()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    words = first.select(F.floor(place / 64).alias("__word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int")).alias("bit")).groupBy("__word").agg(F.bit_or("bit").alias("__mask"))
    some = docs.withColumn("__at", place).join(F.broadcast(words), F.floor(F.col("__at") / 64) == F.col("__word")).where(F.call_function("bit_get", "__mask", (F.col("__at") % 64).cast("int")) == 1).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            for piece in pieces_of(batch, "text"):
                h, sizes = shingle_sets(texts_of(piece.column("text")), n)
                cls = digests(h, sizes)
                fresh = seen.fresh(cls, sizes > 0)
                at = (np.cumsum(sizes) - sizes)[fresh]
                cells = [h[a : a + m].tobytes() for a, m in zip(at.tolist(), sizes[fresh].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(cls[fresh]), pa.array(cells, pa.binary())], names=["cls", "members"])

    made = some.mapInArrow(lean(run), "cls bigint, members binary")
    out = saved(made.join(asked.hint("merge"), "cls", "left_semi").dropDuplicates(["cls"]), "ngram-sets")
    discard(asked, first)
    return out


def _verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, n: int, bands: Bands) -> DataFrame:
    """The linked ones of distinct pairs (a, b), by their sets."""
    sets = _sets(docs, rows, n, pairs)
    members = [sets.select(F.col("cls").alias(c), F.col("members").alias(f"s_{c}")) for c in "ab"]
    full = pairs.join(members[0].hint("merge"), "a").join(members[1].hint("merge"), "b").select("a", "b", "s_a", "s_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("s_a"), batch.column("s_b"), strict=True):
                s, t = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = np.concatenate([s, t])
                both.sort(kind="stable")
                overlap = int((both[1:] == both[:-1]).sum())
                keep.append(bool(bands.enough(overlap, len(s), len(t))))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = saved(full.mapInArrow(lean(run), "a bigint, b bigint"), "ngram-links")
    discard(sets)
    return out


ITEMS = "array<struct<cls:bigint,component:bigint,point:binary>>"


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class, component, point, and number of the list, of all items of a column of lists."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten()
    cls, component = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    return cls, component, _points(flat.field(2).to_pylist()), np.repeat(np.arange(len(sizes)), sizes)


def _pairs_of(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    low, high = np.minimum(a, b), np.maximum(a, b)
    some = np.flatnonzero(low < high)
    pair = np.unique(np.stack([low[some], high[some]], axis=1), axis=0) if len(some) else np.empty((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, 0])), pa.array(np.ascontiguousarray(pair[:, 1]))], names=["a", "b"])


def _lists_of(batch: pa.RecordBatch, *names: str, limit: int = 2 * PIECE) -> Iterator[list[pa.Array]]:
    """Runs of a batch's rows, as columns of lists with about limit items (one row at least)."""
    ends = np.cumsum(sum(np.diff(batch.column(n).offsets.to_numpy()) for n in names))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, side="right")))
        yield [pa.concat_arrays([batch.column(n).slice(a, b - a)]) for n in names]
        a = b


def _covered(pieces: DataFrame, bands: Bands) -> DataFrame:
    """First candidates (a, b) of each piece; see cover()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (items,) in _lists_of(batch, "items"):
                cls, _, point, group = _unpacked(items)
                a, b = cover(point, group, bands)
                yield _pairs_of(cls[a], cls[b])

    return pieces.select("items").mapInArrow(lean(run), "a bigint, b bigint").distinct()


def _searched(cells: DataFrame, bands: Bands) -> DataFrame:
    """All candidates (a, b) of different components between the two pieces of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in _lists_of(batch, "left", "right"):
                cls, component, point, group = _unpacked(left)
                forest = Forest(point, group, component, bands)
                asking, own, from_point, of = _unpacked(right)
                q, row = forest.reach(from_point, of, own)
                yield _pairs_of(asking[q], cls[row])

    return cells.select("left", "right").mapInArrow(lean(run), "a bigint, b bigint").distinct()


def _packed(rows: DataFrame, *by: str) -> DataFrame:
    """Rows (.., cls, component, point) as one list of items per piece; a piece is bounded."""
    return rows.groupBy(*by).agg(F.collect_list(F.struct("cls", "component", "point")).cast(ITEMS).alias("items"))


def _open_cells(buckets: DataFrame, points_: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of pieces (left, right) of buckets that hold several components. In a bucket, the classes of its
    commonest component stay in their pieces, all others are dealt anew into pieces of their own, so that two pieces of the
    commonest component never meet."""
    members = buckets.select("bucket", "piece", F.explode("members").alias("cls"))
    placed = members.join(found.withColumnRenamed("node", "cls"), "cls", "left").select("bucket", "piece", "cls", F.coalesce("component", "cls").alias("component"))
    held = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    split = held.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    lane = F.pmod(F.xxhash64("cls"), F.ceil(F.col("others") / PIECE))
    inside: Column = F.col("component") == F.col("main")
    still = placed.join(split, "bucket").select("bucket", inside.alias("inside"), F.when(inside, F.col("piece")).otherwise(lane).alias("piece"), "cls", "component").distinct()
    pieces = saved(_packed(still.join(points_, "cls"), "bucket", "inside", "piece"), "ngram-open")
    left = pieces.select("bucket", F.col("inside").alias("in_l"), F.col("piece").alias("piece_l"), F.col("items").alias("left"))
    right = pieces.where("not inside").select("bucket", F.col("piece").alias("piece_r"), F.col("items").alias("right"))
    return left.join(right, "bucket").where("in_l or piece_l <= piece_r")


def join(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable by links, itself included)."""
    bands = Bands(num, den)
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = saved(_set_rows(docs, n), "ngram-rows")
    real = rows.where("n_shingles > 0 and doc_id is not null")
    classes = real.groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    usable = docs.where("doc_id is not null")

    # a set has about as many keys as places it may differ in, in each of two bands
    total = real.where("point is not null").agg(F.sum("n_shingles")).first()[0] or 0
    parts = max(shuffle_parts(docs.sparkSession), 2 * total * (den - num) // (den * CHUNK))
    met = _keyed(usable, n, bands, parts).repartitionById(parts, "part").select("kind", "keys", "classes").mapInArrow(lean(_buckets), "bucket bigint, piece bigint, members array<bigint>")
    buckets = saved(met.dropDuplicates(["bucket", "piece"]), "ngram-buckets")

    members = buckets.select("bucket", "piece", F.explode("members").alias("cls"))
    points_ = rows.where("point is not null").groupBy("cls").agg(F.first("point").alias("point"))
    pairs = saved(_covered(_packed(members.join(points_, "cls").withColumn("component", F.lit(0).cast("bigint")), "bucket", "piece"), bands), "ngram-pairs")
    found = components(_verified(pairs, usable, rows, n, bands))

    # what the centres leave open
    more = saved(_searched(_open_cells(buckets, points_, found), bands).join(pairs, ["a", "b"], "left_anti"), "ngram-more")
    if not more.isEmpty():
        # the components so far, as edges, and the new links
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(_verified(more, usable, rows, n, bands)))

    found = found.select(F.col("node").alias("cls"), "component")
    first_of = found.join(classes, "cls").groupBy("component").agg(F.min("doc_id").alias("first_id"))
    named = found.join(first_of, "component").select("cls", "first_id").unionByName(classes.join(found, "cls", "left_anti").select("cls", F.col("doc_id").alias("first_id")))
    out = rows.join(named, "cls", "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("first_id")).alias("component_id"))
