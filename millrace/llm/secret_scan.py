"""Secret scans: fixed patterns, and a probabilistic automaton inferred from labelled credentials.

The patterns find credentials by their surroundings or prefix. What they find in all texts labels the training set, which holds
every distinct string: credentials, and for contrast ordinary candidates of the same alphabet. Of either set a prefix tree is made over
classes of characters, and its states are merged, smallest prefixes first, where their frequencies are statistically
compatible (Hoeffding's bound at every shared suffix); the two automata then score every candidate, a maximal
run of 8 credential characters or more, by the log ratio of its likelihoods. Candidates over the threshold, which one in a
thousand of the ordinary ones exceeds, become spans of kind `format`. Pattern spans always stay.

The driver holds the tree's nodes that one in SHARE strings passes (two at least), counted over all strings; rarer continuations begin anew at
the root, where a node passed once always merges to as well. All strings then go through the merged automaton, rare
ones too, and what they pass there makes its probabilities. Both thresholds are exact ranks among all strings.

Null texts count as empty; an empty text has no spans. Texts are scanned whole, in time proportional to their length. Repeated rows
are scanned one by one. Without any labelled credential nothing is added. An empty table gives an empty result; extra
columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, lean, pieces_of, prefix_hash, saved, span_hash, texts_of

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # no shorter run holds another match, so this equals dropping the short ones
HEX = re.compile(r"[0-9a-f]{32,}")
#: Characters of a candidate at least; labelled credentials start there too.
SHORTEST = 8
#: Nodes of a prefix tree that fewer than one in so many strings pass are left to the root's counts.
SHARE = 500
#: Hashes of strings that a task remembers, so as not to hand them on again; then it begins anew.
HELD = 500_000


def _class_table() -> np.ndarray:
    """Symbol of each ASCII character of a candidate: digit, a-f, g-z, A-F, G-Z, and one each for + / _ . = -"""
    out = np.zeros(128, np.int8)
    for k, chars in enumerate(["0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", ".", "=", "-"]):
        out[[ord(c) for c in chars]] = k
    return out


CLASS = _class_table()
IN_RUN = np.array([bool(re.fullmatch(r"[A-Za-z0-9+/_.=-]", chr(c))) for c in range(128)])
SYMBOLS = int(CLASS.max()) + 1
#: Symbols are written as letters from here on.
LETTER = ord("a")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, in order."""
    return [x[:3] for x in _matches(text)]


def _matches(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, where the credential begins) of the patterns' matches, in order."""
    found = [(m.start(), 0, m.end(), m.start(1)) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


@dataclass
class Found:
    """What texts hold: their code points one after the other, where each begins, matches of each, and the candidates' owners and
    places (in the whole row of code points)."""

    points: np.ndarray
    begin: np.ndarray
    matches: list[list[tuple[int, int, int, int]]]
    owner: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def symbols(self) -> np.ndarray:
        return CLASS[np.minimum(self.points, 127)].astype(np.int64)


def search(texts: list[str]) -> Found:
    """Matches and candidates of texts: maximal runs of credential characters that no match touches; full stops and hyphens at
    the ends don't count. All texts are scanned together, in time proportional to their length."""
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)], dtype=np.int64)
    matches = [_matches(t) for t in texts]
    alphabet = np.zeros(129, bool)
    alphabet[:128] = IN_RUN
    run = np.zeros(len(points) + 1, np.int8)
    run[:-1] = alphabet[np.minimum(points, 128)]
    step = np.diff(run, prepend=0)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    # from the first to the last character that is neither full stop nor hyphen
    solid = np.flatnonzero(run[:-1].astype(bool) & (points != ord(".")) & (points != ord("-")))
    first, last = np.searchsorted(solid, start), np.searchsorted(solid, end)
    some = first < last
    start, end = solid[first[some]], solid[last[some] - 1] + 1
    long = end - start >= SHORTEST
    start, end = start[long], end[long]
    touched = np.zeros(len(points) + 1, np.int32)
    for a, own in zip(begin.tolist(), matches, strict=False):
        for s, _, e, _ in own:
            touched[a + s] += 1
            touched[a + e] -= 1
    inside = np.append(0, np.cumsum(np.cumsum(touched[:-1]) > 0))
    free = inside[end] == inside[start]
    start, end = start[free], end[free]
    return Found(points, begin[:-1], matches, np.searchsorted(begin, start, side="right") - 1, start, end)


@dataclass
class Automaton:
    """Deterministic probabilistic automaton: next state and log probability by state and symbol, and log probability to end."""

    step: np.ndarray
    log_p: np.ndarray
    log_end: np.ndarray

    def likelihood(self, symbols: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Log probabilities of spans of a row of symbols; all spans advance together."""
        order = np.argsort(-size, kind="stable")
        state, total = np.zeros(len(size), np.int64), np.zeros(len(size))
        live = order
        for i in range(int(size.max(initial=0))):
            live = live[: int(np.searchsorted(-size[live], -i, side="left"))]
            s = symbols[first[live] + i]
            total[live] += self.log_p[state[live], s]
            state[live] = self.step[state[live], s]
        return total + self.log_end[state]

    def passes(self, symbols: np.ndarray, first: np.ndarray, size: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """How often weighted spans of a row of symbols pass each state with each symbol, or (last column) end there."""
        out = np.zeros((len(self.step), SYMBOLS + 1), np.int64)
        order = np.argsort(-size, kind="stable")
        state, live = np.zeros(len(size), np.int64), order
        for i in range(int(size.max(initial=0))):
            live = live[: int(np.searchsorted(-size[live], -i, side="left"))]
            s = symbols[first[live] + i]
            np.add.at(out, (state[live], s), weight[live])
            state[live] = self.step[state[live], s]
        np.add.at(out[:, SYMBOLS], state, weight)
        return out

    def counted(self, passes: np.ndarray, smooth: float = 0.1) -> Automaton:
        """The same states, with the probabilities of these counts."""
        p = np.log((passes + smooth) / (passes.sum(axis=1, keepdims=True) + smooth * (SYMBOLS + 1)))
        return Automaton(self.step, p[:, :SYMBOLS], p[:, SYMBOLS])


def infer(strings: list[np.ndarray], alpha: float = 0.05, smooth: float = 0.1) -> Automaton:
    """Merges compatible states of the strings' prefix tree, red-blue fashion, into an automaton."""
    child: list[dict[int, int]] = [{}]
    seen, ended, passed = [0], [0], [[0] * SYMBOLS]
    for s in strings:
        at = 0
        for c in s.tolist():
            seen[at] += 1
            passed[at][c] += 1
            if c not in child[at]:
                child[at][c] = len(child)
                child.append({})
                seen.append(0)
                ended.append(0)
                passed.append([0] * SYMBOLS)
            at = child[at][c]
        seen[at] += 1
        ended[at] += 1
    return _merged(child, seen, ended, passed, alpha, smooth)


def infer_tree(nodes: dict[str, list[int]], alpha: float = 0.05, smooth: float = 0.1) -> Automaton:
    """The same of a tree's nodes: by prefix (a letter per symbol), how many strings go on with each symbol, and how many end."""
    order = sorted(nodes, key=lambda x: (len(x), x))
    place = {x: k for k, x in enumerate(order)}
    child: list[dict[int, int]] = [{} for _ in order]
    for x in order[1:]:
        child[place[x[:-1]]][ord(x[-1]) - LETTER] = place[x]
    return _merged(child, [sum(nodes[x]) for x in order], [nodes[x][SYMBOLS] for x in order], [nodes[x][:SYMBOLS] for x in order], alpha, smooth)


def _merged(child: list[dict[int, int]], seen: list[int], ended: list[int], passed: list[list[int]], alpha: float, smooth: float) -> Automaton:
    width = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(x: int, n: int, y: int, m: int) -> bool:
        return abs(x / n - y / m) > width * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = seen[a], seen[b]
            if differ(ended[a], n, ended[b], m) or any(differ(x, n, y, m) for x, y in zip(passed[a], passed[b], strict=True)):
                return False
            todo += [(child[a][c], t) for c, t in child[b].items() if c in child[a]]
        return True

    def fold(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            seen[a] += seen[b]
            ended[a] += ended[b]
            passed[a] = [x + y for x, y in zip(passed[a], passed[b], strict=True)]
            for c, t in child[b].items():
                if c in child[a]:
                    todo.append((child[a][c], t))
                else:
                    child[a][c] = t

    red = [0]
    while True:
        known = set(red)
        blue = next(((r, c, t) for r in red for c, t in sorted(child[r].items()) if t not in known), None)
        if blue is None:
            break
        parent, symbol, node = blue
        into = next((r for r in red if compatible(r, node)), None)
        if into is None:
            red.append(node)
        else:
            child[parent][symbol] = into
            fold(into, node)
    place = {r: k for k, r in enumerate(red)}
    step, p, end = np.zeros((len(red), SYMBOLS), np.int64), np.zeros((len(red), SYMBOLS)), np.zeros(len(red))
    for r, k in place.items():
        total = seen[r] + smooth * (SYMBOLS + 1)
        p[k] = [(n + smooth) / total for n in passed[r]]
        end[k] = (ended[r] + smooth) / total
        for c in range(SYMBOLS):
            step[k, c] = place[child[r][c]] if c in child[r] else 0
    return Automaton(step, np.log(p), np.log(end))


@dataclass
class Model:
    credential: Automaton
    ordinary: Automaton
    threshold: float

    def ratios(self, texts: list[str]) -> np.ndarray:
        size = np.array([len(t) for t in texts], np.int64)
        return self.spans(_symbols(["".join(texts)])[0], np.cumsum(size) - size, size)

    def spans(self, symbols: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Log ratios of spans of a row of symbols."""
        return self.credential.likelihood(symbols, first, size) - self.ordinary.likelihood(symbols, first, size)


def _strings(docs: DataFrame, text_col: str) -> DataFrame:
    """kind (1: credential, 0: ordinary candidate), s (a letter per symbol) and n (how many distinct strings have these symbols) of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[set[int]] = [set(), set()]
        for batch in batches:
            for piece in pieces_of(batch, text_col):
                got = search(texts_of(piece.column(text_col)))
                prefix = prefix_hash(got.points)
                letters = (got.symbols() + LETTER).astype(np.uint8).tobytes().decode("ascii")
                labelled = [(a + c, a + e) for a, own in zip(got.begin.tolist(), got.matches, strict=True) for _, _, e, c in own]
                for kind, start, end in ((1, *np.array(labelled, np.int64).reshape(-1, 2).T), (0, got.start, got.end)):
                    h, one = np.unique(span_hash(prefix, start, end).view(np.int64), return_index=True)
                    fresh = [k for k, x in enumerate(h.tolist()) if x not in held[kind]]
                    if len(held[kind]) > HELD:
                        held[kind].clear()
                    held[kind].update(h[fresh].tolist())
                    at = one[fresh]
                    cells = [letters[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(h[fresh]), pa.array(cells, pa.string())], names=["kind", "h", "s"])

    found = docs.select(F.col(text_col).cast("string").alias(text_col)).mapInArrow(lean(run), "kind int, h bigint, s string")
    return saved(found.groupBy("kind", "h").agg(F.min("s").alias("s")).groupBy("kind", "s").agg(F.count("*").alias("n")), "secret-strings")


def frequent_prefixes(strings: DataFrame, least: int) -> dict[str, list[int]]:
    """The nodes of the prefix tree of all strings (s, n) that at least so many strings pass: how many go on with each symbol, and how many end.
    Levels are counted in runs of growing length, each over the strings with a frequent prefix of the levels before."""
    out: dict[str, list[int]] = {}
    depth, step = 0, 8
    live, open_ = strings.select("s", "n"), [""]
    while open_:
        if depth:
            some = strings.sparkSession.createDataFrame([(x,) for x in open_], "__open string")
            live = strings.select("s", "n").join(F.broadcast(some), F.substring("s", 1, depth) == F.col("__open"), "left_semi")
        at = live.select("s", "n", F.explode(F.sequence(F.lit(depth), F.least(F.length("s"), F.lit(depth + step - 1)))).alias("i"))
        node = at.select(F.expr("substring(s, 1, i)").alias("prefix"), F.expr("substring(s, i + 1, 1)").alias("next"), "n")
        goes = [F.sum(F.when(F.col("next") == x, F.col("n")).otherwise(0)) for x in [*(chr(LETTER + k) for k in range(SYMBOLS)), ""]]
        rows = node.groupBy("prefix").agg(F.sum("n").alias("all"), F.array(*goes).alias("goes")).where(F.col("all") >= least).select("prefix", "goes").collect()
        out.update((r.prefix, list(r.goes)) for r in rows)
        open_ = [r.prefix + chr(LETTER + k) for r in rows if len(r.prefix) == depth + step - 1 for k in range(SYMBOLS) if r.goes[k] >= least]
        depth, step = depth + step, 2 * step
    return out


def _spread(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of symbols of a batch's strings, where each begins, and sizes."""
    texts = batch.column("s").to_pylist()
    size = np.array([len(x) for x in texts], np.int64)
    return np.frombuffer("".join(texts).encode("ascii"), np.uint8).astype(np.int64) - LETTER, np.cumsum(size) - size, size


def learn(strings: DataFrame) -> Automaton:
    """Automaton of all strings (s, n): states from the frequent prefixes, probabilities from all strings' ways through them."""
    total = strings.agg(F.sum("n")).first()[0]
    shape = strings.sparkSession.sparkContext.broadcast(infer_tree(frequent_prefixes(strings, max(2, -(-total // SHARE))) or {"": [0] * (SYMBOLS + 1)}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = np.zeros((len(shape.value.step), SYMBOLS + 1), np.int64)
        for batch in batches:
            for piece in pieces_of(batch, "s"):
                passes += shape.value.passes(*_spread(piece), piece.column("n").to_numpy())
        cell = np.flatnonzero(passes)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(passes.ravel()[cell])], names=["cell", "n"])

    passes = np.zeros((len(shape.value.step), SYMBOLS + 1), np.int64)
    for r in strings.select("s", "n").mapInArrow(lean(run), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        passes.ravel()[r.cell] = r.n
    return shape.value.counted(passes)


def _scored(strings: DataFrame, score: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Strings (s, n) with the score of each, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces_of(batch, "s"):
                yield pa.RecordBatch.from_arrays([piece.column("s"), piece.column("n"), pa.array(score(*_spread(piece)))], names=["s", "n", "score"])

    return saved(strings.select("s", "n").mapInArrow(lean(run), "s string, n bigint, score double"), "secret-scores")


def rank(scored: DataFrame, share: float, bins: int = 1024) -> float | None:
    """The least score that so large a share of the rows (score, n) doesn't exceed, exactly: counts in bins, then in the
    bins of the one that holds it."""
    low, high, total = scored.agg(F.min("score"), F.max("score"), F.sum("n")).first()
    if total is None:
        return None
    below, want = 0, max(1, math.ceil(share * total))
    while low < high:
        place = F.least(F.lit(bins - 1), F.floor((F.col("score") - low) / (high - low) * bins).cast("int")).alias("bin")
        rows = scored.where(F.col("score").between(low, high)).groupBy(place).agg(F.sum("n").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).orderBy("bin").collect()
        for r in rows:
            if below + r.n >= want:
                low, high = r.low, r.high
                break
            below += r.n
    return low


def fit(docs: DataFrame, text_col: str = "text") -> Model | None:
    """Learns from all distinct strings of either kind; None without any labelled credential."""
    strings = _strings(docs, text_col)
    labelled = strings.where("kind = 1")
    if labelled.isEmpty():
        discard(strings)
        return None
    credential = learn(labelled)

    def per_letter(symbols: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        return credential.likelihood(symbols, first, size) / np.maximum(size, 1)

    # ordinary strings that look as much like credentials as most of those do may be unlabelled ones: they teach nothing
    known, others = _scored(labelled, per_letter), _scored(strings.where("kind = 0"), per_letter)
    ordinary = others.where(F.col("score") < rank(known, 0.02))
    model = Model(credential, credential, 0.0)
    if not ordinary.isEmpty():
        model.ordinary = learn(ordinary)
        ratios = _scored(ordinary, model.spans)
        model.threshold = max(0.0, rank(ratios, 0.999))
        discard(ratios)
    else:
        model.ordinary = infer([])
    discard(strings, known, others)
    return model


def _symbols(strings: list[str]) -> list[np.ndarray]:
    return [CLASS[np.frombuffer(s.encode("ascii"), np.uint8)].astype(np.int64) for s in strings]


def scan(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, n_format, base (the patterns' spans) and spans (all), as kind:start:end joined
    by commas, by start and then kind, and best (the highest log ratio of a candidate, null without any)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces_of(batch, text_col):
                got = search(texts_of(piece.column(text_col)))
                n = piece.num_rows
                best, added = np.full(n, -np.inf), [[] for _ in range(n)]
                if shared.value and len(got.start):
                    ratio = shared.value.spans(got.symbols(), got.start, got.end - got.start)
                    np.maximum.at(best, got.owner, ratio)
                    for i in np.flatnonzero(ratio > shared.value.threshold).tolist():
                        a = got.begin[got.owner[i]]
                        added[got.owner[i]].append((int(got.start[i] - a), 3, int(got.end[i] - a)))
                base = [[x[:3] for x in own] for own in got.matches]
                count = np.array([np.bincount([k for _, k, _ in s], minlength=3) for s in base], np.int64).reshape(-1, 3)
                columns = [piece.column(id_col), *(pa.array(count[:, k]) for k in range(3)), pa.array([len(a) for a in added], pa.int64()), pa.array([joined(s) for s in base]), pa.array([joined(sorted(s + a)) for s, a in zip(base, added, strict=True)]), pa.array(best, mask=np.isinf(best))]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_assign", "n_access", "n_hex", "n_format", "base", "spans", "best"])

    chosen = docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return chosen.mapInArrow(lean(run), f"{id_col} bigint, n_assign bigint, n_access bigint, n_hex bigint, n_format bigint, base string, spans string, best double")
