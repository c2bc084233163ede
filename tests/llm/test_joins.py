import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from millrace.llm import line_dedup, ngram_join, topk
from millrace.llm.queries import LINE_DEDUP_SQL, oracle_sql, queries


def linked(texts, n, num, den):
    """Set sizes and components by brute force over all pairs; texts by id."""
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    index = defaultdict(list)
    for d in sorted(sets):
        common = defaultdict(int)
        for g in sets[d]:
            for e in index[g]:
                common[e] += 1
            index[g].append(d)
        for e, o in common.items():
            if den * o >= num * (len(sets[d]) + len(sets[e]) - o):
                a, b = find(d), find(e)
                top[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def made_texts(seed=1):
    """Groups of copies and near copies of many sizes, chains of small changes, and texts that share a long passage."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5)))
    passage = [word() for _ in range(60)]
    texts = []
    for size in (3, 5, 9, 14, 30, 80, 300):
        base = [word() for _ in range(size)]
        for _ in range(14):
            own = list(base)
            for _ in range(r.randint(0, max(1, size // 40))):
                own[r.randrange(size)] = word()
            texts.append(" ".join(own))
        for _ in range(8):  # a chain: each a little further
            base = list(base)
            base[r.randrange(size)] = word()
            texts.append("\n".join(base))
    for _ in range(60):
        texts.append(" ".join(passage + [word() for _ in range(r.randint(1, 14))]))
    r.shuffle(texts)
    return {k * 3: t for k, t in enumerate(texts + ["", "   ", "one", "ONE", "two three"])}


def check(spark, texts, n, num, den):
    df = spark.createDataFrame([*texts.items(), (None, "one"), (None, None)], "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df, n, num, den).collect() if r.doc_id is not None}
    assert got == linked(texts, n, num, den)


def test_join_by_brute_force(spark):
    texts = made_texts()
    check(spark, texts, 4, 85, 100)
    check(spark, texts, 5, 80, 100)


def test_join_with_all_ways_in_use(spark, monkeypatch):
    """Tiny limits, so that gathered pieces, several pieces a bucket and trees of several levels all take part."""
    for name, value in (("PIECE", 5), ("LOCAL", 3), ("CHUNK", 2000), ("FAN", 2), ("MAP_BITS", 3)):
        monkeypatch.setattr(ngram_join, name, value)
    check(spark, made_texts(2), 4, 85, 100)
    check(spark, made_texts(3), 5, 80, 100)


def test_trees_find_the_candidates(spark, data):
    """All links are among the pairs that the trees give, and these are few."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rng = np.random.default_rng(8)
    points = rng.poisson(2.0, (400, ngram_join.POINT)).astype(np.int32)
    points[200:] = points[:200]
    points[200:, 0] += 1
    bands = ngram_join.Bands(85, 100)
    a, b = ngram_join.cover(points, np.arange(400) % 200 // 4, bands)
    met = {frozenset(x) for x in zip(a.tolist(), b.tolist(), strict=True)}
    assert {frozenset((k, k + 200)) for k in range(200)} <= met and len(met) <= 800
    links = ngram_join.join(docs, 4, 85, 100)
    assert links.where("component_id != doc_id").count() > 0


def test_copies_short_of_the_threshold_are_not_candidates():
    """Copies of one text that differ in too many places: few of their pairs may be left to be verified, whatever their number."""
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in range(400)]
    texts = []
    for k in range(60):
        words = list(base)
        for at in rng.choice(400, 6, replace=False):
            words[at] = f"x{k}y{at}"
        texts.append(" ".join(words))
    h, sizes = ngram_join.shingle_sets(texts, 4)
    ends, bands = np.append(0, np.cumsum(sizes)), ngram_join.Bands(85, 100)
    sets = [set(h[ends[k] : ends[k + 1]].tolist()) for k in range(60)]
    near = {(i, j) for i in range(60) for j in range(60) if bands.enough(np.int64(len(sets[i] & sets[j])), sizes[i], sizes[j])}
    points = ngram_join.points(h, sizes)
    q, row = ngram_join.Forest(points, np.zeros(60, np.int64), np.arange(60), bands).reach(points, np.zeros(60, np.int64))
    got = set(zip(q.tolist(), row.tolist(), strict=True))
    assert near <= got and len(got - near) < 40  # of 3540 pairs
    assert (ngram_join._points(ngram_join._point_bytes(h, sizes, 7)) == points).all()


def test_points_as_bytes():
    """Coordinates beyond one and two bytes, and no sets at all."""
    h = np.concatenate([np.zeros(300, np.uint64), np.ones(70_000, np.uint64), np.full(3, 1 << 63, np.uint64)])
    sizes = np.array([300, 70_000, 0, 3])
    held = ngram_join._point_bytes(h, sizes)
    assert [x[0] for x in held] == [2, 4, 1, 1] and (ngram_join._points(held) == ngram_join.points(h, sizes)).all()
    assert ngram_join._points([]).shape == (0, ngram_join.POINT)


def test_join_edges(spark, docs, texts, empty):
    got = {r.doc_id: r for r in ngram_join.join(docs).collect()}
    assert got[4].component_id == 0 and got[1].n_shingles == 0 and got[1].component_id == 1 and got[None].component_id is None
    assert ngram_join.join(empty).count() == 0


def test_bands_hold_all_linked_sizes():
    for num, den in ((85, 100), (80, 100)):
        starts = ngram_join.Bands(num, den).starts(400)
        band = lambda s: int(np.searchsorted(starts, s, side="right")) - 1  # noqa: B023, E731
        assert all(0 <= band(b) - band(a) <= 1 for a in range(1, 400) for b in range(a, a * den // num + 1))


def test_forest_reaches_all():
    rng = np.random.default_rng(3)
    rows = rng.poisson(1.0, (300, ngram_join.POINT)).astype(np.int32)
    rows[150:] = np.maximum(0, rows[:150] + rng.integers(-1, 2, (150, ngram_join.POINT)) * (rng.random((150, ngram_join.POINT)) < 0.03))
    group, component = np.concatenate([np.arange(150) % 7] * 2), np.arange(300) % 3
    bands = ngram_join.Bands(85, 100)
    forest = ngram_join.Forest(rows, group, component, bands)
    for own in (None, component):
        q, row = forest.reach(rows, group, own)
        got = set(zip(q.tolist(), row.tolist(), strict=True))
        want = set()
        for i, p in enumerate(rows):
            fits = bands.enough(np.minimum(rows, p).sum(axis=1), rows.sum(axis=1), int(p.sum())) & (group == group[i])
            want |= {(i, j) for j in np.flatnonzero(fits & (component != component[i]) if own is not None else fits).tolist()}
        assert got == want


def dedup_rows(spark, texts, min_words=6):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    return [r.text for r in line_dedup.dedup(df, min_words=min_words).orderBy("doc_id").collect()]


def test_lines(spark, docs, empty):
    run = "one two three\nfour five six\nseven"
    got = dedup_rows(spark, [run, f"new\n{run}\nend", "four five six", f"{run}\n\n{run}", "a\n" * 30, None, "", "one two three\n \nfour five six "])
    assert got == [run, "new\nend", "four five six", "", "a\n" * 6, None, "", ""]
    out = line_dedup.dedup(docs, removed_col="gone")
    assert set(out.columns) == {*docs.columns, "gone"} and out.count() == docs.count()
    # the first of equal long texts stays
    kept = {r.doc_id: r.text for r in line_dedup.dedup(docs, min_words=4).collect()}
    assert kept[0] == "The cat sat.\nOn the mat, it's fine." and kept[4] == ""
    assert line_dedup.dedup(empty).count() == 0


def test_lines_of_one_text_repeat(spark):
    (a,) = dedup_rows(spark, ["x y z\np q r\nmiddle\nx y z\np q r"])
    assert a == "x y z\np q r\nmiddle"


def test_lines_by_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    key = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(object).to_numpy().tolist()))
    assert key(queries()["op9_line_dedup"](spark, data).toPandas()) == key(con.sql(LINE_DEDUP_SQL).df())


def test_lines_stay_in_the_jvm(spark, docs):
    frames = [line_dedup.positions(docs, "doc_id", "text", 50), line_dedup.dedup(docs)]
    for plan in (f._jdf.queryExecution().toString() for f in frames):
        assert "Python" not in plan and "Arrow" not in plan


def nearest(vectors, k, every):
    out = []
    x = {i: np.floor(np.array(v, np.float64) * 64) for i, v in vectors.items()}
    for q in sorted(i for i in x if i % every == 0):
        best = sorted((-int(x[q] @ x[c]), c) for c in x if c != q)[:k]
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return out


def test_top_k(spark):
    rng = np.random.default_rng(5)
    v = {i: rng.standard_normal(12).astype(np.float32).tolist() for i in range(900)}
    for i in range(300, 340):
        v[i] = v[300]  # ties
    bad = [(5000, None), (5020, [None] * 12), (5040, [float("nan")] * 12), (5060, [float("inf")] * 12), (None, v[1])]
    df = spark.createDataFrame([*v.items(), *bad], "vec_id bigint, embedding array<float>").repartition(4)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df).collect())
    assert got == nearest(v, 20, 20)
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (20, [3.0])], "vec_id bigint, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(few).collect())) == [(0, 1, 20, 64 * 192), (0, 2, 1, 64 * 128), (20, 1, 1, 192 * 128), (20, 2, 0, 192 * 64)]
    assert topk.top_k(df.where("false")).count() == 0


def test_top_k_in_blocks(spark):
    rng = np.random.default_rng(6)
    v = {i: rng.standard_normal(5).tolist() for i in range(400)}
    df = spark.createDataFrame(list(v.items()), "vec_id bigint, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, k=7, every=4, shard_rows=16, query_rows=16, cell_rows=40).collect())
    assert got == nearest(v, 7, 4)


def test_few_positions_are_selected(spark, data):
    """Winnowing: each window selects one position, neighbours mostly the same; equal windows select equal lines."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    found = line_dedup.positions(docs, "doc_id", "text", 50)
    rows = found.select("__line_doc", "fingerprint", "place", F.explode("windows").alias("w")).select("*", "w.*").toPandas()
    assert found.count() < 0.7 * len(rows)
    assert (rows.groupby(["h", "g"])["fingerprint"].nunique() == 1).all()
    assert ((rows["first"] <= -rows["place"]) & (-rows["place"] <= rows["last"])).all()


def test_many_lines(spark):
    """A long text whose repeated lines alternate with new ones, and one that repeats as a whole."""
    n = 4000
    base = [f"line {k} of seven words or so" for k in range(n)]
    other = [x if k % 3 else f"{k}" for k, x in enumerate(base)]
    got = dedup_rows(spark, ["\n".join(base), "\n".join(other), "\n".join(base[n // 2 :])], min_words=14)
    assert got[0] == "\n".join(base) and got[2] == ""
    assert got[1].split("\n") == [x for k, x in enumerate(other) if k % 3 == 0]


def test_top_k_exact_or_refused(spark):
    big = [(0, [3e5, 1.0]), (1, [2e5, 3.0]), (2, [-1e5, 5.0]), (3, [2e5, 3.5])]
    frame = lambda rows: spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(frame(big)).collect()) == nearest(dict(big), 20, 20)
    huge = [(0, [2.0**31, 2.0**31]), (1, [2.0**19, 1.0]), (2, [2.0**19, -(2.0**19)])]
    want = sorted(((0, 64 * 64 * sum(int(a) * int(b) for a, b in zip(huge[0][1], v, strict=True)), i) for i, v in huge[1:]), key=lambda x: (-x[1], x[2]))
    assert [(r.vec_id, r.score) for r in topk.top_k(frame(huge)).orderBy("rank").collect()] == [(i, x) for _, x, i in want]
    for bad in ([(0, [1e8]), (1, [5e8])], [(0, [1e300]), (1, [1.0])]):
        with pytest.raises(Exception, match="64-bit integer"):
            topk.top_k(frame(bad)).collect()


def test_top_k_odd_rows(spark):
    """Repeated ids, vectors of unequal width, clashing names, and the query as a whole."""
    rows = [(0, [1.0, 2.0], 9), (0, [0.5], 9), (1, [1.0], 9), (1, [2.0, 1.0, 7.0], 9), (2, [], 9), (20, [0.0], 9)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, cell int").withColumn("shard", F.lit("x")).withColumn("score", F.lit(1))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df).collect())
    assert got == [(0, 1, 1, 64 * 64), (0, 2, 1, 32 * 64), (0, 3, 2, 0), (0, 4, 20, 0), (20, 1, 0, 0), (20, 2, 0, 0), (20, 3, 1, 0), (20, 4, 1, 0), (20, 5, 2, 0)]


@pytest.mark.parametrize("name,tables", [("op8_topk", ["embeddings"]), ("op5_ngram_join", ["documents"])])
def test_queries_by_sql(spark, data, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    key = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(object).to_numpy().tolist()))
    assert key(queries()[name](spark, data).toPandas()) == key(con.sql(oracle_sql()[name]).df())
