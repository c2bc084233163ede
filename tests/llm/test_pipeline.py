import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_take_effect(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    seen = docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns, name
        left = out.count()
        assert 0.7 * seen <= left <= seen
        docs, seen = out, left
    assert pipeline.run(spark, data).count() == seen


def test_planted(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    item = spark.read.parquet(f"{data}/benchmark.parquet").first().text
    base = docs.where("n_chars between 900 and 2000").orderBy("doc_id").first()
    words = base.text.split(" ")
    near = " ".join(["changed" if k == 40 else w for k, w in enumerate(words)])
    extra = [(10**6, base.text), (10**6 + 1, near), (10**6 + 2, f"{' '.join(words[:60])} {item} {' '.join(words[60:120])}")]
    df = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in extra], docs.schema))
    kept = {r.doc_id for r in pipeline.near_copies(spark, df, data).collect()}
    assert base.doc_id in kept and not {10**6, 10**6 + 1} & kept
    clean = {r.doc_id for r in pipeline.benchmark_leaks(spark, df, data).collect()}
    assert 10**6 + 2 not in clean


def test_odd_rows(spark, data):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and columns that stages could take for their own."""
    names = ["__id", "__removed", "__leaking", "removed_lines", "__line_doc", "__line_runs", "cls", "component_id", "held_out", "ids", "d", "g"]
    long = "\n".join(f"this is line number {k} of a long text without repeats" for k in range(4000))
    texts = [(1, None), (2, ""), (3, "  \n "), (4, long), (5, "some short text"), (5, "some short text"), (None, "a text without an id"), (None, None), (6, long + "\nand an end")]
    df = spark.createDataFrame([(i, t, None, None, None, *["x"] * len(names)) for i, t in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} string" for n in names))
    want = {"toxicity": 9, "line dedup": 9, "n-gram Jaccard join": 9, "benchmark decontamination": 9}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, df, data)
        assert out.schema.fieldNames() == df.schema.fieldNames() and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
        rows = out.collect()
        assert {r["component_id"] for r in rows} == {"x"} and len(rows) == want[name] - (name == "n-gram Jaccard join"), name
        if name == "line dedup":
            assert {r.doc_id: r.text for r in rows}[6] == "and an end" and {r.doc_id: r.text for r in rows}[4] == long
        assert stage(spark, df.where("false"), data).count() == 0
    last = pipeline.STAGES[-1][1](spark, df, data).collect()
    assert len(last) == 9 and {r.doc_id: r.n_tokens for r in last}[2] == 0
