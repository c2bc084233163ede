"""Line deduplication by winnowing over line hashes; DataFrame functions only.

A window is the least run of lines, from some line on or up to some line, that holds `min_words` words or more; blank
lines don't count. Each window selects its least line hash, the last of equal ones, as a fingerprint; windows that
lie side by side mostly select the same line, so a document has far fewer selected positions than windows, and only positions
travel. Two places that share a run of min_words words share a whole window, hence the fingerprint that it selects: a position
whose fingerprint occurs nowhere else is done. Positions that do meet another one are compared by the windows
around them, from the selected line to both sides: windows of equal content belong together, the earliest stays (by id,
then line), and later ones mark all their lines. The windows from and up to each line of a repeated run reach
its ends, so what is marked grows together, line by line and both ways, to the longest repeated run. No pairs are made: a passage that a third
of all documents share is one group, aggregated before the shuffle.

A repeat that overlaps the earliest window within one document isn't one (the first copy always stays). Lines are
compared without blanks at their ends; hashes have 64 bits, twice. Null and empty texts stay as they are. Rows
with equal ids and texts are treated alike, as copies of one row: they lose what an earlier document has, not
what the other copy has. Very long documents are handled line by line, in time proportional to their lines.
An empty table gives an empty result; other columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import discard, saved

#: Names of this operator's own columns; no input column is touched or compared with them.
ID, TEXT, COPY, RUNS = "__line_doc", "__line_text", "__line_copy", "__line_runs"


def positions(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """Selected positions: document, fingerprint, the line it stands in, and the windows that select it (first and last line, and
    two hashes of the content)."""
    texts = docs.select(F.col(id_col).alias(ID), F.col(text_col).cast("string").alias(TEXT)).where(F.length(TEXT) > 0)
    lines = texts.select(ID, F.xxhash64(TEXT).alias(COPY), F.posexplode(F.split(TEXT, "\n", -1)).alias("line", "body"))
    body = F.trim("body")
    words = F.regexp_count(body, F.lit(r"\S+")).cast("bigint")
    lines = lines.select(ID, COPY, "line", F.xxhash64(body).alias("h"), F.xxhash64(F.lit(1), body).alias("g"), words.alias("words")).where("words > 0")
    doc = Window.partitionBy(ID, COPY).orderBy("line")
    # rows that repeat exactly have each line several times; once is enough
    lines = lines.withColumn("again", F.lag("line").over(doc).eqNullSafe(F.col("line"))).where("not again").drop("again")
    before = F.sum("words").over(doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words")
    ahead = Window.partitionBy(ID, COPY).orderBy("before").rangeBetween(0, min_words - 1)
    back = Window.partitionBy(ID, COPY).orderBy("until").rangeBetween(1 - min_words, 0)
    placed = lines.withColumn("before", before).withColumn("until", before + F.col("words"))

    def window(frame) -> Column:
        least = F.min(F.struct("h", (-F.col("line")).alias("place"))).over(frame)
        return F.struct(F.sum("words").over(frame).alias("held"), least.alias("least"), F.min("line").over(frame).alias("first"), F.max("line").over(frame).alias("last"), F.collect_list("h").over(frame).alias("hs"), F.collect_list("g").over(frame).alias("gs"))

    both = placed.select(ID, COPY, window(ahead).alias("a"), window(back).alias("b")).select(ID, COPY, F.explode(F.array("a", "b")).alias("w")).where(F.col("w.held") >= min_words)
    content = F.struct("w.first", "w.last", F.xxhash64("w.hs").alias("h"), F.xxhash64(F.lit(2), F.col("w.gs")).alias("g"))
    # at most two windows per line of a window select one line
    return both.groupBy(ID, COPY, F.col("w.least.h").alias("fingerprint"), F.col("w.least.place").alias("place")).agg(F.collect_set(content).alias("windows"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """A written table: per id and hash of the text (__line_doc, __line_copy), __line_runs: first and last line of the longest runs, in order
    and apart from each other, that repeat an earlier run of min_words words or more."""
    selected = saved(positions(docs, id_col, text_col, min_words), "line-positions")
    # joined alike at every size: by sorted exchanges of tables, whose large groups Spark can split
    often = saved(selected.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint"), "line-fingerprints")
    matches = saved(selected.join(often.hint("merge"), "fingerprint"), "line-matches")
    met = matches.select(ID, COPY, "fingerprint", F.explode("windows").alias("w")).select(ID, COPY, "fingerprint", "w.*")
    key = ["fingerprint", "h", "g"]
    at = F.struct(F.col(ID).isNotNull().alias("known"), F.col(ID).alias("doc"), F.col("first").alias("first"), F.col("last").alias("last"), F.col(COPY).alias("copy"))
    earliest = saved(met.groupBy(*key).agg(F.min(at).alias("origin"), F.max(at).alias("newest")).where("origin != newest").select(*key, "origin"), "line-origins")
    later = met.join(earliest.hint("merge"), key).where((~F.col(ID).eqNullSafe(F.col("origin.doc"))) | (F.col(COPY) != F.col("origin.copy")) | (F.col("first") > F.col("origin.last")))
    # what is marked, as runs that don't touch
    doc = Window.partitionBy(ID, COPY).orderBy("first", "last")
    reach = F.max("last").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    marked = later.select(ID, COPY, "first", "last").distinct().withColumn("apart", F.coalesce(F.col("first") > reach + 1, F.lit(True)).cast("int"))
    runs = marked.withColumn("run", F.sum("apart").over(doc.rowsBetween(Window.unboundedPreceding, Window.currentRow))).groupBy(ID, COPY, "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    out = saved(runs.groupBy(ID, COPY).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias(RUNS)), "line-marks")
    discard(selected, often, matches, earliest)
    return out


def _kept(text: Column, runs: Column) -> Column:
    """The text without the runs of lines: what lies between them, each stretch cut out once."""

    def joined(lines: Column) -> Column:
        n = F.size(runs)
        start = lambda k: F.when(k == 0, 0).otherwise(F.get(runs, k - 1)["last"] + 1)
        end = lambda k: F.when(k == n, F.size(lines)).otherwise(F.get(runs, k)["first"])
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), n), lambda k: F.slice(lines, start(k) + 1, end(k) - start(k)))), "\n")

    return F.get(F.transform(F.array(F.split(text, "\n", -1)), joined), F.lit(0))  # splits once


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, removed_col: str | None = None) -> DataFrame:
    """The rows with repeated runs deleted from their texts; with removed_col, also the number of lines deleted."""
    marks = repeats(docs, id_col, text_col, min_words)
    # by place, so that no name of an input column can be one of the marks'
    place = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    body = F.col(place[text_col])
    marked = docs.toDF(*place.values()).join(marks.hint("merge"), F.col(place[id_col]).eqNullSafe(F.col(ID)) & (F.xxhash64(body.cast("string")) == F.col(COPY)), "left")
    text = F.when(F.col(RUNS).isNull(), body).otherwise(_kept(body.cast("string"), F.col(RUNS)))
    columns = [(text if c == text_col else F.col(x)).alias(c) for c, x in place.items() if c != removed_col]
    if removed_col:
        columns.append(F.coalesce(F.aggregate(RUNS, F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1), F.lit(0)).alias(removed_col))
    return marked.select(*columns)
