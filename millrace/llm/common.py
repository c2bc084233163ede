"""Small helpers shared by the corpus operators: tables, shared folders, hashing of text in numpy."""

from __future__ import annotations

import ctypes
import gc
import math
import re
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A blank between two letters or digits: a place where texts may be cut without changing pretokens or words.
BETWEEN_WORDS = re.compile(r"(?<=[^\W_]) (?=[^\W_])")
#: Bytes of text that one numpy pass handles at a time (temporaries take about 60 times as much).
CHUNK_BYTES = 1 << 20

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder, read by Spark alone (the folder may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which the driver and all executors share.

    Where the setting is unset and everything runs in one process (local runs and tests), a folder of the session's warehouse; on a cluster
    an unset folder is an error, as executors and driver need not share any other.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[\d*, ]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        if "://" not in root and not root.startswith("file:"):
            root = f"file://{root}"
        if root.startswith("file:/") and not root.startswith("file:///"):
            root = "file://" + root[len("file:") :]
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it again: cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    trim()
    return out


def discard(*frames: DataFrame) -> None:
    """Removes the folders of saved frames that nothing will read again: what was made of them is itself written by now."""
    for frame in frames:
        context = frame.sparkSession.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(frame.saved_at)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def shuffle_parts(spark: SparkSession) -> int:
    """Number of partitions for a keyed exchange; follows the session, which follows the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def texts_of(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def pieces_of(batch: pa.RecordBatch, name: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Splits a record batch into runs of rows whose texts have about `limit` bytes (one row at least)."""
    if not batch.num_rows:
        return
    sizes = np.asarray(batch.column(name).cast(pa.large_binary()).fill_null(b"").to_numpy(zero_copy_only=False))
    ends = np.cumsum([len(x) for x in sizes])
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def parts_of(texts: list[str], edge: re.Pattern, limit: int = CHUNK_BYTES, skip: int = 0) -> Iterator[tuple[np.ndarray, list[str]]]:
    """The texts in groups of about `limit` characters, with each one's number; longer texts are cut before matches of `edge`, so that
    temporaries stay bounded whatever a text's length (a run without any such place stays whole). skip: characters left out at a cut."""
    owner, held, size = [], [], 0
    for k, text in enumerate(texts):
        a = 0
        while True:
            b = len(text)
            if b - a > limit and (m := edge.search(text, a + limit)):
                b = m.start()
            owner.append(k)
            held.append(text[a:b] if a or b < len(text) else text)
            size += b - a
            if size >= limit:
                yield np.array(owner, np.int64), held
                owner, held, size = [], [], 0
            if b >= len(text):
                break
            a = b + skip
    if held:
        yield np.array(owner, np.int64), held


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a task which, when the task ends, gives the memory it freed back to the system: Python workers
    outlive their tasks, and what they hold adds up over the stages of a job."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return task


def trim() -> None:
    """Gives this process's freed memory, and tables that are quickly made again, back to the system."""
    del _powers[:], _symbols[:]
    _powers.extend([np.ones(1, U64), np.ones(1, U64)])
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit values (splitmix)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) <= n:
        size = 1 << max(12, math.ceil(math.log2(n + 2)))
        for k, base in ((0, BASE), (1, BASE_INVERSE)):
            row = np.full(size, base, U64)
            row[0] = 1
            _powers[k] = np.multiply.accumulate(row)
    return _powers[0][: n + 1], _powers[1][: n + 1]


_symbols: list[np.ndarray] = []


def symbol_values(symbols: np.ndarray) -> np.ndarray:
    """Mixed 64-bit values of code points or bytes."""
    if not _symbols:
        _symbols.append(mixed(np.arange(0x110000, dtype=U64) + BASE))
    return _symbols[0][symbols]


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """Running polynomial hash of a row of symbols; n + 1 values. See span_hash."""
    out = np.zeros(len(symbols) + 1, U64)
    np.cumsum(symbol_values(symbols) * powers(len(symbols))[0][:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) of the row below `prefix`; equal content gives equal hashes."""
    raw = (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]
    return mixed(raw + (end - start).astype(U64) * BASE)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of all spans, one after the other."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(np.asarray(starts, np.int64) - first, lengths)


def free_names(df: DataFrame, *names: str) -> DataFrame:
    """Drops extra columns whose names an operator needs for its own results."""
    return df.drop(*[c for c in df.columns if c in names])


def unused(df: DataFrame, name: str) -> str:
    """A column name like `name` that the frame doesn't have (names are compared without regard to case)."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name
