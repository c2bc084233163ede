"""Token ids in binary files: frequency-ranked ids in a byte-aligned variable-length code.

Ids are replaced by their rank in frequency over all documents (the most frequent is 0), so most take one byte.
Each rank takes 1 to 4 bytes, low byte first; the byte counts, two bits each, lie apart in control bytes, four
to a byte. Decoding looks each control byte up in a table of lengths and gathers the bytes with numpy.

A file is a run of blocks, and files hold ascending ranges of ids. A block: 4 little-endian unsigned 64-bit numbers (rows, ids, control bytes, data bytes),
then per row its id (signed 64-bit; the smallest number stands for null), its number of ids (unsigned 32-bit),
the control bytes and the data bytes. Files hold ascending ranges of row ids, which share an id at most where it ends one and begins the next, and rows ascend within
them (null first); the rank table is kept beside them as Parquet.

Null and empty texts give the end id alone. Equal ids and repeated rows stay, in any order among themselves. An empty
table gives no file and no row. A task writes under a name of its own attempt, and the manifest names the files of the
attempts that counted, so lost executors and repeated tasks leave whole results.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import pretokens
from millrace.llm.common import lean, pieces_of, saved, shared_dir, shuffle_parts, texts_of

NULL_ID = -(1 << 63)


def _code_lengths() -> np.ndarray:
    """Table: control byte -> the byte counts of its four values."""
    c = np.arange(256, dtype=np.uint8)
    return np.stack([((c >> (2 * k)) & 3) + 1 for k in range(4)], axis=1).astype(np.int64)


_LENGTHS = _code_lengths()


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = values.astype(np.uint32)
    size = 1 + (v > 0xFF) + (v > 0xFFFF) + (v > 0xFFFFFF)
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[: len(v)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    first = np.cumsum(size) - size
    data = np.empty(int(size.sum()), np.uint8)
    for k in range(4):
        has = size > k if k else slice(None)
        data[first[has] + k] = (v[has] >> np.uint32(8 * k)) & 0xFF
    return control.astype(np.uint8), data


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n values of pack's control and data bytes."""
    size = _LENGTHS[control].reshape(-1)[:n]
    first = np.cumsum(size) - size
    out = np.zeros(n, np.uint32)
    for k in range(4):
        has = np.flatnonzero(size > k)
        if not len(has):
            break
        out[has] |= data[first[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _open(folder: str, compression: str | None = None):
    """A new file in the folder, and its name."""
    fs, inner = pafs.FileSystem.from_uri(folder)
    fs.create_dir(inner, recursive=True)
    name = f"{folder}/{uuid.uuid4().hex}.ids"
    return fs.open_output_stream(f"{inner}/{name.rpartition('/')[2]}", compression=compression), name


def _write_block(out, keys: np.ndarray, sizes: np.ndarray, n: int, control: np.ndarray, data: np.ndarray) -> None:
    for part in (np.array([len(keys), n, control.nbytes, data.nbytes], "<u8"), keys.astype("<i8"), sizes.astype("<u4"), control, data):
        out.write(part.tobytes())


_FILE = "file string, least bigint, most bigint, rows bigint, ids bigint"


def _file_row(name: str, least: int, most: int, rows: int, ids: int) -> pa.RecordBatch:
    schema = pa.schema([("file", pa.string()), ("least", pa.int64()), ("most", pa.int64()), ("rows", pa.int64()), ("ids", pa.int64()), ("token_id", pa.int32()), ("n", pa.int64())])
    return pa.RecordBatch.from_pylist([{"file": name, "least": least, "most": most, "rows": rows, "ids": ids}], schema)


def write_tokens(docs: DataFrame, path: str, end_id: int | None = 0, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, np.ndarray]:
    """Encodes whole texts, appends `end_id` to each unless None, and writes the files in ascending order of ids.

    Texts are encoded once: a first pass writes plain ids, of 16 or, for larger vocabularies, 32 bits, and counts them, a second ranks and packs them.
    Returns the manifest (a row per file: file, its least id, rows, ids, and how many rows and ids all files before it
    hold) and the table rank -> id. Both are bounded: by the number of files and by the vocabulary.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "tokens")
    size = max(pretokens.library(path)[0].get_vocab_size(), (end_id or 0) + 1)
    plain_kind = "<u2" if size <= 1 << 16 else "<u4"
    docs = docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).cast("string").alias(text_col))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows, ids, least, most, count = None, 0, 0, 0, 0, np.zeros(size, np.int64)
        for batch in batches:
            for piece in pieces_of(batch, text_col):
                got, sizes = pretokens.encode_texts(path, texts_of(piece.column(text_col)))
                if end_id is not None:
                    got, sizes = np.insert(got.astype(plain_kind), np.cumsum(sizes), end_id), sizes + 1
                count += np.bincount(got, minlength=len(count))
                keys = piece.column(id_col).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
                if out is None:
                    (out, name), least = _open(f"{folder}/plain", "zstd"), int(keys[0])
                _write_block(out, keys, sizes, len(got), np.empty(0, np.uint8), got.astype(plain_kind))
                rows, ids, most = rows + len(keys), ids + len(got), int(keys[-1])
        if out is not None:
            out.close()
            first = _file_row(name, least, most, rows, ids)
            yield first
            at = np.flatnonzero(count)
            blank = [pa.nulls(len(at), f.type) for f in first.schema][:5]
            yield pa.RecordBatch.from_arrays([*blank, pa.array(at.astype(np.int32)), pa.array(count[at])], schema=first.schema)

    # rows of one id (or of none) may be many: they are dealt by their texts too, and their files stand side by side
    ordered = docs.repartitionByRange(shuffle_parts(spark), F.col(id_col), F.xxhash64(text_col)).sortWithinPartitions(id_col)
    plain = saved(ordered.mapInArrow(lean(encode), f"{_FILE}, token_id int, n bigint"), "plain")
    counts = plain.where("token_id is not null").groupBy("token_id").agg(F.sum("n").alias("n")).toPandas().sort_values(["n", "token_id"], ascending=[False, True])
    id_of = counts["token_id"].to_numpy(np.uint32)
    rank_of = np.zeros(size, np.uint32)
    rank_of[id_of] = np.arange(len(id_of), dtype=np.uint32)
    shared_ranks = spark.sparkContext.broadcast(rank_of)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out, name = _open(folder)
                for keys, sizes, n, _, data in _raw_blocks(row["file"], "zstd"):
                    _write_block(out, keys, sizes, n, *pack(shared_ranks.value[np.frombuffer(data, plain_kind)]))
                out.close()
                yield pa.RecordBatch.from_pylist([row | {"file": name}], batch.schema)

    files = plain.where("file is not null").select("file", "least", "most", "rows", "ids").repartition(shuffle_parts(spark), "file")
    made = files.mapInArrow(lean(rank), _FILE).toPandas().sort_values(["least", "most"], kind="stable")
    shared_ranks.destroy()
    made["first_row"] = made["rows"].cumsum() - made["rows"]
    made["first_id"] = made["ids"].cumsum() - made["ids"]
    made = made.astype({c: "int64" for c in made.columns if c != "file"})
    return spark.createDataFrame(made, f"{_FILE}, first_row bigint, first_id bigint"), id_of


def _raw_blocks(file: str, compression: str | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, int, bytes, bytes]]:
    fs, inner = pafs.FileSystem.from_uri(file)
    with fs.open_input_stream(inner, compression=compression) as f:
        while head := f.read(32):
            rows, n, n_control, n_data = map(int, np.frombuffer(head, "<u8"))
            yield np.frombuffer(f.read(8 * rows), "<i8"), np.frombuffer(f.read(4 * rows), "<u4").astype(np.int64), n, f.read(n_control), f.read(n_data)


def _blocks(file: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row ids, ids per row and ranks of each block of a file."""
    for keys, sizes, n, control, data in _raw_blocks(file):
        yield keys, sizes, unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n)


def read_tokens(spark: SparkSession, manifest: DataFrame, id_of: np.ndarray, with_ids: bool = False, id_col: str = "doc_id") -> DataFrame:
    """Per row, from the files: id, start (ids of all rows before it), n_tokens, ids_crc32 (of its ids as little-endian
    unsigned 32-bit integers), and with_ids the ids themselves."""
    shared_ids = spark.sparkContext.broadcast(id_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("first_id").to_pylist(), strict=True):
                for keys, sizes, ranks in _blocks(file):
                    ids = shared_ids.value[ranks].astype("<u4")
                    ends = np.cumsum(sizes)
                    first = ends - sizes
                    raw = memoryview(ids.tobytes())
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
                    columns = [pa.array(keys, mask=keys == NULL_ID), pa.array(start + first), pa.array(sizes), pa.array(crc, pa.int64())]
                    names = [id_col, "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32))))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    start += int(sizes.sum())

    schema = f"{id_col} bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    files = manifest.repartition(max(1, shuffle_parts(spark)), "file")
    return files.select("file", "first_id").mapInArrow(lean(run), schema)
