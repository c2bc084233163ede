"""Corpus pipeline: documents without toxic ones, repeated lines, near copies and benchmark leaks, encoded to ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet to the shared folder
and reads them again for the next. All but the last return the columns of documents, extra ones included, whatever their names.
Null, empty and blank texts stay through all stages but line dedup, which drops a document only if it deleted lines and nothing is left; they get no
ids. Very long texts are handled whole. Rows that repeat an id and a text stay or go together. Rows without an id are judged by toxicity and
line dedup and pass the other two filters. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, line_dedup, ngram_join, sentencepieces, toxicity
from millrace.llm.common import saved, table, unused
from millrace.llm.queries import vocabulary


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic; learns from the labels' documents."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines, of 50 words or more, that an earlier document has; n_chars follows the text.
    Documents with nothing left go."""
    removed = unused(docs, "removed_lines")
    out = line_dedup.dedup(docs, min_words=50, removed_col=removed)
    out = out.where(~((F.col(removed) > 0) & (F.trim(F.coalesce("text", F.lit(""))) == "")))
    if "n_chars" in docs.columns:
        length = F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies: five-word shingles, Jaccard 0.8 or more.

    Without words a document is in no group; rows that repeat one id stay or go together."""
    gone = ngram_join.join(docs, n=5, num=80, den=100).where("component_id != doc_id").select("doc_id").distinct()
    return docs.alias("d").join(gone.alias("g"), F.col("d.doc_id") == F.col("g.doc_id"), "left_anti").select("d.*")


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the text's SentencePiece ids and their number."""
    out = sentencepieces.encode(docs.select("doc_id", "text"), vocabulary("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [("toxicity", toxic), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", benchmark_leaks), ("SentencePiece encoding", token_ids)]

#: SQL can't express the nearest neighbours of the first stage, nor the pieces of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = saved(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
