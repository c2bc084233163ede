"""Streams to tables: documents go to an outbox, unclaimed events past the engine, both once per batch id.

foreachBatch may repeat a batch after a failure; each batch writes a folder of its own number, which a repeat overwrites, so
results are whole and not doubled.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from millrace.operators import delivery, views
from millrace.plans.rules import Rule


def documents_by_rule(batch: DataFrame) -> DataFrame:
    """Documents of a stream's closed flows, each made by the rule that its flow began with. A batch has few rules, but may have several
    versions of one."""
    rules = sorted(r.rule_json for r in batch.select("rule_json").distinct().collect())
    made = [views.documents(batch.where(F.col("rule_json") == text).withColumn("rule", F.lit(0)).drop("rule_json"), [Rule.from_json(text)]) for text in rules]
    return reduce(DataFrame.unionByName, made) if made else batch.sparkSession.createDataFrame([], "output_id string, index string, created_at timestamp, document string")


def to_outbox(flows: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """Documents of closed flows, as Parquet below folder/batch=N."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            documents_by_rule(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        finally:
            batch.unpersist()

    return flows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def to_lines(unclaimed: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """Events that passed through, byte for byte, one text file per index and batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch.select("raw", "index").write.mode("overwrite").partitionBy("index").text(f"{folder}/batch={number}")

    return unclaimed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def drain(outbox: DataFrame, dead: DataFrame, sink: Callable, now, bulk: int = 64, max_retries: int = 8, max_dead: int = 10_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One delivery round: (outbox, dead letters, dropped) after sending what is due."""
    batch = delivery.pending(outbox, now, bulk)
    results = delivery.settled(batch, delivery.send(batch, sink), now, max_retries)
    return delivery.resolved(outbox, dead, results, now, max_dead)
