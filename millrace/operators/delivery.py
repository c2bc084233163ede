"""Delivery: an outbox of documents, sink verdicts, retries with growing delays, and dead letters that can be replayed.

Tables: an outbox has output_id, index, document, created_at, attempts, replay_count, last_error, rejection_type and
next_attempt_at (null: at once); dead letters also have dead_lettered_at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalars import retry_delay_ms

DELIVERED, RETRYABLE, PERMANENT = "delivered", "retryable", "permanent"


class Sink(Protocol):
    """Takes (output_id, index, document) rows; returns (output_id, status, error_type) of those that it answered."""

    def __call__(self, rows: Iterable[tuple[str, str, str]]) -> Iterable[tuple[str, int, str | None]]: ...


def classified(status: Column, error_type: Column) -> Column:
    """Disposition of a response: 2xx delivered; 408, 429 and 5xx retryable, as is a blocked cluster whatever its status;
    other 4xx permanent; everything else retryable."""
    return (
        F.when(error_type == "cluster_block_exception", RETRYABLE)
        .when(status.between(200, 299), DELIVERED)
        .when(status.isin(408, 429) | (status >= 500), RETRYABLE)
        .when(status.between(400, 499), PERMANENT)
        .otherwise(RETRYABLE)
    )


def enqueue(outbox: DataFrame, documents: DataFrame) -> DataFrame:
    """The outbox with new documents; a document of an id that is there already takes its place."""
    fresh = documents.select("output_id", "index", "document", "created_at", F.lit(0).alias("attempts"), F.lit(0).alias("replay_count"), F.lit(None).cast("string").alias("last_error"), F.lit(None).cast("string").alias("rejection_type"), F.lit(None).cast("timestamp").alias("next_attempt_at"))
    return outbox.join(fresh.select("output_id"), "output_id", "left_anti").unionByName(fresh)


def ready(outbox: DataFrame, now: Column) -> DataFrame:
    return outbox.where(F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now))


def pending(outbox: DataFrame, now: Column, limit: int = 64) -> DataFrame:
    """The next documents to deliver: the oldest that are due."""
    due = ready(outbox, now).orderBy("created_at", "output_id")
    return due.limit(limit) if limit else due


#: Status of records whose whole batch failed; retryable like all from 500 on.
BATCH_FAILED = 599


def send(batch: DataFrame, sink: Callable) -> DataFrame:
    """Verdicts (output_id, status, error_type) of a sink, called on the executors for some records at a time. An exception
    of the sink is the verdict of all these records: they are retryable, and the job goes on."""

    def run(batches):
        for b in batches:
            rows = list(zip(*[b.column(c).to_pylist() for c in ("output_id", "index", "document")], strict=True))
            try:
                got = [(i, int(status), error) for i, status, error in sink(rows)]
            except Exception as e:  # whatever the sink raises, no record may be lost
                got = [(i, BATCH_FAILED, type(e).__name__) for i, _, _ in rows]
            yield pa.RecordBatch.from_pydict({"output_id": pa.array([g[0] for g in got], pa.string()), "status": pa.array([g[1] for g in got], pa.int32()), "error_type": pa.array([g[2] for g in got], pa.string())})

    return batch.select("output_id", "index", "document").mapInArrow(run, "output_id string, status int, error_type string")


def verdicts_by_place(rows: DataFrame, sink: Callable, batch_size: int = 500) -> DataFrame:
    """Lines (index, raw) with the status that the sink gives each by its place, batch_size lines a request."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, batch_size):
                part = b.slice(k, batch_size)
                lines = list(zip(*[part.column(c).to_pylist() for c in ("index", "raw")], strict=True))
                try:
                    status = list(sink(lines))
                except Exception:  # as in send()
                    status = [BATCH_FAILED] * len(lines)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(status, pa.int32())], names=["index", "raw", "status"])

    return rows.select("index", "raw").mapInArrow(run, "index string, raw string, status int")


class Unsent:
    """Lines that wait for a sink: those left by batch N, in a folder of its number, are the first of batch N + 1. A repeated batch reads
    and writes the same folders."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, number: int) -> DataFrame:
        if number == 0:
            return self.spark.createDataFrame([], "index string, raw string")
        return self.spark.read.schema("index string, raw string").parquet(f"{self.folder}/waiting={number - 1}")

    def write(self, answered: DataFrame, number: int) -> None:
        way = classified(F.col("status"), F.lit(None).cast("string"))
        kept = answered.withColumn("way", way).where(F.col("way") != DELIVERED)
        # one request per line: the answers are written before they are told apart
        kept.write.mode("overwrite").parquet(f"{self.folder}/answers={number}")
        kept = self.spark.read.parquet(f"{self.folder}/answers={number}")
        kept.where(F.col("way") == RETRYABLE).select("index", "raw").write.mode("overwrite").parquet(f"{self.folder}/waiting={number}")
        kept.where(F.col("way") == PERMANENT).groupBy("index", "status").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{self.folder}/dropped={number}")


def settled(batch: DataFrame, verdicts: DataFrame, now: Column, max_retries: int = 8) -> DataFrame:
    """The batch with disposition and its new state. Records that the sink left out are retryable; more than max_retries
    failures are permanent (retry_limit_exceeded)."""
    answers = verdicts.groupBy("output_id").agg(F.max(F.struct("status", "error_type")).alias("v"))
    joined = batch.join(answers, "output_id", "left")
    first = F.when(F.col("v").isNull(), RETRYABLE).otherwise(classified(F.col("v.status"), F.col("v.error_type")))
    out = joined.withColumn("verdict", first).withColumn("attempts", F.col("attempts") + F.when(F.col("verdict") == RETRYABLE, 1).otherwise(0))
    spent = (F.col("verdict") == RETRYABLE) & (F.col("attempts") > max_retries)
    out = out.withColumn("disposition", F.when(spent, PERMANENT).otherwise(F.col("verdict")))
    kind = F.when(spent, "retry_limit_exceeded").when(F.col("disposition") == PERMANENT, F.coalesce(F.when(F.col("v.error_type") != "", F.col("v.error_type")), F.lit("unknown")))
    delay = F.make_dt_interval(secs=(retry_delay_ms(F.col("output_id"), F.col("attempts")) / 1000).cast("decimal(18,6)"))
    error = F.when(F.col("v").isNull(), "sink omitted delivery result").when(F.col("disposition") != DELIVERED, F.coalesce(F.col("v.error_type"), F.lit("sink rejected record")))
    return (
        out.withColumn("last_error", F.coalesce(error, F.col("last_error")))
        .withColumn("rejection_type", F.coalesce(kind, F.col("rejection_type")))
        .withColumn("next_attempt_at", F.when(F.col("disposition") == RETRYABLE, now + delay))
        .drop("v", "verdict")
    )


def resolved(outbox: DataFrame, dead: DataFrame, results: DataFrame, now: Column, max_dead: int = 10_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outbox, dead letters, dropped dead letters) after a delivery: delivered records leave, permanent ones move, of the
    dead letters the newest max_dead stay."""
    columns = outbox.columns
    untouched = outbox.join(results.select("output_id"), "output_id", "left_anti")
    again = results.where(F.col("disposition") == RETRYABLE).select(columns)
    moved = results.where(F.col("disposition") == PERMANENT).select(*columns, now.alias("dead_lettered_at"))
    every = dead.join(moved.select("output_id"), "output_id", "left_anti").unionByName(moved)
    kept, dropped = retained(every, max_dead)
    return untouched.select(columns).unionByName(again), kept, dropped


def retained(dead: DataFrame, maximum: int) -> tuple[DataFrame, DataFrame]:
    """The newest dead letters by creation, and the rest. A bounded top-k gives the oldest that stays; no full sort."""
    newest = dead.orderBy(F.desc("created_at"), F.desc("output_id")).limit(maximum).agg(F.min(F.struct("created_at", "output_id")).alias("least"))
    marked = dead.join(F.broadcast(newest), how="left")  # one row
    stays = F.struct("created_at", "output_id") >= F.col("least")
    return marked.where(stays).drop("least"), marked.where(~stays).drop("least")


def metadata(dead: DataFrame) -> DataFrame:
    """Dead letters without their documents, with these' bytes."""
    return dead.select(*[c for c in dead.columns if c != "document"], F.octet_length("document").cast("bigint").alias("document_bytes"))


def selected(dead: DataFrame, output_id: str = "", reason: str = "", index: str = "", older_than: Column | None = None) -> DataFrame:
    """Dead letters that meet all given conditions."""
    for column, value in (("output_id", output_id), ("rejection_type", reason), ("index", index)):
        if value:
            dead = dead.where(F.col(column) == value)
    return dead if older_than is None else dead.where(F.col("dead_lettered_at") < older_than)


def page(dead: DataFrame, cursor: str = "", limit: int = 50) -> tuple[DataFrame, Callable[[], str | None]]:
    """A page of dead letters in order of ids after the cursor, and the next cursor (None on the last page). limit: 1 to 500."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    more = dead.where(F.col("output_id") > cursor).orderBy("output_id").limit(limit + 1)

    def next_cursor() -> str | None:
        ids = [r.output_id for r in more.select("output_id").collect()]
        return ids[limit - 1] if len(ids) > limit else None

    return metadata(more.orderBy("output_id").limit(limit)), next_cursor


def replayed(outbox: DataFrame, dead: DataFrame, chosen: DataFrame, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """(outbox, dead letters) after the first `limit` (1 to 1000) chosen records, by id, go back to the outbox as new."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be between 1 and 1000")
    back = chosen.orderBy("output_id").limit(limit)
    fresh = back.drop("dead_lettered_at").withColumns({"attempts": F.lit(0), "last_error": F.lit(None).cast("string"), "rejection_type": F.lit(None).cast("string"), "next_attempt_at": F.lit(None).cast("timestamp"), "replay_count": F.col("replay_count") + 1})
    kept = outbox.join(back.select("output_id"), "output_id", "left_anti")
    return kept.unionByName(fresh.select(outbox.columns)), dead.join(back.select("output_id"), "output_id", "left_anti")


def replay(outbox: DataFrame, dead: DataFrame, output_id: str = "", reason: str = "", index: str = "", older_than: Column | None = None, limit: int = 100, dry_run: bool | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outbox, dead letters, metadata of the chosen) after a replay by conditions. Without an id the conditions may fit many, so then
    a dry run is the default: it shows what would go back, and changes nothing."""
    chosen = selected(dead, output_id, reason, index, older_than).orderBy("output_id").limit(limit)
    if dry_run if dry_run is not None else not output_id:
        return outbox, dead, metadata(chosen)
    return *replayed(outbox, dead, chosen, limit), metadata(chosen)


def due(open_flows: DataFrame, before: Column, limit: int = 128) -> DataFrame:
    """The next open flows to close: those of a deadline (expires_at) not after `before`, by deadline, rule and key."""
    rows = open_flows.where(F.col("expires_at") <= before).orderBy("expires_at", "rule_id", "key")
    return rows.limit(limit) if limit else rows


def observed(outbox: DataFrame, dead: DataFrame, dropped: DataFrame | None, at: Column) -> DataFrame:
    """One row of what alerts are made of: at, dead_letters, dropped, outbox, oldest_age_s, reasons (type and count of the dead
    letters, by type) and indices (of the dead letters and of the outbox, each once, in order). Types and indices are few."""
    now = at.alias("at")
    by_reason = summary(dead, "rejection_type").agg(F.array_sort(F.collect_list(F.struct(F.col("rejection_type").alias("type"), F.col("n").alias("count")))).alias("reasons"), F.coalesce(F.sum("n"), F.lit(0)).alias("dead_letters"))
    indices = dead.select("index", F.lit("dlq").alias("of")).unionByName(outbox.select("index", F.lit("outbox").alias("of"))).distinct()
    listed = [F.array_sort(F.collect_list(F.when(F.col("of") == k, F.col("index")))).alias(f"{k}_indices") for k in ("dlq", "outbox")]
    box = outbox.agg(F.count("*").alias("outbox"), F.min("created_at").alias("oldest"))
    lost = (dropped if dropped is not None else dead.limit(0)).agg(F.count("*").alias("dropped"))
    whole = by_reason.crossJoin(indices.agg(*listed)).crossJoin(box).crossJoin(lost)  # one row each
    age = F.coalesce((F.unix_micros(now) - F.unix_micros("oldest")) / 1e6, F.lit(0.0))
    return whole.select(now, "dead_letters", "dropped", "outbox", F.greatest(age, F.lit(0.0)).alias("oldest_age_s"), "reasons", "dlq_indices", "outbox_indices")


def alert_documents(found: DataFrame) -> DataFrame:
    """kind, at and document (JSON) of alerts."""
    counts = F.struct(F.col("dead_letters").alias("dlq_records"), F.col("dropped").alias("dlq_dropped"), F.col("outbox").alias("outbox_records"))
    dlq = F.concat(F.lit("dead-letter condition "), "state", F.lit(": "), F.col("dead_letters").cast("string"), F.lit(" retained, "), F.col("dropped").cast("string"), F.lit(" dropped"))
    backlog = F.concat(F.lit("outbox backlog condition "), "state", F.lit(": "), F.col("outbox").cast("string"), F.lit(" records, oldest "), F.format_string("%.0f", "oldest_age_s"), F.lit("s"))
    parts = [F.col("at").alias("@timestamp"), "kind", "state", counts.alias("counts")]
    parts += [F.col(c) for c in ("reasons", "indices") if c in found.columns]
    document = F.struct(*parts, F.col("oldest_age_s").alias("oldest_outbox_age_seconds"), F.when(F.col("kind") == "dlq", dlq).otherwise(backlog).alias("summary"))
    return found.select("kind", "at", F.to_json(document).alias("document"))


def summary(dead: DataFrame, by: str) -> DataFrame:
    """Counts of dead letters by rejection_type (unknown where missing) or index."""
    key = F.coalesce(F.when(F.col(by) != "", F.col(by)), F.lit("unknown")).alias(by)
    return dead.groupBy(key).agg(F.count("*").alias("n"))


def refuses(open_flows: int, outbox: int, max_open_flows: int, max_outbox: int) -> bool:
    """Whether new events are refused, to be sent again later; limits of 0 don't hold."""
    return bool(max_open_flows and open_flows >= max_open_flows or max_outbox and outbox >= max_outbox)


def expired_indices(indices: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Daily indices (index, created_at) older than the retention."""
    return indices.where(F.col("created_at") < now - F.make_dt_interval(days=F.lit(days)))


def alerts(seen: DataFrame, threshold_s: float = 300.0, min_interval_s: float = 300.0) -> DataFrame:
    """Alert phases over observations (at, dead_letters, dropped, outbox, oldest_age_s): kinds dlq and outbox_backlog.

    A kind starts when its condition first holds, goes on where it still holds min_interval after its last alert, and
    clears when it ends. Rows of observed() also give alerts their reasons and indices. Observations are few (one per delivery round); the chain of alerts of a kind is in
    order by nature, so each kind's run from start to clear is folded as one array of times.
    """
    kinds = F.array(
        F.struct(F.lit("dlq").alias("kind"), (F.col("dead_letters") > 0).alias("active")),
        F.struct(F.lit("outbox_backlog").alias("kind"), (F.col("oldest_age_s") > threshold_s).alias("active")),
    )
    figures = ["at", "dead_letters", "dropped", "outbox", "oldest_age_s"]
    each = seen.select("*", F.explode(kinds).alias("k")).select(*seen.columns, "k.kind", "k.active")
    if "reasons" in seen.columns:
        each = each.withColumn("indices", F.when(F.col("kind") == "dlq", F.col("dlq_indices")).otherwise(F.col("outbox_indices")))
        figures += ["reasons", "indices"]
    order = Window.partitionBy("kind").orderBy("at")
    before = F.coalesce(F.lag("active").over(order), F.lit(False))
    runs = each.withColumn("was", before).withColumn("run", F.sum((F.col("active") & ~F.col("was")).cast("int")).over(order))
    clearing = runs.where("not active and was").select("at", "kind", F.lit("clearing").alias("state"), *figures[1:])
    row = F.struct(*figures)
    lists = runs.where("active").groupBy("kind", "run").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    gap = F.lit(int(min_interval_s * 1e6))
    state = F.array(F.get("rows", F.lit(0)))
    emitted = F.aggregate(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0))), state, lambda acc, r: F.when(F.unix_micros(r["at"]) - F.unix_micros(F.element_at(acc, -1)["at"]) >= gap, F.array_append(acc, r)).otherwise(acc))
    out = lists.select("kind", F.posexplode(emitted).alias("n", "r")).select("r.at", "kind", F.when(F.col("n") == 0, "starting").otherwise("ongoing").alias("state"), *[f"r.{c}" for c in figures[1:]])
    return out.unionByName(clearing)
