"""Event sources: raw JSON rows to events, single or batched, with everything that can't be an event kept apart.

An event has raw (the text as it came), doc (variant), observed_at (the engine's time stamp) and seq (tie-break).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Accepted:
    events: DataFrame
    rejected: DataFrame


def accept(rows: DataFrame, raw: str = "raw", observed_at: str = "observed_at", seq: str = "seq", max_bytes: int = 4 << 20) -> Accepted:
    """One event per row. Texts over max_bytes and texts that aren't one JSON object are rejected, with a reason."""
    doc = F.try_parse_json(F.col(raw))
    is_object = F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False))
    reason = F.when(F.octet_length(raw) > max_bytes, "too large").when(~is_object, "malformed json")
    made = rows.select(F.col(raw).alias("raw"), doc.alias("doc"), F.col(observed_at).cast("timestamp").alias("observed_at"), F.col(seq).cast("bigint").alias("seq"), reason.alias("reason"))
    return Accepted(made.where("reason is null").drop("reason"), made.where("reason is not null").select("raw", "observed_at", "seq", "reason"))


#: Elements of an array that have places of their own in seq; later ones share the last.
WITHIN = 1 << 20


def accept_batch(rows: DataFrame, body: str = "body", observed_at: str = "observed_at", max_bytes: int = 4 << 20, number: str | None = None) -> Accepted:
    """Rows that hold JSON arrays of events. All events of an array share its observed_at and are numbered in order; the first
    element that isn't an object ends its array, and events before it count. number: a column that orders arrays of one observed_at; their
    events are then numbered from WITHIN times it on, so that no two of them tie."""
    parsed = F.try_parse_json(F.col(body)).try_cast("array<variant>")
    ok = parsed.isNotNull() & (F.octet_length(body) <= max_bytes)
    base = F.col(number).cast("bigint") * WITHIN if number else F.lit(0).cast("bigint")
    items = rows.where(ok).select(F.col(observed_at).cast("timestamp").alias("observed_at"), base.alias("base"), parsed.alias("items"))
    kinds = F.transform("items", lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)))
    items = items.withColumn("first_bad", F.array_position(kinds, F.lit(False)))
    each = items.select("observed_at", "base", "first_bad", F.posexplode("items").alias("at", "doc"))
    seq = (F.col("base") + F.least(F.col("at"), F.lit(WITHIN - 1))).alias("seq")
    events = each.where("first_bad = 0 or at < first_bad - 1").select(F.to_json("doc").alias("raw"), "doc", "observed_at", seq)
    bad = each.where("at = first_bad - 1").select(F.to_json("doc").alias("raw"), "observed_at", seq, F.lit("malformed json").alias("reason"))
    whole = F.when(F.octet_length(body) > max_bytes, "too large").otherwise("malformed json")
    lost = rows.where(~F.coalesce(ok, F.lit(False))).select(F.col(body).alias("raw"), F.col(observed_at).cast("timestamp").alias("observed_at"), base.alias("seq"), whole.alias("reason"))
    return Accepted(events, bad.unionByName(lost))


def as_events(df: DataFrame, observed_at: Column, seq: Column, **values: Column) -> DataFrame:
    """Events made of typed columns: the document is their JSON object; the event time may be an NTZ timestamp (UTC)."""
    raw = F.to_json(F.struct(*[c.alias(k) for k, c in values.items()]))
    out = df.select(raw.alias("raw"), observed_at.cast("timestamp").alias("observed_at"), seq.cast("bigint").alias("seq"))
    return out.withColumn("doc", F.parse_json("raw"))
