"""Counters, gauges and histograms of the engine as tables; labels come from rules and from the engine's own names only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.views import per_rule
from millrace.plans.rules import Rule

#: Upper bounds of histogram buckets: durations in ms, event counts.
DURATION_MS = (10, 50, 100, 500, 1000, 5000, 30_000, 60_000)
EVENTS = (1, 2, 4, 8, 16, 32, 64, 128)


def bucket(value: Column, bounds: Sequence[int]) -> Column:
    """The least bound that the value doesn't exceed, as text; +Inf beyond."""
    out = F.lit("+Inf")
    for b in sorted(bounds, reverse=True):
        out = F.when(value <= b, str(b)).otherwise(out)
    return out


def ingest(routed: DataFrame, rules: Sequence[Rule], pass_through: bool) -> DataFrame:
    """Events by rule and disposition."""
    rule = per_rule(rules, lambda r: F.lit(r.id), "string")
    way = F.when(F.col("rule").isNotNull(), "correlated").when(F.lit(pass_through), "passed_through").otherwise("quarantined")
    return routed.groupBy(F.coalesce(rule, F.lit("")).alias("rule_id"), way.alias("disposition")).agg(F.count("*").alias("n"))


def closed(figures: DataFrame) -> DataFrame:
    """Closed flows by rule and reason, with sums for averages."""
    return figures.groupBy("rule_id", "reason").agg(F.count("*").alias("flows"), F.sum("event_count").alias("events"), F.sum("duplicate_count").alias("duplicates"), F.sum("incomplete_invocations").alias("incomplete"), F.sum("age_ms").alias("age_ms"))


def histogram(figures: DataFrame, column: str, bounds: Sequence[int], by: str = "rule_id") -> DataFrame:
    """Counts per bucket of a figure, by rule (or another label)."""
    return figures.groupBy(by, bucket(F.col(column), bounds).alias("le")).agg(F.count("*").alias("n"))


def open_flows(flows: DataFrame, at: Column) -> DataFrame:
    """Flows open at a moment, by rule and version."""
    live = flows.where((F.col("first_observed") <= at) & (F.col("finalized_at") > at))
    return live.groupBy("rule_id", "rule_version").agg(F.count("*").alias("n"))


def ready(open_count: int, outbox: int, max_open: int, max_outbox: int, state_ok: bool) -> bool:
    """Readiness: state can be read and capacity is left. Liveness never depends on the sink."""
    return state_ok and not (max_open and open_count >= max_open or max_outbox and outbox >= max_outbox)
