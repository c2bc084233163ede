"""Flows of a stream: the same fold with keyed state and timers.

State holds the open flow of a (rule's id, key) and the rule as it was when the flow opened, as JSON, so a flow ends under the rule it
began with even if the query is started again with other rules, or with the same in another order. Each closed flow carries its rule (rule_json). It is cleared when the flow closes: what is kept are open flows
only, and flows of a stream have no number (flow_seq is null; their ids don't need one).

By default the clock is processing time: nothing is dropped, and flows close when the clock reaches their deadlines. In event time the
clock is observed_at, and rows older than the watermark are dropped by Spark, so observed_at should be stamped on
arrival (it then never goes back), or the watermark must allow for the disorder there is.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.operators.flows import INPUT
from millrace.operators.fold import UNAVAILABLE, Closed, Event, Flow, closed_row
from millrace.operators.route import matched
from millrace.plans.rules import Rule

_TIMES = ("first_observed", "finalized_at")


class FlowProcessor(StatefulProcessor):
    """One flow at a time per key. versions: the rules' current versions, if flows of others are to end as unavailable."""

    def __init__(self, rules: Sequence[Rule], versions: frozenset[str] | None = None):
        self.rules, self.versions = {r.id: r for r in rules}, versions
        self.place = {r.id: k for k, r in enumerate(rules)}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("flow", T.StructType([T.StructField("flow", T.StringType()), T.StructField("rule", T.StringType())]))

    def _load(self) -> tuple[Flow | None, Rule | None]:
        if not self.state.exists():
            return None, None
        flow, rule = self.state.get()
        return Flow.from_json(flow), Rule.from_json(rule)

    def _save(self, flow: Flow | None, rule: Rule | None) -> None:
        for at in self.handle.listTimers():
            self.handle.deleteTimer(at)
        if flow is None:
            self.state.clear()
            return
        self.handle.registerTimer(-(-flow.expires_at // 1000))
        self.state.update((flow.to_json(), rule.to_json()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rule_id, text = key
        place = self.place[rule_id]
        flow, rule = self._load()
        events = pd.concat(list(rows)).sort_values(["observed_us", "seq"], kind="stable")
        out = []
        for r in events.itertuples(index=False):
            if flow is not None and flow.expires_at <= r.observed_us:
                out.append((Closed(place, text, None, flow, flow.expiry_reason(rule), flow.expires_at), rule))
                flow = None
            if flow is None:
                rule = self.rules[rule_id]
                flow = Flow.open(r.observed_us, rule)
            groups = None if r.groups is None else list(r.groups)
            none = lambda x: None if x is None or x != x else x
            stamp = none(r.stamp_us)
            flow.apply(Event(r.observed_us, r.raw, none(r.event_type), None if stamp is None else int(stamp), none(r.stitch), none(r.role), groups, bool(r.terminal)), rule)
            if reason := flow.closes(rule, r.observed_us):
                out.append((Closed(place, text, None, flow, reason, r.observed_us), rule))
                flow = None
        self._save(flow, rule)
        if out:
            yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        flow, rule = self._load()
        if flow is None or flow.expires_at > expiredTimerInfo.getExpiryTimeInMs() * 1000:
            return
        reason = flow.expiry_reason(rule)
        if self.versions is not None and rule.version not in self.versions:
            reason = UNAVAILABLE
        self._save(None, None)
        yield _frame([(Closed(self.place.get(key[0], -1), key[1], None, flow, reason, flow.expires_at), rule)])

    def close(self) -> None:
        pass


#: Rows of a stream keep their arrays as JSON; times are microseconds.
STREAM_SCHEMA = "rule int, key string, flow_seq bigint, reason string, first_observed bigint, finalized_at bigint, rule_json string, body string"


def _frame(closed: list[tuple[Closed, Rule]]) -> pd.DataFrame:
    plain = []
    for row, rule in ((closed_row(c), r) for c, r in closed):
        body = json.dumps({k: row[k] for k in ("duplicates", "anomalies", "events", "invocations")})
        plain.append({k: row[k] for k in ("rule", "key", "flow_seq", "reason", *_TIMES)} | {"rule_json": rule.to_json(), "body": body})
    return pd.DataFrame(plain).astype({"flow_seq": "Int64"})


def stream_flows(routed: DataFrame, rules: Sequence[Rule], watermark: str | None = None, versions: frozenset[str] | None = None) -> DataFrame:
    """Closed flows of a stream of routed events, in the columns of the bounded fold, and rule_json. (rule is a place among the current rules, -1
    if the flow's rule is no longer there.) watermark: event time, with this delay; None:
    processing time."""
    from pyspark.sql import functions as F

    rows = matched(routed)
    if watermark is not None:
        rows = rows.withWatermark("observed_at", watermark)
    rows = rows.withColumn("observed_us", F.unix_micros("observed_at")).withColumn("stamp_us", F.unix_micros("stamp"))
    kept = [*(c for c in INPUT if c not in ("stamp",)), "seq", "observed_us", "stamp_us"]
    mode = "EventTime" if watermark is not None else "ProcessingTime"
    ids = F.array(*[F.lit(r.id) for r in rules])
    out = rows.select(*kept).withColumn("rule_id", F.get(ids, F.col("rule"))).groupBy("rule_id", "key").transformWithStateInPandas(FlowProcessor(rules, versions), STREAM_SCHEMA, "Append", mode)
    arrays = "struct<duplicates:array<struct<type:string,count:bigint>>,anomalies:array<struct<kind:string,detail:string,at:bigint>>,events:array<struct<observed:bigint,raw:string,type:string,stamp:bigint,invocation:int,role:string,ord:int>>,invocations:array<struct<stitch:string,groups:array<string>,ord:int,first_observed:bigint,complete:boolean,duplicates:bigint>>>"
    body = F.from_json("body", arrays)
    time = F.timestamp_micros
    return out.select(
        "rule", "rule_json", "key", "flow_seq", "reason", time("first_observed").alias("first_observed"), time("finalized_at").alias("finalized_at"), body.alias("b")
    ).select(
        "rule", "rule_json", "key", "flow_seq", "reason", "first_observed", "finalized_at", "b.duplicates",
        F.transform("b.anomalies", lambda a: a.withField("at", time(a["at"]))).alias("anomalies"),
        F.transform("b.events", lambda e: e.withField("observed", time(e["observed"])).withField("stamp", time(e["stamp"]))).alias("events"),
        F.transform("b.invocations", lambda i: i.withField("first_observed", time(i["first_observed"]))).alias("invocations"),
    )


def open_flows(spark, checkpoint: str) -> DataFrame:
    """Open flows in the state of a stream that stopped or goes on, by its checkpoint: rule_id, rule_version, key, first_observed, expires_at,
    event_count. The rule's id and version are those that the flow began with."""
    from pyspark.sql import functions as F

    state = spark.read.format("statestore").option("stateVarName", "flow").load(checkpoint)
    flow = F.from_json("value.flow", "struct<first_observed:bigint,expires_at:bigint,events:array<struct<order:int>>>")
    rule = F.from_json("value.rule", "struct<id:string,version:string>")
    rows = state.select(F.col("key.key").alias("key"), flow.alias("f"), rule.alias("r"))
    return rows.select(F.col("r.id").alias("rule_id"), F.col("r.version").alias("rule_version"), "key", F.timestamp_micros("f.first_observed").alias("first_observed"), F.timestamp_micros("f.expires_at").alias("expires_at"), F.size("f.events").cast("bigint").alias("event_count"))
