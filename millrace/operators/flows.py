"""Flows of a bounded table: one exchange by (rule, key), a sort, and the fold over each sorted partition.

Only the keys are read before the exchange; types, stamps, groups and roles are read after it, where the work is spread by
key however the input was cut, and the exchange carries five columns. The fold streams: a task holds the open flow of one key and the
rows of the batches it is reading, so a key with any number of events needs no more memory than its longest flow. Keys are
independent, so partitions scale out; one key's events are in order by nature and stay in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.operators.fold import FLOW_SCHEMA, Closed, Event, Flow, closed_batch
from millrace.operators.route import claim, describe, matched
from millrace.plans.rules import Rule

#: Closed flows per Arrow batch.
BATCH = 4096
INPUT = ("rule", "key", "observed_at", "raw", "event_type", "stamp", "stitch", "role", "groups", "terminal")
ORDER = ("rule", "key", "observed_at", "seq")


def flows(events: DataFrame, rules: Sequence[Rule], with_raw: bool = True, latest: bool = False) -> DataFrame:
    """Closed flows (FLOW_SCHEMA) of events, numbered per key from 1. Open flows at the end close at their deadlines.
    with_raw False: without the events' texts, for views that don't look into them. latest: of a key's flows of one first observation, which
    have one document id, only the last; documents then need no exchange by id."""
    narrow = matched(claim(events, rules)).select(*ORDER, "raw").repartition("rule", "key").sortWithinPartitions(*ORDER)
    return _folded(describe(narrow.withColumn("doc", F.parse_json("raw")), rules).select(*INPUT), rules, with_raw, latest)


def fold(routed: DataFrame, rules: Sequence[Rule], with_raw: bool = True) -> DataFrame:
    """Closed flows of events that are routed already."""
    needed = matched(routed).select(*INPUT, "seq").repartition("rule", "key").sortWithinPartitions(*ORDER)
    return _folded(needed.select(*INPUT), rules, with_raw)


def _folded(needed: DataFrame, rules: Sequence[Rule], with_raw: bool, latest: bool = False) -> DataFrame:
    rules = tuple(rules)
    arrow = to_arrow_schema(T._parse_datatype_string(FLOW_SCHEMA), timestamp_utc=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[Closed] = []
        at: tuple[int, str] | None = None
        flow, seq, rule = None, 0, None

        def close(reason: str, when: int) -> None:
            nonlocal flow, seq
            seq += 1
            if latest and out and (out[-1].rule, out[-1].key, out[-1].flow.first_observed) == (*at, flow.first_observed):
                out.pop()
            out.append(Closed(*at, seq, flow, reason, when))
            flow = None

        for batch in batches:
            columns = [batch.column(c) for c in INPUT]
            for k in (2, 5):
                columns[k] = columns[k].cast(pa.int64())
            for r, key, observed, raw, kind, stamp, stitch, role, groups, terminal in zip(*[c.to_pylist() for c in columns], strict=True):
                if at != (r, key):
                    if flow is not None:
                        close(flow.expiry_reason(rule), flow.expires_at)
                    at, seq, rule = (r, key), 0, rules[r]
                if flow is not None and flow.expires_at <= observed:
                    close(flow.expiry_reason(rule), flow.expires_at)
                if flow is None:
                    flow = Flow.open(observed, rule)
                flow.apply(Event(observed, raw, kind, stamp, stitch, role, groups, terminal), rule)
                if reason := flow.closes(rule, observed):
                    close(reason, observed)
            while len(out) > BATCH:  # the last may yet be replaced
                yield closed_batch(out[:BATCH], arrow, with_raw)
                del out[:BATCH]
        if flow is not None:
            close(flow.expiry_reason(rule), flow.expires_at)
        if out:
            yield closed_batch(out, arrow, with_raw)

    return needed.mapInArrow(run, FLOW_SCHEMA)
