"""The fold: what an open flow does with each event, and when it closes. Used alike over tables and over streams.

Times are microseconds. The schedule is the ideal one: a flow is closed at its deadline exactly, before any event
at or after it is applied.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa

from millrace.functions.paths import canonical_json, stored_bytes
from millrace.plans.rules import ALL_COMPLETE, Rule

TERMINAL, LIMIT, COMPLETE, TIMEOUT, UNAVAILABLE = "terminal_event", "limit_exceeded", "invocations_complete", "timeout", "rule_unavailable"
MEMBER, PLAIN, DUPLICATE, CARDINALITY = "member", "plain", "duplicate", "cardinality"
#: Layout of the state; other versions fail closed.
STATE_VERSION = 1


@dataclass(slots=True)
class Event:
    """What the fold reads of a routed event; raw is parsed only where documents are compared or measured."""

    observed: int
    raw: str
    type: str | None = None
    stamp: int | None = None
    stitch: str | None = None
    role: str | None = None
    groups: list[str] | None = None
    terminal: bool = False


@dataclass(slots=True)
class Invocation:
    stitch: str
    groups: list[str]
    order: int
    first_observed: int
    members: dict[str, int] = field(default_factory=dict)  # role -> number of the stored event
    complete: bool = False
    duplicates: int = 0


@dataclass(slots=True)
class Stored:
    """An event that the flow keeps: its place in the timeline, and its invocation (-1: on its own)."""

    observed: int
    raw: str
    type: str | None
    stamp: int | None
    invocation: int
    role: str | None
    order: int


@dataclass(slots=True)
class Flow:
    first_observed: int
    timeout_at: int
    expires_at: int
    settle_until: int | None = None
    terminal_seen: bool = False
    limit_seen: bool = False
    next_order: int = 0
    bytes: int = 0
    duplicates: dict[str, int] = field(default_factory=dict)
    events: list[Stored] = field(default_factory=list)
    invocations: list[Invocation] = field(default_factory=list)
    anomalies: list[tuple[str, str, int]] = field(default_factory=list)
    #: Made of the above: number of each invocation, and how many are incomplete.
    place: dict[tuple, int] = field(default_factory=dict, repr=False, compare=False)
    incomplete: int = field(default=0, repr=False, compare=False)

    @classmethod
    def open(cls, observed: int, rule: Rule) -> Flow:
        return cls(observed, observed + rule.timeout_us, observed + rule.timeout_us)

    def apply(self, e: Event, rule: Rule) -> str:
        """Takes an event in; says as what."""
        self.terminal_seen |= e.terminal
        if e.stitch is None:
            self._store(e, rule, -1)
            return PLAIN
        at = self._invocation(e)
        call = self.invocations[at]
        if e.role in call.members:
            if _same(self.events[call.members[e.role]].raw, e.raw):
                call.duplicates += 1
                self.duplicates[e.type] = self.duplicates.get(e.type, 0) + 1
                return DUPLICATE
            self.anomalies.append(("cardinality_exceeded", f"stitch {e.stitch} role {e.role} is already occupied", e.observed))
            self._store(e, rule, -1)
            return CARDINALITY
        call.members[e.role] = len(self.events)
        self._store(e, rule, at)
        if not call.complete and call.members.keys() >= rule.required(e.stitch):
            call.complete = True
            self.incomplete -= 1
        return MEMBER

    def _invocation(self, e: Event) -> int:
        """Number of the event's invocation, which is new if its stitch and group are."""
        at = self.place.setdefault((e.stitch, *e.groups), len(self.invocations))
        if at == len(self.invocations):
            self.invocations.append(Invocation(e.stitch, list(e.groups), self.next_order, e.observed))
            self.next_order += 1
            self.incomplete += 1
        return at

    def _store(self, e: Event, rule: Rule, invocation: int) -> None:
        order = self.invocations[invocation].order if invocation >= 0 else self.next_order
        self.next_order += invocation < 0
        self.events.append(Stored(e.observed, e.raw, e.type, e.stamp, invocation, e.role if invocation >= 0 else None, order))
        if rule.max_event_bytes > 0 or rule.max_flow_bytes > 0:
            size = stored_bytes(json.loads(e.raw))
            self.bytes += size
            self.limit_seen |= size > rule.max_event_bytes > 0 or self.bytes > rule.max_flow_bytes > 0

    def closes(self, rule: Rule, now: int) -> str | None:
        """The reason to close now, by priority; keeps the settle timer."""
        if self.terminal_seen:
            return TERMINAL
        if self.limit_seen or len(self.events) >= rule.max_events > 0:
            return LIMIT
        done = rule.close_when == ALL_COMPLETE and self.invocations and not self.incomplete
        if not done:
            self.settle_until, self.expires_at = None, self.timeout_at
            return None
        if rule.settle_us <= 0:
            return COMPLETE
        if self.settle_until is None:
            self.settle_until = now + rule.settle_us
            self.expires_at = min(self.timeout_at, self.settle_until)
            return None
        return COMPLETE if now >= self.settle_until else None

    def expiry_reason(self, rule: Rule) -> str:
        """The reason at the deadline."""
        return self.closes(rule, self.expires_at) or TIMEOUT

    def to_json(self) -> str:
        kept = asdict(self)
        del kept["place"], kept["incomplete"]
        return json.dumps({"v": STATE_VERSION, **kept}, separators=(",", ":"))

    @classmethod
    def from_json(cls, text: str) -> Flow:
        raw = json.loads(text)
        if raw.pop("v", None) != STATE_VERSION:
            raise ValueError("flow state of an unknown version")
        raw["events"] = [Stored(**e) for e in raw["events"]]
        raw["invocations"] = [Invocation(**i) for i in raw["invocations"]]
        raw["anomalies"] = [tuple(a) for a in raw["anomalies"]]
        place = {(i.stitch, *i.groups): k for k, i in enumerate(raw["invocations"])}
        return cls(**raw, place=place, incomplete=sum(not i.complete for i in raw["invocations"]))


def _same(a: str, b: str) -> bool:
    return a == b or canonical_json(json.loads(a)) == canonical_json(json.loads(b))


#: Row of a closed flow.
FLOW_SCHEMA = (
    "rule int, key string, flow_seq bigint, reason string, first_observed timestamp, finalized_at timestamp, "
    "duplicates array<struct<type:string,count:bigint>>, anomalies array<struct<kind:string,detail:string,at:timestamp>>, "
    "events array<struct<observed:timestamp,raw:string,type:string,stamp:timestamp,invocation:int,role:string,ord:int>>, "
    "invocations array<struct<stitch:string,groups:array<string>,ord:int,first_observed:timestamp,complete:boolean,duplicates:bigint>>"
)


@dataclass(slots=True)
class Closed:
    """A closed flow: whose it is, its number, why and when it closed. Times are microseconds."""

    rule: int
    key: str
    seq: int | None
    flow: Flow
    reason: str
    at: int


def closed_batch(closed: list[Closed], schema: pa.Schema, with_raw: bool = True) -> pa.RecordBatch:
    """Closed flows as a batch in FLOW_SCHEMA's columns, put together column by column."""

    def lists(kind: pa.DataType, rows: list[list], columns: list[list]) -> pa.Array:
        offsets = pa.array(np.append(0, np.cumsum([len(r) for r in rows], dtype=np.int64)).astype(np.int32))
        made = [_column(c, f.type) for c, f in zip(columns, kind.value_type, strict=True)]
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(made, fields=list(kind.value_type)), type=kind)

    flows = [c.flow for c in closed]
    duplicates = [sorted(f.duplicates.items(), key=lambda x: (x[0] is not None, x[0])) for f in flows]
    events = [e for f in flows for e in f.events]
    calls = [i for f in flows for i in f.invocations]
    noted = [a for f in flows for a in f.anomalies]
    tallied = [d for row in duplicates for d in row]
    kind = {f.name: f.type for f in schema}
    plain = [[c.rule for c in closed], [c.key for c in closed], [c.seq for c in closed], [c.reason for c in closed], [f.first_observed for f in flows], [c.at for c in closed]]
    columns = [_column(x, f.type) for x, f in zip(plain, schema, strict=False)]
    columns.append(lists(kind["duplicates"], duplicates, [[t for t, _ in tallied], [n for _, n in tallied]]))
    columns.append(lists(kind["anomalies"], [f.anomalies for f in flows], [[a[k] for a in noted] for k in range(3)]))
    raw = [e.raw for e in events] if with_raw else [None] * len(events)
    columns.append(lists(kind["events"], [f.events for f in flows], [[e.observed for e in events], raw, [e.type for e in events], [e.stamp for e in events], [e.invocation for e in events], [e.role for e in events], [e.order for e in events]]))
    columns.append(lists(kind["invocations"], [f.invocations for f in flows], [[i.stitch for i in calls], [i.groups for i in calls], [i.order for i in calls], [i.first_observed for i in calls], [i.complete for i in calls], [i.duplicates for i in calls]]))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """Values as an Arrow array; times come as microseconds."""
    return pa.array(values, pa.int64()).cast(kind) if pa.types.is_timestamp(kind) else pa.array(values, kind)


def closed_row(c: Closed) -> dict:
    """A closed flow as plain values."""
    flow = c.flow
    return {
        "rule": c.rule, "key": c.key, "flow_seq": c.seq, "reason": c.reason, "first_observed": flow.first_observed, "finalized_at": c.at,
        "duplicates": [{"type": t, "count": n} for t, n in sorted(flow.duplicates.items(), key=lambda x: (x[0] is not None, x[0]))],
        "anomalies": [dict(zip(("kind", "detail", "at"), a, strict=True)) for a in flow.anomalies],
        "events": [{"observed": e.observed, "raw": e.raw, "type": e.type, "stamp": e.stamp, "invocation": e.invocation, "role": e.role, "ord": e.order} for e in flow.events],
        "invocations": [{"stitch": i.stitch, "groups": i.groups, "ord": i.order, "first_observed": i.first_observed, "complete": i.complete, "duplicates": i.duplicates} for i in flow.invocations],
    }
