"""Index templates of a configuration: one mapping per distinct output index, with the names that its rules give."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import types as T

from millrace.functions.scalars import SPARK_TYPES, index_wildcard
from millrace.plans.rules import Rule

#: Fields of flow documents and their types in the index.
ENTRY = {"complete": "boolean", "duration_ms": "long", "started_at": "date", "ended_at": "date", "type": "keyword", "timestamp": "date", "duplicate_count": "long", "event": "flat_object"}
ROLE = {"type": "keyword", "timestamp": "date", "event": "flat_object"}
FLOW = {
    "id": "keyword", "rule_id": "keyword", "rule_version": "keyword", "finalization_reason": "keyword", "started_at": "date", "ended_at": "date",
    "duration_ms": "long", "age_ms": "long", "event_count": "long", "entry_count": "long", "duplicate_count": "long", "incomplete_invocations": "long",
}
ANOMALY = {"kind": "keyword", "detail": "keyword", "at": "date"}
ALERT = {"@timestamp": "date", "kind": "keyword", "state": "keyword", "summary": "keyword", "indices": "keyword", "oldest_outbox_age_seconds": "double"}
ALERT_COUNTS = {"dead_letter_records": "long", "dead_letter_dropped": "long", "outbox_records": "long"}
TYPE_COUNT = {"type": "keyword", "count": "long"}


def _typed(names: dict[str, str]) -> dict[str, Any]:
    return {k: {"type": v} for k, v in names.items()}


def _closed(properties: dict[str, Any], **more: Any) -> dict[str, Any]:
    return {**more, "dynamic": False, "properties": properties}


def _template(index: str, properties: dict[str, Any], description: str) -> dict[str, Any]:
    return {"index_patterns": [index_wildcard(index)], "template": {"mappings": _closed(properties)}, "priority": 100, "_meta": {"description": description}}


def flow_template(index: str, rules: Sequence[Rule]) -> dict[str, Any]:
    roles = sorted({r.name for rule in rules for s in rule.stitches for r in s.roles})
    groups = sorted({g for rule in rules for s in rule.stitches for g in s.group_fields})
    promoted = {p.name: p.type for rule in rules for p in rule.promotions}
    entry = _typed(ENTRY) | {"group": _closed(_typed(dict.fromkeys(groups, "keyword")))} | {r: _closed(_typed(ROLE)) for r in roles}
    properties = {
        "@timestamp": {"type": "date"},
        "flow": _closed(_typed(FLOW) | {"duplicates": {"properties": _typed(TYPE_COUNT)}}),
        "events": _closed(entry, type="object"),
        "anomalies": _closed(_typed(ANOMALY), type="object"),
    }
    if promoted:
        properties["fields"] = _closed(_typed(dict(sorted(promoted.items()))))
    return _template(index, properties, "Fields of flow documents and promoted fields.")


def alert_template(index: str) -> dict[str, Any]:
    properties = _typed(ALERT) | {"counts": _closed(_typed(ALERT_COUNTS)), "reasons": _closed(_typed(TYPE_COUNT), type="object")}
    return _template(index, properties, "Fields of delivery alerts.")


def templates(rules: Sequence[Rule], alerts_index: str = "") -> list[dict[str, Any]]:
    """[{index, template}] in order of index."""
    by_index: dict[str, list[Rule]] = {}
    for rule in rules:
        by_index.setdefault(rule.index, []).append(rule)
    made = [{"index": i, "template": flow_template(i, own)} for i, own in by_index.items()]
    if alerts_index:
        made.append({"index": alerts_index, "template": alert_template(alerts_index)})
    return sorted(made, key=lambda t: t["index"])


def promoted_schema(rules: Sequence[Rule]) -> T.StructType:
    """Spark types of the promoted fields of all rules."""
    kinds = {p.name: p.type for r in rules for p in r.promotions}
    types = {"string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}
    return T.StructType([T.StructField(n, types[SPARK_TYPES[k]]) for n, k in sorted(kinds.items())])
