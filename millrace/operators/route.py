"""Routing: each event goes to the first enabled rule whose correlation key resolves to a text that isn't empty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.paths import Path, compile_path, literal
from millrace.functions.scalars import index_name, stamp
from millrace.plans.rules import Rule


def _by_rule(rules: Sequence[Rule], make, kind: str) -> Column:
    out = F.lit(None).cast(kind)
    for k in reversed(range(len(rules))):
        value = make(rules[k])
        if value is not None:
            out = F.when(F.col("rule") == k, value).otherwise(out)
    return out


def claim(events: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Events with rule (its place among `rules`; null if none claims the event) and key."""
    names = {k: f"__key{k}" for k, r in enumerate(rules) if r.enabled}
    keyed = events.select("*", *[rules[k].key.column("doc", "raw").alias(name) for k, name in names.items()])
    which = "CAST(NULL AS INT)" if not names else "coalesce(" + ", ".join(f"CASE WHEN {n} != '' THEN {k} END" for k, n in names.items()) + ")"
    key = "CAST(NULL AS STRING)" if not names else "coalesce(" + ", ".join(f"nullif({n}, '')" for n in names.values()) + ")"
    # generated columns: a filter on them stays above, so no key and no text is worked out twice for it
    return keyed.select(*events.columns, F.inline(F.array(F.struct(F.expr(which).cast("int").alias("rule"), F.expr(key).alias("key")))))


def describe(claimed: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Claimed events with what the fold needs of each: event_type, stamp (the producer's time), stitch, role, groups (null if the event
    stands alone) and terminal."""
    event_type = _by_rule(rules, lambda r: r.event_type.column("doc", "raw") if r.event_type else None, "string")
    stamped = _by_rule(rules, lambda r: stamp(r.timestamp.column("doc", "raw")) if r.timestamp else None, "timestamp")
    out = claimed.select("*", event_type.alias("event_type"), stamped.alias("stamp"))
    terminal = F.coalesce(_by_rule(rules, lambda r: F.col("event_type").isin(*r.terminal_events) if r.terminal_events else None, "boolean"), F.lit(False))

    def place(rule: Rule) -> Column | None:
        """(stitch, role) that the event's type has in the rule."""
        cases = [f"WHEN event_type IN ({', '.join(map(literal, role.types))}) THEN named_struct('stitch', {literal(s.id)}, 'role', {literal(role.name)})" for s in rule.stitches for role in s.roles if role.types]
        return F.expr(f"CASE {' '.join(cases)} END") if cases else None

    out = out.select("*", terminal.alias("terminal"), _by_rule(rules, place, "struct<stitch:string,role:string>").alias("place"))

    def groups(rule: Rule) -> Column | None:
        cases = [f"WHEN place.stitch = {literal(s.id)} THEN array({', '.join(g.sql_of_text('raw', 'doc') for g in s.group_by)})" for s in rule.stitches if s.group_by]
        cases += [f"WHEN place.stitch = {literal(s.id)} THEN CAST(array() AS ARRAY<STRING>)" for s in rule.stitches if not s.group_by]
        return F.expr(f"CASE {' '.join(cases)} END") if cases else None

    out = out.withColumn("groups", _by_rule(rules, groups, "array<string>"))
    known = F.expr("CASE WHEN groups IS NOT NULL AND NOT exists(groups, g -> g IS NULL) THEN groups END")
    grouped = out.withColumn("groups", known)
    alone = F.col("groups").isNull()
    return grouped.select(*[c for c in grouped.columns if c not in ("place", "terminal")], "terminal", F.when(~alone, F.col("place.stitch")).alias("stitch"), F.when(~alone, F.col("place.role")).alias("role"))


def route(events: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Claimed and described events."""
    return describe(claim(events, rules), rules)


def matched(routed: DataFrame) -> DataFrame:
    return routed.where("rule is not null")


def unmatched(routed: DataFrame) -> DataFrame:
    """Events that no rule claims."""
    return routed.where("rule is null")


def pass_through(routed: DataFrame, index: str, timestamp: str = "", now: Column | None = None) -> DataFrame:
    """Unclaimed events as they came, with the index their date gives them; without a readable date, that of `now`."""
    path = compile_path(timestamp) if timestamp else Path()
    at = stamp(path.column())
    return unmatched(routed).select("raw", "observed_at", "seq", index_name(index, at, now if now is not None else F.col("observed_at")).alias("index"))
