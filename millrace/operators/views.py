"""What closed flows look like from outside: entries, flow figures, anomalies, promoted fields, documents.

All are expressions over the arrays that a flow row holds, so none of them needs another exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.paths import literal
from millrace.functions.scalars import SPARK_TYPES, coerced, index_name, output_id, rfc3339
from millrace.plans.rules import FINALIZED, LAST, Promotion, Rule


def per_rule(rules: Sequence[Rule], make, kind: str) -> Column:
    """make(rule) of each flow's rule."""
    out = F.lit(None).cast(kind)
    for k, rule in enumerate(rules):
        value = make(rule)
        out = out if value is None else F.when(F.col("rule") == k, value).otherwise(out)
    return out


def _role_stamps(names: Sequence[str]) -> str:
    """SQL text: stamps of the members of the call c in these roles, in this order; roles without a member are left out."""
    members = [f"transform(filter(events, e -> e.invocation = c.number AND e.role = {literal(n)}), e -> e.stamp)" for n in names]
    return f"flatten(array({', '.join(members)}))" if members else "CAST(array() AS ARRAY<TIMESTAMP>)"


def _timed(rule: Rule) -> str:
    """SQL text: the flow's calls with started_at, ended_at and duration_ms. A call begins with its first known stamp in the order of the
    required roles, and ends with the last of these; if none of them has a stamp, all roles count."""
    need = "CASE " + " ".join(f"WHEN c.stitch = {literal(s.id)} THEN {_role_stamps(s.required)}" for s in rule.stitches) + " END"
    every = "CASE " + " ".join(f"WHEN c.stitch = {literal(s.id)} THEN {_role_stamps([r.name for r in s.roles])}" for s in rule.stitches) + " END"
    known = "exists(c.need, s -> s IS NOT NULL)"
    given = ", ".join(f"'{n}', c.{n}" for n in ("stitch", "groups", "ord", "first_observed", "complete", "duplicates", "number"))
    numbered = "transform(invocations, (i, k) -> named_struct('stitch', i.stitch, 'groups', i.groups, 'ord', i.ord, 'first_observed', i.first_observed, 'complete', i.complete, 'duplicates', i.duplicates, 'number', k))"
    stamped = f"transform({numbered}, c -> named_struct({given}, 'need', {need}, 'every', {every}))"
    bounded = f"transform({stamped}, c -> named_struct({given}, 'started_at', get(filter(CASE WHEN {known} THEN c.need ELSE c.every END, s -> s IS NOT NULL), 0), 'last', CASE WHEN {known} THEN get(c.need, size(c.need) - 1) ELSE get(c.every, size(c.every) - 1) END))"
    apart = "unix_micros(c.last) - unix_micros(c.started_at)"
    return f"transform({bounded}, c -> named_struct({given}, 'started_at', c.started_at, 'ended_at', CASE WHEN c.complete THEN c.last END, 'duration_ms', CASE WHEN c.complete THEN ({apart}) DIV 1000 ELSE -1L END))"


def with_figures(flows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Flow rows with rule_id, rule_version, started_at, ended_at, duration_ms, age_ms, event_count, entry_count,
    duplicate_count, incomplete_invocations, complete_invocations, calls (invocations with their times) and output_id."""
    calls_type = "array<struct<stitch:string,groups:array<string>,ord:int,first_observed:timestamp,complete:boolean,duplicates:bigint,number:int,started_at:timestamp,ended_at:timestamp,duration_ms:bigint>>"
    out = flows.selectExpr(
        "*",
        "array_min(transform(events, e -> e.stamp)) AS started_at",
        "array_max(transform(events, e -> e.stamp)) AS ended_at",
        "CAST(size(filter(invocations, i -> NOT i.complete)) AS BIGINT) AS incomplete_invocations",
        "CAST(size(filter(invocations, i -> i.complete)) AS BIGINT) AS complete_invocations",
    )
    return out.select(
        "*",
        per_rule(rules, lambda r: F.lit(r.id), "string").alias("rule_id"),
        per_rule(rules, lambda r: F.lit(r.version), "string").alias("rule_version"),
        F.expr("(unix_micros(ended_at) - unix_micros(started_at)) DIV 1000 AS duration_ms"),
        F.expr("(unix_micros(finalized_at) - unix_micros(first_observed)) DIV 1000 AS age_ms"),
        F.expr("CAST(size(events) AS BIGINT) AS event_count"),
        F.expr("CAST(size(invocations) + size(filter(events, e -> e.invocation < 0)) AS BIGINT) AS entry_count"),
        F.expr("coalesce(aggregate(duplicates, 0L, (n, d) -> n + d.count), 0L) AS duplicate_count"),
        per_rule(rules, lambda r: F.expr(_timed(r)).cast(calls_type) if r.stitches else F.expr(f"CAST(array() AS {calls_type})"), calls_type).alias("calls"),
    ).withColumn("output_id", output_id(F.col("rule_id"), F.col("key"), F.col("first_observed")))


def skewed(call: Column, incomplete_is_skew: bool = True) -> Column:
    """Whether an invocation gives a clock_skew anomaly: a negative duration, which incomplete ones (-1) have too."""
    negative = F.coalesce(call["duration_ms"] < 0, F.lit(False))
    return negative if incomplete_is_skew else negative & call["complete"]


def entries(figures: DataFrame) -> DataFrame:
    """The timeline of each flow: one row per invocation or event on its own, by earliest time observed, then order."""
    calls = F.transform("calls", lambda c: F.struct(c["first_observed"].alias("at"), c["ord"].alias("ord"), c.alias("call"), F.lit(None).cast("struct<observed:timestamp,raw:string,type:string,stamp:timestamp,invocation:int,role:string,ord:int>").alias("plain")))
    plain_call = "struct<stitch:string,groups:array<string>,ord:int,first_observed:timestamp,complete:boolean,duplicates:bigint,number:int,started_at:timestamp,ended_at:timestamp,duration_ms:bigint>"
    plains = F.transform(F.filter("events", lambda e: e["invocation"] < 0), lambda e: F.struct(e["observed"].alias("at"), e["ord"].alias("ord"), F.lit(None).cast(plain_call).alias("call"), e.alias("plain")))
    ordered = F.array_sort(F.concat(calls, plains), lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(a["ord"] - b["ord"]))
    keep = ["rule", "rule_id", "key", "flow_seq", "output_id"]
    rows = figures.select(*keep, "events", F.posexplode(ordered).alias("position", "entry"))
    members = F.filter("events", lambda e: e["invocation"] == F.col("entry.call.number"))
    return rows.select(
        *keep,
        "position",
        F.when(F.col("entry.call").isNotNull(), "stitched").otherwise("plain").alias("kind"),
        F.col("entry.call.stitch").alias("stitch"),
        F.col("entry.call.groups").alias("groups"),
        F.col("entry.call.complete").alias("complete"),
        F.col("entry.call.started_at").alias("started_at"),
        F.col("entry.call.ended_at").alias("ended_at"),
        F.col("entry.call.duration_ms").alias("duration_ms"),
        F.col("entry.call.duplicates").alias("duplicate_count"),
        F.map_from_entries(F.transform(members, lambda e: F.struct(e["role"], F.struct(e["type"].alias("type"), e["stamp"].alias("timestamp"), e["raw"].alias("event"))))).alias("members"),
        F.col("entry.plain.type").alias("type"),
        F.col("entry.plain.stamp").alias("timestamp"),
        F.col("entry.plain.raw").alias("event"),
    )


def promoted_text(rule: Rule, p: Promotion) -> Column:
    """The raw text that a promotion selects from a flow's events."""

    if p.source in ("first", "last"):
        at = "0" if p.source == "first" else "size(events) - 1"
        return F.expr(p.path.sql_of_text(f"get(events, {at}).raw"))
    if p.source:
        # the first event in the role decides, even if it has no such value
        return F.expr(p.path.sql_of_text(f"get(filter(events, e -> e.role = {literal(p.source)}), 0).raw"))
    return F.expr(f"get(filter(transform(events, e -> {p.path.sql_of_text('e.raw')}), w -> w IS NOT NULL), 0)")


def promoted(figures: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Flow rows with fields (a struct of all promoted names, typed) and promotion_failed (names and texts that aren't of
    their type)."""
    kinds = {p.name: p.type for r in rules for p in r.promotions}
    names = sorted(kinds)
    texts = {n: per_rule(rules, lambda r, n=n: next((promoted_text(r, p) for p in r.promotions if p.name == n), None), "string") for n in names}
    out = figures.select("*", *[t.alias(f"__text_{n}") for n, t in texts.items()])
    values = {n: coerced(F.col(f"__text_{n}"), kinds[n]).cast(SPARK_TYPES[kinds[n]]) for n in names}
    failed = [F.when(F.col(f"__text_{n}").isNotNull() & values[n].isNull(), F.struct(F.lit(n).alias("name"), F.col(f"__text_{n}").alias("text"), F.lit(kinds[n]).alias("type"))) for n in names]
    nothing = F.array().cast("array<struct<name:string,text:string,type:string>>")
    fields = F.struct(*[values[n].alias(n) for n in names]) if names else F.lit(None).cast("struct<none:string>")
    out = out.withColumn("fields", fields).withColumn("promotion_failed", F.filter(F.array(*failed), lambda f: f.isNotNull()) if names else nothing)
    return out.drop(*[f"__text_{n}" for n in names])


def anomalies(figures: DataFrame, incomplete_is_skew: bool = True) -> DataFrame:
    """One row per anomaly, of the fold and of negative durations; with promoted() rows also of failed promotions."""
    skews = F.transform(F.filter("calls", lambda c: skewed(c, incomplete_is_skew)), lambda c: F.struct(F.lit("clock_skew").alias("kind"), F.lit("invocation duration is negative").alias("detail"), F.col("finalized_at").alias("at")))
    parts = [F.col("anomalies"), skews]
    if "promotion_failed" in figures.columns:
        detail = lambda f: F.concat(F.lit('promoted field "'), f["name"], F.lit('" received "'), f["text"], F.lit('", which is not '), f["type"])
        parts.append(F.transform("promotion_failed", lambda f: F.struct(F.lit("promotion_failed").alias("kind"), detail(f).alias("detail"), F.col("finalized_at").alias("at"))))
    return figures.select("rule_id", "key", "flow_seq", "output_id", F.explode(F.concat(*parts)).alias("a")).select("rule_id", "key", "flow_seq", "output_id", "a.*")


def timestamp_of(rules: Sequence[Rule]) -> Column:
    """A document's @timestamp; null where no event has a readable stamp."""
    return per_rule(rules, lambda r: F.col("finalized_at") if r.output_timestamp == FINALIZED else F.col("ended_at") if r.output_timestamp == LAST else F.col("started_at"), "timestamp")


def documents(flows: DataFrame, rules: Sequence[Rule], incomplete_is_skew: bool = True, unique: bool = False) -> DataFrame:
    """output_id, index, created_at and document (JSON) of each flow; of equal ids the last one stays, unless ids are unique already (flows of which
    only the latest was kept).

    Role and group names are keys of the JSON objects of entries.
    """
    figures = promoted(with_figures(flows, rules), rules)
    at = timestamp_of(rules)
    dates = {p.name for r in rules for p in r.promotions if p.type == "date"}
    names = sorted({p.name for r in rules for p in r.promotions})
    fields = F.struct(*[(rfc3339(F.col(f"fields.`{n}`")) if n in dates else F.col(f"fields.`{n}`")).alias(n) for n in names]) if names else F.col("fields")

    def entry_json(e: Column) -> Column:
        return F.to_json(e)

    def group_map(rule: Rule, call: Column) -> Column:
        out = F.lit(None).cast("map<string,string>")
        for s in rule.stitches:
            names = F.array(*[F.lit(n) for n in s.group_fields]) if s.group_by else F.array().cast("array<string>")
            out = F.when(call["stitch"] == s.id, F.map_from_arrays(names, call["groups"])).otherwise(out)
        return out

    def stitched(call: Column) -> Column:
        group = per_rule(rules, lambda r: group_map(r, call), "map<string,string>")
        base = F.struct(group.alias("group"), call["complete"].alias("complete"), rfc3339(call["started_at"]).alias("started_at"), call["duration_ms"].alias("duration_ms"), rfc3339(call["ended_at"]).alias("ended_at"), call["duplicates"].alias("duplicate_count"))
        members = F.filter("events", lambda e: e["invocation"] == call["number"])
        roles = F.transform(members, lambda e: F.concat(F.to_json(F.struct(e["role"].alias("n"))).substr(F.lit(6), F.length(F.to_json(F.struct(e["role"].alias("n")))) - 6), F.lit(":"), plain_json(e)))
        return _joined_object(entry_json(base), roles)

    def plain_json(e: Column) -> Column:
        return _joined_object(F.to_json(F.struct(e["type"].alias("type"), rfc3339(e["stamp"]).alias("timestamp"))), F.array(F.concat(F.lit('"event":'), e["raw"])))

    calls = F.transform("calls", lambda c: F.struct(c["first_observed"].alias("at"), c["ord"].alias("ord"), stitched(c).alias("json")))
    plains = F.transform(F.filter("events", lambda e: e["invocation"] < 0), lambda e: F.struct(e["observed"].alias("at"), e["ord"].alias("ord"), plain_json(e).alias("json")))
    timeline = F.array_sort(F.concat(calls, plains), lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(a["ord"] - b["ord"]))
    skews = F.transform(F.filter("calls", lambda c: skewed(c, incomplete_is_skew)), lambda c: F.struct(F.lit("clock_skew").alias("kind"), F.lit("invocation duration is negative").alias("detail"), rfc3339(F.col("finalized_at")).alias("at")))
    failed = F.transform("promotion_failed", lambda f: F.struct(F.lit("promotion_failed").alias("kind"), F.concat(F.lit('promoted field "'), f["name"], F.lit('" received "'), f["text"], F.lit('", which is not '), f["type"]).alias("detail"), rfc3339(F.col("finalized_at")).alias("at")))
    noted = F.transform("anomalies", lambda a: F.struct(a["kind"], a["detail"], rfc3339(a["at"]).alias("at")))
    head = F.struct(
        rfc3339(at).alias("@timestamp"),
        F.struct(F.col("key").alias("id"), "rule_id", "rule_version", F.col("reason").alias("finalization_reason"), rfc3339(F.col("started_at")).alias("started_at"), rfc3339(F.col("ended_at")).alias("ended_at"), "duration_ms", "age_ms", "event_count", "entry_count", "duplicate_count", "incomplete_invocations", "duplicates").alias("flow"),
        fields.alias("fields"),
        F.concat(noted, skews, failed).alias("anomalies"),
    )
    events = F.concat(F.lit('"events":['), F.array_join(F.transform(timeline, lambda t: t["json"]), ","), F.lit("]"))
    index = per_rule(rules, lambda r: index_name(r.index, at, F.col("finalized_at")), "string")
    made = figures.select("output_id", index.alias("index"), F.col("finalized_at").alias("created_at"), "flow_seq", _joined_object(F.to_json(head), F.array(events)).alias("document"))
    if unique:
        return made.drop("flow_seq")
    # upsert by id: a later flow of the same first observation overwrites
    latest = made.groupBy("output_id").agg(F.max_by(F.struct("index", "created_at", "document"), F.struct("created_at", "flow_seq")).alias("d"))
    return latest.select("output_id", "d.index", "d.created_at", "d.document")


def _joined_object(head: Column, more: Column) -> Column:
    """A JSON object with further members, given as texts."""
    inner = head.substr(F.lit(2), F.length(head) - 2)
    parts = F.filter(F.concat(F.array(inner), more), lambda p: p != "")
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def reason_counts(flows: DataFrame) -> DataFrame:
    return flows.groupBy("reason").agg(F.count("*").alias("n"))
