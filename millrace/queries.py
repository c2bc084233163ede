"""Registered queries of the event engine, each with the SQL that gives the same rows.

Results are flat: texts, integers, doubles and booleans; times are microseconds since the epoch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.paths import compile_path
from millrace.functions.scalars import coerced, index_name, retry_delay_ms
from millrace.operators import delivery, metrics, views
from millrace.operators.flows import flows
from millrace.operators.route import pass_through, route, unmatched
from millrace.plans.rules import ALL_COMPLETE, Promotion, Role, Rule, Stitch
from millrace.sources.events import accept, accept_batch, as_events
from millrace.streaming import sinks

HOUR = 3_600_000_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query, with its SQL where there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p(expression: str):
    return compile_path(expression)


def us(c: str | Column) -> Column:
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


# ---------------------------------------------------------------- paths


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """Nested documents made of the events table."""
    e = table(spark, d, "events")
    item = lambda c: F.struct(c.alias("v"))
    made = as_events(
        e, F.col("ts"), F.col("event_id"),
        event_id=F.col("event_id"), context=F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("type")),
        items=F.array(item(_k()), item(F.col("event_id"))), payload=F.map_from_arrays(F.array(F.lit("http.status"), F.lit("0")), F.array(_k(), F.col("user_id"))),
        value=F.col("value"), flag=F.col("event_type") == "view",
    )
    return made


def _selected(name: str, expression: str, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _documents(spark, d).select(F.col("seq").alias("event_id"), p(expression).column().alias("selected"))

    run.__name__ = name
    query(f"SELECT event_id, {sql} AS selected FROM events")(run)


K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_selected("path_nested", "$.context.user", "CAST(user_id AS VARCHAR)")
_selected("path_index", "$.items[0].v", f"CAST({K} AS VARCHAR)")
_selected("path_neg_index", "$.items[-1].v", "CAST(event_id AS VARCHAR)")
_selected("path_quoted_key", '$.payload["http.status"]', f"CAST({K} AS VARCHAR)")
_selected("path_quoted_digits", '$.payload["0"]', "CAST(user_id AS VARCHAR)")
_selected("path_number_format", "$.value", r"CASE WHEN value IS NULL THEN NULL ELSE regexp_replace(CAST(value AS VARCHAR), '\.0$', '') END")
_selected("path_bool", "$.flag", "CASE WHEN event_type = 'view' THEN 'true' ELSE 'false' END")
_selected("path_absent", "$.missing.deeper", "CAST(NULL AS VARCHAR)")
_selected("path_object_is_none", "$.context", "CAST(NULL AS VARCHAR)")
_selected("path_index_out_of_range", "$.items[9].v", "CAST(NULL AS VARCHAR)")

# ---------------------------------------------------------------- rules over the events table

TIMEBOX = Rule("user-timebox", p("$.user"), 12 * HOUR, "flows-{yyyy}.{MM}.{dd}", event_type=p("$.event"), timestamp=p("$.datetime")).versioned()
CALL = Stitch("call", (p("$.g"),), (Role("request", ("view",)), Role("response", ("purchase",))), ("request", "response"))
CALLS = Rule(
    "user-calls", p("$.user"), 24 * HOUR, "calls-{yyyy}.{MM}.{dd}", event_type=p("$.event"), timestamp=p("$.datetime"), stitches=(CALL,),
    promotions=(Promotion("first_value", p("$.value"), "double", "first"), Promotion("kind", p("$.event"), "keyword", "last"), Promotion("response_k", p("$.k"), "long", "response"),
                Promotion("any_k", p("$.maybe"), "long"), Promotion("wrong", p("$.event"), "long", "first")),
    close_when=ALL_COMPLETE, terminal_events=("error",), max_events=6,
).versioned()
SETTLING = Rule("user-settle", p("$.user"), 24 * HOUR, "calls", event_type=p("$.event"), stitches=(CALL,), close_when=ALL_COMPLETE, settle_us=HOUR).versioned()


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Events as the rules above read them. Producers' clocks are behind by some hours, each event by its own."""
    e = table(spark, d, "events").withColumn("k", _k())
    behind = F.col("ts") - F.make_dt_interval(hours=(F.col("event_id") % 5 * 3).cast("int"))
    return as_events(
        e, F.col("ts"), F.col("event_id"),
        event_id=F.col("event_id"), user=F.col("user_id"), event=F.col("event_type"), k=F.col("k"), g=F.col("k") % 3, value=F.col("value"),
        maybe=F.when(F.col("k") % 2 == 0, F.col("k")), datetime=F.date_format(behind, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
    )


def _flows(spark: SparkSession, d: str, rule: Rule, with_raw: bool = False) -> DataFrame:
    return views.with_figures(flows(_events(spark, d), [rule], with_raw), [rule])


STAMP = "(ts - to_hours(CAST(event_id % 5 * 3 AS INTEGER)))"


def timebox_sql(hours: int) -> str:
    """Common table `b`: events with the time-box they are in."""
    return f"""WITH RECURSIVE e AS (SELECT *, {K} AS k, {STAMP} AS stamp, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
b AS (SELECT user_id, event_id, event_type, ts, stamp, k, n, ts AS start, 1 AS flow_seq FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.event_id, e.event_type, e.ts, e.stamp, e.k, e.n,
  CASE WHEN e.ts >= b.start + INTERVAL {hours} HOUR THEN e.ts ELSE b.start END, b.flow_seq + CASE WHEN e.ts >= b.start + INTERVAL {hours} HOUR THEN 1 ELSE 0 END
  FROM b JOIN e ON e.user_id = b.user_id AND e.n = b.n + 1) """


#: Common table `r`: events with flow, status and the reason that closes the flow at this event.
CALLS_SQL = f"""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, ts, {STAMP} AS stamp, {K} AS k, {K} % 3 AS g, value,
  CASE event_type WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END AS bit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (
SELECT user_id, event_id, event_type, ts, stamp, k, g, value, bit, rn, ts AS start, 1 AS flow_seq, 1 AS n,
  CASE WHEN g = 0 THEN bit ELSE 0 END AS s0, CASE WHEN g = 1 THEN bit ELSE 0 END AS s1, CASE WHEN g = 2 THEN bit ELSE 0 END AS s2,
  CASE WHEN bit = 0 THEN 'plain' ELSE 'member' END AS status, CASE WHEN event_type = 'error' THEN 'terminal_event' END AS reason
FROM e WHERE rn = 1
UNION ALL
SELECT user_id, event_id, event_type, ts, stamp, k, g, value, bit, rn, start, flow_seq, n, s0, s1, s2, status,
  CASE WHEN event_type = 'error' THEN 'terminal_event' WHEN n >= 6 THEN 'limit_exceeded'
    WHEN (s0 = 3 OR s1 = 3 OR s2 = 3) AND s0 NOT IN (1, 2) AND s1 NOT IN (1, 2) AND s2 NOT IN (1, 2) THEN 'invocations_complete' END AS reason
FROM (SELECT user_id, event_id, event_type, ts, stamp, k, g, value, bit, rn, start, flow_seq, n,
    CASE WHEN g = 0 THEN p0 | bit ELSE p0 END AS s0, CASE WHEN g = 1 THEN p1 | bit ELSE p1 END AS s1, CASE WHEN g = 2 THEN p2 | bit ELSE p2 END AS s2,
    CASE WHEN bit = 0 THEN 'plain' WHEN (CASE g WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END) & bit > 0 THEN 'cardinality' ELSE 'member' END AS status
  FROM (SELECT e.*, CASE WHEN fresh THEN e.ts ELSE start0 END AS start, seq0 + CASE WHEN fresh THEN 1 ELSE 0 END AS flow_seq, CASE WHEN fresh THEN 1 ELSE n0 + 1 END AS n,
      CASE WHEN fresh THEN 0 ELSE q0 END AS p0, CASE WHEN fresh THEN 0 ELSE q1 END AS p1, CASE WHEN fresh THEN 0 ELSE q2 END AS p2
    FROM (SELECT user_id AS u0, rn AS rn0, start AS start0, flow_seq AS seq0, n AS n0, s0 AS q0, s1 AS q1, s2 AS q2, reason AS reason0 FROM r) prev
    JOIN (SELECT * FROM e) e ON e.user_id = prev.u0 AND e.rn = prev.rn0 + 1,
    LATERAL (SELECT (prev.reason0 IS NOT NULL OR e.ts >= prev.start0 + INTERVAL 24 HOUR) AS fresh) f) y) z),
f AS (SELECT user_id, flow_seq, min(start) AS first_observed, count(*) AS event_count, coalesce(max(reason), 'timeout') AS reason,
  CASE WHEN max(reason) IS NULL THEN min(start) + INTERVAL 24 HOUR ELSE max(ts) END AS finalized_at, min(stamp) AS started_at, max(stamp) AS ended_at FROM r GROUP BY ALL),
c AS (SELECT user_id, flow_seq, g, bool_or(bit = 1) AND bool_or(bit = 2) AS complete, min(ts) AS first_observed, min(stamp) FILTER (bit = 1) AS asked, min(stamp) FILTER (bit = 2) AS answered
  FROM r WHERE status = 'member' GROUP BY ALL) """
KEY = "CAST(user_id AS VARCHAR) AS key"


@query(timebox_sql(12) + f"SELECT {KEY}, flow_seq, 'timeout' AS reason, count(*) AS event_count, epoch_us(min(start)) AS first_observed_us, epoch_us(min(start)) + 12 * 3600000000 AS finalized_us FROM b GROUP BY user_id, flow_seq")
def flow_timebox(spark: SparkSession, d: str) -> DataFrame:
    return _flows(spark, d, TIMEBOX).select("key", "flow_seq", "reason", "event_count", us("first_observed").alias("first_observed_us"), us("finalized_at").alias("finalized_us"))


@query(
    CALLS_SQL
    + f"""SELECT {KEY}, flow_seq, reason, event_count, epoch_us(first_observed) AS first_observed_us, epoch_us(finalized_at) AS finalized_us,
  coalesce((SELECT count(*) FROM c WHERE c.user_id = f.user_id AND c.flow_seq = f.flow_seq AND complete), 0) AS complete_invocations,
  coalesce((SELECT count(*) FROM c WHERE c.user_id = f.user_id AND c.flow_seq = f.flow_seq AND NOT complete), 0) AS incomplete_invocations,
  coalesce((SELECT count(*) FROM c WHERE c.user_id = f.user_id AND c.flow_seq = f.flow_seq), 0) + (SELECT count(*) FROM r WHERE r.user_id = f.user_id AND r.flow_seq = f.flow_seq AND status <> 'member') AS entry_count FROM f"""
)
def flow_complete(spark: SparkSession, d: str) -> DataFrame:
    return _flows(spark, d, CALLS).select("key", "flow_seq", "reason", "event_count", us("first_observed").alias("first_observed_us"), us("finalized_at").alias("finalized_us"), "complete_invocations", "incomplete_invocations", "entry_count")


@query(CALLS_SQL + "SELECT reason, count(*) AS n FROM f GROUP BY reason")
def flow_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    return views.reason_counts(flows(_events(spark, d), [CALLS], with_raw=False))


@query(CALLS_SQL + f"SELECT {KEY}, flow_seq, event_id, CASE WHEN status = 'member' THEN CASE bit WHEN 1 THEN 'request' ELSE 'response' END END AS role FROM r")
def flow_assign_events(spark: SparkSession, d: str) -> DataFrame:
    events = flows(_events(spark, d), [CALLS]).select("key", "flow_seq", F.explode("events").alias("e"))
    return events.select("key", "flow_seq", F.get_json_object("e.raw", "$.event_id").cast("bigint").alias("event_id"), "e.role")


@query(CALLS_SQL + f"SELECT {KEY}, flow_seq, CAST(g AS VARCHAR) AS g, CAST(trunc((epoch_us(answered) - epoch_us(asked)) / 1000) AS BIGINT) AS duration_ms FROM c WHERE complete")
def stitch_pairs(spark: SparkSession, d: str) -> DataFrame:
    done = views.entries(_flows(spark, d, CALLS)).where("complete")
    return done.select("key", "flow_seq", F.get("groups", F.lit(0)).alias("g"), "duration_ms")


@query(CALLS_SQL + f"SELECT {KEY}, flow_seq, CAST(g AS VARCHAR) AS g, CAST(-1 AS BIGINT) AS duration_ms, asked IS NOT NULL AS has_request FROM c WHERE NOT complete")
def stitch_incomplete(spark: SparkSession, d: str) -> DataFrame:
    half = views.entries(_flows(spark, d, CALLS)).where("not complete")
    return half.select("key", "flow_seq", F.get("groups", F.lit(0)).alias("g"), "duration_ms", F.map_contains_key("members", F.lit("request")).alias("has_request"))


@query(CALLS_SQL + f"SELECT {KEY}, flow_seq, count(*) AS n FROM r WHERE status = 'cardinality' GROUP BY user_id, flow_seq")
def stitch_cardinality(spark: SparkSession, d: str) -> DataFrame:
    return views.anomalies(_flows(spark, d, CALLS)).where("kind = 'cardinality_exceeded'").groupBy("key", "flow_seq").agg(F.count("*").alias("n"))


@query(CALLS_SQL + f"SELECT {KEY}, flow_seq, count(*) AS n FROM c WHERE NOT complete OR answered < asked GROUP BY user_id, flow_seq")
def clock_skew_anomalies(spark: SparkSession, d: str) -> DataFrame:
    return views.anomalies(_flows(spark, d, CALLS)).where("kind = 'clock_skew'").groupBy("key", "flow_seq").agg(F.count("*").alias("n"))


@query(
    CALLS_SQL
    + f"""SELECT {KEY}, flow_seq, epoch_us(started_at) AS started_us, epoch_us(ended_at) AS ended_us, (epoch_us(ended_at) - epoch_us(started_at)) // 1000 AS duration_ms,
  (epoch_us(finalized_at) - epoch_us(first_observed)) // 1000 AS age_ms FROM f"""
)
def flow_meta(spark: SparkSession, d: str) -> DataFrame:
    return _flows(spark, d, CALLS).select("key", "flow_seq", us("started_at").alias("started_us"), us("ended_at").alias("ended_us"), "duration_ms", "age_ms")


@query(
    CALLS_SQL
    + f""", t AS (SELECT user_id, flow_seq, first_observed AS t0, 'stitched' AS kind, CAST(g AS VARCHAR) AS what FROM c
  UNION ALL SELECT user_id, flow_seq, ts, 'plain', event_type FROM r WHERE status <> 'member')
SELECT {KEY}, flow_seq, row_number() OVER (PARTITION BY user_id, flow_seq ORDER BY t0) - 1 AS position, kind, what FROM t"""
)
def entry_timeline(spark: SparkSession, d: str) -> DataFrame:
    return views.entries(_flows(spark, d, CALLS)).select("key", "flow_seq", F.col("position").cast("bigint").alias("position"), "kind", F.coalesce(F.get("groups", F.lit(0)), "type").alias("what"))


def _promoted(spark: SparkSession, d: str, name: str) -> DataFrame:
    return views.promoted(_flows(spark, d, CALLS, with_raw=True), [CALLS]).select("key", "flow_seq", F.col(f"fields.{name}").alias(name))


@query(CALLS_SQL + f"SELECT {KEY}, flow_seq, arg_min(value, rn) AS first_value FROM r GROUP BY user_id, flow_seq")
def promote_first(spark: SparkSession, d: str) -> DataFrame:
    return _promoted(spark, d, "first_value")


@query(CALLS_SQL + f"SELECT {KEY}, flow_seq, arg_max(event_type, rn) AS kind FROM r GROUP BY user_id, flow_seq")
def promote_last(spark: SparkSession, d: str) -> DataFrame:
    return _promoted(spark, d, "kind")


@query(CALLS_SQL + f"SELECT {KEY}, flow_seq, arg_min(k, rn) FILTER (status = 'member' AND bit = 2) AS response_k FROM r GROUP BY user_id, flow_seq")
def promote_role(spark: SparkSession, d: str) -> DataFrame:
    return _promoted(spark, d, "response_k")


@query(CALLS_SQL + f"SELECT {KEY}, flow_seq, arg_min(k, rn) FILTER (k % 2 = 0) AS any_k FROM r GROUP BY user_id, flow_seq")
def promote_default(spark: SparkSession, d: str) -> DataFrame:
    return _promoted(spark, d, "any_k")


@query(CALLS_SQL + f"""SELECT {KEY}, flow_seq, 'promoted field "wrong" received "' || arg_min(event_type, rn) || '", which is not long' AS detail FROM r GROUP BY user_id, flow_seq""")
def promotion_failed(spark: SparkSession, d: str) -> DataFrame:
    found = views.anomalies(views.promoted(_flows(spark, d, CALLS, with_raw=True), [CALLS]))
    return found.where("kind = 'promotion_failed'").select("key", "flow_seq", "detail")


RFC = r"regexp_replace(regexp_replace(strftime(first_observed, '%Y-%m-%dT%H:%M:%S.%f'), '0+$', ''), '\.$', '') || 'Z'"


@query(CALLS_SQL + f"SELECT {KEY}, flow_seq, sha256('user-calls:' || user_id || ':' || {RFC}) AS output_id FROM f")
def output_ids(spark: SparkSession, d: str) -> DataFrame:
    return _flows(spark, d, CALLS).select("key", "flow_seq", "output_id")


@query(CALLS_SQL + "SELECT 'calls-' || strftime(started_at, '%Y.%m.%d') AS index, count(*) AS n FROM f GROUP BY ALL")
def index_daily(spark: SparkSession, d: str) -> DataFrame:
    figures = _flows(spark, d, CALLS)
    return figures.select(index_name(CALLS.index, views.timestamp_of([CALLS]), F.col("finalized_at")).alias("index")).groupBy("index").agg(F.count("*").alias("n"))


@query(
    CALLS_SQL
    + f""", t AS (SELECT user_id, flow_seq, first_observed AS t0, 'stitched:' || g AS what FROM c
  UNION ALL SELECT user_id, flow_seq, ts, 'plain:' || event_type FROM r WHERE status <> 'member'),
line AS (SELECT user_id, flow_seq, string_agg(what, ',' ORDER BY t0) AS timeline, count(*) AS entry_count FROM t GROUP BY ALL),
o AS (SELECT user_id, flow_seq, count(*) AS n FROM r WHERE status = 'cardinality' GROUP BY ALL),
i AS (SELECT user_id, flow_seq, count(*) AS n FROM c WHERE NOT complete GROUP BY ALL)
SELECT sha256('user-calls:' || f.user_id || ':' || {RFC}) AS output_id, 'calls-' || strftime(started_at, '%Y.%m.%d') AS index, epoch_us(finalized_at) AS created_us, CAST(f.user_id AS VARCHAR) AS key, reason, event_count,
  epoch_us(started_at) AS started_us, epoch_us(ended_at) AS ended_us, (epoch_us(ended_at) - epoch_us(started_at)) // 1000 AS duration_ms, (epoch_us(finalized_at) - epoch_us(first_observed)) // 1000 AS age_ms,
  entry_count, timeline, coalesce(o.n, 0) AS cardinality_exceeded, coalesce(i.n, 0) AS incomplete_invocations
FROM f LEFT JOIN line ON f.user_id = line.user_id AND f.flow_seq = line.flow_seq LEFT JOIN o ON f.user_id = o.user_id AND f.flow_seq = o.flow_seq LEFT JOIN i ON f.user_id = i.user_id AND f.flow_seq = i.flow_seq"""
)
def document_json(spark: SparkSession, d: str) -> DataFrame:
    """Documents, read again from their JSON."""
    docs = views.documents(flows(_events(spark, d), [CALLS], latest=True), [CALLS], unique=True)
    schema = """struct<flow:struct<id:string,finalization_reason:string,started_at:timestamp,ended_at:timestamp,duration_ms:bigint,age_ms:bigint,event_count:bigint,entry_count:bigint,incomplete_invocations:bigint>,
      events:array<struct<group:map<string,string>,type:string>>,anomalies:array<struct<kind:string>>>"""
    read = docs.withColumn("d", F.from_json("document", schema)).select("output_id", "index", us("created_at").alias("created_us"), "d.flow.*", "d.events", "d.anomalies")
    return read.select(
        "output_id", "index", "created_us", F.col("id").alias("key"), F.col("finalization_reason").alias("reason"), "event_count", us("started_at").alias("started_us"), us("ended_at").alias("ended_us"), "duration_ms", "age_ms", "entry_count",
        F.expr("array_join(transform(events, e -> CASE WHEN e.group IS NULL THEN 'plain:' || e.type ELSE 'stitched:' || map_values(e.group)[0] END), ',') AS timeline"),
        F.expr("CAST(size(filter(anomalies, a -> a.kind = 'cardinality_exceeded')) AS BIGINT) AS cardinality_exceeded"), "incomplete_invocations",
    )


@query(CALLS_SQL + f"SELECT sha256('user-calls:' || user_id || ':' || {RFC}) AS output_id, {KEY}, reason, event_count FROM f")
def document_fields(spark: SparkSession, d: str) -> DataFrame:
    docs = views.documents(flows(_events(spark, d), [CALLS], latest=True), [CALLS], unique=True)
    get = lambda path: F.get_json_object("document", path)
    return docs.select("output_id", get("$.flow.id").alias("key"), get("$.flow.finalization_reason").alias("reason"), get("$.flow.event_count").cast("bigint").alias("event_count"))


@query(
    f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT {KEY}, (n - 1) // 5 + 1 AS flow_seq, CASE WHEN count(*) = 5 THEN 'limit_exceeded' ELSE 'timeout' END AS reason, count(*) AS event_count FROM e GROUP BY user_id, (n - 1) // 5"""
)
def flow_max_events(spark: SparkSession, d: str) -> DataFrame:
    rule = Rule("sharded", p("$.user"), 100_000 * HOUR, "x", event_type=p("$.event"), max_events=5)
    return _flows(spark, d, rule).select("key", "flow_seq", "reason", "event_count")


@query(
    f"""WITH e AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events)
SELECT {KEY}, CAST(before AS BIGINT) + 1 AS flow_seq, CASE WHEN bool_or(event_type = 'error') THEN 'terminal_event' ELSE 'timeout' END AS reason, count(*) AS event_count FROM e GROUP BY user_id, before"""
)
def flow_terminal(spark: SparkSession, d: str) -> DataFrame:
    rule = Rule("until-error", p("$.user"), 100_000 * HOUR, "x", event_type=p("$.event"), terminal_events=("error",))
    return _flows(spark, d, rule).select("key", F.col("flow_seq").cast("bigint").alias("flow_seq"), "reason", "event_count")


def _small(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return as_events(e, F.col("ts"), F.col("event_id"), event=F.col("event_type"), user=F.col("user_id"))


#: Bytes of {"event":"...","user":...}
SIZE = "(length(event_type) + length(CAST(user_id AS VARCHAR)) + 20)"


@query(
    f"""WITH e AS (SELECT *, {SIZE} > 30 AS big FROM events), s AS (SELECT *, coalesce(sum(CASE WHEN big THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e)
SELECT {KEY}, CAST(before AS BIGINT) + 1 AS flow_seq, CASE WHEN bool_or(big) THEN 'limit_exceeded' ELSE 'timeout' END AS reason, count(*) AS event_count FROM s GROUP BY user_id, before"""
)
def flow_max_event_bytes(spark: SparkSession, d: str) -> DataFrame:
    rule = Rule("big", p("$.user"), 100_000 * HOUR, "x", event_type=p("$.event"), max_event_bytes=30)
    return views.with_figures(flows(_small(spark, d), [rule]), [rule]).select("key", "flow_seq", "reason", "event_count")


@query(
    f"""WITH RECURSIVE e AS (SELECT user_id, {SIZE} AS size, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
b AS (SELECT user_id, n, size AS total, 1 AS flow_seq FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.n, CASE WHEN b.total > 200 THEN 0 ELSE b.total END + e.size, b.flow_seq + CASE WHEN b.total > 200 THEN 1 ELSE 0 END FROM b JOIN e ON e.user_id = b.user_id AND e.n = b.n + 1)
SELECT {KEY}, flow_seq, CASE WHEN max(total) > 200 THEN 'limit_exceeded' ELSE 'timeout' END AS reason, count(*) AS event_count FROM b GROUP BY user_id, flow_seq"""
)
def flow_max_flow_bytes(spark: SparkSession, d: str) -> DataFrame:
    rule = Rule("heavy", p("$.user"), 100_000 * HOUR, "x", event_type=p("$.event"), max_flow_bytes=200)
    return views.with_figures(flows(_small(spark, d), [rule]), [rule]).select("key", "flow_seq", "reason", "event_count")


DONE = "(s0 = 3 OR s1 = 3 OR s2 = 3) AND s0 NOT IN (1, 2) AND s1 NOT IN (1, 2) AND s2 NOT IN (1, 2)"


@query(
    f"""WITH RECURSIVE e AS (SELECT user_id, ts, {K} % 3 AS g, CASE event_type WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END AS bit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (
SELECT user_id, ts, rn, ts AS start, 1 AS flow_seq, CASE WHEN g = 0 THEN bit ELSE 0 END AS s0, CASE WHEN g = 1 THEN bit ELSE 0 END AS s1, CASE WHEN g = 2 THEN bit ELSE 0 END AS s2, CAST(NULL AS TIMESTAMP) AS settle, FALSE AS closed FROM e WHERE rn = 1
UNION ALL
SELECT user_id, ts, rn, start, flow_seq, s0, s1, s2, CASE WHEN NOT ({DONE}) THEN NULL WHEN settle IS NULL THEN ts + INTERVAL 1 HOUR ELSE settle END, FALSE FROM (
  SELECT e.user_id, e.ts, e.rn, CASE WHEN fresh THEN e.ts ELSE start0 END AS start, seq0 + CASE WHEN fresh THEN 1 ELSE 0 END AS flow_seq, CASE WHEN fresh THEN NULL ELSE settle0 END AS settle,
    CASE WHEN fresh THEN 0 ELSE q0 END | CASE WHEN g = 0 THEN bit ELSE 0 END AS s0, CASE WHEN fresh THEN 0 ELSE q1 END | CASE WHEN g = 1 THEN bit ELSE 0 END AS s1, CASE WHEN fresh THEN 0 ELSE q2 END | CASE WHEN g = 2 THEN bit ELSE 0 END AS s2
  FROM (SELECT user_id AS u0, rn AS rn0, start AS start0, flow_seq AS seq0, s0 AS q0, s1 AS q1, s2 AS q2, settle AS settle0 FROM r) prev JOIN (SELECT * FROM e) e ON e.user_id = prev.u0 AND e.rn = prev.rn0 + 1,
  LATERAL (SELECT e.ts >= least(prev.start0 + INTERVAL 24 HOUR, coalesce(prev.settle0, prev.start0 + INTERVAL 24 HOUR)) AS fresh) f) z)
SELECT {KEY}, flow_seq, count(*) AS event_count, CASE WHEN arg_max(settle, rn) <= min(start) + INTERVAL 24 HOUR THEN 'invocations_complete' ELSE 'timeout' END AS reason,
  epoch_us(least(min(start) + INTERVAL 24 HOUR, coalesce(arg_max_null(settle, rn), min(start) + INTERVAL 24 HOUR))) AS finalized_us FROM r GROUP BY user_id, flow_seq""".replace("arg_max(settle, rn) <=", "arg_max_null(settle, rn) <=")
)
def flow_settle(spark: SparkSession, d: str) -> DataFrame:
    return _flows(spark, d, SETTLING).select("key", "flow_seq", "event_count", "reason", us("finalized_at").alias("finalized_us"))


def _twice(spark: SparkSession, d: str) -> DataFrame:
    """Each event comes two times, with the same document."""
    e = _events(spark, d)
    return e.unionByName(e)


@query(timebox_sql(12) + f"SELECT {KEY}, flow_seq, event_type AS type, count(*) AS n FROM b GROUP BY user_id, flow_seq, event_type")
def flow_duplicates_by_type(spark: SparkSession, d: str) -> DataFrame:
    kinds = ("view", "click", "purchase", "signup", "error")
    stitch = Stitch("each", (p("$.event_id"),), tuple(Role(k, (k,)) for k in kinds), kinds)
    rule = Rule("twice", p("$.user"), 12 * HOUR, "x", event_type=p("$.event"), stitches=(stitch,))
    return flows(_twice(spark, d), [rule]).select("key", "flow_seq", F.explode("duplicates").alias("t")).select("key", "flow_seq", "t.type", F.col("t.count").alias("n"))


@query(timebox_sql(12) + f"SELECT {KEY}, flow_seq, 2 * count(*) AS event_count, CAST(0 AS BIGINT) AS duplicate_count FROM b GROUP BY user_id, flow_seq")
def plain_not_deduped(spark: SparkSession, d: str) -> DataFrame:
    return views.with_figures(flows(_twice(spark, d), [TIMEBOX]), [TIMEBOX]).select("key", "flow_seq", "event_count", "duplicate_count")


@query(
    """WITH t AS (SELECT conv_id, turn, turn // 2 AS pair, role FROM conversations WHERE role IN ('user', 'assistant')),
s AS (SELECT conv_id, pair, count(DISTINCT role) = 2 AS complete FROM t GROUP BY conv_id, pair)
SELECT CAST(conv_id AS VARCHAR) AS key, CAST(pair AS VARCHAR) AS pair, complete FROM s"""
)
def conversations_turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").where("role in ('user', 'assistant')")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn"))
    e = as_events(c, at, F.col("turn"), conv=F.col("conv_id"), role=F.col("role"), pair=F.floor(F.col("turn") / 2), turn=F.col("turn"))
    stitch = Stitch("turns", (p("$.pair"),), (Role("question", ("user",)), Role("answer", ("assistant",))))
    rule = Rule("dialogue", p("$.conv"), HOUR, "x", event_type=p("$.role"), stitches=(stitch,))
    found = views.entries(views.with_figures(flows(e, [rule]), [rule])).where("kind = 'stitched'")
    return found.select("key", F.get("groups", F.lit(0)).alias("pair"), "complete")


@query(
    """WITH l AS (SELECT l_orderkey, l_shipdate, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity) AS n, l_quantity FROM lineitem)
SELECT CAST(l_orderkey AS VARCHAR) AS key, (n - 1) // 3 + 1 AS flow_seq, count(*) AS event_count, arg_min(l_quantity, n) AS first_quantity FROM l GROUP BY l_orderkey, (n - 1) // 3"""
)
def order_shards(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    # a line's number, part, supplier and quantity in one integer: 4, 27, 24 and 8 bits, so that no two lines of a day tie
    place = ((F.col("l_linenumber").cast("bigint") * (1 << 27) + F.col("l_partkey")) * (1 << 24) + F.col("l_suppkey")) * (1 << 8) + F.col("l_quantity").cast("bigint")
    e = as_events(line, F.col("l_shipdate"), place, order=F.col("l_orderkey"), status=F.col("l_linestatus"), quantity=F.col("l_quantity"))
    rule = Rule("shards", p("$.order"), 100_000 * HOUR, "x", event_type=p("$.status"), max_events=3, promotions=(Promotion("first_quantity", p("$.quantity"), "double", "first"),))
    made = views.promoted(views.with_figures(flows(e, [rule]), [rule]), [rule])
    return made.select("key", "flow_seq", "event_count", F.col("fields.first_quantity").alias("first_quantity"))


# ---------------------------------------------------------------- routing and sources

BY_ORDER = Rule("purchases", p("$.order"), HOUR, "x", event_type=p("$.event"))
BY_USER = Rule("users", p("$.user"), HOUR, "y", event_type=p("$.event"))


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    """Purchases have an order; clicks an empty one; signups neither order nor user."""
    e = table(spark, d, "events")
    kind = F.col("event_type")
    order = F.when(kind == "purchase", F.concat(F.lit("o"), F.col("event_id"))).when(kind == "click", F.lit(""))
    stamp = F.when(kind == "signup", F.when(F.col("event_id") % 2 == 0, F.date_format(F.col("ts") - F.expr("interval 40 days"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("no date"))
    return as_events(e, F.col("ts"), F.col("event_id"), event=kind, order=order, user=F.when(kind != "signup", F.col("user_id")), datetime=stamp)


def _routes(spark: SparkSession, d: str, rules: list[Rule]) -> DataFrame:
    routed = route(_mixed(spark, d), rules)
    return routed.select(F.col("seq").alias("event_id"), views.per_rule(rules, lambda r: F.lit(r.id), "string").alias("rule_id"), F.col("key"))


@query("SELECT event_id, CASE event_type WHEN 'purchase' THEN 'purchases' WHEN 'signup' THEN NULL ELSE 'users' END AS rule_id, CASE event_type WHEN 'purchase' THEN 'o' || event_id WHEN 'signup' THEN NULL ELSE CAST(user_id AS VARCHAR) END AS key FROM events")
def route_first_rule(spark: SparkSession, d: str) -> DataFrame:
    return _routes(spark, d, [BY_ORDER, BY_USER])


@query("SELECT event_id, CASE WHEN event_type <> 'signup' THEN 'users' END AS rule_id, CASE WHEN event_type <> 'signup' THEN CAST(user_id AS VARCHAR) END AS key FROM events")
def route_disabled_rule(spark: SparkSession, d: str) -> DataFrame:
    return _routes(spark, d, [Rule("purchases", p("$.order"), HOUR, "x", enabled=False), BY_USER])


@query("SELECT event_id, 'users' AS rule_id, CAST(user_id AS VARCHAR) AS key FROM events WHERE event_type = 'click'")
def route_empty_key_falls_through(spark: SparkSession, d: str) -> DataFrame:
    return _routes(spark, d, [BY_ORDER, BY_USER]).join(table(spark, d, "events").where("event_type = 'click'").select("event_id"), "event_id", "left_semi")


@query("SELECT event_id FROM events WHERE event_type = 'signup'")
def passthrough_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return unmatched(route(_mixed(spark, d), [BY_ORDER, BY_USER])).select(F.col("seq").alias("event_id"))


@query("SELECT event_id, 'logs-' || strftime(CASE WHEN event_id % 2 = 0 THEN ts - INTERVAL 40 DAY ELSE ts END, '%Y.%m.%d') AS index FROM events WHERE event_type = 'signup'")
def passthrough_index_date(spark: SparkSession, d: str) -> DataFrame:
    out = pass_through(route(_mixed(spark, d), [BY_ORDER, BY_USER]), "logs-{yyyy}.{MM}.{dd}", "$.datetime")
    return out.select(F.col("seq").alias("event_id"), "index")


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'too large' ELSE 'malformed json' END AS reason FROM events WHERE event_id % 5 < 4")
def reject_malformed(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    bad = F.array(F.concat(F.lit('{"a":"'), F.repeat(F.lit("x"), 100), F.lit('"}')), F.lit("[1]"), F.lit("{oops"), F.lit("null"), F.col("props"))
    rows = e.select(F.get(bad, (F.col("event_id") % 5).cast("int")).alias("raw"), F.col("ts").cast("timestamp").alias("observed_at"), F.col("event_id").alias("seq"))
    return accept(rows, max_bytes=64).rejected.select(F.col("seq").alias("event_id"), "reason")


@query("SELECT event_id, event_id * 1048576 + i AS seq, CAST(user_id AS VARCHAR) AS user FROM events, (SELECT unnest(range(3)) AS i) WHERE i = 0 OR event_id % 3 = 0")
def batch_source(spark: SparkSession, d: str) -> DataFrame:
    """Arrays of events; in two of three the second element is malformed and ends the array."""
    e = table(spark, d, "events")
    one = F.to_json(F.struct("event_id", F.col("user_id").alias("user")))
    second = F.when(F.col("event_id") % 3 == 0, one).otherwise(F.lit("7"))
    rows = e.select(F.concat(F.lit("["), one, F.lit(","), second, F.lit(","), one, F.lit("]")).alias("body"), F.col("ts").cast("timestamp").alias("observed_at"), "event_id")
    got = accept_batch(rows, number="event_id").events
    return got.select(p("$.event_id").column().cast("bigint").alias("event_id"), "seq", p("$.user").column().alias("user"))


def _coerce(name: str, kind: str, texts: tuple[str, ...], sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        value = coerced(_pick(*texts), kind)
        return table(spark, d, "events").select("event_id", (us(value) if kind == "date" else value).alias("coerced"))

    run.__name__ = name
    query(f"SELECT event_id, {sql} AS coerced FROM events")(run)


def _pick(*texts: str) -> Column:
    """One of the texts or the event's number, in turn."""
    return F.get(F.array(*[F.lit(t) for t in texts], F.col("event_id").cast("string")), (F.col("event_id") % (len(texts) + 1)).cast("int"))


_coerce("coerce_long", "long", ("12", " 5 ", "+7", "1.0", "99999999999999999999", ""), "CASE event_id % 7 WHEN 0 THEN 12 WHEN 2 THEN 7 WHEN 6 THEN event_id END")
_coerce("coerce_double", "double", ("1.5", "1e3", "NaN", "Infinity", "1e999", "x"), "CASE event_id % 7 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1000::DOUBLE WHEN 6 THEN event_id::DOUBLE END")
_coerce("coerce_bool", "boolean", ("t", "F", "yes", "TRUE", "0"), "CASE event_id % 6 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 3 THEN TRUE WHEN 4 THEN FALSE WHEN 5 THEN (CASE event_id WHEN 0 THEN FALSE WHEN 1 THEN TRUE END) END")
_coerce("coerce_date", "date", ("2026-08-21T00:30:00+02:00", "2026-08-21", "2026-08-21T00:30:00.5Z"), "CASE event_id % 4 WHEN 0 THEN 1787265000000000 WHEN 2 THEN 1787272200500000 END")

# ---------------------------------------------------------------- delivery


def _outbox(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.sha2(F.col("event_id").cast("string"), 256).alias("output_id"), F.concat(F.lit("flows-"), "event_type").alias("index"), F.col("props").alias("document"), F.col("ts").cast("timestamp").alias("created_at"),
        (F.col("event_id") % 10).cast("int").alias("attempts"), F.lit(0).alias("replay_count"), F.lit(None).cast("string").alias("last_error"), F.lit(None).cast("string").alias("rejection_type"),
        F.when(F.col("event_id") % 4 == 0, F.lit(None)).otherwise((F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 7).cast("int"))).cast("timestamp")).alias("next_attempt_at"),
        "event_id",
    )


def _dead(spark: SparkSession, d: str) -> DataFrame:
    kind = F.get(F.array(F.lit("mapper_parsing_exception"), F.lit("retry_limit_exceeded"), F.lit("")), (F.col("event_id") % 3).cast("int"))
    return _outbox(spark, d).withColumn("rejection_type", kind).withColumn("dead_lettered_at", F.col("created_at") + F.expr("interval 1 hour"))


MIDDLE = "(SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events)"


@query(f"SELECT sha256(CAST(event_id AS VARCHAR)) AS output_id, epoch_us(ts) AS created_us FROM events WHERE event_id % 4 = 0 OR ts + to_hours(CAST(event_id % 7 AS INTEGER)) <= {MIDDLE} ORDER BY ts, sha256(CAST(event_id AS VARCHAR)) LIMIT 64")
def outbox_pending_topk(spark: SparkSession, d: str) -> DataFrame:
    box = _outbox(spark, d)
    now = F.timestamp_micros(F.lit(box.agg(F.expr("min(unix_micros(created_at)) + (max(unix_micros(created_at)) - min(unix_micros(created_at))) div 2")).first()[0]))
    return delivery.pending(box, now, 64).select("output_id", us("created_at").alias("created_us"))


STATUS = "CASE event_id % 9 WHEN 0 THEN 200 WHEN 1 THEN 201 WHEN 2 THEN 429 WHEN 3 THEN 503 WHEN 4 THEN 408 WHEN 5 THEN 500 WHEN 6 THEN 400 WHEN 7 THEN 403 ELSE 302 END"


@query(f"SELECT event_id, CASE WHEN event_id % 9 = 7 AND event_id % 2 = 0 THEN 'retryable' WHEN {STATUS} BETWEEN 200 AND 299 THEN 'delivered' WHEN {STATUS} IN (400, 403) THEN 'permanent' ELSE 'retryable' END AS disposition FROM events")
def classify_status(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("status", F.expr(STATUS))
    error = F.when((F.col("status") == 403) & (F.col("event_id") % 2 == 0), "cluster_block_exception")
    return e.select("event_id", delivery.classified(F.col("status"), error).alias("disposition"))


@query(
    """WITH a AS (SELECT sha256(CAST(event_id AS VARCHAR)) AS id, event_id % 12 + 1 AS attempt, event_id FROM events),
h AS (SELECT *, CAST('0x' || substr(sha256(id || ':' || attempt), 1, 4) AS INTEGER) / 65535.0::DOUBLE AS x, CAST('0x' || substr(sha256(id || ':cap'), 1, 4) AS INTEGER) / 65535.0::DOUBLE AS y FROM a)
SELECT event_id, CAST(round(CASE WHEN 1000 * pow(2, attempt - 1) >= 300000 THEN 256000 + 44000 * y ELSE 1000 * pow(2, attempt - 1) * (0.75 + 0.25 * x) END) AS BIGINT) AS delay_ms FROM h"""
)
def retry_backoff(spark: SparkSession, d: str) -> DataFrame:
    delay = retry_delay_ms(F.sha2(F.col("event_id").cast("string"), 256), F.col("event_id") % 12 + 1)
    return table(spark, d, "events").select("event_id", F.round(delay).cast("bigint").alias("delay_ms"))


@query(f"""WITH v AS (SELECT event_id, event_id % 10 AS attempts, CASE WHEN event_id % 9 = 8 THEN NULL ELSE {STATUS} END AS status FROM events),
c AS (SELECT *, CASE WHEN status BETWEEN 200 AND 299 THEN 'delivered' WHEN status IN (400, 403) THEN 'permanent' ELSE 'retryable' END AS verdict FROM v)
SELECT CASE WHEN verdict = 'retryable' AND attempts + 1 > 8 THEN 'permanent' ELSE verdict END AS disposition,
  CASE WHEN verdict = 'retryable' AND attempts + 1 > 8 THEN 'retry_limit_exceeded' WHEN verdict = 'permanent' THEN 'unknown' END AS rejection_type, count(*) AS n FROM c GROUP BY ALL""")
def drain_verdicts(spark: SparkSession, d: str) -> DataFrame:
    box = _outbox(spark, d)
    verdicts = box.where("event_id % 9 != 8").select("output_id", F.expr(STATUS).cast("int").alias("status"), F.lit(None).cast("string").alias("error_type"))
    out = delivery.settled(box, verdicts, F.col("created_at"))
    return out.groupBy("disposition", "rejection_type").agg(F.count("*").alias("n"))


@query("SELECT sha256(CAST(event_id AS VARCHAR)) AS output_id FROM events ORDER BY ts DESC, sha256(CAST(event_id AS VARCHAR)) DESC LIMIT 500")
def dlq_retention(spark: SparkSession, d: str) -> DataFrame:
    return delivery.retained(_dead(spark, d), 500)[0].select("output_id")


@query("SELECT CASE event_id % 3 WHEN 0 THEN 'mapper_parsing_exception' WHEN 1 THEN 'retry_limit_exceeded' ELSE 'unknown' END AS rejection_type, count(*) AS n FROM events GROUP BY ALL")
def dlq_summary(spark: SparkSession, d: str) -> DataFrame:
    return delivery.summary(_dead(spark, d), "rejection_type")


@query("SELECT sha256(CAST(event_id AS VARCHAR)) AS output_id, length(props) AS document_bytes FROM events WHERE event_type = 'error' AND event_id % 3 = 1 AND sha256(CAST(event_id AS VARCHAR)) > '8' ORDER BY 1 LIMIT 50")
def dlq_page(spark: SparkSession, d: str) -> DataFrame:
    chosen = delivery.selected(_dead(spark, d), reason="retry_limit_exceeded", index="flows-error")
    return delivery.page(chosen, cursor="8", limit=50)[0].select("output_id", "document_bytes")


@query("SELECT sha256(CAST(event_id AS VARCHAR)) AS output_id, 0 AS attempts, 1 AS replay_count FROM events WHERE event_id % 3 = 0 ORDER BY 1 LIMIT 100")
def dlq_replay(spark: SparkSession, d: str) -> DataFrame:
    dead = _dead(spark, d)
    empty = _outbox(spark, d).where("false")
    return delivery.replayed(empty, dead, delivery.selected(dead, reason="mapper_parsing_exception"), limit=100)[0].select("output_id", "attempts", "replay_count")


@query(
    """WITH RECURSIVE h AS (SELECT date_trunc('hour', ts) AS t, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS dead FROM events GROUP BY 1),
o AS (SELECT t, CASE WHEN dead > 2 THEN TRUE ELSE FALSE END AS active, row_number() OVER (ORDER BY t) AS n FROM h),
s AS (SELECT t, n, active, t AS last, CASE WHEN active THEN 'starting' END AS state FROM o WHERE n = 1
UNION ALL SELECT o.t, o.n, o.active, CASE WHEN (o.active AND NOT s.active) OR (o.active AND o.t >= s.last + INTERVAL 3 HOUR) OR (NOT o.active AND s.active) THEN o.t ELSE s.last END,
  CASE WHEN o.active AND NOT s.active THEN 'starting' WHEN o.active AND o.t >= s.last + INTERVAL 3 HOUR THEN 'ongoing' WHEN NOT o.active AND s.active THEN 'clearing' END FROM s JOIN o ON o.n = s.n + 1)
SELECT epoch_us(t) AS at_us, 'dlq' AS kind, state FROM s WHERE state IS NOT NULL"""
)
def alert_fsm(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    hours = e.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("at")).agg(F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("errors"))
    seen = hours.select("at", F.when(F.col("errors") > 2, F.col("errors")).otherwise(0).alias("dead_letters"), F.lit(0).alias("dropped"), F.lit(0).alias("outbox"), F.lit(0.0).alias("oldest_age_s"))
    return delivery.alerts(seen, min_interval_s=3 * 3600).select(us("at").alias("at_us"), "kind", "state")


@query(timebox_sql(12) + """, f AS (SELECT user_id, flow_seq, min(start) AS start FROM b WHERE ts <= (SELECT max(ts) - INTERVAL 6 HOUR FROM events) GROUP BY ALL)
SELECT 'user-timebox' AS rule_id, count(*) AS open_flows FROM f WHERE start + INTERVAL 12 HOUR > (SELECT max(ts) - INTERVAL 6 HOUR FROM events)""")
def open_flows_by_rule(spark: SparkSession, d: str) -> DataFrame:
    """Flows open six hours before the end."""
    e = _events(spark, d)
    at = F.timestamp_micros(F.lit(e.agg(F.max(us("observed_at"))).first()[0] - 6 * HOUR))
    found = views.with_figures(flows(e.where(F.col("observed_at") <= at), [TIMEBOX]), [TIMEBOX])
    return found.where(F.col("finalized_at") > at).groupBy("rule_id").agg(F.count("*").alias("open_flows"))


@query(CALLS_SQL + "SELECT reason, CASE WHEN event_count <= 1 THEN '1' WHEN event_count <= 3 THEN '3' ELSE 'inf' END AS le, count(*) AS n FROM f GROUP BY ALL")
def metrics_rollup(spark: SparkSession, d: str) -> DataFrame:
    figures = _flows(spark, d, CALLS)
    return metrics.histogram(figures, "event_count", (1, 3), by="reason").select("reason", F.when(F.col("le") == "+Inf", "inf").otherwise(F.col("le")).alias("le"), "n")


@query(timebox_sql(12) + """, f AS (SELECT user_id, flow_seq, min(start) + INTERVAL 12 HOUR AS expires FROM b WHERE ts <= (SELECT max(ts) - INTERVAL 6 HOUR FROM events) GROUP BY ALL)
SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(expires) AS expires_us FROM f WHERE expires > (SELECT max(ts) - INTERVAL 6 HOUR FROM events) AND expires <= (SELECT max(ts) FROM events) ORDER BY expires, CAST(user_id AS VARCHAR) LIMIT 20""")
def due_flows_topk(spark: SparkSession, d: str) -> DataFrame:
    """Of the flows open six hours before the end, the next 20 to close until the end."""
    e = _events(spark, d)
    end = e.agg(F.max(us("observed_at"))).first()[0]
    at = F.timestamp_micros(F.lit(end - 6 * HOUR))
    found = views.with_figures(flows(e.where(F.col("observed_at") <= at), [TIMEBOX], with_raw=False), [TIMEBOX])
    live = found.where(F.col("finalized_at") > at).select("rule_id", "key", F.col("finalized_at").alias("expires_at"))
    return delivery.due(live, F.timestamp_micros(F.lit(end)), 20).select("key", us("expires_at").alias("expires_us"))


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type NOT IN ('purchase', 'signup')),
b AS (SELECT user_id, ts, n, ts AS start, 1 AS flow_seq FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.ts, e.n, CASE WHEN e.ts >= b.start + INTERVAL 1 HOUR THEN e.ts ELSE b.start END, b.flow_seq + CASE WHEN e.ts >= b.start + INTERVAL 1 HOUR THEN 1 ELSE 0 END FROM b JOIN e ON e.user_id = b.user_id AND e.n = b.n + 1)
SELECT 'users' AS rule_id, CAST(user_id AS VARCHAR) AS key, flow_seq, count(*) AS event_count, 'y' AS index FROM b GROUP BY user_id, flow_seq
UNION ALL SELECT 'purchases', 'o' || event_id, 1, 1, 'x' FROM events WHERE event_type = 'purchase'"""
)
def several_rules(spark: SparkSession, d: str) -> DataFrame:
    """Flows of two rules from one fold."""
    rules = [BY_ORDER, BY_USER]
    figures = views.with_figures(flows(_mixed(spark, d), rules, with_raw=False), rules)
    index = views.per_rule(rules, lambda r: index_name(r.index, F.col("started_at"), F.col("finalized_at")), "string")
    return figures.select("rule_id", "key", "flow_seq", "event_count", index.alias("index"))


HALF = Stitch("half", (p("$.maybe"),), (Role("request", ("view",)), Role("response", ("purchase",))))
HALVES = Rule("halves", p("$.user"), 12 * HOUR, "x", event_type=p("$.event"), stitches=(HALF,)).versioned()


@query(timebox_sql(12) + f"""SELECT {KEY}, flow_seq, count(*) - count(*) FILTER (event_type IN ('view', 'purchase') AND k % 2 = 0) + count(*) FILTER (event_type IN ('view', 'purchase') AND k % 2 = 0)
  - count(DISTINCT CASE WHEN event_type IN ('view', 'purchase') AND k % 2 = 0 THEN k || event_type END) + count(DISTINCT CASE WHEN event_type IN ('view', 'purchase') AND k % 2 = 0 THEN k END) AS entry_count,
  count(DISTINCT CASE WHEN event_type IN ('view', 'purchase') AND k % 2 = 0 THEN k END) AS invocations FROM b GROUP BY user_id, flow_seq""")
def ungrouped_is_plain(spark: SparkSession, d: str) -> DataFrame:
    """Events in a role whose group has no value stand alone."""
    found = views.with_figures(flows(_events(spark, d), [HALVES]), [HALVES])
    return found.select("key", "flow_seq", "entry_count", (F.col("complete_invocations") + F.col("incomplete_invocations")).alias("invocations"))


@query(
    """WITH r AS (SELECT CASE event_id % 3 WHEN 0 THEN 'mapper_parsing_exception' WHEN 1 THEN 'retry_limit_exceeded' ELSE 'unknown' END AS type, count(*) AS n FROM events GROUP BY ALL)
SELECT (SELECT string_agg(type || '=' || n, ',' ORDER BY type) FROM r) AS reasons, (SELECT string_agg(i, ',' ORDER BY i) FROM (SELECT DISTINCT 'flows-' || event_type AS i FROM events)) AS indices,
  (SELECT string_agg(i, ',' ORDER BY i) FROM (SELECT DISTINCT 'flows-' || event_type AS i FROM events WHERE event_id % 5 = 0)) AS outbox_indices, (SELECT count(*) FROM events) AS dead_letters, (SELECT count(*) FROM events WHERE event_id % 5 = 0) AS outbox"""
)
def alert_lists(spark: SparkSession, d: str) -> DataFrame:
    """What alerts tell: reasons with counts and indices, in order."""
    seen = delivery.observed(_outbox(spark, d).where("event_id % 5 = 0"), _dead(spark, d), None, F.current_timestamp())
    reasons = F.array_join(F.transform("reasons", lambda r: F.concat(r["type"], F.lit("="), r["count"].cast("string"))), ",")
    return seen.select(reasons.alias("reasons"), F.array_join("dlq_indices", ",").alias("indices"), F.array_join("outbox_indices", ",").alias("outbox_indices"), "dead_letters", "outbox")


def _answers(rows):
    """A sink that answers by the first digits of the id; it leaves some records out."""
    for i, _, _ in rows:
        status = (200, 429, 400, 0)[int(i[:2], 16) % 4]
        if status:
            yield i, status, "mapper_parsing_exception" if status == 400 else None


@query(
    f"""WITH o AS (SELECT sha256(CAST(event_id AS VARCHAR)) AS id, event_id % 10 AS attempts, ts, event_id FROM events),
b AS (SELECT *, CAST('0x' || substr(id, 1, 2) AS INTEGER) % 4 AS way FROM o WHERE event_id % 4 = 0 OR ts + to_hours(CAST(event_id % 7 AS INTEGER)) <= {MIDDLE} ORDER BY ts, id LIMIT 64)
SELECT 'dead' AS place, id AS output_id, attempts + CASE WHEN way = 2 THEN 0 ELSE 1 END AS attempts, CASE WHEN way = 2 THEN 'mapper_parsing_exception' ELSE 'retry_limit_exceeded' END AS rejection_type FROM b WHERE way = 2 OR (way IN (1, 3) AND attempts + 1 > 8)
UNION ALL SELECT 'outbox', id, attempts + 1, NULL FROM b WHERE way IN (1, 3) AND attempts + 1 <= 8"""
)
def drain_round(spark: SparkSession, d: str) -> DataFrame:
    """Where the records of one delivery round are after it."""
    box = _outbox(spark, d).drop("event_id")
    now = F.timestamp_micros(F.lit(box.agg(F.expr("min(unix_micros(created_at)) + (max(unix_micros(created_at)) - min(unix_micros(created_at))) div 2")).first()[0]))
    dead = spark.createDataFrame([], box.withColumn("dead_lettered_at", F.col("created_at")).schema)
    left, kept, _ = sinks.drain(box, dead, _answers, now)
    sent = delivery.pending(box, now).select("output_id")
    both = left.select(F.lit("outbox").alias("place"), "output_id", "attempts", "rejection_type").unionByName(kept.select(F.lit("dead").alias("place"), "output_id", "attempts", "rejection_type"))
    return both.join(sent, "output_id", "left_semi").select("place", "output_id", "attempts", "rejection_type")


