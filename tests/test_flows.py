"""Scenarios of calls and flows, as data, over the batch fold; the stream must agree."""

import json
from datetime import UTC, datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from millrace.functions.paths import compile_path as p
from millrace.operators import views
from millrace.operators.fold import Flow
from millrace.operators.flows import flows, fold
from millrace.operators.route import pass_through, route
from millrace.plans.rules import ALL_COMPLETE, Promotion, Role, Rule, Stitch
from millrace.sources.events import accept, accept_batch
from millrace.streaming.flows import stream_flows

T0 = datetime(2026, 8, 20, 12, 0, tzinfo=UTC)
SECOND = 1_000_000
CALL = Stitch("call", (p("$.service"), p("$.context.id")), (Role("request", ("http.request",)), Role("response", ("http.response", "http.error"))))


def rule(**more):
    base = dict(id="http", key=p("$.flow_id"), timeout_us=10 * SECOND, index="flows-{yyyy}.{MM}.{dd}", event_type=p("$.event"), timestamp=p("$.datetime"), stitches=(CALL,), close_when=ALL_COMPLETE, max_events=100)
    return Rule(**{**base, **more}).versioned()


def event(kind, at=0.0, call="c1", flow="flow-1", stamp="2026-08-20T12:00:00Z", **more):
    doc = {"flow_id": flow, "event": kind, "datetime": stamp, "service": "web", **({"context": {"id": call}} if call else {}), **more}
    return (json.dumps(doc), T0 + timedelta(seconds=at))


def run(spark, events, r):
    rows = [(raw, at, k) for k, (raw, at) in enumerate(events)]
    got = accept(spark.createDataFrame(rows, "raw string, observed_at timestamp, seq bigint")).events
    return views.promoted(views.with_figures(fold(route(got, [r]), [r]), [r]), [r])


def rows(spark, events, r):
    return run(spark, events, r).orderBy("key", "flow_seq").collect()


def test_request_and_response(spark):
    (f,) = rows(spark, [event("http.request"), event("http.response", 1, stamp="2026-08-20T12:00:00.073Z")], rule())
    assert (f.reason, f.event_count, f.entry_count, f.calls[0].duration_ms, f.incomplete_invocations) == ("invocations_complete", 2, 1, 73, 0)


def test_response_first_gives_the_same(spark):
    a, b = event("http.request"), event("http.response", stamp="2026-08-20T12:00:01Z")
    one, two = (run(spark, e, rule()).select("output_id", "reason", "calls").collect() for e in ([a, b], [b, a]))
    assert one == two


def test_fan_out_closes_on_the_last(spark):
    (f,) = rows(spark, [event("http.request"), event("http.request", 1, "c2"), event("http.response", 2), event("http.response", 3, "c2")], rule())
    assert (f.event_count, f.entry_count, f.complete_invocations) == (4, 2, 2)


def test_plain_events_never_complete(spark):
    (f,) = rows(spark, [event("note"), event("note", 1)], rule())
    assert (f.reason, f.age_ms, f.duplicate_count, f.event_count) == ("timeout", 10_000, 0, 2)


def test_missing_response(spark):
    df = run(spark, [event("http.request")], rule())
    (f,) = df.collect()
    assert (f.reason, f.incomplete_invocations, f.calls[0].duration_ms) == ("timeout", 1, -1)
    assert [a.kind for a in views.anomalies(df).collect()] == ["clock_skew"]
    assert views.anomalies(df, incomplete_is_skew=False).count() == 0


def test_settle(spark):
    done = [event("http.request"), event("http.response", 1)]
    (f,) = rows(spark, done, rule(settle_us=SECOND))
    assert f.reason == "invocations_complete" and f.finalized_at.second == 2
    (g,) = rows(spark, [*done, event("http.request", 1.5, "c2")], rule(settle_us=SECOND))
    assert (g.reason, g.event_count) == ("timeout", 3)
    (h,) = rows(spark, [event("http.request"), event("http.response", 9.5)], rule(settle_us=SECOND))
    assert h.reason == "timeout"


def test_identical_repeat_is_a_duplicate(spark):
    (f,) = rows(spark, [event("http.request"), event("http.request", 1), event("http.response", 2)], rule())
    assert (f.duplicate_count, f.event_count, f.duplicates[0].type, f.calls[0].duplicates) == (1, 2, "http.request", 1)


def test_equal_numbers_are_equal_documents(spark):
    a, b = event("http.request", n=1), event("http.request", 1, n=1)
    (f,) = rows(spark, [a, (b[0].replace('"n": 1', '"n": 1.0'), b[1])], rule())
    assert f.duplicate_count == 1


def test_other_document_in_the_slot(spark):
    df = run(spark, [event("http.request"), event("http.request", 1, attempt=2), event("http.response", 2)], rule())
    (f,) = df.collect()
    assert (f.event_count, f.entry_count, [a.kind for a in f.anomalies]) == (3, 2, ["cardinality_exceeded"])
    assert [e.kind for e in views.entries(df).orderBy("position").collect()] == ["stitched", "plain"]


def test_terminal_and_limit(spark):
    (f,) = rows(spark, [event("http.request"), event("done", 1)], rule(terminal_events=("done",)))
    assert (f.reason, f.incomplete_invocations) == ("terminal_event", 1)
    got = rows(spark, [event("a"), event("b", 1)], rule(max_events=1))
    assert [g.reason for g in got] == ["limit_exceeded"] * 2 and got[0].output_id != got[1].output_id
    (g,) = rows(spark, [event("a", text="<" * 200)], rule(max_event_bytes=1000))
    assert g.reason == "limit_exceeded"


def test_deadline_opens_a_new_flow(spark):
    got = rows(spark, [event("a"), event("b", 9.999), event("c", 10)], rule())
    assert [g.event_count for g in got] == [2, 1]


def test_ungrouped_is_plain(spark):
    (f,) = rows(spark, [event("http.request", call=None)], rule())
    assert (f.entry_count, f.incomplete_invocations) == (1, 0)


def test_negative_duration_follows_requires(spark):
    pair = [event("http.request", stamp="2026-08-20T12:00:01Z"), event("http.response", 1)]
    (f,) = rows(spark, pair, rule())
    assert f.calls[0].duration_ms == -1000
    (g,) = rows(spark, pair, rule(stitches=(Stitch("call", CALL.group_by, CALL.roles, ("response", "request")),)))
    assert g.calls[0].duration_ms == 1000


def test_documents(spark):
    promos = (Promotion("status", p("$.payload.status"), "long", "response"), Promotion("bad", p("$.event"), "long", "first"), Promotion("when", p("$.datetime"), "date"))
    r = rule(promotions=promos)
    events = [event("http.request"), event("http.response", 1, stamp="2026-08-20T12:00:02Z", payload={"status": "200"})]
    df = spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(events)], "raw string, observed_at timestamp, seq bigint")
    (d,) = views.documents(fold(route(accept(df).events, [r]), [r]), [r]).collect()
    doc = json.loads(d.document)
    assert d["index"] == "flows-2026.08.20" and doc["flow"]["finalization_reason"] == "invocations_complete" and doc["fields"]["status"] == 200
    (entry,) = doc["events"]
    assert entry["group"] == {"service": "web", "id": "c1"} and entry["duration_ms"] == 2000 and entry["response"]["event"]["payload"] == {"status": "200"}
    assert [a["kind"] for a in doc["anomalies"]] == ["promotion_failed"] and "bad" not in doc["fields"]


def test_index_date_is_utc_of_the_stamp(spark):
    df = spark.createDataFrame([('{"m":1,"datetime":"2026-08-21T03:15:00+09:00"}', T0, 0), ('{"m":2,"datetime":"x"}', T0, 1)], "raw string, observed_at timestamp, seq bigint")
    got = pass_through(route(accept(df).events, [rule()]), "logs-{yyyy}.{MM}.{dd}", "$.datetime").orderBy("seq").collect()
    assert [g["index"] for g in got] == ["logs-2026.08.20"] * 2 and got[0].raw.startswith('{"m":1')


def test_sources(spark):
    df = spark.createDataFrame([(x, T0, k) for k, x in enumerate(['{"a":1}', "[1]", "null", "{", None, '{"a":"' + "x" * 99 + '"}'])], "raw string, observed_at timestamp, seq bigint")
    got = accept(df, max_bytes=50)
    assert got.events.count() == 1 and sorted(r.reason for r in got.rejected.collect()) == ["malformed json"] * 4 + ["too large"]
    batch = accept_batch(spark.createDataFrame([('[{"a":1},{"a":2},3,{"a":4}]', T0), ("oops", T0)], "body string, observed_at timestamp"))
    assert [r.seq for r in batch.events.orderBy("seq").collect()] == [0, 1] and batch.rejected.count() == 2


def test_state_keeps_its_version():
    flow = Flow.open(5, rule())
    assert Flow.from_json(flow.to_json()) == flow
    with pytest.raises(ValueError):
        Flow.from_json(flow.to_json().replace('"v":1', '"v":9'))


def sequential(events, r):
    """What a plain loop over time makes of it: (key, reason, event count, duplicates) of each flow."""
    open_, out = {}, []
    for raw, at in sorted(events, key=lambda e: e[1]):
        doc = json.loads(raw)
        key, t = doc["flow_id"], (at - T0).total_seconds()
        f = open_.get(key)
        if f and t >= f["start"] + 10:
            out.append((key, "timeout", f["n"], f["dup"]))
            f = None
        if f is None:
            f = open_[key] = {"start": t, "n": 0, "dup": 0, "slots": {}}
        role = {"http.request": "q", "http.response": "a"}.get(doc["event"])
        slot = (doc["context"]["id"], role)
        if role and slot in f["slots"]:
            if f["slots"][slot] == raw:
                f["dup"] += 1
            else:
                f["n"] += 1
        else:
            f["n"] += 1
            if role:
                f["slots"][slot] = raw
        calls = {c for c, _ in f["slots"]}
        reason = "terminal_event" if doc["event"] == "done" else "limit_exceeded" if f["n"] >= 5 else "invocations_complete" if calls and all((c, x) in f["slots"] for c in calls for x in "qa") else None
        if reason:
            out.append((key, reason, f["n"], f["dup"]))
            del open_[key]
    return sorted(out + [(k, "timeout", f["n"], f["dup"]) for k, f in open_.items()])


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["http.request", "http.response", "note", "done"]), st.integers(0, 60), st.sampled_from("xy"), st.sampled_from("ab"), st.integers(0, 1)), min_size=1, max_size=60))
def test_fold_equals_a_plain_loop(spark, made):
    events = [event(k, at + i / 1000, call=c, flow=f, n=n) for i, (k, at, c, f, n) in enumerate(made)]
    r = rule(max_events=5, terminal_events=("done",))
    got = sorted((g.key, g.reason, g.event_count, g.duplicate_count) for g in run(spark, events, r).collect())
    assert got == sequential(events, r)


class Stream:
    """A stream over files, started anew for each file."""

    def __init__(self, spark, folder, watermark=None):
        self.spark, self.folder, self.watermark, self.n = spark, folder, watermark, 0
        (folder / "in").mkdir()

    def put(self, rules, *events, start=0):
        lines = [json.dumps({"raw": raw, "observed_at": at.isoformat(), "seq": start + k}) for k, (raw, at) in enumerate(events)]
        self.n += 1
        (self.folder / "in" / f"{self.n}.json").write_text("\n".join(lines))
        raw = self.spark.readStream.schema("raw string, observed_at timestamp, seq bigint").json(str(self.folder / "in"))
        out = stream_flows(route(accept(raw).events, rules), rules, self.watermark)
        once = {"availableNow": True} if self.watermark else {"once": True}  # processing time goes on and on
        q = out.writeStream.format("parquet").option("path", str(self.folder / "out")).option("checkpointLocation", str(self.folder / "cp")).outputMode("append").trigger(**once).start()
        assert q.awaitTermination(180)

    def rows(self):
        return self.spark.read.parquet(str(self.folder / "out")).orderBy("first_observed", "key").collect()


def test_stream_equals_batch_and_survives_a_restart(spark, tmp_path):
    r = rule(max_events=5, terminal_events=("done",))
    kinds = ["http.request", "http.response", "note", "http.request", "done"]
    events = [event(kinds[i * 7 % 5], i * 1.7, call=f"c{i % 3}", flow=f"f{i % 4}") for i in range(60)]
    want = sorted((g.key, g.first_observed, g.reason, g.event_count) for g in run(spark, events, r).collect())
    s = Stream(spark, tmp_path, "0 seconds")
    s.put([r], *events[:30])
    s.put([r], *events[30:], start=30)
    # a late event of another key moves the clock, so all timers fire
    s.put([r], event("note", 1000, flow="clock"))
    got = [g for g in s.rows() if g.key != "clock"]
    assert sorted((g.key, g.first_observed, g.reason, len(g.events)) for g in got) == want and all(g.flow_seq is None for g in got)


def test_flow_ends_under_the_rule_it_began_with(spark, tmp_path):
    """A query started again with other rules: open flows keep theirs, new ones get the new."""
    old, new = rule(timeout_us=30 * SECOND, max_events=3), rule(timeout_us=5 * SECOND, max_events=2)
    s = Stream(spark, tmp_path, "0 seconds")
    s.put([old], event("note"))
    s.put([new], event("note", 20), event("note", 40), event("note", 41))
    s.put([new], event("note", 1000, flow="clock"))
    assert [(g.reason, len(g.events), (g.finalized_at - g.first_observed).total_seconds()) for g in s.rows() if g.key == "flow-1"] == [("timeout", 2, 30), ("limit_exceeded", 2, 1)]


def test_processing_time_drops_nothing(spark, tmp_path):
    """Rows far behind others still count, and closed flows leave no state."""
    r = rule(max_events=2)
    s = Stream(spark, tmp_path)
    ahead = timedelta(days=4000)
    later = lambda *a, **k: (event(*a, **k)[0], event(*a, **k)[1] + ahead)
    s.put([r], later("note", 500), later("note", 500, flow="flow-2"))
    s.put([r], later("note", 0, flow="flow-3"), later("note", 1, flow="flow-3"), later("note", 501))
    assert sorted((g.key, len(g.events)) for g in s.rows()) == [("flow-1", 2), ("flow-3", 2)]
    state = spark.read.format("statestore").option("stateVarName", "flow").load(str(tmp_path / "cp"))
    assert [x.key.key for x in state.select("key").collect()] == ["flow-2"]


def test_rules_survive_as_json():
    r = rule(promotions=(Promotion("status", p("$.payload.status"), "long", "response"),), terminal_events=("done",), settle_us=5)
    assert Rule.from_json(r.to_json()) == r and Rule.from_json(rule(timestamp=p("$.a")).to_json()).timestamp == p("$.a")


def test_several_rules_at_once(spark):
    """Each event belongs to the first rule whose key it has; flows of all rules come from one fold, each under its own limits."""
    by_flow, by_user = rule(max_events=2, stitches=()), Rule("users", p("$.user"), 60 * SECOND, "people-{yyyy}", event_type=p("$.event")).versioned()
    events = [event("a", user="u1"), event("b", 1, user="u2"), (json.dumps({"user": "u1", "event": "c"}), T0), (json.dumps({"flow_id": "", "user": "u1", "event": "d"}), T0 + timedelta(seconds=30)), (json.dumps({"user": 7}), T0), (json.dumps({"other": 1}), T0)]
    rows = spark.createDataFrame([(raw, at, k) for k, (raw, at) in enumerate(events)], "raw string, observed_at timestamp, seq bigint")
    got = accept(rows).events
    figures = views.with_figures(flows(got, [by_flow, by_user]), [by_flow, by_user])
    assert sorted((g.rule_id, g.key, g.reason, g.event_count) for g in figures.collect()) == [("http", "flow-1", "limit_exceeded", 2), ("users", "7", "timeout", 1), ("users", "u1", "timeout", 2)]
    documents = views.documents(flows(got, [by_flow, by_user]), [by_flow, by_user]).collect()
    assert sorted(d["index"] for d in documents) == ["flows-2026.08.20", "people-2026", "people-2026"]
    assert sorted(map(str, fold(route(got, [by_flow, by_user]), [by_flow, by_user]).collect())) == sorted(map(str, flows(got, [by_flow, by_user]).collect()))
