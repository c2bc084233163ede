"""Sinks over a local HTTP server, streams into them, the state they leave, metrics, log and command line."""

import base64
import io
import json
import threading
from datetime import UTC, datetime, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from millrace import __main__ as cli
from millrace.functions.paths import compile_path as p
from millrace.operators import delivery, log, metrics, views
from millrace.operators.flows import flows
from millrace.operators.route import route, unmatched
from millrace.plans.rules import Rule
from millrace.sources.events import accept
from millrace.streaming import sinks
from millrace.streaming.bulk import AlertFailed, Bulk, to_bulk
from millrace.streaming.flows import open_flows, stream_flows

T0 = datetime(2026, 3, 4, 5, tzinfo=UTC)
RULE = Rule("parcels", p("$.parcel"), 60_000_000, "parcels-{yyyy}", event_type=p("$.step"), max_events=3).versioned()


class Server(ThreadingHTTPServer):
    """Takes bulk requests; answer(lines) gives status and body."""

    def __init__(self, answer):
        self.got, self.answer = [], answer

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                lines = self.rfile.read(int(self.headers["Content-Length"])).decode().splitlines()
                self.server.got.append((self.path, dict(self.headers), lines))
                status, body = self.server.answer(lines)
                self.send_response(status)
                self.end_headers()
                self.wfile.write(body.encode())

            def log_message(self, *args):
                pass

        super().__init__(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.serve_forever, daemon=True).start()

    @property
    def address(self):
        return f"http://127.0.0.1:{self.server_port}"


def items(*given):
    return 200, json.dumps({"items": [{"index": x} for x in given]})


@pytest.fixture
def server():
    made = Server(lambda lines: items(*[{"_id": json.loads(x)["index"].get("_id"), "status": 201} for x in lines[::2]]))
    yield made
    made.shutdown()


ROWS = [("a", "x-1", '{"n":1}'), ("b", "x-2", '{"n":2}'), ("c", "x-1", '{"n":3}')]


def test_documents_by_id(server):
    server.answer = lambda lines: items({"_id": "c", "status": 400, "error": {"type": "parse", "reason": "secret"}}, {"_id": "a", "status": 200}, {"_id": "zzz", "status": 200})
    sink = Bulk((server.address,), "me", "word")
    assert sorted(sink(ROWS)) == [("a", 200, None), ("c", 400, "parse")]  # b was left out
    path, headers, lines = server.got[0]
    assert path == "/_bulk" and headers["Content-Type"] == "application/x-ndjson" and headers["Authorization"] == "Basic " + base64.b64encode(b"me:word").decode()
    assert lines[::2] == [json.dumps({"index": {"_id": i, "_index": x}}) for i, x, _ in ROWS] and lines[1::2] == [d for _, _, d in ROWS]
    assert list(sink([])) == [] and len(server.got) == 1


@pytest.mark.parametrize("answer,status", [((503, "busy"), 503), ((400, ""), 400), ((200, "no json"), 599), ((200, '{"items": 3}'), 599), ((200, "[1]"), 599)])
def test_whole_batches_fail(server, answer, status):
    server.answer = lambda lines: answer
    assert [x[1] for x in Bulk((server.address,))(ROWS)] == [status] * 3
    assert Bulk((server.address,)).verbatim([("x", "1")] * 2) == [status] * 2


def test_bounds_and_addresses(server):
    assert [x[1] for x in Bulk(())(ROWS)] == [x[1] for x in Bulk(("http://127.0.0.1:9",), timeout_s=1)(ROWS)] == [599] * 3
    assert [x[1] for x in Bulk((server.address,), max_answer=10)(ROWS)] == [599] * 3
    other = Server(server.answer)
    both = Bulk((server.address, other.address + "/"))
    for _ in range(4):
        list(both(ROWS[:1]))
    assert len(other.got) == 2
    other.shutdown()


def test_verbatim_by_place_and_alerts(server):
    server.answer = lambda lines: items({"status": 201}, {"status": 429})
    sink = Bulk((server.address,))
    assert sink.verbatim([("x", " {raw}"), ("x", "2"), ("x", "3")]) == [201, 429, 599]
    assert server.got[0][2][:2] == ['{"index": {"_index": "x"}}', " {raw}"]
    sink.alert("alerts", "{}")
    server.answer = lambda lines: items({"status": 403, "error": {"type": "t"}})
    for answer in (server.answer, lambda lines: (500, ""), lambda lines: items()):
        server.answer = answer
        with pytest.raises(AlertFailed):
            sink.alert("alerts", "{}")


def outbox(spark, n):
    rows = [(f"{k:02}", "x", json.dumps({"k": k}), T0 + timedelta(seconds=k), 0, 0, None, None, None) for k in range(n)]
    return spark.createDataFrame(rows, "output_id string, index string, document string, created_at timestamp, attempts int, replay_count int, last_error string, rejection_type string, next_attempt_at timestamp")


def test_drain(spark, server):
    now = F.lit(T0 + timedelta(hours=1)).cast("timestamp")
    dead = spark.createDataFrame([], outbox(spark, 0).withColumn("dead_lettered_at", F.col("created_at")).schema)
    server.answer = lambda lines: items(*[{"_id": (i := json.loads(x)["index"]["_id"]), "status": 400 if i == "03" else 200} for x in lines[::2]])
    left, kept, dropped = sinks.drain(outbox(spark, 6), dead, Bulk((server.address,)), now, bulk=5)
    assert [r.output_id for r in left.collect()] == ["05"] and [(r.output_id, r.rejection_type) for r in kept.collect()] == [("03", "unknown")] and dropped.count() == 0

    def broken(rows):
        raise RuntimeError("sink down")

    left, kept, _ = sinks.drain(outbox(spark, 2), dead, broken, now)
    assert [(r.attempts, r.last_error) for r in left.collect()] == [(1, "RuntimeError")] * 2 and kept.count() == 0


def test_replay_shows_before_it_acts(spark):
    dead = outbox(spark, 4).withColumn("rejection_type", F.lit("bad")).withColumn("dead_lettered_at", F.col("created_at") + F.expr("interval 1 day"))
    box, left, chosen = delivery.replay(outbox(spark, 0), dead, reason="bad", limit=3)
    assert box.count() == 0 and left.count() == 4 and chosen.count() == 3 and "document" not in chosen.columns
    box, left, _ = delivery.replay(outbox(spark, 0), dead, reason="bad", limit=3, dry_run=False)
    assert (box.count(), left.count()) == (3, 1)
    box, left, _ = delivery.replay(outbox(spark, 0), dead, output_id="02")
    assert [(r.output_id, r.replay_count, r.rejection_type) for r in box.collect()] == [("02", 1, None)] and left.count() == 3
    old = delivery.selected(dead, older_than=F.lit(T0 + timedelta(days=1, seconds=2)).cast("timestamp"))
    assert sorted(r.output_id for r in old.collect()) == ["00", "01"]


def test_alert_documents(spark):
    dead = outbox(spark, 3).withColumn("rejection_type", F.when(F.col("output_id") == "00", "").otherwise("bad")).withColumn("dead_lettered_at", F.col("created_at"))
    seen = delivery.observed(outbox(spark, 2), dead, dead.limit(1), F.lit(T0 + timedelta(seconds=400)).cast("timestamp"))
    made = {r.kind: json.loads(r.document) for r in delivery.alert_documents(delivery.alerts(seen)).collect()}
    assert made["dlq"]["reasons"] == [{"type": "bad", "count": 2}, {"type": "unknown", "count": 1}] and made["dlq"]["indices"] == ["x"]
    assert made["dlq"]["summary"] == "dead-letter condition starting: 3 retained, 1 dropped" and made["outbox_backlog"]["summary"] == "outbox backlog condition starting: 2 records, oldest 400s"
    nothing = delivery.observed(outbox(spark, 0), dead.limit(0), None, F.current_timestamp()).first()
    assert (nothing.dead_letters, nothing.outbox, nothing.oldest_age_s, nothing.reasons, nothing.dlq_indices) == (0, 0, 0.0, [], [])
    assert delivery.expired_indices(spark.createDataFrame([("a", T0), ("b", T0 + timedelta(days=9))], "index string, created_at timestamp"), F.lit(T0 + timedelta(days=32)).cast("timestamp")).first()["index"] == "a"


def parcels(spark, folder, number, rows):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps({"raw": json.dumps(doc), "observed_at": (T0 + timedelta(seconds=s)).isoformat(), "seq": k}) for k, (s, doc) in enumerate(rows)]
    (folder / f"{number}.json").write_text("\n".join(lines))
    return accept(spark.readStream.schema("raw string, observed_at timestamp, seq bigint").json(str(folder))).events


def test_stream_to_outbox_and_open_flows(spark, tmp_path):
    rows = [(0, {"parcel": "p1", "step": "sent"}), (1, {"parcel": "p2", "step": "sent"}), (2, {"parcel": "p1", "step": "way"}), (3, {"parcel": "p1", "step": "there"}), (4, {"other": 1})]
    events = parcels(spark, tmp_path / "in", 1, rows)
    found = stream_flows(route(events, [RULE]), [RULE], "0 seconds")
    q = sinks.to_outbox(found, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    docs = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(d["index"], json.loads(d.document)["flow"]["event_count"]) for d in docs] == [("parcels-2026", 3)]
    live = open_flows(spark, str(tmp_path / "cp"))
    assert [(r.rule_id, r.key, r.event_count, r.expires_at - r.first_observed) for r in live.collect()] == [("parcels", "p2", 1, timedelta(seconds=60))]
    assert delivery.due(live, F.lit(T0 + timedelta(seconds=61)).cast("timestamp")).count() == 1 and delivery.due(live, F.lit(T0).cast("timestamp")).count() == 0
    lines = sinks.to_lines(unmatched(route(events, [RULE])).select("raw", F.lit("rest").alias("index")), str(tmp_path / "lines"), str(tmp_path / "cp2")).trigger(availableNow=True).start()
    assert lines.awaitTermination(120)
    assert [r.value for r in spark.read.text(str(tmp_path / "lines")).collect()] == ['{"other": 1}']


def test_pass_through_waits_for_its_sink(spark, tmp_path, server):
    def go(number, rows, **limits):
        events = parcels(spark, tmp_path / "in", number, rows)
        q = to_bulk(events.select(F.lit("rest").alias("index"), "raw"), Bulk((server.address,)), str(tmp_path / "out"), str(tmp_path / "cp"), batch_size=2, **limits).trigger(availableNow=True).start()
        q.awaitTermination(120)

    def status(lines, of):
        return items(*[{"status": of(json.loads(x)["n"])} for x in lines[1::2]])

    server.answer = lambda lines: status(lines, lambda n: 429 if n == 1 else 400 if n == 2 else 201)
    go(1, [(k, {"n": k}) for k in range(4)])
    assert [r.raw for r in spark.read.parquet(str(tmp_path / "out" / "waiting=0")).collect()] == ['{"n": 1}']
    assert [(r.status, r.n) for r in spark.read.parquet(str(tmp_path / "out" / "dropped=0")).collect()] == [(400, 1)]
    with pytest.raises(Exception, match="wait for the sink"):
        go(2, [(9, {"n": 9})], buffer_size=1)
    server.answer = lambda lines: status(lines, lambda n: 201)
    server.got.clear()
    go(2, [(9, {"n": 9})])
    assert sorted(x for _, _, lines in server.got for x in lines[1::2]) == ['{"n": 1}', '{"n": 9}']
    assert spark.read.parquet(str(tmp_path / "out" / "waiting=1")).count() == 0


def test_metrics(spark):
    rows = [(json.dumps(x), T0 + timedelta(seconds=k), k) for k, x in enumerate([{"parcel": "a", "step": "s"}] * 4 + [{"parcel": "b"}, {"z": 1}])]
    events = accept(spark.createDataFrame(rows, "raw string, observed_at timestamp, seq bigint")).events
    tally = lambda df: sorted(tuple(r) for r in df.collect())
    assert tally(metrics.ingest(route(events, [RULE]), [RULE], True)) == [("", "passed_through", 1), ("parcels", "correlated", 5)]
    assert tally(metrics.ingest(route(events, [RULE]), [RULE], False))[0] == ("", "quarantined", 1)
    figures = views.with_figures(flows(events, [RULE]), [RULE])
    assert sorted((r.reason, r.flows, r.events) for r in metrics.closed(figures).collect()) == [("limit_exceeded", 1, 3), ("timeout", 2, 2)]
    assert tally(metrics.histogram(figures, "event_count", metrics.EVENTS)) == [("parcels", "1", 2), ("parcels", "4", 1)]
    assert metrics.open_flows(figures, F.lit(T0 + timedelta(seconds=10)).cast("timestamp")).first().n == 2
    assert metrics.ready(1, 1, 2, 2, True) and not metrics.ready(2, 0, 2, 0, True) and not metrics.ready(0, 0, 0, 0, False)


def test_log():
    out = io.StringIO()
    log.configure("info", "json", out)
    log.note("debug", "unseen")
    log.note("info", "flow closed", rule_id="r", reason="timeout")
    log.configure("debug", "text", out)
    log.note("debug", "seen", count=2)
    first, second = out.getvalue().splitlines()
    assert json.loads(first)["msg"] == "flow closed" and json.loads(first)["reason"] == "timeout" and second == "DEBUG seen count=2"
    with pytest.raises(ValueError):
        log.note("info", "no", document="{}")


CONFIG = """
rules:
  - id: parcels
    enabled: true
    correlation: {key: $.parcel}
    lifecycle: {timeout: 1m}
    output: {index: "parcels-{yyyy}", timestamp: finalized_at}
"""


def test_command_line(tmp_path, capsys):
    good, bad = tmp_path / "good.yaml", tmp_path / "bad.yaml"
    good.write_text(CONFIG)
    bad.write_text(CONFIG.replace("1m", "0s"))
    assert cli.main(["validate", str(good)]) == 0 and "1 rules, 1 enabled" in capsys.readouterr().out
    assert cli.main(["validate", str(bad)]) == 1 and "timeout" in capsys.readouterr().err
    assert cli.main(["print-index-template", str(good)]) == 0 and json.loads(capsys.readouterr().out)[0]["index"] == "parcels-{yyyy}"
    assert cli.main(["print-index-template", str(good), "--index", "parcels-{yyyy}"]) == 0 and json.loads(capsys.readouterr().out)["index_patterns"] == ["parcels-*"]
    assert cli.main(["print-index-template", str(good), "--index", "none"]) == 1 and cli.main(["version"]) == 0
