"""The engine as a whole: a configuration's streams, reload, monitoring."""

import json
import time
import urllib.error
import urllib.request
from datetime import UTC, datetime, timedelta

import pytest

from millrace.plans.rules import ConfigError, parse_config
from millrace.sources.events import accept
from millrace.streaming.engine import Engine, Monitor

T0 = datetime(2026, 5, 6, tzinfo=UTC)
CONFIG = """
observability: {{log_level: error}}
passthrough: {{enabled: true, index: "rest-{{yyyy}}"}}
rules:
{first}
  - id: parcels
    enabled: true
    extract: {{event_type: $.step, timestamp: $.when}}
    correlation: {{key: $.parcel}}
    promote:
      weight: {{path: $.kg, type: {kind}, from: first}}
    lifecycle: {{timeout: {timeout}}}
    limits: {{max_events: {most}}}
    output: {{index: "parcels-{{yyyy}}", timestamp: finalized_at}}
"""
OTHER = """  - id: letters
    enabled: true
    correlation: {key: $.letter}
    lifecycle: {timeout: 1m}
    output: {index: "letters", timestamp: finalized_at}
"""


def config(first="", kind="long", timeout="30s", most=3):
    return CONFIG.format(first=first, kind=kind, timeout=timeout, most=most)


def get(server, path):
    try:
        with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{path}") as answer:
            return answer.status, answer.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.headers.get("Retry-After")


def test_reload_keeps_open_flows_and_renders_them_by_their_rule(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    monitor = Monitor()
    spark.streams.addListener(monitor)
    server = monitor.serve()

    def put(name, *rows):
        (source / name).write_text("\n".join(json.dumps({"raw": json.dumps(d), "observed_at": (T0 + timedelta(seconds=s)).isoformat(), "seq": k}) for k, (s, d) in enumerate(rows)))

    def events():
        return accept(spark.readStream.schema("raw string, observed_at timestamp, seq bigint").json(str(source))).events

    put("1.json", (0, {"parcel": "p", "step": "sent", "kg": "7"}), (1, {"junk": 1}))
    engine = Engine(spark, parse_config(config()), events, str(tmp_path / "out"), watermark="0 seconds", trigger={"availableNow": True})
    engine.start()
    assert engine.wait(120)
    for bad in (config(most=0).replace("rules:", "rulez:"), config() + "limits: {max_open_flows: 5}\n"):
        with pytest.raises(ConfigError):
            engine.reload(bad)
    # the new configuration has another rule first, another type, and shorter limits
    put("2.json", (20, {"parcel": "p", "step": "way"}), (40, {"parcel": "p", "step": "late", "kg": "x"}), (41, {"parcel": "p", "step": "end"}), (42, {"letter": "l"}))
    engine.reload(config(OTHER, kind="keyword", timeout="5s", most=2))
    assert engine.wait(120)
    put("3.json", (1000, {"junk": 2}))
    put("4.json", (2000, {"parcel": "clock"}), (2000, {"letter": "clock"}))
    engine.reload(config(OTHER, kind="keyword", timeout="5s", most=2))
    assert engine.wait(120)
    docs = [json.loads(d.document) for d in spark.read.parquet(str(tmp_path / "out" / "outbox")).collect()]
    got = sorted((d["flow"]["rule_id"], d["flow"]["id"], d["flow"]["finalization_reason"], d["flow"]["event_count"], d["flow"]["age_ms"], d["fields"].get("weight") if d.get("fields") else None) for d in docs if d["flow"]["id"] != "clock")
    assert got == [("letters", "l", "timeout", 1, 60_000, None), ("parcels", "p", "limit_exceeded", 2, 1000, "x"), ("parcels", "p", "timeout", 2, 30_000, 7)]
    lines = spark.read.text(str(tmp_path / "out" / "pass-through")).select("value").collect()
    assert sorted(r.value for r in lines) == ['{"junk": 1}', '{"junk": 2}']
    for _ in range(50):  # the listener hears of progress a little later
        if monitor.counts["events_total"] >= 9:
            break
        time.sleep(0.2)
    assert get(server, "/live")[0] == get(server, "/ready")[0] == 200 and get(server, "/nothing")[0] == 404
    assert "millrace_events_total" in get(server, "/metrics")[1] and "millrace_state_rows" in get(server, "/metrics")[1]
    monitor.accepting = lambda: False
    assert get(server, "/ready") == (503, "5")
    server.shutdown()
    spark.streams.removeListener(monitor)
