"""The running engine: a configuration's streams, their reload, and their state of health.

An Engine owns the queries of one configuration: flows to an outbox, pass-through to its sink. Reloading stops the queries, takes the new
rules and starts them again from their checkpoints: open flows end under the rules they began with, new ones begin under
the new. Settings that a running engine can't take over are refused, and the old rules go on.
"""

from __future__ import annotations

import json
import os
import threading
from collections import Counter
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from millrace.operators import log
from millrace.operators.route import pass_through, route
from millrace.plans.rules import Config, ConfigError, parse_config, reload_conflicts
from millrace.streaming import sinks
from millrace.streaming.bulk import Bulk, to_bulk
from millrace.streaming.flows import stream_flows


class Engine:
    def __init__(self, spark: SparkSession, config: Config, events: Callable[[], DataFrame], folder: str, watermark: str | None = None, trigger: dict | None = None):
        """events: makes the stream of accepted events; folder: holds outbox, pass-through and checkpoints; trigger: of all queries."""
        self.spark, self.config, self.events, self.folder, self.watermark, self.trigger = spark, config, events, folder, watermark, trigger
        self.queries: list[StreamingQuery] = []
        log.configure(config.observability["log_level"], config.observability["log_format"])

    def start(self) -> None:
        rules = list(self.config.enabled_rules)
        routed = route(self.events(), rules)
        writers = [sinks.to_outbox(stream_flows(routed, rules, self.watermark), f"{self.folder}/outbox", f"{self.folder}/checkpoints/flows")]
        through = self.config.passthrough
        if through["enabled"]:
            lines = pass_through(routed, through["index"], through["timestamp"])
            where = f"{self.folder}/checkpoints/pass-through"
            if self.config.sink["addresses"]:
                writers.append(to_bulk(lines, self.bulk(), f"{self.folder}/pass-through", where, through["batch_size"], through["buffer_size"]))
            else:
                writers.append(sinks.to_lines(lines, f"{self.folder}/pass-through", where))
        self.queries = [(w.trigger(**self.trigger) if self.trigger else w).start() for w in writers]
        for r in rules:
            log.note("info", "rule in use", rule_id=r.id, rule_version=r.version)

    def bulk(self) -> Bulk:
        """The configuration's HTTP sink; user and password come from the environment variables that it names."""
        sink = self.config.sink
        user, word = (os.environ.get(sink[k], "") if sink[k] else "" for k in ("username_env", "password_env"))
        return Bulk(tuple(sink["addresses"]), user, word, verify=not sink["tls_skip_verify"])

    def stop(self) -> None:
        for q in self.queries:
            q.stop()
        self.queries = []

    def wait(self, seconds: float) -> bool:
        """Whether all queries ended (with a trigger that ends) in this time each."""
        return all([q.awaitTermination(int(seconds)) for q in self.queries])

    def reload(self, text: str) -> None:
        """Takes a new configuration over; ConfigError, and nothing changes, if it is wrong or differs where a running engine can't follow."""
        fresh = parse_config(text)
        if differ := reload_conflicts(self.config, fresh):
            raise ConfigError(f"these settings need a restart: {', '.join(differ)}")
        self.stop()
        self.config = fresh
        log.configure(fresh.observability["log_level"], fresh.observability["log_format"])
        self.start()


class Monitor(StreamingQueryListener):
    """Counts what the session's queries report, and serves it: /metrics as text lines, /live always, /ready while no query failed and
    `accepting` says so."""

    def __init__(self, accepting: Callable[[], bool] = lambda: True):
        self.counts: Counter[str] = Counter()
        self.gauges: dict[str, float] = {}
        self.failed, self.accepting = False, accepting

    def onQueryStarted(self, event) -> None:
        self.counts["queries_started_total"] += 1

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.counts["batches_total"] += 1
        self.counts["events_total"] += p.numInputRows
        for s in p.stateOperators:
            self.gauges["state_rows"] = s.numRowsTotal
            self.gauges["state_bytes"] = s.memoryUsedBytes
            self.counts["late_events_total"] += s.numRowsDroppedByWatermark
        log.note("debug", "batch done", batch=p.batchId, count=p.numInputRows, duration_ms=(p.durationMs or {}).get("triggerExecution"))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.counts["queries_ended_total"] += 1
        if event.exception:
            self.failed = True
            self.counts["queries_failed_total"] += 1
            log.note("error", "query failed", error=event.exception.splitlines()[0][:200])

    def text(self) -> str:
        rows = {**dict(self.counts), **self.gauges}
        return "".join(f"millrace_{k} {v:g}\n" for k, v in sorted(rows.items()))

    def serve(self, port: int = 0) -> ThreadingHTTPServer:
        """Begins to answer on a local port; shutdown() ends it."""
        monitor = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self) -> None:
                ready = not monitor.failed and monitor.accepting()
                status, body = {"/metrics": (200, monitor.text()), "/live": (200, "{}"), "/ready": (200 if ready else 503, json.dumps({"ready": ready}))}.get(self.path, (404, ""))
                self.send_response(status)
                if status == 503:
                    self.send_header("Retry-After", "5")
                self.end_headers()
                self.wfile.write(body.encode())

            def log_message(self, *args) -> None:
                pass

        server = ThreadingHTTPServer(("127.0.0.1", port), Handler)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        return server
