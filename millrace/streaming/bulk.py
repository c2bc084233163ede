"""HTTP sink of newline-delimited bulk requests: documents by id, pass-through lines by position, alerts one by one.

A Bulk object is plain settings, so it travels to executors, where delivery.send() calls it. Each process goes round its
addresses. Answers are read up to a bound; neither their bodies nor producers' data appear in errors.
"""

from __future__ import annotations

import base64
import itertools
import json
import ssl
import urllib.error
import urllib.request
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from millrace.operators.delivery import BATCH_FAILED, Unsent, verdicts_by_place

#: Round of each process, shared by its sinks.
_turn = itertools.count()


class AlertFailed(RuntimeError):
    """An alert that wasn't taken; alerts are never sent again."""


@dataclass(frozen=True)
class Bulk:
    addresses: tuple[str, ...]
    username: str = ""
    password: str = ""
    timeout_s: float = 30.0
    max_answer: int = 16 << 20
    verify: bool = True

    def __call__(self, rows: Sequence[tuple[str, str, str]]) -> Iterator[tuple[str, int, str | None]]:
        """Answers (id, status, error type) to documents (id, index, JSON), by the ids that the answer names. Records that it
        leaves out have none, which delivery counts as retryable; a failed request is every record's answer."""
        if not rows:
            return
        status, items = self._post(line for i, index, document in rows for line in (_action(index, i), document))
        if items is None:
            yield from ((i, status, None if status != BATCH_FAILED else "transport") for i, _, _ in rows)
            return
        known = {i for i, _, _ in rows}
        for item in items:
            if item.get("_id") in known:
                error = item.get("error")
                yield item["_id"], int(item.get("status") or BATCH_FAILED), error.get("type") if isinstance(error, dict) else None

    def verbatim(self, rows: Sequence[tuple[str, str]]) -> list[int]:
        """Status of each line (index, text), by its place in the answer; the index gives identities."""
        status, items = self._post(line for index, text in rows for line in (_action(index), text)) if rows else (200, [])
        if items is None:
            return [status] * len(rows)
        found = [int(item.get("status") or BATCH_FAILED) for item in items[: len(rows)]]
        return found + [BATCH_FAILED] * (len(rows) - len(found))

    def alert(self, index: str, document: str) -> None:
        """Writes one diagnostic document without an id; AlertFailed if it wasn't taken."""
        status, items = self._post([_action(index), document])
        if items:
            status = int(items[0].get("status") or BATCH_FAILED)
        if items is not None and not items or not 200 <= status < 300:
            raise AlertFailed(f"alert was answered with status {status}")

    def _post(self, lines: Iterable[str]) -> tuple[int, list[dict] | None]:
        """Status of the request, and the answer's items if it was well-formed and the request taken."""
        if not self.addresses:
            return BATCH_FAILED, None
        address = self.addresses[next(_turn) % len(self.addresses)].rstrip("/") + "/_bulk"
        headers = {"Content-Type": "application/x-ndjson"}
        if self.username or self.password:
            headers["Authorization"] = "Basic " + base64.b64encode(f"{self.username}:{self.password}".encode()).decode()
        context = None
        if address.startswith("https:"):
            context = ssl.create_default_context()
            context.minimum_version = ssl.TLSVersion.TLSv1_2
            if not self.verify:
                context.check_hostname, context.verify_mode = False, ssl.CERT_NONE
        body = "".join(f"{line}\n" for line in lines).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(address, body, headers, method="POST"), timeout=self.timeout_s, context=context) as answer:
                raw = answer.read(self.max_answer + 1)
        except urllib.error.HTTPError as e:
            e.close()
            return e.code, None
        except (OSError, ValueError):
            return BATCH_FAILED, None
        try:
            items = json.loads(raw)["items"] if len(raw) <= self.max_answer else None
            return 200, [next(iter(x.values()), {}) for x in items]
        except (ValueError, TypeError, KeyError, AttributeError):
            return BATCH_FAILED, None


def _action(index: str, output_id: str | None = None) -> str:
    """The line that says where the next one belongs."""
    return json.dumps({"index": {"_index": index} if output_id is None else {"_id": output_id, "_index": index}})


class BufferFull(RuntimeError):
    """More lines wait than the buffer may hold: the batch fails and its source offers it again later."""


def to_bulk(unclaimed: DataFrame, sink: Bulk, folder: str, checkpoint: str, batch_size: int = 500, buffer_size: int = 10_000, flush_interval: str = "1 second") -> DataStreamWriter:
    """Pass-through events of a stream, byte for byte. What the sink can't take yet waits below folder/waiting=N, for batch N + 1; what it
    rejects for good is dropped and counted in folder/dropped=N. With buffer_size lines waiting, a batch is refused (BufferFull), so the
    stream stops and its source keeps what it has: start it again when the sink is back."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("index", "raw")
        earlier = Unsent(spark, folder).read(number)
        waiting = earlier.count()
        if waiting and waiting + rows.count() > buffer_size:
            raise BufferFull(f"{waiting} pass-through events wait for the sink")
        answered = verdicts_by_place(earlier.unionByName(rows), sink.verbatim, batch_size)
        Unsent(spark, folder).write(answered, number)

    return unclaimed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=flush_interval)
