"""Structured log of the engine: one line per event, as JSON or text, with a level that can change while it runs.

Lines hold names, counts and reasons of the engine; producers' data (documents, keys, texts) never goes in.
"""

from __future__ import annotations

import json
import logging
import sys
from datetime import UTC, datetime

LOG = logging.getLogger("millrace")
#: What a line may carry beside its message.
FIELDS = frozenset({"rule_id", "rule_version", "reason", "index", "batch", "count", "status", "kind", "state", "error", "duration_ms"})


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        at = datetime.fromtimestamp(record.created, UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        return json.dumps({"time": at, "level": record.levelname, "msg": record.getMessage(), **getattr(record, "fields", {})}, default=str)


class TextLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return " ".join([record.levelname, record.getMessage(), *(f"{k}={v}" for k, v in getattr(record, "fields", {}).items())])


def configure(level: str = "info", form: str = "json", stream=None) -> None:
    """Sets level and form; called again, it changes them."""
    handler = logging.StreamHandler(stream or sys.stderr)
    handler.setFormatter(JsonLines() if form == "json" else TextLines())
    LOG.handlers[:] = [handler]
    LOG.propagate = False
    LOG.setLevel(level.upper())


def note(level: str, message: str, **fields: object) -> None:
    """Writes a line; fields outside FIELDS are an error, so that no producer data slips in."""
    if unknown := set(fields) - FIELDS:
        raise ValueError(f"not a field of the log: {sorted(unknown)[0]}")
    LOG.log(logging.getLevelName(level.upper()), message, extra={"fields": fields})
