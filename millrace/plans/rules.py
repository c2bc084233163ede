"""Rules and their configuration: strict YAML, defaults, validation, content versions."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, fields, is_dataclass, replace
from pathlib import Path as File
from typing import Any

import yaml

from millrace.functions.paths import Path, PathError, compile_path
from millrace.functions.scalars import check_index, sha256_hex

PROMOTED_TYPES = ("long", "double", "keyword", "boolean", "date")
FIRST, LAST, FINALIZED = "first_event.timestamp", "last_event.timestamp", "finalized_at"
ALL_COMPLETE = "all_invocations_complete"


class ConfigError(ValueError):
    """A configuration that can't be used."""


@dataclass(frozen=True)
class Role:
    name: str
    types: tuple[str, ...]


@dataclass(frozen=True)
class Stitch:
    """How events of one call form an entry: by equal group values, in roles given by event types."""

    id: str
    group_by: tuple[Path, ...] = ()
    roles: tuple[Role, ...] = ()
    requires: tuple[str, ...] = ()

    @property
    def required(self) -> tuple[str, ...]:
        return self.requires or tuple(r.name for r in self.roles)

    @property
    def group_fields(self) -> tuple[str, ...]:
        """Names of the group's fields: last keys of the paths, numbered from the second of a name on."""
        seen: dict[str, int] = {}
        out = []
        for path in self.group_by:
            name = path.last_segment()
            seen[name] = seen.get(name, 0) + 1
            out.append(name if seen[name] == 1 else f"{name}{seen[name]}")
        return tuple(out)


@dataclass(frozen=True)
class Promotion:
    """A typed field lifted from events: of the first, the last, a role's, or by default the first that has it."""

    name: str
    path: Path
    type: str
    source: str = ""


@dataclass(frozen=True)
class Rule:
    id: str
    key: Path
    timeout_us: int
    index: str
    enabled: bool = True
    event_type: Path = Path()
    timestamp: Path = Path()
    stitches: tuple[Stitch, ...] = ()
    promotions: tuple[Promotion, ...] = ()
    close_when: str = ""
    settle_us: int = 0
    terminal_events: tuple[str, ...] = ()
    max_events: int = 0
    max_event_bytes: int = 0
    max_flow_bytes: int = 0
    output_timestamp: str = FIRST
    version: str = ""
    _required: dict[str, frozenset[str]] = field(default_factory=dict, init=False, repr=False, compare=False, hash=False)

    def stitch(self, stitch_id: str) -> Stitch:
        return next(s for s in self.stitches if s.id == stitch_id)

    def required(self, stitch_id: str) -> frozenset[str]:
        """Roles that make an invocation of the stitch complete."""
        if not self._required:
            self._required.update({s.id: frozenset(s.required) for s in self.stitches})
        return self._required[stitch_id]

    def to_json(self) -> str:
        """The whole rule, in the order it was given, as text that from_json reads."""

        def plain(x: Any) -> Any:
            if isinstance(x, Path):
                return x.expression
            if is_dataclass(x):
                return {f.name: plain(getattr(x, f.name)) for f in fields(x) if f.compare}
            return [plain(v) for v in x] if isinstance(x, tuple) else x

        return json.dumps(plain(self), ensure_ascii=False, separators=(",", ":"))

    @classmethod
    def from_json(cls, text: str) -> Rule:
        raw = json.loads(text)
        path = lambda x: compile_path(x) if x else Path()
        for name in ("key", "event_type", "timestamp"):
            raw[name] = path(raw[name])
        raw["stitches"] = tuple(Stitch(s["id"], tuple(map(path, s["group_by"])), tuple(Role(r["name"], tuple(r["types"])) for r in s["roles"]), tuple(s["requires"])) for s in raw["stitches"])
        raw["promotions"] = tuple(Promotion(p["name"], path(p["path"]), p["type"], p["source"]) for p in raw["promotions"])
        return cls(**raw | {"terminal_events": tuple(raw["terminal_events"])})

    def check(self) -> None:
        """Raises ConfigError if the rule contradicts itself."""
        for ok, why in ((self.id, "rule id is required"), (self.key, "correlation key is required"), (self.timeout_us > 0, "timeout must be positive"), (self.index, "output index is required")):
            if not ok:
                raise ConfigError(f"rule {self.id!r}: {why}")
        claimed: dict[str, str] = {}
        for stitch in self.stitches:
            names = {r.name for r in stitch.roles}
            for role in stitch.roles:
                for kind in role.types:
                    if kind in claimed:
                        raise ConfigError(f"rule {self.id!r}: event type {kind!r} is claimed by stitches {claimed[kind]!r} and {stitch.id!r}")
                    claimed[kind] = stitch.id
            for name in stitch.requires:
                if name not in names:
                    raise ConfigError(f"rule {self.id!r}: stitch {stitch.id!r} requires undeclared role {name!r}")
        declared = {r.name for s in self.stitches for r in s.roles}
        for p in self.promotions:
            if p.type not in PROMOTED_TYPES:
                raise ConfigError(f"rule {self.id!r}: promoted field {p.name!r} has unknown type {p.type!r}")
            if p.source not in ("", "first", "last") and p.source not in declared:
                raise ConfigError(f"rule {self.id!r}: promoted field {p.name!r} selects undeclared role {p.source!r}")

    def content(self) -> dict[str, Any]:
        """What the version is taken of: all settings, with lists sorted where order means nothing."""

        def plain(x: Any) -> Any:
            if isinstance(x, Path):
                return x.expression
            if is_dataclass(x):
                return {f.name: plain(getattr(x, f.name)) for f in fields(x) if f.compare and f.name != "version"}
            return [plain(v) for v in x] if isinstance(x, tuple) else x

        stitches = tuple(replace(s, roles=tuple(sorted((replace(r, types=tuple(sorted(r.types))) for r in s.roles), key=lambda r: r.name)), requires=tuple(sorted(s.requires))) for s in self.stitches)
        return plain(replace(self, stitches=stitches, promotions=tuple(sorted(self.promotions, key=lambda p: p.name)), terminal_events=tuple(sorted(self.terminal_events))))

    def versioned(self) -> Rule:
        return replace(self, version=sha256_hex(json.dumps(self.content(), sort_keys=True, ensure_ascii=False)))


_UNITS = {"ns": 0.001, "us": 1, "µs": 1, "ms": 1000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000}


def duration_us(text: str | int) -> int:
    """Microseconds of a duration such as 1m30s or 250ms."""
    if text in (0, "0", ""):
        return 0
    found = re.fullmatch(r"([+-]?)((?:\d+\.?\d*|\.\d+)(?:ns|us|µs|ms|s|m|h))+", str(text))
    if not found:
        raise ConfigError(f"invalid duration {text!r}")
    total = sum(float(n) * _UNITS[u] for n, u in re.findall(r"(\d+\.?\d*|\.\d+)(ns|us|µs|ms|s|m|h)", str(text)))
    return round(-total if str(text).startswith("-") else total)


#: Keys that each block may have, with defaults; durations are marked by their texts.
DEFAULTS: dict[str, dict[str, Any]] = {
    "server": {"address": ":8080", "read_timeout": "0", "write_timeout": "0", "shutdown_grace": "15s", "max_request_size": 4 << 20, "admin_token_env": ""},
    "state": {"driver": "memory", "path": "", "sync_writes": True},
    "passthrough": {"enabled": False, "index": "", "timestamp": "", "buffer_size": 10000, "batch_size": 500, "flush_interval": "1s"},
    "alerts": {"enabled": False, "index": "", "min_interval": "5m", "outbox_age_threshold": "5m"},
    "sinks": {},
    "observability": {"metrics_path": "/metrics", "log_level": "info", "log_format": "json"},
    "limits": {"max_open_flows": 0, "max_state_bytes": 0, "max_outbox_records": 0, "max_dlq_records": 10000, "max_event_bytes": 0},
}
SINK = {"addresses": [], "username_env": "", "password_env": "", "tls_skip_verify": False, "bulk_size": 64, "flush_interval": "1s", "max_retries": 8}
RULE_KEYS = {"id", "enabled", "extract", "correlation", "stitch", "promote", "lifecycle", "limits", "output"}
NESTED_KEYS = {"extract": {"event_type", "timestamp"}, "correlation": {"key"}, "lifecycle": {"timeout", "close_when", "settle", "terminal_events"}, "limits": {"max_events", "max_event_bytes", "max_flow_bytes"}, "output": {"index", "timestamp"}}


@dataclass(frozen=True)
class Config:
    rules: tuple[Rule, ...]
    server: dict[str, Any] = field(default_factory=dict)
    state: dict[str, Any] = field(default_factory=dict)
    passthrough: dict[str, Any] = field(default_factory=dict)
    alerts: dict[str, Any] = field(default_factory=dict)
    sink: dict[str, Any] = field(default_factory=dict)
    observability: dict[str, Any] = field(default_factory=dict)
    limits: dict[str, Any] = field(default_factory=dict)

    @property
    def enabled_rules(self) -> tuple[Rule, ...]:
        return tuple(r for r in self.rules if r.enabled)


def _known(block: Any, keys: set[str] | dict, where: str) -> dict:
    block = block or {}
    if not isinstance(block, dict):
        raise ConfigError(f"{where} must be a mapping")
    if unknown := set(block) - set(keys):
        raise ConfigError(f"{where}: unknown key {sorted(unknown)[0]!r}")
    return block


def rule_of(raw: dict) -> Rule:
    """A rule from its YAML mapping."""
    _known(raw, RULE_KEYS, "rule")
    name = raw.get("id", "")
    part = {k: _known(raw.get(k), keys, f"rule {name!r}: {k}") for k, keys in NESTED_KEYS.items()}

    def path(what: str, text: str, optional: bool = False) -> Path:
        if optional and not text:
            return Path()
        try:
            return compile_path(text or "")
        except PathError as e:
            raise ConfigError(f"rule {name!r}: {what}: {e}") from e

    stitches = []
    for s in raw.get("stitch") or []:
        _known(s, {"id", "group_by", "roles", "requires"}, f"rule {name!r}: stitch")
        roles = tuple(Role(k, (v,) if isinstance(v, str) else tuple(v)) for k, v in (s.get("roles") or {}).items())
        requires = tuple(s.get("requires") or ()) or tuple(r.name for r in roles)
        stitches.append(Stitch(s.get("id", ""), tuple(path("group_by", g) for g in s.get("group_by") or []), roles, requires))
    promotions = []
    for field_name, p in sorted((raw.get("promote") or {}).items()):
        _known(p, {"path", "type", "from"}, f"rule {name!r}: promote {field_name!r}")
        promotions.append(Promotion(field_name, path("promote", p.get("path", "")), p.get("type", ""), p.get("from", "")))
    life, limits, output = part["lifecycle"], part["limits"], part["output"]
    return Rule(
        id=name,
        key=path("correlation.key", part["correlation"].get("key", "")),
        timeout_us=duration_us(life.get("timeout", 0)),
        index=output.get("index", ""),
        enabled=bool(raw.get("enabled", False)),
        event_type=path("extract.event_type", part["extract"].get("event_type", ""), True),
        timestamp=path("extract.timestamp", part["extract"].get("timestamp", ""), True),
        stitches=tuple(stitches),
        promotions=tuple(promotions),
        close_when=life.get("close_when", ""),
        settle_us=duration_us(life.get("settle", 0)),
        terminal_events=tuple(life.get("terminal_events") or ()),
        max_events=limits.get("max_events", 0),
        max_event_bytes=limits.get("max_event_bytes", 0),
        max_flow_bytes=limits.get("max_flow_bytes", 0),
        output_timestamp=output.get("timestamp", ""),
    ).versioned()


def parse_config(text: str) -> Config:
    """A configuration from YAML text: unknown keys are errors, defaults filled in, everything checked."""
    raw = yaml.safe_load(text) or {}
    _known(raw, {*DEFAULTS, "rules"}, "config")
    blocks = {k: {**d, **{a: b for a, b in _known(raw.get(k), d, k).items() if b not in (None, "", 0) or k == "limits" and a != "max_dlq_records"}} for k, d in DEFAULTS.items() if k != "sinks"}
    sinks = _known(raw.get("sinks"), {"opensearch"}, "sinks")
    sink = {**SINK, **_known(sinks.get("opensearch"), SINK, "sinks.opensearch")}
    for name in ("bulk_size", "max_retries"):
        if sink[name] <= 0:
            sink[name] = SINK[name]
    config = Config(tuple(rule_of(r) for r in raw.get("rules") or []), blocks["server"], blocks["state"], blocks["passthrough"], blocks["alerts"], sink, blocks["observability"], blocks["limits"])
    check_config(config)
    return config


def load_config(file: str) -> Config:
    return parse_config(File(file).read_text(encoding="utf-8"))


def check_config(config: Config) -> None:
    """Raises ConfigError if settings or rules conflict."""

    def need(ok: object, why: str) -> None:
        if not ok:
            raise ConfigError(why)

    def index(pattern: str, what: str) -> None:
        try:
            check_index(pattern)
        except ValueError as e:
            raise ConfigError(f"{what}: {e}") from e

    need(config.rules, "at least one rule is required")
    need(config.limits["max_dlq_records"] >= 1, "limits.max_dlq_records must be greater than zero")
    through, alerts = config.passthrough, config.alerts
    if through["enabled"]:
        need(through["index"], "passthrough.index is required when passthrough is enabled")
        index(through["index"], "passthrough.index")
        if through["timestamp"]:
            try:
                compile_path(through["timestamp"])
            except PathError as e:
                raise ConfigError(f"passthrough.timestamp: {e}") from e
        need(1 <= through["batch_size"] <= through["buffer_size"] and duration_us(through["flush_interval"]) > 0, "passthrough sizes and interval must be positive, and batch_size must not exceed buffer_size")
    if alerts["enabled"]:
        need(alerts["index"], "alerts.index is required when alerts are enabled")
        index(alerts["index"], "alerts.index")
        need(duration_us(alerts["min_interval"]) > 0 and duration_us(alerts["outbox_age_threshold"]) > 0, "alerts.min_interval and alerts.outbox_age_threshold must be positive")
        need(not (through["enabled"] and alerts["index"] == through["index"]), "alerts.index must differ from passthrough.index")
    need(config.state["driver"] in ("memory", "pebble"), f"unsupported state.driver {config.state['driver']!r}")
    need(config.state["driver"] == "memory" or config.state["path"], "state.path is required for the durable driver")
    ids: set[str] = set()
    keys: dict[str, str] = {}
    promoted: dict[tuple[str, str], tuple[str, str]] = {}
    for rule in config.rules:
        index(rule.index, f"rule {rule.id!r}: output.index")
        need(not (alerts["enabled"] and rule.index == alerts["index"]), f"rule {rule.id!r} output.index must differ from alerts.index")
        need(rule.id not in ids, f"duplicate rule id {rule.id!r}")
        ids.add(rule.id)
        rule.check()
        for p in rule.promotions:
            owner, kind = promoted.setdefault((rule.index, p.name), (rule.id, p.type))
            need(kind == p.type, f"rules {owner!r} and {rule.id!r} promote field {p.name!r} to different types {kind!r} and {p.type!r} for output index {rule.index!r}")
        if rule.enabled:
            key = rule.key.canonical()
            need(key not in keys, f"correlation key path {key!r} is shared by enabled rules {keys.get(key)!r} and {rule.id!r}")
            keys[key] = rule.id


def reload_conflicts(old: Config, new: Config) -> list[str]:
    """Blocks that a running engine can't take over: all but rules and the log level."""
    differ = [b for b in ("server", "state", "passthrough", "alerts", "sink", "limits") if getattr(old, b) != getattr(new, b)]
    return differ + ["observability"] * ({**old.observability, "log_level": ""} != {**new.observability, "log_level": ""})
