import pytest

from millrace.functions.scalars import IndexPatternError, check_index, index_wildcard
from millrace.plans.rules import ConfigError, duration_us, parse_config, reload_conflicts
from millrace.plans.templates import promoted_schema, templates

RULE = """
  - id: {id}
    enabled: {enabled}
    extract: {{event_type: $.kind, timestamp: $.when}}
    correlation: {{key: {key}}}
    stitch:
      - id: sale
        group_by: [$.branch, $.till.no, $.clerk.no]
        roles: {{opened: sale.opened, settled: [sale.paid, sale.refused]}}
    promote:
      total: {{path: $.receipt.total, type: {kind}, from: settled}}
    lifecycle: {{timeout: 30s, close_when: all_invocations_complete, terminal_events: [done]}}
    limits: {{max_events: 64}}
    output: {{index: "baskets-{{yyyy}}.{{MM}}.{{dd}}", timestamp: first_event.timestamp}}
"""


def config(*rules, more=""):
    return "rules:" + "".join(RULE.format(**{"id": "a", "enabled": "true", "key": "$.basket", "kind": "long", **r}) for r in rules) + more


def test_rule_is_read():
    c = parse_config(config({}))
    rule = c.rules[0]
    assert rule.timeout_us == 30_000_000 and rule.stitches[0].required == ("opened", "settled")
    assert rule.stitches[0].group_fields == ("branch", "no", "no2") and len(rule.version) == 64
    assert c.limits["max_dlq_records"] == 10000 and c.sink["bulk_size"] == 64 and c.passthrough["buffer_size"] == 10000


def test_version_ignores_order_where_it_means_nothing():
    a = parse_config(config({})).rules[0].version
    assert a == parse_config(config({}).replace("[sale.paid, sale.refused]", "[sale.refused, sale.paid]")).rules[0].version
    assert a != parse_config(config({}).replace("[$.branch, $.till.no", "[$.till.no, $.branch")).rules[0].version


@pytest.mark.parametrize(
    "text,why",
    [
        ("rules: []", "at least one rule"),
        (config({}, {"key": "$.other"}), "duplicate rule id"),
        (config({}, {"id": "b", "key": "flow"}), "path"),
        (config({}, {"id": "b"}), "shared by enabled rules"),
        (config({}, {"id": "b", "key": "$.other", "kind": "keyword"}), "different types"),
        (config({"kind": "text"}), "unknown type"),
        (config({}).replace("from: settled", "from: nobody"), "undeclared role"),
        (config({}).replace("timeout: 30s", "timeout: 0s"), "timeout"),
        (config({}).replace("{dd}", "{hh}"), "unknown placeholder"),
        (config({}).replace("limits:", "limitz:"), "unknown key"),
        (config({}).replace("sale.refused]", "sale.opened]"), "claimed"),
        (config({}, more="passthrough: {enabled: true}"), "passthrough.index"),
        (config({}, more='passthrough: {enabled: true, index: x, batch_size: 5, buffer_size: 2}'), "batch_size"),
        (config({}, more='alerts: {enabled: true, index: "baskets-{yyyy}.{MM}.{dd}"}'), "must differ"),
        (config({}, more="state: {driver: redis}"), "state.driver"),
        (config({}, more="limits: {max_dlq_records: -1}"), "max_dlq_records"),
    ],
)
def test_conflicts(text, why):
    with pytest.raises(ConfigError, match=why):
        parse_config(text)


def test_disabled_rules_may_share_a_key():
    assert len(parse_config(config({}, {"id": "b", "enabled": "false"})).enabled_rules) == 1


def test_durations_and_reload():
    assert [duration_us(d) for d in ("1m30s", "250ms", "1.5h", 0)] == [90_000_000, 250_000, 5_400_000_000, 0]
    with pytest.raises(ConfigError):
        duration_us("5 parsecs")
    old = parse_config(config({}))
    assert reload_conflicts(old, parse_config(config({"id": "z"}, more="observability: {log_level: debug}"))) == []
    assert reload_conflicts(old, parse_config(config({}, more="limits: {max_open_flows: 5}"))) == ["limits"]


def test_index_patterns():
    for bad in ("a-{yyyy", "a-{}", "a}b", "a-{day}"):
        with pytest.raises(IndexPatternError):
            check_index(bad)
    assert index_wildcard("a-{yyyy}.{MM}.{dd}") == "a-*" and index_wildcard("plain") == "plain"


def test_templates():
    rules = parse_config(config({})).rules
    made = templates(rules, "alerts-{yyyy}")
    assert [t["index"] for t in made] == ["alerts-{yyyy}", "baskets-{yyyy}.{MM}.{dd}"]
    body = made[1]["template"]
    assert body["index_patterns"] == ["baskets-*"] and body["priority"] == 100
    p = body["template"]["mappings"]["properties"]
    assert p["fields"]["properties"] == {"total": {"type": "long"}} and set(p["events"]["properties"]["group"]["properties"]) == {"branch", "no", "no2"}
    assert p["events"]["properties"]["opened"]["properties"]["event"] == {"type": "flat_object"}
    assert promoted_schema(rules).simpleString() == "struct<total:bigint>"
