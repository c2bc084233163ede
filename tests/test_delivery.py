from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import delivery as d

T0 = datetime(2026, 1, 1, tzinfo=UTC)
SCHEMA = "output_id string, index string, document string, created_at timestamp, attempts int, replay_count int, last_error string, rejection_type string, next_attempt_at timestamp"


def box(spark, *ids, **more):
    rows = [{"output_id": i, "index": "x", "document": "{}", "created_at": T0 + timedelta(seconds=k), "attempts": 0, "replay_count": 0, "last_error": None, "rejection_type": None, "next_attempt_at": None, **more} for k, i in enumerate(ids)]
    return spark.createDataFrame(rows, SCHEMA)


def now():
    return F.lit(T0 + timedelta(hours=1)).cast("timestamp")


def test_round(spark):
    outbox = box(spark, "a", "b", "c", "d", "e")
    answers = {"a": (200, None), "b": (429, None), "c": (400, "mapper_parsing_exception"), "d": (403, "cluster_block_exception")}

    def sink(rows):
        return [(i, *answers[i]) for i, _, _ in rows if i in answers]

    batch = d.pending(outbox, now())
    out = d.settled(batch, d.send(batch, sink), now())
    assert {r.output_id: r.disposition for r in out.collect()} == {"a": "delivered", "b": "retryable", "c": "permanent", "d": "retryable", "e": "retryable"}
    dead = spark.createDataFrame([], SCHEMA + ", dead_lettered_at timestamp")
    left, kept, dropped = d.resolved(outbox, dead, out, now())
    assert sorted(r.output_id for r in left.collect()) == ["b", "d", "e"]
    assert [(r.output_id, r.rejection_type) for r in kept.collect()] == [("c", "mapper_parsing_exception")] and dropped.count() == 0
    assert d.ready(left, now()).count() == 0  # each waits its delay
    back, gone = d.replayed(left, kept, d.selected(kept, reason="mapper_parsing_exception"))
    assert gone.count() == 0 and [(r.attempts, r.replay_count) for r in back.where("output_id = 'c'").collect()] == [(0, 1)]
    assert "document" not in d.metadata(kept).columns


def test_retry_limit(spark):
    full = box(spark, "a", attempts=8)
    (r,) = d.settled(full, spark.createDataFrame([("a", 503, None)], "output_id string, status int, error_type string"), now()).collect()
    assert (r.disposition, r.rejection_type) == ("permanent", "retry_limit_exceeded")


def test_delays_grow_to_the_cap(spark):
    from millrace.functions.scalars import retry_delay_ms

    df = spark.range(1, 13).select(F.col("id").alias("n"), retry_delay_ms(F.lit("some-id"), F.col("id")).alias("ms"))
    ms = [r.ms for r in df.orderBy("n").collect()]
    assert all(0.75 * 1000 * 2**k <= m <= 1000 * 2**k for k, m in enumerate(ms[:9]))
    assert ms == sorted(ms) and ms[9:] == [ms[9]] * 3 and 256_000 <= ms[9] <= 300_000


def test_retention_pages_and_upsert(spark):
    dead = box(spark, *"abcdef").withColumn("dead_lettered_at", F.col("created_at"))
    kept, dropped = d.retained(dead, 2)
    assert sorted(r.output_id for r in kept.collect()) == ["e", "f"] and dropped.count() == 4
    first, cursor = d.page(dead, limit=4)
    assert [r.output_id for r in first.collect()] == list("abcd") and cursor() == "d"
    last, cursor = d.page(dead, cursor="d", limit=4)
    assert [r.output_id for r in last.collect()] == ["e", "f"] and cursor() is None
    with pytest.raises(ValueError):
        d.page(dead, limit=501)
    twice = d.enqueue(box(spark, "a", attempts=3), box(spark, "a", "b").select("output_id", "index", "document", "created_at"))
    assert sorted((r.output_id, r.attempts) for r in twice.collect()) == [("a", 0), ("b", 0)]
    assert d.refuses(10, 0, 10, 0) and d.refuses(0, 5, 0, 5) and not d.refuses(9, 9, 10, 0)


def test_alerts(spark):
    seen = [(T0, 1, 0, 0, 0.0), *[(T0 + timedelta(seconds=25 * k), 1, 0, 0, 0.0) for k in range(1, 12)], (T0 + timedelta(minutes=5), 1, 0, 3, 360.0), (T0 + timedelta(minutes=6), 0, 0, 0, 0.0)]
    df = spark.createDataFrame(seen, "at timestamp, dead_letters int, dropped int, outbox int, oldest_age_s double")
    got = [(r.kind, r.state, (r.at.minute, r.at.second)) for r in d.alerts(df).orderBy("kind", "at").collect()]
    assert got == [("dlq", "starting", (0, 0)), ("dlq", "ongoing", (5, 0)), ("dlq", "clearing", (6, 0)), ("outbox_backlog", "starting", (5, 0)), ("outbox_backlog", "clearing", (6, 0))]
