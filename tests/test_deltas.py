"""Viewers kept by deltas: equal to recomputation at every tick, and what a tick reads."""

import random
from datetime import timedelta

import pytest
from helpers import T0
from pyspark.sql import functions as F

from spanforge.adapters import text_attrs
from spanforge.operators import viewers
from spanforge.operators.viewers import compile_viewer
from spanforge.streaming import deltas

BASE = "batch int, signal string, observed_at timestamp, service_name string, payload_text string, stream_ms long, stream_seq long, value double"


def made(id, mask=7, lookback=60_000, revision=1, **body):
    return compile_viewer({"id": id, "signal_mask": mask, "lookback_ms": lookback, "revision": revision, "definition_json": body})


class World:
    """Batches of entries that come over time, some of them late."""

    def __init__(self, spark, root, seed=1, batches=14, slot_ms=5_000):
        r = random.Random(seed)
        self.rows, self.spark, self.root, self.slot_ms = [], spark, root, slot_ms
        for b in range(batches):
            for i in range(30):
                at = T0 + timedelta(milliseconds=10_000 * b + r.randrange(-8_000, 10_000))
                signal = r.choice(("metrics", "metrics", "logs", "traces"))
                value = r.choice((None, 1.5, r.randrange(9) / 4)) if signal == "metrics" else None
                self.rows.append((b, signal, at, r.choice(("a", "b", None)), f"{signal} n {r.randrange(9)}", int(at.timestamp() * 1000), len(self.rows), value))
        frame = spark.createDataFrame(self.rows, BASE)
        is_metric = F.col("signal") == "metrics"
        self.frame = frame.select(
            *(c for c in frame.columns if c != "value"),
            F.when(is_metric, F.array(F.struct(F.concat(F.lit("m"), F.col("stream_seq") % 2).alias("name"), F.col("value").alias("value"), F.lit(0).alias("rs")))).alias("metrics"),
            F.when(is_metric, F.array(text_attrs(k8s__pod__name=F.concat(F.lit("pod-"), (F.col("stream_seq") % 3).cast("string"))))).alias("resources"),
            F.to_date("observed_at").alias("day"),
        ).persist()

    def entries(self, numbers, first_day=None):
        rows = self.frame.where(F.col("batch").isin(numbers))
        return rows if first_day is None else rows.where(F.col("day") >= F.lit(first_day))

    def store(self):
        return deltas.Deltas(self.spark, self.root, self.entries, self.slot_ms)

    def expected(self, v, landed, now):
        live = viewers.matching(v, self.entries(landed), now)
        return rows_of(v, viewers.aggregate(v.aggregation, live) if v.aggregation else viewers.newest(live)), live.count()


def rows_of(v, df):
    return [(r.bucket_start_ms, list(r.group_keys), round(r.value, 9)) for r in df.collect()] if v.aggregation else [(r.stream_seq, r.payload_text) for r in df.collect()]


def tick(store, known, landed, now):
    store.advance(known, landed, now)


def check(world, store, known, landed, now):
    counts = {r.viewer_id: r["count"] for r in store.counts().collect()}
    for v in known:
        rows, n = world.expected(v, landed, now)
        assert rows_of(v, store.results(v)) == rows and counts.get(v.id, 0) == n, v.id


AGGS = [
    made("p95", 2, 30_000, aggregation={"fn": "p95", "bucket_ms": 7_000, "group_by": ["service_name", "k8s.pod.name"]}),
    made("sum", 2, 45_000, aggregation={"fn": "sum", "bucket_ms": 10_000, "metric_name": "m1"}),
    made("avg", 7, 20_000, query="n 1", aggregation={"fn": "avg", "bucket_ms": 3_000}),
    made("rate", 5, 60_000, aggregation={"fn": "rate", "bucket_ms": 60_000, "group_by": ["service_name"]}),
    made("rows", 4, 15_000),
    made("shown", 7, 200_000, filters=[{"field": "service_name", "op": "eq", "value": "A"}]),
]


def test_every_tick_equals_recomputation(spark, tmp_path, monkeypatch):
    """Late entries, look-backs of all lengths, merges, a restart, an idle end."""
    monkeypatch.setattr(deltas, "FAN_IN", 2)
    world, now = World(spark, str(tmp_path), batches=6), T0
    store = world.store()
    for b in range(6):
        now = T0 + timedelta(seconds=10 * (b + 1))
        if b == 4:
            store = world.store()
        tick(store, AGGS, list(range(b + 1)), now)
        if b in (2, 5):
            check(world, store, AGGS, list(range(b + 1)), now)
    for idle in (17, 400):
        now += timedelta(seconds=idle)
        tick(store, AGGS, list(range(6)), now)
        check(world, store, AGGS, list(range(6)), now)
    assert store.manifest.slots == {} and max(level for level, _ in store.manifest.runs) >= 2
    assert store.state().count() == 0


def test_a_steady_tick_reads_what_came_and_what_left(spark, tmp_path):
    world = World(spark, str(tmp_path), batches=10)
    store, known = world.store(), AGGS[1:4]
    for b in range(10):
        now = T0 + timedelta(seconds=10 * (b + 1))
        tick(store, known, list(range(b + 1)), now)
        if b > 7:
            entries = [n for n in store.was_read if n.startswith("entries/")]
            slots = {int(n.rsplit("=", 1)[1]) for n in store.was_read if "/slot=" in n}
            ms = int(now.timestamp() * 1000)
            passed = {s for v in known for s in range((ms - 10_000 - v.lookback_ms) // 5_000, (ms - v.lookback_ms) // 5_000 + 1)}
            assert entries == [f"entries/batch={b}"] and slots <= passed and not any(n.startswith("runs/") for n in store.was_read if b % deltas.FAN_IN != deltas.FAN_IN - 1)
    held = store.manifest
    tick(store, known, list(range(10)), T0 + timedelta(seconds=100))
    assert store.manifest is held and store.was_read == []  # nothing moved, nothing is written


def test_cursors_revisions_and_failures(spark, tmp_path, monkeypatch):
    world = World(spark, str(tmp_path))
    store, now = world.store(), T0 + timedelta(seconds=50)
    first, second = AGGS[3], AGGS[4]
    tick(store, [first], [0, 1, 2], now)
    assert store.cursor("rate")["batch"] == 2 and len(store.cursor("rate")["logs"]) == 2 and "metrics" not in store.cursor("rate")

    # A tick that fails half-way is made again; what it left counts nowhere.
    with monkeypatch.context() as m:
        m.setattr(deltas.Deltas, "_commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            tick(store, [first], [0, 1, 2, 3], now)
    store = world.store()
    assert store.cursor("rate")["batch"] == 2
    tick(store, [first], [0, 1, 2, 3], now)
    check(world, store, [first], [0, 1, 2, 3], now)

    # A viewer that comes later reads its look-back, the other one only what is new to it.
    tick(store, [first, second], [0, 1, 2, 3, 4], now)
    assert [n for n in store.was_read if n.startswith("entries/")] == [f"entries/batch={b}" for b in (0, 1, 2, 3, 4, 4)]
    check(world, store, [first, second], [0, 1, 2, 3, 4], now)

    # After a restart the cursor holds for the same revision; a revision that only renames takes the state over.
    store = world.store()
    assert store.knows(first) and not store.knows(made("rate", 5, 60_000, 2, aggregation=first.aggregation.to_json()))
    renamed = made("rate", 5, 60_000, 2, aggregation=first.aggregation.to_json())
    store.rename(renamed)
    assert store.knows(renamed) and world.store().knows(renamed)
    other = made("rate", 5, 60_000, 3, query="n 2", aggregation=first.aggregation.to_json())
    store.rename(other)
    assert not store.knows(other)
    tick(store, [other, second], [0, 1, 2, 3, 4], now)
    check(world, store, [other, second], [0, 1, 2, 3, 4], now)
    # The clock does not go back.
    tick(store, [other, second], [0, 1, 2, 3, 4, 5], now - timedelta(seconds=30))
    check(world, store, [other, second], [0, 1, 2, 3, 4, 5], now)
    # One that asks again for what it asked before begins anew.
    tick(store, [renamed, second], [0, 1, 2, 3, 4, 5], now)
    check(world, store, [renamed, second], [0, 1, 2, 3, 4, 5], now)
    store.forget("rows")
    assert store.cursor("rows") is None and world.store().cursor("rows") is None
