"""Streams whose entries are taken back by the clock."""

import math
import random
import struct
import time
from datetime import datetime, timedelta, timezone

import pytest
from helpers import T0
from pyspark.sql import functions as F

from spanforge.operators.viewers import Aggregation
from spanforge.streaming import live

SCHEMA = "observed_at timestamp, group_key string, value double"


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def land(spark, path, n, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/b{n:04d}")


def recorded(changes, tmp_path, **trigger):
    out = str(tmp_path / "out")

    def keep(df, number):
        df.select("*", F.lit(number).alias("batch"), F.monotonically_increasing_id().alias("step")).write.mode("overwrite").parquet(f"{out}/at={number}")

    return changes.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(**trigger).start()


def state(spark, tmp_path):
    rows = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out"))
    return {(r.group_key, r.bucket_start_ms): (r.n, r.value) for r in live.final_state(rows).collect()}


def recompute(rows, agg, bound):
    found = {}
    for t, key, v in rows:
        ms = int(t.timestamp() * 1000)
        if ms > bound and (v is not None or agg.fn in ("count", "rate")):
            found.setdefault((key, ms - ms % agg.bucket_ms), []).append(v)
    rank = lambda p: lambda v: sorted(v, key=live.place)[math.ceil(p * len(v)) - 1]
    made = {"count": lambda v: float(len(v)), "rate": lambda v: len(v) / (agg.bucket_ms / 1000), "sum": math.fsum, "avg": lambda v: math.fsum(v) / len(v)}.get(agg.fn) or rank(int(agg.fn[1:]) / 100)
    return {k: (len(v), made(v)) for k, v in found.items()}


@pytest.mark.parametrize("fn", ("sum", "p95", "count"))
def test_random_arrival_and_restart(spark, tmp_path, fn):
    """Late, repeated and missing values in any order, two runs from one checkpoint: as recomputation gives it, to the last bit."""
    r = random.Random(fn)
    rows = [(T0 + timedelta(milliseconds=r.randrange(40_000)), r.choice(("a", "b", None)), r.choice((None, 0.1, -0.0, 0.0, 1e-300, 1e15, r.gauss(0, 1e3)))) for _ in range(300)]
    rows.sort(key=lambda x: x[0] + timedelta(milliseconds=r.randrange(6_000)))
    rows += [(T0 + timedelta(seconds=41), "c", 7.0)]
    agg, path = Aggregation(fn, 5_000), str(tmp_path / "in")
    for n, part in enumerate((rows[:90], rows[90:180], rows[180:])):
        land(spark, path, n, part)
        if n:  # the second run goes on from the first one's checkpoint
            q = recorded(live.live_buckets(stream(spark, path), agg, 12_000), tmp_path, availableNow=True)
            q.awaitTermination()
            assert q.exception() is None
    assert state(spark, tmp_path) == recompute(rows, agg, int(T0.timestamp() * 1000) + 41_000 - 12_000)


def test_idle_keys_empty_by_the_clock(spark, tmp_path):
    """No new row comes: the wall clock alone takes the bucket back, first in part."""
    path, now = str(tmp_path / "in"), datetime.now(timezone.utc)
    land(spark, path, 0, [(now + timedelta(seconds=s), "idle", 1.0) for s in (-600, 20, 20, 26)])
    q = recorded(live.live_buckets(stream(spark, path), Aggregation("sum", 3_600_000 * 24 * 400), 1_000, clock="processing"), tmp_path, processingTime="500 milliseconds")
    seen, end = [], time.time() + 90
    try:
        while time.time() < end and (not seen or seen[-1]):
            time.sleep(0.3)
            assert q.exception() is None
            try:
                now_held = sum(n for n, _ in state(spark, tmp_path).values())
            except Exception:  # nothing written yet, or a batch half-way
                continue
            if not seen and not now_held or seen and seen[-1] == now_held:
                continue
            seen.append(now_held)
    finally:
        q.stop()
    assert seen[0] == 3 and seen[-1] == 0 and seen == sorted(seen, reverse=True)


def test_sums_and_order_of_doubles():
    r = random.Random(1)
    values = [struct.unpack("<d", r.randbytes(8))[0] for _ in range(2000)]
    values = [v for v in values if math.isfinite(v) and abs(v) < 1e300] + [0.0, -0.0, 5e-324, -5e-324]
    total = sum(live.exact(v) for v in values)
    assert live.inexact(total) == math.fsum(values) and total - sum(live.exact(v) for v in reversed(values)) == 0
    assert sorted(values, key=live.place) == sorted(values) and live.place(-0.0) == live.place(0.0)
    assert live.place(math.nan) > live.place(math.inf) > live.place(1e308) and live.place(-math.inf) < live.place(-1e308)
    with pytest.raises(ValueError):
        live.live_buckets(None, Aggregation("sum", 1), 1, clock="moon")
