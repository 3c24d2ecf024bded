"""Bucket aggregations over a stream with clock-driven retraction.

``live_buckets`` keeps state by (group, bucket), so a group's state is spread over its buckets, and a batch reads and
writes only the buckets that it meets.  A bucket holds its count, an exact sum, for percentiles the counts of its
values in order, and, by slots of time, what each slot put in.  A timer for each slot takes the slot off again when
its entries leave the look-back: no new row of the group is needed for that, so idle groups empty as the clock goes on.

The clock is the wall clock (``processing``), or the newest event of the whole stream (``event``), for replays of
history.  An entry counts while its time is above the clock less the look-back; the bound itself is out.

Sums are whole numbers of 2**-1074, so what is taken off leaves exactly what recomputation would give, whatever the
order of arrival.  Values are ordered by their bits, as numbers are and with NaN last; the order is kept in two
levels, counts by the upper sixteen bits and below each of these its values, so a percentile reads the upper counts
and one list, and a new value writes one list.
"""

from __future__ import annotations

import math
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.viewers import Aggregation

CHANGES = "group_key string, bucket_start_ms long, n long, value double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SHIFT = 1074


def exact(value: float) -> int:
    """A finite double as a whole number of 2**-1074."""
    top, bottom = value.as_integer_ratio()
    return top << (_SHIFT - (bottom.bit_length() - 1))


def inexact(total: int) -> float:
    """The double next to a whole number of 2**-1074."""
    try:
        return total / (1 << _SHIFT)
    except OverflowError:
        return math.inf if total > 0 else -math.inf


def place(value: float) -> int:
    """The rank of a double among all doubles, from 0, with NaN last; -0.0 is 0.0."""
    if value != value:
        return (1 << 64) - 1
    bits = struct.unpack("<Q", struct.pack("<d", value + 0.0))[0]
    return bits ^ ((1 << 64) - 1 if bits >> 63 else 1 << 63)


def nearest_rank(p: float, n: int) -> int:
    return max(1, math.ceil(p * n))


class LiveBucket(StatefulProcessor):
    """State of one (group, bucket): what counts now, and by slot what has to be taken off when."""

    def __init__(self, agg: Aggregation, lookback_ms: int, slot_ms: int, event_clock: bool):
        self.agg, self.lookback, self.slot, self.event = agg, lookback_ms, slot_ms, event_clock
        self.p = int(agg.fn[1:]) / 100 if agg.fn[0] == "p" else None
        self.numeric = agg.fn not in ("count", "rate")

    def init(self, handle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "n long, total binary, nan long, up long, down long")
        self.slots = handle.getMapState("slots", "slot long", "ms array<long>, value array<double>, n array<long>")
        self.upper = handle.getMapState("upper", "upper int", "n long")
        self.lower = handle.getMapState("lower", "upper int", "value array<double>, n array<long>")

    def close(self) -> None:
        pass

    def _now(self, times) -> int:
        """The clock: in event time Spark's watermark is the newest event less the look-back."""
        return times.getCurrentWatermarkInMs() + self.lookback if self.event else times.getCurrentProcessingTimeInMs()

    def _arm(self, oldest: int) -> None:
        # The look-back is in the watermark already; a timer is due once the clock is past it.
        self.handle.registerTimer(max(0, oldest - 1 if self.event else oldest + self.lookback - 1))

    def _put(self, counts: dict[float | None, int], sign: int) -> int:
        """Adds or takes off values with their counts; the number of what is left."""
        held = self.totals.get() if self.totals.exists() else (0, b"\0", 0, 0, 0)
        n, total, nan, up, down = held[0], int.from_bytes(held[1], "little", signed=True), *held[2:]
        by_upper: dict[int, dict[float, int]] = {}
        for value, c in counts.items():
            c *= sign
            n += c
            if value is None:
                continue
            if value != value:
                nan += c
            elif math.isinf(value):
                up, down = (up + c, down) if value > 0 else (up, down + c)
            else:
                total += exact(value) * c
            if self.p is not None:
                at = by_upper.setdefault(place(value) >> 48, {})
                at[value] = at.get(value, 0) + c
        for at, changed in by_upper.items():
            old = self.lower.getValue((at,)) if self.lower.containsKey((at,)) else ([], [])
            new = {place(v): [v, int(c)] for v, c in zip(old[0], old[1])}
            for v, c in changed.items():
                new.setdefault(place(v), [v, 0])[1] += c
            kept = [x for _, x in sorted(new.items()) if x[1]]
            if kept:
                self.lower.updateValue((at,), ([x[0] for x in kept], [x[1] for x in kept]))
                self.upper.updateValue((at,), (sum(x[1] for x in kept),))
            else:
                self.lower.removeKey((at,))
                self.upper.removeKey((at,))
        if n:
            self.totals.update((n, total.to_bytes(total.bit_length() // 8 + 1, "little", signed=True), nan, up, down))
        else:
            self.totals.clear()
        return n

    def _value(self, n: int) -> float | None:
        fn = self.agg.fn
        if not n:
            return None if self.p is not None or fn == "avg" else 0.0
        if fn in ("count", "rate"):
            return float(n) if fn == "count" else n / (self.agg.bucket_ms / 1000)
        if self.p is not None:
            rank = nearest_rank(self.p, n)
            for (at,), (c,) in sorted((tuple(k), tuple(v)) for k, v in self.upper.iterator()):
                if rank <= c:
                    for v, m in zip(*self.lower.getValue((at,))):
                        if rank <= m:
                            return float(v)
                        rank -= m
                rank -= c
        _, total, nan, up, down = self.totals.get()
        whole = math.nan if nan or up and down else math.inf if up else -math.inf if down else None
        if fn == "avg" and whole is None:
            return inexact(int.from_bytes(total, "little", signed=True)) / n
        return inexact(int.from_bytes(total, "little", signed=True)) if whole is None else whole

    def _changed(self, key: tuple, n: int) -> pd.DataFrame:
        return pd.DataFrame({"group_key": [key[0]], "bucket_start_ms": [key[1]], "n": [n], "value": pd.Series([self._value(n)], dtype="float64")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        bound = self._now(timerValues) - self.lookback
        fresh: dict[int, dict[tuple[int, float | None], int]] = {}
        counts: dict[float | None, int] = {}
        for frame in rows:
            for ms, value, known in zip(frame["ms"].tolist(), frame["v"].tolist(), frame["known"].tolist()):
                value = value + 0.0 if known else None
                if ms <= bound or value is None and self.numeric:
                    continue
                value = value if self.numeric else None
                at = fresh.setdefault(ms // self.slot, {})
                at[ms, value] = at.get((ms, value), 0) + 1
                counts[value] = counts.get(value, 0) + 1
        if not counts:
            return
        for slot, found in fresh.items():
            old = self.slots.getValue((slot,)) if self.slots.containsKey((slot,)) else ([], [], [])
            self._keep(slot, [*zip(old[0], old[1], old[2]), *((ms, v, c) for (ms, v), c in found.items())])
        yield self._changed(key, self._put(counts, 1))

    def _keep(self, slot: int, rows: list[tuple]) -> None:
        self.slots.updateValue((slot,), tuple(list(x) for x in zip(*rows)))
        self._arm(min(int(r[0]) for r in rows))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        bound = self._now(timerValues) - self.lookback
        due = expiredTimerInfo.getExpiryTimeInMs() + 1 - (0 if self.event else self.lookback)
        slot = due // self.slot
        if not self.slots.containsKey((slot,)):
            return
        rows = list(zip(*self.slots.getValue((slot,))))
        gone = [r for r in rows if r[0] <= bound]
        left = [r for r in rows if r[0] > bound]
        if left:
            self._keep(slot, left)
        else:
            self.slots.removeKey((slot,))
        if gone:
            counts: dict[float | None, int] = {}
            for _, v, c in gone:
                counts[v] = counts.get(v, 0) + int(c)
            yield self._changed(key, self._put(counts, -1))


def live_buckets(rows: DataFrame, agg: Aggregation, lookback_ms: int, clock: str = "event", slot_ms: int | None = None) -> DataFrame:
    """Changes of the buckets of a stream of (observed_at, group_key, value): group_key, bucket_start_ms, n, value, for update output.

    A bucket that all its entries have left is given once more, with n = 0 and 0 (count, rate, sum) or null.  An entry
    may come late by up to the look-back.
    """
    if clock not in ("event", "processing"):
        raise ValueError(f"clock {clock}")
    event = clock == "event"
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    if event:
        rows = rows.withWatermark("observed_at", f"{lookback_ms} milliseconds")
    ms = F.unix_millis("observed_at")
    value = F.col("value").cast("double")
    flat = rows.select("observed_at", "group_key", (ms - F.pmod(ms, F.lit(agg.bucket_ms))).alias("bucket_start_ms"), ms.alias("ms"), F.coalesce(value, F.lit(0.0)).alias("v"), value.isNotNull().alias("known"))
    step = LiveBucket(agg, lookback_ms, slot_ms or max(1, lookback_ms // 64), event)
    return flat.groupBy("group_key", "bucket_start_ms").transformWithStateInPandas(step, CHANGES, "Update", "EventTime" if event else "ProcessingTime")


def final_state(changes: DataFrame) -> DataFrame:
    """Buckets that hold something after all changes (with the number ``batch`` of each and its order ``step`` inside the batch)."""
    last = F.max_by(F.struct("n", "value"), F.struct("batch", "step")).alias("last")
    return changes.groupBy("group_key", "bucket_start_ms").agg(last).where("last.n > 0").select("group_key", "bucket_start_ms", "last.n", "last.value")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; where none is named, below /tmp in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    return f"{(base or '/tmp/checkpoints/spanforge').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_through(changes: DataFrame, folder: str) -> DataFrame:
    """Runs a stream of changes over what is there, each batch written under its number, and gives the state that they leave."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.select("*", F.lit(number).cast("long").alias("batch"), F.monotonically_increasing_id().alias("step")).write.mode("overwrite").parquet(f"{folder}/changes/at={number}")

    query = changes.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    spark = changes.sparkSession
    return final_state(spark.read.schema(f"{CHANGES}, batch long, step long").option("recursiveFileLookup", "true").parquet(f"{folder}/changes"))
