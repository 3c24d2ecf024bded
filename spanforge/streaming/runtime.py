"""Continuous viewers over landed entries.

``ViewerRuntime`` takes each micro-batch once, decodes it once and writes under the batch's number the decoded rows,
rollups, attribute index and error groups, so a batch that comes again overwrites itself.  Viewers' results are kept by
deltas (``deltas.Deltas``): a tick reads the batches that came and the contributions that left, for all viewers in
one pass, and its manifest holds the viewers' cursors, from which a restart goes on.  A change of a viewer is worked out
at once, from that viewer's look-back.  Results stay in tables; ``results`` fetches a viewer's when it is asked for
them.  ``rollup_stream`` is the native form for what needs no retraction, ``live.live_buckets`` the one for what takes
its entries back by the clock inside Spark's own state.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Mapping
from datetime import date, datetime, timedelta, timezone
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import insight, viewers
from ..operators.viewers import Viewer
from ..schema import RAW_ENTRY
from ..sources import landing, otlp
from .deltas import Deltas


class Results(Mapping):
    """Rows of the viewers that have been worked out, by id; each is read from its tables when asked for."""

    def __init__(self, runtime: ViewerRuntime):
        self._runtime = runtime

    def frame(self, viewer_id: str) -> DataFrame:
        v = self._runtime.viewers[viewer_id]
        if not self._runtime.live.knows(v):
            raise KeyError(viewer_id)
        return self._runtime.live.results(v)

    def __getitem__(self, viewer_id: str) -> list:
        return self.frame(viewer_id).collect()

    def __iter__(self) -> Iterator[str]:
        return (i for i, v in self._runtime.viewers.items() if self._runtime.live.knows(v))

    def __len__(self) -> int:
        return sum(1 for _ in self)


class ViewerRuntime:
    """Keeps entries in ``root``/entries, side tables next to them, and the viewers' state in ``root``/live."""

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], datetime] | None = None, alerts: list | None = None, on_alert: Callable | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.clock = clock or (lambda: datetime.now(timezone.utc))
        self.viewers: dict[str, Viewer] = {}
        self.status: dict[str, dict] = {}
        self.alerts, self.on_alert = list(alerts or ()), on_alert
        self.alert_status: dict[str, str] = {}
        self._last_run: dict[str, float] = {}
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.live = Deltas(spark, f"{self.root}/live", self._of_batches)
        self.results = Results(self)

    # definitions

    def add(self, viewer: Viewer) -> None:
        """Takes a viewer up; what is held of the same revision counts, and the next tick goes on after its cursor."""
        self.viewers[viewer.id] = viewer
        self.status[viewer.id] = {"type": "ok"}

    def update(self, viewer: Viewer) -> str:
        """Takes a change up and works it out: ``rebuild`` (other entries are met), ``recompute`` (another aggregation) or ``metadata``."""
        old = self.viewers.get(viewer.id)
        matcher = lambda v: (v.signal_mask, v.lookback_ms, v.query, v.filters, v.any_filter)
        if old is None or matcher(old) != matcher(viewer):
            action = "rebuild"
        else:
            action = "recompute" if old.aggregation != viewer.aggregation else "metadata"
        self.viewers[viewer.id] = viewer
        self.status[viewer.id] = {"type": "ok"}
        if action == "metadata":
            self.live.rename(viewer)
        else:
            self._advance(self.clock())
        return action

    def remove(self, viewer_id: str) -> None:
        for kept in (self.viewers, self.status):
            kept.pop(viewer_id, None)
        self.live.forget(viewer_id)

    # work

    def table(self) -> str:
        return f"{self.root}/entries"

    def start(self, stream: DataFrame, available_now: bool = False, interval: str = "1 second") -> StreamingQuery:
        """Runs ``stream`` of raw entries; each batch is written under its own number, so a repeat overwrites it."""
        writer = stream.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.root}/checkpoint")
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()

    def _batch(self, batch: DataFrame, number: int) -> None:
        bodies = otlp.parse(otlp.decode_bodies(batch)).persist()
        try:
            side_tables(bodies, self.root, number)
            decoded = otlp.entries(bodies).withColumn("day", F.to_date("observed_at"))
            decoded.write.mode("overwrite").partitionBy(*landing.PARTITIONS).parquet(f"{self.table()}/batch={number}")
        finally:
            bodies.unpersist()
        self.refresh(self.clock())

    def landed(self) -> list[int]:
        """Numbers of the batches whose entries are written."""
        path = self._path(self.table())
        names = [f.getPath().getName() for f in self._fs.listStatus(path)] if self._fs.exists(path) else []
        return sorted(int(n[6:]) for n in names if n.startswith("batch=") and self._fs.exists(self._path(f"{self.table()}/{n}/_SUCCESS")))

    @cached_property
    def _schema(self):
        none = otlp.parse(self.spark.createDataFrame([], f"{RAW_ENTRY}, body string"))
        return otlp.entries(none).withColumn("day", F.to_date("observed_at")).withColumn("batch", F.lit(0)).schema

    def _of_batches(self, numbers: list[int], first_day: date | None = None) -> DataFrame:
        """Entries of the batches, days before ``first_day`` left out."""
        paths = [f"{self.table()}/batch={n}" for n in numbers if self._fs.exists(self._path(f"{self.table()}/batch={n}"))]
        if not paths:
            return self.spark.createDataFrame([], self._schema)
        rows = self.spark.read.schema(self._schema).option("basePath", self.table()).parquet(*paths)
        return rows if first_day is None else rows.where(F.col("day") >= F.lit(first_day))

    def entries(self) -> DataFrame:
        return self._of_batches(self.landed()).drop("batch")

    def _recent(self, of: list[Viewer], now: datetime) -> DataFrame:
        """Entries of the days that the longest look-back needs; a day's name depends on the time zone."""
        first = (now - timedelta(milliseconds=max([0, *(v.lookback_ms for v in of)]), days=1)).date()
        return self.entries().where(F.col("day") >= F.lit(first))

    def _sound(self, v: Viewer) -> bool:
        """Whether the viewer's patterns can run at all; if not it is degraded, and the others go on without it."""
        try:
            for _, op, value in v.filters:
                if op == "regex":
                    viewers.check_pattern(value)
        except viewers.ViewerError as e:
            self.status[v.id] = {"type": "degraded", "reason": str(e)[:200]}
            return False
        return True

    def _advance(self, now: datetime) -> None:
        """A tick; a viewer whose condition cannot run is degraded and keeps what it had, and the others go on."""
        known = [v for v in self.viewers.values() if self._sound(v)]
        try:
            self._tick(known, now)
        except Exception:
            good = [v for v in known if self._runs(v)]
            if len(good) == len(known):
                raise
            self._tick(good, now)

    def _tick(self, known: list[Viewer], now: datetime) -> None:
        self.live.advance(known, self.landed(), now)
        for v in known:
            self.status[v.id] = {"type": "ok"}

    def _runs(self, v: Viewer) -> bool:
        try:
            viewers.fan_out([v], self._of_batches(self.landed()[-1:])).limit(1).count()
        except Exception as e:
            self.status[v.id] = {"type": "degraded", "reason": str(e)[:200]}
            return False
        return True

    def refresh(self, now: datetime) -> None:
        """Brings all viewers to the landed batches and to ``now``, then the alerts that are due."""
        self._advance(now)
        self._evaluate(now)

    def panel(self, viewer_id: str, services: str | None = None, query: str | None = None) -> DataFrame | None:
        """A viewer's live entries under a dashboard's filter; None for a viewer that is not there."""
        v = self.viewers.get(viewer_id)
        now = self.clock()
        return None if v is None else viewers.dashboard_filter(viewers.matching(v, self._recent([v], now), now), services, query)

    def _evaluate(self, now: datetime) -> None:
        ms = now.timestamp() * 1000
        due = [a for a in self.alerts if ms - self._last_run.get(a.id, -1e18) >= a.interval_ms]
        if not due:
            return
        watched = [(v.id,) for v in self.viewers.values() if any(a.viewer_id == v.id for a in due) and self.status[v.id]["type"] == "ok"]
        frame = self.spark.createDataFrame(watched, "viewer_id string").join(self.live.counts(), "viewer_id", "left").select("viewer_id", F.coalesce("count", F.lit(0)).alias("count"))
        for r in insight.evaluate_alerts(frame, due).collect():
            self._last_run[r.alert_id] = ms
            self.alert_status[r.alert_id] = r.status
            if self.on_alert and r.status == "breached":
                self.on_alert(r.asDict())


def rollup_stream(entries: DataFrame, resolution: str = "1m", late: str = "10 minutes") -> DataFrame:
    """Counts by signal, bucket and service of a stream of entries, as ``insight.rollup`` gives them, for append or update output."""
    width = insight.RESOLUTIONS[resolution]
    window = F.window("observed_at", f"{width} seconds")
    rows = entries.withColumn("service", F.explode(insight.rollup_services()))
    out = rows.withWatermark("observed_at", late).groupBy("signal", window.alias("w"), "service").agg(F.count(F.lit(1)).alias("count"))
    return out.select("signal", F.unix_seconds("w.start").alias("bucket_start_seconds"), "service", "count")


def side_tables(bodies: DataFrame, root: str, number: int) -> None:
    """Rollups, attribute index and error groups of a batch, under its number: a repeat overwrites, readers add up or fold."""
    errors = insight.span_errors(otlp.spans(bodies)).unionByName(insight.log_errors(otlp.log_records(bodies)))
    made = {"rollups": insight.rollup(otlp.entries(bodies)), "attributes": insight.attribute_index(*otlp.indexable_attributes(bodies)), "errors": insight.error_groups(errors)}
    for name, df in made.items():
        df.write.mode("overwrite").parquet(os.path.join(root, name, f"batch={number}"))
