"""The whole as one object: landed requests in, every analysis out, each as a DataFrame.

    engine = Engine(spark, "/data/telemetry")
    engine.ingest(requests)                       # signal, content_type, content_encoding, body
    engine.query("SELECT service_name, count(*) FROM logs GROUP BY service_name", lookback_ms=3_600_000)

Bodies are parsed once, when they are landed, into a struct that all decoded tables, rollups, error groups and the attribute
index are taken from; queries read only those.  A batch of requests counts once all its tables are written
(``landing.Log``), so a failure in between shows nothing and a batch that comes again under its key is taken once.  ``now`` is a parameter everywhere; left out it is the wall clock.  A look-back
prunes days; bounds on scanned rows are off unless asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog, CatalogError
from .operators import insight, preview, traces, viewers
from .plans import dialect
from .schema import RAW_ENTRY
from .sources import calls, landing, otlp

MINUTE = 60_000
APM_LOOKBACK_MS = 5 * MINUTE
MAP_LOOKBACK_MS = 10 * MINUTE
EXEMPLAR_BUCKET_MS = MINUTE
#: Where a table's rows name the entry that they came from: signal, stream_ms, stream_seq.
IDS = {
    "landing": ("signal", "stream_ms", "stream_seq"), "entries": ("signal", "stream_ms", "stream_seq"), "spans": ("'traces'", "ord.ms", "ord.seq"),
    "points": ("'metrics'", "ord.ms", "ord.seq"), "records": ("'logs'", "ord.ms", "ord.seq"),
}
#: Signals that a table's rows come from, and whether they are its partitions.
HOLDS = {"landing": (landing.SIGNALS, True), "entries": (landing.SIGNALS, True), "spans": (("traces",), False), "points": (("metrics",), False), "records": (("logs",), False)}
#: What is written of each landed request.
DECODED = {
    "entries": otlp.entries, "spans": otlp.spans, "points": otlp.metric_points, "records": otlp.log_records,
    "attributes": lambda bodies: insight.attribute_index(*otlp.indexable_attributes(bodies)),
}


#: Partitions of tables below those of their batch, where it is not the day.
BY = {"landing": landing.PARTITIONS, "entries": landing.PARTITIONS, "rollups": ("signal", "resolution")}
#: Order of rows in the files of tables that are looked into by a value, so that statistics leave row groups and pages out.
SORTED = {"spans": ("trace_id", "start_ns"), "attributes": ("key", "value")}
#: Columns of theirs with Bloom filters (or dictionaries, where those hold all values), sized to the values that come.
BLOOM = {"spans": ("trace_id",), "attributes": ("value",)}


class Engine:
    def __init__(self, spark: SparkSession, root: str, catalog: Catalog | None = None, retention: int | None = None, purge: bool = False):
        """``retention``: how many newest entries of each signal are kept; all if None.  ``purge``: others are deleted, not only left out."""
        self.spark, self.root, self.catalog, self.retention, self.purge = spark, root.rstrip("/"), catalog or Catalog(), retention, purge
        self.log = landing.Log(spark, self.root)

    # --- data ---

    def ingest(self, requests: DataFrame, now: datetime | None = None, key: str | None = None) -> DataFrame:
        """Lands the requests that can be taken, arrived ``now``; gives all with the status of each.

        ``key`` names the batch: one that was taken already is not taken again.
        """
        taken = otlp.normalize(requests)
        self._land(taken.where("status = 200").select("signal", "payload"), now, key, otlp.name_services, self._tables)
        return taken.select("signal", "status")

    def ingest_calls(self, requests: DataFrame, now: datetime | None = None, key: str | None = None) -> DataFrame:
        """The same for remote calls (path, content_type, content_encoding, body): gives the code of each."""
        taken = calls.normalize(requests)

        def tables(bodies: DataFrame) -> dict[str, DataFrame]:
            return {name: df.where(F.lit(name not in ("rollups", "attributes"))) for name, df in self._tables(bodies).items()}

        self._land(taken.where(F.col("code") == calls.OK).select("signal", "payload", "transport"), now, key, calls.name_services, tables)
        return taken.select("signal", "transport", "code")

    def _land(self, good: DataFrame, now: datetime | None, key: str | None, named: Callable, tables: Callable) -> None:
        at = now or datetime.now(timezone.utc)
        batch = self.log.reserve(int(at.timestamp() * 1000), key)
        if not batch.committed:
            good = good.select(F.lit(at).cast("timestamp").alias("observed_at"), F.lit(None).cast("string").alias("service_name"), *good.columns)
            rows = landing.with_ids(good, batch).withColumn("entry_id", F.xxhash64("signal", "stream_ms", "stream_seq", "payload"))
            bodies = named(otlp.parse(otlp.decode_bodies(rows))).persist()
            try:
                for name, df in tables(bodies).items():
                    by = BY.get(name, ("day",))
                    if name in SORTED:
                        df = df.sortWithinPartitions(*by, *SORTED[name])
                    filters = {"parquet.bloom.filter.adaptive.enabled": "true"} | {f"parquet.bloom.filter.enabled#{c}": "true" for c in BLOOM[name]} if name in BLOOM else {}
                    df.write.mode("overwrite").partitionBy(*by).options(**filters).parquet(f"{self.root}/{name}/batch={batch.number}")
            finally:
                bodies.unpersist()
            self.log.commit(batch)
            self.__dict__.pop("_floors", None)
            if self.retention and self.purge:
                self._expire()

    def _tables(self, bodies: DataFrame) -> dict[str, DataFrame]:
        daily = {name: made(bodies).withColumn("day", F.to_date("observed_at")) for name, made in DECODED.items()}
        found = insight.span_errors(otlp.spans(bodies)).unionByName(insight.log_errors(otlp.log_records(bodies)))
        landed = bodies.select("entry_id", "stream_ms", "stream_seq", "signal", "observed_at", "service_name", "payload").withColumn("day", F.to_date("observed_at"))
        return daily | {"landing": landed, "rollups": insight.rollup(otlp.entries(bodies)), "errors": insight.error_groups(found).withColumn("day", F.to_date("last_seen"))}

    @cached_property
    def _schemas(self) -> dict:
        """Schemas of the tables, which may hold no file yet of a signal that has not come."""
        none = otlp.parse(self.spark.createDataFrame([], f"{RAW_ENTRY}, body string"))
        return {name: df.withColumn("batch", F.lit(0)).schema for name, df in self._tables(none).items()}

    @cached_property
    def _floors(self) -> dict[str, tuple[int, int]]:
        return landing.floors(self._stored("landing"), self.retention) if self.retention else {}

    def _expire(self) -> None:
        """Deletes batches of which retention had kept nothing at the ingest before, and notes what it keeps now.

        Readers leave out the batches below the noted floor, so one that began since the last ingest loses no file.
        """
        for signal, floor in self.log.floors().items():
            for name, (signals, apart) in HOLDS.items():
                if signal in signals:
                    self.log.delete_below(f"{self.root}/{name}", floor[1] >> 40, f"/signal={signal}" if apart else "")
        # Batches below the floor of before hold no entry that counts, so they are not looked at again.
        self.log.note_floors(landing.floors(self._stored("landing"), self.retention))

    def _stored(self, name: str) -> DataFrame:
        if not self.log.batches():
            return self.spark.createDataFrame([], self._schemas[name]).drop("batch")
        rows = self.spark.read.schema(self._schemas[name]).option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}")
        if name in HOLDS and self.retention and self.purge:
            signals, apart = HOLDS[name]
            for signal, floor in self.log.floors().items():
                if signal in signals:  # partitions, so what is left out is not opened
                    rows = rows.where((F.col("batch") >= floor[1] >> 40) | (F.col("signal") != signal if apart else F.lit(False)))
        return self.log.whole(rows)

    def table(self, name: str) -> DataFrame:
        """Rows of committed batches, of kept entries where they name one."""
        rows = self._stored(name)
        if name in IDS and self._floors:
            rows = rows.where(landing.above(self._floors, *map(F.expr, IDS[name])))
        return rows

    @property
    def bodies(self) -> DataFrame:
        """Landed requests as JSON text, for previews."""
        return otlp.decode_bodies(self.table("landing").withColumn("service_name", F.nullif(F.col("service_name"), F.lit(""))))

    def entries(self) -> DataFrame:
        return self.table("entries")

    def spans(self) -> DataFrame:
        return self.table("spans")

    def _since(self, df: DataFrame, now: datetime | None, lookback_ms: int, inclusive: bool = True) -> DataFrame:
        """Rows of a look-back, with the day's bound stated so that older days are not read."""
        return viewers.within_lookback(df, lookback_ms, now or datetime.now(timezone.utc), inclusive)

    def _recent(self, name: str, now: datetime | None, lookback_ms: int, inclusive: bool = True) -> DataFrame:
        at = now or datetime.now(timezone.utc)
        first_day = (at - timedelta(milliseconds=lookback_ms, days=1)).date()  # a day's name depends on the time zone
        return self._since(self.table(name).where(F.col("day") >= F.lit(first_day)), at, lookback_ms, inclusive)

    # --- queries ---

    def query(self, sql: str, lookback_ms: int | None = None, now: datetime | None = None, scan_limit: int | None = None) -> dialect.QueryResult:
        rows = self._recent("entries", now, viewers.query_lookback(lookback_ms), inclusive=False)
        return dialect.run(sql, viewers.scan_cap(rows, scan_limit) if scan_limit else rows)

    # --- viewers and dashboards ---

    def _viewer(self, viewer_id: str, lookback_ms: int | None = None) -> viewers.Viewer:
        row = self.catalog.get("viewer", viewer_id)
        if lookback_ms is not None:
            if not 0 < lookback_ms <= row["lookback_ms"]:
                raise CatalogError(400, "look-back out of the viewer's")
            row = row | {"lookback_ms": lookback_ms}
        return viewers.compile_viewer(row)

    def _live(self, v: viewers.Viewer, now: datetime | None) -> DataFrame:
        at = now or datetime.now(timezone.utc)
        return viewers.matching(v, self._recent("entries", at, v.lookback_ms), at)

    def viewer(self, viewer_id: str, now: datetime | None = None, lookback_ms: int | None = None, services: str | None = None, query: str | None = None) -> dict:
        """entries, buckets (not touched by the filters), rows, traces and exemplars of a viewer."""
        v = self._viewer(viewer_id, lookback_ms)
        live = self._live(v, now)
        shown = viewers.dashboard_filter(live, services, query)
        out = {"entries": shown, "rows": self._rows(shown)}
        if v.aggregation:
            out["buckets"] = viewers.aggregate(v.aggregation, live)
        if "traces" in v.signals():
            out["traces"] = traces.summaries(self.spans().join(shown.select("entry_id"), "entry_id", "left_semi"))
        if "metrics" in v.signals():
            out["exemplars"] = self.exemplars(viewer_id, now=now)
        return out

    def _rows(self, entries: DataFrame, n: int = 50) -> DataFrame:
        newest = viewers.newest(entries, n).select("entry_id")
        return preview.preview(self.bodies.join(F.broadcast(newest), "entry_id", "left_semi"), n)  # n rows at most

    def preview(self, definition: dict, now: datetime | None = None) -> dict:
        """What a definition that is not saved would show."""
        live = self._live(viewers.compile_viewer(definition), now)
        return {"entries": live, "rows": self._rows(live)}

    def dashboard(self, dashboard_id: str, now: datetime | None = None, lazy: bool = False, **filters) -> list[dict]:
        """Panels in order with their viewers' results; a viewer that is gone leaves None."""
        from .catalog import panels_of

        out = []
        for p in panels_of(self.catalog.get("dashboard", dashboard_id)["layout_json"]):
            known = p["viewer_id"] in self.catalog.rows.get("viewer", {})
            out.append(p | {"viewer": None if not known else self.catalog.get("viewer", p["viewer_id"]) if lazy else self.viewer(p["viewer_id"], now, **filters)})
        return out

    def services(self, now: datetime | None = None) -> DataFrame:
        """Of the entries that are live in an enabled viewer."""
        at = now or datetime.now(timezone.utc)
        live = [viewers.compile_viewer(v) for v in self.catalog.enabled_viewers()]
        if not live:
            return viewers.services(self.entries().limit(0))
        recent = self._recent("entries", at, max(v.lookback_ms for v in live), inclusive=False)
        return viewers.services(viewers.fan_out(live, recent, at))

    def attribute_index(self) -> DataFrame:
        return self.table("attributes").dropDuplicates(["key", "value", "entry_id"])

    def attribute_keys(self) -> DataFrame:
        return insight.attribute_keys(self.attribute_index())

    def attribute_values(self, key: str, prefix: str | None = None) -> DataFrame:
        return insight.attribute_values(self.attribute_index(), key, prefix)

    # --- traces ---

    def trace_search(self, **options) -> DataFrame:
        return traces.search(self.spans(), **options)

    def trace(self, trace_id: str) -> DataFrame:
        return traces.lookup(self.spans(), trace_id)

    def waterfall(self, trace_id: str) -> DataFrame:
        if not trace_id.strip():
            raise CatalogError(400, "no trace id")
        return traces.waterfall(self.spans(), trace_id.strip())

    def service_map(self, now: datetime | None = None, lookback_ms: int = MAP_LOOKBACK_MS) -> tuple[DataFrame, DataFrame]:
        at = now or datetime.now(timezone.utc)
        s = self._recent("spans", at, lookback_ms) if lookback_ms > 0 else self.spans()
        return traces.service_nodes(s, at, lookback_ms), traces.service_edges(s, at, lookback_ms)

    # --- errors and calls ---

    def error_groups(self, now: datetime | None = None, lookback_ms: int | None = None) -> DataFrame:
        """Groups are kept by batch when it is landed; here they are folded, a row a group and batch."""
        return insight.recent_error_groups(insight.fold_error_groups(self._stored("errors").drop("day")), now or datetime.now(timezone.utc), lookback_ms)

    def _calls(self, now: datetime | None, lookback_ms: int) -> DataFrame:
        return insight.db_spans(self._recent("spans", now, max(lookback_ms, 0)))

    def slow_queries(self, now: datetime | None = None, lookback_ms: int = APM_LOOKBACK_MS, min_p95_ms: int = 100) -> DataFrame:
        return insight.slow_queries(self._calls(now, lookback_ms), min_p95_ms)

    def n_plus_one(self, now: datetime | None = None, lookback_ms: int = APM_LOOKBACK_MS, min_repetitions: int = 5) -> DataFrame:
        return insight.n_plus_one(self._calls(now, lookback_ms), max(min_repetitions, 1))

    # --- insight ---

    def exemplars(self, viewer_id: str, now: datetime | None = None, lookback_ms: int | None = None, bucket_ms: int = EXEMPLAR_BUCKET_MS, max_samples: int = 5) -> DataFrame:
        v = self._viewer(viewer_id)
        if "metrics" not in v.signals():
            raise CatalogError(400, "not a viewer of metrics")
        at = now or datetime.now(timezone.utc)
        metric = self._live(v, at).where("signal = 'metrics'")
        return insight.exemplars(metric, self._recent("spans", at, lookback_ms or v.lookback_ms), at, lookback_ms or v.lookback_ms, bucket_ms, insight.exemplar_service(metric), max_samples)

    def rollups(self, signal: str, from_ms: int, to_ms: int, resolution: str = "1m") -> DataFrame:
        return insight.rollup_range(self.table("rollups"), signal, resolution, from_ms, to_ms)

    def anomaly(self, viewer_id: str, detector: dict, now: datetime | None = None) -> DataFrame:
        """``{"kind": "no_data", "window_ms"}`` or ``{"kind": "zscore", "bucket_ms", "threshold"}`` over a viewer."""
        at = now or datetime.now(timezone.utc)
        live = self._live(self._viewer(viewer_id), at)
        if detector["kind"] == "no_data":
            return insight.no_data(live, detector["window_ms"], at)
        if detector["kind"] == "zscore":
            return insight.zscore(live, detector["bucket_ms"], detector["threshold"], at)
        raise CatalogError(400, f"unknown detector {detector['kind']}")

    def budget(self, slo_id: str, now: datetime | None = None) -> DataFrame:
        at = now or datetime.now(timezone.utc)
        row = self.catalog.get("slo", slo_id)
        live = self._live(self._viewer(row["viewer_id"]), at) if row["viewer_id"] in self.catalog.rows.get("viewer", {}) else self.entries().limit(0)
        return self.catalog.slo_budget(slo_id, live, at)

    def alerts(self, now: datetime | None = None) -> DataFrame:
        at = now or datetime.now(timezone.utc)
        live = [viewers.compile_viewer(v) for v in self.catalog.enabled_viewers()]
        seen = self.spark.createDataFrame([(v.id,) for v in live], "viewer_id string")
        recent = self._recent("entries", at, max([0, *(v.lookback_ms for v in live)]), inclusive=False)
        rows = viewers.fan_out(live, recent) if live else recent.withColumn("viewer_id", F.lit(""))
        spans_of = self.spark.createDataFrame([(v.id, at - timedelta(milliseconds=v.lookback_ms)) for v in live], "viewer_id string, since timestamp")
        counted = rows.join(F.broadcast(spans_of), "viewer_id").where("observed_at > since").groupBy("viewer_id").agg(F.count(F.lit(1)).alias("n"))  # a row a viewer
        counts = seen.join(counted, "viewer_id", "left").select("viewer_id", F.coalesce("n", F.lit(0)).alias("count"))
        return insight.evaluate_alerts(counts, self.catalog.alerts())
