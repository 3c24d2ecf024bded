"""Errors, database calls, exemplars, rollups, attribute index, error budgets, detectors, alerts and charts."""

from __future__ import annotations

import operator
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import attribute_text, bucket_start, duration_ns, fingerprint, normalize_statement, sanitize_service, signature
from .selection import at_ranks
from .viewers import within_lookback

ERROR_SEVERITY = 17
RESOLUTIONS = {"1m": 60, "5m": 300, "1h": 3600}
RETENTION_SECONDS = {"1m": 6 * 3600, "5m": 24 * 3600, "1h": 7 * 24 * 3600}
EXEMPLAR_BUCKETS = (1_000, 86_400_000)


# --- error groups ---


def span_errors(spans: DataFrame) -> DataFrame:
    """Exception events of spans as occurrences."""
    event = spans.withColumn("_e", F.explode("events")).where("_e.name = 'exception'")
    text = lambda k: attribute_text(F.col("_e.attributes"), f"exception.{k}")
    named = event.select("ord", "observed_at", F.col("entry_service_name").alias("service_name"), F.lit("traces").alias("signal"), text("type").alias("exception_type"), text("message").alias("exception_message"), text("stacktrace").alias("stacktrace"))
    return named.withColumn("fingerprint", fingerprint(F.col("exception_type"), F.col("exception_message"))).withColumn("signature", signature(F.col("exception_type"), F.col("exception_message")))


def log_errors(records: DataFrame) -> DataFrame:
    """Log records at error level or above as occurrences."""
    bad = F.coalesce(F.lower("severity_text") == "error", F.lit(False)) | F.coalesce(F.col("severity_number") >= ERROR_SEVERITY, F.lit(False))
    kind = F.coalesce("severity_text", F.concat(F.lit("severity="), F.col("severity_number").cast("string")), F.lit("ERROR"))
    named = records.where(bad).select("ord", "observed_at", F.col("entry_service_name").alias("service_name"), F.lit("logs").alias("signal"), kind.alias("exception_type"), F.coalesce("body", F.lit("")).alias("exception_message"), F.lit(None).cast("string").alias("stacktrace"))
    shown = F.when(F.col("exception_message") == "", F.col("exception_type")).otherwise(F.concat_ws(": ", "exception_type", "exception_message"))
    return named.withColumn("fingerprint", fingerprint(F.col("exception_type"), F.col("exception_message"))).withColumn("signature", shown)


def error_groups(occurrences: DataFrame) -> DataFrame:
    """One row a fingerprint; signature and sample are of the newest occurrence, the first to arrive at ties."""
    order = F.struct("observed_at", *((-F.col(f"ord.{p}")).alias(p) for p in ("ms", "seq", "rs", "ss", "i")))
    newest = F.max(F.struct(order.alias("o"), "signature", "service_name", "signal", "exception_type", "exception_message", "stacktrace"))
    grouped = occurrences.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("count"), F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"), newest.alias("n"))
    return grouped.select("fingerprint", "count", "first_seen", "last_seen", *(f"n.{c}" for c in ("signature", "service_name", "signal", "exception_type", "exception_message", "stacktrace")))


def merge_error_groups(old: DataFrame, new: DataFrame, overwrite: bool = False) -> DataFrame:
    """Groups kept so far with those of a batch: counts add up, bounds widen, the newer sample stays.

    ``overwrite``: the batch's sample replaces the old one whatever its time.
    """
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    rank = F.struct("_batch", "last_seen") if overwrite else F.struct("last_seen", -F.col("_batch"))
    rest = [c for c in old.columns if c not in ("fingerprint", "count", "first_seen", "last_seen")]
    out = both.groupBy("fingerprint").agg(F.sum("count").alias("count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max(F.struct(rank.alias("r"), *rest)).alias("n"))
    return out.select("fingerprint", "count", "first_seen", "last_seen", *(f"n.{c}" for c in rest))


def fold_error_groups(groups: DataFrame) -> DataFrame:
    """Groups of many batches as one row a fingerprint: counts add up, bounds widen, the newest sample stays."""
    rest = [c for c in groups.columns if c not in ("fingerprint", "count", "first_seen", "last_seen")]
    out = groups.groupBy("fingerprint").agg(F.sum("count").alias("count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max(F.struct("last_seen", *rest)).alias("n"))
    return out.select("fingerprint", "count", "first_seen", "last_seen", *(f"n.{c}" for c in rest))


def recent_error_groups(groups: DataFrame, now: datetime, lookback_ms: int | None = None) -> DataFrame:
    ms = lookback_ms if lookback_ms and lookback_ms > 0 else 3_600_000
    return groups.where(F.col("last_seen") >= F.lit(now - timedelta(milliseconds=ms))).orderBy(F.desc("last_seen"), "fingerprint")


# --- database calls ---


def db_spans(spans: DataFrame) -> DataFrame:
    """Spans with a statement and a trace: statement normalised, system, duration in ns."""
    raw = attribute_text(F.col("attrs"), "db.statement")
    rows = spans.where(F.coalesce("trace_id", F.lit("")) != "").withColumn("_s", raw).where("_s is not null")
    return rows.select("trace_id", "span_id", normalize_statement(F.col("_s")).alias("statement"), attribute_text(F.col("attrs"), "db.system").alias("db_system"), F.coalesce("resource_service_name", "entry_service_name").alias("service_name"), duration_ns(F.col("start_ns"), F.col("end_ns")).cast("long").alias("duration_ns"))


def slow_queries(calls: DataFrame, min_p95_ms: int = 100) -> DataFrame:
    """statement, db_system, count, p50_ms, p95_ms, p99_ms, max_ms of statements whose p95 is that slow."""
    ms = calls.withColumn("ms", F.floor(F.col("duration_ns") / 1000000).cast("long"))
    ranks = {f"p{p}_ms": p / 100 for p in (50, 95, 99)}
    found = at_ranks(ms.select("statement", "db_system", "ms"), ["statement", "db_system"], "ms", ranks, most="max_ms")
    out = found.select("statement", "db_system", F.col("n").alias("count"), *(F.col(c).cast("long").alias(c) for c in (*ranks, "max_ms")))
    return out.where(F.col("p95_ms") >= min_p95_ms).orderBy(F.desc("p95_ms"), F.desc("count"), "statement", "db_system")


def n_plus_one(calls: DataFrame, min_repetitions: int = 5) -> DataFrame:
    """Statements repeated inside one trace."""
    if min_repetitions <= 0:
        return calls.limit(0).select("trace_id", "statement", "db_system", F.lit(0).cast("long").alias("count"), F.array("service_name").alias("services"))
    out = calls.groupBy("trace_id", "statement", "db_system").agg(F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_set(F.when(F.col("service_name") != "", F.col("service_name")))).alias("services"))
    return out.where(F.col("count") >= min_repetitions).orderBy(F.desc("count"), "statement", "trace_id")


# --- exemplars ---


def exemplars(metric_entries: DataFrame, spans: DataFrame, now: datetime, lookback_ms: int, bucket_ms: int, service: str | None = None, max_samples: int = 5) -> DataFrame:
    """bucket_start_ms, sample_trace_ids: the first traces to arrive in buckets that hold metrics."""
    if not EXEMPLAR_BUCKETS[0] <= bucket_ms <= EXEMPLAR_BUCKETS[1]:
        raise ValueError(f"bucket_ms {bucket_ms} is out of {EXEMPLAR_BUCKETS}")
    end = int(now.timestamp() * 1000)
    at = F.unix_millis("observed_at")
    window = at.between(end - max(lookback_ms, 0), end)

    def of(df: DataFrame, name: str) -> DataFrame:
        df = df.where(window)
        return df if service is None else df.where(F.coalesce(F.lower(name) == service.lower(), F.lit(False)))

    bucket = bucket_start(at, bucket_ms).alias("bucket_start_ms")
    active = of(metric_entries.where("signal = 'metrics'"), "service_name").select(bucket).distinct()
    seen = of(spans, "entry_service_name").where(F.coalesce("trace_id", F.lit("")) != "").groupBy(bucket, "trace_id").agg(F.min("ord").alias("ord"))
    live = seen.join(active, "bucket_start_ms", "left_semi")
    ranked = live.withColumn("n", F.row_number().over(Window.partitionBy("bucket_start_ms").orderBy("ord"))).where(F.col("n") <= max(max_samples, 1))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("n", "trace_id"))), lambda s: s["trace_id"])
    return ranked.groupBy("bucket_start_ms").agg(ids.alias("sample_trace_ids")).orderBy("bucket_start_ms")


def exemplar_service(metric_entries: DataFrame) -> str | None:
    """A viewer's exemplars are held to a service only if all its metric entries share one, whatever its case."""
    row = metric_entries.agg(F.count_if(F.col("service_name").isNull()).alias("none"), F.min(F.lower("service_name")).alias("lo"), F.max(F.lower("service_name")).alias("hi"), F.min("service_name").alias("name")).first()
    return row.name if row.none == 0 and row.lo is not None and row.lo == row.hi else None


# --- rollups ---


def rollup_services() -> Column:
    """What an entry counts for: all entries (''), and its service if it has one."""
    name = F.when(F.coalesce("service_name", F.lit("")) != "", sanitize_service(F.col("service_name")))
    return F.array_compact(F.array(F.lit(""), name))


def rollup(entries: DataFrame, resolutions: tuple[str, ...] = tuple(RESOLUTIONS)) -> DataFrame:
    """signal, resolution, bucket_start_seconds, service, count; the service '' counts all entries.

    One scan for all resolutions; a bucket's services are rows, so no map grows with the data.
    """
    kinds = F.array(*(F.struct(F.lit(r).alias("resolution"), F.lit(RESOLUTIONS[r]).alias("width")) for r in resolutions))
    rows = entries.select("signal", F.floor(F.unix_millis("observed_at") / 1000).alias("s"), F.explode(rollup_services()).alias("service"))
    rows = rows.groupBy("signal", "s", "service").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.explode(kinds))
    return rows.groupBy("signal", F.col("k.resolution").alias("resolution"), bucket_start(F.col("s"), F.col("k.width")).alias("bucket_start_seconds"), "service").agg(F.sum("n").alias("count"))


def rollup_range(rolled: DataFrame, signal: str, resolution: str, from_ms: int, to_ms: int) -> DataFrame:
    """bucket_start_seconds, count, by_service of the buckets from the first to the last instant's, both included."""
    if from_ms > to_ms:
        raise ValueError("from is after to")
    width = RESOLUTIONS[resolution]
    first, last = (x // 1000 // width * width for x in (from_ms, to_ms))
    rows = rolled.where((F.col("signal") == signal) & (F.col("resolution") == resolution) & F.col("bucket_start_seconds").between(first, last))
    # Rollups may be appended in parts: those of a service add up first.
    summed = rows.groupBy("bucket_start_seconds", "service").agg(F.sum("count").alias("count"))
    services = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("service") != "", F.struct("service", "count")))))
    return summed.groupBy("bucket_start_seconds").agg(F.sum(F.when(F.col("service") == "", F.col("count"))).alias("count"), services.alias("by_service")).orderBy("bucket_start_seconds")


# --- attribute index ---


def attribute_index(*sources: DataFrame) -> DataFrame:
    """(key, value, signal, entry_id, observed_at) of string attributes of spans, metrics or logs, once an entry.

    Each source has signal, entry_id, observed_at and a column ``attributes``.
    """
    rows = None
    for s in sources:
        one = s.select("signal", "entry_id", "observed_at", F.explode("attributes").alias("a")).select("a.key", F.col("a.value.stringValue").alias("value"), "signal", "entry_id", "observed_at")
        rows = one if rows is None else rows.unionByName(one)
    return rows.where("key != '' and key != 'service.name' and value != ''").dropDuplicates(["key", "value", "entry_id"])


def attribute_keys(index: DataFrame) -> DataFrame:
    return index.select("key").distinct().orderBy("key")


def escape_like(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def attribute_values(index: DataFrame, key: str, prefix: str | None = None, limit: int = 50) -> DataFrame:
    rows = index.where(F.col("key") == key)
    if prefix:
        rows = rows.where(F.col("value").ilike(escape_like(prefix) + "%"))
    return rows.select("value").distinct().orderBy("value").limit(limit)


# --- error budgets, detectors, alerts ---


def slo_budget(entries: DataFrame, total, success, target_pct: float, window_ms: int, now: datetime) -> DataFrame:
    """One row: counts and percentages of the window; ``total`` and ``success`` are conditions on entries."""
    counts = within_lookback(entries, window_ms, now, inclusive=True).where(total).agg(F.count(F.lit(1)).alias("total_count"), F.count_if(F.coalesce(success, F.lit(False))).alias("success_count"))
    allowed = max(100.0 - target_pct, 0.0)
    current = F.when(F.col("total_count") == 0, 100.0).otherwise(F.col("success_count") / F.col("total_count") * 100.0)
    observed = F.greatest(100.0 - F.col("current_pct"), F.lit(0.0))
    used = F.when(observed == 0, 0.0).otherwise(100.0) if allowed == 0 else F.least(F.greatest(observed / allowed * 100.0, F.lit(0.0)), F.lit(100.0))
    return counts.withColumn("current_pct", current).withColumn("consumed_pct", used).withColumn("remaining_pct", F.least(F.greatest(100.0 - F.col("consumed_pct"), F.lit(0.0)), F.lit(100.0))).withColumn("target_pct", F.lit(float(target_pct))).withColumn("window_ms", F.lit(window_ms).cast("long"))


def no_data(entries: DataFrame, window_ms: int, now: datetime) -> DataFrame:
    """breached, value, expected in seconds: how old the latest entry is."""
    age = F.lit(int(now.timestamp() * 1000)) - F.unix_millis(F.max("observed_at"))
    row = entries.agg(age.alias("age"))
    return row.select(F.coalesce(F.col("age") > window_ms, F.lit(True)).alias("breached"), F.coalesce(F.col("age") / 1000, F.lit(window_ms / 1000 * 2)).alias("value"), F.lit(window_ms / 1000).alias("expected"))


def zscore(entries: DataFrame, bucket_ms: int, threshold: float, now: datetime) -> DataFrame:
    """breached, value, expected: the latest bucket against the mean and deviation of all before, empty ones too.

    Empty buckets need no rows: moments of the filled ones and the number of the oldest give those of all.
    """
    if bucket_ms <= 0:
        return entries.sparkSession.createDataFrame([(False, 0.0, 0.0)], "breached boolean, value double, expected double")
    age = F.lit(int(now.timestamp() * 1000)) - F.unix_millis("observed_at")
    return zscore_of(entries.groupBy(F.greatest(F.expr("0L"), F.floor(age / bucket_ms)).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("c")), threshold)


def zscore_of(counts: DataFrame, threshold: float) -> DataFrame:
    """The same of counts ``c`` by bucket ``b``, 0 being the latest."""
    c = F.when(F.col("b") > 0, F.col("c"))
    row = counts.agg(F.coalesce(F.sum(F.when(F.col("b") == 0, F.col("c"))), F.lit(0.0)).alias("value"), F.coalesce(F.max("b"), F.lit(0)).alias("n"), F.count(c).alias("m"), F.coalesce(F.avg(c), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(c), F.lit(0.0)).alias("var"))
    # Moments about the mean of the filled buckets, merged with those of the n - m empty ones: no large squares cancel.
    share = F.col("m") / F.col("n")
    mean = F.col("mean") * share
    spread = F.sqrt(F.col("var") * share + F.col("mean") * F.col("mean") * share * (1 - share))
    expected = F.when(F.col("n") < 2, F.col("value")).otherwise(mean + threshold * spread)
    return row.select((F.col("value") > expected).alias("breached"), "value", expected.alias("expected"))


_THRESHOLDS = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
EPSILON = 2.220446049250313e-16


@dataclass(frozen=True)
class Alert:
    id: str
    viewer_id: str
    op: str
    threshold: float
    severity: str = "warning"
    interval_ms: int = 60_000


def breaches(op: str, value, threshold):
    """Works on numbers and columns alike."""
    if op in _THRESHOLDS:
        return _THRESHOLDS[op](value, threshold)
    if op not in ("==", "!="):
        raise ValueError(f"unknown threshold operator {op}")
    near = (abs if isinstance(value, (int, float)) else F.abs)(value - threshold) < EPSILON
    return near if op == "==" else (not near if isinstance(near, bool) else ~near)


def evaluate_alerts(counts: DataFrame, alerts: list[Alert]) -> DataFrame:
    """alert_id, viewer_id, status, value: ``counts`` has viewer_id and count; a missing viewer is named so."""
    spark = counts.sparkSession
    rows = spark.createDataFrame([(a.id, a.viewer_id, a.op, float(a.threshold)) for a in alerts], "alert_id string, viewer_id string, op string, threshold double")
    joined = rows.join(counts.select("viewer_id", F.col("count").cast("double").alias("value")), "viewer_id", "left")
    met = F.lit(False)
    for op in (">", ">=", "<", "<=", "==", "!="):
        met = F.when(F.col("op") == op, breaches(op, F.col("value"), F.col("threshold"))).otherwise(met)
    status = F.when(F.col("value").isNull(), "missing_viewer").when(met, "breached").otherwise("ok")
    return joined.select("alert_id", "viewer_id", status.alias("status"), "value")


# --- charts ---


def chart_bucket_ms(lookback_ms: int) -> int:
    return 10_000 if lookback_ms <= 300_000 else 60_000 if lookback_ms <= 3_600_000 else 300_000


def _series(metrics: DataFrame) -> DataFrame:
    """Metric rows (metric_name, service_name, observed_at, value) with the name of their series."""
    label = F.concat(F.coalesce("metric_name", F.lit("unknown")), F.lit(" ("), F.coalesce("service_name", F.lit("unknown")), F.lit(")"))
    return metrics.where(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("series", label)


def chart_series(metrics: DataFrame, lookback_ms: int) -> DataFrame:
    """series, bucket_start_ms, value; a series without rows in a bucket that others have is 0 there."""
    rows = _series(metrics).groupBy("series", bucket_start(F.unix_millis("observed_at"), chart_bucket_ms(lookback_ms)).alias("bucket_start_ms")).agg(F.sum("value").alias("value"))
    # Series and buckets are a chart's axes: small sets made from rows that are grouped already.
    grid = rows.agg(F.collect_set("series").alias("s"), F.collect_set("bucket_start_ms").alias("b")).select(F.explode("s").alias("series"), "b").select("series", F.explode("b").alias("bucket_start_ms"))
    return grid.join(rows, ["series", "bucket_start_ms"], "left").select("series", "bucket_start_ms", F.coalesce("value", F.lit(0.0)).alias("value")).orderBy("series", "bucket_start_ms")


def chart_totals(metrics: DataFrame) -> DataFrame:
    return _series(metrics).groupBy("series").agg(F.sum("value").alias("value")).orderBy("series")


def billboard(metrics: DataFrame, lookback_ms: int) -> DataFrame:
    """latest, previous, change_pct of the last two buckets that have rows."""
    totals = _series(metrics).groupBy(bucket_start(F.unix_millis("observed_at"), chart_bucket_ms(lookback_ms)).alias("b")).agg(F.sum("value").alias("v"))
    last = totals.orderBy(F.desc("b")).limit(2).agg(F.max(F.struct("b", "v")).alias("new"), F.min(F.struct("b", "v")).alias("old"), F.count(F.lit(1)).alias("n"))
    row = last.select(F.coalesce("new.v", F.lit(0.0)).alias("latest"), F.when(F.col("n") > 1, F.col("old.v")).alias("previous"))
    return row.withColumn("change_pct", F.when(F.col("previous") != 0, (F.col("latest") - F.col("previous")) / F.col("previous") * 100))


def timeseries(buckets: DataFrame) -> DataFrame:
    """Buckets of a viewer as series: keys joined by ' / ', or ``all``."""
    name = F.when(F.size("group_keys") > 0, F.array_join("group_keys", " / ")).otherwise(F.lit("all"))
    return buckets.select(name.alias("series"), "bucket_start_ms", "value").orderBy("series", "bucket_start_ms")
