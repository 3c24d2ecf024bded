"""Viewers: saved filters over entries with an optional time-bucket aggregation.

Entries hold one request a row: signal, observed_at, service_name, payload_text, and for metrics ``metrics``
(name, first value and number of the owning resource of each metric) and ``resources`` (their attributes).
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass, field
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import attribute_text, bucket_start
from ..schema import RESOURCES
from . import dispatch, patterns
from .selection import at_ranks

SIGNAL_BITS = {"traces": 1, "metrics": 2, "logs": 4}
FIELDS = {"service_name": "service_name", "payload": "payload_text"}
FUNCTIONS = ("count", "sum", "avg", "p50", "p95", "p99", "rate")
GROUP_KEYS = ("service_name", "k8s.node.name", "k8s.cluster.name", "k8s.namespace.name", "k8s.pod.name", "host.name")
CHARTS = ("table", "stacked_bar", "line", "area", "pie", "donut", "billboard", "timeseries")
UNKNOWN = "unknown"
#: Viewers up to which each is a condition of its own; beyond some hundred, generated code gets too large to be compiled.
FEW_VIEWERS = 64


class ViewerError(ValueError):
    def __init__(self, kind: str, detail: object = ""):
        super().__init__(f"{kind}: {detail}")
        self.kind = kind


@dataclass(frozen=True)
class Aggregation:
    fn: str
    bucket_ms: int
    group_by: tuple[str, ...] = ()
    metric_name: str | None = None

    def to_json(self) -> dict:
        out = {"fn": self.fn, "bucket_ms": self.bucket_ms}
        return out | ({"group_by": list(self.group_by)} if self.group_by else {}) | ({"metric_name": self.metric_name} if self.metric_name is not None else {})


@dataclass(frozen=True)
class Viewer:
    id: str
    signal_mask: int
    lookback_ms: int
    query: str | None = None
    filters: tuple[tuple[str, str, str], ...] = ()
    any_filter: bool = False
    aggregation: Aggregation | None = None
    revision: int = 0
    definition: dict = field(default_factory=dict, hash=False, compare=False)

    def signals(self) -> list[str]:
        return [s for s, bit in SIGNAL_BITS.items() if self.signal_mask & bit]

    def predicate(self) -> Column:
        """Entries of the watched signals that meet the filters, or without filters the query."""
        watched = F.col("signal").isin(self.signals())
        if self.filters:
            tests = [_test(*f) for f in self.filters]
            return watched & functools.reduce(operator.or_ if self.any_filter else operator.and_, tests)
        if self.query:
            meets = lambda c: F.coalesce(F.lower(c).contains(self.query), F.lit(False))
            return watched & (meets("service_name") | meets("payload_text"))
        return watched


def _test(name: str, op: str, value: str) -> Column:
    x = F.col(FIELDS[name])
    if op == "regex":
        found = patterns.found(x, value)
    else:
        found = F.lower(x) == value.lower() if op == "eq" else F.lower(x).contains(value.lower())
    return F.coalesce(found, F.lit(False))


def check_pattern(pattern: str) -> None:
    """By the dialect's rules, then by the engine that will run it, where a session is there."""
    from pyspark.errors import PySparkException
    from pyspark.sql import SparkSession

    try:
        made = patterns.read(pattern)
        session = SparkSession.getActiveSession()
        if made.nested:
            pc.match_substring_regex(pa.array([""]), made.linear)
        elif session is not None:
            session.sparkContext._jvm.java.util.regex.Pattern.compile(made.java)
    except (patterns.PatternError, pa.ArrowInvalid) as e:
        raise ViewerError("InvalidFilterRegex", e) from None
    except (Py4JJavaError, PySparkException) as e:
        raise ViewerError("InvalidFilterRegex", str(e).splitlines()[0]) from None


def parse_aggregation(definition: dict) -> Aggregation | None:
    if "aggregation" not in definition:
        return None
    raw = definition["aggregation"]
    if not isinstance(raw, dict):
        raise ViewerError("InvalidAggregation", "not an object")
    if not isinstance(raw.get("fn"), str):
        raise ViewerError("InvalidAggregation", "missing fn")
    if raw["fn"] not in FUNCTIONS:
        raise ViewerError("InvalidAggregation", f"unknown fn {raw['fn']}")
    width = raw.get("bucket_ms")
    if isinstance(width, bool) or not isinstance(width, int) or width <= 0:
        raise ViewerError("InvalidAggregation", f"bucket_ms {width}")
    group = raw.get("group_by", [])
    if not isinstance(group, list):
        raise ViewerError("InvalidAggregation", "group_by is no array")
    name = raw.get("metric_name")
    return Aggregation(raw["fn"], width, tuple(g for g in group if g in GROUP_KEYS), name if isinstance(name, str) else None)


def compile_viewer(definition: dict) -> Viewer:
    """Checks a definition: id, signal_mask, lookback_ms, definition_json (query, filters, filter_mode, aggregation)."""
    mask = definition["signal_mask"] & 7
    if not mask:
        raise ViewerError("ZeroSignalMask")
    lookback = definition["lookback_ms"]
    if lookback <= 0:
        raise ViewerError("NonPositiveLookback", lookback)
    body = definition.get("definition_json") or {}
    query = body.get("query")
    query = query.strip().lower() if isinstance(query, str) else ""
    raw = body.get("filters", [])
    if not isinstance(raw, list):
        raise ViewerError("FiltersNotArray")
    filters = []
    for f in raw:
        text = {k: f.get(k) if isinstance(f, dict) and isinstance(f.get(k), str) else "" for k in ("field", "op", "value")}
        if text["field"] not in FIELDS:
            raise ViewerError("InvalidFilterField", text["field"])
        if not text["value"]:
            raise ViewerError("EmptyFilterValue")
        if text["op"] not in ("eq", "contains", "regex"):
            raise ViewerError("InvalidFilterOp", text["op"])
        if text["op"] == "regex":
            check_pattern(text["value"])
        filters.append((text["field"], text["op"], text["value"]))
    mode = body.get("filter_mode", "and")
    if mode not in ("and", "or"):
        raise ViewerError("InvalidFilterMode", mode)
    return Viewer(str(definition.get("id", "")), mask, lookback, query or None, tuple(filters), mode == "or", parse_aggregation(body), int(definition.get("revision", 0)), definition)


def check_group_by(keys: list[str]) -> None:
    """The interface refuses keys that ``parse_aggregation`` only skips."""
    for k in keys:
        if k not in GROUP_KEYS:
            raise ViewerError("UnknownGroupKey", k)


def check_chart(chart: str, signals: list[str]) -> None:
    if chart not in CHARTS:
        raise ViewerError("UnknownChart", chart)
    if chart not in ("table", "timeseries") and signals != ["metrics"]:
        raise ViewerError("ChartNeedsMetrics", chart)


def within_lookback(entries: DataFrame, lookback_ms: int, now: datetime, inclusive: bool = False) -> DataFrame:
    """Entries younger than the look-back; an entry on the bound stays only if ``inclusive``."""
    bound = F.lit(now - timedelta(milliseconds=lookback_ms))
    return entries.where(F.col("observed_at") >= bound if inclusive else F.col("observed_at") > bound)


def query_lookback(lookback_ms: int | None, default: int = 300_000, most: int = 86_400_000) -> int:
    return default if not lookback_ms or lookback_ms <= 0 else min(lookback_ms, most)


def matching(viewer: Viewer, entries: DataFrame, now: datetime) -> DataFrame:
    return within_lookback(entries.where(viewer.predicate()), viewer.lookback_ms, now)


def fan_out(viewers: list[Viewer], entries: DataFrame, now: datetime | None = None) -> DataFrame:
    """Each entry once for every viewer that it meets, within its look-back where ``now`` is given, in one pass: adds ``viewer_id``.

    A few viewers are conditions in generated code; many are looked up by one automaton.
    """
    if len(viewers) > FEW_VIEWERS:
        return dispatch.fan_out(viewers, entries, FIELDS, now)
    meets = lambda v: v.predicate() if now is None else v.predicate() & (F.col("observed_at") > F.lit(now - timedelta(milliseconds=v.lookback_ms)))
    ids = F.array_compact(F.array(*(F.when(meets(v), F.lit(v.id)) for v in viewers)))
    return entries.withColumn("viewer_id", F.explode(ids))


def dashboard_filter(entries: DataFrame, services: str | None = None, query: str | None = None) -> DataFrame:
    """Services as a comma list, case and all, a missing one as ''; the query as a part of service or payload."""
    names = [s.strip() for s in (services or "").split(",") if s.strip()]
    if names:
        entries = entries.where(F.coalesce("service_name", F.lit("")).isin(names))
    q = (query or "").strip().lower()
    if q:
        entries = entries.where(F.lower(F.coalesce("service_name", F.lit(""))).contains(q) | F.lower(F.coalesce("payload_text", F.lit(""))).contains(q))
    return entries


def services(entries: DataFrame) -> DataFrame:
    return entries.where("service_name is not null").select("service_name").distinct().orderBy("service_name")


def _key(name: str, owner: Column | None) -> Column:
    """A group key of an entry: from the owning resource, else from the first resource that has it."""
    rest = attribute_text(F.flatten(F.coalesce("resources", F.array().cast(RESOURCES))), name)
    rest = F.col("service_name") if name == "service_name" else F.when(F.col("signal") == "metrics", rest)
    own = attribute_text(F.get("resources", owner), name) if owner is not None else F.lit(None).cast("string")
    return F.coalesce(own, rest, F.lit(UNKNOWN))


def inputs(agg: Aggregation, entries: DataFrame, *more) -> DataFrame:
    """(bucket_start_ms, group_keys, value) that entries put into the aggregation, behind ``more`` columns of theirs.

    Without a metric name an entry gives one, with its first value; with one each metric of the name gives one, and
    an entry without any still gives one that has no value.
    """
    bucket = bucket_start(F.unix_millis("observed_at"), agg.bucket_ms).alias("bucket_start_ms")
    if agg.metric_name is None:
        keys = F.array(*(_key(k, None) for k in agg.group_by)) if agg.group_by else F.array().cast("array<string>")
        value = F.when(F.col("signal") == "metrics", F.get(F.filter("metrics", lambda m: m["value"].isNotNull()), F.lit(0))["value"])
        return entries.select(*more, bucket, keys.alias("group_keys"), value.alias("value"))
    named = F.filter("metrics", lambda m: m["name"] == agg.metric_name)
    one = entries.withColumn("_m", F.explode_outer(F.when(F.col("signal") == "metrics", named)))
    keys = F.array(*(_key(k, F.col("_m.rs")) for k in agg.group_by)) if agg.group_by else F.array().cast("array<string>")
    return one.select(*more, bucket, keys.alias("group_keys"), F.col("_m.value").alias("value"))


def aggregate(agg: Aggregation, entries: DataFrame) -> DataFrame:
    """bucket_start_ms, group_keys, value; buckets without inputs are left out."""
    rows, by = inputs(agg, entries), ["bucket_start_ms", "group_keys"]
    if agg.fn[0] == "p":
        return at_ranks(rows, by, "value", {"p": int(agg.fn[1:]) / 100}).select(*by, F.col("p").alias("value")).orderBy(*by)
    n = F.count(F.lit(1)).cast("double")
    made = {"count": n, "rate": n / (agg.bucket_ms / 1000), "sum": F.sum("value"), "avg": F.avg("value")}[agg.fn]
    if agg.fn not in ("count", "rate"):
        rows = rows.where("value is not null")
    return rows.groupBy(*by).agg(made.alias("value")).orderBy(*by)


def newest(entries: DataFrame, n: int = 50) -> DataFrame:
    return entries.orderBy(F.desc("stream_ms"), F.desc("stream_seq")).limit(n)


def read_since(entries: DataFrame, signal: str, cursor: tuple[int, int] | None, n: int) -> DataFrame:
    """The oldest ``n`` entries after a stream position."""
    rows = entries.where(F.col("signal") == signal)
    if cursor is not None:
        rows = rows.where((F.col("stream_ms") > cursor[0]) | (F.col("stream_ms") == cursor[0]) & (F.col("stream_seq") > cursor[1]))
    return rows.orderBy("stream_ms", "stream_seq").limit(n)


def scan_cap(entries: DataFrame, n: int = 100_000) -> DataFrame:
    """The oldest ``n`` entries, for interfaces that state such a bound."""
    return entries.orderBy("stream_ms", "stream_seq").limit(n)
