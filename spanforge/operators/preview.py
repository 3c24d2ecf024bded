"""One-line previews of requests and rows of metrics, for tables that show the newest entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import attribute_text, squeeze
from ..plans.dialect import number_text
from ..schema import SHOWN_METRICS
from ..sources.otlp import _attrs, _exploded, _inner, _parsed, body_text, service_name
from .viewers import newest

WIDTH = 160
HEX_BYTES = 24


def cut(text):
    return F.when(F.char_length(text) > WIDTH, F.concat(F.substring(text, 1, WIDTH), F.lit("..."))).otherwise(text)


def raw_preview(payload):
    """Text on one line, or the first bytes in hex where the payload is no text."""
    text = squeeze(F.try_validate_utf8(payload))
    shown = F.when(text == "", "(empty payload)").otherwise(cut(text))
    first = F.lower(F.hex(F.substring(payload, 1, HEX_BYTES)))
    return F.coalesce(shown, F.when(F.octet_length(payload) > HEX_BYTES, F.concat(first, F.lit("..."))).otherwise(first))


def structured(bodies: DataFrame) -> DataFrame:
    """(entry_id, structured): what a decoded request shows, as ``service=.. | span=.. | otlp_json``; null if nothing."""
    p = F.col("p")
    first = lambda a, f: F.get(F.filter(F.transform(a, f), lambda x: x.isNotNull()), F.lit(0))
    part = lambda name, x: F.concat(F.lit(f"{name}="), x)
    line = lambda *parts: F.when(F.coalesce(*parts).isNotNull(), F.concat_ws(" | ", *parts, F.lit("otlp_json")))
    spans = _inner(p, "resourceSpans", "scopeSpans", "spans")
    traces = _parsed(bodies, "traces").select("entry_id", line(part("service", service_name(p, "resourceSpans")), part("span", first(spans, lambda s: s["name"]))).alias("structured"))
    records = _inner(p, "resourceLogs", "scopeLogs", "logRecords")
    logs = _parsed(bodies, "logs").select(
        "entry_id",
        line(part("service", service_name(p, "resourceLogs")), part("severity", first(records, lambda r: r["severityText"])), part("body", squeeze(first(records, lambda r: body_text(r["body"]))))).alias("structured"),
    )
    metrics = _inner(p, "resourceMetrics", "scopeMetrics", "metrics")
    name, value = first(metrics, lambda m: m["name"]), first(metrics, shown_value).try_cast("double")
    shown = F.when(name.isNotNull(), part("value", number_text(value)))
    measured = _parsed(bodies, "metrics", SHOWN_METRICS).select("entry_id", line(part("service", service_name(p, "resourceMetrics")), part("metric", name), shown).alias("structured"))
    return traces.unionByName(logs).unionByName(measured)


def preview(bodies: DataFrame, n: int = 50) -> DataFrame:
    """The newest requests: observed_at, signal, service_name, payload_size, preview, metric_name, metric_value."""
    rows = newest(bodies, n)
    shown = structured(rows).join(first_metric(rows), "entry_id", "left")
    text = F.coalesce(cut(F.col("structured")), raw_preview(F.col("payload")))
    out = rows.join(shown, "entry_id", "left").orderBy(F.desc("stream_ms"), F.desc("stream_seq"))
    return out.select("observed_at", "signal", "service_name", F.octet_length("payload").alias("payload_size"), text.alias("preview"), "metric_name", "metric_value")


def shown_value(metric):
    """First point of sum, then gauge, as shown: asInt before asDouble, any scalar."""
    point = lambda k: F.get(metric[k]["dataPoints"], F.lit(0))
    return F.coalesce(*(point(k)[v] for k in ("sum", "gauge") for v in ("asInt", "asDouble")))


def metric_rows(bodies: DataFrame, query: str | None = None) -> DataFrame:
    """A row each metric whose name holds the query: observed_at, service_name, metric_name, metric_value."""
    x = _exploded(_parsed(bodies, "metrics", SHOWN_METRICS), "resourceMetrics", "scopeMetrics", "metrics").where("x.name IS NOT NULL")
    if query:
        x = x.where(F.lower("x.name").contains(query.lower()))
    service = attribute_text(_attrs("resource"), "service.name")
    return x.select("entry_id", "ord", "observed_at", service.alias("service_name"), F.col("x.name").alias("metric_name"), shown_value(F.col("x")).try_cast("double").alias("metric_value"))


def first_metric(bodies: DataFrame, query: str | None = None) -> DataFrame:
    """Per entry the first metric that meets the query, else the first name and, apart from it, the first value."""
    q = (query or "").lower()
    rows = metric_rows(bodies)
    met = F.lower("metric_name").contains(q) if q else F.lit(True)
    pick = lambda c, when: F.min_by(c, F.when(when, F.col("ord")))
    out = rows.groupBy("entry_id").agg(
        F.bool_or(met).alias("met"),
        pick("metric_name", met).alias("n1"),
        pick("metric_value", met).alias("v1"),
        pick("metric_name", F.lit(True)).alias("n2"),
        pick("metric_value", F.col("metric_value").isNotNull()).alias("v2"),
    )
    return out.select("entry_id", F.when(F.col("met"), F.col("n1")).otherwise(F.col("n2")).alias("metric_name"), F.when(F.col("met") & F.lit(bool(q)), F.col("v1")).otherwise(F.col("v2")).alias("metric_value"))
