"""Small telemetry bodies for tests."""

import json
from datetime import datetime, timedelta, timezone

from spanforge.schema import RAW_ENTRY
from spanforge.sources import otlp

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def attr(key, value):
    kind = "boolValue" if isinstance(value, bool) else "intValue" if isinstance(value, int) else "doubleValue" if isinstance(value, float) else "stringValue"
    return {"key": key, "value": {kind: value}}


def attrs(d):
    return [attr(k, v) for k, v in d.items()]


def span(trace="t", id="s", parent="", name="op", start=1_000_000_000, end=2_000_000_000, status=0, events=(), **a):
    return {"traceId": trace, "spanId": id, "parentSpanId": parent, "name": name, "startTimeUnixNano": str(start), "endTimeUnixNano": end, "status": {"code": status}, "attributes": attrs(a.get("a", {})), "events": list(events)}


def trace_body(*blocks):
    return {"resourceSpans": [{"resource": {"attributes": attrs({"service.name": s} if s else {})}, "scopeSpans": [{"spans": list(spans)}]} for s, spans in blocks]}


def metric_body(*blocks):
    return {"resourceMetrics": [{"resource": {"attributes": attrs(a)}, "scopeMetrics": [{"metrics": [{"name": n, kind: {"dataPoints": points}} for n, kind, points in ms]}]} for a, ms in blocks]}


def log_body(*records, **resource):
    return {"resourceLogs": [{"resource": {"attributes": attrs(resource)}, "scopeLogs": [{"logRecords": list(records)}]}]}


def raw(spark, *rows):
    """rows: (signal, age in ms, service, body)."""
    data = [(i, int((T0 - timedelta(milliseconds=age)).timestamp() * 1000), i, signal, T0 - timedelta(milliseconds=age), service, body if isinstance(body, (bytes, bytearray)) else json.dumps(body).encode()) for i, (signal, age, service, body) in enumerate(rows)]
    return spark.createDataFrame(data, RAW_ENTRY)


def bodies(spark, *rows):
    return otlp.decode_bodies(raw(spark, *rows))
