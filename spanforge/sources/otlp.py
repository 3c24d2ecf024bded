"""Request bodies to typed tables: media types, decompression, JSON and protobuf, then columns.

``decode_bodies`` turns landed bodies into JSON text (only protobuf and compressed bodies cost Python time);
``entries``, ``spans``, ``metric_points`` and ``log_records`` parse that text once each with ``from_json`` and keep
the arrival order of nested parts in ``ord``.  A part of the wrong shape is passed over, never an error.
"""

from __future__ import annotations

import base64
import gzip
import json
import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import attribute_text, nanos
from ..schema import BODIES, KINDS, METRICS, RESOURCE, RESOURCES

MEDIA_TYPES = {"application/x-protobuf": "protobuf", "application/json": "json"}
ENCODINGS = ("identity", "gzip", "zstd", "snappy", "lz4")
MAX_BODY = 4 << 20


class BodyError(ValueError):
    """``status``: the answer a server would give."""

    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status = status


def media_type(header: str | None) -> str:
    """``protobuf`` or ``json``; parameters are passed over, case counts."""
    name = (header or "").split(";")[0].strip()
    if name not in MEDIA_TYPES:
        raise BodyError(415, f"unsupported content type {header!r}")
    return MEDIA_TYPES[name]


def decompress(body: bytes, encoding: str | None) -> bytes:
    name = (encoding or "identity").strip()
    try:
        if name in ("", "identity"):
            out = body
        elif name == "gzip":
            out = gzip.decompress(body)
        elif name == "zstd":
            import zstandard

            out = zstandard.ZstdDecompressor().decompressobj().decompress(body)
        elif name == "snappy":
            out = _snappy_frames(body)
        elif name == "lz4":
            out = pa.input_stream(pa.BufferReader(body), compression="lz4").read()
        else:
            raise BodyError(415, f"unsupported content encoding {encoding!r}")
    except BodyError:
        raise
    except Exception as e:
        raise BodyError(400, f"bad {name} body: {e}") from e
    if len(out) > MAX_BODY:
        raise BodyError(413, "body too large")
    return out


def _snappy_frames(body: bytes) -> bytes:
    """The framing format: chunks of (type, 3-byte length); 0 is compressed, 1 is not, both after a checksum."""
    at, out, codec = 0, [], pa.Codec("snappy")
    if body[:10] != b"\xff\x06\x00\x00sNaPpY":
        raise ValueError("no stream identifier")
    while at < len(body):
        kind, size = body[at], int.from_bytes(body[at + 1 : at + 4], "little")
        data = body[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0:
            size, shift = 0, 0
            for b in data[4:9]:
                size |= (b & 127) << shift
                shift += 7
                if b < 128:
                    break
            out.append(codec.decompress(data[4:], size).to_pybytes())
        elif kind == 1:
            out.append(data[4:])
        elif kind in range(2, 0x80):
            raise ValueError(f"chunk type {kind}")
    return b"".join(out)


# --- protobuf: the few messages that the operators read, by field number ---
# The public field numbers and wire shapes of the telemetry messages.
_ANY = {1: ("stringValue", "text"), 2: ("boolValue", "bool"), 3: ("intValue", "int64"), 4: ("doubleValue", "double"), 5: ("arrayValue", {1: ("values", ["any"])}), 6: ("kvlistValue", {1: ("values", ["pair"])}), 7: ("bytesValue", "bytes")}
_PAIR = {1: ("key", "text"), 2: ("value", "any")}
_RESOURCE = {1: ("attributes", ["pair"])}
_EVENT = {1: ("timeUnixNano", "fixed64"), 2: ("name", "text"), 3: ("attributes", ["pair"])}
_STATUS = {2: ("message", "text"), 3: ("code", "int")}
_SPAN = {1: ("traceId", "hex"), 2: ("spanId", "hex"), 4: ("parentSpanId", "hex"), 5: ("name", "text"), 6: ("kind", "int"), 7: ("startTimeUnixNano", "fixed64"), 8: ("endTimeUnixNano", "fixed64"), 9: ("attributes", ["pair"]), 11: ("events", [_EVENT]), 15: ("status", _STATUS)}
_NUMBER = {3: ("timeUnixNano", "fixed64"), 4: ("asDouble", "double"), 6: ("asInt", "sfixed64"), 7: ("attributes", ["pair"])}
_HISTOGRAM = {3: ("timeUnixNano", "fixed64"), 4: ("count", "fixed64"), 5: ("sum", "double"), 9: ("attributes", ["pair"])}
_EXPONENTIAL = {1: ("attributes", ["pair"]), 3: ("timeUnixNano", "fixed64"), 4: ("count", "fixed64"), 5: ("sum", "double")}
_SUMMARY = {3: ("timeUnixNano", "fixed64"), 4: ("count", "fixed64"), 5: ("sum", "double"), 7: ("attributes", ["pair"])}
_METRIC = {1: ("name", "text"), 5: ("gauge", {1: ("dataPoints", [_NUMBER])}), 7: ("sum", {1: ("dataPoints", [_NUMBER])}), 9: ("histogram", {1: ("dataPoints", [_HISTOGRAM])}), 10: ("exponentialHistogram", {1: ("dataPoints", [_EXPONENTIAL])}), 11: ("summary", {1: ("dataPoints", [_SUMMARY])})}
_RECORD = {1: ("timeUnixNano", "fixed64"), 2: ("severityNumber", "int"), 3: ("severityText", "text"), 5: ("body", "any"), 6: ("attributes", ["pair"]), 9: ("traceId", "hex"), 10: ("spanId", "hex")}
_REQUEST = {
    "traces": {1: ("resourceSpans", [{1: ("resource", _RESOURCE), 2: ("scopeSpans", [{2: ("spans", [_SPAN])}])}])},
    "metrics": {1: ("resourceMetrics", [{1: ("resource", _RESOURCE), 2: ("scopeMetrics", [{2: ("metrics", [_METRIC])}])}])},
    "logs": {1: ("resourceLogs", [{1: ("resource", _RESOURCE), 2: ("scopeLogs", [{2: ("logRecords", [_RECORD])}])}])},
}


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        value |= (b & 127) << shift
        at += 1
        if b < 128:
            return value, at
        shift += 7
        if shift > 63:
            raise ValueError("varint too long")


def _scalar(kind: str, wire: int, value: int | bytes):
    if kind == "text":
        return value.decode()
    if kind == "hex":
        return value.hex()
    if kind == "bytes":
        return base64.b64encode(value).decode()
    if kind == "bool":
        return bool(value)
    if kind == "int":
        return value - (1 << 64) if value >> 63 else value
    if kind == "int64":
        return str(value - (1 << 64) if value >> 63 else value)
    if kind == "double":
        return struct.unpack("<d", value)[0]
    number = struct.unpack("<q" if kind == "sfixed64" else "<Q", value)[0]
    return str(number)


def message(raw: bytes, shape: dict) -> dict:
    """A message by its shape, as JSON-like values with hex ids and numeric enums; unknown fields are skipped."""
    out: dict = {}
    at = 0
    while at < len(raw):
        tag, at = _varint(raw, at)
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            value, at = _varint(raw, at)
        elif wire in (1, 5):
            value, at = raw[at : at + (8 if wire == 1 else 4)], at + (8 if wire == 1 else 4)
        elif wire == 2:
            size, at = _varint(raw, at)
            value, at = raw[at : at + size], at + size
            if len(value) != size:
                raise ValueError("truncated")
        else:
            raise ValueError(f"wire type {wire}")
        if at > len(raw) or not number:
            raise ValueError("truncated")
        if number not in shape:
            continue
        name, kind = shape[number]
        inner = kind[0] if isinstance(kind, list) else kind
        inner = {"any": _ANY, "pair": _PAIR}.get(inner, inner) if isinstance(inner, str) else inner
        made = message(value, inner) if isinstance(inner, dict) else _scalar(inner, wire, value)
        if isinstance(kind, list):
            out.setdefault(name, []).append(made)
        else:
            out[name] = made
    return out


def to_json(signal: str, body: bytes) -> str | None:
    """A body as JSON text: JSON by its first byte if it parses, else protobuf, else null."""
    head = body.lstrip()[:1]
    if head in (b"{", b"["):
        try:
            text = body.decode()
            json.loads(text)
            return text
        except ValueError:
            pass
    try:
        return json.dumps(message(body, _REQUEST[signal]), ensure_ascii=False) if body else None
    except (ValueError, IndexError, struct.error, TypeError, AttributeError):
        return None


def normalize(raw: DataFrame) -> DataFrame:
    """Landed requests (signal, content_type, content_encoding, body) with ``payload`` and ``status``.

    ``status`` is 200, or what a server would answer to a body that it does not take.
    """

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            types, encodings, bodies = (batch.column(names.index(n)).to_pylist() for n in ("content_type", "content_encoding", "body"))
            payloads, status = [], []
            for t, e, b in zip(types, encodings, bodies):
                try:
                    if len(b or b"") > MAX_BODY:
                        raise BodyError(413, "body too large")
                    media_type(t)
                    payloads.append(decompress(b or b"", e))
                    status.append(200)
                except BodyError as x:
                    payloads.append(None)
                    status.append(x.status)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(payloads, pa.binary()), pa.array(status, pa.int32())], [*names, "payload", "status"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in raw.schema.fields)
    return raw.mapInArrow(run, f"{fields}, payload binary, status int")


def decode_bodies(raw: DataFrame) -> DataFrame:
    """Raw entries with ``body``: the payload as JSON text.

    Payloads that begin like JSON stay in the JVM; only the others go through Python.
    """

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            out = [to_json(s, p) if p is not None else None for s, p in zip(batch.column(names.index("signal")).to_pylist(), batch.column(names.index("payload")).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*names, "body"])

    text = F.try_validate_utf8(F.col("payload"))
    is_json = F.coalesce(text.rlike(r"^\s*[{\[]"), F.lit(False))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in raw.schema.fields)
    return raw.where(is_json).withColumn("body", text).unionByName(raw.where(~is_json).mapInArrow(run, f"{fields}, body string"))


def parse(entries: DataFrame) -> DataFrame:
    """Adds ``parsed``: the body by its signal.  What reads it later does not parse again."""
    by_signal = (F.when(F.col("signal") == s, F.from_json("body", shape, {"mode": "PERMISSIVE"})).alias(s) for s, shape in BODIES.items())
    return entries.withColumn("parsed", F.struct(*by_signal))


def _parsed(entries: DataFrame, signal: str, shape: str | None = None) -> DataFrame:
    """Entries of a signal with ``p``, their parsed body: each is parsed once; ``shape``: other types than the tables'."""
    if shape is not None:
        return entries.where(F.col("signal") == signal).withColumn("p", F.from_json("body", shape, {"mode": "PERMISSIVE"}))
    if "parsed" in entries.columns:
        return entries.where(F.col("signal") == signal).withColumn("p", F.col(f"parsed.{signal}"))
    return entries.where(F.col("signal") == signal).withColumn("p", F.from_json("body", BODIES[signal], {"mode": "PERMISSIVE"}))


def _exploded(df: DataFrame, outer: str, middle: str, inner: str) -> DataFrame:
    """Rows of the innermost parts with their place: part ``x``, its resource's attributes ``resource``, ``ord``.

    Rows carry nothing else of the body: with the part that they come from in each of them, a body's rows would take the
    square of its size.
    """
    keep = [c for c in ("entry_id", "signal", "observed_at", "service_name", "stream_ms", "stream_seq") if c in df.columns]
    a = df.select(*keep, F.posexplode(f"p.{outer}").alias("rs", "r"))
    a = a.select(*keep, "rs", F.col("r.resource.attributes").alias("resource"), F.col(f"r.{middle}").alias("inside"))
    b = a.select(*keep, "rs", "resource", F.posexplode("inside").alias("ss", "s"))
    b = b.select(*keep, "rs", "ss", "resource", F.col(f"s.{inner}").alias("inside"))
    c = b.select(*keep, "rs", "ss", "resource", F.posexplode("inside").alias("i", "x"))
    return c.withColumn("ord", F.struct(F.col("stream_ms").alias("ms"), F.col("stream_seq").alias("seq"), "rs", "ss", "i"))


def _attrs(path: str) -> Column:
    return F.coalesce(F.col(path), F.array().cast(RESOURCES[6:-1]))


def spans(bodies: DataFrame) -> DataFrame:
    x = _exploded(_parsed(bodies, "traces"), "resourceSpans", "scopeSpans", "spans").where("x IS NOT NULL")
    return x.select(
        "entry_id", "ord", "observed_at", F.col("service_name").alias("entry_service_name"), attribute_text(_attrs("resource"), "service.name").alias("resource_service_name"),
        F.coalesce("x.traceId", F.lit("")).alias("trace_id"), F.coalesce("x.spanId", F.lit("")).alias("span_id"), F.coalesce("x.parentSpanId", F.lit("")).alias("parent_span_id"), F.coalesce("x.name", F.lit("")).alias("name"),
        F.col("x.kind").try_cast("int").alias("kind"), nanos(F.col("x.startTimeUnixNano")).alias("start_ns"), nanos(F.col("x.endTimeUnixNano")).alias("end_ns"),
        F.coalesce(F.col("x.status.code").try_cast("int"), F.lit(0)).alias("status_code"), F.col("x.status.message").alias("status_message"),
        _attrs("resource").alias("resource_attrs"), _attrs("x.attributes").alias("attrs"), F.col("x.events").alias("events"),
    )


def point_value(point: Column) -> Column:
    """asDouble, asInt, then sum of a data point, of JSON numbers; asInt may also be a whole number in quotes."""
    number = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    whole = F.when(point["asInt"].rlike(r"^[+-]?[0-9]+$"), point["asInt"].try_cast("bigint").cast("double"))
    return F.coalesce(number(point["asDouble"]), whole, number(point["sum"]))


def metric_value(metric: Column) -> Column:
    """First data point of sum, gauge, histogram that has a value."""
    return F.coalesce(*(F.get(F.filter(F.transform(metric[k]["dataPoints"], point_value), lambda v: v.isNotNull()), F.lit(0)) for k in ("sum", "gauge", "histogram")))


def metric_points(bodies: DataFrame) -> DataFrame:
    """One row a data point."""
    x = _exploded(_parsed(bodies, "metrics"), "resourceMetrics", "scopeMetrics", "metrics").where("x IS NOT NULL")

    def of(kind: str) -> Column:
        shaped = F.transform(F.col(f"x.{kind}.dataPoints"), lambda p: F.struct(F.lit(kind).alias("kind"), point_value(p).alias("value"), p["attributes"].alias("attributes")))
        return F.coalesce(shaped, F.array())

    points = F.flatten(F.array(*map(of, KINDS)))
    y = x.select("entry_id", "ord", "observed_at", F.col("service_name").alias("entry_service_name"), _attrs("resource").alias("resource_attrs"), F.col("x.name").alias("metric_name"), F.posexplode(points).alias("point_idx", "pt"))
    return y.select("entry_id", "ord", "observed_at", "entry_service_name", "resource_attrs", "metric_name", "pt.kind", "point_idx", "pt.value", F.col("pt.attributes").alias("attrs"))


def body_text(raw: Column) -> Column:
    """A log body: its string value, or itself where it is a plain string."""
    shaped = raw.rlike(r"^\s*[{\[]")
    return F.when(shaped, F.get_json_object(raw, "$.stringValue")).otherwise(raw)


def log_records(bodies: DataFrame) -> DataFrame:
    x = _exploded(_parsed(bodies, "logs"), "resourceLogs", "scopeLogs", "logRecords").where("x IS NOT NULL")
    return x.select(
        "entry_id", "ord", "observed_at", F.col("service_name").alias("entry_service_name"), attribute_text(_attrs("resource"), "service.name").alias("resource_service_name"),
        F.col("x.severityText").alias("severity_text"), F.col("x.severityNumber").try_cast("int").alias("severity_number"), body_text(F.col("x.body")).alias("body"), _attrs("x.attributes").alias("attrs"),
    )


def service_name(p: Column, outer: str) -> Column:
    """The first resource block with a string ``service.name``."""
    names = F.transform(p[outer], lambda r: attribute_text(r["resource"]["attributes"], "service.name"))
    return F.get(F.filter(names, lambda n: n.isNotNull()), F.lit(0))


_OUTER = {"traces": "resourceSpans", "metrics": "resourceMetrics", "logs": "resourceLogs"}


def name_services(bodies: DataFrame) -> DataFrame:
    """``service_name`` of new entries from their bodies; only the resource blocks are parsed."""
    if "parsed" in bodies.columns:
        found = F.coalesce(*(F.when(F.col("signal") == s, service_name(F.col(f"parsed.{s}"), o)) for s, o in _OUTER.items()))
        return bodies.withColumn("service_name", F.coalesce("service_name", found))
    shape = "struct<" + ",".join(f"{o}:array<struct<resource:{RESOURCE}>>" for o in _OUTER.values()) + ">"
    parsed = bodies.withColumn("_p", F.from_json("body", shape, {"mode": "PERMISSIVE"}))
    found = F.coalesce(*(F.when(F.col("signal") == s, service_name(F.col("_p"), o)) for s, o in _OUTER.items()))
    return parsed.withColumn("service_name", F.coalesce("service_name", found)).drop("_p")


def _joined(texts: Column) -> Column:
    kept = F.filter(texts, lambda t: t.isNotNull() & (t != ""))
    return F.when(F.size(kept) > 0, F.array_join(kept, " "))


def _inner(p: Column, outer: str, middle: str, inner: str) -> Column:
    return F.flatten(F.flatten(F.transform(F.filter(p[outer], lambda r: r[middle].isNotNull()), lambda r: F.transform(F.filter(r[middle], lambda s: s[inner].isNotNull()), lambda s: s[inner]))))


def entries(bodies: DataFrame) -> DataFrame:
    """The row that dialect and viewers read, one a request; a remote call (``transport``) has its service's name already."""
    keep = ["entry_id", "stream_ms", "stream_seq", "signal", "observed_at"]
    p = F.col("p")
    no_number = F.lit(None).cast("double")
    t = _inner(p, "resourceSpans", "scopeSpans", "spans")
    start, end = (lambda s: nanos(s["startTimeUnixNano"])), (lambda s: nanos(s["endTimeUnixNano"]))
    good = F.filter(t, lambda s: (start(s) > 0) & (end(s) >= start(s)))
    lasted = F.array_max(F.transform(good, lambda s: ((end(s) - start(s)) / 1e6).cast("double")))
    settled = "transport" in bodies.columns
    named = lambda outer: (F.col("service_name") if settled else F.coalesce("service_name", service_name(p, outer))).alias("service_name")
    none_m, none_r = F.lit(None).cast(METRICS).alias("metrics"), F.lit(None).cast(RESOURCES).alias("resources")
    traces = _parsed(bodies, "traces").select(*keep, named("resourceSpans"), lasted.alias("duration_ms"), _joined(F.transform(t, lambda s: s["name"])).alias("payload_text"), none_m, none_r)
    m = F.flatten(F.transform(p["resourceMetrics"], lambda r, i: F.transform(F.flatten(F.transform(F.filter(r["scopeMetrics"], lambda s: s["metrics"].isNotNull()), lambda s: s["metrics"])), lambda x: F.struct(x["name"].alias("name"), metric_value(x).alias("value"), i.alias("rs")))))
    resources = F.transform(p["resourceMetrics"], lambda r: F.coalesce(r["resource"]["attributes"], F.array().cast(RESOURCES[6:-1])))
    metrics = _parsed(bodies, "metrics").select(*keep, named("resourceMetrics"), no_number.alias("duration_ms"), _joined(F.transform(m, lambda x: x["name"])).alias("payload_text"), m.cast(METRICS).alias("metrics"), resources.alias("resources"))
    g = _inner(p, "resourceLogs", "scopeLogs", "logRecords")
    words = F.flatten(F.transform(g, lambda r: F.array(r["severityText"], body_text(r["body"]))))
    logs = _parsed(bodies, "logs").select(*keep, named("resourceLogs"), no_number.alias("duration_ms"), _joined(words).alias("payload_text"), none_m, none_r)
    return traces.unionByName(metrics).unionByName(logs)


def indexable_attributes(bodies: DataFrame) -> list[DataFrame]:
    """Sources for the attribute index: resource and own attributes of spans, data points and records."""
    s, m, g = spans(bodies), metric_points(bodies), log_records(bodies)
    resource = _exploded(_parsed(bodies, "logs"), "resourceLogs", "scopeLogs", "logRecords").select("entry_id", "observed_at", _attrs("resource").alias("attributes"))
    row = lambda df, signal, attrs: df.select(F.lit(signal).alias("signal"), "entry_id", "observed_at", attrs.alias("attributes"))
    return [
        row(s, "traces", F.concat("resource_attrs", "attrs")),
        row(m, "metrics", F.concat("resource_attrs", F.coalesce("attrs", F.array().cast(RESOURCES[6:-1])))),
        row(g, "logs", F.col("attrs")),
        row(resource, "logs", F.col("attributes")),
    ]
