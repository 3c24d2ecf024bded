"""Remote calls."""

import base64
import gzip
import struct

import pytest
from helpers import T0, raw
from pyspark.sql import functions as F

from spanforge.adapters import _field, log_message
from spanforge.engine import Engine
from spanforge.sources import calls, otlp

LOGS = "/opentelemetry.proto.collector.logs.v1.LogsService/Export"
MESSAGE = log_message("svc", "ERROR", None, "boom", "1")


def frame(data, flags=0):
    return struct.pack(">BI", flags, len(data)) + data


@pytest.mark.parametrize(
    "kind,encoding,body,code",
    [
        ("application/grpc", None, frame(MESSAGE), 0), ("application/grpc+proto; x=y", "gzip", frame(gzip.compress(MESSAGE), 1), 0), ("application/grpc", "gzip", frame(MESSAGE), 0),
        ("application/grpc-web", None, frame(MESSAGE) + frame(b"grpc-status: 0\r\n", 0x80), 0), ("application/grpc-web-text", None, base64.b64encode(frame(MESSAGE)), 0), ("application/grpc-web-text", None, base64.encodebytes(frame(MESSAGE)) + base64.b64encode(frame(b"ok", 0x80)), 0), ("application/proto", None, MESSAGE, 0), ("application/proto", "gzip", gzip.compress(MESSAGE), 0),
        ("application/grpc", None, frame(MESSAGE)[:-1], 13), ("application/grpc", None, b"\0\0", 13), ("application/grpc", None, b"", 13), ("application/grpc", None, frame(MESSAGE) * 2, 12), ("application/grpc", None, frame(MESSAGE, 1), 13),
        ("application/grpc", None, frame(MESSAGE, 2), 13), ("application/grpc", "brotli", frame(MESSAGE, 1), 12), ("application/grpc", "gzip", frame(MESSAGE, 1), 13), ("application/grpc", None, frame(MESSAGE) + frame(b"", 0x80), 13), ("application/grpc-web", None, frame(b"", 0x80) + frame(MESSAGE), 13),
        ("application/grpc-web-text", None, b"*", 13), ("application/grpc", None, frame(b"x" * (5 << 20)), 8), ("text/plain", None, frame(MESSAGE), 12), (None, None, None, 12),
    ],
)
def test_framings(kind, encoding, body, code):
    signal, payload, transport, got = calls.read_call(LOGS, kind, encoding, body)
    assert got == code and (payload == MESSAGE if code == 0 else payload is None) and signal == "logs" and (transport is None) == (kind in ("text/plain", None))
    assert calls.read_call("/x", kind, encoding, body)[3] == 12 and calls.read_call(None, kind, encoding, body)[0] is None


def test_name_rule(spark):
    """In a block one without any value ends the search, one of another kind does not; the next block is looked at."""
    value = lambda **v: {"key": "service.name", **({"value": v} if v != {"no": 1} else {})}
    blocks = {
        "text": [[value(stringValue="a")]], "number first": [[value(intValue=3), value(stringValue="b")]], "none first": [[value(no=1), value(stringValue="c")]], "next": [[value(no=1)], [value(stringValue="d")]], "empty": [[]], "other": [[{"key": "x", "value": {"stringValue": "y"}}]],
    }
    rows = raw(spark, *(("traces", n, None, {"resourceSpans": [{"resource": {"attributes": x}} for x in b]}) for n, b in enumerate(blocks.values())))
    bodies = otlp.parse(otlp.decode_bodies(rows.withColumn("transport", F.lit("grpc"))))
    got = {r.entry_id: r.service_name for r in otlp.entries(calls.name_services(bodies)).collect()}
    assert [got[n] for n in range(len(blocks))] == ["a", "b", None, "d", None, None]
    plain = {r.entry_id: r.service_name for r in otlp.entries(otlp.parse(otlp.decode_bodies(rows))).collect()}
    assert plain[2] == "c"  # requests by the other way go on past it


def test_engine_takes_calls(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    requests = spark.createDataFrame([(LOGS, "application/grpc", None, bytearray(frame(MESSAGE))), (LOGS, "application/grpc", None, bytearray(b"?")), ("/x", "application/grpc", None, bytearray(frame(MESSAGE)))], "path string, content_type string, content_encoding string, body binary")
    assert sorted((r.code, r.signal or "") for r in engine.ingest_calls(requests, T0, key="a").collect()) == [(0, "logs"), (12, ""), (13, "logs")]
    engine.ingest_calls(requests, T0, key="a")
    assert [(r.service_name, r.payload_text) for r in engine.entries().collect()] == [("svc", "ERROR boom")]
    assert engine.table("errors").count() == 1 and engine.table("attributes").count() == 0 and engine.table("rollups").count() == 0
