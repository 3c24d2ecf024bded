import gzip
import json
import struct

import pyarrow as pa
import pytest
from helpers import attrs, bodies, log_body, metric_body, raw, span, trace_body

from spanforge.operators import insight, preview
from spanforge.sources import landing, otlp


def test_media_types_and_codecs():
    import zstandard

    assert otlp.media_type("application/json; charset=utf-8") == "json" and otlp.media_type("application/x-protobuf") == "protobuf"
    for bad in ("Application/JSON", "text/plain", None):
        with pytest.raises(otlp.BodyError) as e:
            otlp.media_type(bad)
        assert e.value.status == 415
    text = b'{"a": 1}' * 50
    lz4 = pa.BufferOutputStream()
    with pa.CompressedOutputStream(lz4, "lz4") as f:
        f.write(text)
    packed = pa.Codec("snappy").compress(text).to_pybytes()
    framed = b"\xff\x06\x00\x00sNaPpY" + b"\x00" + (len(packed) + 4).to_bytes(3, "little") + b"abcd" + packed + b"\x01" + (7).to_bytes(3, "little") + b"abcd" + b"end"
    assert otlp.decompress(text, None) == otlp.decompress(text, "identity") == otlp.decompress(gzip.compress(text), "gzip") == otlp.decompress(zstandard.compress(text), "zstd") == otlp.decompress(lz4.getvalue().to_pybytes(), "lz4") == text
    assert otlp.decompress(framed, "snappy") == text + b"end"
    for name, status in (("gzip", 400), ("zstd", 400), ("snappy", 400), ("br", 415)):
        with pytest.raises(otlp.BodyError) as e:
            otlp.decompress(b"junk", name)
        assert e.value.status == status


def test_normalize(spark):
    rows = [("traces", "application/json", None, b"{}"), ("traces", "text/html", None, b"{}"), ("logs", "application/json", "gzip", gzip.compress(b"[]")), ("logs", "application/json", "gzip", b"junk"), ("logs", "application/json", None, None)]
    got = otlp.normalize(spark.createDataFrame(rows, "signal string, content_type string, content_encoding string, body binary")).collect()
    assert [(r.status, bytes(r.payload) if r.payload is not None else None) for r in got] == [(200, b"{}"), (415, None), (200, b"[]"), (400, None), (200, b"")]


def test_traces(spark):
    body = trace_body(("web", [span(id="a", start=5, end=4_000_005), span(id="b", name="sql", a={"db.system": "x", "n": 3})]), (None, [span(id="c", status=2, start=10, end=5)]))
    body["resourceSpans"].append({"resource": {"attributes": "wrong"}, "scopeSpans": [{"spans": [span(id="d")]}, {}]})
    b = bodies(spark, ("traces", 5, None, body), ("traces", 4, "x", {}), ("traces", 3, None, b"\xff\xfe"), ("traces", 2, None, {"resourceSpans": 7}))
    s = {r.span_id: r for r in otlp.spans(b).collect()}
    assert set(s) == {"a", "b", "c", "d"}
    assert (s["a"].resource_service_name, s["c"].resource_service_name, s["c"].status_code) == ("web", None, 2)
    assert (int(s["a"].start_ns), int(s["a"].end_ns)) == (5, 4_000_005) and s["b"].ord.i == 1 and s["d"].ord.rs == 2
    e = {r.entry_id: r for r in otlp.entries(b).collect()}
    assert len(e) == 4 and (e[0].service_name, e[0].duration_ms, e[0].payload_text) == ("web", 1000.0, "op sql op op")
    assert all(e[i].duration_ms is None and e[i].payload_text is None for i in (1, 2, 3)) and e[1].service_name == "x"


def test_nanos(spark):
    from pyspark.sql import functions as F

    from spanforge.functions.core import nanos

    cases = {"12": 12, "18446744073709551615": 2**64 - 1, "18446744073709551616": 2**64 - 1, "99999999999999999999999": 2**64 - 1, "-4": 0, "x": 0, "1.9e3": 1900, "2.5": 2, "1e300": 2**64 - 1, "": 0, None: 0}
    got = spark.createDataFrame([(k,) for k in cases], "x string").select(nanos(F.col("x")).alias("n")).collect()
    assert [int(r.n) for r in got] == list(cases.values())


def test_metrics(spark):
    body = metric_body(
        ({"service.name": "a", "k8s.pod.name": "p1"}, [("cpu", "gauge", [{"asDouble": 0.5}, {"asInt": "9"}]), ("mem", "sum", [{"asInt": "7"}])]),
        ({"k8s.pod.name": "p2"}, [("cpu", "histogram", [{"sum": 3.5}]), ("odd", "summary", [{"sum": 1}])]),
    )
    b = bodies(spark, ("metrics", 1, None, body))
    points = otlp.metric_points(b).orderBy("ord", "point_idx").collect()
    assert [(p.metric_name, p.kind, p.value) for p in points] == [("cpu", "gauge", 0.5), ("cpu", "gauge", 9.0), ("mem", "sum", 7.0), ("cpu", "histogram", 3.5), ("odd", "summary", 1.0)]
    e = otlp.entries(b).first()
    assert [(m.name, m.value, m.rs) for m in e.metrics] == [("cpu", 0.5, 0), ("mem", 7.0, 0), ("cpu", 3.5, 1), ("odd", None, 1)] and e.service_name == "a"
    assert [(r.metric_name, r.metric_value) for r in preview.metric_rows(b, "CPU").orderBy("ord").collect()] == [("cpu", 0.5), ("cpu", None)]
    f = preview.first_metric(b, "mem").first()
    assert (f.metric_name, f.metric_value) == ("mem", 7.0)


def test_logs_and_errors(spark):
    records = [{"severityText": "error", "body": {"stringValue": "user 12 failed 0a1b2c3d4e"}}, {"severityNumber": 17, "body": "plain"}, {"severityText": "INFO", "severityNumber": 9, "body": {"stringValue": "ok"}}, {"severityText": "Error", "body": {"kvlistValue": {}}}]
    exception = {"name": "exception", "attributes": attrs({"exception.type": "E", "exception.message": "id 7"})}
    b = bodies(spark, ("logs", 9, "s", log_body(*records)), ("traces", 8, "s", trace_body(("s", [span(events=[exception, {"name": "other"}, {"name": "exception"}])]))))
    found = insight.span_errors(otlp.spans(b)).unionByName(insight.log_errors(otlp.log_records(b))).collect()
    assert {r.signature for r in found} == {"error: user 12 failed 0a1b2c3d4e", "severity=17: plain", "Error", "E: id 7", "<unknown error>"}
    import hashlib

    want = hashlib.sha256(b"error\0user <num> failed <hex>").hexdigest()[:16]
    assert want in {r.fingerprint for r in found}
    assert otlp.entries(b).where("signal = 'logs'").first().payload_text == "error user 12 failed 0a1b2c3d4e plain INFO ok Error"


def test_protobuf_equals_json(spark):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    ld = lambda n, b: varint(n << 3 | 2) + varint(len(b)) + b
    fixed = lambda n, v: varint(n << 3 | 1) + struct.pack("<Q", v)
    pair = lambda k, v: ld(1, k.encode()) + ld(2, ld(1, v.encode()))
    one = ld(1, bytes.fromhex("ab" * 16)) + ld(2, bytes.fromhex("cd" * 8)) + ld(5, b"GET") + fixed(7, 10) + fixed(8, 3_000_010) + ld(9, pair("k", "v")) + ld(15, varint(3 << 3) + varint(2)) + varint(99 << 3) + varint(5)
    body = ld(1, ld(1, ld(1, pair("service.name", "pb"))) + ld(2, ld(2, one)))
    s = otlp.spans(bodies(spark, ("traces", 1, None, body))).first()
    assert (s.trace_id, s.span_id, s.name, s.status_code, s.resource_service_name, int(s.end_ns)) == ("ab" * 16, "cd" * 8, "GET", 2, "pb", 3_000_010)
    point = fixed(4, struct.unpack("<Q", struct.pack("<d", 1.5))[0])
    m = ld(1, ld(2, ld(2, ld(1, b"cpu") + ld(5, ld(1, point)))))
    log = ld(1, ld(2, ld(2, varint(2 << 3) + varint(18) + ld(5, ld(1, b"boom")))))
    b = bodies(spark, ("metrics", 1, None, m), ("logs", 1, None, log), ("logs", 1, None, b"\x0a\xff"))
    assert otlp.metric_points(b).first().value == 1.5
    r = otlp.log_records(b).first()
    assert (r.severity_number, r.body) == (18, "boom") and otlp.log_records(b).count() == 1


def test_attribute_index(spark):
    t = trace_body(("web", [span(a={"http.method": "GET", "n": 3, "empty": ""}), span(id="z", a={"http.method": "GET"})]))
    b = bodies(spark, ("traces", 1, None, t), ("metrics", 1, None, metric_body(({"host.name": "h_1"}, [("m", "gauge", [{"asInt": 1, "attributes": attrs({"cpu": "0"})}])]))), ("logs", 1, None, log_body({"attributes": attrs({"k": "v"})}, region="eu")))
    index = insight.attribute_index(*otlp.indexable_attributes(b)).cache()
    assert {(r.key, r.value, r.entry_id) for r in index.collect()} == {("http.method", "GET", 0), ("host.name", "h_1", 1), ("cpu", "0", 1), ("k", "v", 2), ("region", "eu", 2)} and index.count() == 5
    assert [r.key for r in insight.attribute_keys(index).collect()] == ["cpu", "host.name", "http.method", "k", "region"]
    assert [r.value for r in insight.attribute_values(index, "host.name", "H_").collect()] == ["h_1"]
    assert insight.attribute_values(index, "host.name", "hx").count() == 0


def test_preview(spark):
    metric = metric_body(({"service.name": "m"}, [("cpu", "gauge", [{"asInt": "3", "asDouble": 2.5}])]))
    log = log_body({"severityText": "INFO", "body": {"stringValue": "x  y" * 100}}, **{"service.name": "s"})
    e = otlp.decode_bodies(raw(spark, ("logs", 5, "s", b"  a \n b  "), ("logs", 4, "s", b""), ("logs", 3, "s", bytes(range(200, 240))), ("traces", 2, "s", trace_body(("web", [span(name="op")]))), ("metrics", 1, "s", metric), ("logs", 0, "s", log)))
    got = preview.preview(e).collect()
    assert [r.preview for r in got] == [("service=s | severity=INFO | body=" + "x y" * 100)[:160] + "...", "service=m | metric=cpu | value=3 | otlp_json", "service=web | span=op | otlp_json", bytes(range(200, 224)).hex() + "...", "(empty payload)", "a b"]
    assert (got[1].metric_name, got[1].metric_value, got[4].payload_size) == ("cpu", 3.0, 0)


def test_landing(spark, tmp_path):
    path = str(tmp_path / "log")
    landing.append(raw(spark, ("traces", 5, "", {}), ("logs", 4, "s", {})), path)
    landing.append(raw(spark, ("logs", 3, "s", {})), path)
    rows = landing.read(spark, path)
    assert rows.count() == 3 and rows.where("service_name is null").count() == 1
    assert landing.newest_per_signal(rows, 1).count() == 2
    from pyspark.sql import functions as F

    ids = spark.createDataFrame([("12-3",), ("x",), ("1-",)], "t string").select(*landing.parse_stream_id(F.col("t"))).collect()
    assert [tuple(r) for r in ids] == [(12, 3), (None, None), (None, None)]
    assert json.dumps(1) == "1"


def test_value_of_a_point_by_its_shape(spark):
    """Numbers are numbers; a quoted whole number counts for asInt, a quoted double for nothing."""
    shapes = [({"asDouble": 1.5}, 1.5), ({"asDouble": "1.5"}, None), ({"asInt": 7}, 7.0), ({"asInt": "7"}, 7.0), ({"asInt": "7.5"}, None), ({"asInt": 7.5}, None), ({"sum": 2}, 2.0), ({"sum": "2"}, None), ({"asDouble": "x", "asInt": "3"}, 3.0), ({"asDouble": True, "sum": 4.5}, 4.5), ({"asDouble": "NaN"}, None)]
    bodies = otlp.decode_bodies(raw(spark, *(("metrics", n, "s", metric_body(({}, [("m", "gauge", [p])]))) for n, (p, _) in enumerate(shapes))))
    got = {r.stream_ms: r.metrics[0].value for r in otlp.entries(bodies).collect()}
    points = {r.ord.ms: r.value for r in otlp.metric_points(bodies).collect()}
    assert [got[k] for k in sorted(got, reverse=True)] == [w for _, w in shapes] == [points[k] for k in sorted(points, reverse=True)]
    same = otlp.entries(otlp.parse(bodies)).select("entry_id", "metrics")
    assert sorted(same.collect()) == sorted(otlp.entries(bodies).select("entry_id", "metrics").collect())
