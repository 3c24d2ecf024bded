import gzip
import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from helpers import T0, attrs, log_body, metric_body, span, trace_body

from spanforge.catalog import Catalog, CatalogError
from spanforge.engine import Engine


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("engine")), Catalog())

    def put(at, *rows):
        data = [(s, "application/json", enc, gzip.compress(json.dumps(b).encode()) if enc else json.dumps(b).encode()) for s, b, enc in rows]
        return e.ingest(spark.createDataFrame(data, "signal string, content_type string, content_encoding string, body binary"), at)

    boom = {"name": "exception", "attributes": attrs({"exception.type": "E"})}
    calls = [span("t1", f"c{n}", "r", start=10**9, end=10**9 + 200 * 10**6, a={"db.statement": f"SELECT {n}"}) for n in range(6)]
    put(T0 - timedelta(seconds=90), ("traces", trace_body(("web", [span("t1", "r", name="root", status=2, events=[boom]), *calls]), ("db", [span("t1", "d", "r")])), None), ("logs", log_body({"severityText": "ERROR", "body": "x"}, **{"service.name": "web"}), "gzip"))
    put(T0 - timedelta(seconds=30), ("metrics", metric_body(({"service.name": "web"}, [("cpu", "gauge", [{"asDouble": 0.5}])])), None), ("traces", trace_body(("web", [span("t2")])), None))
    bad = e.ingest(spark.createDataFrame([("logs", "text/plain", None, b"x")], "signal string, content_type string, content_encoding string, body binary"), T0)
    assert bad.first().status == 415
    return e


def test_queries(engine):
    r = engine.query("SELECT service_name, count(*) AS n FROM traces GROUP BY service_name", now=T0)
    assert r.rows == [("web", 2.0)] and r.scanned == 4
    assert engine.query("SELECT count(*) FROM traces", 60_000, T0).rows == [(1.0,)]
    assert engine.services(T0).count() == 0  # services are those of live viewers
    seen = engine.catalog.create_viewer("seen", ["logs"], 300_000)
    assert [x.service_name for x in engine.services(T0).collect()] == ["web"] and engine.services(T0 + timedelta(days=1)).count() == 0
    engine.catalog.rows["viewer"].pop(seen["id"])
    assert [x.key for x in engine.attribute_keys().collect()] == ["db.statement"] and engine.attribute_values("db.statement", "select 1").count() == 1
    assert [x.trace_id for x in engine.trace_search(only_errors=True).collect()] == ["t1"] and engine.trace("t2").count() == 1
    assert [x.span_id for x in engine.waterfall("t1").orderBy("position").collect()][0] == "r"
    nodes, edges = engine.service_map(T0)
    assert {x.service for x in nodes.collect()} == {"web", "db"} and [(x.source, x.target) for x in edges.collect()] == [("web", "db")]
    assert engine.service_map(T0, 60_000)[0].count() == 1
    assert {x.signature for x in engine.error_groups(T0).collect()} == {"E", "ERROR: x"}
    assert engine.slow_queries(T0).first().p95_ms == 200 and engine.n_plus_one(T0).first()["count"] == 6 and engine.slow_queries(T0, 60_000).count() == 0
    ms = int(T0.timestamp() * 1000)
    assert [x["count"] for x in engine.rollups("traces", ms - 120_000, ms).collect()] == [1, 1]


def test_viewers(engine):
    c = engine.catalog
    m = c.create_viewer("m", ["metrics"], 300_000, "timeseries", aggregation={"fn": "avg", "bucket_ms": 60_000})
    t = c.create_viewer("t", ["traces"], 300_000)
    d = c.create_dashboard("d", [{"viewer_id": m["id"]}, {"viewer_id": t["id"]}])
    out = engine.viewer(m["id"], T0)
    assert [b.value for b in out["buckets"].collect()] == [0.5] and out["rows"].first().metric_name == "cpu"
    assert [list(x.sample_trace_ids) for x in out["exemplars"].collect()] == [["t2"]]
    shown = engine.viewer(t["id"], T0, services="none")
    assert shown["entries"].count() == 0 and engine.viewer(t["id"], T0)["traces"].count() == 2
    with pytest.raises(CatalogError):
        engine.viewer(t["id"], T0, lookback_ms=10**9)
    c.rows["viewer"].pop(t["id"])
    assert [p["viewer"] is None for p in engine.dashboard(d["id"], T0)] == [False, True] and engine.dashboard(d["id"], lazy=True)[0]["viewer"]["name"] == "m"
    c.create_alert("a", m["id"], ">=", 1)
    assert [x.status for x in engine.alerts(T0).collect()] == ["breached"]
    assert engine.anomaly(m["id"], {"kind": "no_data", "window_ms": 1000}, T0).first().breached and not engine.anomaly(m["id"], {"kind": "zscore", "bucket_ms": 1000, "threshold": 2.0}, T0 + timedelta(seconds=1)).first().breached
    s = c.create_slo("s", m["id"], 99.0, 300_000, {}, {"query": "cpu"})
    assert engine.budget(s["id"], T0).first().current_pct == 100.0
    assert engine.preview({"signal_mask": 4, "lookback_ms": 300_000, "definition_json": {}}, T0)["rows"].first().preview == "service=web | severity=ERROR | body=x | otlp_json"


def requests(spark, *bodies):
    return spark.createDataFrame([("logs", "application/json", None, json.dumps(b).encode()) for b in bodies], "signal string, content_type string, content_encoding string, body binary")


def record(text):
    return log_body({"severityText": "ERROR", "body": text}, **{"service.name": "s"})


def ids(engine):
    return sorted((x.stream_ms, x.stream_seq) for x in engine.entries().collect())


def test_two_batches_of_one_millisecond(spark, tmp_path):
    """Ids go on growing over calls, also with a clock that stands or goes back, so a cursor loses nothing."""
    from spanforge.operators import viewers

    e = Engine(spark, str(tmp_path), Catalog())
    e.ingest(requests(spark, record("a"), record("b")), T0)
    first = ids(e)
    e.ingest(requests(spark, record("c")), T0)
    e.ingest(requests(spark, record("d")), T0 - timedelta(seconds=1))
    assert len(set(ids(e))) == 4
    left = viewers.read_since(e.entries(), "logs", first[-1], 10).collect()
    assert [x.payload_text for x in left] == ["ERROR c", "ERROR d"]


def test_a_batch_counts_once_and_only_whole(spark, tmp_path, monkeypatch):
    e = Engine(spark, str(tmp_path), Catalog())
    e.ingest(requests(spark, record("a")), T0, key="1")
    e.ingest(requests(spark, record("a")), T0, key="1")
    assert e.entries().count() == 1 and e.error_groups(T0).first()["count"] == 1
    whole = e._tables
    monkeypatch.setattr(e, "_tables", lambda bodies: {k: v for k, v in whole(bodies).items() if k == "entries"} | {"spans": None})
    with pytest.raises(AttributeError):
        e.ingest(requests(spark, record("b")), T0, key="2")
    assert e.entries().count() == 1  # what the failure left does not count
    monkeypatch.undo()
    e.ingest(requests(spark, record("c")), T0)
    e.ingest(requests(spark, record("b")), T0, key="2")
    assert sorted(x.payload_text for x in e.entries().collect()) == ["ERROR a", "ERROR b", "ERROR c"]
    assert e.error_groups(T0).agg({"count": "sum"}).first()[0] == 3


def test_retention(spark, tmp_path):
    e = Engine(spark, str(tmp_path), Catalog(), retention=3)
    for n in range(5):
        e.ingest(requests(spark, record(f"n {n}")), T0 + timedelta(seconds=n // 2))
    assert sorted(x.payload_text for x in e.entries().collect()) == ["ERROR n 2", "ERROR n 3", "ERROR n 4"] and e.table("records").count() == 3
    assert Engine(spark, str(tmp_path), Catalog()).entries().count() == 5


def test_days_are_pruned(spark, tmp_path):
    e = Engine(spark, str(tmp_path), Catalog())
    body = trace_body(("web", [span("t1", a={"db.statement": "x"})]))
    e.ingest(requests(spark, record("a")).union(requests(spark, body).withColumn("signal", F.lit("traces"))), T0)
    for df in (e.service_map(T0)[0], e.slow_queries(T0), e._recent("entries", T0, 1000)):
        assert "day" in df._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
