import json
import subprocess
import sys
from datetime import timedelta
from pathlib import Path

import pytest
from helpers import T0, log_body, metric_body, raw, span, trace_body
from pyspark.sql import functions as F

from spanforge import catalog as c
from spanforge.operators import insight, viewers
from spanforge.operators.viewers import Aggregation
from spanforge.sources import landing, otlp
from spanforge.streaming import live as live_state
from spanforge.streaming import runtime

ROOT = Path(__file__).resolve().parent.parent


def drain(query):
    query.awaitTermination()
    assert query.exception() is None


def viewer(id, mask=7, lookback=60_000, **body):
    return viewers.compile_viewer({"id": id, "signal_mask": mask, "lookback_ms": lookback, "definition_json": body})


def test_runtime_equals_batch(spark, tmp_path):
    """Micro-batches with a restart give what one query over all entries gives; old rows expire."""
    land = str(tmp_path / "land")
    rows = [("logs", 1000 * n, f"s{n % 3}", log_body({"severityText": "INFO", "body": {"stringValue": f"n {n}"}})) for n in range(40)]
    rows += [("metrics", 700 * n, "m", metric_body(({"service.name": "m"}, [("cpu", "gauge", [{"asDouble": float(n)}])]))) for n in range(40)]
    agg = {"fn": "p95", "bucket_ms": 10_000, "group_by": ["service_name"]}
    defs = [viewer("logs", 4, query="n 1"), viewer("cpu", 2, 20_000, aggregation=agg), viewer("all")]
    alerts = [insight.Alert("a", "logs", ">", 3.0), insight.Alert("b", "gone", ">", 0.0)]
    seen = []
    now = [T0]
    for part in range(2):
        raw(spark, *rows[part::2]).write.mode("append").parquet(land)
        rt = runtime.ViewerRuntime(spark, str(tmp_path / "rt"), lambda: now[0], alerts, seen.append)
        for d in defs:
            rt.add(d)
        drain(rt.start(landing.stream(spark, land, 1), available_now=True))
    e = otlp.entries(otlp.decode_bodies(raw(spark, *rows)))
    assert rt.entries().count() == 80
    key = lambda r: (r.bucket_start_ms, list(r.group_keys), r.value)
    assert [key(r) for r in rt.results["cpu"]] == [key(r) for r in viewers.aggregate(defs[1].aggregation, viewers.matching(defs[1], e, T0)).collect()]
    assert {r.payload_text for r in rt.results["logs"]} == {r.payload_text for r in viewers.matching(defs[0], e, T0).collect()}
    assert rt.alert_status == {"a": "breached", "b": "missing_viewer"} and seen and set(rt.status) == {"logs", "cpu", "all"}
    rt.refresh(T0 + timedelta(seconds=50))
    assert rt.results["cpu"] == [] and rt.panel("none") is None and rt.panel("all", "s1", "n 1").count() == viewers.dashboard_filter(viewers.matching(defs[2], e, T0), "s1", "n 1").count()
    assert rt.update(viewer("cpu", 2, 20_000)) == "recompute" and rt.update(viewer("cpu", 2, 30_000)) == "rebuild" and rt.update(viewer("cpu", 2, 30_000)) == "metadata" and rt.update(viewer("new")) == "rebuild"
    rt.remove("cpu")
    assert "cpu" not in rt.results


def test_snapshots_by_revision(spark, tmp_path):
    """After a restart a viewer has its results again if it is the same revision; a change is worked out at once."""
    land, root = str(tmp_path / "land"), str(tmp_path / "rt")
    raw(spark, *(("logs", 1000 * n, f"s{n % 3}", log_body({"severityText": "INFO", "body": f"n {n}"})) for n in range(6))).write.parquet(land)
    agg = {"fn": "count", "bucket_ms": 60_000, "group_by": ["service_name"]}

    def made(id, revision, **body):
        return viewers.compile_viewer({"id": id, "signal_mask": 4, "lookback_ms": 60_000, "revision": revision, "definition_json": body})

    rt = runtime.ViewerRuntime(spark, root, lambda: T0)
    rt.add(made("rows", 3))
    rt.add(made("sums", 1, aggregation=agg))
    drain(rt.start(landing.stream(spark, land), available_now=True))
    assert len(rt.results["rows"]) == 6 and rt.results["sums"]

    again = runtime.ViewerRuntime(spark, root, lambda: T0)
    again.add(made("rows", 3))
    again.add(made("sums", 2, aggregation=agg))
    assert [r.payload_text for r in again.results["rows"]] == [r.payload_text for r in rt.results["rows"]] and again.results["rows"][0].observed_at == rt.results["rows"][0].observed_at
    assert "sums" not in again.results  # another revision
    assert again.update(made("rows", 4, query="n 1")) == "rebuild" and [r.payload_text for r in again.results["rows"]] == ["INFO n 1"]
    assert again.update(made("sums", 3, aggregation=agg | {"fn": "rate"})) == "recompute" and round(sum(r.value for r in again.results["sums"]) * 60) == 6
    assert again.update(made("rows", 5, query="n 1")) == "metadata"
    last = runtime.ViewerRuntime(spark, root, lambda: T0)
    last.add(made("rows", 5, query="n 1"))
    assert [r.payload_text for r in last.results["rows"]] == ["INFO n 1"]


def test_degraded_viewer(spark, tmp_path):
    land = str(tmp_path / "land")
    raw(spark, ("logs", 1, "s", {})).write.parquet(land)
    rt = runtime.ViewerRuntime(spark, str(tmp_path / "rt"), lambda: T0)
    rt.add(viewers.Viewer("bad", 7, 1000, filters=(("payload", "regex", "("),)))
    rt.add(viewer("good"))
    drain(rt.start(landing.stream(spark, land), available_now=True))
    assert rt.status["bad"]["type"] == "degraded" and len(rt.results["good"]) == 1


def entries_stream(spark, tmp_path, rows):
    path = str(tmp_path / "in")
    for n, part in enumerate(rows):
        spark.createDataFrame(part, "signal string, observed_at timestamp, service_name string, value double").coalesce(1).write.parquet(f"{path}/b{n:03d}")
    return spark.readStream.schema("signal string, observed_at timestamp, service_name string, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def test_rollup_stream(spark, tmp_path):
    rows = [[("logs", T0 + timedelta(seconds=20 * n + k), name, 1.0) for k, name in enumerate(("s0", "a b", None, ""))] for n in range(4)]
    out = runtime.rollup_stream(entries_stream(spark, tmp_path, rows))
    drain(out.writeStream.format("memory").queryName("rolled").outputMode("complete").trigger(availableNow=True).start())
    flat = spark.createDataFrame(sum(rows, []), "signal string, observed_at timestamp, service_name string, value double")
    want = insight.rollup(flat, ("1m",)).select("signal", "bucket_start_seconds", "service", "count")
    assert sorted(map(tuple, spark.table("rolled").collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("fn", ["sum", "p95", "count", "avg", "rate"])
def test_stateful_equals_recompute(spark, tmp_path, fn):
    rows = [[("metrics", T0 + timedelta(seconds=10 * n + k), "a" if k % 2 else "b", float(n * k)) for k in range(6)] for n in range(3)]
    stream = entries_stream(spark, tmp_path, rows).withColumnRenamed("service_name", "group_key")
    agg = Aggregation(fn, 5_000)
    seen = {}

    def keep(df, _):
        for r in df.collect():  # an update sink: only what comes changes
            seen.setdefault(r.group_key, {})[r.bucket_start_ms] = r.value

    query = live_state.live_buckets(stream, agg, 12_000).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    drain(query)
    import math

    for key in "ab":
        mine = [(int(t.timestamp() * 1000), x) for _, t, s, x in sum(rows, []) if s == key]
        last = max(m for m, _ in mine)
        live = [(m, x) for m, x in mine if m > last - 12_000]
        want = {}
        for m, x in live:
            want.setdefault(m - m % 5_000, []).append(x)
        value = {"sum": sum, "count": len, "avg": lambda v: sum(v) / len(v), "rate": lambda v: len(v) / 5, "p95": lambda v: sorted(v)[math.ceil(0.95 * len(v)) - 1]}[fn]
        empty = [x for b, x in seen[key].items() if b not in want]
        assert all(x == 0 if fn in ("count", "rate", "sum") else x is None for x in empty)
        assert {b: x for b, x in seen[key].items() if b in want} == {b: float(value(v)) for b, v in want.items()}


def test_side_tables(spark, tmp_path):
    b = otlp.decode_bodies(raw(spark, ("logs", 5, "s", log_body({"severityText": "ERROR", "body": "x"}, region="eu")), ("traces", 4, "s", trace_body(("s", [span(a={"k": "v"})])))))
    for _ in range(2):
        runtime.side_tables(b, str(tmp_path), 7)  # a batch that comes again counts once
    read = lambda n: spark.read.parquet(str(tmp_path / n))
    assert insight.fold_error_groups(read("errors").drop("batch")).agg(F.sum("count")).first()[0] == 1 and read("attributes").select("key").distinct().count() == 2
    assert insight.rollup_range(read("rollups"), "logs", "1h", int(T0.timestamp() * 1000) - 10, int(T0.timestamp() * 1000)).agg(F.sum("count")).first()[0] == 1


# --- catalog ---


def test_viewers_and_dashboards(spark, tmp_path):
    k = c.Catalog()
    k.add_defaults()
    assert [v["slug"] for v in k.listed("viewer")] == ["all-logs", "all-metrics", "all-traces"]
    a = k.create_viewer(" A ", ["metrics"], 5000, "line", aggregation={"fn": "sum", "bucket_ms": 5, "group_by": ["host.name"]})
    assert a["name"] == "A"
    for bad in ({"name": ""}, {"name": "x" * 81}, {"signals": ["logs"]}, {"aggregation": {"fn": "sum", "bucket_ms": 5, "group_by": ["zz"]}}, {"lookback_ms": 0}):
        with pytest.raises(ValueError):
            k.create_viewer(**({"name": "n", "signals": ["metrics"], "lookback_ms": 5, "chart": "line"} | bad))
    assert k.patch_viewer(a["id"], name="B") == "metadata" and k.patch_viewer(a["id"], aggregation=None) == "recompute" and k.patch_viewer(a["id"], query="q", chart_type="area") == "rebuild"
    assert k.get("viewer", a["id"])["revision"] == 4
    b = k.create_viewer("C", ["logs"], 1000)
    d = k.create_dashboard("D", [{"viewer_id": a["id"], "col_span": 2}, {"viewer_id": b["id"]}], 3)
    assert [p["col_span"] for p in c.panels_of(d["layout_json"])] == [2, 1] and c.dashboard_lookback([a, b]) == 1000
    assert [p["col_span"] for p in c.replace_viewers(d["layout_json"], [b["id"], a["id"]])["panels"]] == [1, 2]
    with pytest.raises(c.CatalogError):
        c.layout([], 5)
    data = json.loads(json.dumps(k.export_dashboard(d["id"])))
    new = k.import_dashboard(data)
    assert len(new["layout_json"]["panels"]) == 2 and new["layout_json"]["columns"] == 3 and data["viewers"][0]["query"] == "q"
    for name in c.TEMPLATES:
        assert k.from_template(name)["layout_json"]["panels"]
    before = len(k.rows["viewer"])
    k.create_dashboard, made = (lambda *a, **b: 1 / 0), None
    with pytest.raises(ZeroDivisionError):
        k.from_template("log-monitoring")
    assert len(k.rows["viewer"]) == before and made is None
    k.save(spark, str(tmp_path / "cat"))
    assert c.Catalog.load(spark, str(tmp_path / "cat")).rows == k.rows
    with pytest.raises(c.CatalogError):
        k.delete("viewer", "nope")


def test_alerts_incidents_keys(spark):
    k = c.Catalog()
    v = k.create_viewer("V", ["logs"], 1000)
    k.create_alert("z", v["id"], ">", 1)
    k.create_alert("a", v["id"], "!=", 1)
    assert [x.op for x in k.alerts()] == ["!=", ">"]
    for bad in ({"viewer_id": "x"}, {"interval_ms": 10}, {"op": "~"}, {"severity": "huge"}):
        with pytest.raises(ValueError):
            k.create_alert(**({"name": "n", "viewer_id": v["id"], "op": ">", "threshold": 1} | bad))
    i = k.open_incident("t", "critical", T0)
    k.move_incident(i["id"], "resolved", T0)
    for bad in ("open", "resolved"):
        with pytest.raises(c.CatalogError):
            k.move_incident(i["id"], bad, T0)
    assert k.authorized(None)
    key = k.create_key("k")
    assert key.startswith("key_") and len(key) == 68 and k.authorized(f"Bearer {key}") and not k.authorized(key) and not k.authorized("Bearer x")
    s = k.create_slo("s", v["id"], 90.0, 60_000, {}, {"query": "ok"})
    e = otlp.entries(otlp.decode_bodies(raw(spark, ("logs", 5, "ok", {}), ("logs", 4, "no", {}))))
    assert k.slo_budget(s["id"], e, T0).first().current_pct == 50.0
    with pytest.raises(ValueError):
        k.create_slo("s", v["id"], 90.0, 60_000, {}, {"filters": 3})


def test_webhook_and_settings():
    ch = c.Catalog().create_channel("c", "http://x.example", {"X-A": "1"})
    got = {}

    class Answer:
        status = 204

        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

    def post(request, timeout):
        got.update(body=json.loads(request.data), headers=dict(request.header_items()), timeout=timeout)
        return Answer()

    assert c.send_webhook(ch, {"a": 1}, post) == 204 and got["body"] == {"a": 1} and got["headers"]["X-a"] == "1" and got["timeout"] == 10
    with pytest.raises(c.CatalogError):
        c.Catalog().create_channel("c", "ftp://x")
    assert c.settings({"PORT": "99", "STANDALONE": "0"})["HTTP_PORT"] == 99 and c.settings({})["STANDALONE"] is True
    for bad in ({"HTTP_PORT": "x"}, {"VIEWER_RUNTIME_POLL_MS": "0"}, {"STANDALONE": "maybe"}):
        with pytest.raises(c.CatalogError):
            c.settings(bad)


# --- the entry points ---


def test_entry_without_the_optional_parts(tmp_path):
    """Nothing but the registration needs the training-data parts."""
    code = "import sys; sys.modules['spanforge.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q), set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.stdout.split()[1:] == ["False", "True"], out.stderr


def test_entry_and_every_query_has_rows(spark):
    import __spark_entry__ as e
    from spanforge.queries import ORACLES, QUERIES

    assert e.entry(spark).count() > 0 and set(QUERIES) == set(ORACLES)
