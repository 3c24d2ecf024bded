"""Retention that deletes."""

import json
from datetime import timedelta
from pathlib import Path

from helpers import T0, log_body, metric_body, span, trace_body
from pyspark.sql import functions as F

from spanforge.engine import Engine


def requests(spark, *bodies):
    return spark.createDataFrame([(s, "application/json", None, bytearray(json.dumps(b).encode())) for s, b in bodies], "signal string, content_type string, content_encoding string, body binary")


def held(root, table):
    """(batch, signal or none) of the folders with data files."""
    out = set()
    for f in Path(root, table).rglob("*.parquet"):
        parts = dict(p.split("=", 1) for p in f.relative_to(root).parts if "=" in p)
        out.add((int(parts["batch"]), parts.get("signal")))
    return out


def test_disk_stays_bounded(spark, tmp_path):
    """Four of each signal stay; traces come in the first batch only, so they stay whatever comes after."""
    root = str(tmp_path / "e")
    engine = Engine(spark, root, retention=4, purge=True)
    log = lambda n: ("logs", log_body({"severityText": "INFO", "body": f"n {n}"}))
    metric = ("metrics", metric_body(({"service.name": "m"}, [("cpu", "gauge", [{"asDouble": 1.0}])])))
    for b in range(6):
        more = [("traces", trace_body(("s", [span()])))] if b == 0 else []
        reader = engine.entries() if b == 5 else None  # begins before the ingest that deletes
        engine.ingest(requests(spark, log(2 * b), log(2 * b + 1), metric, *more), T0 + timedelta(seconds=b))
        if reader is not None:
            assert {r.payload_text for r in reader.where("signal = 'logs'").collect()} >= {"INFO n 8", "INFO n 9"}
        e = engine.entries()
        counts = {r.signal: r["count"] for r in e.groupBy("signal").count().collect()}
        assert counts == {"logs": min(2 * (b + 1), 4), "metrics": min(b + 1, 4), "traces": 1}, b
        assert sorted(r.payload_text for r in e.where("signal = 'logs'").collect()) == sorted(f"INFO n {n}" for n in range(max(0, 2 * b - 2), 2 * b + 2))
    # What was below the floor at the ingest before is gone: logs of batches 0 to 2, metrics of batches 0 and 1.
    logs = {b for b, s in held(root, "landing") if s == "logs"}
    assert logs == {b for b, s in held(root, "entries") if s == "logs"} == {3, 4, 5} and {b for b, _ in held(root, "records") if b < 3} == set()
    assert {b for b, s in held(root, "entries") if s == "metrics"} == {1, 2, 3, 4, 5} and (0, "traces") in held(root, "landing")
    again = Engine(spark, root, retention=4, purge=True)
    assert again.entries().count() == 9 and again.spans().count() == 1 and again.table("points").count() == 4 and again.table("records").count() == 4
    assert len(again.log.floors()) == 2 and again.entries().where(F.col("signal") == "logs").agg(F.min("payload_text")).first()[0] == "INFO n 10"
