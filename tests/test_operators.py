import random
from datetime import timedelta

import pytest
from helpers import T0, attrs, bodies, log_body, metric_body, span, trace_body
from pyspark.sql import functions as F

from spanforge.functions import core
from spanforge.operators import insight as i
from spanforge.operators import traces as t
from spanforge.operators import viewers as v
from spanforge.sources import otlp


def viewer(mask=7, lookback=60_000, **body):
    return v.compile_viewer({"id": "v", "signal_mask": mask, "lookback_ms": lookback, "definition_json": body})


# --- viewers ---


@pytest.mark.parametrize(
    "change,kind",
    [
        ({"signal_mask": 8}, "ZeroSignalMask"), ({"lookback_ms": 0}, "NonPositiveLookback"), ({"filters": {}}, "FiltersNotArray"), ({"filters": [{"field": "x", "op": "eq", "value": "a"}]}, "InvalidFilterField"),
        ({"filters": [{"field": "payload", "op": "in", "value": "a"}]}, "InvalidFilterOp"), ({"filters": [{"field": "payload", "op": "eq", "value": ""}]}, "EmptyFilterValue"), ({"filters": [{"field": "payload", "op": "regex", "value": "("}]}, "InvalidFilterRegex"),
        ({"filters": [{"field": "payload", "op": "regex", "value": "a(?=b)"}]}, "InvalidFilterRegex"), ({"filter_mode": "xor"}, "InvalidFilterMode"), ({"aggregation": 3}, "InvalidAggregation"), ({"aggregation": {"fn": "median", "bucket_ms": 1}}, "InvalidAggregation"),
        ({"aggregation": {"fn": "sum", "bucket_ms": 0}}, "InvalidAggregation"), ({"aggregation": {"bucket_ms": 5}}, "InvalidAggregation"), ({"aggregation": {"fn": "sum", "bucket_ms": 5, "group_by": "x"}}, "InvalidAggregation"),
    ],
)
def test_viewer_errors(change, kind):
    outer = {"signal_mask": 1, "lookback_ms": 5} | {k: x for k, x in change.items() if k in ("signal_mask", "lookback_ms")}
    with pytest.raises(v.ViewerError) as e:
        v.compile_viewer(outer | {"definition_json": {k: x for k, x in change.items() if k not in outer}})
    assert e.value.kind == kind


def test_aggregation_json():
    a = v.parse_aggregation({"aggregation": {"fn": "p95", "bucket_ms": 10, "group_by": ["host.name", "nope"], "metric_name": "m"}})
    assert a == v.Aggregation("p95", 10, ("host.name",), "m") and v.parse_aggregation({"aggregation": a.to_json()}) == a
    with pytest.raises(v.ViewerError):
        v.check_group_by(["nope"])
    with pytest.raises(v.ViewerError):
        v.check_chart("line", ["logs"])
    v.check_chart("timeseries", ["logs"])


def test_viewer_filters(spark):
    b = bodies(spark, ("logs", 10, "Web", log_body({"severityText": "ERROR", "body": {"stringValue": "Größe 5"}})), ("logs", 9, None, log_body({"severityText": "INFO", "body": {"stringValue": "fine"}})), ("traces", 8, "api", trace_body(("api", [span(name="Checkout")]))), ("logs", 60_000, "old", {}))
    e = otlp.entries(b).cache()
    ids = lambda w: sorted(r.entry_id for r in v.matching(w, e, T0).collect())
    assert ids(viewer()) == [0, 1, 2]
    assert ids(viewer(lookback=60_001)) == [0, 1, 2, 3]
    assert ids(viewer(mask=4, query=" wEb ")) == [0] and ids(viewer(query="FINE")) == [1] and ids(viewer(query="checkout")) == [2]
    f = lambda *x: [dict(zip(("field", "op", "value"), y)) for y in x]
    assert ids(viewer(query="zzz", filters=f(("service_name", "eq", "WEB")))) == [0]
    assert ids(viewer(filters=f(("payload", "regex", r"^error GRÖSSE|größe \d$"), ("service_name", "contains", "w")))) == [0]
    assert ids(viewer(filter_mode="or", filters=f(("payload", "contains", "FIN"), ("service_name", "eq", "api")))) == [1, 2]
    assert [r.service_name for r in v.services(e).collect()] == ["Web", "api", "old"]
    assert {r.viewer_id for r in v.fan_out([viewer(mask=1)], e).collect()} == {"v"}
    assert v.query_lookback(None) == 300_000 and v.query_lookback(-5) == 300_000 and v.query_lookback(10**12) == 86_400_000


def test_buckets(spark):
    pods = metric_body(*(({"service.name": "s", "k8s.pod.name": p}, [("cpu", "gauge", [{"asDouble": x}]), ("mem", "gauge", [{"asInt": "9"}])]) for p, x in (("a", 1.0), ("b", 3.0))), ({"host.name": "h"}, [("cpu", "gauge", [{"asDouble": 5.0}])]))
    e = otlp.entries(bodies(spark, ("metrics", 1500, None, pods), ("metrics", 500, "x", metric_body(({}, [("disk", "sum", [{}])]))), ("logs", 400, "x", {})))
    rows = lambda a: [(r.bucket_start_ms % 10_000, list(r.group_keys), r.value) for r in v.aggregate(a, e).collect()]
    assert rows(v.Aggregation("sum", 1000)) == [(8000, [], 1.0)]
    assert rows(v.Aggregation("count", 1000)) == [(8000, [], 1.0), (9000, [], 2.0)]
    assert rows(v.Aggregation("rate", 2000)) == [(8000, [], 1.5)]
    named = v.Aggregation("sum", 10_000, ("k8s.pod.name", "service_name", "host.name"), "cpu")
    assert rows(named) == [(0, ["a", "s", "h"], 6.0), (0, ["b", "s", "h"], 3.0)]
    assert rows(v.Aggregation("count", 10_000, (), "cpu")) == [(0, [], 5.0)]
    assert rows(v.Aggregation("p50", 10_000, (), "cpu")) == [(0, [], 3.0)]
    assert rows(v.Aggregation("count", 10_000, ("host.name",))) == [(0, ["h"], 1.0), (0, ["unknown"], 2.0)]


@pytest.mark.parametrize("n", [1, 2, 20, 21, 100])
def test_nearest_rank(spark, n):
    import math

    values = [float(x) for x in random.Random(n).sample(range(1000), n)]
    got = spark.createDataFrame([(x,) for x in values], "x double").agg(*(core.percentile(p, "x").alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99))).first()
    assert list(got) == [sorted(values)[math.ceil(p * n) - 1] for p in (0.5, 0.95, 0.99)]


# --- traces ---


@pytest.fixture(scope="module")
def spans(spark):
    tree = [span(id="root", name="root", start=1_000_000_000, end=1_000_005_000), span(id="b", parent="root", start=1_000_003_000, end=1_000_004_000), span(id="a", parent="root", start=1_000_001_000, end=1_000_002_000), span(id="g", parent="a", start=1_000_001_500, end=1_000_001_600, status=2, a={"http.status_code": 500})]
    loop = [span("loop", "x", "y", start=3, end=4), span("loop", "y", "x", start=1, end=2), span("loop", "z", "z", start=9, end=5), span("loop", "o", "gone", start=7, end=8, a={"peer.service": "db"})]
    rows = (("traces", 5, "e", trace_body(("web", tree), ("", [span("")]))), ("traces", 4, "e", trace_body(("api", loop + [span("t", "late", "g", start=1_000_001_550, end=1_000_001_560)]))))
    return otlp.spans(bodies(spark, *rows)).cache()


def test_search_and_lookup(spans):
    got = {r.trace_id: r for r in t.search(spans).collect()}
    assert list(got) == ["t", "loop"]
    assert (got["t"].span_count, got["t"].has_error, got["t"].service_names, got["t"].root_span_name, int(got["t"].duration_ns)) == (5, True, ["api", "web"], "root", 5000)
    ids = lambda **k: [r.trace_id for r in t.search(spans, **k).collect()]
    assert ids(service="api") == ["t", "loop"] and ids(service="web") == ["t"] and ids(service="WEB") == []
    assert ids(only_errors=True) == ["t"] and ids(min_duration_ms=1) == []
    assert ids(attribute=t.parse_attribute("http.status_code=50")) == ["t"] and ids(attribute=("peer.service", None)) == ["loop"]
    assert ids(span_name="ROOT", attribute=("http.status_code", None)) == [] and ids(span_name="roo") == ["t"]
    assert [r.span_id for r in t.lookup(spans, "t").collect()] == ["root", "a", "g", "late", "b"]
    assert t.truthy("maybe") and not t.truthy("off") and not t.truthy("maybe", strict=True) and t.truthy("ON", strict=True) and not t.truthy(None)


def test_waterfall(spans):
    order = lambda i: [(r.span_id, r.depth) for r in t.waterfall(spans, i).orderBy("position").collect()]
    assert order("t") == [("root", 0), ("a", 1), ("g", 2), ("late", 3), ("b", 1)]
    assert order("loop") == [("o", 0), ("x", 0), ("y", 0), ("z", 0)]
    assert order("none") == []


def test_service_map(spans):
    nodes = {r.service: r for r in t.service_nodes(spans).collect()}
    assert set(nodes) == {"web", "api"} and (nodes["web"].span_count, nodes["web"].error_count) == (4, 1) and nodes["api"].p95_ms >= 0
    assert [(r.source, r.target, r.calls, r.error_rate) for r in t.service_edges(spans).collect()] == [("api", "db", 1, 0.0), ("web", "api", 1, 0.0)]
    assert t.service_nodes(spans, T0, 4).count() == 1 and t.service_nodes(spans, T0, 0).count() == 2


def test_last_owner_wins(spark):
    rows = (("traces", 2, None, trace_body(("one", [span(id="p")]))), ("traces", 1, None, trace_body(("two", [span("u", "p")]), ("kid", [span(id="c", parent="p", status=2)]))))
    got = t.service_edges(otlp.spans(bodies(spark, *rows))).collect()
    assert [(r.source, r.target, r.error_rate) for r in got] == [("two", "kid", 1.0)]


def test_attribute_map(spark):
    a = attrs({"s": 'a"b', "n": 3, "b": True, "d": 1.5}) + attrs({"n": 4})
    s = otlp.spans(bodies(spark, ("traces", 1, None, {"resourceSpans": [{"scopeSpans": [{"spans": [span() | {"attributes": a}]}]}]})))
    assert s.select(t.attribute_map(F.col("attrs")).alias("m")).first().m == {"s": '"a\\"b"', "n": "4", "b": "true", "d": "1.5"}


# --- errors and statements ---


def test_normalisers(spark):
    from pyspark.sql import Row

    df = spark.createDataFrame([Row(x=" SELECT  * FROM t1 WHERE a = 1.5 AND b='x 7'\n"), Row(x="User 42 at DEADBEEF01-23ab t1")])
    got = df.select(core.normalize_statement(F.col("x")).alias("s"), core.normalize_message(F.col("x")).alias("m")).collect()
    assert got[0].s == "SELECT * FROM t1 WHERE a = ? AND b='x ?'" and got[1].m == "user <num> at <hex> t<num>"


def test_error_groups_merge(spark):
    def occ(*rows):
        return spark.createDataFrame([(f, T0 + timedelta(seconds=s), f"{f}@{s}#{n}", (s, n, 0, 0, 0)) for f, s, n in rows], "fingerprint string, observed_at timestamp, signature string, ord struct<ms:long,seq:long,rs:int,ss:int,i:int>").selectExpr("*", "'svc' AS service_name", "'logs' AS signal", "'t' AS exception_type", "'m' AS exception_message", "'' AS stacktrace")

    old, new = i.error_groups(occ(("a", 1, 0), ("a", 5, 1), ("a", 5, 2), ("b", 2, 3))), i.error_groups(occ(("a", 3, 4), ("c", 9, 5)))
    got = {r.fingerprint: r for r in i.merge_error_groups(old, new).collect()}
    assert (got["a"]["count"], got["a"].signature, got["c"]["count"]) == (4, "a@5#1", 1) and got["a"].last_seen.second == 5
    assert {r.fingerprint: r.signature for r in i.merge_error_groups(old, new, overwrite=True).collect()}["a"] == "a@3#4"
    assert [r.fingerprint for r in i.recent_error_groups(i.merge_error_groups(old, new), T0 + timedelta(seconds=9), 4000).collect()] == ["c", "a"]


def test_slow_and_repeated(spark):
    calls = [span("t", f"c{n}", start=1, end=1 + (n * 30) * 1_000_000, a={"db.statement": f"SELECT {n}", "db.system": "pg"}) for n in range(1, 8)]
    s = otlp.spans(bodies(spark, ("traces", 1, None, trace_body(("web", calls + [span("", "x", a={"db.statement": "SELECT 1"})])))))
    d = i.db_spans(s)
    r = i.slow_queries(d).collect()
    assert [(x.statement, x["count"], x.p50_ms, x.p95_ms, x.max_ms) for x in r] == [("SELECT ?", 7, 120, 210, 210)]
    assert i.slow_queries(d, 211).count() == 0 and i.n_plus_one(d).first().services == ["web"] and i.n_plus_one(d, 8).count() == 0 == i.n_plus_one(d, 0).count()


# --- insight ---


def test_exemplars(spark):
    m = otlp.entries(bodies(spark, ("metrics", 2500, "A", {}), ("metrics", 100, "b", {})))
    s = otlp.spans(bodies(spark, ("traces", 2600, "a", trace_body(("x", [span("t2"), span("t1"), span("t2"), span("")]))), ("traces", 2550, "a", trace_body(("x", [span("t3"), span("t1")]))), ("traces", 1500, "a", trace_body(("x", [span("t4")]))), ("traces", -10, "a", trace_body(("x", [span("t5")])))))
    got = lambda **k: [list(r.sample_trace_ids) for r in i.exemplars(m, s, T0, 60_000, 1000, **k).collect()]
    assert got() == [["t2", "t1", "t3"]] and got(max_samples=0) == [["t2"]] and got(service="a") == [["t2", "t1", "t3"]] and got(service="zz") == []
    with pytest.raises(ValueError):
        i.exemplars(m, s, T0, 1, 10)
    assert i.exemplar_service(m) is None


def test_rollups(spark):
    e = otlp.entries(bodies(spark, ("logs", 1_000, "a:b", {}), ("logs", 2_000, "a b", {}), ("logs", 3_000, "", {}), ("logs", 61_000, "z", {}), ("traces", 1, "t", {})))
    r = i.rollup(e)
    end = int(T0.timestamp() * 1000)
    got = i.rollup_range(r, "logs", "1m", end - 120_000, end).collect()
    assert [(x["count"], x.by_service) for x in got] == [(1, {"z": 1}), (3, {"a_b": 2})]
    assert [x["count"] for x in i.rollup_range(r, "logs", "1h", end - 1, end).collect()] == [4]
    with pytest.raises(ValueError):
        i.rollup_range(r, "logs", "1m", 2, 1)


def test_budget(spark):
    e = otlp.entries(bodies(spark, *[("logs", 1000 * n, "s", {}) for n in range(5)], ("traces", 4000, "s", {})))
    ok = F.col("entry_id") < 3
    b = i.slo_budget(e, F.col("signal") == "logs", ok, 50.0, 4000, T0).first()
    assert (b.total_count, b.success_count, b.current_pct, b.consumed_pct, round(b.remaining_pct, 6)) == (5, 3, 60.0, 80.0, 20.0)
    assert i.slo_budget(e, F.lit(True), ok, 100.0, 4000, T0).first().consumed_pct == 100.0
    assert i.slo_budget(e.limit(0), F.lit(True), ok, 100.0, 4000, T0).first().consumed_pct == 0.0


def test_detectors(spark):
    e = otlp.entries(bodies(spark, *[("logs", a, "s", {}) for a in (-5, 10, 1_010, 1_020, 3_500)]))
    z = i.zscore(e, 1000, 1.0, T0).first()
    history = [2.0, 0.0, 1.0]
    mean = sum(history) / 3
    want = mean + (sum((x - mean) ** 2 for x in history) / 3) ** 0.5
    assert z.value == 2.0 and abs(z.expected - want) < 1e-9 and z.breached is (2.0 > want)
    short = i.zscore(e.where("entry_id < 4"), 1000, 1.0, T0).first()
    assert (short.breached, short.value, short.expected) == (False, 2.0, 2.0)
    assert tuple(i.zscore(e, 0, 1.0, T0).first()) == (False, 0.0, 0.0)
    assert tuple(i.no_data(e.limit(0), 5000, T0).first()) == (True, 10.0, 5.0)
    assert tuple(i.no_data(e.where("entry_id = 4"), 3500, T0).first()) == (False, 3.5, 3.5)


def test_alerts(spark):
    counts = spark.createDataFrame([("v", 3)], "viewer_id string, count long")
    got = {r.alert_id: r.status for r in i.evaluate_alerts(counts, [i.Alert(op, "v", op, 3.0) for op in (">", ">=", "<", "<=", "==", "!=")] + [i.Alert("x", "none", ">", 0)]).collect()}
    assert got == {">": "ok", ">=": "breached", "<": "ok", "<=": "breached", "==": "breached", "!=": "ok", "x": "missing_viewer"}
    with pytest.raises(ValueError):
        i.breaches("~", 1.0, 1.0)


def test_charts(spark):
    rows = [("m", "s", 0, 1.0), ("m", "s", 1, 2.0), (None, None, 12, 5.0), ("m", "s", 12, float("nan")), ("m", "s", 13, None)]
    m = spark.createDataFrame([(n, s, T0 + timedelta(seconds=x), y) for n, s, x, y in rows], "metric_name string, service_name string, observed_at timestamp, value double")
    assert [(r.series, r.value) for r in i.chart_series(m, 60_000).collect()] == [("m (s)", 3.0), ("m (s)", 0.0), ("unknown (unknown)", 0.0), ("unknown (unknown)", 5.0)]
    assert [(r.series, r.value) for r in i.chart_totals(m).collect()] == [("m (s)", 3.0), ("unknown (unknown)", 5.0)]
    assert tuple(round(x, 3) for x in i.billboard(m, 60_000).first()) == (5.0, 3.0, 66.667)
    assert tuple(i.billboard(m.limit(0), 60_000).first()) == (0.0, None, None)
    assert i.chart_bucket_ms(300_000) == 10_000 and i.chart_bucket_ms(3_600_000) == 60_000 and i.chart_bucket_ms(3_600_001) == 300_000


def test_waterfall_query_covers_all_traces(spark):
    from spanforge import adapters
    from spanforge.queries import QUERIES

    got = QUERIES["t_waterfall"](spark, "/root/testdata/sf0.001")
    spans = adapters.spans(spark, "/root/testdata/sf0.001").select("trace_id", "span_id")
    assert got.select("trace_id", "span_id").exceptAll(spans).count() == spans.exceptAll(got.select("trace_id", "span_id")).count() == 0


def test_patterns_for_the_engine(spark):
    from spanforge.operators import patterns, viewers

    assert patterns.read(r"(?P<n>x+)(?<m>y)\(?P<z>").java == r"(?iuU)(x+)(y)\(?P<z>"
    v = viewers.compile_viewer({"id": "v", "signal_mask": 7, "lookback_ms": 1000, "definition_json": {"filters": [{"field": "payload", "op": "regex", "value": "(?P<n>x+)y"}]}})
    df = spark.createDataFrame([("logs", "XXY"), ("logs", "y")], "signal string, payload_text string")
    assert [r.payload_text for r in df.where(v.predicate()).collect()] == ["XXY"]
    for bad in ("(", "x{2,1}", "(?=x)"):
        with pytest.raises(viewers.ViewerError):
            viewers.compile_viewer({"id": "v", "signal_mask": 7, "lookback_ms": 1000, "definition_json": {"filters": [{"field": "payload", "op": "regex", "value": bad}]}})


def test_attribute_of_a_request():
    from spanforge.operators import traces

    assert [traces.parse_attribute(x) for x in ("k", " k = v ", "k=", "k= ", "a=b=c")] == [("k", None), ("k", "v"), ("k", None), ("k", None), ("a", "b=c")]
