"""Many viewers in one pass."""

import random
import time
from datetime import timedelta

import pytest

from spanforge import adapters as a
from spanforge.operators import dispatch, viewers

DAY = 86_400_000


def random_viewers(seed, n, lookback=True):
    r = random.Random(seed)
    value = lambda: r.choice(("SVC-1", "svc", "error", "K=1", "k=12", "metric.purchase", "view", "click", "é", "zzz", "r", "svc-3"))
    out = []
    for i in range(n):
        body = {}
        kind = r.randrange(5)
        if kind == 1:
            body = {"query": value()}
        elif kind > 1:
            ops = ("eq", "contains", "contains") if kind < 4 else ("eq", "contains", "regex")
            body = {"filter_mode": r.choice(("and", "or")), "filters": [{"field": r.choice(("service_name", "payload")), "op": (op := r.choice(ops)), "value": r.choice((r"k=\d$", "^svc-[12]$", "(e|r+)+o")) if op == "regex" else value()} for _ in range(r.randrange(1, 4))]}
        out.append(viewers.compile_viewer({"id": f"v{i}", "signal_mask": r.randrange(1, 8), "lookback_ms": r.choice((DAY, 10 * DAY, 40 * DAY)), "definition_json": body}))
    return out


def pairs(df):
    return {(x.viewer_id, x.entry_id) for x in df.select("viewer_id", "entry_id").collect()}


@pytest.mark.parametrize("now", (None, a.NOW, a.NOW - timedelta(days=15)))
def test_equal_to_conditions(spark, monkeypatch, now):
    entries = a.entries(spark, "/root/testdata/sf0.001")
    some = random_viewers(1, 60)
    want = pairs(viewers.fan_out(some, entries, now))
    assert len(want) > 1000 and pairs(dispatch.fan_out(some, entries, viewers.FIELDS, now)) == want
    monkeypatch.setattr(dispatch, "SENT_BYTES", 2_000)  # several groups
    assert len(dispatch._groups(some)) > 3 and pairs(dispatch.fan_out(some, entries, viewers.FIELDS, now)) == want


def test_texts_of_all_kinds(spark):
    rows = [(1, "logs", a.NOW, None, "Ünï ERROR"), (2, "logs", a.NOW, "error", None), (3, "traces", a.NOW, "", "erro"), (4, None, a.NOW, "error", "error"), (5, "logs", None, "error", "error")]
    entries = spark.createDataFrame(rows, "entry_id long, signal string, observed_at timestamp, service_name string, payload_text string")
    made = lambda n, **body: viewers.compile_viewer({"id": n, "signal_mask": 7, "lookback_ms": DAY, "definition_json": body})
    some = [made("q", query="error"), made("u", query="ünï"), made("all"), made("eq", filters=[{"field": "service_name", "op": "eq", "value": "ERROR"}]), made("both", filters=[{"field": f, "op": "contains", "value": "erro"} for f in ("service_name", "payload")])]
    for now in (None, a.NOW):
        assert pairs(dispatch.fan_out(some, entries, viewers.FIELDS, now)) == pairs(viewers.fan_out(some, entries, now))


def test_thousands_of_viewers(spark):
    """5,000 viewers over 100,000 entries, equal to single filters of some of them."""
    entries = a.entries(spark, "/root/testdata/sf0.1")
    r = random.Random(3)
    some = [
        viewers.compile_viewer({"id": f"v{i}", "signal_mask": 7, "lookback_ms": 40 * DAY, "definition_json": {"filters": [{"field": "service_name", "op": "contains", "value": f"svc-{r.randrange(10)}"}, {"field": "payload", "op": "contains", "value": f"k={r.randrange(100)}{r.choice(('', 'x', 'yz'))} n{i % 50}" if i % 10 else f"k={i % 100}"}]}})
        for i in range(5_000)
    ]
    began = time.time()
    got = {x.viewer_id: x["count"] for x in viewers.fan_out(some, entries, a.NOW).groupBy("viewer_id").count().collect()}
    assert time.time() - began < 120
    for v in some[:3] + some[10:60:10]:
        assert got.get(v.id, 0) == viewers.matching(v, entries, a.NOW).count(), v.id
    assert len(got) > 100
