"""Percentiles by distributed selection."""

import math
import random

import pytest
from pyspark.sql import functions as F

from spanforge.operators import selection

RANKS = {"p0": 0.001, "p50": 0.5, "p95": 0.95, "p99": 0.99}


def order(v):
    return (v != v, v)


def brute(rows):
    groups = {}
    for g, v, bad in rows:
        if v is not None:
            groups.setdefault(g, []).append((v, bad))
    out = {}
    for g, found in groups.items():
        values = sorted((v for v, _ in found), key=order)
        out[g] = (len(values), sum(b for _, b in found), values[-1], *(values[math.ceil(p * len(values)) - 1] for p in RANKS.values()))
    return out


def same(a, b):
    return a == b or a != a and b != b


@pytest.mark.parametrize("kind", ("spread", "close", "ties", "odd"))
def test_against_sorting(spark, kind):
    r = random.Random(kind)
    draw = {
        "spread": lambda: r.choice((-1, 1)) * 10 ** r.uniform(-300, 300),
        "close": lambda: 1.0 + r.randrange(1 << 20) * 2.0**-52,
        "ties": lambda: float(r.randrange(7) - 3),
        "odd": lambda: r.choice((math.nan, math.inf, -math.inf, 0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, 1.0, None)),
    }[kind]
    rows = [(r.choice((None, "a", "a", "a", "b")), draw(), r.randrange(2)) for _ in range(800)] + [("one", 3.0, 1), ("none", None, 1)]
    frame = spark.createDataFrame(rows, "g string, v double, bad int").repartition(3)
    got = selection.at_ranks(frame, ["g"], "v", RANKS, {"bad_n": F.sum("bad")}, most="top")
    want = brute(rows)
    found = {x.g: tuple(x)[1:] for x in got.collect()}
    assert got.columns == ["g", "n", "bad_n", "top", *RANKS] and found.keys() == want.keys()
    for g in want:
        assert all(same(a, b) for a, b in zip(found[g], want[g])), g


def test_digits_rise_with_the_value(spark):
    r = random.Random(4)
    values = sorted([r.choice((-1, 1)) * 10 ** r.uniform(-320, 308) for _ in range(3000)] + [0.0, 5e-324, -5e-324, math.inf, -math.inf, 1.0, math.nextafter(1.0, 2)]) + [math.nan]
    frame = spark.createDataFrame(list(enumerate(values)), "i int, v double").orderBy("i")
    d = [x[0] for x in frame.select(selection.coarse(F.col("v"))).collect()]
    assert d == sorted(d) and len(set(d)) > 2000 and max(d[:-1]) < d[-1]
    low, high = 1.0, math.nextafter(1.0, 2) + 2**-20
    inside = sorted(r.uniform(low, high) for _ in range(2000))
    e = [x[0] for x in spark.createDataFrame(list(enumerate(inside)), "i int, v double").orderBy("i").select(selection.fine(F.col("v"), F.lit(low), F.lit(high))).collect()]
    assert e == sorted(e) and len(set(e)) > 1900 and 0 <= e[0] and e[-1] <= selection.PARTS


def test_one_group_is_read_once_and_sorted_in_parts(spark, tmp_path):
    """A table of one group: one scan, no percentile over raw values, and what a window sorts is digits."""
    spark.range(200_000).select(F.lit("g").alias("g"), (F.rand(3) * 1000).alias("v")).write.parquet(f"{tmp_path}/one")
    df = selection.at_ranks(spark.read.parquet(f"{tmp_path}/one"), ["g"], "v", {"p": 0.95})
    row = df.collect()[0]
    values = sorted(x.v for x in spark.read.parquet(f"{tmp_path}/one").collect())
    assert row.p == values[190_000 - 1] and row.n == 200_000
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("FileScan") == 1 and "percentile" not in final and "ReusedExchange" in final
    digits = spark.read.parquet(f"{tmp_path}/one").select(selection.coarse(F.col("v")).alias("d")).groupBy("d").count()
    assert digits.count() < 20_000 and digits.agg(F.max("count")).first()[0] < 2_000
