"""Patterns of filters, and moments of large counts."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from spanforge.operators import insight, patterns
from spanforge.operators.viewers import ViewerError, check_pattern


@pytest.mark.parametrize("bad", [r"(a)\1", r"(?=a)b", r"(?!a)", r"(?<=a)b", r"(?<!a)b", r"(?>a)b", r"a\k<x>", r"\Qa\E", r"a\Z", "a{3,2}", "*a", "(", ")", "[a", "a\\", r"\p", "(?P<1>a)", "a{99999}"])
def test_refused(spark, bad):
    with pytest.raises(ViewerError):
        check_pattern(bad)


@pytest.mark.parametrize("good", [r"C:\\1", r"C:\\(\d+)", "[a-z&&[b]]", "(?P<year>[0-9]{4})", "(?<y>a)|b", "(?i)a(?-i:B)", r"\x41\u0042", "a++b", "[]a]", "[^]]", "a{2}", r"\p{Greek}", "(?s).", "}", "x]"])
def test_taken(spark, good):
    check_pattern(good)


def test_meaning(spark):
    texts = ["C:\\1", "aab", "aaab", "b", "q", "Über", "x]", "12", "٣", "a b", "error k=7", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    want = {
        r"^C:\\1$": {0}, "^a++ab$": {1, 2}, "[a-z&&[b]]": {1, 2, 3, 5, 9}, "über": {5}, r"^\d+$": {7, 8}, r"k=\d$": {10}, r"x]$": {6}, r"^(a+)+b$": {1, 2}, r"^(\w|\d)+$": {1, 2, 3, 4, 5, 7, 8},
        r"^(?:\S+\s?)+$": {0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10},
    }
    got = frame.select("i", *(patterns.found(F.col("t"), p).alias(f"c{n}") for n, p in enumerate(want))).collect()
    for n, (p, rows) in enumerate(want.items()):
        assert {r.i for r in got if r[f"c{n}"]} == rows, p


def test_against_another_engine(spark):
    """Random patterns without possessive forms mean the same to Python's engine."""
    r = random.Random(5)

    def made(depth):
        if depth == 0:
            return r.choice(["a", "b", "c", ".", "[ab]", "[^a]", r"\d", "x1"])
        kind = r.randrange(5)
        inner = made(depth - 1)
        return {0: inner + made(depth - 1), 1: f"({inner}|{made(depth - 1)})", 2: f"(?:{inner})" + r.choice("*+?"), 3: f"({inner}){{1,2}}", 4: inner}[kind]

    texts = ["".join(r.choice("abcx1") for _ in range(r.randrange(7))) for _ in range(60)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    some = [f"^{made(3)}$" for _ in range(25)]
    rows = frame.select("i", "t", *(patterns.found(F.col("t"), p).alias(f"c{n}") for n, p in enumerate(some))).collect()
    assert {patterns.read(p).nested for p in some} == {False, True}
    for n, p in enumerate(some):
        assert [x[f"c{n}"] for x in rows] == [re.search(p, x.t, re.I) is not None for x in rows], p


def test_nested_repetition_is_linear(spark):
    assert patterns.read("(a+)+$").nested and patterns.read("(a|aa)*$").nested and patterns.read("a++").nested and not patterns.read("(ab)+c*").nested
    frame = spark.createDataFrame([("a" * 40_000 + "!",)], "t string")
    began = time.time()
    assert not frame.select(patterns.found(F.col("t"), "^(a+)+$")).first()[0]
    assert time.time() - began < 30


def test_zscore_of_large_counts(spark):
    """Counts near 10**9 that differ by a few."""
    base = 1e9
    rows = [(0, base + 6)] + [(i + 1, base + d) for i, d in enumerate((0, 3, -2, 4, 1))]
    r = insight.zscore_of(spark.createDataFrame(rows, "b long, c double"), 2.0).first()
    assert abs(r.expected - (base + 1.2 + 2 * (22.8 / 5) ** 0.5)) < 1e-6 and r.breached
    holes = spark.createDataFrame([(0, 3.0), (2, 4.0), (5, 6.0)], "b long, c double")
    counts = [0, 4, 0, 0, 6]
    mean = sum(counts) / 5
    assert abs(insight.zscore_of(holes, 1.0).first().expected - (mean + (sum((x - mean) ** 2 for x in counts) / 5) ** 0.5)) < 1e-9
