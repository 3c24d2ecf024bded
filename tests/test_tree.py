import random

from pyspark.sql import functions as F

from spanforge.operators import traces, tree

ROWS = "trace_id string, span_id string, parent_span_id string, start_ms double, ms long, seq long, rs int, ss int, i int"
KEYS = ("ms", "seq", "rs", "ss", "i")


def table(spark, made):
    """(trace, span id, parent id, start) as they arrived."""
    rows = [(*m, 0, 0, 0, 0, i) for i, m in enumerate(made)]
    random.Random(5).shuffle(rows)
    return spark.createDataFrame(rows, ROWS).repartition(3).select("*", F.struct(*KEYS).alias("ord"))


def places(df):
    return {(r.trace_id, r.i): (r.position, r.depth) for r in df.select("trace_id", F.col("ord.i").alias("i"), "position", "depth").collect()}


def brute(made):
    out = {}
    for trace in {m[0] for m in made}:
        mine = [i for i, m in enumerate(made) if m[0] == trace]
        found = traces.depth_first(*([made[i][c] for i in mine] for c in (1, 2, 3)))
        out |= {(trace, mine[j]): (n, d) for n, (j, d) in enumerate(found)}
    return out


def random_traces(seed, n, ids):
    """Few ids and starts: missing parents, ties, repeated ids, cycles."""
    r = random.Random(seed)
    return [(f"t{r.randrange(n)}", *(str(r.randrange(ids)) if r.random() > 0.1 else "" for _ in range(2)), float(r.randrange(4))) for _ in range(n * ids // 2)]


def test_random_trees_equal_a_walk(spark):
    for seed, ids in ((1, 4), (2, 9)):
        made = random_traces(seed, 60, ids)
        placed, walk = tree.preorder(table(spark, made))
        want, got = brute(made), places(placed)
        assert walk is not None and {t for t, _ in got}.isdisjoint(r.trace_id for r in walk.select("trace_id").distinct().collect())
        assert len(got) + walk.count() == len(made) and len({t for t, _ in got}) > 3
        assert got == {k: v for k, v in want.items() if k in got}


def test_clear_ids_need_no_walk(spark):
    r = random.Random(3)
    made = [(f"t{t}", str(i), str(r.randrange(14)) if r.random() > 0.2 else "", float(r.randrange(3))) for t in range(40) for i in range(12)]
    again = made + [m for m in made if r.random() < 0.3]  # sent twice
    for rows in (made, again, made[:0]):
        placed, walk = tree.preorder(table(spark, rows))
        assert walk is None and places(placed) == brute(rows)


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    made = [("t", str(i), str(i - 1) if i else "", 0.0) for i in range(3000)] + [("u", "x", "x", 1.0), ("u", "r", "", 2.0), ("u", "y", "x", 0.0)]
    rounds = []
    real = tree._Tables.drop
    monkeypatch.setattr(tree._Tables, "drop", lambda self, name: (rounds.append(name), real(self, name)))
    got = places(tree.preorder(table(spark, made))[0])
    assert got == brute(made) and got["t", 2999] == (2999, 2999) and got["u", 3001] == (0, 0)
    assert len([n for n in rounds if "going" in n]) <= 15  # binary digits of 6,000 steps, and one that ends nothing


def test_large_and_small_traces_of_a_waterfall(spark):
    from helpers import bodies, span, trace_body

    from spanforge.sources import otlp

    kids = [span("big", f"k{i}", parent=f"k{i - 1}" if i else "") for i in range(9)]
    twice = [span("odd", "a"), span("odd", "b", parent="a"), span("odd", "a", parent="b"), span("odd", "c", parent="a"), span("odd", "d", parent="b")]
    spans = otlp.spans(bodies(spark, ("traces", 1, None, trace_body(("s", kids + twice + [span("small", "z")])))))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(traces.waterfall(spans, walked=4)) == rows(traces.waterfall(spans)) and traces.waterfall(spans, walked=4).count() == 15
