import math
import random

from pyspark.sql import functions as F

from spanforge.llm.topk import top_k


def brute(rows, queries, k):
    ok = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, q in ok:
        if queries(i):
            best = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in ok if j != i and len(x) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_against_brute_force(spark):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(8)]) for i in range(700)]
    rows += [(700 + i, rows[i % 7][1]) for i in range(60)]
    rows += [(900, None), (901, [1.0, None] * 4), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (904, []), (None, [0.5] * 8), (910, [1.0, 2.0]), (920, [0.5, 0.25])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    for block, k in ((4096, 5), (64, 5), (64, 900)):
        got = top_k(df, F.col("vec_id") % 10 == 0, k=k, block=block, pivots=6).collect()
        assert sorted(tuple(x) for x in got) == brute(rows, lambda i: i % 10 == 0, k)
    assert top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_large_components(spark):
    rows = [(i, [float(i * 3 - 20) * 1e5, 7.5]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(x) for x in top_k(df, F.col("vec_id") % 10 == 0).collect()) == brute(rows, lambda i: i % 10 == 0, 5)


def test_scores_near_64_bits(spark):
    import pytest

    r = random.Random(6)
    rows = [(i, [r.uniform(-1, 1) * 3e6 for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(x) for x in top_k(df, F.col("vec_id") % 10 == 0, block=16).collect()) == brute(rows, lambda i: i % 10 == 0, 5)
    far = spark.createDataFrame([(1, [1e17, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        top_k(far, F.col("vec_id") > 0)


def test_pivots_leave_most_candidates_out():
    import numpy as np

    from spanforge.llm import topk

    r = np.random.default_rng(3)
    centres = r.normal(0, 80, (40, 16))
    x = np.floor(centres[r.integers(0, 40, 4000)] + r.normal(0, 4, (4000, 16)))
    pivots = topk._far_apart(x, 24)
    top, table = topk._table(x, pivots)
    got, seen = topk._pairs_of(np.arange(4000), x, top, table, np.arange(50), x[:50], np.full(50, -np.inf), pivots, 5)
    assert seen < 0.5 * 50 * 4000
    for i in range(50):
        score = x @ x[i]
        score[i] = -np.inf
        assert sorted(s for q, _, s in got if q == i) == sorted(np.sort(score)[-5:].astype(int).tolist())


def test_long_vectors_leave_the_driver_small(spark, monkeypatch):
    """400 vectors of 20,000 components, 64 MB; the driver holds and sends a few of them."""
    import numpy as np

    held = []
    broadcast = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: held.append(value) or broadcast(self, value))
    rows = spark.range(0, 400, numPartitions=4).select(F.col("id").alias("vec_id"), F.expr("transform(sequence(0, 19999), j -> double(pmod(xxhash64(id, j), 512)) / 256 - 1)").alias("embedding"))
    rows = rows.union(spark.createDataFrame([(1000, [0.5] * 8), (1001, [0.25] * 8)], rows.schema))
    got = top_k(rows, F.col("vec_id") % 100 == 0).collect()
    x = {r.vec_id: np.floor(256 * np.array(r.embedding)) for r in rows.where("vec_id < 400").collect()}
    want = [(1000, 1, 1001, 8 * 128 * 64)]
    for q in (0, 100, 200, 300):
        best = sorted((-int(x[q] @ v), i) for i, v in x.items() if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    first, _ = held[0]
    assert 0 < sum(v.nbytes for _, v in first.values()) <= 8 << 19


def test_cells_of_bounded_size_give_the_same(spark, monkeypatch):
    """Many small cells, many equal vectors: each candidate is in one cell, a query meets all."""
    from spanforge.llm import topk

    monkeypatch.setattr(topk, "CELL_VALUES", 200)
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    r = random.Random(8)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, rows[5][1] if i % 3 else [4.0] * 8) for i in range(90)] + [(1000, [1.0, 2.0]), (1010, [0.5, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(tuple(x) for x in top_k(df, F.col("vec_id") % 10 == 0).collect()) == brute(rows, lambda i: i % 10 == 0, 5)


def test_no_row_between_spark_and_python_grows_with_the_tables(spark, monkeypatch):
    """A row that went to the search held a block of queries, one of candidates and its pivot table, 1.1 MB, up to 1,000 of them in a batch."""
    from spanforge.llm import topk

    seen = []
    blocks = topk._blocks
    monkeypatch.setattr(topk, "_blocks", blocks)
    df = spark.range(0, 5000).select(F.col("id").alias("vec_id"), F.expr("transform(sequence(0, 63), j -> float(pmod(xxhash64(id, j), 512)) / 512 - 0.5)").alias("embedding"))
    lean = topk.lean

    def watched(run):
        if run.__name__ != "search":
            return lean(run)

        def sizes(batches):
            import pyarrow as pa

            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([max(sum(c.slice(i, 1).nbytes for c in b.columns) for i in range(b.num_rows))]), pa.array([0])], ["query_id", "vec_id", "score"])

        return lean(sizes)

    monkeypatch.setattr(topk, "lean", watched)
    seen = top_k(df, F.col("vec_id") % 2 == 0).collect()
    assert seen and max(r.query_id for r in seen) <= 2 * topk.BATCH_BYTES and max(r.vec_id for r in seen) <= 200_000
