import zlib

from spanforge.llm.sharding import shard


def test_contiguous_and_balanced(spark):
    rows = [(i, "ä" * (i % 37)) for i in range(500)] + [(None, "x"), (7, None), (7, "a"), (7, "a"), (600, "z" * 3000)]
    got = shard(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, size int"), 10, ranges=7).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    want = sorted((repr(d), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted((repr(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    order = [r.doc_id if r.doc_id is not None else -1 for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    for s in range(10):
        mine = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        assert abs(sum(r["size"] for r in mine) - total / 10) <= largest


def test_few_rows(spark):
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert [(r.slot, 0 <= r.shard < 40) for r in shard(one).collect()] == [(0, True)]
    assert shard(one.limit(0)).count() == 0


def test_one_row_repeated(spark):
    """A row that repeats is split over ranges and shards, and each of its copies has a slot of its own."""
    df = spark.createDataFrame([(7, "same")] * 400, "doc_id long, text string").repartition(8)
    rows = shard(df, 4, ranges=8).collect()
    assert sorted((x.shard, x.slot) for x in rows) == [(s, n) for s in range(4) for n in range(100)]
