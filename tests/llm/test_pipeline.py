import pandas as pd
from test_decontaminate import brute as brute_hits
from test_near_dedup import brute as brute_near
from test_substring_dedup import brute as brute_cut

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    good = cp.keep_quality(spark, docs, SF).cache()
    kept = {x.doc_id for x in good.collect()}
    wrong = [(i in kept) != (q == 1) for i, q in zip(labels.doc_id, labels.quality)]
    assert sum(wrong) <= 0.03 * len(wrong) and good.columns == cp.COLUMNS

    one = cp.drop_near_copies(spark, good, SF).cache()
    rows = [(x.doc_id, x.text) for x in good.collect()]
    assert sorted(repr(x.doc_id) for x in one.collect()) == sorted(i for i, _, _, first in brute_near(rows, 80, 100) if first)

    cut = cp.cut_repeats(spark, one, SF).cache()
    want = {i: raw.decode(errors="ignore") for i, _, raw in brute_cut([(x.doc_id, x.text) for x in one.collect()], 200)}
    got = {repr(x.doc_id): x for x in cut.collect()}
    assert {i: x.text for i, x in got.items()} == want and all(len(x.text) == x.n_chars for x in got.values())

    clean = cp.cut_benchmark(spark, cut, SF).cache()
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = brute_hits([(x.doc_id, x.text) for x in cut.collect()], items, 10)
    assert {x.doc_id for x in clean.collect()} == {i for i, n, h, _ in hits if h <= 0.5 * n}
    untouched = {i for i, _, h, _ in hits if h == 0}
    before = {x.doc_id: x.text for x in cut.collect()}
    assert all(x.text == before[x.doc_id] for x in clean.collect() if x.doc_id in untouched)
    assert sum(h for _, _, h, _ in hits) > 0

    ids = cp.encode(spark, clean, SF).collect()
    assert all(x.round_trip and x.n_tokens == len(x.ids) for x in ids) and len(ids) == clean.count()


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, None, "en", "s", 0), (2, "a b c", "en", "s", 5), (2, "a b c", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
    assert cp.keep_quality(spark, docs, SF).count() <= 5
    # Texts without words link with nothing and stay, each of them; of the repeated row one stays.
    left = cp.drop_near_copies(spark, docs, SF)
    assert sorted((x.doc_id or 0, x.text or "") for x in left.collect()) == [(0, ""), (1, ""), (1, ""), (2, "a b c")]
    out = cp.encode(spark, cp.cut_benchmark(spark, cp.cut_repeats(spark, left, SF), SF), SF).collect()
    assert sorted((x.doc_id or 0, x.n_tokens > 0, x.round_trip) for x in out) == [(0, False, True), (1, False, True), (1, False, True), (2, True, True)]
