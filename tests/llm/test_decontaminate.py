import random
import re

from spanforge.llm import decontaminate as dc

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(docs, items, window):
    grams = [(i, PATTERN.findall(lower(t))) for i, t in items]
    out = []
    for d, t in docs:
        w, hit, found = PATTERN.findall(lower(t)), set(), set()
        for i, g in grams:
            m = min(window, len(g))
            for a in range(len(g) - m + 1 if m else 0):
                for b in range(len(w) - m + 1):
                    if w[b : b + m] == g[a : a + m]:
                        hit.update(range(b, b + m))
                        if i is not None:
                            found.add(str(i))
        out.append((-1 if d is None else d, len(w), len(hit), sorted(found)))
    return sorted(out)


def test_against_brute_force(spark):
    r = random.Random(2)
    vocab = ["a", "b", "c", "dé", "E1"]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(k, text(r.randrange(0, 9))) for k in range(25)] + [(3, text(6)), (None, text(5)), (99, None), (98, ""), (97, "...")]
    docs = [(k, text(r.randrange(0, 60))) for k in range(60)] + [(1, text(20)), (None, text(30)), (77, None), (78, ""), (79, "--")]
    d = spark.createDataFrame([(*x, "z") for x in docs], "doc_id long, text string, hits string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for window, block in ((4, 10**6), (4, 20), (10, 10**6), (1, 10**6)):
        rows = dc.decontaminate(d, b, window, block).collect()
        assert sorted((-1 if x.doc_id is None else x.doc_id, x.n_words, x.n_hit, x["items"]) for x in rows) == brute(docs, items, window), (window, block)
    assert {x.n_hit for x in dc.decontaminate(d, b.limit(0)).collect()} == {0}
    assert dc.decontaminate(d.limit(0), b).count() == 0


def test_remove(spark):
    item = "one two three four five six seven eight nine ten"
    d = spark.createDataFrame([(1, f"Été, {item.title()}! rest is kept, and more words here of the text than of the item"), (2, item), (3, "clean"), (4, None)], "doc_id long, text string")
    rows = {x.doc_id: x.text for x in dc.remove_hits(dc.decontaminate(d, spark.createDataFrame([(1, item)], "item_id long, text string"))).collect()}
    assert rows == {1: "Été, ! rest is kept, and more words here of the text than of the item", 3: "clean", 4: None}


def test_automaton_is_small():
    """What a worker loads for a block is bounded: about a hundred bytes a word."""
    import pickle

    import numpy as np

    r = np.random.default_rng(1)
    n = 20_000
    items = [(str(i), r.integers(0, 3000, 40).astype(np.uint64)) for i in range(n // 40)]
    assert len(pickle.dumps(dc.SuffixAutomaton(items))) < 120 * n


def test_long_text_and_repeated_items(spark):
    r = random.Random(8)
    item = " ".join(f"w{r.randrange(10**6)}" for _ in range(15))
    d = spark.createDataFrame([(1, "filler " * 100_000 + item + " filler" * 1000)], "doc_id long, text string")
    b = spark.createDataFrame([("b", item), ("a", item), ("a", item), ("c", "not there at all, this one")], "item_id string, text string")
    (row,) = dc.decontaminate(d, b).collect()
    assert (row.n_words, row.n_hit, row["items"]) == (101_015, 15, ["a", "b"])
