import random
import re

import numpy as np
import pytest

from spanforge.llm import near_dedup as nd
from spanforge.llm.components import components

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(t, k=5):
    w = [x.lower() for x in WORDS.findall((t or "").encode())]
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows, num, den):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((repr(d), len(sets[i]), repr(least.get(root(i))), d == least.get(root(i))) for i, (d, _) in enumerate(rows))


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows, base = [], [[r.choice(vocab) for _ in range(r.choice((6, 30, 120)))] for _ in range(12)]
    base.append([r.choice(vocab) for _ in range(160)])
    for i in range(220):
        w = list(base[12] if i % 2 else r.choice(base))
        for _ in range(r.choice((0, 1, 2, 3, 5, 9))):
            w[r.randrange(len(w))] = r.choice(vocab)
        if rows and r.random() < 0.3:
            w = rows[r.randrange(len(rows))][1].split()
            w[r.randrange(len(w))] = "again"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("num,stars", [(85, 2), (80, 1)])
def test_against_brute_force(spark, num, stars):
    rows = corpus(num)
    rows += [(300, ""), (301, None), (302, " \n "), (303, "one two"), (304, "One  two"), (305, "one two three"), (None, rows[5][1]), (None, "only here without an id"), (5, rows[5][1]), (306, "x " * 30000)]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, kept int")
    got = nd.near_duplicates(docs, num, 100, stars=stars).collect()
    assert sorted((repr(x.doc_id), x.n_shingles, repr(x.component_id), x.kept) for x in got) == brute(rows, num, 100)


def test_empty(spark):
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketch_estimates_similarity():
    r = np.random.default_rng(1)
    pool = nd.mix64(np.arange(1, 4001, dtype=np.uint64))
    a, b = np.sort(pool[:800]), np.sort(np.concatenate([pool[:640], pool[2000:2160]]))
    one = np.sort(pool[:1])
    s = nd.sketch(np.concatenate([a, b, one, one]), np.array([0, 800, 1600, 1601, 1602]), 400)
    assert (s != np.uint64(2**64 - 1)).all() and (s[2] == s[3]).all()
    assert abs((s[0] == s[1]).mean() - 640 / 960) < 0.08 and r is not None


def test_components_of_a_path(spark):
    n = 40
    edges = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(100, 101)], "a long, b long")
    assert {(x.v, x.label) for x in components(edges).collect()} == {(i, 0) for i in range(n + 1)} | {(100, 100), (101, 100)}
