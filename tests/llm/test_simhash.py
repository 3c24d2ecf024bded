import random
import re

import numpy as np
import pytest
import xxhash

from spanforge.llm import simhash as sh

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text, k=3):
    w = WORDS.findall((text or "").encode().translate(LOWER))
    return [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def fingerprint(text):
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, radius):
    """The least index that each reaches."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(prints))]


def brute(rows, radius=3):
    prints = [fingerprint(t) for _, t in rows]
    of, least = groups(prints, radius), {}
    for (d, _), g in zip(rows, of):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    return sorted(((d, f"{p:016x}", least.get(g), len(shingles(t))) for (d, t), p, g in zip(rows, prints, of)), key=repr)


def corpus(seed, n=250):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)] + ["Überaus", "naïve", "日本語", "x" * 70]
    base, rows = [[r.choice(vocab) for _ in range(r.choice((2, 12, 60, 200)))] for _ in range(25)], []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice((0, 0, 1, 2))):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((i, r.choice((" ", " \t", "\n")).join(w)))
    return rows


def test_against_brute_force(spark):
    rows = corpus(1)
    rows += [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "One two"), (505, "one two"), (None, rows[5][1]), (None, "only here and without an id"), (5, rows[5][1]), (506, "very long " * 200_000 + "END")]
    docs = spark.createDataFrame([(*x, "x") for x in rows], "doc_id long, text string, fingerprint string")
    got = sh.simhash_duplicates(docs)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)
    assert got.columns == ["doc_id", "fingerprint", "component_id", "n_shingles"]


def test_empty_table(spark):
    assert sh.simhash_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def near_prints(seed, n, close):
    """Random fingerprints, and a crowd of ``close`` around one of them, chained by single steps."""
    r = random.Random(seed)
    out = {r.getrandbits(64) for _ in range(n)}
    centre = r.getrandbits(64)
    for _ in range(close):
        x = centre
        for _ in range(r.randrange(6)):
            x ^= 1 << r.randrange(64)
        out.add(x)
    for x in list(out)[: n // 4]:
        for _ in range(r.choice((2, 3, 4))):
            x ^= 1 << r.randrange(64)
        out.add(x)
    return sorted(out | {0, (1 << 64) - 1, 7, 8})


@pytest.mark.parametrize("dealt,levels,radius", ((4096, 1, 3), (16, 1, 3), (8, 2, 3), (4096, 3, 3), (16, 1, 1), (5, 1, 6)))
def test_buckets_and_tiles_lose_no_link(spark, dealt, levels, radius):
    prints = near_prints(dealt + levels + radius, 300, 300)
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "print long").repartition(3)
    links = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in sh.close_prints(frame, radius, dealt, levels).collect()]
    place = {p: i for i, p in enumerate(prints)}
    want = groups(prints, radius)
    assert all(want[place[a]] == want[place[b]] for a, b in links)
    pairs = [(np.array([place[a]]), np.array([place[b]])) for a, b in links]
    assert sh.reached(len(prints), pairs).tolist() == want


def test_a_crowd_gives_no_list_of_pairs(spark):
    r = random.Random(3)
    prints = {sum(1 << b for b in r.sample(range(16, 63), 2)) for _ in range(700)}
    frame = spark.createDataFrame([(p,) for p in prints], "print long")
    assert sh.close_prints(frame, 3, dealt=64).count() < 60 * len(prints)
    assert sh.close_prints(frame, 3).count() < 4 * len(prints)


@pytest.mark.parametrize("seed", range(5))
def test_tiles_against_all_pairs(seed):
    r = np.random.default_rng(seed)
    base = r.integers(0, 2**64, 20, dtype=np.uint64)
    x, y = (np.sort(base[r.integers(0, 20, n)] ^ (np.uint64(1) << r.integers(0, 64, n, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, n, dtype=np.uint64))) for n in (300, 170))
    x, y = x[np.argsort(np.bitwise_count(x), kind="stable")], y[np.argsort(np.bitwise_count(y), kind="stable")]
    got = {(int(a), int(b)) for i, j in sh.compare(x, y, 3, tile=16) for a, b in zip(i, j)}
    assert got == {(a, b) for a in range(300) for b in range(170) if (int(x[a]) ^ int(y[b])).bit_count() <= 3}


@pytest.mark.parametrize("seed", range(6))
def test_pieces_of_a_long_text(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("aB9é") for _ in range(r.choice((1, 5, 40)))) for _ in range(r.choice((1, 2, 3, 200)))]
    text = (" " * r.choice((0, 1, 90))) + r.choice((" ", "  \n")).join(words) + " " * r.choice((0, 90))
    data = np.frombuffer(text.encode(), np.uint8)
    assert sh.long_fingerprint(data, limit=50) == (fingerprint(text), len(shingles(text)))
