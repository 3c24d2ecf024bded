import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from spanforge.llm import importance as im

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def features(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(rows, target):
    found = [features(t) for _, t in rows]
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for _, f in found:
        np.add.at(s, f, 1)
    for x in target:
        np.add.at(t, features(x)[1], 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10000) / ((a + 1) * (t.sum() + 10000)))) for a, b in zip(s, t)]
    out = []
    for (d, _), (n, f) in zip(rows, found):
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[3], x[0] is None, x[0], x[2], x[1]))
    for i, x in enumerate(able[: 5 * len(able) // 100]):
        x[4] = i + 1
    return sorted((tuple(x[:5]) for x in out), key=repr)


def corpus(seed, n=400):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(200)] + ["Überaus", "naïve", "日本語", "a" * 64, "B" * 65, "c" * 66, "x9" * 300]
    return [(i, r.choice((" ", ", ", "\n")).join(r.choice(vocab) for _ in range(r.choice((1, 19, 20, 60))))) for i in range(n)]


def test_checksums_of_runs():
    r = random.Random(3)
    for _ in range(30):
        texts = [r.choice((" ", "--", "\t ")).join("".join(r.choice("aBcé9") for _ in range(r.choice((1, 3, 63, 64, 65, 200)))) for _ in range(r.randrange(6))).encode() for _ in range(r.randrange(1, 5))]
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.cumsum([0, *map(len, texts)])
        got = [[] for _ in texts]
        for _, found in im.hashed_runs(data, offsets, limit=100):
            for of, bucket in found:
                for i, b in zip(of, bucket):
                    got[i].append(int(b))
        assert [sorted(g) for g in got] == [sorted(features(t.decode())[1]) for t in texts]


def test_pieces_of_a_long_text_lose_no_run():
    text = corpus(5, 1)[0][1] + " " + " ".join(t for _, t in corpus(6, 40))
    data = np.frombuffer(text.encode(), np.uint8)
    got = sorted(int(b) for _, found in im.hashed_runs(data, np.array([0, len(data)]), limit=64) for _, bucket in found for b in bucket)
    assert got == sorted(features(text)[1])


def test_against_brute_force(spark):
    rows = corpus(1)
    rows += [(500, None), (501, ""), (502, " . "), (None, rows[3][1] + " more words"), (7, rows[7][1]), (503, "long " * 400_000)]
    rows += [(600, "the same twenty words " * 5)] * 60
    target = [t for _, t in corpus(2, 30)] + [None, ""]
    docs = spark.createDataFrame([(*x, 1.0) for x in rows], "doc_id long, text string, score double")
    got = im.resample(docs, spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, target)
    assert [t for _, t in got.dtypes] == ["bigint"] * 5


@pytest.mark.parametrize("n", (1, 3, 17))
def test_ranks_do_not_depend_on_the_partitions(spark, n):
    rows = corpus(4, 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
    assert sorted((tuple(r) for r in im.resample(docs, docs.limit(0)).collect()), key=repr) == brute(rows, [])


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none")
    none = spark.read.parquet(f"{tmp_path}/none")
    assert im.resample(none, none).collect() == []
    assert len(im.resample(spark.createDataFrame([(1, "a")], "doc_id long, text string"), none).collect()) == 1
