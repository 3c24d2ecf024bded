import random
from collections import Counter

import pytest

from spanforge.llm import substring_dedup as sd


def brute(rows, length):
    raw = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + length] for _, b in raw for i in range(len(b) - length + 1))
    out = []
    for d, b in raw:
        gone = sd.merged([(i, i + length) for i in range(len(b) - length + 1) if seen[b[i : i + length]] > 1])
        at, kept = 0, b""
        for x, y in gone:
            kept, at = kept + b[at:x], y
        out.append((repr(d), gone, kept + b[at:]))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    syllables = ["tha", "ing", "é ", "on ", "ß", "er", ". ", "a"]
    text = lambda n: "".join(r.choice(syllables) for _ in range(n))
    passages = [text(r.randrange(20, 400)) for _ in range(8)]
    rows = []
    for i in range(120):
        parts = [text(r.randrange(0, 150))]
        for _ in range(r.choice((0, 0, 1, 2))):
            p = r.choice(passages)
            a = r.randrange(len(p) // 2)
            parts += [p[a : a + r.randrange(1, len(p))], text(r.randrange(0, 60))]
        rows.append((i, "".join(parts)))
    rows += [(200 + i, rows[7][1]) for i in range(5)] + [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (None, rows[10][1])]
    rows += [(300, None), (301, ""), (302, "short"), (303, "a" * 5000), (304, "ab" * 900), (305, " " * 401), (306, "了" * 300), (307, passages[0] * 3)]
    return rows


@pytest.mark.parametrize("length", [200, 60, 10])
def test_against_brute_force(spark, length):
    rows = corpus(length)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, kept string, hash int")
    got = sd.remove_repeats(docs, length).collect()
    assert sorted((repr(x.doc_id), [tuple(s) for s in x.removed], bytes(x.kept)) for x in got) == brute(rows, length)


def test_empty(spark):
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
