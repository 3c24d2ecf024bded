import hashlib
import math
import random

import numpy as np
import pytest

from spanforge.llm import vector_codes as vc


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, lab, [math.floor(scale * x) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    width = -(-len(kept[0][2]) // parts)
    cut = [[(x + [0] * (width * parts - len(x)))[p * width : (p + 1) * width] for p in range(parts)] for _, _, x in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = [nearest(c[p], books[p])[1] for c in cut]
            for j in range(len(books[p])):
                mine = [c[p] for c, o in zip(cut, of) if o == j]
                if mine:
                    books[p][j] = [sum(z) // len(mine) for z in zip(*mine)]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors, by_label = [sum(d for d, _ in f) for f in found], {}
    for (_, lab, _), e in zip(kept, errors):
        by_label[lab] = by_label.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{j:02x}" for _, j in f), e, by_label[lab], sha) for (i, lab, _), f, e in zip(kept, found, errors)), key=repr)


def vectors(seed, n, dim, spread):
    r = random.Random(seed)
    centres = [[r.uniform(-1, 1) for _ in range(dim)] for _ in range(9)]
    return [(i, [c + r.gauss(0, spread) for c in r.choice(centres)], r.choice((None, 1, 2, 3))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, error int")


@pytest.mark.parametrize("scale", (1024.0, 4.0))
def test_against_plain_loops(spark, scale):
    """At the small scale most distances are ties."""
    rows = vectors(1, 330, 8, 0.2)
    rows += [(400, None, 1), (401, [0.5] * 7 + [None], 1), (402, [float("nan")] * 8, None), (403, [float("inf")] + [0.0] * 7, 2), (None, [0.25] * 8, None)]
    rows += [(404 + i, [0.125] * 8, 7) for i in range(100)] + [rows[3], (5, [0.3] * 8, 2)] + [(600, [0.1] * 9, 1), (601, [], 1)]
    random.Random(2).shuffle(rows)
    made = vc.encode(frame(spark, rows).repartition(5), scale=scale)
    assert sorted((tuple(r) for r in made.collect()), key=repr) == brute(rows, scale=scale)
    assert [t for _, t in made.dtypes] == ["bigint", "string", "bigint", "bigint", "string"]


@pytest.mark.parametrize("rows", ([], [(1, None, None)], [(1, [0.5, 0.25], 3)], vectors(3, 40, 6, 0.1), [(i, [float(i % 3)] * 4, i % 2) for i in range(300)], [(1, [], 1), (2, [], None)]), ids=["none", "null", "one", "few", "ties", "no components"])
def test_small_tables(spark, rows):
    got = sorted((tuple(r) for r in vc.encode(frame(spark, rows)).collect()), key=repr)
    assert got == (brute(rows) if any(v is not None for _, v, _ in rows) else [])


def test_large_components(spark):
    rows = [(i, [x * 2000.0 for x in v], lab) for i, v, lab in vectors(4, 60, 4, 0.5)]
    assert sorted((tuple(r) for r in vc.encode(frame(spark, rows)).collect()), key=repr) == brute(rows)
    with pytest.raises(ValueError):
        vc.encode(frame(spark, [(1, [1e30], 1)]))


@pytest.mark.parametrize("seed", range(4))
def test_bounds_spare_scans_but_no_entry(seed):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 300, (40, 5))
    x = np.floor(centres[r.integers(0, 40, 3000)] + r.normal(0, 15, (3000, 5))).astype(np.int64)
    book = x[:200].copy()
    groups = vc._groups(book)
    assert sorted(np.concatenate(groups).tolist()) == list(range(200))
    code, bounds, drift, work = np.zeros(len(x), np.int64), None, np.zeros(200), []
    for _ in range(6):
        code, d, bounds, scanned = vc.reassign(x, book, groups, code, bounds, drift)
        full = ((x[:, None, :] - book[None]) ** 2).sum(2)
        assert (code == full.argmin(1)).all() and (d == full.min(1)).all()
        full[np.arange(len(x)), code] = 1 << 60
        for g, members in enumerate(groups):
            assert (bounds[:, g] <= np.sqrt(full[:, members].min(1))).all()
        work.append(scanned)
        new = np.stack([x[code == j].sum(0) // max(1, (code == j).sum()) if (code == j).any() else book[j] for j in range(200)])
        drift, book = np.sqrt(((new - book) ** 2).sum(1)) + 1e-9, new
    assert work[-1] < work[0] / 2


def test_one_state_is_left(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("spanforge.llm.common.shared_dir", lambda _: str(tmp_path))
    vc.encode(frame(spark, vectors(5, 50, 4, 0.1))).collect()
    assert len(list(tmp_path.iterdir())) == 1
