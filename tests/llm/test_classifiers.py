import random

import numpy as np
import pytest

from spanforge.llm import quality, toxicity
from spanforge.llm.labelled import remainder

SF = "/root/testdata/sf0.1"


def chunk(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def dense_votes(model, text, term, weight, ids, y, queries, k=toxicity.K):
    """Votes and neighbours of every example, itself left out, from whole rows of cosines."""
    v = len(model.vocabulary)
    x = np.zeros((len(ids), v))
    x[text, term] = weight
    out = []
    for i in queries:
        cosine = np.round(x @ x[i], 12)
        cosine[ids == ids[i]] = 0
        held, held_1 = np.zeros(v), np.zeros(v)
        for j in range(len(ids)):
            if j != i:
                worth = model.prior / y.mean() if y[j] else (1 - model.prior) / (1 - y.mean())
                held[x[j] > 0] += worth
                held_1[x[j] > 0] += worth * y[j]
        lift = ((held_1 + toxicity.PRIOR_TERM * model.prior) / (held + toxicity.PRIOR_TERM) - model.prior) / (1 - model.prior)
        lift[lift < toxicity.LEAST_LIFT] = 0
        spoken = likeness = 0.0
        near = []
        for label in (0, 1):
            mine = [j for j in range(len(ids)) if y[j] == label and cosine[j] > 0]
            mine.sort(key=lambda j: (-cosine[j], ids[j]))
            least = cosine[mine[k - 1]] if len(mine) > k else 0
            above = [j for j in mine if cosine[j] > least]
            ties = [j for j in mine if cosine[j] == least]
            for j in above + ties:
                share = 1.0 if j in above or len(mine) <= k else (k - len(above)) / len(ties)
                likeness += share * cosine[j]
                spoken += share * label * float((x[i] * x[j] * lift**2).sum())
            near.append([(int(ids[j]), cosine[j]) for j in above + ties])
        out.append((spoken / likeness if likeness else np.nan, near))
    return out


def test_votes_equal_dense_cosine():
    r = np.random.default_rng(3)
    for n, n_words in ((700, 60), (90, 400), (30, 5)):
        y = (r.random(n) < 0.3).astype(float)
        texts = [" ".join([*(f"w{int(j)}" for j in r.integers(0, n_words, r.integers(0, 25))), *(["marking"] if y[i] and r.random() < 0.7 else [])]) for i in range(n)]
        ids = np.arange(n) * 3 + 1
        data, offsets = chunk(texts)
        vocabulary = toxicity.Vocabulary(np.unique(toxicity.terms(data, offsets)[1]))
        model = toxicity.Model(vocabulary, 1 + r.random(len(vocabulary)), ids, y, 0.1)
        text, term, weight = model.vectors(data, offsets)
        model.fill(ids, y, text, term, weight)
        votes, near = model.votes(text, term, weight, ids.tolist())
        some = range(0, n, 9)
        for i, (vote, want) in zip(some, dense_votes(model, text, term, weight, ids, y, some)):
            assert np.isnan(votes[i]) == np.isnan(vote) and (np.isnan(vote) or abs(votes[i] - vote) < 1e-9)
            for label in (0, 1):
                q, e, cosine, _ = near[label]
                got = [(int(j), round(c, 9)) for j, c in zip(model.index.ids[e[q == i]], cosine[q == i])]
                assert sorted(got) == sorted((j, round(c, 9)) for j, c in want[label])


def test_every_term_is_indexed(spark):
    """No term is picked by its label, so a text that shares any word with an example has neighbours."""
    docs = spark.createDataFrame([(i, f"common{i % 7} alone{i} tail") for i in range(200)] + [(900, "alone3 only")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, "toxic", remainder(5) >= 0)
    assert len(model.vocabulary) >= 200
    (row,) = toxicity.score(docs.where("doc_id = 900"), model).collect()
    assert [e.doc_id for e in row.evidence if e.cosine > 0.05] == [3]


@pytest.mark.parametrize("module,column,modulus,held,least", [(toxicity, "toxic", 5, lambda r: r == 0, 0.95), (quality, "quality", 3, lambda r: r == 1, 0.97)])
def test_held_out_accuracy(spark, module, column, modulus, held, least):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = module.learn(docs, labels, column, ~held(remainder(modulus)))
    out = module.score(docs.join(labels, "doc_id").where(held(remainder(modulus))), model).toPandas()
    assert ((out.score >= 0.5) == (out[column] == 1)).mean() >= least
    assert out.score.between(0, 1).all()


@pytest.mark.parametrize("module,column", [(toxicity, "toxic"), (quality, "quality")])
def test_odd_rows(spark, module, column):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["good", "word", "and", "more"]) for _ in range(30)) + (" badword!! BADWORD!!" * 4 if i % 3 == 0 else "")) for i in range(120)]
    odd = [(None, "no id"), (500, None), (501, ""), (502, "x" * 300_000), (0, rows[0][1])]
    docs = spark.createDataFrame([(i, t, "s", 0.1) for i, t in rows + odd], "doc_id long, text string, evidence string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)] + [(None, 1), (7, None), (500, 0)], f"doc_id long, {column} int")
    model = module.learn(docs, labels, column, remainder(5) != 0)
    out = module.score(docs, model).collect()
    assert len(out) == 125 and all(0 <= x.score <= 1 for x in out)
    assert len({x.score for x in out if x.doc_id == 0}) == 1
    assert all((x.score >= 0.5) == (x.doc_id % 3 == 0) for x in out if x.doc_id is not None and x.doc_id < 120)
    assert {x.score for x in module.score(docs, module.learn(docs, labels.limit(0), column, remainder(5) != 0)).collect()} == {0.5}
    assert module.score(docs.limit(0), model).count() == 0


def test_evidence(spark):
    docs = spark.createDataFrame([(i, "bad thing here" if i < 10 else "fine thing here") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 10)) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, "toxic", remainder(5) >= 0)
    for x in toxicity.score(docs, model).collect():
        assert (x.score >= 0.5) == (x.doc_id < 10)
        assert x.doc_id not in {e.doc_id for e in x.evidence} and max(x.evidence, key=lambda e: e.cosine).label == int(x.doc_id < 10)


def test_passages_cover_all_words():
    texts = ["", "one", " ".join(f"w{i}" for i in range(200)), "  lead and trail  \n", "\n"]
    x, owner = quality.passages(*chunk(texts))
    assert np.bincount(owner).tolist() == [1, 1, 4, 1, 1]
    assert np.isclose(x[:, quality.N_CLASSES].sum() * quality.PASSAGE, 204)


def small_model(n_in=7):
    model = quality.AttentionMil(n_in, hidden=5, gate=4, seed=3)
    r = np.random.default_rng(11)
    model.mean, model.scale = r.normal(0, 0.3, n_in), 0.5 + r.random(n_in)
    sizes = [1, 4, 2, 7]
    return model, r.normal(0, 1, (sum(sizes), n_in)), np.repeat(np.arange(4), sizes), np.array([1.0, 0.0, 1.0, 0.0])


def plain_score(model, bag):
    """Gated attention over one document's passages, one by one."""
    import math

    w = model.w
    hidden = [[math.tanh(sum((v - m) / s * k for v, m, s, k in zip(x, model.mean, model.scale, w["W"][:, j])) + w["b"][j]) for j in range(w["W"].shape[1])] for x in bag]
    dot = lambda h, m, j: sum(a * b for a, b in zip(h, m[:, j]))
    gate = [math.exp(sum(w["a"][j] * math.tanh(dot(h, w["V"], j)) / (1 + math.exp(-dot(h, w["U"], j))) for j in range(len(w["a"])))) for h in hidden]
    z = [sum(g * h[j] for g, h in zip(gate, hidden)) / sum(gate) for j in range(len(hidden[0]))]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(z, w["c"])) + w["d"][0])))


def test_attention_against_plain_loops():
    model, x, owner, y = small_model()
    got = model.score(x, owner, 4)
    assert np.allclose(got, [plain_score(model, x[owner == i]) for i in range(4)], atol=1e-12)


def test_gradients_against_differences():
    model, x, owner, y = small_model()

    def loss():
        p = model.score(x, owner, 4)
        return -float((y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    for name, grad in model.gradients(x, owner, y).items():
        w = model.w[name]
        for at in np.ndindex(w.shape):
            was = w[at]
            w[at] = was + 1e-6
            up = loss()
            w[at] = was - 1e-6
            down = loss()
            w[at] = was
            assert abs((up - down) / 2e-6 - grad[at]) < 1e-7, (name, at)


def test_features_against_plain_counts():
    texts = ["One two two, THREE! ok\n 12", "", "a " * 70 + "End.", "\u00e9t\u00e9 caf\u00e9"]
    x, owner = quality.passages(*chunk(texts))
    n = quality.N_CLASSES
    for i, t in enumerate(texts):
        words = t.encode().split()
        bags = [words[j : j + quality.PASSAGE] for j in range(0, len(words), quality.PASSAGE)] or [[]]
        assert (owner == i).sum() == len(bags)
        for row, bag in zip(x[owner == i], bags):
            if not bag:
                assert not row.any()
                continue
            low = [w.lower() for w in bag]
            assert np.isclose(row[n], len(bag) / quality.PASSAGE) and np.isclose(row[n + 1] * 8, np.mean([len(w) for w in bag]), atol=1e-5)
            assert np.isclose(row[n + 3], len(set(low)) / len(low)) and np.isclose(row[n + 5], max(map(low.count, low)) / len(low))
            assert np.isclose(row[n + 4], sum(a == b for a, b in zip(low, low[1:])) / len(low)) and np.isclose(row[:n].sum(), 1, atol=1e-5)
