"""Toxicity from the nearest labelled examples by exact TF-IDF cosine over block-max inverted indexes.

Terms are all words and all word beginnings of ``PREFIX`` bytes of the sampled labelled documents; none is picked by
its label.  Their document frequencies are counted over all documents.  The examples are cut into blocks of one label
each, and each term's postings keep the largest weight of every block, so the sum of a
query's weights times those bounds any cosine in the block.  Each label's blocks are opened in the order of their bounds
until its k-th cosine found is above the next bound, so the neighbours are exact.  If several are as near as the k-th, all of
them vote and share the votes that are left, so no id decides.

Each neighbour of label 1 votes with the part of its cosine that speaks for the label, each shared term's product
times the square of ``lift``: how far the label's share among the term's examples is above its share among all (0 below a tenth).  The
votes' sum over the sum of all neighbours' cosines is the share of likeness that goes with the label.  A monotone
calibration, fitted on the examples' own leave-one-out votes, makes it a probability; the neighbours are the evidence.
A document of the sample is left out of its own neighbours and of its own terms' shares.

Bounds: ``EXAMPLES`` labelled documents, half of each label where there are as many, of ``EXAMPLE_BYTES`` of text in all
(the first ones by a hash of the id); what is sent to tasks is of that order.

Defined results: texts without a known term (null and empty ones too) have no neighbours and get the share of label 1;
repeated rows get equal results; if the labels have no examples of both kinds every score is 0.5; an empty table gives
an empty result; other columns are carried through, and those of the names of output columns are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _WORDS, LOWER, WORD_ALNUM, batch_chunks, discard, gather_spans, lean, materialize, mix64, read, signed, words
from .labelled import balanced, remainder, texts

EXAMPLES = 1500
EXAMPLE_BYTES = 64 << 20
BLOCK = 64
K = 15
PREFIX = 5
#: Share of the examples from which on a term's postings are stored dense.
DENSE = 0.05
#: Blocks of either label that a query opens first.
FIRST = 4
NO_ID = np.iinfo(np.int64).min
#: Examples' worth of the label's overall share in each term's share.
PRIOR_TERM = 5.0
#: A lift below this says nothing.
LEAST_LIFT = 0.1


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, term hash) of all term places of a chunk."""
    start, end, text, hashes = words(data, offsets, WORD_ALNUM)
    if not len(start):
        return text, hashes
    long = end - start > PREFIX
    begun = mix64(_WORDS.spans(_WORDS.prefix(LOWER[data]), start[long], start[long] + PREFIX) ^ np.uint64(PREFIX))
    return np.concatenate([text, text[long]]), np.concatenate([hashes, begun])


class Vocabulary:
    """Sorted term hashes; they are uniform, so their first bits lead to their place."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.bits = max(4, int(len(hashes)).bit_length() + 3)
        head = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        counts = np.bincount(head, minlength=1 << self.bits)
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        self.most = int(counts.max(initial=0))
        self.padded = np.concatenate([hashes, np.zeros(self.most + 1, np.uint64)])

    def __len__(self) -> int:
        return len(self.hashes)

    def __reduce__(self):
        return Vocabulary, (self.hashes,)

    def counts(self, text: np.ndarray, term: np.ndarray):
        """(text, term number, count) of the known terms, sorted by text and number."""
        at = self.first[(term >> np.uint64(64 - self.bits)).astype(np.int64)]
        found = self.padded[at] == term
        for step in range(1, self.most):
            other = np.flatnonzero(~found)
            hit = other[self.padded[at[other] + step] == term[other]]
            at[hit] += step
            found[hit] = True
        key = np.sort(text[found] * len(self.hashes) + at[found])
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        text, term = np.divmod(key[first], max(len(self.hashes), 1))
        return text, term, np.diff(np.concatenate([first, [len(key)]]))


def vocabulary_of(examples: DataFrame) -> Vocabulary:
    """All terms of the examples."""

    def run(batches):
        for batch in batches:
            for _, _, data, offsets in batch_chunks(batch):
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.unique(terms(data, offsets)[1])))], ["term"])

    found = examples.select("text").mapInArrow(lean(run), "term long").distinct().toArrow()
    return Vocabulary(np.sort(np.asarray(found.column("term")).view(np.uint64)))


def document_frequencies(docs: DataFrame, vocabulary: Vocabulary) -> tuple[int, np.ndarray]:
    """(documents, documents that hold each term) over the whole table."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        total, counts = 0, np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for a, b, data, offsets in batch_chunks(batch):
                total += b - a
                _, term, _ = shared.value.counts(*terms(data, offsets))
                counts += np.bincount(term, minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], some])), pa.array(np.concatenate([[total], counts[some]]))], ["term", "n"])

    found = docs.select("text").mapInArrow(lean(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = np.asarray(found.column("term")), np.asarray(found.column("n"))
    out = np.zeros(len(vocabulary), np.int64)
    out[term[term >= 0]] = n[term >= 0]
    return int(n[term < 0].sum()), out


class BlockMaxIndex:
    """Vectors by term, in blocks of one label each, with the largest weight of each term in each block.

    Postings of a term that ``DENSE`` of the examples hold are a row over all examples, so that the products of a chunk of
    queries with these terms are one matrix product; they are exact and part of the blocks' bounds.
    """

    def __init__(self, ids: np.ndarray, y: np.ndarray, text: np.ndarray, term: np.ndarray, weight: np.ndarray, speaking: np.ndarray):
        """``text`` numbers the ids; vectors are unit vectors; ``speaking``: for each term, whether it goes with label 1."""
        n_terms, self.speaking = len(speaking), speaking
        held = np.bincount(term, minlength=n_terms)
        # Neighbours in the order share the heaviest of their common terms, which keeps the blocks' bounds tight.
        often = held[term] >= min(BLOCK, max(2, len(ids) // 8))
        heaviest = np.full(len(ids), -1)
        order = np.lexsort((np.where(often, weight, -1.0), text))
        heaviest[text[order]] = term[order]
        rank = np.lexsort((ids, heaviest, y))
        n_0 = int((y == 0).sum())
        # A label begins with a block of its own: places between are empty.
        slot = np.concatenate([np.arange(n_0), -(-n_0 // BLOCK) * BLOCK + np.arange(len(ids) - n_0)])
        place = np.empty(len(ids), np.int64)
        place[rank] = slot
        self.n_blocks = int(-(-(slot[-1] + 1) // BLOCK))
        self.labels = [slice(0, -(-n_0 // BLOCK)), slice(-(-n_0 // BLOCK), self.n_blocks)]
        self.n = self.n_blocks * BLOCK
        self.ids = np.zeros(self.n, np.int64)
        self.ids[slot] = ids[rank]
        at = place[text]
        mine = np.flatnonzero(speaking[term] & (y[text] > 0))
        mine = mine[np.argsort(at[mine], kind="stable")]
        self.own_term, self.own_weight = term[mine], weight[mine]
        self.own_first = np.searchsorted(at[mine], np.arange(self.n + 1))
        self.row = np.full(n_terms, -1)
        many = np.flatnonzero(held >= max(BLOCK, DENSE * len(ids)))
        self.row[many] = np.arange(len(many))
        self.dense = np.zeros((len(many), self.n))
        full = self.row[term] >= 0
        self.dense[self.row[term[full]], at[full]] = weight[full]
        at, weight, term = at[~full], weight[~full], term[~full]
        order = np.lexsort((at, term))
        self.at, self.weight, term = at[order].astype(np.int32), weight[order], term[order]
        block = self.at // BLOCK
        head = np.ones(len(term), bool)
        head[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        self.run = np.concatenate([np.flatnonzero(head), [len(term)]])
        self.run_size = np.diff(self.run)
        self.run_block = block[self.run[:-1]]
        self.run_max = np.maximum.reduceat(self.weight, self.run[:-1]) if len(term) else np.zeros(0)
        self.run_first = np.searchsorted(self.run, np.searchsorted(term, np.arange(n_terms + 1)))

    def nearest(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, n_queries: int, k: int = K, but: np.ndarray | None = None):
        """By label, (query, example, cosine, votes) of each query's k nearest and of all as near as the k-th, exact.

        Queries are rows (query, term, weight), sorted; ``but``: for each query an id that is no neighbour.  Each
        neighbour has one vote; those as near as the k-th share what is left of k.  All queries open their ``FIRST``
        best blocks of either label, then all blocks whose bound is not below their k-th cosine.
        """
        full = self.row[term] >= 0
        dense = np.zeros((n_queries, len(self.dense)))
        dense[query[full], self.row[term[full]]] = weight[full]
        score = dense @ self.dense
        first = self.run_first[term]
        per = self.run_first[term + 1] - first
        runs, w, of_query = gather_spans(first, per), np.repeat(weight, per), np.repeat(query, per)
        cell = of_query * self.n_blocks + self.run_block[runs]
        bound = np.bincount(cell, w * self.run_max[runs], n_queries * self.n_blocks).reshape(n_queries, self.n_blocks).astype(float)
        bound += score.reshape(n_queries, self.n_blocks, BLOCK).max(2)
        open_ = np.zeros(bound.shape, bool)

        def evaluate(now: np.ndarray) -> None:
            mine = np.flatnonzero(now.ravel()[cell])
            size = self.run_size[runs[mine]]
            posting = gather_spans(self.run[runs[mine]], size)
            place = np.repeat(of_query[mine] * self.n, size) + self.at[posting]
            score.ravel()[:] += np.bincount(place, np.repeat(w[mine], size) * self.weight[posting], score.size)
            open_[now] = True

        def of_label(span: slice):
            here = np.where(np.repeat(open_[:, span], BLOCK, axis=1), np.round(score[:, span.start * BLOCK : span.stop * BLOCK], 12), 0)
            if but is not None:
                here[but[:, None] == self.ids[None, span.start * BLOCK : span.stop * BLOCK]] = 0
            least = np.partition(here, -k, axis=1)[:, -k] if here.shape[1] > k else np.zeros(n_queries)
            return here, least

        now = np.zeros(bound.shape, bool)
        for span in self.labels:
            best = np.argsort(-bound[:, span], axis=1, kind="stable")[:, :FIRST] + span.start
            np.put_along_axis(now, best, True, axis=1)
        evaluate(now & (bound > 0))
        now = np.zeros(bound.shape, bool)
        for span in self.labels:
            low = of_label(span)[1]
            now[:, span] = bound[:, span] >= np.maximum(low - 1e-9, 1e-12)[:, None]
        evaluate(now & ~open_)
        out = []
        for span in self.labels:
            here, least = of_label(span)
            q, e = np.nonzero((here > 0) & (here >= least[:, None]))
            cosine = here[q, e]
            last = cosine == least[q]
            ties = np.bincount(q, last, n_queries)
            left = k - np.bincount(q, ~last, n_queries)
            votes = np.where(last, left[q] / np.maximum(ties[q], 1), 1.0)
            e += span.start * BLOCK
            order = np.lexsort((self.ids[e], -cosine, q))
            out.append((q[order], e[order], cosine[order], votes[order]))
        return out


class Model:
    """Indexes of both labels' examples, the terms' frequencies and shares, and the calibration."""

    def __init__(self, vocabulary: Vocabulary, idf: np.ndarray, ids: np.ndarray, y: np.ndarray, prior: float):
        self.vocabulary, self.idf, self.prior = vocabulary, idf, prior
        self.label = dict(zip(ids.tolist(), y.tolist()))
        self.curve_x, self.curve_y = np.array([0.0, 1.0]), np.array([prior, prior])

    def vectors(self, data: np.ndarray, offsets: np.ndarray):
        """(text, term number, weight) of unit TF-IDF vectors."""
        text, term, count = self.vocabulary.counts(*terms(data, offsets))
        w = (1 + np.log(count)) * self.idf[term]
        norm = np.sqrt(np.bincount(text, w * w, len(offsets) - 1))
        # Weights are what 32 bits hold, so that the model travels small.
        return text, term, (w / norm[text]).astype(np.float32).astype(np.float64) if len(w) else w

    def __getstate__(self) -> dict:
        """The vectors alone; their index is built again where it is read."""
        return {k: v for k, v in self.__dict__.items() if k not in ("index", "held", "held_1")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        if "rows" in state:
            self.fill(*self.rows)

    def fill(self, ids: np.ndarray, y: np.ndarray, text: np.ndarray, term: np.ndarray, weight: np.ndarray) -> Model:
        self.rows = ids, y, text.astype(np.int32), term.astype(np.int32), weight.astype(np.float32)
        _, _, text, term, weight = self.rows
        weight = weight.astype(np.float64)
        n = len(self.vocabulary)
        self.share = float(y.mean())
        # An example stands for as many labelled documents as its label has for each of its examples.
        self.worth = ((1 - self.prior) / (1 - self.share), self.prior / self.share)
        held_1 = np.bincount(term[y[text] > 0], minlength=n)
        self.held_1 = held_1 * self.worth[1]
        self.held = self.held_1 + (np.bincount(term, minlength=n) - held_1) * self.worth[0]
        # One document less can raise a share, so a term may speak for documents of the sample only.
        speaking = self._lift(self.held_1, np.maximum(self.held - self.worth[0], self.held_1)) > 0
        self.index = BlockMaxIndex(ids, y, text, term, weight, speaking)
        return self

    def lift(self, term: np.ndarray, of_sample: np.ndarray, label: np.ndarray) -> np.ndarray:
        """How far the label's share among a term's examples is above its share among all, 0 to 1.

        ``of_sample``: the term is read for a document of the sample, with this label, that does not count.
        """
        own = of_sample * np.where(label > 0, self.worth[1], self.worth[0])
        return self._lift(self.held_1[term] - own * (label > 0), self.held[term] - own)

    def _lift(self, held_1: np.ndarray, held: np.ndarray) -> np.ndarray:
        share = (held_1 + PRIOR_TERM * self.prior) / (held + PRIOR_TERM)
        lift = (share - self.prior) / (1 - self.prior)
        return np.where(lift >= LEAST_LIFT, lift, 0.0)

    def votes(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, ids: list):
        """(each query's share of the likeness that goes with label 1, NaN without neighbours; neighbours by label)."""
        n = len(ids)
        mine = np.array([i in self.label for i in ids], bool)
        label = np.array([self.label.get(i, 0) for i in ids])
        but = np.array([i if ok else NO_ID for i, ok in zip(ids, mine)], np.int64)
        near = self.index.nearest(query, term, weight, n, but=but)
        likeness = sum(np.bincount(q, votes * cosine, n) for q, _, cosine, votes in near)
        q, e, _, votes = near[1]
        per = self.index.own_first[e + 1] - self.index.own_first[e]
        place = gather_spans(self.index.own_first[e], per)
        own_q, own_term = np.repeat(q, per), self.index.own_term[place]
        speaks = self.index.speaking[term]
        query, term, weight = query[speaks], term[speaks], weight[speaks]
        keys, wanted = query * len(self.vocabulary) + term, own_q * len(self.vocabulary) + own_term
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        hit = np.flatnonzero(keys[at] == wanted) if len(keys) else np.zeros(0, np.int64)
        own_q, own_term = own_q[hit], own_term[hit]
        lift = self.lift(own_term, mine[own_q], label[own_q])
        spoken = np.bincount(own_q, np.repeat(votes, per)[hit] * weight[at[hit]] * lift**2 * self.index.own_weight[place[hit]], n)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(likeness > 0, spoken / likeness, np.nan), near

    def calibrate(self, votes: np.ndarray, truth: np.ndarray) -> Model:
        """Pool adjacent violators, each example with the weight of its label in all labels; a pool gets one example's worth of the prior."""
        weight = np.where(truth > 0, self.worth[1], self.worth[0])
        pools: list[list[float]] = []
        for v, t, w in sorted(zip(votes.tolist(), truth.tolist(), weight.tolist())):
            pools.append([v, v, t * w, w])
            while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
                _, hi, s, n = pools.pop()
                pools[-1][1], pools[-1][2], pools[-1][3] = hi, pools[-1][2] + s, pools[-1][3] + n
        points = [(x, (s + self.prior) / (n + 1)) for lo, hi, s, n in pools for x in ((lo, hi) if hi > lo else (lo,))]
        if points:
            self.curve_x = np.array([p[0] for p in points])
            self.curve_y = np.maximum.accumulate(np.array([p[1] for p in points]))
        return self

    def score(self, votes: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(votes), self.prior, np.interp(votes, self.curve_x, self.curve_y))


def _vectors(model: Model, batch: pa.RecordBatch):
    for a, b, data, offsets in batch_chunks(batch):
        yield a, b, *model.vectors(data, offsets)


def learn(docs: DataFrame, labels: DataFrame, column: str, chosen, limit: int = EXAMPLES, limit_bytes: int = EXAMPLE_BYTES) -> Model | None:
    """Vocabulary, document frequencies over all of ``docs``, indexes of the examples and calibration."""
    context = docs.sparkSession.sparkContext
    sampled, totals = balanced(labels, column, chosen, limit)
    found = texts(docs, sampled).groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    examples = materialize(found, "examples")
    sizes = examples.select("doc_id", "y", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"), F.xxhash64("doc_id").alias("h")).toArrow().to_pandas()
    sizes = sizes.sort_values(["h", "doc_id"])
    kept = sizes[sizes.n.cumsum() <= limit_bytes]
    if kept.y.nunique() < 2:
        discard(examples)
        return None
    if len(kept) < len(sizes):
        examples = examples.where(F.col("doc_id").isin(kept.doc_id.tolist()))
    vocabulary = vocabulary_of(examples)
    n, df = document_frequencies(docs, vocabulary)
    ids, y = kept.doc_id.to_numpy(), kept.y.to_numpy().astype(float)
    model = Model(vocabulary, (np.log((n + 1) / (df + 1)) + 1).astype(np.float32), ids, y, totals[1] / (totals[0] + totals[1]))
    weighed = context.broadcast(model)

    def vectors(batches):
        for batch in batches:
            for a, b, text, term, weight in _vectors(weighed.value, batch):
                cuts = pa.array(np.searchsorted(text, np.arange(b - a + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(cuts, pa.array(term)), pa.ListArray.from_arrays(cuts, pa.array(weight))], ["doc_id", "terms", "weights"])

    rows = examples.select("doc_id", "text").mapInArrow(lean(vectors), "doc_id long, terms array<long>, weights array<double>").toArrow()
    order = {int(i): j for j, i in enumerate(ids)}
    at = np.array([order[i] for i in rows.column("doc_id").to_pylist()])
    lists = rows.column("terms").combine_chunks()
    text = np.repeat(at, np.asarray(lists.value_lengths()))
    model.fill(ids, y, text, np.asarray(lists.flatten()), np.asarray(rows.column("weights").combine_chunks().flatten()))
    shared = context.broadcast(model)

    def votes(batches):
        for batch in batches:
            for a, b, text, term, weight in _vectors(shared.value, batch):
                ids = batch.column(0).slice(a, b - a)
                yield pa.RecordBatch.from_arrays([ids, pa.array(shared.value.votes(text, term, weight, ids.to_pylist())[0])], ["doc_id", "vote"])

    spread = examples.select("doc_id", "text").repartition(min(len(ids), 4 * context.defaultParallelism), "doc_id")
    voted = spread.mapInArrow(lean(votes), "doc_id long, vote double").where("not isnan(vote)").toArrow()
    discard(examples)
    truth = np.array([model.label[i] for i in voted.column("doc_id").to_pylist()])
    return model.calibrate(np.asarray(voted.column("vote")), truth)


_EVIDENCE = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("label", T.IntegerType())]))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds ``score`` and ``evidence``: the neighbours' ids, cosines and labels."""
    docs = docs.drop("score", "evidence")
    if model is None:
        return docs.withColumn("score", F.lit(0.5)).withColumn("evidence", F.array().cast(_EVIDENCE))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_at = docs.columns.index("doc_id")

    def run(batches):
        model = shared.value
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
        for batch in batches:
            for a, b, text, term, weight in _vectors(model, batch):
                part = batch.slice(a, b - a)
                votes, near = model.votes(text, term, weight, part.column(id_at).to_pylist())
                scores = model.score(votes)
                q, e, cosine, label = (np.concatenate(x) for x in zip(*((q, e, c, np.full(len(q), label, np.int32)) for label, (q, e, c, _) in enumerate(near))))
                order = np.argsort(q, kind="stable")
                structs = pa.StructArray.from_arrays([pa.array(model.index.ids[e[order]]), pa.array(cosine[order]), pa.array(label[order])], ["doc_id", "cosine", "label"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(q[order], np.arange(b - a + 1)).astype(np.int32)), structs).cast(kind)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores), lists], [*batch.schema.names, "score", "evidence"])

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("evidence", _EVIDENCE)]))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, learn(docs, read(spark, sf_dir, "labels"), "toxic", remainder(5) != 0))
    # The nearest example with label 1 and the nearest without: what the score rests on.
    top = F.transform(F.array(*(F.filter("evidence", lambda e: e["label"] == label) for label in (1, 0))), lambda near: F.get(near, F.lit(0))["doc_id"])
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), top.alias("neighbours"))
