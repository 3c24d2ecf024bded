"""Benchmark decontamination with a generalised suffix automaton of the items' words.

The items' word sequences go into one suffix automaton (the benchmark is read in blocks of ``BLOCK_WORDS`` words, one
automaton a block, held in flat arrays of about 100 bytes a word, so what is broadcast is bounded; an item is never
split).  Document words stream through it with the longest matching
length; each word inside an occurrence of a window (``window`` consecutive item words, or a whole shorter item) is
hit.  Only stretches whose words and neighbouring pairs all occur in the items are fed to the automaton: no match
of two words or more can lie elsewhere, so nothing is lost, and the vectorised look-ups pass over most of the text.

Defined results: a null or empty text has no words and no hit; null, empty or word-less items have no window;
rows of an item id count as one item; an item whose id is null hits words but is not listed; repeated documents
repeat their result; an empty benchmark hits nothing; an empty table gives an empty result; other columns of
the documents are carried through, and those of the names of output columns are replaced.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_ALNUM, batch_chunks, lean, read, words

WINDOW = 10
BLOCK_WORDS = 200_000


class SuffixAutomaton:
    """All substrings of the items' word sequences; each state knows the windows that end in it."""

    def __init__(self, items: list[tuple[str | None, np.ndarray]], window: int = WINDOW):
        self.window = window
        self.names = sorted({name for name, _ in items if name is not None})
        number = {name: i for i, name in enumerate(self.names)}
        self.vocabulary = np.unique(np.concatenate([h for _, h in items])) if items else np.zeros(0, np.uint64)
        codes = [np.searchsorted(self.vocabulary, h).tolist() for _, h in items]
        self.base = len(self.vocabulary)
        pairs = [np.array(c[:-1], np.int64) * self.base + np.array(c[1:], np.int64) for c in codes if len(c) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.shortest = min([window, *(len(c) for c in codes if c)])
        self.next, self.link, self.length = [{}], [-1], [0]
        for c in codes:
            last = 0
            for x in c:
                last = self._extend(last, x)
        self._freeze()
        #: (state, window length, number of the item that has it); -1 for an item without a name
        found = {(state, m, -1 if name is None else number[name]) for (name, _), c in zip(items, codes) for m, state in self._windows(c)}
        rows = np.array(sorted(found), np.int64).reshape(-1, 3)
        self.end_state, at = (array("q", x.tolist()) for x in np.unique(rows[:, 0], return_index=True))
        self.end_first, self.end_length, self.end_item = (array("i", x) for x in ([*at, len(rows)], rows[:, 1].tolist(), rows[:, 2].tolist()))
        # From each state the nearest one on its way of suffix links, itself included, in which a window ends.
        self.hop = array("i", [0]) * len(self.link)
        ending = set(self.end_state)
        for state in np.argsort(np.array(self.length), kind="stable").tolist():
            self.hop[state] = state if state in ending else self.hop[self.link[state]] if state else 0

    def _freeze(self) -> None:
        """The transitions as sorted keys (state, word) and their targets."""
        keys = np.array([s * self.base + x for s, out in enumerate(self.next) for x in out], np.int64)
        order = np.argsort(keys)
        self.keys = array("q", keys[order].tolist())
        self.targets = array("i", np.array([t for out in self.next for t in out.values()], np.int64)[order].tolist())
        self.link, self.length = array("i", self.link), array("i", self.length)
        del self.next

    def _target(self, state: int, x: int) -> int:
        key = state * self.base + x
        at = bisect_left(self.keys, key)
        return self.targets[at] if at < len(self.keys) and self.keys[at] == key else -1

    def _extend(self, last: int, x: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if x in nxt[last]:
            q = nxt[last][x]
            return q if length[q] == length[last] + 1 else self._clone(last, x, q)
        cur = len(nxt)
        nxt.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p >= 0 and x not in nxt[p]:
            nxt[p][x] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][x]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, x, q)
        return cur

    def _clone(self, p: int, x: int, q: int) -> int:
        nxt, link = self.next, self.link
        new = len(nxt)
        nxt.append(dict(nxt[q])), link.append(link[q]), self.length.append(self.length[p] + 1)
        while p >= 0 and nxt[p].get(x) == q:
            nxt[p][x] = new
            p = link[p]
        link[q] = new
        return new

    def _windows(self, codes: list[int]):
        """(length, state) of each window of an item."""
        if not codes:
            return
        m, state, length = min(self.window, len(codes)), 0, 0
        for x in codes:
            state, length = self.step(state, length, x)
            while length > m and self.length[self.link[state]] >= m:
                state = self.link[state]
                length = self.length[state]
            if length >= m:
                yield m, state

    def step(self, state: int, length: int, x: int) -> tuple[int, int]:
        while (to := self._target(state, x)) < 0 and state:
            state = self.link[state]
            length = self.length[state]
        return (to, length + 1) if to >= 0 else (0, 0)

    def stream(self, codes: list[int]):
        """(place, window length, item number) of each window that ends at a place of the word sequence."""
        state = length = 0
        for i, x in enumerate(codes):
            state, length = self.step(state, length, x)
            s = self.hop[state]
            while s:
                at = bisect_left(self.end_state, s)
                for j in range(self.end_first[at], self.end_first[at + 1]):
                    if self.end_length[j] <= length:
                        yield i, self.end_length[j], self.end_item[j]
                s = self.hop[self.link[s]]

    def match(self, text: np.ndarray, hashes: np.ndarray):
        """(hit words, {text: item numbers}) of the words of a chunk of texts."""
        hit = np.zeros(len(hashes), bool)
        found: dict[int, set[int]] = {}
        if not self.base or not len(hashes):
            return hit, found
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), self.base - 1)
        known = self.vocabulary[at] == hashes
        joined = np.zeros(len(hashes), bool)  # with the word before
        both = np.flatnonzero(known[1:] & known[:-1] & (text[1:] == text[:-1]))
        if len(self.pairs) and len(both):
            key = at[both] * self.base + at[both + 1]
            p = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            joined[both[self.pairs[p] == key] + 1] = True
        begin = np.flatnonzero(known & ~joined)
        follows = np.concatenate([joined[1:], [False]])
        end = np.flatnonzero(known & ~follows) + 1
        for a, b in zip(begin.tolist(), end.tolist()):
            if b - a >= self.shortest:
                for i, m, item in self.stream(at[a:b].tolist()):
                    hit[a + i - m + 1 : a + i + 1] = True
                    if item >= 0:
                        found.setdefault(int(text[a]), set()).add(item)
        return hit, found


def item_words(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return words(raw, np.array([0, len(raw)]), WORD_ALNUM)[3]


def automata(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS):
    """One automaton for each block of items; an item is never split."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        h = item_words(row[1])
        if len(h):
            if size and size + len(h) > block_words:
                yield SuffixAutomaton(block, window)
                block, size = [], 0
            block.append((row[0], h))
            size += len(h)
    yield SuffixAutomaton(block, window)


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_OUT = [T.StructField("n_words", T.LongType()), T.StructField("hits", _SPAN), T.StructField("items", T.ArrayType(T.StringType()))]


def _against(docs: DataFrame, automaton: SuffixAutomaton) -> DataFrame:
    """Adds n_words, hits (spans of word numbers) and items."""
    docs = docs.drop(*(f.name for f in _OUT))
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches):
        sam = shared.value
        for batch in batches:
            for a, b, data, offsets in batch_chunks(batch):
                _, _, text, hashes = words(data, offsets, WORD_ALNUM)
                counts = np.bincount(text, minlength=b - a)
                first = np.concatenate([[0], np.cumsum(counts)])
                hit, found = sam.match(text, hashes)
                edge = np.zeros(len(hit) + 1, bool)
                edge[first] = True
                on = np.flatnonzero(hit & ~(np.concatenate([[False], hit[:-1]]) & ~edge[:-1]))
                off = np.flatnonzero(hit & ~(np.concatenate([hit[1:], [False]]) & ~edge[1:])) + 1
                where = np.searchsorted(first, on, side="right") - 1
                spans = pa.StructArray.from_arrays([pa.array((x - first[where]).astype(np.int32)) for x in (on, off)], ["start", "end"])
                at = np.concatenate([[0], np.cumsum(np.bincount(where, minlength=b - a))]).astype(np.int32)
                items = [[sam.names[i] for i in sorted(found.get(i, ()))] for i in range(b - a)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(a, b - a).columns, pa.array(counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(at), spans), pa.array(items, pa.list_(pa.string()))],
                    [*batch.schema.names, *(f.name for f in _OUT)],
                )

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, *_OUT]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Adds n_words, n_hit, hits (merged spans of word numbers), items (ids as strings, sorted)."""
    out = None
    for automaton in automata(benchmark, window, block_words):
        if out is None:
            out = _against(docs, automaton)
        else:
            more = _against(out.withColumnsRenamed({"hits": "_hits", "items": "_items"}), automaton)
            joined = F.array_sort(F.concat("_hits", "hits"))
            merge = F.aggregate(
                joined,
                F.slice(joined, 1, 0),
                lambda acc, s: F.when(
                    (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
                    F.concat(
                        F.slice(acc, 1, F.size(acc) - 1),
                        F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))),
                    ),
                ).otherwise(F.concat(acc, F.array(s))),
            )
            out = more.withColumn("hits", merge).withColumn("items", F.array_sort(F.array_union("_items", "items"))).drop("_hits", "_items")
    n_hit = F.aggregate("hits", F.lit(0), lambda acc, s: acc + s["end"] - s["start"]).cast("long")
    return out.withColumn("n_hit", n_hit)


def remove_hits(found: DataFrame, max_coverage: float = 0.5, max_span: int | None = None) -> DataFrame:
    """Cuts the hit spans out of ``text`` and drops documents beyond the limits.

    A document whose hit words are more than ``max_coverage`` of its words, or that has a hit span of more than
    ``max_span`` words, goes; from the others the bytes from the first hit word's start to the end of the last
    one's are cut, each span on its own, and all other bytes stay as they are.
    """
    spark_fields = found.schema.fields
    index = {f.name: i for i, f in enumerate(spark_fields)}
    kept = found.where(F.coalesce(F.col("n_hit") <= max_coverage * F.col("n_words"), F.lit(True)))
    if max_span is not None:
        kept = kept.where(~F.exists("hits", lambda s: s["end"] - s["start"] > max_span))

    def run(batches):
        for batch in batches:
            hits = batch.column(index["hits"])
            if not len(hits.flatten()):
                yield batch
                continue
            texts = batch.column(index["text"]).to_pylist()
            for i, spans in enumerate(hits.to_pylist()):
                if spans:
                    raw = texts[i].encode()
                    start, end, _, _ = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), WORD_ALNUM)
                    at, parts = 0, []
                    for s in spans:
                        parts.append(raw[at : start[s["start"]]])
                        at = end[s["end"] - 1]
                    texts[i] = b"".join([*parts, raw[at:]]).decode()
            columns = list(batch.columns)
            columns[index["text"]] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return kept.mapInArrow(lean(run), found.schema)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP9_SQL = r"""
WITH item_words AS (
  SELECT item_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, len(g) AS m, array_to_string(g, ' ') AS g FROM (
    SELECT item_id, unnest(CASE WHEN len(w) < 10 THEN [w] ELSE list_transform(range(1, len(w) - 8), lambda i: w[i:i + 9]) END) AS g
    FROM item_words WHERE len(w) > 0)
), doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w,
    row_number() OVER () AS r FROM documents
), sizes AS (SELECT DISTINCT m FROM windows), grams AS (
  SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM (
    SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc_words, sizes WHERE len(w) >= m)
), found AS (SELECT DISTINCT r, i, m, item_id FROM grams JOIN windows USING (m, g)
), hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM found) GROUP BY r
), items AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""
