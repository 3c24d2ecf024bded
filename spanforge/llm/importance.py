"""Importance resampling towards a target distribution, over hashed runs of words.

Two passes over whole texts in Arrow batches.  The first hashes every run of 1 to ``runs`` words to a bucket, each
task adds up one vector of counts (``numpy.bincount``), and ``treeReduce`` merges the vectors of all tasks; the same
pass over the target's texts gives its counts.  The driver turns the two vectors into one gain a bucket and sends
them, one number a bucket whatever the size of the corpus.  The second pass gathers the gains of a document's runs
and sums them with ``bincount``'s weights.  What follows works on one short row a document: a Gumbel number of the
document's id is added, and the rows are ranked by one range exchange: the order inside a range comes from its sort,
the ranges' counts give the rest, so no task holds more than its range.

A bucket is the CRC-32 of the run's bytes, modulo their number.  CRC-32 is linear, so the checksum of words that
follow each other comes from those of the words: four look-ups shift a checksum past the next word.

Defined results: a null text, or one without words, has no runs and weight 0; documents of fewer than ``least_words``
words are never drawn; a null id counts as an empty text in the Gumbel number and comes last among equal scores;
repeated rows are drawn each on its own, of one score and id by weight, then number of runs; without any target
words, or without documents, gains come from zero counts; a very long text is worked on in pieces of a megabyte;
other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, LOWER, WORD_ALNUM, batch_chunks, discard, lean, materialize, partitions, read

BUCKETS = 10_000
RUNS = 3
#: Words up to this length are checksummed together, column by column, and shifted past by one table.
SHORT = 64
U32 = np.uint32


def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=U32)
    for _ in range(8):
        x = np.where(x & U32(1), (x >> U32(1)) ^ U32(0xEDB88320), x >> U32(1)).astype(U32)
    return x


_CRC = _crc_table()


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by the images of each byte at each of the four places."""
    return tables[0, x & U32(255)] ^ tables[1, (x >> U32(8)) & U32(255)] ^ tables[2, (x >> U32(16)) & U32(255)] ^ tables[3, x >> U32(24)]


def _shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """Maps past 0 to SHORT + 1 bytes, and past 1, 2, 4 ... 2**39 bytes."""
    same = np.stack([np.arange(256, dtype=U32) << U32(8 * k) for k in range(4)])
    near = [same]
    for _ in range(SHORT + 1):
        near.append(_CRC[near[-1] & U32(255)] ^ (near[-1] >> U32(8)))
    far = [near[1]]
    for _ in range(39):
        far.append(_apply(far[-1], far[-1]))
    return np.stack(near), np.stack(far)


_NEAR, _FAR = _shift_tables()
_NEAR_FLAT = _NEAR.reshape(-1)


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What checksums contribute once ``length`` more bytes have followed."""
    at = np.minimum(length, SHORT + 1) << 10
    out = _NEAR_FLAT[at + (crc & U32(255))] ^ _NEAR_FLAT[at + 256 + ((crc >> U32(8)) & U32(255))] ^ _NEAR_FLAT[at + 512 + ((crc >> U32(16)) & U32(255))] ^ _NEAR_FLAT[at + 768 + (crc >> U32(24))]
    for i in np.flatnonzero(length > SHORT + 1):
        x, rest = crc[i : i + 1], int(length[i])
        for b in range(rest.bit_length()):
            if rest >> b & 1:
                x = _apply(_FAR[b], x)
        out[i] = x[0]
    return out


def word_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of ``data``."""
    length = end - start
    order = np.argsort(-length, kind="stable")
    order = order[int((length > SHORT).sum()) :]
    at, size = start[order], length[order]
    crc = np.full(len(order), 0xFFFFFFFF, U32)
    for j in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -j, side="left"))
        crc[:n] = _CRC[(crc[:n] ^ data[at[:n] + j]) & U32(255)] ^ (crc[:n] >> U32(8))
    out = np.empty(len(start), U32)
    out[order] = ~crc
    for i in np.flatnonzero(length > SHORT):
        out[i] = zlib.crc32(data[start[i] : end[i]])
    return out


_SPACE = np.array([zlib.crc32(b" ")], U32)


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the words of a chunk."""
    inside = WORD_ALNUM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, side="right") - 1


def _pieces(data: np.ndarray, limit: int):
    """Ranges of a text, cut between words, of about ``limit`` bytes; a word is never cut."""
    a = 0
    while a < len(data):
        b = min(a + limit, len(data))
        while b < len(data) and WORD_ALNUM[data[b]]:
            white = np.flatnonzero(~WORD_ALNUM[data[b : b + limit]])
            b = b + int(white[0]) if len(white) else min(b + limit, len(data))
        yield a, b
        a = b


def hashed_runs(data: np.ndarray, offsets: np.ndarray, runs: int = RUNS, buckets: int = BUCKETS, limit: int = CHUNK_BYTES):
    """(text of each word, [(text, bucket) of each run of 1 word, of 2 ...]), in pieces of a chunk."""
    whole = [(0, len(data))] if len(offsets) != 2 else _pieces(data, limit)
    crc = size = np.zeros(0, np.int64)
    for a, b in whole:
        low = LOWER[data[a:b]]
        start, end, text = _spans(low, offsets if len(offsets) != 2 else np.array([0, b - a]))
        # The last words of the piece before go on into the first runs of this one.
        old = len(crc)
        crc, size = np.concatenate([crc.astype(U32), word_crcs(low, start, end)]), np.concatenate([size, end - start])
        of = np.concatenate([np.zeros(old, np.int64), text])
        spaced = shifted(np.broadcast_to(_SPACE, len(crc)), size) ^ crc
        found, run = [], crc
        for k in range(1, runs + 1):
            if k > 1:
                run = shifted(run[:-1], 1 + size[k - 1 :]) ^ spaced[k - 1 :]
            last = np.arange(k - 1, len(crc))
            ok = (last >= old) & (of[last] == of[last - k + 1])
            found.append((of[last[ok]], (run[ok] % U32(buckets)).astype(np.int64)))
        yield text, found
        keep = max(0, len(crc) - runs + 1)
        crc, size = crc[keep:], size[keep:]


def bucket_counts(texts: DataFrame, runs: int = RUNS, buckets: int = BUCKETS) -> np.ndarray:
    """How many runs of all texts fall into each bucket: one vector a task, merged in a tree."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in batch_chunks(batch):
                for _, found in hashed_runs(data, offsets, runs, buckets):
                    for _, bucket in found:
                        total += np.bincount(bucket, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["counts"])

    vectors = texts.select("text").mapInArrow(lean(run), "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    return vectors.treeReduce(np.add) if vectors.getNumPartitions() else np.zeros(buckets, np.int64)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm by which a run of each bucket is likelier in the target, with one more of each bucket counted."""
    s_all, t_all, n = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, runs: int = RUNS) -> DataFrame:
    """doc_id, n_words, n_features, weight: the gains of all runs of a document, added up."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        by_bucket = shared.value
        for batch in batches:
            for a, b, data, offsets in batch_chunks(batch):
                n = b - a
                n_words, n_features, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
                for text, found in hashed_runs(data, offsets, runs, len(by_bucket)):
                    n_words += np.bincount(text, minlength=n)
                    for of, bucket in found:
                        n_features += np.bincount(of, minlength=n)
                        weight += np.bincount(of, weights=by_bucket[bucket], minlength=n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), pa.array(n_words), pa.array(n_features), pa.array(weight.astype(np.int64))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id, seed: int = 42):
    """Thousandths of the Gumbel number that belongs to an id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, num: int = 5, den: int = 100, least_words: int = 20, runs: int = RUNS, buckets: int = BUCKETS, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score, rank: of N documents long enough, floor(num * N / den) are drawn, in the order of their ranks."""
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, runs, buckets), bucket_counts(target, runs, buckets))
    # Written once: the range exchange looks at its input twice, and the texts shall not be read again for that.
    weighed = materialize(weigh(docs, gain, runs), "weights")
    scored = weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("enough", F.col("n_words") >= least_words)
    order = [F.desc("enough"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("weight"), F.asc("n_features"), F.asc("tie")]
    dealt = scored.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    # The id that is given after the sort holds the range in its upper bits, the place inside the range in its lower 33.
    placed = materialize(dealt.select("doc_id", "n_features", "weight", "score", "enough", F.monotonically_increasing_id().alias("place")), "ranks")
    discard(weighed)
    part, nth = F.shiftrightunsigned("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.count_if("enough").alias("enough_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.expr(f"{num} * sum(enough_rows) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) div {den}").alias("drawn"))
    # One row a range, and the number of ranges is a setting: a bounded broadcast.
    ranked = placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("at", F.col("rows_before") + nth + 1)
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("at") <= F.col("drawn"), F.col("at")).alias("rank"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH bits AS (
  SELECT list(crc ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END, i) AS crc FROM (SELECT unnest(range(256)) AS i))
), texts AS (
  SELECT row_number() OVER () AS r, doc_id, text, true AS own FROM documents UNION ALL SELECT row_number() OVER (), NULL, text, false FROM benchmark
), w AS (
  SELECT r, doc_id, own, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), f AS (
  SELECT r, own, unnest(w) AS g FROM w
  UNION ALL SELECT r, own, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
  UNION ALL SELECT r, own, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w
), g AS (SELECT DISTINCT g, hex(encode(g)) AS h FROM f
), b AS (
  SELECT g, xor(4294967295, list_reduce(list_transform(range(1, len(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8), CAST(4294967295 AS BIGINT))) % 10000 AS b FROM g, bits
), c AS (SELECT b, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM f JOIN b USING (g) GROUP BY b
), n AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM c
), gain AS (SELECT c.b, CAST(floor(1000 * ln(CAST(c.t + 1 AS DOUBLE) * CAST(n.s + 10000 AS DOUBLE) / (CAST(c.s + 1 AS DOUBLE) * CAST(n.t + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM c, n
), weights AS (SELECT r, count(*) AS n_features, sum(gain) AS weight FROM f JOIN b USING (g) JOIN gain USING (b) WHERE own GROUP BY r
), d AS (
  SELECT w.r, w.doc_id, len(w.w) >= 20 AS enough, coalesce(x.n_features, 0) AS n_features, coalesce(x.weight, 0) AS weight,
    coalesce(x.weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(w.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM w LEFT JOIN weights x USING (r) WHERE w.own
), o AS (SELECT *, row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id NULLS LAST, weight, n_features) AS n, 5 * count(*) FILTER (enough) OVER () // 100 AS k FROM d)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN enough AND n <= k THEN CAST(n AS BIGINT) END AS rank FROM o
"""
