"""Removal of repeated substrings by prefix-free parsing.

A byte goes if it lies in a string of ``length`` bytes that starts anywhere else too, in any text of the corpus.
The texts are parsed at triggers of a rolling hash: every window of ``length`` bytes is served by the trigger
whose 8-byte hash is least among its first ``reach`` places, which its content alone decides, so equal windows
have their triggers at the same offset.  A phrase is all that the windows of one trigger cover; the distinct
phrases with their counts are the dictionary, the triggers of a text in their order its parse.

The sorted order of all corpus suffixes is wanted only for the question whether a neighbour agrees in ``length``
bytes, so suffixes are held by equality classes instead of lexicographic ranks:

1. dictionary prefixes: windows of a trigger share the bytes after it, so a trigger whose next
   ``length - reach + 1`` bytes are unique ends here (nearly all of an unrepetitive corpus);
2. dictionary phrases: a phrase that occurs twice repeats all its windows;
3. where several different phrases share the bytes after their trigger (the ends of repeated passages), the same
   two steps follow for bands of ``BAND`` suffixes each, once for each distinct phrase, weighted by its count:
   bytes that all suffixes of a band share, then the band's whole;
4. phrase suffixes: in bands that are still open each suffix of ``length`` bytes gets its 128-bit class.

Exchanges carry fixed-size rows aggregated before the shuffle; a passage that a third of all texts hold is one row
of the dictionary a task.  Texts are only joined with their own few spans.  Classes of all steps are 128 bits wide,
from two independent polynomial hashes, and are taken as equal strings.

Defined results: a null or empty text has no bytes; texts of under ``length`` bytes lose nothing; repeated rows
repeat each other's strings and so lose all if they are long enough; rows without an id take part; an empty table
gives an empty result; other columns are carried through, but for those named hash, spans, removed and kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_chunks, discard, gather_spans, lean, materialize, mix64, read, RollingHash, signed

LENGTH = 200
GRAM = 8
BAND = 20
_ONE, _TWO = RollingHash(101), RollingHash(202)
#: Columns of classes: 128 bits each, from two independent hashes.
FOLLOW, PHRASE = ["follow", "follow2"], ["phrase", "phrase2"]
_GRAM_MIX = np.uint64(0x9E3779B97F4A7C15)
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def reach_of(length: int) -> int:
    """Places in which a window's trigger is sought: its gram and a long run after it stay inside the window."""
    return max(1, min(160, length - max(GRAM, length // 5)))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    out, w = keys, 1
    while 2 * w <= width:
        out = np.minimum(out[:-w], out[w:])
        w *= 2
    return np.minimum(out[: len(out) - (width - w)], out[width - w :]) if w < width else out


def triggers(data: np.ndarray, offsets: np.ndarray, length: int):
    """(text, trigger, first window, last window) of the triggers of a chunk, places within the chunk."""
    reach = reach_of(length)
    if len(data) < length:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    padded = np.concatenate([data, np.zeros(GRAM, np.uint8)])
    gram = np.lib.stride_tricks.sliding_window_view(padded, GRAM)[: len(data)]
    key = np.ascontiguousarray(gram).view(np.uint64).ravel()
    key = mix64(key * _GRAM_MIX) >> np.uint64(32) << np.uint64(32) | np.arange(len(data), dtype=np.uint64)
    least = _least(key, reach)
    text_of = lambda i: np.searchsorted(offsets, i, side="right") - 1
    n_windows = np.maximum(np.diff(offsets) - length + 1, 0)
    window = gather_spans(offsets[:-1], n_windows)
    if not len(window):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    at = (least[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(window)]]) - 1
    return text_of(window[first]), at[first], window[first], window[last]


def _parse(docs: DataFrame, length: int) -> DataFrame:
    """The parse: id, text hash, place (trigger, windows) and the classes of what follows and of the phrase."""
    after = length - reach_of(length) + 1

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in batch_chunks(batch):
                text, at, lo, hi = triggers(data, offsets, length)
                keys = []
                for h in (_ONE, _TWO):
                    prefix = h.prefix(data)
                    keys.append((h.spans(prefix, at, at + after), mix64(h.spans(prefix, lo, hi + length) ^ ((at - lo) * 512 + hi - lo).astype(np.uint64))))
                place = (at - offsets[text]) << 16 | (at - lo) << 8 | (hi - lo)
                part = batch.slice(a, b - a)
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(place), *(pa.array(signed(k)) for pair in zip(*keys) for k in pair)], ["doc_id", "hash", "place", *FOLLOW, *PHRASE])

    return docs.select("doc_id", "hash", "text").mapInArrow(lean(run), "doc_id long, hash long, place long, follow long, follow2 long, phrase long, phrase2 long")


def _opened(batch: pa.RecordBatch):
    """Chunks of texts with the phrases listed with them: (rows, bytes, offsets, row, trigger, first window, windows, weight)."""
    lists = batch.column(3)
    for a, b, data, offsets in batch_chunks(batch):
        part = lists.slice(a, b - a)
        flat = part.flatten()
        place, weight = np.asarray(flat.field(0)), np.asarray(flat.field(1))
        row = np.repeat(np.arange(b - a), np.asarray(part.value_lengths().fill_null(0)))
        at = offsets[row] + (place >> 16)
        yield batch.slice(a, b - a), data, offsets, row, at, at - (place >> 8 & 255), (place & 255) + 1, weight


def _bands(texts: DataFrame, length: int, band: int) -> DataFrame:
    """The listed phrases again, cut into bands of windows at multiples of ``band`` from their trigger."""

    def run(batches):
        for batch in batches:
            for own, data, offsets, row, at, lo, count, weight in _opened(batch):
                far, near = (at - lo) // band, (at - (lo + count - 1)) // band  # a window's distance is at - window
                per = far - near + 1
                source = np.repeat(np.arange(len(row)), per)
                number = gather_spans(near, per)
                t, rows = at[source], row[source]
                first = np.maximum(lo[source], t - (number + 1) * band + 1)
                last = np.minimum(lo[source] + count[source] - 1, t - number * band)
                keys = []
                for h in (_ONE, _TWO):
                    prefix = h.prefix(data)
                    core = mix64(h.spans(prefix, t - number * band, t - (number + 1) * band + 1 + length) + number.astype(np.uint64))
                    keys.append((core, mix64(h.spans(prefix, first, last + length) ^ ((t - first) * 512 + last - first).astype(np.uint64))))
                place = (t - offsets[rows]) << 16 | (t - first) << 8 | (last - first)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0).take(take), own.column(1).take(take), pa.array(place), *(pa.array(signed(k)) for pair in zip(*keys) for k in pair), pa.array(weight[source])],
                    ["doc_id", "hash", "place", *FOLLOW, *PHRASE, "weight"],
                )

    return texts.select("doc_id", "hash", "text", "phrases").mapInArrow(lean(run), "doc_id long, hash long, place long, follow long, follow2 long, phrase long, phrase2 long, weight long")


def _suffixes(texts: DataFrame, length: int) -> DataFrame:
    """Class and weight of each window of the phrases listed with each text."""

    def run(batches):
        for batch in batches:
            for own, data, offsets, row, _, lo, count, weight in _opened(batch):
                start = gather_spans(lo, count)
                rows = np.repeat(row, count)
                c1, c2 = (signed(h.spans(h.prefix(data), start, start + length)) for h in (_ONE, _TWO))
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0).take(take), own.column(1).take(take), pa.array((start - offsets[rows]).astype(np.int32)), pa.array(c1), pa.array(c2), pa.array(np.repeat(weight, count))],
                    ["doc_id", "hash", "start", "c1", "c2", "weight"],
                )

    return texts.select("doc_id", "hash", "text", "phrases").mapInArrow(lean(run), "doc_id long, hash long, start int, c1 long, c2 long, weight long")


def _refine(parse: DataFrame, length: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(spans of phrases that occur again, phrases still open by text) of a level of the parse; deletes ``parse``.

    Rows of weight over 1 stand for phrases whose places are known to be repeated already.
    """
    ends = (f(c).alias(f"{f.__name__}_{c}") for c in PHRASE for f in (F.min, F.max))
    shared = parse.groupBy(*FOLLOW).agg(F.sum("weight").alias("n"), *ends).where("n > 1")
    # A table of its own: a join with an aggregate in the same stage cannot split a hot key's rows.
    differs = (F.col("min_phrase") != F.col("max_phrase")) | (F.col("min_phrase2") != F.col("max_phrase2"))
    shared = materialize(shared.select(*FOLLOW, differs.alias("several")), f"{name}-follow")
    alive = materialize(parse.join(shared, FOLLOW), f"{name}-shared")
    discard(parse)
    several, key = alive.where("several"), [*FOLLOW, *PHRASE]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "hash", "place")).alias("first")
    dictionary = materialize(several.groupBy(*key).agg(F.sum("weight").alias("n"), first), f"{name}-dictionary")
    # Every open phrase gets its mark, repeated or not, and the marks are written once for all that read them.
    marked = materialize(several.join(dictionary.select(*key, (F.col("n") > 1).alias("again")), key, "left"), f"{name}-marked")
    spot = alive.where("not several").unionByName(marked.where("again").select(alive.columns)).where("weight = 1")
    start = (F.shiftright("place", 16) - F.shiftright("place", 8).bitwiseAND(255)).cast("int")
    span = F.struct(start.alias("start"), (start + F.col("place").bitwiseAND(255) + length).cast("int").alias("end"))
    spans = materialize(spot.select("doc_id", "hash", span.alias("span")), f"{name}-spans")
    for done in (alive, marked, shared):
        discard(done)
    listed = dictionary.select("first.doc_id", "first.hash", F.struct("first.place", "n").alias("phrase")).groupBy("doc_id", "hash").agg(F.collect_list("phrase").alias("phrases"))
    return spans, listed


def repeated_spans(docs: DataFrame, length: int = LENGTH, band: int = BAND) -> DataFrame:
    """(doc_id, hash, spans): the repeated byte spans of each text that has any, not yet merged."""
    band = max(1, min(band, reach_of(length)))
    parse = materialize(_parse(docs, length).withColumn("weight", F.lit(1).cast("long")), "parse")
    whole, listed = _refine(parse, length, "parse")
    texts = materialize(_with_texts(docs, listed).dropDuplicates(["doc_id", "hash"]), "open-texts")
    bands = materialize(_bands(texts, length, band), "bands")
    banded, open_ = _refine(bands, length, "bands")
    suffixes = materialize(_suffixes(_with_texts(texts.drop("phrases"), open_), length), "suffixes")
    discard(texts)
    again = suffixes.groupBy("c1", "c2").agg(F.sum("weight").alias("n")).where("n > 1").select("c1", "c2")
    part = suffixes.where("weight = 1").join(again, ["c1", "c2"]).select("doc_id", "hash", F.struct("start", (F.col("start") + length).alias("end")).alias("span"))
    return whole.union(banded).union(part).groupBy("doc_id", "hash").agg(F.array_sort(F.collect_set("span")).alias("spans"))


def _with_texts(docs: DataFrame, lists: DataFrame, how: str = "inner") -> DataFrame:
    right = lists.withColumnsRenamed({"doc_id": "__id__", "hash": "__hash__"})
    return docs.join(right, docs.doc_id.eqNullSafe(right["__id__"]) & (docs.hash == right["__hash__"]), how).drop("__id__", "__hash__")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _back(text: bytes, at: int) -> int:
    while at > 0 and text[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _forth(text: bytes, at: int) -> int:
    while at < len(text) and text[at] & 0xC0 == 0x80:
        at += 1
    return at


def cut(docs: DataFrame, spans: DataFrame, whole_characters: bool = False) -> DataFrame:
    """All rows of ``docs`` with ``removed`` (merged byte spans) and ``kept`` (the other bytes).

    ``whole_characters``: spans grow to the bounds of the characters that they cut, so ``kept`` is UTF-8.
    """
    joined = _with_texts(docs, spans, "left")
    names = joined.columns
    text_at, spans_at = names.index("text"), names.index("spans")
    schema = T.StructType([*(f for f in joined.schema.fields if f.name != "spans"), T.StructField("removed", SPANS), T.StructField("kept", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in batch_chunks(batch):
                part = batch.slice(a, b - a)
                removed, kept = [], []
                raw = data.tobytes()
                listed = part.column(spans_at)
                for i in range(b - a):
                    text = raw[offsets[i] : offsets[i + 1]]
                    row = listed[i].values if listed[i].is_valid else None
                    if row is None:
                        removed.append([])
                        kept.append(text)
                        continue
                    gone = merged(list(zip(row.field(0).to_pylist(), row.field(1).to_pylist())))
                    if whole_characters:
                        gone = merged([(_back(text, x), _forth(text, y)) for x, y in gone])
                    at, pieces = 0, []
                    for x, y in gone:
                        pieces.append(text[at:x])
                        at = y
                    removed.append([{"start": x, "end": y} for x, y in gone])
                    kept.append(b"".join([*pieces, text[at:]]))
                columns = [c for j, c in enumerate(part.columns) if j != spans_at]
                spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, spans_type), pa.array(kept, pa.binary())], schema.names)

    assert text_at >= 0
    return joined.mapInArrow(lean(run), schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH, whole_characters: bool = False) -> DataFrame:
    """Columns of ``docs`` with removed (byte spans) and kept (remaining bytes, binary)."""
    taken = docs.drop("hash", "spans", "removed", "kept").withColumn("hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    return cut(taken, repeated_spans(taken.select("doc_id", "hash", "text"), length), whole_characters).drop("hash")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    n_bytes = F.octet_length(F.coalesce("text", F.lit("")))
    return done.select(
        "doc_id",
        n_bytes.cast("long").alias("n_bytes"),
        (n_bytes - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


OP6_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (SELECT r, unnest(range(0, len(h) // 2 - 199)) AS i, h FROM d WHERE len(h) >= 400
), k AS (SELECT r, i, md5_number(substr(h, 2 * i + 1, 400)) AS k FROM w
), again AS (SELECT k FROM k GROUP BY k HAVING count(*) > 1
), hit AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS gap FROM k WHERE k IN (SELECT k FROM again)
), runs AS (SELECT r, i, sum(CASE WHEN gap IS NULL OR gap > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS g FROM hit
), spans AS (SELECT r, g, min(i) AS a, max(i) + 200 AS b FROM runs GROUP BY r, g
), kept AS (
  SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS p FROM spans
), cut AS (SELECT d.r, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS k FROM kept JOIN d USING (r) GROUP BY d.r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""
