"""MinHash near-duplicate detection with fast similarity sketches.

A document's set holds the hashes of its distinct shingles of ``k`` words.  Fast similarity sketching fills the
coordinates in rounds: a round hashes each element to a bin and a value, a bin keeps the least (round, value), and
after as many rounds as bins, each further round serves one bin, so every coordinate is filled at last.  Runs of
``rows`` coordinates are band keys; documents that share one are candidates and are confirmed on their full sets.
At the default 40 bands of 5 a pair at the threshold is missed with a probability of 1e-10 (0.85) or 1e-7 (0.8).

Equal sets are one vertex.  Within a bucket no pairs are made: the vertex that meets most others represents it, all
members are compared with it, components are formed, and only buckets that still hold several components go on,
without that representative.  After ``STARS`` rounds the sets of what is left are opened once: elements that occur
in no other set of these bound the similarity of a vertex to any other, which removes most of what cannot link.
What then remains in different components of a bucket is compared, whatever its number: nothing is capped.

Defined results: a null, empty or word-less text has an empty set (0 shingles), links with nothing and is kept;
repeated rows have equal sets and share a component; rows without an id take part, name no component and are
kept only in components without an id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_WHITE, batch_chunks, discard, lean, list_array, materialize, mix64, random_table, read, shingle_hashes, signed, words
from .components import components

BANDS, ROWS = 40, 5
STARS = 2
GROUPS = 128
_SEEDS = random_table(41, 2 * BANDS * ROWS + 512)
_KEY = random_table(43, 64)


def distinct_sets(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, offsets by text."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return h[first], np.concatenate([[0], np.cumsum(np.bincount(t[first], minlength=len(offsets) - 1))])


def sketch(sets: np.ndarray, offsets: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketches of the sets, one row of ``t`` coordinates each; empty sets stay unfilled."""
    n = len(offsets) - 1
    empty = np.uint64(2**64 - 1)
    out = np.full(n * t, empty, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    element = sets
    for i in range(2 * t):
        if not len(element):
            break
        h = mix64(element ^ _SEEDS[i])
        place = (h >> np.uint64(40)) % np.uint64(t) if i < t else np.full(len(h), i - t, np.uint64)
        value = (np.uint64(i) << np.uint64(40)) | (h & np.uint64((1 << 40) - 1))
        np.minimum.at(out, owner * t + place.astype(np.int64), value)
        open_ = (out.reshape(n, t) == empty).any(1)
        live = open_[owner]
        if not live.all():
            owner, element = owner[live], element[live]
    return out.reshape(n, t)


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    part = sketches[:, : bands * rows].reshape(len(sketches), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(sketches), bands)).copy()
    for j in range(rows):
        key = mix64(key ^ (part[:, :, j] * (_KEY[j] | np.uint64(1))))
    return key


def _set_ids(sets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name a set."""
    out = []
    for salt in (np.uint64(0xA5A5A5A5), np.uint64(0xC3C3C3C3C3)):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(sets ^ salt))])
        out.append(signed(mix64(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(np.uint64))))
    return out[0], out[1]


def _sets_of(batch: pa.RecordBatch, k: int):
    for a, b, data, offsets in batch_chunks(batch):
        _, _, text, hashes = words(data, offsets, WORD_WHITE)
        yield a, b, *distinct_sets(*shingle_hashes(text, hashes, b - a, k))


def _sketched(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for a, b, sets, at in _sets_of(batch, k):
                h1, h2 = _set_ids(sets, at)
                keys = signed(band_keys(sketch(sets, at, bands * rows), bands, rows).ravel())
                full = np.diff(at) > 0
                lists = list_array(keys[np.repeat(full, bands)], np.concatenate([[0], np.cumsum(full * bands)]))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).select(["doc_id", "text_hash"]).columns, pa.array(h1), pa.array(h2), pa.array(np.diff(at)), lists], ["doc_id", "text_hash", "h1", "h2", "n", "keys"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(lean(run), "doc_id long, text_hash long, h1 long, h2 long, n long, keys array<long>")


def _full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(v, set) of the wanted vertices (v, doc): their sets from their first document's text."""
    own = docs.select("text", F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")).alias("doc"))
    joined = own.join(wanted.select("doc", "v"), "doc").select("text", "v.h1", "v.h2")

    def run(batches):
        for batch in batches:
            for a, b, sets, at in _sets_of(batch, k):
                part = batch.slice(a, b - a)
                h1, h2 = _set_ids(sets, at)
                same = pa.array((np.asarray(part.column(1)) == h1) & (np.asarray(part.column(2)) == h2))
                out = pa.RecordBatch.from_arrays([part.column(1), part.column(2), list_array(signed(sets), at)], ["h1", "h2", "set"])
                yield out.filter(same)

    found = joined.mapInArrow(lean(run), "h1 long, h2 long, set array<long>")
    return found.dropDuplicates(["h1", "h2"]).select(F.struct("h1", "h2").alias("v"), "set")


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    joined = pairs.join(sets.select(F.col("v").alias("b"), F.col("set").alias("set_b")), "b").join(sets.select(F.col("v").alias("a"), F.col("set").alias("set_a")), "a")
    inter = F.size(F.array_intersect("set_a", "set_b"))
    return joined.where(den * inter >= num * (F.size("set_a") + F.size("set_b") - inter)).select("a", "b")


def near_duplicates(docs: DataFrame, num: int = 85, den: int = 100, k: int = 5, bands: int = BANDS, rows: int = ROWS, stars: int = STARS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash, first_hash (of the component's first row); documents link at den * |A n B| >= num * |A u B|."""
    docs = docs.select("doc_id", "text")
    sketched = materialize(_sketched(docs, k, bands, rows), "sketches").withColumn("v", F.struct("h1", "h2"))
    # min() over structs would take a null id first: rows with an id come before those without.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.struct(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).alias("doc")))
    vertices = materialize(sketched.where("n > 0").groupBy("v").agg(first.alias("f"), F.first("n").alias("n"), F.first("keys").alias("keys")).select("v", "f.doc", "n", "keys"), "vertices")
    banded = vertices.select("v", "n", F.explode("keys").alias("key"))
    # A table of its own: a join with an aggregate in the same stage cannot split a hot key's rows.
    shared = materialize(banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "keys")
    paired = materialize(banded.join(shared, "key"), "members")
    degree = paired.groupBy("v").agg(F.sum("size").alias("degree"))
    members = materialize(paired.join(degree, "v").withColumn("label", F.col("v")).withColumn("own", F.col("n")), "members")
    for done in (paired, shared):
        discard(done)
    wanted = vertices.join(members.select("v").distinct(), "v", "left_semi")
    sets = materialize(_full_sets(docs.where(F.col("doc_id").isNotNull()), wanted.where("doc.id is not null"), k).unionByName(_full_sets_without_id(docs, wanted, k)), "sets")
    links = labels = None
    possible = lambda x, y: f"{den} * least({x}own, {y}own) >= {num} * ({x}n + {y}n - least({x}own, {y}own))"
    best = F.max(F.struct(F.col("own") / F.col("n"), "degree", "v", "label", "n", "own")).alias("rep")
    # First each vertex meets the best of its buckets' representatives alone, which joins most of a group at once.
    heads = members.groupBy("key").agg(best)
    nearest = members.join(heads, "key").where("v != rep.v").where(possible("", "rep.")).groupBy("v").agg(F.max("rep").alias("rep"))
    found = materialize(_linked(nearest.select(F.least("v", "rep.v").alias("a"), F.greatest("v", "rep.v").alias("b")).distinct(), sets, num, den), "links-found")
    if found.limit(1).count():
        links, labels = found, components(found)
        members = _relabel(members, labels)
    for turn in range(2 * stars + 1):
        active = members.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), best).where("lo != hi")
        now = members.join(active.select("key", "rep"), "key")
        if turn == 2 * stars:
            # A pair meets in the first key that both have, so it is made once however many buckets they share.
            held = _histograms(sets, now.select("v").distinct())
            left = materialize(now.drop("rep").join(vertices.select("v", "keys"), "v").join(held, "v"), "members")
            right = left.select("key", F.col("v").alias("b"), F.col("n").alias("m"), F.col("own").alias("mown"), F.col("label").alias("other"), F.col("keys").alias("keys_b"), F.col("held").alias("held_b"))
            met = left.join(right, "key").where("v < b and label != other").where(f"{den} * least(own, mown) >= {num} * (n + m - least(own, mown))")
            most = "aggregate(zip_with(held, held_b, (x, y) -> least(x, y)), 0, (a, x) -> a + x)"
            pairs = met.where("key = array_min(array_intersect(keys, keys_b))").where(f"({den} + {num}) * {most} >= {num} * (n + m)").select(F.col("v").alias("a"), "b")
        else:
            members = materialize(now.where("v != rep.v"), "members")
            if members.limit(1).count() == 0:
                break
            pairs = members.where("label != rep.label").where(possible("", "rep.")).select(F.least("v", F.col("rep.v")).alias("a"), F.greatest("v", F.col("rep.v")).alias("b")).distinct()
            members = members.drop("rep")
        found = materialize(_linked(pairs, sets, num, den), "links-found")
        if found.limit(1).count():
            links = found if links is None else links.union(found)
            labels = components(links, labels)
            if turn < 2 * stars:
                members = _relabel(members, labels)
        if turn == stars - 1:
            members = _with_own(members, sets, num, den)
    discard(sets)
    named = vertices.select("v", F.struct(F.col("doc.id").isNull().alias("no"), "doc").alias("f"))
    if labels is not None:
        named = named.join(labels, "v", "left").select("v", "f", F.coalesce("label", "v").alias("label"))
        named = named.join(named.groupBy("label").agg(F.min("f").alias("least")), "label").select("v", F.col("least").alias("f"))
    full = sketched.where("n > 0").join(named, "v").select("doc_id", "text_hash", "n", F.col("f.doc.id").alias("component_id"), F.col("f.doc.hash").alias("first_hash"))
    lone = sketched.where("n = 0").select("doc_id", "text_hash", "n", F.col("doc_id").alias("component_id"), F.col("text_hash").alias("first_hash"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return full.union(lone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"), "text_hash", "first_hash")


def keep_first(docs: DataFrame, num: int = 80, den: int = 100, **options) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component its first row by id and text, once; of rows without words all."""
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    wordless, docs = docs.where(~worded), docs.where(worded)
    found = near_duplicates(docs, num, den, **options)
    first = found.where(F.col("kept") & F.col("text_hash").eqNullSafe(F.col("first_hash"))).select(F.col("doc_id").alias("__id__"), F.col("text_hash").alias("__hash__")).distinct()
    hashed = docs.withColumn("__own__", F.xxhash64("text")).dropDuplicates(["doc_id", "__own__"])
    return hashed.join(first, hashed.doc_id.eqNullSafe(first["__id__"]) & (hashed["__own__"] == first["__hash__"]), "left_semi").drop("__own__").unionByName(wordless)


def _full_sets_without_id(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Sets of vertices whose documents all lack an id: found by the text's hash alone."""
    zero = F.lit(0).cast("long")
    some = wanted.where("doc.id is null").select("v", F.struct(zero.alias("id"), F.col("doc.hash").alias("hash")).alias("doc"))
    return _full_sets(docs.where("doc_id is null").withColumn("doc_id", zero), some, k)


def _relabel(members: DataFrame, labels: DataFrame) -> DataFrame:
    new = labels.withColumnRenamed("label", "new")
    return members.join(new, "v", "left").withColumn("label", F.coalesce("new", "label")).drop("new")


def _with_own(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """``own``: how many elements of a vertex's set occur in another set of the active buckets.

    The intersection with any other vertex is within these, so a vertex with fewer than num/den of its elements
    among them links with nothing more.
    """
    active = members.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("key")
    members = materialize(members.join(active, "key", "left_semi"), "members")
    # Representatives that have left their buckets have been compared already, and count no more.
    own = _common(sets, members.select("v").distinct()).groupBy("v").agg(F.count(F.lit(1)).alias("now"))
    out = members.drop("own").join(own, "v").withColumnRenamed("now", "own")
    return materialize(out.where(f"{den} * own >= {num} * n"), "members")


def _common(sets: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, x): elements of the vertices' sets that occur in more than one of these sets."""
    open_ = sets.join(vertices, "v", "left_semi").select("v", F.explode("set").alias("x"))
    common = open_.groupBy("x").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("x")
    return open_.join(common, "x")


def _histograms(sets: DataFrame, vertices: DataFrame, groups: int = GROUPS) -> DataFrame:
    """(v, held): how many common elements of a vertex fall into each of ``groups`` hash groups.

    The sum of the smaller counts of two vertices is an upper bound on their intersection, and near it where the
    groups hold few elements each.
    """
    counts = _common(sets, vertices).groupBy("v", F.pmod("x", F.lit(groups)).cast("int").alias("g")).agg(F.count(F.lit(1)).cast("int").alias("c"))
    by_group = F.map_from_entries(F.collect_list(F.struct("g", "c")))
    filled = counts.groupBy("v").agg(by_group.alias("m"))
    return filled.select("v", F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: F.coalesce(F.col("m")[g], F.lit(0))).alias("held"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d
), n AS (SELECT r, count(*) AS n FROM s GROUP BY r
), p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.r < b.r GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), reach AS (
  WITH RECURSIVE t(r, o) AS (SELECT r, r FROM d UNION SELECT t.r, z.b FROM t JOIN both_ways z ON z.a = t.o) SELECT * FROM t
)
SELECT x.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(y.doc_id) AS component_id, x.doc_id = min(y.doc_id) AS kept
FROM reach JOIN d x USING (r) JOIN d y ON y.r = reach.o LEFT JOIN n ON n.r = reach.r GROUP BY x.r, x.doc_id, n.n
"""
