"""SimHash near-duplicate detection: fingerprints of 64 bits, linked at a small Hamming distance by tiled comparison.

A bit of a fingerprint is set if it is set in over half the XXH64 hashes of the text's shingles, repeats counted.
Equal fingerprints are one vertex, so copies never meet each other.  Tiles of fingerprints are compared whole, with
numpy's exclusive or and bit counts, and two tiles are skipped where their population counts differ by more than the
radius: a bit that differs moves the count by one at most.

Comparing every tile with every other would take time in the square of the corpus, so tiles are formed inside
buckets.  The 64 bits are cut into radius + 1 blocks; two fingerprints within the radius agree in one block at least,
so a bucket for each block and value keeps every link.  Where buckets of one level would on average hold more than a
tile, the other bits are cut once more in the same way inside each bucket.  No bucket is a group of one task: one
that holds more than a tile is dealt into tiles by population count and hash, and pairs of its tiles whose counts are
close enough are tasks of their own.  A pair of tiles gives no list of pairs but, for each fingerprint that met
another, the least fingerprint that it reaches inside the pair.

Defined results: a null, empty or word-less text has fingerprint zero and is linked like any other; fewer words than
a shingle make one shingle; repeated rows share a component; rows without an id take part and name no component (null
where a component has no id at all); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import CHUNK_BYTES, LOWER, WORD_WHITE, batch_chunks, discard, gather_spans, lean, materialize, partitions, read, signed
from .components import components

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Fingerprints of a tile of the comparison, and of a tile that a task is given.
TILE, DEALT = 256, 4096


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the words of a chunk."""
    inside = WORD_WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, side="right") - 1


def shingle_digests(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, text) in the order of the texts: words lower-cased and joined by one space."""
    start, end, text = word_spans(data, offsets)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # All words with one space behind each: a shingle is then a slice, whatever stood between its words.
    size = end - start + 1
    joined = LOWER[data[np.minimum(gather_spans(start, size), len(data) - 1)]]
    to = np.cumsum(size)
    joined[to - 1] = 0x20
    words = np.bincount(text, minlength=len(offsets) - 1)
    first = np.cumsum(words) - words
    n = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    head = gather_spans(first, n)
    of = np.repeat(np.arange(len(n)), n)
    tail = np.minimum(head + k, first[of] + words[of]) - 1
    raw, digest = joined.tobytes(), xxh64_intdigest
    hashes = [digest(raw[a:b], seed) for a, b in zip((to - size)[head].tolist(), (to[tail] - 1).tolist())]
    return np.array(hashes, np.uint64), of


def bit_counts(hashes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """How many of a text's hashes have each bit set, a row a text; bit i of a hash is column i."""
    out = np.zeros((n, 64), np.int64)
    at = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))])
    # Runs of up to 255 hashes are added up in bytes.
    starts = np.concatenate([np.arange(a, b, 255) for a, b in zip(at[:-1], at[1:])]) if len(hashes) else np.zeros(0, np.int64)
    if len(starts):
        bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        np.add.at(out, of[starts], np.add.reduceat(bits, starts, axis=0, dtype=np.uint8))
    return out


def fingerprints(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, number of shingles) of each text of a chunk."""
    hashes, of = shingle_digests(data, offsets, k, seed)
    n = np.bincount(of, minlength=len(offsets) - 1)
    bits = 2 * bit_counts(hashes, of, len(n)) > n[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel(), n


def _pieces(data: np.ndarray, limit: int, k: int):
    """A long text in pieces that overlap by k - 1 words, so that every shingle is in one piece."""
    a = 0
    while True:
        b = min(a + limit, len(data))
        while b < len(data) and WORD_WHITE[data[b]]:
            white = np.flatnonzero(~WORD_WHITE[data[b : b + limit]])
            b = b + int(white[0]) if len(white) else min(b + limit, len(data))
        piece = data[a:b]
        yield piece
        if b == len(data):
            return
        start, _, _ = word_spans(piece, np.array([0, len(piece)]))
        if len(start) >= k:  # else the piece is read again, longer
            a += int(start[len(start) - k + 1]) if k > 1 else b - a
        else:
            limit *= 2


def long_fingerprint(data: np.ndarray, k: int = SHINGLE, seed: int = SEED, limit: int = CHUNK_BYTES) -> tuple[int, int]:
    """(fingerprint, number of shingles) of one text, a piece of it in memory at a time."""
    total, n = np.zeros((1, 64), np.int64), 0
    for piece in _pieces(data, limit, k):
        hashes, of = shingle_digests(piece, np.array([0, len(piece)]), k, seed)
        if len(piece) < len(data) and len(word_spans(piece, np.array([0, len(piece)]))[0]) < k:
            continue  # of fewer words than a shingle, and read again with what follows, or the overlap alone
        total, n = total + bit_counts(hashes, of, 1), n + len(hashes)
    return int(np.packbits(2 * total > n, axis=1, bitorder="little").view(np.uint64)[0, 0]), n


def fingerprinted(docs: DataFrame, k: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, print (64 bits, signed), n_shingles."""

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in batch_chunks(batch):
                if b - a == 1 and len(data) > CHUNK_BYTES:
                    one = long_fingerprint(data, k, seed)
                    found, n = np.array([one[0]], np.uint64), np.array([one[1]])
                else:
                    found, n = fingerprints(data, offsets, k, seed)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(signed(found)), pa.array(n)], ["doc_id", "print", "n_shingles"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, print long, n_shingles long")


def blocks(bits: list[int], n: int) -> list[list[int]]:
    """The bits in ``n`` runs of nearly equal length."""
    return [list(x) for x in np.array_split(bits, n)]


def _value(bits: list[int]) -> Column:
    """The given bits of the fingerprint; they lie in runs, so a mask tells values apart without moving them."""
    mask = sum(1 << b for b in bits)
    return F.col("print").bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask))


def bucket_keys(radius: int = RADIUS, levels: int = 1) -> list[tuple[int, Column]]:
    """(number, value) of each bucket of a fingerprint: two within the radius share one at least."""
    every = list(range(64))
    chosen = blocks(every, radius + 1)
    for _ in range(levels - 1):
        chosen = [old + new for old in chosen for new in blocks([b for b in every if b not in set(old)], radius + 1)]
    return [(i, _value(bits)) for i, bits in enumerate(chosen)]


def _levels(n: int, radius: int, dealt: int) -> int:
    """As many levels as it takes for an evenly filled bucket to hold a tile at most; no link depends on it."""
    levels, bits = 1, 64 // (radius + 1)
    while n >> bits > dealt and levels < 3:
        levels, bits = levels + 1, bits + (64 - bits) // (radius + 1)
    return levels


def compare(first: np.ndarray, second: np.ndarray, radius: int, tile: int = TILE):
    """Index arrays (i, j) of pairs within the radius, a pair of tiles at a time; both sides sorted by population count."""
    counts = np.bitwise_count(first).astype(np.int64), np.bitwise_count(second).astype(np.int64)
    for a in range(0, len(first), tile):
        lo, hi = counts[0][a], counts[0][min(a + tile, len(first)) - 1]
        # Tiles of the second side whose counts lie within the radius of this one's.
        left = int(np.searchsorted(counts[1], lo - radius, "left")) // tile * tile
        right = int(np.searchsorted(counts[1], hi + radius, "right"))
        for b in range(left, right, tile):
            near = np.bitwise_count(first[a : a + tile, None] ^ second[None, b : b + tile]) <= radius
            i, j = np.nonzero(near)
            if len(i):
                yield i + a, j + b


def reached(n: int, pairs) -> np.ndarray:
    """The least index that each of ``n`` reaches over the pairs, which come as index arrays (i, j)."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            one, other = label[i], label[j]
            if (one == other).all():
                break
            # All labels are roots here, so nothing that was joined before comes apart.
            low = np.minimum(one, other)
            np.minimum.at(label, one, low)
            np.minimum.at(label, other, low)
            while (label != (up := label[label])).any():
                label = up
    return label


def _links(prints: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): fingerprints of a bucket, or of a pair of tiles (sides 0 and 1), and the least that each reaches."""
    order = np.lexsort((prints, np.bitwise_count(prints)))
    prints, side = prints[order], side[order]
    one = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if len(one[1]):
        pairs = ((one[0][i], one[1][j]) for i, j in compare(prints[one[0]], prints[one[1]], radius))
    else:
        pairs = compare(prints, prints, radius)
    label = reached(len(prints), pairs)
    moved = np.flatnonzero(label != np.arange(len(prints)))
    return prints[moved], prints[label[moved]]


def _small(group: np.ndarray, prints: np.ndarray, radius: int):
    """(i, j) of all links in many small groups at once; rows sorted by group, then population count."""
    counts = np.bitwise_count(prints).astype(np.int64)
    at, d = np.arange(len(prints) - 1), 1
    while len(at):
        at = at[at + d < len(prints)]
        at = at[(group[at] == group[at + d]) & (counts[at + d] - counts[at] <= radius)]
        near = at[np.bitwise_count(prints[at] ^ prints[at + d]) <= radius]
        if len(near):
            yield near, near + d
        d += 1


#: Groups up to this size are compared together, by distance of their rows.
TOGETHER = 48


def _within(batches, radius: int):
    """Links of buckets and pairs of tiles: rows come sorted by (key, value, tile, side)."""

    def flush(table: pa.Table):
        """Whole groups, each a bucket or a pair of tiles."""
        prints = np.asarray(table["print"]).view(np.uint64)
        side = np.asarray(table["side"])
        new = np.zeros(len(prints), bool)
        new[:1] = True
        for name in ("key", "value", "tile"):
            x = np.asarray(table[name])
            new[1:] |= x[1:] != x[:-1]
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        few = (size[group] <= TOGETHER) & (np.bincount(group, side)[group] == 0)
        index = np.flatnonzero(few)
        index = index[np.lexsort((np.bitwise_count(prints[index]), group[index]))]
        some = prints[index]
        label = reached(len(some), _small(group[index], some, radius))
        moved = np.flatnonzero(label != np.arange(len(some)))
        found = [(some[moved], some[label[moved]])]
        starts = np.concatenate([[0], np.cumsum(size)])
        for g in np.unique(group[~few]):
            part = slice(starts[g], starts[g + 1])
            found.append(_links(prints[part], side[part], radius))
        a, b = (np.concatenate([x[k] for x in found]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(signed(a)), pa.array(signed(b))], ["a", "b"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < 4 * DEALT:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = np.ones(rows, bool)
        for name in ("key", "value", "tile"):
            x = np.asarray(table[name])
            last &= x == x[-1]
        cut = int(np.argmax(last)) if last.any() else rows  # the last group may go on
        if cut:
            yield flush(table.slice(0, cut))
        held = table.slice(cut).to_batches()
        rows -= cut
    if rows:
        yield flush(pa.Table.from_batches(held).combine_chunks())


def close_prints(prints: DataFrame, radius: int = RADIUS, dealt: int = DEALT, levels: int | None = None) -> DataFrame:
    """(a, b): links between the distinct fingerprints (column ``print``) whose components are those of all pairs within the radius."""
    levels = levels or _levels(prints.count(), radius, dealt)
    keys = F.array(*[F.struct(F.lit(i).alias("key"), v.alias("value")) for i, v in bucket_keys(radius, levels)])
    rows = prints.select("print", F.bit_count("print").alias("ones"), F.inline(keys))
    bucket = ["key", "value"]
    counted = rows.groupBy(*bucket, "ones").agg(F.count(F.lit(1)).alias("n"))
    # Fingerprints of a bucket by population count: 65 numbers a bucket at most.
    filled = counted.groupBy(*bucket).agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("ones", "n"))).alias("by_ones")).where("`all` > 1")
    # Buckets of up to a tile are one group; of others each (population count, part) is a tile.
    parts = F.map_from_entries(F.transform(F.map_entries("by_ones"), lambda e: F.struct(e["key"], F.ceil(e["value"] / dealt).cast("int"))))
    filled = materialize(filled.select(*bucket, "all", F.when(F.col("all") > dealt, parts).alias("parts")), "buckets")
    found = rows.join(filled, bucket)
    own = F.pmod(F.xxhash64("print", F.lit("tile")), F.try_element_at("parts", "ones")).cast("long")
    # A tile meets itself, the others of its own count and those of the next counts up to the radius.  A pair of
    # tiles is named by count and part of the lower one, then of the upper one; side 0 is the lower one.
    of = lambda count: F.coalesce(F.try_element_at("parts", count), F.lit(0))
    pair = lambda o, p, q, r: F.shiftleft(o.cast("long"), 55) + F.shiftleft(q.cast("long"), 48) + F.shiftleft(p, 24) + r
    every = lambda sign: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(radius)), lambda d: F.transform(F.sequence(F.lit(0), of(F.col("ones") + sign * d)), lambda q: F.struct((F.col("ones") + sign * d).alias("ones"), q.cast("long").alias("part")))))
    there = lambda sign, same: F.filter(every(sign), lambda x: (x["part"] < of(x["ones"])) & ((x["ones"] != F.col("ones")) | same(x["part"])))
    lower = F.transform(there(1, lambda q: q >= F.col("own")), lambda x: F.struct(pair(F.col("ones"), F.col("own"), x["ones"], x["part"]).alias("tile"), F.lit(0).alias("side")))
    upper = F.transform(there(-1, lambda q: q < F.col("own")), lambda x: F.struct(pair(x["ones"], x["part"], F.col("ones"), F.col("own")).alias("tile"), F.lit(1).alias("side")))
    alone = F.array(F.struct(F.lit(-1).cast("long").alias("tile"), F.lit(0).alias("side")))
    work = found.withColumn("own", own).select("print", *bucket, F.inline(F.when(F.col("parts").isNull(), alone).otherwise(F.concat(lower, upper))))
    dealt_out = work.repartition(partitions(prints.sparkSession), "key", "value", "tile").sortWithinPartitions("key", "value", "tile", "side")
    links = materialize(dealt_out.mapInArrow(lean(lambda batches: _within(batches, radius)), "a long, b long"), "close-prints")
    discard(filled)
    return links


def simhash_duplicates(docs: DataFrame, radius: int = RADIUS, k: int = SHINGLE, seed: int = SEED, dealt: int = DEALT, levels: int | None = None) -> DataFrame:
    """doc_id, fingerprint, component_id, n_shingles; documents link where ``radius`` bits or fewer of their fingerprints differ."""
    made = materialize(fingerprinted(docs, k, seed), "fingerprints")
    # min() passes over rows without an id.
    prints = materialize(made.groupBy("print").agg(F.min("doc_id").alias("first")), "prints")
    links = close_prints(prints.select("print"), radius, dealt, levels)
    labels = components(links)
    discard(links)
    labels._written_to = labels.inputFiles()[0].rsplit("/", 1)[0]
    named = prints.join(labels.withColumnRenamed("v", "print"), "print", "left").select("print", "first", F.coalesce("label", "print").alias("label"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    known = materialize(named.join(least, "label").select("print", "component_id"), "print-components")
    for done in (prints, labels):
        discard(done)
    return made.join(known, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id", "n_shingles")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def _sql() -> str:
    """The hash in 128-bit integers modulo 2**64; ``let`` binds a value that is needed twice."""
    p1, p2, p3, p4, p5 = (f"{x}::UHUGEINT" for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))  # fixed values of XXH64
    mod = lambda x: f"(({x}) % 18446744073709551616::UHUGEINT)"
    let = lambda name, value, body: f"list_transform([{value}], lambda {name}: {body})[1]"
    rot = lambda name, x, r: let(name, f"({x}) * {1 << r}::UHUGEINT", f"{name} % 18446744073709551616::UHUGEINT + {name} // 18446744073709551616::UHUGEINT")
    step = lambda name, acc, x: mod(f"{rot(name, mod(f'{acc} + ({x}) * {p2}'), 31)} * {p1}")
    shift = lambda x, r: let("z", x, f"xor(z, z // {1 << r}::UHUGEINT)")
    number = lambda at, n: f"CAST('0x' || {' || '.join(f'substr(h, {at} + {2 * i}, 2)' for i in reversed(range(n)))} AS UBIGINT)::UHUGEINT"
    lane = lambda i: f"list_reduce(list_transform(range(0, n // 32), lambda i: {number(f'i * 64 + {16 * i - 15}', 8)}), lambda a, x: {step('y', 'a', 'x')}, v{i})"
    merge = mod(" + ".join(rot("y", f"lanes[{i}]", r) for i, r in ((1, 1), (2, 7), (3, 12), (4, 18))))
    wide = f"list_reduce(lanes, lambda a, x: {mod(f'xor(a, ' + step('y', '0::UHUGEINT', 'x') + f') * {p1} + {p4}')}, {merge})"
    eight = f"list_reduce(list_transform(range(n // 32 * 4, n // 8), lambda i: {number('i * 16 + 1', 8)}), lambda a, x: {mod(rot('w', 'xor(a, ' + step('y', '0::UHUGEINT', 'x') + ')', 27) + f' * {p1} + {p4}')}, g)"
    four = f"CASE WHEN n % 8 >= 4 THEN {mod(rot('w', f'xor(g, ' + mod(number('n // 8 * 16 + 1', 4) + f' * {p1}') + ')', 23) + f' * {p2} + {p3}')} ELSE g END"
    ones = f"list_reduce(list_transform(range(n // 4 * 4, n), lambda i: {number('i * 2 + 1', 1)}), lambda a, x: {mod(rot('w', 'xor(a, ' + mod(f'x * {p5}') + ')', 11) + f' * {p1}')}, g)"
    last = shift(mod(f"{shift(mod(f'{shift('g', 33)} * {p2}'), 29)} * {p3}"), 32)
    bits = ", ".join(f"sum((x >> {b}) & 1::UBIGINT) AS b{b}" for b in range(64))
    print_ = " + ".join(f"CASE WHEN 2 * b{b} > n THEN {1 << b}::UHUGEINT ELSE 0::UHUGEINT END" for b in range(64))
    return rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM d
), h0 AS (SELECT g AS s, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM s)
), h1 AS (SELECT s, h, len(h) // 2 AS n, {(11400714785074694791 + 14029467366897019727 + SEED) % 2**64}::UHUGEINT AS v1, {(14029467366897019727 + SEED) % 2**64}::UHUGEINT AS v2, {SEED}::UHUGEINT AS v3, {(SEED - 11400714785074694791) % 2**64}::UHUGEINT AS v4 FROM h0
), h2 AS (SELECT s, h, n, CASE WHEN n >= 32 THEN [{", ".join(lane(i) for i in (1, 2, 3, 4))}] END AS lanes FROM h1
), h3 AS (SELECT s, h, n, {mod(f"CASE WHEN n >= 32 THEN {wide} ELSE {(2870177450012600261 + SEED) % 2**64}::UHUGEINT END + n::UHUGEINT")} AS g FROM h2
), h4 AS (SELECT s, h, n, {eight} AS g FROM h3
), h5 AS (SELECT s, h, n, {four} AS g FROM h4
), h6 AS (SELECT s, {ones} AS g FROM h5
), h7 AS (SELECT s, CAST({last} AS UBIGINT) AS x FROM h6
), c AS (SELECT r, count(*) AS n, {bits} FROM s JOIN h7 ON h7.s = s.g GROUP BY r
), f AS (SELECT r, CAST({print_} AS UBIGINT) AS f FROM c
), p AS (SELECT d.r, d.doc_id, coalesce(f.f, 0::UBIGINT) AS f FROM d LEFT JOIN f USING (r)
), q AS (SELECT DISTINCT f FROM p
), e AS (SELECT a.f AS a, b.f AS b FROM q a JOIN q b ON bit_count(xor(a.f, b.f)) <= 3
), t AS (SELECT f, f AS o FROM q UNION SELECT t.f, e.b FROM t JOIN e ON e.a = t.o
), m AS (SELECT t.f, min(p.doc_id) AS component_id FROM t JOIN p ON p.f = t.o GROUP BY t.f)
SELECT doc_id, format('{{:016x}}', f) AS fingerprint, component_id FROM p JOIN m USING (f)
"""


OP12_SQL = _sql()
