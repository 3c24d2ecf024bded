"""Product codes of vectors: codebooks by exact Lloyd rounds with Yinyang bounds.

A vector becomes integers, floor(scale * x), and is cut into equal parts; each part position has a codebook.  The
entries of a codebook are clustered into groups once.  A vector carries, for each part, its entry and one lower bound
a group on the distance to any other entry of it.  When the entries have moved, a bound falls by the largest drift of
its group; the distance to the own entry is worked out anew, and only groups whose bound no longer exceeds it are
scanned.  Scans give integer distances, so ties are seen as such and go to the lower index; bounds are rounded
outwards, so that rounding never spares a scan that matters.

The state is a table in the shared folder, written anew in each round and deleted once the next is whole, so a lost
executor costs its tasks alone.  What a round needs besides is the codebooks and their drifts, whose size is a
setting times the length of a vector, and what it gives back is one sum and count an entry, merged in a tree.
A null, or a vector that holds one or a component that is not finite, is dropped.

Defined results: vectors of another length than that of the least kept id are dropped; a length that is no multiple
of ``parts`` counts as filled up with zeros; repeated rows count each, and of equal ids the lesser vector comes first
in the first codebook; fewer rows than ``entries`` make shorter codebooks; rows without an id follow all others;
components whose squared distances may leave 63 bits are refused with a ValueError; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, lean, materialize, read

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024.0
#: Entries of a group, on average, and turns of the clustering that makes the groups.
GROUP, GROUP_TURNS = 16, 5
#: Integers below it are exact in double precision.
EXACT = 2**53


def _groups(codebook: np.ndarray) -> list[np.ndarray]:
    """Indices of a codebook's entries by group: a few plain Lloyd turns over the entries."""
    x = codebook.astype(np.float64)
    n = max(1, -(-len(x) // GROUP))
    centres = x[:: max(1, len(x) // n)][:n].copy()
    for _ in range(GROUP_TURNS):
        of = ((x[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        for g in range(n):
            if (of == g).any():
                centres[g] = x[of == g].mean(0)
    return [m for g in range(n) if len(m := np.flatnonzero(of == g))]


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries, as integers."""
    top = int(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    if 4 * top * top * max(1, x.shape[1]) < EXACT:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    out = np.empty((len(x), len(entries)), np.int64)
    for j, e in enumerate(entries):
        out[:, j] = ((x - e) ** 2).sum(1)
    return out


def reassign(x: np.ndarray, codebook: np.ndarray, groups: list[np.ndarray], code: np.ndarray, bounds: np.ndarray | None, drift: np.ndarray):
    """(code, squared distance, bounds, scanned distances) of one part's rows after the entries moved by ``drift``.

    ``bounds`` holds, by group, less than the distance to any entry of it but the own; None: nothing is known.
    """
    n = len(x)
    if bounds is None:
        code = np.zeros(n, np.int64)
        bounds = np.full((n, len(groups)), -1.0)
    else:
        bounds = bounds.astype(np.float64) - np.array([drift[g].max() for g in groups])[None, :]
    before = code
    best = ((x - codebook[code]) ** 2).sum(1) if n else np.zeros(0, np.int64)
    own = best.copy()
    reach = np.sqrt(own.astype(np.float64)) * (1 + 1e-6) + 1e-6
    code, scanned = code.copy(), n
    group_of = np.empty(len(codebook), np.int64)
    looked: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = []
    for g, members in enumerate(groups):
        group_of[members] = g
        rows = np.flatnonzero(bounds[:, g] <= reach)
        scanned += len(rows) * len(members)
        if not len(rows):
            looked.append(None)
            continue
        d = _distances(x[rows], codebook[members])
        looked.append((rows, members, d))
        least = d.argmin(1)  # of equal distances the first, and members rise
        near, index = d[np.arange(len(rows)), least], members[least]
        better = (near < best[rows]) | (near == best[rows]) & (index < code[rows])
        best[rows[better]], code[rows[better]] = near[better], index[better]
    down = lambda d: np.sqrt(d.astype(np.float64)) * (1 - 1e-6) - 1e-6
    for g, found in enumerate(looked):
        if found is None:
            continue
        rows, members, d = found
        other = np.where(members[None, :] == code[rows][:, None], np.iinfo(np.int64).max, d)
        bounds[rows, g] = down(other.min(1))
    # The entry that was left is another one now, in a group that may not have been scanned.
    left = np.flatnonzero(code != before)
    np.minimum.at(bounds, (left, group_of[before[left]]), down(own[left]))
    return code, best, _rounded_down(bounds), scanned


def _rounded_down(bounds: np.ndarray) -> np.ndarray:
    """The largest floats of 32 bits that are not above."""
    out = bounds.astype(np.float32)
    return np.where(out > bounds, np.nextafter(out, np.float32(-np.inf)), out)


STATE = "vec_id long, label string, x binary, code binary, bounds binary, error long"
#: Components that are worked on at once, one vector at least.
STEP_VALUES = 1 << 20


def _slices(batches, dim: int):
    rows = max(1, STEP_VALUES // max(1, dim))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _whole(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """The integer vectors of a batch, a row each."""
    return np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("x")).to_pylist()), np.int32).reshape(batch.num_rows, dim)


def _packed(x: np.ndarray) -> pa.Array:
    width = x.itemsize * x.shape[1]
    raw = np.ascontiguousarray(x).tobytes()
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(raw)])


class Compressor:
    """Codebooks in training; ``state`` is the table of vectors, codes and bounds as of the last assignment."""

    def __init__(self, vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, scale: float = SCALE):
        whole = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale))
        finite = ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
        clean = vectors.where(F.col("embedding").isNotNull() & finite).select("vec_id", F.col("label").cast("string").alias("label"), whole.alias("x"))
        # The first codebook: a fixed number of rows, so what the driver holds is bounded by the length of a vector.
        first = clean.orderBy(F.asc_nulls_last("vec_id"), "x").select("x").limit(entries).collect()
        self.parts, self.length = parts, len(first[0].x) if first else 0
        self.width = -(-self.length // parts)
        self.dim = self.width * parts
        kept = clean.where(F.size("x") == self.length)
        if self.length:
            top = kept.agg(F.max(F.array_max(F.transform("x", lambda v: F.abs(v.cast("double")))))).first()[0] or 0
            if 4 * top * top * self.dim >= 2**62 or top >= 2**31:
                raise ValueError("squared distances may leave 63 bits: components are too large for this scale")
        self.spark = vectors.sparkSession
        rows = [r.x for r in first if len(r.x) == self.length]
        filled = np.zeros((len(rows), self.dim), np.int64)
        if self.length:
            filled[:, : self.length] = rows
        self.codebooks = [filled[:, p * self.width : (p + 1) * self.width].copy() for p in range(parts)]
        self.groups = [_groups(c) for c in self.codebooks] if rows else []
        self.drifts = [np.zeros(len(c)) for c in self.codebooks]
        self.state = None
        self.kept = kept.select("vec_id", "label", F.transform("x", lambda v: v.cast("int")).alias("x"))

    def _step(self, first: bool):
        shared = self.spark.sparkContext.broadcast((self.codebooks, self.groups, self.drifts))
        parts, width, dim, length = self.parts, self.width, self.dim, self.length

        def run(batches):
            codebooks, groups, drifts = shared.value
            for batch in _slices(batches, dim):
                n = batch.num_rows
                if first:
                    x = np.zeros((n, dim), np.int32)
                    column = batch.column(2)
                    x[:, :length] = np.asarray(column.flatten()).reshape(n, length)
                else:
                    x = _whole(batch, dim)
                    codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(n, parts)
                    held = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.float32).reshape(n, -1)
                code, bounds, error, at = np.zeros((n, parts), np.uint8), [], np.zeros(n, np.int64), 0
                for p in range(parts):
                    own, size = x[:, p * width : (p + 1) * width].astype(np.int64), len(groups[p])
                    known = None if first else held[:, at : at + size]
                    got, d, b, _ = reassign(own, codebooks[p], groups[p], None if first else codes[:, p].astype(np.int64), known, drifts[p])
                    code[:, p], error, at = got, error + d, at + size
                    bounds.append(b)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _packed(x), _packed(code), _packed(np.hstack(bounds)), pa.array(error)], ["vec_id", "label", "x", "code", "bounds", "error"])

        return lean(run)

    def assign(self) -> None:
        """Assigns every part to its nearest entry; the state of before goes once the new one is written."""
        before = self.state
        source = self.kept if before is None else before
        self.state = materialize(source.mapInArrow(self._step(before is None), STATE), "vector-codes")
        if before is not None:
            discard(before)

    def update(self) -> None:
        """Each entry becomes the floor of the mean of its parts; entries without parts stay."""
        parts, width, dim, sizes = self.parts, self.width, self.dim, [len(c) for c in self.codebooks]

        def run(batches):
            sums = [np.zeros((k, width + 1), np.int64) for k in sizes]
            for batch in _slices(batches, dim):
                x = _whole(batch, dim).astype(np.int64)
                codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(x), parts)
                for p in range(parts):
                    order = np.argsort(codes[:, p], kind="stable")
                    used, starts = np.unique(codes[order, p], return_index=True)
                    sums[p][used, :width] += np.add.reduceat(x[order, p * width : (p + 1) * width], starts, axis=0)
                    sums[p][:, width] += np.bincount(codes[:, p], minlength=sizes[p])
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(s.tobytes() for s in sums)])], ["sums"])

        vectors = self.state.select("x", "code").mapInArrow(lean(run), "sums binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
        if not vectors.getNumPartitions():
            return
        total, at = vectors.treeReduce(np.add), 0
        for p, k in enumerate(sizes):
            sums = total[at : at + k * (width + 1)].reshape(k, width + 1)
            at += k * (width + 1)
            used = sums[:, width] > 0
            new = self.codebooks[p].copy()
            new[used] = sums[used, :width] // sums[used, width][:, None]
            moved = (new - self.codebooks[p]).astype(np.float64)
            self.drifts[p] = np.sqrt((moved * moved).sum(1)) * (1 + 1e-9) + 1e-9
            self.codebooks[p] = new

    def digest(self) -> str:
        text = ",".join(str(v) for c in self.codebooks for v in c.ravel().tolist())
        return hashlib.sha256(text.encode()).hexdigest()


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> Compressor:
    """Codebooks after ``rounds`` rounds and the vectors' final codes; a code is a byte a part, so ``entries`` is 256 at most."""
    made = Compressor(vectors, parts, entries, scale)
    if made.groups:
        for _ in range(rounds):
            made.assign()
            made.update()
        made.assign()
    return made


def encode(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    made = train(vectors, **options)
    if made.state is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    done = made.state.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error")
    # The sums are joined to the rows, not made by a window, so that a label of a third of all rows is split like any hot key.
    sums = done.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return done.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(made.digest()).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "embeddings"))


def _sql() -> str:
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS (
  SELECT x.r, x.p, min(row(list_sum(list_transform(list_zip(x.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c.e)) AS best FROM x JOIN c{r} c USING (p) GROUP BY x.r, x.p
)""")
        if r < ROUNDS:
            steps.append(f"""m{r} AS (
  SELECT p, e, list(v ORDER BY i) AS x FROM (
    SELECT x.p, a.best[2] AS e, i, CAST(floor(sum(x.x[i]) / count(*)) AS BIGINT) AS v FROM x JOIN a{r} a USING (r, p), (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM x))) AS i) GROUP BY x.p, a.best[2], i
  ) GROUP BY p, e
), c{r + 1} AS (SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (p, e))""")
    return f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS (SELECT r, p, x[p * len(x) // 4 + 1:(p + 1) * len(x) // 4] AS x FROM v, (SELECT unnest(range(4)) AS p)
), c0 AS (SELECT p, r - 1 AS e, x FROM x WHERE r <= 256
), {", ".join(steps)}, d AS (
  SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1]) AS error FROM a{ROUNDS} GROUP BY r
), s AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, CAST(error AS BIGINT) AS error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN d USING (r), s
"""


OP13_SQL = _sql()
