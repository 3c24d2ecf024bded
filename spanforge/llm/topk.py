"""Exact top-k search by integer inner product with a pivot table.

Vectors become integers, floor(scale * x).  With one more coordinate, sqrt(M - |x|^2), all candidates have the
squared norm M (per cell), so that a query's distance to a candidate falls as their inner product rises.  Candidates are dealt
evenly into cells of ``CELL_VALUES`` components at most, each in one cell, where its distances to many pivots are computed
once; a cell's candidates are sorted by their nearest pivot and their distance to it and cut into groups.  By the pivots, the
least of |d(q, p) - d(x, p)| over a group bounds d(q, x) from below.  The query set streams past each cell in blocks; a cell's
groups are evaluated in the order of their bounds, each for those queries whose k-th score its bound does not exclude, which
starts from an exact lower bound on that score made by each query against one block.  The driver holds that block alone, 4 MB
at most whatever the vectors' length; longer vectors come in blocks of fewer rows.  A task holds one cell and one block of queries, and
Arrow batches are bounded in bytes, so that no process' memory grows with the tables.  The results of the cells are merged per query.

All scores are exact: in single precision where they stay below 2**24, in double below 2**52, else in 64-bit integers.  Bounds are widened by
more than the rounding error, so rounding never drops a candidate.  Scores must fit a long: if the largest
squared norm of the integer vectors reaches 2**63, the search is refused with a ValueError before it begins.

Defined results: vectors that are null, or hold null or non-finite components, take no part; vectors of another
length than the query's are no candidates for it; rows of a query's id are its own and no candidates of it, other repeated rows are candidates each; of equal scores the smaller
id comes first; rows whose id is null take no part; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, lean, partitions, read

PIVOTS = 24
BLOCK = 1024
QUERY_BLOCK = 1024
#: Rows from which pivots and first bounds come, and how many components they may hold together.
FIRST = 4096
FIRST_VALUES = 1 << 19
#: Components of a block, which has one row at least, and of a cell of candidates, in about.
BLOCK_VALUES = 1 << 18
CELL_VALUES = 1 << 23
#: Rows of a cell from which a table is dealt into several.
CELL = 8192
#: Scores below it are exact in single or in double precision.
EXACT_SINGLE = 2.0**24
EXACT = 2.0**52
#: Candidates of a group, at least and at most; in between, a cell has 128 groups.
STEP = (32, 256)
#: Bytes of an Arrow batch on both sides of the Python boundary.
BATCH_BYTES = 8 << 20


def _table(x: np.ndarray, pivots: np.ndarray) -> tuple[float, np.ndarray]:
    """(M, distances of the block's lifted vectors to the lifted pivots, a row a pivot)."""
    norms, p_norms = (x * x).sum(1), (pivots * pivots).sum(1)
    top = float(max(norms.max(), p_norms.max()))
    lift = np.sqrt(top - norms)[:, None] * np.sqrt(top - p_norms)
    return top, np.sqrt(np.maximum(2 * top - 2 * (x @ pivots.T + lift), 0)).T.astype(np.float32)


class _Cell:
    """Candidates sorted by their nearest pivot and their distance to it, in groups, with each group's least and greatest distance to each pivot."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, top: float, table: np.ndarray, pivots: np.ndarray):
        near = table.argmin(0)
        self.order = np.lexsort((table[near, np.arange(len(x))], near))
        self.ids, self.x, self.top, self.pivots = ids[self.order], x[self.order], top, pivots
        self.step = min(max(len(x) // 128, STEP[0]), STEP[1])
        table, cuts = table[:, self.order], np.arange(0, len(x), self.step)
        self.low, self.high = np.minimum.reduceat(table, cuts, axis=1), np.maximum.reduceat(table, cuts, axis=1)
        self.norm, self.forms = float((x * x).sum(1).max()), {}

    def form(self, kind) -> np.ndarray:
        if kind not in self.forms:
            self.forms = {kind: self.x.astype(kind, copy=False)}
        return self.forms[kind]

    def best(self, q_ids: np.ndarray, q: np.ndarray, tau: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query indices, candidates' places in the order of the cell, scores) of each query's best k of the cell that reach tau; how many scores were worked out."""
        q_norm = (q * q).sum(1)
        # No score, nor any part of its sum, is above the product of the norms.
        most = np.sqrt(self.norm * q_norm.max()) * (1 + 1e-9)
        kind = np.float32 if most < EXACT_SINGLE else np.float64 if most < EXACT else np.int64
        xs, qs = self.form(kind), q.astype(kind)
        dq = np.sqrt(np.maximum(q_norm[:, None] + self.top - 2 * (q @ self.pivots.T), 0)).astype(np.float32)
        bound = np.zeros((len(q), self.low.shape[1]), np.float32)
        for low, high, d in zip(self.low, self.high, dq.T):
            np.maximum(bound, low - d[:, None], out=bound)
            np.maximum(bound, d[:, None] - high, out=bound)
        slack = 1e-3 * (1 + np.sqrt(2 * self.top))
        # |q - x|^2 = |q|^2 + top - 2 * score, so a score of s at least lies within this distance.
        reach = lambda least: np.sqrt(np.maximum(q_norm + self.top - 2 * least, 0)) * (1 + 1e-9) + slack
        # The k-th score so far and its id: what does not come before them is left out.  tau is a bound on the score alone.
        floor = np.where(np.isfinite(tau), tau, -(2.0**63)).astype(np.int64)
        least, last = floor.copy(), np.full(len(q), np.iinfo(np.int64).max)
        within = np.where(np.isfinite(tau), reach(least.astype(np.float64)), np.inf)
        of, at, score, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        waiting = []

        def merge():
            nonlocal of, at, score
            of, at, score = (np.concatenate([old, *new]) for old, new in zip((of, at, score), zip(*waiting)))
            waiting.clear()
            order = np.lexsort((self.ids[at], -score, of))
            of, at, score = of[order], at[order], score[order]
            start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            size = np.diff(np.concatenate([start, [len(of)]]))
            full = start[size >= k] + k - 1
            least[of[full]], last[of[full]] = score[full], self.ids[at[full]]
            within[of[full]] = reach(least.astype(np.float64))[of[full]]
            kept = np.arange(len(of)) - np.repeat(start, size) < k
            of, at, score = of[kept], at[kept], score[kept]

        # Each query's nearest group comes first, then the others in the order of their bounds.
        own = bound.argmin(1)
        for g, nearest in [(g, True) for g in np.unique(own).tolist()] + [(g, False) for g in np.argsort(bound.min(0), kind="stable").tolist()]:
            if waiting and (sum(len(w[0]) for w in waiting) > len(q) or not nearest and first_round):
                merge()
            first_round = nearest
            live = own == g if nearest else (own != g) & (bound[:, g] <= within)
            n = np.count_nonzero(live)
            if not n:
                continue
            part = slice(g * self.step, min((g + 1) * self.step, len(xs)))
            rows = np.flatnonzero(live) if 4 * n < 3 * len(q) else slice(None)
            found = qs[rows] @ xs[part].T
            seen += found.size
            # Scores in single precision are whole numbers below 2**24, and so are the bounds that they may reach.
            limit = least[rows] if kind is np.int64 else np.maximum(least[rows], -(2**53)).astype(kind)
            i, j = np.nonzero(found >= limit[:, None])
            s, i, j = found[i, j].astype(np.int64), np.arange(len(q))[rows][i], j + part.start
            ok = live[i] & (self.ids[j] != q_ids[i]) & ((s > least[i]) | (s == least[i]) & (self.ids[j] <= last[i]))
            if ok.any():
                waiting.append((i[ok], j[ok], s[ok]))
        if waiting:
            merge()
        return of, at, score, seen


def _pairs_of(ids: np.ndarray, x: np.ndarray, top: float, table: np.ndarray, q_ids: np.ndarray, q: np.ndarray, tau: np.ndarray, pivots: np.ndarray, k: int):
    """((query index, candidate index, score) of each query's best k of a cell, at least; how many scores were worked out)."""
    cell = _Cell(ids, x, top, table, pivots)
    of, at, score, seen = cell.best(q_ids, q, tau, k)
    return list(zip(of.tolist(), cell.order[at].tolist(), score.tolist())), seen


def _blocks(batches, block: int):
    """(length, ids, vectors) of up to ``block`` rows of vectors of one length, over the batches of a task."""
    held: dict[int, list] = {}
    for batch in batches:
        dims = np.asarray(batch.column(2))
        for d in np.unique(dims).tolist():
            rows = batch.take(pa.array(np.flatnonzero(dims == d)))
            held.setdefault(d, []).append((np.asarray(rows.column(0)).astype(np.int64), np.asarray(rows.column(1).flatten()).astype(np.float64).reshape(-1, d)))
            n = max(1, min(block, BLOCK_VALUES // d))
            if sum(len(i) for i, _ in held[d]) >= n:
                ids, x = (np.concatenate(c) for c in zip(*held.pop(d)))
                for a in range(0, len(ids) - n + 1, n):
                    yield d, ids[a : a + n], x[a : a + n]
                a = len(ids) // n * n
                if a < len(ids):
                    held[d] = [(ids[a:], x[a:])]
    for d, parts in held.items():
        ids, x = (np.concatenate(c) for c in zip(*parts))
        yield d, ids, x


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as hold them all."""
    most = np.abs(x).max()
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.float64).tobytes()


def _unpacked(raw: bytes, n: int, dim: int) -> np.ndarray:
    kind = {2: np.int16, 4: np.int32, 8: np.float64}[len(raw) // (n * dim)]
    return np.frombuffer(raw, kind).reshape(n, dim).astype(np.float64)


def _floats(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(-1, dim)


def _first(clean: DataFrame, mean: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) by length of up to ``FIRST`` rows, ``FIRST_VALUES`` components in all; ``mean``: the vectors' mean length."""
    # Rows of up to one and a half times the mean length, so that a few very long ones do not use the room up.
    longest = int(1.5 * mean) if mean != int(mean) else int(mean)
    n = min(FIRST, FIRST_VALUES // max(1, longest))
    if not n:
        return {}

    def pack(batches):
        for batch in batches:
            at, flat = np.concatenate([[0], np.cumsum(np.asarray(batch.column(2)))]), np.asarray(batch.column(1).flatten()).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([flat[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())], ["vec_id", "dim", "x"])

    out: dict[int, tuple[list, list]] = {}
    for row in clean.where(F.col("dim") <= longest).mapInArrow(lean(pack), "vec_id long, dim int, x binary").limit(n).collect():
        ids, parts = out.setdefault(row.dim, ([], []))
        ids.append(row.vec_id)
        parts.append(bytes(row.x))
    return {d: (np.array(i, np.int64), _floats(b"".join(x), d)) for d, (i, x) in out.items()}


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query; ``is_query``: a condition on vec_id."""
    spark = vectors.sparkSession
    bound_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    whole = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("double"))
    finite = ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    clean = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite).select("vec_id", whole.alias("x"), F.size("embedding").alias("dim"))
    # No score, nor any part of its sum, is above the largest squared norm.
    largest, mean, n = clean.agg(F.max(F.aggregate("x", F.lit(0.0), lambda n, c: n + c * c)), F.avg("dim"), F.count("dim")).first()
    if largest is not None and largest >= 2**63 * (1 - 1e-9):
        raise ValueError("a score may leave 64 bits: components are too large for this scale")
    # Pivots and the first bounds: one bounded block of candidates of each length, however large the table is.
    first = _first(clean, mean or 0.0)
    # A length that the first rows lack has the origin for a pivot: no bound but the norms.
    chosen = {d: _far_apart(x, pivots) for d, (_, x) in first.items()}
    shared = spark.sparkContext.broadcast((first, chosen))
    pivots_of = lambda centres, d: centres[d] if d in centres else np.zeros((1, d))
    cells = max(int(n * (mean or 0.0)) // CELL_VALUES + 1, min(partitions(spark), n // CELL + 1))
    schema, names = "cell int, dim int, query boolean, ids binary, x binary, tau binary", ["cell", "dim", "query", "ids", "x", "tau"]
    kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]

    def packed(cell: int, d: int, query: bool, ids: np.ndarray, x: np.ndarray, tau: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((cell, d, query, ids.tobytes(), _packed(x), tau), kinds)], names)

    def candidates(batches):
        from pyspark import TaskContext

        # Blocks go to one cell after the other, from another first cell in each task.
        at = TaskContext.get().partitionId() * 7919
        for i, (d, ids, x) in enumerate(_blocks(batches, min(block, BLOCK))):
            yield packed((at + i) % cells, d, False, ids, x, b"")

    def queries_of(batches):
        known, _ = shared.value
        for d, q_ids, q in _blocks(batches, QUERY_BLOCK):
            tau = np.full(len(q), -np.inf)
            if d in known and len(known[d][0]) > k and np.abs(known[d][1]).max() * np.abs(q).max() * d < EXACT:
                ids, x = known[d]
                score = q @ x.T
                score[q_ids[:, None] == ids[None, :]] = -np.inf
                tau = np.partition(score, -k, axis=1)[:, -k]
            yield packed(0, d, True, q_ids, q, tau.tobytes())

    def search(batches):
        _, centres = shared.value
        key, held, cell = None, [], None
        for batch in batches:
            for row in range(batch.num_rows):
                at, d, query, raw_ids, raw, tau = (c[row].as_py() for c in batch.columns)
                if (at, d) != key:
                    key, held, cell = (at, d), [], None
                ids = np.frombuffer(raw_ids, np.int64)
                x = _unpacked(raw, len(ids), d)
                if not query:
                    held.append((ids, x))
                    continue
                if held:
                    c_ids, c_x = (np.concatenate(c) for c in zip(*held))
                    held = []
                    cell = _Cell(c_ids, c_x, *_table(c_x, pivots_of(centres, d)), pivots_of(centres, d))
                if cell is not None:
                    of, found, score, _ = cell.best(ids, x, np.frombuffer(tau, np.float64), k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[of]), pa.array(cell.ids[found]), pa.array(score)], ["query_id", "vec_id", "score"])

    # The candidates of a cell come first, then every block of queries.
    cands = clean.mapInArrow(lean(candidates), schema)
    asked = clean.where(is_query).repartition(max(1, partitions(spark) // 8), F.xxhash64("vec_id")).mapInArrow(lean(queries_of), schema)
    asked = asked.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))).select(*names)
    met = cands.union(asked).repartitionById(cells, F.col("cell")).sortWithinPartitions("cell", "dim", "query")
    found = met.mapInArrow(lean(search), "query_id long, vec_id long, score long")
    # Ranks up to k only: Spark keeps k rows a query and task before the exchange.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """Pivots: each next one is the vector farthest from those chosen before."""
    chosen = [0]
    d = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(x)):
        chosen.append(int(d.argmax()))
        d = np.minimum(d, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
