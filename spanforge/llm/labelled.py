"""Labelled rows to learn from: a bounded, documented sample that follows the hash of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus, F.lit(-1)).cast("int")


def sample(labels: DataFrame, column: str, learn: Column, limit: int) -> DataFrame:
    """(doc_id, y) of at most ``limit`` ids to learn from, in the order of a hash of the id.

    Rows without id or label are left out; the label of an id with several rows is their majority's, at a tie 1.
    """
    clean = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & learn)
    one = clean.groupBy("doc_id").agg((F.avg(F.col(column).cast("double")) >= 0.5).cast("int").alias("y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def balanced(labels: DataFrame, column: str, learn: Column, limit: int) -> tuple[DataFrame, tuple[int, int]]:
    """``sample`` with at most half of ``limit`` from either label, and the numbers of ids with label 0 and 1."""
    clean = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & learn)
    one = clean.groupBy("doc_id").agg((F.avg(F.col(column).cast("double")) >= 0.5).cast("int").alias("y"))
    totals = dict(one.groupBy("y").count().collect())
    half = [one.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit // 2) for y in (0, 1)]
    return half[0].union(half[1]), (totals.get(0, 0), totals.get(1, 0))


def texts(docs: DataFrame, sampled: DataFrame) -> DataFrame:
    """(doc_id, text, y): the documents of the sample, which is small enough to send to every task."""
    return docs.select("doc_id", "text").join(F.broadcast(sampled), "doc_id")
