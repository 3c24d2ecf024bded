"""Connected components by minimum labels with pointer jumping, as DataFrames throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(v, label) of every vertex of ``edges`` (a, b); label: the least vertex of its component.

    ``seeds``: labels (v, label) of an earlier call whose edges are among these, to start from.
    Each round takes the least label of the neighbours, then the label of the label, so the number of rounds is
    logarithmic in the length of a path.  Only the labels that are returned stay in the shared folder.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("label")).withColumnRenamed("a", "v")
    if seeds is not None:
        old = seeds.select("v", F.col("label").alias("seed"))
        labels = labels.join(old, "v", "left").select("v", F.least("label", F.coalesce("seed", "label")).alias("label"))
    labels = table = materialize(labels, "labels")
    while True:
        near = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("label").alias("near"))
        stepped = labels.join(near, labels.v == near.a).select("v", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("far"))
        new = materialize(stepped.join(jump, "label", "left").select("v", "was", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        changed = new.where(F.col("was") != F.col("label")).limit(1).count()
        discard(table)
        table, labels = new, new.select("v", "label")
        if not changed:
            discard(both)
            return labels
