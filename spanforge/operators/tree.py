"""Display order of trees by pointer doubling: no task walks or holds a tree.

A tour enters each span, goes through its children by start, and leaves it.  Each step of the tour knows the step before;
each round lets a step look as far back again as it has looked already, so after as many rounds as a tour's length has
binary digits every step knows how many steps, and how many entrances, lie before it: the entrances are the span's
position, entrances less exits its depth.  Every step is looked up by one other, so no key is hot.  The tours of
spans below a cycle of parents have no first step and never end; a round in which nothing else ends shows that.

A span hangs below the first holder of the id that it names as its parent.  That is what a walk does too, but where
spans with one id, named as a parent, name different parents themselves: which of them comes first then depends on the
walk, and their traces are given back to be walked.

Spans, rounds and places are tables in a scratch folder.  Tables of rounds are deleted when nothing reads them; the spans,
and the steps that have ended in each round, are read by the result and stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..streaming.live import scratch

STEPS = "step long, before long, enters long, length long"


class _Tables:
    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, scratch(spark, name)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.read(df.schema, name)

    def read(self, schema, *names: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{n}" for n in names))

    def drop(self, name: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _tour(linked: DataFrame) -> DataFrame:
    """Steps of the tours (2n enters span n, 2n + 1 leaves it), each with the step before; the first of a trace has none."""
    n, up = F.col("n"), F.col("up")
    enter = linked.select((2 * n).alias("step"), F.coalesce(2 * F.col("left") + 1, 2 * up).alias("before"))
    # A span is left after its last child has been, or right after it was entered: the latter steps are even.
    ends = F.array(F.struct((2 * n + 1).alias("step"), (2 * n).alias("before")), F.struct((2 * up + 1).alias("step"), F.when(F.col("last"), 2 * n + 1).alias("before")))
    left = linked.select(F.explode(ends).alias("e")).select("e.*").where("step is not null and before is not null")
    left = left.groupBy("step").agg(F.coalesce(F.max(F.when(F.col("before") % 2 == 1, F.col("before"))), F.max("before")).alias("before"))
    entered = F.when(F.col("before").isNull(), 0).otherwise(1 - F.col("before") % 2)
    return enter.unionByName(left).select("step", "before", entered.cast("long").alias("enters"), F.col("before").isNotNull().cast("long").alias("length"))


def _look_back(steps: DataFrame, tables: _Tables) -> tuple[DataFrame, bool]:
    """(steps that have ended, with all that lies before them; whether some never end)."""
    done, going = ["ended-0"], "going-0"
    tables.keep(steps.where("before is null"), "ended-0")
    left = tables.keep(steps.where("before is not null"), "going-0").count()
    turn = 0
    while left:
        turn += 1
        on = tables.read(STEPS, going)
        there = tables.read(STEPS, going, *done).select(F.col("step").alias("before"), *(F.col(c).alias(f"_{c}") for c in ("before", "enters", "length")))
        further = on.join(there, "before").select("step", F.col("_before").alias("before"), (F.col("enters") + F.col("_enters")).alias("enters"), (F.col("length") + F.col("_length")).alias("length"))
        # One pass writes both parts.
        further.withColumn("part", F.when(F.col("before").isNull(), "ended").otherwise("going")).write.mode("overwrite").partitionBy("part").parquet(f"{tables.folder}/turn-{turn}")
        tables.drop(going)
        now = tables.spark.read.schema(f"{STEPS}, part string").parquet(f"{tables.folder}/turn-{turn}").where("part = 'going'").count()
        if now < left:
            done.append(f"turn-{turn}/part=ended")
        going = f"turn-{turn}/part=going"
        if now == left:
            break
        left = now
    if left:
        tables.drop(going)
    return tables.read(STEPS, *done), left > 0


def preorder(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rows with ``position`` and ``depth``, rows of traces that have to be walked or None).

    ``rows``: trace_id, span_id and parent_span_id (no nulls, '' is none), start_ms, ord (arrival) and any others.  Children
    and roots are ordered by start, then arrival; spans that no root reaches come last, as they arrived, with depth 0.
    """
    tables = _Tables(rows.sparkSession, "tree")
    nodes = tables.keep(rows.withColumn("n", F.monotonically_increasing_id()), "nodes")
    first = F.min(F.struct("start_ms", "ord", "n"))["n"]
    holders = nodes.where("span_id != ''").groupBy("trace_id", F.col("span_id").alias("parent_span_id")).agg(first.alias("up"), (F.min("parent_span_id") != F.max("parent_span_id")).alias("several"))
    hung = nodes.select("trace_id", "parent_span_id", "start_ms", "ord", "n").join(holders, ["trace_id", "parent_span_id"], "left")
    siblings = Window.partitionBy("trace_id", "up").orderBy("start_ms", "ord", "n")
    linked = tables.keep(hung.select("trace_id", "n", "up", F.coalesce("several", F.lit(False)).alias("several"), F.lag("n").over(siblings).alias("left"), F.lead("n").over(siblings).isNull().alias("last")), "linked")
    unclear = linked.where("several").select("trace_id").distinct()
    walk = None
    if not unclear.isEmpty():
        unclear = tables.keep(unclear, "unclear")
        walk = nodes.join(unclear, "trace_id", "left_semi").drop("n")
        nodes, linked = (df.join(unclear, "trace_id", "left_anti") for df in (nodes, linked))
    ended, endless = _look_back(_tour(linked), tables)
    tables.drop("linked")
    places = ended.where("step % 2 = 0").select((F.col("step") / 2).cast("long").alias("n"), F.col("enters").cast("int").alias("position"), (2 * F.col("enters") - F.col("length")).cast("int").alias("depth"))
    if not endless:
        return nodes.join(places, "n").drop("n"), walk
    found = nodes.join(places, "n", "left").drop("n")
    reached = found.groupBy("trace_id").agg(F.count("position").alias("_reached"))
    number = F.row_number().over(Window.partitionBy("trace_id").orderBy("ord"))
    lost = found.where("position is null").withColumn("position", number).join(reached, "trace_id").withColumn("position", (F.col("_reached") + F.col("position") - 1).cast("int")).withColumn("depth", F.lit(0))
    return found.where("position is not null").unionByName(lost.drop("_reached")), walk
