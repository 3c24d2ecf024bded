"""Sharding: contiguous shards of near-equal bytes from global prefix sums (DataFrame operations only).

The rows are range-partitioned in a total order; each partition's totals give its offset, a running sum
inside the partition gives each row's global byte position, and equal targets cut the positions into shards.
No task ever holds more than one range, and what is broadcast is one row a range.

Defined results: a null text has no bytes and counts as the overhead alone; repeated rows and ties each get a
slot of their own; a null id sorts first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, read

OVERHEAD = 16


def shard(docs: DataFrame, shards: int = 40, ranges: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; law ``bytes``: sizes near equal.

    A row goes to the shard in which the middle of its byte span lies, so no shard is off its target by more
    than the largest row.
    """
    spark = docs.sparkSession
    ranges = ranges or partitions(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    order = ["doc_id", "text_crc32", "size"]
    # Equal rows are told apart by where they were read, so that a row that repeats a billion times is split too.
    tied = sized.withColumn("tie", F.monotonically_increasing_id())
    # Ids of partitions are only stable once written: later plans may coalesce them differently.
    ranged = materialize(tied.repartitionByRange(ranges, *order, "tie").withColumn("part", F.spark_partition_id()), "shard-ranges")
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    all_parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(all_parts).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order, "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    row = Window.partitionBy("part").orderBy(*order, "tie")
    # One row a range, and the number of ranges is a setting: a bounded broadcast.
    placed = (
        ranged.withColumn("upto", F.sum("size").over(inside))
        .withColumn("nth", F.row_number().over(row))
        .join(F.broadcast(starts), "part")
        .withColumn("twice_middle", 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size"))
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("twice_middle").cast("decimal(38,0)") * shards / (2 * F.col("all_bytes")).cast("decimal(38,0)"))).cast("int"))
        .withColumn("row_at", F.col("rows_before") + F.col("nth") - 1)
    )
    placed = materialize(placed.select(*order, "shard", "row_at"), "shard-placed")
    firsts = placed.groupBy("shard").agg(F.min("row_at").alias("first_row"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row_at") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"))


OP7_SQL = """
WITH bits AS (
  SELECT list(crc ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END, i) AS crc FROM (SELECT unnest(range(256)) AS i))
), d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), s AS (
  SELECT r, doc_id, len(h) // 2 + 16 AS size,
    xor(4294967295, list_reduce(list_transform(range(1, len(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8), CAST(4294967295 AS BIGINT))) AS text_crc32
  FROM d, bits
), p AS (
  SELECT *, sum(size) OVER w - size AS before, sum(size) OVER () AS total, row_number() OVER w - 1 AS n FROM s WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)
), q AS (SELECT *, least(39, ((2 * before + size) * 40) // (2 * total)) AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(n - min(n) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM q
"""
