"""Exact percentiles by distributed selection: no task holds a group's values.

Values are counted first, equal ones combined before the exchange.  Three descents then find the value at the rank:
each cuts what is left of a group into ordered digits, adds the counts up by digit, and goes on in the digit that
holds the rank.  The first digit is the logarithm's, the second divides the first's own range evenly, the third is the
value.  Whatever the values, a group has 1.6 million logarithms at most on either side of zero, 2**20 parts of a range, and in
a part at most 2**23 numbers; these, and not its rows or distinct values, are what one task sorts.

A digit need only rise with the value, not be exact, so roundings of logarithm and division do no harm.  Every descent
asks for the same columns of the counted values, and by null-safe keys, so that Spark reads them from one exchange.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Logarithms in steps of 1/2048, kept clear of zero by OFFSET (the least double's logarithm is above -746).
STEPS, OFFSET = 2048, 1_600_000
PARTS = 1 << 20


def coarse(value: Column) -> Column:
    """A whole number that rises with a double; NaN comes last, as Spark orders it."""
    of = F.floor(F.log(F.abs(value)) * STEPS) + OFFSET
    return F.when(F.isnan(value), F.lit(2 * 2 * OFFSET)).when(F.abs(value) == float("inf"), F.signum(value) * 3 * OFFSET).when(value == 0, F.lit(0)).otherwise(F.signum(value) * of).cast("long")


def fine(value: Column, low: Column, high: Column) -> Column:
    """The part of the range from ``low`` to ``high`` that a value of it lies in."""
    # Halves, so that the width of no range is infinite.
    share = (value / 2 - low / 2) / (high / 2 - low / 2)
    return F.when((high > low) & (F.abs(low) != float("inf")) & ~F.isnan(high), F.floor(share * PARTS)).otherwise(F.lit(0)).cast("long")


def _before(rows: DataFrame, by: list[str], digit: str) -> DataFrame:
    """Adds how many values of the group come before each digit, ``_below``, and how many have come with it, ``_upto``."""
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy(digit).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_upto", upto).withColumn("_below", F.col("_upto") - F.col("n"))


def at_ranks(rows: DataFrame, by: list[str], value: str, ranks: dict[str, float], sums: dict[str, Column] | None = None, most: str | None = None) -> DataFrame:
    """by, n, ``sums``, ``most`` and for each name of ``ranks`` the value at rank ceil(p * n) of the group, as a double.

    Rows without a value take no part.  ``sums``: aggregates of whole numbers that add up, such as counts; ``most``:
    the name that the largest value shall have.
    """
    sums = sums or {}
    keys = [f"_k{i}" for i in range(len(by))]
    keyed = rows.where(F.col(value).isNotNull()).withColumns({k: F.col(b) for k, b in zip(keys, by)} | {"v": F.col(value).cast("double") + 0.0})
    counted = keyed.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"), *(c.alias(s) for s, c in sums.items()))
    asked = functools.reduce(operator.and_, (F.col(s) >= 0 for s in sums), F.col("n") > 0)  # all columns in each descent
    counted = counted.where(asked).withColumn("d", coarse(F.col("v")))
    same = lambda left, right: functools.reduce(operator.and_, (F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)))
    group = Window.partitionBy(*keys)

    first = counted.groupBy(*keys, "d").agg(F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in sums), F.min("v").alias("low"), F.max("v").alias("high"))
    whole = {"_n": F.sum("n").over(group)} | {f"_{s}": F.sum(s).over(group) for s in sums} | {"_most": F.max("high").over(group)}
    first = _before(first.withColumns(whole), keys, "d")
    wanted = F.array(*(F.struct(F.lit(i).alias("i"), F.ceil(F.lit(p) * F.col("_n")).alias("rank")) for i, p in enumerate(ranks.values())))
    here = F.filter(wanted, lambda w: (F.col("_below") < w["rank"]) & (w["rank"] <= F.col("_upto")))
    picked = first.withColumn("w", F.explode(here)).select(*(F.col(k).alias(f"{k}_") for k in keys), F.col("d").alias("d_"), "low", "high", *whole, F.col("w.i").alias("i"), (F.col("w.rank") - F.col("_below")).alias("rest"))

    inside = counted.join(picked, same([*keys, "d"], [*(f"{k}_" for k in keys), "d_"])).withColumn("e", fine(F.col("v"), F.col("low"), F.col("high")))
    second = _before(inside.groupBy(*keys, "i", "e").agg(F.sum("n").alias("n"), F.first("rest").alias("rest")), [*keys, "i"], "e")
    part = second.where((F.col("_below") < F.col("rest")) & (F.col("rest") <= F.col("_upto")))
    part = part.select(*(F.col(k).alias(f"{k}__") for k in keys), F.col("i").alias("i__"), F.col("e").alias("e__"), (F.col("rest") - F.col("_below")).alias("last"))

    third = inside.join(part, same([*keys, "i", "e"], [*(f"{k}__" for k in keys), "i__", "e__"]))
    found = _before(third.select(*keys, "i", "v", "n", *whole, "last"), [*keys, "i"], "v").where((F.col("_below") < F.col("last")) & (F.col("last") <= F.col("_upto")))
    out = found.groupBy(*keys).agg(*(F.first(w).alias(w) for w in whole), *(F.max(F.when(F.col("i") == i, F.col("v"))).alias(name) for i, name in enumerate(ranks)))
    more = [F.col("_most").alias(most)] if most else []
    return out.select(*(F.col(k).alias(b) for b, k in zip(by, keys)), F.col("_n").alias("n"), *(F.col(f"_{s}").alias(s) for s in sums), *more, *ranks)
