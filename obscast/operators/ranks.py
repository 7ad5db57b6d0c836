"""Ranks of values in groups of any size: counts of different values, ranges, two levels of sums.

No task sorts a whole group: different values are laid out in ranges of (group, value); a range
knows how many rows lie before it from the sums of the ranges, and only adds up its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obscast.operators.stations import same
from obscast.sources.shared import stored


def value_ranks(rows: DataFrame, keys: list[str], value: str, *extra: Column) -> DataFrame:
    """(keys, value, n, before, total, extra) of each different value of a group.

    n rows have it, `before` rows have smaller ones, the group has `total` rows. extra:
    aggregates over the rows of a value. Rows without a value are left out.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), *extra)
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written once: ranges are chosen from a sample and must be the same for both levels.
    laid = stored(counts.repartitionByRange(ranges, *keys, value).withColumn("range", F.spark_partition_id()), "ranks")
    own = Window.partitionBy(*keys, "range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    sums = laid.groupBy(*keys, "range").agg(F.sum("n").alias("in_range"))
    # As many rows as a group has ranges.
    group = Window.partitionBy(*keys)
    start = F.sum("in_range").over(group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*keys, "range", F.coalesce(start, F.lit(0)).alias("start"), F.sum("in_range").over(group).alias("total"))
    inside = laid.withColumn("inside", F.coalesce(F.sum("n").over(own), F.lit(0))).alias("a")
    found = inside.join(sums.alias("b"), same(inside, sums, [*keys, "range"]))
    kept = [c for c in laid.columns if c not in ("range",)]
    return found.select(*[inside[c] for c in kept], (F.col("start") + F.col("inside")).alias("before"), "total")
