"""Running totals over an order, without a window that spans the table."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .materialize import materialize

ROWS_PER_RANGE = 50_000


def ranged(table: DataFrame, keys: Sequence[str], ranges: int, name: str) -> DataFrame:
    """The table, written down in ``ranges`` ranges of the keys, each sorted.

    ``_range`` numbers the ranges in key order, ``_at`` the rows of each.
    """
    dealt = table.repartitionByRange(max(1, ranges), *keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return materialize(dealt.withColumn("_range", F.spark_partition_id()).withColumn("_at", at), name)


def running_total(table: DataFrame, keys: Sequence[str], value: str, name: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Adds ``name``, the sum of ``value`` over all rows before, in order of ``keys``, which are unique.

    Two levels: sums inside of each range by a window over that range alone, and the sums of whole
    ranges, of which there is one for ``rows_per_range`` rows. ``table`` should read from files, as it
    is counted first; beyond one range it is written down in ranges.
    """
    spark = table.sparkSession
    ranges = -(-table.count() // rows_per_range)
    inside = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum(value).over(inside), F.lit(0)).cast("long")
    if ranges <= 1:
        return table.withColumn("_range", F.lit(0)).withColumn(name, local).drop("_range")
    dealt = ranged(table, keys, ranges, "running-total")
    totals = dealt.groupBy("_range").agg(F.sum(value).alias("t")).orderBy("_range").collect()
    before = [0, *accumulate(r["t"] or 0 for r in totals)]
    bases = [(r["_range"], int(b)) for r, b in zip(totals, before, strict=False)]
    known = F.broadcast(spark.createDataFrame(bases, "_range int, _base long"))
    return dealt.withColumn("_local", local).join(known, "_range").select(*table.columns, (F.col("_base") + F.col("_local")).alias(name))
