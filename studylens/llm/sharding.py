"""Sharding by weighted rendezvous hashing, with DataFrame functions only.

A record key scores every shard with a hash of (key, shard); the smallest weighted score
wins. A further shard can only win records for itself, so growing from n to n + 1 shards
moves about 1/(n + 1) of the records and none between old shards.

Defined cases: a null key is a key of its own (rows without a key go to one shard); repeated
rows go to the same shard and get slots of their own; an empty table gives an empty result;
other columns of any name are kept by ``assign_shards`` and ignored by ``number_slots``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.materialize import materialize

GROUPS_PER_BUCKET = 50_000  # rows that one sort of number_slots sees, on average
COPIES_PER_TASK = 100_000  # equal rows written out by one task


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, of a record key; ``weights`` has one positive number per shard.

    Score of a shard: -ln(u) / weight, u in (0, 1) from the first 52 bits of the MD5 of
    "key:shard". The least score wins, ties go to the smaller shard.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one for each shard")
    text = F.coalesce(key.cast("string"), F.lit("\u0000null"))

    def score(shard: int, weight: float) -> Column:
        head = F.substring(F.md5(F.concat(text, F.lit(f":{shard}"))), 1, 13)
        u = (F.conv(head, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))
        return F.struct((-F.log(u) / F.lit(float(weight))).alias("score"), F.lit(shard).alias("shard"))

    scores = [score(i, w) for i, w in enumerate(weights)]
    return (F.least(*scores) if len(scores) > 1 else scores[0])["shard"].cast("int")


def assign_shards(table: DataFrame, key: str, weights: Sequence[float], name: str = "shard") -> DataFrame:
    """The table with its shard in column ``name``; narrow, nothing is shuffled."""
    return table.withColumn(name, shard_of(F.col(f"`{key}`"), weights))


def write_shards(table: DataFrame, key: str, weights: Sequence[float], path: str) -> None:
    """Writes each shard to a folder ``shard=N`` below ``path``."""
    assign_shards(table, key, weights).write.partitionBy("shard").parquet(path)


def number_slots(table: DataFrame, shard: str, columns: Sequence[str]) -> DataFrame:
    """``columns`` and ``shard`` of every row, with its gapless place ``slot`` in its shard.

    Equal rows are counted first (map-side), so a key that repeats without bound is one row
    until the last step. Rows are numbered in hash buckets of bounded size whose offsets come
    from a table with one row per bucket; no window spans a shard. The order does not depend
    on how the data is partitioned.
    """
    columns = list(columns)
    spark = table.sparkSession
    groups = table.groupBy(shard, *columns).agg(F.count(F.lit(1)).alias("_copies"))
    groups = materialize(groups, "slot-groups")
    buckets = max(1, -(-groups.count() // GROUPS_PER_BUCKET))
    groups = groups.withColumn("_bucket", F.pmod(F.xxhash64(*columns), F.lit(buckets)))
    sizes = groups.groupBy(shard, "_bucket").agg(F.sum("_copies").alias("_rows"))
    # One row per bucket and shard: 1 / GROUPS_PER_BUCKET of the table, ordered within a shard.
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col(shard).alias("_shard"), F.col("_bucket").alias("_at"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(shard, "_bucket").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    numbered = groups.withColumn("_start", F.coalesce(F.sum("_copies").over(inside), F.lit(0)))
    numbered = numbered.join(offsets, (F.col(shard) == F.col("_shard")) & (F.col("_bucket") == F.col("_at")))
    first = F.col("_start") + F.col("_offset")
    parts = numbered.select(
        shard, *columns, first.alias("_first"), "_copies",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(COPIES_PER_TASK).cast("long"))).alias("_part"),
    )
    parts = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_first", "_part")
    last = F.least(F.col("_part") + COPIES_PER_TASK, F.col("_copies")) - 1
    return parts.select(shard, *columns, F.explode(F.sequence(F.col("_first") + F.col("_part"), F.col("_first") + last)).alias("slot"))
