"""Fetching the rows that belong to a set of keys, safe under skew.

Checks over groups (uniqueness, orphans, date windows) all work in two steps:

1. reduce the tables to one row per key with an ordinary aggregation. It is
   combined map-side, so a key holding a third of all rows costs one partial row
   per task;
2. keep the keys that break a rule, and fetch only *their* rows.

In step 2 the key table is usually small and is broadcast, but only after its
real size was measured; the big table then is not shuffled at all. Otherwise both
sides are shuffled, and every key that weighs more than a fraction of a partition is cut into
slices in proportion to its weight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024
# A slice has at most 1/SLICES_PER_PARTITION of the rows of an average partition, but need not have fewer
# than SLICE_ROWS rows.
SLICES_PER_PARTITION = 8
SLICE_ROWS = 10_000
ROW_OVERHEAD_BYTES = 64


def row_bytes(table: DataFrame) -> str:
    """SQL for an upper estimate of the in-memory size of a row, from its real values."""
    variable = [f.name for f in table.schema.fields if isinstance(f.dataType, T.StringType)]
    fixed = ROW_OVERHEAD_BYTES + 16 * len(table.columns)
    return " + ".join([f"{fixed}L", *[f"coalesce(octet_length(`{c}`), 0)" for c in variable]])


def total_bytes(table: DataFrame, conditions: Sequence[str] = ("TRUE",)) -> list[int]:
    """Size of the rows under each condition; one pass over a materialized table."""
    size = row_bytes(table)
    sums = [f"coalesce(sum({size}) FILTER (WHERE {c}), 0) AS b{i}" for i, c in enumerate(conditions)]
    return list(table.selectExpr(*sums).first())


def rows_of_keys(
    rows: DataFrame,
    keyed: DataFrame,
    on: Sequence[str],
    weight: str,
    keyed_bytes: int | None = None,
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, which has at most one row per key.

    ``keyed`` must read from a materialized table; ``weight`` is its column with the
    number of rows each key has. ``keyed_bytes`` is its size if already measured. Rows
    need a ``row_index`` that differs within a key.
    """
    on = list(on)
    limit = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    size = total_bytes(keyed)[0] if keyed_bytes is None else keyed_bytes
    if size <= limit:
        return rows.join(F.broadcast(keyed), on)
    return sliced_join(rows, keyed, on, weight)


def slice_rows(keyed: DataFrame, on: Sequence[str], weight: str, max_bytes: int = BROADCAST_BYTES) -> int:
    """Rows that a slice of a key may have.

    A share of an average partition, so keys beyond it number at most SLICES_PER_PARTITION times the
    partitions, whatever the distribution. Should their list still be too large to broadcast, as ids
    are long, slices are made larger.
    """
    partitions = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    target = max(SLICE_ROWS, -(-total // (SLICES_PER_PARTITION * partitions)))
    ids = keyed.select(*on, weight)
    doubled = [target << i for i in range(24)]
    sizes = total_bytes(ids, [f"`{weight}` > {t}L" for t in doubled])
    return next((t for t, size in zip(doubled, sizes, strict=True) if size <= max_bytes), doubled[-1])


def sliced_join(rows: DataFrame, keyed: DataFrame, on: Sequence[str], weight: str) -> DataFrame:
    """Shuffle join in which a key has a slice for every so many of its rows.

    Exact: a row goes to one slice of its key, and the single key row is copied to each of them. The copies
    number the keys plus the rows divided by the rows of a slice.
    """
    on = list(on)
    target = slice_rows(keyed, on, weight)
    named = keyed.dropna(subset=on).withColumn("_slices", F.ceil(F.col(weight) / target).cast("int"))
    copies = named.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.greatest("_slices", F.lit(1)) - 1))).drop("_slices")
    cut = named.filter(f"`{weight}` > {target}L").select(*on, "_slices")
    own = F.pmod(F.xxhash64("row_index"), F.coalesce("_slices", F.lit(1))).cast("int")
    spread = rows.dropna(subset=on).join(F.broadcast(cut), on, "left").withColumn("_slice", own).drop("_slices")
    return spread.join(copies, [*on, "_slice"]).drop("_slice")
