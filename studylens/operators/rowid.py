"""Row identity for tables that come without a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .materialize import materialize
from .prefix import running_total

ROW_INDEX = "row_index"
_SPLIT = ["_file", "_block"]
# Offsets of so many splits are broadcast: a row of the hash table takes some hundred bytes.
BROADCAST_SPLITS = 1_000_000


def with_row_index(df: DataFrame, from_files: bool = False) -> DataFrame:
    """Adds a contiguous 0-based ``row_index`` unless the table already has one.

    With ``from_files``, for a table that is a plain file scan, the index follows the rows'
    order in the files, files in path order. Where the format knows a row's place in its file (Parquet),
    the rows of each file are counted and nothing is written; else the table is written once, with the split that
    each row came from. Rows are neither sorted nor shuffled: a row's index is the offset of its file or split
    plus its place there, whatever the splits of later scans.

    Any other table might deliver its rows in another order when it is computed again, so
    it is written down first, and the index follows the partitions as they were written.
    A stable key from the source is better than either.
    """
    if ROW_INDEX in df.columns:
        return df
    if from_files:
        placed = _with_place(df)
        return number_rows(with_split(df)) if placed is None else _number(placed, ["_file"], "_id")
    return number_rows(df.selectExpr("*", "'' AS _file", "CAST(spark_partition_id() AS BIGINT) AS _block", "monotonically_increasing_id() AS _id"))


def with_split(df: DataFrame) -> DataFrame:
    """A file scan with the file and block that each row came from, and its order there."""
    return df.selectExpr("*", "_metadata.file_path AS _file", "_metadata.file_block_start AS _block", "monotonically_increasing_id() AS _id")


def _with_place(df: DataFrame) -> DataFrame | None:
    """A file scan with each row's file and its place in it, if the format tells."""
    if ROW_INDEX not in df.select("_metadata").schema["_metadata"].dataType.names:
        return None
    return df.selectExpr("*", "_metadata.file_path AS _file", "_metadata.row_index AS _id")


def number_rows(tagged: DataFrame) -> DataFrame:
    """Rows of ``with_split`` (also a union of several) with ``row_index`` in place of the tags."""
    # Written once with its tags: a second scan could be split otherwise and lose rows in the join.
    return _number(materialize(tagged, "numbered-rows"), _SPLIT, "_id")


def _number(tagged: DataFrame, split: list[str], place: str) -> DataFrame:
    columns = [f"`{c}`" for c in tagged.columns if c not in (*_SPLIT, place)]
    counts = tagged.groupBy(*split).agg(F.count(F.lit(1)).alias("_rows"), F.min(place).alias("_first"))
    counts = materialize(counts, "row-counts")
    # Two levels of sums, so no window sees all splits; and the data never moves while the list is small.
    offsets = running_total(counts, split, "_rows", "_offset").select(*split, "_first", "_offset")
    if counts.count() <= BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    return tagged.join(offsets, split).selectExpr(f"CAST(_offset + {place} - _first AS BIGINT) AS {ROW_INDEX}", *columns)
