"""CSV in and out."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, DataFrameReader, SparkSession

from ..functions.text import quoted
from ..operators.rowid import number_rows, with_row_index, with_split
from .onefile import CSV_OPTIONS, write_one_csv

_BROKEN = "_broken_record"
_SPLIT_CELL = "a quoted cell has a line break: read with multi_line=True"
HEADER_THREADS = 16


def _reader(spark: SparkSession, multi_line: bool) -> DataFrameReader:
    # Without enforceSchema, a file whose header names other columns, or in another order, is an error.
    strict = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').option("enforceSchema", False)
    # An empty cell is null, a pair of quotes an empty text; the default would make both null.
    return strict.option("nullValue", "\x00").option("emptyValue", "")


def _texts(spark: SparkSession, paths: str | list[str], columns: Sequence[str], multi_line: bool) -> DataFrame:
    """Files with one header, every column as text.

    Line by line, a cell with a line break would become two rows. The pieces of such a row have too few cells and
    an odd number of quotes, which is an error; with one column there is nothing to tell it by, so it is read whole.
    """
    # A single column cannot show that a cell was cut.
    multi_line = multi_line or len(columns) < 2
    schema = ", ".join(f"`{c}` STRING" for c in [*columns, _BROKEN])
    reader = _reader(spark, multi_line).schema(schema).option("columnNameOfCorruptRecord", _BROKEN)
    # The cells of a row are counted whichever columns are asked for.
    rows = reader.option("columnPruning", multi_line).csv(paths)
    if multi_line:
        return rows.drop(_BROKEN)
    cut = f"{_BROKEN} IS NOT NULL AND (length({_BROKEN}) - length(replace({_BROKEN}, '\"', ''))) % 2 = 1"
    # Names the row, and so reads a cell: Spark refuses queries that want nothing but broken records.
    said = f"concat({quoted(_SPLIT_CELL)}, '; a row begins with ', coalesce(`{columns[0]}`, ''))"
    return rows.filter(f"CASE WHEN {cut} THEN CAST(raise_error({said}) AS BOOLEAN) ELSE TRUE END").drop(_BROKEN)


def _headers(spark: SparkSession, path: str, multi_line: bool) -> dict[tuple[str, ...], list[str]]:
    """{header: files that have it}, in order of the first such file."""
    files = sorted(spark.read.text(path).inputFiles())

    def header(file: str) -> tuple[str, ...]:
        return tuple(_reader(spark, multi_line).csv(file).columns)

    with ThreadPoolExecutor(HEADER_THREADS) as pool:
        names = list(pool.map(header, files))
    found: dict[tuple[str, ...], list[str]] = {}
    for file, own in zip(files, names, strict=True):
        if own:  # a file without any line has no rows either
            found.setdefault(own, []).append(file)
    return found


def _by_name(spark: SparkSession, path: str, multi_line: bool, numbered: bool) -> DataFrame:
    groups = _headers(spark, path, multi_line)
    if not groups:
        raise ValueError(f"no header in {path}")
    parts = [_texts(spark, files, columns, multi_line) for columns, files in groups.items()]
    if numbered:
        parts = [with_split(p) for p in parts]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return number_rows(union) if numbered else union


def read_table(
    spark: SparkSession, path: str, columns: list[str] | None = None, multi_line: bool = False, by_name: bool = False
) -> DataFrame:
    """A CSV file or folder with header, every column as text and an empty cell as null.

    Types are not inferred: rules judge the text as written, and inference would cost
    a pass over the data. ``columns`` spares reading a header; ``multi_line`` allows line
    breaks in quoted cells, at the price of one task per file, and without it such a cell is an error.
    The files of a folder must have one header, or it is an error; with ``by_name`` each file's header is read and
    columns are matched by name, null where a file lacks one.
    """
    if by_name:
        return _by_name(spark, path, multi_line, numbered=False)
    names = columns if columns is not None else _reader(spark, multi_line).csv(path).columns
    return _texts(spark, path, names, multi_line)


def read_domain(
    spark: SparkSession, path: str, columns: list[str] | None = None, multi_line: bool = False, by_name: bool = False
) -> DataFrame:
    """``read_table`` with ``row_index``, the row's place in the files, files in path order."""
    if by_name:
        return _by_name(spark, path, multi_line, numbered=True)
    return with_row_index(read_table(spark, path, columns, multi_line), from_files=True)


def write_csv(table: DataFrame, path: str) -> None:
    """A folder of CSV parts with headers, as ``read_table`` reads them."""
    table.write.mode("overwrite").option("header", True).options(**CSV_OPTIONS).csv(path)


def write_findings_csv(findings: DataFrame, path: str, one_file: bool = False) -> None:
    """A folder of CSV parts, or with ``one_file`` one file in order of domain, rule and row."""
    if one_file:
        order = [c for c in ("doc_id", "domain", "rule_id", "row_index", "usubjid", "field", "evidence") if c in findings.columns]
        write_one_csv(findings.orderBy(*order), path)
    else:
        write_csv(findings, path)


def write_findings(findings: DataFrame, path: str) -> None:
    """The sink for large studies: Parquet, one folder per domain."""
    findings.write.mode("overwrite").partitionBy("domain").parquet(path)


def stamped_path(folder: str, now: datetime | None = None) -> str:
    return f"{folder.rstrip('/')}/validation_report_{(now or datetime.now()).strftime('%Y-%m-%d_%H-%M-%S')}.csv"
