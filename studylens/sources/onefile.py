"""A Spark data source that delivers one CSV file instead of a folder of parts.

Tasks write parts beside the file, in parallel, and the commit strings them together in order of the partitions
under a temporary name, in pieces of bounded size, and moves the result to its place. So readers never see
half a file, and a failed or repeated task leaves nothing in it. The last step is one
process: this is the sink for files that people open; write a folder where that is too slow.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

# The writer runs in Python workers, which need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "one_csv"
COPY_BYTES = 8 << 20
# White space at the ends of a cell is part of it; a quote in a cell is doubled.
CSV_OPTIONS = {"escape": '"', "emptyValue": '""', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


@dataclass
class Part(WriterCommitMessage):
    number: int
    name: str


class OneCsvWriter(DataSourceArrowWriter):
    def __init__(self, path: str, header: str, overwrite: bool):
        self.path, self.header, self.overwrite = path, header, overwrite
        folder, _, name = path.rpartition("/")
        self.parts = f"{folder}/.{name}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        number = TaskContext.get().partitionId()
        store, place = fs.FileSystem.from_uri(self.parts)
        store.create_dir(place, recursive=True)
        name = f"{number:07d}-{uuid.uuid4().hex}"
        with store.open_output_stream(f"{place}/{name}") as out:
            for batch in iterator:
                if batch.num_rows:
                    out.write(("\n".join(batch.column(0).to_pylist()) + "\n").encode())
        return Part(number, name)

    def commit(self, messages: list[Part | None]) -> None:
        store, place = fs.FileSystem.from_uri(self.path)
        _, parts = fs.FileSystem.from_uri(self.parts)
        store.create_dir(parts, recursive=True)
        try:
            if not self.overwrite and store.get_file_info(place).type != fs.FileType.NotFound:
                raise FileExistsError(self.path)
            whole = f"{parts}/whole"
            with store.open_output_stream(whole) as out:
                out.write((self.header + "\n").encode())
                for part in sorted(filter(None, messages), key=lambda m: m.number):
                    with store.open_input_stream(f"{parts}/{part.name}") as rows:
                        while piece := rows.read(COPY_BYTES):
                            out.write(piece)
            store.move(whole, place)
        finally:
            store.delete_dir(parts)

    def abort(self, messages: list[Part | None]) -> None:
        store, parts = fs.FileSystem.from_uri(self.parts)
        if store.get_file_info(parts).type == fs.FileType.Directory:
            store.delete_dir(parts)


class OneCsv(DataSource):
    """Rows of one text column, each a line of CSV, below the line given as option ``header``; see ``write_one_csv``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        raise NotImplementedError("read the file with spark.read.csv")

    def writer(self, schema: StructType, overwrite: bool) -> OneCsvWriter:
        return OneCsvWriter(self.options["path"], self.options["header"], overwrite)


def write_one_csv(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """The rows as one CSV file with a header, in the order of the partitions.

    Null is an empty cell, an empty text is a pair of quotes. Unless ``overwrite``, the file must not exist.
    """
    df.sparkSession.dataSource.register(OneCsv)
    header = ",".join('"' + c.replace('"', '""') + '"' if set(c) & set(',"\r\n') else c for c in df.columns)
    cells = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)])
    lines = df.select(F.to_csv(cells, CSV_OPTIONS).alias("line"))
    lines.write.format(FORMAT).option("header", header).mode("overwrite" if overwrite else "append").save(path)
