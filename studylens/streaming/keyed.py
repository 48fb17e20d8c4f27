"""Checks that need to remember subjects across the batches of a stream.

State is kept by subject with ``transformWithState`` in Spark's own store, so it survives restarts and grows
with the subjects, not with the rows. What comes out is what the batch checks find in the same rows, in
whatever order they arrive. A subject's rows of one batch pass through one task as a stream, so limit the
size of a batch (``maxFilesPerTrigger``) where one subject may have very many rows.

Spark keeps such state in RocksDB: ``state_store`` sets it for queries that are started inside of it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import null_or_blank, text
from ..operators.findings import Hit, emit
from ..operators.rowid import ROW_INDEX
from ..plans.domains import DUPLICATE_MODES
from ..rules import texts as X
from .findings import require_row_index

# The processors run in Python workers, which need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed checks need, for streams started inside."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class _Duplicates(StatefulProcessor):
    """Remembers the least row number of a subject, and whether that row was reported."""

    def __init__(self, spare_first: bool):
        self.spare_first = spare_first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("least", "row BIGINT, reported BOOLEAN")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        least, reported = self.state.get() if self.state.exists() else (None, False)
        for row in rows:
            number = row[ROW_INDEX]
            if least is None:
                least = number
            elif self.spare_first:
                # All but the least row are repeats; the row that was the least so far may become one.
                yield Row(row_index=max(least, number), USUBJID=key[0])
                least = min(least, number)
            else:
                if not reported:
                    yield Row(row_index=least, USUBJID=key[0])
                    reported = True
                yield Row(row_index=number, USUBJID=key[0])
        self.state.update((least, reported))

    def close(self) -> None:
        pass


def stream_duplicates(dm: DataFrame, mode: str = "all", blank_is_a_key: bool = True) -> DataFrame:
    """SDTM_DM_002 on a stream of demographics: findings appear as soon as a subject's second row does."""
    if mode not in DUPLICATE_MODES:
        raise ValueError(f"mode must be one of {DUPLICATE_MODES}, got {mode!r}")
    require_row_index(dm)
    ids = dm.selectExpr(f"CAST({ROW_INDEX} AS BIGINT) AS {ROW_INDEX}", f"{text('USUBJID')} AS USUBJID")
    ids = ids.filter("USUBJID IS NOT NULL" if blank_is_a_key else f"NOT {null_or_blank('USUBJID')}")
    repeated = ids.groupBy("USUBJID").transformWithState(
        _Duplicates(mode == "repeat"), f"{ROW_INDEX} BIGINT, USUBJID STRING", "Append", "None"
    )
    severity, field, message = X.DM_SDTM_TEXTS["SDTM_DM_002"]
    return emit(repeated, [Hit("TRUE", X.SDTM_RULE, "SDTM_DM_002", severity, "DM", field, message, ROW_INDEX, "USUBJID", "USUBJID")])


class _Links(StatefulProcessor):
    """Remembers whether demographics knows a subject, and which of its rows were reported because it didn't yet."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "yes BOOLEAN")
        self.waiting = handle.getListState("waiting", "row BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        known, orphans = self.known.exists(), []
        for row in rows:
            if row["of_dm"]:
                known = True
            elif not known:
                orphans.append((row[ROW_INDEX],))
        if not known:
            if orphans:
                self.waiting.appendList(orphans)
            for (number,) in orphans:
                yield Row(row_index=number, USUBJID=key[0], retracted=False)
        elif not self.known.exists():
            self.known.update((True,))
            if self.waiting.exists():
                for (number,) in self.waiting.get():
                    yield Row(row_index=number, USUBJID=key[0], retracted=True)
                self.waiting.clear()

    def close(self) -> None:
        pass


def stream_links(dm: DataFrame, rows: DataFrame, domain: str) -> DataFrame:
    """Orphans among arriving rows, where demographics arrives as a stream as well.

    A row is reported while its subject is unknown. Should the subject arrive later, the finding comes once more with
    ``retracted`` true; ``settled`` keeps what stands. Rows without a subject are orphans for good.
    """
    require_row_index(rows)
    own = rows.selectExpr(f"CAST({ROW_INDEX} AS BIGINT) AS {ROW_INDEX}", f"{text('USUBJID')} AS USUBJID", "FALSE AS of_dm")
    subjects = dm.selectExpr(f"CAST(NULL AS BIGINT) AS {ROW_INDEX}", f"{text('USUBJID')} AS USUBJID", "TRUE AS of_dm")
    named = own.union(subjects).filter("USUBJID IS NOT NULL")
    found = named.groupBy("USUBJID").transformWithState(
        _Links(), f"{ROW_INDEX} BIGINT, USUBJID STRING, retracted BOOLEAN", "Append", "None"
    )
    nameless = own.filter("USUBJID IS NULL").selectExpr(ROW_INDEX, "USUBJID", "FALSE AS retracted")
    severity, field, message = X.DM_LINK_TEXTS["001"]
    hit = Hit(
        "TRUE", X.CROSS_DOMAIN, f"X_DMLINK_{domain}_001", severity, "CROSS", field, message.replace("%s", domain),
        ROW_INDEX, "USUBJID", "USUBJID",
    )
    return emit(found.union(nameless), [hit], ["retracted"])


def settled(findings: DataFrame) -> DataFrame:
    """The findings of ``stream_links`` that stand, from what its sink has so far."""
    keys = ["rule_id", "usubjid", "row_index"]
    taken_back = findings.filter("retracted").select(*keys)
    standing = findings.filter("NOT retracted").join(taken_back, keys, "left_anti")
    return standing.select(*[c for c in findings.columns if c != "retracted"])
