"""Row rules, and links to a given DM table, on a stream of records, with the same rules as in batch.

Uniqueness, and links to demographics that arrive as a stream, are in ``keyed``; date windows stay batch checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.text import text
from ..operators.findings import Hit, emit
from ..operators.keyed import BROADCAST_BYTES, total_bytes
from ..operators.materialize import materialize
from ..operators.rowid import ROW_INDEX
from ..plans.domains import validate_rows
from ..rules import texts as X

# Copies of the key table where it is too large to broadcast: no task gets a whole hot key.
SLICES = 16


def require_row_index(rows: DataFrame) -> None:
    if ROW_INDEX not in rows.columns:
        raise ValueError(f"a stream needs its own {ROW_INDEX}: positions cannot be counted while rows arrive")


def stream_row_findings(rows: DataFrame, domain: str, dm_profile: str = "sdtm") -> DataFrame:
    """The domain's row rules; stateless, so findings appear with the rows."""
    require_row_index(rows)
    return validate_rows(rows, domain, dm_profile)


def stream_dm_link(rows: DataFrame, dm: DataFrame, domain: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Arriving rows whose subject a given (static) DM table does not know."""
    require_row_index(rows)
    keys = materialize(dm.selectExpr(f"{text('USUBJID')} AS USUBJID").dropna().distinct(), "dm-keys")
    rows = rows.selectExpr(ROW_INDEX, f"{text('USUBJID')} AS USUBJID")
    if total_bytes(keys)[0] <= broadcast_bytes:
        orphans = rows.join(F.broadcast(keys), "USUBJID", "left_anti")
    else:
        copies = keys.selectExpr("USUBJID", f"explode(sequence(0, {SLICES - 1})) AS slice")
        spread = rows.selectExpr("*", f"CAST(pmod(xxhash64({ROW_INDEX}), {SLICES}) AS INT) AS slice")
        orphans = spread.join(copies, ["USUBJID", "slice"], "left_anti")
    severity, field, message = X.DM_LINK_TEXTS["001"]
    hit = Hit(
        "TRUE", X.CROSS_DOMAIN, f"X_DMLINK_{domain}_001", severity, "CROSS", field, message.replace("%s", domain),
        ROW_INDEX, "USUBJID", "USUBJID",
    )
    return emit(orphans, [hit])


def write_stream(findings: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append-only Parquet sink by domain; the caller chooses the trigger and starts it."""
    return (
        findings.writeStream.format("parquet")
        .outputMode("append")
        .partitionBy("domain")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
