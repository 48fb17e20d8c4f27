"""Checks of one domain table: row rules, required columns, uniqueness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import null_or_blank, text
from ..operators.findings import Hit, dataset_finding, emit, merge
from ..operators.keyed import rows_of_keys
from ..operators.materialize import materialize
from ..operators.rowid import ROW_INDEX, with_row_index
from ..rules import texts as X
from ..rules.domains import catalog

DUPLICATE_MODES = ("all", "repeat")


def missing_columns(columns: Sequence[str], required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in columns]


def row_hits(columns: Sequence[str], domain: str, dm_profile: str = "sdtm") -> list[Hit]:
    """The row rules that apply to a table with these columns."""
    rules, texts = catalog(domain, dm_profile)
    usubjid = "USUBJID" if "USUBJID" in columns else "''"
    return [
        Hit(
            rule.violated, X.SDTM_RULE, rule.rule_id, severity, domain, field, message,
            ROW_INDEX, usubjid, rule.evidence,
        )
        for rule in rules
        if not missing_columns(columns, rule.needs)
        for severity, field, message in [texts[rule.rule_id]]
    ]


def validate_rows(df: DataFrame, domain: str, dm_profile: str = "sdtm", carry: Sequence[str] = ()) -> DataFrame:
    """Row rules only: one narrow pass, so it also works on a streaming DataFrame."""
    return emit(df, row_hits(df.columns, domain, dm_profile), carry)


def duplicate_subjects(
    dm: DataFrame,
    mode: str = "all",
    blank_is_a_key: bool = True,
    on: Sequence[str] = ("USUBJID",),
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """SDTM_DM_002. ``all`` reports every row of a duplicate group, ``repeat`` spares the first.

    Counting is an aggregation, not a window: a window would bring all rows of a
    key into one task.
    """
    if mode not in DUPLICATE_MODES:
        raise ValueError(f"mode must be one of {DUPLICATE_MODES}, got {mode!r}")
    ids = dm.selectExpr(ROW_INDEX, *[f"{text(c)} AS {c}" if c == "USUBJID" else c for c in on])
    ids = ids.filter("USUBJID IS NOT NULL" if blank_is_a_key else f"NOT {null_or_blank('USUBJID')}")
    groups = ids.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"), F.min(ROW_INDEX).alias("_first"))
    repeated = materialize(groups.filter("_rows > 1"), "duplicate-keys")
    rows = rows_of_keys(ids, repeated, on, weight="_rows", broadcast_bytes=broadcast_bytes)
    return emit(rows, [duplicate_hit("TRUE" if mode == "all" else f"{ROW_INDEX} > _first")], [c for c in on if c != "USUBJID"])


def duplicate_hit(mask: str) -> Hit:
    severity, field, message = X.DM_SDTM_TEXTS["SDTM_DM_002"]
    return Hit(mask, X.SDTM_RULE, "SDTM_DM_002", severity, "DM", field, message, ROW_INDEX, "USUBJID", "USUBJID")


def _required_columns_finding(df: DataFrame, domain: str) -> DataFrame | None:
    missing = missing_columns(df.columns, X.REQUIRED[domain])
    if not missing:
        return None
    # A DM table with missing columns is reported under the cross-domain type.
    finding_type = X.SDTM_RULE if domain in ("VS", "AE", "CM") else X.CROSS_DOMAIN
    return dataset_finding(
        df.sparkSession, finding_type, f"SDTM_{domain}_000", "CRIT", domain,
        ",".join(missing), f"Missing required columns for {domain}: {missing}",
    )


def table_notes(df: DataFrame, domain: str, dm_profile: str = "sdtm") -> tuple[list[DataFrame], bool]:
    """(findings about the table as a whole, whether its rows can be judged)."""
    spark = df.sparkSession
    if domain != "DM" or dm_profile == "domain":
        fatal = _required_columns_finding(df, domain)
        if fatal is not None:
            return [fatal], False
    if domain == "VS" and "VSORRESU" not in df.columns:
        severity, field, message = X.VS_UNIT_COLUMN_ABSENT
        return [dataset_finding(spark, X.SDTM_RULE, "SDTM_VS_005", severity, "VS", field, message)], True
    if domain == "DM" and "USUBJID" not in df.columns:
        severity, field, message = X.DM_SDTM_NO_USUBJID
        return [dataset_finding(spark, X.SDTM_RULE, "SDTM_DM_001", severity, "DM", field, message)], True
    return [], True


def _validate_table(df: DataFrame, domain: str, dm_profile: str = "sdtm", duplicates: str = "all") -> DataFrame:
    notes, judged = table_notes(df, domain, dm_profile)
    if judged:
        df = with_row_index(df)
        notes.append(validate_rows(df, domain, dm_profile))
        if domain == "DM" and "USUBJID" in df.columns:
            notes.append(duplicate_subjects(df, duplicates, blank_is_a_key=dm_profile == "sdtm"))
    return merge(df.sparkSession, notes)


def validate_vs(vs: DataFrame) -> DataFrame:
    return _validate_table(vs, "VS")


def validate_ae(ae: DataFrame) -> DataFrame:
    return _validate_table(ae, "AE")


def validate_cm(cm: DataFrame) -> DataFrame:
    return _validate_table(cm, "CM")


def validate_dm(dm: DataFrame, profile: str = "sdtm", duplicates: str = "all") -> DataFrame:
    """Demographics. Two rule sets share ids but not meaning, hence ``profile``:

    ``sdtm`` is what the study jobs run; ``domain`` also checks AGEU, RFENDTC and the
    order of the reference dates, and treats a missing STUDYID column as fatal.
    """
    return _validate_table(dm, "DM", profile, duplicates)
