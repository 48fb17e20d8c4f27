"""A whole study: four domain tables in, one findings table out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.text import null_or_blank
from ..operators.findings import merge
from ..operators.rowid import ROW_INDEX, with_row_index
from ..rules.domains import catalog
from .cross import OwnRules, fused_findings, planned_rules
from .domains import DUPLICATE_MODES, duplicate_hit, row_hits, table_notes


def _own_rules(df: DataFrame, domain: str, judged: bool, dm_profile: str, duplicates: str) -> OwnRules:
    if not judged:
        return OwnRules([], [])
    repeated = None
    if domain == "DM" and "USUBJID" in df.columns:
        mask = "n_DM > 1" if duplicates == "all" else f"n_DM > 1 AND {ROW_INDEX} > DM_least_row"
        # Blank ids are no keys in the domain profile.
        repeated = duplicate_hit(mask if dm_profile == "sdtm" else f"{mask} AND NOT {null_or_blank('USUBJID')}")
    needs = [c for rule in catalog(domain, dm_profile)[0] for c in rule.needs]
    return OwnRules(row_hits(df.columns, domain, dm_profile), needs, repeated)


def validate_study(
    dm: DataFrame,
    vs: DataFrame,
    ae: DataFrame,
    cm: DataFrame,
    dm_profile: str = "sdtm",
    duplicates: str = "all",
    tolerance_days: int = 0,
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """Domain rules, the three links to demographics, and the VS/AE and VS/CM checks, in two scans of each table."""
    if duplicates not in DUPLICATE_MODES:
        raise ValueError(f"mode must be one of {DUPLICATE_MODES}, got {duplicates!r}")
    tables = {d: with_row_index(t) for d, t in {"DM": dm, "VS": vs, "AE": ae, "CM": cm}.items()}
    notes, own = [], {}
    for domain, table in tables.items():
        said, judged = table_notes(table, domain, dm_profile)
        notes += said
        own[domain] = _own_rules(table, domain, judged, dm_profile, duplicates)
    rules, missing = planned_rules(tables, ["VS", "AE", "CM"], vs_ae=True, vs_cm=True, tolerance_days=tolerance_days)
    return merge(dm.sparkSession, [*notes, *missing, fused_findings(tables, rules, own, broadcast_bytes)])
