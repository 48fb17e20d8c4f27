"""Checks between domains, all answered from one table with a row per subject."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import iso_date, joined, text
from ..operators.findings import Hit, dataset_finding, emit, merge
from ..operators.keyed import BROADCAST_BYTES, rows_of_keys, total_bytes
from ..operators.materialize import materialize
from ..operators.rowid import ROW_INDEX, with_row_index
from ..rules import texts as X

START_DATE = {"VS": "VSDTC", "AE": "AESTDTC", "CM": "CMSTDTC"}
END_DATE = {"CM": "CMENDTC"}


@dataclass(frozen=True)
class CrossRule:
    """Rows of domain ``of`` judged by what the subject has in domain ``against``.

    ``subject`` holds for every subject that may own a violating row; ``row`` then
    decides per row. ``measures`` are the columns of the subject profile both rest on.
    ``orphan`` rules also fire on rows without a subject id.
    """

    rule_id: str
    of: str
    against: str
    subject: str
    row: str
    evidence: str
    measures: tuple[str, ...]
    orphan: bool = False


def orphan_rule(rule_id: str, of: str, against: str) -> CrossRule:
    absent = f"n_{against} = 0"
    return CrossRule(rule_id, of, against, absent, absent, "USUBJID", (f"n_{against}",), orphan=True)


def outside_range_rule(rule_id: str, of: str, against: str, tolerance_days: int = 0) -> CrossRule:
    """Date before the first or after the last date the subject has in ``against``."""
    first, last = f"{against}_first", f"{against}_last"

    def beyond(earliest: str, latest: str) -> str:
        # Without a last date there is no window to be outside of.
        return (
            f"{last} IS NOT NULL AND ({earliest} < date_sub({first}, {tolerance_days})"
            f" OR {latest} > date_add({last}, {tolerance_days}))"
        )

    return CrossRule(
        rule_id, of, against,
        subject=beyond(f"{of}_first", f"{of}_latest_start"),
        row=beyond(f"({iso_date('_raw')})", f"({iso_date('_raw')})"),
        evidence=joined("_raw", "' vs ['", text(first), "', '", text(last), "']'"),
        measures=(f"{of}_first", f"{of}_latest_start", first, last),
    )


def _subject_rows(df: DataFrame, domain: str, on: Sequence[str]) -> DataFrame:
    """Only the columns that cross checks need, as written: dates are parsed where they are used."""
    started, ended = START_DATE.get(domain), END_DATE.get(domain, START_DATE.get(domain))
    keys = [f"{text(c)} AS {c}" if c == "USUBJID" else c for c in on]
    dates = [text(c) if c in df.columns else "CAST(NULL AS STRING)" for c in (started, ended)]
    return df.selectExpr(*keys, ROW_INDEX, f"{dates[0]} AS _raw", f"{dates[1]} AS _raw_end")


def _measure(name: str, domain: str) -> str | None:
    """SQL of a profile column; each rests on one column that only its own domain fills."""
    return {
        f"n_{domain}": f"count(in_{domain})",
        f"{domain}_first": f"min({domain}_start)",
        f"{domain}_latest_start": f"max({domain}_start)",
        f"{domain}_last": f"max({domain}_end)",
        f"{domain}_least_row": f"min({domain}_row)",
    }.get(name)


def subject_profile(
    rows: Mapping[str, DataFrame], measures: Sequence[str], on: Sequence[str] = ("USUBJID",)
) -> DataFrame:
    """One row per subject with the measures asked for: ``n_VS``, ``VS_first``, ``VS_latest_start``, ``VS_last``, ``VS_least_row``.

    One aggregation over the union of all domains, in place of a distinct or a
    group-by per check; it is combined map-side, so hot subjects cost nothing extra.
    What no measure needs is not read.
    """
    # An end counts only where the start is a date.
    start, end = iso_date("_raw"), iso_date("_raw_end")
    parts = [
        df.filter("USUBJID IS NOT NULL").selectExpr(
            *on, f"1 AS in_{d}", f"{ROW_INDEX} AS {d}_row", f"{start} AS {d}_start", f"CASE WHEN ({start}) IS NOT NULL THEN {end} END AS {d}_end"
        )
        for d, df in rows.items()
    ]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    sql = {name: next(filter(None, (_measure(name, d) for d in rows))) for name in dict.fromkeys(measures)}
    return union.groupBy(*on).agg(*[F.expr(f"{of} AS {name}") for name, of in sql.items()])


def cross_findings(
    tables: Mapping[str, DataFrame],
    rules: Sequence[CrossRule],
    on: Sequence[str] = ("USUBJID",),
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """Findings of any number of cross rules.

    The subject profile is computed once and written down. Only subjects that break a
    rule are then matched with rows, so clean data is neither joined nor shuffled.
    """
    needed = {r.of for r in rules} | {r.against for r in rules}
    used = [d for d in tables if d in needed]
    rows = {d: _subject_rows(tables[d], d, on) for d in used}
    measures = [m for r in rules for m in (f"n_{r.of}", *r.measures)]
    profile = materialize(subject_profile(rows, measures, on), "subjects")
    carry = [c for c in on if c != "USUBJID"]
    own_rules = {d: [r for r in rules if r.of == d] for d in used}
    own_rules = {d: own for d, own in own_rules.items() if own}
    suspect = {
        d: f"n_{d} > 0 AND ({' OR '.join(f'({r.subject})' for r in own)})" for d, own in own_rules.items()
    }
    sizes = dict(zip(suspect, total_bytes(profile, list(suspect.values()))))
    parts = []
    for domain, own in own_rules.items():
        matched = rows_of_keys(
            rows[domain].drop("_raw_end"), profile.filter(suspect[domain]), on, f"n_{domain}", sizes[domain], broadcast_bytes
        )
        parts.append(emit(matched, [_hit(r, r.row) for r in own], carry))
        orphans = [r for r in own if r.orphan]
        if orphans:
            # A null id matches nothing, so its rows are orphans by definition: no join needed.
            unnamed = rows[domain].filter("USUBJID IS NULL")
            parts.append(emit(unnamed, [_hit(r, "TRUE") for r in orphans], carry))
    return reduce(DataFrame.unionByName, parts)


def _texts(rule_id: str) -> tuple[str, str, str]:
    if rule_id in X.CROSS_TEXTS:
        return X.CROSS_TEXTS[rule_id]
    domain, number = rule_id.removeprefix("X_DMLINK_").rsplit("_", 1)
    severity, field, message = X.DM_LINK_TEXTS[number]
    return severity, field, message.replace("%s", domain)


def _hit(rule: CrossRule, mask: str) -> Hit:
    severity, field, message = _texts(rule.rule_id)
    return Hit(
        mask, X.CROSS_DOMAIN, rule.rule_id, severity, "CROSS", field, message, ROW_INDEX, "USUBJID", rule.evidence
    )


def vs_ae_rules(tolerance_days: int = 0) -> list[CrossRule]:
    return [orphan_rule("X_VSAE_001", "AE", "VS"), outside_range_rule("X_VSAE_002", "AE", "VS", tolerance_days)]


def vs_cm_rules(cm_has_end: bool = True) -> list[CrossRule]:
    window = [outside_range_rule("X_VSCM_002", "VS", "CM")] if cm_has_end else []
    return [orphan_rule("X_VSCM_001", "CM", "VS"), *window]


def dm_link_rule(domain: str) -> CrossRule:
    return orphan_rule(f"X_DMLINK_{domain}_001", domain, "DM")


def planned_rules(
    tables: Mapping[str, DataFrame], dm_links: Sequence[str] = (), vs_ae: bool = False, vs_cm: bool = False, tolerance_days: int = 0
) -> tuple[list[CrossRule], list[DataFrame]]:
    """(rules of the chosen checks, ``_000`` findings of those whose columns are missing)."""
    spark = next(iter(tables.values())).sparkSession
    rules: list[CrossRule] = []
    parts: list[DataFrame] = []

    def add(fallback_id: str, needed: Mapping[str, Sequence[str]], found: list[CrossRule]) -> None:
        if all(set(columns) <= set(tables[d].columns) for d, columns in needed.items()):
            rules.extend(found)
        else:
            severity, field, message = _texts(fallback_id)
            parts.append(dataset_finding(spark, X.CROSS_DOMAIN, fallback_id, severity, "CROSS", field, message))

    for d in dm_links:
        add(f"X_DMLINK_{d}_000", {"DM": ["USUBJID"], d: ["USUBJID"]}, [dm_link_rule(d)])
    if vs_ae:
        add("X_VSAE_000", {"VS": ["USUBJID", "VSDTC"], "AE": ["USUBJID", "AESTDTC"]}, vs_ae_rules(tolerance_days))
    if vs_cm:
        has_end = "CMENDTC" in tables["CM"].columns
        add("X_VSCM_000", {"VS": ["USUBJID", "VSDTC"], "CM": ["USUBJID", "CMSTDTC"]}, vs_cm_rules(has_end))
    return rules, parts


def study_cross_findings(
    tables: Mapping[str, DataFrame],
    dm_links: Sequence[str] = (),
    vs_ae: bool = False,
    vs_cm: bool = False,
    tolerance_days: int = 0,
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """The chosen cross checks together, over one subject profile.

    A check whose columns are missing yields its ``_000`` finding instead.
    """
    spark = next(iter(tables.values())).sparkSession
    tables = {domain: with_row_index(df) for domain, df in tables.items()}
    rules, parts = planned_rules(tables, dm_links, vs_ae, vs_cm, tolerance_days)
    if rules:
        parts.append(cross_findings(tables, rules, broadcast_bytes=broadcast_bytes))
    return merge(spark, parts)


@dataclass(frozen=True)
class OwnRules:
    """What the rows of one domain are judged by besides cross rules: hits, and the columns these need.

    ``repeated`` is a hit for rows of subjects that have more than one row; it may use n_DOMAIN and DOMAIN_least_row.
    """

    hits: Sequence[Hit]
    needs: Sequence[str]
    repeated: Hit | None = None


def fused_findings(
    tables: Mapping[str, DataFrame], rules: Sequence[CrossRule], own: Mapping[str, OwnRules], broadcast_bytes: int | None = None
) -> DataFrame:
    """Row rules, repeated subjects and cross rules of all domains: two scans of each table.

    The first scan makes the subject profile, the second judges every row, with what the profile says of its subject
    where that subject breaks a rule. Where those subjects are too many to broadcast, their rows are fetched apart.
    """
    limit = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    needed = {r.of for r in rules} | {r.against for r in rules} | {d for d, o in own.items() if o.repeated}
    named = {d: _subject_rows(tables[d], d, ["USUBJID"]) for d in tables if d in needed}
    measures = [m for r in rules for m in (f"n_{r.of}", *r.measures)]
    measures += [m for d, o in own.items() if o.repeated for m in (f"n_{d}", f"{d}_least_row")]
    conditions = {}
    for d in named:
        checks = [f"({r.subject})" for r in rules if r.of == d] + [f"n_{d} > 1"] * bool(own[d].repeated)
        if checks:
            conditions[d] = f"n_{d} > 0 AND ({' OR '.join(checks)})"
    parts = []
    profile = sizes = None
    if conditions:
        profile = materialize(subject_profile(named, measures), "subjects")
        sizes = dict(zip(conditions, total_bytes(profile, list(conditions.values())), strict=True))
    for d, table in tables.items():
        wanted = [c for c in dict.fromkeys(own[d].needs) if c in table.columns and c != "USUBJID"]
        dated = text(START_DATE[d]) if START_DATE.get(d) in table.columns else "CAST(NULL AS STRING)"
        subject = [f"{text('USUBJID')} AS USUBJID"] if "USUBJID" in table.columns else []
        rows = table.selectExpr(ROW_INDEX, *subject, *[f"`{c}`" for c in wanted], f"{dated} AS _raw")
        # A null id matches nothing, so its rows are orphans by definition.
        hits = [*own[d].hits, *[_hit(r, "USUBJID IS NULL") for r in rules if r.of == d and r.orphan]]
        by_subject = [_hit(r, r.row) for r in rules if r.of == d] + [own[d].repeated] * bool(own[d].repeated)
        if d in conditions and sizes[d] <= limit:
            suspects = profile.filter(conditions[d]).withColumnRenamed("USUBJID", "_subject")
            rows = rows.join(F.broadcast(suspects), F.col("USUBJID") == F.col("_subject"), "left")
            hits += by_subject
        elif d in conditions:
            fetched = rows_of_keys(rows, profile.filter(conditions[d]), ["USUBJID"], f"n_{d}", sizes[d], limit)
            parts.append(emit(fetched, by_subject))
        parts.append(emit(rows, hits))
    return reduce(DataFrame.unionByName, parts)


def validate_dm_link(dm: DataFrame, other: DataFrame, other_domain: str) -> DataFrame:
    """Subjects of one domain that demographics does not know."""
    return study_cross_findings({"DM": dm, other_domain: other}, dm_links=[other_domain])


def validate_vs_ae(vs: DataFrame, ae: DataFrame, tolerance_days: int = 0) -> DataFrame:
    return study_cross_findings({"VS": vs, "AE": ae}, vs_ae=True, tolerance_days=tolerance_days)


def validate_vs_cm(vs: DataFrame, cm: DataFrame) -> DataFrame:
    return study_cross_findings({"VS": vs, "CM": cm}, vs_cm=True)
