"""Validation of Dataset-JSON documents, each one a small study of its own."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.text import quoted
from ..operators.findings import Hit, emit, merge
from ..operators.materialize import materialize
from ..operators.rowid import ROW_INDEX
from ..rules import texts as X
from ..rules.domains import catalog
from ..sources.dataset_json import DatasetJson, cell, column_names, findings_of
from .cross import cross_findings, dm_link_rule
from .domains import duplicate_subjects

LINKED = ["VS", "AE", "CM"]
KEYS = ("doc_id", "USUBJID")
_FIRST = f"{ROW_INDEX} = 0"


class Datasets(Mapping[str, DataFrame]):
    """Per domain a table (doc_id, row_index, src_index, items); built when asked for."""

    def __init__(self, dj: DatasetJson, staged: DataFrame, domains: Sequence[str]):
        self._dj, self._staged, self._domains = dj, staged, domains

    def __getitem__(self, domain: str) -> DataFrame:
        if domain not in self._domains:
            raise KeyError(domain)
        first_rows = self._staged.filter(f"domain = {quoted(domain)} AND {_FIRST}")
        return self._dj.domain_table(domain, column_names(first_rows))

    def __iter__(self) -> Iterator[str]:
        return iter(self._domains)

    def __len__(self) -> int:
        return len(self._domains)


@dataclass(frozen=True)
class DocumentResult:
    """``findings`` has doc_id and the nine columns."""

    datasets: Datasets
    findings: DataFrame


def _rule_columns(dm_profile: str) -> list[str]:
    needed = [c for d in X.DOMAINS for rule in catalog(d, dm_profile)[0] for c in rule.needs]
    return list(dict.fromkeys(["USUBJID", *(c for d in X.DOMAINS for c in X.REQUIRED[d]), *needed]))


def _has(column: str) -> str:
    return f"array_contains(item_names, {quoted(column)})"


def _missing(domain: str) -> str:
    return f"array_except(array({', '.join(map(quoted, X.REQUIRED[domain]))}), item_names)"


def _hits(domain: str, dm_profile: str, linked: bool) -> list[Hit]:
    """Everything that can be said of a row, or of a data set at its first row.

    A document has the columns its own items name, so column checks that are decided
    once for a plain table become part of the predicate here.
    """
    here = f"domain = '{domain}' AND {ROW_INDEX} IS NOT NULL"
    rules, texts = catalog(domain, dm_profile)
    hits = []
    runs = here
    if domain != "DM" or dm_profile == "domain":
        missing = _missing(domain)
        runs = f"{here} AND size({missing}) = 0"
        named = f"array_join(transform({missing}, c -> concat('\\'', c, '\\'')), ', ')"
        hits.append(
            Hit(
                f"{here} AND {_FIRST} AND size({missing}) > 0",
                X.CROSS_DOMAIN if domain == "DM" else X.SDTM_RULE, f"SDTM_{domain}_000", "CRIT", domain, "", "",
                field_sql=f"array_join({missing}, ',')",
                message_sql=f"concat('Missing required columns for {domain}: [', {named}, ']')",
            )
        )
    elif domain == "DM":
        severity, field, message = X.DM_SDTM_NO_USUBJID
        absent = f"{here} AND {_FIRST} AND NOT {_has('USUBJID')}"
        hits.append(Hit(absent, X.SDTM_RULE, "SDTM_DM_001", severity, "DM", field, message))
    for rule in rules:
        severity, field, message = texts[rule.rule_id]
        present = " AND ".join(_has(c) for c in rule.needs)
        hits.append(
            Hit(
                f"{runs} AND ({rule.violated}) AND {present}", X.SDTM_RULE, rule.rule_id, severity, domain, field,
                message, ROW_INDEX, f"CASE WHEN {_has('USUBJID')} THEN USUBJID ELSE '' END", rule.evidence,
            )
        )
    if domain == "VS":
        severity, field, message = X.VS_UNIT_COLUMN_ABSENT
        no_unit = f"{runs} AND {_FIRST} AND NOT {_has('VSORRESU')}"
        hits.append(Hit(no_unit, X.SDTM_RULE, "SDTM_VS_005", severity, "VS", field, message))
    if linked and domain in LINKED:
        severity, field, message = X.DM_LINK_TEXTS["000"]
        unlinkable = f"{here} AND {_FIRST} AND anchor_rows AND NOT (anchor_has_id AND {_has('USUBJID')})"
        hits.append(
            Hit(
                unlinkable, X.CROSS_DOMAIN, f"X_DMLINK_{domain}_000", severity, "CROSS", field,
                message.replace("%s", domain),
            )
        )
    return hits


def validate_documents(
    documents: DataFrame,
    domains: Sequence[str] | None = None,
    dm_profile: str = "sdtm",
    duplicates: str = "all",
    finding_type: str = X.DATASET_JSON,
) -> DocumentResult:
    """Structure, extraction, domain rules and links to DM, document by document.

    The documents are parsed once; their records are written down by domain and all
    later checks read just the columns and domains they need. Within a document a
    domain is checked only where it has rows, and linked only where DM has rows.
    """
    domains = list(X.DOMAINS if domains is None else domains)
    dj = DatasetJson(documents, finding_type)
    linked = "DM" in domains
    columns = _rule_columns(dm_profile)
    records = dj.records(domains, anchor="DM" if linked else None)
    staged = materialize(
        records.selectExpr(
            "doc_id", "domain", "oid", "item_names", ROW_INDEX, "src_index", "anchor_rows", "anchor_has_id", "notes",
            *[f"{cell(c)} AS {c}" for c in columns],
        ),
        "document-records",
        partition_by="domain",
    )
    known = [d for d in X.DOMAINS if d in domains]
    parts = [findings_of(staged)]
    for domain in known:
        own = staged.filter(f"domain = '{domain}'")
        parts.append(emit(own, _hits(domain, dm_profile, linked), ["doc_id"]))
    if linked:
        usable = staged.filter(f"{ROW_INDEX} IS NOT NULL AND {_has('USUBJID')}")
        dm = usable.filter("domain = 'DM'")
        checked = dm if dm_profile == "sdtm" else dm.filter(f"size({_missing('DM')}) = 0")
        parts.append(duplicate_subjects(checked, duplicates, blank_is_a_key=dm_profile == "sdtm", on=KEYS))
        others = [d for d in known if d in LINKED]
        if others:
            tables = {"DM": dm}
            for d in others:
                tables[d] = usable.filter(f"domain = '{d}' AND anchor_rows AND anchor_has_id")
            parts.append(cross_findings(tables, [dm_link_rule(d) for d in others], on=KEYS))
    return DocumentResult(Datasets(dj, staged, domains), merge(documents.sparkSession, parts))


