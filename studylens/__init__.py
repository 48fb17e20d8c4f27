"""Clinical data-quality checks as Spark jobs."""

from .operators.findings import FINDINGS, conform, merge, no_findings, summarize
from .operators.rowid import with_row_index
from .plans.codelists import codelist_violations
from .plans.cross import study_cross_findings, validate_dm_link, validate_vs_ae, validate_vs_cm
from .plans.documents import validate_documents
from .plans.domains import duplicate_subjects, validate_ae, validate_cm, validate_dm, validate_rows, validate_vs
from .plans.study import validate_study
from .plans.visits import (
    apply_rules,
    detect_anomalies,
    ensure_columns,
    flagged,
    generate_report,
    impute_medians,
    judge_visits,
    load_data,
    preview,
    run_visits,
    summary,
    validate_visits,
    write_report,
)
from .sources.codelists import read_codelists
from .sources.csv import read_domain, read_table, write_findings, write_findings_csv
from .sources.dataset_json import DatasetJson, read_documents
from .sources.onefile import write_one_csv

__all__ = [
    "FINDINGS",
    "DatasetJson",
    "apply_rules",
    "codelist_violations",
    "conform",
    "detect_anomalies",
    "duplicate_subjects",
    "ensure_columns",
    "flagged",
    "generate_report",
    "impute_medians",
    "judge_visits",
    "load_data",
    "merge",
    "no_findings",
    "preview",
    "read_codelists",
    "read_documents",
    "read_domain",
    "read_table",
    "run_visits",
    "study_cross_findings",
    "summarize",
    "summary",
    "validate_ae",
    "validate_cm",
    "validate_dm",
    "validate_dm_link",
    "validate_documents",
    "validate_rows",
    "validate_study",
    "validate_visits",
    "validate_vs",
    "validate_vs_ae",
    "validate_vs_cm",
    "with_row_index",
    "write_findings",
    "write_findings_csv",
    "write_one_csv",
    "write_report",
]
