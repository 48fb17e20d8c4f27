"""Row rules of the four domains: each rule is one SQL predicate that is true for a violation.

A rule names the columns it cannot do without (``needs``); where one is absent the
rule does not exist. A predicate that is null does not fire.
"""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.text import (
    decimal_comma,
    decimal_number,
    is_decimal,
    iso_date,
    joined,
    looks_like_iso_date,
    null_or_blank,
    outside,
    quoted,
    text,
)
from . import texts as X


@dataclass(frozen=True)
class RowRule:
    rule_id: str
    needs: tuple[str, ...]
    violated: str
    evidence: str


def _rule(rule_id: str, violated: str, *needs: str, evidence: str | None = None) -> RowRule:
    return RowRule(rule_id, needs, violated, evidence or text(needs[0]))


def _bad_date(rule_id: str, column: str) -> RowRule:
    return _rule(rule_id, f"`{column}` IS NOT NULL AND ({iso_date(text(column))}) IS NULL", column)


def _wrong_order(rule_id: str, start: str, end: str) -> RowRule:
    violated = f"({iso_date(text(start))}) > ({iso_date(text(end))})"
    return _rule(rule_id, violated, start, end, evidence=joined(text(start), "' > '", text(end)))


def _blank(rule_id: str, column: str) -> RowRule:
    return _rule(rule_id, null_or_blank(text(column)), column)


def _not_a_term(rule_id: str, column: str, terms: list[str]) -> RowRule:
    return _rule(rule_id, outside(text(column), terms), column)


_TEST = text("VSTESTCD")
_KNOWN_TEST = f"{_TEST} IN ({', '.join(map(quoted, X.VSTESTCD_TERMS))})"
_WRONG_UNIT = " OR ".join(
    f"({_TEST} = {quoted(test)} AND {outside(text('VSORRESU'), units)})" for test, units in X.UNITS_OF_TEST.items()
)
_NOT_NUMERIC = f"{_KNOWN_TEST} AND VSORRES IS NOT NULL AND NOT {is_decimal(decimal_comma(text('VSORRES')))}"
_AGE = f"({decimal_number(text('AGE'))})"
_AGE_OUT_OF_RANGE = f"{_AGE} < 0 OR {_AGE} > 120"
_AGE_WITHOUT_UNIT = f"{_AGE} IS NOT NULL AND (AGEU IS NULL OR {outside(text('AGEU'), X.AGEU_TERMS)})"

VS_RULES = [
    _blank("SDTM_VS_001", "USUBJID"),
    _not_a_term("SDTM_VS_002", "VSTESTCD", X.VSTESTCD_TERMS),
    _bad_date("SDTM_VS_003", "VSDTC"),
    _rule("SDTM_VS_004", _NOT_NUMERIC, "VSORRES", "VSTESTCD"),
    _rule(
        "SDTM_VS_005", _WRONG_UNIT, "VSORRESU", "VSTESTCD",
        evidence=joined(_TEST, "' / '", text("VSORRESU")),
    ),
]

AE_RULES = [
    _blank("SDTM_AE_001", "AETERM"),
    _bad_date("SDTM_AE_002", "AESTDTC"),
    _bad_date("SDTM_AE_003", "AEENDTC"),
    _wrong_order("SDTM_AE_004", "AESTDTC", "AEENDTC"),
    _not_a_term("SDTM_AE_005", "AESER", X.AESER_TERMS),
    _not_a_term("SDTM_AE_006", "AESEV", X.AESEV_TERMS),
]

CM_RULES = [
    _blank("SDTM_CM_001", "CMTRT"),
    _bad_date("SDTM_CM_002", "CMSTDTC"),
    _bad_date("SDTM_CM_003", "CMENDTC"),
    _wrong_order("SDTM_CM_004", "CMSTDTC", "CMENDTC"),
]

DM_DOMAIN_RULES = [
    _blank("SDTM_DM_001", "USUBJID"),
    _not_a_term("SDTM_DM_003", "SEX", X.SEX_TERMS),
    _rule("SDTM_DM_004", _AGE_OUT_OF_RANGE, "AGE"),
    _rule("SDTM_DM_005", _AGE_WITHOUT_UNIT, "AGEU", "AGE"),
    _bad_date("SDTM_DM_006", "RFSTDTC"),
    _bad_date("SDTM_DM_007", "RFENDTC"),
    _wrong_order("SDTM_DM_008", "RFSTDTC", "RFENDTC"),
]

# Same rule ids, other meanings: this is the set the study jobs use.
DM_SDTM_RULES = [
    _blank("SDTM_DM_001", "USUBJID"),
    _blank("SDTM_DM_003", "STUDYID"),
    _not_a_term("SDTM_DM_004", "SEX", X.SEX_TERMS),
    _rule("SDTM_DM_005", _AGE_OUT_OF_RANGE, "AGE"),
    _rule("SDTM_DM_006", f"NOT ({looks_like_iso_date(text('RFSTDTC'))})", "RFSTDTC"),
]

DM_PROFILES = ("sdtm", "domain")
_CATALOG = {
    "VS": (VS_RULES, X.VS_TEXTS),
    "AE": (AE_RULES, X.AE_TEXTS),
    "CM": (CM_RULES, X.CM_TEXTS),
    ("DM", "domain"): (DM_DOMAIN_RULES, X.DM_DOMAIN_TEXTS),
    ("DM", "sdtm"): (DM_SDTM_RULES, X.DM_SDTM_TEXTS),
}


def catalog(domain: str, dm_profile: str = "sdtm") -> tuple[list[RowRule], dict[str, tuple[str, str, str]]]:
    """(rules, texts) of a domain."""
    if dm_profile not in DM_PROFILES:
        raise ValueError(f"dm_profile must be one of {DM_PROFILES}, got {dm_profile!r}")
    return _CATALOG[("DM", dm_profile) if domain == "DM" else domain]
