"""Everything here must read exactly as published, since findings
are compared by rule id, severity, field and message."""

# --- Fixed values: vocabulary -------------------------------------------------
SDTM_RULE = "SDTM_RULE"
CROSS_DOMAIN = "CROSS_DOMAIN"
DATASET_JSON = "DATASET_JSON"
DOMAINS = ["DM", "VS", "AE", "CM"]

# --- Fixed values: controlled terms -------------------------------------------
VSTESTCD_TERMS = ["SYSBP", "DIABP", "HR", "TEMP", "WEIGHT", "HEIGHT", "RESP"]
UNITS_OF_TEST = {
    "SYSBP": ["mmHg"],
    "DIABP": ["mmHg"],
    "HR": ["bpm"],
    "RESP": ["breaths/min", "bpm"],
    "TEMP": ["C", "F"],
    "WEIGHT": ["kg", "g", "lb"],
    "HEIGHT": ["cm", "m", "in"],
}
AESER_TERMS = ["Y", "N"]
AESEV_TERMS = ["MILD", "MODERATE", "SEVERE"]
SEX_TERMS = ["M", "F", "U"]
AGEU_TERMS = ["YEARS", "MONTHS", "DAYS"]

# --- Fixed values: required columns -------------------------------------------
REQUIRED = {
    "VS": ["USUBJID", "VSTESTCD", "VSORRES", "VSDTC"],
    "AE": ["USUBJID", "AETERM", "AESTDTC"],
    "CM": ["USUBJID", "CMTRT", "CMSTDTC"],
    "DM": ["USUBJID", "STUDYID"],
}
VISIT_COLUMNS = ["age", "systolic_bp", "treatment_dose", "visit_date"]

# --- Fixed values: rule texts, rule id -> (severity, field, message) ----------
VS_TEXTS = {
    "SDTM_VS_001": ("HIGH", "USUBJID", "USUBJID is required and must be non-empty."),
    "SDTM_VS_002": ("MED", "VSTESTCD", f"VSTESTCD should be one of: {VSTESTCD_TERMS}."),
    "SDTM_VS_003": ("LOW", "VSDTC", "VSDTC should be ISO date YYYY-MM-DD (subset check)."),
    "SDTM_VS_004": ("HIGH", "VSORRES", "VSORRES should be numeric for this VSTESTCD."),
    "SDTM_VS_005": ("MED", "VSORRESU", "VSORRESU unit is not consistent with VSTESTCD (MVP unit map)."),
}
VS_UNIT_COLUMN_ABSENT = ("LOW", "VSORRESU", "Column VSORRESU not present; unit consistency checks skipped.")
AE_TEXTS = {
    "SDTM_AE_001": ("HIGH", "AETERM", "AETERM is required and must be non-empty."),
    "SDTM_AE_002": ("MED", "AESTDTC", "AESTDTC should be ISO date YYYY-MM-DD (subset check)."),
    "SDTM_AE_003": ("LOW", "AEENDTC", "AEENDTC should be ISO date YYYY-MM-DD (subset check)."),
    "SDTM_AE_004": ("HIGH", "AESTDTC/AEENDTC", "AESTDTC must be on/before AEENDTC."),
    "SDTM_AE_005": ("MED", "AESER", f"AESER should be one of: {AESER_TERMS}."),
    "SDTM_AE_006": ("LOW", "AESEV", f"AESEV should be one of: {AESEV_TERMS}."),
}
CM_TEXTS = {
    "SDTM_CM_001": ("HIGH", "CMTRT", "CMTRT is required and must be non-empty."),
    "SDTM_CM_002": ("MED", "CMSTDTC", "CMSTDTC should be ISO date YYYY-MM-DD (subset check)."),
    "SDTM_CM_003": ("LOW", "CMENDTC", "CMENDTC should be ISO date YYYY-MM-DD (subset check)."),
    "SDTM_CM_004": ("HIGH", "CMSTDTC/CMENDTC", "CMSTDTC must be on/before CMENDTC."),
}
DM_DOMAIN_TEXTS = {
    "SDTM_DM_001": ("HIGH", "USUBJID", "USUBJID is required and must be non-empty."),
    "SDTM_DM_002": ("HIGH", "USUBJID", "USUBJID must be unique in DM."),
    "SDTM_DM_003": ("MED", "SEX", f"SEX should be one of: {SEX_TERMS}."),
    "SDTM_DM_004": ("MED", "AGE", "AGE should be between 0 and 120 (MVP heuristic)."),
    "SDTM_DM_005": ("LOW", "AGEU", f"AGEU should be one of: {AGEU_TERMS} when AGE is present."),
    "SDTM_DM_006": ("LOW", "RFSTDTC", "RFSTDTC should be ISO date YYYY-MM-DD (subset check)."),
    "SDTM_DM_007": ("LOW", "RFENDTC", "RFENDTC should be ISO date YYYY-MM-DD (subset check)."),
    "SDTM_DM_008": ("HIGH", "RFSTDTC/RFENDTC", "RFSTDTC must be on/before RFENDTC."),
}
DM_SDTM_TEXTS = {
    "SDTM_DM_001": ("HIGH", "USUBJID", "USUBJID is required and must be non-empty."),
    "SDTM_DM_002": ("HIGH", "USUBJID", "USUBJID must be unique in DM."),
    "SDTM_DM_003": ("HIGH", "STUDYID", "STUDYID is required and must be non-empty."),
    "SDTM_DM_004": ("MED", "SEX", "SEX must be one of: M, F, U."),
    "SDTM_DM_005": ("MED", "AGE", "AGE should be between 0 and 120 for typical adult/human studies."),
    "SDTM_DM_006": ("LOW", "RFSTDTC", "RFSTDTC should be ISO 8601 date format YYYY-MM-DD (subset check)."),
}
DM_SDTM_NO_USUBJID = ("HIGH", "USUBJID", "Missing required column USUBJID.")
CROSS_TEXTS = {
    "X_VSAE_000": ("CRIT", "USUBJID/--DTC", "Missing required columns for VS/AE cross checks (need VS.USUBJID,VSDTC and AE.USUBJID,AESTDTC)."),
    "X_VSAE_001": ("HIGH", "USUBJID", "AE subject not found in VS (orphan USUBJID)."),
    "X_VSAE_002": ("MED", "AESTDTC", "AE start date is outside the subject's VS date range (MVP heuristic)."),
    "X_VSCM_000": ("CRIT", "USUBJID/--DTC", "Missing required columns for VS/CM cross checks (need VS.USUBJID,VSDTC and CM.USUBJID,CMSTDTC)."),
    "X_VSCM_001": ("HIGH", "USUBJID", "CM subject not found in VS (orphan USUBJID)."),
    "X_VSCM_002": ("LOW", "VSDTC", "VS date is outside the subject's CM medication window (MVP heuristic)."),
}
# Links to DM: last part of the rule id -> text; %s stands for the domain.
DM_LINK_TEXTS = {
    "000": ("CRIT", "USUBJID", "Missing USUBJID for DM/%s link check."),
    "001": ("HIGH", "USUBJID", "%s subject not found in DM (orphan USUBJID)."),
}

# --- Fixed values: Dataset-JSON -----------------------------------------------
# Rule id -> (severity, message); a %s stands for the name in question.
DJ_UNREADABLE = "DJ_UNREADABLE"  # own rule: a text that is no JSON document
DJ_TEXTS = {
    DJ_UNREADABLE: ("CRIT", "The document is not a well-formed JSON text."),
    "DJ_000": ("CRIT", "Missing required top-level attribute: %s"),
    "DJ_001": ("CRIT", "Dataset-JSON must include either clinicalData or referenceData."),
    "DJ_002": ("CRIT", "clinicalData/referenceData must be a JSON object."),
    "DJ_003": ("CRIT", "Missing itemGroupData object under clinicalData/referenceData."),
    "DJ_004": ("CRIT", "itemGroupData must be a JSON object mapping dataset OIDs to datasets."),
    "DJ_100": ("CRIT", "ItemGroup '%s' not found in itemGroupData."),
    "DJ_101": ("CRIT", "Dataset must include a non-empty 'items' array."),
    "DJ_102": ("CRIT", "'itemData' must be an array of records."),
    "DJ_103": ("HIGH", "Each element of 'items' must be an object."),
    "DJ_104": ("CRIT", "Could not derive any column names from 'items'."),
    "DJ_105": ("HIGH", "Each itemData record should be an array of values."),
    "DJ_106": ("HIGH", "Record length does not match number of items."),
    "DJ_110": ("CRIT", "Could not infer itemGroup OID for domain '%s'."),
}
EVIDENCE_CHARS = 20  # of an unreadable text
DJ_TOP_LEVEL = ["creationDateTime", "datasetJSONVersion"]

# --- Fixed values: visit record bounds and outlier settings -------------------
AGE_RANGE = (18, 100)
SYSTOLIC_RANGE = (90, 180)
MIN_ROWS_FOR_OUTLIERS = 10
CONTAMINATION = 0.1
SEED = 42
PREVIEW_ROWS = 25
