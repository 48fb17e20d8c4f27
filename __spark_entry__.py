"""Registered queries and, for each, SQL that computes the same rows independently."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

import studylens as sl  # noqa: E402
from studylens.functions.text import quoted  # noqa: E402
from studylens.operators.materialize import shared_folder  # noqa: E402
from studylens.plans.domains import validate_rows  # noqa: E402
from studylens.plans.visits import NUMBERS  # noqa: E402
from studylens.rules import texts as X  # noqa: E402
from studylens.sources.dataset_json import findings_of  # noqa: E402
from studylens.sources.views import study_documents, view, view_of, view_sql  # noqa: E402
from studylens.streaming.findings import stream_row_findings, write_stream  # noqa: E402
from studylens.streaming.keyed import settled, state_store, stream_duplicates, stream_links  # noqa: E402

BLOCK = 100  # row numbers per document
CODED_FIELDS = {"sdtm_dm": ["SEX"], "sdtm_vs": ["VSTESTCD"], "sdtm_ae": ["AESER", "AESEV"]}


# -- queries -------------------------------------------------------------------


def _study(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {d: view(spark, sf, f"sdtm_{d}") for d in ("dm", "vs", "ae", "cm")}


def _all_findings(spark: SparkSession, sf: str) -> DataFrame:
    return sl.validate_study(**_study(spark, sf))


def _rule(findings: DataFrame, rule_id: str) -> DataFrame:
    return findings.filter(f"rule_id = '{rule_id}'")


def _links(spark: SparkSession, sf: str) -> DataFrame:
    tables = {d.upper(): t for d, t in _study(spark, sf).items()}
    return sl.study_cross_findings(tables, dm_links=["VS", "AE", "CM"])


def _missing_columns(spark: SparkSession, sf: str) -> DataFrame:
    s = _study(spark, sf)
    no_id = s["dm"].drop("USUBJID")
    return sl.merge(
        spark,
        [
            sl.validate_vs(s["vs"].drop("VSORRES", "VSDTC")),
            sl.validate_ae(s["ae"].drop("AETERM")),
            sl.validate_cm(s["cm"].drop("USUBJID")),
            sl.validate_dm(no_id, profile="domain"),
            sl.validate_dm(no_id, profile="sdtm"),
            sl.validate_dm_link(no_id, s["ae"], "AE"),
            sl.validate_vs_ae(s["vs"].drop("VSDTC"), s["ae"]),
            sl.validate_vs_cm(s["vs"], s["cm"].drop("CMSTDTC")),
        ],
    )


def _codelists(spark: SparkSession, sf: str) -> DataFrame:
    lists = sl.read_codelists(spark)
    parts = [
        sl.codelist_violations(view(spark, sf, v), lists, fields).selectExpr(f"'{v}' AS source", "*")
        for v, fields in CODED_FIELDS.items()
    ]
    return sl.merge(spark, parts)


def _visits(spark: SparkSession, sf: str) -> DataFrame:
    return sl.apply_rules(view(spark, sf, "visit_records"))


def _imputed(spark: SparkSession, sf: str) -> DataFrame:
    return sl.impute_medians(_visits(spark, sf))[0].select("row_index", *NUMBERS)


def _anomalies(spark: SparkSession, sf: str) -> DataFrame:
    return sl.detect_anomalies(_visits(spark, sf)).select("row_index", *NUMBERS, "anomaly")


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    return sl.detect_anomalies(_visits(spark, sf))


def _own_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _visits_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Visit records from one CSV file to the report in one CSV file; the report read back, with its counts."""
    folder = _own_folder(spark, "visits")
    records = view(spark, sf, "visit_records").orderBy("row_index").drop("row_index")
    sl.write_one_csv(records, f"{folder}/visits.csv")
    report = sl.run_visits(spark, f"{folder}/visits.csv", f"{folder}/reports")
    counts = f"{report.total_records}L AS total_records", f"{report.flagged_records}L AS flagged_records"
    return sl.read_table(spark, report.path).selectExpr("*", *counts)


def _dm_files(spark: SparkSession, sf: str) -> DataFrame:
    """Demographics from two CSV files, read by name: other columns in another order, line breaks in cells."""
    folder, dm = _own_folder(spark, "dm"), view(spark, sf, "sdtm_dm").orderBy("row_index")
    even = dm.filter("row_index % 2 = 0").select("STUDYID", "USUBJID", "SEX", "AGE")
    odd = dm.filter("row_index % 2 = 1").selectExpr("SEX", "concat('seen\nby ', USUBJID, ', \"MD\"') AS NOTE", "USUBJID", "STUDYID")
    sl.write_one_csv(even, f"{folder}/a.csv")
    sl.write_one_csv(odd, f"{folder}/b.csv")
    return sl.read_domain(spark, folder, multi_line=True, by_name=True)


def _visits_loaded(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{_own_folder(spark, 'visits')}/visits.csv"
    sl.write_one_csv(view(spark, sf, "visit_records").orderBy("row_index").drop("row_index"), path)
    return sl.load_data(spark, path)


def _findings_file(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{_own_folder(spark, 'findings')}/findings.csv"
    sl.write_findings_csv(_all_findings(spark, sf), path, one_file=True)
    return sl.read_table(spark, path)


def _report_file(spark: SparkSession, sf: str) -> DataFrame:
    """The report of the rule flags alone, from its file, with the counts taken while it was written."""
    report = sl.write_report(_visits(spark, sf), _own_folder(spark, "reports"), one_file=True)
    counts = f"{report.total_records}L AS total_records", f"{report.flagged_records}L AS flagged_records"
    return sl.read_table(spark, report.path).selectExpr("*", *counts)


def _few_visits(spark: SparkSession, sf: str) -> DataFrame:
    """A visit for each order priority, too few for outliers."""
    fields = "o_orderpriority, max(o_totalprice) AS o_totalprice, max(o_custkey) AS o_custkey, max(o_orderkey) AS n, max(o_orderdate) AS o_orderdate"
    spark.read.parquet(f"{sf}/orders.parquet").createOrReplaceTempView("orders_of_few_visits")
    few = spark.sql(f"SELECT {fields} FROM orders_of_few_visits GROUP BY o_orderpriority")
    return sl.detect_anomalies(sl.apply_rules(few.selectExpr(*_FEW_VISITS))).select("row_index", *NUMBERS, "anomaly")


_FEW_VISITS = [
    "CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS row_index",
    "CAST(o_custkey % 120 AS STRING) AS age",
    "CAST(CAST(floor(o_totalprice / 2000) AS INT) AS STRING) AS systolic_bp",
    "CASE WHEN n % 2 = 0 THEN 'n/a' ELSE CAST(n % 200 AS STRING) END AS treatment_dose",
    "substr(CAST(o_orderdate AS STRING), 1, 10) AS visit_date",
]


def _streamed(spark: SparkSession, sf: str) -> DataFrame:
    """The AE rules over the events table read as a stream, to its end."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    findings = stream_row_findings(view_of(events, "sdtm_ae"), "AE")
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    write_stream(findings, f"{out}/rows", f"{out}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(findings.schema).parquet(f"{out}/rows").select(*findings.columns)


BATCHES = 4


def _in_batches(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A view as a stream of several batches, later rows first."""
    folder, rows = _own_folder(spark, name), view(spark, sf, name)
    for part in range(BATCHES):
        rows.filter(f"row_index % {BATCHES} = {BATCHES - 1 - part}").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _to_the_end(findings: DataFrame) -> DataFrame:
    spark = findings.sparkSession
    out = _own_folder(spark, "stream")
    with state_store(spark):
        write_stream(findings, f"{out}/rows", f"{out}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(findings.schema).parquet(f"{out}/rows").select(*findings.columns)


def _duplicates_streamed(spark: SparkSession, sf: str) -> DataFrame:
    return _to_the_end(stream_duplicates(_in_batches(spark, sf, "sdtm_dm")))


def _links_streamed(spark: SparkSession, sf: str) -> DataFrame:
    return settled(_to_the_end(stream_links(_in_batches(spark, sf, "sdtm_dm"), _in_batches(spark, sf, "sdtm_ae"), "AE")))


def _row_index(spark: SparkSession, sf: str) -> DataFrame:
    table = spark.read.parquet(f"{sf}/orders.parquet")
    return sl.with_row_index(table, from_files=True).select("row_index", "o_orderkey")


# Texts planted into whole documents, by doc_id % 8; other documents stay sound.
_PLANTED = {
    1: ('"creationDateTime"', '"created"'),
    2: ('"clinicalData":', '"clinicalData":[],"other":'),
    3: ('"clinicalData"', '"studyData"'),
    4: ('"itemGroupData"', '"groups"'),
    5: ('"itemGroupData":', '"itemGroupData":7.5,"other":'),
    6: ('"clinicalData":', '"clinicalData":0,"referenceData":'),
    7: ('"IG.VS":{"name":"VS",', '"IG.QVS":{"name":"vitals",'),
    # Values of the wrong kind, some of them texts that hold JSON.
    8: ('"clinicalData":', '"clinicalData":"{}","other":'),
    9: ('"clinicalData":', '"clinicalData":[{}],"other":'),
    10: ('"itemGroupData":', '"itemGroupData":"{\\"IG.VS\\":{}}","other":'),
    11: ('"itemGroupData":', '"itemGroupData":null,"other":'),
}


def _faulty_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _plant(study_documents(spark, sf, ["VS"], BLOCK), _PLANTED)


# Faults planted into the only item group, by doc_id % 7.
_PLANTED_IN_GROUP = {
    1: ('"items":', '"itms":'),
    2: ('"itemData":', '"data":'),
    3: ('"items":[', '"items":[3,null,'),
    4: ('"itemData":[', '"itemData":"none","other":['),
    5: ('"IG.VS":{"name":"VS",', '"IG.VS":5,"OTHER":{"name":"other",'),
    6: ('"items":[', '"items":[],"itemData":{},"other":['),
    # Texts that hold JSON are texts.
    7: ('"IG.VS":{"name":"VS",', '"IG.VS":"{\\"items\\":[{\\"name\\":\\"A\\"}],\\"itemData\\":[[1]]}","OTHER":{"name":"other",'),
    8: ('"items":[', '"items":"[{}]","other":['),
    9: ('"itemData":[', '"itemData":"[[1]]","other":['),
    10: ('"items":[', '"items":{"name":"A","OID":"B"},"other":['),
}

# Other names for the first item, by doc_id % 8.
_PLANTED_NAMES = {
    1: ('"name":"USUBJID"', '"name":0'),
    2: ('"name":"USUBJID"', '"name":false'),
    3: ('"name":"USUBJID"', '"name":true'),
    4: ('"OID":"IT.USUBJID","name":"USUBJID"', '"OID":[],"name":""'),
    5: ('"name":"USUBJID"', '"name":null'),
    6: ('"name":"USUBJID"', '"name":7'),
    7: ('"name":"USUBJID"', '"name":"VSDTC"'),
}


def _plant(docs: DataFrame, faults: dict[int, tuple[str, str]]) -> DataFrame:
    branches = " ".join(f"WHEN {k} THEN replace(doc, {quoted(old)}, {quoted(new)})" for k, (old, new) in faults.items())
    return docs.selectExpr("doc_id", f"CASE doc_id % {max(faults) + 1} {branches} ELSE doc END AS doc")


def _group_findings(spark: SparkSession, sf: str, strict: bool) -> DataFrame:
    docs = _plant(study_documents(spark, sf, ["VS"], BLOCK), _PLANTED_IN_GROUP)
    return findings_of(sl.DatasetJson(docs).records(["VS"], strict))


# Texts that are no JSON document, by doc_id % 6: cut off, more text, another document, an open end, none at all.
_BROKEN = """CASE doc_id % 6 WHEN 1 THEN substr(doc, 1, length(doc) - 3) WHEN 2 THEN concat(doc, ' x') WHEN 3 THEN concat(doc, doc)
 WHEN 4 THEN concat(doc, '}') WHEN 5 THEN '  ' ELSE doc END"""


def _broken_documents(spark: SparkSession, sf: str) -> DataFrame:
    return study_documents(spark, sf, ["DM"], BLOCK).selectExpr("doc_id", f"{_BROKEN} AS doc")


def _documents_from_files(spark: SparkSession, sf: str) -> DataFrame:
    """Demographics out of files, one document each, a part of them broken."""
    folder = _own_folder(spark, "documents")
    _broken_documents(spark, sf).write.partitionBy("doc_id").text(folder)
    read = sl.read_documents(spark, folder).selectExpr("CAST(regexp_extract(doc_id, 'doc_id=([0-9]+)', 1) AS BIGINT) AS doc_id", "doc")
    return sl.DatasetJson(read).domain_table("DM")


# Faults planted into records, by row_index % 50.
_VS_CELLS = "USUBJID, VSTESTCD, VSORRES, VSORRESU, VSDTC"
_FAULTY_RECORD = f"""CASE row_index % 50 WHEN 0 THEN '5' WHEN 2 THEN to_json(array(USUBJID, VSTESTCD))
 WHEN 4 THEN to_json(array({_VS_CELLS}, 'x', 'y')) WHEN 6 THEN 'null' WHEN 8 THEN '{{"a":1}}'
 WHEN 10 THEN '"[1]"' ELSE to_json(array({_VS_CELLS})) END"""


def _faulty_records(spark: SparkSession, sf: str) -> sl.DatasetJson:
    return sl.DatasetJson(study_documents(spark, sf, ["VS"], BLOCK, {"VS": _FAULTY_RECORD}))


def _all_documents(spark: SparkSession, sf: str) -> DataFrame:
    return study_documents(spark, sf, X.DOMAINS, BLOCK)


def entry(spark: SparkSession) -> DataFrame:
    """All findings of a study."""
    return _all_findings(spark, "/root/testdata/sf0.001")


def _text_queries() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """Queries and SQL for training text; none if that subpackage is not installed."""
    found, sql = {}, {}
    try:
        from studylens.llm import queries as own

        found, sql = dict(own.QUERIES), dict(own.ORACLES)
        import corpus_pipeline

        found["pipeline"] = corpus_pipeline.run
        if corpus_pipeline.ORACLE_SQL is not None:
            sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    except ImportError as missing:
        if missing.name not in ("studylens.llm", "studylens.llm.queries", "corpus_pipeline"):
            raise
    return found, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def on(name: str, check: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf: check(view(spark, sf, name))

    def vs_with(other: str, check: Callable[[DataFrame, DataFrame], DataFrame], rule_id: str):
        return lambda spark, sf: _rule(check(view(spark, sf, "sdtm_vs"), view(spark, sf, f"sdtm_{other}")), rule_id)

    return {
        "vs_row_rules": on("sdtm_vs", sl.validate_vs),
        "ae_row_rules": on("sdtm_ae", sl.validate_ae),
        "ae_row_rules_streamed": _streamed,
        "dm_duplicates_streamed": _duplicates_streamed,
        "dm_link_streamed": _links_streamed,
        "cm_row_rules": on("sdtm_cm", sl.validate_cm),
        "dm_rules_sdtm": on("sdtm_dm", lambda dm: validate_rows(dm, "DM", "sdtm")),
        "dm_rules_domain": on("sdtm_dm", lambda dm: sl.validate_dm(dm, "domain")),
        "dm_duplicates_all": on("sdtm_dm", lambda dm: sl.duplicate_subjects(dm, "all")),
        "dm_duplicates_repeat": on("sdtm_dm", lambda dm: sl.duplicate_subjects(dm, "repeat")),
        "vs_missing_unit_column": on("sdtm_vs", lambda vs: sl.validate_vs(vs.drop("VSORRESU"))),
        "missing_required_columns": _missing_columns,
        "dm_link_orphans": _links,
        "vs_ae_orphans": vs_with("ae", sl.validate_vs_ae, "X_VSAE_001"),
        "vs_ae_date_range": vs_with("ae", sl.validate_vs_ae, "X_VSAE_002"),
        "vs_ae_date_tolerance": vs_with("ae", lambda vs, ae: sl.validate_vs_ae(vs, ae, 2), "X_VSAE_002"),
        "vs_cm_orphans": vs_with("cm", sl.validate_vs_cm, "X_VSCM_001"),
        "vs_cm_window": vs_with("cm", sl.validate_vs_cm, "X_VSCM_002"),
        "codelist_violations": _codelists,
        "study_findings": _all_findings,
        "study_summary": lambda spark, sf: sl.summarize(_all_findings(spark, sf)),
        "visit_flags": _visits,
        "visit_imputed": _imputed,
        "visit_flagged_rules": lambda spark, sf: sl.flagged(_visits(spark, sf)),
        "visit_report_summary": lambda spark, sf: sl.summary(_visits(spark, sf)),
        "report_preview": lambda spark, sf: sl.preview(_visits(spark, sf)),
        "visit_anomalies": _anomalies,
        "visit_anomalies_few_rows": _few_visits,
        "visit_flagged": lambda spark, sf: sl.flagged(_judged(spark, sf)),
        "visit_summary": lambda spark, sf: sl.summary(_judged(spark, sf)),
        "visits_pipeline": _visits_pipeline,
        "report_roundtrip": _report_file,
        "csv_domain_roundtrip": _dm_files,
        "csv_visits_load": _visits_loaded,
        "findings_csv_roundtrip": _findings_file,
        "file_row_index": _row_index,
        "djson_structure_findings": lambda spark, sf: sl.DatasetJson(_faulty_documents(spark, sf)).validate_top_level(),
        "djson_own_finding_type": lambda spark, sf: sl.DatasetJson(_faulty_documents(spark, sf), "INTAKE").validate_top_level(),
        "djson_list_itemgroups": lambda spark, sf: sl.DatasetJson(_all_documents(spark, sf))
        .itemgroups()
        .selectExpr("doc_id", "array_join(oids, ';') AS oids"),
        "djson_group_findings": lambda spark, sf: _group_findings(spark, sf, strict=False),
        "djson_group_findings_strict": lambda spark, sf: _group_findings(spark, sf, strict=True),
        "djson_domain_inference": lambda spark, sf: sl.DatasetJson(_faulty_documents(spark, sf)).itemgroup_oids(["VS", "DM"]),
        "djson_item_names": lambda spark, sf: sl.DatasetJson(
            _plant(study_documents(spark, sf, ["VS"], BLOCK), _PLANTED_NAMES)
        ).group_columns(["VS"]).selectExpr("doc_id", "oid", "array_join(item_names, ';') AS names"),
        "djson_unreadable": lambda spark, sf: sl.DatasetJson(_broken_documents(spark, sf)).validate_top_level(),
        "djson_read_files": _documents_from_files,
        "djson_extract_dm": lambda spark, sf: sl.DatasetJson(study_documents(spark, sf, ["DM"], BLOCK)).domain_table("DM"),
        "djson_extract_faulty_vs": lambda spark, sf: _faulty_records(spark, sf).domain_table("VS", _VS_CELLS.split(", ")),
        "djson_record_findings": lambda spark, sf: findings_of(_faulty_records(spark, sf).records(["VS"])),
        "djson_study_findings": lambda spark, sf: sl.validate_documents(_all_documents(spark, sf)).findings,
        **_text_queries()[0],
    }


# -- the same in SQL -----------------------------------------------------------


def _with(views: list[str], body: str) -> str:
    heads = ", ".join(f"{v} AS ({view_sql(v)})" for v in views)
    return f"WITH {heads} {body}"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _d(x: str) -> str:
    return f"CASE WHEN regexp_full_match({x}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN CAST(try_strptime({x}, '%Y-%m-%d') AS DATE) END"


def _n(x: str) -> str:
    return f"CASE WHEN regexp_full_match({x}, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST({x} AS DOUBLE) END"


def _in(terms: list[str]) -> str:
    return "(" + ", ".join(map(_q, terms)) + ")"


def _select(
    source: str, where: str, finding_type: str, rule_id: str, domain: str, text: tuple[str, str, str], evidence: str,
    row_index: str = "row_index", usubjid: str = "USUBJID", extra: str = "",
) -> str:
    severity, field, message = text
    return (
        f"SELECT {extra}{_q(finding_type)} AS finding_type, {_q(rule_id)} AS rule_id, {_q(severity)} AS severity,"
        f" {_q(domain)} AS domain, {_q(field)} AS field, {_q(message)} AS message,"
        f" CAST({row_index} AS BIGINT) AS row_index, {usubjid} AS usubjid, {evidence} AS evidence FROM {source} WHERE {where}"
    )


def _blank(x: str) -> str:
    return f"({x} IS NULL OR trim({x}) = '')"


def _bad(x: str) -> str:
    return f"{x} IS NOT NULL AND ({_d(x)}) IS NULL"


def _units() -> str:
    return " OR ".join(
        f"(VSTESTCD = {_q(t)} AND VSORRESU IS NOT NULL AND VSORRESU NOT IN {_in(u)})" for t, u in X.UNITS_OF_TEST.items()
    )


def _checks() -> dict[str, list[tuple[str, str, str]]]:
    """rule set -> (rule id, condition, evidence)."""
    age = f"({_n('AGE')})"
    return {
        "VS": [
            ("SDTM_VS_001", _blank("USUBJID"), "USUBJID"),
            ("SDTM_VS_002", f"VSTESTCD NOT IN {_in(X.VSTESTCD_TERMS)}", "VSTESTCD"),
            ("SDTM_VS_003", _bad("VSDTC"), "VSDTC"),
            (
                "SDTM_VS_004",
                f"VSTESTCD IN {_in(X.VSTESTCD_TERMS)} AND VSORRES IS NOT NULL AND ({_n('replace(VSORRES, chr(44), chr(46))')}) IS NULL",
                "VSORRES",
            ),
            ("SDTM_VS_005", _units(), "VSTESTCD || ' / ' || VSORRESU"),
        ],
        "AE": [
            ("SDTM_AE_001", _blank("AETERM"), "AETERM"),
            ("SDTM_AE_002", _bad("AESTDTC"), "AESTDTC"),
            ("SDTM_AE_003", _bad("AEENDTC"), "AEENDTC"),
            ("SDTM_AE_004", f"({_d('AESTDTC')}) > ({_d('AEENDTC')})", "AESTDTC || ' > ' || AEENDTC"),
            ("SDTM_AE_005", "AESER NOT IN ('Y', 'N')", "AESER"),
            ("SDTM_AE_006", "AESEV NOT IN ('MILD', 'MODERATE', 'SEVERE')", "AESEV"),
        ],
        "CM": [
            ("SDTM_CM_001", _blank("CMTRT"), "CMTRT"),
            ("SDTM_CM_002", _bad("CMSTDTC"), "CMSTDTC"),
            ("SDTM_CM_003", _bad("CMENDTC"), "CMENDTC"),
            ("SDTM_CM_004", f"({_d('CMSTDTC')}) > ({_d('CMENDTC')})", "CMSTDTC || ' > ' || CMENDTC"),
        ],
        "DM_SDTM": [
            ("SDTM_DM_001", _blank("USUBJID"), "USUBJID"),
            ("SDTM_DM_003", _blank("STUDYID"), "STUDYID"),
            ("SDTM_DM_004", "SEX NOT IN ('M', 'F', 'U')", "SEX"),
            ("SDTM_DM_005", f"{age} < 0 OR {age} > 120", "AGE"),
            ("SDTM_DM_006", "NOT regexp_full_match(RFSTDTC, '[0-9]{4}-[0-9]{2}-[0-9]{2}')", "RFSTDTC"),
        ],
        "DM_DOMAIN": [
            ("SDTM_DM_001", _blank("USUBJID"), "USUBJID"),
            ("SDTM_DM_003", "SEX NOT IN ('M', 'F', 'U')", "SEX"),
            ("SDTM_DM_004", f"{age} < 0 OR {age} > 120", "AGE"),
            ("SDTM_DM_005", f"{age} IS NOT NULL AND (AGEU IS NULL OR AGEU NOT IN ('YEARS', 'MONTHS', 'DAYS'))", "AGEU"),
            ("SDTM_DM_006", _bad("RFSTDTC"), "RFSTDTC"),
            ("SDTM_DM_007", _bad("RFENDTC"), "RFENDTC"),
            ("SDTM_DM_008", f"({_d('RFSTDTC')}) > ({_d('RFENDTC')})", "RFSTDTC || ' > ' || RFENDTC"),
        ],
    }


_RULE_TEXTS = {
    "VS": X.VS_TEXTS, "AE": X.AE_TEXTS, "CM": X.CM_TEXTS, "DM_SDTM": X.DM_SDTM_TEXTS, "DM_DOMAIN": X.DM_DOMAIN_TEXTS,
}


def _rules(rule_set: str, source: str | None = None, extra: str = "", skip: tuple[str, ...] = ()) -> str:
    domain = rule_set[:2]
    return " UNION ALL ".join(
        _select(
            source or f"sdtm_{domain.lower()}", where, "SDTM_RULE", rule_id, domain, _RULE_TEXTS[rule_set][rule_id],
            evidence, extra=extra,
        )
        for rule_id, where, evidence in _checks()[rule_set]
        if rule_id not in skip
    )


def _duplicates(mode: str, blank_is_a_key: bool = True, source: str = "sdtm_dm", by: str = "USUBJID", extra: str = "") -> str:
    measure = (
        f"count(*) OVER (PARTITION BY {by})" if mode == "all" else f"row_number() OVER (PARTITION BY {by} ORDER BY row_index)"
    )
    kept = "USUBJID IS NOT NULL" if blank_is_a_key else f"NOT {_blank('USUBJID')}"
    return _select(
        f"(SELECT *, {measure} AS m FROM {source} WHERE {kept})", "m > 1", "SDTM_RULE", "SDTM_DM_002", "DM",
        X.DM_SDTM_TEXTS["SDTM_DM_002"], "USUBJID", extra=extra,
    )


def _orphans(rule_id: str, text: tuple[str, str, str], of: str, against: str) -> str:
    return _select(
        f"sdtm_{of} o", f"NOT EXISTS (SELECT 1 FROM sdtm_{against} k WHERE k.USUBJID = o.USUBJID)", "CROSS_DOMAIN",
        rule_id, "CROSS", text, "USUBJID",
    )


def _link_text(domain: str) -> tuple[str, str, str]:
    severity, field, message = X.DM_LINK_TEXTS["001"]
    return severity, field, message.replace("%s", domain)


def _all_links() -> str:
    return " UNION ALL ".join(_orphans(f"X_DMLINK_{d}_001", _link_text(d), d.lower(), "dm") for d in ("VS", "AE", "CM"))


def _ae_range(days: int = 0) -> str:
    ranges = f"(SELECT USUBJID AS k, min({_d('VSDTC')}) AS lo, max({_d('VSDTC')}) AS hi FROM sdtm_vs GROUP BY 1)"
    source = f"(SELECT a.*, lo, hi, {_d('AESTDTC')} AS dt FROM sdtm_ae a JOIN {ranges} r ON r.k = a.USUBJID)"
    return _select(
        source, f"dt < lo - {days} OR dt > hi + {days}", "CROSS_DOMAIN", "X_VSAE_002", "CROSS", X.CROSS_TEXTS["X_VSAE_002"],
        "AESTDTC || ' vs [' || CAST(lo AS STRING) || ', ' || CAST(hi AS STRING) || ']'",
    )


def _cm_window() -> str:
    windows = (
        f"(SELECT USUBJID AS k, min({_d('CMSTDTC')}) AS lo, max({_d('CMENDTC')}) AS hi FROM sdtm_cm"
        f" WHERE ({_d('CMSTDTC')}) IS NOT NULL GROUP BY 1)"
    )
    source = f"(SELECT v.*, lo, hi, {_d('VSDTC')} AS dt FROM sdtm_vs v JOIN {windows} w ON w.k = v.USUBJID)"
    return _select(
        source, "hi IS NOT NULL AND (dt < lo OR dt > hi)", "CROSS_DOMAIN", "X_VSCM_002", "CROSS",
        X.CROSS_TEXTS["X_VSCM_002"], "VSDTC || ' vs [' || CAST(lo AS STRING) || ', ' || CAST(hi AS STRING) || ']'",
    )


def _vsae_orphans() -> str:
    return _orphans("X_VSAE_001", X.CROSS_TEXTS["X_VSAE_001"], "ae", "vs")


def _vscm_orphans() -> str:
    return _orphans("X_VSCM_001", X.CROSS_TEXTS["X_VSCM_001"], "cm", "vs")


_STUDY_VIEWS = ["sdtm_dm", "sdtm_vs", "sdtm_ae", "sdtm_cm"]


def _study_sql() -> str:
    return " UNION ALL ".join(
        [
            _rules("DM_SDTM"), _duplicates("all"), _rules("VS"), _rules("AE"), _rules("CM"), _all_links(),
            _vsae_orphans(), _ae_range(), _vscm_orphans(), _cm_window(),
        ]
    )


def _about_table(finding_type: str, rule_id: str, domain: str, text: tuple[str, str, str]) -> str:
    return _select("(SELECT 1) t", "TRUE", finding_type, rule_id, domain, text, "''", "-1", "''")


def _missing_sql() -> str:
    def required(domain: str, finding_type: str, *missing: str) -> str:
        message = f"Missing required columns for {domain}: {list(missing)}"
        return _about_table(finding_type, f"SDTM_{domain}_000", domain, ("CRIT", ",".join(missing), message))

    # Without the id column the other rules of the sdtm profile still run.
    remaining = _rules("DM_SDTM", "(SELECT * REPLACE ('' AS USUBJID) FROM sdtm_dm)", skip=("SDTM_DM_001",))
    parts = [
        required("VS", "SDTM_RULE", "VSORRES", "VSDTC"),
        required("AE", "SDTM_RULE", "AETERM"),
        required("CM", "SDTM_RULE", "USUBJID"),
        required("DM", "CROSS_DOMAIN", "USUBJID"),
        remaining,
        _about_table("SDTM_RULE", "SDTM_DM_001", "DM", ("HIGH", "USUBJID", "Missing required column USUBJID.")),
        _about_table("CROSS_DOMAIN", "X_DMLINK_AE_000", "CROSS", ("CRIT", "USUBJID", "Missing USUBJID for DM/AE link check.")),
        _about_table("CROSS_DOMAIN", "X_VSAE_000", "CROSS", X.CROSS_TEXTS["X_VSAE_000"]),
        _about_table("CROSS_DOMAIN", "X_VSCM_000", "CROSS", X.CROSS_TEXTS["X_VSCM_000"]),
    ]
    return _with(["sdtm_dm"], " UNION ALL ".join(parts))


def _codelist_sql() -> str:
    # The codelist file differs from the rules: it knows no U for SEX.
    lists = {"SEX": ["M", "F"], "VSTESTCD": X.VSTESTCD_TERMS, "AESER": X.AESER_TERMS, "AESEV": X.AESEV_TERMS}
    parts = [
        f"SELECT '{v}' AS source, row_index, '{f}' AS field, {f} AS value FROM {v} WHERE {f} NOT IN {_in(lists[f])}"
        for v, fields in CODED_FIELDS.items()
        for f in fields
    ]
    return _with(list(CODED_FIELDS), " UNION ALL ".join(parts))


def _flags_cte(source: str | None = None) -> str:
    """``flags``: the visit records, or those of ``source``, with numbers and flags."""
    whole = "CASE WHEN regexp_full_match(age, '[+-]?[0-9]+') THEN TRY_CAST(age AS BIGINT) END"
    return (
        f"visit_records AS ({source or view_sql('visit_records')}), nums AS (SELECT *, {whole} AS age_num,"
        f" {_n('systolic_bp')} AS systolic_bp_num, {_n('treatment_dose')} AS treatment_dose_num FROM visit_records),"
        " flags AS (SELECT *, CASE WHEN age_num BETWEEN 18 AND 100 THEN 1 ELSE 0 END AS age_valid,"
        " CASE WHEN systolic_bp_num BETWEEN 90 AND 180 THEN 1 ELSE 0 END AS bp_valid,"
        " CASE WHEN treatment_dose_num > 0 THEN 1 ELSE 0 END AS dose_valid,"
        " CASE WHEN visit_date IS NOT NULL THEN 1 ELSE 0 END AS date_valid FROM nums)"
    )


def _forest_cte() -> str:
    """``judged``: the visits with ``anomaly``, by the forest's own draws repeated here; needs 256 visits or more."""
    levels, starts, ring = 8, 10, 2**52 // 10 * 10
    step = ring // starts

    def drawn(text: str, first: str) -> str:
        return f"('0x' || substr(md5({text}), {first}, 13))::BIGINT"

    def finite(c: str) -> str:
        return f"CASE WHEN isfinite(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END"

    filled = ", ".join(f"coalesce({finite(c)}, (SELECT median({finite(c)}) FROM flags), 0) AS {c}" for c in NUMBERS)
    ranges = ", ".join(f"{{'i': {i}, 'low': min(x[{i}]) OVER w, 'high': max(x[{i}]) OVER w}}" for i in (1, 2, 3))
    ctes = [
        f"filled AS MATERIALIZED (SELECT row_index, {filled} FROM flags)",
        f"points AS (SELECT row_index, [{', '.join(NUMBERS)}] AS x FROM filled)",
        f"""hashed AS (SELECT row_index, x, g, {drawn("'42:' || (g // 2) || ':' || row_index", "1 + 13 * (g % 2)")} % {ring} AS h
 FROM points, range({starts}) groups(g))""",
        f"""moved0 AS MATERIALIZED (SELECT {starts} * g + j AS tree, x, 1::BIGINT AS node FROM hashed, range({starts}) s(j)
 QUALIFY row_number() OVER (PARTITION BY g, j ORDER BY (h - j * {step} + {ring}) % {ring}, row_index) <= 256)""",
    ]
    for k in range(levels):
        ctes += [
            f"""ranged{k} AS (SELECT tree, x, node, count(*) OVER w AS n, [{ranges}] AS r, md5('42:' || tree || ':' || node) AS m
 FROM moved{k} WINDOW w AS (PARTITION BY tree, node))""",
            f"usable{k} AS (SELECT *, [q FOR q IN r IF q.high > q.low] AS u FROM ranged{k})",
            f"""picked{k} AS (SELECT *, CASE WHEN len(u) > 0 THEN u[('0x' || substr(m, 1, 13))::BIGINT % len(u) + 1] END AS p,
 ('0x' || substr(m, 14, 13))::BIGINT / {2**52}::DOUBLE AS share FROM usable{k})""",
            f"split{k} AS MATERIALIZED (SELECT tree, x, node, n, p.i AS feature, p.low + share * (p.high - p.low) AS border FROM picked{k})",
            f"""moved{k + 1} AS MATERIALIZED (SELECT tree, x,
 CASE WHEN feature IS NULL THEN node ELSE 2 * node + (x[feature] > border)::INTEGER END AS node FROM split{k})""",
        ]
    nodes = [f"SELECT DISTINCT tree, node, n, feature, border FROM split{k}" for k in range(levels)]
    nodes.append(f"SELECT tree, node, count(*) AS n, NULL AS feature, NULL AS border FROM moved{levels} WHERE node >= {2**levels} GROUP BY tree, node")
    ctes.append(f"nodes AS MATERIALIZED ({' UNION '.join(nodes)})")
    ctes.append("walk0 AS (SELECT row_index, x, tree, 1::BIGINT AS node FROM points, range(100) t(tree))")
    for k in range(levels):
        ctes.append(
            f"""walk{k + 1} AS (SELECT row_index, x, w.tree, CASE WHEN feature IS NULL THEN w.node ELSE 2 * w.node + (x[feature] > border)::INTEGER END AS node
 FROM walk{k} w LEFT JOIN nodes USING (tree, node))"""
        )
    mean = "CASE WHEN n > 2 THEN 2 * (ln(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n WHEN n = 2 THEN 1 ELSE 0 END"
    ctes += [
        f"""paths AS (SELECT row_index, sum(CAST(round((length(bin(node)) - 1 + {mean}) * {2**20}) AS BIGINT)) AS path
 FROM walk{levels} LEFT JOIN nodes USING (tree, node) GROUP BY row_index)""",
        "ranked AS (SELECT path, row_number() OVER (ORDER BY path DESC) - 1 AS place, count(*) OVER () AS total FROM paths)",
        "cut AS (SELECT path AS least FROM ranked WHERE place = (total - 1) * 9 // 10)",
        "judged AS (SELECT flags.*, CASE WHEN path < least THEN 1 ELSE 0 END AS anomaly FROM flags JOIN paths USING (row_index), cut)",
    ]
    return ", ".join(ctes)


_INVALID = "age_valid = 0 OR bp_valid = 0 OR dose_valid = 0 OR date_valid = 0"


def _dj(rule_id: str, field: str, evidence: str, where: str, source: str, row_index: str = "-1", message: str | None = None) -> str:
    severity, text = X.DJ_TEXTS[rule_id]
    return (
        f"SELECT doc_id, 'DATASET_JSON' AS finding_type, '{rule_id}' AS rule_id, '{severity}' AS severity,"
        f" 'DATASET_JSON' AS domain, {field} AS field, {_q(message or text)} AS message, CAST({row_index} AS BIGINT) AS row_index,"
        f" '' AS usubjid, {evidence} AS evidence FROM {source} WHERE {where}"
    )


_VS_DOCS = f"docs AS (SELECT DISTINCT row_index // {BLOCK} AS doc_id FROM sdtm_vs)"


def _structure_sql() -> str:
    root, groups = "'clinicalData/referenceData'", "'itemGroupData'"
    parts = [
        _dj("DJ_002", root, "'<class ''str''>'", "doc_id % 12 = 8", "docs"),
        _dj("DJ_002", root, "'<class ''list''>'", "doc_id % 12 = 9", "docs"),
        _dj("DJ_004", groups, "'<class ''str''>'", "doc_id % 12 = 10", "docs"),
        _dj("DJ_004", groups, "'<class ''NoneType''>'", "doc_id % 12 = 11", "docs"),
        _dj("DJ_000", "'creationDateTime'", "''", "doc_id % 12 = 1", "docs", message="Missing required top-level attribute: creationDateTime"),
        _dj("DJ_002", root, "'<class ''NoneType''>'", "doc_id % 12 = 2", "docs"),
        _dj("DJ_001", root, "''", "doc_id % 12 = 3", "docs"),
        _dj("DJ_003", groups, "''", "doc_id % 12 = 4", "docs"),
        _dj("DJ_004", groups, "'<class ''float''>'", "doc_id % 12 = 5", "docs"),
    ]
    return _with(["sdtm_vs"], f", {_VS_DOCS} " + " UNION ALL ".join(parts))


def _group_findings_sql(strict: bool) -> str:
    items, data, none = "'IG.VS.items'", "'IG.VS.itemData'", "'<class ''NoneType''>'"

    def dj(rule_id: str, field: str, evidence: str, *faults: int) -> str:
        return _dj(rule_id, field, evidence, f"doc_id % 11 IN ({', '.join(map(str, faults))})", "docs")

    parts = [
        dj("DJ_101", items, "''", 1, 6, 8, 10),
        dj("DJ_102", data, none, 2),
        dj("DJ_103", "'IG.VS.items[0]'", "'<class ''int''>'", 3),
        dj("DJ_103", "'IG.VS.items[1]'", none, 3),
        dj("DJ_102", data, "'<class ''str''>'", 4, 9),
        _dj("DJ_100", "'itemGroupData'", "'IG.VS;OTHER'", "doc_id % 11 IN (5, 7)", "docs", message="ItemGroup 'IG.VS' not found in itemGroupData."),
    ]
    if not strict:
        parts.append(dj("DJ_104", items, "''", 1, 6, 8, 10))
        # A text is gone through by character, an object by key.
        parts += [dj("DJ_103", f"'IG.VS.items[{i}]'", "'<class ''str''>'", *([8, 10] if i < 2 else [8])) for i in range(4)]
    return _with(["sdtm_vs"], f", {_VS_DOCS} " + " UNION ALL ".join(parts))


def _oids_sql() -> str:
    docs = " UNION ALL ".join(f"SELECT row_index // {BLOCK} AS doc_id, {i} AS place, 'IG.{d}' AS oid FROM sdtm_{d.lower()}" for i, d in enumerate(X.DOMAINS))
    return _with(_STUDY_VIEWS, f"SELECT doc_id, string_agg(oid, ';' ORDER BY place) AS oids FROM (SELECT DISTINCT * FROM ({docs})) GROUP BY doc_id")


def _inference_sql() -> str:
    oid = "CASE WHEN doc_id % 12 IN (0, 1, 6) THEN 'IG.VS' WHEN doc_id % 12 = 7 THEN 'IG.QVS' END"
    return _with(
        ["sdtm_vs"],
        f", {_VS_DOCS} SELECT doc_id, 'VS' AS domain, {oid} AS oid FROM docs"
        " UNION ALL SELECT doc_id, 'DM' AS domain, CAST(NULL AS STRING) AS oid FROM docs",
    )


def _in_documents(v: str) -> str:
    """A view with its document and its place there as row_index."""
    return (
        f"(SELECT * REPLACE (row_number() OVER (PARTITION BY row_index // {BLOCK} ORDER BY row_index) - 1 AS row_index),"
        f" row_index // {BLOCK} AS doc_id FROM {v})"
    )


def _faulty_cte() -> str:
    return (
        f"placed AS (SELECT *, row_index // {BLOCK} AS doc_id, row_index % 50 AS fault,"
        f" row_number() OVER (PARTITION BY row_index // {BLOCK} ORDER BY row_index) - 1 AS src_index FROM sdtm_vs)"
    )


def _record_findings_sql() -> str:
    place = "'IG.VS.itemData[' || CAST(src_index AS STRING) || ']'"
    kinds = "CASE fault WHEN 0 THEN '<class ''int''>' WHEN 6 THEN '<class ''NoneType''>' WHEN 8 THEN '<class ''dict''>' ELSE '<class ''str''>' END"
    lengths = "CASE fault WHEN 2 THEN 'len(record)=2 len(items)=5' ELSE 'len(record)=7 len(items)=5' END"
    parts = [
        _dj("DJ_105", place, kinds, "fault IN (0, 6, 8, 10)", "placed", "src_index"),
        _dj("DJ_106", place, lengths, "fault IN (2, 4)", "placed", "src_index"),
    ]
    return _with(["sdtm_vs"], f", {_faulty_cte()} " + " UNION ALL ".join(parts))


def _faulty_vs_sql() -> str:
    cut = ", ".join(f"CASE WHEN fault <> 2 THEN {c} END AS {c}" for c in ("VSORRES", "VSORRESU", "VSDTC"))
    return _with(
        ["sdtm_vs"],
        f", {_faulty_cte()} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY src_index) - 1 AS row_index,"
        f" src_index, USUBJID, VSTESTCD, {cut} FROM placed WHERE fault NOT IN (0, 6, 8, 10)",
    )


def _documents_sql() -> str:
    ctes = ", ".join(f"d_{d.lower()} AS (SELECT * FROM {_in_documents(f'sdtm_{d.lower()}')})" for d in X.DOMAINS)
    docs = " UNION ".join(f"SELECT doc_id FROM d_{d.lower()}" for d in X.DOMAINS)
    oids = " || ".join(
        f"(CASE WHEN doc_id IN (SELECT doc_id FROM d_{d.lower()}) THEN ';IG.{d}' ELSE '' END)" for d in X.DOMAINS
    )
    parts = [
        _dj(
            "DJ_110", "'domain'", f"substr({oids}, 2)", f"doc_id NOT IN (SELECT doc_id FROM d_{d.lower()})", "docs",
            message=f"Could not infer itemGroup OID for domain '{d}'.",
        )
        for d in X.DOMAINS
    ]
    parts += [_rules(r, f"d_{r[:2].lower()}", "doc_id, ") for r in ("DM_SDTM", "VS", "AE", "CM")]
    parts.append(_duplicates("all", source="d_dm", by="doc_id, USUBJID", extra="doc_id, "))
    for d in ("VS", "AE", "CM"):
        linked = "doc_id IN (SELECT doc_id FROM d_dm)"
        orphan = "NOT EXISTS (SELECT 1 FROM d_dm k WHERE k.doc_id = o.doc_id AND k.USUBJID = o.USUBJID)"
        parts.append(
            _select(
                f"d_{d.lower()} o", f"{linked} AND {orphan}", "CROSS_DOMAIN", f"X_DMLINK_{d}_001", "CROSS", _link_text(d),
                "USUBJID", extra="doc_id, ",
            )
        )
    return _with(_STUDY_VIEWS, f", {ctes}, docs AS ({docs}) " + " UNION ALL ".join(parts))


def oracle_sql() -> dict[str, str]:
    severity, field, message = X.VS_UNIT_COLUMN_ABSENT
    no_unit = _about_table("SDTM_RULE", "SDTM_VS_005", "VS", (severity, field, message))
    flags = _flags_cte()
    imputed = ", ".join(
        f"coalesce(CAST({c} AS DOUBLE), (SELECT median(CAST({c} AS DOUBLE)) FROM flags)) AS {c}" for c in NUMBERS
    )
    totals = f"count(*) AS total_records, count(*) FILTER (WHERE {_INVALID} OR anomaly = 1) AS flagged_records"
    few = (
        f"SELECT {', '.join(_FEW_VISITS)} FROM (SELECT o_orderpriority, max(o_totalprice) AS o_totalprice, max(o_custkey) AS o_custkey,"
        " max(o_orderkey) AS n, max(o_orderdate) AS o_orderdate FROM orders GROUP BY o_orderpriority)"
    )
    # In the report every value is text.
    numbers = [f"CAST({c} AS VARCHAR) AS {c}" for c in ("row_index", "age_num", "age_valid", "bp_valid", "dose_valid", "date_valid", "anomaly", *NUMBERS[1:])]
    report = ", ".join(["age, systolic_bp, treatment_dose, visit_date", *numbers])
    of_rules = report.replace(", CAST(anomaly AS VARCHAR) AS anomaly", "")
    rule_totals = f"count(*) AS total_records, count(*) FILTER (WHERE {_INVALID}) AS flagged_records"
    loaded = f"SELECT * REPLACE (row_number() OVER (ORDER BY row_index) - 1 AS row_index) FROM ({view_sql('visit_records')})"
    dm_columns = "STUDYID, USUBJID, SEX, AGE, AGEU, RFSTDTC, RFENDTC"
    return {
        "vs_row_rules": _with(["sdtm_vs"], _rules("VS")),
        "ae_row_rules": _with(["sdtm_ae"], _rules("AE")),
        "ae_row_rules_streamed": _with(["sdtm_ae"], _rules("AE")),
        "dm_duplicates_streamed": _with(["sdtm_dm"], _duplicates("all")),
        "dm_link_streamed": _with(["sdtm_dm", "sdtm_ae"], _orphans("X_DMLINK_AE_001", _link_text("AE"), "ae", "dm")),
        "cm_row_rules": _with(["sdtm_cm"], _rules("CM")),
        "dm_rules_sdtm": _with(["sdtm_dm"], _rules("DM_SDTM")),
        "dm_rules_domain": _with(["sdtm_dm"], f"{_rules('DM_DOMAIN')} UNION ALL {_duplicates('all', blank_is_a_key=False)}"),
        "dm_duplicates_all": _with(["sdtm_dm"], _duplicates("all")),
        "dm_duplicates_repeat": _with(["sdtm_dm"], _duplicates("repeat")),
        "vs_missing_unit_column": _with(["sdtm_vs"], f"{_rules('VS', skip=('SDTM_VS_005',))} UNION ALL {no_unit}"),
        "missing_required_columns": _missing_sql(),
        "dm_link_orphans": _with(_STUDY_VIEWS, _all_links()),
        "vs_ae_orphans": _with(["sdtm_vs", "sdtm_ae"], _vsae_orphans()),
        "vs_ae_date_range": _with(["sdtm_vs", "sdtm_ae"], _ae_range()),
        "vs_ae_date_tolerance": _with(["sdtm_vs", "sdtm_ae"], _ae_range(2)),
        "vs_cm_orphans": _with(["sdtm_vs", "sdtm_cm"], _vscm_orphans()),
        "vs_cm_window": _with(["sdtm_vs", "sdtm_cm"], _cm_window()),
        "codelist_violations": _codelist_sql(),
        "study_findings": _with(_STUDY_VIEWS, _study_sql()),
        "study_summary": _with(
            _STUDY_VIEWS,
            "SELECT domain, severity, rule_id, count(*) AS n_findings, count(DISTINCT usubjid) AS n_subjects"
            f" FROM ({_study_sql()}) GROUP BY domain, severity, rule_id",
        ),
        "visit_flags": f"WITH {flags} SELECT * FROM flags",
        "visit_imputed": f"WITH {flags} SELECT row_index, {imputed} FROM flags",
        "visit_anomalies": f"WITH {flags}, {_forest_cte()} SELECT row_index, {', '.join(NUMBERS)}, anomaly FROM judged",
        "visit_anomalies_few_rows": f"WITH {_flags_cte(few)} SELECT row_index, {', '.join(NUMBERS)}, 0 AS anomaly FROM flags",
        "visit_flagged": f"WITH {flags}, {_forest_cte()} SELECT * FROM judged WHERE {_INVALID} OR anomaly = 1",
        "visit_summary": f"WITH {flags}, {_forest_cte()} SELECT {totals} FROM judged",
        "visits_pipeline": f"WITH {_flags_cte(loaded)}, {_forest_cte()} SELECT {report}, t.* FROM judged, (SELECT {totals} FROM judged) t WHERE {_INVALID} OR anomaly = 1",
        "visit_flagged_rules": f"WITH {flags} SELECT * FROM flags WHERE {_INVALID}",
        "visit_report_summary": f"WITH {flags} SELECT count(*) AS total_records, count(*) FILTER (WHERE {_INVALID}) AS flagged_records FROM flags",
        "report_preview": f"WITH {flags} SELECT * FROM flags WHERE {_INVALID} ORDER BY row_index LIMIT 25",
        "report_roundtrip": f"WITH {flags} SELECT {of_rules}, t.* FROM flags, (SELECT {rule_totals} FROM flags) t WHERE {_INVALID}",
        "csv_domain_roundtrip": _with(
            ["sdtm_dm"],
            "SELECT row_number() OVER (ORDER BY row_index % 2, row_index) - 1 AS row_index, STUDYID, USUBJID, SEX,"
            " CASE WHEN row_index % 2 = 0 THEN AGE END AS AGE,"
            " CASE WHEN row_index % 2 = 1 THEN 'seen' || chr(10) || 'by ' || USUBJID || ', \"MD\"' END AS NOTE FROM sdtm_dm",
        ),
        "csv_visits_load": loaded,
        "findings_csv_roundtrip": _with(_STUDY_VIEWS, f"SELECT * REPLACE (CAST(row_index AS VARCHAR) AS row_index) FROM ({_study_sql()})"),
        "file_row_index": "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index, o_orderkey FROM orders",
        "djson_structure_findings": _structure_sql(),
        "djson_own_finding_type": f"SELECT * REPLACE ('INTAKE' AS finding_type) FROM ({_structure_sql()})",
        "djson_list_itemgroups": _oids_sql(),
        "djson_group_findings": _group_findings_sql(strict=False),
        "djson_group_findings_strict": _group_findings_sql(strict=True),
        "djson_domain_inference": _inference_sql(),
        "djson_item_names": _with(
            ["sdtm_vs"],
            f", {_VS_DOCS} SELECT doc_id, 'IG.VS' AS oid, CASE doc_id % 8 WHEN 0 THEN 'USUBJID' WHEN 3 THEN 'True' WHEN 4 THEN 'COL_0'"
            " WHEN 6 THEN '7' WHEN 7 THEN 'VSDTC' ELSE 'IT.USUBJID' END || ';VSTESTCD;VSORRES;VSORRESU;VSDTC'"
            " || CASE WHEN doc_id % 8 = 7 THEN '_2' ELSE '' END AS names FROM docs",
        ),
        "djson_unreadable": _with(
            ["sdtm_dm"],
            f", docs AS (SELECT DISTINCT row_index // {BLOCK} AS doc_id FROM sdtm_dm) "
            + _dj(X.DJ_UNREADABLE, "'document'", """CASE WHEN doc_id % 6 = 5 THEN '  ' ELSE '{"creationDateTime":' END""", "doc_id % 6 <> 0", "docs"),
        ),
        "djson_read_files": _with(
            ["sdtm_dm"],
            f"SELECT doc_id, row_index, row_index AS src_index, {dm_columns} FROM {_in_documents('sdtm_dm')} WHERE doc_id % 6 = 0",
        ),
        "djson_extract_dm": _with(
            ["sdtm_dm"], f"SELECT doc_id, row_index, row_index AS src_index, {dm_columns} FROM {_in_documents('sdtm_dm')}"
        ),
        "djson_extract_faulty_vs": _faulty_vs_sql(),
        "djson_record_findings": _record_findings_sql(),
        "djson_study_findings": _documents_sql(),
        **_text_queries()[1],
    }
