"""Whole studies from CSV, with every finding known."""

import random

import pytest

import studylens as sl
from studylens.operators.findings import FINDINGS

STUDY = {
    "dm": """STUDYID,DOMAIN,USUBJID,SEX,AGE,AGEU,RFSTDTC,RFENDTC
T1,DM,T1-01,F,51,YEARS,2025-03-01,2025-03-20
T1,DM,T1-02,M,29,YEARS,2025-03-02,2025-03-21
T1,DM,T1-02,M,29,YEARS,2025-03-02,2025-03-21
,DM,T1-03,?,-4,YEARS,2025-3-2,2025-03-01
T1,DM,,U,60,YEARS,2025-03-04,
""",
    "vs": """STUDYID,DOMAIN,USUBJID,VSTESTCD,VSORRES,VSORRESU,VSDTC
T1,VS,T1-01,TEMP,"36,9",C,2025-03-02
T1,VS,T1-01,TEMP,38.1,K,2025-03-09
T1,VS,T1-02,HEIGHT,tall,cm,2025-03-05
T1,VS,T1-77,BMI,22,kg/m2,2025-03-06
T1,VS,,RESP,14,bpm,2025-02-30
""",
    "ae": """STUDYID,DOMAIN,USUBJID,AETERM,AESTDTC,AEENDTC,AESER,AESEV
T1,AE,T1-01,Cough,2025-03-01,2025-03-03,N,MILD
T1,AE,T1-01,Fever,2025-03-09,2025-03-08,Y,MODERATE
T1,AE,T1-02,,2025-03-05,soon,N,HUGE
T1,AE,T1-03,Itch,March,2025-03-08,?,SEVERE
""",
    "cm": """STUDYID,DOMAIN,USUBJID,CMTRT,CMSTDTC,CMENDTC
T1,CM,T1-01,Syrup,2025-03-03,2025-03-08
T1,CM,T1-88,Cream,2025-03-03,2025-03-02
T1,CM,T1-02, ,x,y
""",
}

EXPECTED = {
    "SDTM_DM_001": [(4, None, None)],
    "SDTM_DM_002": [(1, "T1-02", "T1-02"), (2, "T1-02", "T1-02")],
    "SDTM_DM_003": [(3, "T1-03", None)],
    "SDTM_DM_004": [(3, "T1-03", "?")],
    "SDTM_DM_005": [(3, "T1-03", "-4")],
    "SDTM_DM_006": [(3, "T1-03", "2025-3-2")],
    "SDTM_VS_001": [(4, None, None)],
    "SDTM_VS_002": [(3, "T1-77", "BMI")],
    "SDTM_VS_003": [(4, None, "2025-02-30")],
    "SDTM_VS_004": [(2, "T1-02", "tall")],
    "SDTM_VS_005": [(1, "T1-01", "TEMP / K")],
    "SDTM_AE_001": [(2, "T1-02", None)],
    "SDTM_AE_002": [(3, "T1-03", "March")],
    "SDTM_AE_003": [(2, "T1-02", "soon")],
    "SDTM_AE_004": [(1, "T1-01", "2025-03-09 > 2025-03-08")],
    "SDTM_AE_005": [(3, "T1-03", "?")],
    "SDTM_AE_006": [(2, "T1-02", "HUGE")],
    "SDTM_CM_001": [(2, "T1-02", " ")],
    "SDTM_CM_002": [(2, "T1-02", "x")],
    "SDTM_CM_003": [(2, "T1-02", "y")],
    "SDTM_CM_004": [(1, "T1-88", "2025-03-03 > 2025-03-02")],
    "X_DMLINK_VS_001": [(3, "T1-77", "T1-77"), (4, None, None)],
    "X_DMLINK_CM_001": [(1, "T1-88", "T1-88")],
    "X_VSAE_001": [(3, "T1-03", "T1-03")],
    "X_VSAE_002": [(0, "T1-01", "2025-03-01 vs [2025-03-02, 2025-03-09]")],
    "X_VSCM_001": [(1, "T1-88", "T1-88")],
    "X_VSCM_002": [
        (0, "T1-01", "2025-03-02 vs [2025-03-03, 2025-03-08]"),
        (1, "T1-01", "2025-03-09 vs [2025-03-03, 2025-03-08]"),
    ],
}


@pytest.fixture(scope="module")
def study(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("study")
    tables = {}
    for name, text in STUDY.items():
        (folder / f"{name}.csv").write_text(text)
        tables[name] = sl.read_domain(spark, str(folder / f"{name}.csv"))
    return tables


def test_csv_study(study, hits):
    findings = sl.validate_study(**study)
    assert findings.schema.names == FINDINGS.names
    found = hits(findings, "usubjid", "evidence")
    assert found == dict(sorted(EXPECTED.items()))


def test_repeat_mode_and_domain_profile(study, hits):
    found = hits(sl.validate_study(**study, dm_profile="domain", duplicates="repeat"))
    assert found["SDTM_DM_002"] == [2]
    assert found["SDTM_DM_003"] == [3]  # SEX in this profile
    assert found["SDTM_DM_004"] == [3]
    assert "SDTM_DM_008" not in found


def test_summary(study):
    rows = {r.rule_id: r for r in sl.summarize(sl.validate_study(**study)).collect()}
    assert {k: r.n_findings for k, r in rows.items()} == {k: len(v) for k, v in EXPECTED.items()}
    assert rows["SDTM_DM_002"].n_subjects == 1
    assert (rows["X_VSAE_002"].domain, rows["X_VSAE_002"].severity) == ("CROSS", "MED")


def test_sinks(study, spark, tmp_path):
    findings = sl.validate_study(**study)
    sl.write_findings_csv(findings, str(tmp_path / "findings.csv"))
    sl.write_findings_csv(findings, str(tmp_path / "findings.csv"))  # replaces
    back = sl.read_table(spark, str(tmp_path / "findings.csv"))
    assert back.columns == FINDINGS.names
    assert back.count() == sum(map(len, EXPECTED.values()))
    sl.write_findings(findings, str(tmp_path / "findings"))
    assert spark.read.parquet(str(tmp_path / "findings")).filter("domain = 'CROSS'").count() == 8


def test_conform_and_merge(spark):
    short = spark.createDataFrame(
        [("SDTM_RULE", "R", "LOW", "F", "m", 3, "e")],
        "finding_type STRING, rule_id STRING, severity STRING, field STRING, message STRING, row_index INT, evidence STRING",
    )
    merged = sl.merge(spark, [sl.conform(short, "DM"), None, sl.no_findings(spark)])
    assert merged.schema.names == FINDINGS.names
    assert [tuple(r) for r in merged.collect()] == [("SDTM_RULE", "R", "LOW", "DM", "F", "m", 3, "", "e")]
    assert sl.merge(spark, []).count() == 0


def test_codelists(spark, table, tmp_path):
    lists = sl.read_codelists(spark)
    assert lists.count() == 14
    ae = table(AESER=["Y", "x", None, "N"], AESEV=["MILD", "LOW", "SEVERE", ""], OTHER=["a", "b", "c", "d"])
    expected = [(1, "AESER", "x"), (1, "AESEV", "LOW"), (3, "AESEV", "")]
    for limit in (10_000, 1):  # as a filter, and by way of distinct values
        found = sl.codelist_violations(ae, lists, ["AESER", "AESEV", "OTHER"], inline_terms=limit)
        assert sorted(map(tuple, found.collect())) == expected
    assert sl.codelist_violations(ae, lists, ["OTHER"]).count() == 0
    (tmp_path / "own.json").write_text('{\n "OTHER": ["a", "b", "c"]\n}')
    own = sl.read_codelists(spark, str(tmp_path / "own.json"))
    assert [tuple(r) for r in sl.codelist_violations(ae, own, ["OTHER"]).collect()] == [(3, "OTHER", "d")]


def study_of(spark, folder, rows=400):
    """A study with every kind of finding, from Parquet, one subject holding a third of the rows."""
    rng = random.Random(11)

    def subject(i):
        return rng.choice([None, "HOT", "HOT", "HOT", f"S{i % 40}", f"S{i % 40}", f"X{i % 7}", " "])

    def day():
        return rng.choice([None, "2024-13-01", f"2024-01-{rng.randrange(1, 29):02d}", f"2024-02-{rng.randrange(1, 29):02d}"])

    columns = {
        "dm": ("STUDYID USUBJID SEX AGE AGEU RFSTDTC RFENDTC", lambda i: ("T", f"S{i % 90}" if i % 9 else rng.choice(["", None, "HOT"]), rng.choice("MFUQ"), str(i % 140), rng.choice([None, "YEARS", "WEEKS"]), day(), day())),
        "vs": ("USUBJID VSTESTCD VSORRES VSORRESU VSDTC", lambda i: (subject(i), rng.choice(["HR", "TEMP", "ODD"]), rng.choice(["1", "x", None]), rng.choice(["bpm", "C", None]), day())),
        "ae": ("USUBJID AETERM AESTDTC AEENDTC AESER AESEV", lambda i: (subject(i), rng.choice(["a", " "]), day(), day(), rng.choice("YNx"), "MILD")),
        "cm": ("USUBJID CMTRT CMSTDTC CMENDTC", lambda i: (subject(i), rng.choice(["a", None]), day(), day())),
    }
    tables = {}
    for name, (names, row) in columns.items():
        schema = ", ".join(["row_index BIGINT", *(f"{c} STRING" for c in names.split()), "n_VS STRING", "_subject STRING"])
        data = [(i, *row(i), "x", "y") for i in range(rows)]  # names that are used inside
        spark.createDataFrame(data, schema).repartition(3).write.parquet(str(folder / name))
        tables[name] = spark.read.parquet(str(folder / name))
    return tables


@pytest.mark.parametrize("profile", ["sdtm", "domain"])
@pytest.mark.parametrize("mode", ["all", "repeat"])
def test_study_equals_its_parts(spark, tmp_path, profile, mode):
    t = study_of(spark, tmp_path)
    parts = sl.merge(
        spark,
        [
            sl.validate_dm(t["dm"], profile, mode), sl.validate_vs(t["vs"]), sl.validate_ae(t["ae"]), sl.validate_cm(t["cm"]),
            *[sl.validate_dm_link(t["dm"], t[d], d.upper()) for d in ("vs", "ae", "cm")], sl.validate_vs_ae(t["vs"], t["ae"]), sl.validate_vs_cm(t["vs"], t["cm"]),
        ],
    )
    expected = sorted(map(str, parts.collect()))
    assert len({r.rule_id for r in parts.select("rule_id").distinct().collect()}) > 20
    for limit in (None, 0):
        assert sorted(map(str, sl.validate_study(**t, dm_profile=profile, duplicates=mode, broadcast_bytes=limit).collect())) == expected


def test_study_with_columns_missing(spark, tmp_path):
    t = study_of(spark, tmp_path, 60)
    t = {"dm": t["dm"].drop("USUBJID"), "vs": t["vs"].drop("VSORRESU"), "ae": t["ae"].drop("AESTDTC"), "cm": t["cm"].drop("CMENDTC")}
    found = {r.rule_id for r in sl.validate_study(**t).filter("row_index = -1").collect()}
    assert found == {"SDTM_DM_001", "SDTM_VS_005", "SDTM_AE_000", "X_DMLINK_VS_000", "X_DMLINK_AE_000", "X_DMLINK_CM_000", "X_VSAE_000"}


def test_each_table_is_scanned_twice(spark, tmp_path):
    t = study_of(spark, tmp_path, 60)
    findings = sl.validate_study(**t)  # the first scan has made the profile by now
    plan = findings._jdf.queryExecution().executedPlan().toString()
    for name in t:
        assert plan.count(f"{tmp_path}/{name}]") == 1


@pytest.mark.parametrize("mode", ["first", ""])
def test_unknown_duplicate_mode(spark, tmp_path, mode):
    with pytest.raises(ValueError, match="mode"):
        sl.validate_study(**study_of(spark, tmp_path, 5), duplicates=mode)
