"""Row rules, column gates and uniqueness on small tables."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import studylens as sl
from studylens.operators.findings import FINDINGS, emit
from studylens.plans.domains import row_hits, validate_rows


def test_findings_schema(spark, table):
    clean = sl.validate_dm(table(USUBJID=["01-001", "01-002"]))
    assert clean.schema.names == FINDINGS.names
    assert [f.dataType for f in clean.schema] == [f.dataType for f in FINDINGS]
    assert clean.count() == 0
    assert sl.no_findings(spark).schema == FINDINGS


def test_dm_missing_id_column(table):
    (row,) = sl.validate_dm(table(STUDYID=["TRIAL-7", "TRIAL-7"])).collect()
    assert (row.rule_id, row.severity, row.field, row.row_index, row.usubjid, row.evidence) == (
        "SDTM_DM_001", "HIGH", "USUBJID", -1, "", "",
    )
    assert row.message == "Missing required column USUBJID."


def test_dm_blank_ids(table, hits):
    found = hits(sl.validate_dm(table(USUBJID=["\u2003", "kim", None, "\n", "lee", "", "\xa0 \t", "."])))
    assert found == {"SDTM_DM_001": [0, 2, 3, 5, 6]}


def test_dm_duplicates(table, hits):
    dm = table(USUBJID=["p9", "p2", "p9", None, "p2", "P2", "p9", None])
    assert hits(sl.validate_dm(dm), "evidence")["SDTM_DM_002"] == [(0, "p9"), (1, "p2"), (2, "p9"), (4, "p2"), (6, "p9")]
    assert hits(sl.validate_dm(dm, duplicates="repeat"))["SDTM_DM_002"] == [2, 4, 6]


def test_blank_ids_are_keys_only_in_the_sdtm_profile(table, hits):
    dm = table(USUBJID=["", "", "a"], STUDYID=["x", "x", "x"])
    assert hits(sl.validate_dm(dm))["SDTM_DM_002"] == [0, 1]
    assert "SDTM_DM_002" not in hits(sl.validate_dm(dm, profile="domain"))


def test_dm_study_id(table, hits):
    found = hits(sl.validate_dm(table(USUBJID=["u", "v", "w", "x"], STUDYID=[" ", "T7", None, ""])))
    assert found == {"SDTM_DM_003": [0, 2, 3]}


def test_dm_sex(table, hits):
    dm = table(USUBJID=list("pqrstu"), SEX=["f", "U", None, "F", "female", "M"])
    assert hits(sl.validate_dm(dm), "evidence") == {"SDTM_DM_004": [(0, "f"), (4, "female")]}


def test_dm_age(table, hits):
    assert hits(sl.validate_dm(table(USUBJID=list("pqrst"), AGE=["120.5", "-0.1", "119", "0.0", "120"]))) == {"SDTM_DM_005": [0, 1]}
    odd = ["old", "7e1", "200d", " 200", "0x1p9", "1e3", "+130", "130."]
    assert hits(sl.validate_dm(table(USUBJID=list("abcdefgh"), AGE=odd))) == {"SDTM_DM_005": [5, 6, 7]}


def test_numeric_age_column(spark, hits):
    dm = spark.createDataFrame([(0, "a", -1), (1, "b", 40), (2, "c", 121)], "row_index BIGINT, USUBJID STRING, AGE INT")
    assert hits(sl.validate_dm(dm), "evidence") == {"SDTM_DM_005": [(0, "-1"), (2, "121")]}


def test_dm_start_date(table, hits):
    dates = ["2019-11-30", "30.11.2019", "2019-11", "", None, "2019-02-30", "2019-11-30\n", "2019-11-30 08:15"]
    dm = table(USUBJID=list("abcdefgh"), STUDYID=["s"] * 8, RFSTDTC=dates)
    # The sdtm profile checks the shape only, the domain profile the calendar too.
    assert hits(sl.validate_dm(dm)) == {"SDTM_DM_006": [1, 2, 3, 6, 7]}
    assert hits(sl.validate_dm(dm, "domain")) == {"SDTM_DM_006": [1, 2, 3, 5, 6, 7]}


@pytest.mark.parametrize(("mode", "repeats"), [("repeat", [2, 3]), ("all", [0, 2, 3])])
def test_dm_rules_together(table, hits, mode, repeats):
    dm = table(
        USUBJID=["k1", None, "k1", "k1"], STUDYID=["T7", "T7", None, "T7"], SEX=["Q", "F", "M", "U"],
        AGE=["64", "121", "x", "-2"], RFSTDTC=["2019-11-30", "soon", "2019", None],
    )
    assert hits(sl.validate_dm(dm, duplicates=mode)) == {
        "SDTM_DM_001": [1], "SDTM_DM_002": repeats, "SDTM_DM_003": [2], "SDTM_DM_004": [0], "SDTM_DM_005": [1, 3], "SDTM_DM_006": [1, 2],
    }


def test_dm_domain_profile(table, hits):
    dm = table(
        USUBJID=list("abcdef"), STUDYID=["s"] * 6, AGE=["40", "40", None, "40", "x", "150"],
        AGEU=["YEARS", None, None, "WEEKS", "WEEKS", "DAYS"],
        RFSTDTC=["2024-01-01", "2024-02-30", "2024-01-02", "2024-01-01", None, "2024-01-01"],
        RFENDTC=["2024-01-01", "2024-01-01", "2024-01-01", "nope", None, "2025-01-01"],
    )
    assert hits(sl.validate_dm(dm, "domain"), "evidence") == {
        "SDTM_DM_004": [(5, "150")],
        "SDTM_DM_005": [(1, None), (3, "WEEKS")],
        "SDTM_DM_006": [(1, "2024-02-30")],
        "SDTM_DM_007": [(3, "nope")],
        "SDTM_DM_008": [(2, "2024-01-02 > 2024-01-01")],
    }


def test_unknown_profile_and_mode(table):
    with pytest.raises(ValueError, match="dm_profile"):
        sl.validate_dm(table(USUBJID=["a"]), profile="other")
    with pytest.raises(ValueError, match="mode"):
        sl.validate_dm(table(USUBJID=["a"]), duplicates="other")


@pytest.mark.parametrize(
    ("check", "domain", "finding_type", "missing"),
    [
        (sl.validate_vs, "VS", "SDTM_RULE", ["VSTESTCD", "VSORRES", "VSDTC"]),
        (sl.validate_ae, "AE", "SDTM_RULE", ["AETERM", "AESTDTC"]),
        (sl.validate_cm, "CM", "SDTM_RULE", ["CMTRT", "CMSTDTC"]),
        (lambda t: sl.validate_dm(t, "domain"), "DM", "CROSS_DOMAIN", ["STUDYID"]),
    ],
)
def test_required_columns(table, check, domain, finding_type, missing):
    (row,) = check(table(USUBJID=["", "a"])).collect()
    assert (row.finding_type, row.rule_id, row.severity, row.domain) == (
        finding_type, f"SDTM_{domain}_000", "CRIT", domain,
    )
    assert row.field == ",".join(missing)
    assert row.message == f"Missing required columns for {domain}: {missing}"


def test_vs_rules(table, hits):
    vs = table(
        USUBJID=["a", None, "a", "a", "a", "a", "a"],
        VSTESTCD=["TEMP", "HR", "GLUCOSE", "SYSBP", None, "WEIGHT", "RESP"],
        VSORRES=["36,6", "72", "abc", "1,234.5", "abc", None, "12"],
        VSORRESU=["C", None, "mg", "kPa", "x", "kg", "bpm"],
        VSDTC=["2024-01-01", None, "2024-13-01", "2024-01-01", "x", "2024-02-29", "2023-02-29"],
    )
    assert hits(sl.validate_vs(vs), "evidence") == {
        "SDTM_VS_001": [(1, None)],
        "SDTM_VS_002": [(2, "GLUCOSE")],
        "SDTM_VS_003": [(2, "2024-13-01"), (4, "x"), (6, "2023-02-29")],
        "SDTM_VS_004": [(3, "1,234.5")],
        "SDTM_VS_005": [(3, "SYSBP / kPa")],
    }
    (note,) = sl.validate_vs(vs.drop("VSORRESU")).filter("rule_id = 'SDTM_VS_005'").collect()
    assert (note.severity, note.row_index, note.message) == (
        "LOW", -1, "Column VSORRESU not present; unit consistency checks skipped.",
    )


def test_messages(table):
    vs = table(USUBJID=["a"], VSTESTCD=["x"], VSORRES=["1"], VSDTC=["2024-01-01"], VSORRESU=["x"])
    assert [r.message for r in sl.validate_vs(vs).collect()] == [
        "VSTESTCD should be one of: ['SYSBP', 'DIABP', 'HR', 'TEMP', 'WEIGHT', 'HEIGHT', 'RESP']."
    ]


def test_optional_columns_absent(table, hits):
    assert hits(sl.validate_ae(table(USUBJID=["a"], AETERM=[" "], AESTDTC=["x"]))) == {
        "SDTM_AE_001": [0], "SDTM_AE_002": [0],
    }
    assert hits(sl.validate_cm(table(USUBJID=["a"], CMTRT=[None], CMSTDTC=["x"]))) == {
        "SDTM_CM_001": [0], "SDTM_CM_002": [0],
    }


texts = st.one_of(
    st.none(),
    st.sampled_from(["", " ", "a", "SYSBP", "HR", "mmHg", "bpm", "1", "1,5", "x", "2024-01-01", "2024-1-1", "2024-99-01"]),
    st.text(alphabet="0123456789-+.,eE \n", max_size=10),
)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(texts, texts, texts, texts, texts), min_size=1, max_size=12))
def test_fused_rules_equal_one_filter_per_rule(spark, rows):
    columns = ["USUBJID", "VSTESTCD", "VSORRES", "VSORRESU", "VSDTC"]
    schema = ", ".join(["row_index BIGINT", *(f"{c} STRING" for c in columns)])
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema).coalesce(1).cache()
    each = sl.merge(spark, [emit(df, [hit]) for hit in row_hits(df.columns, "VS")])
    key = lambda r: tuple(map(str, r))
    fused = sorted(validate_rows(df, "VS").collect(), key=key)
    assert fused == sorted(each.collect(), key=key)
    assert fused == sorted(validate_rows(df.repartition(3), "VS").collect(), key=key)
    df.unpersist()


def test_one_scan_for_all_row_rules(spark, tmp_path, table):
    path = str(tmp_path / "vs")
    table(USUBJID=["a"], VSTESTCD=["x"], VSORRES=["1"], VSORRESU=["x"], VSDTC=["x"]).write.parquet(path)
    plan = sl.validate_vs(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert "Exchange" not in plan
    assert "Python" not in plan
