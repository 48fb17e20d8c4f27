"""Visit records: flags, outliers, report."""

from datetime import datetime

import pytest

import studylens as sl
from studylens.plans.visits import score_visits

COLUMNS = ["age", "systolic_bp", "treatment_dose", "visit_date"]
SCHEMA = "row_index BIGINT, age STRING, systolic_bp STRING, treatment_dose STRING, visit_date STRING"


def flags(df):
    rows = sl.apply_rules(df).orderBy("row_index").collect()
    return [(r.age_valid, r.bp_valid, r.dose_valid, r.date_valid) for r in rows]


def test_flags(table):
    visits = table(
        age=["100", "18", "17.9", "101", None, "0099", "+18", "x"],
        systolic_bp=["89.9", "180", "90", "1e2", None, "180.1", "-120", "n/a"],
        treatment_dose=["0", "-1", "1e-3", "7", None, "0.0", ".5", ""],
        visit_date=["d", None, "", "2019-12-01", None, "d", "d", "d"],
    )
    assert flags(visits) == [
        (1, 0, 0, 1), (1, 1, 0, 0), (0, 1, 1, 1), (0, 1, 1, 1), (0, 0, 0, 0), (1, 0, 0, 1), (1, 0, 1, 1), (0, 0, 0, 1),
    ]


def test_flags_of_typed_columns(spark):
    rows = [(0, 25, 120.0, 50.0, "2023-01-01"), (1, 17, 200.0, 0.0, None)]
    typed = spark.createDataFrame(rows, "row_index INT, age INT, systolic_bp DOUBLE, treatment_dose DOUBLE, visit_date STRING")
    assert flags(typed) == [(1, 1, 1, 1), (0, 0, 0, 0)]


def test_column_gate(table):
    with pytest.raises(ValueError, match="Missing required columns"):
        sl.ensure_columns(table(age=["1"]), COLUMNS)
    sl.ensure_columns(table(**{c: ["1"] for c in COLUMNS}), COLUMNS)


def test_load(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        sl.load_data(spark, str(tmp_path / "absent.csv"))
    (tmp_path / "v.csv").write_text("id,age,systolic_bp,visit_date,treatment_dose\n1,45,120,2025-01-01,10\n2,46,,2025-01-02,\n")
    rows = sl.load_data(spark, str(tmp_path / "v.csv")).orderBy("row_index").collect()
    assert [(r.row_index, r.id, r.systolic_bp) for r in rows] == [(0, "1", "120"), (1, "2", None)]
    (tmp_path / "w.csv").write_text("id,age\n1,45\n")
    with pytest.raises(ValueError, match="systolic_bp"):
        sl.load_data(spark, str(tmp_path / "w.csv"))


def test_few_rows_have_no_outliers(table):
    nine = table(age=["900"] * 9, systolic_bp=["1"] * 9, treatment_dose=["1"] * 9, visit_date=["d"] * 9)
    assert [r.anomaly for r in sl.detect_anomalies(sl.apply_rules(nine)).collect()] == [0] * 9
    flagged, summary = sl.validate_visits(nine)
    assert flagged.count() == 9
    assert tuple(summary.first()) == (9, 9)


def planted(spark, rows=600):
    """Ordinary visits with three that are far off."""
    data = []
    for i in range(rows):
        far = i in (100, 200, 300)
        age, bp, dose = 30 + (i * 7) % 30, 110 + (i * 11) % 30, 50 + (i * 13) % 20
        data.append((i, str(age + 500 * far), str(bp + 900 * far), None if i % 50 == 1 else str(dose + 9000 * far), "2025-01-01"))
    return spark.createDataFrame(data, SCHEMA)


def test_outliers(spark):
    visits = sl.apply_rules(planted(spark))
    scored, cut = score_visits(visits)
    top = [r.row_index for r in scored.orderBy("anomaly_score", ascending=False).limit(3).collect()]
    assert sorted(top) == [100, 200, 300]
    judged = sl.detect_anomalies(visits)
    marked = {r.row_index for r in judged.filter("anomaly = 1").collect()}
    assert {100, 200, 300} <= marked
    assert 0.07 * 600 <= len(marked) <= 0.1 * 600  # ties at the cut lower the share
    assert dict(judged.dtypes)["anomaly"] == "int"
    assert judged.columns == [*visits.columns, "anomaly"]
    again = {r.row_index for r in sl.detect_anomalies(visits.repartition(5)).filter("anomaly = 1").collect()}
    assert again == marked


def test_column_without_values(spark):
    visits = planted(spark, 40).selectExpr("row_index", "age", "'n/a' AS systolic_bp", "treatment_dose", "visit_date")
    filled, rows = sl.impute_medians(sl.apply_rules(visits))
    assert rows == 40
    assert {r.systolic_bp_num for r in filled.collect()} == {0.0}
    assert sl.detect_anomalies(sl.apply_rules(visits)).count() == 40


def test_imputation(table):
    visits = table(
        age=["20", None, "40", "70"], systolic_bp=["x", "100", "110", "200"], treatment_dose=["1", "2", "3", "10"],
        visit_date=["d"] * 4,
    )
    rows = sl.impute_medians(sl.apply_rules(visits))[0].orderBy("row_index").collect()
    assert [r.age_num for r in rows] == [20, 40, 40, 70]
    assert [r.systolic_bp_num for r in rows] == [110, 100, 110, 200]
    assert [r.treatment_dose_num for r in rows] == [1, 2, 3, 10]


def test_numbers_that_are_not_finite_count_as_missing(spark):
    rows = [(i, 40 + i % 3, [120.0, float("inf"), float("nan"), 130.0, float("-inf")][i % 5], 10.0, "d") for i in range(40)]
    visits = sl.apply_rules(spark.createDataFrame(rows, "row_index BIGINT, age INT, systolic_bp DOUBLE, treatment_dose DOUBLE, visit_date STRING"))
    assert {r.systolic_bp_num for r in sl.impute_medians(visits)[0].collect()} == {120.0, 125.0, 130.0}
    assert sl.detect_anomalies(visits).count() == 40


def test_report_counts_in_the_job_that_writes(spark, tmp_path):
    judged = sl.detect_anomalies(sl.apply_rules(planted(spark)))
    expected = tuple(sl.summary(judged).first())
    spark.sparkContext.setJobGroup("report", "report")
    try:
        report = sl.write_report(judged, str(tmp_path), datetime(2025, 1, 2, 3, 4, 5))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("report")) == 1
    assert (report.total_records, report.flagged_records) == expected
    assert sl.read_table(spark, report.path).count() == report.flagged_records


def test_from_file_to_one_report_file(spark, tmp_path):
    records = planted(spark, 300).repartition(4).orderBy("row_index").drop("row_index")
    sl.write_one_csv(records, str(tmp_path / "in.csv"))
    report = sl.run_visits(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"), datetime(2025, 1, 2))
    path = tmp_path / "out" / "validation_report_2025-01-02_00-00-00.csv"
    assert report.path == str(path) and path.is_file() and [p.name for p in path.parent.iterdir()] == [path.name]
    lines = path.read_text().splitlines()
    names = [n.strip('"') for n in lines[0].split(",")]
    assert names[0] == "row_index" and names[-1] == "anomaly"
    numbers = [int(line.split(",")[0]) for line in lines[1:]]
    assert numbers == sorted(numbers) and len(numbers) == report.flagged_records and report.total_records == 300
    assert {100, 200} <= set(numbers)


def test_report(spark, tmp_path):
    judged = sl.detect_anomalies(sl.apply_rules(planted(spark)))
    path = sl.generate_report(judged, str(tmp_path), datetime(2025, 1, 2, 3, 4, 5))
    assert path == f"{tmp_path}/validation_report_2025-01-02_03-04-05.csv"
    written = sl.read_table(spark, path)
    total, flagged = sl.summary(judged).first()
    assert total == 600
    assert written.count() == flagged == sl.flagged(judged).count()
    assert "anomaly" in written.columns
    first = [r.row_index for r in sl.preview(judged).collect()]
    assert len(first) == 25
    assert first == sorted(r.row_index for r in sl.flagged(judged).collect())[:25]
