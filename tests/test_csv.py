"""CSV files in, by name and with line breaks in cells, and one file out."""

import csv

import pytest

import studylens as sl
from studylens.sources.onefile import write_one_csv


def test_one_file_holds_all_parts_in_order(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else f'say "{i}", then\n{i}' if i % 5 == 0 else "", i / 4) for i in range(500)]
    table = spark.createDataFrame(rows, "n INT, t STRING, x DOUBLE").repartition(6).orderBy("n")
    path = tmp_path / "deep" / "one.csv"
    write_one_csv(table, str(path))
    write_one_csv(table, str(path))  # replaces
    assert path.is_file() and [p.name for p in path.parent.iterdir()] == ["one.csv"]
    with path.open(newline="") as file:
        found = list(csv.reader(file))
    assert found[0] == ["n", "t", "x"]
    assert [(int(n), t) for n, t, _ in found[1:]] == [(n, t or "") for n, t, _ in rows]
    back = sl.read_table(spark, str(path), multi_line=True)
    assert [(r.n, r.t) for r in back.collect()] == [(str(n), t) for n, t, _ in rows]
    with pytest.raises(Exception, match="one.csv"):
        write_one_csv(table, str(path), overwrite=False)
    assert [p.name for p in path.parent.iterdir()] == ["one.csv"]


def test_one_file_of_no_rows_has_a_header(spark, tmp_path):
    write_one_csv(spark.createDataFrame([], "a INT, b STRING"), str(tmp_path / "none.csv"))
    assert sl.read_table(spark, str(tmp_path / "none.csv")).columns == ["a", "b"]


def test_a_failing_task_leaves_no_file(spark, tmp_path):
    bad = spark.range(40).selectExpr("id", "CASE WHEN id = 33 THEN raise_error('no') ELSE 'x' END AS t")
    with pytest.raises(Exception, match="no"):
        write_one_csv(bad, str(tmp_path / "bad.csv"))
    assert not (tmp_path / "bad.csv").exists()


def test_findings_as_one_file(spark, table, tmp_path):
    found = sl.validate_vs(table(USUBJID=[None, "A"], VSTESTCD=["HR", "ODD"], VSORRES=["x", "1"], VSORRESU=["bpm", "C"], VSDTC=["2024-01-01", "?"]))
    sl.write_findings_csv(found, str(tmp_path / "f.csv"), one_file=True)
    back = sl.read_table(spark, str(tmp_path / "f.csv"))
    assert (tmp_path / "f.csv").is_file() and back.columns == found.columns
    as_text = sorted(tuple(None if v is None else str(v) for v in r) for r in found.collect())
    assert sorted(map(tuple, back.collect()), key=str) == sorted(as_text, key=str)


def test_a_cell_with_a_line_break_is_never_cut_in_silence(spark, tmp_path):
    (tmp_path / "v.csv").write_text('id,note,more\n1,"first\nsecond",x\n2,"a, ""b""",y\n3,,\n')
    with pytest.raises(Exception, match="multi_line=True"):
        sl.read_table(spark, str(tmp_path / "v.csv")).collect()
    with pytest.raises(Exception, match="multi_line=True"):
        sl.read_table(spark, str(tmp_path / "v.csv")).select("id").collect()
    rows = sl.read_domain(spark, str(tmp_path / "v.csv"), multi_line=True).orderBy("row_index").collect()
    assert [tuple(r) for r in rows] == [(0, "1", "first\nsecond", "x"), (1, "2", 'a, "b"', "y"), (2, "3", None, None)]
    (tmp_path / "w.csv").write_text("id,note\n1,2\n3\n")  # a short row without quotes is filled up
    assert [tuple(r) for r in sl.read_table(spark, str(tmp_path / "w.csv")).collect()] == [("1", "2"), ("3", None)]
    (tmp_path / "x.csv").write_text('note\n"a\nb"\nc\n')  # one column
    assert [r.note for r in sl.read_table(spark, str(tmp_path / "x.csv")).collect()] == ["a\nb", "c"]


def test_files_with_different_headers(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("USUBJID,SEX\nS1,M\nS2,F\n")
    (folder / "b.csv").write_text("SEX,USUBJID,AGE\nF,S3,40\n")
    (folder / "c.csv").write_text("USUBJID,SEX\nS4,U\n")
    (folder / "d.csv").write_text("")
    with pytest.raises(Exception, match="(?i)header"):
        sl.read_domain(spark, str(folder)).collect()
    rows = sl.read_domain(spark, str(folder), by_name=True).orderBy("row_index").collect()
    assert [(r.row_index, r.USUBJID, r.SEX, r.AGE) for r in rows] == [(0, "S1", "M", None), (1, "S2", "F", None), (2, "S3", "F", "40"), (3, "S4", "U", None)]
    plain = sl.read_table(spark, str(folder), by_name=True)
    assert sorted(plain.columns) == ["AGE", "SEX", "USUBJID"] and plain.count() == 4
