"""The same findings whether rows arrive as a stream or as a table."""

import pytest

import studylens as sl
from studylens.plans.domains import duplicate_subjects
from studylens.streaming.findings import stream_dm_link, stream_row_findings, write_stream
from studylens.streaming.keyed import settled, state_store, stream_duplicates, stream_links

SCHEMA = "row_index BIGINT, USUBJID STRING, AETERM STRING, AESTDTC STRING, AESEV STRING"


@pytest.fixture
def rows(spark, tmp_path):
    path = str(tmp_path / "ae")
    data = [
        (i, None if i % 11 == 0 else f"S{i % 7}", " " if i % 5 == 0 else "x", "2024-01-01" if i % 4 else "2024-01", "MILD")
        for i in range(60)
    ]
    spark.createDataFrame(data, SCHEMA).repartition(4).write.parquet(path)
    return path


def run(findings, tmp_path, spark):
    out = str(tmp_path / "out")
    query = write_stream(findings, out, str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(map(str, spark.read.schema(findings.schema).parquet(out).select(*findings.columns).collect()))


def test_row_rules(spark, rows, tmp_path):
    stream = spark.readStream.schema(SCHEMA).parquet(rows)
    batch = sl.validate_ae(spark.read.parquet(rows))
    assert run(stream_row_findings(stream, "AE"), tmp_path, spark) == sorted(map(str, batch.collect()))


@pytest.mark.parametrize("limit", [10_000_000, 0])
def test_dm_link(spark, rows, tmp_path, limit):
    dm = spark.createDataFrame([(f"S{i}",) for i in range(5)], "USUBJID STRING")
    stream = spark.readStream.schema(SCHEMA).parquet(rows)
    batch = sl.validate_dm_link(dm, spark.read.parquet(rows), "AE")
    assert batch.count() > 10
    assert run(stream_dm_link(stream, dm, "AE", limit), tmp_path, spark) == sorted(map(str, batch.collect()))


def test_row_index_is_required(spark, rows):
    stream = spark.readStream.schema(SCHEMA).parquet(rows).drop("row_index")
    with pytest.raises(ValueError, match="row_index"):
        stream_row_findings(stream, "AE")


def batches(spark, folder, schema, parts):
    """A stream with one batch for each list of rows."""
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def collected(findings, tmp_path, spark):
    out = str(tmp_path / "found")
    with state_store(spark):
        query = write_stream(findings, out, str(tmp_path / "progress")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) > 1
    return spark.read.schema(findings.schema).parquet(out).select(*findings.columns)


DM_PARTS = [
    [(5, "a"), (6, "b"), (7, None), (8, "a"), (9, " ")],
    [(1, "c"), (2, "a"), (3, "b")],
    [(4, "d"), (0, "c"), (10, " "), (11, None), (12, "a")],
]


@pytest.mark.parametrize("mode", ["all", "repeat"])
@pytest.mark.parametrize("blank", [True, False])
def test_duplicates_over_several_batches(spark, tmp_path, mode, blank):
    schema = "row_index BIGINT, USUBJID STRING"
    stream = batches(spark, tmp_path / "dm", schema, DM_PARTS)
    found = collected(stream_duplicates(stream, mode, blank), tmp_path, spark)
    whole = spark.createDataFrame([r for part in DM_PARTS for r in part], schema)
    expected = duplicate_subjects(whole, mode, blank)
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
    assert expected.count() > 4


def test_links_over_several_batches(spark, tmp_path):
    schema = "row_index BIGINT, USUBJID STRING"
    dm_parts = [[(0, "a"), (1, None)], [(2, "b")], [(3, "c"), (4, "a")]]
    ae_parts = [[(0, "a"), (1, "b"), (2, "z"), (3, None)], [(4, "c"), (5, "b"), (6, "z")], [(7, "c"), (8, "y"), (9, "a")]]
    dm, ae = batches(spark, tmp_path / "dm", schema, dm_parts), batches(spark, tmp_path / "ae", schema, ae_parts)
    found = collected(stream_links(dm, ae, "AE"), tmp_path, spark)
    assert sorted(r.row_index for r in found.filter("retracted").collect()) == [1, 4]
    whole = [spark.createDataFrame([r for part in parts for r in part], schema) for parts in (dm_parts, ae_parts)]
    expected = sl.validate_dm_link(*whole, "AE")
    assert sorted(map(str, settled(found).collect())) == sorted(map(str, expected.collect()))
    assert sorted(r.row_index for r in expected.collect()) == [2, 3, 6, 8]


def test_state_survives_a_restart(spark, tmp_path):
    schema = "row_index BIGINT, USUBJID STRING"
    folder, out = tmp_path / "dm", str(tmp_path / "out")
    for part in DM_PARTS:
        stream = batches(spark, folder, schema, [part])
        findings = stream_duplicates(stream)
        with state_store(spark):
            write_stream(findings, out, str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    whole = spark.createDataFrame([r for part in DM_PARTS for r in part], schema)
    rows = spark.read.schema(findings.schema).parquet(out).select(*findings.columns).collect()
    assert sorted(map(str, rows)) == sorted(map(str, duplicate_subjects(whole).collect()))
