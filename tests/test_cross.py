"""Cross-domain checks, and the joins beneath them under skew."""

import random

import pytest
from pyspark.sql import functions as F

import studylens as sl
from studylens.operators import keyed
from studylens.operators.materialize import materialize
from studylens.plans.cross import cross_findings, dm_link_rule, vs_ae_rules, vs_cm_rules
from studylens.plans.domains import duplicate_subjects


def test_dm_link(spark):
    dm = spark.createDataFrame([("q2",), ("q1",)], "USUBJID STRING")
    cm = spark.createDataFrame([("iron", "q1"), ("zinc", "q8"), ("iron", "q2"), ("zinc", "q8")], "CMTRT STRING, USUBJID STRING")
    rows = sl.validate_dm_link(dm, cm, "CM").collect()
    assert sorted((r.rule_id, r.severity, r.usubjid, r.evidence) for r in rows) == [("X_DMLINK_CM_001", "HIGH", "q8", "q8")] * 2
    assert {(r.finding_type, r.domain, r.message) for r in rows} == {
        ("CROSS_DOMAIN", "CROSS", "CM subject not found in DM (orphan USUBJID)."),
    }


def test_dm_link_of_any_domain(table, hits):
    found = sl.validate_dm_link(table(USUBJID=["a"]), table(USUBJID=["b"]), "LB")
    assert [(r.rule_id, r.message) for r in found.collect()] == [
        ("X_DMLINK_LB_001", "LB subject not found in DM (orphan USUBJID).")
    ]


def test_null_and_blank_ids(table, hits):
    dm = table(USUBJID=["a", None, " "])
    ae = table(USUBJID=["a", None, " ", "", "A"])
    # Null never matches, not even null; blanks are ordinary keys.
    assert hits(sl.validate_dm_link(dm, ae, "AE"), "usubjid") == {"X_DMLINK_AE_001": [(1, None), (3, ""), (4, "A")]}


def test_missing_columns(table):
    some, none = table(USUBJID=["a"], VSDTC=["2024-01-01"]), table(X=["a"])
    (row,) = sl.validate_dm_link(some, none, "CM").collect()
    assert (row.rule_id, row.severity, row.row_index) == ("X_DMLINK_CM_000", "CRIT", -1)
    assert row.message == "Missing USUBJID for DM/CM link check."
    (row,) = sl.validate_vs_ae(some, some).collect()
    assert (row.rule_id, row.field) == ("X_VSAE_000", "USUBJID/--DTC")
    (row,) = sl.validate_vs_cm(some, some).collect()
    assert row.rule_id == "X_VSCM_000"


def test_vs_ae(table, hits):
    vs = table(
        USUBJID=["a", "a", "a", "b", None, "d"],
        VSDTC=["2024-01-05", "2024-01-10", "bad", "bad", "2024-01-01", "2024-03-01"],
    )
    ae = table(
        USUBJID=["a", "a", "a", "a", "b", "c", None, "d"],
        AESTDTC=["2024-01-04", "2024-01-05", "2024-01-11", "bad", "2020-01-01", "2024-01-01", "2024-01-01", "2024-03-04"],
    )
    assert hits(sl.validate_vs_ae(vs, ae), "evidence") == {
        "X_VSAE_001": [(5, "c"), (6, None)],
        "X_VSAE_002": [
            (0, "2024-01-04 vs [2024-01-05, 2024-01-10]"),
            (2, "2024-01-11 vs [2024-01-05, 2024-01-10]"),
            (7, "2024-03-04 vs [2024-03-01, 2024-03-01]"),
        ],
    }
    assert hits(sl.validate_vs_ae(vs, ae, tolerance_days=1))["X_VSAE_002"] == [7]


def test_vs_cm(table, hits):
    vs = table(
        USUBJID=["a", "a", "a", "b", "c", "d", "e"],
        VSDTC=["2024-01-01", "2024-01-05", "2024-01-31", "2024-01-05", "2024-01-05", "2024-01-05", "2024-01-05"],
    )
    cm = table(
        USUBJID=["a", "a", "b", "c", "d", "x"],
        CMSTDTC=["2024-01-03", "2024-01-10", "2024-01-08", "2024-01-01", "bad", "2024-01-01"],
        CMENDTC=["2024-01-06", "2024-01-30", "2024-01-04", "ongoing", "2024-01-09", "2024-01-01"],
    )
    # b: an inverted window; c: no end; d: the start does not parse, so no window.
    assert hits(sl.validate_vs_cm(vs, cm), "evidence") == {
        "X_VSCM_001": [(5, "x")],
        "X_VSCM_002": [
            (0, "2024-01-01 vs [2024-01-03, 2024-01-30]"),
            (2, "2024-01-31 vs [2024-01-03, 2024-01-30]"),
            (3, "2024-01-05 vs [2024-01-08, 2024-01-04]"),
        ],
    }
    assert hits(sl.validate_vs_cm(vs, cm.drop("CMENDTC"))) == {"X_VSCM_001": [5]}


def skewed_study(spark, rows=600):
    """A third of all rows belongs to one subject."""
    rng = random.Random(7)

    def subject(i):
        return "HOT" if i % 3 == 0 else f"S{rng.randrange(60)}" if i % 17 else None

    def day():
        return f"2024-{rng.randrange(1, 14):02d}-{rng.randrange(1, 29):02d}"

    vs = [(i, subject(i), day()) for i in range(rows)]
    ae = [(i, subject(i), day()) for i in range(rows)]
    cm = [(i, subject(i), day(), day()) for i in range(rows)]
    dm = [(i, f"S{i % 45}" if i % 3 else "HOT") for i in range(90)]
    return {
        "DM": spark.createDataFrame(dm, "row_index BIGINT, USUBJID STRING"),
        "VS": spark.createDataFrame(vs, "row_index BIGINT, USUBJID STRING, VSDTC STRING"),
        "AE": spark.createDataFrame(ae, "row_index BIGINT, USUBJID STRING, AESTDTC STRING"),
        "CM": spark.createDataFrame(cm, "row_index BIGINT, USUBJID STRING, CMSTDTC STRING, CMENDTC STRING"),
    }


def test_sliced_path_finds_the_same(spark, monkeypatch):
    tables = skewed_study(spark)
    rules = [*vs_ae_rules(), *vs_cm_rules(), *(dm_link_rule(d) for d in ("VS", "AE", "CM"))]
    monkeypatch.setattr(keyed, "SLICE_ROWS", 7)
    key = lambda r: tuple(map(str, r))
    broadcast = sorted(cross_findings(tables, rules).collect(), key=key)
    sliced = sorted(cross_findings(tables, rules, broadcast_bytes=0).collect(), key=key)
    assert broadcast == sliced
    assert len(broadcast) > 300
    both = [
        sorted(duplicate_subjects(tables["DM"], mode, broadcast_bytes=b).collect(), key=key)
        for mode in ("all", "repeat")
        for b in (None, 0)
    ]
    assert both[0] == both[1]
    assert both[2] == both[3]
    assert len(both[0]) > len(both[2]) > 0


@pytest.fixture
def plain_shuffles(spark):
    """Without adaptive execution and broadcasts by size, and with 16 partitions."""
    changed = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {name: spark.conf.get(name) for name in changed}
    for name, value in changed.items():
        spark.conf.set(name, value)
    yield 16
    for name, value in before.items():
        spark.conf.set(name, value)


def hot_rows(spark):
    """300 keys of 400 rows each, one with 60,000, a third of all, and some light ones."""
    hot = "CASE WHEN id < 60000 THEN 'HOT' WHEN id < 180000 THEN concat('K', id % 300) ELSE concat('S', id) END"
    return spark.range(0, 181_000, numPartitions=6).selectExpr("id AS row_index", f"{hot} AS k")


def test_every_heavy_key_is_spread(spark, plain_shuffles, monkeypatch):
    monkeypatch.setattr(keyed, "SLICE_ROWS", 100)
    rows = hot_rows(spark)
    table = materialize(rows.groupBy("k").count(), "keys")
    monkeypatch.setattr(keyed, "SLICES_PER_PARTITION", 100)
    assert keyed.slice_rows(table, ["k"], "count") == 114
    joined = keyed.sliced_join(rows, table, ["k"], "count")
    tasks = [r["n"] for r in joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(tasks) == 181_000 and len(tasks) == plain_shuffles
    assert max(tasks) < 1.5 * 181_000 / plain_shuffles  # a third of all rows would be 60,000
    assert joined.select("row_index").distinct().count() == 181_000
    assert joined.filter("k = 'HOT' AND count = 60000").count() == 60_000
    # 300 keys of 400 rows, which no list of a few heaviest keys could hold, are cut as well.
    places = joined.filter("k = 'K7'").groupBy(F.spark_partition_id().alias("p")).count().count()
    assert places > 1


def test_as_many_slices_as_there_are_rows_for(spark, plain_shuffles, monkeypatch):
    table = materialize(hot_rows(spark).groupBy("k").count(), "keys")
    assert keyed.slice_rows(table, ["k"], "count") == 10_000  # small tables need no slices smaller than this
    monkeypatch.setattr(keyed, "SLICE_ROWS", 1)
    target = keyed.slice_rows(table, ["k"], "count")
    assert target == -(-181_000 // (8 * plain_shuffles))
    assert table.filter(F.col("count") > target).count() <= 8 * plain_shuffles
    # A list that may not take any memory leaves no key cut, and the join is right all the same.
    assert keyed.slice_rows(table, ["k"], "count", max_bytes=0) >= 60_000
    few = hot_rows(spark).filter("row_index % 50 = 0")
    counts = materialize(few.groupBy("k").count(), "keys")
    assert keyed.sliced_join(few, counts, ["k"], "count").count() == few.count()


@pytest.mark.parametrize("partitions", [1, 5])
def test_findings_do_not_depend_on_partitions(spark, partitions):
    tables = {d: t.repartition(partitions) for d, t in skewed_study(spark, 120).items()}
    found = sl.study_cross_findings(tables, dm_links=["VS", "AE", "CM"], vs_ae=True, vs_cm=True)
    key = lambda r: tuple(map(str, r))
    expected = sl.study_cross_findings(skewed_study(spark, 120), dm_links=["VS", "AE", "CM"], vs_ae=True, vs_cm=True)
    assert sorted(found.collect(), key=key) == sorted(expected.collect(), key=key)


def test_clean_rows_are_not_shuffled(spark, tmp_path):
    tables = skewed_study(spark)
    for d, t in tables.items():
        t.write.parquet(str(tmp_path / d))
    read = {d: spark.read.parquet(str(tmp_path / d)) for d in tables}
    plan = cross_findings(read, vs_ae_rules())._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert "hashpartitioning" not in plan


def test_compound_keys_under_skew(spark):
    tables = {
        d: t.selectExpr("row_index % 4 AS doc_id", "*") for d, t in skewed_study(spark, 400).items() if d in ("DM", "AE")
    }
    on = ("doc_id", "USUBJID")
    key = lambda r: tuple(map(str, r))
    one, other = (
        sorted(cross_findings(tables, [dm_link_rule("AE")], on=on, broadcast_bytes=b).collect(), key=key) for b in (None, 0)
    )
    assert one == other
    known = {(r.doc_id, r.USUBJID) for r in tables["DM"].collect()}
    orphans = [r for r in tables["AE"].collect() if r.USUBJID is None or (r.doc_id, r.USUBJID) not in known]
    assert sorted((r.doc_id, r.row_index) for r in one) == sorted((r.doc_id, r.row_index) for r in orphans)
