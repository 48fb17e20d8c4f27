"""Row numbers, quantiles, the forest and materialized tables."""

import hashlib
import random
import statistics

import numpy as np
import pytest

from studylens.operators import isolation, quantiles
from studylens.operators.isolation import average_path, depth_limit, draw_samples, fit_forest, with_scores
from studylens.operators.materialize import materialize
from studylens.operators.prefix import running_total
from studylens.operators.quantiles import exact_quantiles
from studylens.operators.rowid import with_row_index


def test_row_index_follows_files(spark, tmp_path):
    total = 0
    for name, rows in (("a", 700), ("b", 3), ("c", 1200)):
        lines = [f"{total + i},{'x' * (i % 40)}" for i in range(rows)]
        (tmp_path / f"{name}.csv").write_text("\n".join(["n,pad", *lines]) + "\n")
        total += rows
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        table = spark.read.option("header", True).csv(str(tmp_path))
        assert table.rdd.getNumPartitions() > 5
        rows = with_row_index(table, from_files=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r.row_index for r in rows) == list(range(total))
    assert all(r.row_index == int(r.n) for r in rows)


def test_row_index_of_any_table(spark):
    table = spark.range(0, 1000, numPartitions=7).withColumnRenamed("id", "n")
    rows = with_row_index(table).collect()
    assert sorted(r.row_index for r in rows) == list(range(1000))
    assert all(r.row_index == r.n for r in rows)
    assert with_row_index(with_row_index(table)).columns == ["row_index", "n"]


def test_row_index_of_a_shuffled_table_is_stable(spark):
    shuffled = spark.range(500).selectExpr("id AS n", "rand() AS r").repartition(4, "r").groupBy("n", "r").count()
    indexed = with_row_index(shuffled)
    first = {r.n: r.row_index for r in indexed.collect()}
    assert sorted(first.values()) == list(range(500))
    assert {r.n: r.row_index for r in indexed.collect()} == first


def test_supplied_row_index_is_kept(table):
    given = table(A=["x"])
    assert with_row_index(given) is given


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_row_index_moves_no_data_and_has_no_window_over_the_table(spark, tmp_path):
    spark.range(0, 5000, numPartitions=4).selectExpr("id AS n", "uuid() AS pad").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    indexed = with_row_index(table, from_files=True).select("row_index", "n")
    rows = indexed.collect()
    assert sorted(r.row_index for r in rows) == list(range(5000))
    by_file = [r.n for r in sorted(rows, key=lambda r: r.row_index)]
    files = sorted(table.inputFiles())
    assert by_file == [r.n for f in files for r in spark.read.parquet(f).collect()]
    data = [part for part in plan_of(indexed).split("BroadcastExchange")[0].splitlines()]
    assert not [line for line in data if " Exchange" in line or "Window" in line]
    assert "pad" not in plan_of(indexed)  # nor is a column read or written that isn't asked for


@pytest.mark.parametrize("rows_per_range", [7, 50_000])
def test_running_total(spark, tmp_path, rows_per_range):
    spark.range(100).selectExpr("concat('k', lpad(id, 3, '0')) AS k", "id % 7 AS v", "'x' AS other").repartition(5).write.parquet(str(tmp_path / "t"))
    found = running_total(spark.read.parquet(str(tmp_path / "t")), ["k"], "v", "before", rows_per_range)
    assert found.columns == ["k", "v", "other", "before"]
    rows = sorted(found.collect())
    assert [r.before for r in rows] == [sum(i % 7 for i in range(n)) for n in range(100)]
    if rows_per_range == 50_000:
        return  # one range is one window, of no more rows than that
    plan = plan_of(found)
    assert plan.count("windowspecdefinition(_range") == plan.count("windowspecdefinition(") > 0


@pytest.mark.parametrize("limit", [50_000, 20])
def test_exact_quantiles(spark, monkeypatch, limit):
    monkeypatch.setattr(quantiles, "VALUE_LIMIT", limit)
    rng = random.Random(3)
    rows = [
        (rng.gauss(0, 1) * 10 ** rng.randrange(0, 9), float(rng.randrange(5)), None if i % 4 else rng.random(), 7.5, None)
        for i in range(5000)
    ]
    df = spark.createDataFrame(rows, "wide DOUBLE, few DOUBLE, gaps DOUBLE, same DOUBLE, none DOUBLE").repartition(3)
    for share in (0.0, 0.5, 0.9, 0.9999, 1.0):
        got, total = exact_quantiles(df, dict.fromkeys(df.columns, share))
        assert total == 5000
        assert got["none"] is None
        for i, column in enumerate(df.columns[:4]):
            values = np.array([r[i] for r in rows if r[i] is not None])
            assert got[column] == pytest.approx(np.quantile(values, share), rel=1e-12), (column, share)


def test_median_interpolates(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (10,)], "x INT")
    assert exact_quantiles(df, {"x": 0.5}) == ({"x": statistics.median([1, 2, 3, 10])}, 4)


def test_values_that_are_no_finite_numbers_are_ignored(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (float("nan"),), (None,), (3.0,), (float("-inf"),)], "x DOUBLE")
    assert exact_quantiles(df, {"x": 0.5}) == ({"x": 2.0}, 6)
    assert exact_quantiles(df.filter("x > 5 OR x IS NULL"), {"x": 0.5})[0] == {"x": None}


def test_quantile_of_a_hot_value(spark):
    df = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 5.0D ELSE id * 0.001D END AS x")
    values = [5.0 if i % 3 == 0 else i * 0.001 for i in range(3000)]
    assert exact_quantiles(df, {"x": 0.8})[0]["x"] == pytest.approx(np.quantile(values, 0.8))


def plain_forest(rows, seed, sample_rows, depth):
    """{(tree, node): (n, feature, at)} by the same draws in plain Python; rows are (row_index, values)."""
    ring = 2**52 // 10 * 10

    def drawn(text, part=0):
        return int(hashlib.md5(text.encode()).hexdigest()[13 * part : 13 * part + 13], 16)

    nodes = {}
    for tree in range(100):
        g, j = divmod(tree, 10)
        lots = sorted(((drawn(f"{seed}:{g // 2}:{i}", g % 2) - j * (ring // 10)) % ring, i, x) for i, x in rows)
        at_node = {1: [x for _, _, x in lots[:sample_rows]]}
        for level in range(depth + 1):
            below = {}
            for node, own in at_node.items():
                usable = [(f, min(v), max(v)) for f, v in enumerate(zip(*own, strict=True)) if max(v) > min(v)]
                if level == depth or not usable:
                    nodes[tree, node] = (len(own), None, None)
                    continue
                f, low, high = usable[drawn(f"{seed}:{tree}:{node}") % len(usable)]
                at = low + drawn(f"{seed}:{tree}:{node}", 1) / 2**52 * (high - low)
                nodes[tree, node] = (len(own), f, at)
                for x in own:
                    below.setdefault(2 * node + (x[f] > at), []).append(x)
            at_node = below
    return nodes


def walk(nodes, tree, x):
    """Path length of a point in one tree."""
    node = 1
    while nodes.get((tree, node), (0, None, None))[1] is not None:
        _, f, at = nodes[tree, node]
        node = 2 * node + (x[f] > at)
    return node.bit_length() - 1 + average_path(nodes.get((tree, node), (0,))[0])


def test_average_paths():
    assert (average_path(1), average_path(2), depth_limit(256)) == (0, 1, 8)
    assert average_path(256) == pytest.approx(10.244, abs=0.01)


@pytest.mark.parametrize("total", [80, 700])
def test_forest_equals_plain_python(spark, total):
    rng = np.random.default_rng(total)
    values = np.column_stack([rng.normal(size=total), rng.integers(0, 5, total), np.full(total, 7.0)])
    values[::9] = values[0]
    rows = [(i, *map(float, v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "row_index BIGINT, a DOUBLE, b DOUBLE, c DOUBLE").repartition(3)
    forest, sample_rows = fit_forest(df, ["a", "b", "c"], total, 42)
    assert sample_rows == min(256, total)
    expected = plain_forest([(r[0], r[1:]) for r in rows], 42, sample_rows, depth_limit(sample_rows))
    got = {(t, n): (k, None if np.isnan(f) else int(f), None if np.isnan(at) else at) for t, n, k, f, at in forest.itertuples(index=False)}
    assert got == expected
    scored = with_scores(df, ["a", "b", "c"], forest, sample_rows, "s").collect()
    for r in scored[:40]:
        mean = statistics.mean(walk(expected, t, (r.a, r.b, r.c)) for t in range(100))
        assert r.s == pytest.approx(2 ** (-mean / average_path(sample_rows)), rel=1e-6)


def test_forest_does_not_depend_on_partitions(spark):
    df = spark.range(400).selectExpr("id AS row_index", "CAST(id * id % 97 AS DOUBLE) AS a", "CAST(id % 13 AS DOUBLE) AS b")
    one, _ = fit_forest(df.coalesce(1), ["a", "b"], 400, 42)
    other, _ = fit_forest(df.repartition(7, "b"), ["a", "b"], 400, 42)
    assert one.equals(other)


def test_samples_come_from_the_whole_table(spark):
    df = spark.range(200_000).selectExpr("id AS row_index", "CAST(id AS DOUBLE) AS a")
    samples = draw_samples(df, ["a"], 200_000, 42)
    sizes = {r["tree"]: r["count"] for r in samples.groupBy("tree").count().collect()}
    assert sizes == dict.fromkeys(range(100), 256)
    distinct, low, mean, high = samples.selectExpr("count(DISTINCT row_index)", "min(x[0])", "avg(x[0])", "max(x[0])").first()
    # 25,600 draws hit about 24,000 different rows, so no pool stands between the trees and the table.
    assert distinct > 23_000
    assert low < 2_000 and high > 198_000
    assert mean == pytest.approx(100_000, rel=0.05)


def test_arcs_are_made_longer_where_they_hold_too_few(spark, monkeypatch):
    monkeypatch.setattr(isolation, "ARC_ROWS", 8)
    df = spark.range(3000).selectExpr("id AS row_index", "CAST(id AS DOUBLE) AS a")
    short = {tuple(r) for r in draw_samples(df, ["a"], 3000, 42).select("tree", "row_index").collect()}
    monkeypatch.undo()
    assert short == {tuple(r) for r in draw_samples(df, ["a"], 3000, 42).select("tree", "row_index").collect()}
    assert len(short) == 25_600


def test_constant_data_has_one_score(spark):
    df = spark.range(50).selectExpr("id AS row_index", "1.0D AS a", "2.0D AS b")
    forest, sample_rows = fit_forest(df, ["a", "b"], 50, 42)
    assert (len(forest), sample_rows) == (100, 50)
    scores = {r.s for r in with_scores(df, ["a", "b"], forest, sample_rows, "s").collect()}
    assert len(scores) == 1


def test_materialized_tables_are_reread(spark):
    df = spark.range(5).selectExpr("id", "rand() AS r", "CAST(id % 2 AS STRING) AS part")
    kept = materialize(df, "random", partition_by="part")
    assert sorted(kept.collect()) == sorted(kept.collect())
    assert set(kept.columns) == {"id", "r", "part"}
    assert kept.filter("part = '1'").count() == 2
    empty = materialize(df.filter("id > 99"), "empty")
    assert empty.dtypes == df.dtypes
    assert empty.count() == 0
