"""Isolation forest (Liu, Ting, Zhou: Isolation Forest, ICDM 2008) on Spark.

Every draw is a number taken from an MD5, so samples, splits and scores depend on nothing but
the rows and the seed, and other engines can repeat them:

* Each row has GROUPS hash values. A tree's sample are the rows that follow the tree's own starting point on the
  ring of its group's hash values, so every row of the table has the same chance, and each tree finds its
  rows in one narrow pass: a row is a candidate only where it lies within a short arc.
* All trees grow together, level by level: counts and ranges of the values by (tree, node), a split drawn
  for each node, and every sample row moves to a child. The samples are dealt out by tree once; a
  tree has SAMPLE_ROWS rows, whatever the table holds, and nothing is shuffled between levels.
* The finished forest has a fixed size and is broadcast; scoring is one narrow pass of Arrow batches.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .materialize import materialize

# The functions below run in Python workers, which need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The customary settings.
TREES = 100
SAMPLE_ROWS = 256
# Trees of one group look at the same hash values from starting points that are STEP apart.
GROUPS = 10
STARTS = TREES // GROUPS
STEP = 2**52 // STARTS
# Arcs are long enough for so many rows on average; should one hold too few, all are made longer.
ARC_ROWS = 2 * SAMPLE_ROWS
# Path lengths are whole numbers of this fraction, so that their sums don't depend on an order.
PATH_UNIT = 2**20


def average_path(rows: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree over ``rows`` values."""
    if rows <= 1:
        return 0.0
    if rows == 2:
        return 1.0
    return 2.0 * (math.log(rows - 1.0) + np.euler_gamma) - 2.0 * (rows - 1.0) / rows


def depth_limit(sample_rows: int) -> int:
    return math.ceil(math.log2(max(sample_rows, 2)))


def part_of(digest: str, part: int) -> str:
    """SQL for a number in 0 .. 2^52 - 1 from an MD5; parts 0 and 1 are independent."""
    return f"CAST(conv(substring({digest}, {1 + 13 * part}, 13), 16, 10) AS BIGINT)"


def drawn(text: str, part: int = 0) -> str:
    """The same from the MD5 of a text."""
    return part_of(f"md5({text})", part)


def draw_samples(df: DataFrame, columns: Sequence[str], total: int, seed: int) -> DataFrame:
    """(tree, row_index, x: the values of ``columns``) of min(SAMPLE_ROWS, total) rows for each tree; written down."""
    wanted, ring = min(SAMPLE_ROWS, total), STEP * STARTS
    # Two groups share an MD5.
    digests = [f"md5(concat('{seed}:{pair}:', row_index)) AS m{pair}" for pair in range(GROUPS // 2)]
    hashes = ", ".join(f"{part_of(f'm{g // 2}', g % 2)} % {ring}L" for g in range(GROUPS))
    values = ", ".join(f"CAST(`{c}` AS DOUBLE)" for c in columns)
    hashed = df.selectExpr("row_index", f"array({values}) AS x", *digests).selectExpr("row_index", "x", f"posexplode(array({hashes})) AS (g, h)")
    arc = min(ring, -(-ring * ARC_ROWS // total))
    while True:
        # From starting points at or before the value, as far back as an arc reaches.
        reach = -(-arc // STEP)
        lots = [f"named_struct('tree', {STARTS}L * g + pmod(h div {STEP}L - {k}, {STARTS}L), 'lot', h % {STEP}L + {k} * {STEP}L)" for k in range(reach)]
        candidates = hashed.selectExpr("row_index", "x", f"inline(array({', '.join(lots)}))").filter(f"lot < {arc}L")
        place = F.row_number().over(Window.partitionBy("tree").orderBy("lot", "row_index"))
        chosen = candidates.withColumn("place", place).filter(F.col("place") <= wanted)
        samples = materialize(chosen.selectExpr("CAST(tree AS INT) AS tree", "row_index", "x"), "forest-samples")
        if arc == ring or samples.count() == TREES * wanted:
            return samples
        arc = min(ring, 4 * arc)


def grow_trees(samples: DataFrame, dimensions: int, depth: int, seed: int) -> DataFrame:
    """(tree, node, n, feature, at): every node of every tree; ``feature`` is null at a leaf.

    Nodes are numbered as in a heap from 1. A value greater than ``at`` goes right, to 2 * node + 1.
    """
    tasks = min(TREES, samples.sparkSession.sparkContext.defaultParallelism)
    rows = samples.repartition(tasks, "tree").selectExpr("tree", "x", "1L AS node")
    over = "OVER (PARTITION BY tree, node)"
    ranges = [f"{end}(x[{i}]) {over} AS {name}{i}" for i in range(dimensions) for end, name in (("min", "low"), ("max", "high"))]
    usable = ", ".join(f"CASE WHEN high{i} > low{i} THEN named_struct('i', {i}, 'low', low{i}, 'high', high{i}) END" for i in range(dimensions))
    text = f"concat('{seed}:', tree, ':', node)"
    seen: list[str] = []
    for level in range(depth):
        ranged = rows.selectExpr("tree", "x", "node", *seen, f"count(1) {over} AS n", *ranges)
        drawn_from = ranged.selectExpr("tree", "x", "node", *seen, "n", f"array_compact(array({usable})) AS usable")
        # Without a usable range there is none to pick.
        pick = f"get(usable, CAST({drawn(text)} % greatest(size(usable), 1) AS INT)) AS pick"
        picked = drawn_from.selectExpr("tree", "x", "node", *seen, "n", pick, f"{drawn(text, 1)} / {2**52}D AS share")
        at = picked.selectExpr("tree", "x", "node", *seen, "n", "pick.i AS feature", "pick.low + share * (pick.high - pick.low) AS at")
        name = f"level{level}"
        # A leaf's rows stay where they are, and find the same again on the next level.
        moved = "CASE WHEN feature IS NULL THEN node ELSE 2 * node + CASE WHEN x[feature] > at THEN 1 ELSE 0 END END AS node"
        rows = at.selectExpr("tree", "x", moved, *seen, f"named_struct('node', node, 'n', n, 'feature', feature, 'at', at) AS {name}")
        seen.append(name)
    last = f"named_struct('node', node, 'n', count(1) {over}, 'feature', CAST(NULL AS INT), 'at', CAST(NULL AS DOUBLE)) AS level{depth}"
    found = rows.selectExpr("tree", *seen, last).selectExpr("tree", f"inline(array({', '.join([*seen, f'level{depth}'])}))")
    return found.groupBy("tree", "node").agg(F.max("n").alias("n"), F.max("feature").alias("feature"), F.max("at").alias("at"))


def fit_forest(df: DataFrame, columns: Sequence[str], total: int, seed: int) -> tuple[pd.DataFrame, int]:
    """(one row per node, rows per sample); ``df`` needs ``row_index`` and complete numeric columns."""
    sample_rows = min(SAMPLE_ROWS, total)
    nodes = grow_trees(draw_samples(df, columns, total, seed), len(columns), depth_limit(sample_rows), seed)
    # At most 2 * SAMPLE_ROWS - 1 nodes a tree, whatever the table holds.
    return nodes.orderBy("tree", "node").toPandas(), sample_rows


def as_heaps(forest: pd.DataFrame, depth: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per tree: feature and threshold of every inner cell, and a path length for each cell of the lowest level.

    Where a branch ends early, everything goes left, to a cell that has the branch's path length.
    """
    inner = 2**depth - 1
    heaps = []
    for _, tree in forest.groupby("tree", sort=True):
        feature, threshold, path = np.zeros(inner, np.int32), np.full(inner, np.inf), np.zeros(2**depth, np.int64)
        for node, n, split, at in zip(tree["node"].astype(int), tree["n"].astype(int), tree["feature"], tree["at"], strict=True):
            level = node.bit_length() - 1
            if pd.isna(split):
                path[(node << (depth - level)) - 2**depth] = round((level + average_path(n)) * PATH_UNIT)
                continue
            feature[node - 1], threshold[node - 1] = int(split), at
            # A child that no sample row went to has no entry of its own, and ends a path where it stands.
            for child in (2 * node, 2 * node + 1):
                path[(child << (depth - level - 1)) - 2**depth] = (level + 1) * PATH_UNIT
        heaps.append((feature, threshold, path))
    return heaps


def with_scores(df: DataFrame, columns: Sequence[str], forest: pd.DataFrame, sample_rows: int, name: str) -> DataFrame:
    """Adds the anomaly score in (0, 1]; higher is more isolated."""
    depth = depth_limit(sample_rows)
    heaps = as_heaps(forest, depth)
    shipped = df.sparkSession.sparkContext.broadcast(heaps)
    scale = (average_path(sample_rows) or 1.0) * PATH_UNIT * len(heaps)

    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        trees = shipped.value
        for batch in batches:
            values = np.column_stack([s.to_numpy(dtype=float) for s in batch])
            flat, start = values.ravel(), np.arange(len(values)) * values.shape[1]
            total_path = np.zeros(len(values), np.int64)
            for feature, threshold, path in trees:
                node = np.zeros(len(values), dtype=np.int64)
                for _ in range(depth):
                    node = 2 * node + 1 + (flat[start + feature[node]] > threshold[node])
                total_path += path[node - len(feature)]
            yield pd.Series(2.0 ** (-total_path / scale))

    # The iterator form is told apart by its type hints.
    scorer = F.pandas_udf(score, "double")
    return df.withColumn(name, scorer(*[F.col(c).cast("double") for c in columns]))
