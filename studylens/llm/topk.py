"""Exact top-k inner products by pivot-table elimination.

Every vector's distances to the pivots are computed once. For a query q and a candidate x the
triangle inequality gives d(q, x) >= max over pivots |d(q, p) - d(x, p)|, hence
q.x = (|q|^2 + |x|^2 - d^2) / 2 has an upper bound. Candidates are evaluated in the order of
their bounds until the next bound is below the k-th best score: the result is exact.

Queries and candidates are dealt into blocks of bounded size, and each task treats one block of
each; the partial lists of k are merged per query. Pivots are a bounded sample (``pivots``): they
change the work, never the result.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part;
vectors are compared with those of the same length only; a null id takes no part; repeated rows are
candidates of their own, but equal rows are one query, and no row with the query's id is its
candidate; ties go to the smaller id. Components beyond 2^25 would overflow the integer score and
raise an error. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.materialize import materialize

CANDIDATES_PER_BLOCK = 8192
QUERIES_PER_BLOCK = 1024
PIVOTS = 24
STEP = 128  # candidates evaluated at a time
LIMIT = float(1 << 25)


def integer_vectors(table: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(key, v) with v = floor(scale * component); faulty vectors are left out."""

    def finite(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))

    def whole(c: Column) -> Column:
        c = F.floor(c * scale)
        return F.when(F.abs(c) <= LIMIT, c).otherwise(F.raise_error(F.lit("component too large for an integer score")).cast("long"))

    x = table.select(
        F.col(f"`{key}`").cast("long").alias("key"), F.transform(F.col(f"`{vector}`"), lambda c: c.cast("double")).alias("x")
    )
    x = x.filter(F.col("key").isNotNull() & F.coalesce(F.size("x") > 0, F.lit(False)))
    return x.filter(F.forall("x", finite)).select("key", F.transform("x", whole).alias("v"))


def _with_distances(vectors: DataFrame, pivots: int) -> DataFrame:
    """Adds ``d``, the distances to the pivots of the vector's length; written down once."""
    vectors = vectors.withColumn("dim", F.size("v"))
    picked = [F.min_by("v", F.xxhash64("key", F.lit(i))).alias(f"p{i}") for i in range(pivots)]
    # One row of ``pivots`` vectors per vector length.
    table = {r["dim"]: np.array(r[1:], np.int64) for r in vectors.groupBy("dim").agg(*picked).collect()}

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            d = np.zeros((len(batch), pivots))
            for dim, rows in batch.groupby("dim").indices.items():
                x = np.stack(batch["v"].to_numpy()[rows])
                for j, p in enumerate(table[dim]):
                    d[rows, j] = np.sqrt(((x - p) ** 2).sum(axis=1).astype(float))
            yield batch.assign(d=list(d))

    return materialize(vectors.mapInPandas(measure, "key long, v array<long>, dim int, d array<double>"), "pivot-distances")


def best_in_block(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates of each query, both of one vector length."""
    if queries.empty or candidates.empty:
        return pd.DataFrame({"query_id": [], "query": [], "vec_id": [], "score": []}).astype("int64")
    candidates = candidates.sort_values("key", kind="stable")
    ids, x, dx = candidates["key"].to_numpy(), np.stack(candidates["v"]), np.stack(candidates["d"])
    norms = (x * x).sum(axis=1)
    found = []
    for q_id, q_row, q, dq in zip(queries["key"], queries["query"], queries["v"], queries["d"], strict=True):
        q, dq = np.asarray(q), np.asarray(dq)
        norm = int((q * q).sum())
        gap = np.abs(dx[:, 0] - dq[0])
        for j in range(1, len(dq)):
            np.maximum(gap, np.abs(dx[:, j] - dq[j]), out=gap)
        both = norms + float(norm)
        bound = (both - gap * gap) / 2 + 1 + both * 1e-9  # a little above the true bound: rounding
        order = np.argsort(-bound, kind="stable")
        order = order[ids[order] != q_id]
        bound = bound[order]
        top_ids, top = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at in range(0, len(order), STEP):
            if len(top) == k and bound[at] < top[-1]:
                break
            some = order[at : at + STEP]
            top_ids, top = np.concatenate([top_ids, ids[some]]), np.concatenate([top, x[some] @ q])
            keep = np.lexsort((top_ids, -top))[:k]
            top_ids, top = top_ids[keep], top[keep]
        found.append(pd.DataFrame({"query_id": q_id, "query": q_row, "vec_id": top_ids, "score": top}))
    return pd.concat(found)


def top_k(
    table: DataFrame,
    key: str,
    vector: str,
    is_query: Column,
    k: int,
    scale: int = 1024,
    pivots: int = PIVOTS,
    candidates_per_block: int = CANDIDATES_PER_BLOCK,
    queries_per_block: int = QUERIES_PER_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where ``is_query``, a test of ``key``, holds."""
    vectors = _with_distances(integer_vectors(table, key, vector, scale), pivots)
    vectors = vectors.withColumn("row", F.xxhash64("key", "v"))
    asked = vectors.filter(is_query).dropDuplicates(["key", "v"]).withColumnRenamed("row", "query")
    n, n_queries = vectors.count(), vectors.filter(is_query).count()
    blocks, query_blocks = max(1, -(-n // candidates_per_block)), max(1, -(-n_queries // queries_per_block))
    # Equal rows share a hash, so copies are spread by their place in the written table.
    spread = F.pmod(F.xxhash64("row", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    asked = asked.select(
        "key", "query", "v", "d", "dim",
        F.pmod(F.col("query"), F.lit(query_blocks)).cast("int").alias("qb"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("cb"),
    )
    vectors = vectors.select(
        "key", "v", "d", "dim", spread.alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb")
    )
    on = ["dim", "cb", "qb"]
    partial = (
        asked.groupBy(*on)
        .cogroup(vectors.groupBy(*on))
        .applyInPandas(lambda q, c: best_in_block(q, c, k), "query_id long, query long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    ranked = partial.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
