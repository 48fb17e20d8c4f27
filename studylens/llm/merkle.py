"""Merkle manifest of a dataset: a tree of digests over its rows, kept as a postorder append log.

Rows are the leaves, in order of their key within their group. Every two consecutive nodes of a level become
their parent, the last one alone if their number is odd, until one is left, the group's subroot; the
subroots, in order of their groups, likewise become the root. A digest is the lower-case
hex SHA-256 of its inputs' concatenation, where digests go in as hex text.

1. ``leaves`` hashes rows with SQL functions.
2. ``numbered`` finds each leaf's place in its group: the leaves are sorted in ranges, and a
   leaf's place is the place in its range plus a prefix sum with one row for each range and group.
3. ``build`` cuts the leaves of a group into aligned blocks of ``2 ** bits``. A builder takes one block
   and appends its nodes in the order in which they are completed, so each subtree is a
   contiguous stretch of the log. The roots of the blocks are the leaves of the next round,
   until every group has one block. No task ever holds more than a block.
4. ``proofs`` goes from the top down: every round hands each block the siblings above it, and a builder's
   log has the siblings inside of it, at places that follow from the sizes of the subtrees before
   (``place``). Nothing is searched or hashed again, but for the fold that checks a proof.

Places: after m leaves, the complete subtrees have 2m - popcount(m) nodes, and the last leaf has just completed
as many as m has trailing zeros, besides itself. So the node that closes with leaf m at level l is at
2m - popcount(m) - 1 - (trailing zeros of m - l). A last node that covers fewer leaves than its level has
is completed after all leaves are in, from the lowest such level up.

Defined cases: null groups and keys come first in their order; rows with equal keys are ordered by their
digests, and equal rows are leaves each; a leaf without a sibling has the digest of no input as its proof;
an empty table gives no rows; other columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.materialize import materialize
from ..operators.prefix import ranged

BITS = 11  # a builder has 2 ** BITS leaves
ROWS_PER_RANGE = 100_000
SIZE = 32  # bytes of a digest
_NONE, _LEFT, _RIGHT = 0, 1, 2  # which side of the path a sibling is on
_STEP = SIZE + 1


def digest(*parts: bytes) -> bytes:
    """The digest over digests, which go in as hex text."""
    return hashlib.sha256(b"".join(p.hex().encode() for p in parts)).digest()


# -- places in the log ------------------------------------------------------------------------


def place(level: int, index: int, leaves: int) -> int:
    """Where the node that is number ``index`` of ``level`` stands in the log of a tree over ``leaves``."""
    m = (index + 1) << level
    if m <= leaves:
        return 2 * m - m.bit_count() - 1 - ((m & -m).bit_length() - 1 - level)
    # All complete nodes, then one incomplete node for each level whose size does not divide the leaves.
    return 2 * leaves - leaves.bit_count() + sum(1 for low in range(1, level) if leaves % (1 << low))


def height(leaves: int) -> int:
    """Levels above the leaves."""
    return (leaves - 1).bit_length() if leaves > 1 else 0


def width(level: int, leaves: int) -> int:
    """Nodes of a level."""
    return -(-leaves >> level)


def block_leaves(bits: int, b: int, n: int) -> int:
    """Leaves of block ``b`` among ``n``."""
    return min(1 << bits, n - (b << bits))


def append_log(leaves: Sequence[bytes], levels: int) -> bytes:
    """The nodes of a tree of ``levels`` levels above the leaves, in the order in which they are completed."""
    log, waiting = bytearray(), [None] * (levels + 1)  # waiting: at each level, the left node whose pair is not complete

    def complete(node: bytes, level: int) -> None:
        while True:
            log.extend(node)
            if level == levels:
                return
            if waiting[level] is None:
                waiting[level] = node
                return
            node, waiting[level], level = digest(waiting[level], node), None, level + 1

    for leaf in leaves:
        complete(leaf, 0)
    for level in range(levels):
        if waiting[level] is not None:  # its pair will never come
            node, waiting[level] = digest(waiting[level]), None
            complete(node, level + 1)
    return bytes(log)


def siblings(log: bytes, index: int, leaves: int, levels: int) -> bytes:
    """For each level, from the leaf up: the side of the sibling and its digest (zeros if there is none)."""
    steps = []
    for level in range(levels):
        beside = index ^ 1
        if beside >= width(level, leaves):
            steps.append(bytes([_NONE]) + bytes(SIZE))
        else:
            at = SIZE * place(level, beside, leaves)
            steps.append(bytes([_LEFT if index & 1 else _RIGHT]) + log[at : at + SIZE])
        index >>= 1
    return b"".join(steps)


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and the siblings on its way up lead to."""
    for at in range(0, len(path), _STEP):
        side, beside = path[at], path[at + 1 : at + _STEP]
        leaf = digest(beside, leaf) if side == _LEFT else digest(leaf, beside) if side == _RIGHT else digest(leaf)
    return leaf


def proof_digest(path: bytes) -> str:
    """Digest of the siblings on a path, in order."""
    there = [path[at + 1 : at + _STEP] for at in range(0, len(path), _STEP) if path[at] != _NONE]
    return digest(*there).hex()


# -- the tree as tables -----------------------------------------------------------------------


def leaf_digest(values: Sequence[Column]) -> Column:
    """Digest of a row: each value as ``-`` if null, else its length in bytes, ``:`` and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def leaves(table: DataFrame, key: str, group: str, values: Sequence[Column], claimed: Column | None = None) -> DataFrame:
    """(k, g, leaf, claimed) with digests of 32 bytes; ``claimed`` is the digest that a holder of the row has, null if it is the row's."""
    said = F.unhex(claimed) if claimed is not None else F.lit(None).cast("binary")
    return table.select(F.col(f"`{key}`").alias("k"), F.col(f"`{group}`").alias("g"), F.unhex(leaf_digest(values)).alias("leaf"), said.alias("claimed"))


def numbered(rows: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Adds ``i``, the place of a leaf in its group, and ``n``, the leaves of the group; written down."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    written = materialize(rows, "merkle-leaves")
    count = written.count()
    ranges = max(-(-count // rows_per_range), min(tasks, count // 1000))
    # The last key cuts a run of equal rows, so that no row's copies have to fit in one range.
    keys = ["g", "k", "leaf", "claimed", "spread"]
    dealt = ranged(written.withColumn("spread", F.monotonically_increasing_id()), keys, ranges, "merkle-sorted")
    parts = dealt.groupBy("g", "_range").agg(F.count(F.lit(1)).alias("rows"), F.min("_at").alias("first"))
    # One row for each range and group is all that these windows see.
    before = F.sum("rows").over(Window.partitionBy("g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select(
        F.col("g").alias("own_g"), F.col("_range").alias("own_range"), (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(Window.partitionBy("g")).alias("n"),
    )
    offsets = materialize(offsets, "merkle-offsets")
    joined = dealt.join(offsets, F.col("g").eqNullSafe(F.col("own_g")) & (F.col("_range") == F.col("own_range")))
    return joined.select("k", "g", "leaf", "claimed", (F.col("_at") + F.col("shift")).cast("long").alias("i"), F.col("n").cast("long"))


@dataclass(frozen=True)
class Tree:
    """``rounds``: per round a table of blocks (g, b, n, total, log; the first also keys and claims); ``roots``: (g, subroot).

    ``b`` numbers the blocks of a group, ``n`` counts the leaves of this round in the group and ``total``
    the leaves of the first.
    """

    rounds: tuple[DataFrame, ...]
    roots: DataFrame
    bits: int


def _kind(table: DataFrame, column: str) -> str:
    return table.schema[column].dataType.simpleString()


def build(rows: DataFrame, bits: int = BITS) -> Tree:
    """All nodes above the leaves of ``numbered``; every round is written down before the next."""
    g, k = _kind(rows, "g"), _kind(rows, "k")
    schema = f"g {g}, b long, n long, total long, log binary"

    def builder(with_keys: bool):  # noqa: ANN202
        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by("i")
            n = table.column("n")[0].as_py()
            own = append_log(table.column("leaf").to_pylist(), min(bits, height(n)))
            columns = {c: table.column(c).slice(0, 1).combine_chunks() for c in ("g", "b", "n", "total")} | {"log": pa.array([own], pa.binary())}
            if with_keys:
                for name in ("k", "claimed"):
                    values = table.column(name).combine_chunks()
                    values = values if isinstance(values, pa.Array) else pa.concat_arrays(values.chunks)
                    columns[name] = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            return pa.table(columns)

        return run

    rows = rows.select("g", "k", "claimed", "leaf", "i", "n", F.col("n").alias("total"), F.shiftright("i", bits).alias("b"))
    blocks = rows.groupBy("g", "b").applyInArrow(builder(True), f"{schema}, k array<{k}>, claimed array<binary>")
    rounds = [materialize(blocks, "merkle-round-0")]
    while True:
        last = rounds[-1].select("g", "b", "n", "total", F.substring("log", -SIZE, SIZE).alias("leaf"))
        more = last.filter(F.col("n") > 1 << bits)
        if more.isEmpty():
            break
        more = more.select("g", "leaf", F.col("b").alias("i"), F.shiftright(F.col("n") + ((1 << bits) - 1), bits).alias("n"), "total", F.shiftright("b", bits).alias("b"))
        rounds.append(materialize(more.groupBy("g", "b").applyInArrow(builder(False), schema), f"merkle-round-{len(rounds)}"))
    tops = [r.filter(F.col("n") <= 1 << bits).select("g", F.substring("log", -SIZE, SIZE).alias("subroot")) for r in rounds]
    return Tree(tuple(rounds), materialize(reduce(DataFrame.unionByName, tops), "merkle-roots"), bits)


def _same_block(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    named = paths.select(F.col("g").alias("own_g"), F.col("b").alias("own_b"), "subroot", "path")
    return blocks.join(named, F.col("g").eqNullSafe(F.col("own_g")) & (F.col("b") == F.col("own_b"))).drop("own_g", "own_b")


def paths_to_blocks(tree: Tree, above: DataFrame) -> DataFrame:
    """The blocks of the first round with ``path``, the siblings above each; ``above`` has (g, subroot, path) of the groups."""
    g, bits = _kind(tree.rounds[0], "g"), tree.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                b, n, log, path = (row.column(c)[0].as_py() for c in ("b", "n", "log", "path"))
                here = block_leaves(bits, b, n)
                steps = [siblings(log, j, here, min(bits, height(n))) + path for j in range(here)]
                many = pa.array([0] * here, pa.int64())
                own = [row.column("g").take(many), pa.array([(b << bits) + j for j in range(here)], pa.int64())]
                yield pa.RecordBatch.from_arrays([*own, row.column("subroot").take(many), pa.array(steps, pa.binary())], names=["g", "b", "subroot", "path"])

    paths = None
    for number in reversed(range(len(tree.rounds))):
        blocks = tree.rounds[number]
        tops = blocks.filter(F.col("n") <= 1 << bits).select(F.col("g").alias("top"))
        own = tops.join(above, F.col("top").eqNullSafe(F.col("g"))).select("g", F.lit(0).cast("long").alias("b"), "subroot", "path")
        known = own if paths is None else own.unionByName(paths)
        joined = _same_block(blocks, known)
        if number == 0:
            return joined
        paths = materialize(joined.select("g", "b", "n", "log", "subroot", "path").mapInArrow(run, f"g {g}, b long, subroot binary, path binary"), "merkle-paths")
    raise ValueError("a tree has a round")


@dataclass(frozen=True)
class Manifest:
    """The trees of all groups, and the tree over their subroots."""

    tree: Tree
    groups: Tree

    @property
    def root(self) -> str:
        return bytes(self.groups.roots.first()["subroot"]).hex()


def manifest(rows: DataFrame, bits: int = BITS) -> Manifest | None:
    """Both levels of trees over the rows of ``leaves``; none if there are no rows."""
    tree = build(numbered(rows), bits)
    if tree.roots.isEmpty():
        return None
    subroots = tree.roots.select(F.col("g").alias("k"), F.lit(0).alias("g"), F.col("subroot").alias("leaf"), F.lit(None).cast("binary").alias("claimed"))
    return Manifest(tree, build(numbered(subroots), bits))


def _expand(blocks: DataFrame, bits: int, root: bytes, with_proof: bool) -> DataFrame:
    """One row for each leaf of blocks with paths."""
    kind = blocks.schema["k"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                b, n, log, path, claims, subroot = (row.column(c)[0].as_py() for c in ("b", "n", "log", "path", "claimed", "subroot"))
                here = block_leaves(bits, b, n)
                at_leaf = [SIZE * place(0, j, here) for j in range(here)]
                own = [log[p : p + SIZE] for p in at_leaf]
                steps = [siblings(log, j, here, min(bits, height(n))) + path for j in range(here)]
                folded = [fold(leaf if claim is None else claim, step) for leaf, claim, step in zip(own, claims, steps, strict=True)]
                columns = [
                    row.column("k").flatten(), row.column("g").take(pa.array([0] * here, pa.int64())),
                    pa.array([leaf.hex() for leaf in own]), pa.array([subroot.hex()] * here), pa.array([root.hex()] * here),
                    pa.array([proof_digest(s) for s in steps]), pa.array([f.hex() for f in folded]), pa.array([f == root for f in folded]),
                ]
                names = ["k", "g", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
                if with_proof:
                    columns, names = [*columns, pa.array(steps, pa.binary())], [*names, "proof"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    wanted = blocks.select("g", "b", "n", "log", "k", "claimed", "path", "subroot")
    schema = f"k {kind}, g {_kind(blocks, 'g')}, {_ROWS}" + (", proof binary" if with_proof else "")
    return wanted.mapInArrow(run, schema)


_ROWS = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proofs(rows: DataFrame, bits: int = BITS, with_proof: bool = False) -> DataFrame:
    """(k, g, leaf, subroot, root, proof_sha256, folded_root, verified[, proof]) for every row of ``leaves``.

    ``folded_root`` is what the claimed digest (the leaf, if there is none) leads to by the siblings of the
    true tree, and ``verified`` whether that is the root.
    """
    made = manifest(rows, bits)
    if made is None:
        empty = f"k {_kind(rows, 'k')}, g {_kind(rows, 'g')}, {_ROWS}" + (", proof binary" if with_proof else "")
        return rows.sparkSession.createDataFrame([], empty)
    root = bytes.fromhex(made.root)
    spark = rows.sparkSession
    start = spark.createDataFrame([(0, root, b"")], "g int, subroot binary, path binary")
    of_groups = _expand(paths_to_blocks(made.groups, start), bits, root, True)
    above = of_groups.select(F.col("k").alias("g"), F.unhex("leaf").alias("subroot"), F.col("proof").alias("path"))
    return _expand(paths_to_blocks(made.tree, materialize(above, "merkle-groups")), bits, root, with_proof)


def log_nodes(tree: Tree) -> DataFrame:
    """(g, place, level, index, digest): the whole log of every group, each node at its place."""
    bits = tree.bits

    def of_round(number: int):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(batch.num_rows):
                    row = batch.slice(at, 1)
                    b, n, total, log = (row.column(c)[0].as_py() for c in ("b", "n", "total", "log"))
                    here, found = block_leaves(bits, b, n), []
                    for low in range(1 if number else 0, min(bits, height(n)) + 1):
                        for j in range(width(low, here)):
                            level, index = number * bits + low, (b << (bits - low)) + j
                            own = SIZE * place(low, j, here)
                            found.append((place(level, index, total), level, index, log[own : own + SIZE].hex()))
                    columns = [row.column("g").take(pa.array([0] * len(found), pa.int64()))]
                    columns += [pa.array(c) for c in zip(*found, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=["g", "place", "level", "index", "digest"])

        return run

    schema = f"g {_kind(tree.rounds[0], 'g')}, place long, level long, index long, digest string"
    parts = [r.select("g", "b", "n", "total", "log").mapInArrow(of_round(i), schema) for i, r in enumerate(tree.rounds)]
    return reduce(DataFrame.unionByName, parts)
