"""The Merkle manifest against a plain tree, its log against its closed form, and odd tables."""

import hashlib
import random
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from studylens.llm import merkle, queries

FOLDER = Path("/root/testdata/sf0.001")
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def beside(levels, i):
    """(which side, digest) of the sibling at each level."""
    found = []
    for level in levels[:-1]:
        j = i ^ 1
        found.append(("none", "") if j >= len(level) else ("left" if i & 1 else "right", level[j]))
        i >>= 1
    return found


def leaf_of(row, more=0):
    values = [*row[:3], None if row[3] is None else row[3] + more, row[4]]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    ordered = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for g in names}
    trees = {g: tree_of([leaf_of(r) for r in ordered[g]]) for g in names}
    top = tree_of([trees[g][-1][0] for g in names])
    found = []
    for place, g in enumerate(names):
        for i, r in enumerate(ordered[g]):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node, path = leaf_of(r, 1) if tampered else leaf_of(r), beside(trees[g], i) + beside(top, place)
            for side, digest in path:
                node = h(node) if side == "none" else h(digest, node) if side == "left" else h(node, digest)
            proof = h(*[d for side, d in path if side != "none"])
            found.append((r[0], trees[g][0][i], trees[g][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(found, key=str)


def answered(table):
    return sorted((tuple(r) for r in table.collect()), key=str)


@pytest.mark.parametrize("n", [*range(1, 20), 31, 32, 33, 63, 64, 65, 100])
def test_closed_form_finds_every_node(n):
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    for levels in (merkle.height(n), merkle.height(n) + 2):
        log, level, seen = merkle.append_log(leaves, levels), [x.hex() for x in leaves], []
        for number in range(levels + 1):
            assert merkle.width(number, n) == len(level)
            for i, digest in enumerate(level):
                at = merkle.place(number, i, n)
                assert log[32 * at : 32 * at + 32].hex() == digest
                if number:  # children before parents, the right one just before
                    children = [merkle.place(number - 1, c, n) for c in (2 * i, 2 * i + 1) if c < merkle.width(number - 1, n)]
                    assert children[-1] == at - 1 and max(children) < at
                seen.append(at)
            if number < levels:
                level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
        assert sorted(seen) == list(range(len(log) // 32))


def rows_of(spark, rows):
    made = [(*r, "x", 3, "y") for r in rows]  # names that are used inside
    return spark.createDataFrame(made, "doc_id long, source string, lang string, n_chars long, text string, g string, i int, leaf string").repartition(3)


def proofs_of(table, bits):
    columns = [F.col(c) for c in COLUMNS]
    grown = [*columns[:3], F.col("n_chars") + 1, columns[4]]
    chosen = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    found = merkle.proofs(merkle.leaves(table, "doc_id", "lang", columns, F.when(chosen, merkle.leaf_digest(grown))), bits)
    return found.select("k", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("bits", [1, 3, 11])
def test_proofs_equal_a_plain_tree(spark, bits):
    rng = random.Random(bits)
    rows = [(rng.randrange(60), "s", rng.choice(["en", "de", "é", "Z"]), rng.choice([None, 5]), f"text {rng.randrange(9)}") for _ in range(90)]
    rows += [(3, "s", "en", 4, "copy")] * 20 + [(None, None, None, None, None), (None, "s", "en", 1, ""), (7, "s", "fr", 1, "ß" * 100_000)]
    assert answered(proofs_of(rows_of(spark, rows), bits)) == brute(rows)


def test_one_row_and_none(spark):
    row = (5, "s", None, 2, "only")
    assert answered(proofs_of(rows_of(spark, [row]), 2)) == brute([row])
    empty = proofs_of(rows_of(spark, []), 2)
    assert empty.collect() == [] and empty.columns[0] == "k"
    table = rows_of(spark, [])
    assert merkle.manifest(merkle.leaves(table, "doc_id", "lang", [F.col("text")])) is None


def test_log_is_whole_and_in_order(spark):
    rows = [(i, "s", "en" if i % 3 else "de", 1, f"t{i}") for i in range(53)]
    made = merkle.manifest(merkle.leaves(rows_of(spark, rows), "doc_id", "lang", [F.col(c) for c in COLUMNS]), 2)
    for g, n in (("de", 18), ("en", 35)):
        nodes = merkle.log_nodes(made.tree).filter(F.col("g") == g).orderBy("place").collect()
        leaves = [leaf_of(r) for r in rows if r[2] == g]
        assert len(leaves) == n
        whole = merkle.append_log([bytes.fromhex(x) for x in leaves], merkle.height(n))
        assert [r["place"] for r in nodes] == list(range(len(whole) // 32))
        assert "".join(r["digest"] for r in nodes) == whole.hex()
    assert made.root == brute(rows)[0][3]


def test_any_change_is_noticed(spark):
    rows = [(i, "s", "en", 1, f"t{i}") for i in range(40)]
    before = {r[0]: r for r in brute(rows)}
    for changed in (rows[:-1], [*rows, (40, "s", "en", 1, "t40")], [(i, s, g, n, "other" if i == 7 else t) for i, s, g, n, t in rows]):
        roots = {r["root"] for r in proofs_of(rows_of(spark, changed), 3).collect()}
        assert len(roots) == 1 and roots != {before[0][3]}


@pytest.mark.skipif(not FOLDER.exists(), reason="no driver tables")
def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select(*COLUMNS).collect()]
    found = queries.op12_merkle(spark, str(FOLDER))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert answered(found) == brute(rows)
