"""Every registered query on odd tables: nulls in any column, empty and long texts, ties, repeated rows, clashing names, no rows."""

import pytest

from studylens.llm.queries import QUERIES

pytest.importorskip("public_tokenizers")

# Columns of each result, in order; more may follow.
COLUMNS = {
    "op1_toxicity": "doc_id held_out score predicted",
    "op2_licenses": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op3_pieces": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op4_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op5_topk": "query_id rank vec_id score",
    "op6_jaccard": "doc_id n_shingles component_id",
    "op7_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op9_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op10_suffixes": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op11_whitening": "vec_id component n deviation whitened explained identity_error",
    "op12_merkle": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "op13_token_files": "doc_id start n_tokens ids_crc32",
}
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = "slot long, shard int, k string, g string, h long, n long, row long, piece int, start long, leaf string, component int, x array<long>"
LONG = " ".join(f"word{i % 997}" for i in range(40_000))
TEXTS = [
    (1, "A plain text of some words, released under the MIT License.", "en", "a", 59), (2, "", "en", "a", 0), (3, None, None, None, None),
    (None, "a text without an id", "de", "b", 20), (4, "tied", "en", "b", 4), (4, "tied too", "en", "b", 8), (5, LONG, "en", "c", len(LONG)),
    (6, "日本語 " * 40, "ja", "c", 160), (7, " \n\t\n ", "fr", None, 5), (8, "x" * 3000, None, "a", 3000),
]
REPEATED = [(9, "the very same row, many times over", "en", "hot", 34)] * 20
VECTORS = [(i, [float((i * k) % 7) for k in range(1, 5)], 0) for i in range(0, 240, 20)]
VECTORS += [(0, [1.0, 2.0, 3.0, 4.0], 1)] * 3 + [(100, None, 0), (300, [None, 1.0, 1.0, 1.0], 0), (400, [float("nan")] * 4, 0), (500, [], 0), (None, [1.0] * 4, 0), (600, [1.0] * 3, 0)]


def written(spark, folder, rows, vectors):
    clash = [f"CAST(NULL AS {c.split(' ', 1)[1]}) AS {c.split(' ', 1)[0]}" for c in CLASHES.split(", ")]
    spark.createDataFrame(rows, DOCS).repartition(3).selectExpr("*", *clash).write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], 1, i % 2) for i, r in enumerate(rows)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    made = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").repartition(2)
    made.selectExpr("*", *clash).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("odd"), TEXTS + REPEATED, VECTORS)


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("none"), [], [])


def test_all_are_covered():
    assert set(COLUMNS) | {"op8_lines"} == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows(spark, odd, name):
    result = QUERIES[name](spark, odd)
    if name in COLUMNS:
        assert result.columns[: len(COLUMNS[name].split())] == COLUMNS[name].split()
    rows = result.collect()
    if name in ("op5_topk", "op11_whitening"):
        assert rows
    elif name == "op4_packing":
        assert {r.doc_id for r in rows if r.piece == 0} == {*range(1, 10), None}
        assert sum(r.piece == 0 for r in rows) == len(TEXTS + REPEATED)
    else:
        # One row for each document, those that repeat and those without an id among them.
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in TEXTS + REPEATED)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_rows(spark, none, name):
    assert QUERIES[name](spark, none).collect() == []
