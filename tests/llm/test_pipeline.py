"""The pipeline's stages on a small table, against what each must do."""

import random
from pathlib import Path

import pytest

import corpus_pipeline
from studylens.llm.queries import ORACLES, QUERIES

pytest.importorskip("public_tokenizers")
FOLDER = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not FOLDER.exists(), reason="no driver tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(FOLDER)), "test-stage")
        assert docs.columns == names
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= before and len(ids) == docs.count()
        assert docs.filter("n_chars <> length(text)").count() == 0
        before = ids
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(FOLDER)).toPandas()
    assert set(packed["doc_id"]) == before
    assert packed.groupby("sequence_id")["length"].sum().max() <= 2048


def shared_runs(texts, words=51):
    """Documents that share so many words in a row with another one."""
    seen = {}
    for i, t in texts.items():
        own = t.split()
        for j in range(len(own) - words + 1):
            seen.setdefault(tuple(own[j : j + words]), set()).add(i)
    return {i for docs in seen.values() if len(docs) > 1 for i in docs}


def test_passages(spark, docs):
    rng = random.Random(5)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(2, 8))) for _ in range(n))

    passage, almost, long_word = prose(51), prose(45), "x" + prose(90).replace(" ", "")
    texts = {i: f"{prose(60 + i)} {passage} {prose(30)}" for i in range(4)}
    texts |= {10 + i: f"{prose(60)} {almost} {prose(20)}" for i in range(2)}  # too short to be a passage
    texts |= {20 + i: f"{prose(60)} {long_word} {prose(20)}" for i in range(2)}  # one word of over 400 bytes
    texts |= {30: f"{prose(20)} {passage} {prose(10)}", 31: prose(12), 32: "", 33: prose(200)}
    assert len(passage) < 400 < len(long_word) and len(almost) > 200
    before = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    after = {r.doc_id: r for r in corpus_pipeline.repeated_passages(spark, before, "").collect()}
    assert shared_runs(texts) == {0, 1, 2, 3, 30} and not shared_runs({i: r.text for i, r in after.items()})
    for i in (10, 11, 31, 32, 33):
        assert after[i].text == texts[i]  # clean documents, and those too short already, stay as they are
    assert 30 not in after and after.keys() == texts.keys() - {30}  # 30 words are left of it
    for i in range(4):
        assert passage[20:-20] not in after[i].text and len(after[i].text.split()) >= 60 + i + 28
        assert after[i].n_chars == len(after[i].text)
    assert all(long_word[20:-20] not in after[i].text for i in (20, 21))


@pytest.mark.skipif(not FOLDER.exists(), reason="no driver tables")
def test_no_passage_is_left_in_the_driver_tables(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").dropDuplicates(["text"])
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    after = {r.doc_id: r.text or "" for r in corpus_pipeline.repeated_passages(spark, rows, "").collect()}
    shared = shared_runs(texts)
    assert len(shared) > 20 and not shared_runs(after)
    # Hardly any other document is touched: those that repeat themselves, and where shorter runs add up.
    own = {i for i, t in texts.items() for w in [t.split()] if len(w) >= 102 and len({tuple(w[j : j + 51]) for j in range(len(w) - 50)}) < len(w) - 50}
    touched = {i for i in texts.keys() - shared - own if after.get(i) != texts[i]}
    assert len(touched) <= 0.02 * len(texts)


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near duplicates", "repeated passages", "packing"]
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.skipif(not FOLDER.exists(), reason="no driver tables")
def test_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    engine = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        engine.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    for name, sql in ORACLES.items():
        cursor = engine.execute(sql)
        names = [c[0] for c in cursor.description]
        result = QUERIES[name](spark, str(FOLDER))
        assert sorted(names) == sorted(result.columns)
        assert sorted(tuple(r) for r in result.select(*names).collect()) == sorted(cursor.fetchall())
