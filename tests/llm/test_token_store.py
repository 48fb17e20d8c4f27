"""The token store against the tokenizers library, and on nulls, ties, repeated rows, long texts and no rows."""

import random
import zlib
from pathlib import Path

import numpy as np
import pytest

from studylens.llm import queries, tokenstore

P = pytest.importorskip("public_tokenizers")
FOLDER = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def path():
    return P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def brute(library, rows):
    """(key, start, n_tokens, crc) in order; nulls first, equal keys by digest of the library's ids."""
    found, start = [], 0
    encoded = [(k, library.encode(t or "", add_special_tokens=False).ids + [0]) for k, t in rows]
    keyed = [((k is not None, k or 0, zlib.crc32(np.array(i, "<u2").tobytes()), len(i)), k, i) for k, i in encoded]
    for _, k, ids in sorted(keyed, key=lambda r: r[0]):
        found.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return found


def rows_of(table):
    return [tuple(r)[:4] for r in table.orderBy("start").collect()]


def test_codec_gives_the_ids_of_the_library(path, library):
    own, rng = tokenstore.ByteCodec(path), random.Random(1)
    signs = [*"ab  the\n\tZ9é\x1c\x1f　 ☃\x00'.,日本語😀\x85", "<|endoftext|>", "'s ", " ing", "  "]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["a" * 3000, " " * 300, ""]
    for t, raw in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(raw, own.kind).tolist() == library.encode(t, add_special_tokens=False).ids
    assert own.fast
    # Every token of the vocabulary, and every character of the Basic Multilingual Plane between others.
    every = [library.decode([i]) for i in range(library.get_vocab_size())]
    every += [f"a{chr(c)}b {chr(c)}1  {chr(c)}x" for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(every), 10_000):
        part = every[at : at + 10_000]
        assert own.encode(part) == own._by_library(part)


def test_other_kinds_of_files_go_through_the_library():
    own = tokenstore.ByteCodec(P.path("word_bpe_49k.json"))
    assert not own.fast
    assert np.frombuffer(own.encode(["Some Words"])[0], own.kind).tolist() == own.library.encode("Some Words", add_special_tokens=False).ids


def test_store_equals_brute_force(spark, docs, path, library):
    rng = random.Random(2)
    rows = [(rng.randrange(400), " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(60)))) for _ in range(300)]
    rows += [(7, "the very same row")] * 200 + [(None, None), (None, "no key"), (1000, None), (1001, ""), (-5, "Zß☃ 日本 \x00 end"), (1002, "word and more " * 20_000)]
    store = tokenstore.write(docs(rows), "doc_id", "text", path, file_bytes=4096)
    expected = brute(library, rows)
    assert rows_of(tokenstore.read(store)) == expected
    files = spark.read.parquet(f"{store.folder}/documents").select("file").distinct().count()
    assert files > 3
    # One document at a time, by key, also after opening the store anew.
    again = tokenstore.open_store(spark, store.folder, "id")
    assert again.dictionary_hash == store.dictionary_hash and again.width == 2
    few = tokenstore.read(again, spark.createDataFrame([(7,), (1002,), (31337,)], "id long"))
    assert few.columns == ["id", "start", "n_tokens", "ids_crc32", "ids"]
    assert rows_of(few) == [r for r in expected if r[0] in (7, 1002)]
    long = next(r for r in few.collect() if r["id"] == 1002)
    assert list(long["ids"]) == library.encode(rows[-1][1], add_special_tokens=False).ids + [0]


def test_file_alone_tells_its_documents(spark, docs, path, library):
    import zstandard

    store = tokenstore.write(docs([(1, "first text"), (2, "second text")]), "doc_id", "text", path)
    (name,) = (r["file"] for r in spark.read.parquet(f"{store.folder}/documents").select("file").distinct().collect())
    data = Path(store.folder.removeprefix("file://"), name).read_bytes()
    assert data.startswith(tokenstore.MAGIC) and data.endswith(tokenstore.MAGIC)
    assert data[9:41].hex() == store.dictionary_hash
    n = int.from_bytes(data[-16:-8], "little")
    at = np.frombuffer(data[-16 - 8 * (n + 1) : -16], "<u8")
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(store.dictionary))
    ids = [np.frombuffer(unpack.decompress(data[a:b]), "<u2").tolist() for a, b in zip(at, at[1:], strict=False)]
    assert ids == [library.encode(t, add_special_tokens=False).ids + [0] for t in ("first text", "second text")]


def test_damage_is_noticed(spark, docs, path):
    store = tokenstore.write(docs([(i, f"text {i} " * 9) for i in range(40)]), "doc_id", "text", path)
    other = tokenstore.TokenStore(spark, store.folder, "doc_id", store.index, store.dictionary + b"x", store.width, store.frame_bytes)
    with pytest.raises(Exception, match="dictionary"):
        tokenstore.read(other).collect()


def test_no_rows_and_clashing_names(spark, docs, path, library):
    assert tokenstore.read(tokenstore.write(docs([]), "doc_id", "text", path)).collect() == []
    names = "start string, n_tokens string, k string, file string"
    table = spark.createDataFrame([("b", "one two", "x", "y"), ("a", None, "x", "y")], names)
    found = tokenstore.read(tokenstore.write(table, "start", "n_tokens", path), with_ids=False).toDF("key", "s", "n", "c")
    assert [(r["key"], r["s"], r["n"]) for r in found.orderBy("s").collect()] == [("a", 0, 1), ("b", 1, len(library.encode("one two").ids) + 1)]


@pytest.mark.skipif(not FOLDER.exists(), reason="no driver tables")
def test_query(spark, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.op13_token_files(spark, str(FOLDER))
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert rows_of(found) == brute(library, rows)
