"""Each operator against brute force or the library, and on nulls, empty and odd input."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from pyspark.sql import functions as F
from studylens.llm import jaccard, licenses, linededup, packing, pieces, quality, queries, sharding, suffixes, topk, toxicity

P = pytest.importorskip("public_tokenizers")
ODD = [(1, None), (2, ""), (None, "some words here"), (4, "  \n \t"), (5, "Zß☃ 日本 \x00 end"), (5, "Zß☃ 日本 \x00 end")]


def words(rng, n, kinds=400):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def test_shards_move_only_into_the_new_one(spark, docs):
    table = docs([(i, "t") for i in range(400)] + [(7, "t")] * 3 + [(None, None)])
    for weights in ([1.0] * 8, [1.0, 2.0, 5.0]):
        grown = table.select(sharding.shard_of(F.col("doc_id"), weights).alias("a"), sharding.shard_of(F.col("doc_id"), [*weights, 1.0]).alias("b"))
        rows = grown.collect()
        assert all(r.a == r.b or r.b == len(weights) for r in rows)
        assert len({r.a for r in rows}) == len(weights)
    slots = sharding.number_slots(sharding.assign_shards(table, "doc_id", [1.0] * 3), "shard", ["doc_id", "text"]).toPandas()
    assert len(slots) == 404
    for _, part in slots.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert sharding.number_slots(sharding.assign_shards(docs([]), "doc_id", [1.0]), "shard", ["doc_id"]).count() == 0


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6)).astype("float32")
    x[40:60] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (600, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (700, [float("nan")] * 6), (None, [1.0] * 6), (800, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    found = topk.top_k(table, "vec_id", "embedding", F.col("key") % 50 == 0, 10, candidates_per_block=64, queries_per_block=2).collect()
    v = np.floor(1024 * x.astype(float)).astype(np.int64)
    for q in range(0, 300, 50):
        best = sorted(((-int(v[i] @ v[q]), i) for i in range(300) if i != q))[:10]
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert {r["query_id"] for r in found} == set(range(0, 300, 50))


def test_pieces_equal_the_library(spark, docs):
    own = pieces.PieceCodec(P.path("piece_bpe_32k.model"))
    rng = random.Random(3)
    signs = list("ab  the\n\tZ9é▁一☃\x00'.,<s></s>日本語😀ing ")
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(500)] + ["a" * 3000, " " * 300, "", " ", "<s>"]
    for t in texts:
        ids = own.library.encode(t)
        assert own.encode(t) == ids and own.decode(ids) == own.library.decode(ids)
    got = pieces.encode_digests(docs(list(enumerate(texts)) + [(9999, None)]), "doc_id", "text", P.path("piece_bpe_32k.model")).collect()
    for r in got:
        ids = own.library.encode(texts[r.doc_id]) if r.doc_id < 9999 else []
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    coded = pieces.encode_texts(docs([(1, "Hello world"), (2, None)]), "doc_id", "text", P.path("piece_bpe_32k.model"))
    assert {r.doc_id: r.text for r in pieces.decode_texts(coded, "doc_id", "ids", P.path("piece_bpe_32k.model")).collect()} == {1: "Hello world", 2: ""}


def test_packing(spark, docs):
    rng = random.Random(4)
    rows = [(i, words(rng, rng.choice([3, 40, 300, 900]))) for i in range(150)] + ODD + [(7000, "İΣ it's <|endoftext|> ﬁ")]
    path = P.path("word_bpe_49k.json")
    cut = packing.token_pieces(docs(rows), "doc_id", "text", path, capacity=256, with_ids=True)
    packed = packing.pack(cut, "length", 256, group_items=60, fan=2).toPandas()
    library = packing.WordCodec(path).library
    want = []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            want.append((-1 if i is None else i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    packed["doc_id"] = packed["doc_id"].fillna(-1).astype(int)
    assert sorted(packed[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    for _, s in packed.sort_values("offset").groupby("sequence_id"):
        assert list(s["offset"]) == [0, *np.cumsum(s["length"])[:-1]] and s["length"].sum() <= 256
    assert packed["sequence_id"].nunique() <= 1.03 * packed["length"].sum() / 256 + 1
    assert packing.pack(packing.token_pieces(docs([]), "doc_id", "text", path), "length").count() == 0


def test_licenses(spark, docs):
    rows = [
        (1, "x\nReleased under the MIT license. y Under THE-mit,license"),
        (2, "Licensed under the Apache License, Version 2.0."),
        (3, "apache licenseé version 2"),
        (4, "licensed under the apache license version two"),
        (6, "all rights reserved\nCC BY NC"),
    ]
    got = {r.doc_id: r for r in licenses.document_labels(licenses.scan(docs([*rows, (20, None), (21, "")]), "doc_id", "text"), "doc_id").collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (2, 2, 7, "mit")
    assert got[2].base_labels == "apache-2" and got[2].score == 1.0
    assert got[3].n_base == 0 and got[3].labels == ""
    assert got[4].base_labels == "" and got[4].labels == "" and got[4].score == 0.0  # 6 of 8 words
    assert got[6].labels == "all-rights-reserved,cc-by-nc"
    assert (got[1].n_words, got[2].n_words) == (11, 8)
    # The join finds exactly the blocks that counting finds.
    rng = random.Random(8)
    pool = sorted({w for _, t in licenses.TEMPLATES for w in licenses.words_of(t)}) + [b"other"]
    index = licenses.TemplateIndex(licenses.TEMPLATES, 0.5, {w: rng.randrange(9) for w in pool})
    for _ in range(300):
        block = rng.sample(pool, rng.randrange(1, 14))
        brute = [i for i, (_, t) in enumerate(licenses.TEMPLATES) if 2 * len(set(licenses.words_of(t)) & set(block)) >= len(set(licenses.words_of(t)))]
        assert [t for t, _ in index.match(block)] == brute


def test_licenses_in_windows(spark, docs):
    by = "This work is licensed under a Creative Commons Attribution 4.0 International License."
    nc = by.replace("Attribution", "Attribution-NonCommercial")
    mit = licenses.TEMPLATES[1][1].split()
    bsd = licenses.TEMPLATES[7][1].split()
    gpl = "This work is licensed under the GNU General Public License, version 3."
    want = {
        "Copyright X\n\n" + " ".join(mit[:13]) + "\n" + " ".join(mit[13:]) + " (the S)": "mit",
        "\n * ".join(bsd): "bsd",
        "Released under the Apache License.": "",
        by: "cc-by",
        nc: "cc-by-nc",
        f"{by}\nNoncommercial use is dear to us.": "cc-by",
        f"{by} {nc}": "cc-by,cc-by-nc",
        nc.replace("Commercial", "Commercial-ShareAlike"): "",
        gpl: "gpl-3",
        gpl.replace("3", "2") + " See section 3.": "",
        gpl.replace("General", "Lesser General"): "",
        "the mit " + "word " * 30 + "license " + "word " * 30 + "released under": "",
        "all " + "word " * 9 + "rights " + "word " * 9 + "reserved": "",
        "All\nrights\nreserved": "all-rights-reserved",
        "reserved": "", "all rights": "", "released under the": "", "mit license": "", None: "", "": "",
    }
    texts = list(want)
    scanned = licenses.scan(docs(list(enumerate(texts)), 1), "doc_id", "text")
    got = {r.doc_id: r.labels for r in licenses.document_labels(scanned, "doc_id").collect()}
    assert {t: got[i] for i, t in enumerate(texts)} == want
    assert [(b.block, b.containment) for b in scanned.filter("doc_id = 0").first().blocks] == [(2, 1.0)]


def brute_components(texts, size, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    of = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                of = [min(of[a], of[b]) if x in (of[a], of[b]) else x for x in of]
    return sets, of


@pytest.mark.parametrize(("group", "percent"), [(1_000_000, 85), (300, 80)])
def test_jaccard_equals_brute_force(spark, docs, monkeypatch, group, percent):
    monkeypatch.setattr(jaccard, "GROUP_TOKENS", group)
    rng, texts = random.Random(6), []
    for _ in range(12):
        base = words(rng, rng.choice([2, 5, 30, 60])).split()
        for _ in range(rng.randrange(1, 7)):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = "new"
            texts.append(" ".join(copy))
    texts += [None, "", " ", "one", "ONE", "a b"]
    got = {r.doc_id: r for r in jaccard.link(docs(list(enumerate(texts))), "doc_id", "text", 4, percent).collect()}
    sets, of = brute_components(texts, 4, percent)
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(texts))] == of
    if group > 300:
        kept = jaccard.keep_one(docs(list(enumerate(texts))), "doc_id", "text", 4, percent)
        assert sorted(r.doc_id for r in kept.collect()) == sorted({i for i, c in enumerate(of) if c == i})
        assert kept.columns == docs([]).columns


def test_lines(spark, docs):
    base = "the quick brown fox jumps over the lazy dog again"
    near = base.replace("quick", "quack")
    far = base.replace("quick", "slow").replace("lazy", "idle").replace("dog", "cat")
    rows = [(3, f"{base}\nkeep me\n{far}"), (1, f"own line that is long enough to count here\n{near}\n{base}"), (2, base), (9, None), (10, ""), (11, "short\nshort")]
    got = {r.doc_id: r for r in linededup.count_lines(docs(rows), "doc_id", "text").collect()}
    assert [got[i].n_removed for i in (1, 2, 3, 9, 10, 11)] == [1, 1, 1, 0, 0, 0]
    assert got[3].kept_in == [1] and got[3].kept_sha256 == hashlib.sha256(f"keep me\n{far}".encode()).hexdigest()
    left = {r.doc_id: r.text for r in linededup.drop_repeats(docs(rows), "doc_id", "text").collect()}
    assert left == {1: f"own line that is long enough to count here\n{near}", 3: f"keep me\n{far}", 9: None, 10: "", 11: "short\nshort"}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance_and_segments():
    rng = random.Random(2)
    for edits in (0, 1, 2, 3):
        pairs = []
        for _ in range(400):
            a = bytes(rng.choice(b"abc") for _ in range(rng.randrange(16, 30)))
            b = bytearray(a)
            for _ in range(rng.randrange(edits + 2)):
                at = rng.randrange(len(b))
                b[at : at + rng.randrange(2)] = bytes(rng.choice(b"abc") for _ in range(rng.randrange(2)))
            pairs.append(sorted((a, bytes(b)), key=len))
        true = [edit_distance(a, b) <= edits for a, b in pairs]
        assert linededup.within([a for a, _ in pairs], [b for _, b in pairs], edits).tolist() == true
        for (a, b), similar in zip(pairs, true, strict=True):  # similar lines always share a key
            if similar:
                keys = []
                for x in (a, b):
                    data = np.frombuffer(x, np.uint8)
                    keys.append(set(linededup.segment_keys(linededup.prefix_hash(data), np.array([0]), np.array([len(x)]), edits)[0].tolist()))
                assert keys[0] & keys[1]


def removed(raw, length):
    count = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] = count.get(b[i : i + length], 0) + 1
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("shard", [1 << 18, 300])
def test_suffixes_equal_brute_force(spark, docs, monkeypatch, shard):
    monkeypatch.setattr(suffixes, "SHARD_BYTES", shard)
    rng = random.Random(9)
    passage = words(rng, 30)
    texts = [f"{words(rng, rng.randrange(20))} {passage[rng.randrange(20):]} {words(rng, rng.randrange(30))}" for _ in range(12)]
    texts += ["ab" * 100, "xyz " * 60, "short", None, "", "é☃" * 40, words(rng, 50)]
    texts += [texts[-1], passage]
    rows = {r.doc_id: r for r in suffixes.spans(docs(list(enumerate(texts))), "doc_id", "text", 64, 16).collect()}
    raw = [(t or "").encode() for t in texts]
    for i, (b, gone) in enumerate(zip(raw, removed(raw, 64), strict=True)):
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        assert (rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans, rows[i].kept_sha256) == (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())


def test_query_removes_strings_of_400_bytes(spark, docs, tmp_path):
    rng = random.Random(21)
    short, long = words(rng, 60), words(rng, 120)  # both of more than 50 words
    assert len(short) < 400 < len(long)
    texts = [f"{words(rng, 40)} {p} {words(rng, 40)}" for p in (short, short, long, long)]
    texts += [f"{long} {words(rng, 20)} {long}", words(rng, 150), "é" * 300, None]
    docs(list(enumerate(texts))).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op10_suffixes(spark, str(tmp_path)).collect()}
    raw = [(t or "").encode() for t in texts]
    for i, (b, gone) in enumerate(zip(raw, removed(raw, 400), strict=True)):
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        assert (got[i].n_bytes, got[i].n_removed, got[i].kept_sha256) == (len(b), int(gone.sum()), hashlib.sha256(kept).hexdigest())
    # n_bytes is the input's length, whether a passage goes (400 bytes) or stays (fewer).
    assert [got[i].n_removed > 0 for i in range(len(texts))] == [False, False, True, True, True, False, True, False]


def test_split_anchors_send_a_string_once_a_part(spark, docs, monkeypatch):
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 1200)  # 10 places a part
    written = {}
    keep = suffixes.materialize
    monkeypatch.setattr(suffixes, "materialize", lambda table, name: written.setdefault(name, keep(table, name)))
    rng = random.Random(3)
    passage, gram = words(rng, 25), "".join(rng.choice("abcdefgh") for _ in range(20))
    texts = [f"{i} {words(rng, 5)} {passage} {words(rng, 5)}" for i in range(120)]
    # One gram twice in a text, in other parts too: the same place seen from two parts is no repeat.
    texts += [f"{words(rng, 15)}{gram}{i}{words(rng, 4)}{gram}{words(rng, 15)}" for i in range(60)]
    got = {r.doc_id: r for r in suffixes.spans(docs(list(enumerate(texts))), "doc_id", "text", 64, 16).collect()}
    gone = removed([t.encode() for t in texts], 64)
    assert [got[i].n_removed for i in range(len(texts))] == [int(g.sum()) for g in gone]
    # A part of a split anchor is a row or so, with every string once, and no place of those it has several times.
    sent = written["suffix-found"].filter("range IS NOT NULL").toPandas()
    strings = [np.frombuffer(x, np.uint64) for x in sent["strings"]]
    places = [np.frombuffer(x, np.int64).reshape(-1, 2)[:, 0] for x in sent["places"]]
    assert len(sent) > 10 and sum(map(len, strings)) > 20 * len(sent)
    assert all((v[1:] > v[:-1]).all() and len(v) == len(p) for v, p in zip(strings, places, strict=True))
    assert any((p < 0).any() for p in places) and any((p >= 0).any() for p in places)
    # Rows out of the search are in proportion to the places looked at.
    assert written["suffix-found"].count() <= 4 * written["suffix-shared"].count()


@pytest.mark.parametrize("ranges", [1, 40])
def test_ranges_of_strings(spark, docs, monkeypatch, ranges):
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 1200)
    monkeypatch.setattr(suffixes, "RANGE_STRINGS", 120 * 49 // ranges)
    rng = random.Random(4)
    passage = words(rng, 25)
    texts = [f"{i} {words(rng, 5)} {passage[i % 7 :]} {words(rng, 5)}" for i in range(120)]
    got = {r.doc_id: r.n_removed for r in suffixes.spans(docs(list(enumerate(texts))), "doc_id", "text", 64, 16).collect()}
    assert [got[i] for i in range(120)] == [int(g.sum()) for g in removed([t.encode() for t in texts], 64)]


def test_lines_of_every_length_equal_brute_force(spark, docs, monkeypatch):
    rng, texts = random.Random(12), []
    pool = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.choice([1, 2, 4, 6, 9, 13, 20, 31, 40]))) for _ in range(60)]
    for _ in range(40):
        own = []
        for line in rng.choices(pool, k=rng.randrange(1, 5)):
            at = rng.randrange(len(line))
            own.append(rng.choice([line, line, line[:at] + "x" + line[at + 1 :], line[:at] + line[at + 1 :], " " * rng.randrange(40)]))
        texts.append("\n".join(own))
    texts += [texts[0] + "\n\n", "Released under the MIT License.\n \n", "Released under the MIT License.\nAll rights reserved.", None, ""]
    places = [(i, n, line) for i, t in enumerate(texts) for n, line in enumerate((t or "").split("\n")) if line.strip()]
    root = list(range(len(places)))
    for a in range(len(places)):
        for b in range(a):
            if root[a] != root[b] and edit_distance(places[a][2].encode(), places[b][2].encode()) <= 2:
                root = [min(root[a], root[b]) if x in (root[a], root[b]) else x for x in root]
    gone = {places[i][:2] for i, r in enumerate(root) if r != i}
    left = {i: "\n".join(x for n, x in enumerate((t or "").split("\n")) if (i, n) not in gone) for i, t in enumerate(texts)}
    for group in (2_000, 3):  # also with leads dealt into blocks
        monkeypatch.setattr(linededup, "GROUP_LINES", group)
        got = {r.doc_id: r for r in linededup.count_lines(docs(list(enumerate(texts))), "doc_id", "text", least=1).collect()}
        assert [got[i].n_removed for i in left] == [sum(i == d for d, _ in gone) for i in left]
        assert [got[i].kept_sha256 for i in left] == [hashlib.sha256(t.encode()).hexdigest() for t in left.values()]
    kept = {r.doc_id: r.text or "" for r in linededup.drop_repeats(docs(list(enumerate(texts))), "doc_id", "text", least=1).collect()}
    assert kept == {i: t for i, t in left.items() if t.strip() or not any(i == d for d, _ in gone)}
    assert {40, 41} - kept.keys() == {40}  # a whole copy goes, blank lines and all


def test_query_and_stage_remove_short_lines(spark, docs, tmp_path):
    rows = [(1, "All rights reserved.\nown"), (2, "other\nAll rights reserved."), (3, "own\n\nother")]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.n_removed for r in queries.op8_lines(spark, str(tmp_path)).collect()}
    assert got == {1: 0, 2: 1, 3: 2}
    left = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs(rows), str(tmp_path)).collect()}
    assert left == {1: rows[0][1], 2: "other"}


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for _ in range(150):
        data = np.tile(rng.integers(97, 99, rng.integers(1, 40)).astype(np.uint8), rng.integers(1, 5))
        order = suffixes.suffix_array(data)
        assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:].tobytes())
        shared = suffixes.common_prefixes(data, order, 20)
        for a, b in zip(order[1:].tolist(), order[:-1].tolist(), strict=True):
            same = 0
            while same < 20 and max(a, b) + same < len(data) and data[a + same] == data[b + same]:
                same += 1
            assert shared[a] == same


def test_quality_figures_and_model(spark, docs):
    rng = random.Random(1)
    normal = [(i, " ".join(rng.choice(["river", "stone", "water", "green", "light"]) + rng.choice("aeiou") for _ in range(120))) for i in range(60)]
    odd = [(100, "qx#zz " * 70), (101, "one two three " * 40), (102, "a b c\na b c\n\n  \nd*")]
    got = {r.doc_id: r for r in quality.assess(docs([*normal, *odd, (200, None), (201, "")]), "doc_id", "text", "lang").collect()}
    assert all(got[i].kept for i, _ in normal) and not got[100].kept and not got[200].kept and got[200].log_perplexity is None
    assert got[101].base_failed and got[101].n_repeat_words == 120
    assert (got[102].n_words, got[102].n_dup_lines, got[102].n_symbols, got[102].word_chars) == (7, 1, 1, 8)
    kept = quality.keep_good(docs(normal + odd), "text", "lang")
    assert kept.count() == 60 and kept.columns == docs([]).columns
    assert quality.keep_good(docs([]), "text", "lang").count() == 0
    # Probabilities after a history add up to one; unseen histories back off.
    key, _ = quality.grams(np.frombuffer(b"abcabdabcabe", np.uint8), np.array([0, 12]))
    model = quality.Model.build(*np.unique(key, return_counts=True))
    model = quality.Model.load(model.dump())
    for history in (0, int(key[5]) & 0x7FFF, 12345):
        every = (np.uint32(history) << np.uint32(5)) | np.arange(32, dtype=np.uint32)
        assert np.exp(model.log_probabilities(every).astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_toxicity_learns_and_holds_out(spark, docs):
    rng, rows = random.Random(7), []
    for i in range(900):
        bad = i % 6 == 0
        rows.append((i, words(rng, 40) + (f" vileterm{rng.randrange(9)} " + words(rng, 20) if bad else ""), "1" if bad and i % 2 == 0 else "0" if i % 3 == 1 else None))
    seen = spark.createDataFrame([(t, None if y is None else int(y)) for _, t, y in rows[:600]], "text string, toxic int")
    model = toxicity.train(seen, "toxic", "text")
    scores = {r.doc_id: r.score for r in toxicity.score(docs([(i, t) for i, t, _ in rows[600:]] + [(5000, None)]), "doc_id", "text", model).collect()}
    bad = [s for i, s in scores.items() if i % 6 == 0 and i < 5000]
    good = [s for i, s in scores.items() if i % 6 and i < 5000]
    assert np.mean(bad) > np.mean(good) + 0.2 and all(0 <= s <= 1 for s in scores.values()) and len(scores) == 301
    nothing = toxicity.train(spark.createDataFrame([], "text string, toxic int"), "toxic", "text")
    assert nothing.scores(*(np.zeros(0, np.uint8), np.zeros(2, np.int64))).tolist() == pytest.approx([0.0])


def test_risk_gradient_is_the_derivative():
    rng = np.random.default_rng(0)
    sets = [(rng.integers(0, n, 60), rng.integers(0, 5, 60), n) for n in (12, 30)]
    w = rng.normal(size=6) * 0.3
    risk, g = toxicity.risk_gradient(w, *sets, 0.1)
    for i in range(6):
        step = np.zeros(6)
        step[i] = 1e-6
        assert (toxicity.risk_gradient(w + step, *sets, 0.1)[0] - risk) / 1e-6 == pytest.approx(g[i], abs=1e-4)


def test_empty_tables(spark, docs):
    none = docs([])
    assert jaccard.link(none, "doc_id", "text").count() == 0
    assert linededup.count_lines(none, "doc_id", "text").count() == 0
    assert suffixes.spans(none, "doc_id", "text").count() == 0
    assert licenses.scan(none, "doc_id", "text").count() == 0
    assert quality.assess(none, "doc_id", "text", "lang").count() == 0


def test_odd_rows_do_not_crash(spark, docs):
    odd = docs(ODD)
    assert jaccard.link(odd, "doc_id", "text").count() == len(ODD)
    assert linededup.count_lines(odd, "doc_id", "text").count() == len(ODD)
    assert suffixes.spans(odd, "doc_id", "text").count() == len(ODD)
    assert quality.assess(odd, "doc_id", "text", "lang").count() == len(ODD)
    assert jaccard.keep_one(odd, "doc_id", "text").count() == len(ODD) - 1
    assert suffixes.clean(odd, "doc_id", "text").count() == len(ODD)
    assert pa.types is not None
