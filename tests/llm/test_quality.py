"""The n-gram model of the quality rules: scripts, figures against plain Python, models too large to broadcast."""

import math
import random
from collections import Counter, defaultdict

import pytest

from studylens.llm import quality

ALPHABETS = {
    "latin": "abcdefghijklmnopqrstuvwxyz",
    "cyrillic": "абвгдежзийклмнопрстуфхцчшщыэюя",
    "chinese": "".join(chr(0x4E00 + 7 * i) for i in range(120)),
}


def texts(alphabet, n, rng, known=True):
    """Texts of words out of a vocabulary, or of words of random letters."""
    word = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randrange(2, 9)))
    vocabulary = [word() for _ in range(150)]
    return [" ".join(rng.choice(vocabulary) if known else word() for _ in range(200)) for _ in range(n)]


@pytest.mark.parametrize("script", ALPHABETS)
def test_random_letters_are_told_from_words_in_every_script(spark, docs, script):
    rng = random.Random(3)
    words, junk = (texts(ALPHABETS[script], n, rng, known) for n, known in ((60, True), (20, False)))
    got = {r.doc_id: r for r in quality.assess(docs(list(enumerate(words + junk))), "doc_id", "text", "lang").collect()}
    assert not any(r.base_failed for r in got.values())
    assert sum(got[i].kept for i in range(60)) >= 58
    assert not any(got[i].kept for i in range(60, 80))


def plain_model(sequences, order):
    """Modified Kneser-Ney by the book: probability of the last symbol of every n-gram met."""
    counts = {order: Counter(("\n" * (order - 1) + s)[i : i + order] for s in sequences for i in range(len(s)))}
    for size in range(order - 1, 0, -1):
        counts[size] = Counter(g[1:] for g in counts[size + 1])
    lower = {"": 1 / (len(counts[1]) + 1)}
    for size in range(1, order + 1):
        n = Counter(counts[size].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
        d = [0, *(min(max(i - (i + 1) * y * n[i + 1] / n[i] if n[i] else y, 0.1), i) for i in (1, 2, 3))]
        total, taken = defaultdict(int), defaultdict(float)
        for g, c in counts[size].items():
            total[g[:-1]] += c
            taken[g[:-1]] += d[min(c, 3)]
        lower = {g: (c - d[min(c, 3)] + taken[g[:-1]] * lower[g[1:]]) / total[g[:-1]] for g, c in counts[size].items()}
    return lower


def test_perplexity_is_that_of_a_plain_model(spark, docs):
    rng = random.Random(5)
    rows = [*texts(ALPHABETS["latin"][:9], 12, rng), *texts(ALPHABETS["cyrillic"], 6, rng)]
    model = plain_model(rows, quality.LONGEST)
    got = {r.doc_id: r.log_perplexity for r in quality.assess(docs(list(enumerate(rows))), "doc_id", "text", "lang").collect()}
    for i, text in enumerate(rows):
        padded = "\n" * (quality.LONGEST - 1) + text
        logs = [math.log(model[padded[j : j + quality.LONGEST]]) for j in range(len(text))]
        assert got[i] == pytest.approx(-sum(logs) / len(text), abs=0.51 * quality.STEP)


def test_a_model_too_large_to_broadcast_gives_the_same(spark, docs, monkeypatch):
    rng = random.Random(8)
    rows = [(i, t, lang) for lang, a in (("en", "latin"), ("ru", "cyrillic")) for i, t in enumerate([*texts(ALPHABETS[a], 25, rng), "", None, "Ä1 #" * 60])]
    rows += [(900, "the same row " * 30, "en")] * 3 + [(901, "only one", None), (902, "", "none")]
    table = docs(rows)
    alike = quality.assess(table, "doc_id", "text", "lang").collect()
    monkeypatch.setattr(quality, "MODEL_BYTES", 0)
    monkeypatch.setattr(quality, "GROUP_BYTES", 1 << 13)
    monkeypatch.setattr(quality, "TABLE_LANGUAGES", 1)
    parts = quality.assess(table, "doc_id", "text", "lang").collect()
    assert len(parts) == len(rows) and sorted(map(str, parts)) == sorted(map(str, alike))


def test_symbols_keep_letters_and_fold_marks():
    import numpy as np

    told = quality.symbols(np.frombuffer("Ab Éß\tЖ漢7٣,“%€".encode(), np.uint8))
    assert "".join(map(chr, told.tolist())) == "ab éß ж漢00..##"


def test_hashes_are_found_and_missed():
    import numpy as np

    rng = np.random.default_rng(2)
    keys = np.unique(np.concatenate([rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2), np.array([0, 5, 6, 7, 2**64 - 1], np.uint64)]))
    for have in (keys, keys[:1], keys[-1:], keys[:0]):
        found = quality.Sorted(have)
        absent = np.setdiff1d(np.concatenate([keys + np.uint64(1), keys]), have)
        wanted = rng.permutation(np.concatenate([have, have, absent]))
        at, missing = found.find(wanted)
        assert sorted(wanted[missing].tolist()) == absent.tolist()
        there = np.delete(np.arange(len(wanted)), missing)
        assert (have[at[there]] == wanted[there]).all()


@pytest.mark.parametrize("held", [quality.HELD, 300])
def test_a_counting_task_sorts_only_new_ngrams(monkeypatch, held):
    """Counts are those of plain Python, and repeated n-grams are not sorted again (before: every character was)."""
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    rng = random.Random(4)
    rows = ["", "a", *texts(ALPHABETS["latin"][:6], 40, rng), "ж漢\U000f0000" * 30, None]
    plain = Counter(g for t in rows if t for s in ["\n" * (quality.LONGEST - 1) + t] for g in (s[i : i + quality.LONGEST] for i in range(len(t))))
    ordered, sizes = quality._distinct, []
    monkeypatch.setattr(quality, "_distinct", lambda key: sizes.append(len(key)) or ordered(key))
    monkeypatch.setattr(quality, "HELD", held)
    monkeypatch.setattr(quality, "slices", lambda batch, *_: (batch.slice(i, 1) for i in range(batch.num_rows)))
    flat = np.zeros(1024, np.float32).tobytes()
    shared = SimpleNamespace(value=([0], {0: flat}, {0: flat}))
    table = SimpleNamespace(select=lambda *_: SimpleNamespace(mapInArrow=lambda count, _: count))
    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(rows), pa.int32()), pa.array(rows, pa.string())], names=["language", "text"])
    got, given = Counter(), 0
    for part in quality.ngrams(table, shared)(iter([batch])):
        given += part.num_rows
        for gram, n in zip(part.column("gram").to_pylist(), part.column("n").to_pylist(), strict=True):
            got[gram] += n
    assert got == plain
    if held > len(plain):
        assert given == len(plain)
        assert sum(sizes) < sum(plain.values()) / 2
