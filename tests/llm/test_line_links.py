"""Lines are compared only where their bytes allow a link, and none is lost."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from studylens.llm import linededup


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def components(n, links):
    of = list(range(n))
    for a, b in links:
        of = [min(of[a], of[b]) if x in (of[a], of[b]) else x for x in of]
    return of


@pytest.mark.parametrize("sparse", [16, 0])  # with 0, clusters go in rounds
@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_links_equal_brute_force(monkeypatch, sparse, edits):
    monkeypatch.setattr(linededup, "SPARSE", sparse)
    rng = random.Random(10 * edits + sparse)
    groups = [[b"one line"], []]
    for letters, longest in ((b"ab", 7), (b"abcdefgh \xc3\xa9#", 20), (b"abAB!1Qq", 330)):
        group = [b"x" * 300, b"x" * 299 + b"y"]
        for _ in range(12):
            base = bytes(rng.choice(letters) for _ in range(rng.randrange(1, longest)))
            for _ in range(3):
                copy = bytearray(base)
                for _ in range(rng.randrange(4)):
                    at = rng.randrange(len(copy) + 1)
                    copy[at : at + rng.randrange(2)] = bytes(rng.choice(letters) for _ in range(rng.randrange(2)))
                group.append(bytes(copy))
        groups.append(group)
    groups.append([b"a" * rng.randrange(1, 40) for _ in range(120)])  # many links
    lines = [(g, t) for g, group in enumerate(groups) for t in group]
    near = [(a, b) for a in range(len(lines)) for b in range(a) if lines[a][0] == lines[b][0] and edit_distance(lines[a][1], lines[b][1]) <= edits]
    found = linededup.connected(groups, edits)
    assert {tuple(sorted(x, reverse=True)) for x in found} <= set(near)
    assert components(len(lines), found) == components(len(lines), near)


def test_unlike_lines_need_no_distance(monkeypatch):
    rng, asked = random.Random(3), []
    distances = linededup._distances

    def counted(packed, pattern, text, edits):
        asked.append(len(pattern))
        return distances(packed, pattern, text, edits)

    monkeypatch.setattr(linededup, "_distances", counted)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(300)]
    found = linededup.connected([[w.encode() for w in words] + [words[5][:-1].encode() + b"."]], 2)
    assert found == [(5, 300)] or found == [(300, 5)]
    assert len(asked) < 10 and sum(asked) < 100


def test_wanted_lines_are_looked_up_without_sorting_them_all():
    rng = np.random.default_rng(4)
    wanted = np.sort(rng.integers(-(2**62), 2**62, 2_000_000))
    own = np.concatenate([rng.integers(-(2**62), 2**62, 50), wanted[::50_000], wanted[-1:]])
    began = time.process_time()
    for _ in range(50):  # as many slices of text
        found = linededup.among(own, wanted)
    assert time.process_time() - began < 2  # 50 sorts of the wanted lines take far more
    assert found.tolist() == np.isin(own, wanted).tolist()
    assert linededup.among(own, wanted[:0]).tolist() == [False] * len(own)
    assert linededup.among(own[:0], wanted).tolist() == []


def test_blank_lines_do_not_count():
    texts = ["", "\n\n", None, " \t\r\x0b\x0c\n x\n\n", "no break", "", "a\n \nb ", "\x1f\n\xa0\n ", "  \n", "\n", " ", "z"]
    part = pa.RecordBatch.from_arrays([pa.array(texts * 2, pa.string())], names=["text"])
    for cut in (part, part.slice(0, 1), part.slice(2, 9), part.slice(0, 0)):
        for least in (1, 2):
            _, starts, ends, doc, number, own = linededup._long_lines(cut, least)
            found = list(zip(doc.tolist(), number.tolist(), (ends - starts).tolist(), strict=True))
            every = [(d, i, x.encode()) for d, t in enumerate(cut.column("text").to_pylist()) for i, x in enumerate((t or "").split("\n"))]
            counted = [(d, i, x) for d, i, x in every if len(x) >= least and x.strip(b" \t\r\x0b\x0c")]
            assert found == [(d, i, len(x)) for d, i, x in counted]
            assert len(set(own.tolist())) == len({x for _, _, x in counted})
