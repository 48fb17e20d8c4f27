"""License scan by an exact set-similarity join of windows of words with license templates.

A window is a run of consecutive words, over line breaks too, as long as the template divided by
``threshold``; every run is looked at. It matches when it holds at least ``threshold`` of the template's
distinct words, and what tells the template's license from similar ones (``DISTINGUISHING``): a window
ends before an excluded word, and one of each group of required phrases must stand in it.

* words are ordered by how often they occur in all texts, rarest first, counted by Spark;
* a template is indexed under its first ``n - need + 1`` words: a window without any of them misses
  at least ``n - need + 1`` words and cannot match (prefix filter), so only the surroundings of such
  words are looked at;
* what holds fewer of a template's words than needed cannot match; what passes is verified by counting.

The templates are a fixed, small parameter and go to every task; texts are not shuffled.

Defined cases: a null text is an empty one, with no words and no labels; an empty table gives no
rows; repeated rows give a row each; long texts are treated whole, a slice at a time; a threshold
must lie in (0, 1]; columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import LOWER, as_bytes, runs, slices

THRESHOLD = 0.8
WORD = rb"[0-9a-z\x80-\xff]+"
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

# Phrases whose consecutive words name a license, and usual license sentences.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("all-rights-reserved", "All rights reserved."),
]
# By template: groups of phrases of which one must stand in a window, and words that must not.
OTHER_CC = "sa nd sharealike share noderivatives noderivs derivatives derivs"
DISTINGUISHING = {
    "Released under the MIT License.": ([("mit",)], ""),
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": (
        [("associated",), ("software",)], "",
    ),
    "Licensed under the Apache License, Version 2.0": ([("apache",), ("version 2", "license 2", "v2")], ""),
    "Licensed under CC BY-NC 4.0.": ([("by nc",)], OTHER_CC),
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": (
        [("creative commons",), ("attribution noncommercial", "attribution non commercial")], OTHER_CC,
    ),
    "This work is licensed under a Creative Commons Attribution 4.0 International License": (
        [("creative commons",), ("attribution",)], OTHER_CC + " noncommercial non commercial nc",
    ),
    "This work is licensed under the GNU General Public License, version 3.": ([("gnu",), ("version 3", "license 3", "v3")], "lesser library affero"),
    "All rights reserved.": ([("rights reserved", "rights are reserved")], ""),
}


def words_of(text: str) -> list[bytes]:
    return re.findall(WORD, text.encode().translate(bytes(LOWER)))


def word_counts(table: DataFrame, text: str, words: set[bytes]) -> dict[bytes, int]:
    """How often each of a few words occurs in all texts."""
    pattern = re.compile(WORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for part in slices(batch, text):
                for t in part.column(text).to_pylist():
                    found = Counter(pattern.findall((t or "").encode().translate(bytes(LOWER))))
                    for w in words & found.keys():
                        total[w] += found[w]
        yield pa.RecordBatch.from_arrays(
            [pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"]
        )

    counts = table.select(F.col(f"`{text}`")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"].encode(): r["n"] for r in counts.collect()}  # at most one row per template word


class TemplateIndex:
    """Templates by the words of their prefixes."""

    def __init__(
        self,
        templates: Sequence[tuple[str, str]],
        threshold: float,
        counts: Mapping[bytes, int],
        distinguishing: Mapping[str, tuple[Sequence[Sequence[str]], str]] = DISTINGUISHING,
    ):
        if not 0 < threshold <= 1:
            raise ValueError("threshold must lie in (0, 1]")
        sets = [(label, set(words_of(text))) for label, text in templates]
        if any(not s for _, s in sets):
            raise ValueError("a template has no words")
        known = sorted({w for _, s in sets for w in s}, key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(known)}
        self.templates = []  # label, ranks in order, overlap needed
        self.index: dict[int, list[tuple[int, int]]] = {}  # rank of a prefix word -> (template, place)
        for label, s in sets:
            ranks = sorted(self.rank[w] for w in s)
            need = max(1, math.ceil(threshold * len(ranks) - 1e-9))
            for place, r in enumerate(ranks[: len(ranks) - need + 1]):
                self.index.setdefault(r, []).append((len(self.templates), place))
            self.templates.append((label, ranks, need))
        self.sizes = [math.ceil(len(words_of(text)) / threshold - 1e-9) for _, text in templates]  # words of a window
        self.rules = []  # phrases required, one of each group, and words excluded
        for _, text in templates:
            groups, excluded = distinguishing.get(text, ((), ""))
            self.rules.append(([[b" %b " % b" ".join(words_of(p)) for p in g] for g in groups], set(words_of(excluded))))
        self.least = min(need for _, _, need in self.templates)
        triggers = sorted((known[r] for r in self.index), key=len, reverse=True)
        self.trigger = re.compile(rb"(?<![0-9a-z\x80-\xff])(?:" + b"|".join(map(re.escape, triggers)) + rb")(?![0-9a-z\x80-\xff])")

    def match(self, words: Sequence[bytes]) -> list[tuple[int, float]]:
        """(template, share of its words) for each template that a block with these words meets."""
        ranks = sorted({self.rank[w] for w in words if w in self.rank})
        if len(ranks) < self.least:
            return []
        found, seen, own = [], set(), set(ranks)
        for at, r in enumerate(ranks):
            for number, place in self.index.get(r, ()):
                if number in seen:
                    continue
                seen.add(number)  # the first shared prefix word: none before it is shared
                _, theirs, need = self.templates[number]
                if len(ranks) < need or min(len(ranks) - at, len(theirs) - place) < need:
                    continue
                overlap = sum(t in own for t in theirs)
                if overlap >= need:
                    found.append((number, overlap / len(theirs)))
        return sorted(found)

    def windows(self, words: Sequence[bytes]) -> list[tuple[int, int, float]]:
        """(first word, template, share of its words) of the best windows, of a template none overlapping."""
        ranks = [self.rank.get(w, -1) for w in words]
        known, found = set(ranks), []
        for number, (_, theirs, need) in enumerate(self.templates):
            own = set(theirs)
            if len(known & own) < need:
                continue
            size, (groups, excluded) = self.sizes[number], self.rules[number]
            stops = [i for i, w in enumerate(words) if w in excluded]
            fits = []
            for i, r in enumerate(ranks):
                if r not in own:
                    continue
                end = min([i + size, len(words), *(s for s in stops if s >= i)])
                overlap = len(own.intersection(ranks[i:end]))
                if overlap >= need:
                    spelled = b" %b " % b" ".join(words[i:end])
                    if all(any(p in spelled for p in g) for g in groups):
                        fits.append((-overlap, i, end))
            taken: list[tuple[int, int]] = []
            for less, i, end in sorted(fits):
                if all(end <= a or i >= b for a, b in taken):
                    taken.append((i, end))
                    found.append((i, number, -less / len(theirs)))
        return sorted(found)


def scan(
    table: DataFrame,
    key: str,
    text: str,
    templates: Sequence[tuple[str, str]] = tuple(TEMPLATES),
    phrases: Mapping[str, str] = PHRASES,
    threshold: float = THRESHOLD,
    separator: str = "\n",
) -> DataFrame:
    """(key, n_words, places, blocks) of every text.

    ``places``: (label, word) of each place where a phrase's words stand consecutively, word being
    its first word's number. ``blocks``: (block, label, template, containment) of each match, block being
    the number of the line (or whatever ``separator`` divides) in which its window begins.
    """
    templates, border = list(templates), separator.encode()
    counts = word_counts(table, text, {w for _, t in templates for w in words_of(t)})
    index = TemplateIndex(templates, threshold, counts)
    reach = max(index.sizes)
    gap, edge = rb"[^0-9a-z\x80-\xff]+", rb"[0-9a-z\x80-\xff]"
    spelled = [(words_of(p), label) for p, label in phrases.items()]
    places_of = [
        (re.compile(b"(?<!" + edge + b")(?=" + gap.join(map(re.escape, w)) + b"(?!" + edge + b"))"), max(w, key=len), label)
        for w, label in spelled
    ]
    kind = table.schema[key].dataType.simpleString()
    place_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    block_type = pa.list_(pa.struct([("block", pa.int64()), ("label", pa.string()), ("template", pa.int32()), ("containment", pa.float64())]))
    schema = (
        f"`{key}` {kind}, n_words long, places array<struct<label string, word long>>, "
        "blocks array<struct<block long, label string, template int, containment double>>"
    )
    pattern = re.compile(WORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                data, offsets = as_bytes(part.column(text))
                data = np.insert(LOWER[data], offsets[1:], 10)  # texts stand side by side: a border behind each
                offsets = offsets + np.arange(len(offsets))
                starts, stops, doc = runs(IS_WORD[data], offsets)
                first = np.searchsorted(doc, np.arange(len(offsets)))
                whole = data.tobytes()
                places: list[list] = [[] for _ in range(part.num_rows)]
                blocks: list[list] = [[] for _ in range(part.num_rows)]
                hits = np.array([m.start() for m in index.trigger.finditer(whole)], np.int64)
                ends = np.array([m.start() for m in re.finditer(b"|".join(sorted({re.escape(w) for _, w, _ in places_of})), whole)], np.int64)
                for d in np.unique(np.searchsorted(offsets, ends, "right") - 1).tolist():
                    own = whole[offsets[d] : offsets[d + 1]]
                    for phrase, _, label in places_of:
                        for m in phrase.finditer(own):
                            word = int(np.searchsorted(starts, offsets[d] + m.start())) - int(first[d])
                            places[d].append({"label": label, "word": word})
                hit = np.searchsorted(starts, hits)
                low, high = np.maximum(hit - reach + 1, first[doc[hit]]), np.minimum(hit + reach, first[doc[hit] + 1])
                new = np.flatnonzero(np.append(True, low[1:] >= high[:-1])) if len(hit) else hit  # surroundings that do not touch
                for a, b in zip(low[new].tolist(), high[np.append(new[1:], len(hit)) - 1].tolist() if len(hit) else [], strict=True):
                    d = int(doc[a])
                    near = [whole[i:j] for i, j in zip(starts[a:b].tolist(), stops[a:b].tolist(), strict=True)]
                    for at, t, share in index.windows(near):
                        block = whole.count(border, int(offsets[d]), int(starts[a + at]))
                        blocks[d].append({"block": block, "label": index.templates[t][0], "template": t, "containment": share})
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), pa.array(np.diff(first), pa.int64()), pa.array(places, place_type), pa.array(blocks, block_type)],
                    names=[key, "n_words", "places", "blocks"],
                )

    return table.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, schema)


def document_labels(scanned: DataFrame, key: str) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) from ``scan``.

    The score is the greatest share of a template found in a window, 1 where a phrase stands."""
    base, found = F.col("places.label"), F.col("blocks.label")
    return scanned.select(
        F.col(f"`{key}`"),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, found)), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("blocks.containment"), F.lit(0.0))).alias("score"),
    )
