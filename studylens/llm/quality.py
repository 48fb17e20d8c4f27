"""Quality rules: n-gram perplexity bands per language, beside plain text statistics.

1. Labels of languages can be wrong and texts mixed, so each stretch of 64 characters counts as the language that fits it
   best, out of its label and the ``GUESSED`` languages with the most text. Fit is judged by pairs of characters folded
   to 32 symbols (a small modified Kneser-Ney model a language) and, for letters that have no symbol, by their own frequency.
2. N-grams of ``LONGEST`` characters are counted per language by Spark. Every letter of every script stays itself (lower
   case); digits, blanks, punctuation and other signs are one symbol each. The modified Kneser-Ney model (interpolated, discounts from
   the counts of counts) comes from aggregations and joins over all orders; its size follows the corpus.
3. The model is kept as arrays of 64-bit hashes in order, with a log-probability each, and searched from where the leading bits
   of a hash begin. A counting task holds its n-grams likewise, so only those that it meets for the first time are sorted. Up to
   ``MODEL_BYTES`` it is broadcast. A larger one stays on the cluster: texts are dealt into groups of bounded size, each
   group's distinct n-grams fetch their probabilities by a join, and the group's own arrays are searched.

The n-grams are those of the texts that are scored, so each is found. The document's
perplexity is judged by the language of most of its characters: the bands are the median of the log-perplexity
over all documents of the language plus and minus ``width`` robust deviations (median absolute
deviation, but at least ``FLOOR``), the spread widened for short texts. Above or below: rejected.

Defined cases: a null text is an empty one (no words, no perplexity, rejected by the base rules); a
null language is a language of its own; repeated rows are judged each; an empty table gives no rows;
a single long text needs memory in proportion to its length; other columns are not looked at by
``assess`` and are kept as they are by ``keep_good``.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.materialize import materialize
from .textbytes import SPACE, as_bytes, count_in, lines, mix, prefix_hash, release, runs, slices, span_hash

ORDER, BITS = 4, 5
SYMBOLS = 1 << BITS
LANGUAGES = 1 << 16  # languages are told apart by a hash of so many values
TABLE_LANGUAGES = 1 << 13  # languages whose tables (8 KB each) are broadcast at once
LETTERS = 1 << 10  # classes of letters without a folded symbol
LONGEST = 5  # characters of the n-grams that are scored
HELD = 1 << 19  # distinct n-grams that a counting task holds
SLICE_BYTES = 1 << 19  # text that is looked at in one go, so that arrays over its characters stay in the cache
MODEL_BYTES = 32 << 20  # largest model that is broadcast, 12 bytes an n-gram
GROUP_BYTES = 16 << 20  # text of a group that searches its own part of a larger model
STRETCH = 64  # characters that are taken to be of one language
GUESSED = 16  # languages compared with the labelled one
WIDTH = 3.5  # robust deviations on either side
FLOOR = 0.02  # least deviation, nats a character
STEP = 0.001  # log-perplexities are rounded to this
SHORT = 400.0  # characters at which the deviation is doubled in variance
MIN_WORDS, MAX_REPEATED = 50, 50  # base rules: words, per cent of words in repeated windows

_MARKS = np.zeros(256, bool)
_MARKS[list(b"#*$%&|<>")] = True
_BLANK, _DIGIT, _POINT, _SIGN, _OTHER, _START = 0, 27, 28, 29, 30, 31


def _fold_table() -> tuple[np.ndarray, np.ndarray]:
    """Symbol of each leading byte, and of the byte behind 0xC3 (accented Latin letters)."""
    import unicodedata

    first = np.full(256, _OTHER, np.uint8)
    first[:128] = _SIGN
    first[SPACE] = _BLANK
    first[list(b".,;:!?'\"()-")] = _POINT
    first[list(b"0123456789")] = _DIGIT
    accented = np.full(256, _OTHER, np.uint8)
    for i in range(26):
        first[[65 + i, 97 + i]] = i + 1
    for code in range(0xC0, 0x100):
        base = unicodedata.normalize("NFD", chr(code))[0].lower()
        base = {"ß": "s", "æ": "a", "ø": "o"}.get(base, base)
        if "a" <= base <= "z":
            accented[code - 0x40] = ord(base) - 96
    return first, accented


_FIRST, _ACCENTED = _fold_table()


def grams(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The packed n-gram that ends at each character, and the character's document."""
    lead = (data & 0xC0) != 0x80
    symbols = _FIRST[data]
    accent = np.flatnonzero(data[:-1] == 0xC3)
    symbols[accent] = _ACCENTED[data[accent + 1]]
    chars = count_in(lead, offsets)
    doc = np.repeat(np.arange(len(chars)), chars)
    symbols = symbols[lead].astype(np.uint32)
    early, place = _early(chars, order - 1)
    key, first = symbols.copy(), symbols[early]
    for back in range(1, order):
        key[back:] |= symbols[: max(len(symbols) - back, 0)] << np.uint32(BITS * back)
        first |= np.where(place < back, np.uint32(_START), symbols[np.maximum(early - back, 0)]) << np.uint32(BITS * back)
    key[early] = first
    return key, doc


def _early(chars: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the first ``n`` characters of texts of so many characters are, and their places in the text."""
    some = np.minimum(chars, n)
    place = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
    return np.repeat(np.cumsum(chars) - chars, some) + place, place


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Discount of a count of 0, 1, 2 and 3 or more."""
    n1, n2, n3, n4 = (int((counts == i).sum()) for i in range(1, 5))
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    d = [i - (i + 1) * y * (b / a) if a else y for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([0.0, *(min(max(x, 0.1), i) for i, x in enumerate(d, 1))])


class Model:
    """A modified Kneser-Ney model in sorted arrays, by order: n-grams, histories, their logarithms."""

    def __init__(self, keys: list[np.ndarray], logs: list[np.ndarray], histories: list[np.ndarray], weights: list[np.ndarray]):
        self.keys, self.logs, self.histories, self.weights = keys, logs, histories, weights

    @classmethod
    def build(cls, key: np.ndarray, count: np.ndarray) -> Model:
        """From the distinct n-grams of the highest order and how often each occurs."""
        order = np.argsort(key)
        tables = [(key[order].astype(np.uint32), count[order].astype(np.int64))]
        for k in range(ORDER - 1, 0, -1):  # lower orders count the symbols seen before them
            tables.append(tuple(np.unique(tables[-1][0] & np.uint32((1 << (BITS * k)) - 1), return_counts=True)))
        keys, logs, histories, weights = [], [], [], []
        lower = None
        for grams_, counts in reversed(tables):
            d = _discounts(counts)[np.minimum(counts, 3)]
            history, which = np.unique(grams_ >> np.uint32(BITS), return_inverse=True)
            total = np.bincount(which, weights=counts)
            weight = np.bincount(which, weights=d) / total
            below = np.full(len(grams_), 1 / SYMBOLS) if lower is None else lower[1][np.searchsorted(lower[0], grams_ & np.uint32((1 << (BITS * len(keys))) - 1))]
            p = (counts - d) / total[which] + weight[which] * below
            lower = (grams_, p)
            keys.append(grams_)
            logs.append(np.log(p).astype(np.float32))
            histories.append(history)
            weights.append(np.log(weight).astype(np.float32))
        return cls(keys, logs, histories, weights)

    def log_probabilities(self, key: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Natural logarithm of the probability of each n-gram's last symbol after the others."""
        if order == 0:
            return np.full(len(key), -np.log(SYMBOLS), np.float32)
        key = key & np.uint32((1 << (BITS * order)) - 1)
        keys, logs = self.keys[order - 1], self.logs[order - 1]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        out = logs[at]
        missing = np.flatnonzero(keys[at] != key)
        if len(missing):
            history = key[missing] >> np.uint32(BITS)
            seen = self.histories[order - 1]
            at = np.minimum(np.searchsorted(seen, history), len(seen) - 1)
            weight = np.where(seen[at] == history, self.weights[order - 1][at], np.float32(0))
            out[missing] = weight + self.log_probabilities(key[missing], order - 1)
        return out

    def pairs(self) -> np.ndarray:
        """Logarithm of the probability of every pair of symbols."""
        return self.log_probabilities(np.arange(SYMBOLS**2, dtype=np.uint32), 2)

    def dump(self) -> bytes:
        file = io.BytesIO()
        np.savez(file, *self.keys, *self.logs, *self.histories, *self.weights)
        return file.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Model:
        with np.load(io.BytesIO(raw)) as file:
            arrays = [file[f"arr_{i}"] for i in range(4 * ORDER)]
        return cls(*(arrays[i : i + ORDER] for i in range(0, 4 * ORDER, ORDER)))


def _language(lang: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(lang.cast("string"), F.lit("\u0000null"))), F.lit(LANGUAGES)).cast("int")


def _symbol_table() -> np.ndarray:
    """Symbol of each character below 0x32400: letters and marks of all scripts as they are, the rest by kind."""
    import unicodedata

    table = np.arange(0x32400, dtype=np.uint32)
    for code in range(len(table)):
        char = chr(code)
        kind = unicodedata.category(char)
        if kind[0] in "LM":
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
        elif kind != "Cn":
            point = char in ".,;:!?'\"()-" if code < 128 else kind[0] == "P"
            table[code] = ord("0" if kind[0] == "N" else " " if kind[0] == "Z" or char.isspace() else "." if point else "#")
    return table


_table = np.zeros(0, np.uint32)
_mixed = np.zeros(0, np.uint64)  # hashes of the symbols of _table
_BEFORE = ord("\n")  # stands before a text; blanks are " "
_FACTORS = mix(np.arange(1, LONGEST + 2, dtype=np.uint64)) | np.uint64(1)


def symbols(data: np.ndarray) -> np.ndarray:
    """The symbol of each character, itself a character."""
    global _table
    if not len(_table):
        _table = _symbol_table()
    codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    return np.where(codes < len(_table), _table[np.minimum(codes, len(_table) - 1)], codes)


def _hashed(spelled: np.ndarray, language: np.ndarray) -> np.ndarray:
    """Hashes of n-grams, given as rows of symbols, in their languages."""
    key = (mix(spelled.astype(np.uint64) + np.uint64(1)) * _FACTORS[:LONGEST]).sum(axis=1, dtype=np.uint64)
    return mix(key + (language.astype(np.uint64) + np.uint64(1)) * _FACTORS[LONGEST])


def _keys(own: np.ndarray, chars: np.ndarray, language: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The hash of the n-gram that ends at each character of texts of ``chars`` characters; ``language`` is a place in ``known``."""
    global _mixed
    if not len(_mixed):
        _mixed = mix(np.arange(1, len(_table) + 1, dtype=np.uint64))
    before = mix(np.array([_BEFORE + 1], np.uint64))
    mixed = np.concatenate([np.repeat(before, LONGEST - 1), _mixed[np.minimum(own, len(_mixed) - 1)]])
    rare = np.flatnonzero(own >= len(_mixed))
    mixed[rare + LONGEST - 1] = mix(own[rare].astype(np.uint64) + np.uint64(1))
    early, place = _early(chars, LONGEST - 1)
    key = ((known.astype(np.uint64) + np.uint64(1)) * _FACTORS[LONGEST])[language]
    for back in range(LONGEST):
        factor = _FACTORS[LONGEST - 1 - back]
        shifted = mixed[LONGEST - 1 - back :][: len(own)] * factor
        shifted[early[place < back]] = before * factor
        key += shifted
    return mix(key)


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the keys, and where in it each distinct one begins."""
    order = np.argsort(key)
    key = key[order]
    return order, np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else order


def _spelled(own: np.ndarray, chars: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The symbols of the n-grams that end at some characters, a row each."""
    back = np.arange(LONGEST - 1, -1, -1)
    first = np.cumsum(chars) - chars
    place = at - first[np.searchsorted(first, at, "right") - 1]
    return np.where(place[:, None] >= back, own[np.maximum(at[:, None] - back, 0)], np.uint32(_BEFORE))


class Sorted:
    """Distinct hashes in order; they are spread evenly, so where those with the same leading bits begin is where each is."""

    def __init__(self, keys: np.ndarray):
        bits = len(keys).bit_length() + 1
        self.keys, self.shift = keys, np.uint64(64 - bits)
        self.heads = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount((keys >> self.shift).view(np.int64), minlength=1 << bits), out=self.heads[1:])

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each wanted hash (any, if it is not there), and which are not there."""
        if not len(self.keys):
            return np.zeros(len(wanted), np.int32), np.arange(len(wanted))
        last = np.int32(len(self.keys) - 1)
        at = np.minimum(self.heads[(wanted >> self.shift).view(np.int64)], last)
        open_ = np.flatnonzero(self.keys[at] != wanted)
        sought, here, gone = wanted[open_], at[open_], []
        while len(open_):
            here = here + np.int32(1)
            met = self.keys[np.minimum(here, last)]
            beyond = (here > last) | (met > sought)
            gone.append(open_[beyond])
            hit = (met == sought) & ~beyond
            at[open_[hit]] = here[hit]
            on = ~(beyond | hit)
            open_, sought, here = open_[on], sought[on], here[on]
        return at, np.concatenate(gone) if gone else open_


def _letters(own: np.ndarray, folded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where characters without a folded symbol are, and the class of each."""
    at = np.flatnonzero(folded & np.uint32(SYMBOLS - 1) == _OTHER)
    return at, (mix(own[at].astype(np.uint64)) >> np.uint64(54)).astype(np.int64)


def train(table: DataFrame, text: str, lang: str) -> DataFrame:
    """(language, pairs, letters, chars): tables to tell languages by, one row each, written down; counts cover all rows."""
    size = SYMBOLS**ORDER + LETTERS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            # Rows of one language side by side, so that most slices have but one.
            batch = batch.take(pa.array(np.argsort(batch.column("language").to_numpy(zero_copy_only=False), kind="stable")))
            for part in slices(batch, "text"):
                data, offsets = as_bytes(part.column("text"))
                key, doc = grams(data, offsets)
                at, letter = _letters(symbols(data), key)
                language = part.column("language").to_numpy(zero_copy_only=False)[doc]
                for own in np.unique(language).tolist():
                    if own not in totals:
                        if len(totals) == 16:  # memory stays bounded with many languages
                            yield from rows(totals)
                            totals.clear()
                        totals[own] = np.zeros(size, np.int64)
                    totals[own] += np.bincount(key[language == own], minlength=size)
                    totals[own] += np.bincount(letter[language[at] == own] + SYMBOLS**ORDER, minlength=size)
        yield from rows(totals)

    def rows(totals: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for own, counts in totals.items():
            seen = np.flatnonzero(counts)
            columns = [pa.array(np.full(len(seen), own, np.int32)), pa.array(seen.astype(np.int32)), pa.array(counts[seen])]
            yield pa.RecordBatch.from_arrays(columns, names=["language", "gram", "n"])

    def build(group: pd.DataFrame) -> pd.DataFrame:
        gram, n = group["gram"].to_numpy(), group["n"].to_numpy()
        folded = gram < SYMBOLS**ORDER
        pairs = Model.build(gram[folded], n[folded]).pairs().astype(np.float32)
        letters = np.bincount(gram[~folded] - SYMBOLS**ORDER, weights=n[~folded], minlength=LETTERS) + 1
        letters = np.log(letters / letters.sum()).astype(np.float32)
        return pd.DataFrame({"language": group["language"].iloc[:1], "pairs": [pairs.tobytes()], "letters": [letters.tobytes()], "chars": [n[folded].sum()]})

    texts = table.select(F.col(f"`{text}`").alias("text"), _language(F.col(f"`{lang}`")).alias("language"))
    counts = texts.mapInArrow(count, "language int, gram int, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    # A language has at most SYMBOLS ** ORDER + LETTERS rows here, so its group is bounded.
    return materialize(counts.groupBy("language").applyInPandas(build, "language int, pairs binary, letters binary, chars long"), "languages")


class Guess:
    """Tables of some languages; tells which fits a stretch best."""

    def __init__(self, frequent: list[int], pairs: dict[int, bytes], letters: dict[int, bytes]):
        self.frequent = frequent
        self.pairs = {k: np.frombuffer(v, np.float32).astype(float) for k, v in pairs.items()}
        self.letters = {k: np.frombuffer(v, np.float32).astype(float) for k, v in letters.items()}

    def languages(self, data: np.ndarray, offsets: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, ...]:
        """Symbol, document and language (a place in the last array) of every character; characters of each text; languages."""
        key, doc = grams(data, offsets, 2)
        own = symbols(data)
        at, letter = _letters(own, key)
        chars = np.bincount(doc, minlength=len(offsets) - 1)
        stretches = -(-chars // STRETCH)
        number = np.arange(stretches.sum()) - np.repeat(np.cumsum(stretches) - stretches, stretches)
        starts = np.repeat(np.cumsum(chars) - chars, stretches) + number * STRETCH
        if not len(starts):
            return own, doc, np.zeros(0, np.int64), chars, np.zeros(0, np.int32)
        lengths = np.diff(np.append(starts, len(key)))
        part_doc, part_at = doc[starts], np.searchsorted(starts, at, "right") - 1

        def fit(language: int) -> np.ndarray:
            found = np.add.reduceat(self.pairs[language][key], starts)
            return found + np.bincount(part_at, weights=self.letters[language][letter], minlength=len(starts)) if len(at) else found

        known = list(self.frequent)
        fits = [fit(k) for k in known]
        for other in sorted(set(np.unique(labels).tolist()) - set(known)):
            if other in self.pairs:  # a label without any characters has no table, and no stretch
                fits.append(np.where(labels[part_doc] == other, fit(other), -np.inf))
                known.append(other)
        return own, doc, np.repeat(np.argmax(fits, axis=0), lengths), chars, np.array(known, np.int32)


def _spread(texts: DataFrame, tables: DataFrame) -> list[tuple[DataFrame, object]]:
    """(rows, broadcast arguments of ``Guess``): texts by batches of languages."""
    # At most LANGUAGES rows of two numbers.
    ordered = [r["language"] for r in tables.select("language", "chars").orderBy(F.desc("chars"), "language").collect()]
    frequent, context = ordered[:GUESSED], texts.sparkSession.sparkContext
    out = []
    for first in range(0, max(len(ordered), 1), TABLE_LANGUAGES):
        batch = ordered[first : first + TABLE_LANGUAGES]
        alone = len(ordered) <= TABLE_LANGUAGES
        some = tables if alone else tables.filter(F.col("language").isin([*batch, *frequent]))
        rows = some.select("language", "pairs", "letters").collect()
        shared = context.broadcast((frequent, {r[0]: bytes(r[1]) for r in rows}, {r[0]: bytes(r[2]) for r in rows}))
        # A language without any characters has no table; its rows go with the first batch.
        own = texts if alone else texts.filter(F.col("language").isin(batch) if first else ~F.col("language").isin(ordered[TABLE_LANGUAGES:]))
        out.append((own, shared))
    return out


def ngrams(texts: DataFrame, shared: object) -> DataFrame:
    """(language, gram, n): n-grams of texts(language, text), several rows each."""

    # Keys in order, symbols, languages, counts.
    nothing = (np.zeros(0, np.uint64), np.zeros((0, LONGEST), np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guess = Guess(*shared.value)
        held, held_keys, new = nothing, Sorted(nothing[0]), []  # new: of slices, those that are not held yet
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                data, offsets = as_bytes(part.column("text"))
                own, _, language, chars, known = guess.languages(data, offsets, part.column("language").to_numpy(zero_copy_only=False))
                key = _keys(own, chars, language, known)
                at, other = held_keys.find(key)
                held[3][:] += np.bincount(np.delete(at, other), minlength=len(held[3]))
                order, heads = _distinct(key[other])
                at = other[order[heads]]
                new.append((key[at], _spelled(own, chars, at), known[language[at]], np.diff(np.append(heads, len(other)))))
                if sum(len(c[0]) for c in new) > len(held[0]) // 4:
                    held = merged(held, new)
                    if len(held[0]) > HELD:
                        yield rows(*held)
                        held = nothing
                    held_keys, new = Sorted(held[0]), []
        if new:
            held = merged(held, new)
        if len(held[0]):
            yield rows(*held)
        release()

    def merged(held: tuple[np.ndarray, ...], new: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        # A key of new may be in several slices, but not among those held.
        key, spelled, language, n = (np.concatenate(c) for c in zip(*new, strict=True))
        order, heads = _distinct(key)
        if not len(heads):
            return held
        at = order[heads]
        between = np.searchsorted(held[0], key[at])
        more = (key[at], spelled[at], language[at], np.add.reduceat(n[order], heads))
        return tuple(np.insert(a, between, b, axis=0) for a, b in zip(held, more, strict=True))

    def rows(_: np.ndarray, spelled: np.ndarray, language: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        # Rows of UTF-32 in a row are strings of LONGEST characters each.
        gram = np.ascontiguousarray(spelled).view(f"<U{LONGEST}").ravel()
        return pa.RecordBatch.from_arrays([pa.array(language, pa.int32()), pa.array(gram.tolist(), pa.string()), pa.array(n)], names=["language", "gram", "n"])

    return texts.select("language", "text").mapInArrow(count, "language int, gram string, n long")


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(language, gram, log): modified Kneser-Ney log-probability of the last symbol of every n-gram after the others.

    ``counts`` has (language, gram, n) of distinct n-grams of ``LONGEST`` symbols."""
    levels = [counts.withColumn("size", F.lit(LONGEST))]
    for size in range(LONGEST - 1, 0, -1):  # lower orders count the symbols seen before them
        shorter = levels[-1].groupBy("language", F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        levels.append(materialize(shorter.withColumn("size", F.lit(size)), "ngrams-shorter"))
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    ones = [F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in range(1, 5)]
    y = F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")), F.lit(0.5))
    cuts = []
    for i in (1, 2, 3):
        exact = F.when(F.col(f"n{i}") > 0, i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")).otherwise(y)
        cuts.append(F.least(F.greatest(exact, F.lit(0.1)), F.lit(float(i))).alias(f"d{i}"))
    # A row for each language and order.
    discounts = every.groupBy("language", "size").agg(*ones, F.count(F.lit(1)).alias("kinds")).select("language", "size", "kinds", *cuts)
    discounts = F.broadcast(materialize(discounts, "ngram-discounts"))
    away = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    every = every.join(discounts, ["language", "size"]).withColumn("away", away).withColumn("history", F.expr("substring(gram, 1, size - 1)"))
    totals = every.groupBy("language", "size", "history").agg(F.sum("n").alias("total"), F.sum("away").alias("taken"))
    every = every.join(totals, ["language", "size", "history"])
    own, back = (F.col("n") - F.col("away")) / F.col("total"), F.col("taken") / F.col("total")
    # The lowest order falls back to all symbols of the language and one that it never saw.
    own = F.when(F.col("size") == 1, own + back / (F.col("kinds") + 1)).otherwise(own)
    every = materialize(every.select("language", "size", "gram", own.alias("p"), back.alias("back")), "ngram-orders")
    found = every.filter("size = 1").select("language", "gram", "p")
    for size in range(2, LONGEST + 1):
        lower = found.select("language", F.col("gram").alias("_lower"), F.col("p").alias("_p"))
        level = every.filter(F.col("size") == size).withColumn("_lower", F.expr("substring(gram, 2)"))
        found = level.join(lower, ["language", "_lower"]).select("language", "gram", (F.col("p") + F.col("back") * F.col("_p")).alias("p"))
    return found.select("language", "gram", F.log("p").cast("float").alias("log"))


def model(parts: list[tuple[DataFrame, object]]) -> DataFrame:
    """(key, log): the hash of every n-gram and its log-probability, written down."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram = batch.column("gram").to_pylist()
            spelled = np.frombuffer("".join(gram).encode("utf-32-le"), np.uint32).reshape(-1, LONGEST)
            key = _hashed(spelled, batch.column("language").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("log")], names=["key", "log"])

    counted = None
    for texts, shared in parts:
        some = ngrams(texts, shared)
        counted = some if counted is None else counted.unionByName(some)
    counted = materialize(counted.groupBy("language", "gram").agg(F.sum("n").alias("n")), "ngrams")
    return materialize(kneser_ney(counted).mapInArrow(hashed, "key long, log float"), "ngram-model")


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Plain figures of each text: words, their characters, marks, repeated lines and windows."""
    n = len(offsets) - 1
    ink = ~SPACE[data]
    starts, ends, doc = runs(ink, offsets)
    sums = prefix_hash(data)
    first, last, of = lines(data, offsets)
    has_word = np.concatenate([[0], np.cumsum(ink)])
    keep = has_word[last] > has_word[first]
    of = of[keep]
    line = span_hash(sums, first[keep], last[keep]) + mix(of.astype(np.uint64) + np.uint64(1))
    _, single = np.unique(line, return_index=True)
    word = span_hash(sums, starts, ends)
    covered = np.zeros(len(word), bool)
    if len(word) > 2:
        same = doc[2:] == doc[:-2]
        key = mix(mix(mix(word[:-2]) + word[1:-1]) + word[2:]) + mix(doc[2:].astype(np.uint64) + np.uint64(1))
        at = np.flatnonzero(same)
        order = at[np.argsort(key[at])]
        again = key[order][1:] == key[order][:-1]
        twice = np.concatenate([order[1:][again], order[:-1][again]])
        for shift in range(3):
            covered[twice + shift] = True
    count = lambda d, size=n: np.bincount(d, minlength=size)
    return {
        "n_words": count(doc),
        "word_chars": count_in(ink & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": count_in(_MARKS[data], offsets),
        "n_dup_lines": count(of) - count(of[single]),
        "n_repeat_words": count(doc[covered]),
    }


def _perplexities(
    data: np.ndarray, offsets: np.ndarray, labels: np.ndarray, guess: Guess, keys: Sorted, logs: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean negative log-probability a character (NaN without any), rounded; characters; language."""
    n = len(offsets) - 1
    if not len(data):
        return np.full(n, np.nan), np.zeros(n, np.int64), labels.astype(np.int32)
    own, doc, language, chars, known = guess.languages(data, offsets, labels)
    at, missing = keys.find(_keys(own, chars, language, known))
    if len(missing):
        raise RuntimeError("an n-gram of the text is not in the model")
    total = np.bincount(doc, weights=logs[at], minlength=n)
    main = np.bincount(doc * len(known) + language, minlength=n * len(known)).reshape(n, len(known))
    language = np.where(chars > 0, known[np.argmax(main, axis=1)], labels)
    with np.errstate(invalid="ignore"):
        mean = -total / chars
    return np.round(mean / STEP) * STEP, chars, language.astype(np.int32)


_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double, chars long"


def _figures(whole: pa.RecordBatch, guess: Guess, keys: Sorted, logs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows without their text and label, but with statistics and perplexity."""
    for part in slices(whole, "text", SLICE_BYTES):
        data, offsets = as_bytes(part.column("text"))
        language = part.column("language").to_numpy(zero_copy_only=False)
        mean, chars, language = _perplexities(data, offsets, language, guess, keys, logs)
        found = statistics(data, offsets)
        kept = [i for i, c in enumerate(part.schema.names) if c not in ("text", "language", "group")]
        arrays = [part.column(i) for i in kept] + [pa.array(language)] + [pa.array(v.astype(np.int64)) for v in found.values()]
        arrays += [pa.array(mean, mask=np.isnan(mean)), pa.array(chars.astype(np.int64))]
        yield pa.RecordBatch.from_arrays(arrays, names=[part.schema.names[i] for i in kept] + ["language", *found, "log_perplexity", "chars"])


def _sorted(keys: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(keys.view(np.uint64), return_index=True)
    return keys, logs[at]


def _scored(texts: DataFrame, columns: str, tables: DataFrame) -> list[DataFrame]:
    """``columns`` of texts(language, text, ...) with figures; one table per batch of languages."""
    parts = _spread(texts, tables)
    probabilities = model(parts)
    if 12 * probabilities.count() > MODEL_BYTES:
        return [_scored_in_groups(own, columns, shared, probabilities) for own, shared in parts]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [batch.column(c).to_numpy(zero_copy_only=False).tobytes() for c in ("key", "log")]
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.binary()) for r in raw], names=["key", "log"])

    rows = probabilities.mapInArrow(pack, "key binary, log binary").collect()
    raw = [b"".join(bytes(r[c]) for r in rows) for c in ("key", "log")]
    both = texts.sparkSession.sparkContext.broadcast([a.tobytes() for a in _sorted(np.frombuffer(raw[0], np.int64), np.frombuffer(raw[1], np.float32))])

    def scoring(shared: object) -> object:
        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            guess, keys, logs = Guess(*shared.value), Sorted(np.frombuffer(both.value[0], np.uint64)), np.frombuffer(both.value[1], np.float32)
            for batch in batches:
                yield from _figures(batch, guess, keys, logs)
            release()

        return score

    return [own.mapInArrow(scoring(shared), f"{columns}, {_SCHEMA}") for own, shared in parts]


def _scored_in_groups(texts: DataFrame, columns: str, shared: object, probabilities: DataFrame) -> DataFrame:
    """The same with a model of any size: each group of texts fetches the n-grams that it has."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // GROUP_BYTES))
    dealt = texts.withColumn("group", F.pmod(F.xxhash64(*[c for c in texts.columns if c not in ("text", "language")], "text"), F.lit(groups)))

    def distinct(table: pa.Table) -> pa.Table:
        guess, found = Guess(*shared.value), np.zeros(0, np.uint64)
        for batch in table.combine_chunks().to_batches():
            for part in slices(batch, "text"):
                own, _, language, chars, known = guess.languages(*as_bytes(part.column("text")), part.column("language").to_numpy(zero_copy_only=False))
                found = np.union1d(found, _keys(own, chars, language, known))
        number = np.full(len(found), table.column("group")[0].as_py(), np.int64)
        return pa.table({"group": number, "key": found.view(np.int64)})

    def score(table: pa.Table, model: pa.Table) -> pa.Table:
        guess = Guess(*shared.value)
        keys, logs = _sorted(model.column("key").to_numpy(), model.column("log").to_numpy())
        known = Sorted(keys)
        out = [r for batch in table.combine_chunks().to_batches() for r in _figures(batch, guess, known, logs)]
        return pa.Table.from_batches(out)

    asked = dealt.select("group", "language", "text").groupBy("group").applyInArrow(distinct, "group long, key long")
    answers = asked.join(probabilities, "key").select("group", "key", "log")
    return dealt.groupBy("group").cogroup(answers.groupBy("group")).applyInArrow(score, f"{columns}, {_SCHEMA}")


def bands(scored: DataFrame) -> DataFrame:
    """(language, middle, spread): median and robust deviation over all documents, exact.

    The values are rounded, so the aggregation holds few distinct ones.
    """
    known = scored.filter(F.col("log_perplexity").isNotNull())
    middle = known.groupBy("language").agg(F.percentile("log_perplexity", F.lit(0.5)).alias("middle"))
    middle = F.broadcast(materialize(middle, "band-middles"))  # at most LANGUAGES rows
    away = known.join(middle, "language").withColumn("away", F.round(F.abs(F.col("log_perplexity") - F.col("middle")), 4))
    spread = away.groupBy("language").agg(F.first("middle").alias("middle"), F.percentile("away", F.lit(0.5)).alias("away"))
    return spread.select("language", "middle", F.greatest(F.lit(FLOOR), 1.4826 * F.col("away")).alias("spread"))


def verdict(width: float = WIDTH) -> tuple[Column, Column]:
    """(base_failed, kept) of rows with figures and their language's band."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    allowed = width * F.col("spread") * F.sqrt(1 + F.lit(SHORT) / F.greatest(F.col("chars"), F.lit(1)))
    inside = F.abs(F.col("log_perplexity") - F.col("middle")) <= allowed
    return failed, ~failed & F.coalesce(inside, F.lit(False))


def _judged(table: DataFrame, text: str, lang: str, columns: list[Column], schema: str, width: float) -> DataFrame:
    tables = train(table, text, lang)
    texts = table.select(*columns, _language(F.col(f"`{lang}`")).alias("language"), F.col(f"`{text}`").alias("text"))
    parts = _scored(texts, f"{schema}, language int", tables)
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    scored = materialize(scored, "scored-documents")
    failed, kept = verdict(width)
    judged = scored.join(F.broadcast(materialize(bands(scored), "bands")), "language", "left")  # at most LANGUAGES rows
    return judged.withColumn("base_failed", failed).withColumn("kept", kept)


def assess(table: DataFrame, key: str, text: str, lang: str, width: float = WIDTH) -> DataFrame:
    """(key, five figures, base_failed, kept, log_perplexity, band_low, band_high) of every row."""
    kind = table.schema[key].dataType.simpleString()
    judged = _judged(table, text, lang, [F.col(f"`{key}`").alias("doc")], f"doc {kind}", width)
    reach = width * F.col("spread") * F.sqrt(1 + F.lit(SHORT) / F.greatest(F.col("chars"), F.lit(1)))
    return judged.select(
        F.col("doc").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "log_perplexity", (F.col("middle") - reach).alias("band_low"), (F.col("middle") + reach).alias("band_high"),
    )


def keep_good(table: DataFrame, text: str, lang: str, width: float = WIDTH) -> DataFrame:
    """The rows that pass, with their columns unchanged."""
    row = F.struct(*[F.col(f"`{c}`") for c in table.columns])
    judged = _judged(table, text, lang, [row.alias("row")], f"row {row_type(table)}", width)
    return judged.filter("kept").select(*[F.col("row").getField(c).alias(c) for c in table.columns])


def row_type(table: DataFrame) -> str:
    """A struct type, as text, of all columns."""
    return "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in table.schema.fields) + ">"
