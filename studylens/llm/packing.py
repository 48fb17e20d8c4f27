"""Best-fit packing of tokenised documents into sequences, by hierarchical rounds.

1. ``token_pieces`` turns texts into pieces of at most ``capacity`` tokens (only longer documents
   are cut) and writes their lengths down once. The ids come from the vocabulary and merges of a
   ``tokenizers`` file; words are merged by our own agenda (``merges``), and any text with unusual
   characters goes through the library itself, so both give the same ids.
2. ``pack`` deals the pieces into groups of bounded size and packs each by best fit, longest first.
   Bins whose free space is smaller than every bin that is still open anywhere are final; the
   others become items of the next round, where FAN groups meet in one, until one group is left
   or a round saves no bin. A group never holds more than about GROUP_ITEMS items.

Defined cases: a null text is an empty one, whose document is the end mark alone; repeated rows are
packed each; documents without an id are packed like others; an empty table gives no rows; columns
other than the id and the text are not looked at.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.materialize import materialize
from .merges import SHORT, PairTable, merge_strings
from .textbytes import release, slices

CAPACITY = 2048
GROUP_ITEMS = 50_000
FAN = 8
ROUND_GROUPS = 1 << 24  # group numbers of a round; bins are numbered (round, group, bin)
CACHE_WORDS = 300_000

# Texts of these characters alone are split here; NFC leaves them as they are and their lower case
# is one character. Anything else, and the marks of special tokens, goes through the library.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ňŊ-ſ]*")
_LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-ſ"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
# The model's own pattern with the common case first; no two alternatives but the last two compete.
_WORD = re.compile(f"[{_LETTER}]+|[{_NUMBER}]|'(?:s|t|re|ve|m|ll|d)|[^\\s{_LETTER}{_NUMBER}]+")
_MODEL_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    place = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}
    return [chr(place[b]) for b in range(256)]


class WordCodec:
    """Ids of texts under one ``tokenizers`` file with lower-cased, end-marked words."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, end = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        split = json.dumps(spec["pre_tokenizer"])
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        # Another kind of file is still read rightly, by the library.
        self.own = (
            kinds == ["NFC", "Replace", "Lowercase"] and json.dumps(_MODEL_PATTERN)[1:-1] in split
            and model["type"] == "BPE" and bool(end) and not model["fuse_unk"] and not model["byte_fallback"] and not model["dropout"]
            and not model["unk_token"] and not model["continuing_subword_prefix"] and not model["ignore_merges"]
        )
        self.special = tuple(t["content"] for t in spec["added_tokens"])
        self.cache: dict[str, bytes] = {}
        if not self.own:
            return
        vocab = model["vocab"]
        shown = byte_characters()
        self.inner = np.array([vocab[c] for c in shown], np.int64)
        self.last = np.array([vocab[c + end] for c in shown], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        rows = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64)
        rank = np.arange(len(rows))
        self.rows = rows
        self.table = PairTable(rows[:, 0], rows[:, 1], rank, rows[:, 2])

    # Both take memory of every worker, and few texts need them: odd ones, and those with very long words.
    @cached_property
    def library(self):  # noqa: ANN201
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @cached_property
    def pairs(self) -> dict[tuple[int, int], tuple[int, int]]:
        return {(a, b): (i, c) for i, (a, b, c) in enumerate(self.rows.tolist())}

    def _learn(self, words: list[str]) -> None:
        spelled = [w.encode() for w in words]
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in spelled])])
        data = np.frombuffer(b"".join(spelled), np.uint8)
        symbols = self.inner[data]
        symbols[offsets[1:] - 1] = self.last[data[offsets[1:] - 1]]
        ids, at = merge_strings(symbols, offsets, self.table, self.pairs if int(np.diff(offsets).max()) > SHORT else {})
        raw, at = ids.astype("<u4").tobytes(), (at * 4).tolist()
        self.cache.update((w, raw[at[i] : at[i + 1]]) for i, w in enumerate(words))

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        easy = [self.own and _PLAIN.fullmatch(t) is not None and not any(s in t for s in self.special) for t in texts]
        split = [_WORD.findall(t.lower()) if e else [] for t, e in zip(texts, easy, strict=True)]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        new = set().union(*split).difference(self.cache)
        if new:
            self._learn(list(new))
        cache = self.cache
        return [
            b"".join(map(cache.__getitem__, words))
            if e
            else np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
            for t, e, words in zip(texts, easy, split, strict=True)
        ]


def token_pieces(
    table: DataFrame, key: str, text: str, path: str, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) for every piece of every document."""
    kind = table.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    mark = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Made anew for every task: kept, its words and tables took 100 MB of each worker through all later stages.
        own = WordCodec(path)
        release()
        for batch in batches:
            for part in slices(batch, text):
                rows, piece, start, length, crc, ids = [], [], [], [], [], []
                for row, raw in enumerate(own.encode([t or "" for t in part.column(text).to_pylist()])):
                    raw += mark
                    for i, at in enumerate(range(0, len(raw), 4 * capacity)):
                        cut = raw[at : at + 4 * capacity]
                        rows.append(row)
                        piece.append(i)
                        start.append(at // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                        if with_ids:
                            ids.append(np.frombuffer(cut, "<u4").astype(np.int32))
                columns = [part.column(key).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32())]
                columns += [pa.array(c, pa.int64()) for c in (start, length, crc)]
                names = [key, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        del own
        release()

    return table.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, schema)


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: longest item first, into the fullest bin that still has room."""
    bins = np.empty(len(sizes), np.int64)
    waiting: dict[int, list[int]] = {}  # free space -> bins with just so much
    free: list[int] = []  # the free spaces that occur, sorted
    made = 0
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        at = bisect_left(free, size)
        if at < len(free):
            room = free[at]
            own = waiting[room].pop()
            if not waiting[room]:
                del waiting[room]
                free.pop(at)
        else:
            room, own, made = capacity, made, made + 1
        bins[item] = own
        room -= size
        if room:
            if room not in waiting:
                waiting[room] = []
                insort(free, room)
            waiting[room].append(own)
    return bins


def _pack_group(rows: pd.DataFrame, capacity: int, tag: int) -> pd.DataFrame:
    """Packs the bins of one group, each as one item, into new bins; rows are their members."""
    old, first = np.unique(rows["bin"].to_numpy(), return_index=True)
    sizes = rows["filled"].to_numpy()[first]
    new = best_fit(sizes, capacity)
    filled = np.bincount(new, weights=sizes).astype(np.int64)
    order = np.lexsort((old, new))
    before = np.concatenate([[0], np.cumsum(sizes[order])[:-1]])
    shift = np.empty(len(old), np.int64)
    head = np.concatenate([[True], new[order][1:] != new[order][:-1]])
    shift[order] = before - np.maximum.accumulate(np.where(head, before, 0))
    which = np.searchsorted(old, rows["bin"].to_numpy())
    return rows.assign(
        offset=rows["offset"].to_numpy() + shift[which], filled=filled[new[which]], bin=(np.int64(tag) << np.int64(32)) + new[which]
    )


def _packer(capacity: int, base: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda rows: _pack_group(rows, capacity, base + int(rows["group"].iloc[0]))


def pack(items: DataFrame, length: str, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, fan: int = FAN) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` (gapless from 0 in a sequence) to items of 1 to ``capacity`` units.

    Items should be few columns wide. Which sequences come out depends on the order in which the
    items were written down, their number hardly.
    """
    names = items.columns
    bad = F.col(f"`{length}`").isNull() | (F.col(f"`{length}`") < 1) | (F.col(f"`{length}`") > capacity)
    size = F.when(bad, F.raise_error(F.lit("item longer than a sequence, or without a length")).cast("long")).otherwise(F.col(f"`{length}`").cast("long"))
    # The own columns travel under numbers, so no name can clash.
    own = [f"c{i}" for i in range(len(names))]
    table = items.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(names, own, strict=True)], size.alias("filled"))
    table = table.select(*own, "filled", F.monotonically_increasing_id().alias("bin"), F.lit(0).cast("long").alias("offset"))
    table = materialize(table, "pack-items")
    groups = max(1, -(-table.count() // group_items))
    schema = table.withColumn("group", F.lit(0).cast("long")).schema
    finished, bins_before, number = [], None, 0
    while True:
        tagged = table.withColumn("group", F.pmod(F.xxhash64("bin", F.lit(number)), F.lit(groups)))
        if groups > ROUND_GROUPS:
            raise ValueError("too many groups in a round; raise group_items")
        base = number * ROUND_GROUPS

        packed = materialize(tagged.groupBy("group").applyInPandas(_packer(capacity, base), schema), f"pack-round-{number}")
        if groups == 1:
            finished.append(packed)
            break
        heads = packed.groupBy("bin").agg(F.first("filled").alias("filled"))
        bins, least = heads.agg(F.count(F.lit(1)), F.min("filled")).first()
        if bins_before is not None and bins >= bins_before:
            finished.append(packed)
            break
        # A bin with less room than the least filled one can take no other.
        closed = F.lit(capacity) - F.col("filled") < least
        finished.append(packed.filter(closed))
        table = packed.filter(~closed)
        left = heads.filter(~closed).count()
        if not left:
            break
        bins_before, groups, number = left, max(1, min(-(-groups // fan), -(-left // group_items)) if left <= group_items else -(-left // group_items)), number + 1
    result = finished[0]
    for part in finished[1:]:
        result = result.unionByName(part)
    return result.select(*[F.col(o).alias(c) for c, o in zip(names, own, strict=True)], F.col("bin").alias("sequence_id"), "offset")


def sequences(packed: DataFrame, ids: str = "ids") -> DataFrame:
    """(sequence_id, ids): the token ids of every sequence, joined in order of their offsets."""
    own = packed.select("sequence_id", F.struct("offset", F.col(f"`{ids}`").alias("ids")).alias("part"))
    joined = own.groupBy("sequence_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return joined.select("sequence_id", F.flatten("parts.ids").alias("ids"))


