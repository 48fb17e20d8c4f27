"""Removal of long repeated byte strings with suffix arrays.

Every byte covered by a string of ``length`` bytes that also starts at another place, in the same or in
another text, is removed. Strings are judged on the input.

1. Winnowing finds where repeats can be: in every ``length`` bytes the gram with the smallest hash is
   an anchor (about one place in 170), and equal strings have equal anchors. An anchor hash met once
   cannot lie in a repeat. Whole copies are counted first, and one text stands for all of them.
2. The surroundings of the other anchors (everything a repeat through them can cover) are dealt into shards
   by anchor hash. A shard builds a suffix array by Larsson-Sadakane refinement and the common
   prefixes of neighbours by Kasai's rule, both in numpy; neighbours that share ``length`` bytes are repeats.
3. An anchor hash with too many places for one shard is dealt into several parts. Each part hands on its distinct
   strings as sorted arrays of hashes, cut into ranges, with the places of those that it has once. Where the arrays
   of all parts for one range meet, binary search in their merged order tells which of these another part has too.
   A part is one row a range, whatever it holds, and a string is in it once however many texts hold it.

Defined cases: null and empty texts have no bytes; texts shorter than ``length`` lose nothing; a text that
occurs twice or more, repeated rows among them, goes completely if it has ``length`` bytes; an empty table
gives no rows; a cut may fall inside a character, and ``clean`` drops what is left of it; other columns
are not looked at by ``spans`` and kept as they are by ``clean``. Texts and strings are told apart
by 128-bit and 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.keyed import total_bytes
from ..operators.materialize import materialize
from .textbytes import as_bytes, prefix_hash, slices, span_hash

LENGTH = 400
GRAM = 64
SHARD_BYTES = 1 << 18  # text in a shard, about
RANGE_STRINGS = 1_000_000  # strings of all parts of an anchor that meet in one task, about
CHAIN = 128  # places that Kasai's rule walks in a row
BROADCAST_BYTES = 32 << 20


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a text."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, document): in every ``length`` bytes of a text, a gram with the smallest hash."""
    width = length - gram + 1
    sums = prefix_hash(data)
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if len(data) < length:
        return none
    at = np.arange(len(data) - gram + 1)
    value = span_hash(sums, at, at + gram)
    # Smallest value of each window, rightmost of equals, by minima from both ends of blocks.
    blocks = -(-len(value) // width) * width
    packed = np.full(blocks, np.uint64(0xFFFFFFFFFFFFFFFF))
    packed[: len(value)] = value
    square = packed.reshape(-1, width)
    left = np.minimum.accumulate(square, axis=1).ravel()
    right = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(value) - width + 1
    if windows <= 0:
        return none
    least = np.minimum(right[:windows], left[width - 1 : width - 1 + windows])
    # A place is an anchor if it holds the least value of a window that lies in its document.
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = doc[:windows] == doc[length - 1 : length - 1 + windows]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return none
    low = least[starts]
    turn = np.ones(len(starts), bool)  # the least value changes, or a new run of windows begins
    turn[1:] = (low[1:] != low[:-1]) | (starts[1:] != starts[:-1] + 1)
    first, values = starts[turn], low[turn]
    last = np.append(starts[np.flatnonzero(turn)[1:] - 1], starts[-1])
    # A value that occurs once where these windows reach is one anchor. One that repeats there (text with
    # a period) is thinned so that every window still has it, but keeps two places: the string repeats.
    found, alone = _only_place(value, first, values, last + width)
    places, keep_value = [found[alone]], [values[alone]]
    for i in np.flatnonzero(~alone).tolist():
        begin, end, v = int(first[i]), int(last[i]), values[i]
        hits = begin + np.flatnonzero(value[begin : end + width] == v)
        kept, window = [hits[0], hits[-1]], begin
        while window <= end:
            kept.append(hits[np.searchsorted(hits, window + width - 1, "right") - 1])  # the rightmost in the window
            window = int(kept[-1]) + 1
        places.append(np.array(kept))
        keep_value.append(np.full(len(kept), v))
    place, value = np.concatenate(places), np.concatenate(keep_value)
    place, one = np.unique(place, return_index=True)
    return value[one], place - offsets[doc[place]], doc[place]


def _only_place(value: np.ndarray, begin: np.ndarray, wanted: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each wanted value, and whether it is the only one and in [begin, end)."""
    # The least of many hashes is small, so nearly all wanted ones are among a few per cent of the places.
    small = np.flatnonzero(value < np.uint64(1 << 59))
    ranked = value[small]
    order = np.argsort(ranked)
    ranked = np.append(ranked[order], np.uint64(0xFFFFFFFFFFFFFFFF))
    at = np.searchsorted(ranked, wanted)
    out = np.append(small[order], 0)[at]
    more = (ranked[at] != wanted) | (np.append(ranked[1:], ranked[-1])[at] == wanted)  # look closer at these
    for i in np.flatnonzero(more).tolist():
        hits = np.flatnonzero(value[begin[i] : end[i]] == wanted[i])
        out[i], more[i] = begin[i] + int(hits[0]), len(hits) > 1
    return out, ~more


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffixes in order, by Larsson-Sadakane refinement with doubled steps.

    Only groups that are not single yet are sorted again, by the rank of the suffix behind."""
    n = len(data)
    if n and data[-1] == 0:  # so that the filling below never ties with the text
        order = suffix_array(np.append(data, np.uint8(1)))
        return order[order < n]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : n + i]
    order = np.argsort(key)
    key = key[order]
    head = np.ones(n, bool)
    head[1:] = key[1:] != key[:-1]
    rank = np.zeros(n + 1, np.int64)  # first slot of a suffix's group, from 1; 0 behind the end
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0)) + 1
    single = head & np.append(head[1:], True)
    slots, step = np.flatnonzero(~single), 8
    while len(slots):
        place = order[slots]
        pair = rank[place] << 32 | rank[np.minimum(place + step, n)]
        by = np.argsort(pair)
        place, pair = place[by], pair[by]
        order[slots] = place
        head = np.ones(len(slots), bool)
        head[1:] = pair[1:] != pair[:-1]
        rank[place] = slots[np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))] + 1
        slots = slots[~(head & np.append(head[1:], True))]
        step *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in the order, up to ``most``.

    Kasai's rule (a suffix shares at least one byte less than the suffix a place earlier) along chains
    of places that advance together; each chain starts anew."""
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([data, np.zeros(8 + most, np.uint8)])
    word = np.zeros(len(padded) - 7, np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | padded[i : len(padded) - 7 + i]
    shared = np.zeros(n, np.int64)
    chains = np.arange(0, n, CHAIN)
    have = np.zeros(len(chains), np.int64)
    for step in range(min(CHAIN, n)):
        place = chains + step
        place = place[place < n]
        have = np.maximum(have[: len(place)] - 1, 0)
        other = before[place]
        have[other < 0] = 0
        live = np.flatnonzero((other >= 0) & (have < most))
        while len(live):
            a, b = place[live] + have[live], other[live] + have[live]
            differ = word[a] ^ word[b]
            same = np.where(differ == 0, 8, 0)
            odd = np.flatnonzero(differ)
            if len(odd):  # whole bytes that agree before the first difference
                x = differ[odd]
                bytes_ = np.zeros(len(odd), np.int64)
                for shift in (56, 48, 40, 32, 24, 16, 8):
                    bytes_ += (x >> np.uint64(shift)) == 0
                same[odd] = bytes_
            have[live] += same
            live = live[(differ == 0) & (have[live] < most)]
        have = np.minimum(have, np.minimum(most, n - np.maximum(place, other)))
        shared[place] = have
    return shared


def repeated_starts(data: np.ndarray, valid: np.ndarray, length: int) -> np.ndarray:
    """Which valid places start ``length`` bytes that another valid place starts too."""
    order = suffix_array(data)
    shared = common_prefixes(data, order, length)[order]
    run = np.cumsum(shared < length) - 1
    members = np.bincount(run, weights=valid[order])
    out = np.zeros(len(data), bool)
    out[order] = members[run] >= 2
    return out & valid


def _merge(starts: np.ndarray, ends: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of touching intervals within each group: starts, ends, groups."""
    order = np.lexsort((starts, groups))
    starts, ends, groups = starts[order], ends[order], groups[order]
    span = int(ends.max(initial=0)) + 1
    reach = np.maximum.accumulate(groups * span + ends)  # groups come one after the other
    new = np.ones(len(starts), bool)
    new[1:] = (groups[1:] != groups[:-1]) | (groups[1:] * span + starts[1:] > reach[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)
    return starts[new], reach[last] - groups[new] * span, groups[new]


def _search_shard(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """Repeated intervals within one shard; for a part of a split anchor, also its distinct strings, by range."""
    texts, of = np.unique(np.stack([rows["k1"], rows["k2"]], axis=1), axis=0, return_inverse=True)
    of = of.ravel()
    pieces = [np.frombuffer(s, np.uint8) for s in rows["segment"]]
    begin = rows["start"].to_numpy(np.int64)
    end = begin + np.array([len(p) for p in pieces])
    starts, ends, owner = _merge(begin, end, of)
    # Lay the merged stretches side by side; overlapping segments of a text agree.
    base = np.concatenate([[0], np.cumsum(ends - starts)])
    data = np.zeros(base[-1], np.uint8)
    span = int(ends.max()) + 1
    to = np.searchsorted(owner * span + starts, of * span + begin, "right") - 1
    for piece, b, t in zip(pieces, begin.tolist(), to.tolist(), strict=True):
        at = base[t] + b - starts[t]
        data[at : at + len(piece)] = piece
    size = ends - starts
    inside = np.arange(len(data)) - np.repeat(base[:-1], size)
    valid = inside + length <= np.repeat(size, size)
    again = repeated_starts(data, valid, length)
    out = []
    hit = np.flatnonzero(again)
    which = np.searchsorted(base, hit, "right") - 1
    places = starts[which] + hit - base[which]
    if len(hit):
        s, e, g = _merge(places, places + length, owner[which])
        out.append(pd.DataFrame({"k1": texts[g, 0], "k2": texts[g, 1], "start": s, "end": e}))
    ranges = int(rows["ranges"].iloc[0])
    if ranges:  # a part of a split anchor
        at = np.flatnonzero(valid)
        value = span_hash(prefix_hash(data), at, at + length)
        order = np.argsort(value, kind="stable")
        value, at = value[order], at[order]
        first = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else order
        alone = np.diff(np.append(first, len(value))) == 1
        value, at = value[first], at[first]
        which = np.searchsorted(base, at, "right") - 1
        # Strings found twice here are known already: others need to see them, but not their places.
        start = np.where(alone, starts[which] + at - base[which], -1)
        out += _ranges_of(value, start, texts, owner[which], ranges, int(rows["h"].iloc[0]))
    columns = ["k1", "k2", "start", "end", "h", "range", "strings", "places", "texts"]
    kinds = {c: "Int64" for c in columns[:6]} | {c: "object" for c in columns[6:]}
    # Cast one by one: a column that is missing somewhere would pass through floating point.
    whole = [frame.astype({c: kinds[c] for c in frame}).reindex(columns=columns).astype(kinds) for frame in out]
    return pd.concat(whole, ignore_index=True) if whole else pd.DataFrame(columns=columns).astype(kinds)


def _ranges_of(value: np.ndarray, start: np.ndarray, texts: np.ndarray, owner: np.ndarray, ranges: int, h: int) -> list[pd.DataFrame]:
    """A row for each range of sorted values: values, (start, text) of each (start -1: none), and the texts."""
    ranked = (value >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    edges = [*np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])).tolist(), len(value)] if len(value) else [0]
    rows = []
    for a, b in zip(edges, edges[1:], strict=False):
        used, text = np.unique(owner[a:b], return_inverse=True)
        places = np.stack([start[a:b], text.ravel()], axis=1).astype(np.int64)
        rows.append((h, int(ranked[a]), value[a:b].tobytes(), places.tobytes(), texts[used].astype(np.int64).tobytes()))
    return [pd.DataFrame(rows, columns=["h", "range", "strings", "places", "texts"])] if rows else []


def _merge_range(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """Intervals of strings that a part has once and another part has at another place, over one range of an anchor's strings."""
    values, place, text, keys = [], [], [], []
    for strings, places, texts in zip(rows["strings"], rows["places"], rows["texts"], strict=True):
        own = np.frombuffer(places, np.int64).reshape(-1, 2)
        values.append(np.frombuffer(strings, np.uint64))
        place.append(own[:, 0])
        keys.append(np.frombuffer(texts, np.int64).reshape(-1, 2))
        text.append(own[:, 1])
    # Overlapping surroundings bring one place into two parts, so places are told apart by text and start.
    known = np.unique(np.concatenate(keys), axis=0, return_inverse=True)[1].ravel()
    first = np.cumsum([0, *map(len, keys)])
    whole = known[np.concatenate([f + t for f, t in zip(first, text, strict=False)])]
    value, start = np.concatenate(values), np.concatenate(place)
    order = np.lexsort((start, whole, value))
    ranked = value[order]
    new = np.append(True, ranked[1:] != ranked[:-1])
    moved = (start[order][1:] != start[order][:-1]) | (whole[order][1:] != whole[order][:-1])
    twice = start[order] < 0  # a part has it at several places
    twice[1:] |= moved & ~new[1:]
    heads = np.flatnonzero(new)
    repeated = np.logical_or.reduceat(twice, heads)
    merged = ranked[heads]
    out = []
    for number, own in enumerate(values):
        hit = np.flatnonzero(repeated[np.searchsorted(merged, own)] & (place[number] >= 0))
        if len(hit):
            s, e, g = _merge(place[number][hit], place[number][hit] + length, text[number][hit])
            out.append(pd.DataFrame({"k1": keys[number][g, 0], "k2": keys[number][g, 1], "start": s, "end": e}))
    return pd.concat(out) if out else pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("k1", "k2", "start", "end")})


def repeats(table: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """For (doc, text): (k1, k2, copies, bytes) of every text, (k1, k2, starts, ends) of texts with repeats."""
    if not 8 <= gram < length:
        raise ValueError("grams must be shorter than the strings and have 8 bytes or more")
    spark = table.sparkSession
    rows = table.select("doc", "text", *text_key(F.col("text")))
    kind = table.schema["doc"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = as_bytes(part.column("text"))
                value, place, doc = anchors(data, offsets, length, gram)
                order = np.lexsort((place, doc))
                ends = pa.array(np.searchsorted(doc[order], np.arange(part.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(c)) for c in (value[order].view(np.int64), place[order])]
                arrays = [part.column(c) for c in ("doc", "k1", "k2")] + [pa.array(np.diff(offsets)), *lists]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc", "k1", "k2", "bytes", "h", "pos"])

    found = materialize(rows.mapInArrow(find, f"doc {kind}, k1 long, k2 long, bytes long, h array<long>, pos array<long>"), "suffix-anchors")
    texts = found.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.min("doc").alias("first"), F.max("bytes").alias("bytes"))
    texts = materialize(texts, "suffix-texts")
    # One row of each text takes part; equal rows of one id are told apart by what they do not add.
    chosen = found.join(texts.select(F.col("k1").alias("_1"), F.col("k2").alias("_2"), "first"), (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2")))
    chosen = chosen.filter(F.col("doc").eqNullSafe(F.col("first"))).select("doc", "k1", "k2", F.explode(F.arrays_zip("h", "pos")).alias("a"))
    chosen = chosen.select("doc", "k1", "k2", F.col("a.h").alias("h"), F.col("a.pos").alias("pos")).distinct()
    chosen = materialize(chosen, "suffix-places")
    shared = chosen.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    span = 2 * length - gram  # most bytes around an anchor that a repeat through it can cover
    most = max(1, SHARD_BYTES // span)  # places of one anchor in a shard
    placed = materialize(chosen.join(shared.withColumnRenamed("h", "_h"), F.col("h") == F.col("_h")).drop("_h"), "suffix-shared")
    total = placed.count()
    parts = F.ceil(F.col("n") / most).cast("int")
    shards = max(1, -(-total // most))
    part = F.pmod(F.xxhash64("k1", "k2", "pos"), parts)
    shard = F.when(parts > 1, F.concat_ws("-", "h", part)).otherwise(F.pmod(F.xxhash64("h"), F.lit(shards)).cast("string"))
    strings = F.ceil(F.col("n") * (length - gram + 1) / F.lit(RANGE_STRINGS)).cast("int")
    ranges = F.when(parts > 1, strings).otherwise(0).alias("ranges")
    wanted = placed.select("doc", "k1", "k2", F.struct("pos", "h", ranges, shard.alias("shard")).alias("p"))
    wanted = wanted.groupBy("k1", "k2").agg(F.first("doc").alias("_doc"), F.collect_list("p").alias("p"))  # as many as the text has anchors
    wanted = materialize(wanted.select(F.col("k1").alias("_1"), F.col("k2").alias("_2"), "_doc", "p"), "suffix-wanted")
    ids = wanted.select(F.col("_1").alias("_k1")).distinct()
    small = total_bytes(ids)[0] <= BROADCAST_BYTES
    rows = rows.join(F.broadcast(ids) if small else ids, F.col("k1") == F.col("_k1"), "left_semi")
    matched = rows.join(wanted, (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2")) & F.col("doc").eqNullSafe(F.col("_doc")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in slices(batch, "text"):
                data, offsets = as_bytes(one.column("text"))
                p = one.column("p")
                lengths = np.diff(p.offsets.to_numpy())
                flat = p.flatten()
                doc = np.repeat(np.arange(one.num_rows), lengths)
                pos = pc.struct_field(flat, "pos").to_numpy(zero_copy_only=False)
                begin = np.maximum(pos - (length - gram), 0)
                end = np.minimum(pos + length, np.diff(offsets)[doc])
                raw = data.tobytes()
                for at in range(0, len(pos), 4096):
                    some = slice(at, at + 4096)
                    a, b = (offsets[doc[some]] + begin[some]).tolist(), (offsets[doc[some]] + end[some]).tolist()
                    segment = pa.array([raw[i:j] for i, j in zip(a, b, strict=True)], pa.binary())
                    take = pa.array(doc[some])
                    arrays = [one.column("k1").take(take), one.column("k2").take(take), pa.array(begin[some]), segment]
                    arrays += [pc.struct_field(flat, c).slice(at, len(a)) for c in ("h", "ranges", "shard")]
                    yield pa.RecordBatch.from_arrays(arrays, names=["k1", "k2", "start", "segment", "h", "ranges", "shard"])

    segments = matched.select("text", "k1", "k2", "p").mapInArrow(
        cut, "k1 long, k2 long, start long, segment binary, h long, ranges int, shard string"
    )
    schema = "k1 long, k2 long, start long, end long, h long, range long, strings binary, places binary, texts binary"
    searched = materialize(segments.groupBy("shard").applyInPandas(lambda g: _search_shard(g, length), schema), "suffix-found")
    split = searched.filter("range IS NOT NULL").select("h", "range", "strings", "places", "texts")
    across = split.groupBy("h", "range").applyInPandas(lambda g: _merge_range(g, length), "k1 long, k2 long, start long, end long")
    intervals = searched.filter("range IS NULL").select("k1", "k2", "start", "end").unionByName(across)
    # As many intervals as the text's anchors give.
    merged = intervals.groupBy("k1", "k2").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    return texts, merged


def _united(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, e, _ = _merge(np.asarray(starts, np.int64), np.asarray(ends, np.int64), np.zeros(len(starts), np.int64))
    return s, e


def _rows_with_spans(table: DataFrame, length: int, gram: int) -> DataFrame:
    """The given (doc, text, ...) with ``copies``, ``starts`` and ``ends`` of the row's text."""
    texts, merged = repeats(table.select("doc", "text"), length, gram)
    known = texts.join(merged.withColumnsRenamed({"k1": "_a", "k2": "_b"}), (F.col("k1") == F.col("_a")) & (F.col("k2") == F.col("_b")), "left")
    known = known.filter((F.col("copies") > 1) & (F.col("bytes") >= length) | F.col("starts").isNotNull())
    known = materialize(known.select(F.col("k1").alias("_1"), F.col("k2").alias("_2"), "copies", "starts", "ends"), "suffix-spans")
    keyed = table.select("*", *text_key(F.col("text")))
    lists = known.select(F.sum(F.size("starts"))).first()[0] or 0
    small = total_bytes(known)[0] + 16 * lists <= BROADCAST_BYTES
    on = (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2"))
    return keyed.join(F.broadcast(known) if small else known, on, "left")


def _kept(
    data: bytes, copies: int | None, starts: list | None, ends: list | None, length: int, counts: Callable[[bytes], bool] | None = None
) -> tuple[bytes, int]:
    """What is left of a text, and the number of runs removed; with ``counts``, only runs that it holds for."""
    if (copies or 0) > 1 and len(data) >= length:
        return (data, 0) if counts and not counts(data) else (b"", 1)
    if not starts:
        return data, 0
    s, e = _united(starts, ends)
    if counts:
        wanted = [counts(data[a:b]) for a, b in zip(s.tolist(), e.tolist(), strict=True)]
        s, e = s[wanted], e[wanted]
    edges = [0, *np.stack([s, e], axis=1).ravel().tolist(), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), len(s)


def spans(table: DataFrame, key: str, text: str, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    kind = table.schema[key].dataType.simpleString()
    rows = _rows_with_spans(table.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("text")), length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw = [(t or "").encode() for t in part.column("text").to_pylist()]
                lists = zip(raw, *(part.column(c).to_pylist() for c in ("copies", "starts", "ends")), strict=True)
                left = [_kept(*row, length) for row in lists]
                arrays = [part.column("doc"), pa.array([len(r) for r in raw], pa.int64())]
                arrays += [pa.array([len(r) - len(k) for r, (k, _) in zip(raw, left, strict=True)], pa.int64())]
                arrays += [pa.array([n for _, n in left], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k, _ in left], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.select("doc", "text", "copies", "starts", "ends").mapInArrow(
        run, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def clean(
    table: DataFrame, key: str, text: str, length: int = LENGTH, gram: int = GRAM,
    least_words: int = 0, sure_bytes: int = 0, least_left: int = 0,
) -> DataFrame:
    """The table with repeated strings taken out of the text; rows whose text goes completely are dropped.

    With ``least_words``, a run of repeated bytes goes only if it holds so many words (between white space), or
    ``sure_bytes`` bytes. A row that loses a run and keeps fewer than ``least_left`` words is dropped.
    """
    counts = (lambda run: len(run.split()) >= least_words or len(run) >= sure_bytes > 0) if least_words else None
    names = table.columns
    own = F.struct(*[F.col(f"`{c}`") for c in names if c != text]).alias("row")
    rows = _rows_with_spans(table.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("text"), own), length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                lists = zip(texts, *(part.column(c).to_pylist() for c in ("copies", "starts", "ends")), strict=True)
                left = [t if t is None else _kept(t.encode(), *more, length, counts)[0].decode("utf-8", "ignore") for t, *more in lists]
                stay = pa.array([not t or t == k or bool(k) and len(k.encode().split()) >= least_left for t, k in zip(texts, left, strict=True)])
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(left, pa.string())], names=["row", "text"]).filter(stay)

    row = rows.schema["row"].dataType
    kind = "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in row.fields) + ">"
    done = rows.select("row", "text", "copies", "starts", "ends").mapInArrow(run, f"row {kind}, text string")
    return done.select(*[F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in names])
