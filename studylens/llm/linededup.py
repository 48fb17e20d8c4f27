"""Line dedup by a segment-partition edit join.

1. Lines of at least ``least`` bytes are split into ``edits + 1`` segments. Two lines within that many byte
   edits share a segment, at nearly the same place. Every line names its own segments (its index entries,
   by length and segment number) and probes those that shorter lines of each possible length could have,
   at the few starts that are possible. Spark sorts these keys; lines that meet name a lead (``leads``).
2. Under a lead, lines whose numbers of bytes of each kind rule out a link are put into different clusters. Within
   a cluster they are compared by banded bit-parallel edit distance, many pairs at a time in numpy, until it
   is known which are connected; where pairs are many, lines already connected are not compared again.
3. Links give components of lines. The first occurrence of a component (smallest document, then line) stays,
   every later one goes. Only blank lines and lines shorter than ``least`` are never removed. With ``least=1``,
   as the registered query and the pipeline have it, every line that is not blank takes part; its segments are
   as short as it needs, down to none: lines of one or two bytes are all within two edits of each other.

Defined cases: null and empty texts have no line to remove; blank lines (spaces, tabs, ...) stay; rows that agree in id and text
count as one document (all of them keep what it keeps); a null id comes before others; an empty
table gives no rows; very long lines and texts are treated whole; other columns are not looked at by
``count_lines`` and are kept as they are by ``drop_repeats``. Lines are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.keyed import total_bytes
from ..operators.materialize import materialize
from .components import connected_components
from .leads import met, route
from .textbytes import CHUNK_BYTES, SPACE, as_bytes, lines, mix, prefix_hash, slices, span_hash

EDITS = 2
LEAST = 32  # bytes; 1 for all lines
GROUP_LINES = 2_000
SPARSE = 16  # pairs a line, up to which all of a cluster are compared at once
KINDS = 32  # bytes alike in their low bits are counted together
LONG = 256  # bytes from which common beginnings and ends of two lines are taken off first
BROADCAST_BYTES = 32 << 20
INK = bytes((~SPACE).astype(np.uint8))  # for bytes.translate


def segments(length: np.ndarray, parts: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, size) of each of the even segments of strings of these lengths, the longer ones last."""
    short, longer = length // parts, length % parts
    out = []
    for i in range(parts):
        extra = np.maximum(i - (parts - longer), 0)
        out.append((i * short + extra, short + (i >= parts - longer)))
    return out


def segment_keys(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, line): index entries and probes of each line [start, end).

    A probe looks for the i-th segment of a line shorter by ``less``. It starts off the segment's place by
    at most i on either side (edits before it), and by what ``less`` leaves for the edits behind it.
    """
    length, keys, owners = ends - starts, [], []
    every = np.arange(len(starts))
    for less in range(edits + 1):
        other = length - less
        for i, (at, size) in enumerate(segments(other, edits + 1)):
            behind = edits - i
            for shift in range(max(-i, less - behind), min(i, less + behind) + 1):
                ok = (other > 0) & (at + shift >= 0) & (at + shift + size <= length)
                begin = (starts + at + shift)[ok]
                tag = mix(other[ok].astype(np.uint64) * np.uint64(64) + np.uint64(i))
                keys.append(mix(span_hash(sums, begin, begin + size[ok]) + tag))
                owners.append(every[ok])
    return np.concatenate(keys), np.concatenate(owners)


class Packed:
    """Lines in one byte buffer, each between bytes that occur in no UTF-8 text."""

    def __init__(self, texts: list[bytes], edits: int):
        before, behind = b"\xff" * edits, b"\xff" * (2 * edits + 1)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.buffer = np.frombuffer(b"".join(x for t in texts for x in (before, t, behind)), np.uint8)
        self.starts = np.cumsum(self.sizes + 3 * edits + 1) - self.sizes - 2 * edits - 1


def _distances(packed: Packed, pattern: np.ndarray, text: np.ndarray, edits: int) -> np.ndarray:
    """Whether each pattern line, not longer than its text line, is within ``edits`` byte edits of it.

    Bit k of a word stands for the pattern row ``column - edits + k``: a band along the diagonal, moved down
    a row with each column of the text. Differences of neighbouring cells are kept in bits (Myers, Hyyrö).
    Cells of the band differ from the diagonal's by at most ``edits``, and no path to the end has a smaller
    cell than its beginning, so a pair whose diagonal exceeds twice the edits is given up.
    """
    buffer, out = packed.buffer, np.zeros(len(pattern), bool)
    pair = np.flatnonzero(packed.sizes[text] - packed.sizes[pattern] <= edits)
    n, m = packed.sizes[pattern[pair]], packed.sizes[text[pair]]
    row0, column0 = packed.starts[pattern[pair]] - edits - 1, packed.starts[text[pair]] - 1
    one, full = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
    top = np.uint64((1 << edits) - 1)  # rows up to 0 before the first column
    plus, minus = np.full(len(pair), full ^ top), np.full(len(pair), top)
    distance = np.zeros(len(pair), np.int64)
    least, column = int(n.min(initial=0)), 0
    while True:
        if column >= least or column % 8 == 0:  # take out what is decided
            done = m <= column
            out[pair[done]] = distance[done] <= edits
            live = ~done & (distance <= 2 * edits)
            if not live.all():
                pair, n, m, row0, column0 = pair[live], n[live], m[live], row0[live], column0[live]
                plus, minus, distance = plus[live], minus[live], distance[live]
                least = int(n.min(initial=0))
            if not len(pair):
                return out
        column += 1
        letter = buffer[column0 + column]
        place = row0 + column
        same = np.zeros(len(pair), np.uint64)
        for k in range(2 * edits + 1):
            same |= (buffer[place + k] == letter).astype(np.uint64) << np.uint64(k)
        diagonal = (((same & plus) + plus) ^ plus) | same | minus
        right_up, right_down = minus | ~(diagonal | plus), plus & diagonal
        missed = ((diagonal >> np.uint64(edits)) & one) == 0
        if column <= least:
            distance += missed
        else:  # behind the pattern's end its last row is followed to the right
            bit = np.clip(n - column + edits, 0, 63).astype(np.uint64)
            step = ((right_up >> bit) & one).astype(np.int64) - ((right_down >> bit) & one).astype(np.int64)
            distance += np.where(column <= n, missed, step)
        plus, minus = right_down | ~((diagonal >> one) | right_up), (diagonal >> one) & right_up


def _middles(a: bytes, b: bytes) -> tuple[bytes, bytes]:
    """Both without their common beginning and end, which leaves their edit distance as it is."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    k = min(len(x), len(y))
    differ = np.flatnonzero(x[:k] != y[:k])
    begin = int(differ[0]) if len(differ) else k
    k -= begin
    differ = np.flatnonzero(x[len(x) - k :] != y[len(y) - k :])
    end = k - 1 - int(differ[-1]) if len(differ) else k
    return a[begin : len(a) - end], b[begin : len(b) - end]


def within(patterns: list[bytes], texts: list[bytes], edits: int) -> np.ndarray:
    """Whether each pattern, not longer than its text, is within ``edits`` byte edits of it."""
    middles = [x for pair in zip(patterns, texts, strict=True) for x in _middles(*pair)]
    at = np.arange(0, len(middles), 2)
    return _distances(Packed(middles, edits), at, at + 1, edits)


def kinds_of(texts: list[bytes]) -> np.ndarray:
    """How many bytes of each kind every line has."""
    out = np.zeros((len(texts), KINDS), np.int32)
    short = [i for i, t in enumerate(texts) if len(t) <= LONG]
    size = np.array([len(texts[i]) for i in short], np.int64)
    data = np.frombuffer(b"".join(texts[i] for i in short), np.uint8) % KINDS
    out[short] = np.bincount(np.repeat(np.arange(len(short)) * KINDS, size) + data, minlength=len(short) * KINDS).reshape(-1, KINDS)
    for i, t in enumerate(texts):
        if len(t) > LONG:
            out[i] = np.bincount(np.frombuffer(t, np.uint8) % KINDS, minlength=KINDS)
    return out


def clusters(lines_: np.ndarray, size: np.ndarray, kinds: np.ndarray, edits: int) -> Iterator[np.ndarray]:
    """The lines in sets of two or more, shortest first, of which no two within ``edits`` are in different sets.

    A replaced byte is one more of a kind and one less of another, an inserted one is one more, so lines
    whose numbers of bytes by kind differ by more than that allows are no neighbours."""
    rest = lines_[np.argsort(size[lines_], kind="stable")]
    while len(rest) > 1:
        queue, own, rest = [int(rest[0])], [], rest[1:]
        while queue:
            line = queue.pop()
            own.append(line)
            first, last = np.searchsorted(size[rest], [size[line] - edits, size[line] + edits + 1]).tolist()
            if first == last:
                continue
            some = rest[first:last]
            near = np.abs(kinds[some] - kinds[line]).sum(axis=1) + np.abs(size[some] - size[line]) <= 2 * edits
            if near.any():
                queue += some[near].tolist()
                rest = np.delete(rest, first + np.flatnonzero(near))
        if len(own) > 1:
            own = np.array(own)
            yield own[np.argsort(size[own], kind="stable")]


def sparse_pairs(own: np.ndarray, size: np.ndarray, kinds: np.ndarray, edits: int) -> np.ndarray | None:
    """All pairs of a cluster that need a distance, the shorter line first, unless they are many."""
    pairs, n = [], 0
    last = np.searchsorted(size[own], size[own] + edits, "right").tolist()
    for i, line in enumerate(own.tolist()):
        some = own[i + 1 : last[i]]
        if not len(some):
            continue
        some = some[np.abs(kinds[some] - kinds[line]).sum(axis=1) + size[some] - size[line] <= 2 * edits]
        pairs.append(np.stack([np.full(len(some), line), some]))
        n += len(some)
        if n > SPARSE * len(own):
            return None
    return np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)


def connected(groups: list[list[bytes]], edits: int) -> list[tuple[int, int]]:
    """Links that connect all lines of a group within ``edits`` of each other.

    Lines are numbered through all groups. A cluster of few pairs has all of them compared at once. Of
    others, each round takes a line of every cluster and compares it with those that nothing is linked to yet."""
    texts = [t for group in groups for t in group]
    packed, links, ends = Packed(texts, edits), [], np.cumsum([len(g) for g in groups])
    kinds = kinds_of(texts)
    size = packed.sizes

    def near(pattern: np.ndarray, text: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(pattern), bool)
        alike = np.abs(kinds[pattern] - kinds[text]).sum(axis=1) + size[text] - size[pattern] <= 2 * edits
        long = size[text] > LONG
        at = np.flatnonzero(alike & ~long)
        hit[at] = _distances(packed, pattern[at], text[at], edits)
        at = np.flatnonzero(alike & long)
        for part in np.split(at, np.flatnonzero(np.diff(np.cumsum(size[text[at]]) // CHUNK_BYTES)) + 1):
            hit[part] = within([texts[i] for i in pattern[part]], [texts[i] for i in text[part]], edits)
        return hit

    states, few = [], []  # lines to compare with the rest, and the rest, shortest first; pairs of sparse clusters
    for group, end in zip(groups, ends.tolist(), strict=True):
        for own in clusters(np.arange(end - len(group), end), size, kinds, edits):
            pairs = sparse_pairs(own, size, kinds, edits)
            states += [([], own)] if pairs is None else []
            few += [] if pairs is None else [pairs]
    if few:
        mine, theirs = np.concatenate(few, axis=1)
        hit = near(mine, theirs)
        links += zip(mine[hit].tolist(), theirs[hit].tolist(), strict=True)
    while states:
        asked, own, other = [], [], []
        for queue, rest in states:
            if not queue and len(rest):
                queue.append(int(rest[0]))
                rest = rest[1:]
            if not len(rest):
                continue
            line = queue.pop()
            first, last = np.searchsorted(size[rest], [size[line] - edits, size[line] + edits + 1])
            asked.append((queue, rest, int(first), int(last)))
            own.append(np.full(last - first, line))
            other.append(rest[first:last])
        if not asked:
            break
        mine, theirs = np.concatenate(own), np.concatenate(other)
        swap = size[mine] > size[theirs]
        hit = near(np.where(swap, theirs, mine), np.where(swap, mine, theirs))
        links += zip(mine[hit].tolist(), theirs[hit].tolist(), strict=True)
        states, at = [], 0
        for queue, rest, first, last in asked:
            found = hit[at : at + last - first]
            at += last - first
            states.append((queue + rest[first:last][found].tolist(), np.delete(rest, first + np.flatnonzero(found))))
    return links


def _links_under(group: pd.DataFrame, edits: int) -> pd.DataFrame:
    """Links between the lines sent to one bucket, lead by lead."""
    rows = group.drop_duplicates(["lead", "class"]).sort_values("lead", kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(rows["lead"].to_numpy()) != 0))
    lines_ = rows["line"].tolist()
    groups = [lines_[i:j] for i, j in zip(first.tolist(), [*first[1:].tolist(), len(rows)], strict=True)]
    classes = rows["class"].to_numpy()
    found = [(classes[i], classes[j]) for i, j in connected(groups, edits)]
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def inked(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each of the lines, which come in order and are all there are, has a byte that is no white space."""
    out = ends > starts
    if out.any():  # line breaks behind a line are white space, so it may end where the next one begins
        ink = np.frombuffer(data.tobytes().translate(INK), np.uint8)
        out[out] = np.maximum.reduceat(ink, starts[out]) > 0
    return out


def _long_lines(part: pa.RecordBatch, least: int) -> tuple[np.ndarray, ...]:
    """(prefix hashes, starts, ends, document, line number, hash) of the lines that count, none of them blank."""
    data, offsets = as_bytes(part.column("text"))
    starts, ends, doc = lines(data, offsets)
    number = np.arange(len(doc)) - np.searchsorted(doc, doc)
    keep = (ends - starts >= least) & inked(data, starts, ends)
    starts, ends = starts[keep], ends[keep]
    sums = prefix_hash(data)
    return sums, starts, ends, doc[keep], number[keep], span_hash(sums, starts, ends).view(np.int64)


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each value is in the ascending array, which is not sorted again as by ``np.isin``."""
    return np.searchsorted(ordered, values) < np.searchsorted(ordered, values, "right")


def line_components(table: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """(class, component) of the lines of (text) that are linked with another; a class is a line's hash."""
    if not 0 <= edits <= 20 or least < 1:
        raise ValueError("lines must have a byte or more, and edits be at most 20")
    spark = table.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal lines within a task are sent once
        for batch in batches:
            for part in slices(batch):
                sums, starts, ends, _, _, own = _long_lines(part, least)
                new = np.array([not (c in seen or seen.add(c)) for c in own.tolist()], bool)
                key, line = segment_keys(sums, starts[new], ends[new], edits)
                arrays = [pa.array(key.view(np.int64)), pa.array(own[new][line])]
                yield pa.RecordBatch.from_arrays(arrays, names=["token", "class"])

    keyed = table.select("text").mapInArrow(keys, "token long, class long")
    keyed = keyed.repartition(partitions, "token").sortWithinPartitions("token", "class")
    sent = keyed.mapInArrow(met, "token long, class long, lead long").select("lead", "class").distinct()
    sent = materialize(sent, "line-leads")
    wanted = materialize(sent.select("class").distinct(), "line-candidates")
    n = wanted.count()
    routes = route(sent, wanted.withColumn("weight", F.lit(1)), GROUP_LINES, max(partitions, -(-n // GROUP_LINES)))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch):
                data, _ = as_bytes(part.column("text"))
                _, starts, ends, _, _, own = _long_lines(part, least)
                new = np.ones(len(own), bool) if chosen is None else among(own, chosen.value)
                new[new] = [not (c in seen or seen.add(c)) for c in own[new].tolist()]
                raw = data.tobytes()
                found = [raw[s:e] for s, e in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(own[new]), pa.array(found, pa.binary())], names=["class", "line"])

    # A bounded list of lines goes to the tasks; a longer one meets all lines in a join.
    chosen = None
    if 8 * n <= BROADCAST_BYTES:
        chosen = spark.sparkContext.broadcast(np.sort(wanted.toArrow().column("class").to_numpy()))
    lines_ = table.select("text").mapInArrow(texts, "class long, line binary")
    routed = routes.join(lines_.withColumnRenamed("class", "_class"), F.col("class") == F.col("_class")).select("bucket", "lead", "class", "line")
    links = routed.groupBy("bucket").applyInPandas(lambda g: _links_under(g, edits), "a long, b long")
    return connected_components(links).withColumnRenamed("node", "class")


def _with_removals(table: DataFrame, edits: int, least: int) -> DataFrame:
    """(doc, text, ...) with ``gone``: the numbers of the lines that repeat an earlier one."""
    components = line_components(table.select("text"), edits, least)
    keyed = table.withColumn("_k", F.xxhash64(F.coalesce("text", F.lit(""))))
    kind = table.schema["doc"].dataType.simpleString()

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                _, _, _, doc, number, own = _long_lines(part, least)
                take = pa.array(doc)
                arrays = [part.column("doc").take(take), part.column("_k").take(take), pa.array(number.astype(np.int64)), pa.array(own)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc", "k", "number", "class"])

    found = keyed.select("doc", "_k", "text").mapInArrow(places, f"doc {kind}, k long, number long, class long")
    found = materialize(found, "line-places")
    place = F.struct("doc", "k", "number")
    known = found.groupBy("class").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    known = known.join(components.withColumnRenamed("class", "_class"), F.col("class") == F.col("_class"), "left")
    known = known.filter((F.col("first") != F.col("last")) | F.col("component").isNotNull())
    known = materialize(known.select("class", "first", F.coalesce("component", "class").alias("component")), "line-repeated")
    keep = known.groupBy("component").agg(F.min("first").alias("keep"))
    known = materialize(known.select("class", "component").join(keep, "component").select(F.col("class").alias("_class"), "keep"), "line-keepers")
    known = F.broadcast(known) if total_bytes(known)[0] <= BROADCAST_BYTES else known
    gone = found.join(known, F.col("class") == F.col("_class")).filter(~place.eqNullSafe(F.col("keep")))
    gone = gone.groupBy(F.col("doc").alias("_doc"), F.col("k").alias("_key")).agg(
        F.collect_set("number").alias("gone"), F.collect_set("keep.doc").alias("kept_in")
    )
    gone = materialize(gone, "line-removals")
    size = gone.select(F.sum(64 + 8 * F.size("gone") + 8 * F.size("kept_in"))).first()[0] or 0
    on = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("_k") == F.col("_key"))
    return keyed.join(F.broadcast(gone) if size <= BROADCAST_BYTES else gone, on, "left")


def _left(text: str | None, gone: list[int] | None) -> str | None:
    """The text without these lines."""
    if not gone or text is None:
        return text
    drop = set(gone)
    return "\n".join([line for i, line in enumerate(text.split("\n")) if i not in drop])


def count_lines(table: DataFrame, key: str, text: str, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """(key, n_lines, n_removed, kept_in, kept_sha256) of every row.

    ``kept_in``: the documents, in order, that keep the first occurrence of the lines removed here."""
    kind = table.schema[key].dataType.simpleString()
    rows = _with_removals(table.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("text")), edits, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                gone = part.column("gone").to_pylist()
                left = [_left(t, g) or "" for t, g in zip(texts, gone, strict=True)]
                arrays = [part.column("doc"), pa.array([(t or "").count("\n") + 1 for t in texts], pa.int64())]
                arrays += [pa.array([len(g or ()) for g in gone], pa.int64()), part.column("kept_in")]
                arrays += [pa.array([hashlib.sha256(t.encode()).hexdigest() for t in left], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[key, "n_lines", "n_removed", "kept_in", "kept_sha256"])

    rows = rows.select("doc", "text", "gone", F.array_sort(F.coalesce("kept_in", F.array().cast(f"array<{kind}>"))).alias("kept_in"))
    return rows.mapInArrow(run, f"`{key}` {kind}, n_lines long, n_removed long, kept_in array<{kind}>, kept_sha256 string")


def drop_repeats(table: DataFrame, key: str, text: str, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """The table with repeated lines taken out of the text; rows that lose all but blank lines are dropped."""
    names = table.columns
    own = F.struct(*[F.col(f"`{c}`") for c in names if c != text]).alias("row")
    rows = _with_removals(table.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("text"), own), edits, least)
    # JVM side: lines are numbered as split("\\n") gives them.
    kept = F.expr("array_join(filter(split(text, '\\n', -1), (line, i) -> NOT array_contains(gone, CAST(i AS BIGINT))), '\\n')")
    rows = rows.withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept))
    rows = rows.filter(F.col("gone").isNull() | F.col("text").rlike("[^\\x09-\\x0D ]"))
    return rows.select(*[F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in names])
