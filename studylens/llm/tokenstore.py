"""Token ids in binary files: one zstandard frame for each document, one dictionary for all.

1. ``train``: a bounded sample of documents is encoded, and a zstandard dictionary is trained on the
   serialized id arrays. The sample shapes the dictionary only, never what is stored.
2. ``write``: every text is encoded and its ids (little-endian, two bytes where the vocabulary
   allows it, else four) become a frame of their own. The frames are sorted by key in ranges, and
   every range is streamed into a file. Files have names of their own for every attempt of a task;
   only those that finished tasks name in the index belong to the store.
3. ``read`` decodes any set of documents: the index has the file, the offset and the size of
   each frame, so a short document costs a short read. A file whose dictionary hash differs
   from the store's, or whose frame does not hold what the index says, ends the job.

A file: magic, width of an id in bytes (1 byte), SHA-256 of the dictionary (32 bytes), the frames, and
then, little-endian in 8 bytes each, the offset of every frame and of the end of the last,
the number of frames, and the magic again. So a file can also be read without the index.

Ids are those of the ``tokenizers`` library for the file given; see ``ByteCodec`` for how they are found.

The folder's scheme must be one that pyarrow can write (local or mounted, hdfs, s3, gs).

Defined cases: a null text is an empty one, whose document is the end id alone; rows without a key
come first; rows with equal keys are ordered by their ids, repeated rows are stored each; an empty table
gives an empty store; texts are encoded whole, whatever their length; columns other than the key and
the text are not looked at, and the key may have any name.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.materialize import materialize, shared_folder
from ..operators.prefix import running_total
from .textbytes import slices

MAGIC = b"IDSTORE1"
# The dictionary is trained on at most this many documents, the first ones by a hash of their key, of at most so many bytes.
SAMPLE_DOCUMENTS = 1000
SAMPLE_BYTES = 16_384
DICTIONARY_BYTES = 65_536
LEVEL = 3
FILE_BYTES = 32 << 20  # frames in a file
LEAST_FILE_BYTES = 1 << 20  # for the sake of parallel work, small stores have smaller files
READ_BYTES = 8 << 20
_INDEX = "shard int, file string, nth long, offset long, size long, local long, n_tokens long"

# Fixed value: how byte-level files of this kind split a text before merging.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> dict[str, int]:
    """The byte that each printable stand-in of byte-level vocabularies means."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)).difference(shown))
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteCodec:
    """Ids of texts under one ``tokenizers`` file.

    A plain byte-level file, in which every token is a byte or comes from a merge and later merges make
    larger ids, is also a table of ranks; ``tiktoken`` merges those several times faster. Texts
    that spell a special token go through the file's own library, and so does the first text of every
    call, as a check: should the two ever differ, the library encodes the whole call.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = tuple(t["content"] for t in spec["added_tokens"])
        ranks = None if spec["normalizer"] else self._ranks(spec["pre_tokenizer"] or {}, spec["model"])
        self.fast = ranks and tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _ranks(self, before: dict, model: dict) -> dict[bytes, int] | None:
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if not plain or model["type"] != "BPE" or any(model.get(o) for o in odd):
            return None
        stands = byte_characters()
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.special}
        ids = [vocab.get(t, -1) for t in merged]
        if vocab.keys() != stands.keys() | set(merged) or ids != sorted(set(ids)) or min(ids, default=0) < 0:
            return None
        return {bytes(stands[c] for c in t): i for t, i in vocab.items()}

    def _by_library(self, texts: Sequence[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(list(texts), add_special_tokens=False)]

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Serialized ids of each text."""
        if not self.fast or not texts:
            return self._by_library(texts)
        found = [
            self._by_library([t])[0] if any(s in t for s in self.special) else np.array(self.fast.encode_ordinary(t), self.kind).tobytes()
            for t in texts
        ]
        return found if found[0] == self._by_library(texts[:1])[0] else self._by_library(texts)


_codecs: dict[str, ByteCodec] = {}


def codec(path: str) -> ByteCodec:
    """One codec per file and worker."""
    if path not in _codecs:
        _codecs[path] = ByteCodec(path)
    return _codecs[path]


@dataclass(frozen=True)
class TokenStore:
    """What ``read`` needs: the index (one row for each document, in key order by shard and nth) and the dictionary."""

    spark: SparkSession
    folder: str
    key: str
    index: str
    dictionary: bytes
    width: int
    frame_bytes: int

    @property
    def dictionary_hash(self) -> str:
        return hashlib.sha256(self.dictionary).hexdigest()


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def _filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", folder))


def train(table: DataFrame, key: str, text: str, path: str, end_id: int = 0, size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary for the ids of short documents; empty where there is nothing to learn from."""
    texts = table.select(
        F.xxhash64(F.col(f"`{key}`"), F.monotonically_increasing_id()).alias("h"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")
    )
    # About three times as many as are taken, so that what meets in one task doesn't grow with the table.
    share = min(1.0, 3 * SAMPLE_DOCUMENTS / max(1, table.count()))
    few = texts.filter((F.octet_length("t") <= SAMPLE_BYTES) & (F.col("h") <= int(share * 2**64) - 2**63 - 1))
    sample = few.orderBy("h").limit(SAMPLE_DOCUMENTS)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        mark = np.array([end_id], own.kind).tobytes()
        found = [raw + mark for batch in batches for raw in own.encode(batch.column("t").to_pylist())]
        if not found:
            return
        try:
            data = zstandard.train_dictionary(size, found).as_bytes()
        except zstandard.ZstdError:  # too little to train on: the ids themselves serve as content
            data = b"".join(found)[-size:]
        yield pa.RecordBatch.from_arrays([pa.array([data if len(data) >= 8 else b""], pa.binary())], names=["d"])

    trained = sample.coalesce(1).select("t").mapInArrow(learn, "d binary").collect()
    return bytes(trained[0]["d"]) if trained else b""


def _frames(table: DataFrame, key: str, text: str, path: str, end_id: int, dictionary: bytes) -> DataFrame:
    """(key, tie, n_tokens, frame) of every document; ``tie`` orders equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        mark = np.array([end_id], own.kind).tobytes()
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary), write_dict_id=False)
        for batch in batches:
            for part in slices(batch, "t"):
                raw = [ids + mark for ids in own.encode([t or "" for t in part.column("t").to_pylist()])]
                columns = [
                    part.column("k"),
                    pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                    pa.array([len(r) // own.kind.itemsize for r in raw], pa.int64()),
                    pa.array([packer.compress(r) for r in raw], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "tie", "n_tokens", "frame"])

    kind = table.schema[key].dataType.simpleString()
    named = table.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    return named.mapInArrow(run, f"k {kind}, tie long, n_tokens long, frame binary")


def write(
    table: DataFrame, key: str, text: str, path: str, folder: str | None = None, end_id: int = 0,
    dictionary: bytes | None = None, file_bytes: int = FILE_BYTES,
) -> TokenStore:
    """Encodes every text and writes the ids in order of the keys; ``folder`` is made in the shared one if not given."""
    spark = table.sparkSession
    folder = folder or f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/token-files-{uuid.uuid4().hex}"
    dictionary = train(table, key, text, path, end_id) if dictionary is None else dictionary
    width = codec(path).kind.itemsize
    head = MAGIC + bytes([width]) + hashlib.sha256(dictionary).digest()
    frames = materialize(_frames(table, key, text, path, end_id, dictionary), "token-frames")
    total = frames.agg(F.sum(F.octet_length("frame") + 32)).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = max(1, -(-total // file_bytes), min(tasks, total // LEAST_FILE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, out, names, at, offsets, local = TaskContext.get().partitionId(), None, "", 0, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                store, place = _filesystem(folder)
                store.create_dir(place, recursive=True)
                names = f"ids-{shard:07d}-{uuid.uuid4().hex}.bin"
                out = store.open_output_stream(f"{place}/{names}")
                out.write(head)
                at = len(head)
            data = batch.column("frame").to_pylist()
            sizes = np.array([len(d) for d in data], np.int64)
            n = batch.column("n_tokens").to_numpy()
            starts = at + np.cumsum(sizes) - sizes
            out.write(b"".join(data))
            columns = [batch.column("k"), pa.array([shard] * len(data), pa.int32()), pa.array([names] * len(data))]
            columns += [pa.array(c, pa.int64()) for c in (np.arange(len(data)) + len(offsets), starts, sizes, local + np.cumsum(n) - n, n)]
            offsets += starts.tolist()
            at, local = int(at + sizes.sum()), int(local + n.sum())
            yield pa.RecordBatch.from_arrays(columns, names=["k", "shard", "file", "nth", "offset", "size", "local", "n_tokens"])
        if out is not None:
            out.write(np.array([*offsets, at, len(offsets)], "<u8").tobytes() + MAGIC)
            out.close()

    # The last key splits a run of equal rows, so that no key has to fit in one file.
    keys = ["k", "tie", "n_tokens", "spread"]
    dealt = frames.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(files, *keys).sortWithinPartitions(*keys)
    kind = frames.schema["k"].dataType.simpleString()
    dealt.select("k", "n_tokens", "frame").mapInArrow(run, f"k {kind}, {_INDEX}").write.parquet(f"{folder}/documents")
    shards = spark.read.parquet(f"{folder}/documents").groupBy("shard").agg(F.sum("n_tokens").alias("tokens"))
    running_total(materialize(shards, "token-shards"), ["shard"], "tokens", "base").write.parquet(f"{folder}/shards")
    store, place = _filesystem(folder)
    with store.open_output_stream(f"{place}/dictionary.bin") as out:
        out.write(dictionary)
    return TokenStore(spark, folder, key, f"k {kind}, {_INDEX}", dictionary, width, total)


def open_store(spark: SparkSession, folder: str, key: str = "key") -> TokenStore:
    """A store that was written before; its key column is called ``key`` here."""
    store, place = _filesystem(folder)
    with store.open_input_file(f"{place}/dictionary.bin") as file:
        dictionary = file.read()
    documents = spark.read.parquet(f"{folder}/documents")
    total = documents.agg(F.sum("size")).first()[0] or 0
    one = documents.select("file").limit(1).collect()
    width = 4
    if one:
        with store.open_input_file(f"{place}/{one[0]['file']}") as file:
            width = file.read(len(MAGIC) + 1)[-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    return TokenStore(spark, folder, key, schema, dictionary, width, total)


class _Reader:
    """Frames of the files of one store, one open file at a time."""

    def __init__(self, folder: str, head: bytes, dictionary: bytes):
        self.store, self.place = _filesystem(folder)
        self.head, self.name, self.file = head, None, None
        self.unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress

    def _open(self, name: str) -> None:
        if name == self.name:
            return
        self.close()
        self.name, self.file = name, self.store.open_input_file(f"{self.place}/{name}")
        if self.file.read_at(len(self.head), 0) != self.head:
            raise ValueError(f"{name} was not written with this store's dictionary")

    def close(self) -> None:
        if self.file is not None:
            self.file.close()

    def ids(self, name: str, offsets: np.ndarray, sizes: np.ndarray) -> Iterator[bytes]:
        """Serialized ids of frames of one file, given in order of their offsets; neighbours are read together."""
        self._open(name)
        first = 0
        while first < len(offsets):
            last = first + 1
            while last < len(offsets) and offsets[last] == offsets[last - 1] + sizes[last - 1] and offsets[last] + sizes[last] - offsets[first] <= READ_BYTES:
                last += 1
            begin = int(offsets[first])
            data = self.file.read_at(int(offsets[last - 1] + sizes[last - 1]) - begin, begin)
            for o, s in zip(offsets[first:last].tolist(), sizes[first:last].tolist(), strict=True):
                yield self.unpack(data[o - begin : o - begin + s])
            first = last


def read(store: TokenStore, keys: DataFrame | None = None, with_ids: bool = True) -> DataFrame:
    """(key, start, n_tokens, ids_crc32[, ids]) from the files, of all documents or of those whose key is in ``keys``.

    ``start`` counts the ids of all documents before; ``ids_crc32`` is taken of the ids as
    little-endian unsigned 32-bit integers.
    """
    spark, folder, dictionary = store.spark, store.folder, store.dictionary
    kind, head = np.dtype(f"<u{store.width}"), MAGIC + bytes([store.width]) + hashlib.sha256(dictionary).digest()
    documents = spark.read.schema(store.index).parquet(f"{folder}/documents")
    if keys is not None:
        documents = documents.join(keys.select(F.col(keys.columns[0]).alias("k")), "k", "left_semi")
    documents = documents.join(spark.read.schema("shard int, tokens long, base long").parquet(f"{folder}/shards"), "shard")
    # The index is small beside the frames, so tasks are made by what there is to read; neighbours stay together.
    tasks = max(1, store.frame_bytes // READ_BYTES, min(int(spark.conf.get("spark.sql.shuffle.partitions")), store.frame_bytes // LEAST_FILE_BYTES))
    wanted = documents.select("k", "file", "offset", "size", (F.col("base") + F.col("local")).alias("start"), "n_tokens", (F.col("nth") / 512).cast("long").alias("near"))
    wanted = wanted.repartition(tasks, "file", "near").sortWithinPartitions("file", "offset").drop("near")
    # Columns travel under numbers, so the key may have any name.
    schema = f"k {spark.read.schema(store.index).parquet(f'{folder}/documents').schema['k'].dataType.simpleString()}, s long, n long, c long"
    schema += ", ids array<int>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(folder, head, dictionary)
        for batch in batches:
            names = batch.column("file").to_pylist()
            offsets, sizes, n = (batch.column(c).to_numpy() for c in ("offset", "size", "n_tokens"))
            borders = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            crc, ids = [], []
            for first, last in zip(borders, borders[1:], strict=False):
                if first == last:
                    continue
                for raw in reader.ids(names[first], offsets[first:last], sizes[first:last]):
                    own = np.frombuffer(raw, kind).astype("<u4")
                    if len(own) != n[len(crc)]:
                        raise ValueError(f"{names[first]} does not hold what the index says")
                    crc.append(zlib.crc32(own.tobytes()))
                    if with_ids:
                        ids.append(own.astype(np.int32))
            columns = [batch.column("k"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())]
            columns += [pa.array(ids, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays(columns, names=["k", "s", "n", "c", "ids"][: len(columns)])
        reader.close()

    found = wanted.mapInArrow(run, schema)
    return found.toDF(store.key, "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
