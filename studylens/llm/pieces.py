"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies with byte fallback.

The vocabulary is read from the model file; the encoding is our own: pairs of adjacent symbols
wait in a score-ordered agenda (``merges``). Text is cut where no piece of the vocabulary crosses,
so each stretch is merged on its own; words already met are taken from a bounded cache. In each
slice of an Arrow batch the words encoded anew are checked against the sentencepiece library.

Defined cases: a null text is encoded as an empty one (no ids); an empty table gives no rows;
repeated rows are encoded each; a very long word goes through a heap, so its time stays
n log n; columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merges import PairTable, merge_strings
from .textbytes import slices

CACHE_WORDS = 300_000
BLANK = "▁"  # stands for a space in pieces
BREAK = "\n"
CHECKED = 64  # stretches that the library checks in one text
NORMAL, BYTE, USER = 1, 6, 4


class PieceCodec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str, check: bool = True):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model_pb2

        model = model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        norm = model.normalizer_spec
        plain = model.trainer_spec.model_type == 2 and not norm.precompiled_charsmap and norm.add_dummy_prefix
        if not plain or norm.remove_extra_whitespaces or not norm.escape_whitespaces or any(p.type in (USER, 5) for p in model.pieces):
            raise ValueError("only merge-type models with plain normalisation are supported")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path) if check else None
        texts = [p.piece for p in model.pieces]
        ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        self.byte_id = [-1] * 256
        self.out = [t.replace(BLANK, " ").encode() for t in texts]  # bytes that an id stands for
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.byte_id[int(p.piece[3:5], 16)] = i
                self.out[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == 2:
                self.out[i] = (model.trainer_spec.unk_surface or " ⁇ ").encode()
            elif p.type == 3:
                self.out[i] = b""
        self.bytes_known = min(self.byte_id) >= 0
        self.text = [str(i) for i in range(len(texts))]
        # Symbols: pieces by id; a character without a piece is len(texts) + its code point.
        self.base = len(texts)
        pairs = {}
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                left, right = self._symbol(ids, piece[:cut]), self._symbol(ids, piece[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = i
        score = np.array([p.score for p in model.pieces])
        rank_of = np.searchsorted(np.unique(-score), -score)  # equal scores, equal rank
        self.pairs = {k: (int(rank_of[i]), i) for k, i in pairs.items()}
        keys, values = np.array(list(pairs), np.int64).reshape(-1, 2), np.array(list(pairs.values()), np.int64)
        self.table = PairTable(keys[:, 0], keys[:, 1], rank_of[values], values)
        characters = sorted({c for piece in ids for c in piece})
        self.code = np.zeros(0x110000, np.uint16)  # number of a character that occurs in pieces
        self.code[[ord(c) for c in characters]] = np.arange(1, len(characters) + 1)
        self.crossing = np.zeros((len(characters) + 1,) * 2, bool)
        for piece in ids:
            codes = self.code[[ord(c) for c in piece]]
            self.crossing[codes[:-1], codes[1:]] = True
        self.first = np.arange(0x110000, dtype=np.int32) + self.base
        for c, i in ids.items():
            if len(c) == 1:
                self.first[ord(c)] = i
        # Letters meet nothing but letters and leading blanks inside a piece, else cut at blanks only.
        letter = np.array([False, *[c.isalpha() for c in characters]])
        signs = "".join(re.escape(c) for c in characters if re.fullmatch(r"[^\W\d_]", c) and not c.isalpha())
        blank = np.array([False, *[c == BLANK for c in characters]])
        apart = not self.crossing[np.ix_(letter, ~letter)].any() and not self.crossing[np.ix_(~letter & ~blank, letter)].any()
        if self.crossing[np.ix_(~blank, blank)].any() or self.code[ord(BREAK)]:
            raise ValueError("a piece of this model crosses a word border or a line break")
        self.stretch = re.compile(
            f"{BLANK}*[^\\W\\d_{signs}]+|{BLANK}*(?:(?!{BLANK})[\\W\\d_{signs}])+|{BLANK}+" if apart else f"{BLANK}*[^{BLANK}]+|{BLANK}+"
        )
        self.cache: dict[str, str] = {}  # stretch -> its ids as text
        self.odd: dict[str, bytes] = {}  # stretches that decode to something else than themselves

    def _symbol(self, ids: dict[str, int], piece: str) -> int | None:
        return ids.get(piece, self.base + ord(piece) if len(piece) == 1 else None)

    def _merge(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each already with its blanks, one after the other, and their offsets."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
        if not len(points):
            return np.zeros(0, np.int64), ends
        codes = self.code[points]
        cut = np.ones(len(points) + 1, bool)
        cut[1:-1] = ~self.crossing[codes[:-1], codes[1:]]
        cut[ends] = True
        offsets = np.flatnonzero(cut)
        symbols, merged = merge_strings(self.first[points], offsets, self.table, self.pairs)
        at = merged[np.searchsorted(offsets, ends)]
        unknown = np.flatnonzero(symbols >= self.base)
        if not len(unknown):
            return symbols, at
        # Characters without a piece become the pieces of their bytes.
        spelled = [[self.unknown] if not self.bytes_known else [self.byte_id[b] for b in chr(s - self.base).encode()] for s in symbols[unknown]]
        width = np.ones(len(symbols), np.int64)
        width[unknown] = [len(s) for s in spelled]
        starts = np.concatenate([[0], np.cumsum(width)])
        out = np.repeat(symbols, width)
        for i, s in zip(unknown, spelled, strict=True):
            out[starts[i] : starts[i + 1]] = s
        return out, starts[at]

    def _learn(self, words: list[str]) -> None:
        """Encodes stretches into the cache; the library must agree on each."""
        ids, at = self._merge(words)
        flat, ends = ids.tolist(), at.tolist()
        if self.library is not None and words:
            # Many stretches make one text for the library, behind a sign that no piece holds.
            texts = [BREAK + BREAK.join(words[i : i + CHECKED]) for i in range(0, len(words), CHECKED)]
            theirs = np.fromiter(chain.from_iterable(self.library.encode(texts, num_threads=1)), np.int64)
            blank, sign = self.library.encode(BREAK)
            mine = np.insert(ids, at[:-1], sign)
            mine = np.insert(mine, (at[:-1] + np.arange(len(words)))[::CHECKED], blank)
            if not np.array_equal(mine, theirs):
                raise AssertionError("encoding differs from the sentencepiece library")
        text, out = self.text, self.out
        digits = [text[j] for j in flat]
        self.cache.update((w, ",".join(digits[ends[i] : ends[i + 1]])) for i, w in enumerate(words))
        if b"".join([out[j] for j in flat]) != "".join(words).replace(BLANK, " ").encode():
            for i, word in enumerate(words):
                decoded = b"".join([out[j] for j in flat[ends[i] : ends[i + 1]]])
                if decoded != word.replace(BLANK, " ").encode():
                    self.odd[word] = decoded

    def split(self, text: str) -> list[str]:
        """Stretches that no piece crosses: blanks with the letters or the other characters behind."""
        return self.stretch.findall(BLANK + text.replace(" ", BLANK)) if text else []

    def encode(self, text: str) -> list[int]:
        return self._merge(self.split(text))[0].tolist()

    def decode(self, ids: Sequence[int]) -> str:
        """Bytes of the pieces in order, less the blank that encoding put first."""
        whole = b"".join([self.out[i] for i in ids])
        if ids and self.out[ids[0]].startswith(b" ") and whole.startswith(b" "):
            whole = whole[1:]
        return whole.decode("utf-8", "replace")

    def digests(self, texts: Sequence[str]) -> list[tuple[int, str, str]]:
        """For each text: number of ids, hash of the ids, hash of the text decoded from them."""
        split = [self.split(t) for t in texts]
        cache, odd = self.cache, self.odd
        if len(cache) > CACHE_WORDS:
            cache.clear()
            odd.clear()
        new = set().union(*split).difference(cache)
        if new:
            self._learn(list(new))
        rows = []
        for words in split:
            ids = ",".join([cache[w] for w in words])
            if odd and not odd.keys().isdisjoint(words):
                decoded = b"".join([odd.get(w) or w.replace(BLANK, " ").encode() for w in words])[1:].decode("utf-8", "replace")
            else:
                decoded = "".join(words).replace(BLANK, " ")[1:]
            rows.append((ids.count(",") + 1 if words else 0, _sha(ids), _sha(decoded)))
        return rows


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One codec per model and worker."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def encode_texts(table: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, ids array<int>) of every row."""
    schema = f"`{key}` {table.schema[key].dataType.simpleString()}, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in slices(batch, text):
                ids = [own.encode(t or "") for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return table.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, schema)


def decode_texts(table: DataFrame, key: str, ids: str, path: str) -> DataFrame:
    """(key, text) of every row of ids."""
    schema = f"`{key}` {table.schema[key].dataType.simpleString()}, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [own.decode(i or []) for i in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(texts, pa.string())], names=[key, "text"])

    return table.select(F.col(f"`{key}`"), F.col(f"`{ids}`")).mapInArrow(run, schema)


def encode_digests(table: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row, ids and texts staying in the task."""
    schema = f"`{key}` {table.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in slices(batch, text):
                rows = own.digests([t or "" for t in part.column(text).to_pylist()])
                counts, ids, decoded = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                    names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return table.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, schema)
