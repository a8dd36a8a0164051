"""Byte-level BPE encoding and decoding through a sentencepiece model.

The rank file of a byte-level BPE becomes a sentencepiece BPE model, written
field by field: one piece for each token, its bytes mapped to the characters
from U+0100 on, its score the negative rank, no normalisation. Sentencepiece
then merges the best-scored neighbours first, which is the order of the ranks.

Texts are cut before single spaces, where a pre-token of the pattern is sure to
end, and the parts split by the pattern; a pre-token that is a token itself
takes that token's id, and others are encoded once. Parts and their ids are kept
in a bounded cache of the worker. Memory of a task: one Arrow batch of texts and the cache.

Null text: no ids (an empty list). Empty text: an empty list. Nulls among ids
and ids outside the vocabulary are an error in decode(); a null list decodes
to empty bytes. Rows are mapped one to one, so repeated rows, other columns
and empty tables need nothing; an existing output column is replaced.
"""

from __future__ import annotations

import base64
import struct
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from itemlake.llm.common import small_batches

CACHE = 1 << 18  # pre-tokens in each half of a worker's cache


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protobuf field: bytes by length, int as varint, float as 32 bits."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


#: Byte b as a character that no normaliser touches and that is no white space.
_TO_CHARS = {b: chr(0x100 + b) for b in range(256)}


def mapped(piece: bytes) -> str:
    return piece.decode("latin-1").translate(_TO_CHARS)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece ModelProto; its pieces are the tokens in the order of ranks.

    The last piece is the unknown one that the library demands; all 256 bytes
    are tokens, so it is never met.
    """
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"not byte-level: no token for the bytes {missing[:5]}")
    normal, unknown, bpe = 1, 2, 2  # values of the format's enumerations
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        out.append(_field(1, _field(1, mapped(token).encode()) + _field(2, -float(rank)) + _field(3, normal)))
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(ranks) + 1) + _field(40, len(ranks)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    identity = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join([*out, _field(2, trainer), _field(3, identity)])


class Codec:
    """One worker's encoder and decoder for a rank file and a pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        by_rank = sorted(self.ranks.items(), key=lambda x: x[1])
        self.ids = [rank for _, rank in by_rank]  # by piece
        if self.ids == list(range(len(self.ids))):
            self.ids = None
        size = by_rank[-1][1] + 1
        lengths = np.full(size, -1, dtype=np.int64)
        lengths[[rank for _, rank in by_rank]] = [len(token) for token, _ in by_rank]
        self.lengths, self.begin = lengths, np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
        self.joined = np.frombuffer(b"".join(token for token, _ in by_rank), dtype=np.uint8)
        self.split = regex.compile(pattern).findall
        self.blank_pairs = regex.compile(r" \s|\s ").search
        self.before_words = regex.compile(r"(?<=\S)(?= \S)", regex.V1).split
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.ranks))
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def units(self, text: str) -> list[str]:
        """The text, cut before each space between two characters that are no white space.

        No pre-token holds such a space after another character, so a text's
        ids are those of its units, of which most are one known word.
        """
        if "\0" in text or self.blank_pairs(text):
            return self.before_words(text)
        return text.replace(" ", "\0 ").split("\0")

    def _learn(self, units: set[str]) -> None:
        """Bring the ids of all these units, as bytes, into the cache."""
        if len(self.young) > CACHE:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        new: dict[str, list[str]] = {}
        for unit in units.difference(young):
            known = old.get(unit)
            if known is None:
                new[unit] = self.split(unit)
            else:
                young[unit] = known
        merge = []
        for piece in set(chain.from_iterable(new.values())).difference(young):
            rank = self.ranks.get(piece.encode())
            if rank is None:
                merge.append(piece)
            else:
                young[piece] = array("i", (rank,)).tobytes()
        if merge:
            for piece, found in zip(merge, self.model.encode([mapped(p.encode()) for p in merge], num_threads=1)):
                young[piece] = array("i", found if self.ids is None else [self.ids[i] for i in found]).tobytes()
        for unit, pieces in new.items():
            young[unit] = b"".join(map(young.__getitem__, pieces))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as 32-bit integers, one after the other; new units of all texts are encoded together."""
        cut = [self.units(t) if t else () for t in texts]
        self._learn(set().union(*cut))
        known = self.young.__getitem__
        return [b"".join(map(known, units)) for units in cut]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All the bytes of these ids, and the place where each id's begin (with the end)."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths) or (self.lengths[ids] < 0).any()):
            raise ValueError("an id is not in the vocabulary")
        n = self.lengths[ids]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[ids] - ends + n, n)
        return self.joined[at], np.concatenate([[0], ends])


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(text: Column, path: str, pattern: str) -> Column:
    """Ids (array of int) of each text; path must be readable on every worker."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def ids_of(texts: pa.Array) -> pa.Array:
        own = codec(path, pattern)
        parts = own.encode(texts.to_pylist())
        ends = np.cumsum([0, *map(len, parts)]) // 4
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), dtype=np.int32), pa.int32()))

    return ids_of(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """Bytes (binary) of each list of ids."""

    @F.arrow_udf(BinaryType())
    def bytes_of(lists: pa.Array) -> pa.Array:
        lists = lists.fill_null([])
        flat = lists.flatten()
        if flat.null_count:
            raise ValueError("a null is no id")
        raw, places = codec(path, pattern).decode(flat.to_numpy())
        ends = places[np.cumsum([0, *lists.value_lengths().to_pylist()])].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends), pa.py_buffer(raw)])

    return bytes_of(ids)


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.withColumn(ids, encode(F.col(text), path, pattern))


def decode_documents(docs: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.withColumn(decoded, decode(F.col(ids), path, pattern))
