"""Byte-level BPE through sentencepiece.

A rank file (base64 token, rank) becomes a sentencepiece model of type BPE, serialised here as the protobuf that the
library loads: each token's bytes are mapped to printable characters, its score is its negative rank, the normaliser is
the identity. Sentencepiece merges the best-scored pair first, which is the pair of lowest rank. A text is split by the
pre-token pattern and each pre-token encoded by itself; ids are the ranks. Decoding maps each id back to its bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, fresh, table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Pre-tokens whose ids a worker remembers, and the longest that it remembers; beyond, it starts anew.
CACHE, CACHE_LEN = 400_000, 64


def byte_chars() -> list[str]:
    """A distinct printable character for each byte: visible Latin-1 bytes stand for themselves, others follow U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | str | int | float) -> bytes:
    """A protobuf field: text and bytes by length, int as varint, float in 4 bytes."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    data = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto of type BPE for `ranks`; piece 0 is the unknown piece that the format demands."""
    chars = byte_chars()
    pieces = [_field(1, "<unk>") + _field(2, 0.0) + _field(3, 2)]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        pieces.append(_field(1, "".join(chars[b] for b in token)) + _field(2, -float(rank)) + _field(3, 1))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(35, 0) + _field(40, 0)
    trainer += b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))  # no begin, end or padding piece
    normaliser = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class ByteBpe:
    """Encodes and decodes as the rank file says; one to a Python worker."""

    _loaded: dict[tuple[str, str], ByteBpe] = {}

    def __init__(self, path: str = RANKS, pattern: str = PATTERN) -> None:
        self.ranks = read_ranks(path)
        model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        chars = byte_chars()
        self.chars = {b: c for b, c in enumerate(chars)}
        self.model = model
        by_piece = {"".join(chars[b] for b in token): rank for token, rank in self.ranks.items()}
        self.rank_of_piece = np.array([by_piece.get(model.id_to_piece(i), 0) for i in range(model.get_piece_size())], "<u4")
        top = max(self.ranks.values())
        self.tokens = [b""] * (top + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> ByteBpe:
        if (path, pattern) not in cls._loaded:
            cls._loaded[path, pattern] = cls(path, pattern)
        return cls._loaded[path, pattern]

    def _packed(self, word: str) -> bytes:
        data = word.encode()
        rank = self.ranks.get(data)
        if rank is not None:
            out = struct.pack("<I", rank)
        else:
            ids = self.model.encode(data.decode("latin-1").translate(self.chars))
            out = self.rank_of_piece[ids].tobytes()
        if len(word) <= CACHE_LEN:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        words = self.split(text)
        known = list(map(self.cache.get, words))
        if None in known:
            for i, x in enumerate(known):
                if x is None:
                    known[i] = self.cache.get(words[i]) or self._packed(words[i])
        return b"".join(known)

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


def encode_texts(
    docs: DataFrame, text_col: str = "text", path: str = RANKS, pattern: str = PATTERN, ids_col: str = "ids", decoded_col: str = "decoded"
) -> DataFrame:
    """`docs` without `text_col`, with `ids` (binary: little-endian unsigned 32-bit ids) and `decoded` (binary: the ids' bytes).

    A null text is encoded as an empty one: no ids, no bytes. Strings of special tokens are ordinary text. Whole texts
    are encoded, however long; rows keep their number, and other columns pass through. A clash of names with `docs`
    adds a leading underscore to the added column.
    """
    other = [c for c in docs.columns if c != text_col]
    ids_name, decoded_name = fresh(docs.select(*other), ids_col, decoded_col)
    schema = extended(docs.select(*other), (ids_name, "binary"), (decoded_name, "binary"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.of(path, pattern)
        for batch in batches:
            ids = [bpe.encode(x or "") for x in batch.column(len(other)).to_pylist()]
            columns = [*batch.columns[: len(other)], pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*other, text_col).mapInArrow(encode, schema)


def decode_ids(encoded: DataFrame, ids_col: str = "ids", path: str = RANKS, pattern: str = PATTERN, decoded_col: str = "decoded") -> DataFrame:
    """`encoded` with the bytes that its binary `ids_col` stands for; null ids decode to no bytes."""
    (name,) = fresh(encoded, decoded_col)
    schema, at = extended(encoded, (name, "binary")), encoded.columns.index(ids_col)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.of(path, pattern)
        for batch in batches:
            out = pa.array([bpe.decode(x or b"") for x in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=schema.names)

    return encoded.mapInArrow(decode, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """n_tokens and the SHA-256 of ids and decoded bytes, next to doc_id."""
    ids = F.sha2("ids", 256).alias("ids_sha256")
    return encoded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), ids, F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of `documents`, by encode_texts(), which states the odd cases."""
    return digests(encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text")))
