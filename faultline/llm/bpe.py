"""Byte-level BPE encoding and decoding through a sentencepiece model serialised from a rank file."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow

#: Pre-tokens whose ids a Python worker remembers; the table is emptied when it is full.
REMEMBERED = 200_000
#: Pre-tokens longer than this are encoded without being remembered.
REMEMBERED_LENGTH = 64


def byte_alphabet() -> list[str]:
    """A printable character for each byte: printable Latin-1 stands for itself, the rest for U+0100 onwards."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    other = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [other.get(b, chr(b)) for b in range(256)]


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """A rank file: a line for each token, its bytes in base 64, then its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, b: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(b)) + b


def _float(field: int, x: float) -> bytes:
    return _varint(field << 3 | 5) + struct.pack("<f", x)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model: piece i is the token of rank i in the byte alphabet, its score -i; the unknown piece is last.

    The normaliser is the identity: no dummy prefix, white space neither removed nor escaped. Ranks must be 0, 1, ...
    without gaps and hold every byte, so that no input is unknown.
    """
    tokens = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in tokens] != list(range(len(tokens))) or not all(bytes([b]) in ranks for b in range(256)):
        raise ValueError("ranks must be gapless from 0 and hold all single bytes")
    alphabet = byte_alphabet()
    # Field numbers of the public model format. Piece: 1 piece, 2 score, 3 type (1 normal, 2 unknown).
    pieces = [_bytes(1, _bytes(1, "".join(alphabet[b] for b in t).encode()) + _float(2, -float(i)) + _number(3, 1)) for i, t in enumerate(tokens)]
    pieces.append(_bytes(1, _bytes(1, b"<unk>") + _float(2, 0.0) + _number(3, 2)))
    # Trainer: 3 model type (2 BPE), 4 vocabulary size, 40 to 43 the ids of unk, bos, eos, pad (-1: none).
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(40, len(tokens)) + b"".join(_number(f, -1) for f in (41, 42, 43))
    # Normaliser: 1 name, 3 dummy prefix, 4 remove extra white space, 5 escape white space.
    normaliser = _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _bytes(2, trainer) + _bytes(3, normaliser)


_CODECS: dict[str, "Codec"] = {}


def codec_for(name: str, ranks, pattern: str) -> "Codec":
    """The worker process's own codec, kept from task to task."""
    if name not in _CODECS:
        _CODECS.clear()
        _CODECS[name] = Codec(ranks.value, pattern)
    return _CODECS[name]


class Codec:
    """Encodes pre-tokens one by one with the sentencepiece model; a pre-token that is itself a token keeps its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.ranks, self.tokens = ranks, sorted(ranks, key=ranks.get)
        self.find = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        self.table = {b: c for b, c in enumerate(byte_alphabet())}
        self.known: dict[str, list[int]] = {}

    def _encode(self, word: str) -> list[int]:
        raw = word.encode("utf-8")
        rank = self.ranks.get(raw)
        ids = [rank] if rank is not None else self.model.encode(raw.decode("latin-1").translate(self.table))
        if len(word) <= REMEMBERED_LENGTH:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        known, slow, out = self.known.get, self._encode, []
        for word in self.find(text):
            out += known(word) or slow(word)
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep_ids: bool = False) -> DataFrame:
    """One row per document: the number of tokens, and SHA-256 of the ids and of the bytes decoded from them.

    Equal to encoding each match of the pattern by the ranks, lowest rank first. A null text is empty: no ids, and the
    digests of no bytes. keep_ids adds the ids themselves. Nothing is shuffled; repeated rows, ties in doc_id and
    extra columns have no influence. The vocabulary (about a megabyte) is sent to the executors once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    name = uuid.uuid4().hex

    def run(batch):
        codec, n, ids_sha, back_sha, kept = codec_for(name, shared, pattern), [], [], [], []
        for text in batch.column("text").to_pylist():
            ids = codec.encode(text or "")
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
            back_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            if keep_ids:
                kept.append(ids)
        out = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": ids_sha, "decoded_sha256": back_sha}
        return out | ({"ids": pa.array(kept, pa.list_(pa.int32()))} if keep_ids else {})

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The rank file at a path that the driver or Spark can open."""
    if "://" in path:
        return parse_ranks(spark.read.format("binaryFile").load(path).first()["content"])
    with open(path, "rb") as f:
        return parse_ranks(f.read())
