"""Token shards as files: a 32-byte little-endian header (magic, version, width, vocabulary, end of text, tokens), ids of 2 or 4 bytes, a SHA-256 of all before."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a file begins with, and the version of the layout.
MAGIC, VERSION = b"MMTOKENS", 1


def encode_shard(tokens, vocabulary: int, eos: int) -> bytes:
    width = 2 if vocabulary <= 65_536 else 4
    body = MAGIC + struct.pack("<IIIIQ", VERSION, width, vocabulary, eos, len(tokens)) + np.asarray(tokens, f"<u{width}").tobytes()
    return body + hashlib.sha256(body).digest()


def decode_shard(content: bytes) -> tuple[int, int, list[int]]:
    """(vocabulary, eos, tokens); ValueError names the first thing that is wrong."""
    if len(content) < 64:
        raise ValueError("too short")
    if content[:8] != MAGIC:
        raise ValueError("not a shard")
    version, width, vocabulary, eos, n = struct.unpack("<IIIIQ", content[8:32])
    if version != VERSION:
        raise ValueError(f"unsupported version {version}")
    if width != (2 if vocabulary <= 65_536 else 4) or len(content) != 64 + n * width:
        raise ValueError("length and header disagree")
    if hashlib.sha256(content[:-32]).digest() != content[-32:]:
        raise ValueError("checksum mismatch")
    tokens = np.frombuffer(content[32:-32], f"<u{width}")
    if eos >= vocabulary or len(tokens) and int(tokens.max()) >= vocabulary:
        raise ValueError("token outside the vocabulary")
    return vocabulary, eos, tokens.tolist()


def header(vocabulary: int, eos: int, n: int) -> bytes:
    """What a file of ``n`` tokens begins with."""
    if not 0 <= eos < vocabulary <= 1 << 32:
        raise ValueError(f"end of text {eos} is outside a vocabulary of {vocabulary}")
    return MAGIC + struct.pack("<IIIIQ", VERSION, 2 if vocabulary <= 65_536 else 4, vocabulary, eos, n)


def read_header(raw: bytes, size: int) -> tuple[int, int, int, int]:
    """(width, vocabulary, eos, tokens) of a file's first 32 bytes; ValueError if they or the file's size can't be right."""
    if size < 64 or len(raw) < 32:
        raise ValueError("too short")
    if raw[:8] != MAGIC:
        raise ValueError("not a shard")
    version, width, vocabulary, eos, n = struct.unpack("<IIIIQ", raw[8:32])
    if version != VERSION:
        raise ValueError(f"unsupported version {version}")
    if width != (2 if vocabulary <= 65_536 else 4) or size != 64 + n * width:
        raise ValueError("length and header disagree")
    if eos >= vocabulary:
        raise ValueError("token outside the vocabulary")
    return width, vocabulary, eos, n


def shard_files(shards: DataFrame, vocabulary: int, eos: int) -> DataFrame:
    """(shard, content) of shards(shard, tokens), for any sink that takes binary rows."""

    def run(batches):
        for batch in batches:
            content = [encode_shard(t.values.to_numpy() if t.is_valid else [], vocabulary, eos) for t in batch.column("tokens")]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(content, pa.binary())], names=["shard", "content"])

    return shards.select(F.col("shard").cast("long").alias("shard"), F.col("tokens").cast("array<int>").alias("tokens")).mapInArrow(run, "shard long, content binary")


def read_shards(files: DataFrame) -> DataFrame:
    """(shard, tokens, error) of rows with ``content``; a damaged shard gives its error and no tokens."""

    def run(batches):
        for batch in batches:
            tokens, errors = [], []
            for content in batch.column("content").to_pylist():
                try:
                    tokens.append(decode_shard(content)[2])
                    errors.append(None)
                except ValueError as error:
                    tokens.append(None)
                    errors.append(str(error))
            yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(tokens, pa.list_(pa.int32())), pa.array(errors, pa.string())], names=["shard", "tokens", "error"])

    return files.select(F.col("shard").cast("long").alias("shard"), F.coalesce("content", F.unhex(F.lit(""))).alias("content")).mapInArrow(run, "shard long, tokens array<int>, error string")
