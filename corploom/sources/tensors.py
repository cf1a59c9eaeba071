"""Tensor files: the length of a JSON header as 8 little-endian bytes, the header, then float32 values that tile the rest."""

from __future__ import annotations

import json
import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most that a header may hold, and its key for text about the file.
MAX_HEADER, METADATA = 100_000_000, "__metadata__"


def header(shapes: list[tuple[str, list[int]]], metadata: dict[str, str] | None = None) -> bytes:
    """What a file of tensors (name, shape), in the order of their names' bytes, begins with; ValueError for a repeated name."""
    head, at = ({METADATA: dict(sorted(metadata.items()))} if metadata else {}), 0
    for name, shape in shapes:
        if name in head or name == METADATA:
            raise ValueError(f"tensor name {name} is taken")
        head[name] = {"dtype": "F32", "shape": list(shape), "data_offsets": [at, at + 4 * math.prod(shape)]}
        at += 4 * math.prod(shape)
    text = json.dumps(head, ensure_ascii=False, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 8)
    if len(text) > MAX_HEADER:
        raise ValueError("the header is too long")
    return struct.pack("<Q", len(text)) + text


def encode_tensors(tensors, metadata: dict[str, str] | None = None) -> bytes:
    """The file of (name, shape, values), by name; ValueError for a repeated name or a shape that doesn't fit."""
    ordered = sorted(tensors, key=lambda t: t[0].encode())
    for name, shape, values in ordered:
        if math.prod(shape) != len(values):
            raise ValueError(f"tensor {name}: {len(values)} values don't fit its shape")
    return header([t[:2] for t in ordered], metadata) + b"".join(np.asarray(t[2], "<f4").tobytes() for t in ordered)


def _no_repeats(pairs):
    found = dict(pairs)
    if len(found) != len(pairs):
        raise ValueError("a key of the header is repeated")
    return found


def header_length(prefix: bytes, size: int) -> int:
    """Bytes of the header of a file of ``size`` bytes, by its first nine; ValueError if that can't be."""
    if size < 8 or len(prefix) < 8:
        raise ValueError("shorter than its length prefix")
    (n,) = struct.unpack("<Q", prefix[:8])
    if n > MAX_HEADER or n > size - 8:
        raise ValueError("the header's length is beyond the file or the limit")
    if prefix[8:9] != b"{":
        raise ValueError("the header must start with {")
    return n


def read_entries(head: bytes, size: int) -> tuple[dict[str, str], list[tuple[int, int, str, list[int]]]]:
    """(metadata, entries (begin, end, name, shape) by place) of a header and the bytes of values after it; ValueError names the first thing that is wrong."""
    found, at, out = json.loads(head.decode(), object_pairs_hook=_no_repeats), 0, []
    metadata = found.pop(METADATA, {})
    if not all(isinstance(k, str) and isinstance(v, str) for k, v in metadata.items()):
        raise ValueError("metadata must be text")
    try:
        entries = sorted(((*e["data_offsets"], name, e["dtype"], e["shape"]) for name, e in found.items()), key=lambda e: e[:2])
    except (KeyError, TypeError) as error:
        raise ValueError("a tensor's entry lacks dtype, shape or data_offsets") from error
    for begin, end, name, dtype, shape in entries:
        if dtype != "F32":
            raise ValueError(f"tensor {name}: dtype {dtype} is not F32")
        if begin != at:
            raise ValueError(f"tensor {name} starts at byte {begin}, not {at}")
        if end - begin != 4 * math.prod(shape) or end > size:
            raise ValueError(f"tensor {name}: shape and range disagree")
        out.append((begin, end, name, shape))
        at = end
    if at != size:
        raise ValueError(f"tensors cover {at} of {size} bytes")
    return metadata, out


def decode_tensors(content: bytes) -> list[tuple[str, list[int], np.ndarray]]:
    """(name, shape, values) by place; ValueError names the first thing that is wrong."""
    n = header_length(content[:9], len(content))
    data = content[8 + n :]
    return [(name, shape, np.frombuffer(data[begin:end], "<f4")) for begin, end, name, shape in read_entries(content[8 : 8 + n], len(data))[1]]


def tensor_files(tensors: DataFrame) -> DataFrame:
    """(path, content) of tensors(path, name, shape, values); a file is one row, so a file's tensors must fit in a task."""

    def run(batches):
        for batch in batches:
            content = [encode_tensors([(t["name"], t["shape"], t["values"]) for t in ts]) for ts in batch.column("ts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(content, pa.binary())], names=["path", "content"])

    grouped = tensors.select(F.col("path").cast("string").alias("path"), F.struct("name", F.col("shape").cast("array<long>").alias("shape"), F.col("values").cast("array<float>").alias("values")).alias("t"))
    return grouped.groupBy("path").agg(F.collect_list("t").alias("ts")).mapInArrow(run, "path string, content binary")


def read_tensors(files: DataFrame) -> DataFrame:
    """(path, name, shape, values, error) of files(path, content), as ``spark.read.format("binaryFile")`` gives them; a damaged or null file gives one row with its error."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                try:
                    found, error = decode_tensors(content.as_py() or b""), None
                except (ValueError, AttributeError) as wrong:
                    found, error = [(None, None, None)], str(wrong)
                arrays = [pa.array([path.as_py()] * len(found), pa.string()), pa.array([t[0] for t in found], pa.string()), pa.array([t[1] for t in found], pa.list_(pa.int64())), pa.array([t[2] for t in found], pa.list_(pa.float32())), pa.array([error] * len(found), pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["path", "name", "shape", "values", "error"])

    return files.select(F.col("path").cast("string").alias("path"), "content").mapInArrow(run, "path string, name string, shape array<long>, values array<float>, error string")
