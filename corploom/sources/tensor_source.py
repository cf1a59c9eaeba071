"""Tensor files as a Spark data source: ``spark.read.format("tensor_files")`` and ``df.write.format("tensor_files")``.

Reading is planned from the headers alone: tensors that a filter on ``name`` rules out are not read, the
others are read by byte range, small ones together and large ones in parts, so neither a file nor a
tensor has to fit in a task. Writing streams values in the order of names into files whose headers are
made from the shapes first; the driver commits the files in one step (``committed``).
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from ..scratch import qualified
from .committed import Commit, Written, committed, file_system, open_file
from .tensors import header, header_length, read_entries

#: Values of a row, and bytes that a partition reads at most.
PART_VALUES, PARTITION_BYTES = 1 << 18, 1 << 26
ENDING = ".safetensors"


class _Ranges(InputPartition):
    """Ranges (name, shape, first value, values, place in the file) of one file."""

    def __init__(self, file: str, label: str, ranges: list[tuple[str, list[int], int, int, int]]):
        self.file, self.label, self.ranges = file, label, ranges


class _Reader(DataSourceReader):
    def __init__(self, path: str, part_values: int, partition_bytes: int):
        self.path, self.part_values, self.partition_bytes = path, part_values, partition_bytes
        self.wanted: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith) and f.attribute == ("name",):
                self.wanted.append(f)
            else:
                yield f

    def _wants(self, name: str) -> bool:
        return all(name in f.value if isinstance(f, In) else name.startswith(f.value) if isinstance(f, StringStartsWith) else name == f.value for f in self.wanted)

    def files(self) -> list[tuple[str, str]]:
        """(name below the path, label) of the manifest's files or, of a folder without one, of all with the ending."""
        try:
            return [(f["name"], f["file"]) for f in committed(self.path)["files"]]
        except FileNotFoundError:
            store, root = file_system(self.path.rstrip("/"))
            found = sorted(f.base_name for f in store.get_file_info(pafs.FileSelector(root)) if f.is_file and f.base_name.endswith(ENDING))
            if not found:
                raise
            return [(name, name.removesuffix(ENDING)) for name in found]

    def _plan(self, file: tuple[str, str]) -> list[_Ranges]:
        name, label = file
        with open_file(self.path, name) as source:
            size = source.size()
            try:
                n = header_length(source.read_at(min(9, size), 0), size)
                entries = read_entries(source.read_at(n, 8), size - 8 - n)[1]
            except ValueError as wrong:
                raise ValueError(f"{name}: {wrong}") from wrong
        out, held, taken = [], [], 0
        for begin, end, tensor, shape in entries:
            if not self._wants(tensor):
                continue
            count = (end - begin) // 4
            for first in range(0, max(count, 1), max(self.partition_bytes // 4, 1)):
                values = min(count - first, self.partition_bytes // 4)
                if held and taken + 4 * values > self.partition_bytes:
                    out.append(_Ranges(name, label, held))
                    held, taken = [], 0
                held.append((tensor, shape, first, values, 8 + n + begin + 4 * first))
                taken += 4 * values
        return [*out, _Ranges(name, label, held)] if held else out

    def partitions(self):
        with ThreadPoolExecutor(16) as pool:
            return [p for own in pool.map(self._plan, self.files()) for p in own]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, _Ranges):
            return
        with open_file(self.path, partition.file) as source:
            for name, shape, first, count, place in partition.ranges:
                for at in range(0, max(count, 1), self.part_values):
                    n = min(self.part_values, count - at)
                    values = pa.array(np.frombuffer(source.read_at(4 * n, place + 4 * at), "<f4"))
                    rows = [pa.array([partition.label]), pa.array([name]), pa.array([shape], pa.list_(pa.int64())), pa.array([first + at]), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), values)]
                    yield pa.RecordBatch.from_arrays(rows, names=["file", "name", "shape", "start", "values"])


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.target = Commit(path, overwrite)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        said, facts, out, left = self.target.message(), None, None, []

        def close():
            if left:
                raise ValueError(f"file {facts['file']}: tensor {left[0][0]} lacks values")
            out.close()
            said.files.append(facts)

        for batch in iterator:
            values = batch.column("values")
            flat, cuts = values.values.to_numpy(zero_copy_only=False), values.offsets.to_numpy()
            for row, (file, name, start, head) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("file", "name", "start", "header")), strict=True)):
                own = flat[cuts[row] : cuts[row + 1]]
                if facts is None or facts["file"] != file:
                    if facts is not None:
                        close()
                    written, out = self.target.open(f"tensors-{said.partition:06d}-{len(said.files):04d}", ENDING)
                    raw = bytes(head)
                    out.write(raw)
                    entries = _entries(raw)
                    facts, left = {"name": written, "file": file, "tensors": len(entries)}, entries
                while left and left[0][1] == 0 and left[0][0] != name:
                    left.pop(0)
                if not left or left[0][0] != name or left[0][2] != start or len(own) > left[0][1]:
                    raise ValueError(f"file {file}: tensor {name} has values from {start} on that don't fit its shape")
                out.write(own.astype("<f4").tobytes())
                left[0] = (name, left[0][1] - len(own), start + len(own))
                if not left[0][1]:
                    left.pop(0)
        if facts is not None:
            left = [e for e in left if e[1]]
            close()
        return said

    def commit(self, messages) -> None:
        self.target.commit(messages, "file")

    def abort(self, messages) -> None:
        self.target.abort()


def _entries(raw: bytes) -> list[tuple[str, int, int]]:
    """(name, values to come, next value) of the tensors of a header."""
    head = json.loads(raw[8:])
    head.pop("__metadata__", None)
    places = sorted((*e["data_offsets"], name) for name, e in head.items())
    return [(name, (end - begin) // 4, 0) for begin, end, name in places]


class TensorFiles(DataSource):
    """Options: path; for reading ``part_values`` and ``partition_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "tensor_files"

    def schema(self) -> str:
        return "file string, name string, shape array<long>, start long, values array<float>"

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return _Reader(o["path"], int(o.get("part_values", PART_VALUES)), int(o.get("partition_bytes", PARTITION_BYTES)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)


def read_tensor_files(spark: SparkSession, path: str, part_values: int = PART_VALUES, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(file, name, shape, start, values) of the tensor files below ``path``: values in parts, ``start`` is the place of a part's first one.

    Filters ``name = ...``, ``name IN (...)`` and ``startswith`` reach the planning, which then reads the
    ranges of those tensors only (the session's ``spark.sql.python.filterPushdown.enabled`` is set for it).
    A header that is wrong fails with the file's name.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TensorFiles)
    return spark.read.format("tensor_files").options(part_values=part_values, partition_bytes=partition_bytes).load(qualified(spark, path))


def write_tensor_files(tensors: DataFrame, path: str, metadata: dict[str, str] | None = None) -> None:
    """Writes tensors(file, name, shape, start, values), in parts or whole (start 0), as one file for each ``file``.

    Only names and shapes are gathered, for the headers; values are dealt by file, sorted and streamed.
    A repeated name, a missing part or one that doesn't fit fails, and nothing is left below ``path``.
    """

    def headers(batches):
        for batch in batches:
            made = [header(sorted(((t["name"], t["shape"]) for t in ts), key=lambda t: t[0].encode()), metadata) for ts in batch.column("ts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(made, pa.binary())], names=["file", "header"])

    rows = tensors.select(F.col("file").cast("string").alias("file"), "name", F.col("shape").cast("array<long>").alias("shape"), F.col("start").cast("long").alias("start"), F.col("values").cast("array<float>").alias("values"))
    heads = rows.where("start = 0").groupBy("file").agg(F.collect_list(F.struct("name", "shape")).alias("ts")).mapInArrow(headers, "file string, header binary")
    ready = rows.drop("shape").join(heads, "file").repartition("file").sortWithinPartitions("file", "name", "start")
    tensors.sparkSession.dataSource.register(TensorFiles)
    ready.select("file", "name", "start", "header", "values").write.format("tensor_files").mode("append").save(qualified(tensors.sparkSession, path))
