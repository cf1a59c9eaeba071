"""Tensor files read by range and written in streams."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan

from corploom.sources import tensor_source, tensors
from corploom.sources.committed import committed, open_file


def test_only_wanted_ranges_are_read(tmp_path, monkeypatch):
    """Of a file of 4 MB: its header and the bytes of the tensor asked for."""
    big, small = np.arange(1_000_000, dtype="<f4"), np.arange(300, dtype="<f4")
    (tmp_path / "m.safetensors").write_bytes(tensors.encode_tensors([("big", [1000, 1000], big), ("small", [3, 100], small)]))
    read = []

    class Counting:
        def __init__(self, source):
            self.source = source

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.source.close()

        def size(self):
            return self.source.size()

        def read_at(self, n, at):
            read.append(n)
            return self.source.read_at(n, at)

    monkeypatch.setattr(tensor_source, "open_file", lambda *a: Counting(open_file(*a)))
    reader = tensor_source.TensorFiles({"path": str(tmp_path), "part_values": "100"}).reader(None)
    left = list(reader.pushFilters([EqualTo(("name",), "small"), GreaterThan(("start",), 0)]))
    assert left == [GreaterThan(("start",), 0)]
    parts = reader.partitions()
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert [r["start"] for r in rows] == [0, 100, 200] and np.concatenate([r["values"] for r in rows]).tolist() == small.tolist()
    assert sum(read) < 2_000
    # a tensor beyond a partition's bytes is read in several, none more than that at a time
    read.clear()
    reader = tensor_source.TensorFiles({"path": str(tmp_path), "partition_bytes": "400000", "part_values": "10000"}).reader(None)
    parts = reader.partitions()
    assert len(parts) == 11 and max(sum(r[3] for r in p.ranges) for p in parts) <= 100_000
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist() if r["name"] == "big"]
    assert np.concatenate([r["values"] for r in sorted(rows, key=lambda r: r["start"])]).tolist() == big.tolist() and max(read) <= 40_000


def test_written_in_parts(spark, tmp_path):
    rng = np.random.default_rng(1)
    whole = {("a", "é"): ([2, 3], rng.random(6)), ("a", "b"): ([], rng.random(1)), ("a", "empty"): ([0, 4], rng.random(0)), ("b", "w"): ([50], rng.random(50))}
    rows = [(f, n, s, k, v[k : k + 4].tolist()) for (f, n), (s, v) in whole.items() for k in range(0, max(len(v), 1), 4)]
    frame = spark.createDataFrame(rows, "file string, name string, shape array<long>, start long, values array<double>").repartition(5)
    path = str(tmp_path / "t")
    tensor_source.write_tensor_files(frame, path, {"k": "v"})
    for f in committed(path)["files"]:
        raw = open(f"{path}/{f['name']}", "rb").read()
        own = [(n, s, v.astype("f4")) for (file, n), (s, v) in whole.items() if file == f["file"]]
        assert raw == tensors.encode_tensors(own, {"k": "v"})
    read = tensor_source.read_tensor_files(spark, path, part_values=5)
    got = {}
    for r in read.orderBy("file", "name", "start").collect():
        got.setdefault((r["file"], r["name"]), []).extend(r["values"])
    assert {k: np.array(v, "f4").tolist() for k, v in got.items()} == {k: v.astype("f4").tolist() for k, (_, v) in whole.items()}
    named = read.where(F.col("name").isin("w", "b"))
    assert "name" in named._jdf.queryExecution().toString() and {r["name"] for r in named.collect()} == {"w", "b"}


def test_bad_tensors_fail_whole(spark, tmp_path):
    schema = "file string, name string, shape array<long>, start long, values array<float>"
    for rows in ([("a", "x", [4], 0, [1.0, 2.0])], [("a", "x", [2], 0, [1.0, 2.0]), ("a", "x", [2], 0, [1.0, 2.0])], [("a", "x", [4], 0, [1.0]), ("a", "x", [4], 2, [1.0, 2.0])]):
        path = str(tmp_path / str(len(rows)) / rows[0][1] / str(rows[-1][3]))
        with pytest.raises(PySparkException):
            tensor_source.write_tensor_files(spark.createDataFrame(rows, schema), path)
        with pytest.raises(PySparkException):
            tensor_source.read_tensor_files(spark, path).count()
    (tmp_path / "x.safetensors").write_bytes(b"\x05\0\0\0\0\0\0\0{}")
    with pytest.raises(PySparkException, match="x.safetensors"):
        tensor_source.read_tensor_files(spark, str(tmp_path)).count()
