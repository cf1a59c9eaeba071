"""Batches of token shards as a stream: ``spark.readStream.format("token_batches")``, whose offset is (epoch, index).

The order of each epoch is made by Spark and written beside the shards first (``prepare_epochs``). A read
of some batches takes their places from that order and the windows from the shard files by byte range,
so a restart goes on with the next batch and reads nothing of those before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators import packing
from ..scratch import qualified
from ..sources.committed import committed, file_system, open_file
from ..sources.shards import read_header
from ..sources.token_shards import TokenShards

#: Places of one file of an order, and batches that one task reads.
PLACES, BATCHES = 1 << 22, 64


def _sequences(path: str, length: int) -> tuple[list[dict], np.ndarray]:
    """The files of the shards, and the number of windows up to the end of each, from 0 on."""
    files = TokenShards({"path": path, "rows": "windows", "length": str(length)}).reader(None).files()
    return files, np.concatenate([[0], np.cumsum([max(f["tokens"] - 1, 0) // length for f in files])]).astype(np.int64)


def prepare_epochs(spark: SparkSession, path: str, length: int, seed: int, epochs: range) -> int:
    """Writes the orders of epochs over the windows of the shards below ``path``, next to them, in files of ``PLACES`` places; the number of windows.

    Epochs are those of ``packing.permutation``. An epoch that is prepared again is replaced.
    """
    path = qualified(spark, path)
    n = int(_sequences(path, length)[1][-1])
    for epoch in epochs:
        order = packing.permutation(spark, n, seed, epoch).withColumn("part", F.floor(F.col("place") / PLACES).cast("int"))
        order.repartition("part").sortWithinPartitions("part", "place").write.partitionBy("part").mode("overwrite").parquet(f"{path}/_orders-{length}-{seed}/epoch={epoch}")
    return n


class _Batches(InputPartition):
    def __init__(self, epoch: int, first: int, last: int):
        self.epoch, self.first, self.last = epoch, first, last


class _Reader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.length, self.batch, self.seed = options["path"].rstrip("/"), int(options["length"]), int(options["batch"]), int(options["seed"])
        self.start = (int(options.get("from_epoch", 0)), int(options.get("from_index", 0)))
        self.stop = (int(options["until_epoch"]), int(options.get("until_index", 0)))
        self.files, self.ends = _sequences(self.path, self.length)
        self.per_epoch = int(self.ends[-1]) // self.batch

    def initialOffset(self) -> dict:
        return {"epoch": self.start[0], "index": self.start[1]}

    def latestOffset(self) -> dict:
        return {"epoch": self.stop[0], "index": self.stop[1]}

    def partitions(self, start: dict, end: dict):
        out = []
        for epoch in range(start["epoch"], end["epoch"] + 1):
            first = start["index"] if epoch == start["epoch"] else 0
            last = min(end["index"], self.per_epoch) if epoch == end["epoch"] else self.per_epoch
            out += [_Batches(epoch, b, min(b + BATCHES, last)) for b in range(first, last, BATCHES)]
        return out

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        low, high = partition.first * self.batch, partition.last * self.batch
        store, root = file_system(self.path)
        parts = [f"{root}/_orders-{self.length}-{self.seed}/epoch={partition.epoch}/part={k}" for k in range(low // PLACES, (high - 1) // PLACES + 1)]
        places = pa.concat_tables([pads.dataset(p, filesystem=store, format="parquet").to_table(columns=["place", "sequence"], filter=(pads.field("place") >= low) & (pads.field("place") < high)) for p in parts])
        place, sequence = places["place"].to_numpy(), places["sequence"].to_numpy()
        inputs, targets = np.empty((len(place), self.length), np.int32), np.empty((len(place), self.length), np.int32)
        shard = np.searchsorted(self.ends, sequence, "right") - 1
        for k in np.unique(shard).tolist():
            own = np.flatnonzero(shard == k)
            with open_file(self.path, self.files[k]["name"]) as source:
                width = read_header(source.read_at(32, 0), source.size())[0]
                for row in own.tolist():
                    at = int(sequence[row] - self.ends[k]) * self.length
                    window = np.frombuffer(source.read_at((self.length + 1) * width, 32 + at * width), f"<u{width}")
                    inputs[row], targets[row] = window[:-1], window[1:]
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, len(place) * self.length + 1, self.length), pa.int32()), pa.array(x.ravel())) for x in (inputs, targets)]
        numbers = [pa.array(x, pa.int64()) for x in (np.full(len(place), partition.epoch), place // self.batch, place % self.batch)]
        yield pa.RecordBatch.from_arrays([*numbers, *lists], names=["epoch", "index", "row", "inputs", "targets"])

    def commit(self, end: dict) -> None:
        pass


class TokenBatches(DataSource):
    """Options: path of the shards, length, batch, seed; from_epoch and from_index, until_epoch and until_index (the first batch that isn't given out)."""

    @classmethod
    def name(cls) -> str:
        return "token_batches"

    def schema(self) -> str:
        return "epoch long, index long, row long, inputs array<int>, targets array<int>"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)


def batch_stream(spark: SparkSession, path: str, length: int, batch: int, seed: int, until: tuple[int, int], start: tuple[int, int] = (0, 0)) -> DataFrame:
    """The batches from ``start`` up to ``until``, both (epoch, index), of epochs that ``prepare_epochs`` has made. A query that starts anew from its checkpoint goes on after the last batch that it finished."""
    path = qualified(spark, path)
    committed(path)  # shards must be there
    spark.dataSource.register(TokenBatches)
    options = {"path": path, "length": length, "batch": batch, "seed": seed, "from_epoch": start[0], "from_index": start[1], "until_epoch": until[0], "until_index": until[1]}
    return spark.readStream.format("token_batches").options(**options).load()
