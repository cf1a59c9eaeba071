"""Packing of a stream: the open shard's number and filling are the state, one for each key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


class _Packer(StatefulProcessor):
    def __init__(self, target: int):
        self.target = target

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "shard long, filling long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        shard, filling = self.open.get() if self.open.exists() else (0, 0)
        part = pd.concat([*rows])
        # by order, then size; rows without an order first, as in the packing of a table
        part = part.sort_values(["ord", "size"], na_position="first", kind="stable")
        out = []
        for size in part["size"].tolist():
            out.append(shard)
            filling += int(size)
            if filling >= self.target:
                shard, filling = shard + 1, 0
        self.open.update((shard, filling))
        yield pd.DataFrame({"key": part["key"], "ord": part["ord"].astype("Int64"), "size": part["size"], "shard": out})

    def close(self) -> None:
        pass


def packed_stream(stream: DataFrame, size: str, order: str, target: int, key: str | None = None) -> DataFrame:
    """(key, ord, size, shard) of a stream of documents: each key's documents fill its shards, in the order of their micro-batches and, within one, by ``order`` and size.

    A stream that comes in ascending order is packed as ``greedy_shards`` packs the table. Without
    ``key`` all documents are one sequence, which is one task by nature: the filling of a shard depends on
    all before; with one (a source, a partition of the input) sequences run side by side. The state is two
    numbers for each key and goes on after a restart from the checkpoint. Needs the RocksDB state store.
    """
    slim = stream.select((F.col(key).cast("string") if key else F.lit("")).alias("key"), F.col(order).cast("long").alias("ord"), F.col(size).cast("long").alias("size")).where("size > 0")
    return slim.groupBy("key").transformWithStateInPandas(_Packer(target), "key string, ord long, size long, shard long", "Append", "None")
