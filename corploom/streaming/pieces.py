"""Piece counts of a stream of texts, in a table that a replayed micro-batch leaves as it is."""

from __future__ import annotations

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.bpe import Splitter, piece_counts
from ..scratch import qualified
from ..sources.committed import file_system

#: Micro-batches after which those before are added up into one table.
FOLD = 64


def _tables(path: str) -> tuple[int, list[str]]:
    """(the last micro-batch that is folded, or -1; the folders that count): the latest fold and the micro-batches after it, complete ones only."""
    store, root = file_system(path.rstrip("/"))
    found = store.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    names = [f.base_name for f in found if f.type == pafs.FileType.Directory and store.get_file_info(f"{f.path}/_SUCCESS").is_file]
    folds = [int(n.removeprefix("upto-")) for n in names if n.startswith("upto-")]
    last = max(folds, default=-1)
    counted = [n for n in names if n.startswith("batch-") and int(n.removeprefix("batch-")) > last]
    return last, [f"{path}/{n}" for n in ([f"upto-{last}"] if folds else []) + sorted(counted)]


def stream_piece_counts(stream: DataFrame, path: str, config: str | Splitter = "code_shell", text: str = "text", fold: int = FOLD) -> DataStreamWriter:
    """A writer that keeps the counts of pieces below ``path``; start it with a checkpoint.

    Each micro-batch's counts are a folder named by its number and written over if the batch is run
    again, so nothing counts twice. Every ``fold`` micro-batches those before are added up into one folder;
    a batch that may still be replayed is never among them.
    """

    path = qualified(stream.sparkSession, path)

    def put(rows: DataFrame, batch: int) -> None:
        last, tables = _tables(path)
        if batch <= last:
            return  # folded already, with the same rows
        piece_counts(rows, config, text).write.mode("overwrite").parquet(f"{path}/batch-{batch}")
        if batch and batch % fold == 0 and last < batch - 1:  # not yet folded
            before = [t for t in tables if not t.endswith(f"/batch-{batch}")]
            if before:
                rows.sparkSession.read.parquet(*before).groupBy("piece").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{path}/upto-{batch - 1}")
                for t in before:
                    store, root = file_system(t)
                    store.delete_dir(root)

    return stream.select(text).writeStream.outputMode("append").foreachBatch(put)


def streamed_counts(spark: SparkSession, path: str) -> DataFrame:
    """(piece, n) of all micro-batches so far."""
    tables = _tables(qualified(spark, path))[1]
    if not tables:
        return spark.createDataFrame([], "piece string, n long")
    return spark.read.parquet(*tables).groupBy("piece").agg(F.sum("n").alias("n"))
