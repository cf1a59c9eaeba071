"""Products of two tables of row vectors, by blocks: no vector is exploded into cells, and no side goes whole to one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and columns of a block, and blocks of rows of the left side that meet one copy of the right side.
BLOCK, SHARED = 256, 64


def _cut(values: str, block: int) -> Column:
    """A vector as (block number, slice) for each block of columns."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int"))
    return F.transform(blocks, lambda k: F.struct(k.cast("long").alias("block"), F.slice(values, k * block + 1, block).alias("part")))


def multiply(a: DataFrame, b: DataFrame, row: str = "row", values: str = "values", block: int = BLOCK) -> DataFrame:
    """(row, values): a(row, values) of m rows and k columns times b(row, values), whose rows 0 to k - 1 have n columns.

    A batch of matrices times one is the same with all their rows numbered on. Blocks of ``a`` meet every
    block of columns of ``b``, of which there is a copy for each ``SHARED`` blocks of rows, so that few
    columns of ``a`` don't make few tasks; each pair is one product in numpy, and products are added up by
    rows and block of columns. Rows of ``b`` that are missing count as zeros, those beyond the longest vector
    of ``a`` meet nothing and are left out before they are copied; a vector of ``a`` that is null or empty
    gives no row.
    """
    last, width = a.agg(F.coalesce(F.max(row), F.lit(0)), F.coalesce(F.max(F.size(values)), F.lit(0))).first()
    copies = 1 + (last // block) // SHARED
    left = a.where(F.size(values) > 0).select(F.col(row).cast("long").alias("i"), F.floor(F.col(row) / block).cast("long").alias("rows_at"), F.explode(_cut(values, block)).alias("c"))
    left = left.groupBy("rows_at", F.pmod(F.xxhash64("rows_at"), F.lit(copies).cast("long")).alias("copy"), F.col("c.block").alias("inner_at")).agg(F.collect_list(F.struct("i", "c.part")).alias("rows"))
    right = b.where((F.size(values) > 0) & F.col(row).between(0, width - 1)).select(F.col(row).cast("long").alias("k"), F.floor(F.col(row) / block).cast("long").alias("inner_at"), F.explode(_cut(values, block)).alias("c"))
    right = right.groupBy("inner_at", F.col("c.block").alias("columns_at")).agg(F.collect_list(F.struct("k", "c.part")).alias("columns"))
    right = right.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))

    def run(batches):
        for batch in batches:
            out: list[tuple[int, int, np.ndarray]] = []
            for big_k, big_j, rows, columns in zip(*(batch.column(c).to_pylist() for c in ("inner_at", "columns_at", "rows", "columns")), strict=True):
                width = max(len(c["part"]) for c in columns)
                matrix = np.zeros((block, width))
                for c in columns:
                    matrix[c["k"] - big_k * block, : len(c["part"])] = c["part"]
                parts = np.zeros((len(rows), block))
                for n, r in enumerate(rows):
                    parts[n, : len(r["part"])] = r["part"]
                out += [(r["i"], big_j, v) for r, v in zip(rows, parts @ matrix, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2].tolist() for o in out], pa.list_(pa.float64()))], names=["i", "columns_at", "part"])

    # a plan knows the size of ``right`` before it is copied only, so it must not choose to send it whole to every task
    products = left.join(right.hint("merge"), ["copy", "inner_at"]).select("inner_at", "columns_at", "rows", "columns").mapInArrow(run, "i long, columns_at long, part array<double>")
    # one addition for each block of columns of a, which is few
    add = lambda parts: F.aggregate(F.slice(parts, 2, F.size(parts)), F.get(parts, F.lit(0)), lambda t, p: F.zip_with(t, p, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0))))
    summed = products.groupBy("i", "columns_at").agg(F.collect_list("part").alias("parts")).select("i", "columns_at", add(F.col("parts")).alias("part"))
    joined = summed.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("columns_at", "part"))).alias("cs"))
    return joined.select(F.col("i").alias("row"), F.flatten(F.transform("cs", lambda c: c["part"])).alias("values"))
