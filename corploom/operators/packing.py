"""Packing of token counts into shards, windows over shards, seeded epochs."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rng import Rng, draws_below, jumped, state_of
from ..scratch import materialize
from .windows import in_ranges, running_total

#: Draws of an epoch's shuffle that one task makes at a time.
DRAWS = 1 << 20


def _chains(size: np.ndarray, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums, closed, filled) of one block: running sums, and for each row, from a shard that opens with it, the shards closed and the last one's filling at the block's end."""
    n, sums = len(size), np.concatenate([[0], np.cumsum(size)])
    # the row with which a shard that opens with row i is full
    full = np.searchsorted(sums[1:], sums[:-1] + target, "left")
    closed, filled = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for i in range(n - 1, -1, -1):
        nxt = full[i] + 1
        closed[i], filled[i] = (closed[nxt] + 1, filled[nxt]) if nxt <= n else (0, sums[n] - sums[i])
    return sums, closed, filled


def _blocks(batches, run):
    """``run`` on (block, sizes) of each block; batches are sorted by block, which may go on over several."""
    held: list[tuple] = []
    for batch in batches:
        block, size = batch.column("block").to_numpy(), batch.column("size").to_numpy()
        cuts = np.flatnonzero(np.diff(block)) + 1
        for b, s in zip(np.split(block, cuts), np.split(size, cuts), strict=True):
            if not len(b):
                continue
            if held and held[0][0] != b[0]:
                yield run(held[0][0], np.concatenate([h[1] for h in held]))
                held = []
            held.append((b[0], s))
    if held:
        yield run(held[0][0], np.concatenate([h[1] for h in held]))


def greedy_shards(docs: DataFrame, size: str, order: str, target: int, blocks: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(ord, size, shard) and the columns ``keep``: in order, a shard is closed once it has ``target`` or more; the next row opens a new one.

    The fold has a carry from row to row: how full the open shard is. Ranges of (order, size) with about
    as many rows each are summed up, in parallel, by what becomes of any filling that comes into them: a
    step function with a step for each row that can fill the first shard. Those tables alone are folded in
    order in one task; then each block is folded in parallel from the filling that it gets. Rows that
    share an ``order`` are taken by size and then by the columns ``keep``, so the shards don't depend on
    how the table lies in partitions. Rows without an order come first, rows of size 0 or less are left out.
    """
    slim = docs.select(F.col(order).cast("long").alias("ord"), F.col(size).cast("long").alias("size"), *keep).where("size > 0")
    by = ["ord", "size", *keep]
    dealt = in_ranges(slim, by, blocks).repartition("block").sortWithinPartitions("block", *by)

    def steps(batches):
        def run(block, sizes):
            sums, closed, filled = _chains(sizes, target)
            # a filling f with target - sums[k + 1] <= f < target - sums[k] is full with row k
            last = int(np.searchsorted(sums[1:], target, "left"))
            rows = np.arange(min(last + 1, len(sizes)))
            least = np.maximum(target - sums[rows + 1], 0)
            done, left = 1 + closed[rows + 1], filled[rows + 1]
            keep = np.concatenate([(done[1:] != done[:-1]) | (left[1:] != left[:-1]), [True]])  # of equal steps the least filling
            return pa.RecordBatch.from_arrays(
                [pa.array([int(block)]), pa.array([int(sums[-1])]), *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in (least[keep], done[keep], left[keep]))],
                names=["block", "total", "least", "closed", "filled"],
            )

        yield from _blocks(batches, run)

    def fold(batches):
        shard = filling = 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                out.append((row["block"], shard, filling))
                found = [k for k, least in enumerate(row["least"]) if filling >= least]  # least falls from step to step
                if found:
                    shard, filling = shard + row["closed"][found[0]], row["filled"][found[0]]
                else:
                    filling += row["total"]
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in range(3)], names=["block", "shard", "filling"])

    tables = dealt.select("block", "size").mapInArrow(steps, "block long, total long, least array<long>, closed array<long>, filled array<long>")
    entries = tables.repartition(1).sortWithinPartitions("block").mapInArrow(fold, "block long, shard long, filling long")

    def assign(batches):
        last, shard, filling = None, 0, 0
        for batch in batches:
            out = []
            for block, size, first, before in zip(*(batch.column(c).to_pylist() for c in ("block", "size", "__shard", "__filling")), strict=True):
                if block != last:
                    last, shard, filling = block, first, before
                out.append(shard)
                filling += size
                if filling >= target:
                    shard, filling = shard + 1, 0
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), pa.array(out, pa.int64())], names=[*by, "shard"])

    # one row for each block; the join leaves rows where they are
    entries = entries.withColumnsRenamed({"shard": "__shard", "filling": "__filling"})
    folded = dealt.join(F.broadcast(entries), "block").sortWithinPartitions("block", *by).select("block", *by, "__shard", "__filling")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema)
    return folded.mapInArrow(assign, f"{kinds}, shard long")


def windows(shards: DataFrame, length: int) -> DataFrame:
    """(shard, i, inputs, targets) of shards(shard, tokens): window i starts at i * length; neighbours overlap by one token."""
    n = F.floor((F.size("tokens") - 1) / length).cast("int")
    cut = shards.where(F.size("tokens") > length).select("shard", "tokens", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    return cut.select("shard", "i", F.slice("tokens", F.col("i") * length + 1, length).alias("inputs"), F.slice("tokens", F.col("i") * length + 2, length).alias("targets"))


def epoch_draws(spark: SparkSession, n: int, seed: int, epoch: int, draws: int = DRAWS, moves: list[tuple[int, int]] | None = None, only: np.ndarray | None = None) -> DataFrame:
    """(i, j): the place i, from n - 1 down to 1, and the place j that the shuffle of an epoch swaps it with; of swaps of the places ``only`` if they are given.

    Tasks start at their own places of the generator's stream. A number that is drawn again moves all
    later ones; that is as rare as n in 2^64, so blocks first tell how many they had, and only then, if
    there are any, those after them are counted anew from the place they have moved to; ``moves`` are
    these places, where ``draw_moves`` has found them already.
    """
    block_draws, blocks = _block_draws(n, seed, epoch, draws), -(-(n - 1) // draws)
    moves = moves or draw_moves(spark, n, seed, epoch, draws)

    def run(batches):
        for batch in batches:
            for block in batch.column("id").to_pylist():
                i, j, _ = block_draws(block, next(m for f, m in reversed(moves) if block >= f))
                if only is not None:
                    keep = np.isin(i, only) | np.isin(j, only)
                    i, j = i[keep], j[keep]
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j)], names=["i", "j"])

    return spark.range(0, max(blocks, 0), 1, max(1, min(blocks, 4096))).mapInArrow(run, "i long, j long")


def _block_draws(n: int, seed: int, epoch: int, draws: int):
    start = state_of(Rng(seed).fork(epoch))

    def block_draws(block: int, moved: int) -> tuple[np.ndarray, np.ndarray, int]:
        at = block * draws
        i = np.arange(n - 1 - at, max(n - 1 - at - draws, 0), -1, dtype=np.int64)
        j, again = draws_below(jumped(start, at + moved), (i + 1).astype(np.uint64))
        return i, j.astype(np.int64), again

    return block_draws


def draw_moves(spark: SparkSession, n: int, seed: int, epoch: int, draws: int = DRAWS) -> list[tuple[int, int]]:
    """(first, moved): from which block on the numbers of an epoch's draws have moved, and by how many."""
    block_draws, blocks = _block_draws(n, seed, epoch, draws), -(-(n - 1) // draws)

    def repeats(moved: int):
        def run(batches):
            for batch in batches:
                found = [(b, block_draws(b, moved)[2]) for b in batch.column("id").to_pylist()]
                found = [f for f in found if f[1]]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["block", "again"])

        return run

    moves, first, moved = [(0, 0)], 0, 0
    while first < blocks:
        hit = spark.range(first, blocks, 1, max(1, min(blocks - first, 4096))).mapInArrow(repeats(moved), "block long, again long").orderBy("block").limit(1).collect()
        if not hit:
            break
        first, moved = hit[0]["block"] + 1, moved + hit[0]["again"]
        moves.append((first, moved))
    return moves


def sequences_at(spark: SparkSession, n: int, seed: int, epoch: int, places: range, draws: int = DRAWS) -> list[tuple[int, int]]:
    """(place, sequence) of ``permutation`` at a few places, which the driver holds, without the tables of all places.

    A place's chain is followed alone. Each step makes the epoch's draws again and keeps those of the
    places where the chains are, so that nothing is written; the longest of some hundred chains has
    about twenty steps for any n.
    """
    if n < 2:
        return [(p, p) for p in places]
    moves = draw_moves(spark, n, seed, epoch, draws)

    def swaps(of: set[int]) -> tuple[np.ndarray, np.ndarray]:
        found = epoch_draws(spark, n, seed, epoch, draws, moves, np.array(sorted(of), np.int64)).toArrow()
        i, j = (found.column(c).to_numpy() for c in ("i", "j"))
        order = np.lexsort((i, j))
        return i[order], j[order]

    i, j = swaps(set(places))
    last = {0: 0} | dict(zip(i.tolist(), j.tolist(), strict=True))
    last = {p: last[p] for p in places}
    # what is looked for: the first swap after a place, of this one with a place further on
    after = {p: (q, p) for p, q in last.items()}
    while after:
        i, j = swaps({q for q, _ in after.values()})
        starts, ends = (dict(zip(sorted({q for q, _ in after.values()}), np.searchsorted(j, sorted({q for q, _ in after.values()}), side).tolist(), strict=True)) for side in ("left", "right"))
        further = {}
        for p, (q, before) in after.items():
            own = i[starts[q] : ends[q]]
            if (k := int(np.searchsorted(own, before, "right"))) < len(own):
                last[p] = int(own[k])
                further[p] = (last[p], last[p])
        after = further
    return sorted(last.items())


def permutation(spark: SparkSession, n: int, seed: int, epoch: int, draws: int = DRAWS) -> DataFrame:
    """(place, sequence): the order of n sequences in an epoch; equal to swapping n - 1, ..., 1 with their draws one after the other.

    The swap at i leaves for good, at i, what stood at j before. That was put there by the swap at the
    next greater k with the same j, which brought what stood at k; without such a k it is j itself. What
    stands at k before its own swap came in the same way from the least k' > k that was swapped with k,
    and so on: each place is in one chain of ascending places, whose end is the answer. The ends are
    found by doubling: joins of (place, place further on), as many as the logarithm of the longest
    chain, which is short itself. No task holds more than its share of the n places.
    """
    if n < 2:
        return spark.range(n).select(F.col("id").alias("place"), F.col("id").alias("sequence"))
    same = Window.partitionBy("j").orderBy("i")
    swaps = epoch_draws(spark, n, seed, epoch, draws).withColumn("later", F.lead("i").over(same)).withColumn("nth", F.row_number().over(same))
    swaps = materialize(swaps, "swaps")
    # the first swap with a place, but for one with itself, is the next in the place's chain
    links = swaps.where("nth = 1").select(F.col("j").alias("k"), F.when(F.col("i") == F.col("j"), F.col("later")).otherwise(F.col("i")).alias("to")).where("to IS NOT NULL")
    links = materialize(links, "links")
    while True:
        further = links.select(F.col("k").alias("to"), F.col("to").alias("beyond"))
        links = materialize(links.select("k", "to").join(further, "to", "left").select("k", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")), "links")
        if links.where("moved").isEmpty():
            break
    # what each place gets: the end of the chain from where it was put last, or the place that nothing was put into
    wanted = swaps.select(F.col("i").alias("place"), "j", F.when(F.col("i") == F.col("j"), F.col("i")).otherwise(F.col("later")).alias("k"))
    wanted = wanted.unionByName(spark.range(1).select(F.col("id").alias("place"), F.col("id").alias("j"), F.col("id").alias("k")))
    return wanted.join(links.select("k", "to"), "k", "left").select("place", F.coalesce("to", "k", "j").alias("sequence"))


def epoch_batches(spark: SparkSession, n: int, batch: int, seed: int, epoch: int, start: int = 0, stop: int | None = None) -> DataFrame:
    """(epoch, index, row, sequence): a seeded permutation of n sequences in batches from batch ``start`` on, or to before ``stop`` where that is a few; the remainder is dropped."""
    if stop is None:
        order = permutation(spark, n, seed, epoch).where((F.col("place") >= start * batch) & (F.col("place") < n - n % batch))
    else:
        order = spark.createDataFrame(sequences_at(spark, n, seed, epoch, range(start * batch, min(stop * batch, n - n % batch))), "place long, sequence long")
    index = F.floor(F.col("place") / batch).cast("long")
    return order.select(F.lit(epoch).cast("long").alias("epoch"), index.alias("index"), (F.col("place") % batch).alias("row"), "sequence")


def batches_of(shards: DataFrame, length: int, batch: int, seed: int, epoch: int, start: int = 0) -> DataFrame:
    """(epoch, index, row, inputs, targets): the windows of shards(shard, tokens), numbered by shard and place, in the order of an epoch."""
    ends = sequence_ends(shards, length)
    n = ends.agg(F.coalesce(F.max("ends"), F.lit(0))).first()[0]
    order = epoch_batches(shards.sparkSession, n, batch, seed, epoch, start)
    numbered = windows(shards, length).join(ends.select("shard", (F.col("ends") - F.col("sequences")).alias("first")), "shard")
    numbered = numbered.select((F.col("first") + F.col("i")).alias("sequence"), "inputs", "targets")
    return order.join(numbered, "sequence").select("epoch", "index", "row", "inputs", "targets")


def sequence_ends(shards: DataFrame, length: int) -> DataFrame:
    """(shard, sequences, ends): running number of sequences by shard."""
    n = shards.select("shard", F.greatest(F.floor((F.size("tokens") - 1) / length), F.lit(0)).alias("sequences"))
    return running_total(n, F.col("sequences"), ["shard"], "ends")


def corpus_counts(encoded: DataFrame, docs: DataFrame) -> DataFrame:
    """(documents, bytes, tokens) in one row: texts of ``docs`` by bytes, encoded(ids) by tokens and an end of text each."""
    tokens = encoded.agg(F.coalesce(F.sum(F.size("ids") + 1), F.lit(0)).cast("long").alias("tokens"))
    sizes = docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("bytes"))
    return sizes.crossJoin(tokens)  # one row each


def batch_digest(made: DataFrame, limit: int = 100) -> str:
    """SHA-256 over the first ``limit`` batches of made(index, row, inputs, targets), which is what is told of an epoch: of each, its inputs, then its targets, as 4-byte little-endian numbers."""
    digest, held, at = hashlib.sha256(), [], None

    def put():
        for column in ("inputs", "targets"):
            for r in held:
                digest.update(np.asarray(r[column], "<u4").tobytes())

    for row in made.where(F.col("index") < limit).orderBy("index", "row").toLocalIterator():
        if row["index"] != at:
            put()
            held, at = [], row["index"]
        held.append(row)
    put()
    return digest.hexdigest()
