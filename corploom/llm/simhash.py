"""Operator 8, SimHash near-duplicates by tiled exact comparison.

Every text gets a 64-bit fingerprint of its word shingles. Distinct fingerprints are compared in
tiles with numpy: exclusive-or, bit count, and whatever differs in more than ``radius`` bits dropped;
parts of tiles whose population counts differ by more than the radius are never compared.

Which fingerprints share a tile is decided without loss: the 64 bits are cut into blocks, two
fingerprints within the radius agree in all but ``radius`` blocks, so each fingerprint goes to one
bucket for every choice of blocks that may be the equal ones, and every link meets in a bucket. How
many blocks is chosen by the number of fingerprints, so buckets stay small as the corpus grows. A
bucket of more than ``TILE`` fingerprints is split into cells by population count and hash; pairs of
cells within the radius are compared, each pair as a group of its own.

A tile returns a spanning forest of its links, so a dense group of n near copies costs n rows, not
n squared. Components are found by alternating star steps over tables, with nothing collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_heavy, materialize, slices, text_of

WIDTH, SEED, RADIUS, TILE = 4, 42, 4, 4096
#: Shingles whose bits are counted at once.
BLOCK = 100_000


def shingle_hashes(text: str, width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """XXH64 of each word shingle of a text, A-Z in lower case, repeats included."""
    words = text.encode("utf-8").lower().split()
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= width:
        return np.array([digest(joined, seed)] if words else [], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    pairs = zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[s:e], seed) for s, e in pairs), np.uint64, len(words) - width + 1)


def fingerprint(hashes: np.ndarray) -> np.uint64:
    """The bits that are set in over half of the hashes; zero without any."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0]


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for doc, text in slices(batches):
        found = np.array([fingerprint(shingle_hashes(t)) for t in text], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(found, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint of each text as a signed long."""
    return text_of(docs).mapInArrow(_fingerprints, "doc_id long, fp long")


def block_masks(n: int, radius: int = RADIUS) -> list[int]:
    """Masks (signed) of the bits that must agree, one for each choice of blocks, for about ``n`` fingerprints.

    More blocks mean longer keys and smaller buckets, but more of them; the least work is chosen.
    """

    def work(blocks: int) -> float:
        keys = len(list(combinations(range(blocks), radius)))
        return keys * (1 + n / 2 ** (64 * (blocks - radius) / blocks) / 100)

    blocks = min(range(radius + 1, radius + 5), key=work)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    masks = [sum(parts[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among ``a`` (or between ``a`` and ``b``), as two arrays of fingerprints."""
    a = a[np.argsort(np.bitwise_count(a), kind="stable")]
    other = a if b is None else b[np.argsort(np.bitwise_count(b), kind="stable")]
    nodes = a if b is None else np.concatenate([a, other])
    shift = 0 if b is None else len(a)
    ones, others = np.bitwise_count(a).astype(int), np.bitwise_count(other).astype(int)
    root = np.arange(len(nodes))
    left, right = [], []
    rows = max(1, 1_000_000 // max(1, len(other)))
    for at in range(0, len(a), rows):
        part = a[at : at + rows]
        # only what is within the radius by population count
        low = np.searchsorted(others, ones[at] - radius, "left")
        high = np.searchsorted(others, ones[at + len(part) - 1] + radius, "right")
        if b is None:
            low = max(low, at)
        if low >= high:
            continue
        i, j = np.nonzero(np.bitwise_count(part[:, None] ^ other[None, low:high]) <= radius)
        i, j = i + at, j + low + shift
        keep = root[i] != root[j]
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        _, first = np.unique(np.minimum(root[i], root[j]) * len(nodes) + np.maximum(root[i], root[j]), return_index=True)
        for x, y in zip(i[first].tolist(), j[first].tolist(), strict=True):
            p, q = x, y
            while root[p] != p:
                p = root[p]
            while root[q] != q:
                q = root[q]
            if p != q:
                root[max(p, q)] = min(p, q)
                left.append(nodes[x])
                right.append(nodes[y])
        while (up := root[root] != root).any():
            root[up] = root[root[up]]
    return np.array(left, np.uint64), np.array(right, np.uint64)


def _tiles(radius: int):
    """Arrow map over rows sorted by (tile, side): the links of each tile. A tile may go on over batches."""

    def links(tile: int, side: np.ndarray, fp: np.ndarray):
        fp = fp.view(np.uint64)
        pair = (side > 0).any()
        u, v = forest(fp[side == 0], fp[side == 1] if pair else None, radius)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64), pa.int64()), pa.array(v.view(np.int64), pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            tile, side, fp = (batch.column(c).to_numpy() for c in ("tile", "side", "fp"))
            cuts = np.flatnonzero(np.diff(tile)) + 1
            for t, s, f in zip(np.split(tile, cuts), np.split(side, cuts), np.split(fp, cuts), strict=True):
                if held and held[0][0][0] != t[0]:
                    yield links(*_joined(held))
                    held = []
                held.append((t, s, f))
        if held:
            yield links(*_joined(held))

    def _joined(held):
        return held[0][0][0], np.concatenate([h[1] for h in held]), np.ascontiguousarray(np.concatenate([h[2] for h in held]))

    return run


def fingerprint_links(nodes: DataFrame, n: int, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(u, v): links that connect what is within ``radius`` bits, of distinct fingerprints ``nodes(fp)``."""
    masks = block_masks(n, radius)
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(masks)]))
    keyed = nodes.select("fp", keys.alias("key")).select("fp", "key.*")
    sizes = keyed.groupBy("k", "bits").agg(F.count("*").alias("size")).where("size > 1")
    sizes = materialize(sizes.withColumn("n_rows", F.col("size")), "sizes")
    keyed = join_heavy(keyed, sizes, ["k", "bits"], "n_rows", n * len(masks))
    small = keyed.where(F.col("size") <= tile).select(F.xxhash64("k", "bits").alias("tile"), F.lit(0).alias("side"), "fp")
    # a large bucket: cells by population count and hash; a fingerprint goes to every pair of cells that its own is in
    cells = F.ceil(F.col("size") / (4 * tile)).cast("int")
    large = keyed.where(F.col("size") > tile).withColumn("cells", cells).withColumn("ones", F.bit_count("fp").cast("int"))
    large = large.withColumn("own", F.struct("ones", F.pmod(F.xxhash64("fp"), "cells").cast("int").alias("part")))
    near = large.withColumn("with", F.explode(F.sequence(F.greatest(F.col("ones") - radius, F.lit(0)), F.least(F.col("ones") + radius, F.lit(64)))))
    near = near.withColumn("with", F.explode(F.transform(F.sequence(F.lit(0), F.col("cells") - 1), lambda p: F.struct(F.col("with").alias("ones"), p.alias("part")))))
    first = F.col("own") <= F.col("with")
    pair = F.xxhash64("k", "bits", F.when(first, F.col("own")).otherwise(F.col("with")), F.when(first, F.col("with")).otherwise(F.col("own")))
    pairs = near.select(pair.alias("tile"), F.when(first, 0).otherwise(1).alias("side"), "fp")
    rows = small.unionByName(pairs)
    return rows.repartition("tile").sortWithinPartitions("tile", "side").mapInArrow(_tiles(radius), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(u, root): the least vertex of each component, for every vertex of ``edges(u, v)`` but the roots.

    Alternates large-star and small-star steps until the table of edges no longer changes; each
    round's table is written to the shared folder, so no round is ever computed again.
    """

    def star(e: DataFrame, n: int, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        # a vertex of very many links is a hot key
        joined = join_heavy(both, materialize(least, "least"), ["u"], "n", 2 * n if large else n)
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        return materialize(out.where("u != v").distinct(), "stars")

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    seen = state(edges)
    while seen[0]:
        large = star(edges, seen[0], True)
        edges = star(large, large.count(), False)
        now = state(edges)
        if now == seen:
            break
        seen = now
    return edges.select("u", F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint, component_id and ``group`` (the component's least fingerprint) of every text.

    Texts link if their fingerprints differ in at most ``radius`` bits; a text without words has the
    fingerprint zero and links like any other. ``component_id`` is the least doc_id that links reach,
    the own one included; rows without a doc_id take part, and a component of only such rows has a
    null id. Every row gives one row, rows that repeat too. Only doc_id and text are read.
    """
    by_doc = materialize(fingerprints(docs), "fingerprints")
    nodes = materialize(by_doc.groupBy("fp").agg(F.min("doc_id").alias("least_doc"), F.count("*").alias("n_rows")), "nodes")
    n = nodes.count()
    roots = components(fingerprint_links(nodes.select("fp"), n, radius, tile))
    labelled = materialize(nodes.join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "labelled")
    # a large component and a fingerprint of many copies are hot keys
    least = materialize(labelled.groupBy("root").agg(F.min("least_doc").alias("component_id"), F.count("*").alias("n")), "least")
    classes = materialize(join_heavy(labelled, least, ["root"], "n", n).select("fp", F.col("root").alias("group"), "component_id", "n_rows"), "classes")
    named = join_heavy(by_doc, classes, ["fp"], "n_rows", by_doc.count())
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group")


def op8_simhash(documents: DataFrame) -> DataFrame:
    """The contract's columns of every row of ``documents``; see ``near_duplicates`` for nulls, ties and repeated rows. An empty table gives no rows."""
    return near_duplicates(documents).drop("group")
