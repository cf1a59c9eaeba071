"""Operator 12, importance resampling towards a target distribution.

Weights: features (runs of words) fall into hashed buckets; each bucket's gain is the logarithm of its
share in the target over its share in the corpus. Bucket counts are added up in arrays, one for each
partition, and combined by a small shuffle; a text's weight is the mean of an array of gains, taken at
once for a slice of a batch. Gains and weights are whole thousandths, so sums don't depend on their order.

Selection: rows are written with their scores, then the k-th key of (score, doc_id, hash of the text,
row), best first, is found by radix selection: the column's range is cut into 4,096 digits, the rows of
each digit are counted, and the digit that holds the k-th row is cut again, until it is one value, or
its rows are all drawn. A column's range is that of the rows still in question, so a few small counts
settle it, and no row passes through the driver. Only the rows up to the k-th key are dealt to ranges,
sorted and numbered; the others get no rank and aren't shuffled at all.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, text_of

#: Buckets of features, words of the longest feature, words that a text needs to be drawn, the part drawn in hundredths, and the seed.
BUCKETS, MAX_WORDS, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Digits of a round of the selection, in bits.
DIGIT_BITS = 12
#: Distinct features whose bucket a worker remembers; beyond that it starts anew, which costs time only.
REMEMBERED = 1_000_000
#: Bytes of a text that are split at a time.
STRETCH = 1 << 20

#: Bytes of words: digits, letters (upper case as lower case) and everything beyond ASCII; the rest is a blank.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


class _Buckets(dict):
    """feature -> its bucket."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def word_lists(text: str) -> Iterator[list[bytes]]:
    """The words of a text, a stretch of about ``STRETCH`` bytes at a time."""
    raw, at = text.encode("utf-8").translate(_FOLD), 0
    while at < len(raw):
        end = raw.find(b" ", at + STRETCH)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def feature_buckets(text: str, bucket: _Buckets, max_words: int) -> tuple[int, np.ndarray]:
    """Number of words, and the buckets of all runs of 1 to ``max_words`` words."""
    n, found, before = 0, [], []
    for words in word_lists(text):
        n += len(words)
        found.append(np.fromiter((bucket[w] for w in words), np.int32, len(words)))
        if max_words > 1:
            near = before + words
            for size in range(2, max_words + 1):
                first = max(0, len(before) - size + 1)  # runs that end in this stretch
                found.append(np.array([bucket[b" ".join(near[i : i + size])] for i in range(first, len(near) - size + 1)], np.int32))
            before = near[-(max_words - 1) :]
    return n, np.concatenate(found) if found else np.zeros(0, np.int32)


def bucket_counts(texts: DataFrame, buckets: int, max_words: int) -> np.ndarray:
    """How many features of all texts(doc_id, text) fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, total = _Buckets(buckets), np.zeros(buckets, np.int64)
        for _, own in slices(batches):
            total += np.bincount(np.concatenate([feature_buckets(text, bucket, max_words)[1] for text in own]), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, in thousandths: the logarithm of its smoothed share in the target over that in the corpus."""
    own, wanted, m = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1) * (own + m) / ((s + 1) * (wanted + m)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(seed: int, doc_id: int | None) -> int:
    """A draw of the Gumbel distribution for a document, in thousandths; a row without an id has that of an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(texts: DataFrame, gain: np.ndarray, max_words: int, seed: int) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score, tie) of texts(doc_id, text)."""
    shared = texts.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        bucket = _Buckets(len(gain))
        for ids, own, tie in slices(batches):
            n_words, found = zip(*(feature_buckets(text, bucket, max_words) for text in own), strict=True)
            size = np.array([len(f) for f in found], np.int64)
            sums = np.concatenate([[0], np.cumsum(gain[np.concatenate(found)])])
            ends = np.cumsum(size)
            weight = np.where(size > 0, (sums[ends] - sums[ends - size]) // np.maximum(size, 1), 0)  # whole numbers, floors go down
            score = weight + np.array([noise(seed, i) for i in ids], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, size, n_words, weight, score, tie)], names=["doc_id", "n_features", "n_words", "weight", "score", "tie"])

    return texts.select("doc_id", "text", F.xxhash64("text").alias("tie")).mapInArrow(run, "doc_id long, n_features long, n_words long, weight long, score long, tie long")


def kth_key(rows: DataFrame, keys: list[tuple[str, bool]], k: int) -> Column:
    """The condition that the first ``k`` rows, and no others, fulfil; keys are (column, descending), whole numbers, nulls last.

    ``rows`` should be a written table with at least ``k`` rows, and no two of them may agree in all keys.
    """
    taken, same = F.lit(False), F.lit(True)  # what is drawn for sure; what is still in question
    for name, down in keys:
        column = F.col(name)
        low, high, known, n = rows.where(same).agg(F.min(name), F.max(name), F.count(name), F.count("*")).first()
        if n <= k:  # all that are in question are drawn
            return taken | same
        if known <= k:
            # those without a value come last, and some of them are needed
            taken, same, k = taken | (same & column.isNotNull()), same & column.isNull(), k - known
            if not k:
                return taken
            continue
        while low < high:
            shift = max(0, (high - low).bit_length() - DIGIT_BITS)
            # in decimals: a column may go over all numbers of 64 bits
            own = f"CAST(`{name}` AS DECIMAL(38, 0))"
            digit = F.expr(f"({high} - {own}) DIV {1 << shift}" if down else f"({own} - {low}) DIV {1 << shift}".replace("- -", "+ "))
            counts = sorted((r["digit"], r["n"]) for r in rows.where(same & column.between(low, high)).groupBy(digit.alias("digit")).agg(F.count("*").alias("n")).collect())
            for d, n in counts:
                if n >= k:
                    break
                k -= n
            first, last = d << shift, min(((d + 1) << shift) - 1, high - low)
            new = (high - last, high - first) if down else (low + first, low + last)
            if down and new[1] < high:
                taken = taken | (same & column.between(new[1] + 1, high))
            elif not down and new[0] > low:
                taken = taken | (same & column.between(low, new[0] - 1))
            low, high = new
            if n == k:  # the whole digit is drawn
                return taken | (same & column.between(low, high))
        same = same & (column == low)
    return taken | same


def ranked(rows: DataFrame, keys: list[tuple[str, bool]], name: str) -> DataFrame:
    """Adds ``name``: 1, 2, 3, ... in the order of the keys. Rows are sorted within ranges, and ranges go on from those before."""
    order = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in keys]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    columns = rows.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(done + 1, done + 1 + batch.num_rows))], names=[*columns, "place"])
            done += batch.num_rows

    numbered = materialize(dealt.mapInArrow(number, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", place long").withColumn("range", F.spark_partition_id()), "ranked")
    before, total = [], 0
    for r in numbered.groupBy("range").agg(F.max("place").alias("n")).orderBy("range").collect():  # a row for each range
        before.append((r["range"], total))
        total += r["n"]
    offsets = rows.sparkSession.createDataFrame(before, "range int, before long")
    return numbered.join(F.broadcast(offsets), "range").select(*columns, (F.col("place") + F.col("before")).alias(name))


def importance_sample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, max_words: int = MAX_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text"
) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score, rank) of every row: ``percent`` hundredths of the rows with ``min_words`` words or more are drawn.

    Rows are drawn by their weight and noise of their id, without replacement, in the order of ``rank``;
    the others have no rank. Ties go to the smaller doc_id, rows without one last; rows that share an id,
    to the lesser hash of the text; equal rows are drawn one by one. A null or empty text has no features
    and weight 0 and is never drawn. An empty table gives no rows, an empty target is a flat one. Columns
    but those two are left out, whatever their names.
    """
    texts = text_of(docs, id_col, text_col)
    wanted = target.select(F.lit(None).cast("long").alias("doc_id"), F.coalesce(F.col(target_col), F.lit("")).alias("text"))
    gain = gains(bucket_counts(texts, buckets, max_words), bucket_counts(wanted, buckets, max_words))
    rows = materialize(scored(texts, gain, max_words, seed).withColumn("row", F.monotonically_increasing_id()), "scored")
    keys = [("score", True), ("doc_id", False), ("tie", False), ("row", False)]
    fit = F.col("n_words") >= min_words
    k = percent * rows.where(fit).count() // 100
    out = ["doc_id", "n_features", "n_words", "weight", "score"]
    if not k:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    drawn = fit & kth_key(rows.where(fit), keys, k)
    rest = rows.where(~F.coalesce(drawn, F.lit(False))).select(*out, F.lit(None).cast("long").alias("rank"))
    return ranked(rows.where(drawn), keys, "rank").select(*out, "rank").unionByName(rest)


def op12_importance(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document, drawn towards the benchmark's words.

    Nulls, ties, repeated rows, clashing columns and empty tables as in ``importance_sample``.
    """
    return importance_sample(documents, benchmark).select("doc_id", "n_features", "weight", "score", "rank")
