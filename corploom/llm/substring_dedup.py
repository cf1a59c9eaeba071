"""Operator 9, removal of repeated passages by seed and extend.

A window is ``WINDOW`` consecutive words. Anchors are winnowed: of the ``K``-word grams of a window
the one with the least hash, so equal windows have the same anchor at the same place, and about one
gram in seven is an anchor of any window. Equal passages therefore meet on their anchors.

1. Seeds. Each anchor occurrence carries the stretch of all windows that it is the anchor of, as a
   hash, and documents are joined on anchors. Where the whole stretch occurs earlier, all its windows
   are repeats; one occurrence of each stretch stays, the earliest.
2. Extension. Occurrences of an anchor in different stretches are matches of the ``K`` words. Each
   match is extended word by word to the left and to the right as far as both texts agree; where it
   reaches the window's length, the later occurrence is a repeat, as long as it goes (maximal).
   Where an anchor has more than ``PAIRED`` different stretches, pairs would be too many: any common
   window reaches at least half of the way to the left or to the right, so such occurrences meet
   again on the anchor extended to one side by half, then by a quarter and so on, until few are
   left or the key is a whole window, of which the earliest stays.
3. Repeats that overlap or touch are merged; the words under them are removed.

Every window has its anchor and every common window is met on the way down, so the result is exact.
Within a batch all but the first occurrence of a stretch are settled before the shuffle, so that a
passage that a third of all texts share sends one row a batch. Anchors of very many surroundings (a
common phrase) are found on a sample of texts and meet by whole windows at once, dealt out by the
window; the sample decides where work is done only, not what is found. Hashes that decide are two of
64 bits together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_heavy, materialize, slices, small

WINDOW, K = 20, 8
#: Different stretches of an anchor up to which they are extended pair by pair.
PAIRED = 16
#: Texts of the sample in which common anchors are sought, and different stretches that make an anchor common.
SAMPLE, COMMON = 5_000, 10
#: Rows of an anchor, counted over all texts, up to which they are extended together in one task.
HOT_ROWS = 100_000
#: An odd multiplier of polynomial hashes modulo 2**64, its inverse, and one for mixing.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX = np.uint64(0xBF58476D1CE4E5B9)
SEED, SETTLED, WHOLE = 0, 1, 2


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


class Words:
    """Words of several texts in a row, with hashes of any stretch of them in constant time."""

    def __init__(self, texts: list[str]):
        split = [t.encode("utf-8").split() for t in texts]
        self.counts = np.array([len(w) for w in split], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        n = int(self.first[-1])
        digest = xxhash.xxh64_intdigest
        self.ids = ids = np.fromiter((digest(w) for words in split for w in words), np.uint64, n)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(n + 1, BASE, np.uint64)) * INVERSE
            self.unpower = np.cumprod(np.full(n + 1, INVERSE, np.uint64)) * BASE
            self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids * power[:n], dtype=np.uint64)])

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words from start to end (exclusive), wherever they stand."""
        with np.errstate(over="ignore"):
            return _mix((self.prefix[end] - self.prefix[start]) * self.unpower[start] + (end - start).astype(np.uint64))

    def arms(self, first: np.ndarray, last: np.ndarray, at: np.ndarray, arm: int, width: int) -> np.ndarray:
        """One row for each seed: hashes of ``width`` words from ``at - arm`` on, zero outside first to last (exclusive)."""
        place = at[:, None] + np.arange(-arm, width - arm)[None, :]
        inside = (place >= first[:, None]) & (place < last[:, None])
        return np.where(inside, self.ids[np.where(inside, place, 0)], np.uint64(0))

    def anchors(self, window: int = WINDOW, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(gram, first, last): for each anchor the place of its gram and the first and last start of its windows."""
        n, grams = int(self.first[-1]), window - k + 1
        if n < window:
            empty = np.zeros(0, np.int64)
            return empty, empty, empty
        at = np.arange(n - k + 1)
        hashes = self.stretch(at, at + k)
        starts = np.arange(n - window + 1)
        # the last of the least: equal windows choose the same place, and choices never move back
        view = np.lib.stride_tricks.sliding_window_view(hashes, grams)[:, ::-1]
        chosen = starts + grams - 1 - view.argmin(axis=1)
        owner = np.searchsorted(self.first, starts, "right") - 1
        whole = starts + window <= self.first[owner + 1]  # no window over two texts
        starts, chosen, owner = starts[whole], chosen[whole], owner[whole]
        if not len(starts):
            return starts, starts, starts
        new = np.concatenate([[True], (np.diff(chosen) != 0) | (np.diff(owner) != 0) | (np.diff(starts) != 1)])
        head = np.flatnonzero(new)
        tail = np.concatenate([head[1:], [len(starts)]]) - 1
        return chosen[head], starts[head], starts[tail]


def _earliest(keys: list[np.ndarray], order: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted, head): rows by keys and order, and for each of them the first row with the same keys."""
    by = np.lexsort([*order[::-1], *keys[::-1]])
    new = np.ones(len(by), bool)
    if len(by):
        new[1:] = np.any([key[by][1:] != key[by][:-1] for key in keys], axis=0)
    return by, by[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(by) else by


def _not_first(keys: list[np.ndarray], doc: np.ndarray, tie: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which rows aren't at the earliest (doc, tie, start) among the rows with the same keys."""
    by, head = _earliest(keys, [doc, tie, start])
    out = np.empty(len(by), bool)
    out[by] = (doc[by] != doc[head]) | (tie[by] != tie[head]) | (start[by] != start[head])
    return out


SEED_ROWS = "anchor long, stretch long, doc_id long, tie long, start int, n int, at int, kind int"
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())


def _rows(anchor, stretch, doc, tie, start, n, at, kind) -> pa.RecordBatch:
    """Rows of SEED_ROWS; those that an earlier row of this batch repeats are settled, runs of them as one row."""
    late = _not_first([anchor, stretch, kind], doc, tie, start) if len(doc) else np.zeros(0, bool)
    d, t, s, m = doc[late], tie[late], start[late], n[late]
    if len(d):
        by = np.lexsort([s, t, d])
        d, t, s, m = d[by], t[by], s[by], m[by]
        new = np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (s[1:] > s[:-1] + m[:-1])])
        head = np.flatnonzero(new)
        m = np.maximum.reduceat(s + m, head) - s[head]
        d, t, s = d[head], t[head], s[head]
    # settled rows need no meeting; their key only deals them out
    nought = np.zeros(len(d), np.int64)
    columns = [
        (anchor[~late].view(np.int64), d * 1_000_003 + s),
        (stretch[~late].view(np.int64), nought),
        (doc[~late], d),
        (tie[~late], t),
        (start[~late], s),
        (n[~late], m),
        (at[~late], nought),
        (kind[~late], nought + SETTLED),
    ]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), kind) for c, kind in zip(columns, _TYPES, strict=True)], names=[c.split()[0] for c in SEED_ROWS.split(", ")])


def _seeds(window: int, k: int, common):
    """(doc_id, text, tie) to seeds; those of common anchors as one row for each of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = common.value if common else np.zeros(0, np.uint64)
        for doc, text, tie in slices(batches):
            words = Words(text)
            gram, first, last = words.anchors(window, k)
            anchor = words.stretch(gram, gram + k)
            n, whole = last - first + 1, np.isin(anchor, often)
            # rows of windows: each window of a common anchor by itself
            m = n[whole]
            inside = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            of = np.concatenate([np.flatnonzero(~whole), np.repeat(np.flatnonzero(whole), m)])
            begin = np.concatenate([first[~whole], first[np.repeat(np.flatnonzero(whole), m)] + inside])
            n = np.concatenate([n[~whole], np.ones(len(inside), np.int64)])
            owner = np.searchsorted(words.first, begin, "right") - 1
            kind = np.where(whole[of], WHOLE, SEED)
            yield _rows(anchor[of], words.stretch(begin, begin + n - 1 + window), np.array(doc, np.int64)[owner], np.array(tie, np.int64)[owner], begin - words.first[owner], n, gram[of] - begin, kind)

    return run


def _with_arms(window: int, k: int):
    """(doc_id, text, tie, parts) to one row for each part with the hashes of the words around its anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, text, tie, parts in slices(batches):
            words = Words(text)
            sizes = [len(p) for p in parts]
            owner = np.repeat(np.arange(len(doc)), sizes)
            first, n, at, anchor = (np.array([x[c] for p in parts for x in p], np.int64) for c in ("start", "n", "at", "anchor"))
            begin = words.first[owner] + first
            arms = words.arms(begin, begin + n - 1 + window, begin + at, window - k, 2 * window - k)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in (anchor, np.array(doc, np.int64)[owner], np.array(tie, np.int64)[owner])), *(pa.array(c, pa.int32()) for c in (first, n, at)), pa.array([a.tobytes() for a in np.ascontiguousarray(arms)], pa.binary())],
                names=["anchor", "doc_id", "tie", "start", "n", "at", "arms"],
            )

    return run


def extend(anchor, doc, tie, start, n, at, words, window: int, k: int, paired: int = PAIRED):
    """(row, start, n): the repeats of whole groups of anchors, as windows from word ``start`` on.

    ``words`` has for each occurrence the hashes of its words, the anchor's from column window - k on.
    An occurrence's windows begin ``least`` to ``most`` words left of its anchor.
    """
    arm = window - k
    most = at
    least = at - n + 1
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def pairs(rows: np.ndarray, group: np.ndarray):
        """Every later row of a group with every earlier one, in few and small groups."""
        size = np.bincount(group)
        begin = np.cumsum(size) - size
        place = np.arange(len(rows)) - begin[group]
        later = np.repeat(np.arange(len(rows)), place)
        earlier = begin[group[later]] + np.arange(len(later)) - np.repeat(np.cumsum(place) - place, place)
        return rows[later], rows[earlier]

    def extended(later: np.ndarray, earlier: np.ndarray):
        """How many words to the left and to the right of the anchor both agree."""
        same = (words[later] == words[earlier]) & (words[later] != 0)
        left = np.logical_and.accumulate(same[:, :arm][:, ::-1], axis=1).sum(axis=1)
        right = np.logical_and.accumulate(same[:, arm + k :], axis=1).sum(axis=1)
        return left, right

    def level(rows: np.ndarray, key: np.ndarray, low: int, high: int):
        """Rows that agree on ``low`` words to the left and ``arm - high`` to the right, for windows that begin low to high words left."""
        by, _ = _earliest([key], [doc[rows], tie[rows], start[rows]])
        rows, key = rows[by], key[by]
        group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])).astype(np.int64)
        if low == high:
            head = rows[np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))[group]]
            late = (doc[rows] != doc[head]) | (tie[rows] != tie[head]) | (start[rows] != start[head])
            found.append((rows[late], (start + at)[rows[late]] - low, np.ones(int(late.sum()), np.int64)))
            return
        few = np.bincount(group)[group] <= paired
        if few.any():
            _, small = np.unique(group[few], return_inverse=True)
            later, earlier = pairs(rows[few], small)
            for cut in range(0, len(later), 100_000):
                b, a = later[cut : cut + 100_000], earlier[cut : cut + 100_000]
                left, right = extended(b, a)
                left, right = np.minimum(left, high), np.minimum(right, arm - low)
                long = (left + right >= arm) & ((doc[b] != doc[a]) | (tie[b] != tie[a]) | (start[b] != start[a]))
                found.append((b[long], (start + at)[b[long]] - left[long], (left + right - arm + 1)[long]))
        if few.all():
            return
        rows, key, middle = rows[~few], key[~few], (low + high) // 2
        for lo, hi in ((low, middle), (middle + 1, high)):
            own = (most[rows] >= lo) & (least[rows] <= hi)
            if own.any():
                deeper = key[own]
                with np.errstate(over="ignore"):
                    # what is new on either side goes into the key
                    for column in [*range(arm - lo, arm - low), *range(arm + k + arm - high, arm + k + arm - hi)]:
                        deeper = _mix(deeper * BASE + words[rows[own], column])
                level(rows[own], deeper, lo, hi)

    if len(anchor):
        level(np.arange(len(anchor)), anchor.view(np.uint64), 0, arm)
    return tuple(np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(3))


def _window_keys(window: int, k: int):
    """Arrow map over rows with arms: a key for each window over the anchor's occurrence, from its words, and the place where the window begins."""
    arm = window - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, doc, tie, start, n, at = (batch.column(c).to_numpy().astype(np.int64) for c in ("anchor", "doc_id", "tie", "start", "n", "at"))
            words = np.frombuffer(b"".join(batch.column("arms").to_pylist()), np.uint64).reshape(len(doc), -1)
            for left in range(arm + 1):
                own = np.flatnonzero((at >= left) & (at - n + 1 <= left))
                key = anchor[own].view(np.uint64) + np.uint64(left)
                with np.errstate(over="ignore"):
                    for column in [*range(arm - left, arm), *range(arm + k, arm + k + arm - left)]:
                        key = _mix(key * BASE + words[own, column])
                begin = (start + at)[own] - left
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc[own]), pa.array(tie[own]), pa.array(begin.astype(np.int32))], names=["key", "doc_id", "tie", "start"])

    return run


def _hot_repeats(rows: DataFrame, window: int, k: int) -> DataFrame:
    """(doc_id, tie, start, n) of the repeats over anchors of very many rows: each window by itself, the earliest of each found by partial minima."""
    keys = materialize(rows.mapInArrow(_window_keys(window, k), "key long, doc_id long, tie long, start int"), "hot-windows")
    heads = materialize(keys.groupBy("key").agg(F.min(F.struct("doc_id", "tie", "start")).alias("head"), F.count("*").alias("n_rows")).where("n_rows > 1"), "hot-heads")
    late = join_heavy(keys, heads, ["key"], "n_rows", keys.count()).where(F.struct("doc_id", "tie", "start") != F.col("head"))
    return late.select("doc_id", "tie", "start", F.lit(1).alias("n"))


def _extended(window: int, k: int, paired: int):
    """Arrow map over rows sorted by anchor: the repeats that extension finds. An anchor may go on over batches."""

    def settled(table: pa.Table) -> pa.RecordBatch:
        anchor, doc, tie, start, n, at = (table.column(c).to_numpy().astype(np.int64) for c in ("anchor", "doc_id", "tie", "start", "n", "at"))
        words = np.frombuffer(b"".join(table.column("arms").to_pylist()), np.uint64).reshape(len(doc), -1)
        row, begin, runs = extend(anchor, doc, tie, start, n, at, words, window, k, paired)
        return pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(tie[row]), pa.array(begin.astype(np.int32)), pa.array(runs.astype(np.int32))], names=["doc_id", "tie", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = batch.column("anchor").to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1], "left"))
            if held and (cut or held[-1].column("anchor")[-1].as_py() != anchor[0]):
                yield settled(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield settled(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield settled(pa.Table.from_batches(held))

    return run


def _kept(window: int):
    """(doc_id, text, repeats) to counts and the digest of what stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, text, repeats in slices(batches):
            n, removed, digests = [], [], []
            for t, spans in zip(text, repeats, strict=True):
                words = t.encode("utf-8").split()
                n.append(len(words))
                kept, done = [], 0
                for start, count in sorted((x["start"], x["n"]) for x in spans or ()):
                    kept += words[done : max(done, start)]
                    done = max(done, start + count + window - 1)
                kept += words[done:]
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def _settle(rows: DataFrame) -> DataFrame:
    """Adds ``repeat`` (an earlier row has the same anchor and stretch) and ``several`` (other stretches have the anchor)."""
    # rows of whole windows are dealt out by the window, so that a common anchor is many keys
    dealt = rows.withColumn("deal", F.when(F.col("kind") == WHOLE, F.xxhash64("anchor", "stretch")).otherwise(F.col("anchor"))).repartition("deal")
    by_anchor = Window.partitionBy("deal", "anchor", "kind")
    here = F.struct("doc_id", "tie", "start")
    # rows at the earliest place itself (a document read twice) are no repeats
    head = F.first(here).over(Window.partitionBy("deal", "anchor", "kind", "stretch").orderBy("doc_id", "tie", "start"))
    out = dealt.withColumn("repeat", (F.col("kind") == SETTLED) | (here != head))
    return out.withColumn("several", (F.min("stretch").over(by_anchor) != F.max("stretch").over(by_anchor)) & (F.col("kind") == SEED))


def common_anchors(keyed: DataFrame, window: int, k: int, sample: int = SAMPLE, common: int = COMMON) -> np.ndarray:
    """Anchors that have ``common`` or more different stretches in about ``sample`` texts, at most a few for each of them."""
    n = keyed.count()
    some = keyed.sample(min(1.0, sample / n), seed=7) if n else keyed
    stretches = some.mapInArrow(_seeds(window, k, None), SEED_ROWS).where(F.col("kind") == SEED).groupBy("anchor").agg(F.count_distinct("stretch").alias("n"))
    return np.array([r["anchor"] for r in stretches.where(F.col("n") >= common).select("anchor").collect()], np.int64).view(np.uint64)


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, tie) of rows with a doc_id; ``tie`` orders different texts that share one, and is 0 where none do."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    hashed = F.xxhash64("text")
    shared = keyed.groupBy("doc_id").agg(F.min(hashed).alias("a"), F.max(hashed).alias("b")).where("a != b")
    return keyed.withColumn("tie", F.lit(0).cast("long") if shared.isEmpty() else hashed)


def repeated_windows(keyed: DataFrame, window: int = WINDOW, k: int = K, paired: int = PAIRED, common: int = COMMON, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, tie, start, n): runs of n windows from word ``start`` on that occur earlier in the corpus, of ``keyed_texts``.

    The sample of common anchors saves work and decides nothing: the rows left of each anchor are counted
    over all texts, and anchors with more than ``hot_rows`` are settled window by window, not in one task.
    """
    often = keyed.sparkSession.sparkContext.broadcast(common_anchors(keyed, window, k, common=common))
    seeds = _settle(keyed.mapInArrow(_seeds(window, k, often), SEED_ROWS))
    seeds = materialize(seeds.where("repeat or several").drop("deal", "stretch"), "seeds")
    several = seeds.where("several and not repeat")
    hot = materialize(several.groupBy("anchor").agg(F.count("*").alias("rows")).where(F.col("rows") > hot_rows).select("anchor"), "hot")
    parts = several.groupBy("doc_id", "tie").agg(F.collect_set(F.struct("start", "n", "at", "anchor")).alias("parts"))
    rows = keyed.join(parts, ["doc_id", "tie"]).select("doc_id", "text", "tie", "parts").mapInArrow(_with_arms(window, k), "anchor long, doc_id long, tie long, start int, n int, at int, arms binary")
    repeats = seeds.where("repeat").select("doc_id", "tie", "start", "n")
    if not hot.isEmpty():
        rows, mark = materialize(rows, "arms"), F.broadcast(hot) if small(hot) else hot
        repeats = repeats.unionByName(_hot_repeats(rows.join(mark, "anchor", "left_semi"), window, k))
        rows = rows.join(mark, "anchor", "left_anti")
    extended = rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_extended(window, k, paired), "doc_id long, tie long, start int, n int")
    return repeats.unionByName(extended)


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = K, paired: int = PAIRED, common: int = COMMON, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every text.

    A word is removed if a window over it occurs earlier: in a smaller doc_id, or in the same text
    at an earlier word. Windows are judged on the input. A null or short text has no window. Rows
    that repeat doc_id and text are one document and give equal rows; different texts that share a
    doc_id are documents of their own, ordered by a hash of the text. A row without a doc_id comes
    neither earlier nor later than any other and keeps its words. Only doc_id and text are read.
    """
    keyed = keyed_texts(docs)
    repeats = repeated_windows(keyed, window, k, paired, common, hot_rows).groupBy("doc_id", "tie").agg(F.collect_set(F.struct("start", "n")).alias("repeats"))
    bare = docs.where("doc_id is null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast(repeats.schema["repeats"].dataType).alias("repeats"))
    joined = keyed.join(repeats, ["doc_id", "tie"], "left").select("doc_id", "text", "repeats").unionByName(bare)
    return joined.mapInArrow(_kept(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op9_substring_dedup(documents: DataFrame) -> DataFrame:
    """The contract's columns of every row of ``documents``; see ``remove_repeats`` for nulls, ties and repeated rows. An empty table gives no rows."""
    return remove_repeats(documents)
