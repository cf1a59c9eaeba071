"""Byte-pair vocabularies: pieces are counted by Spark, merges are learnt from the distinct pieces."""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bound
from ..scratch import materialize

#: Bytes of the longest piece; longer ones are cut between characters.
MAX_PIECE = 128


@dataclass(frozen=True)
class Splitter:
    """The switches of a pre-tokeniser; ``pattern`` is the same for Java's engine and Python's ``regex``.

    ``ansi`` keeps terminal sequences whole, ``underscore`` makes it a letter, ``prefix`` (space or any)
    is what a word may take with it, ``digits`` the longest run (0: no bound), ``newlines`` follow
    punctuation, ``whitespace`` (gpt2 or cl100k) tells whether a run ends with its last line break.
    """

    ansi: bool = True
    underscore: bool = True
    prefix: str = "any"
    digits: int = 3
    newlines: bool = True
    whitespace: str = "gpt2"

    @property
    def pattern(self) -> str:
        letter, white = r"\p{IsAlphabetic}" + "_" * self.underscore, r"\p{IsWhite_Space}"
        space = " ?" if self.prefix == "space" else ""
        parts = ["\\x1b\\[[0-?]*[ -/]*[@-~]", "\\x1b"] if self.ansi else []
        parts.append((space or rf"[^\r\n{letter}0-9]?") + f"[{letter}]+")
        parts.append(space + "[0-9]" + (f"{{1,{self.digits}}}" if self.digits else "+"))
        parts.append(f" ?[^{white}{letter}0-9" + "\\x1b" * self.ansi + "]+" + r"[\r\n]*" * self.newlines)
        parts += [rf"{white}*[\r\n]+"] * (self.whitespace == "cl100k")
        return "|".join([*parts, rf"{white}+(?![^{white}])", f"{white}+"])


SPLITTERS = {
    "gpt2_like": Splitter(False, False, "space", 0, False, "gpt2"),
    "cl100k_like": Splitter(False, False, "any", 3, True, "cl100k"),
    "code_shell": Splitter(),
}
#: Distinct pieces that are learnt from on the driver; of more, each merge is a round over their table.
MAX_DISTINCT = 2_000_000


def _splitter(config: str | Splitter) -> Splitter:
    return SPLITTERS[config] if isinstance(config, str) else config


def _cut(piece: Column) -> Column:
    """A piece of over ``MAX_PIECE`` bytes in parts, each as long as whole characters allow."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def take(t, c):
        full = F.octet_length(t["open"]) + F.octet_length(c) > MAX_PIECE
        return F.struct(F.when(full, F.array_append(t["done"], t["open"])).otherwise(t["done"]).alias("done"), F.when(full, c).otherwise(F.concat(t["open"], c)).alias("open"))

    return F.aggregate(F.split(piece, ""), start, take, lambda t: F.array_append(t["done"], t["open"]))


def pieces(text: Column, config: str | Splitter = "code_shell") -> Column:
    """The pieces of a text, which join to it; null for a null."""
    found = F.regexp_extract_all(text, F.lit(f"({_splitter(config).pattern})"), F.lit(1))
    cut = lambda ps: F.flatten(F.transform(ps, lambda p: F.when(F.octet_length(p) > MAX_PIECE, _cut(p)).otherwise(F.array(p))))
    return bound(found, lambda ps: F.when(F.exists(ps, lambda p: F.octet_length(p) > MAX_PIECE), cut(ps)).otherwise(ps))


def short_parts(raw: bytes):
    """A piece in parts of ``MAX_PIECE`` bytes at most, cut where characters start."""
    while len(raw) > MAX_PIECE:
        # the nearest place up to three bytes before the limit where a character starts
        back = next((k for k in range(4) if raw[MAX_PIECE - k] & 0xC0 != 0x80), 0)
        yield raw[: MAX_PIECE - back]
        raw = raw[MAX_PIECE - back :]
    yield raw


def byte_pieces(docs: DataFrame, config: str | Splitter = "code_shell", content: str = "content") -> DataFrame:
    """(doc_id, pieces): the pieces of any bytes; a byte that isn't part of UTF-8 counts as punctuation. Null bytes have no pieces."""
    compiled = regex.compile(_splitter(config).pattern)

    def run(batches):
        for batch in batches:
            out = []
            for raw in batch.column("content").to_pylist():
                text = (raw or b"").decode("utf-8", "surrogateescape")
                out.append([x for m in compiled.finditer(text) for x in short_parts(m.group().encode("utf-8", "surrogateescape"))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.binary()))], names=["doc_id", "pieces"])

    return docs.select("doc_id", F.col(content).alias("content")).mapInArrow(run, "doc_id long, pieces array<binary>")


def with_specials(text: Column, specials: tuple[str, ...], config: str | Splitter = "code_shell") -> Column:
    """The pieces of a text with special tokens kept whole: leftmost first, of several at one place the longest."""
    if not specials:
        return pieces(text, config)
    any_of = "|".join("\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E" for s in sorted(specials, key=len, reverse=True))
    between, found = F.split(text, any_of, -1), F.regexp_extract_all(text, F.lit(f"({any_of})"), F.lit(1))
    return F.flatten(F.zip_with(between, found, lambda b, s: F.when(s.isNull(), pieces(b, config)).otherwise(F.array_append(pieces(b, config), s))))


def piece_counts(docs: DataFrame, config: str | Splitter = "code_shell", text: str = "text") -> DataFrame:
    """(piece, n) over all texts, combined before the shuffle."""
    return docs.select(F.explode(pieces(F.col(text), config)).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))


def learn(counts, merges: int, min_frequency: int = 2) -> list[tuple[int, int]]:
    """The merges of ``learn_counted`` alone."""
    return learn_counted(counts, merges, min_frequency)[0]


def learn_counted(counts, merges: int, min_frequency: int = 2) -> tuple[list[tuple[int, int]], list[int]]:
    """Merges (left, right) in the order learnt and their counts, from (bytes, n): the most frequent pair first, ties to the smaller pair.

    Pair counts are kept up to date for the words that hold the merged pair only; a heap gives the
    next pair, entries out of date are put right when they come up.
    """
    words = [list(piece) for piece, _ in counts]
    weight = [n for _, n in counts]
    total: Counter = Counter()
    where: defaultdict = defaultdict(set)
    for w, ids in enumerate(words):
        for pair in zip(ids, ids[1:], strict=False):
            total[pair] += weight[w]
            where[pair].add(w)
    heap = [(-n, pair) for pair, n in total.items()]
    heapq.heapify(heap)
    out: list[tuple[int, int]] = []
    told: list[int] = []
    while heap and len(out) < merges:
        n, pair = heapq.heappop(heap)
        if -n != total[pair]:
            if total[pair] > 0:
                heapq.heappush(heap, (-total[pair], pair))
            continue
        if -n < min_frequency:
            break
        new = 256 + len(out)
        out.append(pair)
        told.append(-n)
        touched = set()
        for w in where.pop(pair, ()):
            ids, merged, i = words[w], [], 0
            for p in zip(ids, ids[1:], strict=False):
                total[p] -= weight[w]
            while i < len(ids):
                if i + 1 < len(ids) and (ids[i], ids[i + 1]) == pair:
                    merged.append(new)
                    i += 2
                else:
                    merged.append(ids[i])
                    i += 1
            words[w] = merged
            for p in zip(merged, merged[1:], strict=False):
                total[p] += weight[w]
                where[p].add(w)
                touched.add(p)
        for p in touched:
            heapq.heappush(heap, (-total[p], p))
    return out, told


@dataclass(frozen=True)
class TrainConfig:
    """What to learn: ``size`` tokens in all are 256 bytes, the merges and the special tokens."""

    size: int
    splitter: Splitter = Splitter()
    specials: tuple[str, ...] = ()
    min_frequency: int = 2
    max_distinct: int = MAX_DISTINCT

    @property
    def merges(self) -> int:
        if (n := self.size - 256 - len(self.specials)) < 0:
            raise ValueError(f"{self.size} tokens don't hold 256 bytes and {len(self.specials)} special tokens")
        return n


@dataclass(frozen=True)
class Trained:
    """Merges with the count that each pair had when it was merged, and what they were learnt from."""

    merges: tuple[tuple[int, int], ...]
    counts: tuple[int, ...]
    requested: int
    distinct_pieces: int
    pieces: int
    bytes: int
    #: Spark jobs that counted pairs; 0 where the driver did.
    rounds: int = 0

    @property
    def stopped_early(self) -> bool:
        """Whether no pair was frequent enough before all merges were learnt."""
        return len(self.merges) < self.requested


def train(docs: DataFrame, config: TrainConfig, text: str = "text") -> Trained:
    """Learns from all pieces of all texts, on the driver or, of more than ``max_distinct`` pieces, in rounds of Spark jobs; the merges are the same.

    Null and empty texts have no pieces; an empty table gives no merges.
    """
    return train_counted(piece_counts(docs, config.splitter, text), config)


def train_counted(counts: DataFrame, config: TrainConfig) -> Trained:
    """``train`` on pieces (piece, n) that were counted already."""
    counts = materialize(counts, "pieces")
    size = F.octet_length("piece").cast("long")
    distinct, pieces, n_bytes = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * size), F.lit(0))).first()
    if distinct <= config.max_distinct:
        rows = sorted((r["piece"].encode(), r["n"]) for r in counts.collect())
        merges, found = learn_counted(rows, config.merges, config.min_frequency)
        return Trained(tuple(merges), tuple(found), config.merges, distinct, pieces, n_bytes)
    merges, found, rounds = learn_rounds(counts, config.merges, config.min_frequency)
    return Trained(tuple(merges), tuple(found), config.merges, distinct, pieces, n_bytes, rounds)


def learn_from(docs: DataFrame, merges: int, config: str | Splitter = "code_shell", min_frequency: int = 2, max_distinct: int = MAX_DISTINCT) -> list[tuple[int, int]]:
    """The merges of ``train`` alone."""
    return list(train(docs, TrainConfig(256 + merges, _splitter(config), (), min_frequency, max_distinct)).merges)


def byte_ids(counts: DataFrame) -> DataFrame:
    """(ids, n) of (piece, n): pieces of two bytes or more as numbers of bytes."""
    ids = F.transform(F.split(F.hex(F.encode("piece", "utf-8")), "(?<=\\G..)(?!$)"), lambda x: F.conv(x, 16, 10).cast("int"))
    return counts.where(F.octet_length("piece") > 1).select(ids.alias("ids"), F.col("n").cast("long").alias("n"))


def pair_counts(words: DataFrame) -> DataFrame:
    """(a, b, n): how often two tokens stand side by side in words(ids, n), combined before the shuffle."""
    pairs = F.zip_with(F.slice("ids", 1, F.size("ids") - 1), F.slice("ids", 2, F.size("ids") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return words.select(F.explode(pairs).alias("p"), "n").groupBy("p.a", "p.b").agg(F.sum("n").alias("n"))


def plan_batch(ranked: list[tuple[int, int, int]], limit: int) -> tuple[list[tuple[int, int, int]], set[tuple[int, int]]]:
    """(batch, passed) of pairs (n, a, b), best first: pairs that may be merged together, and those passed over between them.

    Merging (a, b) takes from the counts of pairs that end with a or begin with b only. A pair that no
    earlier one of the batch takes from keeps its count, so it joins the batch; one that loses some is
    passed over, in the hope that it falls behind. A pair of equal tokens counts differently once others
    are merged, so it comes first in its batch.
    """
    batch: list[tuple[int, int, int]] = []
    passed: set[tuple[int, int]] = set()
    lefts: set[int] = set()
    rights: set[int] = set()
    for n, a, b in ranked:
        if len(batch) == limit or a == b and batch or len(passed) > 4 + len(batch):
            break
        if a in rights or b in lefts:
            passed.add((a, b))
            continue
        batch.append((n, a, b))
        lefts.add(a)
        rights.add(b)
    return batch, passed


def _before(batch: list[tuple[int, int, int]], base: int, k: int, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (rows u, v) as they were when only the first ``k`` of the batch were merged: a later token is again its right part for what follows it, its left part for what it follows."""
    left, right = np.array([p[1] for p in batch]), np.array([p[2] for p in batch])
    u, v = pairs[:, 0].copy(), pairs[:, 1].copy()
    later = u >= base + k
    u[later] = right[u[later] - base]
    later = v >= base + k
    v[later] = left[v[later] - base]
    return u, v


def accepted(batch: list[tuple[int, int, int]], passed: set[tuple[int, int]], base: int, pairs: np.ndarray, n: np.ndarray) -> int:
    """How many leading merges of a batch are those that one merge after the other would have made.

    ``pairs`` and ``n`` are counts after the whole batch, of all pairs that have a token of the batch and
    of those passed over. From them follow the counts just before each merge; it was right if no new pair
    and no pair passed over came before it then.
    """
    skipped = np.array([a << 32 | b for a, b in passed], np.int64)
    for k in range(1, len(batch)):
        u, v = _before(batch, base, k, pairs)
        key = u << 32 | v
        rivals = (u >= base) | (v >= base) | np.isin(key, skipped)
        keys, place = np.unique(key[rivals], return_inverse=True)
        if not len(keys):
            continue
        then = np.bincount(place, n[rivals].astype(np.float64)).astype(np.int64)
        best, a, b = batch[k]
        if ((then > best) | (then == best) & (keys < (a << 32 | b))).any():
            return k
    return len(batch)


def learn_rounds(counts: DataFrame, merges: int, min_frequency: int = 2, limit: int = 256, keep: int = 512, most: int = 20_000) -> tuple[list[tuple[int, int]], list[int], int]:
    """(merges, their counts, jobs): ``learn`` without the driver, a batch of merges for each Spark job.

    The driver ranks the most frequent pairs and plans a batch; one pass over the table of pieces merges
    it and counts pairs anew; the counts tell how much of the batch was right, and what the counts were
    then, so what was wrong costs no further job. What comes to the driver are pairs with at least a
    floor of occurrences (about ``most`` at first; where they run out the floor is lowered) and those that
    the batch's tokens take part in. Every ``keep`` merges the table of pieces is written with them.
    """
    words = materialize(byte_ids(counts), "words")
    found: list[tuple[int, int]] = []
    told: list[int] = []
    done = jobs = 0  # merges that ``words`` have; jobs so far
    size = 16

    def job(batch: list[tuple[int, int, int]], floor: int) -> tuple[np.ndarray, np.ndarray]:
        base, merging = 256 + len(found), {pair: 256 + done + k for k, pair in enumerate([*found[done:], *((a, b) for _, a, b in batch)])}
        table = words.mapInArrow(_merged_counts(merging), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
        if batch:
            lefts, rights = [p[1] for p in batch], [p[2] for p in batch]
            near = (F.col("a") >= base) | (F.col("b") >= base) | F.col("b").isin(lefts) | F.col("a").isin(rights)
            table = table.where((F.col("n") >= floor) | near)
        else:
            table = table.where(F.col("n") >= floor)
        rows = table.toArrow()
        return np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("a", "b")], axis=1), rows.column("n").to_numpy()

    # the first floor: what the ``most``-th pair has
    first = pair_counts(words).orderBy(F.desc("n")).limit(most).agg(F.min("n"), F.count("*")).first()
    floor = max(min_frequency, first[0] or 0) if first[1] == most else min_frequency
    jobs += 1
    pairs, n = job([], floor)
    jobs += 1
    while len(found) < merges:
        fit = n >= floor
        order = np.lexsort((pairs[fit, 1], pairs[fit, 0], -n[fit]))[: 8 * limit]
        ranked = [(int(c), int(a), int(b)) for c, (a, b) in zip(n[fit][order], pairs[fit][order], strict=True)]
        batch, passed = plan_batch(ranked, min(size, merges - len(found)))
        if not batch or len(ranked) < size and floor > min_frequency:
            if floor <= min_frequency:
                break
            floor = max(min_frequency, floor // 4)
            pairs, n = job([], floor)
            jobs += 1
            continue
        base = 256 + len(found)
        pairs, n = job(batch, floor)
        jobs += 1
        k = accepted(batch, passed, base, pairs, n)
        # the counts as they were after the first k
        u, v = _before(batch, base, k, pairs)
        key = np.concatenate([u << 32 | v, np.array([a << 32 | b for _, a, b in batch[k:]], np.int64)])
        keys, place = np.unique(key, return_inverse=True)
        n = np.bincount(place, np.concatenate([n, [c for c, _, _ in batch[k:]]]).astype(np.float64)).astype(np.int64)
        pairs = np.stack([keys >> 32, keys & 0xFFFFFFFF], axis=1)
        found += [(a, b) for _, a, b in batch[:k]]
        told += [c for c, _, _ in batch[:k]]
        size = min(limit, 2 * size) if k == len(batch) else max(8, min(limit, k + k // 2))
        if len(found) - done >= keep:
            words = materialize(words.mapInArrow(_merged_words({pair: 256 + done + i for i, pair in enumerate(found[done:])}), "ids array<int>, n long"), "words")
            done = len(found)
    return found, told, jobs


def _merge(ids: list[int], merging: dict[tuple[int, int], int]) -> list[int]:
    """All merges of a word in their order; those numbered lower come first."""
    while len(ids) > 1:
        new = min((merging[p] for p in zip(ids, ids[1:], strict=False) if p in merging), default=None)
        if new is None:
            break
        merged, i = [], 0
        while i < len(ids):
            if i + 1 < len(ids) and merging.get((ids[i], ids[i + 1])) == new:
                merged.append(new)
                i += 2
            else:
                merged.append(ids[i])
                i += 1
        ids = merged
    return ids


def _merged_words(merging: dict[tuple[int, int], int]):
    def run(batches):
        for batch in batches:
            out = [_merge(ids, merging) for ids in batch.column("ids").to_pylist()]
            keep = pa.array([len(ids) > 1 for ids in out], pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32())).filter(keep), batch.column("n").filter(keep)], names=["ids", "n"])

    return run


def _merged_counts(merging: dict[tuple[int, int], int], held: int = 1_000_000):
    """Arrow map: pair counts of the words of a partition with the merges made, given out whenever ``held`` pairs are known."""

    def told(total: Counter):
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in total], pa.int32()), pa.array([p[1] for p in total], pa.int32()), pa.array(total.values(), pa.int64())], names=["a", "b", "n"])

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for ids, n in zip(batch.column("ids").to_pylist(), batch.column("n").to_pylist(), strict=True):
                merged = _merge(ids, merging) if merging else ids
                for p in zip(merged, merged[1:], strict=False):
                    total[p] += n
            if len(total) > held:
                yield told(total)
                total = Counter()
        yield told(total)

    return run


def decode(encoded: DataFrame, piece: dict[int, bytes]) -> DataFrame:
    """(doc_id, raw, error): the bytes of (doc_id, ids); an id that the vocabulary lacks gives an error and no bytes."""

    def run(batches):
        for batch in batches:
            raw, errors = [], []
            for ids in batch.column("ids").to_pylist():
                unknown = next((i for i in ids or () if i not in piece), None)
                raw.append(None if unknown is not None else b"".join(piece[i] for i in ids or ()))
                errors.append(f"unknown token {unknown}" if unknown is not None else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary()), pa.array(errors, pa.string())], names=["doc_id", "raw", "error"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, raw binary, error string")


def encode_piece(piece: bytes, rank: dict[tuple[int, int], int]) -> list[int]:
    ids = list(piece)
    while len(ids) > 1:
        best = min(zip(ids, ids[1:], strict=False), key=lambda p: rank.get(p, 1 << 60))
        if best not in rank:
            break
        out, i = [], 0
        while i < len(ids):
            if i + 1 < len(ids) and (ids[i], ids[i + 1]) == best:
                out.append(256 + rank[best])
                i += 2
            else:
                out.append(ids[i])
                i += 1
        ids = out
    return ids


def encode(docs: DataFrame, merges: list[tuple[int, int]], config: str | Splitter = "code_shell", specials: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ids) of every text, with the merges broadcast; a worker encodes each distinct piece of a batch once.

    Special tokens have the ids after the merges; no other piece can be equal to one, since texts are cut at them first.
    """
    special = {s: [256 + len(merges) + k] for k, s in enumerate(specials)}
    shared = docs.sparkSession.sparkContext.broadcast({pair: r for r, pair in enumerate(merges)})

    def run(batches):
        rank, known = shared.value, dict(special)
        for batch in batches:
            if len(known) > 200_000:
                known = dict(special)
            out = []
            for found in batch.column("pieces").to_pylist():
                ids: list[int] = []
                for p in found or ():
                    if p not in known:
                        known[p] = encode_piece(p.encode(), rank)
                    ids += known[p]
                out.append(ids)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", with_specials(F.col("text"), specials, config).alias("pieces")).mapInArrow(run, "doc_id long, ids array<int>")
