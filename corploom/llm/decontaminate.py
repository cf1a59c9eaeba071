"""Operator 10, benchmark decontamination by q-gram lemma filtering and banded alignment.

An item of n characters that stands in a text with at most e edits shares at least
n + 1 - q * (e + 1) of its q-grams with it, on diagonals at most e apart; of any k of its q-grams, at
least k - q * e. Items of fewer than q characters have no q-gram and must stand in a text exactly, as
whole words. So:

1. the q-grams of a text are looked up in an index of the benchmark's (a table of bits first, which
   nearly all fail),
2. hits are counted in overlapping bands of diagonals, at least as wide as e, for each item,
3. bands with as many hits as the lemma asks for are aligned, within the band and all those of items of
   one length at once in numpy; what needs more than e edits is dropped. A band whose text is that of
   another band of the same item and text is aligned once.

Where many items share a stretch (an instruction, say), each of them can pass the lemma by it wherever
it stands; texts with more hits than ``HITS`` are then cut in halves that overlap, so memory is bounded.

The benchmark is a stated query set. Its index is broadcast in blocks of at most ``BLOCK_CHARS``
characters, each of which is held against all texts; texts are never shuffled or paired.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of

Q, MAX_EDIT_SHARE, MIN_CHARS = 8, 0.1, 1
#: Characters of the benchmark whose index is broadcast at once, and of texts that are scanned at once.
BLOCK_CHARS, SCAN_CHARS = 4_000_000, 1_000_000
TABLE_BITS, CACHED = 22, 1 << 15
#: Hits in the index that are counted at once, and cells of a row of the alignments made at once.
HITS, CELLS = 4_000_000, 1_000_000
#: Bands from which on those that look alike are sought.
MANY = 2_000
BASE = np.uint64(0x9E3779B97F4A7C15)


def codes(text: str) -> np.ndarray:
    """Code points, A-Z in lower case, blanks as spaces; places stay what they are."""
    found = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    found[(found >= 9) & (found <= 13)] = 32
    found[(found >= 65) & (found <= 90)] += 32
    return found


def gram_hashes(found: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q characters from each place on."""
    n = len(found) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, n, CACHED):  # parts that stay in a core's cache
            h = out[at : at + CACHED]
            wide = found[at : at + CACHED + q].astype(np.uint64)
            h[:] = wide[: len(h)]
            for j in range(1, q):
                h *= BASE
                h += wide[j : j + len(h)]
            h ^= h >> np.uint64(29)
            h *= BASE
    return out


@dataclass
class Index:
    """q-grams of the items of one block."""

    q: int
    ids: np.ndarray
    texts: list[str]
    edits: np.ndarray
    needed: np.ndarray
    width: np.ndarray
    table: np.ndarray
    grams: np.ndarray
    item: np.ndarray
    place: np.ndarray
    longest: int
    #: whether an item's rarer q-grams are in its later part
    rear: np.ndarray
    #: for items of fewer than q characters: length -> (hashes in order, items)
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def build_index(items: list[tuple[int, str]], q: int = Q, share: float = MAX_EDIT_SHARE, min_chars: int = MIN_CHARS) -> Index:
    items = [(i, t) for i, t in items if t and len(t) >= min_chars and t.strip()]
    n = np.array([len(t) for _, t in items], np.int64)
    # as many edits as the share allows and the lemma can still see
    edits = np.maximum(np.minimum((n * share).astype(np.int64), n // q - 1), 0)
    hashes = [gram_hashes(codes(t), q) for _, t in items]
    short = {}
    for length in sorted(set(n[n < q].tolist())):
        own = np.flatnonzero(n == length)
        whole = np.array([gram_hashes(codes(items[i][1]), length)[0] for i in own.tolist()], np.uint64)
        by = np.argsort(whole, kind="stable")
        short[length] = (whole[by], own[by])
    grams = np.concatenate([*hashes, np.zeros(0, np.uint64)])
    item = np.repeat(np.arange(len(items)), [len(h) for h in hashes]).astype(np.int64)
    place = np.concatenate([*(np.arange(len(h)) for h in hashes), np.zeros(0, int)]).astype(np.int64)
    needed = n + 1 - q * (edits + 1)
    # e edits spoil at most q * e grams, whichever are counted: an item may do without its most frequent
    # ones, and then needs as many fewer. What is left tells texts apart better and is met less often.
    _, same, often = np.unique(grams, return_inverse=True, return_counts=True)
    rank, counted = often[same], np.ones(len(grams), bool)
    ends = np.cumsum([0, *map(len, hashes)])
    for i, spare in enumerate((needed - np.maximum(4, needed // 4)).tolist()):
        own = rank[ends[i] : ends[i + 1]]
        go = np.argsort(-own, kind="stable")[: max(0, spare)]
        go = go[own[go] > 1]
        counted[ends[i] + go] = False
        needed[i] -= len(go)
    weight = 1 / np.maximum(rank, 1)
    middle = np.bincount(item, weight * place, len(items)) / np.maximum(np.bincount(item, weight, len(items)), 1e-9)
    grams, item, place = grams[counted], item[counted], place[counted]
    order = np.argsort(grams, kind="stable")
    table = np.zeros(1 << TABLE_BITS, bool)
    table[(grams >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
    return Index(q, np.array([i for i, _ in items], np.int64), [t for _, t in items], edits, needed, edits + 1, table, grams[order], item[order], place[order], int(n.max(initial=0)), middle > 0.6 * (n - q), short)


def banded_alignments(patterns: np.ndarray, n: np.ndarray, windows: np.ndarray, low: np.ndarray, size: np.ndarray, budget: np.ndarray, anchored: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(edits, end) of the best match of each whole pattern (a row, of which ``n`` characters count) within its text, on as many diagonals from ``low`` on as the windows allow; edits beyond the budget are no match.

    Diagonal d holds the cells of pattern place i and text place i + d; ``windows`` have the text's
    characters from place ``low`` on, ``size`` is its length. A match may begin and end anywhere in the
    text; an anchored one begins where the text does.
    """
    edits, ends = np.full(len(patterns), 1 << 30), np.zeros(len(patterns), np.int64)
    order = np.argsort(n, kind="stable")
    live, n, low, size, budget, patterns, windows = order, n[order], low[order], size[order], budget[order], patterns[order], windows[order]
    width = windows.shape[1] - patterns.shape[1] + 1
    k = np.arange(width)
    begin = low[:, None] + k
    row = np.maximum(begin, 0) if anchored else np.zeros((len(live), width), np.int64)
    row = np.where((begin < 0) | (begin > size[:, None]), budget[:, None] + 1, row)
    for i in range(int(n[-1]) if len(n) else 0):
        new = row + (windows[:, i : i + width] != patterns[:, i : i + 1])  # replaced or the same
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])  # a pattern character left out
        if int(low.min()) + i + 1 < 0 or (low + (i + width) > size).any():
            end = low[:, None] + (i + 1) + k
            new = np.where((end < 0) | (end > size[:, None]), budget[:, None] + 1 + patterns.shape[1], new)
        new -= k
        np.minimum.accumulate(new, axis=1, out=new)
        new += k  # text characters put in
        row = new
        done = int(np.searchsorted(n, i + 1, "right"))
        if not done and i % 2:
            continue
        best = row.min(axis=1)
        if done:
            at = row[:done].argmin(axis=1)
            edits[live[:done]], ends[live[:done]] = best[:done], i + 1 + low[:done] + at
        stay = best <= budget
        stay[:done] = False
        if not stay.all():
            row, live, n, low, size, budget, patterns, windows = (x[stay] for x in (row, live, n, low, size, budget, patterns, windows))
            if not len(live):
                break
    return edits, ends


def _stretches(joined: np.ndarray, first: np.ndarray, size: np.ndarray, start: np.ndarray, length: int, back: bool = False) -> np.ndarray:
    """For each text (by its first place and size) ``length`` characters from place ``start`` on, or backwards from it; what lies outside of it equals nothing."""
    at = start[:, None] + (-1 if back else 1) * np.arange(length)
    inside = (at >= 0) & (at < size[:, None])
    return np.where(inside, joined[np.clip(first[:, None] + at, 0, len(joined) - 1)], np.uint32(0xFFFFFFFF))


def _aligned(index: Index, joined: np.ndarray, first: np.ndarray, size: np.ndarray, item: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, start, end) for candidates: texts (by first place and size), items and the lowest diagonals of their bands; edits beyond the item's budget are no match.

    Items of one budget are aligned together. The same backwards from the end gives the start.
    """
    edits, start, end = np.full(len(item), 1 << 30), np.zeros(len(item), np.int64), np.zeros(len(item), np.int64)
    for e in np.unique(index.edits[item]).tolist():
        own = np.flatnonzero(index.edits[item] == e)
        width = 2 * (e + 1) + 2 * e + 1  # the band and the budget on both sides
        for few in np.array_split(own, max(1, -(-len(own) * width // CELLS))):
            known, which = np.unique(item[few], return_inverse=True)
            coded = [codes(index.texts[i]) for i in known.tolist()]
            lengths = np.array([len(c) for c in coded], np.int64)
            longest = int(lengths.max())

            def padded(turned: bool, coded=coded, longest=longest):
                out = np.zeros((len(coded), longest), np.uint32)
                for k, c in enumerate(coded):
                    out[k, : len(c)] = c[::-1] if turned else c
                return out

            n, where, budget = lengths[which], low[few] - e, np.full(len(few), e)
            left = np.ones(len(few), bool)
            # from the end first where an item's beginning is that of many: most bands are given up early
            rear = np.flatnonzero(index.rear[item[few]])
            if len(rear):
                place, m, text = where[rear], n[rear], few[rear]
                windows = _stretches(joined, first[text], size[text], place + m + width - 2, longest + width - 1, back=True)
                left[rear] = banded_alignments(padded(True)[which[rear]], m, windows, size[text] - m - place - width + 1, size[text], budget[rear])[0] <= e
            few, which, n, where, budget = few[left], which[left], n[left], where[left], budget[left]
            if not len(few):
                continue
            windows = _stretches(joined, first[few], size[few], where, longest + width - 1)
            found, stop = banded_alignments(padded(False)[which], n, windows, where, size[few], budget)
            good = np.flatnonzero(found <= e)
            if not len(good):
                continue
            hit, stop, found, n = few[good], stop[good], found[good], n[good]
            behind = _stretches(joined, first[hit], size[hit], stop - 1 + e, longest + 2 * e, back=True)
            behind[:, :e] = 0xFFFFFFFF  # before the reversed text's first character
            again, back = banded_alignments(padded(True)[which[good]], n, behind, np.full(len(hit), -e), np.minimum(stop, n + e), found, anchored=True)
            edits[hit], end[hit] = found, stop
            start[hit] = stop - np.where(again <= found, back, n)
    return edits, start, end


def _short_matches(index: Index, joined: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(text, item) -> (0, start, end) of the first place of each item that has no q-gram, as whole words."""
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    letter = (joined >= 97) & (joined <= 122) | (joined >= 48) & (joined <= 57) | (joined >= 128) & (joined < 0xFFFFFFF0)
    for length, (grams, items) in index.short.items():
        hashes = gram_hashes(joined, length)
        left = np.searchsorted(grams, hashes, "left")
        hit = np.flatnonzero((left < len(grams)) & (grams[np.minimum(left, len(grams) - 1)] == hashes))
        # a word may not go on on either side of the item's own first and last letter
        before = (hit > 0) & letter[np.maximum(hit - 1, 0)] & letter[hit]
        after = letter[np.minimum(hit + length, len(joined) - 1)] & (hit + length < len(joined)) & letter[hit + length - 1]
        for at in hit[~before & ~after].tolist():
            t = int(np.searchsorted(first, at, "right")) - 1
            for k in range(int(np.searchsorted(grams, hashes[at], "left")), int(np.searchsorted(grams, hashes[at], "right"))):
                start = at - int(first[t])
                found.setdefault((t, int(items[k])), (0, start, start + length))
    return found


def _halves(index: Index, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
    """``matches`` of texts in two parts; a single text is cut with an overlap that holds any match."""
    if len(texts) > 1:
        half = len(texts) // 2
        return matches(index, texts[:half]) + [(t + half, *rest) for t, *rest in matches(index, texts[half:])]
    half, overlap = len(texts[0]) // 2, 2 * index.longest + 1
    best: dict[int, tuple[int, int, int]] = {}
    for offset, part in ((0, texts[0][: half + overlap]), (half, texts[0][half:])):
        for _, i, edits, start, end in matches(index, [part]):
            found = (edits, start + offset, end + offset)
            best[i] = min(best.get(i, found), found)
    return [(0, i, *found) for i, found in sorted(best.items())]


def matches(index: Index, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, edits, start, end): for each text and item that stands in it the match of fewest edits, the first of them."""
    if not len(index.ids) or not texts:
        return []
    q, coded = index.q, [codes(t) for t in texts]
    gap = np.full(1, 0xFFFFFFFE, np.uint32)
    joined = np.concatenate([x for c in coded for x in (c, gap)])
    first = np.concatenate([[0], np.cumsum([len(c) + 1 for c in coded])])
    hashes = gram_hashes(joined, q)
    hit = np.flatnonzero(index.table[(hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
    left = np.searchsorted(index.grams, hashes[hit], "left")
    count = np.searchsorted(index.grams, hashes[hit], "right") - left
    hit, left, count = hit[count > 0], left[count > 0], count[count > 0]
    total = int(count.sum())
    if total > HITS and (len(texts) > 1 or len(texts[0]) > 8 * index.longest + 8):
        return _halves(index, texts)
    best: dict[tuple[int, int], tuple[int, int, int]] = _short_matches(index, joined, first)
    if not len(hit):
        return [(t, i, *found) for (t, i), found in sorted(best.items())]
    entry = np.repeat(left, count) + np.arange(total) - np.repeat(np.cumsum(count) - count, count)
    at, item = np.repeat(hit, count), index.item[entry]
    owner = np.searchsorted(first, at, "right") - 1
    diagonal = at - index.place[entry]
    band = diagonal // index.width[item]
    # band b has the diagonals b * width to (b + 2) * width, so each hit is in two, and any width + 1 diagonals are in one
    lowest = int(band.min()) - 1
    span = int(band.max()) - lowest + 2
    key = (owner * len(index.ids) + item) * span + (band - lowest)
    keys, hits = np.unique(np.concatenate([key, key - 1]), return_counts=True)
    pair = keys // span
    keep = hits >= index.needed[pair % len(index.ids)]
    owner, item = np.divmod(pair[keep], len(index.ids))
    low = (keys[keep] % span + lowest) * index.width[item] - first[owner]
    size = first[1:] - first[:-1] - 1
    # bands of one item and text that look alike are aligned once, where they come first
    if len(low) > MANY:
        owner, item, low = _once(index, joined, first, size, owner, item, low)
    edits, start, end = _aligned(index, joined, first[owner], size[owner], item, low)
    for k in np.flatnonzero(edits <= index.edits[item]).tolist():
        t, i = int(owner[k]), int(item[k])
        found = (int(edits[k]), int(start[k]), int(end[k]))
        if (t, i) not in best or found < best[t, i]:
            best[t, i] = found
    return [(t, i, *found) for (t, i), found in sorted(best.items())]


def _once(index: Index, joined: np.ndarray, first: np.ndarray, size: np.ndarray, owner: np.ndarray, item: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates (text, item, lowest diagonal) without those whose text in reach is that of an earlier one of the same text and item."""
    reach = index.longest + 4 * int(index.edits.max()) + 3
    lengths = np.array([len(t) for t in index.texts], np.int64)
    mixed = np.zeros(len(low), np.uint64)
    with np.errstate(over="ignore"):
        weights = BASE ** np.arange(1, reach + 1, dtype=np.uint64) | np.uint64(1)
        for few in np.array_split(np.arange(len(low)), max(1, len(low) * reach // (4 * CELLS))):
            e = index.edits[item[few]]
            seen = _stretches(joined, first[owner[few]], size[owner[few]], low[few] - e, reach)
            # as far as the item's own band reaches
            seen[np.arange(reach) >= (lengths[item[few]] + 4 * e + 2)[:, None]] = 0
            mixed[few] = (seen.astype(np.uint64) * weights).sum(axis=1)
    _, once = np.unique(np.stack([owner.astype(np.uint64), item.astype(np.uint64), mixed], axis=1), axis=0, return_index=True)
    once.sort()
    return owner[once], item[once], low[once]


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        overlap = 2 * index.longest + 1
        for batch in batches:
            rows: dict[tuple[int, int], tuple] = {}
            held: list[tuple[int, int, str]] = []
            size = 0

            def flush(held=held, rows=rows):
                for t, i, edits, start, end in matches(index, [h[2] for h in held]):
                    row, offset, _ = held[t]
                    found = (edits, start + offset, end + offset)
                    if (row, i) not in rows or found < rows[row, i]:
                        rows[row, i] = found
                held.clear()

            for row, value in enumerate(batch.column("text")):
                text = value.as_py()
                for at in range(0, max(1, len(text) - overlap), SCAN_CHARS):
                    part = text[at : at + SCAN_CHARS + overlap]
                    held.append((row, at, part))
                    size += len(part)
                    if size >= SCAN_CHARS:
                        flush()
                        size = 0
            flush()
            docs = batch.column("doc_id").to_pylist()
            out = [(docs[r], int(index.ids[i]), e, s, x) for (r, i), (e, s, x) in sorted(rows.items())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[k] for o in out], pa.int64() if k < 2 else pa.int32()) for k in range(5)], names=["doc_id", "item_id", "edits", "start", "end"]
            )

    return run


def _blocks(benchmark: DataFrame, q: int, share: float, min_chars: int, block_chars: int):
    """(number of blocks, broadcast index) of the benchmark's blocks, each of about ``block_chars`` characters, built one after the other."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and item_id is not null")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // block_chars))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).distinct().orderBy("item_id", "text").collect()
        yield blocks, benchmark.sparkSession.sparkContext.broadcast(build_index([(r[0], r[1]) for r in rows], q, share, min_chars))


def contamination(docs: DataFrame, benchmark: DataFrame, q: int = Q, share: float = MAX_EDIT_SHARE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, edits, start, end) for every text and item that stands in it within the edit budget.

    An item of n characters may differ in ``share`` of them, A-Z in either case and any blank for
    any other; start and end are code points of the text. Items of fewer than q characters match
    exactly, as whole words. Items without text or of blanks only, or of fewer than ``min_chars``
    characters, are no passages and match nothing. Of several places of an item in a text the one of
    fewest edits, then the first, is given. Texts without a match give no row; null and empty texts
    match nothing. Repeated rows are matched alike, with a doc_id or without. An empty benchmark or an
    empty table gives no rows. Of several blocks, each one's matches are written before the next is built.
    """
    texts, out = text_of(docs), None
    for blocks, shared in _blocks(benchmark, q, share, min_chars, block_chars):
        found = texts.mapInArrow(_scan(shared), "doc_id long, item_id long, edits int, start int, end int")
        if blocks > 1:
            found = materialize(found, "matches")
            shared.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


def _drop(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            texts = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), batch.column("text").fill_null("")], names=["doc_id", "text"])
            hit = {d for found in _scan(shared)(iter([texts])) for d in found.column("doc_id").to_pylist()}
            yield batch.filter(pa.array([i not in hit for i in range(n)], pa.bool_()))

    return run


def without_matches(docs: DataFrame, benchmark: DataFrame, q: int = Q, share: float = MAX_EDIT_SHARE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, that no item of the benchmark stands in; row by row, so ids may be null or repeat.

    Of several blocks, the rows that each one leaves are written before the next is built.
    """
    for blocks, shared in _blocks(benchmark, q, share, min_chars, block_chars):
        docs = docs.mapInArrow(_drop(shared), docs.schema)
        if blocks > 1:
            docs = materialize(docs, "left")
            shared.unpersist()
    return docs


def op10_decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, start, end) of every benchmark passage in every whole text; see ``contamination`` for nulls, ties and repeated rows."""
    return contamination(documents, benchmark)
