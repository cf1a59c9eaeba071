"""Operator 13, runs of a repeated stretch of words, by Karp-Miller-Rosenberg names.

Names: at level 0 a word of a document is named by a number that equal words of that document share; at
level k + 1 the stretch of 2^(k+1) words from a place on is named by the pair of names of its halves. A
stretch that stands once in its document has the name -1, which equals nothing, and only pairs of
halves that stand more than once are sorted, so levels thin out quickly where little is repeated. The
words of a slice of a batch are named together; names of different documents never meet.

Candidates: a run of period q has at least 4 q words, so it holds the places i, i + q and the 2^k <= q
words after each, for one i of the grid of multiples of 2 q. Where the names of level k agree there, the
longest common extension forwards and backwards is measured by going down the levels once, all
candidates of a period at a time in numpy, and gives the run's exact ends. A candidate inside a known
run whose period divides q is the same run and is passed over, so each run comes up with its smallest
period. No hashes are compared and no suffixes sorted.

The step is a map: no shuffle; memory is one slice of a batch (or one text), with one number for each
word and level on which anything is repeated.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, text_of

#: A run has at least so many words, and so many times its period.
MIN_WORDS, MIN_EXPONENT = 6, 4


def words_of(doc_id: int | None, text: str) -> list[bytes]:
    """The words of a text in UTF-8; bytes are split at exactly the blanks that separate words."""
    return text.encode("utf-8").split()


def planted_words(doc_id: int | None, text: str) -> list[bytes]:
    """``words_of``, the end of every tenth document by the checksum of its id made periodic; rows without an id stay as they are."""
    words = words_of(doc_id, text)
    n = len(words)
    if doc_id is None or not n:
        return words
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def _shared(keys: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """Names of n places: equal keys share a number, keys that stand once and other places have -1."""
    out = np.full(n, -1, np.int32)
    if len(keys):
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        name = np.cumsum(new) - 1
        again = np.bincount(name)[name] > 1
        out[places[order[again]]] = name[again]
    return out


def names(words: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """Levels of names of places: ``words`` are numbers of words, ``doc`` numbers of documents, ascending."""
    n = len(words)
    levels = [_shared(doc.astype(np.int64) << 32 | words, np.arange(n), n)]
    while True:
        last, step = levels[-1], 1 << (len(levels) - 1)
        first = np.flatnonzero(last[: max(n - step, 0)] >= 0)
        first = first[last[first + step] >= 0]
        found = _shared(last[first].astype(np.int64) << 32 | last[first + step], first, n)
        if not (found >= 0).any():
            return levels
        levels.append(found)


def _extensions(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair i < j: how many words from i and from j on agree, and how many before them do.

    No level above the top one has equal names, so no extension is as long as two stretches of the top level.
    """
    n, ahead, back = len(levels[0]), np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        name = levels[k]
        at, to = i + ahead, np.minimum(j + ahead, n - 1)
        ahead += np.where((j + ahead < n) & (name[at] >= 0) & (name[at] == name[to]), 1 << k, 0)
        at, to = np.maximum(i - back - (1 << k), 0), np.maximum(j - back - (1 << k), 0)
        back += np.where((i - back >= 1 << k) & (name[at] >= 0) & (name[at] == name[to]), 1 << k, 0)
    return ahead, back


def find_runs(words: np.ndarray, doc: np.ndarray, min_words: int = MIN_WORDS) -> np.ndarray:
    """Rows (start, length, period), by period and start, of all runs of all documents; places count over the whole array."""
    n = len(words)
    if n < min_words:
        return np.zeros((0, 3), np.int64)
    levels = names(words, doc)
    longest, seen = int(np.bincount(doc).max()), set()  # equal ends: the same run, by a multiple of its period
    found, period, end = [], np.zeros(n, np.int64), np.zeros(n, np.int64)  # of the known run over a place: its period and end
    for q in range(1, min(longest // MIN_EXPONENT, (1 << len(levels)) - 1) + 1):
        name = levels[q.bit_length() - 1]
        left = name[: n - q : 2 * q]
        i = np.flatnonzero((left >= 0) & (left == name[q :: 2 * q][: len(left)])) * (2 * q)
        if not len(i):
            continue
        known = period[i]
        i = i[(known == 0) | (q % np.maximum(known, 1) != 0) | (i + q >= end[i])]
        if not len(i):
            continue
        ahead, back = _extensions(levels, i, i + q)
        start, length = i - back, ahead + back + q
        fits = length >= max(min_words, MIN_EXPONENT * q)
        for s, size in sorted(set(zip(start[fits].tolist(), length[fits].tolist(), strict=True)) - seen):
            seen.add((s, size))
            found.append((s, size, q))
            period[s : s + size], end[s : s + size] = q, s + size
    return np.array(found, np.int64).reshape(-1, 3)


def _judged(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """A document's row: runs are (start, length, period) within it."""
    runs.sort(key=lambda r: (r[0], r[2]))
    listed = "".join([f"{s},{size},{q}\n" for s, size, q in runs])
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    kept = words
    if runs:
        mask = np.ones(len(words), bool)
        for s, size, q in runs:
            mask[s + q : s + size] = False
        kept = [words[k] for k in np.flatnonzero(mask).tolist()]
    collapsed = b" ".join(kept)
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest(), listed, collapsed.decode("utf-8"))


def _slice_rows(ids: list, texts: list[str], split: Callable[[int | None, str], list[bytes]]) -> list[tuple]:
    words = [split(i, t) for i, t in zip(ids, texts, strict=True)]
    sizes = np.array([len(w) for w in words], np.int64)
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    number: dict[bytes, int] = {}
    flat = np.fromiter((number.setdefault(w, len(number)) for own in words for w in own), np.int64, int(firsts[-1]))
    doc = np.repeat(np.arange(len(words)), sizes)
    runs: list[list] = [[] for _ in words]
    for s, size, q in find_runs(flat, doc).tolist():
        d = int(doc[s])
        runs[d].append((s - int(firsts[d]), size, q))
    return [_judged(w, r) for w, r in zip(words, runs, strict=True)]


_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_TYPES = [pa.int64()] * 5 + [pa.string()] * 4


def periodic_runs(docs: DataFrame, split: Callable[[int | None, str], list[bytes]] = words_of, texts: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: the number of runs, the run with the greatest exponent, digests of all runs and of the text with each run cut to its first period.

    A run is a longest stretch of at least max(6, 4 q) words whose smallest period is q. ``start`` and
    ``length`` count words. With ``texts`` also ``runs`` (a line ``start,length,period`` for each) and
    ``collapsed`` (kept words joined by one space). ``split`` gives the words of (doc_id, text). Of equal
    exponents the least start, then the least period counts; no run gives four nulls. A null text has no
    words, and neither has an empty one: no runs, digests of nothing. Rows without an id or that repeat
    are rows of their own; an empty table gives none; other columns are left out, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, own in slices(batches):
            columns = list(zip(*_slice_rows(ids, own, split), strict=True))
            found = [pa.array(ids, pa.int64()), *(pa.array(c, kind) for c, kind in zip(columns, _TYPES, strict=True))]
            names_ = [*(f.split()[0] for f in _SCHEMA.split(", ")), "runs", "collapsed"]
            keep = len(names_) if texts else len(names_) - 2
            yield pa.RecordBatch.from_arrays(found[:keep], names=names_[:keep])

    return text_of(docs, id_col, text_col).mapInArrow(run, _SCHEMA + (", runs string, collapsed string" if texts else ""))


def op13_periodic_runs(documents: DataFrame) -> DataFrame:
    """The runs of every whole text, with the ends of every tenth document made periodic first.

    Nulls, ties, repeated rows, clashing columns and empty tables as in ``periodic_runs``.
    """
    return periodic_runs(documents, planted_words, texts=False)
