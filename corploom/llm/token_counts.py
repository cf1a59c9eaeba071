"""Operator 3, exact token counts at every prefix by dynamic programming.

Pre-tokens are encoded apart from each other, so the count of a prefix is the sum over the pieces
that end in it and the count of the prefix of the piece it cuts. Within a piece the counts come
from one left-to-right pass: the last token of the encoding of each prefix is the one token that
ends there and stands validly after the last token of the prefix before it, where two tokens are a
valid pair if undoing their merges never shows a merge across them that would have come first.

A text's counts are stored in two levels: for each piece the count at its end, special tokens among
them, and for each distinct piece the counts of all of its prefixes. Totals, truncations and budget
questions are read off by a search in the first and a look into the second, without encoding again;
``prefix_counts`` gives them out in full. The step is a map: no shuffle, and its memory is one slice of
a batch, one text's counts and a bounded table of pieces.

The tokens that may end at a place come from an automaton of the vocabulary for long pieces. In a run of
one byte the last tokens repeat after a while, and from there on counts go up by one for each repetition,
so a run of any length costs no more than its start.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import splitter, text_of

#: Distinct pieces whose counts a worker remembers; beyond that it starts anew, which costs time only.
REMEMBERED = 500_000
#: Bytes from which on a piece is looked through by the automaton.
LONG = 96


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable Latin-1 for itself, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts of a byte-level vocabulary with ranked merges, by its library's JSON file."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as lines:
            spec = json.load(lines)
        letter = byte_letters()
        raw = lambda token: bytes([letter[c] for c in token])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.rank: dict[bytes, int] = {bytes([b]): b for b in range(256)}  # a token's number: bytes, then merges by rank
        self.halves: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        for merge in spec["model"]["merges"]:
            left, right = map(raw, merge if isinstance(merge, list) else merge.split(" "))
            pair, new = (self.rank[left], self.rank[right]), len(self.halves)
            self.rank[left + right] = self.merged[pair] = new
            self.halves.append(pair)
        self.longest = max(map(len, self.rank))
        self.pieces = splitter(pattern)
        self.blank = regex.compile(r"\s+").fullmatch
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.totals = _Totals(self)
        self.stored: dict[str, array] = {}
        self.runs: dict[int, tuple[list[int], list[int]]] = {}
        self.pairs: dict[int, bool] = {}

    def valid(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' bytes is these two tokens."""
        if len(self.pairs) > REMEMBERED // 3:
            self.pairs.clear()
        found = self.pairs[left << 32 | right] = self._valid(left, right)
        return found

    def _valid(self, left: int, right: int) -> bool:
        bound = len(self.halves)  # merges from here on come later than those undone so far
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < bound:
                return False
            # undo the later of the two merges; on equal rank the right one, which the left one beat by standing first
            if left > right and left > 255:
                bound, left = left, self.halves[left][1]
            elif right > 255:
                bound, right = right + 1, self.halves[right][0]
            else:
                return True

    def prefix_counts(self, piece: bytes) -> list[int] | array:
        """Tokens of each prefix of a pre-token, from the empty one to the whole."""
        if len(piece) >= LONG:
            return self._run_counts(piece[0], len(piece)) if piece.count(piece[0]) == len(piece) else self._long_counts(piece)
        last, counts, rank, longest, pairs = [-1], [0], self.rank.get, self.longest, self.pairs
        for end in range(1, len(piece) + 1):
            for start in range(max(0, end - longest), end):
                token = rank(piece[start:end])
                if token is None:
                    continue
                if start:
                    found = pairs.get(last[start] << 32 | token)
                    if not (self.valid(last[start], token) if found is None else found):
                        continue
                last.append(token)
                counts.append(counts[start] + 1)
                break
        return counts

    @cached_property
    def automaton(self):
        """Finds all tokens that end at a place, the longest first; bytes stand as characters."""
        found = ahocorasick.Automaton()
        for token, number in self.rank.items():
            found.add_word(token.decode("latin-1"), (number, len(token)))
        found.make_automaton()
        return found

    def _long_counts(self, piece: bytes) -> array:
        last, counts, pairs = array("i", [-1]), array("i", [0]), self.pairs
        for end, (token, size) in self.automaton.iter(piece.decode("latin-1")):
            if len(counts) > end + 1:
                continue  # this place has its last token
            start = end + 1 - size
            if start:
                found = pairs.get(last[start] << 32 | token)
                if not (self.valid(last[start], token) if found is None else found):
                    continue
            last.append(token)
            counts.append(counts[start] + 1)
        return counts

    def _run_counts(self, byte: int, n: int) -> np.ndarray | list[int]:
        """Counts of a run of one byte: what ends at a place depends on the last tokens of the ``longest`` places before alone."""
        known = self.runs.get(byte)
        if known is None:
            tokens = [(self.rank[token], len(token)) for k in range(self.longest, 0, -1) if (token := bytes([byte]) * k) in self.rank]
            last, counts = [-1], [0]
            for end in range(1, 16 * self.longest + 1):
                token, size = next((t, k) for t, k in tokens if k == end or k < end and self.valid(last[end - k], t))
                last.append(token)
                counts.append(counts[end - size] + 1)
            known = self.runs[byte] = (last, counts)
        last, counts = known
        if n < len(counts):
            return counts[: n + 1]
        tail = self.longest + 1
        for period in range(1, 8 * self.longest):
            if last[-tail:] == last[-tail - period : -period]:
                # from here on each place is that of a period before, with so many tokens more
                more, cycle = counts[-1] - counts[-1 - period], np.array(counts[-period:], np.int64)
                turns = np.arange(1, -(-(n + 1 - len(counts)) // period) + 1)
                return np.concatenate([counts, (cycle + turns[:, None] * more).ravel()])[: n + 1]
        return self._long_counts(bytes([byte]) * n)

    def prefix(self, piece: str):
        """The stored counts of a piece's prefixes, by bytes."""
        found = self.stored.get(piece)
        if found is None:
            self.totals[piece]  # short pieces are stored with their totals
            found = self.stored.get(piece)
        return self.prefix_counts(piece.encode("utf-8")) if found is None else found

    def ends(self, text: str) -> tuple[list[str], list[int]]:
        """The pieces of a text without special tokens, and the tokens up to the end of each of them, from 0 on."""
        pieces = self.pieces(text)
        return pieces, list(accumulate(map(self.totals.__getitem__, pieces), initial=0))

    def segments(self, text: str) -> tuple[list[str], list[int]]:
        """``ends`` of any text; the string of a special token is a piece of one token."""
        parts = self.parts(text)
        if len(parts) == 1:
            return self.ends(text)
        pieces, ends = [], [0]
        for i, part in enumerate(parts):
            own = [part] if i % 2 else self.pieces(part)
            pieces += own
            for piece in own:
                ends.append(ends[-1] + (1 if i % 2 else self.totals[piece]))
        return pieces, ends

    def parts(self, text: str) -> list[str]:
        """Ordinary text and special tokens' strings in turn."""
        return self.cut(text) if self.cut and any(s in text for s in self.special) else [text]

    def count(self, text: str) -> int:
        """Tokens of a text; a special token's string in it is one token, as is the library's default."""
        return self.segments(text)[1][-1]

    def text_counts(self, text: str) -> list[int]:
        """Tokens of every prefix of a text, by characters, from the empty prefix to the whole text.

        A cut within a piece counts that piece's prefix; where a shorter text splits otherwise than
        the whole does (blanks before a word, the letters of a contraction), the tail is split anew.
        """
        out, done = [0], 0
        parts, pieces = self.parts(text), []
        for i, part in enumerate(parts):
            if i % 2:
                # a special string that is cut is ordinary text; only the last piece before it may go on into it
                tail = pieces[-1] if pieces else ""
                base = done - (self.totals[tail] if tail else 0)
                out += [base + self.ends(tail + part[:k])[1][-1] for k in range(1, len(part))] + [done + 1]
                done, pieces = out[-1], []
                continue
            before, blank = done, ""
            pieces = self.pieces(part)
            for piece in pieces:
                if self.blank(piece):
                    # blanks at a prefix's end are one piece, together with those just before
                    blank += piece
                    own = self.prefix(blank)
                    if blank.isascii():
                        out += [before + int(n) for n in own[len(blank) - len(piece) + 1 :]]
                    else:
                        places = list(accumulate(len(c.encode("utf-8")) for c in blank))[len(blank) - len(piece) :]
                        out += [before + int(own[p]) for p in places]
                    done += self.totals[piece]
                    continue
                if blank and self.blank(piece[0]):
                    out.append(before + self.totals[blank + piece[0]])
                    start = 1
                else:
                    start = 0
                own, at = self.prefix(piece), len(piece[:start].encode("utf-8"))
                contraction = piece[0] == "'" and len(piece) > 2 and piece[1].isalpha()
                for k in range(start, len(piece)):
                    at += len(piece[k].encode("utf-8"))
                    out.append(done + (self.ends(piece[: k + 1])[1][-1] if contraction and k + 1 < len(piece) else int(own[at])))
                done += int(own[-1])
                before, blank = done, ""
        return out

    def fit(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens; a negative budget fits nothing and gives 0."""
        return self.within(text, *self.segments(text), budget)

    def within(self, text: str, pieces: list[str], ends: list[int], budget: int) -> int:
        """``fit`` by the counts at the ends of the text's pieces: a search for the piece that goes beyond the budget, and a look at the prefixes of those around it."""
        over = bisect_right(ends, budget)  # the piece whose end is the first beyond the budget
        if over == len(ends):
            return len(text)
        # a prefix that ends in a later piece but the next has more tokens; blanks join those just before
        first, last = max(0, over - 6), min(len(pieces), over + 1)
        start = sum(map(len, pieces[:first]))
        near = self.text_counts(text[start : start + sum(map(len, pieces[first:last]))])
        return start + max((k for k, n in enumerate(near) if ends[first] + n <= budget), default=0)


class _Totals(dict):
    """piece -> its tokens; the counts of its prefixes are stored beside, of at most ``REMEMBERED`` pieces of 64 characters or fewer."""

    def __init__(self, counter: PrefixCounter):
        self.counter = counter

    def __missing__(self, piece: str) -> int:
        counts = self.counter.prefix_counts(piece.encode("utf-8"))
        total = int(counts[-1])
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
                self.counter.stored.clear()
            self[piece], self.counter.stored[piece] = total, array("H", counts)
        return total


@lru_cache(maxsize=2)
def _counter(path: str, pattern: str) -> PrefixCounter:
    """One per worker process."""
    return PrefixCounter(path, pattern)


def _counts(path: str, pattern: str, limit: int, prefixes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, pattern)
        for batch in batches:
            n_bytes, n_tokens, fits, stored = [], [], [], []
            for value in batch.column("text"):
                text = value.as_py()
                n_bytes.append(len(text) if text.isascii() else len(text.encode("utf-8")))
                pieces, ends = counter.segments(text)
                total = ends[-1]
                n_tokens.append(total)
                fits.append(len(text) if total <= limit else counter.within(text, pieces, ends, limit))
                if prefixes:
                    stored.append(counter.text_counts(text))
            columns = [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_()), pa.array(fits, pa.int64())]
            names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "limit_chars"]
            if prefixes:
                columns, names = [*columns, pa.array(stored, pa.list_(pa.int32()))], [*names, "prefix_counts"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def prefix_token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 1024, prefixes: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, limit_chars and, if asked for, ``prefix_counts``: the tokens of each prefix, by characters.

    ``limit_chars`` is the length of the longest prefix of at most ``limit`` tokens, read off the
    counts of prefixes. With ``prefix_counts`` any other budget question is one of the array, without
    encoding again. A null text counts as the empty one (no bytes, no tokens); every row gives one
    row, rows that repeat and those without an id too.
    """
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, limit_chars long" + (", prefix_counts array<int>" if prefixes else "")
    return text_of(docs, id_col, text_col).mapInArrow(_counts(path, pattern, limit, prefixes), schema)


def op3_token_counts(documents: DataFrame) -> DataFrame:
    """Counts of byte_bpe_50k.json over every whole text, from the counts of prefixes at the ends of pieces.

    ``limit_chars`` answers the truncation to 1,024 tokens. Nulls and repeated rows as in
    ``prefix_token_counts``; an empty table gives no rows.
    """
    import public_tokenizers

    return prefix_token_counts(documents, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, prefixes=False)
