"""What the operators of this subpackage share: word splitting, scratch tables, bounded slices of batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize, scratch_path  # noqa: F401

#: A word: no space, tab, newline, vertical tab, form feed or carriage return in it.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]"


def text_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, a null text as the empty one; other columns never reach an operator."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


#: A key is heavy if it has more than this part of all rows, so at most as many keys are.
HEAVY = 2_000
#: Rows and bytes up to which a table whose size was counted is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16_000_000


def join_heavy(rows: DataFrame, facts: DataFrame, keys: list[str], n: str, total: int, how: str = "inner", slim: Column | None = None) -> DataFrame:
    """``rows`` joined with ``facts`` (one row for each key, whose column ``n`` says how many rows have it) without a hot key.

    Keys with more than one in ``HEAVY`` of the ``total`` rows, of which there are no more than
    ``HEAVY``, are broadcast, found by a hash of the key; the other ones are joined by shuffle, where
    none of them can fill a task. ``slim`` says which facts are small enough to be broadcast. Both
    tables should be written ones.
    """
    heavy = F.col(n) * HEAVY > total
    hashed = F.xxhash64(*keys)
    often = [r[0] for r in facts.where(heavy & slim if slim is not None else heavy).select(hashed).distinct().collect()]
    if not often:
        return rows.join(facts.drop(n), keys, how)
    # as text: thousands of literals one by one take the driver seconds
    own = F.expr(f"xxhash64({', '.join(f'`{k}`' for k in keys)}) IN ({', '.join(map(str, often))})")
    return rows.where(own).join(F.broadcast(facts.where(own).drop(n)), keys, how).unionByName(rows.where(~own).join(facts.where(~own).drop(n), keys, how))


def small(df: DataFrame, *texts: str) -> bool:
    """Whether a written table is small enough to be broadcast, by its rows and the bytes of its columns ``texts``."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(0))
    n, width = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return n <= BROADCAST_ROWS and width <= BROADCAST_BYTES


def plain_form(pattern: str, ranges: dict[str, str]) -> str | None:
    """The pattern in terms of the standard library's engine, with its classes as ``ranges`` of characters; None if it has others."""
    out, rest, inside = [], pattern, False
    while rest:
        known = next((k for k in (*ranges, r"\S") if rest.startswith(k)), None)
        if known is None and rest[0] == "\\" and len(rest) > 1 and rest[1].isalnum() or known == r"\S" and inside:
            return None
        token = known or (rest[:2] if rest[0] == "\\" else rest[0])
        inside = token == "[" or inside and token != "]"
        own = ranges[r"\s" if known == r"\S" else known] if known else ""
        out.append((f"[^{own}]" if known == r"\S" else own if inside else f"[{own}]") if known else token)
        rest = rest[len(token) :]
    return "".join(out)


ASCII_CLASSES = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9", r"\s": r"\t-\r "}


@lru_cache(maxsize=1)
def plane_classes() -> dict[str, str]:
    """The same classes over all characters below U+10000, as the general engine has them."""
    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))

    def ranges(name: str) -> str:
        found = [m.span() for m in regex.compile(f"{name}+").finditer(plane)]
        return "".join(f"\\u{ord(plane[a]):04x}-\\u{ord(plane[b - 1]):04x}" for a, b in found)

    return {name: ranges(name) for name in ASCII_CLASSES}


def splitter(pattern: str):
    """text -> its pre-tokens. Texts without characters beyond U+FFFF go to the standard library's engine, which is several times faster, with fewer ranges if they are ASCII."""
    general, plain = regex.compile(pattern).findall, plain_form(pattern, ASCII_CLASSES)
    if plain is None:
        return general
    simple, wide, beyond = re.compile(plain).findall, re.compile(plain_form(pattern, plane_classes())).findall, re.compile("[\U00010000-\U0010ffff]").search
    return lambda text: simple(text) if text.isascii() else general(text) if beyond(text) else wide(text)


def slices(batches: Iterator[pa.RecordBatch], max_chars: int = 2_000_000, text: int = 1) -> Iterator[list[list]]:
    """The columns of each batch as lists, cut into runs of rows of about ``max_chars`` characters of text."""
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        start = size = 0
        for row, value in enumerate(columns[text]):
            if size and size + len(value) > max_chars:
                yield [c[start:row] for c in columns]
                start, size = row, 0
            size += len(value)
        if start < len(columns[text]):
            yield [c[start:] for c in columns]


def text_key() -> Column:
    """By which a text is known, whatever its doc_id: 16 bytes of its SHA-256, a null text like the empty one."""
    return F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), 1, 16)
