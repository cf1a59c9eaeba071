"""Operator 5, byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks that overlap. Each chunk is split into pre-tokens on its own, as its own
row. The pre-token pattern looks only ahead, so where two neighbours have a boundary in common both
are right from there on: the earliest such place in the overlap is where they are stitched. What
lies between two stitches is split and encoded piece by piece as one row, and the rows of a text
are put together by their order. Texts of one chunk need no stitch and no shuffle.

A neighbour that never falls into step (one pre-token over a whole chunk, say) is joined to the
chunk before it and split again as one text, so the result is exact for every text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import splitter, text_of

#: Characters of a chunk and of the overlap with the next, and how near a chunk's end a boundary isn't trusted.
CHUNK, OVERLAP, MARGIN = 1 << 16, 1 << 10, 8
#: Distinct pieces that a worker remembers, about 40 MB; beyond that it starts anew, which costs time only.
REMEMBERED = 100_000


@lru_cache(maxsize=4)
def _coder(ranks_path: str, pattern: str):
    """(encode piece to (ids as text, number of ids, bytes of the decoded ids), find pieces), once per worker process."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    bytes_of = {rank: token for token, rank in ranks.items()}
    known: dict[str, tuple[str, int, bytes]] = {}

    def code(piece: str) -> tuple[str, int, bytes]:
        found = known.get(piece)
        if found is None:
            ids = encoding.encode_ordinary(piece)  # a pre-token by itself is one pre-token
            found = " ".join(map(str, ids)), len(ids), b"".join([bytes_of[i] for i in ids])
            if len(piece) <= 64:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[piece] = found
        return found

    return code, splitter(pattern)


def _boundaries(pattern: str, chunk: int, overlap: int):
    """Arrow map: adds the places (from the text's start) in either overlap at which a chunk's pieces begin, those near its end left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = regex.compile(pattern).finditer
        for batch in batches:
            places = []
            for t, s, end in zip(*(batch.column(c).to_pylist() for c in ("text", "start", "last")), strict=True):
                trusted = len(t) if end else len(t) - MARGIN
                found = [m.start() for m in pieces(t)]
                # after blanks a boundary may depend on what comes next, so a text is never cut there
                places.append([s + p for p in found[1:] if (p <= overlap or chunk <= p) and p <= trusted and not t[p - 1].isspace()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.list_(pa.int32()))], names=[*batch.schema.names, "places"])

    return run


def _coded(id_type: str, digests: bool) -> str:
    return f"id {id_type}, n_tokens long, ids string, raw {'string' if digests else 'binary'}"


def _encode(ranks_path: str, pattern: str, digests: bool):
    """Arrow map: (id, text) to (id, n_tokens, ids as text, decoded bytes), the last two as digests if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, split = _coder(ranks_path, pattern)
        for batch in batches:
            n, ids, raw = [], [], []
            for text in batch.column("text"):
                coded = [code(p) for p in split(text.as_py())]
                joined, decoded = " ".join([c[0] for c in coded]), b"".join([c[2] for c in coded])
                n.append(sum([c[1] for c in coded]))
                ids.append(hashlib.sha256(joined.encode()).hexdigest() if digests else joined)
                raw.append(hashlib.sha256(decoded).hexdigest() if digests else decoded)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string() if digests else pa.binary())], names=["id", "n_tokens", "ids", "raw"]
            )

    return run


def _chunks(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                text, of = batch.column("text")[row].as_py(), batch.slice(row, 1)
                starts = range(0, len(text), chunk)
                for few in range(0, len(starts), 64):
                    own = starts[few : few + 64]
                    same = [of.column(c).take(pa.array([0] * len(own))) for c in ("key", "digest", "copies")]
                    parts = [pa.array([text[s : s + chunk + overlap] for s in own], pa.string()), *(pa.array(x, pa.int32()) for x in ([s // chunk for s in own], list(own)))]
                    yield pa.RecordBatch.from_arrays([*same, *parts, pa.array([s + chunk >= len(text) for s in own])], names=["key", "digest", "copies", "text", "seq", "start", "last"])

    return run


def chunks(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(key, digest, copies, text) with its chunks for its text: ``chunk`` characters each and ``overlap`` of the next."""
    return texts.select("key", "digest", "copies", "text").mapInArrow(_chunks(chunk, overlap), "key long, digest string, copies long, text string, seq int, start int, last boolean")


def segments(texts: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Long texts to (key, digest, copies, seq, text): stretches between stitches, each split on its own as within its text."""
    cut = chunks(texts, chunk, overlap)
    places = cut.mapInArrow(_boundaries(pattern, chunk, overlap), cut.schema.simpleString()[7:-1] + ",places:array<int>")
    by_text = Window.partitionBy("key", "digest").orderBy("seq")
    common = F.array_min(F.array_intersect(F.filter("places", lambda p: p >= F.col("start")), F.lag("places").over(by_text)))
    found = places.withColumn("from", F.when(F.col("seq") == 0, 0).otherwise(common)).drop("places")
    # a chunk is right from its stitch on if all before it were stitched too; the rest joins the stretch before it
    broken = F.max(F.col("from").isNull()).over(by_text.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = found.withColumn("from", F.when(~broken, F.col("from")))
    found = found.withColumn("to", F.lead("from").over(by_text)).withColumn("stretch", F.last("from", ignorenulls=True).over(by_text))
    begin = F.coalesce("from", "start")
    end = F.coalesce("to", F.when(F.col("last"), F.col("start") + F.length("text")).otherwise(F.col("start") + chunk))
    part = F.struct("seq", F.substring("text", begin - F.col("start") + 1, end - begin).alias("text"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["text"]), "")
    return found.groupBy("key", "digest", "copies", "stretch").agg(joined.alias("text")).withColumnRenamed("stretch", "seq")


def chunked_encode(texts: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, digests: bool = False) -> DataFrame:
    """(key, text) to (key, n_tokens, ids, raw): the ids as decimal text and the decoded bytes, or their SHA-256.

    A text up to ``chunk`` characters is one row of one map; only longer ones are cut, stitched and
    shuffled, by key and place, a text's stretches back to one row at the end. Longer rows that
    repeat key and text are encoded once and returned as often as they came. A null key is kept.
    An empty text has no ids and no bytes.
    """
    short = texts.where(F.length("text") <= chunk)
    coded = short.select(F.struct("key").alias("id"), "text").mapInArrow(_encode(ranks_path, pattern, digests), _coded("struct<key:bigint>", digests)).select("id.*", "n_tokens", "ids", "raw")
    long = texts.where(F.length("text") > chunk).withColumn("digest", F.sha2("text", 256))
    long = long.groupBy("key", "digest").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    pieces = segments(long, pattern, chunk, overlap).select(F.struct("key", "digest", "copies", "seq").alias("id"), "text")
    parts = pieces.mapInArrow(_encode(ranks_path, pattern, False), _coded("struct<key:bigint,digest:string,copies:bigint,seq:int>", False)).select("id.*", "n_tokens", "ids", "raw")
    # one text's stretches in order; bytes as hex, since array_join takes strings
    folded = F.sort_array(F.collect_list(F.struct("seq", "ids", F.hex("raw").alias("raw"))))
    whole = parts.groupBy("key", "digest", "copies").agg(F.sum("n_tokens").alias("n_tokens"), folded.alias("parts"))
    ids = F.array_join(F.transform(F.filter("parts", lambda p: p["ids"] != ""), lambda p: p["ids"]), " ")
    raw = F.unhex(F.array_join(F.transform("parts", lambda p: p["raw"]), ""))
    whole = whole.select("key", "n_tokens", (F.sha2(ids, 256) if digests else ids).alias("ids"), (F.sha2(raw, 256) if digests else raw).alias("raw"), F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    return coded.unionByName(whole.drop("copy"))


def op5_bpe_codec(documents: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text; a null text is the empty one.

    Every input row gives one row, rows that repeat and rows without a doc_id too.
    """
    import public_tokenizers

    ranks_path, pattern = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    texts = text_of(documents).withColumnRenamed("doc_id", "key")
    coded = chunked_encode(texts, ranks_path, pattern, digests=True)
    return coded.select(F.col("key").alias("doc_id"), "n_tokens", F.col("ids").alias("ids_sha256"), F.col("raw").alias("decoded_sha256"))
