"""Functions and table functions that SQL calls by name: ``register(spark)`` and ``register_vocabulary(spark, kept)``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf, udtf
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators import bpe, scrub
from ..operators.vocabulary import Vocabulary
from ..sources.shards import decode_shard
from . import spdx

#: The fields of a manifest's sources, in their order.
FIELDS = ("id", "url", "revision", "license", "fetched", "category")
#: Merges that are made one after the other over whole texts; of more, each distinct piece is encoded by itself.
FEW_MERGES = 1_000


def scrub_text(texts: pa.Array) -> pa.Array:
    """A text with its secrets replaced; null for null."""
    return pa.array([t and scrub.redact(t, scrub.find(t)) for t in texts.to_pylist()], pa.string())


def scrub_find(texts: pa.Array) -> pa.Array:
    """The secrets of a text: rule, start and end in bytes; none for null."""
    kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    return pa.array([[dict(zip(("rule", "start", "end"), f, strict=True)) for f in scrub.find(t or "")] for t in texts.to_pylist()], kind)


def spdx_verdict(expressions: pa.Array) -> pa.Array:
    """The default policy's verdict on a licence expression; each distinct one of a batch is judged once."""
    values = expressions.to_pylist()
    known = {x: spdx.verdict(x) for x in set(values)}
    return pa.array([{"accepted": known[x].accepted, "reason": known[x].reason, "valid": known[x].valid} for x in values], pa.struct([("accepted", pa.bool_()), ("reason", pa.string()), ("valid", pa.bool_())]))


class ManifestRows:
    """``manifest_rows(text)``: a row for each source of a manifest, in order; of a wrong manifest the sources before the fault and a row that names its line."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        if text.dataType.simpleString() not in ("string", "void"):
            raise ValueError("manifest_rows takes a text")
        schema = StructType().add("ord", IntegerType())
        for name in (*FIELDS, "error"):
            schema = schema.add(name, StringType())
        return AnalyzeResult(schema)

    def eval(self, text: str):
        if text is None:
            return
        lines, ord_ = text.removesuffix("\n").split("\n"), 0
        for at in range(1, len(lines), len(FIELDS) + 1):
            record, values = lines[at : at + len(FIELDS) + 1], []
            for k, line in enumerate(record):
                if k and not (line.startswith(f"{FIELDS[k - 1]}: ") and len(line) > len(FIELDS[k - 1]) + 2) or not k and line:
                    yield (ord_, *[None] * len(FIELDS), f"line {at + k + 1}: expected " + (f"`{FIELDS[k - 1]}: <value>`" if k else "a blank line"))
                    return
                values += [line[len(FIELDS[k - 1]) + 2 :]] if k else []
            if len(values) < len(FIELDS):
                yield (ord_, *[None] * len(FIELDS), f"the text ends where `{FIELDS[len(values)]}:` was expected")
                return
            yield (ord_, *values, None)
            ord_ += 1


class ReadShard:
    """``read_shard(content, rows)``: the documents of a shard file's bytes, or its tokens in chunks of 65,536; ``rows`` is a constant that decides the columns."""

    @staticmethod
    def analyze(content: AnalyzeArgument, rows: AnalyzeArgument) -> AnalyzeResult:
        if content.dataType.simpleString() != "binary" or rows.value not in ("documents", "tokens"):
            raise ValueError("read_shard takes the bytes of a file and 'documents' or 'tokens'")
        return AnalyzeResult(StructType().add("n" if rows.value == "documents" else "start", LongType()).add("tokens", ArrayType(IntegerType())))

    def eval(self, content: bytes, rows: str):
        if content is None:
            return
        _, eos, listed = decode_shard(content)
        tokens = np.array(listed, np.int64)
        if rows == "tokens":
            for at in range(0, len(tokens), 65_536):
                yield at, tokens[at : at + 65_536].tolist()
            return
        ends = np.flatnonzero(tokens == eos)
        for n, (a, b) in enumerate(zip(np.concatenate([[0], ends[:-1] + 1]), ends, strict=True) if len(ends) else ()):
            yield n, tokens[a:b].tolist()


def register(spark: SparkSession) -> None:
    """``scrub_text``, ``scrub_find``, ``spdx_verdict``, ``manifest_rows`` and ``read_shard`` for SQL of this session."""
    finding, verdict = "array<struct<rule:string,start:int,end:int>>", "struct<accepted:boolean,reason:string,valid:boolean>"
    for function, kind in ((scrub_text, "string"), (scrub_find, finding), (spdx_verdict, verdict)):
        spark.udf.register(function.__name__, arrow_udf(function, kind))
    spark.udtf.register("manifest_rows", udtf(ManifestRows))
    spark.udtf.register("read_shard", udtf(ReadShard))


def register_vocabulary(spark: SparkSession, kept: Vocabulary) -> None:
    """``bpe_encode(text)`` and ``bpe_decode(ids)`` by a vocabulary, which is broadcast; special tokens' strings in a text are text."""
    shared = spark.sparkContext.broadcast(({pair: r for r, pair in enumerate(kept.merges)}, kept.pieces(), kept.splitter.pattern))

    @arrow_udf("array<int>")
    def bpe_encode(texts: pa.Array) -> pa.Array:
        rank, piece, pattern = shared.value
        find, known = regex.compile(pattern).findall, {}
        # what ends in byte 255 is in no text, so that byte may stand between pieces
        steps = [(chr(a) + chr(b), chr(256 + r)) for (a, b), r in rank.items() if b"\xff" not in piece[256 + r]]

        def by_steps(parts: list[str]) -> np.ndarray:
            """Merges one after the other over the whole text: one can only make room for later ones."""
            if len(max(parts, key=len, default="")) * 4 > bpe.MAX_PIECE:
                parts = [x.decode() for p in parts for x in bpe.short_parts(p.encode())]
            made = "\udcff".join(parts).encode("utf-8", "surrogateescape").decode("latin-1")
            for pair, new in steps:
                made = made.replace(pair, new)
            return np.frombuffer(made.replace("\xff", "").encode("utf-32-le"), "<i4")

        def by_pieces(parts: list[str]) -> np.ndarray:
            ids = []
            for part in parts:
                if part not in known:
                    known[part] = [i for x in bpe.short_parts(part.encode()) for i in bpe.encode_piece(x, rank)]
                ids += known[part]
            return np.array(ids, np.int32)

        encoded = by_steps if len(rank) <= FEW_MERGES else by_pieces
        out = [np.zeros(0, np.int32) if text is None else encoded(find(text)) for text in texts.to_pylist()]
        cuts = np.concatenate([[0], np.cumsum([len(o) for o in out])])
        return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *out]), pa.int32()), mask=texts.is_null())

    @arrow_udf("binary")
    def bpe_decode(lists: pa.Array) -> pa.Array:
        piece = shared.value[1]
        whole, sizes = np.frombuffer(b"".join(piece[i] for i in range(len(piece))), np.uint8), np.array([len(piece[i]) for i in range(len(piece))], np.int64)
        starts, values, cuts = np.cumsum(sizes) - sizes, lists.values.fill_null(-1).to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        out: list[bytes | None] = []
        for null, a, b in zip(lists.is_null().to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            ids = values[a:b]
            if null or len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < len(piece):
                out.append(None)
                continue
            n = sizes[ids]
            at = np.repeat(starts[ids] - (np.cumsum(n) - n), n)
            out.append(whole[at + np.arange(len(at))].tobytes())
        return pa.array(out, pa.binary())

    spark.udf.register("bpe_encode", bpe_encode)
    spark.udf.register("bpe_decode", bpe_decode)
