"""Token shards as a Spark data source: ``spark.read.format("token_shards")`` and ``df.write.format("token_shards")``.

Writing streams: the tokens of a shard come as rows in order, packed on the way, go to the file at once, and a running
digest ends it; what a shard will hold is known from the packing, since a file's header tells it. The
driver commits the files of all tasks in one step (``committed``). Reading gives a file a partition and
never a whole shard a row: chunks of tokens, documents, or windows for training, by the option ``rows``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition

from ..operators import bpe, packing
from ..operators.vocabulary import Vocabulary
from ..scratch import materialize, qualified
from .committed import Commit, Written, committed, file_system, open_file
from .shards import header, read_header

#: How a document's ids are packed on their way to its shard.
CODEC = "zstd"
#: Tokens of a chunk, and of what is read at a time.
CHUNK = 1 << 16
ENDING = ".shard"
#: Fixed value: the special token that ends a document.
END_OF_TEXT = "<|endoftext|>"
SCHEMAS = {
    "chunks": "shard long, start long, tokens array<int>",
    "documents": "shard long, n long, tokens array<int>",
    "windows": "shard long, i long, sequence long, inputs array<int>, targets array<int>",
}


def _lists(rows: list[np.ndarray]) -> pa.Array:
    cuts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *rows]).astype(np.int32)))


class _File(InputPartition):
    def __init__(self, name: str, shard: int, first: int):
        self.name, self.shard, self.first = name, shard, first


class _Reader(DataSourceReader):
    def __init__(self, path: str, rows: str, length: int):
        self.path, self.rows, self.length = path, rows, length

    def files(self) -> list[dict]:
        """Files of the manifest or, of a folder without one, all that have the ending, by name."""
        try:
            return committed(self.path)["files"]
        except FileNotFoundError:
            store, root = file_system(self.path.rstrip("/"))
            found = sorted((f.base_name, f.size) for f in store.get_file_info(pafs.FileSelector(root)) if f.is_file and f.base_name.endswith(ENDING))
            if not found:
                raise
            out = []
            for k, (name, size) in enumerate(found):
                with open_file(self.path, name) as source:
                    out.append({"name": name, "shard": k, "tokens": read_header(source.read_at(min(32, size), 0), size)[3]})
            return out

    def partitions(self):
        out, first = [], 0
        for f in self.files():
            out.append(_File(f["name"], f["shard"], first))
            if self.rows == "windows":
                first += max(f["tokens"] - 1, 0) // self.length
        return out

    def _chunks(self, source, size: int) -> Iterator[np.ndarray]:
        """The tokens, and at the end the check of the digest."""
        head = source.read_at(min(32, size), 0)
        width, vocabulary, self.eos, n = read_header(head, size)
        digest = hashlib.sha256(head)
        for at in range(0, n, CHUNK):
            raw = source.read_at(min(CHUNK, n - at) * width, 32 + at * width)
            digest.update(raw)
            tokens = np.frombuffer(raw, f"<u{width}")
            if int(tokens.max()) >= vocabulary:
                raise ValueError("token outside the vocabulary")
            yield tokens.astype(np.int32)
        if source.read_at(32, size - 32) != digest.digest():
            raise ValueError("checksum mismatch")

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, _File):
            return
        with open_file(self.path, partition.name) as source:
            try:
                yield from getattr(self, f"_rows_{self.rows}")(partition, self._chunks(source, source.size()))
            except ValueError as wrong:
                raise ValueError(f"{partition.name}: {wrong}") from wrong

    def _batch(self, file: _File, numbers: list[np.ndarray], lists: list[list[np.ndarray]]) -> pa.RecordBatch:
        names = [c.split()[0] for c in SCHEMAS[self.rows].split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(lists[0]), file.shard), pa.int64()), *(pa.array(x, pa.int64()) for x in numbers), *map(_lists, lists)], names=names)

    def _rows_chunks(self, file: _File, chunks: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for k, tokens in enumerate(chunks):
            yield self._batch(file, [np.array([k * CHUNK])], [[tokens]])

    def _rows_documents(self, file: _File, chunks: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        open_, done = [], 0
        for tokens in chunks:
            ends = np.flatnonzero(tokens == self.eos)
            if not len(ends):
                open_.append(tokens)
                continue
            parts = [tokens[a:b] for a, b in zip(np.concatenate([[0], ends[:-1] + 1]), ends, strict=True)]
            parts[0] = np.concatenate([*open_, parts[0]])
            yield self._batch(file, [np.arange(done, done + len(parts))], [parts])
            done, open_ = done + len(parts), [tokens[ends[-1] + 1 :]]
        if sum(map(len, open_)):
            yield self._batch(file, [np.array([done])], [[np.concatenate(open_)]])

    def _rows_windows(self, file: _File, chunks: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        held, done, size = np.zeros(0, np.int32), 0, self.length
        for tokens in chunks:
            held = np.concatenate([held, tokens])
            n = max(len(held) - 1, 0) // size
            if n:
                i = np.arange(done, done + n)
                yield self._batch(file, [i, file.first + i], [list(held[: n * size].reshape(n, size)), list(held[1 : n * size + 1].reshape(n, size))])
                held, done = held[n * size :], done + n


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, vocabulary: int, eos: int, overwrite: bool):
        self.vocabulary, self.eos = vocabulary, eos
        header(vocabulary, eos, 0)
        self.target = Commit(path, overwrite)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        said, facts, out, digest, total = self.target.message(), None, None, None, 0
        end = np.array([self.eos], np.int64)

        def put(raw: bytes):
            digest.update(raw)
            out.write(raw)

        def close():
            if facts["tokens"] != total:
                raise ValueError(f"shard {facts['shard']} has {facts['tokens']} tokens, not the {total} that it should have")
            out.write(digest.digest())
            out.close()
            said.files.append(facts)

        kind = "<u2" if self.vocabulary <= 65_536 else "<u4"
        for batch in iterator:
            for shard, size, order, n, packed in zip(*(batch.column(c).to_pylist() for c in ("shard", "shard_tokens", "ord", "size", "packed")), strict=True):
                own = np.frombuffer(pa.decompress(packed, decompressed_size=4 * (n - 1), codec=CODEC), "<i4").astype(np.int64)
                if len(own) and (int(own.max()) >= self.vocabulary or int(own.min()) < 0):
                    raise ValueError(f"document {order}: a token is outside the vocabulary of {self.vocabulary}")
                if (own == self.eos).any():
                    raise ValueError(f"document {order}: the end of text {self.eos} stands inside it")
                if facts is None or facts["shard"] != shard:
                    if facts is not None:
                        close()
                    name, out = self.target.open(f"shard-{shard:08d}", ENDING)
                    facts, total, digest = {"name": name, "shard": shard, "documents": 0, "tokens": 0}, size, hashlib.sha256()
                    put(header(self.vocabulary, self.eos, size))
                put(np.concatenate([own, end]).astype(kind).tobytes())
                facts["documents"] += 1
                facts["tokens"] += len(own) + 1
        if facts is not None:
            close()
        return said

    def commit(self, messages) -> None:
        self.target.commit(messages, "shard", vocabulary=self.vocabulary, eos=self.eos)

    def abort(self, messages) -> None:
        self.target.abort()


class TokenShards(DataSource):
    """Options: path; for reading ``rows`` (chunks, documents, windows) and ``length`` of windows; for writing vocabulary and eos."""

    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("rows", "chunks")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("rows", "chunks"), int(self.options.get("length", 0)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], int(self.options["vocabulary"]), int(self.options["eos"]), overwrite)


def read_shards_from(spark: SparkSession, path: str, rows: str = "chunks", length: int = 0) -> DataFrame:
    """Rows of the shard files below ``path``: see ``SCHEMAS``. Windows carry their number over all shards; the last tokens of a shard that make no window are left out."""
    if rows == "windows" and length < 1:
        raise ValueError("windows need a length")
    spark.dataSource.register(TokenShards)
    return spark.read.format("token_shards").options(rows=rows, length=length).load(qualified(spark, path))


def _keys(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    """The order of documents in the shards as values that numpy compares: those without ``ord`` first."""
    made = np.empty(rows.num_rows, [("known", "i1"), ("ord", "i8"), ("size", "i8"), ("row", "i8")])
    for c in made.dtype.names:
        made[c] = rows.column(c).to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows.column(c).to_numpy()
    return made


def pack_tokens(encoded: DataFrame, vocabulary: int, eos: int, target: int, path: str) -> dict[str, int]:
    """Packs encoded(ord, ids) into shard files below ``path``; {shards, documents, tokens}, each document's end of text counted.

    In the order of ``ord`` a shard is closed once it has ``target`` tokens; the last one may be short.
    Documents without tokens are left out. A token outside the vocabulary or an end of text inside a
    document fails the job, and nothing is left below ``path``. The first document of each shard is told
    to all tasks, so tokens are shuffled once, to their shard; its documents go through one task, one
    after another.
    """
    rows = encoded.where(F.size("ids") > 0).select(F.col("ord").cast("long").alias("ord"), "ids", F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, "encoded")
    sized = rows.select("ord", (F.size("ids") + 1).alias("size"), "row")
    dealt = materialize(packing.greedy_shards(sized, "size", "ord", target, keep=("row",)), "dealt")
    spark = encoded.sparkSession
    firsts = dealt.groupBy("shard").agg(F.min(F.struct("ord", "size", "row")).alias("first"), F.sum("size").alias("tokens")).select(F.col("first.ord").isNotNull().alias("known"), F.coalesce("first.ord", F.lit(0)).alias("ord"), "first.size", "first.row", "shard", "tokens").orderBy("shard").toArrow()
    shared = spark.sparkContext.broadcast((_keys(firsts), firsts.column("shard").to_numpy(), firsts.column("tokens").to_numpy()))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, shard, tokens = shared.value
        for batch in batches:
            at, ids = np.searchsorted(first, _keys(batch), "right") - 1, batch.column("ids")
            values, cuts = ids.values.to_numpy(zero_copy_only=False).astype("<i4"), ids.offsets.to_numpy()
            packed = [pa.compress(values[a:b].tobytes(), codec=CODEC, asbytes=True) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            order = pc.if_else(batch.column("known"), batch.column("ord"), None)
            yield pa.RecordBatch.from_arrays([pa.array(shard[at]), pa.array(tokens[at]), order, batch.column("size"), batch.column("row"), pa.array(packed, pa.binary())], names=["shard", "shard_tokens", "ord", "size", "row", "packed"])

    keyed = rows.select(F.col("ord").isNotNull().alias("known"), F.coalesce("ord", F.lit(0)).alias("ord"), (F.size("ids") + 1).cast("long").alias("size"), "row", "ids")
    ready = keyed.mapInArrow(placed, "shard long, shard_tokens long, ord long, size long, row long, packed binary")
    ready = ready.repartition("shard").sortWithinPartitions("shard", F.col("ord").asc_nulls_first(), "size", "row")
    path = qualified(spark, path)
    spark.dataSource.register(TokenShards)
    ready.drop("row").write.format("token_shards").options(vocabulary=vocabulary, eos=eos).mode("append").save(path)
    files = committed(path)["files"]
    return {"shards": len(files), "documents": sum(f["documents"] for f in files), "tokens": sum(f["tokens"] for f in files)}


def pack_text(docs: DataFrame, kept: Vocabulary, target: int, path: str, order: str = "doc_id", text: str = "text", end: str = END_OF_TEXT) -> dict[str, int]:
    """``pack_tokens`` of texts by a vocabulary; the strings of special tokens in a text are text like any other. Null texts are left out as empty ones are."""
    if end not in kept.specials:
        raise ValueError(f"the vocabulary has no {end} to end documents with")
    size = 256 + len(kept.merges) + len(kept.specials)
    encoded = bpe.encode(docs.select(F.col(order).cast("long").alias("doc_id"), F.col(text).alias("text")), list(kept.merges), kept.splitter)
    return pack_tokens(encoded.select(F.col("doc_id").alias("ord"), "ids"), size, 256 + len(kept.merges) + kept.specials.index(end), target, path)


def batches_from(spark: SparkSession, path: str, length: int, batch: int, seed: int, epoch: int, start: int = 0, stop: int | None = None) -> DataFrame:
    """(epoch, index, row, inputs, targets) of an epoch over the windows of all shards below ``path``, or of its batches before ``stop``, where that is a few; how many windows there are is told by the manifest."""
    n = sum(max(f["tokens"] - 1, 0) // length for f in _Reader(qualified(spark, path), "windows", length).files())
    order = packing.epoch_batches(spark, n, batch, seed, epoch, start, stop)
    return (order if stop is None else F.broadcast(order)).join(read_shards_from(spark, path, "windows", length), "sequence").select("epoch", "index", "row", "inputs", "targets")
