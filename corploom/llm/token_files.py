"""Operator 11, token ids in bit-packed files.

An id takes the least number of bits that the vocabulary needs. A file holds ids in blocks of equal
numbers of ids, each beginning at a whole byte, then an index: doc_ids, the place of each document's
first id, the byte at which each block begins and a checksum of each block. A reader looks the block
up, reads its bytes alone and unpacks any stretch of it at once in numpy; nothing before it is read.

Layout, little-endian: magic, bits, ids a block | blocks | doc_ids (8 bytes each), null flags (1 bit
each), starts (8 each, and one more), block offsets (8 each, and one more), CRC-32 of blocks (4 each) |
place of the index, documents, ids, blocks (8 each), CRC-32 of the index, version (4 each), magic.
Bit j of a block's id i is bit i * bits + j of the block, counted from the lowest bit of its first byte.

Documents are dealt to ranges of (doc_id, hash of the text, row), so that neither repeated ids nor rows
without one fill a task, sorted within them and written by a data source: a task writes files of a
bounded number of ids, block by block, and the driver commits their names. The manifest has each file's
number of ids, so the reader knows, without a job, how many ids stand before a file. The data source
reads a file as one partition, some documents at a time.
"""

from __future__ import annotations

import json
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition

from ..scratch import qualified
from ..sources.committed import Commit, Written, committed, open_file
from .common import scratch_path, splitter, text_of
from .token_counts import byte_letters

MAGIC, VERSION = b"CLBITIDS", 1
_HEAD, _TAIL = struct.Struct("<8sII"), struct.Struct("<QQQQII8s")
#: Ids of a block, ids after which a file is closed at the end of a document, ids of the batches that a reader gives out.
BLOCK, FILE_IDS, BATCH_IDS = 1 << 13, 1 << 27, 1 << 20
#: Distinct pieces whose ids a worker remembers; beyond that it starts anew, which costs time only.
REMEMBERED = 400_000
#: Bytes of texts whose stretches between blanks are looked up together.
TOGETHER = 2_000_000


# -- packing -----------------------------------------------------------------------------------------


def bits_of(vocabulary: int) -> int:
    """Bits of the greatest id, one at least."""
    if not 0 < vocabulary <= 1 << 31:
        raise ValueError(f"a vocabulary of {vocabulary} ids")
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after another in ``bits`` bits each, filled up to a whole byte."""
    if bits in (8, 16, 32):
        return np.ascontiguousarray(ids, f"<u{bits // 8}").tobytes()
    each = np.unpackbits(np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each.ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, bits: int, first: int, count: int) -> np.ndarray:
    """``count`` ids from the ``first`` one on, all at once: each is read from the few bytes that it can lie in."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", count, first * bits // 8).astype(np.uint32)
    place = np.arange(first, first + count, dtype=np.int64) * bits
    byte, shift, reach = place >> 3, (place & 7).astype(np.uint64), (bits + 14) // 8
    source = np.frombuffer(raw + bytes(reach), np.uint8)
    wide = np.zeros(count, np.uint64)
    for k in range(reach):
        wide |= source[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((wide >> shift) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class FileWriter:
    """Writes one file; holds one block and the index."""

    def __init__(self, out, vocabulary: int, block: int = BLOCK):
        self.out, self.vocabulary, self.bits, self.block = out, vocabulary, bits_of(vocabulary), block
        self.docs, self.starts, self.offsets, self.sums = [], [0], [_HEAD.size], []
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        out.write(_HEAD.pack(MAGIC, self.bits, block))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >= self.vocabulary:
            raise ValueError(f"document {doc_id}: id {int(ids.max())} is outside a vocabulary of {self.vocabulary}")
        self.docs.append(doc_id)
        self.n_ids += len(ids)
        self.starts.append(self.n_ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            waiting = np.concatenate(self.held)
            whole = self.n_held - self.n_held % self.block
            for at in range(0, whole, self.block):
                self._put(waiting[at : at + self.block])
            self.held, self.n_held = [waiting[whole:]], self.n_held - whole

    def _put(self, ids: np.ndarray) -> None:
        raw = pack(ids, self.bits)
        self.out.write(raw)
        self.sums.append(zlib.crc32(raw))
        self.offsets.append(self.offsets[-1] + len(raw))

    def close(self) -> dict:
        """Writes what is left and the index; the facts of the file."""
        if self.n_held:
            self._put(np.concatenate(self.held))
        nulls = np.packbits(np.array([d is None for d in self.docs], bool), bitorder="little")
        index = b"".join([
            np.array([d or 0 for d in self.docs], "<i8").tobytes(), nulls.tobytes(), np.array(self.starts, "<u8").tobytes(),
            np.array(self.offsets, "<u8").tobytes(), np.array(self.sums, "<u4").tobytes(),
        ])
        self.out.write(index)
        self.out.write(_TAIL.pack(self.offsets[-1], len(self.docs), self.n_ids, len(self.sums), zlib.crc32(index), VERSION, MAGIC))
        self.out.close()
        return {"documents": len(self.docs), "ids": self.n_ids}


class FileReader:
    """Reads one file: the index when it is opened, then the blocks that are asked for."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        if size < _HEAD.size + _TAIL.size:
            raise ValueError("too short for a file of ids")
        magic, self.bits, self.block = _HEAD.unpack(source.read_at(_HEAD.size, 0))
        at, n_docs, self.n_ids, n_blocks, crc, version, end = _TAIL.unpack(source.read_at(_TAIL.size, size - _TAIL.size))
        if magic != MAGIC or end != MAGIC or version != VERSION:
            raise ValueError("not a file of ids of this version")
        index = source.read_at(size - _TAIL.size - at, at)
        flags = (n_docs + 7) // 8
        if zlib.crc32(index) != crc or len(index) != 16 * n_docs + flags + 8 + 8 * (n_blocks + 1) + 4 * n_blocks:
            raise ValueError("the index is damaged")
        take = lambda kind, n, start: np.frombuffer(index, kind, n, start)
        self.nulls = np.unpackbits(take(np.uint8, flags, 8 * n_docs), bitorder="little")[:n_docs].astype(bool)
        self.docs = take("<i8", n_docs, 0)
        self.starts = take("<u8", n_docs + 1, 8 * n_docs + flags).astype(np.int64)
        self.offsets = take("<u8", n_blocks + 1, 16 * n_docs + flags + 8).astype(np.int64)
        self.sums = take("<u4", n_blocks, 16 * n_docs + flags + 8 + 8 * (n_blocks + 1))

    def ids(self, first: int, count: int) -> np.ndarray:
        """Any stretch of the file's ids; only its blocks are read, and their checksums looked at."""
        if first < 0 or count < 0 or first + count > self.n_ids:
            raise ValueError(f"ids {first} to {first + count} of {self.n_ids}")
        if not count:
            return np.zeros(0, np.uint32)
        low, high = first // self.block, (first + count - 1) // self.block
        begin = int(self.offsets[low])
        raw = self.source.read_at(int(self.offsets[high + 1]) - begin, begin)
        out = []
        for b in range(low, high + 1):
            own = raw[int(self.offsets[b]) - begin : int(self.offsets[b + 1]) - begin]
            if zlib.crc32(own) != self.sums[b]:
                raise ValueError(f"block {b} is damaged")
            start = max(first - b * self.block, 0)
            out.append(unpack(own, self.bits, start, min(first + count - b * self.block, self.block) - start))
        return np.concatenate(out)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1] - self.starts[k]))


# -- the data source -----------------------------------------------------------------------------------


class _File(InputPartition):
    def __init__(self, name: str, before: int):
        self.name, self.before = name, before


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        found, before = [], 0
        for f in committed(self.path)["files"]:
            found.append(_File(f["name"], before))
            before += f["ids"]
        return found

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, _File):  # a table without files
            return
        with open_file(self.path, partition.name) as source:
            file, low = FileReader(source), 0
            while low < len(file.docs):
                high = max(low + 1, int(np.searchsorted(file.starts, file.starts[low] + BATCH_IDS, "right")) - 1)
                cuts = file.starts[low : high + 1] - file.starts[low]
                values = pa.array(file.ids(int(file.starts[low]), int(cuts[-1])).astype(np.int32))
                ids = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)
                docs = pa.array(file.docs[low:high], pa.int64(), mask=file.nulls[low:high])
                yield pa.RecordBatch.from_arrays([docs, pa.array(file.starts[low:high] + partition.before), ids], names=["doc_id", "start", "ids"])
                low = high


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, vocabulary: int, block: int, file_ids: int, overwrite: bool, coder: tuple[str, str, int | None] | None):
        self.vocabulary, self.block, self.file_ids, self.coder = vocabulary, block, file_ids, coder
        self.target = Commit(path, overwrite)

    def lists(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.ListArray]]:
        """doc_ids and their ids; those of some texts at a time where texts come."""
        for batch in batches:
            docs, values = batch.column("doc_id"), batch.column(1)
            if self.coder is None:
                yield docs, values
                continue
            path, pattern, end = self.coder
            for low, high in _runs(values, TOGETHER):
                yield docs.slice(low, high - low), _coder(path, pattern).many(values.slice(low, high - low), end)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        said, file, name = self.target.message(), None, ""
        for docs, ids in self.lists(iterator):
            values, cuts = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            for row, doc_id in enumerate(docs.to_pylist()):
                if file is None:
                    name, out = self.target.open(f"ids-{said.partition:06d}-{len(said.files):04d}", ".bits")
                    file = FileWriter(out, self.vocabulary, self.block)
                file.add(doc_id, values[cuts[row] : cuts[row + 1]])
                if file.n_ids >= self.file_ids:
                    said.files.append({"name": name, **file.close()})
                    file = None
        if file is not None:
            said.files.append({"name": name, **file.close()})
        return said

    def commit(self, messages) -> None:
        self.target.commit(messages, vocabulary=self.vocabulary, block=self.block)

    def abort(self, messages) -> None:
        self.target.abort()


class PackedIds(DataSource):
    """``packed_ids``: (doc_id, start, ids) in the order written; options path, vocabulary, block, file_ids. Rows to write are (doc_id, ids), or (doc_id, text) with the options tokenizer, pattern and, if wanted, end."""

    @classmethod
    def name(cls) -> str:
        return "packed_ids"

    def schema(self) -> str:
        return "doc_id long, start long, ids array<int>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        o = self.options
        coder = (o["tokenizer"], o["pattern"], int(o["end"]) if "end" in o else None) if "tokenizer" in o else None
        return _Writer(o["path"], int(o["vocabulary"]), int(o.get("block", BLOCK)), int(o.get("file_ids", FILE_IDS)), overwrite, coder)


# -- encoding ------------------------------------------------------------------------------------------


#: Each byte, as the letter that stands for it in vocabulary files.
_LETTERS = {byte: letter for letter, byte in byte_letters().items()}


#: The pattern by which a blank between others than blanks begins a pre-token, whatever stands around.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_WHITE = "".join(f"\\x{{{ord(c):x}}}" for c in map(chr, range(0x3001)) if c.isspace())
#: A text that is empty, begins with white space, ends with a blank or has one before white space, which includes all that Python calls so.
ODD_BLANKS = f"^(?:[{_WHITE}]|$)| (?:[{_WHITE}]|$)"


class _Known(dict):
    """pre-token -> its ids as bytes, by the library's model; long ones aren't remembered."""

    def __init__(self, model):
        self.model = model

    def __missing__(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():  # only the blank has another letter
            letters = piece.replace(" ", _LETTERS[0x20])
        else:
            letters = piece.encode("utf-8").decode("latin-1").translate(_LETTERS)
        found = array("i", [t.id for t in self.model.tokenize(letters)]).tobytes()
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = found
        return found


class _Coder:
    """Whole texts to ids. Special tokens' strings are cut out first; each pre-token between is encoded once."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as lines:
            spec = json.load(lines)
        before = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError(f"{path} is not a byte-level vocabulary that splits texts as they are")
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.known, self.pieces, self.by_blanks = _Known(tokenizer.model), splitter(pattern), pattern == BYTE_LEVEL
        self.special_ids = {s: np.array([tokenizer.token_to_id(s)], "<i4").tobytes() for s in self.special}

    def one(self, text: str) -> bytes:
        """The ids of a text as bytes, pre-token by pre-token."""
        known, pieces = self.known, self.pieces
        if self.cut is None or not any(s in text for s in self.special):
            return b"".join([known[p] for p in pieces(text)])
        return b"".join([self.special_ids[part] if i % 2 else b"".join([known[p] for p in pieces(part)]) for i, part in enumerate(self.cut(text))])

    def many(self, texts: pa.Array, end: int | None = None) -> pa.ListArray:
        """The ids of each text, then ``end`` if one is given.

        Texts are split at blanks, and each distinct stretch is cut into pre-tokens and looked up once
        for all texts: where none is empty or begins with white space, a pre-token begins at each blank
        and none goes over it. Other texts, and those with special tokens, are encoded one by one.
        """
        rows = np.arange(len(texts))
        alone = pc.match_substring_regex(texts, ODD_BLANKS).to_numpy(zero_copy_only=False) if self.by_blanks else rows >= 0
        for s in self.special:
            alone = alone | pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(texts.filter(pa.array(~alone)), " ")
        own, coded = split.offsets.to_numpy(), split.flatten().dictionary_encode()
        stretches = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        joined = pc.binary_join(stretches, pa.scalar(" ", texts.type))[0].as_py()
        units = joined.split(" ") if joined else []
        pieces = self.pieces(" " + joined) if joined else []
        raw = [self.known[p] for p in pieces]
        begins = np.flatnonzero(np.fromiter((p[0] == " " for p in pieces), bool, len(pieces)))
        if not len(begins) == len(units) == len(coded.dictionary):
            raise RuntimeError(f"{len(begins)} of {len(coded.dictionary)} stretches begin a pre-token")
        # the first stretch of a text has no blank before it, so it has an entry of its own, as has a text by itself
        sizes, codes = np.ones(len(texts), np.int64), coded.indices.to_numpy()
        sizes[~alone] = np.diff(own)
        bounds, first = np.concatenate([[0], np.cumsum(sizes)]), iter(codes[own[:-1]].tolist())
        heads = [self.one(texts[row].as_py() if by_itself else units[next(first)]) for row, by_itself in enumerate(alone.tolist())]
        places = np.empty(bounds[-1], np.int32)
        places[np.repeat(~alone, sizes)] = codes
        places[bounds[:-1]] = len(units) + rows
        return _lists([*raw, *heads], places, bounds, end, np.concatenate([begins, len(raw) + rows]))


def _lists(raw: list[bytes], codes: np.ndarray, bounds: np.ndarray, end: int | None, begins: np.ndarray) -> pa.ListArray:
    """Lists of ids, ``bounds`` of the ``codes`` each; a code is a stretch of ``raw``, from its place in ``begins`` to the next."""
    last = [] if end is None else [np.array([end], "<i4").tobytes()]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
    sizes = np.concatenate([np.add.reduceat(sizes, begins), np.ones(len(last), np.int64)])
    if last:
        codes = np.insert(codes, bounds[1:], len(sizes) - 1)
        bounds = bounds + np.arange(len(bounds))
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    entries = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.frombuffer(b"".join([*raw, *last]), "<i4")))
    taken = entries.take(pa.array(codes))
    return pa.ListArray.from_arrays(pa.array(taken.offsets.to_numpy()[bounds]), taken.values)


@lru_cache(maxsize=2)
def _coder(path: str, pattern: str) -> _Coder:
    """One per worker process."""
    return _Coder(path, pattern)


def _runs(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Rows from and to, of about ``size`` bytes of text; a longer one by itself."""
    ends, low = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64), 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + size, "right")))
        yield low, high
        low = high


def write_packed(docs: DataFrame, target: str, path: str, pattern: str, vocabulary: int, end: int | None = None, block: int = BLOCK, file_ids: int = FILE_IDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text and writes the ids to ``target`` in ascending order of ``id_col``.

    Rows without an id come first; rows that share an id are ordered by a hash of their texts. A null
    text is an empty one (``end`` alone, if there is one). An empty table gives a table without files.
    Any other columns are left out, whatever their names.
    """
    rows = text_of(docs, id_col, text_col).select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    keys = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("row")]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    docs.sparkSession.dataSource.register(PackedIds)
    options = {"vocabulary": vocabulary, "block": block, "file_ids": file_ids, "tokenizer": path, "pattern": pattern} | ({} if end is None else {"end": end})
    ordered.write.format("packed_ids").options(**options).mode("overwrite").save(qualified(docs.sparkSession, target))


def read_packed(spark: SparkSession, target: str) -> DataFrame:
    """(doc_id, start, ids): ``start`` is the number of ids of all documents before."""
    spark.dataSource.register(PackedIds)
    return spark.read.format("packed_ids").load(qualified(spark, target))


def stretch(target: str, first: int, count: int) -> np.ndarray:
    """Any ``count`` ids of a table, counted over its files, by reading the blocks that hold them alone."""
    found, before = [np.zeros(0, np.uint32)], 0
    for f in committed(target)["files"]:
        low, high = max(first - before, 0), min(first + count - before, f["ids"])
        if low < high:
            with open_file(target, f["name"]) as source:
                found.append(FileReader(source).ids(low, high - low))
        before += f["ids"]
    out = np.concatenate(found)
    if first < 0 or len(out) != count:
        raise ValueError(f"ids {first} to {first + count} of {before}")
    return out


def digests(read: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what ``read_packed`` gives: CRC-32 of the ids as little-endian numbers of 4 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            raw, cuts = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B"), ids.offsets.to_numpy()
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(cuts), pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op11_token_files(documents: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from files of byte_bpe_50k.json's ids that were written and read back.

    Each document ends with id 2. Nulls, repeated rows, clashing columns and empty tables as in ``write_packed``.
    """
    import public_tokenizers

    spark, target = documents.sparkSession, scratch_path(documents.sparkSession, "token-ids")
    write_packed(documents, target, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 50_257, end=2)
    return digests(read_packed(spark, target))
