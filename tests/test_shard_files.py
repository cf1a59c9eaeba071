"""Shard files as a data source: packing, reading back, windows, epochs, and writes that fail."""

import os

import numpy as np
import pytest
from pyspark.errors import PySparkException

from corploom.operators import bpe, packing
from corploom.operators.vocabulary import Vocabulary
from corploom.sources import shards, token_shards
from corploom.sources.committed import Commit, Written, committed

CONFIG = bpe.SPLITTERS["cl100k_like"]


def files_below(path):
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs)


def test_texts_to_files_and_back(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(90_001, ""), (90_002, None), (90_003, "a <|endoftext|> b"), (None, "first of all")], "doc_id long, text string")
    docs = docs.unionByName(extra)
    kept = Vocabulary(CONFIG, tuple(bpe.learn_from(docs, 40, CONFIG)), ("<|pad|>", "<|endoftext|>"))
    said = token_shards.pack_text(docs, kept, 20_000, f"file://{tmp_path}/s")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["text"]]
    assert said["documents"] == len(rows) and said["shards"] == len(committed(str(tmp_path / "s"))["files"])
    piece = kept.pieces()
    back = token_shards.read_shards_from(spark, str(tmp_path / "s"), "documents").orderBy("shard", "n").collect()
    texts = [b"".join(piece[t] for t in r["tokens"]).decode() for r in back]
    assert texts == [t for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]
    # every shard but the last is full, each is a valid file, and the tokens are those told
    sizes = [len(shards.decode_shard(open(tmp_path / "s" / f["name"], "rb").read())[2]) for f in committed(str(tmp_path / "s"))["files"]]
    assert all(n >= 20_000 for n in sizes[:-1]) and sum(sizes) == said["tokens"] == sum(len(r["tokens"]) + 1 for r in back)
    with pytest.raises(ValueError, match="endoftext"):
        token_shards.pack_text(docs, Vocabulary(CONFIG), 10, str(tmp_path / "x"))


def test_chunks_windows_and_epochs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_shards, "CHUNK", 7)
    encoded = spark.createDataFrame([(k, list(range(k % 9))) for k in range(60)], "ord long, ids array<int>").repartition(4)
    path = str(tmp_path / "s")
    assert token_shards.pack_tokens(encoded, 300, 256, 50, path) == {"shards": 6, "documents": 53, "tokens": 53 + sum(k % 9 for k in range(60))}
    whole = {}
    for f in committed(path)["files"]:
        whole[f["shard"]] = shards.decode_shard(open(f"{path}/{f['name']}", "rb").read())[2]
    table = spark.createDataFrame(sorted(whole.items()), "shard long, tokens array<int>")
    want = sorted(map(tuple, packing.windows(table, 4).select("shard", "i", "inputs", "targets").collect()))
    got = token_shards.read_shards_from(spark, path, "windows", 4)
    assert sorted(map(tuple, got.select("shard", "i", "inputs", "targets").collect())) == want
    assert sorted(r["sequence"] for r in got.collect()) == list(range(len(want)))
    chunks = {}
    for r in token_shards.read_shards_from(spark, path).orderBy("shard", "start").collect():
        chunks.setdefault(r["shard"], []).extend(r["tokens"])
    assert chunks == whole
    made = packing.batches_of(table, 4, 2, 42, 1)
    assert sorted(map(tuple, token_shards.batches_from(spark, path, 4, 2, 42, 1).collect())) == sorted(map(tuple, made.collect()))


def test_failed_writes_leave_nothing(spark, tmp_path):
    good = [(k, [1, 2, 3]) for k in range(50)]
    for bad, why in (((50, [256]), "stands inside"), ((50, [300]), "outside the vocabulary")):
        path = str(tmp_path / why.replace(" ", "-"))
        with pytest.raises(PySparkException, match=why):
            token_shards.pack_tokens(spark.createDataFrame([*good, bad], "ord long, ids array<int>"), 300, 256, 20, path)
        assert files_below(path) == []
        with pytest.raises(PySparkException):
            token_shards.read_shards_from(spark, path).count()
    # what a killed task left isn't listed, isn't read, and goes with the commit
    path = str(tmp_path / "s")
    target = Commit(path, False)
    _, out = target.open("shard-00000000", ".shard")
    out.write(b"half")
    out.close()
    token_shards.pack_tokens(spark.createDataFrame(good, "ord long, ids array<int>"), 300, 256, 20, path)
    assert token_shards.read_shards_from(spark, path, "documents").count() == 50
    assert len(files_below(path)) == len(committed(path)["files"]) + 1
    with pytest.raises(PySparkException, match="already"):
        token_shards.pack_tokens(spark.createDataFrame(good, "ord long, ids array<int>"), 300, 256, 20, path)


def test_commit_replaces_in_one_step(tmp_path):
    path = str(tmp_path / "t")
    for text in (b"one", b"two"):
        write = Commit(path, True)
        name, out = write.open("f", ".x")
        out.write(text)
        out.close()
        write.commit([None, Written(1, [{"name": name}])], kind="k")
        assert [open(f"{path}/{f['name']}", "rb").read() for f in committed(path)["files"]] == [text]
        assert len(files_below(path)) == 2 and committed(path)["kind"] == "k"


def test_damaged_and_foreign_files(spark, tmp_path):
    (tmp_path / "a.shard").write_bytes(shards.encode_shard(list(range(200)) + [256], 300, 256))
    (tmp_path / "b.shard").write_bytes(shards.encode_shard([5, 256, 6], 70_000, 256))
    read = token_shards.read_shards_from(spark, str(tmp_path), "documents").orderBy("shard", "n").collect()
    assert [(r["shard"], r["n"], len(r["tokens"])) for r in read] == [(0, 0, 200), (1, 0, 1), (1, 1, 1)]
    raw = bytearray((tmp_path / "a.shard").read_bytes())
    raw[40] ^= 1
    (tmp_path / "a.shard").write_bytes(bytes(raw))
    with pytest.raises(PySparkException, match="a.shard: checksum mismatch"):
        token_shards.read_shards_from(spark, str(tmp_path)).count()
    with pytest.raises(ValueError, match="outside"):
        shards.header(300, 300, 1)
    assert np.frombuffer(shards.header(300, 256, 4)[24:], "<u8")[0] == 4
