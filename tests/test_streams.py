"""Streams that go on after a restart: packing, batches of epochs, piece counts."""

import pytest
from pyspark.sql import functions as F

from corploom.operators import bpe, packing
from corploom.sources import token_shards
from corploom.streaming import batcher, pieces
from corploom.streaming.packing import packed_stream

ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@pytest.fixture
def rocks(spark):
    spark.conf.set(*ROCKS)
    yield spark
    spark.conf.unset(ROCKS[0])


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source", F.length("text").cast("long").alias("size"))


def in_files(docs, path, low, high):
    """Rows of some ids as files that a stream reads one after the other."""
    for k in range(low, high, 50):
        docs.where(F.col("doc_id").between(k, min(k + 49, high - 1))).coalesce(1).write.mode("append").parquet(path)


def stream_of(spark, docs, path):
    return spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_packed_stream_equals_the_table(rocks, sf, tmp_path):
    docs, path, out = documents(rocks, sf), str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        packed = packed_stream(stream_of(rocks, docs, path), "size", "doc_id", 20_000)
        packed.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    in_files(docs, path, 0, 100)
    run()
    first = rocks.read.parquet(out).count()
    in_files(docs, path, 100, 200)  # after a restart
    run()
    got = sorted(map(tuple, rocks.read.parquet(out).select("ord", "size", "shard").collect()))
    assert 0 < first < len(got) and got == sorted(map(tuple, packing.greedy_shards(docs, "size", "doc_id", 20_000).collect()))


def test_packed_stream_by_key(rocks, sf, tmp_path):
    docs, path = documents(rocks, sf), str(tmp_path / "in")
    in_files(docs, path, 0, 200)
    packed = packed_stream(stream_of(rocks, docs, path), "size", "doc_id", 5_000, "source")
    packed.writeStream.format("memory").queryName("keyed_packs").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, rocks.table("keyed_packs").where("key = 'src1'").select("ord", "size", "shard").collect()))
    assert got and got == sorted(map(tuple, packing.greedy_shards(docs.where("source = 'src1'"), "size", "doc_id", 5_000).collect()))


def test_batches_go_on_where_they_were(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(batcher, "BATCHES", 3)
    path, out = str(tmp_path / "shards"), str(tmp_path / "out")
    token_shards.pack_tokens(spark.createDataFrame([(k, [(k * 7 + j) % 256 for j in range(k % 40)]) for k in range(80)], "ord long, ids array<int>"), 300, 256, 300, path)
    n = batcher.prepare_epochs(spark, path, 8, 5, range(2))
    batches = n // 4

    def run(until):
        made = batcher.batch_stream(spark, path, 8, 4, 5, until)
        made.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(out)

    assert run((0, 5)).count() == 20
    assert run((0, 5)).count() == 20  # nothing new, nothing twice
    assert run((1, 2)).count() == 4 * (batches + 2)
    whole = run((1, batches))
    want = token_shards.batches_from(spark, path, 8, 4, 5, 0).unionByName(token_shards.batches_from(spark, path, 8, 4, 5, 1))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, want.collect()))


def test_piece_counts_of_a_stream(spark, sf, tmp_path):
    docs, path, out = documents(spark, sf), str(tmp_path / "in"), f"file://{tmp_path}/out"

    def run(check):
        pieces.stream_piece_counts(stream_of(spark, docs, path), out, fold=3).option("checkpointLocation", str(tmp_path / check)).trigger(availableNow=True).start().awaitTermination()

    in_files(docs, path, 0, 200)
    run("a")
    want = sorted(map(tuple, bpe.piece_counts(docs).collect()))
    assert sorted(map(tuple, pieces.streamed_counts(spark, out).collect())) == want
    # the same batches once more, as after a failure before the commit
    run("b")
    assert sorted(map(tuple, pieces.streamed_counts(spark, out).collect())) == want
    assert pieces.streamed_counts(spark, f"file://{tmp_path}/none").count() == 0
