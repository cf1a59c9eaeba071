"""Functions that SQL calls by name, settings, and products of two tables."""

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from corploom.functions import registered, settings
from corploom.operators import bpe, matrices
from corploom.operators.vocabulary import Vocabulary
from corploom.sources import shards


def test_table_functions(spark):
    registered.register(spark)
    content = shards.encode_shard([1, 2, 256, 256, 7, 256], 300, 256)
    rows = spark.createDataFrame([(1, content), (2, None)], "shard long, content binary")
    got = spark.sql("SELECT shard, n, tokens FROM {t} t, LATERAL read_shard(t.content, 'documents') ORDER BY n", t=rows).collect()
    assert [tuple(r) for r in got] == [(1, 0, [1, 2]), (1, 1, []), (1, 2, [7])]
    got = spark.sql("SELECT start, tokens FROM {t} t, LATERAL read_shard(t.content, 'tokens')", t=rows).collect()
    assert [tuple(r) for r in got] == [(0, [1, 2, 256, 256, 7, 256])]
    with pytest.raises(AnalysisException, match="read_shard takes"):
        spark.sql("SELECT * FROM {t} t, LATERAL read_shard(t.content, 'words')", t=rows)
    record = "\nid: a\nurl: u\nrevision: r\nlicense: MIT\nfetched: d\ncategory: c\n"
    texts = spark.createDataFrame([("ok", "head\n" + record + record), ("cut", "head\n" + record + "\nid: b\n"), ("odd", "head\n\nid: a\nurl:\n"), ("none", None), ("bare", "head\n")], "name string, value string")
    got = {}
    for r in spark.sql("SELECT t.name, m.* FROM {t} t, LATERAL manifest_rows(t.value) m ORDER BY t.name, m.ord", t=texts).collect():
        got.setdefault(r["name"], []).append((r["ord"], r["id"], r["error"]))
    assert got == {"ok": [(0, "a", None), (1, "a", None)], "cut": [(0, "a", None), (1, None, "the text ends where `url:` was expected")], "odd": [(0, None, "line 4: expected `url: <value>`")]}


def test_functions_by_name(spark):
    registered.register(spark)
    kept = Vocabulary(bpe.SPLITTERS["cl100k_like"], ((104, 101), (256, 108)), ("<|end|>",))
    registered.register_vocabulary(spark, kept)
    rows = spark.createDataFrame([("hello <|end|> é" + "x" * 200,), (None,), ("",)], "text string")
    got = spark.sql("SELECT text, ids, CAST(bpe_decode(ids) AS STRING) AS back FROM (SELECT text, bpe_encode(text) AS ids FROM {t})", t=rows).collect()
    assert all(r["back"] == r["text"] for r in got) and got[0]["ids"][:3] == [257, 108, 111]
    assert [r[0] for r in spark.sql("SELECT bpe_decode(array(99999, length(text))) FROM {t} WHERE text <> ''", t=rows).collect()] == [None]
    assert [r[0] for r in spark.sql("SELECT size(scrub_find(text)) FROM {t}", t=rows).collect()] == [0, 0, 0]
    want = bpe.encode(rows.where("text <> ''").withColumn("doc_id", F.lit(1).cast("long")), list(kept.merges), kept.splitter).first()["ids"]
    assert got[0]["ids"] == want


def test_settings_that_differ(spark):
    rows = spark.createDataFrame(
        [('{"a": 1, "b": "x", "c": null}', '{"a": 2, "b": "x", "d": [1]}'), ('{"a": 1}', '{"a": 1}'), (None, '{"a": true}'), ("no json", '{"a": 1}'), ('{"a": 1}', None), ('{"a": null}', '{"a": 3}')], "saved string, now string"
    )
    saved, now = settings.json_settings(F.col("saved")), settings.json_settings(F.col("now"))
    got = [r[0] for r in rows.select(settings.check_matches(saved, now)).collect()]
    begin = "the saved run was made with other settings: "
    assert got == [begin + "`a` was 1 and is now 2; `d` is missing from the saved run", None, begin + "`a` is missing from the saved run", begin + "`a` is missing from the saved run", None, begin + "`a` was null and is now 3"]


@pytest.mark.parametrize(("m", "k", "n", "block"), [(1, 1, 1, 4), (7, 5, 3, 4), (40, 13, 9, 4), (300, 8, 2, 2)])
def test_products_of_tables(spark, m, k, n, block):
    rng = np.random.default_rng(m)
    a, b = rng.integers(-5, 6, (m, k)).astype(float), rng.integers(-5, 6, (k, n)).astype(float)
    frame = lambda x: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row long, values array<double>").repartition(3)
    got = {r["row"]: r["values"] for r in matrices.multiply(frame(a), frame(b), block=block).collect()}
    assert len(got) == m and all(np.allclose(got[i], a[i] @ b) for i in range(m))


def test_products_of_tables_with_many_more_rows(spark):
    """Rows beyond the width of the left side are left out before they are copied, and copies are not sent whole to every task."""
    rng = np.random.default_rng(5)
    a, b = rng.integers(-5, 6, (300, 6)).astype(float), rng.integers(-5, 6, (20_000, 2)).astype(float)
    frame = lambda x: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row long, values array<double>").repartition(3)
    made = matrices.multiply(frame(a), frame(b), block=2)
    got = {r["row"]: r["values"] for r in made.collect()}
    assert len(got) == 300 and all(np.allclose(got[i], a[i] @ b[:6]) for i in range(300))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "<= 5)" in plan


@pytest.mark.parametrize("few", [0, 1_000])
def test_encoding_by_steps_and_by_pieces(spark, monkeypatch, few):
    """Whole texts at once give what their pieces give one by one, and encoding does not go through each piece."""
    monkeypatch.setattr(registered, "FEW_MERGES", few)
    merges = ((97, 97), (256, 97), (195, 169), (258, 258), (257, 256), (32, 97), (101, 255))
    kept = Vocabulary(bpe.SPLITTERS["cl100k_like"], merges, ("<|end|>",))
    texts = ["aaaaaaa aaaa éééé é", "a" * 999, "é" * 301, "\U0001f468 aÿa\0\r\n  aa", "", None, "e ee \U0010ffff"]
    want = []
    for t in texts:
        found = [] if t is None else [x for p in __import__("regex").findall(kept.splitter.pattern, t) for x in bpe.short_parts(p.encode())]
        want.append(None if t is None else [i for x in found for i in bpe.encode_piece(x, {m: r for r, m in enumerate(merges)})])
    if few:
        monkeypatch.setattr(bpe, "encode_piece", None)
    registered.register_vocabulary(spark, kept)
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").coalesce(1)
    got = spark.sql("SELECT ids, CAST(bpe_decode(ids) AS STRING) AS back FROM (SELECT k, bpe_encode(text) AS ids FROM {t}) ORDER BY k", t=rows).collect()
    assert [r["ids"] for r in got] == want and [r["back"] for r in got] == texts
    odd = spark.createDataFrame([([97, None],), ([-1],), ([264],), (None,), ([],), ([263, 262],)], "ids array<int>").coalesce(1)
    assert [r[0] for r in spark.sql("SELECT bpe_decode(ids) FROM {t}", t=odd).collect()] == [None, None, None, None, b"", b"<|end|>e\xff"]
