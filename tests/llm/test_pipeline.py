"""The pipeline's stages, one by one, on rows of the tables and on odd ones."""

import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from corploom.llm import decontaminate, near_copies

from .test_operators import ODD, brute_quality, docs_of


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(docs_of(spark, ODD).select("doc_id", "text", "lang", "source", "n_chars"))
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, sf).cache()
        n, ids = after.count(), {r[0] for r in after.select("doc_id").collect()}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
            assert after.where("n_chars != length(text)").isEmpty()
        if name == "quality_rules":
            failed = {r["doc_id"] for r in before.collect() if brute_quality(r["text"])[-1]}
            assert not ids & failed and n > 100
        if name == "near_dedup":
            assert after.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
            assert after.select("text").distinct().count() == n
        if name == "decontamination":
            assert decontaminate.contamination(after, spark.read.parquet(f"{sf}/benchmark.parquet")).isEmpty()
        if name == "pii":
            assert n == before.count() and after.where("text rlike '[a-z]@[a-z]+[.]'").isEmpty()
        before = after
    assert before.count() == n


def test_stages_on_no_rows(spark, sf):
    docs = docs_of(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def _similarity(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


@pytest.mark.parametrize("tile,leaders", [(64, 32), (2, 32), (2, 1)])
def test_near_copies_go_and_others_stay(spark, tile, leaders, monkeypatch):
    monkeypatch.setattr(near_copies, "LEADERS", leaders)
    monkeypatch.setattr(near_copies, "PART", 3)
    rnd = random.Random(4)
    rows = []
    for g in range(12):
        base = [f"g{g}w{k}" for k in range(200)]
        rows.append((100 * g, " ".join(base)))
        for c in range(1, 9):
            words = list(base)
            for at in rnd.sample(range(200), c):
                words[at] = f"c{c}x{at}"
            rows.append((100 * g + c if c % 4 else None, " ".join(words)))
    # different texts with one doc_id, and an exact copy of a named row without an id
    rows += [(5000, "one text of its own that is long enough to have shingles"), (5000, "quite another text with the same number and other words in it"), (None, rows[0][1])]
    docs = docs_of(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    left = [(r[0], r[1]) for r in near_copies.without_near_copies(docs, tile=tile).select("doc_id", "text").collect()]
    assert all(_similarity(a, b) < 0.8 for (_, a), (_, b) in itertools.combinations(left, 2))
    gone = [t for i, t in rows if (i, t) not in left]
    assert all(any(_similarity(t, u) >= 0.8 and u != t or u == t and rows[0][1] == t for _, u in rows) for t in gone)
    assert {t for i, t in rows if i == 5000} == {t for i, t in left if i == 5000}
    # the stage with its own settings leaves no pair either
    stage = [r["text"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert all(_similarity(a, b) < 0.8 for a, b in itertools.combinations(stage, 2))


@pytest.mark.parametrize("tile,leaders", [(64, 32), (2, 1)])
def test_near_copies_make_components(spark, tile, leaders, monkeypatch):
    """Chains in which only neighbours are alike, in any order of ids, are one class: of each the least doc_id stays."""
    monkeypatch.setattr(near_copies, "LEADERS", leaders)
    monkeypatch.setattr(near_copies, "PART", 3)
    rnd = random.Random(7)
    rows = []
    for g in range(6):
        words = [f"g{g}w{k}" for k in range(260)]
        chain = [" ".join(words[8 * c : 8 * c + 200]) for c in range(8)]
        ids = list(range(100 * g, 100 * g + 8))
        rnd.shuffle(ids)
        rows += zip(ids, chain, strict=True)
        assert all(_similarity(a, b) >= 0.8 for a, b in itertools.pairwise(chain)) and _similarity(chain[0], chain[-1]) < 0.8
    docs = docs_of(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    left = near_copies.without_near_copies(docs, tile=tile).collect()
    assert sorted(r["doc_id"] for r in left) == [100 * g for g in range(6)]


def test_near_copies_that_keys_and_fingerprints_miss(spark):
    """Pairs at 0.8 whose fingerprints differ in more bits than the radius, or that share no key, go too."""
    rnd, rows, far, apart = random.Random(3), [], 0, 0
    while far < 12 or apart < 3:
        long = [f"w{rnd.randrange(10**9)}" for _ in range(9)]
        a, b = (near_copies.shingles(" ".join(w)) for w in (long[:8], long))
        bits = bin(int(near_copies.fingerprint(a)) ^ int(near_copies.fingerprint(b))).count("1")
        keys = set(near_copies.bands(a)) & set(near_copies.bands(b))
        if bits > near_copies.RADIUS or not keys:
            far, apart = far + (bits > near_copies.RADIUS), apart + (not keys)
            rows += [(len(rows), " ".join(long[:8])), (len(rows) + 1, " ".join(long))]
    docs = docs_of(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    left = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(left) == list(range(0, len(rows), 2))


def test_prefixes_of_alike_sets_meet():
    rng = np.random.default_rng(2)
    for n in [*range(1, 30), 100, 333]:
        for _ in range(20):
            b = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
            a = np.unique(np.concatenate([rng.permutation(b)[: max(1, int(np.ceil(0.8 * n)))], rng.integers(0, 1 << 63, rng.integers(0, 2), np.uint64)]))
            often = np.sort(rng.permutation(b)[: rng.integers(0, n + 1)])
            if near_copies.similar(a, b):
                assert np.intersect1d(near_copies.prefix(a, often), near_copies.prefix(b, often)).size >= near_copies.least(min(len(a), len(b)))
