"""The merge learner in rounds of Spark jobs against the one on the driver."""

import random

import numpy as np
import pytest

from corploom.operators import bpe


def counts_of(spark, words):
    return spark.createDataFrame(words, "piece string, n long").repartition(3)


@pytest.mark.parametrize("seed", range(4))
def test_rounds_equal_the_driver(spark, seed):
    rng = random.Random(seed)
    letters = ["ab", "abc", "etaoinshr", "aé"][seed]
    words = {}
    for _ in range(400):
        word = "".join(rng.choices(letters, [len(letters) - k for k in range(len(letters))], k=rng.randrange(1, 12)))
        words[word] = words.get(word, 0) + rng.choice([1, 1, 2, 5, 30])
    want, told = bpe.learn_counted(sorted((p.encode(), n) for p, n in words.items()), 90)
    found, counts, jobs = bpe.learn_rounds(counts_of(spark, sorted(words.items())), 90, limit=24, keep=20, most=30)
    assert found == want and counts == told and jobs < 80


def test_thousand_merges_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rounds = bpe.train(docs, bpe.TrainConfig(256 + 1000, bpe.SPLITTERS["gpt2_like"], max_distinct=0))
    driver = bpe.train(docs, bpe.TrainConfig(256 + 1000, bpe.SPLITTERS["gpt2_like"]))
    assert rounds.merges == driver.merges and rounds.counts == driver.counts and driver.rounds == 0
    assert len(rounds.merges) == 1000 and rounds.rounds <= 100, rounds.rounds


def test_rejected_merges_are_put_back():
    """What the driver works out of the counts after a batch, against counts made after each merge."""
    rng = random.Random(8)
    cut = 0
    for _ in range(300):
        words = [([rng.randrange(5) for _ in range(rng.randrange(2, 9))], rng.randrange(1, 20)) for _ in range(30)]

        def count(merging, words=words):
            out = {}
            for ids, n in words:
                merged = bpe._merge(ids, merging)
                for p in zip(merged, merged[1:], strict=False):
                    out[p] = out.get(p, 0) + n
            return out

        ranked = sorted((-n, *p) for p, n in count({}).items())
        batch, passed = bpe.plan_batch([(-n, a, b) for n, a, b in ranked], 6)
        merging = {(a, b): 256 + k for k, (_, a, b) in enumerate(batch)}
        after = count(merging)
        pairs, n = np.array(list(after)).reshape(-1, 2), np.array(list(after.values()))
        right = 0
        for k, (_, a, b) in enumerate(batch):
            now = count({p: t for p, t in merging.items() if t < 256 + k})
            if min((-n, *p) for p, n in now.items())[1:] != (a, b):
                break
            right = k + 1
        assert bpe.accepted(batch, passed, 256, pairs, n) == right
        cut += right < len(batch)
        u, v = bpe._before(batch, 256, right, pairs)
        then = {(a, b): n for n, a, b in batch[right:]}
        for a, b, c in zip(u.tolist(), v.tolist(), n.tolist(), strict=True):
            then[a, b] = then.get((a, b), 0) + c
        assert then == count({p: t for p, t in merging.items() if t < 256 + right})
    assert cut > 30


def test_settings_and_figures(spark):
    docs = spark.createDataFrame([("low low low low low lower lower",), (None,), ("",)], "text string")
    t = bpe.train(docs, bpe.TrainConfig(256 + 50 + 2, specials=("<|a|>", "<|b|>")))
    assert t.requested == 50 and t.stopped_early and t.pieces == 7 and t.bytes == len("low low low low low lower lower") and t.distinct_pieces == 3
    assert list(t.counts) == sorted(t.counts, reverse=True) and len(t.counts) == len(t.merges)
    with pytest.raises(ValueError):
        bpe.TrainConfig(257, specials=("a", "b")).merges  # noqa: B018
    none = bpe.train(docs.where("text is null"), bpe.TrainConfig(300, max_distinct=0))
    assert none.merges == () and none.pieces == 0


def test_learner_against_counting_all_pairs_each_time():
    rng = random.Random(12)
    for _ in range(40):
        words = {}
        for _ in range(rng.randrange(1, 40)):
            word = bytes(rng.choices(b"aabbc ", k=rng.randrange(1, 10)))
            words[word] = words.get(word, 0) + rng.randrange(1, 6)
        ids, merges, told = [(list(w), n) for w, n in sorted(words.items())], [], []
        while len(merges) < 12:
            total = {}
            for w, n in ids:
                for p in zip(w, w[1:], strict=False):
                    total[p] = total.get(p, 0) + n
            best = min(total, key=lambda p: (-total[p], p), default=None)
            if best is None or total[best] < 2:
                break
            merges.append(best)
            told.append(total[best])
            ids = [(bpe._merge(w, {best: 255 + len(merges)}), n) for w, n in ids]
        assert bpe.learn_counted(sorted(words.items()), 12) == (merges, told)
