"""Operator 4, toxicity by multiple-instance learning.

A document is a bag of sentences, of which only the bag has a label. A sentence's probability is a
logistic function of the words in it; the bag's is their noisy-or, 1 - prod(1 - p). The weights are
fitted to the labels of bags, so the sentences that make a bag toxic get high scores by themselves,
and are then pointed out.

The fit sees a bounded sample of labelled rows (``MAX_POSITIVE``, ``MAX_NEGATIVE``, ``MAX_CHARS``),
which is all that is broadcast or sent to the driver beside the model (``VOCABULARY`` words); the
driver gets known words as numbers, so at most four bytes for each two characters of the sample.
Scoring is a map over whole texts: no shuffle, and a hot source or group of copies costs as many
other rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_of

#: Labelled rows that the fit sees at most, the first of each label by a hash of the id.
MAX_POSITIVE, MAX_NEGATIVE = 4_000, 8_000
#: Characters of the texts of each label that the fit sees at most, in the same order.
MAX_CHARS = 24_000_000
#: Words of the model, and texts that a word must be in.
VOCABULARY, MIN_TEXTS = 2_048, 5
#: Steps of the fit, their size, the pull of weights to zero, and the first bias of a sentence.
EPOCHS, STEP, DECAY, BIAS = 300, 0.1, 1e-4, -7.0

SENTENCE = re.compile(r"[^.!?\n]+")
TERM = re.compile(r"\w+")
#: Letters of a longer word's beginning, which is a feature beside the word: inflected words share it.
STEM = 5


def features(text: str) -> set[str]:
    """Words of a lower-case text, and the beginnings of longer ones with a star."""
    words = set(TERM.findall(text))
    return words | {w[:STEM] + "*" for w in words if len(w) > STEM}


@dataclass(frozen=True)
class MilModel:
    """Weights of words and the bias of a sentence without any."""

    weights: dict[str, float]
    bias: float

    def sentence(self, text: str) -> float:
        return self.bias + sum(self.weights.get(w, 0.0) for w in features(text))


def held_out(doc_id):
    """Whether a row is one of those whose labels are never learnt from."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, max_positive: int, max_negative: int, max_chars: int = MAX_CHARS) -> DataFrame:
    """(doc_id, toxic, text) of the sample: at most so many rows and characters of each label, by a hash of the id.

    Of different texts that share a doc_id the least one is taken. An id is toxic if any of its labels is.
    """
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).alias("toxic"))
    order = F.xxhash64("doc_id")
    sample = rows.where("toxic").orderBy(order, "doc_id").limit(max_positive).unionByName(rows.where("not toxic").orderBy(order, "doc_id").limit(max_negative))
    # bounded by the two limits, whatever the input
    texts = text_of(docs).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    texts = materialize(texts, "sample")
    chars = texts.select("doc_id", "toxic", F.length("text").alias("n")).withColumn("sum", F.sum("n").over(Window.partitionBy("toxic").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    return texts.join(F.broadcast(chars.where(F.col("sum") <= max_chars).select("doc_id")), "doc_id", "left_semi")


def vocabulary(rows: DataFrame, size: int, min_texts: int) -> list[str]:
    """The words whose presence tells most about the label, by the log odds over their standard error."""
    words = rows.select("toxic", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))).alias("words"))
    stems = F.transform(F.filter("words", lambda w: F.length(w) > STEM), lambda w: F.concat(F.substring(w, 1, STEM), F.lit("*")))
    words = words.select("toxic", F.explode(F.array_union("words", stems)).alias("word"))
    counts = words.groupBy("word").agg(F.count_if("toxic").alias("pos"), F.count_if(~F.col("toxic")).alias("neg")).where(F.col("pos") + F.col("neg") >= min_texts)
    totals = rows.agg(F.count_if("toxic"), F.count_if(~F.col("toxic"))).first()
    n_pos, n_neg = float(totals[0]), float(totals[1])
    if not n_pos or not n_neg:
        return []
    odds = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
    z = odds / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    top = counts.select("word", F.abs(z).alias("z")).where("z > 3").orderBy(F.desc("z"), "word").limit(size)
    return [r["word"] for r in top.collect()]


@dataclass(frozen=True)
class Bags:
    """Bags of sentences in one: labels and sentences without a known word of each bag; for each other sentence its bag and its words."""

    label: np.ndarray
    plain: np.ndarray
    bag_of: np.ndarray
    lengths: np.ndarray
    word: np.ndarray


def bags(rows: DataFrame, words: list[str]) -> Bags:
    """The bags of the sample, in the order of doc_id."""
    place = {w: i for i, w in enumerate(words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain, known, lengths = [], [], []
            for text in batch.column("text").to_pylist():
                found = [sorted({place[w] for w in features(s) if w in place}) for s in SENTENCE.findall(text.lower())]
                held = [f for f in found if f]
                plain.append(len(found) - len(held))
                lengths.append(np.array([len(f) for f in held], np.uint16).tobytes())
                known.append(np.array([w for f in held for w in f], np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(plain, pa.int32()), pa.array(lengths, pa.binary()), pa.array(known, pa.binary())], names=["doc_id", "toxic", "plain", "lengths", "known"])

    found = sorted(rows.mapInArrow(run, "doc_id long, toxic boolean, plain int, lengths binary, known binary").collect())
    lengths = [np.frombuffer(r["lengths"], np.uint16) for r in found]
    return Bags(
        np.array([r["toxic"] for r in found], float),
        np.array([r["plain"] for r in found], float),
        np.repeat(np.arange(len(found)), [len(x) for x in lengths]),
        np.concatenate([*lengths, np.zeros(0, np.uint16)]).astype(int),
        np.concatenate([*(np.frombuffer(r["known"], np.uint16) for r in found), np.zeros(0, np.uint16)]).astype(int),
    )


def fit_noisy_or(found: Bags, n_words: int) -> tuple[np.ndarray, float]:
    """Weights and bias that maximise the likelihood of the bags' labels; a fixed number of steps from fixed values."""
    label, plain, bag_of, lengths, word = found.label, found.plain, found.bag_of, found.lengths, found.word
    sentence_of = np.repeat(np.arange(len(lengths)), lengths)
    n, share = len(label), max(label.mean(), 1e-9)
    weight = np.where(label > 0, 0.5 / share, 0.5 / max(1 - share, 1e-9))
    theta, m, v = np.append(np.zeros(n_words), BIAS), np.zeros(n_words + 1), np.zeros(n_words + 1)
    for t in range(1, EPOCHS + 1):
        z = theta[-1] + np.bincount(sentence_of, theta[word], len(lengths))
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + math.exp(-theta[-1]))
        none = np.exp(np.bincount(bag_of, np.log1p(-np.minimum(p, 1 - 1e-12)), n) + plain * math.log1p(-p0))
        # d log likelihood / d z of a sentence: p * none / (1 - none) in a toxic bag, -p in another
        pull = weight * np.where(label > 0, none / np.maximum(1 - none, 1e-9), -1.0)
        by_sentence = pull[bag_of] * p
        grad = np.append(np.bincount(word, by_sentence[sentence_of], n_words), by_sentence.sum() + (pull * plain).sum() * p0) / n
        grad[:-1] -= DECAY * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta += STEP * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE, size: int = VOCABULARY, min_texts: int = MIN_TEXTS, max_chars: int = MAX_CHARS) -> MilModel:
    """The model of the labelled rows that aren't held out. Without both labels in the sample it knows no word and calls nothing toxic."""
    rows = training_rows(docs, labels, max_positive, max_negative, max_chars)
    words = vocabulary(rows, size, min_texts)
    if not words:
        return MilModel({}, -50.0)
    weights, bias = fit_noisy_or(bags(rows, words), len(words))
    return MilModel({w: float(x) for w, x in zip(words, weights, strict=True)}, bias)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: MilModel = shared.value
        known = model.weights.keys()
        plain = math.log1p(-1 / (1 + math.exp(-model.bias)))
        for batch in batches:
            scores, spans = [], []
            for value in batch.column("text"):
                lower = value.as_py().lower()
                at = []
                if known.isdisjoint(features(lower)):
                    none = plain * sum(1 for _ in SENTENCE.finditer(lower))
                else:
                    none = 0.0
                    for m in SENTENCE.finditer(lower):
                        p = 1 / (1 + math.exp(-max(-50.0, min(36.0, model.sentence(m.group())))))
                        none += math.log1p(-p)
                        if p >= 0.5:
                            at.append({"start": m.start(), "end": m.end(), "score": p})
                scores.append(-math.expm1(none))
                spans.append(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))],
                names=["doc_id", "score", "offending"],
            )

    return run


def toxicity_scores(docs: DataFrame, model: MilModel) -> DataFrame:
    """doc_id, score, offending (spans of sentences of 0.5 or more, in the text's lower case) of every whole text.

    A null or empty text has no sentence and scores 0. Every row gives one row; only the text is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return text_of(docs).mapInArrow(_score(shared), "doc_id long, score double, offending array<struct<start:int,end:int,score:double>>")


def op4_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns and the place of the first offending sentence (null without one), for every row of ``documents``.

    A null or empty text scores 0; a row without a doc_id isn't held out. Rows that repeat score alike.
    Without labels nothing is toxic; an empty table gives no rows.
    """
    found = toxicity_scores(documents, fit(documents, labels))
    return found.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("offending").cast("long").alias("n_offending"),
        F.get("offending", F.lit(0))["start"].alias("first_start"),
        F.get("offending", F.lit(0))["end"].alias("first_end"),
    )
