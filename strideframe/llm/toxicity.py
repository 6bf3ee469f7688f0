"""Toxicity by multiple-instance learning: a document is a bag of sentences, its probability is the noisy-or of theirs.

Only documents are labelled.  A sentence's probability is a logistic function of its features (words, and their first 3 to 7
characters, as offensive words are inflected); a document is clean when all its sentences are: ``1 - prod(1 - p)``.  The likelihood of the document
labels is maximised, which teaches the sentence model which sentences to blame; they are returned as spans.

The classifier is fit on a bounded sample of the labelled rows: about ``SAMPLE`` of them, drawn by a hash of the id, the longest
ones included whole.  Their feature ids, not their texts, come to the driver.  Scoring reads every whole text.

Defined results: a null text is empty and, like any text without sentences, has the score of a bag with one featureless sentence;
a label that is null or whose id is null teaches nothing; a document with several labels counts once per label; without any labelled
row the model is the bias alone; rows that repeat an id are scored each; extra columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.shared import as_text, written

SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
WORDS = re.compile(r"\w+")
STEMS, SAMPLE, LEAST_DOCS, LEAST_Z, CACHE = range(3, 8), 8000, 3, 4.0, 500_000
BIAS, L2, ROUNDS, RATE, BLAME = -7.0, 0.003, 150, 0.3, 0.3


def features(sentence: str) -> list[str]:
    words = WORDS.findall(sentence.lower())
    return words + ["^" + w[:n] for w in words for n in STEMS if len(w) > n]


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]  # per feature, summed over a sentence
    bias: float

    def sentence(self, text: str, cache: dict[str, float]) -> float:
        """The logit of a sentence.  ``cache`` keeps the logits of up to ``CACHE`` words."""
        z = self.bias
        for w in WORDS.findall(text.lower()):
            x = cache.get(w)
            if x is None:
                if len(cache) >= CACHE:
                    cache.clear()
                cache[w] = x = sum(self.weights.get(f, 0.0) for f in features(w))
            z += x
        return z


def fit_noisy_or(word: np.ndarray, sentence: np.ndarray, bag: np.ndarray, label: np.ndarray, n_words: int, rounds: int = ROUNDS,
                 l2: float = L2, rate: float = RATE, bias: float = BIAS) -> tuple[np.ndarray, float]:
    """Weights and bias from feature occurrences ``(word, sentence)``, the bag of each sentence, the label of each bag.

    Full-batch Adam on the mean negative log-likelihood.  With ``s = sum(softplus(z))`` over a bag, its clean probability is
    ``exp(-s)``.
    """
    w, b = np.zeros(n_words + 1), bias
    w[-1] = b
    m, v = np.zeros_like(w), np.zeros_like(w)
    n, bags = len(bag), len(label)
    for step in range(1, rounds + 1):
        z = np.bincount(sentence, weights=w[word], minlength=n) + w[-1]
        s = np.bincount(bag, weights=np.logaddexp(0, z), minlength=bags)
        pull = np.where(label == 1, -1 / np.expm1(np.clip(s, 1e-9, 700)), 1.0)  # d loss / d softplus
        g = pull[bag] / (1 + np.exp(-np.clip(z, -500, 500)))
        grad = np.append(np.bincount(word, weights=g[sentence], minlength=n_words), g.sum()) / max(bags, 1)
        grad[:-1] += l2 / max(bags, 1) * w[:-1] * 10
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= rate * 0.98 ** (step / 2) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn from ``(id, label)`` rows and the texts of those ids."""
    known = labels.filter(F.col(id).isNotNull() & F.col(label).isin(0, 1)).select(F.col(id).alias("id"), F.col(label).cast("int").alias("y"))
    n = known.count()
    share = min(1.0, sample / max(n, 1))
    drawn = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)  # the documented sample
    bags = docs.select(F.col(id).alias("id"), as_text(text).alias("text")).join(F.broadcast(written(drawn, "labelled")), "id").select("text", "y")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([[" ".join(f) for s in SENTENCE.findall(t.as_py()) if (f := features(s))] for t in b.column(0)], pa.list_(pa.string()))],
                                             names=["y", "sentences"])

    bags = written(bags.mapInArrow(tokens, "y int, sentences array<string>"), "bags")
    feature = F.explode(F.array_distinct(F.split(F.array_join("sentences", " "), " ")))
    rate = bags.agg(F.avg("y")).first()[0] or 0.0
    surprise = (F.col("toxic") / F.col("n") - rate) / F.sqrt(F.lit(rate * (1 - rate) + 1e-9) / F.col("n"))
    per = bags.select("y", feature.alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("toxic"))
    per = per.filter((F.col("toxic") >= LEAST_DOCS) & (surprise >= LEAST_Z) & (F.col("f") != ""))  # more often in toxic documents than by chance
    vocabulary = {r["f"]: i for i, r in enumerate(sorted(per.collect()))}  # features of a bounded sample

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[[vocabulary[f] for f in s.split(" ") if f in vocabulary] for s in bag] for bag in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[i for s in bag for i in s] for bag in out], pa.list_(pa.int32())), pa.array([[len(s) for s in bag] or [0] for bag in out], pa.list_(pa.int32()))],
                                             names=["y", "words", "lengths"])

    table = bags.mapInArrow(encode, "y int, words array<int>, lengths array<int>").toArrow().combine_chunks()  # of the sample
    if not table.num_rows:
        return Model({}, BIAS)
    words, lengths = (table.column(c).combine_chunks() for c in ("words", "lengths"))
    per_sentence, y = lengths.flatten().to_numpy(), table.column("y").to_numpy()
    bag = np.repeat(np.arange(len(y)), np.diff(lengths.offsets.to_numpy()))
    weights, bias = fit_noisy_or(words.flatten().to_numpy(), np.repeat(np.arange(len(bag)), per_sentence), bag, y, len(vocabulary))
    return Model({f: float(weights[i]) for f, i in vocabulary.items() if abs(weights[i]) > 1e-3}, bias)


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text", blame: float = BLAME) -> DataFrame:
    """``doc_id, score, sentences``: the noisy-or, and the spans (code points, with probability) of the sentences of ``blame`` or more."""
    span = pa.struct([("from", pa.int32()), ("to", pa.int32()), ("p", pa.float64())])
    kinds = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("sentences", pa.list_(span))])
    logit = float(np.log(blame / (1 - blame)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for b in batches:
            scores, spans = [], []
            for t in b.column(1):
                text, z, found = t.as_py(), [], []
                for s in SENTENCE.finditer(text):
                    one = model.sentence(s[0], cache)
                    z.append(one)
                    if one >= logit:
                        found.append({"from": s.start(), "to": s.end(), "p": 1 / (1 + np.exp(-one))})
                scores.append(-np.expm1(-np.logaddexp(0, np.array(z or [model.bias])).sum()))
                spans.append(found)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(span))], schema=kinds)

    return docs.select(F.col(id).cast("bigint").alias("doc_id"), as_text(text).alias("text")).mapInArrow(
        run, "doc_id bigint, score double, sentences array<struct<from: int, to: int, p: double>>")


def held_out(id: str = "doc_id"):
    """The fold that no label is learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
