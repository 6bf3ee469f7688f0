"""Quality by weak supervision: rules vote or abstain, expectation-maximisation learns how far to trust each.

A rule sees a few counts of a text and votes for good (1) or bad (-1), or abstains (0).  Nothing is labelled: a document's
class is latent, votes are taken as independent given the class, and for each rule the share of right votes among good and
among bad documents is estimated with the share of good documents.  The posterior of a document replaces the test that all
rules must pass: one wrong rule is outvoted, several weak hints add up.

Counts come from one pass over the texts, document by document.  Expectation-maximisation needs only how often each pattern
of votes occurs: at most 3 ** (number of rules) numbers reach the driver (177,147 for the rules below, whatever the number of
documents), and all documents count.

Defined results: a null text counts as empty, has no words and fails the base test; a rule whose counts have nothing to
divide by abstains; a document for which all rules abstain has the share of good documents as posterior; ties (exactly 0.5)
are kept; null ids and repeated rows are judged as rows of their own; extra columns are ignored, whatever their names; an
empty table gives an empty table, and the starting model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm.shared import as_text, written

SYMBOLS = b"#*$%&|<>"
CAPITALS, SMALL = bytes(range(65, 91)), bytes(range(97, 123))
#: What letters are made of (ASCII letters, and bytes of longer code points), and how words of prose end.
LETTERS = np.isin(np.arange(256), [*CAPITALS, *SMALL, *range(128, 256)])
PLAIN_END = LETTERS | np.isin(np.arange(256), [*b"0123456789.,;:!?\"')"])
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_capitals", "n_small", "n_shouts",
          "n_plain_ends", "n_spoken", "n_doubled")
LEAST_WORDS, MOST_REPEATED = 10, 20  # of the base test: words, and repeated words in a hundred

#: A rule's expected share of right votes among good and among bad documents (a rule sees one kind of fault, and is rarely
#: wrong), and what each expectation weighs as a share of all documents; the share of good documents to start from; rounds.
RIGHT_GOOD, WEIGHT_GOOD, RIGHT_BAD, WEIGHT_BAD = 0.99, 1.0, 0.5, 0.1
START, ROUNDS = 0.9, 40


def rank_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers that are equal for equal pairs."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def repeated_words(codes: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows that occur twice or more.  Windows are numbered by doubling their length, so equality is exact."""
    n = len(codes) - window + 1
    if n < 2:
        return 0
    ranks, size = codes, 1
    while size < window:
        step = min(size, window - size)
        ranks, size = rank_pairs(ranks[:len(ranks) - step], ranks[step:]), size + step
    again = np.flatnonzero(np.bincount(ranks)[ranks] > 1)
    marks = np.zeros(len(codes) + 1, np.int64)
    np.add.at(marks, again, 1)
    np.add.at(marks, again + window, -1)
    return int(np.count_nonzero(np.cumsum(marks)))


def counted(text: bytes) -> tuple[int, ...]:
    """The ``COUNTS`` of a text.  ``bytes.split`` cuts at the same six characters as a word ends."""
    words = text.split()
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    lines = [line for line in text.split(b"\n") if line.split(None, 1)]
    letters = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    chars = int(np.count_nonzero(letters & 0xC0 != 0x80))
    spoken = np.add.reduceat(LETTERS[letters], ends - np.diff(ends, prepend=0), dtype=np.int64) if len(words) else ends
    return (len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(codes), len(lines),
            len(numbers), len(text) - len(text.translate(None, CAPITALS)), len(text) - len(text.translate(None, SMALL)), text.count(b"!!"),
            int(PLAIN_END[letters[ends - 1]].sum()), int(np.count_nonzero(spoken)), int(np.count_nonzero(codes[1:] == codes[:-1])))


def counts(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the ``COUNTS`` of every whole text."""
    schema = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            table = np.array([counted(t.as_py()) for t in b.column(1)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in table.T)], names=["doc_id", *COUNTS])

    return docs.select(F.col(id).cast("bigint").alias("doc_id"), as_text(text).cast("binary").alias("text")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """Votes by the quotient of two integer expressions over the counts: bad and good are ranges, anything else abstains."""

    name: str
    part: str
    whole: str
    good: tuple[float, float]
    bad: tuple[tuple[float, float], ...]

    def vote(self) -> Column:
        part, whole = F.expr(f"({self.part})").cast("double"), F.expr(f"({self.whole})").cast("double")
        within = lambda lo, hi: (part >= lo * whole) & (part < hi * whole)
        bad = F.lit(False)
        for lo, hi in self.bad:
            bad = bad | within(lo, hi)
        return F.when(whole <= 0, 0).when(bad, -1).when(within(*self.good), 1).otherwise(0).alias(self.name)

    def sql(self) -> str:
        """The same vote for another SQL engine."""
        within = lambda lo, hi: f"({self.part})::DOUBLE >= {lo!r} * ({self.whole}) AND ({self.part})::DOUBLE < {hi!r} * ({self.whole})"
        bad = " OR ".join(f"({within(*b)})" for b in self.bad)
        return f"CASE WHEN ({self.whole}) <= 0 THEN 0 WHEN {bad} THEN -1 WHEN {within(*self.good)} THEN 1 ELSE 0 END"


FAR = 1e18
RULES = (
    Rule("words", "n_words", "least(n_words, 1)", (50, FAR), ((0, 15),)),
    Rule("word_length", "word_chars", "n_words", (3, 9), ((0, 2.5), (12, FAR))),
    Rule("symbols", "n_symbols", "n_words", (0, 0.01), ((0.1, FAR),)),
    Rule("word_ends", "n_plain_ends", "n_words", (0.95, 1.01), ((0, 0.8),)),
    Rule("spoken_words", "n_spoken", "n_words", (0.95, 1.01), ((0, 0.8),)),
    Rule("repeated_lines", "n_dup_lines", "n_lines", (0, 0.05), ((0.25, FAR),)),
    Rule("repeated_words", "n_repeat_words", "n_words", (0, 0.03), ((0.15, FAR),)),
    Rule("doubled_words", "n_doubled", "n_words", (0, 0.03), ((0.2, FAR),)),
    Rule("capitals", "n_capitals", "n_capitals + n_small", (0, 0.15), ((0.4, FAR),)),
    Rule("shouts", "n_shouts", "n_words", (0, 0.005), ((0.1, FAR),)),
    Rule("variety", "n_distinct * n_distinct", "n_words", (12, FAR), ((0, 2.5),)),
)


@dataclass(frozen=True)
class Model:
    """The share of good documents, and each rule's share of right votes among good and among bad documents."""

    good: float
    right_good: tuple[float, ...]
    right_bad: tuple[float, ...]

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        up, down = self.weights()
        return math.log(self.good / (1 - self.good)) + (votes == 1) @ up + (votes == -1) @ down

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """What a vote for good and a vote for bad add to the log odds."""
        a, b = np.array(self.right_good), np.array(self.right_bad)
        return np.log(a / (1 - b)), np.log((1 - a) / b)

    def posterior(self, rules: tuple[Rule, ...] = RULES) -> Column:
        up, down = self.weights()
        odds = F.lit(math.log(self.good / (1 - self.good)))
        for rule, u, d in zip(rules, up.tolist(), down.tolist()):
            odds = odds + F.when(F.col(rule.name) == 1, u).when(F.col(rule.name) == -1, d).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def estimate(votes: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation over the different patterns of votes, ``n`` documents each.

    Expectations enter as votes seen before, in proportion to the number of documents, so that all sizes behave alike.  They
    also keep the classes' names: the good class is the one in which rules are rarely wrong.
    """
    k = votes.shape[1]
    model = Model(START, (RIGHT_GOOD,) * k, (RIGHT_BAD,) * k)
    total = float(n.sum())
    up, down = votes == 1, votes == -1
    for _ in range(rounds if total else 0):
        good = n / (1 + np.exp(-model.log_odds(votes)))
        bad = n - good
        model = Model(float(good.sum() + START) / (total + 1),
                      tuple(((good @ up + RIGHT_GOOD * WEIGHT_GOOD * total) / (good @ (up | down) + WEIGHT_GOOD * total)).tolist()),
                      tuple(((bad @ down + RIGHT_BAD * WEIGHT_BAD * total) / (bad @ (up | down) + WEIGHT_BAD * total)).tolist()))
    return model


def base_failed() -> Column:
    """Too few words, or more than a fifth of them in repeated windows."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, the counts, a vote per rule, ``posterior``, ``base_failed`` and ``kept``."""
    voted = written(counts(docs, id, text).select("*", *(r.vote() for r in rules)), "votes")
    pattern = sum(((F.col(r.name) + 1) * F.lit(3 ** i) for i, r in enumerate(rules)), F.lit(0)).cast("bigint").alias("pattern")
    found = voted.groupBy(pattern).count().orderBy("pattern").toPandas()
    votes = found["pattern"].to_numpy(np.int64)[:, None] // 3 ** np.arange(len(rules)) % 3 - 1
    model = estimate(votes, found["count"].to_numpy(float))
    out = voted.withColumn("posterior", model.posterior(rules)).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
