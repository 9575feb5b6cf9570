"""Document quality by weak supervision.

Simple rules look at a document and vote good (1), bad (-1) or abstain (0). None is
trusted by itself: expectation maximisation over the documents' vote patterns estimates
how often each rule votes how on good and on bad documents (its accuracies), and gives
each document a posterior probability of being good. What counts are patterns, at most
3^6 of them: Spark counts them over all documents, the fit runs on the counts.

Base features are counted over whole texts. Words are runs of characters other than
ASCII white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlog.llm.hashing import runs, word_hashes

FEATURES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_alphanumeric", "n_distinct_words",
]
SYMBOLS = "#*$%&|<>"
WINDOW = 8
# Fixed values of the base filter: fewest words, highest percentage of repeated words.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


def repeated_words(hashes: np.ndarray, width: int = WINDOW) -> int:
    """Words inside windows that are found twice or more."""
    found = runs(hashes, width)
    if len(found) < 2:
        return 0
    order = np.argsort(found, kind="stable")
    same = found[order][1:] == found[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(found), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    marks = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(twice)
    marks[at] += 1
    marks[at + width] -= 1
    return int((np.cumsum(marks) > 0).sum())


def features(text: str | None, hashes: np.ndarray) -> tuple[int, ...]:
    """The values of FEATURES, given the hashes of the words; zeros for a null text."""
    if not text:
        return (0,) * len(FEATURES)
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, " \t\n\r\x0b\x0c"))
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    alphanumeric = len(text) - _other_signs(text)
    return (
        len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(hashes),
        len(lines), alphanumeric, len(set(words)),
    )


def _other_signs(text: str) -> int:
    """Code points that are neither letters nor digits; counted on the distinct ones."""
    return sum(text.count(c) for c in set(text) if not c.isalnum())


@F.pandas_udf(T.StructType([T.StructField(name, T.LongType()) for name in FEATURES]))
def text_features(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in texts:
        yield pd.DataFrame(list(map(features, part, word_hashes([(t or "").encode() for t in part]))), columns=FEATURES, dtype="int64")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules(f: str) -> dict[str, Column]:
    """The rules over a struct column of features. Every share is of something that is not zero here."""
    at = lambda name: F.col(f)[name]
    words, chars = F.greatest(at("n_words"), F.lit(1)), F.greatest(at("word_chars"), F.lit(1))
    symbols, length = at("n_symbols") / words, at("word_chars") / words
    repeats, copies = at("n_repeat_words") / words, at("n_dup_lines") / F.greatest(at("n_lines"), F.lit(1))
    plain, variety = at("n_alphanumeric") / chars, at("n_distinct_words") / words
    return {
        "symbols": _vote(symbols <= 0.1, symbols >= 0.3),
        "word_length": _vote(length.between(3, 7), (length < 2) | (length > 20)),
        "repeats": _vote(repeats <= 0.05, repeats >= 0.3),
        "line_copies": _vote(copies <= 0.1, copies >= 0.5),
        "plain_signs": _vote(plain >= 0.9, plain < 0.7),
        "variety": _vote((variety >= 0.5) | (words >= 1000), (variety < 0.2) & (words < 1000)),
    }


class VoteModel:
    """Two classes; each rule votes independently given the class."""

    def __init__(self, prior: float, table: np.ndarray):
        self.prior = prior  # share of good documents
        self.table = table  # P(vote | class): rule x class (bad, good) x vote (-1, 0, 1)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of being good for each row of votes."""
        logs = np.log(np.array([1 - self.prior, self.prior]))[None, :]
        for j in range(votes.shape[1]):
            logs = logs + np.log(self.table[j][:, votes[:, j] + 1]).T
        logs -= logs.max(axis=1, keepdims=True)
        share = np.exp(logs)
        return share[:, 1] / share.sum(axis=1)

    def accuracies(self) -> np.ndarray:
        """Per rule: share of right votes among votes on bad and on good documents."""
        right = np.stack([self.table[:, 0, 0], self.table[:, 1, 2]], axis=1)
        return right / (1 - self.table[:, :, 1])


def fit(votes: np.ndarray, counts: np.ndarray, rounds: int = 200, smoothing: float = 1.0) -> VoteModel:
    """Expectation maximisation over vote patterns and their counts.

    Starts from the share of good votes, one bad vote weighing as much as two good ones.
    A class is what its rules call it: wherever an estimate has the bad class vote good
    more often than the good class does, the two rates are set equal (the rule then says nothing).
    """
    n_rules = votes.shape[1]
    if not len(votes):
        return VoteModel(0.5, np.full((n_rules, 2, 3), 1 / 3))
    weight = counts.astype(float)
    good = 1 / (1 + np.exp(2.0 * (votes < 0).sum(axis=1) - (votes > 0).sum(axis=1)))
    one_hot = np.stack([(votes == v).astype(float) for v in (-1, 0, 1)], axis=2)
    model = None
    for _ in range(rounds):
        share = np.stack([1 - good, good]) * weight
        table = np.einsum("cp,pjv->jcv", share, one_hot) + smoothing
        table /= table.sum(axis=2, keepdims=True)
        odd = (table[:, 0, 2] > table[:, 1, 2]) & (table[:, 0, 0] < table[:, 1, 0])
        table[odd] = table[odd].mean(axis=1, keepdims=True)
        prior = float(np.clip(share[1].sum() / weight.sum(), 0.01, 0.99))
        model = VoteModel(prior, table)
        new = model.posterior(votes)
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return model


def assess(df: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """All columns of df plus `quality`, a struct of the features, base_failed, the votes, probability and kept.

    A null or empty text has no words and fails the base filter. Two passes over the
    texts: one counts vote patterns over all rows, one applies the fitted model. With
    no rows there is nothing to fit and nothing to return. A column named quality is replaced.
    """
    others = [c for c in df.columns if c.lower() != "quality"]
    found = df.select(*[df[c] for c in others], text_features(df[text_col].cast("string")).alias("quality"))
    votes = rules("quality")
    names = list(votes)
    patterns = found.select(*[v.alias(n) for n, v in votes.items()]).groupBy(*names).count().collect()  # 3^6 rows at most
    patterns = sorted(tuple(r) for r in patterns)
    table = np.array([p[:-1] for p in patterns], np.int64).reshape(len(patterns), len(names))
    model = fit(table, np.array([p[-1] for p in patterns], np.int64))
    odds = F.lit(float(np.log(model.prior / (1 - model.prior))))
    for j, name in enumerate(names):
        bad, none, good = (float(x) for x in np.log(model.table[j, 1] / model.table[j, 0]))
        vote = F.col("quality")[name]
        odds += F.when(vote < 0, bad).when(vote > 0, good).otherwise(none)
    f = F.col("quality")
    base = (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * f["n_words"])
    voted = found.withColumn("quality", F.struct("quality.*", base.alias("base_failed"), *[v.alias(n) for n, v in votes.items()]))
    scored = voted.withColumn("quality", f.withField("probability", 1 / (1 + F.exp(-odds))))
    return scored.withColumn("quality", f.withField("kept", ~f["base_failed"] & (f["probability"] >= threshold)))
