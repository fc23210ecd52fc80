"""Quality rules by weak supervision.

Each rule looks at a few numbers of a text and votes good (1), bad (-1) or abstains (0).
Nobody knows the rules' accuracies, so expectation-maximisation estimates them from how
their votes agree over all documents, and a document is kept if the posterior probability
that it is good reaches a threshold.  The model needs only the counts of the vote
patterns, at most 3 to the power of the number of rules, whatever the corpus' size.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revloom.llm.common import materialize, packed_row, quoted, unpacked_row

SPACES = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
HAS_SYMBOL = re.compile(rb"[#*$%&|<>]").search
WINDOW = 3
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_types", "n_lines", "n_symbol_words")
FEATURE_TYPE = T.StructType([T.StructField(name, T.LongType()) for name in FEATURES])


def repeat_words(words: list[bytes]) -> int:
    """Words in three-word windows that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    times = Counter(windows)
    if len(times) == len(windows):
        return 0
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered += i + WINDOW - max(i, end)
            end = i + WINDOW
    return covered


def features_of(text: str | None) -> tuple[int, ...]:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: at the six ASCII white-space characters only
    lines = raw.split(b"\n")
    filled = [x for x in lines if x.strip()]
    symbols = sum(map(text.count, SYMBOLS))
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        symbols,
        len(filled) - len(set(filled)),
        repeat_words(words),
        sum(raw.count(c) for c in range(65, 91)),
        len(set(words)),
        len(filled),
        sum(HAS_SYMBOL(w) is not None for w in words) if symbols else 0,
    )


@F.pandas_udf(FEATURE_TYPE)
def text_features(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([features_of(x) for x in texts], columns=list(FEATURES), dtype="int64")


@dataclass(frozen=True)
class VotingRule:
    """Bad where ``value`` is outside ``bad``, good where it is inside ``good``."""

    name: str
    value: str
    good: tuple[float, float]
    bad: tuple[float, float]

    def vote(self) -> Column:
        x = F.expr(self.value)
        return F.when((x < self.bad[0]) | (x > self.bad[1]), -1).when((x >= self.good[0]) & (x <= self.good[1]), 1).otherwise(0)


RULES = (
    VotingRule("length", "n_words", (100, 1e9), (50, 1e9)),
    VotingRule("word_length", "word_chars / greatest(n_words, 1)", (4, 8), (3, 10)),
    VotingRule("symbols", "n_symbols / greatest(n_words, 1)", (0, 0.02), (0, 0.1)),
    VotingRule("symbol_words", "n_symbol_words / greatest(n_words, 1)", (0, 0.02), (0, 0.1)),
    VotingRule("line_copies", "n_dup_lines / greatest(n_lines, 1)", (0, 0.05), (0, 0.5)),
    VotingRule("window_copies", "n_repeat_words / greatest(n_words, 1)", (0, 0.1), (0, 0.3)),
    VotingRule("capitals", "n_upper / greatest(word_chars, 1)", (0, 0.08), (0, 0.25)),
    VotingRule("variety", "n_types / sqrt(2 * greatest(n_words, 1))", (4, 1e9), (2, 1e9)),
)

#: Base conditions, which no vote overrules.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50


@dataclass(frozen=True)
class LabelModel:
    """Naive Bayes over the votes: ``prior`` of good and, by class and rule, the
    probabilities of the votes -1, 0 and 1."""

    prior: float
    votes: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        rules = np.arange(patterns.shape[1])
        log = np.log(self.votes[:, rules, patterns + 1]).sum(axis=2) + np.log([[1 - self.prior], [self.prior]])
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


#: What is assumed of a rule before the data speak: votes bad, none and good, on a bad
#: text, which seldom breaks all rules at once, and on a good one.
ASSUMED = ((0.3, 0.2, 0.5), (0.02, 0.1, 0.88))


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, assumed=ASSUMED, prior: float = 0.8, smoothing: float = 1.0) -> LabelModel:
    """EM from the votes ``assumed`` of each rule.

    The smoothing pulls each rule's table towards that assumption, so that rules that
    never vote, or a single pattern, leave it as it is.
    """
    n_rules = patterns.shape[1]
    start = np.repeat(np.array(assumed)[:, None, :], n_rules, axis=1)
    model = LabelModel(prior, start)
    weight = counts.astype(float)
    onehot = patterns[:, :, None] == np.array([-1, 0, 1])
    strength = smoothing + 0.01 * weight.sum()
    for _ in range(rounds):
        good = model.posterior(patterns)
        share = np.stack([(1 - good) * weight, good * weight])
        votes = np.einsum("cp,prv->crv", share, onehot) + strength * start
        new = float(np.clip((share[1].sum() + prior * strength) / (weight.sum() + strength), 0.01, 0.99))
        votes /= votes.sum(axis=2, keepdims=True)
        done = abs(new - model.prior) < 1e-9 and np.abs(votes - model.votes).max() < 1e-9
        model = LabelModel(new, votes)
        if done:
            break
    return model


def with_votes(featured: DataFrame, rules: tuple[VotingRule, ...] = RULES) -> DataFrame:
    """Adds ``pattern``, the votes as one number in base 3, and ``base_failed``."""
    code = sum(((r.vote() + 1) * 3**i for i, r in enumerate(rules)), F.lit(0))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return featured.withColumn("pattern", code.cast("int")).withColumn("base_failed", failed)


def posteriors(voted: DataFrame, n_rules: int) -> tuple[list[float], LabelModel]:
    """The posterior of every vote pattern there can be, fitted to all rows' votes."""
    every = np.array(list(itertools.product((-1, 0, 1), repeat=n_rules)))[:, ::-1]
    counts = np.zeros(3**n_rules)
    for row in voted.groupBy("pattern").count().collect():  # at most 3 ** n_rules rows
        counts[row["pattern"]] = row["count"]
    seen = counts > 0
    if not seen.any():
        seen[:] = True
    model = fit_label_model(every[seen], counts[seen])
    return model.posterior(every).tolist(), model


def verdict(voted: DataFrame, probability: list[float], threshold: float) -> DataFrame:
    """Adds the posterior ``quality`` and ``kept``."""
    looked_up = lookup(probability)(F.col("pattern"))
    return voted.withColumn("quality", looked_up).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def lookup(probability: list[float]):
    table = np.round(np.array(probability), 6)

    @F.pandas_udf(T.DoubleType())
    def of(pattern: pd.Series) -> pd.Series:
        return pd.Series(table[pattern.to_numpy()])

    return of


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[VotingRule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, the features, base_failed, quality, kept.

    Null and empty texts have no words and fail the base conditions; repeated rows and
    ids get a row each; an empty table gives none; other columns are not read.
    """
    featured = docs.select(quoted(id_col).alias("doc_id"), text_features(quoted(text_col)).alias("f")).select("doc_id", "f.*")
    voted = materialize(with_votes(featured, rules))
    probability, _ = posteriors(voted, len(rules))
    return verdict(voted, probability, threshold).drop("pattern")


def quality_filtered(docs: DataFrame, text_col: str = "text", rules: tuple[VotingRule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the model keeps, with the same columns: null, empty and
    short texts go, repeated rows are judged alike, and an empty table gives an empty one."""
    rows = docs.select(packed_row(docs).alias("row"), text_features(quoted(text_col)).alias("f")).select("row", "f.*")
    voted = with_votes(rows, rules)
    probability, _ = posteriors(voted, len(rules))
    kept = verdict(voted, probability, threshold).filter("kept")
    return unpacked_row(kept, docs.columns)
