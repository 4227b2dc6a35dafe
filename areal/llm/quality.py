"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a short vector of transformed statistics. A normal density with
its own mean and covariance is fitted to each class; the covariances are shrunk
towards the pooled one and its diagonal. The fit keeps the Cholesky factors, so a
score is a difference of two Mahalanobis forms plus constants.

The fit reads all labelled rows of the training folds: counts, sums and sums of
products are added up by Spark, and only those few numbers reach the driver.
"""

from __future__ import annotations

import functools
import itertools
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areal.llm.common import labels_of

#: Share of the pooled covariance in that of a class, and of the diagonal in both.
TO_POOLED, TO_DIAGONAL = 0.1, 0.02

FEATURES = (
    "log_chars",
    "letters",
    "upper",
    "digits",
    "marks",
    "symbols",
    "log_word_chars",
    "spread_word_chars",
    "distinct",
    "commonest",
    "repeats",
    "log_line_words",
    "common_marks",
)
LETTER, UPPER, DIGIT, SPACE, MARK, SYMBOL = range(6)
#: Imagined signs or words of usual prose that each share is drawn to.
WEIGHT = 30
#: Signs of ordinary prose.
MARKS = ".,;:'\"()-’“”"


@functools.cache
def _kinds() -> np.ndarray:
    """The kind of each code point of the first plane."""
    kinds = np.full(0x10000, LETTER, dtype=np.uint8)
    for point in range(0x10000):
        sign = chr(point)
        if sign in MARKS:
            kinds[point] = MARK
        elif sign.isspace():
            kinds[point] = SPACE
        elif sign.isalpha():
            kinds[point] = UPPER if sign.isupper() else LETTER
        elif sign.isdigit():
            kinds[point] = DIGIT
        elif not unicodedata.category(sign).startswith("M"):
            kinds[point] = SYMBOL
    return kinds


def _angle(share: float) -> float:
    """Spread shares near 0 and 1, where they crowd."""
    return float(np.arcsin(np.sqrt(min(max(share, 0.0), 1.0))))


def _share(part: int, whole: int, usual: float) -> float:
    """A share, drawn to the usual one by WEIGHT imagined items, so that short texts don't look odd by chance."""
    return _angle((part + WEIGHT * usual) / (whole + WEIGHT))


def features(text: str | None) -> list[float]:
    """The statistics of one whole text, in the order of FEATURES; null counts as empty, empty gives zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    counts = np.bincount(_kinds()[np.minimum(points, 0xFFFF)], minlength=6)
    letters = int(counts[LETTER] + counts[UPPER])
    seen = max(1, len(points) - int(counts[SPACE]))
    words = text.split()
    n = max(1, len(words))
    sizes = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    tally = Counter(words)
    repeats = sum(map(str.__eq__, words, itertools.islice(words, 1, None)))
    return [
        float(np.log1p(len(points))),
        _share(letters, seen, 0.95),
        _share(int(counts[UPPER]), letters, 0.04),
        _share(int(counts[DIGIT]), seen, 0.0),
        _share(int(counts[MARK]), seen, 0.04),
        _share(int(counts[SYMBOL]), seen, 0.0),
        float(np.log1p(sizes.mean())),
        float(np.log1p(sizes.std())),
        float(np.log1p(len(tally)) / np.log1p(n)),
        _share(max(tally.values(), default=0), n, 0.06),
        _share(repeats, n, 0.0),
        float(np.log1p(n / (1 + text.count("\n")))),
        _share(int(counts[MARK]), int(counts[MARK] + counts[SYMBOL]), 1.0),
    ]


def features_of(text: Column) -> Column:
    """Column of the statistics of a text column."""

    @F.pandas_udf("array<double>")
    def rows(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([features(t) for t in batch])

    return rows(text)


@dataclass(frozen=True)
class Discriminant:
    """Two classes: log priors, means, inverse Cholesky factors and log determinants."""

    log_prior: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    whitener: np.ndarray
    log_det: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        logs = []
        for k in range(2):
            away = ((x / self.scale) - self.mean[k]) @ self.whitener[k].T
            logs.append(self.log_prior[k] - 0.5 * ((away**2).sum(axis=1) + self.log_det[k]))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def _moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """For each label: rows, sum and sum of products of column features."""
    d = len(FEATURES)
    pairs = list(itertools.combinations_with_replacement(range(d), 2))
    x = rows.select("label", *[F.get("features", F.lit(i)).alias(f"x{i}") for i in range(d)])
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(d)]
    products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in pairs]
    found = {}
    for row in x.groupBy("label").agg(F.count("*").alias("n"), *sums, *products).collect():
        product = np.zeros((d, d))
        for i, j in pairs:
            product[i, j] = product[j, i] = row[f"p{i}_{j}"]
        found[row["label"]] = (float(row["n"]), np.array([row[f"s{i}"] for i in range(d)]), product)
    return found


def fit(rows: DataFrame, to_pooled: float = TO_POOLED, to_diagonal: float = TO_DIAGONAL) -> Discriminant:
    """Fit to rows (label 0 or 1, features).

    Each class counts as one row more than it has, so a class without rows takes
    the pooled density and its prior stays above 0; with no rows at all every score
    is one half.
    """
    d = len(FEATURES)
    moments = _moments(rows)
    n = np.array([moments[k][0] if k in moments else 0.0 for k in range(2)])
    mean, scatter = np.zeros((2, d)), np.zeros((2, d, d))
    for k, (count, total, product) in moments.items():
        mean[k] = total / count
        scatter[k] = product - np.outer(total, total) / count
    whole = (mean * n[:, None]).sum(axis=0) / max(1.0, n.sum())
    mean[n == 0] = whole
    pooled = scatter.sum(axis=0) / max(1.0, n.sum())
    between = ((mean - whole) ** 2 * n[:, None]).sum(axis=0) / max(1.0, n.sum())
    scale = np.sqrt(np.maximum(np.diag(pooled) + between, 1e-6))
    pooled = pooled / np.outer(scale, scale)
    whitener, log_det = np.zeros((2, d, d)), np.zeros(2)
    for k in range(2):
        own = scatter[k] / np.outer(scale, scale) / n[k] if n[k] else pooled
        shrunk = (1 - to_pooled) * own + to_pooled * pooled
        shrunk = (1 - to_diagonal) * shrunk + to_diagonal * np.diag(np.maximum(np.diag(pooled), 1e-2))
        factor = np.linalg.cholesky(shrunk + 1e-6 * np.eye(d))
        whitener[k] = np.linalg.inv(factor)
        log_det[k] = 2 * np.log(np.diag(factor)).sum()
    return Discriminant(np.log((n + 1) / (n.sum() + 2)), mean / scale, scale, whitener, log_det)


def fit_labelled(described: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """Fit to the rows of described (doc_id, features) that labels (doc_id, label) covers.

    Ids with contrary labels are left out; rows that repeat an id count each.
    """
    return fit(described.join(labels_of(labels, label), "doc_id"))


def score_of(described: Column, model: Discriminant) -> Column:
    """Score column (0 to 1, higher: class 1 likelier) of a column made by features_of."""

    @F.pandas_udf("double")
    def rows(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.score(np.stack(batch.to_numpy())) if len(batch) else [], dtype="float64")

    return rows(described)
