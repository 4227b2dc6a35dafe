"""Toxicity: class-conditional Kneser-Ney models of words.

One model is counted on toxic and one on ordinary labelled texts. A text's score
compares its length-normalised log-likelihoods under both. The models back off in
a tree: pair of words, word, its first six, five and four letters, nothing. A
child's probability is its discounted count in the class plus the class's backoff
weight times a share that both classes have in common: in how many contexts the
child was met, in either class. An expression whose counts in the classes differ
no more than chance does, given its parent, or by little, is too rare to judge and takes its
parent's ratio, so rare forms of a word are as toxic as its stem. A logistic
curve, fitted on labelled texts that the models did not count, maps the mean
log-likelihood ratio to 0..1.

The models are fitted on at most MAX_ROWS labelled texts of each class, those with
the smallest hashes of their ids; the counting of their words runs in Spark, and
the driver gets the expressions of at least MIN_COUNT occurrences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areal.llm.common import fold, labels_of, portions
from areal.plans.sizing import checkpoint

#: Bound on the labelled texts of a class that the fit reads.
MAX_ROWS = 4000
MIN_COUNT = 5
DISCOUNT = 0.75
#: Deviations from the parent's ratio by which an expression stands on its own.
SURE = 4.0
#: Least change of the log ratio for that: topics and languages differ a little between the classes everywhere.
STEEP = 1.0
#: Letters of the stems a word backs off to, the longest first.
STEMS = (6, 5, 4)
LEVELS = ("word", *(f"stem{n}" for n in STEMS))
#: Every so many-th labelled text, by crc32 of its id, fits the logistic curve.
CURVE_FOLDS = 4
WORD = re.compile(r"\w+")
#: Context of the first word of a text.
START = 0


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of whole texts, in lower case.

    Returns for each word its place among the distinct words, for each text its
    number of words, and for each distinct word the hashes of its LEVELS. A null
    text counts as empty.
    """
    lists = [WORD.findall(t.lower()) if t else [] for t in texts]
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    flat = np.array([w for words in lists for w in words], dtype=object)
    if not len(flat):
        return np.zeros(0, dtype=np.int64), sizes, np.zeros((0, len(LEVELS)), dtype=np.int64)
    places, distinct = pd.factorize(flat)
    levels = [_hashes(distinct), *(_hashes(np.array([w[:n] for w in distinct], dtype=object)) ^ n for n in STEMS)]
    return places, sizes, np.column_stack(levels)


def _hashes(words: np.ndarray) -> np.ndarray:
    return pd.util.hash_array(words, categorize=False).view(np.int64)


def _before(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The value before each one in its text, START for the first."""
    before = np.empty_like(values)
    before[1:] = values[:-1]
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = START
    return before


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One hash for two, order kept."""
    return (first.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ second.view(np.uint64)).view(np.int64)


def sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, text, label) of at most max_rows labelled ids of each class, the smallest by hash."""
    labelled = labels_of(labels, label)
    chosen = [
        labelled.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for k in (0, 1)
    ]
    # at most 2 * max_rows ids
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))
    return docs.select("doc_id", "text").join(ids, "doc_id")


def count_pairs(texts: DataFrame) -> DataFrame:
    """Occurrences (toxic, ordinary) of each word after each other, with the word's stems."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, labels = batch["text"].to_pylist(), np.asarray(batch["label"], dtype=np.int64)
            for part in portions(texts):
                places, sizes, levels = words_of(texts[part])
                words = levels[places]
                columns = {"before": _before(words[:, 0], sizes), "label": np.repeat(labels[part], sizes)}
                columns |= {name: words[:, i] for i, name in enumerate(LEVELS)}
                frame = pd.DataFrame(columns).groupby(list(columns), as_index=False).size()
                yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    names = ["before", "label", *LEVELS, "size"]
    counted = texts.select("text", "label").mapInArrow(count, ", ".join(f"{n} long" for n in names))
    of = lambda k: F.sum(F.when(F.col("label") == k, F.col("size")).otherwise(0))
    return counted.groupBy("before", *LEVELS).agg(of(1).alias("toxic"), of(0).alias("ordinary"))


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratios (toxic over ordinary) of words, stems and pairs that stand on their own, and the curve."""

    units: np.ndarray
    unit_ratio: np.ndarray
    pairs: np.ndarray
    pair_ratio: np.ndarray
    curve: np.ndarray

    def compare(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean log-likelihood ratio and number of words of each text; 0 for texts without words."""
        found = [self._compare(texts[part]) for part in portions(texts)] or [self._compare([])]
        ratio, words = zip(*found, strict=True)
        return np.concatenate(ratio), np.concatenate(words)

    def _compare(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        places, sizes, levels = words_of(texts)
        if not len(places):
            return np.zeros(len(sizes)), sizes
        of_word = np.zeros(len(levels))
        for level in reversed(range(len(LEVELS))):
            known, ratio = _look_up(self.units, self.unit_ratio, levels[:, level])
            of_word[known] = ratio
        ratios = of_word[places]
        words = levels[places, 0]
        known, ratio = _look_up(self.pairs, self.pair_ratio, _pair(_before(words, sizes), words))
        ratios[known] = ratio
        totals = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=ratios, minlength=len(sizes))
        return totals / np.maximum(sizes, 1), sizes

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_inputs(*self.compare(texts)) @ self.curve, -700, 700)))


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the wanted are among the ordered keys, and their values."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=bool), np.zeros(0)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    known = keys[at] == wanted
    return known, values[at[known]]


def _inputs(ratio: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Inputs of the curve: the mean ratio, the same weighed by how sure its length makes it, and the length."""
    return np.column_stack([np.ones(len(sizes)), ratio * 10, ratio * np.sqrt(sizes), np.log1p(sizes) / 5])


def _fit_curve(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's steps, slightly drawn to 0; both classes weigh the same."""
    weight = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum())) * len(label)
    curve = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        gradient = x.T @ (weight * (p - label)) + 1e-2 * curve
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(curve)), gradient)
        curve = curve - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return curve


def _stand(
    child: pd.DataFrame, parent: pd.DataFrame, above: np.ndarray, log_odds: float
) -> tuple[np.ndarray, np.ndarray]:
    """Which children stand on their own, and the ratio of every child.

    child and parent: toxic, ordinary, contexts (both classes), and of the parent
    toxic_kinds, ordinary_kinds (children met in the class), row by row. above:
    the parent's ratio.
    """
    seen = child["toxic"] + child["ordinary"]
    expected = 1 / (1 + np.exp(-(log_odds + above)))
    away = (child["toxic"] - seen * expected) / np.sqrt(seen * expected * (1 - expected) + 1e-9)
    shared = child["contexts"] / parent["contexts"]
    logs = []
    for name in ("toxic", "ordinary"):
        n = np.maximum(parent[name], 1)
        back = np.where(parent[name] > 0, DISCOUNT * parent[f"{name}_kinds"] / n, 1.0)
        logs.append(np.log(np.maximum(child[name] - DISCOUNT, 0) / n + np.minimum(back, 1.0) * shared))
    own_ratio = (logs[0] - logs[1]).to_numpy()
    alone = (np.abs(away) >= SURE).to_numpy() & (np.abs(own_ratio) >= STEEP)
    return alone, np.where(alone, above + own_ratio, above)


def _ratios(counted: DataFrame) -> Model:
    """Kneser-Ney ratios from counts of pairs; without words of both classes the model is empty."""
    sums = [F.sum(c).alias(c) for c in ("toxic", "ordinary", "contexts")]
    kinds = [F.sum((F.col(c) > 0).cast("long")).alias(f"{c}_kinds") for c in ("toxic", "ordinary")]
    pairs = counted.withColumn("contexts", F.lit(1))
    tables = [pairs]
    for i in range(len(LEVELS)):
        tables.append(tables[-1].groupBy(*LEVELS[i:]).agg(*sums, *kinds))
    root = tables[-1].agg(*sums, *kinds).toPandas().fillna(0)
    none = np.zeros(0)
    if not (root["toxic"] * root["ordinary"]).any():
        return Model(none.astype(np.int64), none, none.astype(np.int64), none, np.zeros(4))
    log_odds = float(np.log(root["toxic"] / root["ordinary"]).iloc[0])
    often = F.col("toxic") + F.col("ordinary") >= MIN_COUNT
    units, ratios = [], []
    parent, above, parents = None, None, None
    for level in reversed(range(len(LEVELS))):
        child = tables[level + 1].filter(often).toPandas()
        if parents is None:
            at, before = np.zeros(len(child), dtype=np.int64), np.zeros(len(child))
            over = root
        else:
            at = parents.get_indexer(child[LEVELS[level + 1]])
            before, over = above[at], parent
        alone, above = _stand(child, over.iloc[at].reset_index(drop=True), before, log_odds)
        units.append(child[LEVELS[level]].to_numpy()[alone])
        ratios.append(above[alone])
        parent, parents = child, pd.Index(child[LEVELS[level]])
    # a pair backs off to its word: its context is the parent, its ratio that of the word
    met = pairs.groupBy("before").agg(*sums, *kinds).filter(often & (F.col("before") != START)).toPandas()
    found = pairs.filter(often & (F.col("before") != START)).select("before", "word", "toxic", "ordinary").toPandas()
    word = parents.get_indexer(found["word"])
    found["contexts"] = parent["contexts"].to_numpy()[word]
    context = met.iloc[pd.Index(met["before"]).get_indexer(found["before"])].reset_index(drop=True)
    alone, ratio = _pairs_stand(found, context, above[word], log_odds, float(root["contexts"].iloc[0]))
    keys, all_units = _pair(found["before"].to_numpy()[alone], found["word"].to_numpy()[alone]), np.concatenate(units)
    order, pair_order = np.argsort(all_units), np.argsort(keys)
    return Model(
        all_units[order], np.concatenate(ratios)[order], keys[pair_order], ratio[alone][pair_order], np.zeros(4)
    )


def _pairs_stand(
    pair: pd.DataFrame, context: pd.DataFrame, above: np.ndarray, log_odds: float, contexts: float
) -> tuple[np.ndarray, np.ndarray]:
    """As _stand, for a pair: its backoff share is that of its word among all words, times the word's ratio."""
    sure, _ = _stand(pair, context.assign(contexts=contexts), above, log_odds)
    logs = []
    for name, tilt in (("toxic", above / 2), ("ordinary", -above / 2)):
        n = np.maximum(context[name], 1)
        back = np.minimum(np.where(context[name] > 0, DISCOUNT * context[f"{name}_kinds"] / n, 1.0), 1.0)
        own = np.maximum(pair[name] - DISCOUNT, 0) / n
        logs.append(np.log(own + back * pair["contexts"] / contexts * np.exp(tilt)))
    ratio = (logs[0] - logs[1]).to_numpy()
    return sure & (np.abs(ratio - above) >= STEEP), ratio


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """Fit to the texts of docs (doc_id, text) that labels (doc_id, label) covers.

    Ids with contrary labels are left out. Without texts of both classes, every
    score is one half.
    """
    rows = checkpoint(sample(docs, labels, label, max_rows))
    for_curve = fold(F.col("doc_id"), CURVE_FOLDS * 5) < 5
    model = _ratios(checkpoint(count_pairs(rows.filter(~for_curve))))
    described = rows.filter(for_curve).select("label", _compare(F.col("text"), model).alias("found"))
    held = described.select("label", "found.ratio", "found.words").toPandas()
    if held["label"].nunique() < 2:
        return model
    x = _inputs(held["ratio"].to_numpy(), held["words"].to_numpy())
    curve = _fit_curve(x, held["label"].to_numpy())
    return Model(model.units, model.unit_ratio, model.pairs, model.pair_ratio, curve)


def _compare(text: Column, model: Model) -> Column:
    @F.pandas_udf("ratio double, words long")
    def rows(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ratio, words = model.compare(batch.tolist())
            yield pd.DataFrame({"ratio": ratio, "words": words})

    return rows(text)


def score_of(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """Score column (0 to 1, higher: toxic likelier) of a text column of docs.

    A null or empty text has ratio 0 and no words. The model is broadcast: at most
    2 * max_rows texts were counted for it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rows(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(shared.value.score(batch.tolist()), dtype="float64")

    return rows(F.col(f"`{text}`"))
