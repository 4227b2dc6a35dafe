"""Personal data: generated candidate spans, scored by gradient-boosted trees.

Fixed rules find the base spans. Generators with high recall propose further,
overlapping spans (other separators, no leading plus, spelled-out signs). Boosted
trees score them by features of their format and context. Training needs no marked
texts: candidates equal to base spans are positive, candidates that break a hard
rule of their kind (check digits, ranges, stuck to other letters or digits) are
negative, and the variants in between are left out and only scored. A threshold
for each kind, calibrated on candidates kept out of training, selects the spans to
redact; base spans always stay.

The fit reads the candidates of all documents. Equal descriptions are counted, so
boosting works on distinct ones, spread over as many tasks as their number needs: each
level of a tree is one job that adds up gradients by node, feature and bin, and only
these sums reach the driver.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areal.plans.sizing import checkpoint

KINDS = ("email", "ip", "card", "phone")
TREES, DEPTH, RATE, BINS = 40, 3, 0.2, 16
#: Share of the selected candidates that must be right on those kept out, and the least threshold.
PRECISION, LEAST = 0.98, 0.8
#: Distinct descriptions for each task of boosting, which runs a job for each level of each tree.
TASK_ROWS = 20_000

Span = tuple[str, int, int]

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORTH = re.compile(r"[0-9@]|[(\[]at[)\]]")

GENERATORS = {
    "email": re.compile(
        r"(?<![\w.%+-])[\w.%+-]{1,64} ?(?:@|[(\[]at[)\]]) ?[\w-]{1,63}(?: ?(?:\.|[(\[]dot[)\]]) ?[\w-]{1,63}){1,8}"
    ),
    "ip": re.compile(r"(?<![0-9])[0-9]{1,3}(?: ?[.,] ?[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[ ./-]?[0-9]{2,7}){2,5}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9])(?:\(?\+|\()?[0-9][0-9 ()./-]{7,20}[0-9](?![0-9])"),
}
CUES = {
    "email": re.compile(r"mail|contact|write|kontakt|correo", re.I),
    "ip": re.compile(r"\bip\b|host|server|addr", re.I),
    "card": re.compile(r"card|visa|karte|carte|tarjeta|credit", re.I),
    "phone": re.compile(r"phone|call|tel|fax|mobil", re.I),
}


def luhn(digits: str) -> bool:
    """Whether the check digit of a row of digits is right."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(filter("0123456789".__contains__, text))


def _small_parts(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in parts)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses from each @: the signs before it as far as they go, a domain behind it. Linear in the text."""
    over, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > over and _local_sign(text[start - 1]):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            over = domain.end()
            yield start, over
        at = text.find("@", max(at + 1, over))


def _local_sign(sign: str) -> bool:
    return sign.isascii() and (sign.isalnum() or sign in "._%+-")


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed rules: leftmost without overlap for each kind, by start, then in the order of KINDS."""
    found: list[Span] = []
    if not WORTH.search(text):
        return found
    found += [("email", start, end) for start, end in _emails(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if _small_parts(m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37 and 14 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str) -> list[Span]:
    """Spans that the generators propose; those of different kinds may overlap."""
    if not WORTH.search(text):
        return []
    return [(kind, *m.span()) for kind, pattern in GENERATORS.items() for m in pattern.finditer(text)]


def broken(text: str, span: Span) -> bool:
    """Whether a candidate breaks a hard rule of its kind."""
    kind, start, end = span
    said, digits = text[start:end], _digits(text[start:end])
    stuck = text[start - 1 : start].isalnum() or text[end : end + 1].isalnum()
    if kind == "card":
        return stuck or not (14 <= len(digits) <= 19 and luhn(digits))
    if kind == "ip":
        return stuck or not _small_parts(re.findall("[0-9]+", said))
    if kind == "phone":
        return stuck or not 10 <= len(digits) <= 15
    return stuck or not re.search(r"[A-Za-z]{2}\Z", said)


def describe(text: str, span: Span) -> list[float]:
    """Features of a candidate's format and context."""
    kind, start, end = span
    said, digits = text[start:end], _digits(text[start:end])
    groups = [len(g) for g in re.findall("[0-9]+", said)] or [0]
    before, after = text[start - 1 : start], text[end : end + 1]
    return [
        *[float(kind == k) for k in KINDS],
        len(said),
        len(digits),
        sum(map(str.isalpha, said)),
        sum(not c.isalnum() for c in said),
        len({c for c in said if not c.isalnum()}),
        len(groups),
        min(groups),
        max(groups),
        float(bool(digits) and luhn(digits)),
        float(_small_parts(re.findall("[0-9]+", said))),
        float(said.count("(") == said.count(")")),
        float(before.isalnum()),
        float(after.isalnum()),
        float(not before or before.isspace()),
        float(not after or after.isspace() or after in ".,;:!?)"),
        float(bool(CUES[kind].search(text, max(0, start - 32), start))),
        float(sum(map(str.isdigit, text[max(0, start - 16) : start] + text[end : end + 16]))),
    ]


@dataclass(frozen=True)
class Trees:
    """Boosted trees of one depth: for each inner node a feature and a bound, for each leaf a value."""

    features: np.ndarray
    bounds: np.ndarray
    leaves: np.ndarray
    start: float
    thresholds: dict[str, float]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, bound, leaf in zip(self.features, self.bounds, self.leaves, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > bound[node])
            total += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def _described(docs: DataFrame) -> DataFrame:
    """(kept, kind, label, x, n): how many candidates of all docs have a description; kept ones are not trained on."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: Counter = Counter()
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                base = set(base_spans(text or ""))
                for span in candidates(text or ""):
                    if span in base or broken(text, span):
                        kept = zlib.crc32(repr((doc_id, *span)).encode()) % 3 == 0
                        out[kept, KINDS.index(span[0]), int(span in base), tuple(map(float, describe(text, span)))] += 1
            yield pd.DataFrame([(*key, n) for key, n in out.items()], columns=["kept", "kind", "label", "x", "n"])

    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    found = found.mapInPandas(rows, "kept boolean, kind int, label int, x array<double>, n long")
    return found.groupBy("kept", "kind", "label", "x").agg(F.sum("n").alias("n"))


def _cuts(described: DataFrame) -> list[np.ndarray]:
    """Bounds of the bins of each feature: exact quantiles. Features are flags and counts of signs of a candidate, whose
    length its pattern bounds, so the values of each are few."""
    counted = described.select("n", F.posexplode("x").alias("feature", "value")).groupBy("feature", "value").agg(F.sum("n").alias("n"))
    table = counted.toPandas().sort_values(["feature", "value"])
    cuts = []
    for _, part in table.groupby("feature"):
        values, ends = part["value"].to_numpy(), part["n"].to_numpy().cumsum()
        place = np.linspace(0, 1, BINS + 1)[1:-1] * (ends[-1] - 1)
        low = values[np.searchsorted(ends, np.floor(place), side="right")]
        high = values[np.searchsorted(ends, np.ceil(place), side="right")]
        cuts.append(np.unique(low + (high - low) * (place - np.floor(place))))
    return cuts


def _binned(described: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """Descriptions by the bins of their features, counted again; dealt evenly by their number, whatever the number of
    shuffle partitions, and in a fixed order within each task."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch["x"].to_numpy()) if len(batch) else np.zeros((0, len(cuts)))
            bins = np.stack([np.searchsorted(cut, x[:, f], side="left") for f, cut in enumerate(cuts)], axis=1)
            yield batch[["kept", "kind", "label", "n"]].assign(bins=[row.tobytes() for row in bins.astype(np.uint8)])

    coded = described.mapInPandas(rows, "kept boolean, kind int, label int, n long, bins binary")
    coded = checkpoint(coded.groupBy("kept", "kind", "label", "bins").agg(F.sum("n").alias("n")))
    tasks = max(1, math.ceil(coded.count() / TASK_ROWS))
    return checkpoint(coded.repartition(tasks).sortWithinPartitions("kept", "kind", "label", "bins"))


def _bins(batch: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(batch["bins"]), dtype=np.uint8).reshape(len(batch), -1).astype(np.int64)


def _walk(bins: np.ndarray, feature: np.ndarray, split: np.ndarray, levels: int = DEPTH) -> np.ndarray:
    """The node of each row some levels down in a tree."""
    node, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
    for _ in range(levels):
        node = 2 * node + 1 + (bins[rows, feature[node]] > split[node])
    return node


def _score(bins: np.ndarray, start: float, trees: list[tuple]) -> np.ndarray:
    total = np.full(len(bins), start)
    for feature, split, leaf in trees:
        total += leaf[_walk(bins, feature, split) - (2**DEPTH - 1)]
    return 1 / (1 + np.exp(-total))


def _gradients(trained: DataFrame, start: float, trees: list[tuple], tree: tuple, level: int, features: int) -> np.ndarray:
    """Sums of gradients and curvatures by node of a level of the growing tree, feature and bin."""
    shape = (2, 2**level, features, BINS + 1)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(shape)
        for batch in batches:
            if len(batch):
                bins, n = _bins(batch), batch["n"].to_numpy()
                p = _score(bins, start, trees)
                node = _walk(bins, *tree, level) - (2**level - 1)
                for f in range(features):
                    place = node * (BINS + 1) + bins[:, f]
                    for i, weight in enumerate((n * (batch["label"].to_numpy() - p), n * p * (1 - p))):
                        sums[i, :, f] += np.bincount(place, weight, 2**level * (BINS + 1)).reshape(2**level, -1)
        yield pd.DataFrame({"sums": [sums.tobytes()]})

    told = trained.select("label", "bins", "n").mapInPandas(rows, "sums binary").collect()
    return sum((np.frombuffer(r["sums"]).reshape(shape) for r in told), np.zeros(shape))


def _boost(trained: DataFrame, start: float, cuts: list[np.ndarray]) -> list[tuple]:
    """Boosting for the logistic loss; each node takes the bound with the largest second-order gain."""
    inner = 2**DEPTH - 1
    trees: list[tuple] = []
    for _ in range(TREES):
        # a node that is not split sends all its rows to the left
        feature, split = np.zeros(inner, dtype=np.int64), np.full(inner, BINS)
        leaf = np.zeros(inner + 1)
        for level in range(DEPTH):
            sums = _gradients(trained, start, trees, (feature, split), level, len(cuts)).cumsum(axis=-1)
            for k in range(2**level):
                node, best = 2**level - 1 + k, 1e-6
                for f, cut in enumerate(cuts):
                    (left_g, left_h), (all_g, all_h) = sums[:, k, f, : len(cut)], sums[:, k, f, -1]
                    gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
                    if len(gain) and gain.max() > best:
                        best = gain.max()
                        feature[node], split[node] = f, gain.argmax()
                if level == DEPTH - 1:
                    left, both = sums[:, k, feature[node], split[node]], sums[:, k, feature[node], -1]
                    for side, (g, h) in enumerate((left, both - left)):
                        leaf[2 * k + side] = RATE * g / (h + 1)
        trees.append((feature, split, leaf))
    return trees


def _thresholds(kept: DataFrame, start: float, trees: list[tuple]) -> dict[str, float]:
    """For each kind the least score from which on the candidates kept out are right often enough; above 1 if there is none."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"kind": batch["kind"], "score": _score(_bins(batch), start, trees), "n": batch["n"], "right": batch["n"] * batch["label"]})

    scored = kept.select("kind", "label", "bins", "n").mapInPandas(rows, "kind int, score double, n long, right long")
    scored = scored.groupBy("kind", "score").agg(F.sum("n").alias("n"), F.sum("right").alias("right"))
    best = Window.partitionBy("kind").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    good = scored.withColumn("share", F.sum("right").over(best) / F.sum("n").over(best)).filter(F.col("share") >= PRECISION)
    least = {KINDS[r["kind"]]: r["score"] for r in good.groupBy("kind").agg(F.min("score").alias("score")).collect()}
    return {kind: max(LEAST, least[kind]) if kind in least else 2.0 for kind in KINDS}


def fit(docs: DataFrame) -> Trees | None:
    """Fit to the candidates of all docs (doc_id, text); None where they have no candidates of both signs."""
    described = checkpoint(_described(docs))
    trained = described.filter("NOT kept")
    count, right = trained.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("label")), F.lit(0))).first()
    if right in (0, count):
        return None
    share = right / count
    start = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    cuts = _cuts(trained)
    coded = _binned(described, cuts)
    trees = _boost(coded.filter("NOT kept"), start, cuts)
    bound = lambda f, k: cuts[f][k] if k < len(cuts[f]) else np.inf
    return Trees(
        np.array([t[0] for t in trees]),
        np.array([[bound(f, k) for f, k in zip(*t[:2], strict=True)] for t in trees]),
        np.array([t[2] for t in trees]),
        start,
        _thresholds(coded.filter("kept"), start, trees),
    )


def select(text: str, trees: Trees | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: the base ones and the selected candidates, best first, that overlap none before."""
    base = base_spans(text)
    proposed = [s for s in candidates(text) if not _meets(s, base)] if trees else []
    if not proposed:
        return base, base
    score = trees.score(np.array([describe(text, s) for s in proposed]))
    spans = list(base)
    for i in np.argsort(-score, kind="stable"):
        kind = proposed[i][0]
        if score[i] >= trees.thresholds[kind] and not broken(text, proposed[i]) and not _meets(proposed[i], spans):
            spans.append(proposed[i])
    return base, sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def _meets(span: Span, others: list[Span]) -> bool:
    return any(span[1] < end and start < span[2] for _, start, end in others)


def spans_of(docs: DataFrame, trees: Trees | None, text: str = "text") -> Column:
    """Struct column (base, spans) of a text column of docs: arrays of (kind, start, end), in code points, end exclusive.

    Null and empty texts have no spans.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    span = "array<struct<kind:string,start:int,end:int>>"

    @F.pandas_udf(f"struct<base:{span},spans:{span}>")
    def rows(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [select(t, shared.value) for t in batch]
            told = [[[dict(zip(("kind", "start", "end"), s, strict=True)) for s in part] for part in f] for f in found]
            yield pd.DataFrame({"base": [t[0] for t in told], "spans": [t[1] for t in told]})

    return rows(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """Text with each span replaced by its kind in brackets; of overlapping spans the first one counts."""

    def step(done: Column, span: Column) -> Column:
        free = span["start"] >= done["at"]
        piece = F.concat(
            done["text"], F.substr(text, done["at"] + 1, span["start"] - done["at"]), F.lit("["), span["kind"], F.lit("]")
        )
        return F.struct(
            F.when(free, piece).otherwise(done["text"]).alias("text"),
            F.when(free, span["end"]).otherwise(done["at"]).alias("at"),
        )

    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    return F.aggregate(spans, start, step, lambda d: F.concat(d["text"], F.substr(text, d["at"] + 1)))
