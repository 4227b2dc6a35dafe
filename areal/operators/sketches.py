"""Quantile breaks from stored sketches: one mergeable KLL sketch per part, merged as parts come in.

A sketch of a part (a day, a source) is built once and kept; breaks over any set of
parts come from merging their sketches, without reading the values again. Exact
breaks read the values once to count and once where a break can lie: a merged sketch
brackets each wanted position, and only values within the brackets are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areal.operators.classify import quantile_positions
from areal.plans.sizing import values_at

#: Size of a sketch; its rank error falls with it.
SKETCH_K = 1024


def rank_error(k: int = SKETCH_K) -> float:
    """Share of the values by which the rank of a KLL quantile is off at most, in 99 of 100 cases."""
    return 2.296 / k**0.9021


def build(values: DataFrame, by: list[str], value: str, k: int = SKETCH_K) -> DataFrame:
    """(by, sketch) with one sketch per part; parts without a value have none. Map-side partial, so no part is gathered."""
    known = values.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return known.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))


def merge(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sketches of coarser parts, or of everything."""
    return sketches.groupBy(*(by or [])).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def _at(sketch: str, rank: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(min(1.0, max(0.0, rank))))


def breaks(sketches: DataFrame, classes: int) -> list[float]:
    """Approximate quantile breaks of all values in the sketches; none where there are no values."""
    if sketches.isEmpty():
        return []
    return list(merge(sketches).select(*[_at("sketch", i / classes) for i in range(1, classes)]).first())


def exact_breaks(values: DataFrame, value: str, sketches: DataFrame, classes: int, k: int = SKETCH_K) -> list[float]:
    """The breaks that nearest ranks give, exactly.

    sketches are those of the same values. A bracket that turns out not to hold its
    position is widened and counted again, so the result does not hang on the error.
    """
    known = values.select(F.col(value).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    whole = merge(sketches)
    n = 0 if sketches.isEmpty() else whole.select(F.kll_sketch_get_n_double("sketch")).first()[0]
    positions = quantile_positions(classes)(n) if n else []
    found: dict[int, float] = {}
    error = 2 * rank_error(k)
    while missing := [p for p in sorted(set(positions)) if p not in found]:
        ends = [_at("sketch", p / n + side * error) for p in missing for side in (-1, 1)]
        bounds = list(whole.select(*ends).first())
        # beyond the ends of the ranks a bracket is open
        lows = [None if p / n <= error else low for p, low in zip(missing, bounds[::2], strict=True)]
        highs = [None if p / n + error >= 1 else high for p, high in zip(missing, bounds[1::2], strict=True)]

        def below(low: float | None) -> Column:
            return F.lit(False) if low is None else F.col("v") < low

        def above(high: float | None) -> Column:
            return F.lit(False) if high is None else F.col("v") > high

        counts = known.agg(*[F.count_if(test) for low, high in zip(lows, highs, strict=True) for test in (below(low), above(high))]).first()
        for i, (p, low, high) in enumerate(zip(missing, lows, highs, strict=True)):
            before, after = counts[2 * i], counts[2 * i + 1]
            if before < p <= n - after:
                within = known.filter(~below(low) & ~above(high))
                found[p] = values_at(within, "v", lambda _, at=p - before: [at])[0]
        error *= 4
    return [found[p] for p in positions]
