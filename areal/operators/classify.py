"""Map classes: categorical, equal interval, quantile, manual and diverging.

Breaks are a handful of numbers computed by aggregates; the rows are then
classified by comparison with literals, in one narrow pass.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areal.functions import number, text
from areal.operators.match import usable
from areal.plans.sizing import literal_table, lookup_join, ranked, values_at

# Palettes by family; the first one of a family is its default.
PALETTES = {
    "qualitative": {
        "safe-default": ["#0072B2", "#E69F00", "#009E73", "#CC79A7", "#56B4E9", "#D55E00", "#F0E442", "#332288", "#88CCEE", "#44AA99", "#DDCC77", "#AA4499"],
        "office": ["#4472C4", "#ED7D31", "#A5A5A5", "#FFC000", "#5B9BD5", "#70AD47", "#264478", "#9E480E", "#636363", "#997300", "#255E91", "#43682B"],
        "coastal": ["#174A5B", "#2B7A78", "#4CA6A8", "#8BC6C5", "#E1B44B", "#D97A43", "#35627A", "#6D9F9C", "#B5D8D1", "#F0D58A", "#A8533D", "#6C7C86"],
        "earth": ["#486B42", "#7D8C3E", "#C39B3A", "#B8643B", "#7B4D37", "#D8C59D", "#315F54", "#89926A", "#D7B56D", "#925448", "#59483D", "#B0A88E"],
    },
    "sequential": {
        "blue": ["#F0F7FF", "#C6DBEF", "#9ECAE1", "#6BAED6", "#3182BD", "#08519C", "#08306B"],
        "teal": ["#E8F5F3", "#C4E6E1", "#95D2CA", "#5CB8AE", "#259A90", "#087F73", "#045A53"],
        "green": ["#EFF7EC", "#D5EBCB", "#AED99F", "#7FC56F", "#55AD4B", "#318A32", "#1C6423"],
        "purple": ["#F4F0F8", "#DED3EB", "#C2AED9", "#A183C2", "#805EAA", "#66428E", "#472B68"],
        "amber": ["#FFF7E6", "#FDE7B1", "#F5CF75", "#EAB348", "#D99525", "#B97612", "#8A5409"],
    },
    "diverging": {
        "blue-orange": ["#2166AC", "#67A9CF", "#D1E5F0", "#F7F7F7", "#FDDBC7", "#EF8A62", "#B2182B"],
        "teal-rose": ["#006D77", "#5BA8A8", "#B9D8D5", "#F7F7F4", "#E8BBC7", "#CF7290", "#9B2F5D"],
        "purple-green": ["#5B2A86", "#9575B5", "#CEC0DC", "#F7F7F4", "#C6D8B6", "#82AD67", "#3F7D3A"],
    },
}
FAMILIES = {"categorical": "qualitative", "diverging": "diverging"}
METHODS = ["categorical", "equal-interval", "quantile", "manual", "diverging"]
NO_CATEGORY = "TANPA KATEGORI"  # fixed value: key of the blank category
NO_DATA_COLOR = "#D9E0E6"  # fixed value
# Places taken from a seven-colour ramp, so the middle colour stays the middle.
CENTRED = {3: [0, 3, 6], 5: [0, 1, 3, 5, 6], 7: [0, 1, 2, 3, 4, 5, 6]}

WARNINGS = {
    "many-categories": "More categories than palette colours; further colours were derived.",
    "no-values": "No numeric value can be classified.",
    "one-value": "All values are equal, so there is one class.",
    "fewer-classes": "Equal values stay together, which leaves fewer classes.",
    "one-sided": "All values lie on one side of the centre.",
    "no-data": "Rows without a usable value or region have no class.",
}


@dataclass
class Classified:
    """assignments: region_id, row_id, class_key, color; class_legend: position,
    key, label, color. What depends on the rows left over (no_data, legend,
    warnings) is planned only when asked for."""

    rows: DataFrame
    assignments: DataFrame
    class_legend: DataFrame
    found: dict[str, DataFrame | None]
    breaks: list[float] = field(default_factory=list)
    no_data_color: str = NO_DATA_COLOR

    @cached_property
    def no_data(self) -> DataFrame:
        """Rows whose region got no class, blank and unmatched rows among them."""
        return lookup_join(self.rows, self.assignments.select("region_id"), ["region_id"], "left_anti", spread=["row_id"])

    @cached_property
    def _missing(self) -> DataFrame:
        return self.no_data.agg(F.count("*").alias("rows")).filter("rows > 0")

    @property
    def legend(self) -> DataFrame:
        """Legend entries; the no-data entry comes last and only if it has rows."""
        entry = self._missing.select(
            F.lit(2_000_000_000).alias("position"),
            F.lit("no-data").alias("key"),
            F.lit("No data").alias("label"),
            F.lit(self.no_data_color).alias("color"),
        )
        return self.class_legend.unionByName(entry)

    @property
    def warnings(self) -> DataFrame:
        """(code, rows, message)"""
        return _warnings(self.rows.sparkSession, {**self.found, "no-data": self._missing})


def palette(method: str, name: str | None = None, reverse: bool = False) -> list[str]:
    choices = PALETTES[FAMILIES.get(method, "sequential")]
    colors = choices.get(name or "", next(iter(choices.values())))
    return colors[::-1] if reverse else list(colors)


def palette_table(spark) -> DataFrame:
    rows = [
        (family, name, position, color)
        for family, names in PALETTES.items()
        for name, colors in names.items()
        for position, color in enumerate(colors)
    ]
    return literal_table(spark, ["family", "palette", "position", "color"], rows)


def clamp(classes, low: int = 2, high: int = 7) -> int:
    value = float(classes) if classes is not None else math.nan
    return min(high, max(low, math.floor(value + 0.5))) if math.isfinite(value) else low


def first_class(value: Column, breaks: list[float]) -> Column:
    """Index of the first upper bound that is not below the value (right-closed classes)."""
    index = None
    for i, upper in enumerate(breaks):
        index = F.when(value <= upper, i) if index is None else index.when(value <= upper, i)
    return F.lit(0) if index is None else index.otherwise(len(breaks))


def _colored(index: Column, colors: list[str]) -> Column:
    return F.element_at(F.lit(colors), index + 1)


def _last_per_region(rows: DataFrame, order: Column) -> DataFrame:
    """One row per region: the last of the given order."""
    return (
        rows.groupBy("region_id")
        .agg(F.max_by(F.struct("row_id", "class_key", "color"), order).alias("last"))
        .select("region_id", "last.row_id", "last.class_key", "last.color")
    )


def _legend(spark, entries: list[tuple], fmt: str) -> DataFrame:
    """Entries (key, low, high, kind, color) with their label text."""
    rows = [(i, key, low, high, kind, color) for i, (key, low, high, kind, color) in enumerate(entries)]
    columns = ["position", "key", "low", "high", "kind", "color"]
    if not rows:
        return literal_table(spark, columns, [(0, "", 0.0, 0.0, "", "")]).filter("false").select(
            "position", "key", F.lit("").alias("label"), "color"
        )
    low, high = number.format_number(F.col("low"), fmt), number.format_number(F.col("high"), fmt)
    label = (
        F.when(F.col("kind") == "upto", F.concat(F.lit("≤ "), high))
        .when(F.col("kind") == "above", F.concat(F.lit("> "), low))
        .when(F.col("kind") == "equal", F.concat(F.lit("= "), low))
        .when(F.col("kind") == "value", low)
        .otherwise(F.concat(low, F.lit("–"), high))
    )
    return literal_table(spark, columns, rows).select("position", "key", label.alias("label"), "color")


def _open_ended(breaks: list[float], colors: list[str]) -> list[tuple]:
    """≤ first, ranges between, > last."""
    uppers = [*breaks, math.inf]
    entries = []
    for i, upper in enumerate(uppers):
        kind = "upto" if i == 0 else "above" if upper == math.inf else "between"
        entries.append((str(i), breaks[i - 1] if i else math.nan, upper, kind, colors[i % len(colors)]))
    return entries


def quantile_positions(classes: int):
    return lambda n: [min(n, math.ceil(i * n / classes)) for i in range(1, classes)]


def merged(values: list[float]) -> list[float]:
    """Successive equal breaks become one."""
    return [v for i, v in enumerate(values) if i == 0 or v != values[i - 1]]


def parse_breaks(breaks) -> list[float]:
    parts = re.split(r"[;,\s]+", breaks) if isinstance(breaks, str) else breaks
    values = [float(p) for p in parts if p != ""]
    rising = all(b > a for a, b in zip(values, values[1:], strict=False))
    if not values or not rising or not all(map(math.isfinite, values)):
        raise ValueError("manual breaks must be finite numbers in rising order")
    return values


def _categorical(rows: DataFrame, colors: list[str]):
    keyed = rows.withColumn("class_key", F.coalesce(F.nullif(text.normalize_category("category"), F.lit("")), F.lit(NO_CATEGORY)))
    keys = ranked(keyed.select("class_key").distinct(), "class_key", "position", "id")
    hue = F.concat(F.lit("hsl("), ((F.col("position") * F.lit(137.508)) % 360).cast("string"), F.lit(" 58% 45%)"))
    colored = keys.withColumn(
        "color", F.when(F.col("position") < len(colors), _colored(F.col("position") % len(colors), colors)).otherwise(hue)
    )
    classed = lookup_join(keyed, colored, ["class_key"], "inner", spread=["row_id"])
    label = F.when(F.col("class_key") == NO_CATEGORY, "No category").otherwise(F.col("class_key"))
    legend = colored.select(F.col("position").cast("int"), F.col("class_key").alias("key"), label.alias("label"), "color")
    many = legend.agg(F.count("*").alias("rows")).filter(F.col("rows") > len(colors))
    return _last_per_region(classed, F.struct("row_number", "row_id")), legend, many


def classify(
    rows: DataFrame,
    method: str = "categorical",
    classes: int | None = 5,
    palette_name: str | None = None,
    reverse: bool = False,
    breaks=None,
    center: float = 0.0,
    number_format: str = "id-ID",
    no_data_color: str = NO_DATA_COLOR,
    compat: bool = False,
) -> Classified:
    """Classify matched rows (row_id, row_number, region_id, status, numeric_value, category).

    compat=True keeps three oddities of the reference: an omitted class count
    means two (three for diverging); diverging takes the first colours of the
    ramp, so fewer than seven classes have no neutral centre; and the classes
    below the centre are numbered from the nearest while the legend numbers them
    from the farthest. By default the count is five, the ramp stays centred and
    below-0 is the farthest class in both.
    """
    method = method if method in METHODS else "categorical"
    spark = rows.sparkSession
    if classes is None and not compat:
        classes = 5
    colors = palette(method, palette_name, reverse)
    fit = usable(rows)
    found: dict[str, DataFrame | None] = {}
    if method == "categorical":
        assignments, legend, many = _categorical(fit, colors)
        found["many-categories"] = many
        cuts: list[float] = []
    else:
        valued = fit.select("row_id", "row_number", "region_id", number.coerce_value("numeric_value").alias("value")).filter(
            "value IS NOT NULL"
        )
        plan = {"equal-interval": _equal_interval, "quantile": _quantile, "manual": _manual, "diverging": _diverging}[method]
        options = {"classes": classes, "breaks": breaks, "center": float(center), "compat": compat}
        index, key, ramp, entries, codes, cuts = plan(valued, colors, options)
        classed = valued.withColumn("_index", index).select(
            "row_id", "row_number", "region_id", "value", key(F.col("_index")).alias("class_key"), ramp(F.col("_index")).alias("color")
        )
        order = ["row_number", "row_id"] if method == "diverging" else ["value", "row_id"]
        assignments = _last_per_region(classed, F.struct(*order))
        legend = _legend(spark, entries, number_format)
        found.update(dict.fromkeys(codes))
    return Classified(rows, assignments, legend, found, cuts, no_data_color)


def _warnings(spark, found: dict[str, DataFrame | None]) -> DataFrame:
    """Warnings with a row count where one is known."""
    parts = []
    for code, rows in found.items():
        counted = spark.range(1).select(F.lit(None).cast("bigint").alias("rows")) if rows is None else rows.select("rows")
        parts.append(counted.select(F.lit(code).alias("code"), "rows", F.lit(WARNINGS[code]).alias("message")))
    return reduce(DataFrame.unionByName, parts)


def _text_key(index: Column) -> Column:
    return index.cast("string")


def _equal_interval(valued: DataFrame, colors: list[str], options: dict):
    low, high = valued.agg(F.min("value"), F.max("value")).first()
    if low is None:
        return F.lit(0), _text_key, lambda i: F.lit(colors[0]), [], ["no-values"], []
    if low == high:
        return F.lit(0), _text_key, lambda i: F.lit(colors[0]), [("0", low, high, "value", colors[0])], ["one-value"], []
    k = clamp(options["classes"])
    step = (high - low) / k
    uppers = [low + step * (i + 1) for i in range(k - 1)] + [high]
    ramp = colors[:k]
    entries = [
        (str(i), low if i == 0 else uppers[i - 1], upper, "between", ramp[i % len(ramp)]) for i, upper in enumerate(uppers)
    ]
    return first_class(F.col("value"), uppers[:-1]), _text_key, lambda i: _colored(i % len(ramp), ramp), entries, [], uppers


def _quantile(valued: DataFrame, colors: list[str], options: dict):
    k = clamp(options["classes"])
    ramp = colors[:k]
    cuts = merged(values_at(valued, "value", quantile_positions(k)))
    if not cuts:
        return F.lit(0), _text_key, lambda i: F.lit(colors[0]), [], ["no-values"], []
    codes = ["fewer-classes"] if len(cuts) + 1 < k else []
    last = len(ramp) - 1
    return first_class(F.col("value"), cuts), _text_key, lambda i: _colored(F.least(i, F.lit(last)), ramp), _open_ended(cuts, ramp), codes, cuts


def _manual(valued: DataFrame, colors: list[str], options: dict):
    cuts = parse_breaks(options["breaks"])
    if valued.isEmpty():
        return F.lit(0), _text_key, lambda i: F.lit(colors[0]), [], ["no-values"], cuts
    return first_class(F.col("value"), cuts), _text_key, lambda i: _colored(i % len(colors), colors), _open_ended(cuts, colors), [], cuts


def _diverging(valued: DataFrame, colors: list[str], options: dict):
    center, compat = options["center"], options["compat"]
    k = max(3, clamp(options["classes"]))
    k += 1 - k % 2
    side = k // 2
    ramp = colors[:k] if compat else [colors[i] for i in CENTRED[k]]
    value = F.col("value")
    below, above = valued.agg(F.max(F.when(value < center, center - value)), F.max(F.when(value > center, value - center))).first()
    codes = [] if below and above else ["one-sided"]
    below, above = below or 0.0, above or 0.0

    def near(distance: Column, most: float) -> Column:
        if not most:
            return F.lit(0)
        return F.least(F.lit(side - 1), F.floor(distance / F.lit(most) * side)).cast("int")

    down = near(center - value, below)
    index = (
        F.when(value == center, side)
        .when(value < center, down if compat else F.lit(side - 1) - down)
        .otherwise(F.lit(side + 1) + near(value - center, above))
    )

    def key(i: Column) -> Column:
        return (
            F.when(i < side, F.concat(F.lit("below-"), i.cast("string")))
            .when(i == side, "center")
            .otherwise(F.concat(F.lit("above-"), (i - side - 1).cast("string")))
        )

    entries = [(f"below-{i}", math.nan, center - below * (side - i) / side, "upto", ramp[i]) for i in range(side)]
    entries.append(("center", center, center, "equal", ramp[side]))
    entries += [(f"above-{i}", center + above * i / side, math.inf, "above", ramp[side + 1 + i]) for i in range(side)]
    return index, key, lambda i: _colored(i, ramp), entries, codes, []


def overlay(manual: DataFrame, assignments: DataFrame, rows: DataFrame) -> DataFrame:
    """Highlights (region_id, color, category, value): classes of the rows over manual colours.

    Category and value come from the last row of a region.
    """
    last = rows.filter("region_id IS NOT NULL").groupBy("region_id").agg(
        F.max_by(F.struct("category", "numeric_value"), F.struct("row_number", "row_id")).alias("_row")
    )
    # Both sides have one row per region, so no key repeats.
    classed = assignments.join(last, "region_id").select(
        "region_id", F.struct("color", text.text_of("_row.category").alias("category"), text.text_of("_row.numeric_value").alias("value")).alias("_new")
    )
    base = manual.select("region_id", F.struct("color", "category", "value").alias("_old"))
    return base.join(classed, "region_id", "full_outer").select("region_id", F.inline(F.array(F.coalesce("_new", "_old"))))
