"""Number parsing and formatting as Column expressions.

Two parsers exist on purpose: parse_number() is strict and keeps blank, zero,
invalid and ambiguous apart; coerce_value() is the lenient one used for
classification, where ``1,234`` is the number 1.234.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from areal.functions import text

NUMBER_TYPE = "struct<kind:string,value:double,percent:boolean,format:string>"


# A rule is (condition, format name, decimal mark); the mark is None where the
# text is no number.
Rule = tuple[Column, str, str | None]


def _by_locale(c: Column, decimal: str, group: str, name: str) -> list[Rule]:
    """One decimal mark at most, groups of three."""
    d, g = f"[{decimal}]", f"[{group}]"
    return [
        (c.rlike(rf"\A(\d+|\d{{1,3}}({g}\d{{3}})+)({d}\d*)?\z"), name, decimal),
        (~c.rlike(r"\A[\d.,]+\z"), "not-numeric", None),
        (c.rlike(f"{d}.*{d}"), "too-many-decimals", None),
        (c.rlike(rf"\A(?!\d{{1,3}}({g}\d{{3}})+({d}|\z))[^{decimal}]*{g}"), "invalid-grouping", None),
        (c.rlike(f"{d}.*{g}"), "invalid-fraction", None),
        (F.lit(True), "not-numeric", None),
    ]


def _one_mark(c: Column, mark: str, name: str) -> list[Rule]:
    """Exactly one separator: decimal, unless three characters follow up to three digits."""
    return [
        (c.rlike(rf"(?s)\A\d{{1,3}}[{mark}].{{3}}\z"), "ambiguous-separator", None),
        (c.rlike(rf"\A\d+[{mark}]\d+\z"), name, mark),
        (F.lit(True), "not-numeric", None),
    ]


def _within(condition: Column, rules: list[Rule]) -> list[Rule]:
    return [(condition & extra, name, mark) for extra, name, mark in rules]


def _auto(c: Column) -> list[Rule]:
    """Without a locale the last of two different marks is the decimal one."""
    indonesian, american = _by_locale(c, ",", ".", "id-ID"), _by_locale(c, ".", ",", "en-US")
    return [
        (c.rlike(r"\A\d+\z"), "integer", "."),
        *_within(c.rlike(r"(?s)[.].*,[^.]*\z"), indonesian),
        *_within(c.rlike(r"(?s),.*[.][^,]*\z"), american),
        *_within(c.rlike(r"\A[^,]*,[^,]*\z"), _one_mark(c, ",", "decimal-comma")),
        *_within(c.contains(","), american[:2]),
        (c.contains(","), "too-many-decimals", None),
        *_within(c.rlike(r"\A[^.]*[.][^.]*\z"), _one_mark(c, ".", "decimal-dot")),
        *_within(c.contains("."), indonesian),
        (F.lit(True), "not-numeric", None),
    ]


def _result(kind, value, percent, name) -> Column:
    return F.struct(kind.alias("kind"), value.alias("value"), percent.alias("percent"), F.lit(name).alias("format"))


def parse_number(c, locale: str = "auto") -> Column:
    """Strict reading of a cell as struct<kind, value, percent, format>.

    kind is blank, number, percentage, ambiguous or invalid; only number and
    percentage carry a value. The cell without blanks and its digits are made once
    for all rules.
    """
    raw = text.text_of(c)
    cell = F.regexp_replace(raw, f"[{text.SPACE}]+", "")
    # (amount), -amount and amount% in one pass; brackets do not span lines.
    digits = F.regexp_replace(cell, r"(?s)\A(?:\(-?(.*?)%?\)|-?(.*?)%?)\z", "$1$2")
    broken = raw.contains("(") & raw.rlike(rf"(?s)\A[{text.SPACE}]*\(.*[\n\r\u2028\u2029].*\)[{text.SPACE}]*\z")
    parts = F.struct(cell.alias("cell"), digits.alias("digits"), broken.alias("broken"))
    return F.get(F.transform(F.array(parts), lambda p: _classified(p, locale)), F.lit(0))


def _classified(parts: Column, locale: str) -> Column:
    cell, digits = parts["cell"], parts["digits"]
    percent = cell.contains("%") & cell.rlike(r"(?s)\A\(.*%\)\z|%\z")
    negative = cell.rlike(r"(?s)\A(\((?!-).*\)|-.*)\z")
    nothing, no = F.lit(None).cast("double"), F.lit(False)

    def amount(mark: str) -> Column:
        plain = F.translate(digits, ",.", ".") if mark == "," else F.replace(digits, F.lit(","), F.lit(""))
        value = plain.try_cast("double")
        signed = F.when(negative, -value).otherwise(value)
        return F.when(percent, signed / 100).otherwise(signed) + F.lit(0.0)

    rules = {
        "id-ID": lambda: _by_locale(digits, ",", ".", "id-ID"),
        "en-US": lambda: _by_locale(digits, ".", ",", "en-US"),
    }.get(locale, lambda: _auto(digits))()
    parsed = (
        F.when(cell == "", _result(F.lit("blank"), nothing, no, "blank"))
        .when(cell.rlike(r"\A[=+@]"), _result(F.lit("invalid"), nothing, no, "formula-like"))
        .when(parts["broken"], _result(F.lit("invalid"), nothing, no, "not-numeric"))
    )
    for condition, name, mark in rules:
        if mark is not None:
            kind, value = F.when(percent, "percentage").otherwise("number"), amount(mark)
        else:
            kind, value = F.lit("ambiguous" if name == "ambiguous-separator" else "invalid"), nothing
        parsed = parsed.when(condition, _result(kind, value, percent, name))
    return parsed


_DECIMAL = r"\A([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\z"


def coerce_value(c) -> Column:
    """Lenient reading of a cell as double, NULL when it is not a finite number."""
    cell = F.regexp_replace(text.text_of(c), f"[{text.SPACE}]+", "")
    clean = F.regexp_replace(cell, r"%\z", "")
    plain = (
        F.when(clean.rlike(r"(?s)[.].*,[^.]*\z"), F.translate(clean, ",.", "."))
        .when(clean.rlike(r"(?s),.*[.][^,]*\z"), F.replace(clean, F.lit(","), F.lit("")))
        .otherwise(F.translate(clean, ",", "."))
    )

    def whole(prefix: str, digits: str, base: int) -> Column:
        found = F.nullif(F.regexp_extract(clean, rf"\A0[{prefix}]([{digits}]+)\z", 1), F.lit(""))
        return F.conv(found, base, 10).try_cast("double")

    number = (
        F.when(clean == "", F.lit(0.0))
        .when(clean.rlike(r"\A0[xXoObB]"), F.coalesce(whole("xX", "0-9a-fA-F", 16), whole("oO", "0-7", 8), whole("bB", "01", 2)))
        .otherwise(F.regexp_extract(plain, _DECIMAL, 1).try_cast("double"))
    )
    value = number / F.when(cell.endswith("%"), 100.0).otherwise(1.0) + F.lit(0.0)
    # Exponents beyond the double range read as infinite, hence as no number.
    readable = (cell != "") & ~cell.rlike(r"\A[=+@]|[eE][+]?0*[1-9]\d\d|\d{300}")
    return F.when(readable, value)


def format_number(c, fmt: str) -> Column:
    """Display text of a number: 'id-ID', 'en-US', 'integer' or 'decimal-2'."""
    value = (F.col(c) if isinstance(c, str) else c).cast("double")
    digits, pattern = {"integer": (0, "#,##0"), "decimal-2": (2, "#,##0.00")}.get(fmt, (3, "#,##0.###"))
    shown = F.call_function("format_number", F.round(value, digits), F.lit(pattern))
    if fmt == "id-ID":
        shown = F.translate(shown, ",.", ".,")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return F.when(finite, shown).otherwise("—")


def clamp_classes(c, low: int = 2, high: int = 7) -> Column:
    """Requested class count rounded half up and kept within bounds."""
    value = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    usable = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return F.when(usable, F.least(F.greatest(F.floor(value + 0.5), F.lit(low)), F.lit(high))).otherwise(low).cast("int")


def day_text(c) -> Column:
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd")
