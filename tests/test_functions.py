"""Scalar functions against literal cases and against Python's own Unicode tables."""

import random
import unicodedata

import pytest

from areal.functions import number, text


def values(spark, function, items):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, v string")
    return [r[0] for r in rows.select("i", function("v").alias("r")).orderBy("i").select("r").collect()]


@pytest.mark.parametrize(
    ("cell", "locale", "kind", "value"),
    [
        ("", "auto", "blank", None),
        ("0", "auto", "number", 0.0),
        ("1.234.567,89", "auto", "number", 1234567.89),
        ("1,234,567.89", "auto", "number", 1234567.89),
        ("12,5%", "auto", "percentage", 0.125),
        ("-3.2", "auto", "number", -3.2),
        ("(1234.50)", "en-US", "number", -1234.5),
        ("1,234", "auto", "ambiguous", None),
        ("abc", "auto", "invalid", None),
        ("=1+1", "auto", "invalid", None),
        ("(-5)", "auto", "number", 5.0),
        ("1,234", "id-ID", "number", 1.234),
        ("1,234", "en-US", "number", 1234.0),
        ("1.23.456", "auto", "invalid", None),
        ("12,", "id-ID", "number", 12.0),
        (" 1 234 ", "auto", "number", 1234.0),
    ],
)
def test_parse_number(spark, cell, locale, kind, value):
    parsed = values(spark, lambda c: number.parse_number(c, locale), [cell])[0]
    assert (parsed.kind, parsed.value) == (kind, value)


def test_coerce_value_follows_number_literals(spark):
    cells = ["1,234", "1e3", "0x10", "(5)", "%", "1.234,5", "1,234.5", "Infinity", "1e999", "", "12%", "=1", "+5", "0b101", "1.2.3"]
    expected = [1.234, 1000.0, 16.0, None, 0.0, 1234.5, 1234.5, None, None, None, 0.12, None, None, 5.0, None]
    assert values(spark, number.coerce_value, cells) == expected


def test_format_number(spark):
    rows = spark.createDataFrame([(1234567.8915,), (2.5,), (float("inf"),)], "v double")
    shown = rows.select(*[number.format_number("v", f).alias(f) for f in ("id-ID", "en-US", "integer", "decimal-2")]).collect()
    assert tuple(shown[0]) == ("1.234.567,892", "1,234,567.892", "1,234,568", "1,234,567.89")
    assert tuple(shown[1]) == ("2,5", "2.5", "3", "2.50")
    assert set(shown[2]) == {"—"}


def test_fold_matches_unicode_tables(spark):
    rng = random.Random(7)
    blocks = [(0x20, 0x24F), (0x1E00, 0x1EFF), (0x2100, 0x218F), (0xFB00, 0xFB06), (0xFF01, 0xFF5E), (0xAC00, 0xAFFF), (0x1D400, 0x1D7FF), (0x300, 0x36F)]
    samples = ["".join(chr(rng.randint(*rng.choice(blocks))) for _ in range(12)) for _ in range(300)]
    samples = [s for s in samples if unicodedata.normalize("NFC", s) or True]

    def expected(s):
        return "".join(c for c in unicodedata.normalize("NFKD", s) if not 0x300 <= ord(c) <= 0x36F)

    assert values(spark, text.fold_accents, samples) == [expected(s) for s in samples]


def test_name_keys(spark):
    assert values(spark, text.normalize_text, ["Kab. Bogor", "Kota Administrasi Jakarta Sélatan", "ﬁne City", "Ж kota"]) == [
        "BOGOR", "JAKARTA SELATAN", "FINE", "",
    ]
    assert values(spark, text.normalize_exact, ["Kab. Bogor"]) == ["KAB BOGOR"]
    assert values(spark, text.normalize_code, ["ID3578", "idn-3578", "35.78", "x1"]) == ["35.78", "35.78", "35.78", "X1"]
    assert values(spark, lambda c: text.normalize_code(c, "import"), ["ID3578", "id-3578"]) == ["35.78", "ID-3578"]


def test_escape_formula(spark):
    assert values(spark, text.escape_formula, ["=1+1", "+SUM(A1:A2)", "-2", "@cmd", "plain"]) == ["'=1+1", "'+SUM(A1:A2)", "'-2", "'@cmd", "plain"]


def test_hash_matches_a_plain_loop(spark):
    def fnv(s):
        h = 2166136261
        raw = s.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = ((h ^ (raw[i] << 8 | raw[i + 1])) * 16777619) & 0xFFFFFFFF
        digits = ""
        while h:
            h, d = divmod(h, 36)
            digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
        return digits.rjust(7, "0")

    samples = ["", "a", "row|2|x", "é한😀", "x" * 5000]
    assert values(spark, text.fnv1a36, samples) == [fnv(s) for s in samples]
