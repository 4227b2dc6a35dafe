"""Text functions as Column expressions (all JVM-side, no Python workers).

Every function takes a Column (or column name) and returns a Column, so it can
be used in batch and streaming DataFrames alike.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the reference's string functions see it (Java's \s and Spark's
# trim() know fewer characters).
SPACE = r"\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

# No character beyond this one decomposes (CJK compatibility ideographs end here).
LAST_DECOMPOSING = 0x2FA1D

# ASCII word edges: Java's \b also counts accented letters.
_WORD_START = r"(?<![A-Za-z0-9_])"
_WORD_END = r"(?![A-Za-z0-9_])"

# Administrative type words dropped from region names.
TYPE_WORDS = {
    "import": ["KABUPATEN", "KAB", "KOTA", "CITY", "REGENCY"],
    "match": ["KABUPATEN", "KAB", "KOTA ADMINISTRASI", "KOTA", "CITY", "REGENCY"],
}
# Words dropped from province names.
PROVINCE_WORDS = ["daerah", "provinsi", "province"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_of(c) -> Column:
    """The value as text, with NULL read as the empty string."""
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def trim(c) -> Column:
    return F.regexp_replace(text_of(c), f"^[{SPACE}]+|[{SPACE}]+$", "")


def squeeze(c) -> Column:
    """Runs of white space become one blank; no blank at either end."""
    return F.trim(F.regexp_replace(text_of(c), f"[{SPACE}]+", " "))


@lru_cache(maxsize=2)
def _fold_tables(ascii_only: bool) -> tuple[str, str, dict[str, str]]:
    """Compatibility decomposition as lookup data, derived from Unicode itself.

    Returns (characters replaced by at most one character, the replacements,
    characters replaced by several). Combining marks U+0300-U+036F stand at the
    end of the first string without a replacement, so translate() deletes them.
    ascii_only leaves out characters that decompose to no ASCII letter or digit.
    """
    single_from, single_to, several = [], [], {}
    for code in range(0x80, LAST_DECOMPOSING + 1):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF or 0x300 <= code <= 0x36F:
            continue
        ch = chr(code)
        plain = "".join(m for m in unicodedata.normalize("NFKD", ch) if not 0x300 <= ord(m) <= 0x36F)
        useful = any(m.isascii() and m.isalnum() for m in plain.upper() + plain.lower())
        if plain == ch or (ascii_only and not useful):
            continue
        if len(plain) == 1:
            single_from.append(ch)
            single_to.append(plain)
        else:
            several[ch] = plain
    marks = "".join(chr(code) for code in range(0x300, 0x370))
    return "".join(single_from) + marks, "".join(single_to), several


def _hangul_parts(ch: Column) -> Column:
    """A Hangul syllable as its two or three letters (arithmetic rule of Unicode)."""
    offset = F.conv(F.hex(F.encode(ch, "UTF-16BE")), 16, 10).cast("int") - F.lit(0xAC00)
    lead = F.lit(0x1100) + F.floor(offset / 588)
    vowel = F.lit(0x1161) + F.floor((offset % 588) / 28)
    tail = F.lit(0x11A7) + offset % 28
    units = F.concat(
        F.lpad(F.hex(lead), 4, "0"),
        F.lpad(F.hex(vowel), 4, "0"),
        F.when(offset % 28 > 0, F.lpad(F.hex(tail), 4, "0")).otherwise(F.lit("")),
    )
    return F.decode(F.unhex(units), "UTF-16BE")


def _ranges(members) -> str:
    """Characters as a compact regex class body."""
    codes = sorted(map(ord, members))
    starts = [c for c in codes if c - 1 not in set(codes)]
    ends = [c for c in codes if c + 1 not in set(codes)]
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends, strict=True))


@lru_cache(maxsize=2)
def _several_class(ascii_only: bool) -> str:
    hangul = "" if ascii_only else "\\x{ac00}-\\x{d7a3}"
    return f"[{_ranges(_fold_tables(ascii_only)[2])}{hangul}]"


def _expand(value: Column, several: dict[str, str], hangul: bool) -> Column:
    """Ligatures, fractions and syllables, written out character by character."""
    spelled = F.str_to_map(
        F.lit("\x1e".join(f"{ch}\x1f{plain}" for ch, plain in several.items())), F.lit("\x1e"), F.lit("\x1f")
    )

    def one(ch: Column) -> Column:
        known = F.coalesce(F.try_element_at(spelled, ch), ch)
        return F.when(ch.between("\uac00", "\ud7a3"), _hangul_parts(ch)).otherwise(known) if hangul else known

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _fold(c, ascii_only: bool) -> Column:
    source, target, several = _fold_tables(ascii_only)
    value = text_of(c)
    expanded = F.when(value.rlike(_several_class(ascii_only)), _expand(value, several, not ascii_only)).otherwise(value)
    return F.when(F.octet_length(value) == F.char_length(value), value).otherwise(
        F.translate(expanded, source, target)
    )


def fold_accents(c) -> Column:
    """Compatibility-decomposed text without the marks U+0300-U+036F.

    Plain ASCII text is returned untouched. Marks outside that block keep their
    order of appearance.
    """
    return _fold(c, ascii_only=False)


def _drop_words(c: Column, words: list[str]) -> Column:
    return F.regexp_replace(c, f"{_WORD_START}(?:{'|'.join(words)}){_WORD_END}", " ")


def _keep(c: Column, allowed: str) -> Column:
    return F.trim(F.regexp_replace(c, f"[^{allowed}]+", " "))


def ascii_fold(c) -> Column:
    """Fold for keys of ASCII letters and digits: what decomposes to neither is left as it is."""
    return _fold(c, ascii_only=True)


def text_key(folded, variant: str = "match") -> Column:
    return _keep(_drop_words(F.upper(_col(folded)), TYPE_WORDS[variant]), "A-Z0-9")


def exact_key(folded) -> Column:
    return _keep(F.upper(_col(folded)), "A-Z0-9")


def normalize_text(c, variant: str = "match") -> Column:
    """Region name without accents, type words and punctuation, upper case."""
    return text_key(ascii_fold(c), variant)


def normalize_exact(c) -> Column:
    """As normalize_text, but type words stay."""
    return exact_key(ascii_fold(c))


def normalize_name(c) -> Column:
    """Province name, lower case, without the words for 'province'."""
    return _keep(_drop_words(F.lower(_fold(c, ascii_only=True)), PROVINCE_WORDS), "a-z0-9")


def normalize_category(c) -> Column:
    return F.upper(F.regexp_replace(fold_accents(trim(c)), f"[{SPACE}]+", " "))


def normalize_header(c) -> Column:
    lowered = F.lower(_fold(c, ascii_only=True))
    return F.trim(F.regexp_replace(_keep(F.regexp_replace(lowered, "[_-]+", " "), "a-z0-9/% "), " +", " "))


def normalize_code(c, variant: str = "match") -> Column:
    """Official region code; four digits become dd.dd, anything else stays."""
    upper = F.upper(trim(c))
    if variant == "import":
        bare = F.replace(F.regexp_replace(upper, "^ID", ""), F.lit("."), F.lit(""))
        is_code = bare.rlike(r"^\d{4}$")
        other = upper
    else:
        other = F.regexp_replace(upper, f"^IDN?[-{SPACE}]?", "")
        bare = F.regexp_replace(other, r"\D", "")
        is_code = F.char_length(bare) == 4
    return F.when(is_code, F.concat(F.substring(bare, 1, 2), F.lit("."), F.substring(bare, 3, 2))).otherwise(other)


def code_variants(c) -> Column:
    """Spellings under which a code is looked up, as array<string>."""
    code = normalize_code(c)
    bare = F.replace(code, F.lit("."), F.lit(""))
    spellings = F.array(code, bare, F.concat(F.lit("ID"), bare), F.concat(F.lit("ID-"), bare))
    return F.when(code == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.filter(spellings, lambda v: v != ""))
    )


def canonical_region_id(source_id, legacy_id=None) -> Column:
    """Stable region id from the geometry source id, or from the legacy id if there is none."""
    source = text_of(source_id)
    stable = F.concat(F.lit("idn-adm2-gb-"), F.lower(source))
    if legacy_id is None:
        return stable
    return F.when(source != "", stable).otherwise(F.concat(F.lit("idn-adm2-legacy-"), F.lower(text_of(legacy_id))))


def fnv1a36(c) -> Column:
    """FNV-1a, 32 bit, base 36, padded to seven: an id kept for compatibility only.

    Thirty-two bits collide from some tens of thousands of rows on; use
    row_key() where the value is a join or grouping key.
    """
    value = text_of(c)
    start = F.lit(2166136261).cast("bigint")

    def step(h: Column, unit: Column) -> Column:
        return (h.bitwiseXOR(unit) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))

    def add(h: Column, ch: Column) -> Column:
        code = F.ascii(ch).cast("bigint")
        high, low = F.lit(0xD7C0) + F.shiftright(code, 10), F.lit(0xDC00) + code.bitwiseAND(F.lit(0x3FF))
        return F.when(code < 0x10000, step(h, code)).otherwise(step(step(h, high), low))

    hashed = F.when(value == "", start).otherwise(F.aggregate(F.split(value, ""), start, add))
    return F.lpad(F.lower(F.conv(hashed.cast("string"), 10, 36)), 7, "0")


def row_key(*columns) -> Column:
    """Collision-safe key over several values (SHA-256 over unit-separated text)."""
    return F.sha2(F.concat_ws("\x1f", *[text_of(c) for c in columns]), 256)


def sanitize(c, max_len: int) -> Column:
    """No control characters besides tab and line ends, trimmed, cut to max_len."""
    return F.substring(trim(F.regexp_replace(text_of(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")), 1, max_len)


def slugify(c, default: str) -> Column:
    slug = F.regexp_replace(F.lower(_fold(sanitize(c, 80), ascii_only=True)), "[^a-z0-9]+", "-")
    slug = F.trim(slug, F.lit("-"))
    return F.when(slug == "", F.lit(default)).otherwise(slug)


def escape_formula(c) -> Column:
    """A leading formula character gets an apostrophe in front of it."""
    value = text_of(c)
    return F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)


def is_color(c) -> Column:
    return text_of(c).rlike(r"\A#[0-9a-fA-F]{6}\z")


def byte_length(c) -> Column:
    return F.octet_length(text_of(c))


def label_text(name, category, value) -> Column:
    """name - category - value, without the empty parts."""
    return F.concat_ws(" - ", text_of(name), *[F.nullif(text_of(c), F.lit("")) for c in (category, value)])


def place_text(display_name, province) -> Column:
    return F.concat_ws(
        " - ", text_of(display_name), F.coalesce(F.nullif(text_of(province), F.lit("")), F.lit("Province not linked"))
    )


MATCHED_STATUSES = ["exact-code", "exact-name-province", "exact-alias-province", "normalized-name-province"]

# Reader labels of the match statuses.
STATUS_LABELS = {
    "user-resolved": "Matched by you",
    "ambiguous": "Choose a match",
    "unmatched": "Unmatched",
    "duplicate-target": "Duplicate region",
    "invalid": "Check this row",
    "ignored": "Ignored",
}


def status_label(status) -> Column:
    status = _col(status)
    label = F.when(status.isin(MATCHED_STATUSES), "Matched")
    for name, text in STATUS_LABELS.items():
        label = label.when(status == name, text)
    return label.otherwise("Not matched")


def status_state(status, has_errors, region_id) -> Column:
    status = _col(status)
    return (
        F.when(_col(has_errors) | status.isin("ambiguous", "duplicate-target", "invalid"), "needs-review")
        .when(status == "unmatched", "unmatched")
        .when(_col(region_id).isNotNull(), "matched")
        .otherwise("needs-review")
    )
