"""Scalar functions over messy rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from areal.catalog.registered import Tables, query
from areal.functions import number, text

# Oracle wording of the shared steps.

def _clean(expr: str, drop: str | None, keep: str = "A-Z0-9") -> str:
    dropped = f"regexp_replace({expr}, '\\b({drop})\\b', ' ', 'g')" if drop else expr
    return f"trim(regexp_replace({dropped}, '[^{keep}]+', ' ', 'g'))"


def sql_text(column: str, variant: str = "match") -> str:
    words = {
        "match": r"KABUPATEN|KAB\.?|KAB|KOTA ADMINISTRASI|KOTA|CITY|REGENCY",
        "import": r"KABUPATEN|KAB\.?|KOTA|CITY|REGENCY",
    }[variant]
    return _clean(f"upper(strip_accents({column}))", words)


def sql_exact(column: str) -> str:
    return _clean(f"upper(strip_accents({column}))", None)


def sql_code(column: str) -> str:
    raw = f"regexp_replace(upper(trim({column})), '^IDN?[-\\s]?', '')"
    digits = f"regexp_replace({raw}, '\\D', '', 'g')"
    return f"CASE WHEN length({digits}) = 4 THEN concat({digits}[1:2], '.', {digits}[3:4]) ELSE {raw} END"


def sql_code_import(column: str) -> str:
    bare = f"replace(regexp_replace(upper(trim({column})), '^ID', ''), '.', '')"
    return (
        f"CASE WHEN regexp_full_match({bare}, '\\d{{4}}') THEN concat({bare}[1:2], '.', {bare}[3:4])"
        f" ELSE upper(trim({column})) END"
    )


SPELLED = "concat(' ', display_name, ' / Kota Administrasi ', region_name, ' Kab.', province_name)"


def _spelled(t: Tables):
    regions = t.regions.select("region_id", "display_name", "region_name", "province_name")
    return t.customer.join(F.broadcast(regions.withColumn("k", F.substring("region_id", 5, 9).cast("int"))), F.col("c_nationkey") == F.col("k")).withColumn(
        "spelled", F.concat(F.lit(" "), "display_name", F.lit(" / Kota Administrasi "), "region_name", F.lit(" Kab."), "province_name", F.lit(" "), "c_name", F.lit(" City"))
    )


_SPELLED_SQL = f"(SELECT c_custkey, concat({SPELLED}, ' ', c_name, ' City') AS spelled FROM {{customer}} JOIN {{regions}} ON ordinal = c_nationkey)"


@query("f1_normalize_text_import", f"SELECT c_custkey, {sql_text('spelled', 'import')} AS v FROM {_SPELLED_SQL}")
def f1(t):
    return _spelled(t).select("c_custkey", text.normalize_text("spelled", "import").alias("v"))


@query("f2_normalize_text", f"SELECT c_custkey, {sql_text('spelled')} AS v FROM {_SPELLED_SQL}")
def f2(t):
    return _spelled(t).select("c_custkey", text.normalize_text("spelled").alias("v"))


@query("f3_normalize_exact", f"SELECT doc_id, {sql_exact("replace(text, 'ß', 'SS')")} AS v FROM {{documents}}")
def f3(t):
    return t.documents.select("doc_id", text.normalize_exact("text").alias("v"))


@query(
    "f4_normalize_name",
    r"SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(strip_accents(concat('Provinsi ', c_name, ' Daerah Ístimewa province'))), '\b(daerah|provinsi|province)\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS v FROM {customer}",
)
def f4(t):
    return t.customer.select(
        "c_custkey", text.normalize_name(F.concat(F.lit("Provinsi "), "c_name", F.lit(" Daerah Ístimewa province"))).alias("v")
    )


@query(
    "f5_normalize_category",
    r"SELECT row_id, upper(regexp_replace(strip_accents(trim(category)), '\s+', ' ', 'g')) AS v FROM {messy}",
)
def f5(t):
    return t.messy.select("row_id", text.normalize_category("category").alias("v"))


@query("f6_normalize_code_import", f"SELECT row_id, {sql_code_import('region_code')} AS v FROM {{messy}}")
def f6(t):
    return t.messy.select("row_id", text.normalize_code("region_code", "import").alias("v"))


@query("f7_normalize_code", f"SELECT row_id, {sql_code('region_code')} AS v FROM {{messy}}")
def f7(t):
    return t.messy.select("row_id", text.normalize_code("region_code").alias("v"))


@query(
    "f8_code_variants",
    f"""SELECT DISTINCT row_id, unnest([code, bare, concat('ID', bare), concat('ID-', bare)]) AS v
        FROM (SELECT row_id, code, replace(code, '.', '') AS bare FROM (SELECT row_id, {sql_code('region_code')} AS code FROM {{messy}}))
        WHERE code <> ''""",
)
def f8(t):
    return t.messy.select("row_id", F.explode(text.code_variants("region_code")).alias("v"))


@query(
    "f9_canonical_region_id",
    """SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN concat('idn-adm2-legacy-gb-', CAST(o_custkey AS VARCHAR))
       ELSE concat('idn-adm2-gb-b', CAST(o_custkey AS VARCHAR)) END AS v FROM {orders}""",
)
def f9(t):
    source = F.when(F.col("o_orderpriority").startswith("1"), "").otherwise(F.concat(F.lit("B"), "o_custkey"))
    return t.orders.select("o_orderkey", text.canonical_region_id(source, F.concat(F.lit("GB-"), "o_custkey")).alias("v"))


@query(
    "f10_stable_hash",
    """SELECT doc_id, lower(to_base(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), units), lambda h, u: (xor(h, u) * 16777619) & 4294967295), 36, 7)) AS v
       FROM (SELECT doc_id, CASE WHEN text = '' THEN [] ELSE flatten(list_transform(string_split(text, ''), lambda c:
           CASE WHEN unicode(c) < 65536 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(55232 + (unicode(c) >> 10) AS BIGINT), CAST(56320 + (unicode(c) & 1023) AS BIGINT)] END)) END AS units
       FROM {documents})""",
)
def f10(t):
    return t.documents.select("doc_id", text.fnv1a36("text").alias("v"))


@query(
    "f11_slugify",
    r"""SELECT doc_id, CASE WHEN s = '' THEN 'map' ELSE s END AS v FROM (SELECT doc_id,
        trim(regexp_replace(lower(strip_accents(substr(trim(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), E' \n\t\r'), 1, 80))), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM {documents})""",
)
def f11(t):
    return t.documents.select("doc_id", text.slugify("text", "map").alias("v"))


@query(
    "f12_sanitize_text",
    r"""SELECT doc_id, substr(trim(regexp_replace(concat(chr(7), ' ', text, chr(31)), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), E' \n\t\r'), 1, 180) AS v FROM {documents}""",
)
def f12(t):
    return t.documents.select("doc_id", text.sanitize(F.concat(F.lit("\x07 "), "text", F.lit("\x1f")), 180).alias("v"))


@query(
    "f13_escape_formula",
    r"SELECT row_id, CASE WHEN regexp_matches(numeric_value, '^[=+\-@\t\r]') THEN concat('''', numeric_value) ELSE numeric_value END AS v FROM {messy}",
)
def f13(t):
    return t.messy.select("row_id", text.escape_formula("numeric_value").alias("v"))


@query("f15_is_color", "SELECT row_id, regexp_full_match(color, '#[0-9a-fA-F]{6}') AS v FROM {messy}")
def f15(t):
    return t.messy.select("row_id", text.is_color("color").alias("v"))


@query("f16_utf8_bytes", "SELECT doc_id, CAST(strlen(text) AS INTEGER) AS v FROM {documents}")
def f16(t):
    return t.documents.select("doc_id", text.byte_length("text").alias("v"))


@query(
    "f17_label_text",
    """SELECT row_id, concat_ws(' - ', region_name, nullif(category, ''), nullif(numeric_value, '')) AS label,
       concat_ws(' - ', region_name, CASE WHEN province = '' THEN 'Province not linked' ELSE province END) AS place
       FROM {messy}""",
)
def f17(t):
    return t.messy.select(
        "row_id",
        text.label_text("region_name", "category", "numeric_value").alias("label"),
        text.place_text("region_name", "province").alias("place"),
    )


# Reading of digits under one locale: d decimal mark, g grouping mark.
def _locale_case(core: str, d: str, g: str, name: str) -> str:
    return f"""CASE WHEN regexp_full_match({core}, '(\\d+|\\d{{1,3}}([{g}]\\d{{3}})+)([{d}]\\d*)?') THEN '{name}'
        WHEN NOT regexp_full_match({core}, '[\\d.,]+') THEN 'not-numeric'
        WHEN length({core}) - length(replace({core}, '{d}', '')) > 1 THEN 'too-many-decimals'
        WHEN contains(split_part({core}, '{d}', 1), '{g}') AND NOT regexp_full_match(split_part({core}, '{d}', 1), '\\d{{1,3}}([{g}]\\d{{3}})+') THEN 'invalid-grouping'
        WHEN contains(split_part({core}, '{d}', 2), '{g}') THEN 'invalid-fraction' ELSE 'not-numeric' END"""


def _one_case(core: str, m: str, name: str) -> str:
    return f"""CASE WHEN regexp_full_match({core}, '\\d{{1,3}}[{m}].{{3}}') THEN 'ambiguous-separator'
        WHEN regexp_full_match({core}, '\\d+[{m}]\\d+') THEN '{name}' ELSE 'not-numeric' END"""


def _number_sql(locale: str) -> str:
    ident, amer = _locale_case("core", ",", ".", "id-ID"), _locale_case("core", ".", ",", "en-US")
    auto = f"""CASE WHEN regexp_full_match(core, '\\d+') THEN 'integer'
        WHEN commas > 0 AND dots > 0 AND instr(reverse(core), ',') < instr(reverse(core), '.') THEN {ident}
        WHEN commas > 0 AND dots > 0 THEN {amer}
        WHEN commas = 1 THEN {_one_case('core', ',', 'decimal-comma')}
        WHEN commas > 1 THEN CASE WHEN {amer} = 'en-US' THEN 'en-US' WHEN regexp_full_match(core, '[\\d.,]+') THEN 'too-many-decimals' ELSE 'not-numeric' END
        WHEN dots = 1 THEN {_one_case('core', '.', 'decimal-dot')}
        WHEN dots > 1 THEN {ident} ELSE 'not-numeric' END"""
    fmt = {"auto": auto, "id-ID": ident, "en-US": amer}[locale]
    good = "('id-ID', 'en-US', 'integer', 'decimal-comma', 'decimal-dot')"
    return f"""SELECT row_id,
        CASE WHEN format = 'blank' THEN 'blank' WHEN format = 'ambiguous-separator' THEN 'ambiguous' WHEN format NOT IN {good} THEN 'invalid'
             WHEN percent THEN 'percentage' ELSE 'number' END AS kind,
        CASE WHEN format IN {good} THEN round(TRY_CAST(CASE WHEN format IN ('id-ID', 'decimal-comma') THEN replace(replace(core, '.', ''), ',', '.')
             ELSE replace(core, ',', '') END AS DOUBLE) * (CASE WHEN negative THEN -1 ELSE 1 END) / (CASE WHEN percent THEN 100 ELSE 1 END), 6) + 0.0 END AS value,
        percent, format
        FROM (SELECT row_id, core, negative, CASE WHEN cell = '' OR cell[1] IN ('=', '+', '@') THEN false ELSE percent END AS percent,
              CASE WHEN cell = '' THEN 'blank' WHEN cell[1] IN ('=', '+', '@') THEN 'formula-like' ELSE {fmt} END AS format
        FROM (SELECT *, length(core) - length(replace(core, ',', '')) AS commas, length(core) - length(replace(core, '.', '')) AS dots
        FROM (SELECT row_id, cell, bracket <> starts_with(unpct, '-') AS negative, percent,
              regexp_replace(unpct, '^-', '') AS core
        FROM (SELECT row_id, cell, bracket, ends_with(inner_, '%') AS percent, regexp_replace(inner_, '%$', '') AS unpct
        FROM (SELECT row_id, cell, regexp_full_match(cell, '\\(.*\\)') AS bracket,
              CASE WHEN regexp_full_match(cell, '\\(.*\\)') THEN cell[2:-2] ELSE cell END AS inner_
        FROM (SELECT row_id, regexp_replace(numeric_value, '\\s+', '', 'g') AS cell FROM {{messy}}))))))"""


def _numbers(t: Tables, locale: str):
    parsed = t.messy.select("row_id", number.parse_number("numeric_value", locale).alias("n"))
    return parsed.select("row_id", "n.kind", F.round("n.value", 6).alias("value"), "n.percent", "n.format")


@query("f20_parse_number", _number_sql("auto"))
def f20(t):
    return _numbers(t, "auto")


@query("f21_parse_number_en_us", _number_sql("en-US"))
def f21(t):
    return _numbers(t, "en-US")


@query("f22_parse_number_id_id", _number_sql("id-ID"))
def f22(t):
    return _numbers(t, "id-ID")


# Lenient reading, for plain decimal input.
COERCE_SQL = """CASE WHEN trim({c}) = '' OR trim({c})[1] IN ('=', '+', '@') THEN NULL ELSE
    TRY_CAST(CASE WHEN contains({k}, ',') AND contains({k}, '.') THEN
        CASE WHEN instr(reverse({k}), ',') < instr(reverse({k}), '.') THEN replace(replace({k}, '.', ''), ',', '.') ELSE replace({k}, ',', '') END
        ELSE replace({k}, ',', '.') END AS DOUBLE) / CASE WHEN ends_with(trim({c}), '%') THEN 100 ELSE 1 END END"""


def sql_coerce(column: str) -> str:
    return COERCE_SQL.format(c=column, k=f"regexp_replace(regexp_replace(trim({column}), '%$', ''), '\\s', '', 'g')")


@query("f23_coerce_value", f"SELECT row_id, round({sql_coerce('numeric_value')}, 6) AS v FROM {{messy}}")
def f23(t):
    return t.messy.select("row_id", F.round(number.coerce_value("numeric_value"), 6).alias("v"))


# Display text; quarters and halves are exact in binary, so both engines round alike.
def sql_format(value: str, fmt: str) -> str:
    digits = {"integer": 0, "decimal-2": 2}.get(fmt, 3)
    shown = f"format('{{:,.{digits}f}}', round({value}, {digits}))"
    if digits == 3:
        shown = f"regexp_replace(regexp_replace({shown}, '0+$', ''), '\\.$', '')"
    if fmt == "id-ID":
        shown = f"translate({shown}, ',.', '.,')"
    return f"CASE WHEN {value} IS NULL OR isinf({value}) OR isnan({value}) THEN '—' ELSE {shown} END"


_AMOUNT = "floor(o_totalprice * 8) / 8"


@query(
    "f24_format_number",
    "SELECT o_orderkey, " + ", ".join(
        f"{sql_format(_AMOUNT, fmt)} AS {name}"
        for fmt, name in (("id-ID", "indonesian"), ("en-US", "american"), ("integer", "whole"), ("decimal-2", "cents"))
    ).replace("{:", "{{:").replace("f}'", "f}}'").replace("{{", "{").replace("}}", "}") + " FROM {orders}",
)
def f24(t):
    amount = F.floor(F.col("o_totalprice") * 8).cast("double") / 8
    return t.orders.select(
        "o_orderkey",
        number.format_number(amount, "id-ID").alias("indonesian"),
        number.format_number(amount, "en-US").alias("american"),
        number.format_number(amount, "integer").alias("whole"),
        number.format_number(amount, "decimal-2").alias("cents"),
    )


@query(
    "f25_clamp_classes",
    "SELECT l_orderkey, l_linenumber, CAST(least(greatest(floor(l_quantity / 4 + 0.5), 2), 7) AS INTEGER) AS v FROM {lineitem}",
)
def f25(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", number.clamp_classes(F.col("l_quantity") / 4).alias("v"))


@query("f27_day_text", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS v FROM {orders}")
def f27(t):
    return t.orders.select("o_orderkey", number.day_text("o_orderdate").alias("v"))
