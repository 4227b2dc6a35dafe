"""Inputs derived from the driver tables.

Each derivation is SQL that Spark and DuckDB read alike; {braces} name tables.
Spark gets it as a DataFrame, the oracle as a common table expression.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]

DERIVED: dict[str, str] = {}

# Registry: nation as second level, region as province. Names repeat on purpose.
DERIVED["regions"] = """
SELECT concat('gb-B', CAST(n_nationkey AS STRING)) AS region_id,
       concat('gb-B', CAST(n_nationkey AS STRING)) AS internal_id,
       concat('B', CAST(n_nationkey AS STRING)) AS geometry_source_id,
       CASE WHEN n_nationkey % 2 = 0 THEN 'Kota' ELSE 'Kabupaten' END AS region_type,
       concat('Nátion ', CAST(n_nationkey % 20 AS STRING)) AS region_name,
       concat(CASE WHEN n_nationkey % 2 = 0 THEN 'Kota' ELSE 'Kabupaten' END, ' Nátion ',
              CAST(n_nationkey % 20 AS STRING)) AS display_name,
       concat('Source ', n_name) AS geometry_source_name,
       CASE WHEN n_nationkey = 24 THEN '' ELSE r_name END AS province_name,
       concat(CAST(10 + n_regionkey AS STRING), '.', lpad(CAST(n_nationkey AS STRING), 2, '0')) AS official_code,
       CASE n_nationkey % 3
            WHEN 0 THEN concat('Old ', CAST(n_nationkey AS STRING), ' | ', r_name, ' | 99', lpad(CAST(n_nationkey AS STRING), 2, '0'),
                               ' ; Ancient ', CAST(n_nationkey % 4 AS STRING))
            WHEN 1 THEN concat(' | ;  Former ', CAST(n_nationkey AS STRING), ' |  | ')
            ELSE '' END AS alternative_names,
       CASE WHEN n_nationkey % 20 < 5 THEN 'ambiguous_name' ELSE 'matched' END AS match_status,
       CASE WHEN n_nationkey % 20 < 2 THEN 'two candidates' ELSE '' END AS notes,
       100 * n_nationkey AS area_sqkm,
       CAST(n_nationkey AS INT) AS ordinal
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
"""

# Spreadsheet rows: every spelling a person might use for a customer's nation.
DERIVED["messy"] = """
SELECT concat('row-', CAST(c_custkey AS STRING)) AS row_id,
       CAST(floor(c_custkey / 6) AS BIGINT) AS source_id,
       CAST(c_custkey + 2 AS BIGINT) AS row_number,
       CASE c_custkey % 12
            WHEN 0 THEN official_code
            WHEN 1 THEN replace(official_code, '.', '')
            WHEN 2 THEN concat('id-', replace(official_code, '.', ''))
            WHEN 3 THEN '77.77'
            WHEN 10 THEN concat('ID99', lpad(CAST(ordinal AS STRING), 2, '0'))
            ELSE '' END AS region_code,
       CASE c_custkey % 12
            WHEN 0 THEN 'wrong name'
            WHEN 3 THEN region_name
            WHEN 4 THEN concat('Kab. ', region_name)
            WHEN 5 THEN upper(display_name)
            WHEN 6 THEN concat('old ', CAST(ordinal AS STRING))
            WHEN 7 THEN region_name
            WHEN 9 THEN concat('Nowhere ', CAST(c_custkey AS STRING))
            WHEN 10 THEN 'Nowhere'
            WHEN 11 THEN concat(region_name, ' City')
            ELSE '' END AS region_name,
       CASE WHEN c_custkey % 12 IN (7, 1) THEN '' ELSE lower(province_name) END AS province,
       CASE c_custkey % 12
            WHEN 0 THEN CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS STRING)
            WHEN 1 THEN replace(CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS STRING), '.', ',')
            WHEN 2 THEN concat(CAST(CAST(floor(abs(c_acctbal) / 1000) AS INT) AS STRING), '.',
                               lpad(CAST(CAST(floor(abs(c_acctbal)) AS INT) % 1000 AS STRING), 3, '0'), ',5')
            WHEN 3 THEN concat('-', CAST(CAST(floor(abs(c_acctbal) / 1000) AS INT) AS STRING), ',',
                               lpad(CAST(CAST(floor(abs(c_acctbal)) AS INT) % 1000 AS STRING), 3, '0'), '.25')
            WHEN 4 THEN concat(CAST(CAST(floor(abs(c_acctbal)) AS INT) % 100 AS STRING), ',5%')
            WHEN 5 THEN concat('(', CAST(CAST(abs(c_acctbal) AS DECIMAL(12,2)) AS STRING), ')')
            WHEN 6 THEN concat('=', CAST(CAST(floor(abs(c_acctbal)) AS INT) AS STRING))
            WHEN 7 THEN ''
            WHEN 8 THEN concat(CAST(CAST(floor(abs(c_acctbal)) AS INT) % 1000 AS STRING), ',',
                               lpad(CAST(CAST(floor(abs(c_acctbal)) AS INT) % 1000 AS STRING), 3, '0'))
            WHEN 9 THEN 'n/a'
            WHEN 10 THEN '0'
            ELSE concat(' ', CAST(CAST(floor(abs(c_acctbal) / 10) AS INT) AS STRING), ' ',
                        CAST(CAST(floor(abs(c_acctbal)) AS INT) % 10 AS STRING), ' ') END AS numeric_value,
       CASE c_custkey % 4
            WHEN 0 THEN c_mktsegment
            WHEN 1 THEN lower(c_mktsegment)
            WHEN 2 THEN concat('  ', c_mktsegment, ' ')
            ELSE replace(c_mktsegment, 'U', 'Ü') END AS category,
       'ledger' AS source,
       concat('Q', CAST(c_custkey % 4 + 1 AS STRING)) AS period,
       CASE WHEN c_acctbal < 0 THEN 'red' WHEN c_acctbal > 9000 THEN '#70ad47' ELSE '' END AS color,
       c_acctbal AS amount,
       region_id AS true_region
FROM {customer} JOIN {regions} ON ordinal = c_nationkey
"""

# User decisions: ignore, resolve by region id or canonical id, current or stale registry.
DERIVED["decisions"] = """
SELECT row_id,
       CASE WHEN amount < 0 THEN 'ignore' ELSE 'resolve' END AS action,
       CASE WHEN period IN ('Q1', 'Q2') THEN true_region
            ELSE concat('idn-adm2-gb-', lower(replace(true_region, 'gb-', ''))) END AS target_id,
       CASE WHEN period = 'Q3' THEN 'stale' ELSE 'IDN-ADM-REGISTRY-v1-2025-06-23' END AS registry_version
FROM {messy} WHERE amount < 0 OR amount > 8000
"""

# One matched row per customer, for classification: region = customer.
DERIVED["valued"] = """
SELECT concat('row-', CAST(c_custkey AS STRING)) AS row_id,
       CAST(c_custkey + 2 AS BIGINT) AS row_number,
       concat('r', CAST(c_custkey AS STRING)) AS region_id,
       CASE WHEN c_mktsegment = 'MACHINERY' AND c_acctbal > 5000 THEN 'ambiguous' ELSE 'exact-code' END AS status,
       CASE WHEN c_acctbal BETWEEN 2000 AND 2100 THEN 'n/a'
            ELSE CAST(CAST(c_acctbal AS DECIMAL(12,1)) AS STRING) END AS numeric_value,
       CASE WHEN c_acctbal < 0 THEN '' WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE concat(' ', c_mktsegment) END AS category
FROM {customer}
"""

# Unit cells on a grid; every third cell has a second polygon with a hole-free half cell.
DERIVED["cells"] = """
SELECT concat('c', CAST(o_orderkey AS STRING)) AS region_id,
       CAST(95 + o_orderkey % 40 AS DOUBLE) AS x,
       CAST(floor(o_orderkey / 40) AS DOUBLE) AS y,
       CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS parts,
       o_totalprice AS area_sqkm,
       CASE o_orderkey % 4 WHEN 0 THEN 'Kota' WHEN 1 THEN '' ELSE 'Kabupaten' END AS region_type,
       o_orderpriority AS province_name,
       concat('Cell ', CAST(o_orderkey AS STRING)) AS display_name
FROM {orders}
"""

# Flat vertices of the cells (oracle side only; Spark starts from nested geometry).
DERIVED["vertices"] = """
SELECT region_id, 0 AS polygon, 0 AS ring, 0 AS pos, x AS x, y AS y FROM {cells}
UNION ALL SELECT region_id, 0, 0, 1, x + 1, y FROM {cells}
UNION ALL SELECT region_id, 0, 0, 2, x + 1, y + 1 FROM {cells}
UNION ALL SELECT region_id, 0, 0, 3, x, y + 1 FROM {cells}
UNION ALL SELECT region_id, 0, 0, 4, x, y FROM {cells}
UNION ALL SELECT region_id, 1, 0, 0, x + 1000, y FROM {cells} WHERE parts = 2
UNION ALL SELECT region_id, 1, 0, 1, x + 1000.5, y FROM {cells} WHERE parts = 2
UNION ALL SELECT region_id, 1, 0, 2, x + 1000.5, y + 1 FROM {cells} WHERE parts = 2
UNION ALL SELECT region_id, 1, 0, 3, x + 1000, y FROM {cells} WHERE parts = 2
"""

_NAME = re.compile(r"\{([a-z]\w*)\}")


def uses(sql: str) -> list[str]:
    return list(dict.fromkeys(_NAME.findall(sql)))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a derived input as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = DERIVED[name]
    return spark.sql(sql, **{n: load(spark, sf_dir, n) for n in uses(sql)})


def oracle(sql: str) -> str:
    """Oracle text with every derived input it names as a common table expression."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in uses(text):
            if name in DERIVED and name not in order:
                visit(DERIVED[name])
                order.append(name)

    visit(sql)
    ctes = [f"{n} AS ({_NAME.sub(r'\1', DERIVED[n]).strip()})" for n in order]
    body = _NAME.sub(r"\1", sql).strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(ctes)}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(ctes)}, {body[5:]}"
    return f"WITH {', '.join(ctes)} {body}"
