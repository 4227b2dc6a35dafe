"""Audits over pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from areal.catalog.registered import query
from areal.operators import audit
from areal.plans import inputs

_BLOCKS = r"regexp_replace(regexp_replace(regexp_replace({html}, '(?is)<script.*?</script>', '{r}', 'g'), '(?is)<style.*?</style>', '{r}', 'g'), '(?s)<!--.*?-->', '{r}', 'g')"
_VISIBLE = r"trim(regexp_replace(regexp_replace(regexp_replace(" + _BLOCKS.format(html="html", r=" ") + r", '<[^>]+>', ' ', 'g'), '(?i)&[a-z0-9#]+;', ' ', 'g'), '\s+', ' ', 'g'))"

# Pages with the markup the rules look for, spread by value over the table.
inputs.DERIVED["marked"] = """
SELECT page_id, url, concat(html,
         CASE WHEN url LIKE '%/en/%' THEN '<main id="m"><a href="#">x</a><a href="mailto:a@b.c">Mail</a><a href="sub/page">Sub</a><img src="logo.png" alt=" Logo  of  us ">' ELSE '' END,
         CASE WHEN url LIKE 'https%' THEN concat('<link rel="canonical" href="', url, '"><a href="', url, '" title="Self">self</a><a href="ftp://other/x">f</a>') ELSE '' END,
         CASE WHEN url LIKE '%ref=%' THEN concat('<form action="/go"><input value="Go" placeholder="Search"></form><meta name="robots" content="noindex"><p>$', chr(123), 'name', chr(125), '</p><p>', chr(123), chr(123), 'title</p>') ELSE '' END,
         CASE WHEN url LIKE '%.org%' THEN '<p>Create map dan peta. Save the project! Upload dari file? Export untuk web. Fix yang ini. Open wilayah now.</p>Pilih Wilayah<script src="assets/js/app.js"></script>' ELSE '' END) AS html
FROM {pages}"""


@query("x1_visible_text", f"SELECT page_id, {_VISIBLE} AS v FROM {{marked}}")
def x1(t):
    return t.marked.select("page_id", audit.visible_text("html").alias("v"))


@query(
    "x2_text_nodes",
    r"SELECT page_id, v AS value, count(*) AS times FROM (SELECT page_id, trim(regexp_replace(unnest(regexp_extract_all("
    + _BLOCKS.format(html="html", r="")
    + r", '>([^<>]+)<', 1)), '\s+', ' ', 'g')) AS v FROM {marked}) WHERE v <> '' AND NOT regexp_matches(v, '^(\{\{|\$\{)') GROUP BY ALL",
)
def x2(t):
    return audit.text_nodes(t.marked, "page_id", "html").groupBy("page_id", "value").agg(F.count("*").alias("times"))


@query(
    "x3_attributes",
    r"""SELECT page_id, regexp_extract(a, '(?i)^([a-z-]+)=', 1) AS attribute, trim(regexp_replace(regexp_extract(a, '"([^"]*)"', 1), '\s+', ' ', 'g')) AS value
        FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)\b(?:aria-label|placeholder|title|alt|value)="[^"]*"')) AS a FROM {marked}) WHERE trim(regexp_extract(a, '"([^"]*)"', 1)) <> ''
        UNION ALL SELECT page_id, 'href', unnest(regexp_extract_all(html, '(?i)href=["'']([^"'']+)["'']', 1)) FROM {marked}
        UNION ALL SELECT page_id, 'src', unnest(regexp_extract_all(html, '(?i)src=["'']([^"'']+)["'']', 1)) FROM {marked}""",
)
def x3(t):
    pages = t.marked
    targets = audit.references(pages, "page_id", "html").withColumnRenamed("target", "value")
    return audit.attributes(pages, "page_id", "html").unionByName(targets)


_PHRASES = ["Pilih Wilayah", "the of", "que la", "und der"]


@query(
    "x4_banned_phrases",
    f"SELECT page_id, p AS phrase FROM (SELECT page_id, lower({_VISIBLE}) AS v FROM {{marked}}), (SELECT unnest(['Pilih Wilayah', 'the of', 'que la', 'und der']) AS p) WHERE contains(v, lower(p))",
)
def x4(t):
    return audit.banned(t.marked, "page_id", audit.visible_text("html"), _PHRASES)


@query(
    "x5_mixed_language",
    rf"""SELECT page_id, trim(s) AS sentence FROM (SELECT page_id, s
        FROM (SELECT page_id, unnest(l) AS s FROM (SELECT page_id, string_split_regex({_VISIBLE}, '[.!?]') AS l FROM {{marked}}))
        WHERE regexp_matches(s, '(?i)\b(create|map|match|upload|export|save|open|fix|continue|cancel)\b') AND regexp_matches(s, '(?i)\b(dan|yang|untuk|dari|dengan|tidak|pilih|wilayah|peta|proyek)\b'))""",
)
def x5(t):
    found = audit.mixed_language(t.marked, "page_id", audit.visible_text("html"), audit.ENGLISH_WORDS, audit.INDONESIAN_WORDS)
    return found.select("page_id", "sentence")


_TOKENS = {"the-and": r"(?i)(?<![A-Za-z0-9_])(?:the|and)(?![A-Za-z0-9_])", "digits": r"\d{3,}"}
_TOKEN_SQL = r"""(SELECT doc_id, i AS line, code, hit FROM (SELECT doc_id, i, 'the-and' AS code, unnest(regexp_extract_all(l, '(?i)\b(?:the|and)\b')) AS hit FROM lines UNION ALL SELECT doc_id, i, 'digits', unnest(regexp_extract_all(l, '\d{3,}')) FROM lines))"""
_LINES = r"lines AS (SELECT doc_id, unnest(l) AS l, unnest(range(len(l))) + 1 AS i FROM (SELECT doc_id, string_split_regex(text, '\r?\n') AS l  FROM {documents}))"


@query("x6_token_scan", f"WITH {_LINES} SELECT doc_id, CAST(line AS INTEGER) AS line, code, hit AS match, count(*) AS times FROM {_TOKEN_SQL} GROUP BY ALL")
def x6(t):
    found = audit.tokens(t.documents, "doc_id", "text", _TOKENS)
    return found.groupBy("doc_id", "line", "code", "match").agg(F.count("*").alias("times"))


@query(
    "x6_first_columns",
    f"""WITH {_LINES} SELECT doc_id, CAST(i AS INTEGER) AS line, CAST(length(regexp_extract(l, '^(?i)(.*?)\\b(?:the|and)\\b', 1)) + 1 AS INTEGER) AS first_column FROM lines WHERE regexp_matches(l, '(?i)\\b(?:the|and)\\b')""",
)
def x6_columns(t):
    found = audit.tokens(t.documents, "doc_id", "text", {"the-and": _TOKENS["the-and"]})
    return found.groupBy("doc_id", "line").agg(F.min("column").alias("first_column"))


@query(
    "a8_occurrence_rollup",
    f"""WITH {_LINES} SELECT t.doc_id, code, CASE WHEN quality = 1 AND code = 'digits' THEN 'allowed' ELSE 'failure' END AS verdict, count(*) AS occurrences FROM {_TOKEN_SQL} t LEFT JOIN {{labels}} b ON b.doc_id = t.doc_id GROUP BY ALL""",
)
def a8(t):
    found = audit.tokens(t.documents, "doc_id", "text", _TOKENS)
    allowed = t.labels.filter("quality = 1").select("doc_id", F.lit("digits").alias("code"), F.lit("reviewed").alias("reason")).distinct()
    return audit.roll_up(audit.with_allowance(found, "doc_id", allowed), ["doc_id", "code", "verdict"])


# Documents with a planted secret by source, built from the row's own values.
inputs.DERIVED["leaky"] = """
SELECT doc_id, concat(text, CASE source WHEN 'src0' THEN concat(' sk-', lpad(CAST(doc_id AS STRING), 24, 'a'))
       WHEN 'src1' THEN ' -----BEGIN EC PRIVATE KEY-----' WHEN 'src2' THEN concat(' ', lpad(CAST(doc_id AS STRING), 32, 'x'), '.', lpad('', 32, 'y'), '.', lpad('', 33, 'z'))
       WHEN 'src3' THEN ' Service_Token = "abc"' ELSE '' END) AS text
FROM {documents}"""
_KEYS = r"""SELECT doc_id, 'api-key' AS kind FROM {leaky} WHERE regexp_matches(text, 'sk-[A-Za-z0-9_-]{20,}')
    UNION ALL SELECT doc_id, 'private-key' FROM {leaky} WHERE regexp_matches(text, '-----BEGIN (RSA |EC |OPENSSH |)PRIVATE KEY-----')
    UNION ALL SELECT doc_id, 'three-part-token' FROM {leaky} WHERE regexp_matches(text, '[A-Za-z0-9_-]{32,}\.[A-Za-z0-9_-]{32,}\.[A-Za-z0-9_-]{32,}')
    UNION ALL SELECT doc_id, 'assignment:token' FROM {leaky} WHERE regexp_matches(text, '(?i)token\s*=\s*[''"][^''"]+')"""


@query("x7_secret_scan", _KEYS)
def x7(t):
    return audit.secrets(t.leaky, "doc_id", "text", ["token"])


@query(
    "x7_secret_scan_long",
    f"""WITH k AS ({_KEYS}) SELECT k.doc_id, k.kind FROM k JOIN {{leaky}} l ON l.doc_id = k.doc_id WHERE octet_length(encode(l.text)) <= 3000
        UNION ALL SELECT doc_id, 'not-scanned' FROM {{leaky}} WHERE octet_length(encode(text)) > 3000""",
)
def x7_long(t):
    """With a limit, what is refused is told."""
    return audit.secrets(t.leaky, "doc_id", "text", ["token"], max_bytes=3000)


@query(
    "x8_link_check",
    r"""WITH refs AS (SELECT page_id, url, 'href' AS attribute, unnest(regexp_extract_all(html, '(?i)href=["'']([^"'']+)["'']', 1)) AS target FROM {marked}
        UNION ALL SELECT page_id, url, 'src', unnest(regexp_extract_all(html, '(?i)src=["'']([^"'']+)["'']', 1)) FROM {marked}),
    placed AS (SELECT *, regexp_extract(url, '^([a-z]+://[^/]+)', 1) AS origin, regexp_replace(target, '[?#].*$', '') AS bare FROM refs),
    resolved AS (SELECT *, starts_with(target, origin) AS own, CASE WHEN starts_with(target, origin) THEN bare WHEN starts_with(bare, '/') THEN concat(origin, bare)
        ELSE concat(regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', ''), bare) END AS place FROM placed)
    SELECT page_id, attribute, target, CASE WHEN attribute = 'href' AND target = '#' THEN 'placeholder' WHEN regexp_matches(target, '^(#|mailto:|tel:)') THEN 'ok'
        WHEN NOT own AND regexp_matches(target, '(?i)^[a-z]+:') THEN 'foreign-scheme' WHEN place IN (SELECT regexp_replace(url, '[?#].*$', '') FROM {marked}) OR bare = '' THEN 'ok' ELSE 'broken' END AS verdict FROM resolved""",
)
def x8(t):
    return audit.links(t.marked, "page_id", "url", "html")


@query(
    "x9_page_rules",
    r"""SELECT page_id, regexp_matches(html, '(?i)<html\s+lang="en"') AS lang, regexp_matches(html, '(?i)<main[\s>]') AS main, regexp_matches(html, '(?i)<link rel="canonical" href="https?://[^"]+"') AS canonical,
        NOT regexp_matches(html, '(?i)<form[\s>]') AS no_form, NOT regexp_matches(html, '(?i)<meta name="robots"[^>]*noindex') AS indexed, NOT contains(html, 'assets/js/app.js') AS no_forbidden FROM {marked}""",
)
def x9(t):
    return audit.page_rules(t.marked, "page_id", "html", "en", ["assets/js/app.js"])


@query("x10_url_inventory", r"""SELECT DISTINCT unnest(regexp_extract_all(concat(url, ' ', html), 'https?://[^"''\s)]+')) AS url FROM {marked}""")
def x10(t):
    return audit.urls(t.marked.select(F.concat_ws(" ", "url", "html").alias("body")), "body")


@query(
    "x11_required_terms",
    "SELECT DISTINCT c_mktsegment AS term FROM {customer} WHERE lower(c_mktsegment) NOT IN (SELECT lower(p_type) FROM {part}) AND lower(c_mktsegment) NOT IN (SELECT DISTINCT lower(c_mktsegment) FROM {customer} WHERE c_acctbal > 9990)",
)
def x11(t):
    terms = t.part.select(F.upper("p_type").alias("term")).union(t.customer.filter("c_acctbal > 9990").select(F.upper("c_mktsegment")))
    return audit.missing_terms(t.customer.select(F.upper("c_mktsegment").alias("term")).distinct(), terms)
