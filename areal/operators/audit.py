"""Audits over page and document tables: text, attributes, links, phrases, secrets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areal.functions import text
from areal.plans.sizing import lookup_join

# Shapes of secrets.
SECRET_PATTERNS = {
    "api-key": r"sk-[A-Za-z0-9_-]{20,}",
    "private-key": r"-----BEGIN (RSA |EC |OPENSSH |)PRIVATE KEY-----",
    "three-part-token": r"[A-Za-z0-9_-]{32,}\.[A-Za-z0-9_-]{32,}\.[A-Za-z0-9_-]{32,}",
}
# Words that tell the two languages of an interface apart.
ENGLISH_WORDS = ["create", "map", "match", "upload", "export", "save", "open", "fix", "continue", "cancel"]
INDONESIAN_WORDS = ["dan", "yang", "untuk", "dari", "dengan", "tidak", "pilih", "wilayah", "peta", "proyek"]

_DROPPED = [r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"(?s)<!--.*?-->"]


def _word(words: list[str]) -> str:
    return rf"(?i)(?<![A-Za-z0-9_])({'|'.join(words)})(?![A-Za-z0-9_])"


def _without_blocks(html, replacement: str) -> Column:
    value = text.text_of(html)
    for pattern in _DROPPED:
        value = F.regexp_replace(value, pattern, replacement)
    return value


def visible_text(html) -> Column:
    """Text of a page: no scripts, styles, comments, tags or entities; blanks squeezed."""
    bare = F.regexp_replace(F.regexp_replace(_without_blocks(html, " "), r"<[^>]+>", " "), r"(?i)&[a-z0-9#]+;", " ")
    return text.squeeze(bare)


def text_nodes(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, position, value) of the text nodes; template markers are left out."""
    nodes = F.regexp_extract_all(_without_blocks(html, ""), F.lit(r">([^<>]+)<"), F.lit(1))
    kept = F.filter(F.transform(nodes, text.squeeze), lambda v: (v != "") & ~v.rlike(r"\A(\{\{|\$\{)"))
    return pages.select(key, F.posexplode(kept).alias("position", "value"))


def attributes(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, attribute, value) of the readable attributes."""
    pattern = F.lit(r'(?i)(?<![A-Za-z0-9_])(aria-label|placeholder|title|alt|value)="([^"]*)"')
    found = F.arrays_zip(
        F.regexp_extract_all(html, pattern, F.lit(1)).alias("attribute"), F.regexp_extract_all(html, pattern, F.lit(2)).alias("value")
    )
    listed = pages.select(key, F.inline(found)).withColumn("value", text.squeeze("value"))
    return listed.filter("value <> ''")


def references(pages: DataFrame, key: str, html: str, names: tuple[str, ...] = ("href", "src"), keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, attribute, target) of href and src, with further page columns."""
    def listed(name: str) -> Column:
        values = F.regexp_extract_all(html, F.lit(rf"""(?i){name}=["']([^"']+)["']"""), F.lit(1))
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("attribute"), v.alias("target")))

    found = F.concat(*[listed(name) for name in names])
    return pages.select(key, *keep, F.inline(found))


def banned(docs: DataFrame, key: str, visible, phrases: list[str]) -> DataFrame:
    """(key, phrase) for every phrase of a fixed list that a text holds, any case."""
    lowered = F.lower(visible)
    hits = F.array_compact(F.array(*[F.when(lowered.contains(p.lower()), p) for p in phrases]))
    return docs.select(key, F.explode(hits).alias("phrase"))


def mixed_language(
    docs: DataFrame, key: str, visible, first: list[str], second: list[str], most: int | None = None, length: int | None = None
) -> DataFrame:
    """(key, position, sentence): sentences with a word of either list.

    most and length cut the sentences of a page and their characters, for short reports.
    """
    both = F.filter(F.split(visible, "[.!?]"), lambda s: s.rlike(_word(first)) & s.rlike(_word(second)))
    shown = both if most is None else F.slice(both, 1, most)
    shown = F.transform(shown, lambda s: text.trim(s) if length is None else F.substring(text.trim(s), 1, length))
    return docs.select(key, F.posexplode(shown).alias("position", "sentence"))


#: Hits of a line that are placed from one another; longer lines are placed stretch by stretch.
STRETCH = 64


def _with(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sums(numbers: Column) -> Column:
    """For each of an array's numbers the sum of those before it; the arrays kept by callers are short."""

    def step(done: Column, n: Column) -> Column:
        return F.struct((done["total"] + n).alias("total"), F.array_append(done["sums"], done["total"]).alias("sums"))

    start = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("sums"))
    return F.aggregate(numbers, start, step, lambda done: done["sums"])


def _before(sizes: Column) -> Column:
    """Like _sums for arrays of any length: within stretches, then over the stretches, so that growing an array stays cheap."""

    def of_stretches(stretches: Column) -> Column:
        totals = F.transform(stretches, lambda part: F.aggregate(part, F.lit(0), lambda total, n: total + n))
        return F.flatten(
            F.zip_with(stretches, _sums(totals), lambda part, base: F.transform(_sums(part), lambda n: n + base))
        )

    def cut(all_sizes: Column) -> Column:
        last = F.floor((F.size(all_sizes) - 1) / STRETCH).cast("int")
        starts = F.when(F.size(all_sizes) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.slice(all_sizes, i * STRETCH + 1, F.lit(STRETCH)))

    return _with(_with(sizes, cut), of_stretches)


def tokens(docs: DataFrame, key: str, body: str, patterns: dict[str, str]) -> DataFrame:
    """(key, line, column, code, match) of every regex hit, lines and columns from 1."""
    lines = docs.select(key, F.posexplode(F.split(body, "\r?\n")).alias("_i", "_line"))

    def placed(code: str, pattern: str) -> Column:
        # The text between the hits and the hits themselves, by turns, give the places.
        def columns(parts: Column) -> Column:
            gaps = F.transform(parts, lambda part: F.char_length(part["gap"]))
            both = F.transform(parts, lambda part: F.char_length(part["gap"]) + F.char_length(part["hit"]))
            starts = F.zip_with(gaps, _before(both), lambda gap, before: gap + before + 1)
            return F.zip_with(starts, parts, lambda column, part: F.struct(
                column.alias("column"), F.lit(code).alias("code"), part["hit"].alias("match")
            ))

        def parted(hits: Column) -> Column:
            gaps = F.split("_line", pattern, -1)
            return F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"))

        none = F.array().cast("array<struct<column:int,code:string,match:string>>")
        hits = F.regexp_extract_all("_line", F.lit(pattern), F.lit(0))
        return F.when(F.col("_line").rlike(pattern), _with(_with(hits, parted), columns)).otherwise(none)

    every = F.concat(*[placed(code, pattern) for code, pattern in patterns.items()])
    return lines.select(key, (F.col("_i") + 1).alias("line"), F.inline(every))


def with_allowance(found: DataFrame, key: str, allowed: DataFrame) -> DataFrame:
    """Hits with their allow-list reason (key, code, reason); the others are failures."""
    joined = lookup_join(found, allowed, [key, "code"], "left", spread=[key, "line", "column"])
    return joined.withColumn("verdict", F.when(F.col("reason").isNull(), "failure").otherwise("allowed"))


def roll_up(found: DataFrame, by: list[str]) -> DataFrame:
    return found.groupBy(*by).agg(F.count("*").alias("occurrences"))


def in_failure_order(found: DataFrame, key: str) -> DataFrame:
    return found.orderBy(key, "line", "column", "code")


def secrets(docs: DataFrame, key: str, body: str, token_names: list[str], max_bytes: int | None = None) -> DataFrame:
    """(key, kind) of possible secrets; token_names are assignments to look for.

    With max_bytes, a longer text has the one kind 'not-scanned'.
    """
    patterns = {f"assignment:{n}": rf"(?i){n}\s*=\s*['\"][^'\"]+" for n in token_names} | SECRET_PATTERNS
    kinds = F.array_compact(F.array(*[F.when(F.col(body).rlike(p), k) for k, p in patterns.items()]))
    if max_bytes is not None:
        kinds = F.when(F.octet_length(body) > max_bytes, F.array(F.lit("not-scanned"))).otherwise(kinds)
    return docs.select(key, F.explode(kinds).alias("kind"))


def _without_query(url) -> Column:
    return F.regexp_replace(url, r"[?#].*\z", "")


def _folder(url) -> Column:
    return F.regexp_replace(_without_query(url), r"[^/]*\z", "")


def links(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """(key, attribute, target, verdict): ok, placeholder, foreign-scheme or broken.

    A relative target is resolved against its page and looked up among the pages.
    """
    located = references(pages.withColumn("_page", F.col(url)), key, html, keep=("_page",))
    target = _without_query(F.col("target"))
    origin = F.regexp_extract("_page", r"\A([a-z]+://[^/]+)", 1)
    resolved = F.when(target.startswith("/"), F.concat(origin, target)).otherwise(F.concat(_folder(F.col("_page")), target))
    own = F.col("target").startswith(origin)
    located = located.withColumns({"_resolved": F.when(own, target).otherwise(resolved), "_own": own})
    known = pages.select(_without_query(F.col(url)).alias("_resolved"), F.lit(True).alias("_known")).distinct()
    checked = lookup_join(located, known, ["_resolved"], "left", spread=[key, "target"])
    verdict = (
        F.when((F.col("attribute") == "href") & (F.col("target") == "#"), "placeholder")
        .when(F.col("target").rlike(r"\A(#|mailto:|tel:)"), "ok")
        .when(~F.col("_own") & F.col("target").rlike(r"(?i)\A[a-z]+:"), "foreign-scheme")
        .when(F.col("_known") | (target == ""), "ok")
        .otherwise("broken")
    )
    return checked.select(key, "attribute", "target", verdict.alias("verdict"))


def page_rules(pages: DataFrame, key: str, html: str, lang: str, forbidden: list[str]) -> DataFrame:
    """Boolean rule columns per page, true where the page passes."""
    page, held = F.col(html), F.lit(False)
    for asset in forbidden:
        held = held | page.contains(asset)
    rules = {
        "lang": page.rlike(rf'(?i)<html\s+lang="{lang}"'),
        "main": page.rlike(r"(?i)<main[\s>]"),
        "canonical": page.rlike(r'(?i)<link rel="canonical" href="https?://[^"]+"'),
        "no_form": ~page.rlike(r"(?i)<form[\s>]"),
        "indexed": ~page.rlike(r'(?i)<meta name="robots"[^>]*noindex'),
        "no_forbidden": ~held,
    }
    return pages.select(key, *[rule.alias(name) for name, rule in rules.items()])


def urls(docs: DataFrame, body: str, ignored: list[str] = ()) -> DataFrame:
    """Distinct external URLs."""
    found = docs.select(F.explode(F.regexp_extract_all(body, F.lit(r"""(https?://[^"'\s)]+)"""), F.lit(1))).alias("url"))
    return found.filter(~F.col("url").isin(list(ignored))).distinct() if ignored else found.distinct()


def missing_terms(required: DataFrame, terms: DataFrame) -> DataFrame:
    """Required terms (term) that the glossary (term) does not govern."""
    return required.select("term").join(terms.select("term").distinct(), "term", "left_anti")

