"""Registered queries: one per operator, over the whole of its table, and their SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areal.llm import (
    alignment,
    bpe,
    chat,
    decontamination,
    distinct_bpe,
    fingerprints,
    jaccard_join,
    line_dedup,
    periodic,
    pii,
    quality,
    sharding,
    toxicity,
)
from areal.llm.common import fold, table
from areal.plans.sizing import checkpoint, literal_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path() -> str:
    """The vocabulary file of op10 and the pipeline."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, oracle: str | None = None) -> Callable:
    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return add


@query("op1_toxicity_kneser_ney")
def toxicity_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 5) == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~held_out), "toxic")
    scored = docs.select("doc_id", toxicity.score_of(docs, model).alias("score"))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query("op2_merkle_fingerprints")
def merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.compare_neighbours(table(spark, sf_dir, "documents"))
    return found.withColumn("edited_paragraphs", F.array_join("edited_paragraphs", ","))


@query("op3_pii_boosted_spans")
def pii_boosted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", pii.spans_of(docs, pii.fit(docs)).alias("found"))
    count = lambda kind: F.size(F.filter("found.base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(pii.listed(F.col("found.base")).cast("binary"), 256).alias("base_sha256"),
        pii.listed(F.col("found.spans")).alias("spans"),
    )


@query("op4_ngram_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.near_copies(table(spark, sf_dir, "documents"))
    return found.select(
        jaccard_join.id_of("_place").alias("doc_id"),
        jaccard_join.id_of("class_place").alias("class_id"),
        "n_links",
        "n_copies",
    )


@query("op5_line_dedup_winnowing")
def line_dedup_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.dedup_lines(docs, detail=True)
    return found.withColumns({c: F.array_join(c, ",") for c in ("removed_lines", "copied_from")})


@query(
    "op6_decontamination",
    r"""
    WITH doc_words AS (
        SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w
        FROM documents
    ), item_words AS (
        SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w
        FROM benchmark
    ), doc_shingles AS (
        SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM doc_words WHERE len(w) > 0)
    ), item_shingles AS (
        SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS shingle
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)
    ), sizes AS (
        SELECT item_id, count(*) AS n_shingles FROM item_shingles GROUP BY item_id
    ), shared AS (
        SELECT doc_id, item_id, count(*) AS n_shared FROM doc_shingles JOIN item_shingles USING (shingle) GROUP BY ALL
    )
    SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
    FROM shared JOIN sizes USING (item_id)
    WHERE n_shared >= 0.8 * n_shingles - 1e-9
    """,
)
def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_shared", "containment")


@query(
    "op7_chat_round_trip",
    r"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL
        SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
    ), escaped AS (
        SELECT *, replace(replace(role, '\', '\-'), chr(10), '\n') || text AS content FROM turns
    ), sized AS (
        SELECT *,
               length(content) + len(regexp_extract_all(content, '\[\\*/?INST\]')) + len(regexp_extract_all(content, '<\\*/?s>'))
               + CASE WHEN role = 'assistant' THEN 8 ELSE 14 END AS size
        FROM escaped
    )
    SELECT conv_id,
           count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(size) AS BIGINT) AS formatted_chars
    FROM sized GROUP BY conv_id
    """,
)
def chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    hard = literal_table(spark, ["conv_id", "turn", "role", "text"], [(-7, 0, "user", said), (-7, 1, "assistant", said)])
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    return chat.digest(chat.format_conversations(rows))


@query("op8_quality_discriminant")
def quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 3) == 1
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # the statistics are short rows, made once and read by the fit and by the scores
    described = checkpoint(docs.select("doc_id", quality.features_of(F.col("text")).alias("features")))
    model = quality.fit_labelled(described, table(spark, sf_dir, "labels").filter(~held_out), "quality")
    scored = described.select("doc_id", quality.score_of(F.col("features"), model).alias("score"))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query("op9_two_pass_shuffle")
def two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit("")).cast("binary")
    return sharding.shuffle_into_shards(docs).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op10_bpe_round_trip")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = docs.select("doc_id", bpe.round_trip_of(docs, tokenizer_path()).alias("coded"))
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("coded.ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("coded.ids", 256).alias("ids_sha256"),
        F.sha2(F.col("coded.text").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op11_cross_tokenizer_alignment")
def cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    aligned = alignment.align(docs, *paths, public_tokenizers.PATTERN, digest=True)
    return aligned.withColumnRenamed("groups", "groups_sha256")


@query("op12_distinct_word_bpe")
def distinct_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = distinct_bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True)
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op13_periodic_runs")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic.find_runs(docs.withColumn("text", periodic.planted(F.col("doc_id"), F.col("text"))))
    runs = F.col("runs")
    ahead = lambda best, run: F.when(run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best)
    found = found.withColumn("top", F.aggregate(runs, F.get(runs, F.lit(0)), ahead))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    return found.select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        *[F.col(f"top.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * top.length) div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(runs, line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
