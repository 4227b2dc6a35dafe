r"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of a formatted conversation:

    conversation := turn*
    turn         := "<s>" role "\n" text "</s>"            under the loss mask (role assistant)
                  | "[INST]" role "\n" text "[/INST]"      any other role

A deterministic parser reads a rendered conversation back. A conversation whose
parsed turns differ from its source is rendered again with its conflicting
content escaped: within each control string, however many backslashes follow its
first character, one more is put there ("[INST]" becomes "[\INST]", "[\INST]"
becomes "[\\INST]"). Parsing takes one backslash away, so the round trip is exact
for every text, and content without conflict stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOSS_ROLE = "assistant"
LOSS_OPEN, LOSS_CLOSE = "<s>", "</s>"
OPEN, CLOSE = "[INST]", "[/INST]"


def escape(text: Column) -> Column:
    """Put one more backslash into each control string; texts without any are unchanged."""
    text = F.regexp_replace(text, r"(\[\\*)(/?INST\])", r"$1\\$2")
    return F.regexp_replace(text, r"(<\\*)(/?s>)", r"$1\\$2")


def unescape(text: Column) -> Column:
    """Undo escape."""
    text = F.regexp_replace(text, r"(\[\\*)\\(/?INST\])", "$1$2")
    return F.regexp_replace(text, r"(<\\*)\\(/?s>)", "$1$2")


def _pack_role(role: Column) -> Column:
    """A role on one line: a backslash becomes \\-, a line end becomes \\n."""
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\-")), F.lit("\n"), F.lit("\\n"))


def _unpack_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\-"), F.lit("\\"))


def render(turns: Column, escaped: bool) -> Column:
    """Text of an array of (role, text) by the grammar; escaped: with conflicting content escaped."""

    def one(turn: Column) -> Column:
        content = [_pack_role(turn["role"]), turn["text"]]
        role, text = [escape(c) for c in content] if escaped else content
        loss = turn["role"] == LOSS_ROLE
        return F.concat(
            F.when(loss, LOSS_OPEN).otherwise(OPEN), role, F.lit("\n"), text, F.when(loss, LOSS_CLOSE).otherwise(CLOSE)
        )

    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """Read a formatted conversation back: an array of (role, text, loss).

    A piece that does not begin with an opening marker, or holds a further one, has a null role.
    """
    pieces = F.split(formatted, r"\[/INST\]|</s>", -1)

    def one(piece: Column) -> Column:
        loss = piece.startswith(LOSS_OPEN)
        body = F.substr(piece, F.when(loss, len(LOSS_OPEN) + 1).otherwise(len(OPEN) + 1))
        known = (loss | piece.startswith(OPEN)) & ~body.contains(LOSS_OPEN) & ~body.contains(OPEN)
        head = F.substring_index(body, "\n", 1)
        return F.struct(
            F.when(known, _unpack_role(unescape(head))).alias("role"),
            unescape(F.substr(body, F.length(head) + 2)).alias("text"),
            loss.alias("loss"),
        )

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), one)


def gather(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation as an array of (role, text), by turn.

    A null role or text counts as empty. Rows of one conversation with equal turn
    numbers are ordered by role and text, null turn numbers come first, and
    repeated rows stay. Rows with a null conv_id are one conversation. A
    conversation is one output text, so its rows meet in one group.
    """
    turn = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_rows"))
    return rows.select(
        "conv_id",
        F.transform("_rows", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"),
    )


def _same(parsed: Column, turns: Column) -> Column:
    return F.transform(parsed, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))) == turns


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns, formatted, escaped, identical) for each conversation.

    Every conversation is rendered as it is and parsed; only where the parsed turns
    differ from the source is it escaped, rendered and parsed once more. escaped
    tells which rendering was taken; identical is the outcome of the last
    comparison. Empty tables give no rows; other columns are not read.
    """
    plain = gather(conversations).withColumn("_plain", render(F.col("turns"), escaped=False))
    tried = plain.withColumn("escaped", ~F.coalesce(_same(parse(F.col("_plain")), F.col("turns")), F.lit(False)))
    formatted = tried.withColumn(
        "formatted", F.when(F.col("escaped"), render(F.col("turns"), escaped=True)).otherwise(F.col("_plain"))
    )
    return formatted.select(
        "conv_id",
        "turns",
        "formatted",
        "escaped",
        (~F.col("escaped") | _same(parse(F.col("formatted")), F.col("turns"))).alias("identical"),
    )


def loss_text(parsed: Column) -> Column:
    """All text under the loss mask of a parsed conversation, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(parsed, lambda t: t["loss"]), lambda t: t["text"]), "")


def digest(formatted: DataFrame) -> DataFrame:
    """What a reader of the formatted texts gets back, per conversation."""
    read = formatted.withColumn("_read", parse(F.col("formatted")))
    said = F.array_join(F.transform("_read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("_read").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss_text(F.col("_read"))).cast("long").alias("loss_chars"),
        F.sha2(loss_text(F.col("_read")).cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
