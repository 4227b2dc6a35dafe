r"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences.

Sections are parted by blank lines, paragraphs by line ends; a paragraph's leaves
are its sentences, and sentences longer than LEAF_CHARS are cut. Every node hashes
its children in order, leaves hash their text with the signs that part them, so
roots are equal exactly if texts are. The fingerprint is the root. Trees that
differ are walked from the roots: equal branches are passed over, the differing
ones locate an edit. Likeness is the share of text in leaves that both trees have.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from areal.plans.sizing import checkpoint

LEAF_CHARS = 32
FIRST, LAST = 0, 1
SECTION = re.compile(r"(?:[^\n]|\n(?!\n))*\n*")
PARAGRAPH = re.compile(r"[^\n]*\n+|[^\n]+")
SENTENCE = re.compile(rf"[^.\n]{{0,{LEAF_CHARS}}}(?:[.\n]+|(?<=[^.\n])) ?")


@dataclass(frozen=True)
class Tree:
    """Nodes of a text: the root, and for each section its hash and paragraphs, each a hash and leaves."""

    root: str
    sections: list[tuple[bytes, list[tuple[bytes, list[tuple[bytes, int]]]]]]

    def leaves(self) -> Counter:
        """Characters in the leaves of each hash."""
        found: Counter = Counter()
        for _, paragraphs in self.sections:
            for _, leaves in paragraphs:
                for name, size in leaves:
                    found[name] += size
        return found


def _node(kind: bytes, children: list[bytes]) -> bytes:
    return hashlib.sha256(kind + b"".join(children)).digest()


def tree_of(text: str | None, known: dict[str, bytes] | None = None) -> Tree:
    """The tree of a whole text; null counts as empty. known takes and gives the hashes of leaves seen before."""
    sections, known = [], {} if known is None else known

    for part in SECTION.findall(text or ""):
        paragraphs = []
        for line in PARAGRAPH.findall(part):
            leaves = []
            for said in SENTENCE.findall(line):
                if said:
                    if (name := known.get(said)) is None:
                        name = known[said] = hashlib.blake2b(said.encode(), digest_size=16).digest()
                    leaves.append((name, len(said)))
            paragraphs.append((_node(b"p", [name for name, _ in leaves]), leaves))
        if paragraphs:
            sections.append((_node(b"s", [name for name, _ in paragraphs]), paragraphs))
    return Tree(_node(b"r", [name for name, _ in sections]).hex(), sections)


def likeness(a: Tree, b: Tree) -> float:
    """Share of the characters of both texts that lie in common leaves: 1 for equal roots, 0 for nothing in common."""
    if a.root == b.root:
        return 1.0
    mine, other = a.leaves(), b.leaves()
    whole = mine.total() + other.total()
    return 2 * (mine & other).total() / whole if whole else 1.0


def edited_paragraphs(a: Tree, b: Tree) -> list[int]:
    """Places (from 0, over all sections) of the paragraphs of a that b has not.

    Walks from the roots and passes over sections whose hashes b has as well.
    """
    if a.root == b.root:
        return []
    known = {name for name, _ in b.sections}
    there = Counter(name for _, paragraphs in b.sections for name, _ in paragraphs)
    found, place = [], 0
    for name, paragraphs in a.sections:
        for i, (paragraph, _) in enumerate(paragraphs):
            if name not in known and not there[paragraph]:
                found.append(place + i)
        place += len(paragraphs)
    return found


def edit(text: str, following: str) -> str:
    """Text whose last quarter is replaced by as many characters from the beginning of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


RESULT = pa.schema(
    {
        "doc_id": pa.int64(),
        "n_chars": pa.int64(),
        "edited_sha256": pa.string(),
        "fingerprint": pa.string(),
        "edited_fingerprint": pa.string(),
        "near_edited": pa.float64(),
        "near_next": pa.float64(),
        "edited_paragraphs": pa.list_(pa.int32()),
    }
)
WALKED = pa.schema([*RESULT, ("tie", pa.int64()), ("border", pa.int32()), ("text", pa.string())])


def _compare(doc_id: int | None, text: str, tree: Tree, known: dict, following: str, next_tree: Tree) -> dict:
    edited = edit(text, following)
    other = tree_of(edited, known)
    return {
        "doc_id": doc_id,
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(),
        "fingerprint": tree.root,
        "edited_fingerprint": other.root,
        "near_edited": likeness(tree, other),
        "near_next": likeness(tree, next_tree),
        "edited_paragraphs": edited_paragraphs(tree, other),
    }


def _walk_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the documents of a range with their followers; hand out its first and last document with their texts."""
    last = None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            tree = tree_of(row["text"], known := {})
            if last is None:
                out.append(row | {"border": FIRST})
            else:
                out.append(_compare(last[0]["doc_id"], last[0]["text"], *last[1:], row["text"], tree))
            last = row, tree, known
        yield pa.RecordBatch.from_pylist(out, WALKED)
    if last is not None:
        yield pa.RecordBatch.from_pylist([last[0] | {"border": LAST}], WALKED)


def _walk_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the last document of each range with the first one of the next, that of the last with the very first."""
    begin = last = None
    for batch in batches:
        for row in batch.to_pylist():
            if row["border"] == LAST:
                last = row
                continue
            begin = begin or row
            if last is not None:
                yield pa.RecordBatch.from_pylist([_meet(last, row)], RESULT)
    if last is not None:
        yield pa.RecordBatch.from_pylist([_meet(last, begin)], RESULT)


def _meet(last: dict, first: dict) -> dict:
    tree = tree_of(last["text"], known := {})
    return _compare(last["doc_id"], last["text"], tree, known, first["text"], tree_of(first["text"]))


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text, of its edited text, and their likeness, by ascending doc_id.

    Returns the columns of RESULT. The following document of the last one is the
    first. A null text counts as empty; a null doc_id comes first; rows of one
    doc_id are ordered by a hash of their text and count as documents of their own.
    Other columns are not read; an empty table gives no rows.

    Spark deals the documents into ranges of ids, ordered within; a task walks its
    range with two trees in hand. Each text is shuffled once. What is left are the
    borders, two documents for each range, which one task walks in order.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.xxhash64("text").alias("tie"),
    )
    ranged = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    walked = checkpoint(ranged.mapInArrow(_walk_range, from_arrow_schema(WALKED)))
    borders = walked.filter(F.col("border").isNotNull()).select("doc_id", "tie", "border", "text")
    met = borders.coalesce(1).sortWithinPartitions("doc_id", "tie", "border").mapInArrow(_walk_borders, from_arrow_schema(RESULT))
    return walked.filter(F.col("border").isNull()).select(*RESULT.names).unionByName(met)
