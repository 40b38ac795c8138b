"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces of a text.

A section ends behind a blank line, a paragraph behind a line feed, a piece
behind 64 characters of its paragraph; together the pieces are the text, character for character.
A node's hash is SHA-256 over its kind and its children's hashes, so equal roots mean equal
texts and different branches lead to the edits.  A fingerprint is the
root in full and the branches below it, shortened::

    root;section,paragraph.piece.piece,paragraph.piece;section,...

`likeness` is the share of pieces two fingerprints have in common (twice the common
ones over all, each piece once; 1 if neither has any) and `differences` names the
branches that only one of them has.  An empty text has a root and no branches; null is empty.

`edits` compares every document with an edited copy of itself and with the document that
follows by id.  Rows without an id are left out and rows that repeat an id and a text are one document;
different texts under one id follow each other in the order of their hashes.
Only DataFrame functions are used.  Texts are shuffled once, to meet the beginning and the pieces of
the next text; ids are numbered over ranges, not in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.tables import texts
from pagescan.operators.ranking import numbered
from pagescan.storage import Workspace

PIECE = 64
ROOT, SECTION, PARAGRAPH, LEAF = 64, 16, 12, 8  # hexadecimal digits kept


def _parts(text: Column, behind: str) -> Column:
    return F.filter(F.split(text, behind, -1), lambda part: part != "")


def _hash(kind: str, children: Column) -> Column:
    return F.sha2(F.concat(F.lit(kind), F.array_join(children, "")), 256)


def _paragraph(paragraph: Column) -> Column:
    pieces = F.transform(
        F.regexp_extract_all(paragraph, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda piece: F.sha2(piece, 256)
    )
    one = F.transform(
        F.array(pieces),
        lambda p: F.struct(
            _hash("p", p).alias("hash"), F.array_join(F.transform(p, lambda h: F.concat(F.lit("."), F.left(h, F.lit(LEAF)))), "").alias("leaves")
        ),
    )
    return F.element_at(one, 1)


def _section(section: Column) -> Column:
    # A blank line ends the section, so every paragraph keeps its own line feed.
    one = F.transform(
        F.array(F.transform(_parts(section, r"(?<=\n)"), _paragraph)),
        lambda p: F.struct(
            _hash("s", F.transform(p, lambda x: x["hash"])).alias("hash"),
            F.array_join(F.transform(p, lambda x: F.concat(F.lit(","), F.left(x["hash"], F.lit(PARAGRAPH)), x["leaves"])), "").alias("branches"),
        ),
    )
    return F.element_at(one, 1)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text (null: empty)."""
    sections = F.transform(_parts(F.coalesce(text, F.lit("")), r"(?<=\n\n)(?!\n)"), _section)
    one = F.transform(
        F.array(sections),
        lambda s: F.concat(
            _hash("r", F.transform(s, lambda x: x["hash"])),
            F.array_join(F.transform(s, lambda x: F.concat(F.lit(";"), F.left(x["hash"], F.lit(SECTION)), x["branches"])), ""),
        ),
    )
    return F.element_at(one, 1)


def root(mark: Column) -> Column:
    return F.left(mark, F.lit(ROOT))


def pieces(mark: Column) -> Column:
    """The distinct pieces of a fingerprint."""
    return F.array_distinct(F.regexp_extract_all(mark, F.lit(rf"\.([0-9a-f]{{{LEAF}}})"), F.lit(1)))


def _alike(left: Column, right: Column) -> Column:
    both = F.size(left) + F.size(right)
    return F.when(both == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(left, right)) / both)


def likeness(left: Column, right: Column) -> Column:
    """0 to 1: the share of pieces in common."""
    return _alike(pieces(left), pieces(right))


def differences(left: Column, right: Column) -> Column:
    """The paragraphs of the left fingerprint, numbered from 0, that the right one lacks.

    Equal roots are answered without a look at the branches.
    """
    def paragraphs(mark: Column) -> Column:
        return F.regexp_extract_all(mark, F.lit(rf",([0-9a-f]{{{PARAGRAPH}}})"), F.lit(1))

    other = paragraphs(right)
    numbered_ = F.transform(paragraphs(left), lambda p, i: F.when(~F.array_contains(other, p), i))
    return F.when(root(left) == root(right), F.array().cast("array<int>")).otherwise(F.filter(numbered_, lambda i: i.isNotNull()))


def _places(rows: DataFrame) -> DataFrame:
    """doc_id, version, next_id, next_version and, as asked by the row before, prior_id, prior_version, prior_half."""
    work = Workspace(rows.sparkSession, "places")
    slim = rows.groupBy("doc_id", "version").agg(F.max(F.length("text")).cast("bigint").alias("n"))
    ordered = work.write(numbered(slim, ["doc_id", "version"]), "ordered")
    last = ordered.agg(F.max("ordinal")).first()[0] or 1
    prior = ordered.select(
        (F.col("ordinal") % F.lit(last) + 1).alias("ordinal"),
        F.col("doc_id").alias("prior_id"), F.col("version").alias("prior_version"),
        F.floor(F.col("n") / 2).cast("int").alias("prior_half"),
    )
    return work.write(ordered.join(prior, "ordinal").drop("ordinal", "n"), "places")


def edits(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next of each document.

    The edited text has its last half replaced by as many first characters of the next
    document by id; the first document follows the last.
    """
    rows = texts(docs, id_column, text_column).withColumn("version", F.xxhash64("text"))
    base = rows.dropDuplicates(["doc_id", "version"]).withColumn("fingerprint", fingerprint(F.col("text")))
    asked = base.join(_places(rows), ["doc_id", "version"]).select(
        F.col("prior_id").alias("doc_id"), F.col("prior_version").alias("version"),
        F.left("text", F.col("prior_half")).alias("beginning"), pieces(F.col("fingerprint")).alias("next_pieces"),
    )
    n = F.length("text")
    joined = base.join(asked, ["doc_id", "version"]).select(
        "doc_id", n.cast("bigint").alias("n_chars"), "fingerprint", "next_pieces",
        F.concat(F.left("text", n - F.floor(n / 2).cast("int")), "beginning").alias("edited_text"),
    )
    marked = joined.withColumn("edited_fingerprint", fingerprint(F.col("edited_text"))).withColumn("own", pieces(F.col("fingerprint")))
    return marked.select(
        "doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint",
        _alike(F.col("own"), pieces(F.col("edited_fingerprint"))).alias("near_edited"),
        _alike(F.col("own"), F.col("next_pieces")).alias("near_next"),
    )
