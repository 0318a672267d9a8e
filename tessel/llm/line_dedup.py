"""Line dedup: a line that many documents hold stays in one of them only.

DataFrame functions alone: explode the normalised lines, hash them, count the distinct documents of each hash, and put
the surviving lines together by position.  Only hashes and positions are shuffled by line; a text is shuffled once,
by its own document.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import content_key, field, join_counted, keep, pack

BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """A-Z only; ``lower`` does the same wherever all characters are ASCII, and is much faster."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def mark_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2
) -> DataFrame:
    """(row, lines, dropped): each input row, its lines, and the positions of those that go.

    A line's key is the line without surrounding ASCII white space, A-Z in lower case.  Keys of at least ``min_chars``
    code points found in at least ``min_docs`` documents lose all their lines but those of the smallest id.

    Null or empty text: one empty line, which is too short to go.  Null ids: one document that comes last.  Rows that
    share an id are one document for the count, and each keeps or loses its own lines.  Empty table: empty result.
    """
    packed = pack(docs, id_col, text_col).withColumn("lines", F.split("text", "\n"))
    t1, t2 = content_key("text")
    packed = packed.withColumns({"t1": t1, "t2": t2})

    def described(line: Column, pos: Column) -> Column:
        key = line_key(line)
        return F.struct(pos.alias("pos"), F.length(key).alias("chars"), *content_key(key))

    lines = keep(
        packed.select(
            "id", "t1", "t2", F.inline(F.filter(F.transform("lines", described), lambda x: x["chars"] >= min_chars))
        ).drop("chars")
    )
    # each document's lines are counted first: a line that a document has often is one row in the shuffle by line
    repeated = keep(
        lines.groupBy("k1", "k2", "id").agg(F.count("*").alias("lines"))
        .groupBy("k1", "k2")
        .agg(F.count("*").alias("docs"), F.min("id").alias("first_id"), F.sum("lines").alias("n"))
        .where(F.col("docs") >= min_docs)
        .select("k1", "k2", "first_id", "n")
    )
    dropped = (
        join_counted(lines, repeated, ["k1", "k2"])
        .where(F.col("id") != F.col("first_id"))
        .groupBy("id", "t1", "t2")
        .agg(F.collect_set("pos").alias("dropped"))
    )
    return packed.join(dropped, ["id", "t1", "t2"], "left").select(
        "row", "lines", F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped")
    )


def kept_text() -> Column:
    """The lines whose position isn't in ``dropped``, in order; linear in the number of lines."""
    positions = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    joined = F.array_join(F.transform(positions, lambda p: F.get("lines", p)), "\n")
    return F.when(F.size("dropped") == 0, F.array_join("lines", "\n")).otherwise(joined)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """The same rows and columns with the repeated lines taken out of the text; a null text stays null."""
    marked = mark_repeated_lines(docs, id_col, text_col, **rules).withColumn("kept", kept_text())
    return marked.select(
        *[
            F.when(field("row", c).isNotNull(), F.col("kept")).alias(c) if c == text_col else field("row", c).alias(c)
            for c in docs.columns
        ]
    )
