"""Suffix dedup by distributed prefix doubling: the same result as suffix_dedup.py, from ranks of all positions.

1. Every position of a text gives a pair of numbers: its next 8 bytes, and the 8 after those.
2. Spark counts equal pairs, drops those that one document alone has (no longer string there can be shared), and sorts the
   others; their numbers in that order are the ranks of 16-byte prefixes.
3. A position's rank and the rank at offset 16 make the pair for 32 bytes, then at offset 18 the pair for 50 bytes.
   That is the threshold, where doubling ends, or earlier, when no pair is shared any more.

Every byte is a row in step 1, so far more than the input is shuffled; see the README for figures.  Rows of hot pairs (a
line of blanks) meet a broadcast table of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.common import join_counted, keep, pack, ship

LENGTH, FIRST = 50, 16
#: (bytes that a rank stands for, offset of the second rank): 16 -> 32 -> 50 bytes.
ROUNDS = [(16, 16), (32, LENGTH - 32)]
KEY = ["id", "t"]
#: Positions that a task hands over at once.
PIECE = 1 << 18


def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, t, pos, a, b): 8 bytes and 8 bytes from each position on, as far as 16 bytes are left."""
    for batch in batches:
        for i, t, text in zip(*(batch.column(c) for c in ("id", "t", "text")), strict=True):
            data = np.frombuffer(text.as_py().encode(), "u1")
            for start in range(0, len(data) - FIRST + 1, PIECE):
                part = data[start : start + PIECE + FIRST - 1]
                words = np.lib.stride_tricks.sliding_window_view(part, 8)
                words = np.ascontiguousarray(words).view(">i8").ravel().astype("i8")
                n = len(part) - FIRST + 1
                yield pa.record_batch([pa.repeat(i, n), pa.repeat(t, n), pa.array(np.arange(start, start + n, dtype="i4")), pa.array(words[:n]), pa.array(words[8 : 8 + n])], names=[*KEY, "pos", "a", "b"])


def shared(pairs: DataFrame) -> DataFrame:
    """(a, b, n, first_id, rank) of the pairs that several documents have; ranks follow the order of the pairs."""
    groups = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    # written at once: ranks are numbers within sorted ranges, and are to be drawn only once
    return keep(groups.where("first_id < last_id").drop("last_id").orderBy("a", "b").withColumn("rank", F.monotonically_increasing_id()))


def later_starts(docs: DataFrame) -> DataFrame:
    """(id, t, pos) of the LENGTH-byte strings that also start in a document with a smaller id; docs: (id, t, text)."""
    long = docs.where(F.octet_length("text") >= LENGTH).distinct()
    pairs = keep(long.mapInArrow(positions, "id long, t long, pos int, a long, b long"))
    groups = shared(pairs)
    for _, offset in ROUNDS:
        ranked = keep(join_counted(pairs, groups, ["a", "b"]).select(*KEY, "pos", "rank"))
        behind = ranked.select(*KEY, (F.col("pos") - offset).alias("pos"), F.col("rank").alias("b"))
        pairs = keep(ranked.withColumnRenamed("rank", "a").join(behind, [*KEY, "pos"]))
        groups = shared(pairs)
    return join_counted(pairs, groups, ["a", "b"]).where("id > first_id").select(*KEY, "pos")


def spans_of(starts: DataFrame) -> DataFrame:
    """(id, t, spans): the maximal runs of bytes that the strings cover, in order."""
    along = Window.partitionBy(*KEY).orderBy("pos")
    gap = F.col("pos") - F.lag("pos").over(along) > LENGTH
    runs = starts.withColumn("gap", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("run", F.sum("gap").over(along))
    spans = runs.groupBy(*KEY, "run").agg(F.min("pos").cast("long").alias("start"), (F.max("pos") + LENGTH).cast("long").alias("stop"))
    return spans.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def cut_by_ranks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, n_bytes, spans, kept), as ``suffix_dedup.cut_repeated_bytes`` gives.

    Null and empty texts: no bytes, nothing removed.  Documents of fewer than 50 bytes stay whole.  A null id counts as
    one document that comes last.  Rows that share an id are one document to each other and don't match; each keeps its
    own row.  Empty table: empty result.
    """
    ship(docs.sparkSession)
    rows = pack(docs, id_col, text_col).withColumn("t", F.xxhash64("text"))
    found = rows.join(spans_of(later_starts(rows.select(*KEY, "text"))), KEY, "left")
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    data, spans, n = F.col("text").cast("binary"), F.col("spans"), F.octet_length("text").cast("long")
    edges = found.withColumn("spans", F.coalesce("spans", none)).withColumn("data", data)
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s.stop))
    ends = F.concat(F.transform(spans, lambda s: s.start), F.array(n))
    pieces = F.transform(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda e: F.hex(F.substring("data", (e.a + 1).cast("int"), (e.b - e.a).cast("int"))))
    return edges.select("row", n.alias("n_bytes"), "spans", F.unhex(F.array_join(pieces, "")).alias("kept"))
