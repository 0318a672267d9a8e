"""Blocks of documents that exchange packed arrays with sorters.

Documents are dealt into blocks by a hash of id and text, and names (64-bit hashes of pieces of text) to sorters by the name.
A message is one row for a pair of block and sorter and holds a packed array, so Spark shuffles few rows of many numbers.
A block sends a name once, however often it has it: a hot piece of text costs a sorter one entry a block, and no task
gets all its occurrences.  The bytes of the input give the number of blocks, of BLOCK_BYTES each, and that of sorters, which is
an eighth of it; neither is below spark.sql.shuffle.partitions.  All exchanges are Spark's, in one plan, so a lost executor's part is computed again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import column, field, pack, partitions
from tessel.llm.text_arrays import U, trim

MESSAGE = "dest int, src int, kind int, data binary"
NAMES, SHARED_IN_BLOCK = range(2)
#: The kind of an answer with names that many blocks have.
HOT = 9


#: Bytes of text in a block, in expectation.
BLOCK_BYTES = 32_000_000


def layout(docs: DataFrame, text_col: str, blocks: int | None = None) -> tuple[int, int]:
    """How many blocks and sorters the texts need; with ``blocks`` given, as many of each."""
    if blocks:
        return blocks, blocks
    least = partitions(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(column(docs, text_col)))).first()[0] or 0
    return max(least, -(-int(total) // BLOCK_BYTES)), max(least, -(-int(total) // (8 * BLOCK_BYTES)))


def block_of(blocks: int) -> Column:
    """By id and text: rows without an id, or with one that many share, are spread like others; equal rows stay together."""
    return F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int").alias("block")


def into_blocks(docs: DataFrame, id_col: str, text_col: str, blocks: int, *more: Column) -> DataFrame:
    """(block, id, row, text, more): the only shuffle of the texts; row is a struct of the id as it was."""
    return (
        pack(docs, id_col, text_col)
        .select(
            block_of(blocks),
            "id",
            F.struct(field("row", id_col).alias(id_col)).alias("row"),
            F.col("text").cast("binary").alias("text"),
            *more,
        )
        .repartition(blocks, "block")
    )


class Block:
    """The documents of a block, in one array of bytes."""

    def __init__(self, table: pa.Table) -> None:
        trim()
        texts, ids = table["text"].to_pylist(), table["id"].to_pylist()
        # rows come from a shuffle in any order, and messages speak of places in the block: one order for every pass
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        texts = [texts[i] for i in order]
        self.order = np.array(order, "i8")
        self.rows = table["row"].take(pa.array(order, pa.int64()))
        self.ids = np.array([ids[i] for i in order], "i8")
        self.stops = np.cumsum([len(x) for x in texts])
        self.starts = self.stops - [len(x) for x in texts]
        self.data = np.frombuffer(b"".join(texts), "u1")


def place(names: np.ndarray, parts: int) -> np.ndarray:
    """Which sorter has a name (from other bits than the low 32, which are sent)."""
    return ((names >> U(32)) % U(parts)).astype("i8")


def short(names: np.ndarray, parts: int) -> np.ndarray:
    """Sorter and low 32 bits of a name as one number."""
    return place(names, parts).astype(U) << U(32) | (names & U(0xFFFFFFFF))


def messages(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    dest, src, kind, data = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table([pa.array(dest, pa.int32()), pa.array(src, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], ["dest", "src", "kind", "data"])


def heads_of(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, "i8")


def send_unique(names: np.ndarray, owners: np.ndarray, number: int, parts: int) -> pa.Table:
    """Each different name of the block once, as 32 bits; apart, those that more than one owner in the block has."""
    key = short(names, parts)
    order = np.lexsort((owners, key))
    key, owners = key[order], owners[order]
    heads = heads_of(key)
    if not len(heads):
        return messages([])
    lasts = np.append(heads[1:], len(key)) - 1
    own, several = key[heads], owners[heads] != owners[lasts]
    out = []
    for kind, some in ((NAMES, own[~several]), (SHARED_IN_BLOCK, own[several])):
        bounds = np.searchsorted(some >> U(32), np.arange(parts + 1).astype(U))
        low = (some & U(0xFFFFFFFF)).astype("<u4")
        out += [(p, number, kind, low[bounds[p] : bounds[p + 1]].tobytes()) for p in range(parts) if bounds[p] < bounds[p + 1]]
    return messages(out)


def sort_names(table: pa.Table) -> pa.Table:
    """``answer_names`` for all names alike; Spark would take a second argument for the table."""
    return answer_names(table)


def answer_names(table: pa.Table, hot_from: int | None = None) -> pa.Table:
    """Tell each block which of its names occur elsewhere too; 32 bits may let a few more pass, never fewer.

    With ``hot_from``, tell apart also which of them so many blocks or more have; all of these blocks hear the same.
    """
    sorter = table["dest"][0].as_py()
    rows = list(zip(*(table[c].to_pylist() for c in ("src", "kind", "data")), strict=True))
    passed = [(s, sorter, k, d) for s, k, d in rows if k not in (NAMES, SHARED_IN_BLOCK)]  # what a block tells itself
    sent = [(s, k, np.frombuffer(d, "<u4")) for s, k, d in rows if k in (NAMES, SHARED_IN_BLOCK)]
    if not sent:
        return messages(passed)
    everything = np.sort(np.concatenate([d for _, _, d in sent]))
    again = everything[1:][everything[1:] == everything[:-1]]
    shared = np.unique(np.concatenate([again, *(d for _, k, d in sent if k == SHARED_IN_BLOCK)]))
    answers = [(s, sorter, NAMES, own.tobytes()) for s, _, d in sent if len(own := d[among(d, shared)])]
    if hot_from:
        found, times = np.unique(everything, return_counts=True)
        answers += [(s, sorter, HOT, own.tobytes()) for s, _, d in sent if len(own := d[among(d, found[times >= hot_from])])]
    return messages(passed + answers)


def among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are in ``known``, which is sorted."""
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


def is_shared(names: np.ndarray, told: pa.Table, parts: int) -> np.ndarray:
    """Which names the sorters called shared."""
    shared = np.concatenate([np.zeros(0, U), *(np.frombuffer(d, "<u4").astype(U) | U(s << 32) for s, d in zip(told["src"].to_pylist(), told["data"].to_pylist(), strict=True))])
    shared.sort()
    return among(short(names, parts), shared)
