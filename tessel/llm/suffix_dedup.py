"""Suffix dedup: bytes inside a string of 50 bytes that also starts in an earlier document go.

Names of a sparse set of strings, in place of prefix doubling with sorted ranks over all suffixes, which shuffles some 80
times the input (suffix_ranks.py): only sampled positions are named, and the sample loses no match: of the 19 positions at which a 32-byte prefix fits into
a 50-byte string, the one with the smallest fingerprint is always in it, and equal strings choose the same one.

Later copies of a whole text are cut by a hash of the text and take no part: the first copy has all their strings.

1. In a document, names of 1, 2, 4, 8, 16 and 32 bytes come from pairs of names at growing offsets.
2. Spark brings the sampled names of 32 bytes together; those of one document alone are unique and drop out.
3. The others are extended to all 50-byte strings around them (offsets 0 to 18) and sorted again, with the smallest
   document of each string; that is past the threshold, so doubling ends.

A name that many blocks have may stand in many surroundings.  Its records go to different sorters, each to two: a 50-byte string around a
name has 9 bytes before it or 10 after it, so strings that are equal meet by the name and these 9 bytes, or by it and these 10.

Texts are shuffled once, into blocks (see blocks.py), and a document's results are put together in its own block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.llm.blocks import HOT, MESSAGE, NAMES, Block, answer_names, block_of, heads_of, into_blocks, layout, is_shared, messages, place, send_unique
from tessel.llm.common import content_key, join_counted, keep, pack, ship
from tessel.llm.text_arrays import U, mix, runs, slices

LENGTH = 50
PREFIX = 32
FLANK = LENGTH - PREFIX
#: Bytes that go through the array operations at once, small enough for the processor's cache.
CHUNK = 300_000
RECORDS, MEMO, FOUND, COPIES = range(2, 6)
RECORD = np.dtype([("name", "<u8"), ("doc", "<i8"), ("left", "u1", FLANK), ("right", "u1", FLANK), ("before", "u1"), ("after", "u1"), ("low", "u1"), ("high", "u1")])
#: From so many blocks on that have a name its records are spread; and the bytes before a name by which half of them meet.
HOT_BLOCKS, HALF = 8, FLANK // 2
NONE = 255


def names_of(data: np.ndarray) -> np.ndarray:
    """Fingerprints of the PREFIX bytes from each position on, by doubling; the last ones run over the end."""
    name, n, power = data.astype(U) + U(1), 1, 0x9E3779B97F4A7C15
    while n < PREFIX:
        pair = name * U(power)
        pair[:-n] += name[n:]
        name, n, power = pair, 2 * n, power * power % 2**64
    return mix(name)


def sliding(op, x: np.ndarray, width: int, back: bool) -> np.ndarray:
    """op over ``width`` values from each position on, or up to it."""
    out, n = x.copy(), 1
    while n < width:
        step = min(n, width - n)
        if back:
            out[step:] = op(out[step:], out[:-step].copy())
        else:
            out[:-step] = op(out[:-step], out[step:].copy())
        n += step
    return out


def sampled(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, names) of the PREFIX-byte strings that are smallest in some LENGTH-byte string of a document."""
    if len(data) < LENGTH:
        return np.zeros(0, "i8"), np.zeros(0, U)
    name = names_of(data)
    least = sliding(np.minimum, name, FLANK + 1, back=False)
    edge = np.zeros(len(data) + 1, "i4")
    np.add.at(edge, np.maximum(starts, stops - (LENGTH - 1)), 1)
    np.add.at(edge, stops, -1)
    least[np.cumsum(edge[:-1]) > 0] = 0  # no LENGTH bytes are left in the document
    at = np.flatnonzero(sliding(np.maximum, least, FLANK + 1, back=True) == name)
    return at, name[at]


class Suffixes(Block):
    def sample(self, own_rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions, names, rows of the documents) of the documents picked."""
        at, names = [], []
        for part in slices((self.stops - self.starts).tolist(), CHUNK):
            first = self.starts[part.start]
            own = self.data[first : self.stops[part.stop - 1]]
            a, n = sampled(own, self.starts[part] - first, self.stops[part] - first)
            at.append(a + first)
            names.append(n)
        at, names = np.concatenate([np.zeros(0, "i8"), *at]), np.concatenate([np.zeros(0, U), *names])
        rows = np.searchsorted(self.stops, at, side="right")
        some = own_rows[rows]
        return at[some], names[some], rows[some]


def send_names(docs: pa.Table, copies: pa.Table, parts: int) -> pa.Table:
    """Names of all documents but later copies of a whole text, which go as they are: the first has all their strings."""
    if not docs.num_rows:
        return messages([])
    block, number = Suffixes(docs), docs["block"][0].as_py()
    later = set(zip(copies["id"].to_pylist(), copies["t1"].to_pylist(), strict=True))
    whole = np.array([x in later for x in zip(docs["id"].to_pylist(), docs["t1"].to_pylist(), strict=True)], bool)[block.order]
    _, names, rows = block.sample(~whole)
    told = send_unique(names, block.ids[rows], number, parts)
    return pa.concat_tables([told, messages([(number % parts, number, COPIES, np.packbits(whole).tobytes())])])


@dataclass
class Memo:
    """What a block tells itself: spans to cut, and places whose records wait for an answer, each record's first marked."""

    start: np.ndarray
    stop: np.ndarray
    asking: np.ndarray
    begins: np.ndarray

    def packed(self) -> bytes:
        sizes = np.array([len(self.start), len(self.asking)], "<i8")
        return b"".join(x.tobytes() for x in (sizes, self.start.astype("<u4"), self.stop.astype("<u4"), self.asking.astype("<u4"), np.packbits(self.begins)))

    @classmethod
    def unpacked(cls, data: bytes) -> Memo:
        n, m = np.frombuffer(data, "<i8", 2).tolist()
        numbers = np.frombuffer(data, "<u4", 2 * n + m, 16).astype("i8")
        begins = np.unpackbits(np.frombuffer(data, "u1", -1, 16 + 4 * len(numbers)), count=m).astype(bool)
        return cls(numbers[:n], numbers[n : 2 * n], numbers[2 * n :], begins)


def flank_hash(record: np.ndarray) -> np.ndarray:
    raw = np.ascontiguousarray(np.concatenate([record["left"], record["right"], record["before"][:, None], record["after"][:, None]], axis=1))
    h = np.zeros(len(record), U)
    padded = np.zeros((len(record), 40), "u1")
    padded[:, : raw.shape[1]] = raw
    for word in padded.view("<u8").T:
        h = mix(h * U(0x9E3779B97F4A7C15) + word + U(1))
    return h


def spread(record: np.ndarray, at: np.ndarray, names: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Records of hot names twice, under a name of their own for each half of the strings around them: those with HALF bytes before, and the rest."""
    def half(side: str, n: int, salt: int) -> np.ndarray:
        h = mix(names ^ U(salt))
        for i in range(n):
            h = mix(h * U(0x9E3779B97F4A7C15) + record[side][:, i].astype(U) + U(1))
        return h

    far = np.flatnonzero(hot & (record["before"] >= HALF))
    near = np.flatnonzero(hot & (record["after"] > FLANK - HALF))
    cold = np.flatnonzero(~hot)
    own = np.concatenate([cold, far, near])
    out = record[own]
    name = np.concatenate([names[cold], half("left", HALF, 0xC2B2AE3D27D4EB4F)[far], half("right", FLANK - HALF + 1, 0x165667B19E3779F9)[near]])
    out["name"] = name
    out["low"][len(cold) : len(cold) + len(far)] = HALF
    out["high"][len(cold) + len(far) :] = HALF - 1
    return out, at[own], name


def send_records(docs: pa.Table, told: pa.Table, parts: int) -> pa.Table:
    """Send the surroundings of names that others have too; what the block can tell by itself goes into a memo."""
    if not docs.num_rows or not told.num_rows:
        return messages([])
    block, number = Suffixes(docs), docs["block"][0].as_py()
    marks = next(d for k, d in zip(told["kind"].to_pylist(), told["data"].to_pylist(), strict=True) if k == COPIES)
    whole = np.unpackbits(np.frombuffer(marks, "u1"), count=docs.num_rows).astype(bool)
    at, names, rows = block.sample(~whole)
    some = is_shared(names, told.filter(pc.equal(told["kind"], NAMES)), parts)
    at, names, rows = at[some], names[some], rows[some]
    record = np.zeros(len(at), RECORD)
    record["name"], record["doc"] = names, block.ids[rows]
    before = np.minimum(FLANK, at - block.starts[rows])
    after = np.minimum(FLANK, block.stops[rows] - at - PREFIX)
    record["before"], record["after"] = before, after
    step = np.arange(FLANK)
    for side, room, place_of in (("left", before, at[:, None] - 1 - step), ("right", after, at[:, None] + PREFIX + step)):
        ok = step < room[:, None]
        record[side] = np.where(ok, block.data[np.clip(place_of, 0, len(block.data) - 1)], 0)
    record["high"] = FLANK
    hot = is_shared(names, told.filter(pc.equal(told["kind"], HOT)), parts)
    if hot.any():
        record, at, names = spread(record, at, names, hot)
    # equal surroundings in a block are one record, of the smallest document that has them
    flank, sorter = flank_hash(record), place(names, parts)
    order = np.lexsort((record["doc"], flank, names, sorter))
    record, at, sorter, flank = record[order], at[order], sorter[order], flank[order]
    new = np.append(True, (record["name"][1:] != record["name"][:-1]) | (flank[1:] != flank[:-1]))[: len(record)]
    variant = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    later = record["doc"] != record["doc"][heads][variant]  # an earlier document of this block has all of it
    most = np.minimum(record["before"], record["high"]).astype("i8")
    least = np.maximum(record["low"], np.maximum(0, FLANK - record["after"].astype("i8")))
    # places of the others in the order of their records, and which of them begins a new one
    gone = whole & (block.stops - block.starts >= LENGTH)
    later &= most >= least
    start, stop = at[later] - most[later], at[later] - least[later] + LENGTH
    memo = Memo(np.append(start, block.starts[gone]), np.append(stop, block.stops[gone]), at[~later], new[~later])
    bounds = np.searchsorted(sorter[heads], np.arange(parts + 1))
    own = record[heads]
    out = [(p, number, RECORDS, own[bounds[p] : bounds[p + 1]].tobytes()) for p in range(parts) if bounds[p] < bounds[p + 1]]
    return messages([*out, (number % parts, number, MEMO, memo.packed())])


def sort_records(table: pa.Table) -> pa.Table:
    """For each record the fewest and the most bytes before the name of a string that an earlier document has, too."""
    sorter = table["dest"][0].as_py()
    rows = list(zip(*(table[c].to_pylist() for c in ("src", "kind", "data")), strict=True))
    out = [(s, sorter, MEMO, d) for s, k, d in rows if k == MEMO]
    sent = [(s, np.frombuffer(d, RECORD)) for s, k, d in rows if k == RECORDS]
    if not sent:
        return messages(out)
    record = np.concatenate([d for _, d in sent])
    _, group = np.unique(record["name"], return_inverse=True)
    base = mix(group.astype(U) + U(0x51ED270B))
    left, right = [np.zeros(len(record), U)], [np.zeros(len(record), U)]
    for i in range(FLANK):
        for side, all_ in (("left", left), ("right", right)):
            all_.append(mix(all_[-1] * U(0x9E3779B97F4A7C15) + record[side][:, i].astype(U) + U(1)))
    least, most = np.full(len(record), NONE, "u1"), np.full(len(record), NONE, "u1")
    for j in range(FLANK + 1):
        ok = np.flatnonzero((record["before"] >= j) & (record["after"] >= FLANK - j) & (record["low"] <= j) & (j <= record["high"]))
        if not len(ok):
            continue
        string = mix(base[ok] ^ mix(left[j][ok] + U(1)) ^ (mix(right[FLANK - j][ok] + U(2)) * U(3)))
        order = np.argsort(string, kind="stable")
        string, doc = string[order], record["doc"][ok][order]
        heads = heads_of(string)
        first = np.repeat(np.minimum.reduceat(doc, heads), np.diff(np.append(heads, len(doc))))
        hit = ok[order[first < doc]]
        most[hit] = j
        least[hit[least[hit] == NONE]] = j
    bounds = np.cumsum([0] + [len(d) for _, d in sent])
    answers = np.stack([least, most], axis=1)
    out += [(s, sorter, FOUND, answers[a:b].tobytes()) for (s, _), a, b in zip(sent, bounds, bounds[1:], strict=False)]
    return messages(out)


def cut(docs: pa.Table, told: pa.Table) -> pa.Table:
    """Take the covered bytes out of each document."""
    if not docs.num_rows:
        return pa.table({"row": docs["row"], "n_bytes": pa.array([], pa.int64()), "spans": pa.array([], SPANS), "kept": pa.array([], pa.binary())})
    block = Block(docs)
    edge = np.zeros(len(block.data) + 1, "i4")
    order = np.argsort(told["src"].to_numpy(), kind="stable").tolist() if told.num_rows else []
    kinds, data = told["kind"].to_pylist(), told["data"].to_pylist()
    answers = np.concatenate([np.zeros((0, 2), "i8"), *(np.frombuffer(data[i], "u1").reshape(-1, 2).astype("i8") for i in order if kinds[i] == FOUND)])
    for i in order:
        if kinds[i] == MEMO:
            memo = Memo.unpacked(data[i])
            least, most = answers[np.cumsum(memo.begins) - 1].T
            hit = least != NONE
            for a, b in ((memo.start, memo.stop), (memo.asking[hit] - most[hit], memo.asking[hit] - least[hit] + LENGTH)):
                np.add.at(edge, a, 1)
                np.add.at(edge, b, -1)
    gone = np.cumsum(edge[:-1]) > 0
    kept, spans = [], []
    for a, b in zip(block.starts.tolist(), block.stops.tolist(), strict=True):
        own = gone[a:b]
        kept.append(block.data[a:b][~own].tobytes() if own.any() else block.data[a:b].tobytes())
        spans.append([{"start": s, "stop": e} for s, e in zip(*(x.tolist() for x in runs(own)), strict=True)] if own.any() else [])
    return pa.table({"row": block.rows, "n_bytes": pa.array(block.stops - block.starts, pa.int64()), "spans": pa.array(spans, SPANS), "kept": pa.array(kept, pa.binary())})


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def cut_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None) -> DataFrame:
    """(row, n_bytes, spans, kept): the id, the length in bytes, the removed spans (maximal, in byte offsets) and the rest.

    A byte goes if a 50-byte string that covers it also starts in a document with a smaller id; strings are judged on the
    input, and matches never cross documents.  ``kept`` is binary, as a cut can part a character.

    Null and empty texts: no bytes, nothing removed.  Documents of fewer than 50 bytes stay whole.  A null id counts as
    one document that comes last.  Rows that share an id are one document to each other and don't match; each keeps its
    own row.  Empty table: empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    blocks, n = layout(docs, text_col, blocks)
    texts = into_blocks(docs, id_col, text_col, blocks, F.xxhash64("text").alias("t1"))
    keys = keep(pack(docs, id_col, text_col).select(block_of(blocks), "id", *[k.alias(c) for k, c in zip(content_key("text"), ("t1", "t2"), strict=True)]))
    firsts = keep(keys.groupBy("t1", "t2").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1"))
    copies = join_counted(keys, firsts, ["t1", "t2"]).where(F.col("id") != F.col("first_id")).select("block", "id", "t1").distinct()
    names = texts.groupBy("block").cogroup(copies.groupBy("block")).applyInArrow(lambda t, c: send_names(t, c, n), MESSAGE)
    hot = HOT_BLOCKS
    shared = names.groupBy("dest").applyInArrow(lambda t: answer_names(t, hot), MESSAGE)
    records = texts.groupBy("block").cogroup(shared.groupBy("dest")).applyInArrow(lambda t, m: send_records(t, m, n), MESSAGE)
    found = records.groupBy("dest").applyInArrow(sort_records, MESSAGE)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    schema = T.StructType([texts.schema["row"], T.StructField("n_bytes", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType())])
    return texts.groupBy("block").cogroup(found.groupBy("dest")).applyInArrow(cut, schema)
