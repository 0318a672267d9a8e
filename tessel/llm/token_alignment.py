"""Alignment of two tokenizers: where their tokens end together, and which tokens stand for which over a whole corpus.

A byte-level BPE (A) and a sentencepiece BPE with byte fallback (B) cut the same bytes.  A task takes many texts at once as flat
arrays: token lengths summed up are the ends, common ends are the cuts (``intersect1d``), the cut at or after a token's end is its
group (``searchsorted``), and the tokens that end at a cut are linked by repeating them.  The links of a text are kept packed, each
pair of ids once with its number.  Spark counts the pairs of the corpus in two stages, by pair and salt and then by pair, and
each text's links meet these counts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.llm.common import column, join_counted, keep, ship
from tessel.llm.text_arrays import U, parts_of, trim

#: Bytes of texts that a task turns into arrays at once; a longer text comes alone.
PART = 1 << 19
#: Parts of a text whose ids a task remembers at most, and their length; it forgets all of them then, which changes no result.
MEMORY, MEMORABLE = 150_000, 64
#: Pairs that a task counts before it hands its counts on.
COUNTED = 1 << 21
#: Parts that the counts of one pair are first dealt to.
SALTS = 16
#: Up to so many different pairs, at 17 bytes each, tasks get the table of their counts; more of them are joined.
BROADCAST_PAIRS = 4_000_000
SPACE = "▁"


def byte_letters() -> dict[str, int]:
    """The letters of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Ids of texts by a byte-level BPE whose merges are in the order of its ids, and the bytes of each id."""

    def __init__(self, content: bytes, pattern: str) -> None:
        import tiktoken

        model, letters = json.loads(content)["model"], byte_letters()
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if [model["vocab"][m] for m in merged] != list(range(256, 256 + len(merged))):
            raise ValueError("merges aren't in the order of their ids")
        self.bytes_of = [b""] * (max(model["vocab"].values()) + 1)
        for piece, i in model["vocab"].items():
            self.bytes_of[i] = bytes(map(letters.__getitem__, piece)) if i < 256 + len(merged) else b""
        ranks = {x: i for i, x in enumerate(self.bytes_of) if x}
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Pieces:
    """Ids of texts by a sentencepiece BPE model that puts a space before each, and the bytes of each id.

    No piece has a space after another character or a line feed, so a text may be cut before its runs of spaces and its line feeds,
    and equal parts are encoded once.  A model with other pieces encodes whole texts.
    """

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_of = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        parted = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces)
        self.split = re.compile(r" +[^ \n]*|\n[^ \n]*").findall if parted else None
        self.space = self.model.piece_to_id(SPACE)
        self.known: dict[str, bytes] = {}
        self.odd: set[str] = set()  # parts that their tokens don't give back

    def ids_of(self, parts: list[str]) -> list[list[int]]:
        """Of parts that begin with a space, which the model itself adds, or with a line feed, before which it adds one too many."""
        made = self.model.encode([p[1:] if p[0] == " " else p for p in parts], num_threads=1)
        return [x[1:] if p[0] == "\n" else x or [self.space] for p, x in zip(parts, made, strict=True)]

    def learn(self, parts: list[str]) -> None:
        for p, ids in zip(parts, self.ids_of(parts), strict=True):
            self.known[p] = np.array(ids, "<u4").tobytes()
            if b"".join(map(self.bytes_of.__getitem__, ids)) != p.encode():
                self.odd.add(p)

    def encode(self, texts: list[str]) -> list[bytes | None]:
        """Packed ids of space and text; none where their bytes aren't those of space and text."""
        if self.split is None:
            ids = self.model.encode(texts, num_threads=1)
            same = (b"".join(map(self.bytes_of.__getitem__, x)) == f" {t}".encode() for x, t in zip(ids, texts, strict=True))
            return [np.array(x, "<u4").tobytes() if ok else None for x, ok in zip(ids, same, strict=True)]
        split = [self.split(f" {t}") for t in texts]
        if len(self.known) > MEMORY:
            self.known.clear()
            self.odd.clear()
        self.learn(list(set().union(*split).difference(self.known)))
        packed = [b"".join(map(self.known.__getitem__, parts)) for parts in split]
        if self.odd:
            packed = [x if self.odd.isdisjoint(parts) or self.whole(x) == f" {t}".encode() else None for x, parts, t in zip(packed, split, texts, strict=True)]
        for long in [p for p in self.known if len(p) > MEMORABLE]:
            del self.known[long]
        return packed

    def whole(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@dataclass
class Aligned:
    """Tokens of some texts after each other, their groups, and the links."""

    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray  # of each token, its group; groups are numbered through all texts
    group_b: np.ndarray
    cuts: np.ndarray  # where groups end, in bytes through all texts
    left: np.ndarray  # of each link, the number of its A token and its B token
    right: np.ndarray


def align(a: np.ndarray, b: np.ndarray, length_a: np.ndarray, length_b: np.ndarray) -> Aligned:
    """Two sequences of ids that stand for the same bytes."""
    ends_a, ends_b = np.cumsum(length_a[a]), np.cumsum(length_b[b])
    cuts = np.intersect1d(ends_a, ends_b)
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    last_a, last_b = np.flatnonzero(cuts[group_a] == ends_a), np.flatnonzero(cuts[group_b] == ends_b)
    count_b = np.bincount(group_b[last_b], minlength=len(cuts))
    first_b = np.cumsum(count_b) - count_b
    times = count_b[group_a[last_a]]
    left = np.repeat(last_a, times)
    within = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
    right = last_b[np.repeat(first_b[group_a[last_a]], times) + within]
    return Aligned(a, b, group_a, group_b, cuts, left, right)


class Groups:
    """Groups as text, `a1,a2|b1;a3|b2,b3`: each id has a string for each sign that may follow it."""

    def __init__(self, size_a: int, size_b: int) -> None:
        self.strings = [b"%d%s" % (i, sign) for n, signs in ((size_a, b",|"), (size_b, b",;")) for sign in (signs[:1], signs[1:]) for i in range(n)]
        self.size_a, self.size_b = size_a, size_b

    def __call__(self, x: Aligned) -> np.ndarray:
        """Numbers of strings for all tokens in the order of the text; a text's last string ends with a sign too much."""
        ends_a = np.append(x.group_a[1:] != x.group_a[:-1], True)[: len(x.a)]
        ends_b = np.append(x.group_b[1:] != x.group_b[:-1], True)[: len(x.b)]
        out = np.empty(len(x.a) + len(x.b), "i8")
        before_b = np.searchsorted(x.group_b, x.group_a, side="left")  # B tokens of earlier groups
        before_a = np.searchsorted(x.group_a, x.group_b, side="right")  # A tokens up to this group
        out[np.arange(len(x.a)) + before_b] = x.a + self.size_a * ends_a
        out[np.arange(len(x.b)) + before_a] = x.b + 2 * self.size_a + self.size_b * ends_b
        return out


class Aligner:
    """What a task needs: both tokenizers, and what follows from their vocabularies."""

    def __init__(self, content: bytes, pattern: str, model: bytes) -> None:
        self.a, self.b = ByteLevel(content, pattern), Pieces(model)
        self.length_a, self.length_b = (np.array([len(x) for x in t.bytes_of], "i8") for t in (self.a, self.b))
        self.groups = Groups(len(self.length_a), len(self.length_b))

    def __call__(self, texts: list[str], readable: bool) -> list[list]:
        """For each text: tokens of A and B, groups, links, the groups as text or its hash, pairs and their numbers."""
        packed = self.b.encode(texts)
        ids_a = [np.array(self.a.encode(f" {t}") if p is not None and t else [], "i8") for t, p in zip(texts, packed, strict=True)]
        sizes = [int(self.length_a[x].sum()) for x in ids_a]
        ids_b = [np.frombuffer(p, "<u4") if n and n == len(t.encode()) + 1 else np.zeros(0, "<u4") for p, n, t in zip(packed, sizes, texts, strict=True)]
        ids_a = [x if len(y) else x[:0] for x, y in zip(ids_a, ids_b, strict=True)]
        count_a, count_b = np.array([len(x) for x in ids_a], "i8"), np.array([len(x) for x in ids_b], "i8")
        x = align(np.concatenate(ids_a), np.concatenate(ids_b).astype("i8"), self.length_a, self.length_b)
        stops_a, stops_b = np.cumsum(count_a), np.cumsum(count_b)
        ends = np.append(0, x.group_a + 1)[stops_a]  # groups up to the end of each text
        groups = np.diff(ends, prepend=0)
        text_of = np.searchsorted(stops_a, x.left, side="right")
        links = np.bincount(text_of, minlength=len(texts))
        # each pair of a text once, with its number
        code = (x.a[x.left] * len(self.length_b) + x.b[x.right]).astype(U)
        order = np.lexsort((code, text_of)) if len(self.length_a) * len(self.length_b) >= 1 << 40 else np.argsort((text_of.astype(U) << U(40)) | code)
        code, text_of = code[order], text_of[order]
        heads = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (text_of[1:] != text_of[:-1]))[: len(code)])
        times = np.diff(np.append(heads, len(code))).astype("<u4")
        code, bounds = code[heads].astype("<u8"), np.searchsorted(text_of[heads], np.arange(len(texts) + 1))
        strings, at, written = self.groups(x).tolist(), np.append(0, stops_a + stops_b).tolist(), []
        for i in range(len(texts)):
            own = b"".join(map(self.groups.strings.__getitem__, strings[at[i] : at[i + 1]]))[:-1]
            written.append(own.decode() if readable or not own else hashlib.sha256(own).hexdigest())
        pairs = [code[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        numbers = [times[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return [count_a.tolist(), count_b.tolist(), groups.tolist(), links.tolist(), written, pairs, numbers]


def _tokenized(docs: DataFrame, text_col: str, tokenizers: tuple[bytes, str, bytes], readable: bool) -> DataFrame:
    """(row, groups, n_a, n_b, n_groups, n_links, pairs, times): rows without their texts, and the links of each, packed."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tokenizers)  # the vocabularies bound it
    rest = [column(docs, c) for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(F.lit(0).alias("none"), *rest).alias("row"), F.coalesce(column(docs, text_col).cast("string"), F.lit("")).alias("text"))
    kinds = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())]
    schema = T.StructType([rows.schema["row"], *(T.StructField(n, {"int64": T.LongType(), "string": T.StringType(), "binary": T.BinaryType()}[str(k)]) for n, k in kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        aligner = Aligner(*shared.value)
        for batch in batches:
            done = 0
            for texts in parts_of(batch.column(1), PART):
                made = aligner(texts, readable)
                own = batch.column(0).slice(done, len(texts))
                done += len(texts)
                yield pa.RecordBatch.from_arrays([own, *(pa.array(x, k) for x, (_, k) in zip(made, kinds, strict=True))], ["row", *(n for n, _ in kinds)])

    return rows.mapInArrow(run, schema)


def count_pairs(linked: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): how many links of the corpus hold each pair of ids, and whether no other pair of its B id has more.

    Tasks count what they read.  A pair that all tasks have is a row for each of them, dealt to SALTS places first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % SALTS
        codes, numbers, held = [], [], 0

        def counted() -> pa.RecordBatch:
            found, where = np.unique(np.concatenate(codes), return_inverse=True)
            n = np.bincount(where, np.concatenate(numbers), len(found)).astype("i8")
            return pa.RecordBatch.from_arrays([pa.array(found.astype("i8")), pa.array(np.full(len(found), salt, "i4")), pa.array(n)], ["pair", "salt", "n"])

        for batch in batches:
            for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes.append(np.frombuffer(p, "<u8"))
                numbers.append(np.frombuffer(t, "<u4"))
                held += len(codes[-1])
            if held > COUNTED:
                yield counted()
                codes, numbers, held = [], [], 0
        if held:
            yield counted()

    salted = linked.select("pairs", "times").mapInArrow(run, "pair long, salt int, n long").groupBy("pair", "salt").agg(F.sum("n").alias("n"))
    counts = keep(salted.groupBy("pair").agg(F.sum("n").alias("n")))
    of_b = counts.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("n").alias("most"))  # a row for each id of B at most
    return counts.withColumn("b", F.col("pair") % size_b).join(F.broadcast(of_b), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _looked_up(linked: DataFrame, counts: DataFrame) -> DataFrame:
    """``linked`` and (n_best, count_sum), each task with the whole table of counts."""
    table = counts.toArrow()
    order = np.argsort(table["pair"].to_numpy())
    arrays = tuple(table[c].to_numpy()[order] for c in ("pair", "n", "best"))
    shared = linked.sparkSession.sparkContext.broadcast(arrays)
    names = [c for c in linked.columns if c not in ("pairs", "times")]
    at = {c: i for i, c in enumerate(linked.columns)}
    schema = T.StructType([*(linked.schema[c] for c in names), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            packed = batch.column(at["pairs"]).to_pylist()
            times = np.frombuffer(b"".join(batch.column(at["times"]).to_pylist()), "<u4").astype("i8")
            where = np.searchsorted(pair, np.frombuffer(b"".join(packed), "<u8").astype("i8"))
            stops = np.cumsum([0] + [len(p) // 8 for p in packed])
            sums = [np.append(0, np.cumsum(times * x[where]))[stops] if len(pair) else np.zeros(len(stops), "i8") for x in (best, n)]
            yield pa.RecordBatch.from_arrays([*(batch.column(at[c]) for c in names), *(pa.array(np.diff(s).astype("i8")) for s in sums)], [*names, "n_best", "count_sum"])

    return linked.mapInArrow(run, schema)


def _joined(linked: DataFrame, counts: DataFrame) -> DataFrame:
    """The same by a join: pairs go to their counts, and the sums back to the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, p, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pair, times = np.frombuffer(p, "<u8").astype("i8"), np.frombuffer(t, "<u4").astype("i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), at)), pa.array(pair), pa.array(times)], ["at", "pair", "times"])

    links = keep(linked.select("at", "pairs", "times").mapInArrow(run, "at long, pair long, times long"))
    best = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best")
    sums = join_counted(links, keep(counts), ["pair"]).groupBy("at").agg(best, F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return linked.drop("pairs", "times").join(sums, "at", "left").fillna(0, ["n_best", "count_sum"])


def align_documents(
    docs: DataFrame, byte_level: bytes, pattern: str, pieces: bytes, text_col: str = "text", readable: bool = False, broadcast_pairs: int = BROADCAST_PAIRS
) -> DataFrame:
    """(row, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) for each row; ``row`` has all columns but the text.

    ``byte_level`` and ``pieces`` are the contents of the tokenizers' files (JSON and model), ``pattern`` says how A cuts texts before it
    merges.  Both encode a space and the text, without special tokens: their strings in a text are plain text.

    groups: `a1,a2|b1;a3|b2` or, unless ``readable``, its SHA-256.  n_links: pairs of tokens that end at one byte.  count_sum: how many links of
    all rows hold the same pair of ids, summed over the row's links.  n_best: its links whose pair has the highest such count of
    all pairs with its B id, ties included.

    Null and empty texts, and those that the tokens of A or B don't give back byte by byte, have no tokens: zeros and ''.
    Rows are independent of each other but for the counts, in which repeated rows count each.  Empty table: empty result.
    """
    linked = keep(_tokenized(docs, text_col, (byte_level, pattern, pieces), readable).withColumn("at", F.monotonically_increasing_id()))
    counts = count_pairs(linked, len(Pieces(pieces).bytes_of))
    found = _looked_up(linked, counts) if counts.count() <= broadcast_pairs else _joined(linked, counts)
    return found.withColumn("row", F.col("row").dropFields("none")).drop("at") if len(docs.columns) > 1 else found.drop("row", "at")
