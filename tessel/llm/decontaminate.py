"""Benchmark decontamination: one Aho-Corasick automaton over the word windows of the benchmark, one scan of each text.

The benchmark is broadcast only below a checked size.  Of a larger one, texts are first scanned for windows whose hashes are in
a broadcast array, and the few documents that may have one are written.  Windows are dealt to blocks by their hashes, so a
document knows from the hashes it has which blocks it must meet; each block's windows and documents come together in one shuffle, and a
task holds one automaton after another.  Neither the plan nor the driver grows with the number of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.llm.common import column, field, join_counted, keep, ship
from tessel.llm.text_arrays import U, field_of, mix, run_hashes, runs

#: Words are runs of digits, letters and non-ASCII bytes; everything else becomes a blank, and A-Z become a-z.
NORMAL = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Bytes of benchmark text that one automaton takes; measured, it has 600 MB in a worker for a million of different words.
BLOCK_BYTES = 1_000_000
#: Windows whose hashes are broadcast at once (8 bytes each); more take one scan of the texts for each so many.
HASHED_WINDOWS = 8_000_000
#: Windows of a block, in expectation, and documents that meet one automaton in a task; more documents of a block go to several tasks.
BLOCK_WINDOWS, BLOCK_DOCS = 40_000, 2_000

SCAN = (
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("item", T.StringType())]))),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))),
)
HIT = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("item", pa.string())]))
SPAN = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(NORMAL).split()


def windows_of(text: str, size: int) -> list[bytes]:
    words = words_of(text)
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def build(items: list[tuple[str | None, str]], size: int):
    """An automaton whose words' values are (number of words, ids of the items that have the window)."""
    import ahocorasick

    owners: dict[bytes, dict[str | None, None]] = {}
    for item, text in items:
        for w in windows_of(text, size):
            owners.setdefault(w, {})[item] = None
    automaton = ahocorasick.Automaton()
    for w, ids in owners.items():
        automaton.add_word(f" {w.decode()} ", (w.count(b" ") + 1, sorted(x for x in ids if x is not None)))
    if owners:
        automaton.make_automaton()
    return automaton if owners else None


def scan_text(text: str, automaton) -> tuple[int, list[dict], list[dict]]:
    """Number of words; for each window found and each item its first word; its place in the text as character offsets."""
    words = words_of(text)
    if not words or automaton is None:
        return len(words), [], []
    plain = f" {b' '.join(words).decode()} "
    found = list(automaton.iter(plain))
    if not found:
        return len(words), [], []
    blanks = np.flatnonzero(np.frombuffer(plain.encode("utf-32-le"), "<u4") == 32)  # the blank after word i is i + 1
    last = np.searchsorted(blanks, [end for end, _ in found]) - 1
    raw = np.frombuffer(text.encode().translate(NORMAL), "u1")
    inside = np.diff(np.concatenate([[0], (raw != 32).astype("i1"), [0]]))
    starts, stops = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(text.encode(), "u1") & 0xC0) != 0x80)])  # characters before a byte
    hits, spans = [], []
    for w, (_, (n, items)) in zip(last.tolist(), found, strict=True):
        first = w - n + 1
        hits += [{"start": first, "length": n, "item": x} for x in (items or [None])]
        spans.append({"start": int(chars[starts[first]]), "stop": int(chars[stops[w]])})
    return len(words), hits, spans


def window_hashes(texts: list[str], lengths: list[int], items: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each run of so many words; with ``items``, of the windows of items with windows of that size."""
    data = np.frombuffer(b" ".join(t.encode().translate(NORMAL) for t in texts), "u1")
    starts, stops = runs(data != 32)
    words = run_hashes(data, starts, stops)
    first = np.searchsorted(starts, np.cumsum([0] + [len(t.encode()) + 1 for t in texts]))
    count = np.diff(first)
    owner = np.repeat(np.arange(len(texts)), count)
    end = np.repeat(first[1:], count)
    out = [(np.zeros(0, "i8"), np.zeros(0, U))]
    for n in lengths:
        at = np.flatnonzero(np.arange(len(words)) + n <= end)
        if items is not None:
            at = at[(count[owner[at]] >= n) if n == items else (count[owner[at]] == n)]
        h = np.full(len(at), U(n))
        for i in range(n):
            h = mix(h * U(0x9E3779B97F4A7C15) + words[at + i] + U(1))
        out.append((owner[at], h))
    own, hashes = zip(*out, strict=True)
    return np.concatenate(own), np.concatenate(hashes)


def _mapped(rows: DataFrame, made: tuple[T.StructField, ...], f) -> DataFrame:
    """All columns and those that ``f`` makes (as arrays) from the first, a struct."""
    kept = len(rows.columns)
    schema = T.StructType([*rows.schema.fields, *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = f()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(kept)), *own(batch.column(0))], schema.names)

    return rows.mapInArrow(run, schema)


def _scan(rows: DataFrame, text_col: str, items: DataFrame, size: int) -> DataFrame:
    """Hits of the windows of all items, in the texts of the rows."""
    listed = rows.sparkSession.sparkContext.broadcast([(r["item"], r["text"]) for r in items.collect()])  # below BLOCK_BYTES, see find_contamination

    def prepared():
        automaton = build(listed.value, size)

        def scan(own: pa.StructArray) -> list[pa.Array]:
            found = [scan_text(x, automaton) for x in field_of(own, text_col).to_pylist()]
            return [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), HIT, SPAN))]

        return scan

    return _mapped(rows, SCAN, prepared)


def _windows(items: DataFrame, size: int) -> DataFrame:
    """(h, item, text) for each window of the items: its hash, the item's id, and its words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own := windows_of(text, size):
                    h = window_hashes([text], [min(size, len(words_of(text)))], size)[1]
                    yield pa.RecordBatch.from_arrays([pa.array(h.view("i8")), pa.array([item] * len(own), pa.string()), pa.array([w.decode() for w in own])], ["h", "item", "text"])

    return items.mapInArrow(cut, "h long, item string, text string").distinct()


def _meet(suspects: DataFrame, text_col: str, items: DataFrame, size: int, blocks: int) -> DataFrame:
    """(nth, hits, spans) of the suspects, for each block of windows of which they have a hash."""
    block = lambda h: F.pmod(h, F.lit(blocks)).cast("int").alias("block")
    pairs = keep(suspects.select("nth", F.explode("seen").alias("h")).select("nth", block(F.col("h"))).distinct())
    sizes = keep(pairs.groupBy("block").agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / BLOCK_DOCS).cast("int")))
    salt = F.pmod(F.xxhash64("nth"), F.col("salts")).cast("int").alias("salt")
    dealt = join_counted(pairs, sizes, ["block"]).select("nth", "block", salt)
    texts = dealt.join(suspects.select("nth", field("row", text_col).alias("text")), "nth").select("block", "salt", F.lit(1).alias("kind"), "nth", F.lit(None).cast("string").alias("item"), "text")
    salts = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    windows = _windows(items, size).select(block(F.col("h")), "item", "text").join(sizes, "block").select("block", salts, F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("nth"), "item", "text")
    met = windows.unionByName(texts).repartition("block", "salt").sortWithinPartitions("block", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, listed, automaton = None, [], None
        for batch in batches:
            out = []
            for at, s, kind, nth, item, text in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if (at, s) != key:
                    key, listed, automaton = (at, s), [], None
                if kind == 0:
                    listed.append((item, text))
                    continue
                if automaton is None and listed:
                    automaton, listed = build(listed, size), []
                _, hits, spans = scan_text(text, automaton)
                if hits:
                    out.append((nth, hits, spans))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), HIT, SPAN))], ["nth", "hits", "spans"])

    return met.mapInArrow(run, T.StructType([T.StructField("nth", T.LongType()), *SCAN[1:]]))


def _suspects(rows: DataFrame, text_col: str, items: DataFrame, size: int) -> tuple[DataFrame, int]:
    """All rows with ``n_words`` and ``seen``, the hashes of their runs of words that are also those of windows; and how many windows there are."""
    spark = rows.sparkSession

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lengths = sorted({min(size, len(words_of(t))) for t in texts} - {0})
            for n in lengths:
                h = np.unique(window_hashes(texts, [n], size)[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), n, "i4")), pa.array(h.view("i8"))], ["n", "h"])

    windows = keep(items.mapInArrow(hashed, "n int, h long").distinct())
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # at most ``size``
    total = windows.count()
    parts = max(1, -(-total // HASHED_WINDOWS))
    made = (T.StructField("n_words", T.LongType()), T.StructField("seen", T.ArrayType(T.LongType())))
    names = rows.columns
    for i in range(parts):
        own = windows.where(F.pmod("h", F.lit(parts)) == i).select("h").toArrow()["h"].to_numpy().view(U)  # HASHED_WINDOWS in expectation
        known = spark.sparkContext.broadcast(np.unique(own))

        def prepared(known=known):
            def look(own: pa.StructArray) -> list[pa.Array]:
                n, seen = [], []
                for t in field_of(own, text_col).to_pylist():
                    h = np.unique(window_hashes([t], lengths)[1])
                    at = np.minimum(np.searchsorted(known.value, h), max(0, len(known.value) - 1))
                    n.append(len(words_of(t)))
                    seen.append(h[known.value[at] == h].view("i8") if len(known.value) else [])
                return [pa.array(n, pa.int64()), pa.array(seen, pa.list_(pa.int64()))]

            return look

        looked = _mapped(rows, made, prepared)
        rows = looked if not i else looked.select(*names, "n_words", F.concat("seen", "before").alias("seen"))
        if i + 1 < parts:
            rows = rows.select(*names, F.col("seen").alias("before"))
    return rows, total


def n_hit(hits: Column) -> Column:
    """Number of words inside any occurrence: lengths of the union of the intervals, in order of their first words."""
    ordered = F.array_sort(F.array_distinct(F.transform(hits, lambda h: F.struct(h["start"], (h["start"] + h["length"]).alias("stop")))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("seen"))

    def step(acc: Column, x: Column) -> Column:
        stop = F.greatest(acc["seen"], x["stop"])
        return F.struct((acc["n"] + stop - F.least(stop, F.greatest(acc["seen"], x["start"]))).alias("n"), stop.alias("seen"))

    return F.aggregate(ordered, start, step, lambda acc: acc["n"])


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = 13,
    block_bytes: int = BLOCK_BYTES,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """(row, n_words, n_hit, items, spans, contaminated) for each row of ``docs``.

    Words are `[0-9a-z]` and non-ASCII characters after lower-casing A-Z.  A window is ``size`` consecutive words of an
    item; an item of fewer words, but not none, is one window.  ``n_hit`` counts the words of the document inside any
    occurrence of a window, ``items`` has the ids (as sorted strings) of items with occurring windows, ``spans`` the
    places in the original text as character offsets.  Contaminated: n_hit > 0 and 20 * n_hit >= n_words.

    Null and empty texts have no words and are clean.  Items without words match nothing; items without an id can hit
    words but are not listed; ids that occur twice are listed once.  An empty benchmark leaves all clean.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.struct(*[column(docs, c) for c in docs.columns]).alias("row"))
    items = benchmark.select(column(benchmark, item_col).cast("string").alias("item"), F.coalesce(column(benchmark, item_text_col), F.lit("")).alias("text"))
    if items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] <= block_bytes:
        found = _scan(rows, text_col, items, size)
    else:
        items = keep(items.distinct())
        looked, total = _suspects(rows, text_col, items, size)
        suspects = keep(looked.where(F.size("seen") > 0).select("row", "n_words", "seen", F.monotonically_increasing_id().alias("nth")))
        hits = keep(_meet(suspects, text_col, items, size, max(1, -(-total // block_windows)))).groupBy("nth")
        hits = hits.agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
        none = [F.array().cast(x.dataType).alias(x.name) for x in SCAN[1:]]
        checked = suspects.join(hits, "nth", "left").select("row", "n_words", *[F.coalesce(x.name, F.array().cast(x.dataType)).alias(x.name) for x in SCAN[1:]])
        found = looked.where(F.size("seen") == 0).select("row", "n_words", *none).unionByName(checked)
    hit = n_hit(F.col("hits"))
    items = F.array_sort(F.array_distinct(F.filter(F.col("hits")["item"], lambda x: x.isNotNull())))
    return found.select(
        "row", "n_words", hit.alias("n_hit"), items.alias("items"), F.array_sort(F.array_distinct("spans")).alias("spans")
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **rules) -> DataFrame:
    """The rows that are not contaminated, with the same columns."""
    found = find_contamination(docs, benchmark, **rules)
    return found.where(~F.col("contaminated")).select(*[field("row", c).alias(c) for c in docs.columns])
