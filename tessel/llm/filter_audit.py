"""Filter interaction audit: what each of several filters removes in every order in which they could be applied.

A document fails some of the filters, which makes a mask of bits.  All that an audit says follows from how many documents
have each mask, so nothing is filtered again for each order.  The masks are counted in Walsh-Hadamard form: for every
subset of the filters, Spark sums a sign that says whether a document fails an even or an odd number of them.  These sums
add up over tasks like any others; their exact inverse, divided by their number, gives the counts of the masks back.
Orders are read off the counts, and the Shapley value in closed form: of a document that fails k filters, each of the k is the
first one in a k-th of all orders.

DataFrame functions alone.  Texts are read once and never shuffled: only their hashes and masks are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import LAST_ID, column, content_key
from tessel.llm.line_dedup import BLANKS

#: Names of the filters that look at a text alone, in the order of their bits; the last filter is that of copies.
LETTERS = "ABCDE"


@dataclass(frozen=True)
class Rules:
    """When a document fails: fewer words, a smaller share of distinct ones, a larger share of capitals, or any of the signs."""

    min_words: int = 200
    min_distinct_pct: int = 50
    max_capitals_pct: int = 3
    signs: str = r"[#$%&*|]"


def measures(text: Column) -> dict[str, Column]:
    """Words, distinct words, capital letters and code points of a text that isn't null."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    words = F.split(trimmed, f"[{BLANKS}]+")  # one empty word where there is none
    none = (trimmed == "").cast("int")
    return {
        "words": F.size(words) - none,
        "own": F.size(F.array_distinct(words)) - none,
        "capitals": F.length(F.regexp_replace(text, "[^A-Z]+", "")),
        "chars": F.length(text),
    }


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """(id, part, k1, k2, mask): a row for each document, with the bits of the filters A to D that it fails and a hash of its text.

    A null text is an empty one: no words, nothing distinct, no capitals.  A null part is the empty string, and a null id
    comes after all others.
    """
    text = F.coalesce(column(docs, text_col).cast("string"), F.lit(""))
    read = docs.select(
        F.coalesce(column(docs, id_col).cast("long"), F.lit(LAST_ID)).alias("id"),
        F.coalesce(column(docs, part_col).cast("string"), F.lit("")).alias("part"),
        text.alias("text"),
    )
    sizes = [x.cast("long").alias(n) for n, x in measures(F.col("text")).items()]
    seen = read.select("id", "part", *content_key("text"), *sizes, F.col("text").rlike(rules.signs).alias("signs"))
    fails = [
        F.col("words") < rules.min_words,
        100 * F.col("own") < rules.min_distinct_pct * F.col("words"),
        100 * F.col("capitals") > rules.max_capitals_pct * F.col("chars"),
        F.col("signs"),
    ]
    bits = [F.when(x, 1 << i).otherwise(0) for i, x in enumerate(fails)]
    return seen.select("id", "part", "k1", "k2", sum(bits[1:], bits[0]).alias("mask"))


def marked(labels: DataFrame, id_col: str, names: list[str]) -> DataFrame:
    """(id, flags): for each id with labels, which of ``names`` is 1 in any of its rows, as bits."""
    bits = [F.max(F.when(column(labels, c) == 1, 1 << i).otherwise(0)) for i, c in enumerate(names)]
    known = labels.where(column(labels, id_col).isNotNull())
    return known.groupBy(column(labels, id_col).cast("long").alias("id")).agg(sum(bits[1:], bits[0]).alias("flags"))


def count_copies(rows: DataFrame) -> DataFrame:
    """(part, flags, mask, n): documents by all five bits; E is set where a smaller id has the same text.

    Equal texts have equal masks, so a text is a few rows, one for each part and flags that it occurs with, however many
    copies it has: of each of these rows all documents are copies but those of the smallest id of all.
    """
    documents = rows.groupBy("k1", "k2", "part", "flags", "mask", "id").agg(F.count("*").alias("n"))
    texts = documents.groupBy("k1", "k2", "part", "flags", "mask").agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("first"))
    kinds = F.collect_list(F.struct("part", "flags", "n", "first"))
    whole = texts.groupBy("k1", "k2", "mask").agg(kinds.alias("kinds"), F.min("first.id").alias("first_id"))
    one = whole.select("mask", "first_id", F.inline("kinds"))
    firsts = F.when(F.col("first.id") == F.col("first_id"), F.col("first.n")).otherwise(0)
    counts = F.array(F.struct(F.col("mask"), firsts.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - firsts).alias("n")))
    return one.select("part", "flags", F.inline(counts)).select("part", "flags", "mask", "n")


def parity_sums(counted: DataFrame, filters: int) -> DataFrame:
    """(part, flags, sums): for each subset of the filters, documents that fail an even number of it less those that fail an odd one."""
    sign = lambda subset: 1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(F.lit(subset))) % 2)
    sums = [F.sum(F.col("n") * sign(subset)) for subset in range(1 << filters)]
    return counted.groupBy("part", "flags").agg(F.array(*sums).alias("sums"))


def cells(sums: Column, filters: int) -> Column:
    """Documents of each mask: the sums transformed once more, divided by how many there are; no rounding, the quotients are whole."""
    size = 1 << filters
    at = F.sequence(F.lit(0), F.lit(size - 1))
    sign = lambda i, m: (1 - 2 * (F.bit_count(i.bitwiseAND(m)) % 2)).cast("long")
    total = lambda m: F.aggregate(F.transform(at, lambda i: F.get(sums, i) * sign(i, m)), F.lit(0).cast("long"), lambda a, b: a + b)
    return F.transform(at, lambda m: F.call_function("div", total(m), F.lit(size).cast("long")))


def orders(filters: str) -> Column:
    """All orders with their steps: the filter's bit, and the bits of those before it."""
    bit = {f: 1 << i for i, f in enumerate(filters)}
    listed = [F.struct(F.lit("".join(p)).alias("filter_order"), F.array(*[F.lit(bit[f]) for f in p]).alias("bits")) for p in permutations(filters)]
    return F.array(*listed)


def audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", good: str = "quality", toxic: str = "toxic", rules: Rules = Rules()
) -> DataFrame:
    """A row for each part, order of the five filters and step: what the filter of that step removes there.

    kept: documents after the step.  removed: by it.  redundant: fail its filter, but were gone.  unique_fails: fail its filter
    alone.  good_lost, toxic_lost: of the removed ones, those with that label.  shapley: what its filter removes, summed over all orders.

    Filters: A few words, B few distinct words, C many capitals, D signs, E a copy of a text with a smaller id.  Null texts are empty, null
    parts the empty string; rows without an id come last and are no copies of each other; repeated rows count each, and rows of one id
    are no copies of each other.  Labels without a document, and null ones, count nothing; of several labels one that is 1
    decides.  Other columns are not looked at.  An empty table: no rows.
    """
    filters = len(LETTERS)
    flags = marked(labels, id_col, [good, toxic])
    rows = masks(docs, id_col, text_col, part_col, rules).join(flags, "id", "left").withColumn("flags", F.coalesce("flags", F.lit(0)))
    sums = parity_sums(count_copies(rows), filters)
    counts = sums.select("part", "flags", F.posexplode(cells(F.col("sums"), filters)).alias("m", "n"))
    flag = lambda bit: F.col("flags").bitwiseAND(F.lit(bit)) > 0
    every_cell = lambda given: F.array(*[F.sum(F.when((F.col("m") == m) & given, F.col("n")).otherwise(0)) for m in range(1 << filters)])
    parts = counts.groupBy("part").agg(every_cell(F.lit(True)).alias("all"), every_cell(flag(1)).alias("good"), every_cell(flag(2)).alias("toxic"))
    steps = (
        parts.select("part", "all", "good", "toxic", F.explode(orders(LETTERS)).alias("o"))
        .select("part", "all", "good", "toxic", "o.*")
        .select("*", F.posexplode("bits").alias("at", "bit"))
        .withColumn("before", F.aggregate(F.slice("bits", 1, F.col("at")), F.lit(0), lambda a, b: a.bitwiseOR(b)))
    )
    every = F.sequence(F.lit(0), F.lit((1 << filters) - 1))

    def total(counts: str, where, weight=None) -> Column:
        used = F.filter(every, where)
        value = lambda m: F.get(F.col(counts), m) * (weight(m) if weight else F.lit(1))
        return F.aggregate(F.transform(used, value), F.lit(0).cast("long"), lambda a, b: a + b)

    bit, before = F.col("bit"), F.col("before")
    fails, gone = (lambda m: m.bitwiseAND(bit) > 0), (lambda m: m.bitwiseAND(before) > 0)
    removed_here = lambda m: fails(m) & ~gone(m)
    all_orders = math.factorial(filters)
    return steps.select(
        "part",
        "filter_order",
        (F.col("at") + 1).cast("int").alias("step"),
        total("all", lambda m: ~gone(m) & ~fails(m)).alias("kept"),
        total("all", removed_here).alias("removed"),
        total("all", lambda m: fails(m) & gone(m)).alias("redundant"),
        total("all", lambda m: m == bit).alias("unique_fails"),
        total("good", removed_here).alias("good_lost"),
        total("toxic", removed_here).alias("toxic_lost"),
        total("all", fails, lambda m: F.call_function("div", F.lit(all_orders).cast("long"), F.bit_count(m).cast("long"))).alias("shapley"),
    )
