"""Language ID for spans of a text: script ranges narrow the candidates, Viterbi over words labels them.

Each word has a score for each language: the sum of log probabilities of its letter trigrams, blanks at both ends
included.  A path over the words of a text pays a penalty for each switch of language, so single odd words don't break
a span.  Trigram counts come from a bounded sample of labelled documents and are summed by Spark; the model is a table
of hashed trigrams by language, bounded by its number of buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.llm.common import column, ship
from tessel.llm.text_arrays import U, field_of, has_letter, letter_table, mix, parts_of, runs

BUCKETS = 1 << 16
#: Labelled documents that are learnt from, in expectation; the share of all labelled ones that a hash of the id picks.
SAMPLE = 20_000
#: Log probability that a switch of language costs.
SWITCH = 12.0
#: A language is a candidate for a script if so large a share of its words has it.
CANDIDATE_SHARE = 0.002
#: Bytes of text that a task turns into arrays at once; a longer text comes alone.
CHARS = 2_000_000
STEP = 500_000
UNDETERMINED = "und"

#: First code point and name of blocks of letters; a block goes on to the next one's start.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
    (0x20000, "han"), (0x30000, "other"),
]
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
_STARTS = np.array([a for a, _ in SCRIPTS])
_SCRIPT_OF = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS], "u1")


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # buckets x languages
    allowed: np.ndarray  # scripts x languages


@dataclass
class Words:
    """The words of some texts: where each stands, and hashed trigrams of all letters."""

    first: np.ndarray  # of each text, the number of its first word; one more at the end
    start: np.ndarray  # of each word in its text, in code points
    length: np.ndarray
    script: np.ndarray
    trigrams: np.ndarray  # one for each letter, words after each other


def words_of(texts: list[str]) -> Words:
    joined = "\n".join(texts)
    lowered = joined.lower()
    if len(lowered) != len(joined):  # a few letters become two: lower these texts one letter at a time
        lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in joined)
    codes = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = letter_table()[codes]
    starts, stops = runs(letter)
    edges = np.cumsum([0] + [len(x) + 1 for x in texts])
    first = np.searchsorted(starts, edges)
    text_of = np.searchsorted(edges, starts, side="right") - 1
    padded = np.concatenate([[0], np.where(letter, codes, 0), [0]]).astype(U)
    own = (padded[:-2] << U(42)) ^ (padded[1:-1] << U(21)) ^ padded[2:]
    trigrams = (mix(own[letter]) % U(BUCKETS)).astype("i4")
    script = _SCRIPT_OF[np.searchsorted(_STARTS, codes[starts], side="right") - 1]
    return Words(first, starts - edges[text_of], stops - starts, script, trigrams)


def emissions(words: Words, model: Model) -> np.ndarray:
    """Score of each word for each language."""
    out = np.empty((len(words.length), len(model.languages)), "f4")
    ends = np.cumsum(words.length)
    begin = ends - words.length
    for a in range(0, len(out), STEP // 8):
        b = min(len(out), a + STEP // 8)
        own = model.logp[words.trigrams[begin[a] : ends[b - 1]]]
        out[a:b] = np.add.reduceat(own, begin[a:b] - begin[a], axis=0)
    out[~model.allowed[words.script]] -= 1e4
    return out


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each word; all texts advance together, the long ones longest."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    n, base = n[order], first[:-1][order]
    lively = len(n) - np.searchsorted(n[::-1], np.arange(n[0] if len(n) else 0), side="right")  # texts with over t words
    stays = np.empty(scores.shape, bool)
    best = np.empty(len(scores), "i2")
    value = np.zeros((len(n), scores.shape[1]), "f4")
    for t, k in enumerate(lively.tolist()):
        at, v = base[:k] + t, value[:k]
        if t:
            top = v.argmax(axis=1)
            leave = v[np.arange(k), top][:, None] - switch
            stay = v >= leave
            best[at], stays[at] = top, stay
            np.maximum(v, leave, out=v)
            v -= leave + switch
        v += scores[at]
    label = np.empty(len(scores), "i2")
    now = value.argmax(axis=1).astype("i2")
    for t in range(len(lively) - 1, -1, -1):
        k = lively[t]
        at = base[:k] + t
        label[at] = now[:k]
        if t:
            now[:k] = np.where(stays[at, now[:k]], now[:k], best[at])
    return label


def label_texts(texts: list[str], model: Model, switch: float) -> tuple[list[str], list[float], list[list[dict]]]:
    """For each text the language with most letters, its share of them, and the spans."""
    words = words_of(texts)
    label = viterbi(emissions(words, model), words.first, switch)
    count = len(model.languages)
    text_of = np.repeat(np.arange(len(texts)), np.diff(words.first))
    letters = np.bincount(text_of * count + label, weights=words.length, minlength=len(texts) * count).reshape(-1, count)
    new = np.ones(len(label), bool)
    new[1:] = (label[1:] != label[:-1]) | (text_of[1:] != text_of[:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(label)) - 1 if len(label) else heads
    spans: list[list[dict]] = [[] for _ in texts]
    stop = words.start + words.length
    for i, a, b, s in zip(text_of[heads].tolist(), words.start[heads].tolist(), stop[tails].tolist() if len(label) else [], label[heads].tolist(), strict=True):
        spans[i].append({"start": a, "stop": b, "lang": model.languages[s]})
    top, total = letters.argmax(axis=1), letters.sum(axis=1)
    known = [t > 0 and has_letter(x) for t, x in zip(total.tolist(), texts, strict=True)]
    names = [model.languages[k] if ok else UNDETERMINED for k, ok in zip(top.tolist(), known, strict=True)]
    share = [float(letters[i, top[i]] / total[i]) if ok else 0.0 for i, ok in enumerate(known)]
    return names, share, [x if ok else [] for x, ok in zip(spans, known, strict=True)]


def fit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_key: str = "doc_id", sample: int = SAMPLE
) -> Model:
    """Learn from the rows with text and language; ``sample`` bounds, in expectation, how many of them.

    The sample is those with the smallest hashes of ``sample_key`` and text, so it is the same whatever the order.
    Trigrams are counted in tasks and summed by Spark; the driver gets a row for each bucket and language at most.
    Without a labelled row the model knows no language, and every text is undetermined.
    """
    spark = docs.sparkSession
    ship(spark)
    labelled = docs.where(column(docs, lang_col).isNotNull() & column(docs, text_col).isNotNull())
    n = labelled.count()
    parts = 1 << 20
    below = parts if n <= sample else max(1, parts * sample // n)
    picked = F.pmod(F.xxhash64(column(docs, sample_key), F.octet_length(column(docs, text_col))), F.lit(parts)) < below
    rows = labelled.where(picked).select(column(docs, lang_col).cast("string").alias("lang"), column(docs, text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, done = np.array(batch.column(0).to_pylist(), object), 0
            for texts in parts_of(batch.column(1), CHARS):
                words, part = words_of(texts), langs[done : done + len(texts)]
                done += len(texts)
                text_of = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
                own = part[text_of]
                by_letter = np.repeat(own, words.length)
                for lang in dict.fromkeys(part):
                    for key, values in (("trigram", words.trigrams[by_letter == lang]), ("script", words.script[own == lang])):
                        found, times = np.unique(values, return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(found)), pa.array([key] * len(found)), pa.array(found.astype("i4")), pa.array(times.astype("i8"))],
                            ["lang", "kind", "value", "times"],
                        )

    counts = (
        rows.mapInArrow(count, "lang string, kind string, value int, times long")
        .groupBy("lang", "kind", "value")
        .agg(F.sum("times").alias("times"))
        .toArrow()
    )
    langs = np.array(counts["lang"].to_pylist(), object)
    languages = sorted(set(langs))
    kind, value, times = np.array(counts["kind"].to_pylist(), object), counts["value"].to_numpy(), counts["times"].to_numpy()
    logp = np.zeros((BUCKETS, len(languages)), "f4")
    allowed = np.zeros((len(SCRIPT_NAMES), len(languages)), bool)
    for i, lang in enumerate(languages):
        own = (langs == lang) & (kind == "trigram")
        table = np.full(BUCKETS, 0.5)
        table[value[own]] += times[own]
        logp[:, i] = np.log(table / table.sum())
        own = (langs == lang) & (kind == "script")
        allowed[value[own], i] = times[own] >= CANDIDATE_SHARE * max(1, times[own].sum())
    allowed[~allowed.any(axis=1)] = True  # a script that no language has narrows nothing
    return Model(languages, logp, allowed)


def predict(docs: DataFrame, model: Model, text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """(row, lang_pred, score, spans): the language with most letters, its share of all letters, and the labelled spans.

    Null texts, texts without a letter, and all texts of a model without languages: `und`, score 0 and no spans.  Ties
    go to the language that sorts first.  Only the text is looked at, so equal texts have equal results.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # buckets x languages
    rows = docs.select(F.struct(*[column(docs, c) for c in docs.columns]).alias("row"))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("lang", T.StringType())])
    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])
    arrow_span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            names, share, spans = [], [], []
            for texts in parts_of(field_of(batch.column(0), text_col), CHARS):
                if own.languages:
                    a, b, c = label_texts(texts, own, switch)
                else:
                    a, b, c = [UNDETERMINED] * len(texts), [0.0] * len(texts), [[] for _ in texts]
                names += a
                share += b
                spans += c
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(share, pa.float64()), pa.array(spans, arrow_span)], ["row", "lang_pred", "score", "spans"])

    return rows.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """A quarter of all documents, by a checksum of the id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
