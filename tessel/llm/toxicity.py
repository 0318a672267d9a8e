"""Toxicity: a noisy channel restores spelled-over words, and a logistic model scores the restored text.

1. Spark counts the letter grams of all documents; what looks spelled over takes no part.  The counts are hashed into a fixed
   number of buckets, so the character model is bounded, whatever the corpus.
2. Of all labelled documents Spark counts how many of either label hold each word and each beginning of a word; those that tell
   the labels apart best (G² on documents) are the model's terms.
3. A logistic model with a ridge is fitted on the rates of these terms per word in a bounded sample of labelled documents.

Spans are decoded by Viterbi (``noisy_channel``) before words are counted, in learning and in scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.llm.common import column, keep, ship
from tessel.llm.noisy_channel import BUCKETS, ORDER, CharModel, Decoder, decoded, gram_buckets, scan
from tessel.llm.text_arrays import U, field_of, mix, parts_of, run_hasher, trim

#: Lengths of the beginnings of words that may be terms, next to whole words.
BEGINNINGS = (3, 4, 5, 6, 7)
#: Terms of the model, and how many are compared for that: those that most documents of label 1 hold.
TERMS, CANDIDATES = 256, 1 << 16
#: A term is held by at least so many documents of label 1.
LEAST = 3
#: Labelled documents that the logistic model is fitted on, in expectation.
SAMPLE = 20_000
RIDGE = 4.0
#: Bytes of text that a task turns into arrays at once; a longer text comes alone.
PART = 500_000
#: Up to so many labels are sent to all tasks, at some 30 bytes each; more of them meet the texts in a shuffle.
BROADCAST_LABELS = 2_000_000
#: From this score on a document counts as toxic.
TOXIC = 0.5


@dataclass
class Bag:
    """Terms of some texts: the text and the hash of each occurrence, and the words of each text."""

    text: np.ndarray
    term: np.ndarray
    words: np.ndarray


def bag_of(texts: list[str], decoder: Decoder, spans: list[list[dict]] | None = None) -> Bag:
    """Terms of the restored texts.  ``spans`` gets, for each text, the spans that were decoded to something else."""
    found = scan(texts)
    restored, owner = [], []
    places = found.text_of(found.spans[:, 0]).tolist() if len(found.spans) else []
    for (a, b, words), i in zip(decoded(found, decoder), places, strict=True):
        restored += words
        owner += [i] * len(words)
        if spans is not None and (own := " ".join(words)) != found.lowered[a:b]:
            base = int(found.edges[i])
            spans[i].append({"start": a - base, "stop": b - base, "text": own})
    more = np.frombuffer(" ".join(restored).encode("utf-32-le", "surrogatepass"), "<u4")
    stops = np.cumsum([len(w) + 1 for w in restored]) - 1 if restored else np.zeros(0, "i8")
    starts = stops - np.array([len(w) for w in restored], "i8")
    codes = np.concatenate([found.codes, more])
    starts = np.concatenate([found.starts, starts + len(found.codes)])
    stops = np.concatenate([found.stops, stops + len(found.codes)])
    text = np.concatenate([found.text_of(found.starts), np.array(owner, "i8")])
    length = stops - starts
    hashed = run_hasher(codes)
    hashes, owners = [hashed(starts, stops)], [text]
    for k in BEGINNINGS:
        long = length >= k
        hashes.append(hashed(starts[long], starts[long] + k) + U(k))  # not the hash of a whole word
        owners.append(text[long])
    return Bag(np.concatenate(owners), np.concatenate(hashes), np.bincount(text, minlength=len(texts)))


@dataclass
class Model:
    """The character model, the terms (sorted hashes) and their weights per rate."""

    chars: CharModel
    terms: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.terms >> U(48)).astype("i8")] = True

    def rates(self, bag: Bag) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, occurrences per word) of the model's terms."""
        likely = self.maybe[(bag.term >> U(48)).astype("i8")]
        text, term = bag.text[likely], bag.term[likely]
        at = np.minimum(np.searchsorted(self.terms, term), max(0, len(self.terms) - 1))
        known = self.terms[at] == term if len(self.terms) else np.zeros(len(term), bool)
        pairs, times = np.unique(text[known] * max(1, len(self.terms)) + at[known], return_counts=True)
        text, at = pairs // max(1, len(self.terms)), pairs % max(1, len(self.terms))
        return text, at, times / bag.words[text]

    def scores(self, bag: Bag) -> np.ndarray:
        text, at, rate = self.rates(bag)
        logit = self.bias + np.bincount(text, self.weights[at] * rate, len(bag.words))
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def count_grams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Grams of the words of all documents, ORDER x BUCKETS counts: each task counts its texts, and Spark sums by bucket."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((ORDER, BUCKETS), "i8")
        for batch in batches:
            for texts in parts_of(batch.column(0), PART):
                found = scan(texts)
                for k, buckets in enumerate(gram_buckets(found.codes, found.starts, found.stops)):
                    counts[k] += np.bincount(buckets, minlength=BUCKETS)
        places = np.flatnonzero(counts.ravel())
        for a in range(0, len(places), 1 << 16):
            own = places[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype("i4")), pa.array(counts.ravel()[own])], ["place", "n"])

    texts = docs.select(F.coalesce(column(docs, text_col).cast("string"), F.lit("")).alias("text"))
    summed = texts.mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # ORDER x BUCKETS rows at most
    counts = np.zeros(ORDER * BUCKETS, "f4")
    counts[summed["place"].to_numpy()] = summed["n"].to_numpy()
    return counts.reshape(ORDER, BUCKETS)


def count_documents(known: DataFrame, grams: np.ndarray, only: np.ndarray | None = None) -> DataFrame:
    """(term, n): how many of the documents (text) hold each term, or each of ``only`` (sorted).  Tasks count first."""
    shared = known.sparkSession.sparkContext.broadcast((CharModel(grams), only))  # buckets and candidates: bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, only = shared.value
        decoder = model.decoder()
        terms, numbers, held = [], [], 0

        def summed() -> pa.RecordBatch:
            found, where = np.unique(np.concatenate(terms), return_inverse=True)
            n = np.bincount(where, np.concatenate(numbers), len(found))
            return pa.RecordBatch.from_arrays([pa.array(found.view("i8")), pa.array(n.astype("i8"))], ["term", "n"])

        for batch in batches:
            for texts in parts_of(batch.column(0), PART):
                bag = bag_of(texts, decoder)
                text, term = bag.text, bag.term
                if only is not None:
                    at = np.minimum(np.searchsorted(only, term), len(only) - 1)
                    text, term = text[only[at] == term], term[only[at] == term]
                order = np.lexsort((text, term))
                text, term = text[order], term[order]
                new = np.append(True, (text[1:] != text[:-1]) | (term[1:] != term[:-1]))[: len(term)]
                found, n = np.unique(term[new], return_counts=True)
                terms.append(found)
                numbers.append(n)
                held += len(found)
            if held > 1 << 21:
                yield summed()
                terms, numbers, held = [], [], 0
        if held:
            yield summed()

    return known.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def g_squared(k: np.ndarray, n: int, m: np.ndarray, total: int) -> np.ndarray:
    """Twice the log likelihood ratio of holding a term and the label: k of n documents with label 1 hold it, m of all ``total``."""
    out = np.zeros(len(k))
    for seen, row, col in ((k, m, n), (m - k, m, total - n), (n - k, total - m, n), (total - n - m + k, total - m, total - n)):
        expected = row * (col / total)
        out += 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias of the columns, each scaled to unit size: Newton's method on the log loss with a ridge on the weights."""
    scale = np.sqrt((x**2).mean(axis=0)) + 1e-12 if len(x) else np.ones(x.shape[1])
    z = np.concatenate([x / scale, np.ones((len(x), 1))], axis=1)
    w, penalty = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w = w + step * min(1.0, 10 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1] / scale, float(w[-1])


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, terms: int = TERMS
) -> Model:
    """Learn the letter grams of all documents, and terms and weights from the labelled ones.

    Rows without a label or an id, and labels without a document, are left out; a label that is repeated counts once.  Null texts are empty.
    Without labelled documents of both kinds the score is the same for all texts, a half.
    """
    ship(docs.sparkSession)
    grams = count_grams(docs, text_col)
    marked = labels.where(column(labels, label_col).isNotNull() & column(labels, id_col).isNotNull())
    marked = marked.select(column(labels, id_col).alias("id"), (column(labels, label_col) == 1).cast("int").alias("label")).distinct()
    texts = docs.select(column(docs, id_col).alias("id"), F.coalesce(column(docs, text_col).cast("string"), F.lit("")).alias("text"))
    few = marked.count() <= BROADCAST_LABELS
    known = texts.join(F.broadcast(marked), "id") if few else keep(texts.join(marked, "id"))  # else texts are shuffled, but once
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n, total = sizes.get(1, 0), sum(sizes.values())
    if not n or n == total:
        return Model(CharModel(grams), np.zeros(0, U), np.zeros(0), 0.0)
    held = count_documents(known.where("label = 1"), grams).where(F.col("n") >= LEAST)
    held = held.orderBy(F.desc("n"), "term").limit(CANDIDATES).toArrow()
    candidates, k = held["term"].to_numpy().view(U), held["n"].to_numpy()
    order = np.argsort(candidates)
    candidates, k = candidates[order], k[order]
    if not len(candidates):
        return Model(CharModel(grams), np.zeros(0, U), np.zeros(0), float(np.log(n / (total - n))))
    others = count_documents(known.where("label = 0"), grams, candidates).toArrow()
    m = k.copy()
    m[np.searchsorted(candidates, others["term"].to_numpy().view(U))] += others["n"].to_numpy()
    telling = np.where(k * total > m * n, g_squared(k, n, m, total), 0)  # held more often with label 1
    best = np.sort(np.lexsort((candidates, -telling))[:terms])
    model = Model(CharModel(grams), candidates[best], np.zeros(len(best)), 0.0)
    parts = 1 << 20
    below = parts if total <= sample else max(1, parts * sample // total)
    picked = known.where(F.pmod(F.xxhash64("id"), F.lit(parts)) < below)
    x, y = term_rates(picked, model)
    model.weights, model.bias = fit_logistic(x, y)
    return model


def term_rates(known: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Rates of the model's terms in some documents, and their labels; in a fixed order."""
    shared = known.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, decoder = shared.value, shared.value.chars.decoder()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, at, rate = own.rates(bag_of([text], decoder))
                yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([at.astype("<i4").tobytes()]), pa.array([rate.astype("<f4").tobytes()])], ["label", "at", "rate"])

    rows = known.select("text", "label").mapInArrow(run, "label int, at binary, rate binary").toArrow().sort_by([("label", "ascending"), ("at", "ascending"), ("rate", "ascending")])
    x = np.zeros((len(rows), len(model.terms)), "f4")
    for i, (at, rate) in enumerate(zip(rows["at"].to_pylist(), rows["rate"].to_pylist(), strict=True)):
        x[i, np.frombuffer(at, "<i4")] = np.frombuffer(rate, "<f4")
    return x, rows["label"].to_numpy().astype("f8")


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(row, score, spans): how likely label 1 is, from the whole text alone, and what was decoded.

    spans: start and stop in code points, and the words there, lower-cased; spans that are what they look like aren't listed.
    Null and empty texts, and those without words, have the score of a text without terms.  Equal texts have equal scores.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets and terms
    rows = docs.select(F.struct(*[column(docs, c) for c in docs.columns]).alias("row"))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("text", T.StringType())])
    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])
    arrow_span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        own, decoder = shared.value, shared.value.chars.decoder()
        for batch in batches:
            scores, spans = [], []
            for texts in parts_of(field_of(batch.column(0), text_col), PART):
                part: list[list[dict]] = [[] for _ in texts]
                scores.append(own.scores(bag_of(texts, decoder, part)))
                spans += part
            made = np.concatenate(scores).astype("f8") if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made), pa.array(spans, arrow_span)], ["row", "score", "spans"])

    return rows.mapInArrow(run, schema)


def restored(text: str, spans: list[dict]) -> str:
    """The text with its decoded spans in place."""
    out, at = [], 0
    for s in spans:
        out += [text[at : s["start"]], s["text"]]
        at = s["stop"]
    return "".join([*out, text[at:]])


def held_out(doc_id: Column) -> Column:
    """A fifth of all documents, by a checksum of the id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
