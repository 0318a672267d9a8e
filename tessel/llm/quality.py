"""Quality by attention-based multiple-instance learning: a document is a bag of passages, and only it has a label.

Every passage is encoded, gated attention weighs the encodings, and a logistic unit scores their weighted sum.  The
network is fitted with numpy on a bounded sample of labelled documents; scoring runs in Spark's tasks over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.llm.common import column, field, ship
from tessel.llm.text_arrays import BLANK, LOWER, U, field_of, parts_of, run_hashes, runs

#: Words of a passage; the last one of a document has fewer.
PASSAGE = 64
#: Labelled documents that are learnt from, in expectation.
SAMPLE = 4_000
#: Bytes of text that are learnt from at most, and the buckets of hashes by which they are counted.
SAMPLE_BYTES, BUCKETS = 30_000_000, 256
#: Bytes that a task turns into arrays at once; a longer text comes alone.
BYTES = 500_000
FEATURES = 256 + 5


def passages_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the number of passages of each text (1 for a text without words).

    Shares of byte values, and how long, how often repeated and how varied its words are.
    """
    raw = [x.encode("utf-8", "replace") for x in texts]
    joined = b"\n".join(raw)
    data = np.frombuffer(joined, "u1")
    starts, stops = runs(~BLANK[data])
    edges = np.cumsum([0] + [len(x) + 1 for x in raw])
    first = np.searchsorted(starts, edges)  # of each text, its first word
    words = np.diff(first)
    count = np.maximum(1, -(-words // PASSAGE))
    base = np.cumsum(count) - count
    text_of = np.repeat(np.arange(len(texts)), words)
    own = base[text_of] + (np.arange(len(starts)) - first[text_of]) // PASSAGE  # passage of each word
    total = int(count.sum())
    out = np.zeros((total, FEATURES), "f4")
    if len(starts):
        length = stops - starts
        inside = np.repeat(own, length)
        chars = data[~BLANK[data]]
        shares = np.bincount(inside * 256 + chars, minlength=total * 256).reshape(total, 256)
        size = np.maximum(1, shares.sum(axis=1))
        out[:, :256] = np.sqrt(shares / size[:, None])
        n = np.maximum(1, np.bincount(own, minlength=total))
        hashes = run_hashes(np.frombuffer(joined.translate(LOWER), "u1"), starts, stops)
        again = np.zeros(len(starts), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (own[1:] == own[:-1])
        pairs = np.sort((own.astype(U) << U(40)) | (hashes >> U(24)))
        distinct = np.bincount((pairs[np.append(True, pairs[1:] != pairs[:-1])] >> U(40)).astype("i8"), minlength=total)
        out[:, 256] = np.log1p(size / n)
        out[:, 257] = np.bincount(own, again, minlength=total) / n
        out[:, 258] = distinct / n
        out[:, 259] = np.log1p(n) / np.log1p(PASSAGE)
        out[:, 260] = np.sqrt(np.bincount(own, length > 20, minlength=total) / n)
        out[np.bincount(own, minlength=total) == 0] = 0  # without words, whatever else is in the batch
    return out, count


@dataclass
class Network:
    """Encoder, gated attention, and the logistic unit."""

    shift: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.shift) * self.scale) @ self.weights["w"] + self.weights["b"])

    def score(self, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-_forward(self.weights, self.encode(x), count)["logit"]))


def _forward(p: dict, h: np.ndarray, count: np.ndarray) -> dict:
    starts = np.cumsum(count) - count
    t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
    e = (t * g) @ p["a"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), count))
    weight = e / np.repeat(np.add.reduceat(e, starts), count)
    z = np.add.reduceat(weight[:, None] * h, starts, axis=0)
    return {"t": t, "g": g, "weight": weight, "z": z, "logit": z @ p["c"] + p["d"]}


def _gradients(p: dict, x: np.ndarray, count: np.ndarray, y: np.ndarray) -> dict:
    h = np.tanh(x @ p["w"] + p["b"])
    f = _forward(p, h, count)
    starts = np.cumsum(count) - count
    dlogit = (1 / (1 + np.exp(-f["logit"])) - y) / len(y)
    dz = np.repeat(dlogit, count)[:, None] * p["c"]
    dweight = (dz * h).sum(axis=1)
    mean = np.repeat(np.add.reduceat(dweight * f["weight"], starts), count)
    de = f["weight"] * (dweight - mean)
    dtg = de[:, None] * p["a"]
    dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
    dh = f["weight"][:, None] * dz + dt @ p["v"].T + dg @ p["u"].T
    dpre = dh * (1 - h**2)
    return {
        "w": x.T @ dpre, "b": dpre.sum(axis=0), "v": h.T @ dt, "u": h.T @ dg, "a": (f["t"] * f["g"]).T @ de,
        "c": f["z"].T @ dlogit, "d": dlogit.sum(keepdims=True),
    }


def fit_network(
    bags: list[np.ndarray], y: np.ndarray, width: int = 24, gate: int = 16, epochs: int = 40, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7
) -> Network:
    """Adam on the log loss of document labels; same bags in the same order, same network."""
    rng = np.random.default_rng(seed)
    x = np.concatenate(bags) if bags else np.zeros((1, FEATURES), "f4")
    shift, scale = x.mean(axis=0), 1 / (x.std(axis=0) + 0.02)
    shape = {"w": (FEATURES, width), "b": (width,), "v": (width, gate), "u": (width, gate), "a": (gate,), "c": (width,), "d": (1,)}
    p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s).astype("f4") * (k not in "bd") for k, s in shape.items()}
    bags = [(b - shift) * scale for b in bags]
    m, v, step = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2)), None, 0
    m, v = m
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for a in range(0, len(order), batch):
            own = order[a : a + batch]
            grads = _gradients(p, np.concatenate([bags[i] for i in own]), np.array([len(bags[i]) for i in own]), y[own])
            step += 1
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + decay * p[k])
    return Network(shift, scale, {k: w.astype("f4") for k, w in p.items()})


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, **network
) -> Network:
    """Learn from a bounded sample of the labelled documents: the smallest hashes of the id.

    ``sample`` bounds how many of them, in expectation, and ``sample_bytes`` how much text: the driver gets some three
    times as many bytes of features.  Hash buckets that would pass the bound are left out.

    Rows without a label or an id, and labels without a document, are left out; a label that is repeated counts once.
    Without any labelled document the network is as it was initialised.
    """
    spark = docs.sparkSession
    ship(spark)
    marked = labels.where(column(labels, label_col).isNotNull() & column(labels, id_col).isNotNull()).select(column(labels, id_col).alias("id"), column(labels, label_col).cast("double").alias("label")).distinct()
    n, parts = marked.count(), 1 << 20
    below = parts if n <= sample else max(1, parts * sample // n)
    place = F.pmod(F.xxhash64("id"), F.lit(parts))
    picked = marked.where(place < below)  # some SAMPLE rows, whatever the size of the table
    texts = docs.select(column(docs, id_col).alias("id"), F.coalesce(column(docs, text_col), F.lit("")).alias("text"))
    known = texts.join(F.broadcast(picked), "id").withColumn("bucket", (place * BUCKETS / below).cast("int"))
    sizes = known.groupBy("bucket").agg(F.sum(F.octet_length("text"))).sort("bucket").collect()  # BUCKETS rows
    total, taken = 0, []
    for bucket, size in sizes:
        if total + size <= sample_bytes:
            total += size
            taken.append(bucket)
    known = known.where(F.col("bucket").isin(taken)) if len(taken) < len(sizes) else known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [passages_of([x])[0].tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["id", "label", "bag"])

    rows = known.select("id", "label", "text").mapInArrow(run, "id long, label double, bag binary").toArrow()
    rows = rows.sort_by([("id", "ascending"), ("label", "ascending")])
    bags = [np.frombuffer(b, "f4").reshape(-1, FEATURES) for b in rows["bag"].to_pylist()]
    return fit_network(bags, rows["label"].to_numpy(), **network)


def predict(docs: DataFrame, network: Network, text_col: str = "text") -> DataFrame:
    """(row, score): the probability of label 1 for each row, from its whole text alone.

    Null, empty and blank texts are one passage without words and have one and the same score.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(network)  # a few thousand numbers
    rows = docs.select(F.struct(*[column(docs, c) for c in docs.columns]).alias("row"))
    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores = [own.score(*passages_of(texts)) for texts in parts_of(field_of(batch.column(0), text_col), BYTES)]
            made = np.concatenate(scores).astype("f8") if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], ["row", "score"])

    return rows.mapInArrow(run, schema)


#: From this score on a document is kept.
KEEP = 0.7


def drop_low_quality(docs: DataFrame, network: Network, text_col: str = "text", least: float = KEEP) -> DataFrame:
    """The rows whose score is at least ``least``, with the same columns."""
    return predict(docs, network, text_col).where(F.col("score") >= least).select(*[field("row", c).alias(c) for c in docs.columns])
