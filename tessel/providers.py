"""Encoders and detectors are producers of columns; the operators take any that have these methods.

The ones here need no model and no network.  They are deterministic stand-ins, not neural encoders: hashed n-grams for
texts, colour shares for images, and the whole image as the one box.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.images import salient
from tessel.functions.text import SPACE, or_default
from tessel.functions.vector import normalised
from tessel.operators.intent import prompts
from tessel.plans.lexicon import DEFAULT, Lexicon
from tessel.session import ship_active

#: Sides of the grey image that stands for one that can't be read, and its level.
GREY_SIDE, GREY = 224, 128
#: What a detector says of an image.
BOXES = "array<struct<box:array<double>,confidence:double,class_name:string>>"


class TextEncoder(Protocol):
    dim: int

    def encode(self, text: Column) -> Column:
        """A unit vector (array of floats) for each text."""


class ImageEncoder(Protocol):
    dim: int

    def encode(self, image: Column) -> Column:
        """A unit vector for each image, a struct as Spark's image source has it."""


class Detector(Protocol):
    def boxes(self, image: Column) -> Column:
        """An array of (box, confidence, class_name) for each image."""


def _unit(counts: np.ndarray) -> pd.Series:
    length = np.linalg.norm(counts, axis=1, keepdims=True)
    return pd.Series(list((counts / np.where(length > 0, length, 1)).astype("f4")))


def _hashed(texts: list[str], dim: int, n: int) -> np.ndarray:
    """Signed counts of hashed n-grams of characters, for all texts at once."""
    padded = [f" {t} ".lower() if t else "" for t in texts]
    code = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    size = np.array([len(x) for x in padded], "i8")
    owner = np.repeat(np.arange(len(padded)), size)
    at = np.arange(max(0, len(code) - n + 1))
    at = at[owner[at] == owner[at + n - 1]] if len(at) else at
    h = np.zeros(len(at), "u8")
    for i in range(n):
        h = (h ^ code[at + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    slot = owner[at] * dim + (h % np.uint64(dim)).astype("i8")
    return np.bincount(slot, np.where(h >> np.uint64(63), 1.0, -1.0), minlength=len(padded) * dim).reshape(len(padded), dim)


def hashed_ngrams(text: Column, dim: int = 64, n: int = 3, batch: int = 1024) -> Column:
    """A unit vector of hashed character n-grams, signed by the hash; not a neural encoder.  Null and empty text: zeros.

    ``batch`` texts are encoded at once.
    """

    ship_active()

    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:  # no iterator: functions of one stage then share a Python worker
        parts = [_unit(_hashed([t or "" for t in texts[a : a + batch]], dim, n)) for a in range(0, len(texts), batch)]
        return pd.concat(parts, ignore_index=True) if parts else pd.Series([], dtype=object)

    return encode(text)


class HashedText:
    """Hashed n-grams; null and blank texts count as a default one.  Of a text the first ``limit`` tokens count, between blanks."""

    def __init__(self, dim: int = 64, n: int = 3, default: str = "fashion product", limit: int = 77, batch: int = 1024) -> None:
        self.dim, self.n, self.default, self.limit, self.batch = dim, n, default, limit, batch

    def encode(self, text: Column) -> Column:
        words = F.split(or_default(text, self.default), f"[{SPACE}]+")
        return hashed_ngrams(F.array_join(F.slice(words, 1, self.limit), " "), self.dim, self.n, self.batch)


def with_vectors(rows: DataFrame, encoder: TextEncoder, text_col: str, out_col: str = "vector") -> DataFrame:
    """All columns and ``out_col``: each different text is encoded once, however many rows have it.  Null texts count as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    known = rows.select(text.alias("_encoded")).distinct().withColumn(out_col, encoder.encode(F.col("_encoded")))
    return rows.withColumn("_encoded", text).join(known, "_encoded", "left").drop("_encoded")


def can_be_read(image: Column) -> Column:
    return F.coalesce((image["height"] > 0) & (F.octet_length(image["data"]) > 0), F.lit(False))


def readable(image: Column) -> Column:
    """The image, or a grey one where it is missing or couldn't be decoded."""
    size = F.greatest(F.coalesce(image["height"], F.lit(0)), F.lit(0)) * 0 + GREY_SIDE * GREY_SIDE * 3  # by row: no plan holds the pixels
    grey = F.struct(
        F.coalesce(image["origin"], F.lit("")).alias("origin"), F.lit(GREY_SIDE).alias("height"), F.lit(GREY_SIDE).alias("width"), F.lit(3).alias("nChannels"), F.lit(16).alias("mode"),
        F.unhex(F.repeat(F.lit(f"{GREY:02x}"), size)).alias("data"),
    )
    return F.when(can_be_read(image), image).otherwise(grey)


class ColourImage:
    """Shares of colours in a coarse cube, ``side`` levels a channel; grey images count their level in each channel."""

    def __init__(self, side: int = 4) -> None:
        self.side, self.dim = side, side**3

    def encode(self, image: Column) -> Column:
        side, dim = self.side, self.dim
        ship_active()

        @F.pandas_udf("array<float>")
        def encode(data: pd.Series, channels: pd.Series) -> pd.Series:
            counts = np.zeros((len(data), dim))
            for i, (raw, n) in enumerate(zip(data, channels, strict=True)):
                level = np.frombuffer(raw, "u1").reshape(-1, int(n))[:, :3].astype("i8") * side // 256 if raw is not None else np.array([[GREY * side // 256]])
                cell = level @ np.array([side * side, side, 1]) if level.shape[1] == 3 else level[:, 0] * (side * side + side + 1)
                counts[i] = np.bincount(cell, minlength=dim)
            return _unit(counts)

        ok = can_be_read(image)
        return encode(F.when(ok, image["data"]), F.when(ok, image["nChannels"]))


class SalientBox:
    """At most one box: that of what stands out against the image's edge."""

    def boxes(self, image: Column) -> Column:
        found = salient(F.when(can_be_read(image), image))
        return F.when(found.isNull(), F.array().cast(BOXES)).otherwise(F.array(F.struct(found.alias("box"), F.lit(0.88).alias("confidence"), F.lit("focused_product").alias("class_name"))))


class WholeImage:
    """One box that is the whole image, as something in focus."""

    def boxes(self, image: Column) -> Column:
        side = lambda c: F.when(can_be_read(image), image[c]).otherwise(GREY_SIDE).cast("double")
        edge = [F.lit(0.0), F.lit(0.0), side("width"), side("height")]
        return F.array(F.struct(F.array(*edge).alias("box"), F.lit(0.88).alias("confidence"), F.lit("focused_product").alias("class_name")))


def with_ensemble(queries: DataFrame, encoder: TextEncoder, text_col: str = "query", out_col: str = "vector", lexicon: Lexicon = DEFAULT) -> DataFrame:
    """All columns and ``out_col``: the unit mean of the vectors of a query's phrasings (see ``prompts``).

    Phrasings follow from the text alone, so each different text is phrased once and each different phrasing encoded once, in one pass.
    Null queries count as empty ones.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    phrases = queries.select(text.alias("_text")).distinct().select("_text", F.explode(prompts(F.col("_text"), lexicon)).alias("_phrase"))
    parts = with_vectors(phrases, encoder, "_phrase", "_v").select("_text", F.posexplode("_v").alias("_at", "_x"))
    means = parts.groupBy("_text", "_at").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    vectors = means.groupBy("_text").agg(F.array_sort(F.collect_list(F.struct("_at", "_m")))["_m"].alias("_m"))
    vectors = vectors.select("_text", normalised(F.col("_m")).cast("array<float>").alias(out_col))
    return queries.withColumn("_text", text).join(vectors, "_text", "left").drop("_text")
