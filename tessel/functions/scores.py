"""Scalar score functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def calibrate(score: Column) -> Column:
    """Similarities across modalities lie low: [0.12, 0.34] is stretched to [0.24, 0.95], what is below is doubled."""
    stretched = clip(F.lit(0.24) + (score - 0.12) / 0.22 * 0.71)
    return F.when(score <= 0.12, F.greatest(F.lit(0.0), score * 2.0)).otherwise(stretched)


def blend_image(image: Column, text: Column, primary: float = 0.75, secondary: float = 0.25) -> Column:
    return primary * image + secondary * calibrate(text)


def blend_text(
    image: Column, text: Column, ngram: Column | None = None, disqualified: Column | None = None, primary: float = 0.75, secondary: float = 0.25, ngram_weight: float = 0.30
) -> Column:
    """Text similarity first; a context score is mixed in where there is one, and a mismatch gives 0."""
    base = primary * text + secondary * calibrate(image)
    if ngram is not None:
        base = clip((1 - ngram_weight) * base + ngram_weight * F.when(ngram > 0, ngram).otherwise(base))
    return base if disqualified is None else F.when(disqualified, F.lit(0.0)).otherwise(base)


def fuse_weighted(image: Column, title: Column, mode: str, weights: tuple[float, float] | None = None) -> Column:
    """Weighted sum; for an image query a near-identical image decides almost alone."""
    w_image, w_title = weights or ((0.85, 0.15) if mode == "image" else (0.25, 0.75))
    plain = w_image * image + w_title * title
    if mode != "image":
        return plain
    same = F.when(title == 0, image).otherwise(0.95 * image + 0.05 * title)
    return F.when(image >= 0.95, same).otherwise(plain)


def fuse_mean(image: Column, title: Column) -> Column:
    return (image + title) / 2


def fuse_ranks(image_rank: Column, title_rank: Column, missing: int, k: int = 60) -> Column:
    """Reciprocal ranks; a missing rank counts as one after the pool."""
    one = lambda r: 1.0 / (k + F.coalesce(r, F.lit(missing)))
    return one(image_rank) + one(title_rank)
