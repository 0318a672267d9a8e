"""Bounding boxes (left, top, right, bottom) of detected things."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(box: Column) -> Column:
    return (box[2] - box[0]) * (box[3] - box[1])


def padded(box: Column, width: Column, height: Column, share: float = 0.05) -> Column:
    """Grown by a share of its sides, clamped to the image, and cut to whole pixels."""
    dx, dy = (box[2] - box[0]) * share, (box[3] - box[1]) * share
    return F.array(
        F.greatest(F.lit(0.0), box[0] - dx).cast("int"),
        F.greatest(F.lit(0.0), box[1] - dy).cast("int"),
        F.least(width.cast("double"), box[2] + dx).cast("int"),
        F.least(height.cast("double"), box[3] + dy).cast("int"),
    )


def crop(box: Column, width: Column, height: Column) -> Column:
    """The padded box if a crop is worth it: the box is below 95 % of the image and the crop has over 20 pixels each way."""
    own = padded(box, width, height)
    worth = (area(box) < 0.95 * width * height) & (own[2] - own[0] > 20) & (own[3] - own[1] > 20)
    return F.when(worth, own)
