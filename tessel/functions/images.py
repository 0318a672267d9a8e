"""Images as Spark's image source has them: cutting a box out of one, and the box of what stands out in it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessel.session import ship_active

#: A region counts from this share of the image on and below that one, and with sides of more than so many pixels.
LEAST_SHARE, MOST_SHARE, LEAST_SIDE = 0.04, 0.95, 20
#: Side of the square by which regions are closed.
CLOSING = 17
#: Weights of blue, green and red, as the image source orders them, in a grey level.
GREY_WEIGHTS = np.array([0.114, 0.587, 0.299])


def pixels(data: bytes | None, height: int, width: int, channels: int) -> np.ndarray | None:
    """Height x width x channels; none where the numbers don't fit the data."""
    fits = data is not None and min(height, width, channels) > 0 and len(data) == height * width * channels
    return np.frombuffer(data, "u1").reshape(height, width, channels) if fits else None


def parts(image: Column) -> list[Column]:
    return [image["data"], *(F.coalesce(image[c], F.lit(0)) for c in ("height", "width", "nChannels"))]


def cut(image: Column, box: Column) -> Column:
    """The part of the image inside a box of whole pixels (left, top, right, bottom), which is clamped to it.

    Null where the image or the box is, where the pixels don't fit the image's sides, and where nothing is left.
    """

    ship_active()

    @F.pandas_udf("binary")
    def inside(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            out = []
            for data, height, width, channels, a, b, c, d in zip(*columns, strict=True):
                own = pixels(data, int(height), int(width), int(channels)) if a == a and a is not None else None
                out.append(own[int(b) : int(d), int(a) : int(c)].tobytes() or None if own is not None else None)
            yield pd.Series(out)

    low = lambda x: F.greatest(F.lit(0), x).cast("int")
    left, top = low(box[0]), low(box[1])
    right, bottom = F.least(image["width"], low(box[2])), F.least(image["height"], low(box[3]))
    data = inside(*parts(image), *(F.when(box.isNotNull(), x) for x in (left, top, right, bottom)))
    made = F.struct(
        image["origin"].alias("origin"), (bottom - top).alias("height"), (right - left).alias("width"), image["nChannels"].alias("nChannels"), image["mode"].alias("mode"), data.alias("data")
    )
    return F.when(box.isNotNull() & (right > left) & (bottom > top) & data.isNotNull(), made)


def grey_levels(image: np.ndarray) -> np.ndarray:
    return np.rint(image[:, :, :3] @ GREY_WEIGHTS).astype("u1") if image.shape[2] >= 3 else image[:, :, 0]


def blurred(grey: np.ndarray) -> np.ndarray:
    """Each pixel with its neighbours up to two away, weighted 1 4 6 4 1 each way; mirrored at the edges."""
    out = grey.astype("f8")
    for axis in (0, 1):
        edge = [(2, 2) if axis == k else (0, 0) for k in (0, 1)]
        wide = np.pad(out, edge, "reflect" if out.shape[axis] > 2 else "edge")
        n = out.shape[axis]
        out = sum(w * wide.take(range(i, i + n), axis) for i, w in enumerate((1, 4, 6, 4, 1))) / 16
    return np.rint(out).astype("u1")


def best_threshold(grey: np.ndarray) -> int:
    """The level up to which pixels are one class, so that the two classes' means are furthest apart (weighted); the first on ties."""
    counts = np.bincount(grey.ravel(), minlength=256).astype("f8")
    low, total = np.cumsum(counts), counts.sum()
    weighted = np.cumsum(counts * np.arange(256))
    with np.errstate(invalid="ignore", divide="ignore"):
        spread = (weighted[-1] * low - weighted * total) ** 2 / (low * (total - low))
    return int(np.nanargmax(np.append(np.nan_to_num(spread[:-1]), 0)))


def window_sums(mask: np.ndarray, side: int) -> np.ndarray:
    """For each pixel, how many of the square around it are set; nothing is beyond the edges."""
    out = mask.astype("i8")
    for axis in (0, 1):
        n, half = out.shape[axis], side // 2
        total = np.concatenate([np.zeros_like(out.take([0], axis)), np.cumsum(out, axis)], axis)
        out = total.take(np.minimum(np.arange(n) + half + 1, n), axis) - total.take(np.maximum(np.arange(n) - half, 0), axis)
    return out


def closed(mask: np.ndarray, side: int = CLOSING) -> np.ndarray:
    """The mask grown by a square and shrunk again: gaps narrower than the square are filled."""
    grown = window_sums(mask, side) > 0
    return window_sums(grown, side) == window_sums(np.ones_like(mask), side)


def regions(mask: np.ndarray, corners: bool = True) -> list[list[tuple[int, int, int]]]:
    """Connected regions, each as its runs (row, start, stop), in the order of their first runs; ``corners`` connect or don't."""
    found: list[tuple[int, int, int]] = []
    owner: list[int] = []

    def root(i: int) -> int:
        while owner[i] != i:
            owner[i] = owner[owner[i]]
            i = owner[i]
        return i

    above: list[int] = []
    reach = 1 if corners else 0
    for y in range(len(mask)):
        edges = np.flatnonzero(np.diff(mask[y].astype("i1"), prepend=0, append=0)).tolist()
        row, k = [], 0
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            me = len(found)
            found.append((y, a, b))
            owner.append(me)
            row.append(me)
            while k < len(above) and found[above[k]][2] + reach <= a:
                k += 1
            j = k
            while j < len(above) and found[above[j]][1] < b + reach:
                x, z = root(above[j]), root(me)
                owner[max(x, z)] = min(x, z)
                j += 1
        above = row
    out: dict[int, list[tuple[int, int, int]]] = {}
    for i, run in enumerate(found):
        out.setdefault(root(i), []).append(run)
    return list(out.values())


def filled_area(own: list[tuple[int, int, int]], left: int, top: int, right: int, bottom: int) -> int:
    """Pixels of a region and of its holes."""
    inside = np.zeros((bottom - top + 2, right - left + 2), bool)
    for y, a, b in own:
        inside[y - top + 1, a - left + 1 : b - left + 1] = True
    outside = regions(~inside, corners=False)[0]  # the frame around it
    return inside.size - sum(b - a for _, a, b in outside)


def salient_box(image: np.ndarray) -> list[float] | None:
    """The bounding box of the largest region that stands out against the edge of the image, or none.

    Grey levels are blurred and split in two by Otsu's threshold; the side that covers less of the image's edge is what stands out.
    It is closed, and of its regions with a fitting area (holes included) and sides the one with the largest box counts.
    """
    grey = blurred(grey_levels(image))
    dark = grey <= best_threshold(grey)
    edge = np.concatenate([dark[0], dark[-1], dark[:, 0], dark[:, -1]])
    height, width = grey.shape
    best, most = None, 0
    for own in regions(closed(dark if edge.mean() < 0.5 else ~dark)):
        left, right = min(a for _, a, _ in own), max(b for _, _, b in own)
        top, bottom = own[0][0], own[-1][0] + 1
        size = (right - left) * (bottom - top)
        if min(right - left, bottom - top) > LEAST_SIDE and size > most and LEAST_SHARE * height * width < filled_area(own, left, top, right, bottom) < MOST_SHARE * height * width:
            best, most = [float(left), float(top), float(right), float(bottom)], size
    return best


def salient(image: Column) -> Column:
    """``salient_box`` of each image as an array; null where there is none, or no image that can be read."""

    ship_active()

    @F.pandas_udf("array<double>")
    def boxes(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            own = (pixels(data, int(h), int(w), int(c)) for data, h, w, c in zip(*columns, strict=True))
            yield pd.Series([None if x is None else salient_box(x) for x in own], dtype=object)

    return boxes(*parts(image))
