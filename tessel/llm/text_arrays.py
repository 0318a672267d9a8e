"""Texts of a batch as flat numpy arrays: what several operators do inside their tasks, without a loop over words."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
MIX = 0xD6E8FEB86659FD93
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 2**64)
#: ASCII white space: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def trim() -> None:
    """Give memory that finished work left in this Python worker back to the system: workers live on from stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    h = (h ^ (h >> U(32))) * U(MIX)
    h = (h ^ (h >> U(32))) * U(MIX)
    return h ^ (h >> U(32))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, U(_MULTIPLIER)), np.full(n, U(_INVERSE))
    up[0] = down[0] = U(1)
    return np.cumprod(up), np.cumprod(down)


def run_hasher(data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of starts and stops: 64-bit hashes of data[start:stop]; equal runs have equal hashes wherever they stand."""
    up, down = _powers(1 << max(16, int(len(data)).bit_length()))
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=total[1:])
    return lambda starts, stops: mix((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(U))


def run_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:stop] for each run."""
    return run_hasher(data)(starts, stops) if len(starts) else np.zeros(0, U)


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs of True."""
    edges = np.flatnonzero(np.diff(inside.view("i1"), prepend=0, append=0))
    return edges[::2], edges[1::2]


def slices(sizes: list[int], most: int) -> Iterator[slice]:
    """Consecutive rows of at most ``most`` in total, or one larger row."""
    first = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(first, i)
            first, total = i, 0
        total += n
    if sizes:
        yield slice(first, len(sizes))


def field_of(rows: pa.StructArray, name: str) -> pa.Array:
    """A text field of a column of structs, empty where it is null: a text travels once, inside its row."""
    return pc.fill_null(rows.field(rows.type.get_field_index(name)), "")


def parts_of(column: pa.Array, most: int) -> Iterator[list[str]]:
    """A column of texts as lists of consecutive ones, each of at most ``most`` bytes in total, or one longer text."""
    for part in slices(pc.binary_length(column).to_pylist(), most):
        yield column.slice(part.start, part.stop - part.start).to_pylist()


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Whether a code point is a letter or a mark that belongs to one."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), bool, 0x110000)


def same_length_lower(text: str) -> str:
    """Lower case, letter by letter where a few letters would become two."""
    lowered = text.lower()
    return lowered if len(lowered) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))
