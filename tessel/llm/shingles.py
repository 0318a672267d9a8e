"""Shingle sets of texts, and parity sketches of sets."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tessel.llm.text_arrays import BLANK, LOWER, U, mix, run_hashes, runs

ROLL = U(0x9E3779B97F4A7C15)


@dataclass
class Sets:
    """Sets of 64-bit hashes: sorted members, one set after the other, and where each begins."""

    members: np.ndarray
    bounds: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.members[self.bounds[i] : self.bounds[i + 1]]

    def of_each(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.sizes)


def shingle_sets(texts: list[bytes], size: int) -> Sets:
    """The distinct shingles of ``size`` words of each text; with fewer words, the whole sequence as one; no words, none.

    Words are runs of other than ASCII white space, A-Z in lower case.
    """
    data = np.frombuffer(b"\n".join(texts).translate(LOWER), "u1")
    starts, stops = runs(~BLANK[data])
    words = run_hashes(data, starts, stops)
    first = np.searchsorted(starts, np.cumsum([0] + [len(x) + 1 for x in texts]))
    count = np.diff(first)
    n = len(words)
    gram, ends = np.zeros(n, U), np.repeat(first[1:], count)
    for i in range(size):
        more = np.flatnonzero(np.arange(n) + i < ends)  # a text of fewer words has its only shingle at its first word
        gram[more] = mix(gram[more] * ROLL + words[more + i] + U(1))
    whole = np.arange(n) + size <= ends
    whole[first[:-1][(count > 0) & (count < size)]] = True
    at = np.flatnonzero(whole)
    owner, gram = np.repeat(np.arange(len(texts)), count)[at], gram[at]
    order = np.lexsort((gram, owner))
    owner, gram = owner[order], gram[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    return Sets(gram[new], np.searchsorted(owner[new], np.arange(len(texts) + 1)))


def set_hashes(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    out = []
    for seed in (0x51, 0x1F3):
        total = np.zeros(len(sets.members) + 1, U)
        np.cumsum(mix(sets.members + U(seed)), out=total[1:])
        out.append(mix((total[sets.bounds[1:]] - total[sets.bounds[:-1]]) ^ sets.sizes.astype(U)))
    return out[0], out[1]


def parity_bits(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """A row of +1 and -1 for each set: -1 where an odd number of members fall on the bit."""
    out = np.ones((len(sets), bits), "f4")
    for i, s in enumerate(sets):
        out[i, np.flatnonzero(np.bincount((s >> U(7)).astype("i8") & (bits - 1), minlength=bits) & 1)] = -1
    return out
