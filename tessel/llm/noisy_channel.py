"""A noisy channel for spelled-over words: spans that look written in leetspeak, with spaces or with repeated letters are decoded.

A character model says how likely a word is; the channel says what a written sign may stand for and at what cost.  A span is
a lattice of such options, and Viterbi finds the cheapest path through it exactly.  Whatever doesn't look spelled over has one
path, itself, and isn't touched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import groupby

import numpy as np

from tessel.llm.text_arrays import MIX, U, letter_table, mix, runs, same_length_lower

#: Letters that a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i",
}
#: Costs, as negative natural logarithms: a sign for a letter; a sign that is none, inside a span and at its edge; a run for fewer
#: letters; a separator that is none, between single letters and elsewhere; a separator that ends a word, between single letters.
LEET_COST, BREAK_COST, EDGE_COST, RUN_COST, JOIN_COST, ODD_JOIN_COST, SPLIT_COST = 0.7, 2.5, 0.5, 0.7, 0.5, 2.5, 1.5
#: Signs of a span with leetspeak or repetition, each run counted once: longer ones are no words, but keys, links and the like.
LONGEST = 40
#: Single letters in a row that look spelled with spaces.
SPACED = 4
ORDER = 4
BUCKETS = 1 << 18
#: Weight of a shorter context in counts, and how many letters are thought possible.
BACKOFF, ALPHABET = 4.0, 400
END, START = 0, 1
MASK = 2**64 - 1
BLANKS = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all code points: letters, signs that may stand for letters, blanks."""
    sign, blank = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    sign[[ord(c) for c in LEET]] = True
    blank[BLANKS] = True
    return letter_table(), sign, blank


@dataclass
class Scan:
    """Words of some texts (runs of letters), and the spans that look spelled over, with places in the joined texts."""

    lowered: str
    codes: np.ndarray
    edges: np.ndarray  # where each text begins, and one more
    starts: np.ndarray  # of words outside spans
    stops: np.ndarray
    spans: np.ndarray  # (start, stop)

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, places, side="right") - 1


def scan(texts: list[str]) -> Scan:
    lowered = same_length_lower("\n".join(texts))
    codes = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter, is_sign, is_blank = tables()
    letter, sign = is_letter[codes], is_sign[codes]
    glyph = letter | sign
    starts, stops = runs(~is_blank[codes])
    follows = np.zeros(len(codes), bool)  # equal to the next one
    follows[:-1] = codes[1:] == codes[:-1]
    again = np.zeros(len(codes), bool)
    again[:-2] = letter[:-2] & follows[:-2] & follows[1:-1]
    beside = np.zeros(len(codes), bool)
    beside[:-1] = (letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])

    def count(inside: np.ndarray) -> np.ndarray:
        total = np.zeros(len(codes) + 1, "i4")
        np.cumsum(inside, out=total[1:])
        return total[stops] - total[starts]

    size, letters, signs, repeats = stops - starts, count(letter), count(sign), count(again)
    heads = glyph.copy()
    heads[1:] &= ~glyph[:-1]
    pieces = count(heads)
    short = size - count(follows & glyph) <= LONGEST
    leet = (count(beside) > 0) & (signs <= 2 * letters) & short
    split = (pieces >= SPACED) & (letters + signs == pieces) & (letters > 1)
    odd = leet | ((repeats > 0) & short) | split
    # single letters, one chunk after the other on one line
    line = np.zeros(len(codes) + 1, "i4")
    np.cumsum(codes == 10, out=line[1:])
    single = (size == 1) & (letters + signs == 1)
    joined = single[1:] & single[:-1] & (line[starts[1:]] == line[stops[:-1]]) if len(starts) else np.zeros(0, bool)
    first, last = runs(joined)
    keep = (last - first + 1 >= SPACED) & (np.add.reduceat(np.append(letters, 0), np.stack([first, last + 1], 1).ravel())[::2] > 1 if len(first) else np.zeros(0, bool))
    first, last = first[keep], last[keep]
    covered = np.zeros(len(starts) + 1, "i4")
    np.add.at(covered, first, 1)
    np.add.at(covered, last + 1, -1)
    alone = odd & (np.cumsum(covered)[:-1] == 0)
    spans = np.concatenate([np.stack([starts[alone], stops[alone]], 1), np.stack([starts[first], stops[last]], 1)])
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    begin, end = runs(letter)
    inside = np.searchsorted(spans[:, 0], begin, side="right") - 1
    free = (inside < 0) | (begin >= np.append(spans[:, 1], 0)[inside])
    return Scan(lowered, codes, np.cumsum([0] + [len(x) + 1 for x in texts]), begin[free], end[free], spans)


def gram_buckets(codes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[np.ndarray]:
    """For each order up to ORDER, the buckets of all grams of these words that end in a letter or in the end of a word."""
    length = stops - starts + 1
    total = int(length.sum())
    base = np.cumsum(length) - length
    at = np.arange(total) - np.repeat(base, length)
    place = np.repeat(starts, length) + at
    last = np.zeros(total, bool)
    last[base + length - 1] = True
    own = np.where(last, END, codes[np.minimum(place, len(codes) - 1)] if len(codes) else 0).astype(U)
    before = [own]
    for k in range(1, ORDER):
        shifted = np.full(total, START, U)
        shifted[k:] = own[:-k] if total > k else own[:0]
        before.append(np.where(at >= k, shifted, U(START)))
    return [gram_hash(before[:k]) for k in range(1, ORDER + 1)]


def gram_hash(last_first: list[np.ndarray]) -> np.ndarray:
    h = np.full(last_first[0].shape, len(last_first), U)
    for x in last_first:
        h = mix((h << U(21)) ^ h ^ x)
    return (h % U(BUCKETS)).astype("i8")


@dataclass
class CharModel:
    """Counts of hashed grams by order; how likely a letter is after the ones before it, shorter contexts mixed in."""

    counts: np.ndarray  # ORDER x BUCKETS
    known: dict = field(default_factory=dict)
    spans: Decoder | None = None

    def __post_init__(self) -> None:
        self.counts = self.counts.copy()
        words = float(self.counts[0, self.bucket((END,))])
        for k in range(1, ORDER):  # what a word begins with follows its start
            self.counts[k - 1, self.bucket((START,) * k)] = words
        self.total = float(self.counts[0].sum()) - words

    @staticmethod
    def bucket(last_first: tuple) -> int:
        """``gram_hash`` of one gram, with plain integers."""
        h = len(last_first)
        for x in last_first:
            h = ((h << 21) ^ h ^ x) & MASK
            h = (h ^ (h >> 32)) * MIX & MASK
            h = (h ^ (h >> 32)) * MIX & MASK
            h ^= h >> 32
        return h % BUCKETS

    def cost(self, before: tuple, letter: int) -> float:
        """Negative log probability of ``letter`` after ``before``, the last one first."""
        key = (letter, *before)
        if (found := self.known.get(key)) is None:
            if len(self.known) > 200_000:
                self.known.clear()
            p = 1 / ALPHABET
            for k in range(1, ORDER + 1):
                context = float(self.counts[k - 2, self.bucket(before[: k - 1])]) if k > 1 else self.total
                p = min(1.0, (float(self.counts[k - 1, self.bucket(key[:k])]) + BACKOFF * p) / (context + BACKOFF))
            found = self.known[key] = -math.log(p)
        return found

    def decoder(self) -> Decoder:
        """One decoder for all tasks of a worker that have this model."""
        if self.spans is None:
            self.spans = Decoder(self)
        return self.spans


def lattice(span: str) -> list[list[tuple[str, float]]]:
    """What each run of equal signs may stand for; a blank stands for the end of a word."""
    is_letter, is_sign, is_blank = tables()
    signs = [(c, len(list(own))) for c, own in groupby(span)]
    kinds = ["letter" if is_letter[ord(c)] else "sign" if is_sign[ord(c)] else "other" for c, _ in signs]
    glyphs = [n for (_, n), k in zip(signs, kinds, strict=True) if k != "other"]
    spread = len(glyphs) >= SPACED and all(n == 1 for n in glyphs) and all(a == "other" or b == "other" for a, b in zip(kinds, kinds[1:], strict=False))
    places = [i for i, k in enumerate(kinds) if k != "other"]
    out = []
    for i, ((c, n), kind) in enumerate(zip(signs, kinds, strict=True)):
        edge = not spread and i in (places[0], places[-1]) if places else False
        if kind == "letter":
            out.append([(c * n, 0.0)] if n < 3 else [(c, RUN_COST), (2 * c, RUN_COST + 0.2), *([(3 * c, RUN_COST + 0.5)] if n == 3 else [])])
        elif kind == "sign":
            options = [(x, LEET_COST + 0.3 * (n > 1)) for x in LEET[c]] + ([(2 * x, LEET_COST + 0.3) for x in LEET[c]] if n == 2 else [])
            out.append([*options, (" ", EDGE_COST if edge else BREAK_COST)])
        elif spread:
            wide = is_blank[ord(c)] and n > 1
            out.append([("", JOIN_COST + 2.5 * wide), (" ", 0.0 if wide else SPLIT_COST)])
        else:
            out.append([(" ", 0.0), *([("", ODD_JOIN_COST)] if n == 1 and 0 < i < len(signs) - 1 else [])])
    return out


def decode(span: str, model: CharModel) -> list[str]:
    """Words of the cheapest path; of equally cheap ones, the one whose options come first."""
    start = (START,) * (ORDER - 1)
    states: dict[tuple, tuple[float, tuple | None]] = {start: (0.0, None)}
    for options in [*lattice(span), [(" ", 0.0)]]:
        new: dict[tuple, tuple[float, tuple | None]] = {}
        for state, (cost, path) in states.items():
            for written, own in options:
                total, now = cost + own, state
                for c in written:
                    if c == " ":
                        total += 0.0 if now == start else model.cost(now, END)
                        now = start
                    else:
                        total += model.cost(now, ord(c))
                        now = (ord(c), *now[:-1])
                if now not in new or total < new[now][0]:
                    new[now] = (total, (path, written))
        states = new
    _, path = states[start]
    pieces = []
    while path is not None:
        path, written = path
        pieces.append(written)
    return "".join(reversed(pieces)).split()


class Decoder:
    """Decodes spans and remembers them, up to a number that bounds its memory."""

    def __init__(self, model: CharModel, most: int = 200_000) -> None:
        self.model, self.most, self.known = model, most, {}

    def __call__(self, span: str) -> list[str]:
        if (found := self.known.get(span)) is None:
            if len(self.known) >= self.most:
                self.known.clear()
            found = self.known[span] = decode(span, self.model)
        return found


def decoded(found: Scan, decoder: Decoder) -> Iterator[tuple[int, int, list[str]]]:
    """(start, stop, words) of each span."""
    for a, b in found.spans.tolist():
        yield a, b, decoder(found.lowered[a:b])
