"""Byte-level BPE through a sentencepiece model that is written straight from a rank file.

Every byte stands for one letter, so a vocabulary of byte strings becomes one of character strings.  Each becomes a
piece with the negative of its rank as score: sentencepiece then merges the pair of lowest rank first, the left one on
ties.  Normalisation is the identity.  The model has no trained part and is small: the vocabulary bounds it.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.llm.common import column, ship
from tessel.llm.text_arrays import slices, trim

#: Where the letters that stand for bytes begin: no spaces, no surrogates, and nothing that a normaliser would touch.
FIRST_LETTER = 0x100
LETTERS = {b: FIRST_LETTER + b for b in range(256)}
#: Pre-tokens whose ids a task remembers at most; it forgets all of them then, which changes no result.
MEMORY = 150_000
#: Bytes of texts that a task takes at once, or one longer text.
PART = 1 << 19


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file (base64, blank, rank), by rank; the ranks must be 0, 1, 2 and so on."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    by_rank = sorted(ranks, key=ranks.__getitem__)
    if [ranks[x] for x in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks have gaps")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"no token for the bytes {missing}")
    return by_rank


def letters(raw: bytes) -> str:
    return raw.decode("latin-1").translate(LETTERS)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(vocabulary: list[bytes]) -> bytes:
    """A serialised sentencepiece model: id = rank, and one unknown piece after the last that no text can reach."""
    pieces = b"".join(_field(1, _field(1, letters(x).encode()) + _field(2, float(-rank))) for rank, x in enumerate(vocabulary))
    unknown = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(2, _field(3, 2) + _field(4, len(vocabulary) + 1) + _field(40, len(vocabulary)))  # 2: BPE
    identity = _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return pieces + unknown + trainer + identity


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, each match of ``pattern`` encoded on its own."""

    def __init__(self, model: bytes, vocabulary: list[bytes], pattern: str) -> None:
        import regex
        import sentencepiece

        self.split = regex.compile(pattern).findall
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.whole = {x: struct.pack("<I", i) for i, x in enumerate(vocabulary)}
        self.known: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        rest = []
        for w in words:
            raw = w.encode()
            if (own := self.whole.get(raw)) is not None:
                self.known[w] = own
            else:
                rest.append((w, letters(raw)))
        for (w, _), ids in zip(rest, self.pieces.encode([x for _, x in rest], out_type=int, num_threads=1), strict=True):
            self.known[w] = struct.pack(f"<{len(ids)}I", *ids)

    def all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; what several of them hold is encoded once."""
        split = [self.split(t) for t in texts]
        words = set().union(*split)
        new = words.difference(self.known)
        if new and len(self.known) > MEMORY:
            self.known.clear()
            new = words
        self.learn(list(new))
        return [b"".join(map(self.known.__getitem__, ws)) for ws in split]

    def __call__(self, text: str) -> bytes:
        return self.all([text])[0]


class Decoder:
    """The bytes that packed ids stand for."""

    def __init__(self, vocabulary: list[bytes]) -> None:
        self.piece = vocabulary.__getitem__

    def __call__(self, ids: bytes) -> bytes:
        return b"".join(map(self.piece, np.frombuffer(ids, "<u4").tolist()))


def encode(
    docs: DataFrame, vocabulary: list[bytes], pattern: str, text_col: str = "text", out_col: str = "token_ids"
) -> DataFrame:
    """All columns and ``out_col``: the ids of the text, packed as little-endian unsigned 32-bit integers.

    No special tokens.  Null and empty texts: no ids (empty binary).  Rows are independent of each other, so repeated
    rows and repeated or null ids are as they are; an existing column named ``out_col`` is replaced.
    """
    shared = _shared(docs, (model_bytes(vocabulary), vocabulary, pattern))

    def prepared():
        encoder = Encoder(*shared.value)
        return lambda texts: (encoder.all(texts),)

    return _map_column(docs, text_col, [out_col], prepared, docs.columns)


def decode(docs: DataFrame, vocabulary: list[bytes], ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """All columns and ``out_col``: the bytes that the packed ids stand for.  Null ids: none."""
    shared = _shared(docs, vocabulary)

    def prepared():
        decoder = Decoder(shared.value)
        return lambda packed: ([decoder(x) for x in packed],)

    return _map_column(docs, ids_col, [out_col], prepared, docs.columns)


def round_trip(
    docs: DataFrame, vocabulary: list[bytes], pattern: str, text_col: str = "text", ids_col: str = "token_ids", out_col: str = "decoded"
) -> DataFrame:
    """All columns but the text, ``ids_col`` as from ``encode``, and ``out_col``: the bytes that ``decode`` makes of these ids.

    Both happen in one pass: a task needs one Python worker where ``encode`` and ``decode`` in a row need two at once.
    """
    shared = _shared(docs, (model_bytes(vocabulary), vocabulary, pattern))

    def prepared():
        encoder, decoder = Encoder(*shared.value), Decoder(shared.value[1])

        def both(texts: list[str]) -> tuple[list[bytes], list[bytes]]:
            packed = encoder.all(texts)
            return packed, [decoder(x) for x in packed]

        return both

    return _map_column(docs, text_col, [ids_col, out_col], prepared, [c for c in docs.columns if c != text_col])


def _shared(docs: DataFrame, value):
    """A broadcast variable for Python workers; the vocabulary bounds it."""
    ship(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(value)


def _map_column(docs: DataFrame, in_col: str, out_cols: list[str], prepare, columns: list[str]) -> DataFrame:
    """``columns`` but for those named like new ones, and new binary columns made of the values of one, PART bytes at a time."""
    kept = [c for c in columns if c not in out_cols]
    plain = [f"c{i}" for i in range(len(kept) + len(out_cols))]  # mapInArrow takes columns by their names, which may have dots
    own = docs.select(*[column(docs, c).alias(n) for c, n in zip(kept, plain, strict=False)])
    given = kept.index(in_col) if in_col in kept else len(kept)
    schema = T.StructType([*own.schema.fields, *(T.StructField(n, T.BinaryType()) for n in plain[len(kept) :])])
    if given == len(kept):
        own = docs.select(*[column(docs, c).alias(n) for c, n in zip(kept, plain, strict=False)], column(docs, in_col).alias("given"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        f = prepare()
        for batch in batches:
            values = batch.column(given)
            for part in slices(pc.fill_null(pc.binary_length(values), 0).to_pylist(), PART):
                size = part.stop - part.start
                nothing = b"" if pa.types.is_binary(values.type) or pa.types.is_large_binary(values.type) else ""
                made = f([nothing if x is None else x for x in values.slice(part.start, size).to_pylist()])
                same = [batch.column(i).slice(part.start, size) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*same, *(pa.array(x, pa.binary()) for x in made)], plain)

    return own.mapInArrow(run, schema).toDF(*kept, *out_cols)


def unpack(packed: str):
    """Packed ids as an array of longs, with DataFrame functions."""
    hexed = F.hex(packed)
    n = (F.length(hexed) / 8).cast("int")
    one = lambda i: F.concat(*[F.substring(hexed, i * 8 + 1 + 2 * k, F.lit(2)) for k in (3, 2, 1, 0)])
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(one(i), 16, 10).cast("long"))
    )
