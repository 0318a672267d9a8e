"""Substring dedup by sliding sentence spans: a run of consecutive sentences that occurred before loses its sentences.

Every run of three consecutive sentences, or of more where those are short, is hashed, the hashes meet globally, and all
occurrences but the first lose their sentences.  A sentence or two of fifty words are such a run as well.  Passages of fifty
words that hold no run of sentences, because they begin and end within long ones, are spans too.  They are met by pieces:
of the five pieces of 46 words in one, that with the least hash stands for it, so fewer names are exchanged.

Texts are shuffled once, into blocks; what meets globally is packed hashes (see blocks.py): first 32 bits of each run and
piece, to leave out those that occur once, then two full hashes and the first place in the block of the others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessel.llm.blocks import MESSAGE, Block, heads_of, into_blocks, layout, is_shared, messages, place, send_unique, sort_names
from tessel.llm.common import ship
from tessel.llm.text_arrays import BLANK, LOWER, U, mix, run_hashes, slices

SPAN = 3
MIN_CHARS = 100
STRETCH = 50
PIECE = 46
CHUNK = 2_000_000
RECORDS, MEMO, FOUND = range(2, 5)
RECORD = np.dtype([("name", "<u8"), ("check", "<u8"), ("doc", "<i8"), ("pos", "<i8")])
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".!?"]] = True


class Sentences(Block):
    """The sentences of a block: where each begins in the block's bytes, and the first sentence of each document."""

    def __init__(self, table: pa.Table) -> None:
        super().__init__(table)
        data = self.data
        blank = BLANK[data]
        begins = np.zeros(len(data), bool)
        if len(data) > 1:
            begins[1:] = ~blank[1:] & (data[:-1] == 10)
            begins[2:] |= ~blank[2:] & blank[1:-1] & STOP[data[:-2]]
            second = self.starts[self.stops - self.starts > 1] + 1  # what comes before belongs to another document
            begins[second] = ~blank[second] & (data[second - 1] == 10)
        filled = self.starts[self.stops > self.starts]
        begins[filled] = True
        self.begin = np.flatnonzero(begins)
        self.first = np.searchsorted(self.begin, np.append(self.starts, len(data)))
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.first))

    def spans(self, span: int, min_chars: int) -> tuple[np.ndarray, ...]:
        """(document row, place within it, first byte, byte after the last, reach, name, check) of each run.

        Places are counted in sentences for runs and in words for passages; one that begins less than ``reach`` after
        another in the same document is no second occurrence.  The words are taken down for ``pieces`` and ``passages``.

        From each sentence on, and back from each, the shortest run that is long enough: so each sentence of a longer one
        is in a run within it, also a short sentence at its end.  A document that isn't long enough is one run.
        """
        stop = np.append(self.begin[1:], len(self.data))
        stop = np.minimum(stop, self.stops[self.doc]) if len(stop) else stop
        n = np.diff(self.first)
        hashes = np.zeros(len(self.begin), U)
        chars = np.zeros(len(self.begin), "i8")
        words, word_hashes = [np.zeros(0, "i8")], [np.zeros(0, U)]
        for part in slices((self.stops - self.starts).tolist(), CHUNK):
            a, b = self.first[part.start], self.first[part.stop]
            low = self.starts[part.start]
            own = self.data[low : self.stops[part.stop - 1]]
            lower = np.frombuffer(own.tobytes().translate(LOWER), "u1")
            full = np.flatnonzero(~BLANK[own])
            left = np.searchsorted(full, self.begin[a:b] - low)
            right = np.searchsorted(full, stop[a:b] - low)
            some = right > left
            begin, end = np.zeros(b - a, "i8"), np.zeros(b - a, "i8")
            begin[some], end[some] = full[left[some]], full[right[some] - 1] + 1
            own_words, word_ends = self.words(part)
            both = run_hashes(lower, np.append(begin, own_words), np.append(end, word_ends))
            hashes[a:b] = both[: b - a]
            words.append(own_words + low)
            word_hashes.append(both[b - a :])
            letters = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
            chars[a:b] = letters[end] - letters[begin]
        words, word_hashes = np.concatenate(words), np.concatenate(word_hashes)
        word_at = np.searchsorted(words, np.append(self.begin, len(self.data)))
        first, last = np.repeat(self.first[:-1], n), np.repeat(self.first[1:], n)
        total, here = np.concatenate([[0], np.cumsum(chars)]), np.arange(len(self.begin))
        least = np.minimum(span, last - first)  # all sentences of a shorter document
        upto = np.maximum(here + least, np.searchsorted(total, total[:-1] + min_chars))
        since = np.minimum(here + 1 - least, np.searchsorted(total, total[1:] - min_chars, "right") - 1)
        upto = np.minimum(upto, np.searchsorted(word_at, word_at[:-1] + STRETCH))
        since = np.maximum(since, np.searchsorted(word_at, word_at[1:] - STRETCH, "right") - 1)
        on, back = upto <= last, since >= first
        back[back] = upto[since[back]] != here[back] + 1  # the others are there already
        size = total[self.first[1:]] - total[self.first[:-1]]
        short = (size > 0) & (size < min_chars)
        at = np.concatenate([here[on], since[back], self.first[:-1][short]])
        width = np.concatenate([(upto - here)[on], (here + 1 - since)[back], n[short]])
        name, check = np.zeros(len(at), U), np.full(len(at), U(7))
        ok = np.arange(len(at))
        for i in range(int(width.max(initial=0))):
            ok = ok[width[ok] > i]
            h = hashes[at[ok] + i]
            name[ok] = mix(name[ok] * U(0x9E3779B97F4A7C15) + h + U(1))
            check[ok] = mix((check[ok] ^ h) * U(0xD6E8FEB86659FD93) + U(3))
        doc = self.doc[at]
        self.word_begin, self.word_hash, self.word_at, self.chars = words, word_hashes, word_at, total
        return doc, at - self.first[doc], self.begin[at], stop[at + width - 1], np.ones(len(at), "i8"), name, check

    def words(self, part: slice) -> tuple[np.ndarray, np.ndarray]:
        """Where the words of some documents begin and end, from the first of them on.

        A word is what stands between blanks; in scripts without blanks (and others of three bytes a character), one character.
        """
        low = self.starts[part.start]
        own = self.data[low : self.stops[part.stop - 1]]
        blank = BLANK[own]
        begins = ~blank
        begins[1:] &= blank[:-1]
        filled = self.starts[part][self.stops[part] > self.starts[part]] - low
        begins[filled] = ~blank[filled]
        wide = (own >= 0xE0) & (own != 0xE2)  # but for punctuation, U+2000 to U+2FFF
        if wide.any():
            lead = np.flatnonzero((own & 0xC0) != 0x80)
            after = lead[1:][wide[lead[:-1]]]
            begins |= wide
            begins[after] = ~blank[after]
        begin, marks = np.flatnonzero(begins), np.flatnonzero(begins | blank)
        return begin, np.append(marks, len(own))[np.searchsorted(marks, begin) + 1]

    def pieces(self, span: int, min_chars: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, name of the piece) of each passage of STRETCH words without a run of whole sentences; after ``spans``."""
        self.word_first = np.searchsorted(self.word_begin, np.append(self.starts, len(self.data)))
        n = np.diff(self.word_first)
        found, names = [np.zeros(0, "i8")], [np.zeros(0, U)]
        for part in slices(n.tolist(), CHUNK):
            a, b = self.word_first[part.start], self.word_first[part.stop]
            own = self.word_hash[a:b]
            g = np.arange(b - a)
            g = g[a + g + STRETCH <= np.repeat(self.word_first[1:][part], n[part])]
            one, other = np.searchsorted(self.word_at, a + g), np.searchsorted(self.word_at, a + g + STRETCH, "right") - 1
            g = g[(other - one < span) | (self.chars[other] - self.chars[np.minimum(one, other)] < min_chars)]
            if not len(g):
                continue
            h = run_hashes(own, np.arange(len(own) - PIECE + 1), np.arange(PIECE, len(own) + 1))
            at = g
            for i in range(1, STRETCH - PIECE + 1):
                at = np.where(h[g + i] < h[at], g + i, at)
            found.append(a + g)
            names.append(mix(h[at] ^ U(0xA5A5A5A5A5A5A5A5)))
        return np.concatenate(found), np.concatenate(names)

    def passages(self, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """What ``spans`` says of each run, for passages of STRETCH words from these words on."""
        names, checks = [np.zeros(0, U)], [np.zeros(0, U)]
        for part in np.array_split(at, max(1, len(at) // 100_000)):
            if len(part):
                low, high = part[0], part[-1] + STRETCH
                own = self.word_hash[low:high]
                names.append(mix(run_hashes(own, part - low, part - low + STRETCH) ^ U(0x1B873593CC9E2D51)))
                checks.append(run_hashes(mix(own ^ U(0x5851F42D4C957F2D)), part - low, part - low + STRETCH))
        doc = np.searchsorted(self.word_first, at, "right") - 1
        after = np.minimum(at + STRETCH, len(self.word_begin))
        end = np.where(at + STRETCH < self.word_first[1:][doc], np.append(self.word_begin, 0)[after], self.stops[doc])
        return doc, at - self.word_first[doc], self.word_begin[at], end, np.full(len(at), STRETCH), np.concatenate(names), np.concatenate(checks)


def send_records(docs: pa.Table, told: pa.Table, parts: int, span: int, min_chars: int, passages: bool) -> pa.Table:
    if not docs.num_rows or not told.num_rows:
        return messages([])
    block, number = Sentences(docs), docs["block"][0].as_py()
    runs = block.spans(span, min_chars)
    some = is_shared(runs[5], told, parts)
    doc, pos, begin, end, reach, name, check = (x[some] for x in runs)
    if passages:
        at, piece = block.pieces(span, min_chars)
        more = block.passages(at[is_shared(piece, told, parts)])
        doc, pos, begin, end, reach, name, check = (np.concatenate(x) for x in zip((doc, pos, begin, end, reach, name, check), more, strict=True))
    ids, sorter = block.ids[doc], place(name, parts)
    order = np.lexsort((pos, ids, check, name, sorter))
    pos, begin, end, reach, ids, name, check, sorter = (x[order] for x in (pos, begin, end, reach, ids, name, check, sorter))
    new = np.append(True, (name[1:] != name[:-1]) | (check[1:] != check[:-1]))[: len(name)]
    variant, heads = np.cumsum(new) - 1, np.flatnonzero(new)
    first = (ids == ids[heads][variant]) & (pos < pos[heads][variant] + reach)
    memo = np.stack([begin, end, variant, first], axis=1).astype("<u4").tobytes()
    record = np.zeros(len(heads), RECORD)
    for k, v in (("name", name), ("check", check), ("doc", ids), ("pos", pos)):
        record[k] = v[heads]
    bounds = np.searchsorted(sorter[heads], np.arange(parts + 1))
    out = [(p, number, RECORDS, record[bounds[p] : bounds[p + 1]].tobytes()) for p in range(parts) if bounds[p] < bounds[p + 1]]
    return messages([*out, (number % parts, number, MEMO, memo)])


def sort_records(table: pa.Table) -> pa.Table:
    """For each record whether it is the first place of its run, in all blocks."""
    sorter = table["dest"][0].as_py()
    rows = list(zip(*(table[c].to_pylist() for c in ("src", "kind", "data")), strict=True))
    out = [(s, sorter, MEMO, d) for s, k, d in rows if k == MEMO]
    sent = [(s, np.frombuffer(d, RECORD)) for s, k, d in rows if k == RECORDS]
    if not sent:
        return messages(out)
    record = np.concatenate([d for _, d in sent])
    order = np.lexsort((record["pos"], record["doc"], record["check"], record["name"]))
    own = record[order]
    new = np.append(True, (own["name"][1:] != own["name"][:-1]) | (own["check"][1:] != own["check"][:-1]))
    heads = own[new][np.cumsum(new) - 1]
    first = np.zeros(len(record), "u1")
    first[order] = (own["doc"] == heads["doc"]) & (own["pos"] == heads["pos"])  # rows that share an id may share the place
    bounds = np.cumsum([0] + [len(d) for _, d in sent])
    out += [(s, sorter, FOUND, first[a:b].tobytes()) for (s, _), a, b in zip(sent, bounds, bounds[1:], strict=False)]
    return messages(out)


def cut(docs: pa.Table, told: pa.Table) -> pa.Table:
    """Take the sentences and pieces of all but first occurrences out of each document."""
    block = Sentences(docs) if docs.num_rows else None
    if block is None:
        return pa.table({"row": docs["row"], "n_sentences": pa.array([], pa.int64()), "removed": pa.array([], pa.list_(pa.int64())), "kept": pa.array([], pa.binary())})
    n = np.diff(block.first)
    begins, ends = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
    order = np.argsort(told["src"].to_numpy(), kind="stable").tolist() if told.num_rows else []
    kinds, data = told["kind"].to_pylist(), told["data"].to_pylist()
    answers = np.concatenate([np.zeros(0, "u1"), *(np.frombuffer(data[i], "u1") for i in order if kinds[i] == FOUND)])
    for i in order:
        if kinds[i] == MEMO:
            begin, end, variant, first = np.frombuffer(data[i], "<u4").reshape(-1, 4).astype("i8").T
            again = (first == 0) | (answers[variant] == 0)
            begins.append(begin[again])
            ends.append(end[again])
    begin, end = np.concatenate(begins), np.concatenate(ends)
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    heads = np.flatnonzero(np.append(True, begin[1:] >= end[:-1])[: len(begin)])
    begin, end = begin[heads], end[np.append(heads[1:], len(end))[: len(heads)] - 1]
    touched = np.zeros(len(block.begin) + 1, "i4")
    np.add.at(touched, np.searchsorted(block.begin, begin, "right") - 1, 1)
    np.add.at(touched, np.searchsorted(block.begin, end), -1)
    gone = np.cumsum(touched[:-1]) > 0
    own = np.searchsorted(begin, np.append(block.starts, len(block.data)))
    kept, removed = [], []
    for i, (a, b) in enumerate(zip(own[:-1].tolist(), own[1:].tolist(), strict=True)):
        cuts = [block.starts[i], *np.stack([begin[a:b], end[a:b]], axis=1).ravel().tolist(), block.stops[i]] if a < b else [block.starts[i], block.stops[i]]
        kept.append(b"".join(block.data[x:y].tobytes() for x, y in zip(cuts[::2], cuts[1::2], strict=True)))
        removed.append(np.flatnonzero(gone[block.first[i] : block.first[i + 1]]).tolist() if a < b else [])
    return pa.table({"row": block.rows, "n_sentences": pa.array(np.maximum(n, 1), pa.int64()), "removed": pa.array(removed, pa.list_(pa.int64())), "kept": pa.array(kept, pa.binary())})


def cut_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, min_chars: int = MIN_CHARS, blocks: int | None = None, passages: bool = True) -> DataFrame:
    """(row, n_sentences, removed, kept): the id, the number of sentences, the positions of those that lose text, and the rest.

    A sentence begins at a character that isn't blank, right after a line break, or after one of .!? and one blank (ASCII
    white space); together, the sentences are the text.  A span is ``span`` consecutive sentences (all of them in a shorter
    document), and as many more as it takes to have ``min_chars`` code points, or fewer that have STRETCH words; sentences are compared without surrounding
    blanks and with A-Z in lower case.  A document of fewer code points in all is one span, which only its copies have.  STRETCH
    consecutive words with no ``span`` whole sentences of ``min_chars`` among them are a span, too, unless ``passages`` is False; a word is what stands
    between blanks, or one character of a script without them.  The first occurrence is that of the smallest id, then of the smallest position, and all
    others lose their text, in the same document too.  ``kept`` is the UTF-8 text of what is left.

    Null and empty texts: one empty sentence, nothing removed.  Null ids: one document that comes last.  Rows with equal
    id and text lose the same sentences; rows that share an id alone are compared like places of one document.  Empty
    table: empty result.
    """
    ship(docs.sparkSession)
    blocks, n = layout(docs, text_col, blocks)
    texts = into_blocks(docs, id_col, text_col, blocks)

    def send(table: pa.Table) -> pa.Table:
        block = Sentences(table)
        runs = block.spans(span, min_chars)[5]
        if not passages:
            return send_unique(runs, np.arange(len(runs)), table["block"][0].as_py(), n)
        at, piece = block.pieces(span, min_chars)
        first = heads_of(piece)  # neighbours share their piece: it counts once, as long as it is the same one
        places = np.concatenate([np.arange(len(runs)), len(runs) + at[first]])
        return send_unique(np.concatenate([runs, piece[first]]), places, table["block"][0].as_py(), n)

    names = texts.groupBy("block").applyInArrow(send, MESSAGE)
    shared = names.groupBy("dest").applyInArrow(sort_names, MESSAGE)
    records = texts.groupBy("block").cogroup(shared.groupBy("dest")).applyInArrow(lambda t, m: send_records(t, m, n, span, min_chars, passages), MESSAGE)
    found = records.groupBy("dest").applyInArrow(sort_records, MESSAGE)
    schema = T.StructType([texts.schema["row"], T.StructField("n_sentences", T.LongType()), T.StructField("removed", T.ArrayType(T.LongType())), T.StructField("kept", T.BinaryType())])
    return texts.groupBy("block").cogroup(found.groupBy("dest")).applyInArrow(cut, schema)
