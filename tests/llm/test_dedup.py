import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tessel.llm import line_dedup, substring_dedup, suffix_dedup

from .helpers import awkward, corpus, docs, sentence


def lower(s):
    return "".join(c.lower() if c.isascii() else c for c in s)


def brute_lines(rows):
    holders = {}
    for i, t in rows:
        for line in t.split("\n"):
            holders.setdefault(lower(line.strip(" \t\n\x0b\x0c\r")), set()).add(i)
    gone = {k: min(v) for k, v in holders.items() if len(k) >= 10 and len(v) > 1}
    return {i: "\n".join(x for x in t.split("\n") if gone.get(lower(x.strip(" \t\n\x0b\x0c\r")), i) == i) for i, t in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_lines(spark, seed):
    rows = [(i, t + "\n  A shared LINE of all \t\n\nÉtat shared line") for i, t in corpus(seed)]
    found = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs(spark, rows)).collect()}
    assert found == brute_lines(rows)


def test_awkward_lines(spark):
    rows = awkward(spark)
    out = line_dedup.drop_repeated_lines(rows)
    assert out.columns == rows.columns and out.count() == rows.count()
    assert line_dedup.drop_repeated_lines(rows.limit(0)).count() == 0
    both = docs(spark, [(None, "one line for two"), (3, "one line for two"), (None, None)])
    assert {(r.doc_id, r.text) for r in line_dedup.drop_repeated_lines(both).collect()} == {(3, "one line for two"), (None, ""), (None, None)}


def test_more_documents_than_a_threshold(spark):
    rows = docs(spark, [(1, "a repeated line"), (2, "a repeated line"), (3, "another of them"), (4, "another of them"), (5, "another of them")])
    kept = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(rows, min_docs=3).collect()}
    assert kept == {1: "a repeated line", 2: "a repeated line", 3: "another of them", 4: "", 5: ""}


BLANKS = " \t\n\x0b\x0c\r"


def brute_words(t):
    """Where words begin: after blanks, and at and after each character of a script without blanks."""
    wide = [ord(c) >= 0x800 and not 0x2000 <= ord(c) < 0x3000 for c in t]
    return [k for k, c in enumerate(t) if c not in BLANKS and (k == 0 or t[k - 1] in BLANKS or wide[k] or wide[k - 1])]


def brute_occurrences(i, t, span, least, stretch):
    """((document, place, begin, end, reach), content) of each span of a text."""
    cuts = [0] + [k for k in range(1, len(t)) if t[k] not in BLANKS and (t[k - 1] == "\n" or (k > 1 and t[k - 1] in BLANKS and t[k - 2] in ".!?"))] + [len(t)]
    keys = [lower(t[a:b].strip(BLANKS)) for a, b in zip(cuts, cuts[1:], strict=False)]
    n, words = len(keys), brute_words(t)
    upto = [sum(w < c for w in words) for c in cuts]
    size = lambda a, b: sum(map(len, keys[a:b]))
    long_enough = lambda a, b: (b - a >= min(span, n) and size(a, b) >= least) or upto[b] - upto[a] >= stretch
    runs = {(a, next((b for b in range(a + 1, n + 1) if long_enough(a, b)), None)) for a in range(n)}
    runs |= {(next((a for a in range(b - 1, -1, -1) if long_enough(a, b)), None), b) for b in range(1, n + 1)}
    if 0 < size(0, n) < least:
        runs.add((0, n))
    for a, b in runs:
        if a is not None and b is not None:
            yield (i, a, cuts[a], cuts[b], 1), ("run", *keys[a:b])
    ends = words + [len(t)]
    content = [lower(t[a:b].strip(BLANKS)) for a, b in zip(ends, ends[1:], strict=False)]
    for g in range(len(words) - stretch + 1):
        whole = [k for k in range(n) if upto[k] >= g and upto[k + 1] <= g + stretch]
        if len(whole) < span or size(whole[0], whole[-1] + 1) < least:
            yield (i, g, words[g], ends[g + stretch], stretch), ("passage", *content[g : g + stretch])


def brute_spans(rows, span=3, least=100, stretch=50):
    found = sorted((x for i, t in rows for x in brute_occurrences(i, t, span, least, stretch)), key=lambda x: x[0][:2])
    first, gone = {}, {i: set() for i, _ in rows}
    for (i, place, begin, end, reach), content in found:
        own, since = first.setdefault(content, (i, place))
        if not (i == own and place < since + reach):
            gone[i] |= set(range(begin, end))
    return {i: "".join(c for k, c in enumerate(t) if k not in gone[i]) for i, t in rows}


@pytest.mark.parametrize("seed", [3, 4])
def test_spans(spark, seed):
    rows = corpus(seed)
    rng = random.Random(seed)
    stock = [sentence(rng, 120).replace(" ", rng.choice([" ", "  ", "\t"])) for _ in range(3)]
    for k in range(12):  # passages within long sentences, and short sentences in a row
        words = rng.choice(stock).split(" ")
        a = rng.randrange(60)
        rows.append((500 + k, f"{sentence(rng, 20)} {' '.join(words[a : a + 60])} {sentence(rng, 20)}. " + " ".join(rng.choice(["Go.", "Yes!", "No?"]) for _ in range(rng.randrange(60)))))
    found = {r.row.doc_id: r.kept.decode() for r in substring_dedup.cut_repeated_spans(docs(spark, rows), blocks=3).collect()}
    assert found == brute_spans(rows)
    assert any(len(found[i]) < len(t) for i, t in rows)


def test_awkward_spans(spark):
    rows = awkward(spark)
    out = substring_dedup.cut_repeated_spans(rows).collect()
    assert len(out) == rows.count() and all(r.n_sentences >= 1 for r in out)
    assert substring_dedup.cut_repeated_spans(rows.limit(0)).count() == 0
    copy = "first sentence of the text, a long one. second one of it, which is longer. third and last one, as long as those."
    both = {r.row.doc_id: (r.removed, r.kept.decode()) for r in substring_dedup.cut_repeated_spans(docs(spark, [(9, copy), (2, copy), (None, copy)])).collect()}
    assert both == {2: ([], copy), 9: ([0, 1, 2], ""), None: ([0, 1, 2], "")}


def test_spans_of_short_sentences(spark):
    """Copies made of short sentences, and short sentences at the end of a passage, go whole."""
    words = "go on. come in. sit. look. yes. no! why? so it is. run. stop. wait. oh."
    listed = "- oil\n- salt\n- rice\n- tea\n- eggs\n- flour\n- milk\n- soap\n- wax\n- bread\n- honey\n- apples\n- butter\n- pepper\n- onions\n- carrots"
    tail = "This is a rather long sentence that stands at the front, and it goes on for a while to be long enough. Yes. No. Ok. Go. Hm. "
    rows = [(1, words), (2, words), (3, listed), (4, "Shopping of today:\n" + listed), (5, tail + "One ends here."), (6, tail + "Another ends so."), (7, "Yes. No. Ok."), (8, "Yes. No. Ok.")]
    found = {r.row.doc_id: (r.n_sentences, r.removed, r.kept.decode()) for r in substring_dedup.cut_repeated_spans(docs(spark, rows), blocks=3).collect()}
    kept = {2: "", 4: "Shopping of today:\n", 6: "Another ends so.", 8: ""}
    assert {i: x[2] for i, x in found.items()} == dict(rows) | kept
    assert found[2][:2] == (12, list(range(12))) and found[6][1] == list(range(6))


def test_passages_within_long_sentences(spark):
    """Fifty words that repeat are found where no three whole sentences are among them."""
    word = lambda seed, n: [f"{w}{seed}" for w in ("ar be co du el fo gi ha il jo ka lu mo ny ox pa ri so tu uv".split() * n)[:n]]
    own = lambda i, n: " ".join(f"own{i}x{k}" for k in range(n))
    passage = " ".join(f"p{k}" + "." * (k == 30) for k in range(53))
    two = " ".join(f"q{k}" for k in range(28)) + ". " + " ".join(f"r{k}" for k in range(28)) + ". "
    han = "".join(chr(0x4E00 + 37 * k) for k in range(80))
    rows = []
    for i in (1, 2):
        rows.append((i, f"{own(i, 20)} {passage} {own(i + 90, 20)}. A last one {i}."))
        rows.append((i + 10, f"{own(i + 10, 9)}. {two}{own(i + 20, 9)}."))
        rows.append((i + 30, "".join(chr(0x7000 + 100 * i + k) for k in range(30)) + han + "".join(chr(0x8000 + 100 * i + k) for k in range(30))))
    rows.append((50, " ".join([own(50, 5), *word(1, 19), own(51, 60), *word(1, 19)])))  # too short to count
    rows.append((60, f"{own(60, 5)} {own(61, 60)} {own(62, 5)} {own(61, 60)} {own(63, 5)}"))
    found = {r.row.doc_id: (r.removed, r.kept.decode()) for r in substring_dedup.cut_repeated_spans(docs(spark, rows), blocks=3).collect()}
    text = dict(rows)
    assert all(found[i] == ([], text[i]) for i in (1, 11, 31, 50))
    assert found[12] == ([1, 2], f"{own(12, 9)}. {own(22, 9)}.")
    left = found[2][1].split()
    assert found[2] == ([0, 1], f"{own(2, 20)} {own(92, 20)}. A last one 2.")
    assert found[32][1] == text[32][:30] + text[32][-30:]
    assert found[60][1] == f"{own(60, 5)} {own(61, 60)} {own(62, 5)} {own(63, 5)}"


def brute_bytes(rows, n=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - n + 1):
            s = b[k : k + n]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - n + 1):
            if first[b[k : k + n]] < i:
                gone[k : k + n] = [True] * n
        out.append((i, len(re.findall("1+", "".join("01"[g] for g in gone))), bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_bytes(spark, seed):
    rows = corpus(seed, n=40, copies=15) + [(900, "ab" * 200), (901, "ba" * 90), (902, "é" * 70), (903, "é" * 40 + "x"), (904, None), (905, "z" * 49), (906, "z" * 49), (907, "z" * 50), (908, "z" * 51)]
    for blocks in (1, 5):
        found = suffix_dedup.cut_repeated_bytes(docs(spark, rows), blocks=blocks).collect()
        assert sorted((r.row.doc_id, len(r.spans), r.kept) for r in found) == brute_bytes(rows)


def test_equal_ids_do_not_match(spark):
    t = "a text of more than fifty bytes that two rows with one id have"
    found = suffix_dedup.cut_repeated_bytes(docs(spark, [(1, t), (1, t), (2, t), (None, t)])).collect()
    assert sorted((r.row.doc_id or 99, len(r.kept)) for r in found) == [(1, len(t)), (1, len(t)), (2, 0), (99, 0)]
    rows = awkward(spark)
    assert suffix_dedup.cut_repeated_bytes(rows).count() == rows.count() and suffix_dedup.cut_repeated_bytes(rows.limit(0)).count() == 0


def test_sampling_keeps_an_anchor_in_every_string():
    import numpy as np

    rng = np.random.default_rng(0)
    for data in (rng.integers(97, 100, 2000).astype("u1"), np.full(500, 97, "u1")):
        at, _ = suffix_dedup.sampled(data, np.array([0, 300]), np.array([300, len(data)]))
        for s in range(len(data) - 49):
            if not s < 300 < s + 50:
                assert ((at >= s) & (at <= s + 18)).any()


def test_digest_of_nothing(spark):
    row = line_dedup.mark_repeated_lines(docs(spark, [(1, None)])).select(F.sha2(line_dedup.kept_text().cast("binary"), 256).alias("h")).first()
    assert row.h == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("hot", [1, 2, 100])
def test_bytes_around_hot_names(spark, monkeypatch, hot):
    """One string of 33 to 60 bytes in many surroundings, some of them equal on one side or on both."""
    monkeypatch.setattr(suffix_dedup, "HOT_BLOCKS", hot)
    rng = random.Random(9)
    stock = "the one string that very many texts have inside, whatever is around it"
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    sides = [word(30) for _ in range(4)]
    rows = []
    for i in range(120):
        left = rng.choice([word(rng.randrange(25)), rng.choice(sides), rng.choice(sides)[-rng.randrange(5, 20) :]])
        right = rng.choice([word(rng.randrange(25)), rng.choice(sides), rng.choice(sides)[: rng.randrange(5, 20)]])
        rows.append((i, left + stock[: rng.choice([33, 33, 40, 49, 60])] + right))
    found = suffix_dedup.cut_repeated_bytes(docs(spark, rows), blocks=4).collect()
    assert sorted((r.row.doc_id, len(r.spans), r.kept) for r in found) == brute_bytes(rows)


def test_records_of_a_hot_name_are_spread():
    """A string of 33 bytes in thousands of different surroundings: no sorter gets many more of its records than the others."""
    import numpy as np

    from tessel.llm.blocks import place

    rng = np.random.default_rng(4)
    record = np.zeros(4000, suffix_dedup.RECORD)
    for side in ("left", "right"):
        record[side] = rng.integers(97, 123, record[side].shape)
    record["before"] = record["after"] = record["high"] = suffix_dedup.FLANK
    names = np.full(4000, 12345, "u8")
    out, at, name = suffix_dedup.spread(record, np.arange(4000), names, np.ones(4000, bool))
    per_sorter = np.bincount(place(name, 8), minlength=8)
    assert len(out) == 8000 and per_sorter.max() < 1.2 * per_sorter.mean()
