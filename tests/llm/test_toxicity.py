import math
import random
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.llm import noisy_channel, toxicity
from tessel.llm.queries import QUERIES

from .helpers import awkward

SMALL = "/root/testdata/sf0.01"
BAD = ["idiot", "moron", "loser", "stupid", "trash", "worthless", "scum", "pathetic"]


def counts_of(texts):
    out = np.zeros((noisy_channel.ORDER, noisy_channel.BUCKETS), "f4")
    found = noisy_channel.scan(texts)
    for k, buckets in enumerate(noisy_channel.gram_buckets(found.codes, found.starts, found.stops)):
        out[k] += np.bincount(buckets, minlength=noisy_channel.BUCKETS)
    return out


def prose(seed, n=400):
    rng = random.Random(seed)
    words = ["the", "river", "stone", "lamp", "garden", "oak", "letter", "isle", "lord", "tall", "add", "ado", *BAD]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(5, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return noisy_channel.CharModel(counts_of(prose(1)))


def test_grams_are_those_of_a_plain_loop():
    texts = ["The Oak, the stone", "", "é tall  isle", "1d10t x"]  # what looks spelled over takes no part
    plain = [Counter() for _ in range(noisy_channel.ORDER)]
    for w in "the oak the stone é tall isle x".split():
        signs = [noisy_channel.START] * 3 + [ord(c) for c in w] + [noisy_channel.END]
        for i in range(3, len(signs)):
            for k in range(noisy_channel.ORDER):
                plain[k][noisy_channel.CharModel.bucket(tuple(signs[i - k : i + 1][::-1]))] += 1
    counts = counts_of(texts)
    for k, own in enumerate(plain):
        assert {int(i): int(counts[k, i]) for i in np.flatnonzero(counts[k])} == dict(own)


def path_cost(model, written):
    """Of one way through the lattice: letter by letter, words ended by blanks."""
    total = 0.0
    for w in "".join(written).split(" "):
        before = (noisy_channel.START,) * 3
        for c in w:
            total += model.cost(before, ord(c))
            before = (ord(c), *before[:-1])
        total += model.cost(before, noisy_channel.END) if w else 0.0
    return total


@pytest.mark.parametrize("span", ["1d10t", "l.o.s.e.r", "t r a s h", "sc!!m", "id1oooot", "w0r7hl3ss!", "a$$$", "lo5er,1d", "1", "a a a a", "$$$"])
def test_the_decoded_path_is_the_cheapest_of_all(model, span):
    best = math.inf
    for path in product(*noisy_channel.lattice(span)):
        written = [w for w, _ in path]
        cost = sum(c for _, c in path) + path_cost(model, written)
        if cost < best - 1e-9:
            best, words = cost, "".join(written).split()
    found = noisy_channel.decode(span, model)
    assert found == words


def test_spelled_over_words_are_restored(model):
    for span, want in {"1d10t": "idiot", "m0r0n": "moron", "5tup1d": "stupid", "l-o-s-e-r": "loser", "t r @ s h": "trash", "paaaathetic": "pathetic", "$cum": "scum", "iiiiidiooot": "idiot"}.items():
        assert noisy_channel.decode(span, model) == [want]


def test_only_what_looks_spelled_over_is_a_span():
    text = "Plain words, no 42 or 3.5! An 1d10t. s t u p i d\nx y\nz w A end looooser i.d.i.o.t well-known"
    found = noisy_channel.scan(["before", text, "a b"])
    base = found.edges[1]
    assert [text[a - base : b - base] for a, b in found.spans.tolist()] == ["1d10t.", "s t u p i d", "looooser", "i.d.i.o.t"]
    words = [found.lowered[a:b] for a, b in zip(found.starts.tolist(), found.stops.tolist(), strict=True)]
    assert words == "before plain words no or an x y z w a end well known a b".split()


def documents(spark, seed=3, n=300):
    """Clean ones, and toxic ones whose words are spelled over in the held out part."""
    rng = random.Random(seed)
    clean = ["river", "stone", "lamp", "garden", "oak", "letter", "wind", "sea", "isle", "lord"]
    over = str.maketrans({"o": "0", "i": "1", "s": "5", "e": "3", "a": "@"})
    rows = []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randrange(20, 60))]
        toxic = i % 3 == 0
        for _ in range(3 * toxic):
            w = rng.choice(BAD)
            if i >= n * 2 // 3:
                w = rng.choice([w.translate(over), " ".join(w), w.replace("o", "ooooo"), "-".join(w)])
            words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_spelled_over_texts_are_scored_as_what_they_say(spark):
    rows = documents(spark)
    model = toxicity.fit(rows, rows.where("doc_id < 200"))
    out = toxicity.predict(rows.where("doc_id >= 200"), model).collect()
    assert all((r.score >= 0.5) == (r.row.toxic == 1) for r in out)
    assert all(bool(r.spans) <= (r.row.toxic == 1) for r in out)
    for r in out:
        assert not set(toxicity.restored(r.row.text, r.spans)) & set("0135@-")


def test_more_labels_than_are_broadcast(spark, monkeypatch):
    rows = documents(spark, n=90)
    few = toxicity.fit(rows, rows)
    monkeypatch.setattr(toxicity, "BROADCAST_LABELS", 5)
    many = toxicity.fit(rows, rows)
    assert (few.terms == many.terms).all() and np.allclose(few.weights, many.weights) and len(few.terms)


def test_document_counts_are_those_of_a_plain_count(spark):
    rows = documents(spark, n=60)
    grams = counts_of([r.text for r in rows.collect()])
    decoder = noisy_channel.CharModel(grams).decoder()
    want = Counter()
    for r in rows.collect():
        want.update(set(toxicity.bag_of([r.text], decoder).term.view("i8").tolist()))
    found = {r.term: r.n for r in toxicity.count_documents(rows.repartition(5), grams).collect()}
    assert found == want
    only = np.sort(np.array(sorted(want)[:50], "i8").view("u8"))
    assert {r.term: r.n for r in toxicity.count_documents(rows, grams, only).collect()} == {k: want[k] for k in only.view("i8").tolist()}
    assert (toxicity.count_grams(rows) == grams).all()


def test_the_logistic_model_is_at_its_minimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    y = (x @ [2, -1, 0, 0] + rng.normal(size=300) > 0).astype(float)
    w, b = toxicity.fit_logistic(x, y, ridge=2.0)
    scale = np.sqrt((x**2).mean(axis=0))
    loss = lambda w, b: np.log1p(np.exp(-(2 * y - 1) * (x @ w + b))).sum() + np.sum((w * scale) ** 2) + 5e-4 * b**2
    assert all(loss(w + d, b) >= loss(w, b) for d in np.vstack([np.eye(4), -np.eye(4)]) * 1e-3) and loss(w, b + 1e-3) >= loss(w, b)


def test_awkward_rows_and_tables(spark):
    rows = awkward(spark)
    labels = spark.createDataFrame([(5, 1), (2, 0), (2, 0), (99, 1), (4, None), (None, 1)], "doc_id long, toxic int")
    for known in (labels, labels.where("toxic = 1"), labels.limit(0)):
        out = toxicity.predict(rows, toxicity.fit(rows, known)).collect()
        assert len(out) == rows.count() and all(0 <= r.score <= 1 for r in out)
        nothing = {r.score for r in out if not (r.row.text or "").strip()}
        assert len(nothing) == 1
    model = toxicity.fit(rows.limit(0), labels)
    assert toxicity.predict(rows.limit(0), model).count() == 0
    dotted = rows.withColumnsRenamed({"text": "a.text", "doc_id": "the id"})
    named = toxicity.predict(dotted, toxicity.fit(dotted, labels.withColumnRenamed("doc_id", "the id"), "the id", "a.text"), "a.text")
    assert named.count() == rows.count() and named.select("row.*").columns == dotted.columns
    long = spark.createDataFrame([(1, "a " * 50_000 + "1d10t " * 20_000), (2, "1" * 100_000 + "x" * 100_000), (3, "")], "doc_id long, text string")
    assert toxicity.predict(long, model).count() == 3


def test_held_out_documents(spark):
    found = QUERIES["op11_toxicity"](spark, SMALL)
    known = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = found.join(known, "doc_id").where("held_out").select("predicted", "toxic").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) >= 0.95
    assert found.where(F.col("predicted") != (F.col("score") >= 0.5).cast("int")).count() == 0
