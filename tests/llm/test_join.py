import random

import numpy as np
import pytest

from tessel.llm import jaccard_join
from tessel.llm.components import connected_components
from tessel.llm.shingles import shingle_sets

from .helpers import awkward, corpus, docs


def shingles(text, size):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute(rows, size, num, den):
    sets = {i: shingles(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("seed, size, num", [(1, 4, 85), (2, 4, 85), (3, 5, 80), (4, 2, 60)])
def test_components(spark, seed, size, num):
    rows = corpus(seed, n=70, copies=60) + [(1000, "a b"), (1001, "A  b"), (1002, "a"), (1003, None), (1004, " \n")]
    found = jaccard_join.link_documents(docs(spark, rows), size=size, num=num, blocks=3).collect()
    assert {r.id: (r.n_shingles, r.component) for r in found} == brute(rows, size, num, 100)


def chain(seed, n):
    """A drift of copies, each a word away from the one before, around one text, in random order."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(120)]
    out = []
    for k in range(n):
        words[rng.randrange(120)] = f"x{k}"
        out.append(" ".join(words if k % 3 else words[: 100 + rng.randrange(20)]))
    rng.shuffle(out)
    return list(enumerate(out))


def test_a_large_group_in_chunks(spark, monkeypatch):
    rows = chain(5, 150)
    want = brute(rows, 4, 85, 100)
    monkeypatch.setattr(jaccard_join, "CHUNK_SHINGLES", 2000)
    found = jaccard_join.link_documents(docs(spark, rows), blocks=2).collect()
    assert {r.id: (r.n_shingles, r.component) for r in found} == want


def test_one_of_each_group_stays(spark):
    rows = corpus(9, n=40, copies=40)
    kept = {r.doc_id for r in jaccard_join.keep_one_of_each(docs(spark, rows)).collect()}
    assert kept == {c for _, c in brute(rows, 4, 85, 100).values()}
    odd = awkward(spark)
    out = jaccard_join.keep_one_of_each(odd)
    assert out.columns == odd.columns
    assert sorted((r.doc_id or 0, r.text) for r in out.where("doc_id = 5 or doc_id is null").collect()) == [(0, "a line that has no id at all"), (5, "other text"), (5, "same same")]
    assert out.where("doc_id <= 3").count() == 3 and jaccard_join.keep_one_of_each(odd.limit(0)).count() == 0


def test_unrelated_rows_without_ids_stay_apart(spark):
    rows = docs(spark, [(None, "one two three four five six"), (None, "ten nine eight seven six five"), (7, "one two three four five six")])
    found = jaccard_join.link_documents(rows).collect()
    assert sorted(r.component for r in found) == [7, 7, 2**63 - 1]
    assert jaccard_join.keep_one_of_each(rows).count() == 2


def test_shingle_sets_equal_python_sets():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(200)] + ["", "é é\té\x0bé é"]
    sets = shingle_sets([t.encode() for t in texts], 4)
    want = [shingles(t, 4) for t in texts]
    assert sets.sizes.tolist() == [len(s) for s in want]
    for a in range(0, 200, 7):
        for b in range(0, 200, 5):
            assert len(np.intersect1d(sets[a], sets[b])) == len(want[a] & want[b])


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7)]
    root = {}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    near = {n: {n} for n in nodes}
    for a, b in edges:
        if a != b:
            near[a].add(b), near[b].add(a)
    for n in nodes:
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m), todo.append(m)
        root[n] = min(seen)
    found = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == root
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
