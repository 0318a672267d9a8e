"""Awkward tables and plain versions: columns with odd and clashing names, many rows without ids, very long texts, hot keys."""

import heapq
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessel.llm import ann, byte_bpe, common, decontaminate, jaccard_join, language, line_dedup, quality, sharding, substring_dedup, suffix_dedup
from tessel.llm.queries import QUERIES

from .helpers import AWKWARD, corpus, docs
from .test_dedup import brute_bytes, brute_lines, brute_spans
from .test_join import brute

ODD = "in string, `n-chars` int, `a.b` string, n int, hits string, score string, shard string, row string, id long, block int, `k1` string"


def odd_table(spark):
    rows = [(i, t, "in", 1, "dot", 2, "h", "s", "x", "r", 3, 4, "k") for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ODD)


def vocabulary():
    return byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def operators(spark):
    """Each operator on documents, as a function of (table, id column, text column)."""
    items = spark.createDataFrame([(1, "same same"), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([(5, 1), (2, 0)], "doc_id long, quality int")
    return {
        "spans": lambda d, i, t: substring_dedup.cut_repeated_spans(d, i, t),
        "lines": lambda d, i, t: line_dedup.drop_repeated_lines(d, i, t),
        "round trip": lambda d, i, t: byte_bpe.round_trip(d, vocabulary(), public_tokenizers.PATTERN, t),
        "bpe": lambda d, i, t: byte_bpe.decode(byte_bpe.encode(d, vocabulary(), public_tokenizers.PATTERN, text_col=t), vocabulary()),
        "shards": lambda d, i, t: sharding.shard_documents(d, 8, i, t),
        "language": lambda d, i, t: language.predict(d, language.fit(d.withColumn("lang", F.lit("en")), t, sample_key=i), t),
        "quality": lambda d, i, t: quality.predict(d, quality.fit(d, labels.withColumnRenamed("doc_id", i), i, t), t),
        "bytes": lambda d, i, t: suffix_dedup.cut_repeated_bytes(d, i, t),
        "contamination": lambda d, i, t: decontaminate.find_contamination(d, items, t),
        "clean": lambda d, i, t: decontaminate.drop_contaminated(d.where(f"`{t}` is null or `{t}` <> 'same same'"), items, text_col=t).unionByName(d.where(f"`{t}` = 'same same'")),
        "links": lambda d, i, t: jaccard_join.link_documents(d, i, t),
    }


@pytest.mark.parametrize("name", ["spans", "lines", "bpe", "round trip", "shards", "language", "quality", "bytes", "contamination", "clean", "links"])
def test_odd_columns_dotted_names_and_empty_tables(spark, name):
    f, table = operators(spark)[name], odd_table(spark)
    assert f(table, "doc_id", "text").count() == table.count()
    dotted = table.withColumnsRenamed({"doc_id": "doc.id", "text": "the text"})
    assert f(dotted, "doc.id", "the text").count() == table.count()
    assert f(table.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_and_empty_tables(spark, stage):
    f = dict(corpus_pipeline.STAGES)[stage]
    rows = [(i, t, "en", "s", 1, "x", 2) for i, t in AWKWARD]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `in` string, `a.b` int")
    out = f(spark, table, "/root/testdata/sf0.001")
    assert out.count() <= len(rows) and f(spark, table.limit(0), "/root/testdata/sf0.001").count() == 0
    if stage != "byte_bpe":
        assert out.columns == table.columns


def many_without_ids(seed):
    """A third of the rows have no id, and another third are copies of one text; one text is very long."""
    rng = random.Random(seed)
    rows = corpus(seed, n=30, copies=10)
    copy = ". ".join(f"word{rng.randrange(99)} next{k} more and more of it" for k in range(6)) + "."
    rows += [(1000 + k, copy) for k in range(30)]
    rows.append((2000, "\n".join(f"line {k % 700} of a very long text, {k % 13} of it." for k in range(6000))))
    return rows, [(None, f"{t} tail {k}") for k, (_, t) in enumerate(rows[:20])]


def test_long_texts_copies_and_rows_without_ids(spark):
    rows, unnamed = many_without_ids(11)
    table = docs(spark, rows + unnamed)
    last = common.LAST_ID
    plain = [(i, t) for i, t in rows if i != 2000]
    cut = {r.row.doc_id: r.kept.decode() for r in substring_dedup.cut_repeated_spans(docs(spark, plain), blocks=3).collect()}
    assert cut == brute_spans(plain)
    assert substring_dedup.cut_repeated_spans(table).count() == len(rows) + len(unnamed)
    found = suffix_dedup.cut_repeated_bytes(table, blocks=4).collect()
    want = brute_bytes([(last if i is None else i, t) for i, t in rows + unnamed])
    assert sorted((last if r.row.doc_id is None else r.row.doc_id, len(r.spans), r.kept) for r in found) == want
    linked = {r.id: (r.n_shingles, r.component) for r in jaccard_join.link_documents(docs(spark, rows), blocks=3).collect()}
    assert linked == brute(rows, 4, 85, 100)
    assert jaccard_join.link_documents(table).count() == len(rows) + len(unnamed)


def test_hot_lines_are_joined_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    rows = [(i, f"a line that all have\nown line of {i}\nanother shared by some {i % 9}") for i in range(60)]
    kept = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs(spark, rows)).collect()}
    assert kept == brute_lines(rows)


def test_shards_are_those_of_the_plain_schedule(spark):
    rows = corpus(5, 90, 40) + [(900, None), (901, "")]
    weights = {}
    for _, t in rows:
        weights[t or ""] = weights.get(t or "", 0) + len((t or "").encode()) + 1
    heap = [0] * 8
    for w in sorted(weights.values(), reverse=True):
        heapq.heapreplace(heap, heap[0] + w)
    loads = {}
    for r in sharding.shard_documents(docs(spark, rows), 8).collect():
        loads[r.shard] = loads.get(r.shard, 0) + r.size
    assert sorted(loads.values()) == sorted(heap)


def test_emissions_equal_plain_sums():
    rng = np.random.default_rng(5)
    texts = ["Das Haus, der Garten 12 и дом", "", "é", "a b"]
    scripts = len(language.SCRIPT_NAMES)
    model = language.Model(["de", "ru"], rng.normal(size=(language.BUCKETS, 2)).astype("f4"), np.ones((scripts, 2), bool))
    words = language.words_of(texts)
    want = []
    for t in texts:
        for w in "".join(c if c.isalpha() else " " for c in t.lower()).split():
            total = np.zeros(2)
            for a, b, c in zip("\0" + w[:-1], w, w[1:] + "\0", strict=True):
                code = np.array([(ord(a) << 42) ^ (ord(b) << 21) ^ ord(c)], "u8")
                total += model.logp[int(language.mix(code)[0] % np.uint64(language.BUCKETS))]
            want.append(total)
    assert np.allclose(language.emissions(words, model), want, atol=1e-4)
    assert np.diff(words.first).tolist() == [6, 0, 1, 2]


def test_network_equals_a_plain_forward_pass():
    rng = np.random.default_rng(6)
    sizes = {"w": (quality.FEATURES, 5), "b": (5,), "v": (5, 3), "u": (5, 3), "a": (3,), "c": (5,), "d": (1,)}
    net = quality.Network(rng.normal(size=quality.FEATURES), rng.uniform(size=quality.FEATURES), {k: rng.normal(size=s) * 0.1 for k, s in sizes.items()})
    texts = [" ".join(rng.choice(["oak", "river", "Stone", "a"], size=n)) for n in (3, 64, 200, 0)]
    x, count = quality.passages_of(texts)
    p, at, want = net.weights, 0, []
    for n in count:
        h = [np.tanh(((row - net.shift) * net.scale) @ p["w"] + p["b"]) for row in x[at : at + n]]
        e = np.array([np.exp(np.sum(p["a"] * np.tanh(v @ p["v"]) / (1 + np.exp(-(v @ p["u"]))))) for v in h])
        z = sum(w * v for w, v in zip(e / e.sum(), h, strict=True))
        want.append(1 / (1 + np.exp(-(z @ p["c"] + p["d"][0]))))
        at += n
    assert count.tolist() == [1, 1, 4, 1] and np.allclose(net.score(x, count), want, atol=1e-6)


def test_the_sample_of_the_classifier_is_bounded_in_bytes(spark):
    rows = docs(spark, [(i, f"text number {i} " * (1 + i % 3)) for i in range(60)] + [(100, "x" * 50_000)])
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(60), 100]] * 2, "doc_id long, quality int")
    network = quality.fit(rows, labels, sample_bytes=3_000, epochs=1)
    assert all(0 <= r.score <= 1 for r in quality.predict(rows, network).collect())


def test_recall_on_the_whole_table(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = {r.vec_id: np.array(r.embedding, "f8") for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    ids = np.array(sorted(rows))
    x = np.stack([rows[i] for i in ids])
    found = {}
    for r in QUERIES["op5_ann_hnsw"](spark, sf_dir).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q, got in found.items():
        order = [i for i in ids[np.lexsort((ids, -(x @ rows[q])))] if i != q][:20]
        hits += len(got & set(order))
    assert len(found) == (ids % 20 == 0).sum() and hits / (20 * len(found)) >= 0.9


def test_scores_are_exact_for_doubles_and_ties_go_to_the_smaller_id(spark):
    base = [1.0, 0.0]
    near = [(i, [0.5 + 1e-10 * (i % 2), 0.1 * (i % 7)]) for i in range(1, 60)]
    table = spark.createDataFrame([(0, base), *near, (99, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in ann.nearest(table, F.col("vec_id") == 0, k=10).orderBy("rank").collect()]
    want = sorted(((i, v[0]) for i, v in near), key=lambda x: (-x[1], x[0]))[:10]
    assert got == want


def test_no_tied_neighbour_of_a_shard_is_lost(spark):
    """Hundreds of different vectors that are nearly or wholly tied, more than a beam holds: the smallest ids are found."""
    tied = [(i, [0.5, 0.001 * i, 1e-9 * (i % 3)]) for i in range(1, 700)]
    table = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), *tied], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in ann.nearest(table, F.col("vec_id") == 0, k=10).orderBy("rank").collect()]
    assert got == [(i, 0.5) for i in range(1, 11)]


def test_neighbours_in_a_table_with_clashing_columns(spark):
    rows = [(i, [float(i % 7), 1.0], 1, 2.0, "x", [3]) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score double, k1 string, vector array<int>")
    plain = ann.nearest(table.select("vec_id", "embedding"), F.col("vec_id") % 20 == 0, k=5).collect()
    assert ann.nearest(table, F.col("vec_id") % 20 == 0, k=5).collect() == plain and len(plain) == 10
    odd = table.withColumnsRenamed({"vec_id": "vec.id", "embedding": "the vector"})
    assert sorted(ann.nearest(odd, F.col("`vec.id`") % 20 == 0, k=5, id_col="vec.id", vector_col="the vector").collect()) == sorted(plain)
