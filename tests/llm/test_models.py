import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessel.llm import ann, byte_bpe, decontaminate, language, quality, sharding
from tessel.llm.queries import QUERIES

from .helpers import awkward, corpus, docs

SMALL = "/root/testdata/sf0.01"


def test_token_ids_are_those_of_the_library(spark):
    vocabulary = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={x: i for i, x in enumerate(vocabulary)}, special_tokens={})
    rng = random.Random(2)
    letters = [chr(c) for c in [*range(0x250), *range(0x391, 0x3AA), *range(0x4E00, 0x4E30), *range(0x1F600, 0x1F620)]]
    texts = [t for _, t in corpus(1, 20, 5)] + ["".join(rng.choices(letters, k=40)) for _ in range(200)] + ["", " " * 500, "a" * 2000, "I'LL don't <|endoftext|>"]
    rows = docs(spark, [*enumerate(texts), (None, None), (7, texts[7])])
    out = byte_bpe.decode(byte_bpe.encode(rows, vocabulary, public_tokenizers.PATTERN), vocabulary).withColumn("ids", byte_bpe.unpack("token_ids")).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        ids = known.encode_ordinary(r.text or "")
        assert bytes(r.token_ids) == struct.pack(f"<{len(ids)}I", *ids) and r.ids == ids and bytes(r.decoded) == (r.text or "").encode()
    both = byte_bpe.round_trip(rows.withColumnRenamed("text", "a text"), vocabulary, public_tokenizers.PATTERN, "a text")
    assert both.columns == ["doc_id", "token_ids", "decoded"]
    facts = lambda rows: sorted((r.doc_id or -1, bytes(r.token_ids), bytes(r.decoded)) for r in rows)
    assert facts(both.collect()) == facts(out)


def test_forgotten_words_and_small_parts_change_no_id(spark, monkeypatch):
    vocabulary = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    model = byte_bpe.model_bytes(vocabulary)
    texts = [t for _, t in corpus(4, 30, 10)] + ["", "x" * 5000]
    plain = [byte_bpe.Encoder(model, vocabulary, public_tokenizers.PATTERN)(t) for t in texts]
    monkeypatch.setattr(byte_bpe, "MEMORY", 5)
    encoder = byte_bpe.Encoder(model, vocabulary, public_tokenizers.PATTERN)
    assert [x for i in range(0, len(texts), 7) for x in encoder.all(texts[i : i + 7])] == plain


def test_ranks_with_gaps_are_refused(tmp_path):
    path = tmp_path / "x.tiktoken"
    path.write_bytes(b"YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        byte_bpe.read_ranks(str(path))


def test_shards(spark):
    rows = corpus(3, 80, 40) + [(500, None), (501, ""), (None, "no id"), (3, "again"), (3, "again")]
    for units in (8192, 2):
        out = sharding.shard_documents(docs(spark, rows), 8, units=units).collect()
        assert sorted((r.row.doc_id or -1, r.text_crc32, r.size) for r in out) == sorted((i or -1, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in rows)
        by_text = {}
        for r in out:
            by_text.setdefault((r.text_crc32, r.size), set()).add(r.shard)
        assert all(len(s) == 1 for s in by_text.values())
        for s in range(8):
            slots = sorted(r.slot for r in out if r.shard == s)
            assert slots == list(range(len(slots)))
        if units > 2:
            loads = [sum(r.size for r in out if r.shard == s) for s in range(8)]
            assert max(loads) - min(loads) <= max(r.size for r in out) * 3
    assert sharding.shard_documents(docs(spark, rows).limit(0)).count() == 0


def test_longest_first_balances():
    rng = random.Random(4)
    weights = [(rng.randrange(1, 1000), i) for i in range(500)]
    shard_of = sharding.longest_first(weights, 8)
    loads = [sum(w for w, i in weights if shard_of[i] == s) for s in range(8)]
    assert max(loads) - min(loads) <= 0.001 * sum(loads) / 8


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1200, 16)) * rng.uniform(0.5, 2, size=(1200, 1))
    x[300:600] = x[300]  # a third or so are one vector
    rows = [(i, v.astype("f4").tolist()) for i, v in enumerate(x)] + [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, []), (2080, [1.0, None] * 8), (None, [1.0] * 16), (20, x[20].astype("f4").tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = ann.nearest(table, F.col("vec_id") % 20 == 0, k=20).collect()
    v = x.astype("f4").astype("f8")
    found = {}
    for r in out:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == set(range(0, 1200, 20))
    hits = 0
    for q, got in found.items():
        got.sort()
        assert [g[0] for g in got] == list(range(1, 21)) and q not in [g[1] for g in got]
        assert [(-s, i) for _, i, s in got] == sorted((-s, i) for _, i, s in got)
        scores = v @ v[q]
        assert all(abs(scores[i] - s) < 1e-9 for _, i, s in got)
        order = [i for i in np.lexsort((np.arange(1200), -scores.round(9))) if i != q][:20]
        hits += len(set(order) & {g[1] for g in got})
    assert hits / (20 * len(found)) >= 0.9


def test_few_vectors_and_none(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in ann.nearest(table, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 0.5), (2, 0.5)]
    assert ann.nearest(table.limit(0), F.col("vec_id") == 0).count() == 0


def accuracy(spark, name, column, truth, label):
    found = QUERIES[name](spark, SMALL)
    known = spark.read.parquet(f"{SMALL}/{truth}.parquet").select("doc_id", F.col(label).alias("truth")).where("truth is not null")
    rows = found.where("held_out").join(known, "doc_id").select(column, "truth").collect()
    return sum(r[0] == r[1] for r in rows) / len(rows)


def test_language_on_held_out_documents(spark):
    assert accuracy(spark, "op6_language_id", "lang_pred", "documents", "lang") >= 0.97


def test_quality_on_held_out_documents(spark):
    assert accuracy(spark, "op7_quality_mil", "predicted", "labels", "quality") >= 0.93


def test_languages_of_awkward_texts(spark):
    rows = spark.createDataFrame([(1, "the house and the garden of the man", "en"), (2, "el jardín de la casa y el hombre", "es"), (3, "дом и сад", "ru"), (4, None, "en"), (5, "the", None)], "doc_id long, text string, lang string")
    model = language.fit(rows)
    asked = docs(spark, [(1, None), (2, ""), (3, "12 !?"), (4, "дом"), (5, "the garden and the house el jardín de la casa y el hombre de la casa"), (6, "İ")])
    out = {r.row.doc_id: r for r in language.predict(asked, model, switch=4.0).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and all(out[i].score == 0 for i in (1, 2, 3))
    assert out[4].lang_pred == "ru" and [s.lang for s in out[5].spans] == ["en", "es"]
    assert all(0 <= r.score <= 1 for r in out.values())
    nothing = language.fit(rows.limit(0))
    assert {r.lang_pred for r in language.predict(awkward(spark), nothing).collect()} == {"und"}


def test_viterbi_finds_the_best_path():
    from itertools import product

    rng = np.random.default_rng(3)
    sizes = [0, 1, 5, 3, 6]
    first = np.cumsum([0, *sizes])
    scores = rng.normal(size=(first[-1], 3)).astype("f4")
    label = language.viterbi(scores, first, 0.7)
    cost = lambda path, s: sum(s[i, k] for i, k in enumerate(path)) - 0.7 * sum(a != b for a, b in zip(path, path[1:], strict=False))
    for a, b in zip(first, first[1:], strict=False):
        if b > a:
            best = max(cost(p, scores[a:b]) for p in product(range(3), repeat=b - a))
            assert cost(label[a:b], scores[a:b]) == pytest.approx(best, abs=1e-4)


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    x, count, y = rng.normal(size=(9, 7)), np.array([4, 1, 4]), np.array([1.0, 0.0, 1.0])
    p = {k: rng.normal(size=s) for k, s in {"w": (7, 5), "b": (5,), "v": (5, 3), "u": (5, 3), "a": (3,), "c": (5,), "d": (1,)}.items()}

    def loss(q):
        z = quality._forward(q, np.tanh(x @ q["w"] + q["b"]), count)["logit"]
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    grads = quality._gradients(p, x, count, y)
    for k in p:
        at = tuple(rng.integers(n) for n in p[k].shape)
        q = {n: v.copy() for n, v in p.items()}
        q[k][at] += 1e-6
        assert (loss(q) - loss(p)) / 1e-6 == pytest.approx(grads[k][at], abs=1e-4)


def test_scores_of_awkward_texts(spark):
    rows = awkward(spark)
    network = quality.fit(rows, spark.createDataFrame([(5, 1), (5, None), (None, 0), (77, 0)], "doc_id long, quality int"))
    out = quality.predict(rows, network).collect()
    assert len(out) == rows.count() and all(0 <= r.score <= 1 for r in out)
    empty = {round(r.score, 9) for r in out if not (r.row.text or "").strip()}
    assert len(empty) == 1
    assert quality.predict(rows.limit(0), network).count() == 0


def brute_contamination(text, items, size=13):
    w = decontaminate.words_of(text or "")
    hit, found = set(), set()
    for item, t in items:
        for win in decontaminate.windows_of(t or "", size):
            win = win.split()
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize(("block_bytes", "block_windows", "block_docs"), [(1_000_000, 40_000, 2_000), (200, 40_000, 2_000), (200, 3, 2)])
def test_contamination(spark, monkeypatch, block_bytes, block_windows, block_docs):
    """By one automaton, by blocks of windows, and by many small blocks whose documents go to several tasks."""
    monkeypatch.setattr(decontaminate, "BLOCK_DOCS", block_docs)
    rng = random.Random(6)
    items = [(i, " ".join(rng.choice("abcde") for _ in range(rng.choice([0, 3, 13, 30])))) for i in range(12)] + [(3, "a b"), (40, None)]
    texts = [" ".join(rng.choice("abcdé") for _ in range(rng.randrange(80))) for _ in range(40)]
    texts += [f"é-{items[k][1].upper()}!  tail" for k in range(12)]
    rows = [*enumerate(texts), (None, None), (1, texts[1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.find_contamination(docs(spark, rows), benchmark, block_bytes=block_bytes, block_windows=block_windows).collect()
    assert len(out) == len(rows)
    for r in out:
        n, hit, found = brute_contamination(r.row.text, items)
        assert (r.n_words, r.n_hit, r["items"]) == (n, hit, found)
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
        for s in r.spans:
            inside = decontaminate.words_of(r.row.text[s.start : s.stop])
            assert len(inside) <= 13 and b" ".join(inside) in b" ".join(decontaminate.words_of(r.row.text))
    odd = awkward(spark)
    assert decontaminate.drop_contaminated(odd, benchmark).columns == odd.columns
    assert decontaminate.drop_contaminated(odd, benchmark.limit(0)).count() == odd.count()


def test_contamination_of_a_large_benchmark_is_that_of_one_automaton(spark):
    """The whole tables, every column; one item is longer than a block, some have no id, some no words, and ids come twice."""
    texts = docs(spark, [(i, t) for i, t in enumerate(["the quick brown fox", None, "", "Über-Maß und Ziel " * 40, "a b c d e f g h i j k l m n o p " * 30])])
    texts = texts.unionByName(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"), allowMissingColumns=True).select("doc_id", "text")
    more = [("long", "a b c d e f g h i j k l m n o p " * 200), (None, "quick brown"), ("x", None), ("y", "..."), ("x", "maß und"), ("z", "maß und"), ("z", "maß und")]
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet").selectExpr("cast(item_id as string) as item_id", "text").unionByName(spark.createDataFrame(more, "item_id string, text string"))
    facts = lambda **how: sorted((r.row.doc_id, str(r)) for r in decontaminate.find_contamination(texts, benchmark, **how).select("row", "n_words", "n_hit", "items", "spans", "contaminated").collect())
    one = facts()
    assert sum("contaminated=True" in x for _, x in one) > 3
    assert facts(block_bytes=1000, block_windows=500) == one


def test_digest_columns(spark):
    row = QUERIES["op9_decontamination"](spark, SMALL).where("n_items = 0").first()
    assert row.items_sha256 == hashlib.sha256(b"").hexdigest()
