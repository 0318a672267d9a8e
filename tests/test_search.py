import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.functions import scores, vector
from tessel.operators import chunks, context, contextual, domain, index, intent, ranking, search
from tessel import queries
from tessel.plans.lexicon import DEFAULT, Category, Lexicon


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_dot_and_norm(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.8), F.lit(0.6), F.lit(0.0))
    assert one(spark, vector.dot(a, b)) == pytest.approx(0.8)
    assert one(spark, vector.norm(b)) == pytest.approx(1.0)
    assert one(spark, vector.mean_of(F.array(a, b), 3)) == pytest.approx([0.9, 0.3, 0.0])


@pytest.mark.parametrize("score, out", [(-0.1, 0.0), (0.12, 0.24), (0.34, 0.95), (0.4, 1.0)])
def test_calibrate(spark, score, out):
    assert one(spark, scores.calibrate(F.lit(score))) == pytest.approx(out)


def test_blends(spark):
    image, title = F.lit(0.9), F.lit(0.4)
    assert one(spark, scores.blend_image(image, title)) == pytest.approx(0.925)
    assert one(spark, scores.blend_text(image, title)) == pytest.approx(0.55)
    good = one(spark, scores.blend_text(F.lit(0.7), F.lit(0.75), F.lit(0.95)))
    assert good > one(spark, scores.blend_text(F.lit(0.68), F.lit(0.72), F.lit(0.2)))
    assert one(spark, scores.blend_text(image, title, F.lit(0.9), F.lit(True))) == 0.0


def cliff(spark, values, **rule):
    rows = spark.createDataFrame(list(enumerate(values)), "id int, score double")
    r = ranking.Cliff(**rule)
    kept = [x.id for x in ranking.cut_at_cliff(rows, "score", "text", r, ties=("id",)).orderBy("rank").collect()]
    return kept, ranking.cliff_report(rows, "score", "text", r, ties=("id",)).first()


def test_cliff_cuts_at_the_gap(spark):
    kept, facts = cliff(spark, [0.92, 0.88, 0.85, 0.65, 0.40, 0.25], gap=0.15)
    assert kept == [0, 1, 2]
    assert (facts.total_candidates, facts.kept_count, facts.eliminated_count, facts.gap_detected, facts.gap_rank) == (6, 3, 3, True, 3)


def test_a_gap_after_the_first_row_does_not_count(spark):
    assert cliff(spark, [0.90, 0.60, 0.59, 0.58], gap=0.12)[0] == [0, 1, 2, 3]


def test_nothing_above_the_floor(spark):
    kept, facts = cliff(spark, [0.27, 0.20])
    assert kept == [] and facts.reason == "all_below_quality_or_incompatible" and facts.kept_count == 0


INTENTS = {
    "ball": (None, None, None, True), "dog": (None, None, None, True), "basketball shoes": ("shoes", None, None, False), "red dress": ("dresses", "red", "Women", False),
    "black shoes for women": ("shoes", "black", "Women", False), "men t-shirt": ("tshirts", None, "Men", False), "blue jeans": ("jeans", "blue", None, False),
    "running shoes": ("sports shoes", None, None, False), "analog watch": ("watches", None, None, False), "navy blue casual shirt": ("shirts", "blue", None, False),
    "dress shirt": ("dresses", None, "Women", False), "short sleeve shirt": ("shorts", None, None, False), "red ring": ("rings", "red", None, False), "": (None, None, None, False),
}


def test_intents(spark):
    rows = intent.parse_intent(spark.createDataFrame([(q,) for q in INTENTS], "query string")).collect()
    found = {r.query: (r.intent.target_category, r.intent.target_color, r.intent.target_gender, r.intent.is_non_fashion_query) for r in rows}
    assert found == INTENTS


LATE = {"tee": "tshirts", "polo": "tshirts", "joggers": "track pants", "chinos": "trousers", "blazer": "jackets", "frock": "dresses", "tote bag": "handbags", "kada": "bracelets"}


def test_late_synonyms(spark):
    """Synonyms beyond the first four count, in queries, in the lookup and in products' n-grams."""
    rows = intent.parse_intent(spark.createDataFrame([(q,) for q in LATE], "query string")).collect()
    assert {r.query: r.intent.target_category for r in rows} == LATE
    found = spark.createDataFrame([(q,) for q in LATE], "q string").select("q", intent.lexicon_entry(F.col("q"))["name"].alias("entry")).collect()
    assert {r.q: r.entry for r in found} == LATE
    grams = chunks.attribute_ngrams(spark.createDataFrame([JEANS], COLUMNS)).first()
    assert "ripped jeans" in grams.unigrams and "blue ripped jeans" in grams.bigrams and "men blue ripped jeans" in grams.trigrams


def test_topwear_and_bottomwear_decide(spark):
    asked = intent.parse_intent(spark.createDataFrame([("handbag",), ("trousers",)], "query string"))
    rows = spark.createDataFrame([("Plain one", "Men", "", "Topwear", "Tunic", "", ""), ("Plain one", "Men", "", "Bottomwear", "Cargos", "", "")], COLUMNS)
    found = {(r.query, r.subCategory): r.context.category_multiplier for r in context.with_context_score(rows.crossJoin(asked)).collect()}
    assert found == {("handbag", "Topwear"): 0.0, ("handbag", "Bottomwear"): 0.6, ("trousers", "Topwear"): 0.6, ("trousers", "Bottomwear"): 1.25}


def test_a_lexicon_is_a_parameter(spark):
    own = Lexicon((Category("gizmos", ("gizmo", "gadget"), "small things"),))
    rows = intent.parse_intent(spark.createDataFrame([("shiny gadget",)], "query string"), lexicon=own)
    assert rows.first().intent.target_category == "gizmos"


JEANS = ("Peter England Men Blue Jeans", "Men", "Apparel", "Bottomwear", "Jeans", "Blue", "Casual")
SHIRT = ("Turtle Check Men Shirt", "Men", "Apparel", "Topwear", "Shirts", "Navy Blue", "Casual")
COLUMNS = "productDisplayName string, gender string, masterCategory string, subCategory string, articleType string, baseColour string, usage string"


def test_chunks(spark):
    rows = chunks.with_chunks(spark.createDataFrame([JEANS], COLUMNS)).first().chunks
    assert [c.chunk_id for c in rows] == list(range(len(rows)))
    assert [c.chunk_type for c in rows] == ["identity_category", "style_attributes", "ngram_context", "semantic_context"]
    grams = chunks.attribute_ngrams(spark.createDataFrame([JEANS], COLUMNS)).first()
    assert "blue jeans" in grams.bigrams and "men blue jeans" in grams.trigrams and any("denim" in g for g in grams.bigrams)


def test_context_scores(spark):
    asked = intent.parse_intent(spark.createDataFrame([("blue jeans",)], "query string"))
    rows = context.with_context_score(spark.createDataFrame([JEANS, SHIRT], COLUMNS).crossJoin(asked)).collect()
    by = {r.articleType: r.context for r in rows}
    assert by["Jeans"].score == 1.0 and not by["Jeans"].is_disqualified
    assert by["Shirts"].context_multiplier == pytest.approx(0.81) and by["Shirts"].score == pytest.approx(0.14175)


def test_nulls_score_like_empty_texts(spark):
    asked = intent.parse_intent(spark.createDataFrame([("red dress",), ("",)], "query string"))
    row = spark.createDataFrame([(None,) * 7], COLUMNS)
    found = {r.query: r.context for r in context.with_context_score(row.crossJoin(asked)).collect()}
    assert found[""].score == 0.5 and found["red dress"].is_disqualified


def test_unified_search_invariants(spark):
    points = search.split_points(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"))
    query = points.where("point_id = 0").select(F.col("vector").alias("query"))
    for strategy in ("weighted_sum", "score_fusion", "rrf", "anything else"):
        rows = search.search_unified(points, query, "image", 10, strategy=strategy).orderBy("rank").collect()
        assert [r.rank for r in rows] == list(range(1, 11)) and len({r.product_id for r in rows}) == 10
        assert all(a.final_score >= b.final_score for a, b in zip(rows, rows[1:], strict=False))
    with pytest.raises(ValueError):
        search.search_unified(points, query, top_k=0)


def test_batch_search_equals_single_searches(spark):
    points = search.split_points(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"))
    asked = points.where("point_id < 6").select(F.col("point_id").alias("query_id"), F.col("vector").alias("query"))
    found = {(r.query_id, r["rank"]): r.point_id for r in search.batch_top_hits(points, asked, 5, block_bytes=1024).collect()}
    for q in range(6):
        single = search.top_hits(points, asked.where(F.col("query_id") == q), 5).collect()
        assert [found[q, i] for i in range(1, 6)] == [r.point_id for r in sorted(single, key=lambda r: r["rank"])]


def test_upsert_and_lookup(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, v string, version int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "id long, v string, version int")
    assert sorted((r.id, r.v) for r in index.upsert(old, new, "id", "version").collect()) == [(1, "a"), (2, "d"), (3, "e")]
    assert index.retrieve(old, spark.createDataFrame([(1,), (1,)], "id long"), "id").count() == 1


def test_registered_queries_take_all_rows(spark):
    """Batch queries, originals and crops, and both sides of the upsert, against brute force over all rows."""
    sf_dir = "/root/testdata/sf0.001"
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}

    def best(q, n, but=None):
        dots = {i: sum(a * b for a, b in zip(vectors[q], v, strict=True)) for i, v in vectors.items() if i != but}
        return sorted(dots, key=lambda i: (-dots[i], i))[:n]

    found = {(r.query_id, r["rank"]): r.point_id for r in queries.QUERIES["batch_query_topk"](spark, sf_dir).collect()}
    assert found == {(q, k): i for q in vectors if q % 20 == 0 for k, i in enumerate(best(q, 10), 1)}
    shown = queries.QUERIES["crop_arbitration"](spark, sf_dir).collect()
    assert {r.image_id for r in shown} == {i for i in vectors if i % 20 == 0} and len(shown) == 3 * len({r.image_id for r in shown})
    assert all(r.product_id == best(q := r.image_id + (r.source == "crop"), 3, but=q)[r["rank"] - 1] for r in shown)
    latest = {}
    for r in spark.read.parquet(f"{sf_dir}/events.parquet").collect():
        latest[r.user_id] = max(latest.get(r.user_id, -1), r.event_id)
    assert {r.user_id: r.event_id for r in queries.QUERIES["upsert_latest"](spark, sf_dir).collect()} == latest


def found_by(spark, queries, mode="text", **more):
    """Contextual search over three products with vectors along the axes."""
    unit = lambda i: [float(i == k) for k in range(3)]
    images = spark.createDataFrame([(i + 1, unit(i)) for i in range(3)], "product_id long, vector array<double>")
    parts = spark.createDataFrame([(1000 * (i + 1), i + 1, f"chunk of {i + 1}", unit(i)) for i in range(3)], "point_id long, product_id long, chunk_text string, vector array<double>")
    goods = spark.createDataFrame([(1, *JEANS, None), (2, *SHIRT, "plain")], "id long, " + COLUMNS + ", name string")
    return contextual.search_contextual(spark.createDataFrame(queries, "query_id int, query string, vector array<double>, is_out_of_domain boolean"), images, parts, goods, mode, **more)


def test_gates_and_payload_of_contextual_search(spark):
    asked = [(1, "blue jeans", [1.0, 0.1, 0.0], None), (2, "dog", [1.0, 0.0, 0.0], False), (3, "  ", [1.0, 0.0, 0.0], None), (4, "red dress", [1.0, 0.0, 0.0], True), (5, None, [0.0, 0.0, 1.0], None)]
    found = found_by(spark, asked)
    report = {r.query_id: r for r in found.report.collect()}
    assert {k: r.reason for k, r in report.items()} == {1: None, 2: "non_fashion_query", 3: "empty_query", 4: "out_of_domain", 5: None}
    assert "dog" in report[2].details and report[2].is_out_of_domain and not report[3].is_out_of_domain and report[1].total_candidates == 3
    rows = sorted(found.results.collect())
    first = {r.query_id: r for r in rows if r["rank"] == 1}
    assert first[1].id == 1 and first[1].name == "Product #1" and first[1].display_name == JEANS[0] and first[1].image_filename == "1.jpg" and first[1].best_matching_chunk == "chunk of 1"
    assert first[5].id == 3 and first[5].name == "Product #3" and first[5].gender == "" and first[5].ngram_score is None and report[5].kept_count == 1
    for r in report.values():
        assert r.kept_count + r.eliminated_count == r.total_candidates


def test_image_floor_of_contextual_search(spark):
    asked = [(1, None, [0.3, 0.1, 0.0], None), (2, None, [0.0, 0.9, 0.3], None)]
    found = found_by(spark, asked, "image", eliminate_noise=False)
    report = {r.query_id: r for r in found.report.collect()}
    assert report[1].reason == "low_similarity_floor" and "0.30" in report[1].details and report[1].eliminated_count == 3
    assert [(r.query_id, r.id) for r in found.results.orderBy("rank").collect()] == [(2, 2), (2, 3)] and report[2].kept_count == 2


def test_pairs_of_the_index_are_all_that_score(spark):
    """Every pair of queries and products, scored one by one, against the pairs that the inverted index forms."""
    goods = [
        (1, "Red Dress for Women", "Dresses", "Red", "Women"), (2, "colored dresses", "Dresses", None, None), (3, "T-Shirt, blue", "Tshirts", "Blue", "Men"),
        (4, "Plain shirt", "Shirts", "", "Men"), (5, "it's a men's tie", "Ties", "Black", "Men"), (6, None, None, None, None), (7, "x-y zed drum", "", "Navy", "Girls"), (8, "shoes", "Shoes", "blue", "Unisex"),
    ]
    table = spark.createDataFrame(goods, "id long, name string, articleType string, baseColour string, gender string")
    asked = ["red dress", "ed dr", "shirt", "t-shirt blue", "dresses for women", "navy tie", "", "y", "a b", "--", "men s", "zed drums", "d dr", "shoe", "blue shoes running", "it's"]
    rows = intent.parse_intent(spark.createDataFrame(list(enumerate(asked)), "query_id int, query string"))
    every = context.with_context_score(table.crossJoin(rows)).where("size(intent.tokens) > 0 and context.score > 0")
    facts = lambda df: sorted(str((r.query_id, r.id, r.context)) for r in df.collect())
    want = facts(every)
    features = context.context_features(table)
    for index in (None, context.context_index(features)):
        assert facts(context.context_pairs(features, rows, index).where("context.score > 0")) == want
    substring = {(r.query_id, r.id) for r in every.where("context.unigram_recall = 0").collect()}
    assert (1, 1) in substring and want  # a pair without a common word
    assert context.context_pairs(features.limit(0), rows).count() == context.context_pairs(features, rows.limit(0)).count() == 0


def test_intents_by_a_join_are_those_by_patterns(spark):
    asked = [*queries.QUERY_TEXTS, None, "T-SHIRT'S dress-shirt", "a  polo-shirt,v-neck", "red-dress", "navy blue's", "running_shoes", "<b>Tie</b> dye", "dog dog's", "hot dog; ball", "-", "track  pants", "men's t-shirts & women", "étui red", "x dress y shirt z hoodie coat"]
    rows = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    facts = lambda df: sorted(str((r.query_id, r.query, r.intent)) for r in df.select("query_id", "query", "intent").collect())
    assert facts(intent.parse_intents(rows, "query_id")) == facts(intent.parse_intent(rows))
    assert intent.parse_intents(rows.limit(0), "query_id").count() == 0
    own = Lexicon.from_rows([("mugs", ("coffee mug set", "mug"), "kitchen")])
    assert facts(intent.parse_intents(rows, "query_id", lexicon=own)) == facts(intent.parse_intent(rows, lexicon=own))


def test_a_grid_finds_what_a_broadcast_finds(spark):
    """Also with ties, queries of several blocks, and rows without vectors."""
    rows = spark.range(300).select(F.col("id").alias("point_id"), F.array(F.col("id") % 7, F.col("id") % 5, F.lit(1)).cast("array<double>").alias("vector"))
    rows = rows.unionByName(spark.createDataFrame([(900, None)], "point_id long, vector array<double>"))
    asked = spark.range(40).select(F.concat(F.lit("q"), "id").alias("query_id"), F.array(F.col("id") % 3, -(F.col("id") % 4), F.lit(0.5)).cast("array<double>").alias("query"))
    facts = lambda df: sorted((r.query_id, r["rank"], r.point_id, r.score) for r in df.collect())
    want = facts(search.batch_top_hits(rows, asked, 6))
    assert len(want) == 240 and facts(search.batch_top_hits(rows, asked, 6, block_bytes=200)) == want
    assert facts(search.grid_top_hits(rows.where("vector is not null"), asked, 6, 10**9)) == want
    assert search.batch_top_hits(rows.limit(0), asked, 6, block_bytes=200).count() == 0


def test_a_long_list_without_keys(spark):
    """One list in ranges against the same list in one window, with gaps at and across the bounds of ranges."""
    import random

    rng = random.Random(4)
    for case in range(4):
        scores_ = sorted((round(0.3 + rng.random() * 0.6, 3) for _ in range(60)), reverse=True)
        if case == 1:
            scores_ = [x + 0.2 if i < 30 else x for i, x in enumerate(scores_)]
        rows = spark.createDataFrame([(i, s, 1) for i, s in enumerate(scores_ if case < 3 else [0.1, 0.2])], "id long, score double, one int").repartition(5)
        rule = ranking.Cliff(gap=(0.12, 0.15, 0.02, 0.12)[case])
        whole = ranking.cliff_report(rows, "score", "text", rule, ties=("id",)).collect()
        assert whole == ranking.cliff_report(rows, "score", "text", rule, ("one",), ("id",)).drop("one").collect()
    assert ranking.cliff_report(rows.limit(0), "score", "text", ties=("id",)).first().reason == "empty_input"


def test_few_ids_read_few_folders(spark, tmp_path):
    points = spark.range(2000).select(F.col("id").alias("point_id"), F.expr("id div 2").alias("product_id"), (F.col("id") % 2 == 1).alias("is_title"))
    path = str(tmp_path / "points")
    index.write_points(points, path)
    ids = spark.createDataFrame([(4,), (5,), (1999,), (5,), (99999,), (None,)], "point_id long")
    assert sorted(r.point_id for r in index.lookup(spark, path, ids).collect()) == [4, 5, 1999]
    goods = spark.createDataFrame([(2,), (7,)], "product_id long")
    assert sorted(r.point_id for r in index.lookup(spark, path, goods, "product_id").collect()) == [4, 5, 14, 15]
    read = index.points_near(spark, path, ids, F.expr("point_id div 2"))
    files = {r[0] for r in read.select(F.input_file_name()).distinct().collect()}
    assert len(files) <= 3 and len({r[0] for r in spark.read.parquet(path).select(F.input_file_name()).distinct().collect()}) > 40
    assert index.lookup(spark, path, ids.limit(0)).count() == 0


def test_multipliers_of_every_pair(spark):
    """No query and no product is left out, whatever they have in common."""
    sf = "/root/testdata/sf0.001"
    pairs = queries.multipliers(spark, sf)
    assert pairs.count() == pairs.select("query_id", "id").distinct().count() == len(queries.QUERY_TEXTS) * queries.products(spark, sf).count()
    goods = spark.createDataFrame([(1, "Red Dress", "Dresses", "Red", "Women"), (2, "Blue shirt", "Shirts", "Blue", "Men"), (3, None, None, None, None)], "id long, name string, articleType string, baseColour string, gender string")
    asked = intent.parse_intent(spark.createDataFrame(list(enumerate(["red dress for women", "ball", "", "men t-shirt"])), "query_id int, query string"))
    facts = lambda df: sorted(str((r.query_id, r.id, r.context)) for r in df.collect())
    found = facts(context.context_of_all(context.context_features(goods), asked))
    assert len(found) == 12 and found == facts(context.with_context_score(goods.crossJoin(asked)))


def test_scores_of_every_pair(spark):
    """Pairs that score 0 are rows, and a query without words scores 0.5 with everything."""
    sf = "/root/testdata/sf0.001"
    pairs, n = queries.context_scores(spark, sf), queries.products(spark, sf).count()
    assert pairs.count() == len(queries.QUERY_TEXTS) * n and pairs.where("score = 0").count() > 0
    assert pairs.where((F.col("query_id") == queries.QUERY_TEXTS.index("")) & (F.col("score") == 0.5)).count() == n


def test_products_that_say_the_same_are_scored_once(spark, tmp_path, monkeypatch):
    """Twins get the score of one of them, ids and counts stay; with few twins or too many different products each is scored."""
    parts = [(i, ("red dress", "navy blue shirt", "old bolt")[i % 3], f"Brand#{i % 2}", "SMALL", i % 7, 1.0) for i in range(400)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    plan_of = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    facts = lambda df: sorted(map(str, df.collect()))
    once = queries.context_scores(spark, str(tmp_path))
    assert "collect_list" in plan_of(once) and "collect_list" in plan_of(queries.multipliers(spark, str(tmp_path)))
    found = facts(once)
    monkeypatch.setattr(context, "BROADCAST_PAIRS", 500)
    each = queries.context_scores(spark, str(tmp_path))
    assert "collect_list" not in plan_of(each) and found == facts(each) and len(found) == 400 * len(queries.QUERY_TEXTS)
    goods = [(1, "Red Dress", "", "Women"), (2, "Red Dress", None, "Women"), (3, "Red Dress", "", "Men"), (3, "Red Dress", None, "Women"), (None, "Red Dress", "", "Women"), (6, None, "", None), (7, "", None, "")]
    table = spark.createDataFrame(goods, "id long, name string, baseColour string, gender string")
    asked = intent.parse_intent(spark.createDataFrame(list(enumerate(["red dress for women", "", "red dress for women"])), "query_id int, query string"))
    found = context.context_of_catalog(table, asked)
    want = context.context_of_all(context.context_features(table), asked).select("query_id", "id", "context")
    assert "collect_list" in plan_of(found) and len(facts(found)) == 21 and facts(found) == facts(want)
    assert context.context_of_catalog(table.select("id"), asked).count() == 21


def test_runs_of_words_are_found_in_texts_and_among_the_products_own(spark):
    """A run counts that stands in the text, also inside longer words, or among the words that are left without single letters."""
    goods = spark.createDataFrame([(1, "red a dressy top"), (2, "red dressy top"), (3, "tired dresses")], "id long, name string")
    asked = intent.parse_intent(spark.createDataFrame(list(enumerate(["red dressy", "red dress", "red dressy top", "red dresses"])), "query_id int, query string"))
    rows = context.context_of_all(context.context_features(goods), asked).collect()
    found = {(r.query_id, r.id): (r.context.bigram_score, r.context.trigram_score) for r in rows}
    assert found[0, 1] == (1.0, 1.0) and found[1, 1] == (0.0, 0.0) and found[2, 1] == (1.0, 1.0)
    assert found[0, 2] == found[1, 2] == found[2, 2] == (1.0, 1.0)
    assert found[0, 3] == (0.0, 0.0) and found[1, 3] == found[3, 3] == (1.0, 1.0) and found[3, 2] == (1.0, 1.0)


def test_a_pair_compares_categories_and_not_their_terms(spark):
    """A product's categories are those with one of its words or stems as a term, and a query brings names alone."""
    from tessel.functions.text import stem_of

    own = Lexicon((Category("gizmos", ("gizmo", "gadget"), ""), Category("boxes", ("box", "big box", "gadget"), "")), incompatible={"gizmos": ("boxes", "none")})
    for lexicon in (DEFAULT, own):
        terms = {t for c in lexicon.categories for t in c.terms}
        texts = [[t] for t in sorted(terms)] + [["plain", "gadgets", "dresses", "t-shirts"], ["ring", "watches"], ["nothing"], []]
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, words array<string>").select("i", context.categories_with(F.col("words"), lexicon).alias("c")).collect()
        for r in rows:
            words = {x for w in texts[r.i] if " " not in w for x in (w, stem_of(w))}
            if not any(" " in w for w in texts[r.i]):
                assert set(r.c) == {c.name for c in lexicon.categories if words & set(c.terms)}
        names = spark.createDataFrame([(c.name,) for c in lexicon.categories] + [("no such",), (None,)], "n string")
        for r in names.select("n", context.excluded_by(F.col("n"), lexicon).alias("e")).collect():
            assert r.e == [k for k in lexicon.incompatible.get(r.n, ()) if lexicon.named(k)]
    asked = context.with_query_features(intent.parse_intent(spark.createDataFrame([("red dress",)], "query string")))
    assert len(asked.first()._q.excluded) == len(DEFAULT.incompatible["dresses"])


def test_best_hits_are_kept_in_n_by_k(spark, monkeypatch):
    """What a task keeps doesn't grow with the points it has seen, ties included, and more hits than a task may keep go to the grid."""
    rng = np.random.default_rng(5)
    asked, points = rng.integers(-2, 3, (7, 3)).astype("f8"), rng.integers(-2, 3, (900, 3)).astype("f8")
    best = search.Best(7, 4)
    for a in range(0, 900, 50):
        best.meet(asked, np.arange(a, a + 50)[::-1], points[a : a + 50][::-1])
        assert best.scores.size == best.ids.size == 7 * 4
    found = [(int(q), float(s), int(i)) for part in best.rows(3) for q, s, i in zip(*part)]
    scores = asked @ points.T
    assert found == [(q, scores[q, i], i) for q in range(7) for i in sorted(range(900), key=lambda i: (-scores[q, i], i))[:4]]
    few = search.Best(2, 5)
    few.meet(asked[:2], np.array([8, 3]), points[:2])
    assert few.count.tolist() == [2, 2] and sum(len(part[0]) for part in few.rows()) == 4
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points[:200])], "point_id long, vector array<double>")
    q = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(asked)], "query_id string, query array<double>")
    facts = lambda df: sorted((r.query_id, r.rank, r.point_id, r.score) for r in df.collect())
    want = facts(search.batch_top_hits(p, q, 4))
    monkeypatch.setattr(search, "KEPT_HITS", 10)
    grid = search.batch_top_hits(p, q, 4)
    assert "MapInArrow" not in grid._jdf.queryExecution().optimizedPlan().toString() and facts(grid) == want
