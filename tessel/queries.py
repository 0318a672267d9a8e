"""Queries over the test tables, one for each operator or a small chain of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.functions import boxes, scores, text, vector
from tessel.operators import chunks, context, contextual, domain, image_search, index, intent, ranking, search
from tessel import providers
from tessel.plans import build as plan
from tessel.session import scratch, table, written
from tessel.sources import catalog
from tessel.streaming import build

QUERY_TEXTS = (
    "ball", "dog", "basketball shoes", "red dress", "dress for women", "red dress for women", "black shoes for women", "men t-shirt",
    "blue jeans", "running shoes", "analog watch", "casual black shirt", "navy blue sports shoes", "navy blue casual shirt",
    "red floral summer dress", "black leather wallet", "sport running shoes white", "classic silver analog watch",
    "brown formal leather shoes", "dress shirt", "short sleeve shirt", "red ring", "",
)


# -- vectors ---------------------------------------------------------------------------------------------------------


def points_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.split_points(table(spark, sf_dir, "embeddings"))


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("query"))


def unified(mode: str, strategy: str, **more):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        points = points_of(spark, sf_dir)
        found = search.search_unified(points, query_vector(spark, sf_dir), mode, strategy=strategy, **more)
        return found.select("product_id", F.col("rank").cast("long").alias("rank"), "final_score", "image_score", "title_score")

    return run


def dot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.top_hits(points_of(spark, sf_dir), query_vector(spark, sf_dir), 50)
    return hits.select("point_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    unit = vector.normalised(F.col("embedding"))
    return rows.select("vec_id", F.round(vector.norm(F.col("embedding")), 6).alias("norm"), F.round(unit[0], 6).alias("first"))


def batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = search.batch_top_hits(points_of(spark, sf_dir), asked, 10)
    return found.select("query_id", "point_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def grouped_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.top_hits(points_of(spark, sf_dir), query_vector(spark, sf_dir), 100)
    hits = hits.withColumn("product_id", F.expr("point_id div 2")).withColumn("is_title", F.col("point_id") % 2 == 1)
    rows = search.group_hits(hits)
    return rows.select(
        "product_id", *[F.round(c, 6).alias(c) for c in ("image_score", "title_score")], *[F.col(c).cast("long").alias(c) for c in ("image_rank", "title_rank")]
    )


def counterparts(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, q = points_of(spark, sf_dir), query_vector(spark, sf_dir)
    hits = search.top_hits(points, q, 100).withColumn("product_id", F.expr("point_id div 2")).withColumn("is_title", F.col("point_id") % 2 == 1)
    grouped, folder = written(search.group_hits(hits)), scratch(spark)
    index.write_points(points, folder)
    missing = grouped.where("image_score is null or title_score is null")
    rows = search.fill_counterparts(grouped, index.points_near(spark, folder, missing, F.col("product_id")), q)
    return rows.select("product_id", *[F.round(c, 6).alias(c) for c in ("image_score", "title_score")])


def similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(product_id, image, title): both similarities to the query vector."""
    rows = search.scored(points_of(spark, sf_dir), query_vector(spark, sf_dir))
    side = lambda n: F.max(F.when(F.col("point_id") % 2 == n, F.col("score")))
    return rows.groupBy(F.expr("point_id div 2").alias("product_id")).agg(side(0).alias("image"), side(1).alias("title"))


def near_identical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = similarities(spark, sf_dir)
    return rows.select("product_id", F.round(scores.fuse_weighted(F.col("image"), F.col("title"), "image"), 4).alias("score")).where(F.col("score") > 0.2)


def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = similarities(spark, sf_dir)
    return rows.select("product_id", F.round(scores.calibrate(F.col("image")), 4).alias("image"), F.round(scores.calibrate(F.col("title")), 4).alias("title"))


def blended(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = similarities(spark, sf_dir)
    image, title = F.col("image"), F.col("title")
    ngram = F.when(F.col("product_id") % 3 == 0, 0.0).otherwise(F.col("product_id") % 10 / 10)
    return rows.select(
        "product_id",
        F.round(scores.blend_image(image, title), 4).alias("image_mode"),
        F.round(scores.blend_text(image, title), 4).alias("text_mode"),
        F.round(scores.blend_text(image, title, ngram, F.col("product_id") % 7 == 0), 4).alias("with_context"),
    )


def label_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of scores by label."""
    rows = search.scored(points_of(spark, sf_dir), query_vector(spark, sf_dir))
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), "label")
    return rows.join(labels, "point_id").select("label", "point_id", F.round(F.col("score") + 0.2, 4).alias("score"))


RULE = ranking.Cliff(gap=0.02)


def cliff_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ranking.cut_at_cliff(label_lists(spark, sf_dir), "score", "text", RULE, ("label",), ("point_id",))
    return kept.select("label", "point_id", "score", F.col("rank").cast("long").alias("rank"))


def cliff_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.cliff_report(label_lists(spark, sf_dir), "score", "text", RULE, ("label",), ("point_id",)).select(
        "label", "total_candidates", "kept_count", "eliminated_count", "gap_detected", "gap_rank", "gap_size", "reason"
    )


def whole_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as one list."""
    rows = label_lists(spark, sf_dir)
    return ranking.cliff_report(rows, "score", "text", ranking.Cliff(gap=0.004), ties=("point_id",)).drop("top_score")


def grid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``batch_query_topk`` finds, by the grid of blocks."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("query"))
    points = rows.select(F.col("vec_id").alias("point_id"), F.col("embedding").cast("array<double>").alias("vector"))
    found = search.grid_top_hits(points, asked, 10, block_bytes=1 << 18)
    return found.select("query_id", "point_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def floor_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = similarities(spark, sf_dir).select("product_id", F.round("image", 6).alias("image_score"))
    return search.image_floor(rows.where(F.col("product_id") < 40)).unionByName(search.image_floor(rows.where(F.col("product_id") >= 40)))


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit mean vector of each label, one row for each component."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    mean = rows.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    length = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy("label")))
    return mean.select("label", F.col("pos").cast("long").alias("pos"), F.round(F.col("m") / length, 4).alias("value"))


LABELS = ("fashion", "sports_ball", "animal", "vehicle", "food", "other")


def zero_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    name = F.element_at(F.array(*map(F.lit, LABELS)), F.col("vec_id").cast("int") + 1)
    labels = rows.where(F.col("vec_id") < len(LABELS)).select(name.alias("label"), F.col("embedding").alias("vector"))
    images = rows.select(F.col("vec_id").alias("image_id"), F.col("embedding").alias("vector"))
    found = domain.zero_shot_domain(domain.label_probabilities(images, labels))
    return found.select("image_id", "top_label", F.round("top_p", 4).alias("top_p"), "is_ood")


def arbitration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of an original and a crop for each vector whose id is divisible by 20: the crop is the next vector.  None is its own result."""
    rows = table(spark, sf_dir, "embeddings")
    points = points_of(spark, sf_dir)

    def results(shift: int) -> DataFrame:
        asked = rows.where((F.col("vec_id") >= shift) & ((F.col("vec_id") - shift) % 20 == 0)).select((F.col("vec_id") - shift).alias("query_id"), F.col("embedding").alias("query"))
        found = search.batch_top_hits(points, asked, 4).where(F.col("point_id") != F.col("query_id") + shift)
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= 3)
        return found.select(F.col("query_id").alias("image_id"), F.col("rank").cast("long").alias("rank"), F.col("point_id").alias("product_id"), F.col("score").alias("image_score"), F.col("score").alias("final_score"))

    shown = domain.arbitrate(results(0), results(1), keep_from=0.4, in_domain_from=0.35)
    return shown.select("image_id", "source", "rank", "product_id", F.round("image_score", 6).alias("image_score"), "in_domain_by_match")


# -- text ------------------------------------------------------------------------------------------------------------


def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_text(F.col("text")).alias("clean"))


def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.clean_text(F.col("html")).alias("clean"))


def words_of(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.tokens(F.col("text")).alias("w"))
        return rows.select("conv_id", "turn", F.array_join(f(F.col("w")), "|").alias("words"))

    return run


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("  "), F.col("p_name"), F.lit(" \t  "), F.when(F.col("p_partkey") % 9 != 0, F.col("p_brand")))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), raw.alias("productDisplayName"))
    return catalog.valid_products(rows).select("id", F.col("productDisplayName").alias("title"))


def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("k"))


def json_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.col("p_partkey") % 4 == 0, F.lit("{broken")).otherwise(
        F.concat(F.lit('{"data":{"productDescriptors":{"description":{"value":"'), F.col("p_name"), F.lit('"}}}}'))
    )
    return table(spark, sf_dir, "part").select("p_partkey", catalog.description(body).alias("description"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.col("event_id") % 5 == 0, F.lit("not json")).otherwise(F.concat(F.lit('{"query":"'), F.col("event_type"), F.lit('","top_k":'), (F.col("event_id") % 20).cast("string"), F.lit("}")))
    parsed = catalog.parse_request(body, "query string, top_k int", query="", top_k=10)
    return table(spark, sf_dir, "events").select("event_id", parsed.alias("r")).select("event_id", "r.query", F.col("r.top_k").cast("long").alias("top_k"))


# -- intent and chunks -----------------------------------------------------------------------------------------------


def query_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(QUERY_TEXTS)), "query_id long, query string")


def asked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query): what is said in conversations, and the names of products, every second one after a query of the list."""
    said = table(spark, sf_dir, "conversations").select(F.concat_ws("/", F.lit("c"), "conv_id", "turn").alias("query_id"), F.col("text").alias("query"))
    before = F.element_at(F.array(*map(F.lit, QUERY_TEXTS)), (F.col("p_partkey") % len(QUERY_TEXTS) + 1).cast("int"))
    named = table(spark, sf_dir, "part").select(F.concat_ws("/", F.lit("p"), "p_partkey").alias("query_id"), F.when(F.col("p_partkey") % 2 == 0, before).otherwise(F.concat_ws(" ", before, "p_name")).alias("query"))
    return said.unionByName(named)


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = intent.parse_intents(asked_texts(spark, sf_dir), "query_id").select("query_id", "intent.*")
    return i.select(
        "query_id", "target_category", "target_gender", "target_color", F.array_join("color_shades", "|").alias("shades"), "is_non_fashion_query", "non_fashion_term", F.array_join("tokens", "|").alias("tokens")
    )


def prompt_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrasings of each different text."""
    rows = asked_texts(spark, sf_dir).select("query").distinct()
    return rows.select("query", F.array_join(intent.prompts(F.col("query")), "|").alias("prompts"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog from ``part``; what the table lacks is made from the key."""
    words = F.split("p_name", " ")
    key = F.col("p_partkey")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (key % len(xs) + 1).cast("int"))
    noun, adjective = F.get(words, F.lit(1)), F.get(words, F.lit(0))
    return table(spark, sf_dir, "part").select(
        key.alias("id"),
        F.col("p_name").alias("productDisplayName"),
        F.col("p_name").alias("name"),
        pick("Men", "Women", "Unisex", "Boys", "Girls").alias("gender"),
        pick("Accessories", "Apparel", "").alias("masterCategory"),
        F.col("p_brand").alias("subCategory"),
        F.initcap(noun).alias("articleType"),
        F.when(adjective.isin("red", "blue"), F.initcap(adjective)).otherwise("").alias("baseColour"),
        pick("Summer", "Fall", "Winter", "Spring").alias("season"),
        (F.lit(2010) + key % 8).cast("string").alias("year"),
        pick("Casual", "Formal", "").alias("usage"),
        F.concat(F.col("p_name"), F.lit(" of type "), F.col("p_type"), F.lit(". It has size "), F.col("p_size").cast("string"), F.lit("!")).alias("description"),
    )


def lexicon_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(x,) for x in ("Jeans", "Sports Shoes", "Running Shoes", "steel bolt", "Dress", "Watches", "", "Denim", "Sweatshirts")], "category string")
    kinds = products(spark, sf_dir).select(F.col("articleType").alias("category")).distinct().unionByName(extra)
    return kinds.select("category", intent.lexicon_entry(F.col("category"))["name"].alias("entry"))


def ngram_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks.attribute_ngrams(products(spark, sf_dir))
    return rows.select("id", *[F.array_join(c, "|").alias(c) for c in ("unigrams", "bigrams", "trigrams")])


def product_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = chunks.chunk_points(chunks.with_chunks(products(spark, sf_dir)))
    return points.select("point_id", "product_id", F.col("chunk_id").cast("long").alias("chunk_id"), "chunk_type", "chunk_text")


def chunk_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_chunks(spark, sf_dir).groupBy("chunk_type").agg(F.count("*").alias("n"), F.avg(F.length("chunk_text")).cast("decimal(18,4)").cast("double").alias("length"))


def chunk_hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Image hits, and chunk hits of vectors that stand for products' chunks (four to a product)."""
    hits = search.top_hits(points_of(spark, sf_dir), query_vector(spark, sf_dir, 2), 120)
    images = hits.where(F.col("point_id") % 2 == 0).select(F.expr("point_id div 4").alias("product_id"), "score", "rank")
    parts = hits.where(F.col("point_id") % 2 == 1).select(F.expr("point_id div 4").alias("product_id"), "score", "rank", F.concat(F.lit("chunk "), F.col("point_id").cast("string")).alias("text"))
    return images, parts


def best_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.best_chunks(*chunk_hits(spark, sf_dir))
    return rows.select("product_id", F.round("image_score", 6).alias("image_score"), F.round("text_score", 6).alias("text_score"), "best_chunk")


# -- context ---------------------------------------------------------------------------------------------------------


def context_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog against all queries of the query table."""
    chunk = F.concat(F.lit("A photo of "), F.col("name"), F.lit("."))
    return context.context_of_catalog(products(spark, sf_dir).withColumn("best_chunk", chunk), intent.parse_intent(query_table(spark)))


def context_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_rows(spark, sf_dir).select(
        "query_id", "id", F.round("context.score", 6).alias("score"), "context.is_disqualified", "context.unigram_recall", "context.bigram_score", "context.trigram_score", "context.exact_match"
    )


def multipliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_rows(spark, sf_dir).select("query_id", "id", *[F.col(f"context.{c}") for c in ("gender_multiplier", "color_multiplier", "category_multiplier")])


def collections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Images and chunks from the vectors: of four in a row the first is the product's image, the others its chunks."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("vec_id div 4").alias("product_id"), F.col("embedding").alias("vector"))
    image = F.col("vec_id") % 4 == 0
    chunk = F.concat(F.lit("chunk "), F.col("vec_id").cast("string")).alias("chunk_text")
    return rows.where(image).drop("vec_id"), rows.where(~image).select(F.col("vec_id").alias("point_id"), "product_id", chunk, "vector")


def by_text(spark: SparkSession, sf_dir: str) -> contextual.Found:
    """Every query text with the vector of its number; one of them is flagged as out of the domain."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    asked = query_table(spark).join(vectors, "query_id").withColumn("is_out_of_domain", F.col("query_id") == 10)
    return contextual.search_contextual(asked, *collections(spark, sf_dir), products(spark, sf_dir), rule=ranking.Cliff(text_floor=0.05))


def by_image(spark: SparkSession, sf_dir: str) -> contextual.Found:
    """For each id divisible by 20, the vector two places on, which is a chunk, as an image."""
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 2").select((F.col("vec_id") - 2).alias("query_id"), F.lit(None).cast("string").alias("query"), F.col("embedding").alias("vector"))
    return contextual.search_contextual(asked, *collections(spark, sf_dir), products(spark, sf_dir), mode="image", rule=ranking.Cliff(image_floor=0.2))


def shown_results(found):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return found(spark, sf_dir).results.select("query_id", F.col("id").alias("product_id"), "name", "image_url", "image_score", "text_score", "best_matching_chunk", "score", F.col("rank").cast("long").alias("rank"))

    return run


def shown_gates(found):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return found(spark, sf_dir).report.drop("details")

    return run


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unified search for each id divisible by 20, with the products' fields."""
    rows = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = image_search.unified_payload(search.search_unified_batch(points_of(spark, sf_dir), rows), products(spark, sf_dir))
    return found.select("query_id", "product_id", F.col("rank").cast("long").alias("rank"), "name", "image_url", "gender", "articleType", "usage", "final_score", "image_score", "text_score")


#: What the detector of these tables can see, in the domain, off it, and in neither list.
CLASSES = (
    "handbag", "dog", "person", "Tie", "car", "clock", "sports ball", "umbrella", "dress", "shoe", "cat", "book", "suitcase", "truck", "shirt", "vase", "toilet", "scissors", "backpack",
)


def sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture for each vector: its sides, a rectangle on a plain ground, two colours, and the boxes that a detector saw, three at most."""
    k, label = F.col("k"), F.col("label")
    named = lambda i: F.element_at(F.array(*map(F.lit, CLASSES)), (i % len(CLASSES) + 1).cast("int"))
    box = lambda *sides: F.array(*[F.lit(x).cast("double") if isinstance(x, int) else x.cast("double") for x in sides])
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "label", (F.col("vec_id") * 37 % 1009).cast("int").alias("k"))
    rows = rows.select("*", (60 + k % 5 * 10).alias("width"), (50 + k % 3 * 10).alias("height"), (8 + k % 7).alias("x0"), (6 + k % 5).alias("y0"))
    rows = rows.withColumns({"x1": F.col("x0") + 24 + k % 20, "y1": F.col("y0") + 22 + k % 18})
    seen = F.array(
        F.struct(box(F.col("x0") - 1.5, F.col("y0") - 1.5, F.col("x1") + 1.5, F.col("y1") + 1.5).alias("box"), (0.5 + k % 50 / 100).alias("confidence"), named(label + k).alias("class_name")),
        F.struct(box(0, 0, F.col("width") - k % 6, F.col("height") - k % 4).alias("box"), (0.4 + k % 60 / 100).alias("confidence"), named(label * 3 + F.floor(k / 2)).alias("class_name")),
        F.struct(box(5, 5, 15 + k % 20, 12 + k % 25).alias("box"), F.lit(0.9).alias("confidence"), named(F.floor(k / 3)).alias("class_name")),
    )
    number = F.when(k % 4 == 3, 0).when(k % 3 != 0, 1).when(k % 2 != 0, 2).otherwise(3)
    return rows.withColumn("boxes", F.slice(seen, F.lit(1), number))


def colour(cell: Column) -> Column:
    """Six hexadecimal digits of a pixel in the middle of a cell of the colour cube."""
    return F.concat(*[F.lpad(F.lower(F.hex(32 + 64 * (F.floor(cell / n) % 4))), 2, "0") for n in (16, 4, 1)])


def drawn(rows: DataFrame) -> DataFrame:
    """(image_id, image, boxes, box_index) of sketches; every eleventh can't be decoded, and every fifth asks for its second box."""
    k = F.col("k")
    dark, light = F.lit(0), F.lit(0)
    for n in (16, 4, 1):
        dark, light = dark + n * (F.floor(k / n) % 2), light + n * (2 + F.floor(k / (2 * n)) % 2)
    ground, thing = (colour(F.when(k % 4 == 1, a).otherwise(b)) for a, b in ((light, dark), (dark, light)))
    plain = lambda n: F.repeat(ground, n.cast("int"))
    middle = F.concat(plain(F.col("x0")), F.repeat(thing, (F.col("x1") - F.col("x0")).cast("int")), plain(F.col("width") - F.col("x1")))
    lines = F.concat(plain(F.col("width") * F.col("y0")), F.repeat(middle, (F.col("y1") - F.col("y0")).cast("int")), plain(F.col("width") * (F.col("height") - F.col("y1"))))
    whole = k % 11 != 0
    image = F.struct(
        F.lit("").alias("origin"), F.when(whole, F.col("height")).otherwise(-1).cast("int").alias("height"), F.when(whole, F.col("width")).otherwise(-1).cast("int").alias("width"),
        F.lit(3).alias("nChannels"), F.lit(16).alias("mode"), F.when(whole, F.unhex(lines)).alias("data"),
    )
    return rows.select("image_id", image.alias("image"), "boxes", F.when(k % 5 == 4, 1).alias("box_index"))


def image_pipeline(spark: SparkSession, sf_dir: str) -> image_search.Found:
    """The pictures of the ids divisible by 20, searched with their detector's boxes."""
    rows = table(spark, sf_dir, "embeddings")
    name = F.element_at(F.array(*map(F.lit, LABELS)), F.col("vec_id").cast("int") + 1)
    labels = rows.where(F.col("vec_id") < len(LABELS)).select(name.alias("label"), F.col("embedding").alias("vector"))
    pictures = drawn(sketches(spark, sf_dir).where("image_id % 20 = 0"))
    return image_search.search_images(points_of(spark, sf_dir), pictures, labels, providers.ColourImage(), rule=PICTURE_RULE, keep_from=0.25, in_domain_from=0.3)


PICTURE_RULE = ranking.Cliff(gap=0.03, image_floor=0.05)


def image_pipeline_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image_pipeline(spark, sf_dir).results.select("image_id", "source", "product_id", F.col("rank").cast("long").alias("rank"), "final_score", "image_score", "title_score")


def image_pipeline_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = image_pipeline(spark, sf_dir).report
    shown = F.array_join(F.transform("detected_boxes", lambda b: F.concat_ws(":", b["class_name"], b["is_selected"].cast("string"))), "|")
    return report.withColumns({"detected_boxes": shown, "crop_box": F.array_join("crop_box", ",")}).drop("width", "height")


# -- index -----------------------------------------------------------------------------------------------------------


def exploded_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.unified_points(products(spark, sf_dir)).select("point_id", "product_id", "name", "embedding_type")


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events up to the middle of all ids are the old table, later ones the new rows, keyed by user."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    middle = rows.agg(((F.min("event_id") + F.max("event_id")) / 2).alias("middle"))
    rows = rows.crossJoin(F.broadcast(middle))
    before, after = (rows.where(c).drop("middle") for c in ("event_id <= middle", "event_id > middle"))
    return index.upsert(index.latest(before, "user_id", "event_id"), after, "user_id", "event_id")


def collection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = points_of(spark, sf_dir)
    return index.stats(unified=points, image=points.where(~F.col("is_title")), chunks=product_chunks(spark, sf_dir))


def looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "part").select((F.col("p_partkey") * 7).alias("point_id"))
    folder = scratch(spark)
    index.write_points(points_of(spark, sf_dir), folder)
    return index.lookup(spark, folder, ids).select("point_id", "product_id", "is_title")


def valid_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "embeddings").select((F.col("vec_id") * 2).alias("id"))
    return catalog.with_readable_images(products(spark, sf_dir), files).select("id", "name")


def rejected_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "embeddings").select((F.col("vec_id") * 2).alias("id"))
    return products(spark, sf_dir).join(files, "id", "left_anti").select("id", "name")


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog, of which the products with chunks about a style for a usage count as indexed."""
    return index.ingest_summary(products(spark, sf_dir), product_chunks(spark, sf_dir).where(F.col("chunk_text").contains("designed for")))


def pictures(rows: DataFrame, key: str) -> DataFrame:
    """(id, image): a small picture made from the key; every seventh can't be decoded."""
    data = F.when(F.col(key) % 7 != 0, F.unhex(F.repeat(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 6), 64)))
    size = F.when(F.col(key) % 7 != 0, 8).otherwise(-1)
    image = F.struct(F.lit("").alias("origin"), size.alias("height"), size.alias("width"), F.lit(3).alias("nChannels"), F.lit(16).alias("mode"), data.alias("data"))
    return rows.select(F.col(key).alias("id"), image.alias("image"))


def index_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build the index of all products that have a picture, in two parts, then those of some sizes again; a summary of each run."""
    folder = scratch(spark)
    files = pictures(table(spark, sf_dir, "part").where("p_size % 5 <> 0"), "p_partkey")
    ready = products(spark, sf_dir).drop("description")
    ready = plan.prepare_products(ready.withColumn("id", F.col("id").cast("string")), files)
    again = ready.join(table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("id")), "id", "left_semi")
    runs = [plan.build_index(rows, folder, providers.HashedText(), providers.ColourImage(), parts=2).withColumn("run", F.lit(i).cast("long")) for i, rows in enumerate((ready, again))]
    return runs[0].unionByName(runs[1]).select("run", "success", "indexed_count", "total_products", *[F.col(f"stats.{c}").alias(c) for c in ("unified", "image", "chunks")])


def hashed_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each product with the length of its title's vector, to four digits, and whether the components are those of the title before its
    first blank and after it, put together again."""
    rows = products(spark, sf_dir).select("id", "name", F.concat_ws(" ", F.element_at(F.split("name", " "), 1), F.regexp_extract("name", "^\\S+ (.*)$", 1)).alias("again"))
    encoder = providers.HashedText()
    both = providers.with_vectors(providers.with_vectors(rows, encoder, "name", "v"), encoder, "again", "w")
    return both.select("id", "name", F.round(vector.norm(F.col("v")), 4).alias("norm"), F.size("v").cast("long").alias("components"), (F.col("v") == F.col("w")).alias("same"))


def ensembles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different vectors the phrasings of all names give, and their lengths."""
    rows = providers.with_ensemble(products(spark, sf_dir).select("id", F.col("name").alias("query")), providers.HashedText())
    return rows.groupBy("query").agg(F.count("*").alias("products"), F.count_distinct("vector").alias("vectors"), F.max(F.round(vector.norm(F.col("vector")), 4)).alias("norm"))


def popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products by how much of them was sold: the facet that a ranking can be weighed with."""
    sold = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("quantity"), F.count_distinct("l_orderkey").alias("orders"))
    return products(spark, sf_dir).join(sold, F.col("id") == F.col("l_partkey"), "left").groupBy("articleType").agg(
        F.count("*").alias("products"), F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("quantity"), F.coalesce(F.max("orders"), F.lit(0)).alias("most_orders")
    )


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An incremental build over the events, then the number of users by the type of their latest event."""
    folder = scratch(spark)
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    build.stream_versions(stream, "user_id", "event_id", f"{folder}/table", f"{folder}/state").awaitTermination()
    rows = build.current(spark.read.parquet(f"{folder}/table"), "user_id", "event_id")
    return rows.groupBy("event_type").agg(F.count("*").alias("users"))


# -- boxes -----------------------------------------------------------------------------------------------------------


def box_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, width, height, box_index, box, confidence, class_name) of all pictures' boxes."""
    return sketches(spark, sf_dir).select("image_id", "width", "height", F.posexplode("boxes").alias("box_index", "b")).select("image_id", "width", "height", "box_index", "b.*")


def box_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.choose_box(box_table(spark, sf_dir)).select("image_id", F.col("box_index").cast("long").alias("box_index"), "class_name")


def box_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = box_table(spark, sf_dir).select("image_id", F.col("box_index").cast("long").alias("box_index"), boxes.crop(F.col("box"), F.col("width"), F.col("height")).alias("crop"))
    return rows.select("image_id", "box_index", F.array_join("crop", ",").alias("crop"))


def box_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.detector_domain(box_table(spark, sf_dir))


def salient_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands out in each picture that can be decoded."""
    rows = drawn(sketches(spark, sf_dir)).select("image_id", F.get(providers.SalientBox().boxes(F.col("image")), F.lit(0))["box"].alias("box"))
    return rows.select("image_id", F.array_join(F.transform("box", lambda x: x.cast("int")), ",").alias("box"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unified("image", "weighted_sum")(spark, sf_dir)


QUERIES = {
    "unified_image_weighted": unified("image", "weighted_sum", top_k=None),
    "unified_text_weighted": unified("text", "weighted_sum", top_k=None),
    "unified_score_fusion": unified("image", "score_fusion", top_k=None),
    "unified_rrf": unified("image", "rrf", top_k=None),
    "unified_custom_weights": unified("text", "weighted_sum", top_k=20, weights=(0.5, 0.5)),
    "dot_topk": dot_topk,
    "l2_norm_check": norms,
    "batch_query_topk": batch_topk,
    "grid_query_topk": grid_topk,
    "group_modality_scores": grouped_hits,
    "counterpart_fill": counterparts,
    "near_identical_rule": near_identical,
    "calibrate_scores": calibrated,
    "blend_scores": blended,
    "cliff_cutoff": cliff_cut,
    "cliff_metadata": cliff_facts,
    "cliff_whole_list": whole_list,
    "image_floor_gate": floor_gate,
    "ensemble_mean_vector": ensemble,
    "zero_shot_softmax": zero_shot,
    "crop_arbitration": arbitration,
    "clean_text_documents": clean_documents,
    "strip_html_pages": clean_pages,
    "tokens": words_of(lambda w: w),
    "stems": words_of(lambda w: F.transform(w, text.stem)),
    "token_stem_union": words_of(text.stemmed_set),
    "bigrams": words_of(lambda w: text.ngrams(w, 2)),
    "trigrams": words_of(lambda w: text.ngrams(w, 3)),
    "standardize_titles": titles,
    "json_extract": json_values,
    "json_descriptions": json_descriptions,
    "request_parse": requests,
    "query_intent": intents,
    "prompt_templates": prompt_lists,
    "lexicon_lookup": lexicon_lookup,
    "attribute_ngrams": ngram_lists,
    "product_chunks": product_chunks,
    "chunk_type_counts": chunk_kinds,
    "best_chunk_per_product": best_chunk,
    "context_multipliers": multipliers,
    "ngram_context_score": context_scores,
    "contextual_search": shown_results(by_text),
    "contextual_gates": shown_gates(by_text),
    "contextual_search_image": shown_results(by_image),
    "contextual_gates_image": shown_gates(by_image),
    "unified_payload": payloads,
    "image_pipeline": image_pipeline_results,
    "image_pipeline_report": image_pipeline_report,
    "explode_points": exploded_points,
    "upsert_latest": upserted,
    "index_stats": collection_counts,
    "point_lookup": looked_up,
    "semi_valid_products": valid_images,
    "anti_rejected_products": rejected_images,
    "ingest_summary": summary,
    "index_build": index_built,
    "title_vectors": hashed_titles,
    "prompt_vectors": ensembles,
    "catalog_popularity": popularity,
    "stream_index_counts": streamed,
    "box_selection": box_choice,
    "crop_geometry": box_crops,
    "detector_domain_rule": box_domain,
    "salient_box": salient_boxes,
}
