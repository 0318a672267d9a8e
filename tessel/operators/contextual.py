"""Contextual search for a batch of queries: gates, two collections, merge, context score, blend and cut."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions import scores
from tessel.operators.context import with_context_score
from tessel.operators.intent import parse_intent
from tessel.operators.ranking import Cliff, cliff_report, cut_at_cliff
from tessel.operators.search import batch_top_hits, best_chunks
from tessel.plans.lexicon import DEFAULT, Lexicon

#: What a result says of its product; all are strings.
PAYLOAD = ("name", "display_name", "gender", "masterCategory", "subCategory", "articleType", "baseColour", "season", "usage", "description", "image_filename", "image_url")


class Found(NamedTuple):
    """Ranked results of each query, and one row of facts for each query."""

    results: DataFrame
    report: DataFrame


def with_payload(rows: DataFrame, products: DataFrame) -> DataFrame:
    """All columns and the ``PAYLOAD`` of each row's ``product_id``, with defaults where the product or a field is missing.

    The name falls back to "Product #id" and the display name to the product's own name, then to the empty text; file and address
    follow from the id; all else is empty.
    """
    known = {c.lower(): c for c in products.columns}
    field = lambda c: products[f"`{known[c.lower()]}`"].cast("string") if c.lower() in known else F.lit(None).cast("string")
    filled = lambda c, *more: F.coalesce(field(c), *more)
    own = products.select(
        products["id"].cast("long").alias("_pid"),
        field("name").alias("_name"),
        filled("productDisplayName", field("name")).alias("_display"),
        *[field(c).alias(f"_{c}") for c in PAYLOAD[2:]],
    )
    number = F.col("product_id").cast("string")
    defaults = {"image_filename": F.concat(number, F.lit(".jpg")), "image_url": F.concat(F.lit("/media/images/"), number, F.lit(".jpg"))}
    out = {"name": F.coalesce("_name", F.concat(F.lit("Product #"), number)), "display_name": F.coalesce("_display", F.lit(""))}
    out |= {c: F.coalesce(f"_{c}", defaults.get(c, F.lit(""))) for c in PAYLOAD[2:]}
    joined = rows.join(own, F.col("product_id") == F.col("_pid"), "left")
    return joined.withColumns(out).drop("_pid", "_name", "_display", *[f"_{c}" for c in PAYLOAD[2:]])


def gate(mode: str) -> Column:
    """Why a query is turned away before anything is searched; null lets it through."""
    out = F.when(F.col("is_out_of_domain"), "out_of_domain")
    if mode == "text":
        out = out.when(F.col("query").isNotNull() & (F.trim(F.col("query")) == ""), "empty_query").when(F.col("intent.is_non_fashion_query"), "non_fashion_query")
    return out


def explained() -> Column:
    """A sentence for the reader about a query that has no results."""
    term = F.col("intent.non_fashion_term")
    return (
        F.when(F.col("reason") == "out_of_domain", F.coalesce("domain_reason", F.lit("The subject is not of this catalog's domain.")))
        .when(F.col("reason") == "non_fashion_query", F.concat(F.lit("The query asks for '"), term, F.lit("', which this catalog does not have.")))
        .when(F.col("reason") == "empty_query", F.lit("The query is empty."))
        .when(F.col("reason") == "low_similarity_floor", F.concat(F.lit("The best image similarity, "), F.format_string("%.2f", "best_image"), F.lit(", is too low.")))
    )


def candidates(queries: DataFrame, images: DataFrame, chunks: DataFrame, n_images: int, n_chunks: int) -> DataFrame:
    """The merged candidates of each query (query_id, vector): see ``best_chunks``."""
    asked = queries.select("query_id", F.col("vector").alias("query"))
    image_hits = batch_top_hits(images, asked, n_images, id_col="product_id").withColumnRenamed("point_id", "product_id")
    chunk_hits = batch_top_hits(chunks, asked, n_chunks).join(chunks.select("point_id", "product_id", F.col("chunk_text").alias("text")), "point_id")
    return best_chunks(image_hits, chunk_hits, ("query_id",))


def search_contextual(
    queries: DataFrame,
    images: DataFrame,
    chunks: DataFrame,
    products: DataFrame,
    mode: str = "text",
    top_candidates: int = 50,
    rule: Cliff = Cliff(),
    eliminate_noise: bool = True,
    weights: tuple[float, float] = (0.75, 0.25),
    ngram_weight: float = 0.30,
    lexicon: Lexicon = DEFAULT,
) -> Found:
    """Results and a report for each of ``queries`` (query_id, query, vector; is_out_of_domain and domain_reason if known).

    ``images`` (product_id, vector) and ``chunks`` (point_id, product_id, chunk_text, vector) are searched exactly, with at
    least 120 images and twice as many chunks in text mode.  Turned away are queries flagged as out of the domain, blank
    ones, those for things off the domain (both in text mode), and in image mode those whose best image is below the
    image floor; the report says why.  A null query text is scored without context.  Scores are rounded to four digits
    before they are ordered; without ``eliminate_noise`` the best ``rule.most`` above 0 stay.
    """
    given = {"is_out_of_domain": F.lit(False), "domain_reason": F.lit(None).cast("string")}
    queries = queries.withColumns({c: F.coalesce(F.col(c), v) if c in queries.columns else v for c, v in given.items()})
    asked = parse_intent(queries, lexicon=lexicon).withColumn("reason", gate(mode))
    limit = max(top_candidates, 120) if mode == "text" else top_candidates
    merged = candidates(asked.where(F.col("reason").isNull()), images, chunks, limit, 2 * limit)
    merged = merged.withColumn("best_image", F.max("image_score").over(Window.partitionBy("query_id")))
    rows = with_payload(merged, products).join(asked.select("query_id", "query", "intent"), "query_id")
    text = F.col("query").isNotNull()
    if mode == "text":
        rows = with_context_score(rows, lexicon)
        blended = F.when(text, scores.blend_text(F.col("image_score"), F.col("text_score"), F.col("context.score"), F.col("context.is_disqualified"), *weights, ngram_weight))
        blended = blended.otherwise(scores.blend_text(F.col("image_score"), F.col("text_score"), primary=weights[0], secondary=weights[1]))
    else:
        blended = scores.blend_image(F.col("image_score"), F.col("text_score"), *weights)
    rows = rows.withColumn("score", F.round(blended, 4))
    passed = rows if mode == "text" else rows.where(F.col("best_image") >= rule.image_floor)
    keys, ties = ("query_id",), ("seq", "product_id")
    cut = Cliff(rule.gap, rule.least_ratio, rule.most, rule.image_floor, rule.text_floor) if eliminate_noise else Cliff(float("inf"), 0.0, rule.most, 0.0, 0.0)
    results = cut_at_cliff(passed, "score", mode, cut, keys, ties)
    context = [F.when(text, F.round("context.score", 4)).alias("ngram_score"), F.when(text, F.col("context")).alias("ngram_meta")] if mode == "text" else []
    results = results.select(
        "query_id", "rank", F.col("product_id").alias("id"), *PAYLOAD, F.round("image_score", 4).alias("image_score"), F.round("text_score", 4).alias("text_score"),
        F.col("best_chunk").alias("best_matching_chunk"), "score", *context, F.lit(weights[0]).alias("primary_weight"), F.lit(weights[1]).alias("secondary_weight"), F.lit(mode).alias("search_mode"),
    )
    return Found(results, _report(asked, rows.select("query_id", "score", "best_image", *ties), mode, cut, eliminate_noise, rule.image_floor))


def _report(asked: DataFrame, rows: DataFrame, mode: str, rule: Cliff, eliminate_noise: bool, floor: float) -> DataFrame:
    facts = cliff_report(rows, "score", mode, rule, ("query_id",), ("seq", "product_id"))
    facts = facts.join(rows.groupBy("query_id").agg(F.max("best_image").alias("best_image")), "query_id").withColumnRenamed("reason", "cut_reason")
    both = asked.join(facts, "query_id", "left")
    low = F.col("best_image") < floor if mode != "text" else F.lit(False)
    reason = F.when(F.col("reason").isNotNull(), F.col("reason")).when(low, "low_similarity_floor")
    both = both.withColumn("reason", F.coalesce(reason, F.col("cut_reason")) if eliminate_noise else reason)
    turned_away = F.col("reason").isin("out_of_domain", "empty_query", "non_fashion_query", "low_similarity_floor")
    total = F.coalesce("total_candidates", F.lit(0))
    kept = F.when(turned_away, 0).otherwise(F.coalesce("kept_count", F.lit(0))).cast("long")
    open_ = ~F.coalesce(turned_away, F.lit(False))
    return both.select(
        "query_id",
        total.alias("total_candidates"),
        kept.alias("kept_count"),
        (total - kept).alias("eliminated_count"),
        (open_ & F.coalesce("gap_detected", F.lit(False))).alias("gap_detected"),
        F.when(open_, F.col("gap_rank")).alias("gap_rank"),
        "reason",
        explained().alias("details"),
        (~open_ & (F.col("reason") != "empty_query")).alias("is_out_of_domain"),
        kept.alias("total_found"),
    )
