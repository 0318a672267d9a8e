"""Search by image: detector, box, crop, encoder, search, arbitration, domain gate and cut, for a batch of images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.functions import boxes
from tessel.functions.images import cut
from tessel.operators.contextual import Found, with_payload
from tessel.operators.domain import INSIDE, arbitrate, choose_box, detector_domain, label_probabilities, zero_shot_domain
from tessel.operators.ranking import Cliff, cliff_report, cut_at_cliff
from tessel.operators.search import search_unified_batch
from tessel.providers import BOXES, Detector, ImageEncoder, SalientBox, can_be_read
from tessel.session import written


def unified_payload(rows: DataFrame, products: DataFrame) -> DataFrame:
    """Results of a unified search with the product's fields: (ids, rank, scores, breakdown, payload)."""
    keys = [c for c in ("query_id", "image_id") if c in rows.columns]
    full = with_payload(rows, products)
    name = F.coalesce(F.nullif("name", F.lit("")), F.nullif("display_name", F.lit("")), F.concat(F.lit("Product #"), F.col("product_id").cast("string")))
    return full.select(
        *keys, "product_id", F.col("product_id").alias("id"), name.alias("name"), name.alias("display_name"), "image_url", "final_score", F.col("final_score").alias("score"),
        F.struct("image_score", "title_score").alias("breakdown"), "image_score", F.col("title_score").alias("text_score"),
        "gender", "masterCategory", "subCategory", "articleType", "baseColour", "season", "usage", "rank",
    )


def detected(images: DataFrame, encoder: ImageEncoder, detector: Detector | None, focus: Detector | None) -> DataFrame:
    """(image_id, box_index, width, height, readable, boxes, focus, vector) of images, without their pixels; see ``search_images``."""
    image, given = F.col("image"), "boxes" in images.columns
    found = (F.col("boxes") if given else detector.boxes(image)) if given or detector else F.array()
    index = F.col("box_index").cast("int") if "box_index" in images.columns else F.lit(None).cast("int")
    rows = images.select("image_id", "image", index.alias("wanted"), F.coalesce(found.cast(BOXES), F.array().cast(BOXES)).alias("boxes"))
    rows = rows.withColumn("boxes", F.transform("boxes", lambda b: F.struct(F.transform(b["box"], lambda x: F.round(x, 1)).alias("box"), F.round(b["confidence"], 3).alias("confidence"), b["class_name"].alias("class_name"))))
    needs = ~F.exists("boxes", lambda b: F.lower(b["class_name"]).isin(*INSIDE))
    extra = focus.boxes(F.when(needs, image)) if focus else F.array().cast(BOXES)
    return rows.select(
        "image_id", "wanted", image["width"].alias("width"), image["height"].alias("height"), can_be_read(image).alias("readable"), "boxes",
        F.when(needs, extra).otherwise(F.array().cast(BOXES)).alias("focus"), encoder.encode(image).alias("vector"),
    )


def focus_crops(seen: DataFrame, label_ood: DataFrame) -> DataFrame:
    """Per image of ``detected`` the domain's rule and the chosen box: (image_id, off, detected_entity, detected_boxes, box_index, crop).

    ``crop`` is null where cropping isn't worth it (see ``boxes.crop``) and for images out of the domain.  What stands out is a box too where
    the detector saw nothing of the domain.
    """
    of_boxes = lambda c: seen.select("image_id", F.posexplode(c).alias("box_index", "b")).select("image_id", "box_index", "b.*")
    rule = seen.join(detector_domain(of_boxes("boxes")), "image_id", "left").join(label_ood, "image_id", "left")
    by_label = F.coalesce("needs_label", F.lit(True)) & F.coalesce("label_ood", F.lit(False))
    rule = rule.withColumn("off", F.coalesce("detector_ood", F.lit(False)) | by_label)
    entity = F.coalesce("entity", F.when(by_label, F.regexp_replace("top_label", "_", " ")))
    every = F.when(F.col("off"), F.col("boxes")).otherwise(F.concat("boxes", "focus"))
    rule = rule.select("image_id", "wanted", "width", "height", "off", entity.alias("detected_entity"), every.alias("boxes"))
    rows = rule.select("image_id", "wanted", "off", F.posexplode("boxes").alias("box_index", "b")).select("image_id", "wanted", "off", "box_index", "b.*")
    chosen = choose_box(rows, explicit=F.col("wanted"), outside=F.col("off")).select("image_id", "box_index", F.col("box"))
    marked = F.transform("boxes", lambda b, i: F.struct(b["box"].alias("box"), b["confidence"].alias("confidence"), b["class_name"].alias("class_name"), F.coalesce(i == F.col("box_index"), F.lit(False)).alias("is_selected")))
    crop = F.when(~F.col("off"), boxes.crop(F.col("box"), F.col("width"), F.col("height")))
    return rule.join(chosen, "image_id", "left").select("image_id", "off", "detected_entity", marked.alias("detected_boxes"), "box_index", crop.alias("crop"))


def search_images(
    points: DataFrame,
    images: DataFrame,
    labels: DataFrame,
    encoder: ImageEncoder,
    detector: Detector | None = None,
    focus: Detector | None = SalientBox(),
    rule: Cliff = Cliff(),
    use_crop: bool = True,
    eliminate_noise: bool = True,
    keep_from: float = 0.65,
    in_domain_from: float = 0.80,
) -> Found:
    """Results and a report for each of ``images`` (image_id, image; boxes and box_index if given).

    A detector's boxes come with the images or from ``detector``; where it sees nothing of the domain, ``focus`` may add one.  The box with
    the index ``box_index``, or the best one, is cut out of the image, and both image and crop are encoded and searched over ``points``
    (see ``split_points``; ``use_crop`` False: the image alone).  The original's results stay unless the crop's first image score beats
    a low one.  A first score of ``in_domain_from`` shows that the image is in the domain; otherwise the detector's rule and then the
    domain labels (label, vector) decide.  Results are cut at the first cliff and ranked anew.

    The report has the boxes, the crop and the reason where nothing is shown: ``invalid_image`` for one that can't be read,
    ``out_of_domain``, ``no_matches``, or that of the cliff.  Pixels are read twice, for images and for crops, and never shuffled with
    the results.  Images of one id count as one.
    """
    pool = max(100, 8 * rule.most)

    def found(asked: DataFrame) -> DataFrame:
        return search_unified_batch(points, asked.select(F.col("image_id").alias("query_id"), F.col("vector").alias("query")), "image", rule.most, pool).withColumnRenamed("query_id", "image_id")

    images = images.dropDuplicates(["image_id"])
    seen = written(detected(images, encoder, detector, focus))
    valid = seen.where("readable")
    by_label = zero_shot_domain(label_probabilities(valid, labels)).select("image_id", F.col("is_ood").alias("label_ood"), "top_label")
    facts = written(focus_crops(valid, by_label).join(by_label.drop("top_label"), "image_id", "left"))
    wanted = images.select("image_id", "image").join(facts.where(F.col("crop").isNotNull()).select("image_id", "crop"), "image_id")
    crops = wanted.select("image_id", cut(F.col("image"), F.col("crop")).alias("image")).select("image_id", encoder.encode(F.col("image")).alias("vector"))
    own = written(found(valid))  # a few rows for each image; unwritten, one task would hold the sorters of all that follows
    cropped = written(found(written(crops))) if use_crop else own.where(F.lit(False))
    shown = written(arbitrate(own, cropped, keep_from, in_domain_from))
    by_match = shown.groupBy("image_id").agg(F.first("source").alias("source"), F.max("in_domain_by_match").alias("in_domain_by_match"))
    out = ~F.coalesce("in_domain_by_match", F.lit(False)) & (F.col("off") | F.coalesce("label_ood", F.lit(False)))
    known = seen.select("image_id", "readable", "width", "height").join(facts, "image_id", "left").join(by_match, "image_id", "left")
    facts = known.withColumn("is_out_of_domain", F.coalesce(out, F.lit(False)))
    rows = shown.join(facts.where(~F.col("is_out_of_domain")).select("image_id"), "image_id").drop("in_domain_by_match")
    keys, ties = ("image_id",), ("rank", "product_id")
    cut_rule = Cliff(rule.gap, 0.5, rule.most, rule.image_floor, rule.text_floor) if eliminate_noise else Cliff(float("inf"), 0.0, rule.most, float("-inf"), float("-inf"))
    results = cut_at_cliff(rows.withColumnRenamed("rank", "before"), "final_score", "image", cut_rule, keys, ("before", "product_id")).drop("before")
    counts = cliff_report(rows, "final_score", "image", cut_rule, keys, ties).withColumnRenamed("reason", "cut_reason")
    both = facts.join(counts, "image_id", "left")
    reason = F.when(~F.col("readable"), "invalid_image").when(F.col("is_out_of_domain"), "out_of_domain").when(F.col("total_candidates").isNull(), "no_matches").otherwise(F.col("cut_reason"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    whole = F.array(F.lit(0), F.lit(0), F.col("width"), F.col("height"))
    report = both.select(
        "image_id", "source", "is_out_of_domain", "detected_entity", "detected_boxes", "box_index", F.col("crop").isNotNull().alias("crop_applied"),
        F.when(F.col("readable"), F.coalesce("crop", whole)).alias("crop_box"), "width", "height", zero("total_candidates"), zero("kept_count"), zero("eliminated_count"),
        F.coalesce("gap_detected", F.lit(False)).alias("gap_detected"), "gap_rank", reason.alias("reason"),
    )
    return Found(results, report)
