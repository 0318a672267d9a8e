"""Whether an image shows something of the catalog's domain, and which box of it to search with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions import boxes
from tessel.functions.vector import dot

# Labels that an image can't have to be in the domain.
OUTSIDE = ("sports_ball", "animal", "vehicle", "food")
# Detector classes that belong to the domain, those that certainly don't, and those that a search prefers.
INSIDE = ("backpack", "umbrella", "handbag", "tie", "suitcase")
OUTSIDE_CLASSES = (
    "dog", "cat", "bird", "horse", "sheep", "cow", "elephant", "bear", "zebra", "giraffe",
    "car", "motorcycle", "airplane", "bus", "train", "truck", "boat",
    "traffic light", "fire hydrant", "stop sign", "parking meter", "toilet",
)
PREFERRED = ("handbag", "backpack", "tie", "suitcase", "shoe", "dress", "shirt", "focused_product")
#: So many labels are met with every image at most; their table is broadcast.
MOST_LABELS = 10_000


def label_probabilities(images: DataFrame, labels: DataFrame, temperature: float = 0.05) -> DataFrame:
    """(image_id, label, p): softmax over the similarities to the few label vectors, which are counted and broadcast."""
    if labels.count() > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    met = images.crossJoin(F.broadcast(labels.select("label", F.col("vector").alias("label_vector"))))
    rows = met.select("image_id", "label", dot(F.col("vector"), F.col("label_vector")).alias("s"))
    own = Window.partitionBy("image_id")
    e = F.exp((F.col("s") - F.max("s").over(own)) / temperature)
    return rows.withColumn("e", e).withColumn("p", F.col("e") / F.sum("e").over(own)).select("image_id", "label", "p")


def zero_shot_domain(probabilities: DataFrame, home: str = "fashion", outside: tuple[str, ...] = OUTSIDE) -> DataFrame:
    """(image_id, top_label, top_p, is_ood): out of the domain if a label outside has at least .5 and home below .25."""
    rows = probabilities.groupBy("image_id").agg(
        F.max_by("label", F.struct("p", "label")).alias("top_label"), F.max("p").alias("top_p"), F.coalesce(F.max(F.when(F.col("label") == home, F.col("p"))), F.lit(0.0)).alias("home_p")
    )
    ood = F.col("top_label").isin(*outside) & (F.col("top_p") >= 0.5) & (F.col("home_p") < 0.25)
    return rows.select("image_id", "top_label", "top_p", ood.alias("is_ood"))


def detector_domain(detections: DataFrame, inside: tuple[str, ...] = INSIDE, outside: tuple[str, ...] = OUTSIDE_CLASSES, least: float = 0.65) -> DataFrame:
    """(image_id, detector_ood, needs_label, entity, has_inside): rows are (image_id, box_index, confidence, class_name).

    An image is out of the domain if a class of ``outside`` has the confidence ``least`` and neither a class of ``inside`` nor a person is
    there; ``entity`` is the surest such class, the first on ties.  Classes that are in no list decide nothing.  Without a class of
    the domain or a person the labels are asked as well (``needs_label``).  Names count in lower case.
    """
    name = F.lower("class_name")
    home, person = name.isin(*inside), name == "person"
    off = name.isin(*outside) & (F.col("confidence") >= least)
    rows = detections.groupBy("image_id").agg(
        F.coalesce(F.max(home | person), F.lit(False)).alias("seen"), F.coalesce(F.max(home), F.lit(False)).alias("has_inside"),
        F.max_by(name, F.when(off, F.struct("confidence", -F.col("box_index")))).alias("entity"), F.coalesce(F.max(off), F.lit(False)).alias("off"),
    )
    ood = ~F.col("seen") & F.col("off")
    return rows.select("image_id", ood.alias("detector_ood"), (~F.col("seen") & ~F.col("off")).alias("needs_label"), F.when(ood, F.col("entity")).alias("entity"), "has_inside")


def choose_box(detections: DataFrame, preferred: tuple[str, ...] = PREFERRED, explicit: Column | None = None, outside: Column | None = None) -> DataFrame:
    """(image_id, box_index, box, class_name): the wanted index if there is such a box, or the largest area x confidence x bonus, first on ties.

    Bonus: 2 for preferred classes, 1.2 for a person, .5 for the rest; names count in lower case.  Of images that are ``outside`` the
    domain only a wanted box is chosen.
    """
    name = F.lower("class_name")
    bonus = F.when(name.isin(*preferred), 2.0).when(name == "person", 1.2).otherwise(0.5)
    wanted = F.coalesce(F.col("box_index") == explicit, F.lit(False)) if explicit is not None else F.lit(False)
    open_ = detections.where(~F.coalesce(outside, F.lit(False)) | wanted) if outside is not None else detections
    rows = open_.withColumn("weight", F.when(wanted, F.lit(float("inf"))).otherwise(boxes.area(F.col("box")) * bonus * F.col("confidence")))
    best = Window.partitionBy("image_id").orderBy(F.desc("weight"), "box_index")
    return rows.withColumn("nth", F.row_number().over(best)).where("nth = 1").select("image_id", "box_index", "box", "class_name")


def arbitrate(original: DataFrame, cropped: DataFrame, keep_from: float = 0.65, in_domain_from: float = 0.80) -> DataFrame:
    """Per image the results (image_id, rank, product_id, image_score, final_score) to show, and ``in_domain_by_match``.

    The original's stay if there are none of the crop, or their first image score is high or not below the crop's.
    """
    first = lambda rows, name: rows.where("rank = 1").select("image_id", F.col("image_score").alias(name))
    tops = first(original, "o").join(first(cropped, "c"), "image_id", "full_outer")
    stays = F.col("c").isNull() | (F.coalesce("o", F.lit(-1.0)) >= keep_from) | (F.coalesce("o", F.lit(-1.0)) >= F.col("c"))
    picks = tops.select("image_id", F.when(stays, "original").otherwise("crop").alias("source"), F.coalesce(F.when(stays, F.col("o")).otherwise(F.col("c")), F.lit(0.0)).alias("top"))
    both = original.withColumn("source", F.lit("original")).unionByName(cropped.withColumn("source", F.lit("crop")))
    return both.join(picks, ["image_id", "source"]).withColumn("in_domain_by_match", F.col("top") >= in_domain_from).drop("top")
