import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel import providers
from tessel.functions import images
from tessel.operators import domain, image_search
from tessel.operators.ranking import Cliff

IMAGE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def picture(pixels):
    h, w, c = pixels.shape
    return ("", h, w, c, 16 if c == 3 else 0, bytearray(pixels.tobytes()))


def drawn(height, width, box, ground=20, thing=220, channels=3):
    out = np.full((height, width, channels), ground, "u1")
    a, b, c, d = box
    out[b:d, a:c] = thing
    return out


# -- pixels ----------------------------------------------------------------------------------------------------------


def plain_threshold(grey):
    best, at = -1.0, 0
    for t in range(255):
        low, high = [x for x in grey.ravel().tolist() if x <= t], [x for x in grey.ravel().tolist() if x > t]
        if low and high:
            spread = len(low) * len(high) * (sum(low) / len(low) - sum(high) / len(high)) ** 2
            if spread > best * (1 + 1e-12):
                best, at = spread, t
    return at


def flood(mask, y, x, steps):
    seen, todo = {(y, x)}, [(y, x)]
    while todo:
        y, x = todo.pop()
        for dy, dx in steps:
            p = (y + dy, x + dx)
            if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and p not in seen:
                seen.add(p)
                todo.append(p)
    return seen


CROSS = [(0, 1), (1, 0), (0, -1), (-1, 0)]
AROUND = [*CROSS, (1, 1), (1, -1), (-1, 1), (-1, -1)]


def plain_regions(mask, steps):
    out, done = [], set()
    for y, x in zip(*np.nonzero(mask), strict=True):
        if (y, x) not in done:
            own = flood(mask, int(y), int(x), steps)
            done |= own
            out.append(own)
    return out


def plain_closed(mask, side):
    h, w = mask.shape
    around = lambda m, y, x: m[max(0, y - side // 2) : y + side // 2 + 1, max(0, x - side // 2) : x + side // 2 + 1]
    grown = np.array([[around(mask, y, x).any() for x in range(w)] for y in range(h)])
    return np.array([[around(grown, y, x).all() for x in range(w)] for y in range(h)])


def plain_salient(image):
    """The rule pixel by pixel."""
    grey = images.grey_levels(image).astype(float)
    for axis in (0, 1):
        n, rows = grey.shape[axis], []
        for i in range(n):
            mirrored = [min(abs(j), 2 * (n - 1) - abs(j)) for j in range(i - 2, i + 3)]
            rows.append(sum(w * grey.take(j, axis) for w, j in zip((1, 4, 6, 4, 1), mirrored, strict=True)) / 16)
        grey = np.stack(rows, axis)
    grey = np.rint(grey).astype("u1")
    dark = grey <= plain_threshold(grey)
    edge = [*dark[0], *dark[-1], *dark[:, 0], *dark[:, -1]]
    best, most = None, 0
    for own in plain_regions(plain_closed(dark if sum(edge) / len(edge) < 0.5 else ~dark, images.CLOSING), AROUND):
        ys, xs = [y for y, _ in own], [x for _, x in own]
        mask = np.ones((max(ys) - min(ys) + 3, max(xs) - min(xs) + 3), bool)
        for y, x in own:
            mask[y - min(ys) + 1, x - min(xs) + 1] = False
        area = mask.size - len(flood(mask, 0, 0, CROSS))
        w, h = max(xs) - min(xs) + 1, max(ys) - min(ys) + 1
        if w > 20 and h > 20 and w * h > most and 0.04 * dark.size < area < 0.95 * dark.size:
            best, most = [float(min(xs)), float(min(ys)), float(max(xs) + 1), float(max(ys) + 1)], w * h
    return best


@pytest.mark.parametrize("seed", range(6))
def test_what_stands_out_equals_a_plain_loop(seed):
    rng = np.random.default_rng(seed)
    out = drawn(60, 70, (0, 0, 0, 0), ground=200 if seed % 2 else 30, channels=(3, 1, 4)[seed % 3])
    for _ in range(3):
        a, b = rng.integers(0, 50, 2)
        out[b : b + rng.integers(5, 40), a : a + rng.integers(5, 40)] = rng.integers(0, 256)
    out = np.clip(out + rng.integers(-6, 7, out.shape), 0, 255).astype("u1")
    assert images.salient_box(out) == plain_salient(out)


def test_regions_are_those_of_a_flood():
    rng = np.random.default_rng(2)
    for corners, steps in ((True, AROUND), (False, CROSS)):
        for share in (0.3, 0.5, 0.7):
            mask = rng.random((23, 31)) < share
            found = sorted(sorted((y, x) for y, a, b in own for x in range(a, b)) for own in images.regions(mask, corners))
            assert found == sorted(sorted(own) for own in plain_regions(mask, steps))


def test_plain_and_tiny_images_have_nothing_that_stands_out():
    assert images.salient_box(np.full((40, 40, 3), 7, "u1")) is None
    assert images.salient_box(np.full((1, 1, 1), 7, "u1")) is None and images.salient_box(np.zeros((2, 90, 3), "u1")) is None


def test_a_box_is_cut_out_of_an_image(spark):
    rng = np.random.default_rng(1)
    own = rng.integers(0, 256, (9, 7, 3)).astype("u1")
    broken = ("", 9, 7, 3, 16, bytearray(b"short"))
    rows = [(1, picture(own), [1, 2, 5, 8]), (2, picture(own), [-3, 0, 99, 4]), (3, picture(own), None), (4, None, [0, 0, 1, 1]), (5, broken, [0, 0, 1, 1]), (6, picture(own), [5, 5, 5, 8]), (7, picture(own[:, :, :1]), [2, 0, 3, 9])]
    table = spark.createDataFrame(rows, f"id int, image {IMAGE}, box array<int>")
    found = {r.id: r.part for r in table.select("id", images.cut(F.col("image"), F.col("box")).alias("part")).collect()}
    assert (found[1].height, found[1].width, bytes(found[1].data)) == (6, 4, own[2:8, 1:5].tobytes())
    assert (found[2].height, found[2].width, bytes(found[2].data)) == (4, 7, own[:4].tobytes())
    assert bytes(found[7].data) == own[:, 2:3, :1].tobytes() and found[7].nChannels == 1
    assert [found[i] for i in (3, 4, 5, 6)] == [None] * 4


# -- domain ----------------------------------------------------------------------------------------------------------


def boxes_of(spark, *images_):
    rows = [(i, k, [0.0, 0.0, float(side), float(side)], conf, name) for i, own in enumerate(images_) for k, (name, conf, side) in enumerate(own)]
    return spark.createDataFrame(rows, "image_id int, box_index int, box array<double>, confidence double, class_name string")


def test_only_listed_classes_put_an_image_off_the_domain(spark):
    """Expectations are literal: a watch is seen as a clock, a cap as a sports ball, and so on."""
    off = ["dog", "Cat", "bird", "horse", "sheep", "cow", "elephant", "bear", "zebra", "giraffe", "car", "motorcycle", "airplane", "bus", "train", "truck", "boat", "traffic light", "fire hydrant", "stop sign", "parking meter", "toilet"]
    neither = ["clock", "sports ball", "vase", "book", "scissors", "cake", "sandwich", "shoe", "dress", "chair"]
    home = ["Tie", "umbrella", "handbag", "backpack", "suitcase", "person"]
    cases = [[(n, 0.9, 5)] for n in [*off, *neither, *home]] + [[("dog", 0.64, 5)], [("dog", 0.65, 5), ("cat", 0.65, 9), ("car", 0.5, 9)], [("dog", 0.9, 5), ("PERSON", 0.1, 5)]]
    found = {r.image_id: r for r in domain.detector_domain(boxes_of(spark, *cases)).collect()}
    for i, n in enumerate([*off, *neither, *home]):
        assert (found[i].detector_ood, found[i].needs_label, found[i].entity) == (n in off, n in neither, n.lower() if n in off else None)
        assert found[i].has_inside == (n in home and n != "person")
    low, two, person = (found[len(off) + len(neither) + len(home) + k] for k in range(3))
    assert not low.detector_ood and low.needs_label and two.entity == "dog" and not person.detector_ood and not person.needs_label


def test_preferred_boxes(spark):
    """shoe, dress and shirt are preferred, umbrella isn't; a person counts 1.2."""
    pairs = {("umbrella", "person"): 1, ("person", "dress"): 1, ("chair", "SHIRT"): 1, ("umbrella", "shoe"): 1, ("tie", "handbag"): 0, ("chair", "umbrella"): 0}
    rows = boxes_of(spark, *[[(a, 0.8, 10), (b, 0.8, 10)] for a, b in pairs])
    assert {r.image_id: r.box_index for r in domain.choose_box(rows).collect()} == dict(enumerate(pairs.values()))
    asked = {r.image_id: r.box_index for r in domain.choose_box(rows, explicit=F.when(F.col("image_id") < 2, F.col("image_id") * 7), outside=F.col("image_id") == 3).collect()}
    assert asked == {0: 0, 1: 1, 2: 1, 4: 0, 5: 0}


# -- search ----------------------------------------------------------------------------------------------------------


class Fixed:
    """A detector that sees the same box in every image."""

    def boxes(self, image):
        return F.array(F.struct(F.array(*map(F.lit, (30.0, 10.0, 60.0, 40.0))).alias("box"), F.lit(0.9).alias("confidence"), F.lit("handbag").alias("class_name")))


def searched(spark, rows, schema="", **more):
    """Points: product 0 is the thing's colour, product 1 the ground's; the labels are far from both."""
    encoder = providers.ColourImage()
    plain = [(0, picture(drawn(4, 4, (0, 0, 4, 4)))), (2, picture(drawn(4, 4, (0, 0, 0, 0)))), (4, picture(drawn(4, 4, (0, 0, 0, 0), ground=120)))]
    table = spark.createDataFrame(plain, f"vec_id long, image {IMAGE}").withColumn("embedding", encoder.encode(F.col("image")))
    from tessel.operators.search import split_points

    labels = table.where("vec_id = 4").select(F.lit("fashion").alias("label"), F.col("embedding").alias("vector"))
    found = image_search.search_images(split_points(table), spark.createDataFrame(rows, f"image_id int, image {IMAGE}{schema}"), labels, encoder, rule=Cliff(image_floor=0.1), **more)
    return {(r.image_id, r["rank"]): r for r in found.results.collect()}, {r.image_id: r for r in found.report.collect()}


BAG = [([30.0, 10.0, 60.0, 40.0], 0.9, "handbag"), ([0.0, 0.0, 25.0, 50.0], 0.9, "chair")]
BOXED = ", boxes " + providers.BOXES + ", box_index int"


def test_from_boxes_to_crop_to_results(spark):
    scene = picture(drawn(60, 100, (30, 10, 60, 40)))
    rows = [
        (1, scene, BAG, None), (2, scene, BAG, 1), (3, scene, BAG, 7), (4, scene, None, None), (5, scene, [([30.0, 10.0, 60.0, 40.0], 0.9, "truck")], 0),
        (6, ("", -1, -1, -1, -1, None), BAG, None), (7, scene, [([31.0, 11.0, 59.0, 39.0], 0.5, "clock")], None), (1, scene, BAG, None),
    ]
    results, report = searched(spark, rows, BOXED, keep_from=0.99)
    assert report[1].crop_applied and report[1].crop_box == [28, 8, 61, 41] and report[1].box_index == 0 and [b.is_selected for b in report[1].detected_boxes] == [True, False]
    assert report[2].box_index == 1 and report[2].crop_box == [0, 0, 26, 52] and report[3].box_index == 0
    assert report[4].crop_box == [28, 8, 61, 41] and [b.class_name for b in report[4].detected_boxes] == ["focused_product"]
    assert report[5].detected_entity == "truck" and not report[5].crop_applied and report[5].crop_box == [0, 0, 100, 60]
    assert report[6].reason == "invalid_image" and report[6].kept_count == 0 and report[6].detected_boxes is None
    assert [b.class_name for b in report[7].detected_boxes] == ["clock", "focused_product"] and report[7].box_index == 1
    assert report[1].kept_count >= 1 and len(report) == 7
    assert results[2, 1].product_id == 1  # the crop of the ground shows the ground


def test_a_crop_wins_or_is_left_out(spark):
    small = picture(drawn(100, 200, (30, 10, 60, 40)))  # the thing is a small part: the crop matches it better
    plain = searched(spark, [(1, small)], detector=Fixed(), focus=None, use_crop=False)
    assert plain[1][1].source == "original" and plain[0][1, 1].product_id == 1
    results, report = searched(spark, [(1, picture(drawn(60, 61, (30, 10, 60, 40), ground=90)))], detector=Fixed(), focus=None, keep_from=1.1)
    assert report[1].source == "crop" and results[1, 1].product_id == 0 and report[1].crop_applied


def test_no_images(spark):
    results, report = searched(spark, [], BOXED)
    assert not results and not report


def test_the_report_reads_what_was_found_from_tables(spark):
    """No task of the report or the results makes the searches again, or holds their sorters."""
    from tessel import queries

    found = queries.image_pipeline(spark, "/root/testdata/sf0.001")
    for rows in found:
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" not in plan and plan.count("Window [") <= 8, plan.count("Window [")
