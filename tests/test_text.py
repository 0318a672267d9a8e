import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessel.functions import text

STEMS = {
    "panties": "panty", "accessories": "accessory", "watches": "watch", "dresses": "dress", "scarves": "scarf", "socks": "sock", "bras": "bra",
    "lipsticks": "lipstick", "ties": "tie", "shoes": "shoe", "bus": "bus", "glass": "glass", "boxes": "box", "tennis": "tennis",
}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_stems(spark):
    rows = spark.createDataFrame([(k,) for k in STEMS], "w string").select("w", text.stem(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in rows} == STEMS
    assert {w: text.stem_of(w) for w in STEMS} == STEMS


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="aeishxcSuy", max_size=8), min_size=1, max_size=20))
def test_stem_is_the_same_for_columns_and_literals(spark_rows, words):
    assert spark_rows(words) == [text.stem_of(w) for w in words]


@pytest.fixture(scope="module")
def spark_rows(spark):
    def run(words):
        rows = spark.createDataFrame(list(enumerate(words)), "i int, w string").select("i", text.stem(F.col("w")).alias("s")).collect()
        return [r.s for r in sorted(rows)]

    return run


@pytest.mark.parametrize(
    "raw, clean",
    [(None, ""), ("", ""), ("<b>Red</b>  dress!", "Red dress"), ("café d'été — 50%", "café d'été 50"), ("a b\x0bc", "a b c"), ("under_score-dash", "under_score-dash")],
)
def test_clean_text(spark, raw, clean):
    assert one(spark, text.clean_text(F.lit(raw).cast("string"))) == clean


def test_tokens_and_ngrams(spark):
    words = text.tokens(F.lit("Peter England men blue a jeans"))
    assert one(spark, words) == ["peter", "england", "men", "blue", "jeans"]
    assert "blue jeans" in one(spark, text.ngrams(words, 2)) and "men blue jeans" in one(spark, text.ngrams(words, 3))
    assert one(spark, text.ngrams(F.array(F.lit("one")), 2)) == []


def test_whole_words(spark):
    assert one(spark, text.has_word(F.lit("summer xété dress"), "dress"))
    assert not one(spark, text.has_word(F.lit("dressing"), "dress"))
    assert not one(spark, text.contains_word(F.lit("xété"), F.lit("ét")))
