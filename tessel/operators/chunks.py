"""Text chunks of a product: caption, style, n-grams, meaning and description, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.text import clean_text, ngrams, sentences, tokens_of_clean
from tessel.operators.intent import lexicon_entry
from tessel.plans.lexicon import DEFAULT, Lexicon

FIELDS = ("productDisplayName", "gender", "masterCategory", "subCategory", "articleType", "baseColour", "season", "year", "usage", "description")


def present(*parts: Column) -> Column:
    """The parts that are not null."""
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def given(x: Column) -> Column:
    return x != ""


def joined(*words: Column) -> Column:
    """Words with blanks between them, if all are given."""
    condition = given(words[0])
    for w in words[1:]:
        condition = condition & given(w)
    return F.when(condition, F.concat_ws(" ", *words))


def cleaned(products: DataFrame) -> DataFrame:
    """``p_``: the fields as clean text, and ``low_``: the same in lower case; a missing column counts as empty.

    They are columns of their own, not a struct: the optimizer would copy a struct's expressions to every use of a field.
    """
    own = {f: clean_text(F.col(f).cast("string")) if f in products.columns else F.lit("") for f in FIELDS}
    return products.withColumns({f"p_{f}": c for f, c in own.items()}).withColumns({f"low_{f}": F.lower(F.col(f"p_{f}")) for f in FIELDS})


def with_entry(rows: DataFrame, key: str, out: str, lexicon: Lexicon) -> DataFrame:
    """``out``: the lexicon entry for ``key``, looked up once for each different key and joined back."""
    kinds = rows.select(F.col(key).alias("_kind")).distinct().withColumn("_entry", lexicon_entry(F.col("_kind"), lexicon))
    return rows.join(kinds, F.col(key) == F.col("_kind"), "left").withColumnRenamed("_entry", out).drop("_kind")


def attribute_ngrams(products: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """All columns, ``p``, ``low``, ``entry``, and sorted distinct ``unigrams``, ``bigrams`` and ``trigrams``.

    N-grams of the title, and colour, gender and usage bound to the article and its synonyms; unisex binds nothing.
    """
    rows = cleaned(products)
    rows = with_entry(rows, "low_articleType", "entry", lexicon).withColumn("words", tokens_of_clean(F.col("low_productDisplayName")))
    colour, gender_all, article, usage = (F.col(f"low_{f}") for f in ("baseColour", "gender", "articleType", "usage"))
    gender = F.when(gender_all != "unisex", gender_all).otherwise("")
    synonyms = F.coalesce(F.col("entry.synonyms"), F.array().cast("array<string>"))

    def bound(*words: Column) -> Column:
        return F.transform(synonyms, lambda s: joined(*words, s))

    def listed(*arrays: Column) -> Column:
        return F.array_sort(F.array_distinct(F.filter(F.concat(*arrays), lambda x: x.isNotNull())))

    words = F.col("words")
    pairs = F.array(joined(colour, article), joined(gender, article), joined(usage, article), joined(colour, usage))
    triples = F.array(joined(gender, colour, article), joined(usage, colour, article), joined(gender, usage, article))
    return rows.withColumns(
        {
            "unigrams": listed(words, synonyms),
            "bigrams": listed(ngrams(words, 2), pairs, bound(colour), bound(gender)),
            "trigrams": listed(ngrams(words, 3), triples, bound(gender, colour)),
        }
    )


def with_chunks(products: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """All columns and ``chunks``: array of (chunk_id, chunk_type, text), numbered from 0 without gaps."""
    rows = attribute_ngrams(products, lexicon)
    rows = with_entry(rows, "low_subCategory", "other", lexicon).withColumn("meaning", F.coalesce("entry", "other"))
    p, low = (lambda f: F.col(f"p_{f}")), (lambda f: F.col(f"low_{f}"))
    title = p("productDisplayName")
    owner = F.when(given(low("gender")) & (low("gender") != "unisex"), F.concat(low("gender"), F.lit("'s")))
    thing = F.when(given(low("articleType")), low("articleType")).when(given(low("subCategory")), low("subCategory"))
    rows = rows.withColumn("phrase", F.array_join(present(F.when(given(low("baseColour")), low("baseColour")), owner, thing), " "))
    phrase = F.col("phrase")
    more = given(phrase) & ~F.contains(low("productDisplayName"), phrase)
    caption = (
        F.when(given(title) & more, F.concat(F.lit("A photo of "), title, F.lit(", a "), phrase, F.lit(".")))
        .when(given(title), F.concat(F.lit("A photo of "), title, F.lit(".")))
        .otherwise(F.concat(F.lit("A photo of a "), phrase, F.lit(".")))
    )
    when = F.array_join(present(F.when(given(low("season")), low("season")), F.when(given(p("year")), p("year"))), " ")
    clauses = present(
        F.when(given(low("baseColour")), F.concat(low("baseColour"), F.lit(" colored"))),
        F.when(given(low("usage")), F.concat(F.lit("designed for "), low("usage"), F.lit(" wear"))),
        F.when(given(when), F.concat(F.lit("suitable for "), when)),
        F.when(given(low("articleType")), F.concat(low("articleType"), F.lit(" fashion product"))),
    )
    style = F.when(F.size(clauses) > 0, F.concat(title, F.lit(". "), F.array_join(clauses, ", "), F.lit(".")))
    phrases = F.concat(F.slice("bigrams", 1, 6), F.slice("trigrams", 1, 4))
    grams = F.when(F.size(phrases) > 0, F.concat(F.lit("Key product phrases and n-grams: "), F.array_join(phrases, ", "), F.lit(".")))
    meaning = F.col("meaning")
    path = F.array_join(present(*[F.when(given(p(f)), p(f)) for f in ("masterCategory", "subCategory", "articleType")]), " > ")
    parts = present(
        F.when(given(p("masterCategory")) | given(p("subCategory")), F.concat(F.lit("Category hierarchy: "), path)),
        F.concat(F.lit("Item meaning and synonyms: "), F.array_join(F.slice(meaning["synonyms"], 1, 4), ", ")),
        F.concat(F.lit("Styling context: "), meaning["context"]),
        F.when(given(p("gender")), F.concat(F.lit("Target audience: "), p("gender"))),
    )
    ontology = F.when(
        F.size(parts) > 0, F.concat(F.lit("Contextual fashion ontology for "), title, F.lit(": "), F.array_join(parts, ". "), F.lit("."))
    )
    told = given(p("description")) & (low("description") != low("productDisplayName"))
    details = F.when(told, F.filter(F.slice(sentences(p("description")), 1, 2), lambda s: F.length(s) > 10)).otherwise(F.array().cast("array<string>"))
    named = [("identity_category", caption), ("style_attributes", style), ("ngram_context", grams), ("semantic_context", ontology)]
    all_ = F.concat(
        F.array(*[F.struct(F.lit(kind).alias("kind"), text.alias("text")) for kind, text in named]),
        F.transform(details, lambda s: F.struct(F.lit("description_detail").alias("kind"), s.alias("text"))),
    )
    made = ("entry", "other", "words", "unigrams", "bigrams", "trigrams", "meaning", "phrase", "listed")
    numbered = F.transform(
        F.filter("listed", lambda x: x["text"].isNotNull()),
        lambda x, i: F.struct(i.alias("chunk_id"), x["kind"].alias("chunk_type"), x["text"].alias("text")),
    )
    return rows.withColumn("listed", all_).withColumn("chunks", numbered).drop(*[f"{k}_{f}" for k in ("p", "low") for f in FIELDS], *made)


def chunk_points(products: DataFrame, id_col: str = "id", per_product: int = 1000) -> DataFrame:
    """One row for each chunk; its point id is the product's id times ``per_product`` plus the chunk's number."""
    return products.select(
        F.col(id_col).cast("long").alias("product_id"), F.col("productDisplayName").alias("product_name"), F.inline("chunks")
    ).select((F.col("product_id") * per_product + F.col("chunk_id")).alias("point_id"), "product_id", "product_name", "chunk_id", "chunk_type", F.col("text").alias("chunk_text"))
