"""What a query asks for: category, gender, colour, and whether it is off the catalog's domain at all."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions.text import WORD, clean_text, let, stem, stem_of, tokens_of_clean, word_pattern
from tessel.plans import lexicon as lx
from tessel.plans.lexicon import DEFAULT, Lexicon


def first_named(q: Column, named: Iterable[tuple[str, Iterable[str]]]) -> Column:
    """The first name of which the text has a term as a whole word.

    Patterns and names are one literal array: a chain of conditions as long as a lexicon would outgrow generated code.
    """
    rows = F.array(*[F.struct(F.lit(word_pattern(*terms)).alias("pattern"), F.lit(name).alias("name")) for name, terms in named])
    return F.get(F.filter(rows, lambda x: F.rlike(q, x["pattern"])), F.lit(0))["name"]


def gender_of(q: Column) -> Column:
    return first_named(q, lx.GENDER_WORDS.items())


def category_of(q: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """The category of the longest name that the query has, by its name, a synonym or their stems, as whole words."""
    return first_named(q, [(c.name, c.terms) for c in lexicon.by_priority()])


def colour_of(q: Column) -> Column:
    return first_named(q, [(c, [c]) for c in lx.QUERY_COLOURS])


def shades_of(colour: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """Shades of the colour's family, sorted; a colour without one is its own shade; no colour, no shades."""
    families = F.create_map(*[x for k, v in lexicon.colours.items() for x in (F.lit(k), F.array(*map(F.lit, sorted({*v, k}))))])
    return F.when(colour.isNull(), F.array().cast("array<string>")).otherwise(F.coalesce(F.try_element_at(families, colour), F.array(colour)))


def off_domain_term(q: Column) -> Column:
    """The longest off-domain term of a query that has nothing of the domain in it."""
    about = F.exists(F.array(*map(F.lit, lx.IN_DOMAIN)), lambda word: F.contains(q, word))
    return F.when(~about, first_named(q, [(t, [t]) for t in sorted(lx.OFF_DOMAIN, key=lambda t: (-len(t), t))]))


def intent_struct(q: Column, category: Column, gender: Column, colour: Column, term: Column, lexicon: Lexicon) -> Column:
    return F.struct(
        category.alias("target_category"),
        gender.alias("target_gender"),
        colour.alias("target_color"),
        shades_of(colour, lexicon).alias("color_shades"),
        term.isNotNull().alias("is_non_fashion_query"),
        term.alias("non_fashion_term"),
        tokens_of_clean(q).alias("tokens"),
        q.alias("clean_query"),
    )


def parse_intent(queries: DataFrame, text_col: str = "query", lexicon: Lexicon = DEFAULT) -> DataFrame:
    """All columns and ``intent``: category, gender (implied by some categories), colour, shades, off-domain term, tokens."""
    q = F.lower(clean_text(F.col(text_col)))
    parsed = queries.withColumn("_q", q).withColumns({"_category": category_of(F.col("_q"), lexicon), "_colour": colour_of(F.col("_q"))})
    implied = F.when(F.col("_category").isin(*lx.WOMEN_BY_DEFAULT), F.lit("Women"))
    term = off_domain_term(F.col("_q"))
    intent = intent_struct(F.col("_q"), F.col("_category"), F.coalesce(gender_of(F.col("_q")), implied), F.col("_colour"), term, lexicon)
    return parsed.withColumn("intent", intent).drop("_q", "_category", "_colour")


# -- many texts, by an equi-join with the terms -----------------------------------------------------------------------


def term_table(spark: SparkSession, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """(term, kind, place, name): all terms that an intent looks for; of several of a kind the one with the smallest place counts."""
    kinds = {
        "category": [(c.name, c.terms) for c in lexicon.by_priority()],
        "gender": list(lx.GENDER_WORDS.items()),
        "colour": [(c, [c]) for c in lx.QUERY_COLOURS],
        "off": [(t, [t]) for t in sorted(lx.OFF_DOMAIN, key=lambda t: (-len(t), t))],
    }
    rows = [(term, kind, place, name) for kind, named in kinds.items() for place, (name, terms) in enumerate(named) for term in dict.fromkeys(terms)]
    return spark.createDataFrame(rows, "term string, kind string, place int, name string")


def pieces_of(term: str) -> int:
    return len(re.findall(r"\w+", term))


def phrases(q: Column, most: int) -> Column:
    """All runs of up to ``most`` pieces (letters, digits, _) of a text, with what stands between them; each once."""
    def all_runs(parts: Column) -> Column:
        words, between = parts["words"], parts["between"]

        def runs(n: int) -> Column:
            def run(i: Column) -> Column:
                return F.concat(F.get(words, i), *[x for k in range(1, n) for x in (F.get(between, i + k), F.get(words, i + k))])

            return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), run)).otherwise(F.array().cast("array<string>"))

        return F.array_distinct(F.concat(*map(runs, range(1, most + 1))))

    # cut once a text, not once for each of its pieces
    return let(F.struct(F.regexp_extract_all(q, F.lit(f"([{WORD}]+)"), 1).alias("words"), F.split(q, f"[{WORD}]+").alias("between")), all_runs)


def parse_intents(queries: DataFrame, key: str, text_col: str = "query", lexicon: Lexicon = DEFAULT) -> DataFrame:
    """``parse_intent`` for many texts: their phrases meet the table of terms in a hash join, and no pattern is tried on any of them.

    ``key`` is unique and not null.  A term counts as whole words, so it is a run of pieces of the text; rows without one don't
    meet anything.  Null texts are empty.
    """
    terms = term_table(queries.sparkSession, lexicon)
    most = max(map(pieces_of, [t for c in lexicon.categories for t in c.terms] + [t for ts in (*lx.GENDER_WORDS.values(), lx.QUERY_COLOURS, lx.OFF_DOMAIN) for t in ts]))
    asked = queries.withColumn("_q", F.lower(clean_text(F.col(text_col))))
    met = asked.select(F.col(key).alias("_key"), F.explode(phrases(F.col("_q"), most)).alias("term")).join(F.broadcast(terms), "term")  # the lexicon bounds it
    found = met.groupBy("_key").agg(*[F.min(F.when(F.col("kind") == k, F.struct("place", "name")))["name"].alias(f"_{k}") for k in ("category", "gender", "colour", "off")])
    rows = asked.join(found, asked[key] == found["_key"], "left")
    about = F.exists(F.array(*map(F.lit, lx.IN_DOMAIN)), lambda word: F.contains(F.col("_q"), word))
    term = F.when(F.col("_off").isNotNull(), F.when(~about, F.col("_off")))
    implied = F.when(F.col("_category").isin(*lx.WOMEN_BY_DEFAULT), F.lit("Women"))
    intent = intent_struct(F.col("_q"), F.col("_category"), F.coalesce("_gender", implied), F.col("_colour"), term, lexicon)
    return rows.withColumn("intent", intent).drop("_q", "_key", "_category", "_gender", "_colour", "_off")


#: An entry of the lexicon as a column.
ENTRY = "struct<name:string,stem:string,synonyms:array<string>,stems:array<string>,context:string>"


def entry_array(lexicon: Lexicon) -> Column:
    """The lexicon as one array, in its order: a constant that is read from one text, as a literal for each term takes seconds to make."""
    rows = [{"name": c.name, "stem": stem_of(c.name), "synonyms": c.synonyms, "stems": [stem_of(s) for s in c.synonyms], "context": c.context} for c in lexicon.categories]
    return F.from_json(F.lit(json.dumps(rows)), f"array<{ENTRY}>")


def lexicon_entry(category: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """The entry for a catalog's category: by name, by stem, by synonym, or by a part of either; null where none fits."""
    entries = entry_array(lexicon)

    def cascade(b: Column) -> Column:
        c, s = b["c"], b["s"]
        tiers = [
            lambda x: x["name"] == c,
            lambda x: x["name"] == s,
            lambda x: (x["stem"] == s) | F.array_contains(x["synonyms"], c) | F.array_contains(x["stems"], s),
            lambda x: F.contains(c, x["name"]) | F.contains(x["name"], s) | F.exists(x["synonyms"], lambda y: F.contains(c, y) | F.contains(y, c)),
        ]
        return F.when(c != "", F.coalesce(*[F.get(F.filter(entries, t), F.lit(0)) for t in tiers]))

    def stemmed(b: Column) -> Column:
        return F.struct(b["c"].alias("c"), stem(b["c"]).alias("s"))

    lowered = F.struct(F.lower(F.trim(F.coalesce(category, F.lit("")))).alias("c"))
    return let(let(lowered, stemmed), cascade)


def prompts(query: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """Phrasings of a query for a text encoder, with up to two synonyms and the context of its lexicon entry."""
    q = F.trim(F.coalesce(query, F.lit("")))

    def phrased(entry: Column) -> Column:
        also = F.slice(F.filter(entry["synonyms"], lambda y: ~F.contains(F.lower(q), y)), 1, 2)
        found = F.array(
            q,
            F.concat(F.lit("a photo of "), q),
            F.concat(F.lit("a close-up photo of "), q),
            F.concat(q, F.lit(", stylish fashion apparel product")),
            F.when(F.size(also) > 0, F.concat(F.lit("a photo of "), q, F.lit(", also known as "), F.array_join(also, ", "))),
            F.concat(q, F.lit(", "), entry["context"]),
        )
        return F.filter(found, lambda p: p.isNotNull())

    return F.when(q == "", F.array(F.lit("fashion item"))).otherwise(let(lexicon_entry(q, lexicon), phrased))
