"""Text functions with one meaning in Java and in SQL engines: explicit Unicode classes instead of \\w, \\s and \\b."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x0B\x{1C}-\x{1F}\x{85}\p{Z}"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, also where the body's own lambdas use it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean_text(text: Column) -> Column:
    """Tags and characters other than words, blanks, hyphens and apostrophes become blanks; runs of blanks become one."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")
    out = F.regexp_replace(out, rf"[^{WORD}{SPACE}\-']", " ")
    return F.trim(F.regexp_replace(out, f"[{SPACE}]+", " "))


def tokens(text: Column) -> Column:
    """Lower-case words of more than one character."""
    return tokens_of_clean(F.lower(clean_text(text)))


def tokens_of_clean(clean: Column) -> Column:
    return F.filter(F.split(clean, " "), lambda t: F.length(t) > 1)


def stem(word: Column) -> Column:
    """Plural endings of a word; the first rule that applies decides."""
    return _stem(F.lower(F.trim(word)))


def _stem(w: Column) -> Column:
    n = F.length(w)
    less = lambda k: F.substring(w, F.lit(1), n - k)
    keeps = F.endswith(w, F.lit("ss")) | F.endswith(w, F.lit("us")) | F.endswith(w, F.lit("is"))
    long_es = F.endswith(w, F.lit("ches")) | F.endswith(w, F.lit("shes")) | F.endswith(w, F.lit("xes"))
    return (
        F.when((n <= 3) | ~F.endswith(w, F.lit("s")), w)  # every rule is for words in s
        .when(w == "scarves", F.lit("scarf"))
        .when(F.endswith(w, F.lit("ies")) & (n > 4), F.concat(less(3), F.lit("y")))
        .when(F.endswith(w, F.lit("sses")) | long_es, less(2))
        .when(~keeps, less(1))
        .otherwise(w)
    )


def stem_of(word: str) -> str:
    """``stem`` for the words of a lexicon, which are literals of a plan."""
    w = word.lower().strip()
    rules = [
        (len(w) <= 3, w),
        (w == "scarves", "scarf"),
        (w.endswith("ies") and len(w) > 4, w[:-3] + "y"),
        (w.endswith(("sses", "ches", "shes", "xes")), w[:-2]),
        (w.endswith("s") and not w.endswith(("ss", "us", "is")), w[:-1]),
    ]
    return next((out for applies, out in rules if applies), w)


def stemmed_set(words: Column) -> Column:
    """Words and their stems, each once."""
    plain = F.transform(words, lambda w: F.lower(F.trim(w)))  # once a word, not once for each rule
    return F.array_union(words, F.transform(plain, _stem))


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words, joined by a blank; none if there are fewer words."""
    at = F.sequence(F.lit(0), F.size(words) - n)
    joined = F.transform(at, lambda i: F.array_join(F.slice(words, i + 1, F.lit(n)), " "))
    return F.when(F.size(words) >= n, joined).otherwise(F.array().cast("array<string>"))


def word_pattern(*terms: str) -> str:
    """A regular expression for any of the terms as whole words."""
    return rf"(^|[^{WORD}])({'|'.join(terms)})($|[^{WORD}])"


def has_word(text: Column, *terms: str) -> Column:
    return F.rlike(text, F.lit(word_pattern(*terms)))


def contains_word(text: Column, term: Column) -> Column:
    """Whole-word test for a term that is a column of plain words."""
    edge = F.lit(rf"[^{WORD}]")
    return F.rlike(text, F.concat(F.lit("(^|"), edge, F.lit(r")\Q"), term, F.lit(r"\E($|"), edge, F.lit(")")))


def sentences(text: Column) -> Column:
    """Parts after a . ! or ? and blanks, without surrounding blanks; empty ones are left out."""
    parts = F.transform(F.split(text, rf"(?<=[.!?])[{SPACE}]+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def standard_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), f"[{SPACE}]+", " "))


def or_default(text: Column, default: str) -> Column:
    """The trimmed text, or the default where nothing is left."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit(default)).otherwise(F.trim(text))
