"""A corpus from raw documents to token ids: quality, line dedup, near duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept.  In every stage an empty table gives an
empty one, more columns than those of documents pass through (but for the last), and null texts count as empty ones.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import byte_bpe, decontaminate, jaccard_join, language, line_dedup, quality
from tessel.llm.common import keep, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels that aren't held out.

    Rows decide alone: equal texts share their score, whatever their ids.  A score of just the bound stays.  Null and empty texts have
    one score, that of a passage without words.  Without a label in use the network is as it was initialised.
    """
    network = quality.fit(docs, table(spark, sf_dir, "labels").where(~language.held_out(F.col("doc_id"))))
    return quality.drop_low_quality(docs, network)


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without lines that an earlier one has; n_chars follows.

    No row goes.  A null text stays null, with null n_chars; a text whose lines all go is empty.  The smallest doc_id keeps a line, a null one
    comes last, and rows of one doc_id keep theirs together.
    """
    return line_dedup.drop_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates, by five words and a similarity of 0.8.

    Texts without words are in no group and stay.  Of a group's rows with the smallest doc_id one stays.
    """
    return jaccard_join.keep_one_of_each(docs, size=5, num=80, den=100)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with less than a twentieth of their words in windows of the benchmark, or none.

    Rows decide alone; a share of just a twentieth is contaminated.  Texts without words stay, and so do all with an empty benchmark.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed, little-endian unsigned 32-bit) and the text that they decode to.

    Null and empty texts: no ids, and the empty text.  Repeated rows are encoded alike.
    """
    vocabulary = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), vocabulary, public_tokenizers.PATTERN).select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        "token_ids",
        F.col("decoded").cast("string").alias("text"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", good_documents),
    ("line_dedup", unrepeated_lines),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", uncontaminated),
    ("byte_bpe", encoded),
]

#: A fitted classifier, components of a graph and a tokenizer can't be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
