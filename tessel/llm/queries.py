"""One query for each operator, over its whole table with production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import ann, byte_bpe, decontaminate, filter_audit, jaccard_join, language, line_dedup, quality, sharding, substring_dedup, suffix_dedup, token_alignment, toxicity
from tessel.llm.common import LAST_ID, table


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.cut_repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "row.doc_id",
        "n_sentences",
        F.size("removed").cast("long").alias("n_removed"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = line_dedup.mark_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return marked.select(
        "row.doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.size("dropped").cast("long").alias("n_dropped"),
        F.sha2(line_dedup.kept_text().cast("binary"), 256).alias("kept_sha256"),
    )


def bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.round_trip(docs, vocabulary, public_tokenizers.PATTERN).select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=8)
    return placed.select(
        "row.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(rows, F.col("vec_id") % 20 == 0, k=20)


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.select("row.doc_id", language.held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


def qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    network = quality.fit(docs, labels.where(~language.held_out(F.col("doc_id"))))
    return quality.predict(docs, network).select(
        "row.doc_id",
        language.held_out(F.col("row.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= quality.KEEP).cast("int").alias("predicted"),
    )


def bytes_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.cut_repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "row.doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = jaccard_join.link_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    given = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    return linked.select(given("id").alias("doc_id"), "n_shingles", given("component").alias("component_id"))


def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.predict(docs, model).select(
        "row.doc_id",
        toxicity.held_out(F.col("row.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.TOXIC).cast("int").alias("predicted"),
    )


def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte_level, pieces = (Path(public_tokenizers.path(name)).read_bytes() for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = token_alignment.align_documents(docs, byte_level, public_tokenizers.PATTERN, pieces)
    return found.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_substring_dedup": spans,
    "op2_line_dedup": line,
    "op3_byte_bpe": bpe,
    "op4_sharding": shards,
    "op5_ann_hnsw": neighbours,
    "op6_language_id": languages,
    "op7_quality_mil": qualities,
    "op8_suffix_dedup": bytes_cut,
    "op9_decontamination": contamination,
    "op10_jaccard_join": components,
    "op11_toxicity": toxic,
    "op12_token_alignment": alignment,
    "op13_filter_audit": filters,
}

ORACLE_SQL = {
    "op2_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM lines),
repeated AS (
  SELECT line_key, min(doc_id) AS first_id FROM keyed WHERE length(line_key) >= 10
  GROUP BY line_key HAVING count(DISTINCT doc_id) >= 2)
SELECT k.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE k.doc_id <> r.first_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE r.first_id IS NULL OR k.doc_id = r.first_id), '')) AS kept_sha256
FROM keyed k LEFT JOIN repeated r USING (line_key)
GROUP BY k.doc_id""",
    "op8_suffix_dedup": r"""
WITH hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (
  SELECT doc_id, unnest(range(0, length(h) // 2 - 49)) AS i,
         unnest(list_transform(range(0, length(h) // 2 - 49), lambda x: md5_number(substr(h, 2 * x + 1, 100)))) AS string
  FROM hexed WHERE length(h) >= 100),
firsts AS (SELECT string, min(doc_id) AS first_id FROM strings GROUP BY string HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, i FROM strings JOIN firsts USING (string) WHERE doc_id > first_id),
islands AS (
  SELECT doc_id, i, sum(CASE WHEN i - before > 50 OR before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS island
  FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM hit)),
spans AS (SELECT doc_id, island, min(i) AS a, max(i) + 50 AS b FROM islands GROUP BY doc_id, island),
edges AS (
  SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans
  UNION ALL SELECT d.doc_id, length(h) // 2, coalesce((SELECT max(b) FROM spans s WHERE s.doc_id = d.doc_id), 0) FROM hexed d),
kept AS (
  SELECT e.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a, before) AS k
  FROM edges e JOIN hexed USING (doc_id) GROUP BY e.doc_id),
sums AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(k)) AS kept_sha256
FROM hexed JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)""",
    "op9_decontamination": r"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i : i + 12], ' ') AS win
  FROM item_words, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
lengths AS (SELECT DISTINCT n FROM windows),
doc_windows AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i,
         unnest(list_transform(range(1, len(w) - n + 2), lambda x: array_to_string(w[x : x + n - 1], ' '))) AS win
  FROM doc_words, lengths WHERE len(w) >= n),
found AS (SELECT doc_id, i, n, item FROM doc_windows JOIN windows USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM found, unnest(range(i, i + n)) AS t(j) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op10_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM shingled),
members AS (SELECT doc_id, unnest(list_transform(s, lambda x: md5_number(x))) AS h FROM shingled),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM members a JOIN members b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
either AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT DISTINCT a AS doc_id, a AS seen FROM either UNION SELECT r.doc_id, l.b FROM reached r JOIN either l ON l.a = r.seen)
SELECT z.doc_id, n AS n_shingles, least(z.doc_id, coalesce(min(seen), z.doc_id)) AS component_id
FROM sizes z LEFT JOIN reached r ON r.doc_id = z.doc_id GROUP BY z.doc_id, n""",
    "op13_filter_audit": r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
firsts AS (SELECT t, min(doc_id) AS first_id FROM texts GROUP BY t),
flagged AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
failing AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > first_id THEN 'E' ELSE '' END AS fails
  FROM texts JOIN firsts USING (t) LEFT JOIN flagged USING (doc_id)),
kinds AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY part, fails),
growing AS (
  SELECT '' AS o UNION ALL
  SELECT o || f FROM growing, unnest(['A', 'B', 'C', 'D', 'E']) AS l(f) WHERE NOT contains(o, f)),
steps AS (SELECT o, k, substr(o, k, 1) AS f, substr(o, 1, k - 1) AS done FROM growing, range(1, 6) AS r(k) WHERE length(o) = 5),
cases AS (
  SELECT part, o, k, n, good, toxic, contains(fails, f) AS hit, fails = f AS alone,
         done <> '' AND translate(fails, done, '') <> fails AS gone, length(fails) AS m
  FROM steps, kinds)
SELECT part, o AS filter_order, CAST(k AS INTEGER) AS step,
  CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND NOT hit), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND hit), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (WHERE gone AND hit), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (WHERE alone), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (WHERE NOT gone AND hit), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(toxic) FILTER (WHERE NOT gone AND hit), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * (120 // greatest(m, 1))) FILTER (WHERE hit), 0) AS BIGINT) AS shapley
FROM cases GROUP BY part, o, k""",
}
