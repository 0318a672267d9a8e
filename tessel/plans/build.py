"""Building the index from a catalog: validated products, their vectors and chunks, written as tables of builds.

A build reads the catalog once: it encodes the products into a table of its own, counts them on the way, and writes the index tables
from there.  It counts from its commit on (see ``commits``), so a build that fails leaves the index as it was.  Readers take the latest
row of each key.  Old chunks of a product stay unless it has a chunk of that number again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessel.operators.chunks import chunk_points, with_chunks
from tessel.operators.index import latest, unified_points
from tessel.plans import commits
from tessel.providers import ImageEncoder, TextEncoder
from tessel.session import filesystem, scratch
from tessel.sources.catalog import ORDER, first_rows, valid_products, with_descriptions

#: Tables of the index and the key of each.
TABLES = {"unified": "point_id", "image": "product_id", "chunks": "point_id"}
PRODUCT = ("productDisplayName", "name", "gender", "masterCategory", "subCategory", "articleType", "baseColour", "season", "year", "usage", "description")


def in_order(catalog: DataFrame) -> DataFrame:
    """Valid products with the places that they have in the catalog, if it has any."""
    places = F.struct(*[c for c in ORDER if c in catalog.columns] or [F.lit(0).alias("none")])
    return valid_products(catalog.withColumn("_place", places)).select("*", *[F.col(f"_place.{c}").alias(c) for c in ORDER if c in catalog.columns]).drop("_place")


def prepare_products(catalog: DataFrame, images: DataFrame, styles: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Products that can be indexed, with their ``image``: a valid id and title, an image file, and the description if any."""
    rows = in_order(catalog).join(images.select("id", "image"), "id")
    rows = with_descriptions(rows, styles) if styles is not None else rows.withColumn("description", F.lit(""))
    return first_rows(rows.withColumn("name", F.col("productDisplayName")), limit)


def encoded_products(products: DataFrame, text: TextEncoder, image: ImageEncoder) -> DataFrame:
    """Products with ``image_vector`` and ``title_vector`` in place of their ``image``."""
    return products.withColumns({"image_vector": image.encode(F.col("image")), "title_vector": text.encode(F.col("name"))}).drop("image")


def index_rows(encoded: DataFrame, text: TextEncoder) -> dict[str, DataFrame]:
    """Rows of the three tables for encoded products."""
    return {
        "unified": unified_points(encoded),
        "image": encoded.select(F.col("id").alias("product_id"), F.col("image_vector").alias("vector"), *[c for c in PRODUCT if c in encoded.columns]),
        "chunks": chunk_points(with_chunks(encoded.drop("image_vector", "title_vector"))).withColumn("vector", text.encode(F.col("chunk_text"))),
    }


def build_index(
    products: DataFrame,
    path: str,
    text: TextEncoder,
    image: ImageEncoder,
    clear_existing: bool = False,
    parts: int = 1,
    progress: Callable[[int, int], None] | None = None,
) -> DataFrame:
    """Index prepared products below ``path`` and summarise this run: success, indexed_count, total_products, stats, error.

    The products are dealt into ``parts`` by a hash of the id; after each, ``progress`` hears how many are done, of how
    many.  With ``clear_existing`` earlier builds don't count any more once this one does.  Without products nothing is written,
    success is false and ``error`` says so.  ``stats`` has the sizes of the whole index.
    """
    spark = products.sparkSession
    commits.create_if_absent(spark, path)
    number = F.pmod(F.xxhash64("id"), F.lit(parts))
    seen, folder = Observation(), scratch(spark)
    counted = encoded_products(products, text, image).withColumn("part", number)
    counted = counted.observe(seen, *[F.count(F.when(F.col("part") == k, 1)).alias(f"p{k}") for k in range(parts)])
    counted.write.partitionBy("part").parquet(folder)
    sizes = {k: seen.get[f"p{k}"] for k in range(parts)}
    total, done = sum(sizes.values()), 0
    if total:
        encoded, build = spark.read.schema(counted.schema).parquet(folder), commits.new_build(spark, path)
        for part in (k for k in range(parts) if sizes[k]):
            for name, rows in index_rows(encoded.where(F.col("part") == part).drop("part"), text).items():
                rows.write.mode("append").parquet(f"{path}/{name}/build={build}")
            done += sizes[part]
            if progress:
                progress(done, total)
        commits.commit(spark, path, lambda builds: [build] if clear_existing else sorted([*builds, build]))
    fs, at = filesystem(spark, folder)
    fs.delete(at, True)
    return build_summary(spark, path, done, total)


def open_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The latest row of each key of an index table."""
    rows = commits.versions(spark, path, name)
    if rows is None:
        raise ValueError(f"no build of {name} at {path}")
    return latest(rows, TABLES[name], "build").drop("build")


def compact(spark: SparkSession, path: str) -> None:
    """One build with the latest rows in place of all others, whose folders are removed once it counts.  No build may be running."""
    before, build = commits.committed(spark, path)[1], commits.new_build(spark, path)
    for name in TABLES:
        if commits.versions(spark, path, name) is not None:
            open_table(spark, path, name).write.parquet(f"{path}/{name}/build={build}")
    if before:
        commits.commit(spark, path, lambda builds: sorted([build, *(b for b in builds if b not in before)]))
        commits.vacuum(spark, path)


def table_sizes(spark: SparkSession, path: str) -> dict[str, int]:
    """Keys of each table; nothing but the key columns is read."""
    out = {}
    for name, key in TABLES.items():
        rows = commits.versions(spark, path, name)
        out[name] = 0 if rows is None else rows.select(F.count_distinct(key)).first()[0]
    return out


def build_summary(spark: SparkSession, path: str, indexed: int, total: int) -> DataFrame:
    """What this run indexed, of what it was given, and the size of each table."""
    sizes = table_sizes(spark, path)
    stats = ", ".join(f"'{n}', {sizes[n]}L" for n in TABLES)
    error = "CAST(NULL AS STRING)" if indexed else "'no product can be indexed'"
    return spark.sql(f"SELECT {str(indexed > 0).lower()} AS success, {indexed}L AS indexed_count, {total}L AS total_products, named_struct({stats}) AS stats, {error} AS error")
