"""Tables of points: expanding products, upserts by key, lookups and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def unified_points(products: DataFrame, image_vector: str = "image_vector", title_vector: str = "title_vector") -> DataFrame:
    """Two rows for each product: its image (2 x id) and its title (2 x id + 1)."""
    name = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("productDisplayName", "name") if c in products.columns], F.concat(F.lit("Product #"), F.col("id").cast("string")))
    vector = lambda c: F.col(c) if c in products.columns else F.lit(None).cast("array<float>")
    sides = F.array(
        F.struct((F.col("id") * 2).alias("point_id"), F.lit("image").alias("embedding_type"), vector(image_vector).alias("vector")),
        F.struct((F.col("id") * 2 + 1).alias("point_id"), F.lit("title").alias("embedding_type"), vector(title_vector).alias("vector")),
    )
    return products.select(F.col("id").alias("product_id"), name.alias("name"), F.inline(sides))


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The row with the largest version of each key; equal versions: any one of equal rows, else the larger row's hash."""
    order = Window.partitionBy(key).orderBy(F.desc(version), F.desc(F.xxhash64(*[c for c in rows.columns])))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str, version: str | None = None) -> DataFrame:
    """New rows, and old ones whose key isn't among them; with a version, the latest new row of each key counts."""
    fresh = latest(new, key, version) if version else new
    return old.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def retrieve(points: DataFrame, ids: DataFrame, key: str = "point_id") -> DataFrame:
    return points.join(ids.select(key).distinct(), key, "left_semi")


#: Folders of a table that is dealt by product.
BUCKETS = 64


def bucket(product: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(product), F.lit(buckets)).cast("int")


def write_points(points: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """A table of points (point_id, product_id) for lookups: a folder for each bucket of products, sorted by point.

    Both points of a product share a bucket, and a few ids need a few folders.
    """
    dealt = points.withColumn("bucket", bucket(F.col("product_id"), buckets))
    dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", "point_id").write.partitionBy("bucket").parquet(path)


def points_near(spark: SparkSession, path: str, ids: DataFrame, product_of: Column, buckets: int = BUCKETS) -> DataFrame:
    """Those folders of ``write_points`` that may have the wanted products; the driver learns the numbers of the folders alone."""
    wanted = [r[0] for r in ids.where(product_of.isNotNull()).select(bucket(product_of, buckets)).distinct().collect()]
    return spark.read.parquet(path).where(F.col("bucket").isin(wanted)).drop("bucket")


def lookup(spark: SparkSession, path: str, ids: DataFrame, key: str = "point_id", buckets: int = BUCKETS) -> DataFrame:
    """``retrieve`` from a table of ``write_points``: by point_id, or by product_id for all points of a product.

    Ids that aren't there, null and repeated ones give no row more.
    """
    product = F.col(key) if key == "product_id" else F.expr(f"{key} div 2")
    return retrieve(points_near(spark, path, ids, product, buckets), ids, key)


def stats(**tables: DataFrame) -> DataFrame:
    """(collection, n) for each named table."""
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("collection"), "n") for name, t in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def ingest_summary(products: DataFrame, indexed: DataFrame) -> DataFrame:
    """One row: success, indexed_count, total_products."""
    a = products.agg(F.count("*").alias("total_products"))
    b = indexed.agg(F.count_distinct("product_id").alias("indexed_count"))
    return a.crossJoin(b).select((F.col("indexed_count") > 0).alias("success"), "indexed_count", "total_products")
