"""Catalog files: CSV with a header, a JSON document for each product, and image files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions.text import standard_title

FIELDS = ("id", "gender", "masterCategory", "subCategory", "articleType", "baseColour", "season", "year", "usage", "productDisplayName")
SCHEMA = ", ".join(f"{f} STRING" for f in FIELDS)


#: Where a row of an ordered catalog stands: the file, the beginning of its block, and a number that grows within it.
ORDER = ("_file", "_start", "_line")


def read_catalog(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """All columns as strings; malformed rows are kept with nulls.  ``ordered`` adds where each row stands (``ORDER``)."""
    rows = spark.read.csv(path, header=True, schema=SCHEMA, mode="PERMISSIVE", encoding="UTF-8", escape='"')
    place = (F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return rows.select("*", *[x.alias(c) for x, c in zip(place, ORDER, strict=True)]) if ordered else rows


def valid_products(catalog: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows with an id and a title (blanks collapsed), the id as long; with a limit, the first ones of the file, or by id without an order."""
    title = standard_title(F.col("productDisplayName"))
    rows = catalog.where(F.col("id").isNotNull() & (F.trim(F.col("id").cast("string")) != "")).withColumn("productDisplayName", title).where(F.col("productDisplayName") != "")
    rows = rows.withColumn("id", F.col("id").try_cast("long")).where(F.col("id").isNotNull())
    return first_rows(rows, limit)


def first_rows(rows: DataFrame, limit: int | None) -> DataFrame:
    """The first rows of the catalog, as many as asked for; the columns of ``ORDER`` go."""
    order = [c for c in ORDER if c in rows.columns] or ["id"]
    return (rows if limit is None else rows.orderBy(*order).limit(limit)).drop(*ORDER)


def read_styles(spark: SparkSession, path: str) -> DataFrame:
    """(id, description) from files named by id; unreadable or missing descriptions are empty."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return files.select(F.regexp_extract("file", r"(\d+)\.json$", 1).cast("long").alias("id"), description(F.col("value")).alias("description"))


def description(json):
    """The nested description value of a style document, empty on any failure."""
    return F.coalesce(F.get_json_object(json, "$.data.productDescriptors.description.value"), F.lit(""))


def with_descriptions(products: DataFrame, styles: DataFrame) -> DataFrame:
    return products.join(styles, "id", "left").withColumn("description", F.coalesce("description", F.lit("")))


def with_readable_images(products: DataFrame, files: DataFrame) -> DataFrame:
    """Products whose image is among the files (id)."""
    return products.join(files.select("id").distinct(), "id", "left_semi")


def number_in(path: Column) -> Column:
    return F.regexp_extract(path, r"(\d+)\.\w+$", 1).try_cast("long")


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """(id, image): images that can be decoded, by the number in their name; others are left out."""
    images = spark.read.format("image").option("dropInvalid", True).load(path)
    return images.select(number_in(F.col("image.origin")).alias("id"), "image").where(F.col("id").isNotNull())


# How files of an image format begin and end, in hexadecimal digits.
FORMATS = {"jpeg": ("FFD8FF", "FFD9"), "png": ("89504E470D0A1A0A", "0000000049454E44AE426082"), "gif": ("47494638", "3B")}


def image_format(content: Column) -> Column:
    """The format of which a file has both the beginning and the end; null for empty, truncated and foreign files."""
    size = F.octet_length(content)
    out = F.lit(None).cast("string")
    for name, (begin, end) in FORMATS.items():
        a, b = len(begin) // 2, len(end) // 2
        whole = (size >= a + b) & (F.hex(F.substring(content, 1, a)) == begin) & (F.hex(F.substring(content, -b, b)) == end)
        out = F.when(whole, F.lit(name)).otherwise(out)
    return out


def readable_images(spark: SparkSession, path: str) -> DataFrame:
    """(id, format, length) of files that look whole, by the number in their name.  Nothing is decoded: see ``image_files`` for that."""
    files = spark.read.format("binaryFile").load(path)
    found = files.select(number_in(F.col("path")).alias("id"), image_format(F.col("content")).alias("format"), "length")
    return found.where(F.col("id").isNotNull() & F.col("format").isNotNull())


def write_sample(spark: SparkSession, path: str, form: str = "csv") -> None:
    """A small catalog with the same schema, unless something is there."""
    kinds = [("Men", "Apparel", "Topwear", "Shirts", "Blue", "Casual"), ("Women", "Apparel", "Dress", "Dresses", "Red", "Party"), ("Unisex", "Accessories", "Watches", "Watches", "Black", "Formal"), ("Men", "Footwear", "Shoes", "Sports Shoes", "White", "Sports"), ("Women", "Accessories", "Bags", "Handbags", "Brown", "Casual")]
    rows = [(str(1000 + 5 * r + i), g, m, s, a, c, "Summer", str(2012 + r), u, f"{c} {a} number {r}") for r in range(3) for i, (g, m, s, a, c, u) in enumerate(kinds)]
    writer = spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("ignore")
    writer.option("header", True).csv(path) if form == "csv" else writer.json(path)


def parse_request(body, schema: str, **defaults):
    """A JSON body as a struct with defaults; a malformed body is an empty one."""
    parsed = F.from_json(body, schema, {"mode": "PERMISSIVE"})
    return F.struct(*[F.coalesce(parsed[k], F.lit(v)).alias(k) for k, v in defaults.items()])
