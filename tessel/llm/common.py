"""Small helpers that several training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.session import scratch, table
from tessel.session import ship as ship_package

__all__ = ["LAST_ID", "column", "content_key", "discard", "field", "join_counted", "keep", "pack", "partitions", "scratch", "ship", "table"]

#: A document without an id counts as one document that comes after all others.
LAST_ID = 2**63 - 1


def ship(spark: SparkSession) -> None:
    """Make Python workers ready: they get the package, and texts in batches of rows that stay small with long texts.

    Only Spark's default number of rows in a batch is lowered; a number that the session has set stays.
    """
    ship_package(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def keep(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back: later steps don't depend on its lineage."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._tessel_path = path
    return kept


def discard(kept: DataFrame) -> None:
    """Delete a table from ``keep`` that nothing will read any more."""
    path = kept.sparkSession._jvm.org.apache.hadoop.fs.Path(kept._tessel_path)
    path.getFileSystem(kept.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def column(df: DataFrame, name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return df[f"`{name.replace('`', '``')}`"]


def field(struct: str, name: str) -> Column:
    return F.col(f"{struct}.`{name.replace('`', '``')}`")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, text): the whole input row as one struct, so that no column of it can clash with an operator's own.

    A missing id becomes LAST_ID and a missing text the empty text; ``row`` keeps what was there.
    """
    return df.select(
        F.struct(*[column(df, c) for c in df.columns]).alias("row"),
        F.coalesce(column(df, id_col).cast("long"), F.lit(LAST_ID)).alias("id"),
        F.coalesce(column(df, text_col), F.lit("")).alias("text"),
    )


def content_key(*cols: Column | str) -> list[Column]:
    """128 bits that stand for the value: two 64-bit hashes with different seeds."""
    return [F.xxhash64(*cols).alias("k1"), F.xxhash64(F.lit(0x9E3779B9), *cols).alias("k2")]


#: Keys with at least 1/HOT_KEYS of all rows are hot, so there are at most HOT_KEYS of them; none below HOT_ROWS rows is.
HOT_KEYS, HOT_ROWS = 8192, 1000


def join_counted(rows: DataFrame, keyed: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, which has each key once and in ``n`` how many of the rows have it.

    The rows of hot keys stay where they are and meet a broadcast table of at most HOT_KEYS rows of ``keyed``, so
    no task gets all rows of a key that a third of them has.  All others are shuffled by key.  Both tables are read more
    than once, so they should be written ones.
    """
    total = keyed.agg(F.sum(n)).first()[0] or 0
    least = max(HOT_ROWS, -(-int(total) // HOT_KEYS))
    hot, cold = keyed.where(F.col(n) >= least), keyed.where(F.col(n) < least)
    if hot.isEmpty():
        return rows.join(cold, on)
    others = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(others.join(cold, on))
