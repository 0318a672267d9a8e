"""Session helpers shared by every part of the library."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED = "_tessel_shipped"
_SCRATCH = "_tessel_scratch"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per context, as ``--py-files`` would."""
    context = spark.sparkContext
    if getattr(context, _SHIPPED, False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tessel-ship-")
    target = os.path.join(folder, "tessel_lib.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(target)
    setattr(context, _SHIPPED, True)


def ship_active() -> None:
    """The same for the session in use: for functions that make columns and get no session."""
    if session := SparkSession.getActiveSession():
        ship(session)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder path below ``spark.checkpoint.dir``, which the driver and all executors must share.

    Where it is unset, a local folder serves if the master is local; on a cluster that would lose rows, so it is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = getattr(spark.sparkContext, _SCRATCH, None) or f"file://{tempfile.mkdtemp(prefix='tessel-scratch-')}"
        setattr(spark.sparkContext, _SCRATCH, base)
    return f"{base.rstrip('/')}/tessel-{uuid.uuid4().hex}"


def filesystem(spark: SparkSession, path: str):
    """The file system of a path, as Spark reaches it, and the path for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the scratch folder: what is computed once and read several times."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows for each task of ``spread``.
SPREAD_ROWS = 20_000


def tasks_for(spark: SparkSession, n: int, rows: int = SPREAD_ROWS) -> int:
    """Tasks of about so many rows for n of them, two for each core at least."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-n // rows))


def spread(df: DataFrame, key: str, rows: int = SPREAD_ROWS) -> DataFrame:
    """The rows dealt by a key into tasks of about so many, for work that is far larger than the bytes of the rows.

    A scan makes tasks by the bytes of its files, which may be one for a million rows.
    """
    return df.repartition(tasks_for(df.sparkSession, df.count(), rows), key)
