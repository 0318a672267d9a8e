"""Which builds of an index count: a reader sees whole builds only, whatever else is being written or was left behind.

Every build writes its rows to folders of its own, ``<path>/<table>/build=<name>``.  A commit is one small file that lists the builds
that count; the one with the highest number holds.  Names sort by age, so the latest row of a key is that of the last name.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessel.session import filesystem

FOLDER = "_commits"


def committed(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """The number of the last commit and its builds, oldest first; (-1, []) where there is none."""
    fs, at = filesystem(spark, f"{path}/{FOLDER}")
    numbers = [int(f.getPath().getName()[:-5]) for f in fs.listStatus(at) if f.getPath().getName().endswith(".json")] if fs.exists(at) else []
    if not numbers:
        return -1, []
    stream = fs.open(filesystem(spark, f"{path}/{FOLDER}/{max(numbers):08d}.json")[1])
    try:
        return max(numbers), json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, change: Callable[[list[str]], list[str]]) -> list[str]:
    """Let ``change`` make the new list of builds from the one that holds; it is asked again if another commit came first."""
    while True:
        number, builds = committed(spark, path)
        new = change(builds)
        fs, draft = filesystem(spark, f"{path}/{FOLDER}/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        target = filesystem(spark, f"{path}/{FOLDER}/{number + 1:08d}.json")[1]
        if not fs.exists(target) and fs.rename(draft, target):
            return new
        fs.delete(draft, False)


def new_build(spark: SparkSession, path: str) -> str:
    """A name after those of all builds so far."""
    return f"{committed(spark, path)[0] + 1:08d}-{uuid.uuid4().hex}"


def create_if_absent(spark: SparkSession, path: str) -> None:
    """An index without builds, unless there is one."""
    if committed(spark, path)[0] < 0:
        commit(spark, path, lambda builds: builds)


def reset(spark: SparkSession, path: str) -> None:
    """No build counts any more; what is there is removed."""
    commit(spark, path, lambda builds: [])
    vacuum(spark, path)


def versions(spark: SparkSession, path: str, table: str) -> DataFrame | None:
    """All rows of a table's builds that count, with their ``build``; none without such rows."""
    fs, _ = filesystem(spark, path)
    folders = [f"{path}/{table}/build={b}" for b in committed(spark, path)[1]]
    there = [f for f in folders if fs.exists(filesystem(spark, f)[1])]
    return spark.read.option("basePath", f"{path}/{table}").parquet(*there) if there else None


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Remove the folders of builds that don't count: failed ones, and those that were compacted.  No build may be running."""
    kept, removed = set(committed(spark, path)[1]), []
    fs, at = filesystem(spark, path)
    for table in [f.getPath() for f in fs.listStatus(at) if f.isDirectory() and f.getPath().getName() != FOLDER]:
        for f in fs.listStatus(table):
            name = f.getPath().getName()
            if name.startswith("build=") and name[6:] not in kept:
                fs.delete(f.getPath(), True)
                removed.append(f"{table.getName()}/{name}")
    return sorted(removed)
