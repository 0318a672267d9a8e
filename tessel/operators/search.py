"""Vector search over product points, and fusion of image and title hits.

Points are (point_id, vector) with product = point_id div 2 and type = point_id mod 2 (0 image, 1 title).  One query is a
one-row table and is broadcast; a batch of queries is broadcast if its size allows, and the points stream past; else both meet in a grid.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessel.functions.scores import fuse_mean, fuse_ranks, fuse_weighted
from tessel.functions.vector import dot
from tessel.session import ship

#: Bytes of query vectors that are broadcast at once.
QUERY_BYTES = 64_000_000
#: Best hits of all queries that a task keeps, of 16 bytes each.
KEPT_HITS = 4_000_000
#: Parts in which what tasks have found for a query is merged first.
MERGES = 16


def scored(points: DataFrame, query: DataFrame, id_col: str = "point_id", vector_col: str = "vector") -> DataFrame:
    """Every point with its dot product with the one query row (column ``query``)."""
    return points.crossJoin(F.broadcast(query.select("query").limit(1))).select(
        F.col(id_col), dot(F.col(vector_col), F.col("query")).alias("score")
    )


def top_hits(points: DataFrame, query: DataFrame, n: int, id_col: str = "point_id", vector_col: str = "vector") -> DataFrame:
    """The n best points with their 1-based ``rank``: partial top-n in tasks, so one task sees n rows of each other."""
    best = scored(points, query, id_col, vector_col).orderBy(F.desc("score"), id_col).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))


class Best:
    """The k best (score, id) so far of each of n queries, ties to the smaller id: two arrays of n x k, and nothing else that grows."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.floor = np.full(n, -np.inf)  # a score below the k-th best can't come in any more
        self.scores, self.ids, self.count = np.zeros((n, k)), np.zeros((n, k), "i8"), np.zeros(n, "i8")

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of queries from ``first`` on (rows) with points (columns)."""
        floor = self.floor[first : first + len(scores)]
        if scores.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(scores, -self.k, axis=1)[:, -self.k])
        row, column = np.nonzero(scores >= floor[:, None])
        if not len(row):
            return
        some = np.unique(row)
        own, nth = np.nonzero(np.arange(self.k) < self.count[some + first, None])
        query = np.concatenate([some[own], row]) + first
        score = np.concatenate([self.scores[some[own] + first, nth], scores[row, column]])
        names = np.concatenate([self.ids[some[own] + first, nth], ids[column]])
        order = np.lexsort((names, -score, query))
        query, score, names = query[order], score[order], names[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        kept = nth < self.k
        query, nth = query[kept], nth[kept]
        self.scores[query, nth], self.ids[query, nth] = score[kept], names[kept]
        np.maximum.at(self.count, query, nth + 1)
        full = query[nth == self.k - 1]
        self.floor[full] = self.scores[full, -1]

    def meet(self, queries: np.ndarray, ids: np.ndarray, points: np.ndarray) -> None:
        """All queries with these points, in slices that bound the matrix of scores."""
        if len(queries) and len(ids):
            step = max(1, 2_000_000 // len(points))
            for a in range(0, len(queries), step):
                self.add(a, queries[a : a + step] @ points.T, ids)

    def rows(self, step: int = 2_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, score, id) of the best, ordered, for so many queries at once."""
        for a in range(0, len(self.floor), step):
            own, nth = np.nonzero(np.arange(self.k) < self.count[a : a + step, None])
            yield own + a, self.scores[own + a, nth], self.ids[own + a, nth]


def matrix_of(column: pa.Array) -> np.ndarray:
    """A column of vectors of one length as a matrix, without a Python object for each number."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def batch_top_hits(
    points: DataFrame, queries: DataFrame, k: int, id_col: str = "point_id", vector_col: str = "vector", block_bytes: int = QUERY_BYTES
) -> DataFrame:
    """(query_id, point_id, score, rank): the k best points of each query (query_id, query), in double precision.

    Up to ``block_bytes`` of query vectors with ``KEPT_HITS`` hits, counted first, are broadcast, and points stream past them in one scan: a task keeps the k
    best of each query.  More of them meet the points in a grid (see ``grid_top_hits``).  Either way the k best of each task or cell are
    merged in two levels.  Rows without a vector take no part.
    """
    spark = points.sparkSession
    ship(spark)
    asked = queries.where(F.col("query").isNotNull()).select(F.col("query_id"), F.col("query").cast("array<double>").alias("query"))
    size, number = asked.agg(F.coalesce(F.sum(8 * F.size("query")), F.lit(0)), F.count("*")).first()
    rows = points.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("point_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    if size > block_bytes or number * k > KEPT_HITS:
        return grid_top_hits(rows, asked, k, block_bytes)
    shared = spark.sparkContext.broadcast(asked.toArrow())  # block_bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        names, q = table["query_id"], matrix_of(table["query"].combine_chunks())
        best = Best(len(q), k)
        for batch in batches:
            best.meet(q, batch.column(0).to_numpy(), matrix_of(batch.column(1)))
        yield from found_rows(best, names)

    found = rows.mapInArrow(run, f"query_id {asked.schema['query_id'].dataType.simpleString()}, point_id long, score double")
    return merged(found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGES))), k)


def found_rows(best: Best, names: pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
    names = names.combine_chunks()
    for query, score, ids in best.rows():
        yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), pa.array(ids), pa.array(score)], ["query_id", "point_id", "score"])


def merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of (query_id, point_id, score) with their rank: first of each ``part``, so no task sees what all have found."""
    best = lambda *keys: Window.partitionBy("query_id", *keys).orderBy(F.desc("score"), "point_id")
    some = found.withColumn("rank", F.row_number().over(best("part"))).where(F.col("rank") <= k).drop("part")
    return some.withColumn("rank", F.row_number().over(best())).where(F.col("rank") <= k)


def grid_top_hits(points: DataFrame, queries: DataFrame, k: int, block_bytes: int = QUERY_BYTES) -> DataFrame:
    """``batch_top_hits`` for any number of queries (query_id, query) and points (point_id, vector): none of them passes the driver.

    Queries and points are dealt into blocks of some ``block_bytes``; a cell of the grid is a task that gets one block of each.  So
    queries are copied once for each block of points and points once for each block of queries, and a cell needs two blocks of memory
    and the k best of its queries, ``KEPT_HITS`` in all.
    """
    ship(points.sparkSession)
    bytes_of = lambda df, c: int(df.agg(F.coalesce(F.sum(8 * F.size(c)), F.lit(0))).first()[0])
    across, down = (max(1, -(-bytes_of(df, c) // block_bytes)) for df, c in ((queries, "query"), (points, "vector")))
    across = max(across, -(-queries.count() * k // KEPT_HITS))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("query_id", "query", dealt("query_id", across).alias("q"), every(down).alias("p"))
    p = points.select("point_id", "vector", dealt("point_id", down).alias("p"), every(across).alias("q"))

    def cell(asked: pa.Table, own: pa.Table) -> pa.Table:
        names, best = asked["query_id"], Best(asked.num_rows, k)
        rows = matrix_of(asked["query"].combine_chunks())
        for batch in own.to_batches(max_chunksize=10_000):
            best.meet(rows, batch["point_id"].to_numpy(), matrix_of(batch["vector"]))
        out = pa.Table.from_batches(found_rows(best, names), names_schema)
        part = pa.repeat(pa.scalar(own["p"][0].as_py() % MERGES if own.num_rows else 0, pa.int32()), out.num_rows)
        return out.append_column("part", part)

    names_schema = pa.schema([("query_id", to_arrow_type(queries.schema["query_id"].dataType)), ("point_id", pa.int64()), ("score", pa.float64())])
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, point_id long, score double, part int"
    return merged(q.groupBy("q", "p").cogroup(p.groupBy("q", "p")).applyInArrow(cell, schema), k)


def split_points(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(point_id, product_id, is_title, vector) from ids whose half is the product and whose parity is the type."""
    return embeddings.select(
        F.col(id_col).alias("point_id"), F.expr(f"{id_col} div 2").alias("product_id"), (F.col(id_col) % 2 == 1).alias("is_title"), F.col(vector_col).alias("vector")
    )


def group_hits(hits: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row for each product of (product_id, is_title, score, rank): best score and first rank of each type, and its place.

    ``keys`` tell the hits of several queries apart.
    """
    image, title = ~F.col("is_title"), F.col("is_title")
    return hits.groupBy(*keys, "product_id").agg(
        F.max(F.when(image, F.col("score"))).alias("image_score"),
        F.max(F.when(title, F.col("score"))).alias("title_score"),
        F.min(F.when(image, F.col("rank"))).alias("image_rank"),
        F.min(F.when(title, F.col("rank"))).alias("title_rank"),
        F.min("rank").alias("place"),
    )


def merge_modalities(unified: DataFrame, images: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Full outer merge of grouped unified hits and image hits (product_id, score, rank), which has a product once.

    The better image score and the unified image rank win; products of the image list alone come after all others.
    """
    late = images.select(*keys, "product_id", F.col("score").alias("late_score"), F.col("rank").alias("late"))
    return (
        unified.join(late, [*keys, "product_id"], "full_outer")
        .withColumn("image_score", F.greatest("image_score", "late_score"))
        .withColumn("image_rank", F.coalesce("image_rank", "late"))
        .withColumn("seq", F.coalesce(F.col("place"), F.lit(1 << 30) + F.col("late")))
        .drop("late", "late_score", "place")
    )


def fill_counterparts(merged: DataFrame, points: DataFrame, queries: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Look up the missing side's point and score it; a side without a point scores 0.  Ranks stay as they are.

    Without keys, ``queries`` is the one query row; else it has a row (keys, query) for each query.
    """
    wanted = merged.where(F.col("image_score").isNull() | F.col("title_score").isNull()).select(*keys, "product_id")
    sides = points.join(wanted, "product_id")
    sides = sides.join(queries.select(*keys, "query"), list(keys)) if keys else sides.crossJoin(F.broadcast(queries.select("query").limit(1)))
    sides = sides.withColumn("score", dot(F.col("vector"), F.col("query")))
    known = sides.groupBy(*keys, "product_id").agg(
        F.max(F.when(~F.col("is_title"), F.col("score"))).alias("own_image"), F.max(F.when(F.col("is_title"), F.col("score"))).alias("own_title")
    )
    return (
        merged.join(known, [*keys, "product_id"], "left")
        .withColumn("image_score", F.coalesce("image_score", "own_image", F.lit(0.0)))
        .withColumn("title_score", F.coalesce("title_score", "own_title", F.lit(0.0)))
        .drop("own_image", "own_title")
    )


def fused(rows: DataFrame, mode: str, strategy: str, pool: int, weights: tuple[float, float] | None = None) -> Column:
    image, title = F.col("image_score"), F.col("title_score")
    if strategy == "rrf":
        return fuse_ranks(F.col("image_rank"), F.col("title_rank"), pool + 1)
    if strategy == "score_fusion":
        return fuse_mean(image, title)
    return fuse_weighted(image, title, mode, weights)


def search_unified(
    points: DataFrame, query: DataFrame, mode: str = "image", top_k: int | None = 10, candidate_pool: int = 100, strategy: str = "weighted_sum", weights: tuple[float, float] | None = None
) -> DataFrame:
    """(product_id, rank, final_score, image_score, title_score, image_rank, title_rank), best first.

    ``points`` are as from ``split_points``.  Scores are rounded to four digits before they are ordered; ties keep the
    order of the hits.  ``top_k`` None gives all candidates; below 1 is an error.
    """
    pool = pool_size(top_k, candidate_pool)
    hits = top_hits(points, query, pool)
    images = top_hits(points.where(~F.col("is_title")), query, pool)
    return _fuse_hits(hits, images, points, query, mode, top_k, pool, strategy, weights, ())


def search_unified_batch(
    points: DataFrame, queries: DataFrame, mode: str = "image", top_k: int | None = 10, candidate_pool: int = 100, strategy: str = "weighted_sum", weights: tuple[float, float] | None = None
) -> DataFrame:
    """``search_unified`` for each row of ``queries`` (query_id, query): its rows, with the query_id before them."""
    pool = pool_size(top_k, candidate_pool)
    hits = batch_top_hits(points, queries, pool)
    images = batch_top_hits(points.where(~F.col("is_title")), queries, pool)
    return _fuse_hits(hits, images, points, queries, mode, top_k, pool, strategy, weights, ("query_id",))


def pool_size(top_k: int | None, candidate_pool: int) -> int:
    if top_k is not None and top_k < 1:
        raise ValueError("top_k must be at least 1")
    return max(candidate_pool, 8 * (top_k or 1))


def _fuse_hits(hits, images, points, queries, mode, top_k, pool, strategy, weights, keys) -> DataFrame:
    hits = hits.withColumn("product_id", F.expr("point_id div 2")).withColumn("is_title", F.col("point_id") % 2 == 1)
    images = images.withColumn("product_id", F.expr("point_id div 2"))
    rows = fill_counterparts(merge_modalities(group_hits(hits, keys), images, keys), points, queries, keys)
    rows = rows.withColumn("final_score", F.round(fused(rows, mode, strategy, pool, weights), 4))
    order = (Window.partitionBy(*keys) if keys else Window).orderBy(F.desc("final_score"), "seq", "product_id")  # two pools of rows at most
    ranked = rows.withColumn("rank", F.row_number().over(order))
    out = ranked if top_k is None else ranked.where(F.col("rank") <= top_k)
    return out.select(
        *keys, "product_id", "rank", "final_score", F.round("image_score", 4).alias("image_score"), F.round("title_score", 4).alias("title_score"), "image_rank", "title_rank"
    )


def best_chunks(image_hits: DataFrame, chunk_hits: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Candidates of a contextual search, one row for each product: (product_id, image_score, text_score, best_chunk, seq).

    Image hits (product_id, score, rank) come first, clamped at 0; of a product's chunk hits (product_id, score, rank, text)
    the best counts, the earlier one on ties.  On a product that images found only chunks above 0 count.  ``keys`` tell the
    hits of several queries apart.
    """
    chunks = chunk_hits.where(F.coalesce(F.col("product_id"), F.lit(0)) != 0)
    best = chunks.groupBy(*keys, "product_id").agg(
        F.max("score").alias("own_text"), F.max_by("text", F.struct("score", -F.col("rank"))).alias("own_chunk"), F.min("rank").alias("late")
    )
    images = image_hits.groupBy(*keys, "product_id").agg(F.greatest(F.lit(0.0), F.max("score")).alias("own_image"), F.min("rank").alias("early"))
    rows = images.join(best, [*keys, "product_id"], "full_outer")
    counts = F.col("early").isNull() | (F.col("own_text") > 0)
    return rows.select(
        *keys,
        "product_id",
        F.coalesce("own_image", F.lit(0.0)).alias("image_score"),
        F.coalesce(F.when(counts, F.greatest(F.lit(0.0), F.col("own_text"))), F.lit(0.0)).alias("text_score"),
        F.coalesce(F.when(counts, F.col("own_chunk")), F.lit("")).alias("best_chunk"),
        F.coalesce(F.col("early"), F.lit(1 << 30) + F.col("late")).alias("seq"),
    )


def image_floor(rows: DataFrame, floor: float = 0.38, keys: tuple[str, ...] = ()) -> DataFrame:
    """All rows, or none if the best image score (of each key) is below the floor."""
    if keys:
        return rows.withColumn("best_image", F.max("image_score").over(Window.partitionBy(*keys))).where(F.col("best_image") >= floor).drop("best_image")
    best = rows.agg(F.max("image_score").alias("best_image"))
    return rows.crossJoin(F.broadcast(best)).where(F.col("best_image") >= floor).drop("best_image")
