"""Approximate nearest neighbours by inner product: a navigable small-world hierarchy for each shard, results merged.

Equal vectors are one node, which keeps its smallest ids: no query can need more of them.  A shard's graph is flat
arrays (vectors, and a fixed number of neighbours for each node and level) in one row of the index table, so an index
can be written and read again.  Searching brings the index rows and all queries together by shard; a task loads its
graph and streams the queries past it, batch by batch.  Graphs give candidates; scores are then computed in double
precision on the original vectors with DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.common import column, content_key, keep, ship

#: Rows that one graph takes: some 30 MB at 64 dimensions.  Small tables are cut into SHARDS all the same, for parallel work.
SHARD_ROWS = 65_536
SHARDS = 12
DEGREE = 16
BEAM_BUILD = 64
BEAM_SEARCH = 128
BATCH = 256
#: Scores in single precision that differ by no more than this share count as tied.
TIED = 1e-5


def hash_levels(count: int, seed: int = 11) -> np.ndarray:
    """Level of each node: each level has one in DEGREE of the nodes below."""
    u = np.random.default_rng(seed).random(count)
    return np.minimum(4, (-np.log(u) / np.log(DEGREE)).astype("i4"))


@dataclass
class Layer:
    nodes: np.ndarray  # row numbers in ``vectors``
    links: np.ndarray  # nodes x width, positions in ``nodes``, -1 for none


def beam_search(vectors: np.ndarray, layer: Layer, queries: np.ndarray, entry: np.ndarray, size: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(positions, scores) of the best nodes found, best first, -1 where fewer; all queries advance together."""
    b, n = len(queries), len(layer.nodes)
    seen = np.zeros((b, n), bool)
    ids = np.full((b, size), -1, "i4")
    scores = np.full((b, size), -np.inf, "f4")
    open_ = np.zeros((b, size), bool)
    entry = entry[:, :size]
    width = entry.shape[1]
    ids[:, :width] = entry
    scores[:, :width] = np.where(entry >= 0, np.einsum("bkd,bd->bk", vectors[layer.nodes[entry]], queries), -np.inf)
    open_[:, :width] = entry >= 0
    seen[np.arange(b)[:, None], np.maximum(entry, 0)] = True
    alive = np.arange(b)
    while len(alive):
        order = np.argsort(-np.where(open_[alive], scores[alive], -np.inf), axis=1, kind="stable")[:, :expand]
        rows = alive[:, None]
        chosen = open_[rows, order]
        live = chosen.any(axis=1)
        if not live.all():
            alive, order, chosen = alive[live], order[live], chosen[live]
            rows = alive[:, None]
            if not len(alive):
                break
        open_[rows, order] = False
        near = layer.links[np.where(chosen, ids[rows, order], -1)]
        near = np.where(chosen[:, :, None], near, -1).reshape(len(alive), -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[(near >= 0) & seen[rows, np.maximum(near, 0)]] = -1
        fresh = near >= 0
        r, c = np.nonzero(fresh)
        seen[alive[r], near[r, c]] = True
        new = np.full(near.shape, -np.inf, "f4")
        new[r, c] = np.einsum("kd,kd->k", vectors[layer.nodes[near[r, c]]], queries[alive[r]])
        all_ids = np.concatenate([ids[alive], near], axis=1)
        all_scores = np.concatenate([scores[alive], new], axis=1)
        all_open = np.concatenate([open_[alive], fresh], axis=1)
        best = np.argpartition(-all_scores, size - 1, axis=1)[:, :size]
        at = np.arange(len(alive))[:, None]
        ids[alive], scores[alive], open_[alive] = all_ids[at, best], all_scores[at, best], all_open[at, best]
    order = np.argsort(-scores, axis=1, kind="stable")
    at = np.arange(b)[:, None]
    ids, scores = ids[at, order], scores[at, order]
    return np.where(np.isfinite(scores), ids, -1), scores


def diverse(vectors: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, scores: np.ndarray, width: int) -> np.ndarray:
    """Up to ``width`` of each row's candidates (best first): those nearer to the row than to one taken before, then the rest."""
    b, c = candidates.shape
    taken = np.zeros((b, c), bool)
    own = vectors[nodes[np.maximum(candidates, 0)]]
    between = np.matmul(own, own.transpose(0, 2, 1))
    blocked = ~np.isfinite(scores)
    for j in range(c):
        ok = ~blocked[:, j] & (taken.sum(axis=1) < width)
        taken[:, j] = ok
        blocked |= ok[:, None] & (between[:, j, :] > scores)
    rank = np.where(taken, 0, 1) * c + np.arange(c)
    rank[~np.isfinite(scores)] = 3 * c
    order = np.argsort(rank, axis=1)[:, :width]
    at = np.arange(b)[:, None]
    return np.where(rank[at, order] < 3 * c, candidates[at, order], -1)


def build_layer(vectors: np.ndarray, nodes: np.ndarray, width: int, entries: list[Layer]) -> Layer:
    """Insert the nodes in batches that double in size; a batch searches what is there and its own members."""
    n, half = len(nodes), max(1, width // 2)
    layer = Layer(nodes, np.full((n, width), -1, "i4"))
    position = np.full(len(vectors), -1, "i4")
    position[nodes] = np.arange(n)
    done = 0
    while done < n:
        batch = np.arange(done, min(n, done + max(32, min(BATCH, done))))
        q = vectors[nodes[batch]]
        inner = q @ q.T
        np.fill_diagonal(inner, -np.inf)
        near = min(len(batch), half)
        top = np.argsort(-inner, axis=1, kind="stable")[:, :near]
        ids, scores = batch[top].astype("i4"), np.take_along_axis(inner, top, axis=1)
        ids[~np.isfinite(scores)] = -1
        if done:
            # a few spread starts besides the way down the upper levels, so that no part of the graph is out of reach
            spread = np.tile(np.linspace(0, done - 1, 4).astype("i4"), (len(batch), 1))
            start = descend(vectors, entries, q, position, done)
            start = spread if start is None else np.concatenate([start[:, None], spread], axis=1)
            found, theirs = beam_search(vectors, Layer(nodes[:done], layer.links[:done]), q, dedup(start), BEAM_BUILD)
            ids, scores = np.concatenate([found, ids], axis=1), np.concatenate([theirs, scores], axis=1)
            order = np.argsort(-scores, axis=1, kind="stable")
            ids, scores = np.take_along_axis(ids, order, axis=1), np.take_along_axis(scores, order, axis=1)
        chosen = diverse(vectors, nodes, ids, np.where(ids >= 0, scores, -np.inf), half)
        layer.links[batch, : chosen.shape[1]] = chosen
        link_back(vectors, layer, batch, chosen)
        done += len(batch)
    return layer


def dedup(start: np.ndarray) -> np.ndarray:
    start = np.sort(start, axis=1)
    start[:, 1:][start[:, 1:] == start[:, :-1]] = -1
    return start


def descend(vectors: np.ndarray, entries: list[Layer], q: np.ndarray, position: np.ndarray, below: int) -> np.ndarray | None:
    """For each query the position (in the layer below) of the nearest node of the upper layers that is already there."""
    start = None
    for level, upper in enumerate(entries):
        here = np.zeros((len(q), 1), "i4") if start is None else start[:, None]
        ids, _ = beam_search(vectors, upper, q, here, 8, expand=2)
        if level == len(entries) - 1:
            at = np.where(ids >= 0, position[upper.nodes[np.maximum(ids, 0)]], -1)
            ok = (at >= 0) & (at < below)
            return np.where(ok.any(axis=1), np.take_along_axis(at, ok.argmax(axis=1)[:, None], axis=1)[:, 0], 0).astype("i4")
        lower = entries[level + 1]
        place = np.full(len(vectors), -1, "i4")
        place[lower.nodes] = np.arange(len(lower.nodes))
        start = place[upper.nodes[np.maximum(ids[:, 0], 0)]]
    return start


def link_back(vectors: np.ndarray, layer: Layer, batch: np.ndarray, chosen: np.ndarray) -> None:
    """Add the reverse of new links; a list that overflows is chosen anew."""
    width = layer.links.shape[1]
    r, c = np.nonzero(chosen >= 0)
    to, new = chosen[r, c], batch[r].astype("i4")
    order = np.argsort(to, kind="stable")
    to, new = to[order], new[order]
    heads = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.zeros(0, int)
    counts = np.diff(np.append(heads, len(to)))
    owners = to[heads] if len(to) else to
    for a in range(0, len(owners), 1024):
        own, h, k = owners[a : a + 1024], heads[a : a + 1024], counts[a : a + 1024]
        most = int(k.max())
        at = np.arange(most)[None, :]
        fresh = np.where(at < k[:, None], new[np.minimum(h[:, None] + at, len(new) - 1)], -1)
        fresh[(fresh[:, :, None] == layer.links[own][:, None, :]).any(axis=2)] = -1
        both = np.concatenate([layer.links[own], fresh], axis=1)
        full = (both >= 0).sum(axis=1) > width
        roomy = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)[:, :width]
        layer.links[own[~full]] = roomy[~full]
        if full.any():
            some, mine = both[full], own[full]
            scores = np.einsum("bkd,bd->bk", vectors[layer.nodes[np.maximum(some, 0)]], vectors[layer.nodes[mine]])
            scores[some < 0] = -np.inf
            order = np.argsort(-scores, axis=1, kind="stable")[:, : 2 * width]
            some, scores = np.take_along_axis(some, order, axis=1), np.take_along_axis(scores, order, axis=1)
            layer.links[mine] = diverse(vectors, layer.nodes, some, scores, width)


def build_graph(vectors: np.ndarray) -> list[Layer]:
    """Layers from the top one down to the one with all nodes."""
    levels = hash_levels(len(vectors))
    layers: list[Layer] = []
    for level in range(int(levels.max(initial=0)), -1, -1):
        nodes = np.flatnonzero(levels >= level)
        if level and len(nodes) < 2:
            continue
        layers.append(build_layer(vectors, nodes, DEGREE if level else 2 * DEGREE, layers))
    return layers


def search_graph(vectors: np.ndarray, layers: list[Layer], queries: np.ndarray, k: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row number, score) of the best k found for each query, and of all that are tied with the last of them.

    Where a whole beam is tied, there may be more: these queries, and these alone, meet all vectors of the shard.
    """
    base = layers[-1]
    position = np.arange(len(vectors), dtype="i4")
    start = np.tile(np.linspace(0, len(vectors) - 1, min(8, len(vectors))).astype("i4"), (len(queries), 1))
    if len(layers) > 1:
        start = np.concatenate([descend(vectors, layers[:-1], queries, position, len(vectors))[:, None], start], axis=1)
    ids, scores = beam_search(vectors, base, queries, dedup(start), max(k, size))
    scores = np.where(ids >= 0, scores, -np.inf)
    if ids.shape[1] > k:
        last = scores[:, k - 1]
        bound = np.where(np.isfinite(last), last - TIED * np.abs(last), last)
    else:
        bound = np.full(len(ids), -np.inf)
    full = (ids[:, -1] >= 0) & (scores[:, -1] >= bound) & np.isfinite(bound) & (ids.shape[1] < len(vectors))
    query, column = np.nonzero((ids >= 0) & (scores >= bound[:, None]) & ~full[:, None])
    rows, near = ids[query, column], scores[query, column]
    for q in np.flatnonzero(full).tolist():
        own = vectors @ queries[q]
        tied = np.flatnonzero(own >= bound[q])
        query, rows, near = np.append(query, np.full(len(tied), q)), np.append(rows, tied), np.append(near, own[tied])
    return query, rows, near


INDEX = "shard int, top_norm double, keys binary, vectors binary, levels array<struct<nodes:binary, links:binary>>"


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def distinct_vectors(rows: DataFrame, id_col: str, vector_col: str, ids: int) -> DataFrame:
    """(k1, k2, vector, ids): each different usable vector with its ``ids`` smallest ids.

    Vectors of another length than the most frequent one take no part: there is no inner product with them.
    """
    vector = column(rows, vector_col).cast("array<double>")
    clean = rows.select(column(rows, id_col).cast("long").alias("id"), vector.alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    length = clean.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    clean = clean.where(F.size("vector") == (length["n"] if length else 0))
    keyed = clean.select("id", "vector", *content_key("vector"))
    first = Window.partitionBy("k1", "k2").orderBy("id")
    least = keyed.groupBy("k1", "k2", "id").agg(F.first("vector").alias("vector")).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= ids)
    return least.groupBy("k1", "k2").agg(F.first("vector").alias("vector"), F.array_sort(F.collect_list("id")).alias("ids"))


def build_index(distinct: DataFrame, shard_rows: int = SHARD_ROWS, shards: int = SHARDS) -> DataFrame:
    """One row for each shard: its vectors and the flat neighbour arrays of each level.

    Vectors of unequal norm get one more component that makes all norms equal, which turns the largest inner product
    into the smallest distance; with equal norms it is zero.
    """
    spark = distinct.sparkSession
    ship(spark)
    norm = dot("vector", "vector")
    n, top = distinct.agg(F.count("*"), F.max(norm)).first()
    count = max(shards, -(-n // shard_rows))
    top = top or 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        rows = pa.Table.from_batches(parts)
        keys = np.stack([rows["k1"].to_numpy(), rows["k2"].to_numpy()], axis=1)
        raw = rows["vector"].combine_chunks().flatten().to_numpy().reshape(len(keys), -1).astype("f4")
        own = rows["shard"].to_numpy()
        for shard in np.unique(own).tolist():
            at = np.flatnonzero(own == shard)
            at = at[np.lexsort(keys[at].T)]
            rest = np.sqrt(np.maximum(0, top - (raw[at].astype("f8") ** 2).sum(axis=1)))
            vectors = np.concatenate([raw[at], rest[:, None].astype("f4")], axis=1)
            levels = [{"nodes": x.nodes.astype("i4").tobytes(), "links": x.links.tobytes()} for x in build_graph(vectors)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()), pa.array([top], pa.float64()), pa.array([keys[at].tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary()),
                    pa.array([levels], pa.list_(pa.struct([("nodes", pa.binary()), ("links", pa.binary())]))),
                ],
                ["shard", "top_norm", "keys", "vectors", "levels"],
            )

    placed = distinct.select(F.pmod("k1", F.lit(count)).cast("int").alias("shard"), "k1", "k2", "vector")
    return placed.repartitionById(count, "shard").mapInArrow(run, INDEX)


def search_index(index: DataFrame, queries: DataFrame, k: int, size: int = BEAM_SEARCH) -> DataFrame:
    """(q1, q2, c1, c2, near): for each query vector (k1, k2, vector) the best ``k`` found in every shard, and those tied with the last one."""
    spark = index.sparkSession
    ship(spark)
    loaded = index.select("shard", F.lit(0).alias("kind"), "keys", "vectors", "levels", F.lit(None).cast("long").alias("k1"), F.lit(None).cast("long").alias("k2"), F.lit(None).cast("array<double>").alias("vector"))
    count = (index.agg(F.max("shard")).first()[0] or 0) + 1
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("shard"), F.lit(1).alias("kind"), *[F.lit(None).cast(index.schema[c].dataType).alias(c) for c in ("keys", "vectors", "levels")], "k1", "k2", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graphs = {}
        for batch in batches:
            kind, shard = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            for i in np.flatnonzero(kind == 0).tolist():
                row = batch.slice(i, 1).to_pylist()[0]
                keys = np.frombuffer(row["keys"], "i8").reshape(-1, 2)
                vectors = np.frombuffer(row["vectors"], "f4").reshape(len(keys), -1)
                layers = []
                for x in row["levels"]:
                    nodes = np.frombuffer(x["nodes"], "i4")
                    layers.append(Layer(nodes, np.frombuffer(x["links"], "i4").reshape(len(nodes), -1)))
                graphs[row["shard"]] = (keys, vectors, layers)
            for own, (keys, vectors, layers) in graphs.items():
                at = np.flatnonzero((kind == 1) & (shard == own))
                for a in range(0, len(at), BATCH):
                    part = batch.take(pa.array(at[a : a + BATCH]))
                    q = part.column(7).flatten().to_numpy().reshape(part.num_rows, -1).astype("f4")
                    q = np.concatenate([q, np.zeros((len(q), 1), "f4")], axis=1)
                    r, own_rows, scores = search_graph(vectors, layers, q, k, size)
                    found = keys[own_rows]
                    asking = [part.column(j).to_numpy()[r] for j in (5, 6)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*asking, found[:, 0].copy(), found[:, 1].copy(), scores.astype("f4"))], ["q1", "q2", "c1", "c2", "near"])

    met = loaded.unionByName(asked).repartitionById(count, "shard").sortWithinPartitions("kind")
    return met.mapInArrow(run, "q1 long, q2 long, c1 long, c2 long, near float")


def dot(a: str, b: str) -> Column:
    products = F.zip_with(a, b, lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def nearest(rows: DataFrame, query_ids: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", size: int = BEAM_SEARCH) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that ``query_ids`` picks, the row itself left out.

    Nearness is the inner product in double precision; ties go to the smaller id.  Vectors that are null, empty, zero or
    hold null or non-finite components take no part, nor do rows without an id.  Rows that share an id are never each
    other's neighbours; equal rows count once.  Equal vectors are found together, with the smallest ids first.
    """
    distinct = keep(distinct_vectors(rows, id_col, vector_col, k + 1))
    index = keep(build_index(distinct))
    vector = column(rows, vector_col).cast("array<double>")
    asking = rows.where(query_ids & usable(vector)).select(column(rows, id_col).cast("long").alias("query_id"), *content_key(vector)).distinct()
    wanted = distinct.join(asking.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").select("k1", "k2", "vector")
    own = Window.partitionBy("q1", "q2")
    found = search_index(index, wanted, k + 4, size).withColumn("nth", F.row_number().over(own.orderBy(F.desc("near"), "c1", "c2")))
    found = found.withColumn("last", F.max(F.when(F.col("nth") == k + 1, F.col("near"))).over(own))
    # single precision orders near scores by chance, so all that are about as good as the last one are scored again
    found = found.where((F.col("nth") <= k + 1) | (F.col("near") >= F.col("last") - TIED * F.abs("last")))
    theirs = distinct.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.col("vector").alias("candidate"), "ids")
    own = wanted.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), "vector")
    scored = found.join(theirs, ["c1", "c2"]).join(own, ["q1", "q2"]).select("q1", "q2", dot("vector", "candidate").alias("score"), F.explode("ids").alias("id"))
    order = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "id")
    top = scored.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    lists = top.groupBy("q1", "q2").agg(F.array_sort(F.collect_list(F.struct("nth", "id", "score"))).alias("found"))
    answers = asking.join(lists.withColumnsRenamed({"q1": "k1", "q2": "k2"}), ["k1", "k2"])
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("pos", "x")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score")
    )
