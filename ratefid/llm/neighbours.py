"""Approximate nearest neighbours by robust-pruned directed graphs, one a shard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

#: Distinct vectors of a shard, and queries of a block that meets a shard.
SHARD, BLOCK = 8192, 4096
#: Out-edges of a node; width of the beam while building and while searching.
DEGREE, BUILD_BEAM, BEAM = 24, 48, 96
#: An edge goes if a kept neighbour is so many times nearer to its end than the node is.
SLACK = 1.2


def lifted(vectors: np.ndarray) -> np.ndarray:
    """One more component makes all norms equal: the nearest point then has the largest inner product."""
    norms = np.einsum("ij,ij->i", vectors, vectors)
    return np.hstack([vectors, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]]).astype(np.float32)


def beam_search(points: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, width: int, seen_out: bool = False):
    """The ``width`` nearest points met by each query, nearest first (-1: none), searched greedily for all queries at once."""
    n, b = len(points), len(queries)
    norms = np.einsum("ij,ij->i", points, points)
    seen = np.zeros((b, n + 1), bool)
    row = np.arange(b)[:, None]
    ids = np.full((b, width), -1, np.int64)
    far = np.full((b, width), np.inf, np.float32)
    done = np.ones((b, width), bool)
    m = min(len(entries), width)
    ids[:, :m], done[:, :m] = entries[:m], False
    far[:, :m] = norms[entries[:m]] - 2 * queries @ points[entries[:m]].T
    seen[:, entries[:m]] = True
    while True:
        order = np.argsort(far, axis=1, kind="stable")
        ids, far, done = ids[row, order], far[row, order], done[row, order]
        live = np.flatnonzero(~done.all(axis=1))
        if not len(live):
            break
        pick = np.argmin(done[live], axis=1)
        done[live, pick] = True
        near = graph[ids[live, pick]]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        dist = norms[near] - 2 * np.einsum("brd,bd->br", points[near], queries[live])
        dist[~fresh] = np.inf
        # The worst of the beam give way to what is nearer.
        all_far = np.concatenate([far[live], dist], axis=1)
        keep = np.argpartition(all_far, width - 1, axis=1)[:, :width]
        at = np.arange(len(live))[:, None]
        far[live] = all_far[at, keep]
        ids[live] = np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1)[at, keep]
        done[live] = np.concatenate([done[live], ~fresh], axis=1)[at, keep]
        done[live] |= ~np.isfinite(far[live])
    ids[~np.isfinite(far)] = -1
    return (ids, seen) if seen_out else ids


def robust_prune(points: np.ndarray, node: int, near: np.ndarray, degree: int, slack: float) -> np.ndarray:
    """The nearest candidate stays and removes those that it is clearly nearer to than the node is; then the next."""
    near = near[(near >= 0) & (near != node)]
    near = np.unique(near)
    own = ((points[near] - points[node]) ** 2).sum(axis=1)
    order = np.argsort(own, kind="stable")
    near, own = near[order], own[order]
    among = own_pairs(points[near])
    alive, kept = np.ones(len(near), bool), []
    for i in range(len(near)):
        if alive[i]:
            kept.append(i)
            if len(kept) == degree:
                break
            alive &= slack * slack * among[i] > own
    return near[kept]


def own_pairs(x: np.ndarray) -> np.ndarray:
    squares = np.einsum("ij,ij->i", x, x)
    return np.maximum(squares[:, None] + squares[None, :] - 2 * x @ x.T, 0)


def build_graph(points: np.ndarray, degree: int = DEGREE, width: int = BUILD_BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Out-neighbours of each point (-1: none), and the points at which a search begins."""
    n = len(points)
    graph = np.full((n, degree), -1, np.int64)
    rng = np.random.default_rng(n)
    if n <= degree + 1:
        for i in range(n):
            graph[i, : n - 1] = np.delete(np.arange(n), i)
        return graph, np.arange(min(n, 4))
    graph[:] = rng.integers(0, n, (n, degree))
    graph[graph == np.arange(n)[:, None]] = -1
    middle = int(np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1)))
    entries = np.unique(np.append(rng.choice(n, min(n, 7), replace=False), middle))
    for slack in (1.0, SLACK):
        for part in np.array_split(rng.permutation(n), max(1, n // 256)):
            found = beam_search(points, graph, entries, points[part], width)
            incoming: dict[int, list[int]] = {}
            for i, near in zip(part, found, strict=True):
                kept = robust_prune(points, i, np.concatenate([near, graph[i]]), degree, slack)
                graph[i] = -1
                graph[i, : len(kept)] = kept
                for j in kept:
                    incoming.setdefault(int(j), []).append(int(i))
            for j, more in incoming.items():
                held = graph[j][graph[j] >= 0]
                every = np.union1d(held, more)
                if len(every) > degree:
                    every = robust_prune(points, j, every, degree, slack)
                graph[j] = -1
                graph[j, : len(every)] = every
    return graph, entries


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def _build(table: pa.Table) -> pa.Table:
    vectors = _matrix(table.column("vector"))
    graph, entries = build_graph(lifted(vectors))
    ids = table.column("ids").combine_chunks()
    ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
    return pa.table(
        {
            "dim": pa.array([vectors.shape[1]], pa.int32()),
            "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()),
            "vectors": pa.array([vectors.tobytes()], pa.binary()),
            "graph": pa.array([graph.astype(np.int32).tobytes()], pa.binary()),
            "entries": pa.array([entries.astype(np.int32).tobytes()], pa.binary()),
            "ids": pa.array([ids.flatten().to_numpy().tobytes()], pa.binary()),
            "sizes": pa.array([ids.value_lengths().to_numpy().astype(np.int32).tobytes()], pa.binary()),
        }
    )


def _search(k: int):
    def job(shards: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if shards.num_rows and asked.num_rows:
            shard = {c: shards.column(c)[0].as_py() for c in shards.column_names}
            vectors = np.frombuffer(shard["vectors"], np.float64).reshape(-1, shard["dim"])
            graph = np.frombuffer(shard["graph"], np.int32).reshape(len(vectors), -1).astype(np.int64)
            entries = np.frombuffer(shard["entries"], np.int32).astype(np.int64)
            ids, sizes = np.frombuffer(shard["ids"], np.int64), np.frombuffer(shard["sizes"], np.int32)
            ends = np.cumsum(sizes)
            queries, names, points = _matrix(asked.column("vector")), asked.column("query_id").to_numpy(), lifted(vectors)
            for at in range(0, len(queries), 256):
                part = queries[at : at + 256]
                flat = np.hstack([part, np.zeros((len(part), 1))]).astype(np.float32)
                found = beam_search(points, graph, entries, flat, max(BEAM, 3 * k))
                for q, name, near in zip(part, names[at : at + 256], found, strict=True):
                    near = near[near >= 0]
                    score = (vectors[near] * q).sum(axis=1)
                    # All that tie with the last of the best stay, until ids settle it.
                    last = np.sort(score)[-(k + 1)] if len(near) > k else -np.inf
                    best, score = near[score >= last], score[score >= last]
                    rows = np.concatenate([ids[ends[i] - sizes[i] : ends[i]] for i in best]) if len(best) else ids[:0]
                    each = np.repeat(score, sizes[best])
                    other = rows != name
                    rows, each = rows[other], each[other]
                    top = np.lexsort((rows, -each))[:k]
                    out["query_id"] += [int(name)] * len(top)
                    out["vec_id"] += rows[top].tolist()
                    out["score"] += each[top].tolist()
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    return job


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` the ``k`` rows of ``vectors`` with the largest inner product found.

    Both tables have vec_id and embedding; a query never finds its own vec_id. Equal vectors are one node of a graph, which holds
    their k + 1 smallest ids, all that any answer can need; the graphs cover every distinct vector, at most about SHARD in one. A
    block of queries is beam-searched in each shard, and the k best of all shards stay. Vectors that are null, zero or hold a
    null or non-finite component take no part; nor do rows without vec_id. Vectors only meet others of the same length.
    Repeated rows of a vec_id count once. Ties go to the smaller vec_id. Other columns are not read. Empty tables give no rows.
    """
    rows = _usable(vectors).distinct()
    order = Window.partitionBy("vector").orderBy("vec_id")
    copies = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    nodes = written(copies.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vector-nodes")
    dim = F.size("vector").cast("int").alias("dim")
    n_shards = max(1, -(-nodes.count() // SHARD))
    shard = F.pmod(F.xxhash64("vector"), F.lit(n_shards)).cast("int")
    index = nodes.select(dim, shard.alias("shard"), "vector", "ids").groupBy("dim", "shard").applyInArrow(
        _build, "dim int, shard int, vectors binary, graph binary, entries binary, ids binary, sizes binary"
    )
    index = written(index, "vector-graphs")
    asked = _usable(queries).distinct().withColumnRenamed("vec_id", "query_id")
    n_blocks = max(1, -(-asked.count() // BLOCK))
    block = F.pmod(F.xxhash64("query_id", "vector"), F.lit(n_blocks)).cast("int")
    asked = asked.select("query_id", "vector", dim, block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"))
    index = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    pair = ["dim", "shard", "block"]
    found = index.groupBy(*pair).cogroup(asked.groupBy(*pair)).applyInArrow(_search(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _usable(vectors: DataFrame) -> DataFrame:
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("vector", lambda x: x != 0))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth id among all rows; unusable vectors, ties, repeats and empty tables as ``nearest`` says."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
