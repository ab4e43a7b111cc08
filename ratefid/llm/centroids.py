"""Centroid clustering in integers, all of it in expressions of the JVM: no Python touches a vector."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 40, 5, 64, 256, 2
#: Components saturate here, so that a squared distance of up to 64 components fits in 64 bits.
MOST = 1 << 27


def integer_vector(vector: Column, dimensions: int = DIMENSIONS, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, as double, within +-2**27; null unless there are ``dimensions``, all of them finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    low, high = F.lit(-float(MOST)), F.lit(float(MOST))
    whole = F.transform(vector, lambda x: F.floor(F.greatest(low, F.least(high, x.cast("double") * scale))))
    return F.when((F.size(vector) == dimensions) & ~bad, whole)


def nearest(vector: Column, centroids: list[list[int]]) -> Column:
    """struct(distance, cluster) of the nearest centroid by squared Euclidean distance, ties to the smaller number.

    The centroids are literals with their squared lengths: |v|^2 + |c|^2 - 2 v c, in exact integers.
    """
    total = lambda products: F.aggregate(products, F.lit(0).cast("long"), lambda s, p: s + p)
    literal = "array({})".format(
        ",".join(
            f"struct({n} AS cluster, {sum(x * x for x in c)}L AS square, array({','.join(f'{x}L' for x in c)}) AS centre)" for n, c in enumerate(centroids)
        )
    )
    own = total(F.transform(vector, lambda x: x * x))
    dots = F.transform(F.expr(literal), lambda c: F.struct((c["square"] - 2 * total(F.zip_with(vector, c["centre"], lambda x, y: x * y))).alias("part"), c["cluster"].alias("cluster")))
    best = F.array_min(dots)
    return F.struct((own + best["part"]).alias("distance"), best["cluster"].alias("cluster"))


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors whose ``seed:id`` have the smallest SHA-256, in that order; rows that share an id go by their components, null ids last."""
    picked = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.select(picked.alias("picked"), "v").orderBy(F.col("picked").asc_nulls_last(), "v").limit(clusters)
    return [list(r.v) for r in rows.collect()]  # ``clusters`` rows


def trained(vectors: DataFrame, centroids: list[list[int]], rounds: int) -> list[list[int]]:
    """``rounds`` of assignment and exact floored means; an empty centroid stays. One row a cluster reaches the driver in each round.

    The sums are columns of one hash aggregate, so they are added up in generated code before the shuffle, and a cluster that
    has most of the rows shuffles one row a task like any other.
    """
    for _ in range(rounds):
        sums = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(len(centroids[0]))]
        found = vectors.select("v", nearest(F.col("v"), centroids)["cluster"].alias("cluster")).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums)
        moved = list(centroids)
        for row in found.collect():
            moved[row.cluster] = [row[f"s{i}"] // row.n for i in range(len(centroids[0]))]
        if moved == centroids:
            break  # all further rounds would do the same
        centroids = moved
    return centroids


def clustered(
    rows: DataFrame,
    vector: str = "embedding",
    key: str = "vec_id",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    seed: int = SEED,
) -> DataFrame:
    """The rows with a whole vector, with cluster, distance, cluster_inertia, inertia and centroid_sha256; columns of these names are replaced.

    A vector that is null, of another length, or with a null or non-finite component takes no part. Repeated rows are separate
    vectors. With fewer vectors than clusters each is a centroid; with none the result is empty. Sums of distances that do not fit
    in 64 bits are null. The result needs the table twice more: once for the sums over clusters, once for the rows.
    """
    facts = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    held = rows.select(F.struct("*").alias("caller"), F.col(key).alias("id"), integer_vector(F.col(vector), dimensions, scale).alias("v")).where("v IS NOT NULL")
    centroids = first_centroids(held, clusters, seed)
    kept = [c for c in rows.columns if c not in facts]
    if not centroids:
        types = dict(zip(facts, ("int", "long", "long", "long", "string"), strict=True))
        return rows.where("false").select(*kept, *[F.lit(None).cast(t).alias(c) for c, t in types.items()])
    centroids = trained(held.select("v"), centroids, rounds)
    found = written(held.select("caller", nearest(F.col("v"), centroids).alias("near")), "clustered")
    sums = {r.cluster: int(r.total) for r in found.groupBy(F.col("near.cluster").alias("cluster")).agg(F.sum(F.col("near.distance").cast("decimal(38,0)")).alias("total")).collect()}
    fits = lambda n: str(n) + "L" if n < 1 << 63 else "CAST(NULL AS BIGINT)"
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    by_cluster = "array({})".format(",".join(f"struct({fits(sums.get(n, 0))} AS inertia, '{h}' AS sha)" for n, h in enumerate(hashes)))
    found = found.withColumn("of", F.get(F.expr(by_cluster), F.col("near.cluster")))
    return found.select(
        *[F.col("caller").getField(c).alias(c) for c in kept],
        F.col("near.cluster").alias("cluster"),
        F.col("near.distance").alias("distance"),
        F.col("of.inertia").alias("cluster_inertia"),
        F.expr(fits(sum(sums.values()))).alias("inertia"),
        F.col("of.sha").alias("centroid_sha256"),
    )


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole vector of embeddings with its cluster; other rows as ``clustered`` says."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return clustered(rows).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """One common table expression a round."""
    parts = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS n, v AS c
    FROM (SELECT v, sha256('{SEED}:' || vec_id) AS h FROM v ORDER BY h LIMIT {clusters}))""",
    ]
    near = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    for i in range(rounds + 1):
        parts.append(
            f"a{i} AS MATERIALIZED (SELECT vec_id, v, n, d FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d, n) AS place\n"
            f"    FROM (SELECT k, vec_id, v, n, {near} AS d FROM (SELECT *, row_number() OVER () AS k FROM v), c{i})) WHERE place = 1)"
        )
        if i < rounds:
            parts.append(
                f"c{i + 1} AS MATERIALIZED (SELECT c{i}.n, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN (\n"
                f"    SELECT n, list(CAST((s - ((s % k) + k) % k) // k AS BIGINT) ORDER BY i) AS c FROM (\n"
                f"        SELECT n, i, sum(x) AS s, count(*) AS k FROM (SELECT n, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY n, i) GROUP BY n) AS m ON m.n = c{i}.n)"
            )
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT vec_id, CAST(a{rounds}.n AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a{rounds}.n) AS BIGINT) AS cluster_inertia,
    CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (n)"""
    )


OP11_SQL = op11_sql()
