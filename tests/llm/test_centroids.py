import hashlib
import math
import random

import duckdb
from pyspark.sql import functions as F

from ratefid.llm.centroids import OP11_SQL, clustered, op11_centroid_clusters

FACTS = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def brute(rows, clusters, rounds, dimensions, scale=256, seed=2):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: (i is None, "" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(own[n]) for x in zip(*own[n])] if n in own else c for n, c in enumerate(centroids)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    sums = {n: sum(d for _, c, d in found if c == n) for n in range(len(centroids))}
    return sorted(((i, c, d, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in found), key=str)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    assert sorted(map(tuple, op11_centroid_clusters(spark, "/root/testdata/sf0.01").collect())) == sorted(con.sql(OP11_SQL).fetchall())


def test_odd_vectors_and_clashing_columns(spark):
    """Null, short, long and non-finite vectors stay out; repeats, ties, null ids and columns with the names of results are defined."""
    rng = random.Random(4)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.7]) for _ in range(3)]) for i in range(60)]
    rows += [(3, rows[3][1]), (3, [0.1, 0.2, 0.3]), (None, [0.0, 0.0, 0.0]), (70, None), (71, []), (72, [1.0, 2.0]), (73, [1.0, 2.0, 3.0, 4.0]), (74, [None, 1.0, 1.0]), (75, [float("nan"), 1.0, 1.0]), (76, [1.0, float("-inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [tuple(r) for r in df.collect()]
    for name in (*FACTS, "v", "id", "caller", "near", "of"):
        df = df.withColumn(name, F.lit("own"))
    got = clustered(df, clusters=7, rounds=4, dimensions=3)
    assert got.columns == ["vec_id", "embedding", "v", "id", "caller", "near", "of", *FACTS]
    assert sorted(map(tuple, got.select("vec_id", *FACTS).collect()), key=str) == brute(rows, 7, 4, 3)


def test_few_none_and_huge_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    two = clustered(spark.createDataFrame([(1, [0.0, 1.0]), (2, [5.0, 5.0])], schema), dimensions=2).collect()
    assert {r.distance for r in two} == {0} and len({r.cluster for r in two}) == 2
    none = clustered(spark.createDataFrame([(1, None)], schema), dimensions=2)
    assert none.count() == 0 and none.columns[-5:] == list(FACTS)
    huge = clustered(spark.createDataFrame([(i, [s * 1e300, 0.0]) for i, s in enumerate((1, -1, 1))], schema), dimensions=2, clusters=1, rounds=0).collect()
    assert {r.distance for r in huge} == {0, (2 << 27) ** 2}


def test_no_python_worker_and_sums_before_the_shuffle(spark):
    from ratefid.llm.centroids import integer_vector, nearest

    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(integer_vector(F.col("embedding")).alias("v"))
    plan = rows.select("v", nearest(F.col("v"), [[0] * 64, [1] * 64])["cluster"].alias("c")).groupBy("c").agg(*[F.sum(F.col("v")[i]) for i in range(64)])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and text.count("HashAggregate") == 2
