import random

from pyspark.sql import functions as F

from ratefid.operators.split import range_rank, running_total


def test_ranks_and_totals_of_a_hot_group(spark):
    """A group with most rows, one value with many of them, a null group: places and running totals as in one sorted list."""
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), 7 if rng.random() < 0.4 else rng.randrange(50), i, rng.randrange(3)) for i in range(3_000)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "g string, v int, i long, x int").repartition(5)
        ranked = range_rank(df, ["g"], [-F.col("v"), F.col("i")])
        got = {r.i: (r.position, r.size, r.total) for r in running_total(ranked, ["g"], "x", block=100).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want = {}
    for g in {r[0] for r in rows}:
        own, total = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 0
        for k, r in enumerate(own, 1):
            total += r[3]
            want[r[2]] = (k, len(own), total)
    assert {i: w for i, w in want.items() if rows[i][0] is not None} == {i: w for i, w in got.items() if rows[i][0] is not None}
    assert want == got
    assert range_rank(df.where("false"), ["g"], [F.col("i")]).count() == 0
