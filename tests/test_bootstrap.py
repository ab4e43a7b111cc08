import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratefid.operators import bootstrap as bs

R = 40


def drawn(key, seed):
    out = []
    for r in range(R):
        digest = hashlib.sha256(f"{seed}:{r // 16}:{'' if key is None else key}".encode()).digest()
        at = r % 16 * 2
        out.append(sum(int.from_bytes(digest[at : at + 2], "big") >= s for s in bs.STEPS))
    return np.array(out, float)


def brute(rows, seed):
    """Area and interval of each group by comparing all pairs with their weights."""
    out = {}
    for g in {r[0] for r in rows}:
        own = [(k, s, y) for gg, k, s, y in rows if gg == g and s is not None and y is not None]
        pairs = [(np.r_[1, drawn(a[0], seed) * drawn(b[0], seed)], 1.0 if a[1] > b[1] else 0.5 if a[1] == b[1] else 0.0) for a in own if a[2] for b in own if not b[2]]
        total = sum(w for w, _ in pairs) if pairs else np.zeros(R + 1)
        value = sum(w * x for w, x in pairs) if pairs else np.zeros(R + 1)
        areas = [v / t if t else None for v, t in zip(value, total)]
        known = sorted(a for a in areas[1:] if a is not None)
        at = lambda share: known[int(share * (len(known) - 1) + 1e-9)] if known else None
        out[g] = (areas[0], at(0.025), at(0.975))
    return out


@pytest.mark.parametrize("values", [3, 1, 1_000])
def test_auc_interval_over_partitions_with_ties_and_nulls(spark, values):
    rng = random.Random(values)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(30) if rng.random() < 0.95 else None, float(rng.randrange(values)), rng.randrange(2)) for _ in range(180)]
    rows += [("a", 1, None, 1), ("a", 1, 2.0, None), ("one", 1, 2.0, 1), ("one", 2, 3.0, 1)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "g string, k long, s double, y int")
        got = {r.g: (r.auc, r.low, r.high) for r in bs.auc_interval(df, ["g"], "k", "s", "y", R, "t").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    want = brute(rows, "t")
    assert got.keys() == want.keys() and got["one"] == (None, None, None)
    for g, w in want.items():
        assert got[g] == pytest.approx(w) if w[0] is not None else got[g] == w


def test_weighted_sums_by_group_and_whole(spark):
    rows = [(i % 3, i % 17, float(i)) for i in range(300)] + [(0, 1, None), (None, None, 5.0)]
    df = spark.createDataFrame(rows, "g int, k int, v double").repartition(5)
    got = {r.g: r for r in bs.weighted_sums(df, ["g"], "k", "v", R, "s").collect()}
    for g in (0, 1, 2, None):
        own = [(k, v) for gg, k, v in rows if gg == g and v is not None]
        assert got[g].n == len(own) and got[g].total == sum(v for _, v in own)
        assert np.allclose(got[g].ns, sum(drawn(k, "s") for k, _ in own)) and np.allclose(got[g].totals, sum(drawn(k, "s") * v for k, v in own))
    whole = bs.mean_interval(df, [], "k", "v", R, "s").first()
    assert whole.n == 301 and whole.low <= whole.mean <= whole.high and len(whole.means) == R
    assert bs.mean_interval(df.where("false"), [], "k", "v", R, "s").count() == 0


def test_draws_are_poisson_and_no_row_is_exploded(spark):
    found = bs.weights([r.d for r in spark.range(500).select(bs.draws(F.col("id"), 208, "p").alias("d")).collect()], 208)
    assert found.shape == (500, 208) and abs(found.mean() - 1) < 0.02 and abs(found.var() - 1) < 0.03
    df = spark.createDataFrame([(1, 1.0, 1)], "k int, s double, y int")
    for made in (bs.auc_interval(df, [], "k", "s", "y", 200, "x"), bs.mean_interval(df, [], "k", "s", 200, "x")):
        assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()
