"""Exact binomial bounds, hashed features and held-out linear predictions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X >= k) of n trials, as an incomplete beta: its continued fraction needs some sqrt(n) steps, not n terms."""
    if k <= 0 or p >= 1:
        return 1.0
    if k > n or p <= 0:
        return 0.0
    a, b = float(k), float(n - k + 1)
    if p > (a + 1) / (a + b + 2):
        return 1.0 - _fraction(b, a, 1 - p)
    return _fraction(a, b, p)


def _fraction(a: float, b: float, x: float) -> float:
    """The incomplete beta of x below the mean, by convergents p/q that are kept near 1."""
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    p0, q0, p1, q1, value, j = 1.0, 0.0, 1.0, 1.0, 0.0, 0
    while j < 100_000:
        j += 1
        m = j // 2
        d = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if j % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        p0, p1, q0, q1 = p1, p1 + d * p0, q1, q1 + d * q0
        p0, q0, p1, q1 = p0 / q1, q0 / q1, p1 / q1, 1.0
        if abs(p1 - value) < 1e-15 * abs(p1):
            break
        value = p1
    return front / p1


def exact_lower(k: int, n: int, alpha: float) -> float:
    """The Clopper-Pearson lower bound: where k or more hits have probability ``alpha``."""
    low, high = 0.0, 1.0
    for _ in range(60 if k else 0):
        middle = (low + high) / 2
        low, high = (middle, high) if binomial_tail(k, n, middle) <= alpha else (low, middle)
    return low


def fewest_hits(n: int, bound: float, alpha: float) -> int | None:
    """The fewest hits of n whose lower bound is at least ``bound``."""
    low, high = 1, n + 1
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if binomial_tail(middle, n, bound) <= alpha else (middle + 1, high)
    return low if low <= n else None


def exact_bounds(rates: DataFrame, hits: str, n: str, alpha: float, bound: float) -> DataFrame:
    """lower and n_needed of each row of aggregated counts."""

    @F.pandas_udf("struct<lower:double,n_needed:long>")
    def both(k: pd.Series, m: pd.Series) -> pd.DataFrame:
        rows = [(exact_lower(int(x), int(y), alpha), fewest_hits(int(y), bound, alpha)) for x, y in zip(k, m, strict=True)]
        return pd.DataFrame({"lower": [r[0] for r in rows], "n_needed": pd.array([r[1] for r in rows], dtype="Int64")})

    return rates.withColumn("_b", both(hits, n)).select("*", "_b.lower", "_b.n_needed").drop("_b")


def hashed_features(docs: DataFrame, key: str, slots: int) -> DataFrame:
    """key, slot, value: words and pairs of neighbours with a sign each, by digest, summed by slot, of length one."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("terms") - 1), lambda i: F.concat_ws(" ", F.get("terms", i - 1), F.get("terms", i)))
    grams = F.concat("terms", F.when(F.size("terms") > 1, pairs).otherwise(F.array().cast("array<string>")))
    number: Column = F.conv(F.substring(F.md5(F.encode("g", "utf-8")), 1, 7), 16, 10).cast("int")
    rows = docs.select(key, F.explode(grams).alias("g")).select(key, number.alias("h"))
    rows = rows.groupBy(key, ((F.col("h") / 2).cast("int") % slots).alias("slot")).agg(F.sum(1 - 2 * (F.col("h") % 2)).alias("s")).where("s <> 0")
    norm = rows.groupBy(key).agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"))
    return rows.join(norm, key).select(key, "slot", (F.col("s") / F.col("norm")).alias("value"))


def held_out_probe(rows: DataFrame, key: str, features: list[str], label: str, fold: str, folds: int) -> DataFrame:
    """key, fold, probability of label 1, by a logistic fit on the other folds with features standardised there."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = rows.select(key, fold, F.col(label).cast("double").alias("label"), *[F.col(c).cast("double") for c in features])
    steps = [VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(regParam=0.01, maxIter=50)]
    out = None
    for k in range(folds):
        model = Pipeline(stages=steps).fit(rows.where(F.col(fold) != k))
        own = model.transform(rows.where(F.col(fold) == k)).select(key, fold, F.get(vector_to_array("probability"), F.lit(1)).alias("probability"))
        out = own if out is None else out.unionByName(own)
    return out
