"""Evaluation of orders and policies against exact lattices, and statistics of the results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .split import range_rank, running_total


def rate(test: Column | str) -> Column:
    """Share of the rows where it is known that pass it."""
    test = F.col(test) if isinstance(test, str) else test
    return F.avg(test.cast("double"))


def paired(hits: DataFrame, base: str, candidate: str, keys: list[str]) -> DataFrame:
    """Hits of two arms side by side, with repairs and breaks."""
    side = lambda arm, name: hits.where(F.col("arm") == arm).select(*keys, "level_id", F.col("hit").alias(name), F.col("tokens").alias(f"{name}_tokens"))
    rows = side(base, "base").join(side(candidate, "candidate"), [*keys, "level_id"])
    return rows.withColumn("repair", F.col("candidate") & ~F.col("base")).withColumn("break", F.col("base") & ~F.col("candidate"))


def windows_of_success(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of depths that hit: number, first length, longest, and falls back after a hit."""
    by = Window.partitionBy(*keys).orderBy("depth")
    rows = hits.where("hit IS NOT NULL").withColumn("before", F.lag("hit").over(by))
    rows = rows.withColumn("starts", (F.col("hit") & ~F.coalesce("before", F.lit(False))).cast("int"))
    rows = rows.withColumn("run", F.sum("starts").over(by))
    runs = rows.where("hit").groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("length"))
    falls = rows.groupBy(*keys).agg(F.count(F.when(F.col("before") & ~F.col("hit"), 1)).alias("rollbacks"))
    found = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_runs"), F.max(F.when(F.col("run") == 1, F.col("length"))).alias("first_length"), F.max("length").alias("longest"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return falls.join(found, keys, "left").select(*keys, zero("n_runs"), zero("first_length"), zero("longest"), "rollbacks")


def auc(scores: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """ROC AUC, ties as one half: from counts of each distinct score and their running sum."""
    counts = scores.where(F.col(label).isNotNull()).groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = counts.withColumn("w", F.col("p") * (below + F.col("n") / 2))
    return rows.groupBy(*by).agg((F.sum("w") / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auc"), F.sum("p").alias("n_positive"), F.sum("n").alias("n_negative"))


def average_precision(scores: DataFrame, score: str, label: str, key: str, by: list[str]) -> DataFrame:
    """By group the mean share of positives above each positive, ties of a score by the key; a group of any size is ranked in ranges."""
    ranked = running_total(range_rank(scores.select(*by, score, label, key), by, [-F.col(score), F.col(key)]), by, label)
    return ranked.groupBy(*by).agg(F.avg(F.when(F.col(label) == 1, F.col("total") / F.col("position"))).alias("ap"))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p = hits / n
    middle, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return middle - half, middle + half


def kappa(one: Column, other: Column) -> Column:
    """Cohen's kappa of two 0/1 columns, as an aggregate."""
    agree, a, b = F.avg((one == other).cast("double")), F.avg(one.cast("double")), F.avg(other.cast("double"))
    chance = a * b + (1 - a) * (1 - b)
    return (agree - chance) / F.nullif(1 - chance, F.lit(0.0))


def tf_idf(docs: DataFrame, key: str, least_docs: int = 2) -> DataFrame:
    """key, term, weight: sublinear counts times smoothed inverse document frequency, each document of length one."""
    tf = docs.select(key, F.explode("terms").alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least_docs)
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    rows = tf.join(df, "term").join(F.broadcast(n))
    rows = rows.withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = rows.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return rows.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def gate(metrics: DataFrame, checks: dict[str, tuple[str, str, float]], keys: list[str]) -> DataFrame:
    """One row per metrics row: the checks that fail, and whether all pass. A check is (column, "min" or "max", value)."""
    fails = [F.when(~F.coalesce(F.col(c) >= v if op == "min" else F.col(c) <= v, F.lit(False)), F.lit(name)) for name, (c, op, v) in checks.items()]
    out = metrics.withColumn("failed", F.array_join(F.array_compact(F.array(*fails)), ","))
    return out.select(*keys, "failed", (F.col("failed") == "").alias("passed"))
