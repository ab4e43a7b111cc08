"""Hash-ordered sampling, splitting and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratefid.sources.files import round_trip


def salted_hash(key: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{salt}:"), key.cast("string")), 256)


def hash_rank(df: DataFrame, key: str, salt: str, by: list[str] = ()) -> DataFrame:
    """position (from 1) of each row in its stratum, by salted hash, then key.

    Rows are ranked inside the 4,096 ranges of the hash's first digits, so a large stratum is ranked by many tasks; the sizes of
    the ranges before one give where it begins.
    """
    rows = df.withColumn("_h", salted_hash(F.col(key), salt)).withColumn("_r", F.substring("_h", 1, 3))
    sizes = rows.groupBy(*by, "_r").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_r")) - F.col("_n")
    sizes = sizes.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_r").alias("_range"), before.alias("_before"))
    same = F.col("_r") == F.col("_range")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    rank = F.row_number().over(Window.partitionBy(*by, "_r").orderBy("_h", key))
    return rows.withColumn("_k", rank).join(sizes, same).select(*df.columns, (F.col("_before") + F.col("_k")).alias("position"))


def range_rank(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """position (from 1) of each row in its group by ``order``, and size of the group; the order should tell all rows apart.

    Rows are put in ranges of (group, order), so that a group of any size, or many rows of one value, lie in several of them. They
    are ranked inside a range, and the sizes of a group's ranges before one say where it begins. The ranges are written, since two
    plans use them.
    """
    names = [f"_o{i}" for i in range(len(order))]
    rows = df.select("*", *[c.alias(n) for c, n in zip(order, names, strict=True)])
    rows = round_trip(rows.repartitionByRange(*by, *names).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = rows.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by)
    sizes = sizes.withColumn("_before", F.sum("_n").over(group.orderBy("_part")) - F.col("_n")).withColumn("size", F.sum("_n").over(group))
    sizes = sizes.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_part").alias("_range"), "_before", "size")
    same = F.col("_part") == F.col("_range")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    rank = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*names))
    return rows.withColumn("_k", rank).join(sizes, same).select(*df.columns, (F.col("_before") + F.col("_k")).alias("position"), "size")


def running_total(ranked: DataFrame, by: list[str], value: str, block: int = 100_000) -> DataFrame:
    """Adds total: of ranked rows the sum of ``value`` up to each position of its group, block by block of positions."""
    rows = ranked.withColumn("_block", F.floor(F.col("position") / block))
    sums = rows.groupBy(*by, "_block").agg(F.sum(value).alias("_s"))
    sums = sums.withColumn("_before", F.sum("_s").over(Window.partitionBy(*by).orderBy("_block")) - F.col("_s"))
    sums = sums.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_block").alias("_at"), "_before")
    same = F.col("_block") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    own = F.sum(value).over(Window.partitionBy(*by, "_block").orderBy("position"))
    return rows.withColumn("_own", own).join(sums, same).select(*ranked.columns, (F.col("_before") + F.col("_own")).alias("total"))


def lowest_hashes(df: DataFrame, key: str, salt: str, n: int) -> DataFrame:
    """The n rows of lowest salted hash: a top-k, so each task hands on n rows at most."""
    return df.withColumn("_h", salted_hash(F.col(key), salt)).orderBy("_h", key).limit(n).drop("_h")


def label_slices(df: DataFrame, key: str, salt: str, slices: dict[str, float], by: list[str] = ()) -> DataFrame:
    """Disjoint named slices of the hash order, as shares of each stratum from its start on."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    ranked = hash_rank(df, key, salt, by).join(sizes, list(by))
    label, start = None, 0.0
    for name, share in slices.items():
        test = (F.col("position") > F.floor(F.col("_n") * start)) & (F.col("position") <= F.floor(F.col("_n") * (start + share)))
        label = F.when(test, name) if label is None else label.when(test, name)
        start = round(start + share, 9)
    return ranked.withColumn("slice", label).drop("_n")


def prefix_fold(key: Column, k: int) -> Column:
    """The first eight bytes of the digest, as a number, modulo k."""
    high = F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(F.sha2(key.cast("string"), 256), 9, 8), 16, 10).cast("long")
    return ((high % k) * ((1 << 32) % k) + low % k) % k


def digest_fold(key: Column, k: int, prefix: str = "") -> Column:
    """The whole digest as a number modulo k, digit by digit."""
    digits = F.split(F.sha2(F.concat(F.lit(prefix), key.cast("string")), 256), "")
    values = F.transform(F.filter(digits, lambda d: d != ""), lambda d: F.conv(d, 16, 10).cast("int"))
    return F.aggregate(values, F.lit(0), lambda a, d: (a * 16 + d) % k)


def stratified(df: DataFrame, key: str, strata: list[str], share: float, salt: str) -> DataFrame:
    """About ``share`` of the rows: each stratum gets its floor, and the largest remainders one row more until the total is right."""
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.floor(F.sum("n") * share).alias("want"), F.sum(F.floor(F.col("n") * share)).alias("have"))
    sizes = sizes.join(F.broadcast(total))
    left = F.col("n") * share - F.floor(F.col("n") * share)
    rank = F.row_number().over(Window.orderBy(F.desc(left), *strata))  # one row a stratum
    quota = F.floor(F.col("n") * share) + F.when(rank <= F.col("want") - F.col("have"), 1).otherwise(0)
    quotas = sizes.withColumn("quota", quota).select(*strata, "quota")
    return hash_rank(df, key, salt, strata).join(quotas, strata).where("position <= quota").drop("position", "quota")


def nested_subsets(df: DataFrame, key: str, salt: str, shares: tuple[float, ...]) -> DataFrame:
    """One row for each subset that holds the row: those of smaller shares are parts of the larger ones."""
    ranked = hash_rank(df, key, salt)
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    rows = ranked.join(F.broadcast(total)).withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares])))
    return rows.where(F.col("position") <= F.ceil(F.col("_n") * F.col("share"))).drop("_n")
