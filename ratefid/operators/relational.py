"""Keyed joins and set operations with the checks that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def strict_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join; raises if a left key has no right row."""
    missing = left.join(right, key, "left_anti").select(key).head(1)
    if missing:
        raise ValueError(f"{key} {missing[0][0]} has no match")
    return left.join(right, key)


def without(df: DataFrame, key: str, *excluded: DataFrame) -> DataFrame:
    """Rows whose key is in none of the excluded tables."""
    ids = excluded[0].select(key)
    for other in excluded[1:]:
        ids = ids.unionByName(other.select(key))
    return df.join(ids.distinct(), key, "left_anti")


def merge_shards(key: str, *shards: DataFrame) -> DataFrame:
    """All shards' rows; raises if a key is in more than one row."""
    rows = shards[0]
    for other in shards[1:]:
        rows = rows.unionByName(other)
    twice = rows.groupBy(key).count().where("count > 1").head(1)
    if twice:
        raise ValueError(f"{key} {twice[0][0]} is there more than once")
    return rows


def unordered_pairs(df: DataFrame, group: str, item: str) -> DataFrame:
    """(first, second) of each two items of a group, first < second."""
    first, second = df.select(group, F.col(item).alias("first")), df.select(group, F.col(item).alias("second"))
    return first.join(second, group).where("first < second")


def reconcile(stored: DataFrame, computed: DataFrame, keys: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Keys on one side only, and columns that differ, numbers by more than the tolerance."""
    columns = [c for c in stored.columns if c not in keys]
    a = stored.select(*keys, F.lit(True).alias("_a"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = computed.select(*keys, F.lit(True).alias("_b"), *[F.col(c).alias(f"b_{c}") for c in columns])
    numbers = {n for n, t in stored.dtypes if t in ("double", "float")}
    differs = [
        F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) & (~F.coalesce(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= tolerance, F.lit(False)) if c in numbers else F.lit(True)), F.lit(c))
        for c in columns
    ]
    kind = F.when(F.col("_a").isNull(), "missing in stored").when(F.col("_b").isNull(), "missing in computed").otherwise(F.array_join(F.array_compact(F.array(*differs)), ","))
    return a.join(b, keys, "full_outer").select(*keys, kind.alias("difference")).where("difference <> ''")


def overlaps(roles: DataFrame, key: str, role: str) -> DataFrame:
    """Number of ids that each two roles share, zero included."""
    names = roles.select(role).distinct()
    grid = names.select(F.col(role).alias("first")).join(names.select(F.col(role).alias("second"))).where("first < second")
    ids = roles.select(key, role).distinct()
    both = ids.select(key, F.col(role).alias("first")).join(ids.select(key, F.col(role).alias("second")), key).where("first < second")
    counts = both.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["first", "second"], "left").select("first", "second", F.coalesce("n", F.lit(0)).alias("n"))


def table_digest(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Of each group: rows, and a digest of its rows that does not depend on their order."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("long")).alias(f"part{i}") for i in range(4)]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *parts)
