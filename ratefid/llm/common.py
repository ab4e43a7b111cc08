"""What the corpus operators share: tables in the shared folder and joins that survive hot keys."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most this many heavy keys are ever broadcast: a key is heavy when it has over 1/HEAVY_KEYS of all rows.
HEAVY_KEYS = 10_000
#: A key with fewer rows than this is never heavy, however small the table.
HEAVY_ROWS = 1_000

BLANKS = "[\\x20\\x09-\\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and Spark runs in one process, one inside the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it cuts the lineage and outlives any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(batches: Iterator[pa.RecordBatch], text: int, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the column ``text`` has about ``most_bytes`` in each part: a task's memory does not grow with its batches."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text)
        if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type):
            ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        else:
            ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + most_bytes, "right")) - 1)
            yield batch.slice(low, high - low)
            low = high


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def join_counted(left: DataFrame, right: DataFrame, key: str, weight: str, spread: str) -> DataFrame:
    """Left-join ``right`` (one row per binary ``key``; ``weight`` says how many left rows have it).

    The heavy keys, at most HEAVY_KEYS by the way they are defined, are joined by broadcast; all others meet in a sort-merge
    join, where no key has more than 1/HEAVY_KEYS of the rows. Rows that found their heavy key get a key of their own there,
    made with the column ``spread``, so they are dealt evenly.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    values = [c for c in right.columns if c != key]
    heavy = right.where(F.col(weight) > max(HEAVY_ROWS, total // HEAVY_KEYS))
    heavy = heavy.select(F.col(key).alias("_hk"), F.struct(*values).alias("_heavy"))
    rest = right.select(F.col(key).alias("_rk"), F.struct(*values).alias("_light"))
    own = F.concat(F.col(key), F.encode(F.coalesce(F.col(spread).cast("string"), F.lit("")), "utf-8"))
    out = left.join(F.broadcast(heavy), F.col(key) == F.col("_hk"), "left")
    out = out.withColumn("_jk", F.when(F.col("_heavy").isNull(), F.col(key)).otherwise(own))
    out = out.join(rest.hint("merge"), F.col("_jk") == F.col("_rk"), "left")
    out = out.withColumn("_got", F.coalesce("_heavy", "_light"))
    return out.select(*[out[c] for c in left.columns], *[F.col(f"_got.{c}").alias(c) for c in values])


def as_key(column: str) -> Column:
    """A binary join key from a column of another type."""
    return F.encode(F.col(column).cast("string"), "utf-8")


def connected(edges: DataFrame) -> DataFrame:
    """The smallest reachable id of every node: (node, component), from edges (a, b) of bigint ids.

    Alternates large-star and small-star steps, each a grouped minimum and a join on the node; what they make is written to
    the shared folder, and only one number comes to the driver a round. The edges become stars around the smallest ids. It ends
    when a round changes nothing; each one lowers some node's neighbour, so that comes.
    """
    spark = edges.sparkSession
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select(as_key("a").alias("k"), "m", "n"), "low")
        held = join_counted(both.withColumn("k", as_key("a")), low, "k", "n", "b")
        large = held.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
        large = written(large, "large")
        low = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "low")
        held = join_counted(large.withColumn("k", as_key("a")), low.select(as_key("a").alias("k"), "m", "n"), "k", "n", "b")
        small = held.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = written(small.where("a <> b").distinct(), "edges")
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == last:
            break
        last = found
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
