"""Files written and read back with a fixed schema, and a table kept by key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one inside the warehouse."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return (found or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared").rstrip("/")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Blank lines are skipped; a line that is no JSON of the schema ends the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_by_suffix(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    form = {"parquet": "parquet", "jsonl": "json", "json": "json", "csv": "csv", "orc": "orc"}[path.removesuffix(".gz").rsplit(".", 1)[-1]]
    reader = spark.read.format(form)
    return (reader.schema(schema) if schema else reader).load(path)


def round_trip(df: DataFrame, name: str, form: str = "parquet", **options) -> DataFrame:
    """Write to a new place in the shared folder by Spark's commit protocol, and read with the same schema, failing on bad rows."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.format(form).options(**options).save(path)
    if form in ("json", "csv"):
        options["mode"] = "FAILFAST"
    options.pop("compression", None)
    return spark.read.format(form).schema(df.schema).options(**options).load(path)


class KeyedStore:
    """Rows by key in folders by bucket of the key, so a get of few keys reads few folders."""

    def __init__(self, spark: SparkSession, key: str, buckets: int, path: str | None = None):
        self.spark, self.key, self.buckets = spark, key, buckets
        self.path = path or f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"

    def _bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def put(self, rows: DataFrame) -> None:
        out = self._bucket(rows)
        out.repartition(self.buckets, "_bucket").write.mode("append").partitionBy("_bucket").parquet(self.path)

    def get(self, keys: DataFrame) -> DataFrame:
        rows = self.spark.read.parquet(self.path)
        return rows.join(self._bucket(keys.select(self.key).distinct()), ["_bucket", self.key], "left_semi").drop("_bucket")
