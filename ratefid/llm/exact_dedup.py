"""Exact dedup against a persistent digest index, bucketed and sorted by hash."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, documents, join_counted, new_path, written


def digest(text: Column) -> Column:
    """SHA-256 of the text with each run of blanks replaced by one space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), f"{BLANKS}+", " "), 256))


class DigestIndex:
    """A table of (digest, keep_id, n_rows, batch) in ``n_buckets`` files a batch, bucketed and sorted by digest.

    ``ingest`` anti-joins a batch with the index by sort-merge (the index is not shuffled) and appends what is new; of digests that
    are known it appends the count alone, with a null keep_id. A document of an older batch stays before any of a newer one;
    within a batch the smallest doc_id does. ``resolve`` says for each row of a table which document stays.
    """

    def __init__(self, spark: SparkSession, n_buckets: int | None = None, name: str | None = None, path: str | None = None):
        self.spark = spark
        self.n_buckets = n_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        if not spark.catalog.tableExists(self.name):
            empty = spark.createDataFrame([], "digest binary, keep_id long, n_rows long, kept boolean, batch string")
            self._append(empty, path or new_path(spark, "digest-index"))

    def _append(self, rows: DataFrame, path: str | None = None) -> None:
        out = rows.write.format("parquet").mode("append").bucketBy(self.n_buckets, "digest").sortBy("digest")
        (out.option("path", path) if path else out).saveAsTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Take the table out of the catalog; its files stay where ``path`` says."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def ingest(self, docs: DataFrame, batch: str | None = None) -> None:
        """Add the rows of ``docs``. A batch whose name the index has already is not added again, so a retry is safe.

        ``docs`` needs doc_id and text; other columns, whatever their names, are not read.
        """
        batch = batch or uuid.uuid4().hex
        if not self.table().where(F.col("batch") == batch).isEmpty():
            return
        rows = docs.select(F.col("doc_id").cast("long"), digest(F.col("text")).alias("digest"))
        counts = rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n_rows"))
        counts = written(counts, "digest-batch").withColumn("batch", F.lit(batch))
        known = self.table().select("digest").distinct().hint("merge")
        fresh = counts.join(known, "digest", "left_anti").withColumn("kept", F.lit(True))
        again = counts.join(known, "digest", "left_semi").withColumn("keep_id", F.lit(None).cast("long")).withColumn("kept", F.lit(False))
        both = fresh.unionByName(again).select("digest", "keep_id", "n_rows", "kept", "batch")
        self._append(both.repartition(self.n_buckets, "digest"))

    def entries(self) -> DataFrame:
        """digest, keep_id, group_size: over all batches; the buckets spare the shuffle."""
        rows = self.table().groupBy("digest")
        return rows.agg(F.max(F.when(F.col("kept"), F.col("keep_id"))).alias("keep_id"), F.sum("n_rows").alias("group_size"))

    def resolve(self, docs: DataFrame) -> DataFrame:
        """One row per row of ``docs`` (all ingested before): doc_id, keep_id, group_size, kept, text_sha256.

        group_size counts the rows with that text in all batches. Null and empty texts are equal; a text of blanks only equals
        one space. A repeated row of the document that stays is kept too. A row without doc_id never stays before one of its batch
        that has it; a group of such rows alone has a null keep_id and keeps them. No rows give no rows.
        """
        rows = docs.select(F.col("doc_id").cast("long"), digest(F.col("text")).alias("digest"))
        out = join_counted(rows, written(self.entries(), "digest-entries"), "digest", "group_size", "doc_id")
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
        return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document of each group of equal texts stays. The table comes in two batches, the smaller half of the ids first.

    So the second batch is joined against an index that is there, and the smallest doc_id stays whatever batch it is in. Null
    texts, repeats and rows without doc_id as ``DigestIndex.resolve`` says.
    """
    docs, index = documents(spark, sf_dir), DigestIndex(spark)
    ends = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    first = F.coalesce(F.col("doc_id") <= ((ends.low or 0) + (ends.high or 0)) // 2, F.lit(False))
    index.ingest(docs.where(first), "first")
    index.ingest(docs.where(~first), "second")
    out = index.resolve(docs)
    index.drop()
    return out


OP6_SQL = r"""
WITH hashed AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents
), groups AS (
    SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM hashed GROUP BY h
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM hashed JOIN groups USING (h)
"""
