"""The corpus pipeline: documents go through the stages in turn, each written as Parquet and read again by the next.

SQL cannot express the first stage, a trained classifier, so ORACLE_SQL is None and tests/llm/test_pipeline.py holds each
stage against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratefid.llm.common import documents, written
from ratefid.llm.line_dedup import LineIndex, shards_for
from ratefid.llm.minhash import near_duplicates
from ratefid.llm.mixing import mixed
from ratefid.llm.packing import in_table_order, packed, word_vocabulary
from ratefid.llm.toxicity import learn, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more go. Null texts score as empty ones; repeats go or stay alike."""
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity(docs, model).where("score < 0.5").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least three documents hold stay in one; texts and n_chars are those of what is left.

    Null texts stay null; a row without doc_id counts for no line; texts that lose no line are not touched.
    """
    index = LineIndex(spark, shards_for(docs))
    index.insert(docs)
    text = F.when(F.col("n_dropped") > 0, F.array_join("kept", "\n")).otherwise(F.col("text"))
    out = index.dedup(docs).withColumn("text", text)
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 5-word shingles at a similarity of 0.8, the one with the smallest doc_id stays.

    Texts without words and rows without doc_id are linked with nothing and stay.
    """
    gone = written(near_duplicates(docs, words=5, percent=80, rows=5).where("NOT kept").select("doc_id"), "near-copies")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture: sources interleave by their target weights from the first row to the last.

    The written table's files are ranges of that order, which packing reads again. Null sources are one source; repeats stay.
    """
    return mixed(docs).orderBy("_slot", "_place").select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of windows of 2048 tokens, with their ids; each task packs a run of the mixture, in its order.

    Null and empty texts have their closing id alone; repeats and rows without doc_id are packed like others.
    """
    return packed(in_table_order(docs), word_vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("packing", pack_windows),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
