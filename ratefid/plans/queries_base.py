"""Queries of the base tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import base
from .registry import query


@query("SELECT doc_id, packet_id, md5(text) AS text, tokens FROM packets")
def b12_atomic_packets(spark, sf_dir):
    return base.packets(spark, sf_dir).withColumn("text", F.md5(F.encode("text", "utf-8")))


@query("SELECT * FROM states")
def e02_scored_states(spark, sf_dir):
    return base.states(spark, sf_dir)


@query("SELECT * FROM prefixes")
def e08_prefix_states(spark, sf_dir):
    return base.prefixes(spark, sf_dir)
