"""Units of text: chunks near a size, merged pieces, nested question rows made flat."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunk_runs(sizes: list[int], target: int, most: int) -> list[tuple[int, int, int]]:
    """(first sentence, how many, first word or -1) of each chunk: sentences are added while that brings it nearer to ``target``.

    A sentence of more than ``most`` words is cut into pieces of its own.
    """
    out, first, size = [], 0, 0
    for i, n in enumerate(sizes):
        grown = size + n
        fits = first < i and (grown <= target or (grown <= most and abs(grown - target) < abs(size - target)))
        if n > most or not fits:
            if first < i:
                out.append((first, i - first, -1))
            first, grown = i, n
        if n > most:
            out += [(i, 1, at) for at in range(0, n, most)]
            first, grown = i + 1, 0
        size = grown
    if first < len(sizes):
        out.append((first, len(sizes) - first, -1))
    return out


def chunked(df: DataFrame, sentences: str, words, target: int, most: int) -> DataFrame:
    """One row for each chunk of the array ``sentences``: chunk (from 0), text, tokens. Only the sentences' sizes go through Python."""

    @F.pandas_udf("array<struct<first:int,n:int,word:int>>")
    def runs(sizes: pd.Series) -> pd.Series:
        return sizes.map(lambda s: [{"first": a, "n": b, "word": c} for a, b, c in chunk_runs(list(s), target, most)])

    rows = df.withColumn("_runs", runs(F.transform(sentences, lambda s: F.size(words(s)))))
    rows = rows.select("*", F.posexplode("_runs").alias("chunk", "_run")).drop("_runs")
    whole = F.array_join(F.slice(sentences, F.col("_run.first") + 1, F.col("_run.n")), " ")
    piece = F.array_join(F.slice(words(F.get(sentences, F.col("_run.first"))), F.greatest(F.col("_run.word"), F.lit(0)) + 1, F.lit(most)), " ")
    text = F.when(F.col("_run.word") < 0, whole).otherwise(piece)
    return rows.withColumn("text", text).withColumn("tokens", F.size(words(F.col("text"))).cast("long")).drop("_run", sentences)


def normalized_units(raw: DataFrame, key: str) -> DataFrame:
    """Units of nested rows: ``context`` has arrays title and sentences, ``supporting_facts`` arrays title and sent_id.

    A paragraph's text is its sentences that are not blank; empty paragraphs go, the others are numbered; it supports if a fact names one of its sentences.
    """
    facts = F.arrays_zip(F.col("supporting_facts.title").alias("title"), F.col("supporting_facts.sent_id").alias("sent_id"))
    paragraphs = F.arrays_zip(F.col("context.title").alias("title"), F.col("context.sentences").alias("sentences"))
    rows = raw.select(key, paragraphs.alias("p"), facts.alias("facts"))
    clean = F.transform("p", lambda x: F.struct(
        x["title"].alias("title"),
        F.array_join(F.filter(F.transform(x["sentences"], lambda s: F.trim(s)), lambda s: s != ""), " ").alias("text"),
        F.exists("facts", lambda f: (f["title"] == x["title"]) & (f["sent_id"] >= 0) & (f["sent_id"] < F.size(x["sentences"]))).alias("supporting"),
    ))
    return rows.select(key, F.posexplode(F.filter(clean, lambda x: x["text"] != "")).alias("unit_id", "u")).select(key, "unit_id", "u.*")


def merged_at(pieces: DataFrame, key: str, item: str, text: str, open_end: str) -> DataFrame:
    """Pieces whose predecessor ends as ``open_end`` says belong to its unit: key, unit, members (items, in order), pieces (texts)."""
    by = Window.partitionBy(key).orderBy(item)
    starts = F.when(F.lag(F.col(text).rlike(open_end)).over(by), 0).otherwise(1)
    rows = pieces.withColumn("_s", starts).withColumn("unit", F.sum("_s").over(by) - 1)
    rows = rows.groupBy(key, "unit").agg(F.array_sort(F.collect_list(F.struct(F.col(item).alias("item"), F.col(text).alias("text")))).alias("m"))
    return rows.select(key, "unit", F.col("m.item").alias("members"), F.col("m.text").alias("pieces"))


def mapped_facts(facts: DataFrame, units: DataFrame, key: str, fact: list[str], normal) -> DataFrame:
    """Each fact (key, *fact, title, sentence) with the one unit (key, unit, title, text) of its title whose text contains it."""
    u = units.select(key, "title", "unit", normal(F.col("text")).alias("_text"))
    rows = facts.join(u, [key, "title"], "left").withColumn("_in", F.col("_text").contains(normal(F.col("sentence"))))
    n = F.count(F.when(F.col("_in"), 1))
    rows = rows.groupBy(key, *fact, "title").agg(n.alias("n_matches"), F.min(F.when(F.col("_in"), F.col("unit"))).alias("unit"))
    status = F.when(F.col("n_matches") == 1, "mapped").when(F.col("n_matches") == 0, "missing").otherwise("ambiguous")
    return rows.withColumn("unit", F.when(F.col("n_matches") == 1, F.col("unit"))).withColumn("status", status)


def blank_normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[ \\t\\n]+", " "))
