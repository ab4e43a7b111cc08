"""License passages by diagonal voting of word k-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, parts, written
from .shingles import ALPHANUMERIC, rolling, small_bytes, word_hashes

#: Phrases whose places are reported, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Opening or typical sentences of public licenses and their notices, with their labels.
NOTICES = {
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2.0",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-2.0",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
}

#: Words of a gram. Two, since the shortest phrase has no more.
K = 2
#: Diagonals of one template so close together, and spans that touch or overlap, count as one passage.
NEAR = 3
#: Share of a template's words that a passage must have in place.
COVER = 0.8

#: Stands after the last gram of each text, so that the join also says how many words there are.
END = 0x5EED0E0D

def license_words(text: str) -> np.ndarray:
    """Hashes of the words of a text: letters a-z after A-Z are made small, digits, and all beyond ASCII."""
    return word_hashes(*small_bytes(text, ALPHANUMERIC))[1]


def template_grams(spark: SparkSession, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """template, label, exact, n_words and, for each place t in the template, its gram. As large as the templates given."""
    rows = [(-1, "", False, 0, 0, END)]
    for number, (text, label, exact) in enumerate([*((t, v, True) for t, v in phrases.items()), *((t, v, False) for t, v in notices.items())]):
        words = license_words(text)
        rows += [(number, label, exact, len(words), t, int(g)) for t, g in enumerate(rolling(words, K).view(np.int64))]
    return spark.createDataFrame(rows, "template int, label string, exact boolean, n_template int, t int, gram long")


def grams(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_words, and all rolling grams with their places as arrays, then END; ``row`` tells rows of one doc_id apart."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 2):  # long texts have many grams
            words = [license_words(t or "") for t in part.column(2).to_pylist()]
            lists = [np.append(rolling(w, K).view(np.int64), END) for w in words]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([len(w) for w in words], pa.int64()), pa.array(lists, pa.list_(pa.int64()))],
                names=["doc_id", "row", "n_words", "grams"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), "text")
    return rows.mapInArrow(job, "doc_id long, row long, n_words long, grams array<long>")


def license_passages(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, cover: float = COVER) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, row, n_words), and the passages: doc_id, row, template, label, exact, first, last, share.

    All grams of a text are joined to the grams of the templates. A hit votes for the diagonal place - t of its template; hits of one
    diagonal that leave no gap make a run, and runs of the same template that follow or overlap each other on diagonals at most NEAR
    apart are merged. A passage is verified on the diagonal that most of its words vote for: runs over NEAR from it do not count, so
    the words are in the template's order and at most 2 * NEAR more than the template's, and of those runs the template's words in
    place are counted: all of them, on one diagonal, for a phrase; ``cover`` of them for a notice. share is that part.

    The join's template side is as large as the templates given, which are parameters, not data; it is broadcast below 100,000 grams.
    Rows that share doc_id and text are one row for the passages.
    """
    spark = docs.sparkSession
    templates = template_grams(spark, phrases, notices)
    n_grams = sum(len(t.split()) for t in [*phrases, *notices])
    side = F.broadcast(templates) if n_grams < 100_000 else templates
    every = grams(docs).select("doc_id", "row", "n_words", F.posexplode("grams").alias("place", "gram"))
    found = written(every.join(side, "gram").drop("gram"), "license-hits")
    hits = found.where("template >= 0").drop("n_words").withColumn("diagonal", F.col("place") - F.col("t")).distinct()
    own = ["doc_id", "row", "template", "label", "exact", "n_template"]
    by_diagonal = Window.partitionBy(*own, "diagonal").orderBy("place")
    runs = hits.withColumn("run", F.col("place") - F.row_number().over(by_diagonal))
    runs = runs.groupBy(*own, "diagonal", "run").agg(F.min("place").alias("first"), (F.max("place") + K - 1).alias("last"))
    whole = runs.where("exact AND last - first + 1 = n_template")
    by_place = Window.partitionBy(*own).orderBy("first", "diagonal")
    previous = F.lag("diagonal").over(by_place), F.max("last").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    starts = previous[0].isNull() | (F.abs(F.col("diagonal") - previous[0]) > NEAR) | (F.col("first") > previous[1] + 1 + NEAR)
    loose = runs.where("NOT exact").withColumn("starts", starts.cast("int"))
    loose = loose.withColumn("passage", F.sum("starts").over(by_place))
    votes = F.sum(F.col("last") - F.col("first") + 1).over(Window.partitionBy(*own, "passage", "diagonal"))
    loose = loose.withColumn("votes", votes)
    main = F.max(F.struct("votes", (-F.col("diagonal")).alias("back"))).over(Window.partitionBy(*own, "passage"))["back"]
    loose = loose.withColumn("main", -main).where(F.abs(F.col("diagonal") - F.col("main")) <= NEAR)
    # Template words in place, each counted once however many runs hold it.
    held = F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("first") - F.col("diagonal"), F.col("last") - F.col("diagonal"))))))
    merged = loose.groupBy(*own, "passage").agg(F.min("first").alias("first"), F.max("last").alias("last"), (held / F.first("n_template")).alias("share"))
    fields = ["doc_id", "row", "template", "label", "exact", "first", "last", "share"]
    passages = whole.withColumn("share", F.lit(1.0)).select(*fields).unionByName(merged.where(F.col("share") >= cover).select(*fields))
    return found.where("template < 0").select("doc_id", "row", "n_words"), passages


def license_scan(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the largest share of a template found, 0 without any. Null and empty texts have no words and no labels. Repeated rows
    each get their row. Other columns are not read. No rows give no rows.
    """
    rows, found = license_passages(docs, **options)
    starts = F.when(F.col("exact"), F.col("first"))
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    facts = found.groupBy("doc_id", "row").agg(
        F.count(starts).alias("n_base"),
        F.min(starts).cast("long").alias("first_word"),
        F.max(starts).cast("long").alias("last_word"),
        labels(F.when(F.col("exact"), F.col("label"))).alias("base_labels"),
        labels(F.col("label")).alias("labels"),
        F.max("share").alias("score"),
    )
    facts = written(facts, "license-facts").withColumnRenamed("doc_id", "_id").withColumnRenamed("row", "_row")
    out = rows.join(facts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license labels; null and empty texts, repeats and rows without doc_id as ``license_scan`` says."""
    return license_scan(documents(spark, sf_dir))
