"""Scoring a table with a user's function, and functions chosen by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.text import count_tokens, words
from .evidence import once


def score_with(df: DataFrame, columns: list[str], make: Callable[[], Callable[[pd.DataFrame], pd.Series]], name: str = "answer", kind: str = "string") -> DataFrame:
    """All columns and the user's answer to each row. ``make`` runs once a task (a model is loaded there); batches come as pandas."""

    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer = make()
        for batch in batches:
            yield batch.assign(**{name: answer(batch[columns])})

    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes if c != name), f"`{name}` {kind}"])
    return df.drop(name).mapInPandas(job, schema)


#: Ways to count a text's tokens; any Column function may be added.
TOKENIZERS: dict[str, Callable[[Column], Column]] = {"symbols": count_tokens, "words": lambda c: F.size(words(c)), "blanks": lambda c: F.size(F.filter(F.split(c, "[ \\t\\n]+", -1), lambda w: w != ""))}

#: Ways to order an example's items by the columns rank_overlap, idx and key.
POLICIES: dict[str, Callable[[], list[Column]]] = {
    "overlap": lambda: [F.desc("overlap"), F.col("idx")],
    "first": lambda: [F.col("idx")],
    "last": lambda: [F.desc("idx")],
}


def with_atom_names(df: DataFrame, atoms: str) -> DataFrame:
    """Adds _names: normalised name and place of each atom (a struct of answer and aliases); work that all answers of a row share."""
    every = F.flatten(F.transform(atoms, lambda a, i: F.transform(F.concat(F.array(a["answer"]), F.coalesce(a["aliases"], F.array().cast("array<string>"))), lambda x: F.struct(tx.normalized_answer(x).alias("k"), i.alias("i")))))
    return once(df, _names=F.filter(every, lambda n: n["k"] != ""), _gold=F.size(atoms).cast("long"))


def with_alias_metrics(df: DataFrame, predictions: Column, name: str = "metrics") -> DataFrame:
    """Adds a struct of correct, predicted, gold, precision, recall and f1 of a list of answers to rows that ``with_atom_names`` has made.

    Names are compared in normalised form. A name that several atoms have belongs to the first of them; an atom counts once, and so
    does a prediction that is repeated. Without atoms recall is 0.
    """
    df = once(df, _said=F.array_distinct(F.filter(F.transform(predictions, tx.normalized_answer), lambda p: p != "")))
    owner = lambda p: F.array_min(F.transform(F.filter("_names", lambda n: n["k"] == p), lambda n: n["i"]))
    df = once(df, _correct=F.size(F.array_distinct(F.array_compact(F.transform("_said", owner)))).cast("long"), _predicted=F.size("_said").cast("long"))
    correct, predicted, gold = F.col("_correct"), F.col("_predicted"), F.col("_gold")
    share = lambda top, below: F.when(below == 0, 0.0).otherwise(top / below)
    made = F.struct(correct.alias("correct"), predicted.alias("predicted"), gold.alias("gold"), share(correct, predicted).alias("precision"), share(correct, gold).alias("recall"), share(F.lit(2.0) * correct, predicted + gold).alias("f1"))
    return df.withColumn(name, made).drop("_names", "_gold", "_said", "_correct", "_predicted")


def alias_metrics(predictions: Column) -> Column:
    """The struct of ``with_alias_metrics`` for one of several lists of a row that ``with_atom_names`` has made."""
    owner = lambda p: F.array_min(F.transform(F.filter("_names", lambda n: n["k"] == p), lambda n: n["i"]))
    gold = F.col("_gold")
    share = lambda top, below: F.when(below == 0, 0.0).otherwise(top / below)

    def counted(said: Column) -> Column:
        correct = F.size(F.array_distinct(F.array_compact(F.transform(said, owner)))).cast("long")
        return F.struct(correct.alias("correct"), F.size(said).cast("long").alias("predicted"))

    def scored(c: Column) -> Column:
        correct, predicted = c["correct"], c["predicted"]
        return F.struct(correct.alias("correct"), predicted.alias("predicted"), gold.alias("gold"), share(correct, predicted).alias("precision"), share(correct, gold).alias("recall"), share(F.lit(2.0) * correct, predicted + gold).alias("f1"))

    said = F.array_distinct(F.filter(F.transform(predictions, tx.normalized_answer), lambda p: p != ""))
    # Each step is bound by a list of one, so that it is worked out once.
    return F.get(F.transform(F.transform(F.array(said), counted), scored), F.lit(0))
