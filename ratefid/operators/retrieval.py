"""BM25 inside an example, and what is chosen by it: an example's items are arrays in its row, so nothing is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evidence import once

NO_INTS = "array<int>"


def with_bm25(df: DataFrame, items: str, query: Column, name: str = "scores", k1: float = 1.2, b: float = 0.75, distinct_terms: bool = False) -> DataFrame:
    """Adds the array of scores of ``items`` (an array of arrays of terms) for the terms of ``query``. The corpus is the row's own items.

    Only words that the query has are counted, by item, for all rows of an Arrow batch at once; a score adds its terms in the query's
    order. Repeated query terms count again unless ``distinct_terms``. A null query has no terms.
    """
    df = df.drop(name).withColumn("_asked", F.coalesce(query, F.array().cast("array<string>")))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), f"`{name}` array<double>"])

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            held, asked = batch.column(items), batch.column("_asked")
            n_items, n_asked, inner = held.value_lengths().to_numpy(), asked.value_lengths().to_numpy(), held.flatten()
            sizes = inner.value_lengths().to_numpy()
            terms = pa.concat_arrays([inner.flatten(), asked.flatten()]).dictionary_encode()
            codes, width = terms.indices.to_numpy().astype(np.int64), len(terms.dictionary)
            row = np.repeat(np.arange(len(batch)), n_items)
            item = np.repeat(np.arange(len(sizes)), sizes)
            wanted, first, times = np.unique(np.repeat(np.arange(len(batch)), n_asked) * width + codes[len(item) :], return_index=True, return_counts=True)
            said = row[item] * width + codes[: len(item)]
            place = np.searchsorted(wanted, said)
            hit = np.flatnonzero(np.append(wanted, -1)[place] == said)
            # An item and a term of its query, in the order of the query, with how often the item has it.
            pairs, often = np.unique(item[hit] * (len(codes) + 1) + first[place[hit]], return_counts=True)
            where, at = np.divmod(pairs, len(codes) + 1)
            term = np.zeros(len(codes) + 1, np.int64)
            term[first] = np.arange(len(first))
            term = term[at]
            found, n = np.bincount(term, minlength=len(first))[term], n_items[row[where]]
            weight = (1 if distinct_terms else times[term]) * np.log(1 + (n - found + 0.5) / (found + 0.5))
            mean = np.bincount(row, weights=sizes, minlength=len(batch)) / np.maximum(n_items, 1)
            norm = k1 * (1 - b + b * sizes[where] / mean[row[where]])
            scores = np.bincount(where, weights=weight * often * (k1 + 1) / (often + norm), minlength=len(sizes))
            ends = np.concatenate([[0], np.cumsum(n_items)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(scores))], names=[*batch.schema.names, name])

    return df.mapInArrow(job, schema).drop("_asked")


def ranked(scores: Column, digits: int = 9) -> Column:
    """Places of the items, best first, ties to the earlier one."""
    pairs = F.transform(scores, lambda s, i: F.struct((-F.round(s, digits)).alias("s"), i.alias("i")))
    return F.transform(F.sort_array(pairs), lambda p: p["i"])


def filled(selected: Column, order: Column, k: int) -> Column:
    """The selected places and as many of the best others as make ``k``, in source order."""
    return F.array_sort(F.slice(F.concat(selected, F.array_except(order, selected)), 1, k))


def within_budget(order: Column, costs: Column, budget: Column) -> Column:
    """Walk the ranked items and keep each that still fits the budget; the first one always stays: struct(used, kept)."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("kept"))
    fits = lambda a, i: (F.size(a["kept"]) == 0) | (a["used"] + F.get(costs, i) <= budget)
    step = lambda a, i: F.struct(
        F.when(fits(a, i), a["used"] + F.get(costs, i)).otherwise(a["used"]).alias("used"),
        F.when(fits(a, i), F.concat(a["kept"], F.array(i.cast("long")))).otherwise(a["kept"]).alias("kept"),
    )
    return F.aggregate(order, start, step)


def plain_title(text: Column) -> Column:
    """Words of a title in small letters, without a last remark in parentheses."""
    return F.array_join(F.regexp_extract_all(F.regexp_replace(F.lower(text), "\\s*\\([^)]*\\)\\s*$", ""), F.lit("[\\p{L}\\p{N}_]+"), 0), " ")


def linked_title_pair(df: DataFrame, candidates: str, question: Column, words, k: int = 6, k1: float = 1.2, b: float = 0.75, bonus: float = 1.5) -> DataFrame:
    """Adds pair (two titles' places, or null) and picks (places of k candidates in source order).

    ``candidates`` is an array of structs of title and sentence; those of one title are a paragraph. ``words`` finds none across
    blanks or line ends. Paragraphs score by BM25 as a
    share of the best; of all two of a row the pair of most points counts, and a pair has ``bonus`` points more if one's title
    (of three letters or more) occurs in the other's text. The question with both titles then asks again for sentences: three of
    each paragraph, filled up with the best of all. A row of fewer than two titles takes the best sentences for its question.
    """
    # A title and a sentence are lines of their own, so their words are those of the whole: each sentence is cut into words once.
    df = once(df, _titles=F.array_distinct(F.transform(candidates, lambda c: c["title"])), _said=F.transform(candidates, lambda c: words(c["sentence"])))
    df = once(df, _at=F.transform(candidates, lambda c: F.array_position("_titles", c["title"]) - 1), _heads=F.transform("_titles", lambda t: F.concat(words(F.lit("Title: ")), words(t))))
    own = lambda lists, j: F.filter(lists, lambda x, i: F.get("_at", i) == j)
    text = lambda t, j: F.concat(F.lit("Title: "), t, F.lit("\n"), F.array_join(F.transform(own(candidates, j), lambda c: c["sentence"]), " "))
    df = once(
        df,
        _sentences=F.transform("_said", lambda w, i: F.concat(F.get("_heads", F.get("_at", i)), w)),
        _words=F.transform("_heads", lambda h, j: F.concat(h, F.flatten(own("_said", j)))),
        _plain=F.transform("_titles", plain_title),
        _texts=F.transform("_titles", lambda t, j: plain_title(text(t, j))),
    ).drop("_said", "_heads")
    names = lambda one, other: (F.length(F.get("_plain", one)) >= 3) & F.contains(F.get("_texts", other), F.get("_plain", one))
    df = once(df, _linked=F.transform("_titles", lambda t, i: F.transform("_titles", lambda u, j: names(i, j) | names(j, i)))).drop("_plain", "_texts")
    df = with_bm25(df, "_words", words(question), "_points", k1, b)
    best = F.array_max("_points")
    df = once(df.drop("_words"), _best=best)
    df = once(df, _share=F.transform("_points", lambda s: F.when(F.col("_best") > 0, s / F.col("_best")).otherwise(0.0)))
    later = lambda i: F.filter(F.sequence(F.lit(0), F.size("_titles") - 1), lambda j: j > i)
    points = lambda i, j: F.get("_share", i) + F.get("_share", j) + F.when(F.get(F.get("_linked", i), j), bonus).otherwise(0.0)
    pair = lambda i, j: F.struct((-F.round(points(i, j), 9)).alias("s"), i.alias("left"), j.alias("right"))
    every = F.when(F.size("_titles") > 1, F.flatten(F.transform(F.sequence(F.lit(0), F.size("_titles") - 1), lambda i: F.transform(later(i), lambda j: pair(i, j)))))
    df = once(df, pair=F.array_min(every))
    title = lambda side: F.get("_titles", F.col(f"pair.{side}"))
    asked = F.when(F.col("pair").isNull(), question).otherwise(F.concat_ws(" ", question, title("left"), title("right")))
    df = with_bm25(df, "_sentences", words(asked), "_scores", k1, b)
    df = once(df, _order=ranked(F.col("_scores")))
    three = lambda side: F.slice(F.filter("_order", lambda i: F.get("_at", i) == F.col(f"pair.{side}")), 1, 3)
    first = F.when(F.col("pair").isNull(), F.array().cast(NO_INTS)).otherwise(F.concat(three("left"), three("right")))
    df = once(df, picks=filled(first, F.col("_order"), k))
    return df.drop("_titles", "_at", "_sentences", "_linked", "_points", "_best", "_share", "_scores", "_order")
