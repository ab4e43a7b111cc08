"""Checks of a packet (source, gist, residual): sizes, repetition, numbers by their value, titles, and names that the source has not."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Number words.
CARDINALS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11,
    "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20,
    "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
ORDINALS = {
    "first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10, "eleventh": 11,
    "twelfth": 12, "thirteenth": 13, "fourteenth": 14, "fifteenth": 15, "sixteenth": 16, "seventeenth": 17, "eighteenth": 18, "nineteenth": 19, "twentieth": 20,
    "thirtieth": 30, "fortieth": 40, "fiftieth": 50, "sixtieth": 60, "seventieth": 70, "eightieth": 80, "ninetieth": 90,
}
SCALES = {"hundred": 100, "hundredth": 100, "thousand": 1_000, "thousandth": 1_000, "million": 1_000_000, "millionth": 1_000_000, "billion": 1_000_000_000, "billionth": 1_000_000_000}

_WORD = "(?:" + "|".join([*CARDINALS, *ORDINALS, *SCALES]) + ")(?![a-z])"
#: Number words one after another, between them nothing but other characters than letters, or "and".
NUMBER_RUN = f"(?<![a-z]){_WORD}(?:[^a-z]+(?:and[^a-z]+)*{_WORD})*"
_VALUE = "[0-9](?:[0-9,]*[0-9])?(?:\\.[0-9]+)?(?:st|nd|rd|th)?"
DIGITS = f"(?<![\\p{{L}}\\p{{N}}_])[+-]?[$€£]?{_VALUE}|(?<=[a-z]){_VALUE}"
NAME = "(?<![\\p{L}\\p{N}_])[A-Z][\\p{L}\\p{N}_.-]+(?:\\s+[A-Z][\\p{L}\\p{N}_.-]+)*(?<=[\\p{L}\\p{N}_])(?![\\p{L}\\p{N}_])"
TITLE = "(?im)^Document title:\\s*(.+?)\\s*$"
ERRORS = ("empty", "no tokens", "ratio", "not shorter", "repeats", "numbers", "titles")
WARNINGS = ("no residual", "names")
MOST_ALIKE = 0.80


def written_numbers(text: Column) -> Column:
    """Values of numbers in digits: without separators, currency signs and endings of ordinals."""
    found = F.regexp_extract_all(F.lower(text), F.lit(DIGITS), 0)
    return F.array_distinct(F.transform(found, lambda v: F.regexp_replace(F.regexp_replace(F.replace(v, F.lit(","), F.lit("")), "^[$€£]", ""), "(?:st|nd|rd|th)$", "")))


def spelled_numbers(text: Column) -> Column:
    """Values of runs of number words: units add up, a hundred multiplies what stands before it, greater scales close it."""
    value = F.create_map(*[F.lit(x) for pair in {**CARDINALS, **ORDINALS, **SCALES}.items() for x in pair])
    scale = lambda w: w.isin(*SCALES)

    def total(run: Column) -> Column:
        words = F.filter(F.regexp_extract_all(run, F.lit("[a-z]+"), 0), lambda w: w != "and")
        start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("now"))

        def step(s: Column, w: Column) -> Column:
            v = F.element_at(value, w).cast("long")
            some = F.greatest(s["now"], F.lit(1).cast("long"))
            closes = scale(w) & (v > 100)
            return F.struct(F.when(closes, s["total"] + some * v).otherwise(s["total"]).alias("total"), F.when(closes, 0).when(scale(w), some * v).otherwise(s["now"] + v).cast("long").alias("now"))

        return F.aggregate(words, start, step, lambda s: (s["total"] + s["now"]).cast("string"))

    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(NUMBER_RUN), 0), total))


def identity(text: Column) -> Column:
    """A title or text as a reader compares it: of links the label, no emphasis, small letters, single blanks."""
    plain = F.regexp_replace(F.regexp_replace(text, "\\[\\[(?:[^\\]|]*\\|)?([^\\]]+)\\]\\]", "$1"), "[*_]+", "")
    return F.trim(F.regexp_replace(F.lower(plain), "\\s+", " "))


def names(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(NAME), 0), lambda n: F.replace(F.lower(n), F.lit(","), F.lit(""))))


@F.pandas_udf(DoubleType())
def alike(one: pd.Series, other: pd.Series) -> pd.Series:
    """Twice the characters in matching blocks, found longest first, of all characters; null of null."""
    return pd.Series([None if a is None or b is None else 1.0 if a == b else SequenceMatcher(None, a, b).ratio() for a, b in zip(one, other, strict=True)], dtype="float64")


def checked(packets: DataFrame, tokens, most_ratio: float = 0.45) -> DataFrame:
    """Adds errors and warnings (as in ERRORS and WARNINGS), and the numbers, titles and names they mean; ``tokens`` counts a text's tokens.

    Nulls are empty texts. Only pairs of gist and residual whose lengths allow it are compared block by block: the others cannot be
    alike. Columns of the added names are replaced.
    """
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("source", "gist", "residual")}
    rows = packets.drop("errors", "warnings", "new_numbers", "missing_titles", "new_names").select("*", F.inline(F.array(F.struct(*[v.alias(f"_{k}") for k, v in text.items()], tokens(text["source"]).alias("_ns"), tokens(text["gist"]).alias("_ng")))))
    both = F.concat("_gist", F.lit(" "), "_residual")
    a, b = F.lower("_gist"), F.lower("_residual")
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    near = (F.trim("_residual") != "") & (2.0 * short > MOST_ALIKE * (short + long))
    rows = rows.select("*", F.inline(F.array(F.struct(
        F.array_sort(F.array_except(written_numbers(both), F.array_union(written_numbers(F.col("_source")), spelled_numbers(F.col("_source"))))).alias("new_numbers"),
        F.filter(F.array_distinct(F.regexp_extract_all("_source", F.lit(TITLE), 1)), lambda t: ~F.contains(identity(both), identity(t))).alias("missing_titles"),
        F.array_sort(F.array_except(names(both), names(F.col("_source")))).alias("new_names"),
    ))))
    rows = rows.withColumn("_alike", alike(F.when(near, a), F.when(near, b)))
    tests = {
        "empty": (F.trim("_source") == "") | (F.trim("_gist") == ""), "no tokens": F.col("_ns") <= 0, "ratio": (F.col("_ns") > 0) & (F.col("_ng") / F.nullif("_ns", F.lit(0)) > most_ratio),
        "not shorter": F.col("_ng") >= F.col("_ns"), "repeats": F.col("_alike") > MOST_ALIKE, "numbers": F.size("new_numbers") > 0, "titles": F.size("missing_titles") > 0,
    }
    warn = {"no residual": F.trim("_residual") == "", "names": F.size("new_names") > 0}
    listed = lambda found: F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in found.items()]))
    rows = rows.withColumn("errors", listed(tests)).withColumn("warnings", listed(warn))
    return rows.drop("_source", "_gist", "_residual", "_ns", "_ng", "_alike")
