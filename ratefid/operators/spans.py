"""The window of a text that says most of a fact and a question in no more tokens than the fact has."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = re.compile(r"[^ \t\n\x0b\f\r]+")
TOKEN = re.compile(r"\w+|[^\w \t\n\x0b\f\r]")
TERM = re.compile("[a-z0-9]+")
RESULT = "struct<start:int,words:int,tokens:int,fact_terms:int,question_terms:int,span:string>"


def window_ends(tokens: np.ndarray, cap: int) -> np.ndarray:
    """Of each start the last word of the longest window of at most ``cap`` tokens; before the start where there is none."""
    total = np.cumsum(tokens)
    return np.searchsorted(total, total - tokens + cap, "right") - 1


def distinct_inside(places: np.ndarray, terms: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each start how many different terms occur from there to its end.

    An occurrence is the first of its term in a window that begins after the one before it, at or before its own place, and whose
    end is not before it. Ends never fall, so those starts are an interval: one addition where it begins, one where it is over.
    """
    order = np.lexsort((places, terms))
    places, terms = places[order], terms[order]
    before = np.r_[-1, places[:-1]] if len(places) else places
    if len(places):
        before[np.r_[True, terms[1:] != terms[:-1]]] = -1
    low = np.maximum(before + 1, np.searchsorted(ends, places, "left"))
    some = low <= places
    change = np.zeros(len(ends) + 1, np.int64)
    np.add.at(change, low[some], 1)
    np.add.at(change, places[some] + 1, -1)
    return np.cumsum(change)[:-1]


def best_window(source: str | None, fact: str | None, question: str | None) -> tuple | None:
    """The window of greatest (2 x fact terms + question terms, their sum, tokens), the earliest of these; null if no word fits.

    Longer windows of one start have no fewer terms or tokens, so of each start only the longest is looked at: linear in the words.
    """
    cap = len(TOKEN.findall(fact or ""))
    spans = [m.span() for m in PIECE.finditer(source or "")]
    if not cap or not spans:
        return None
    wanted = [{t: k for k, t in enumerate(sorted(set(TERM.findall((x or "").lower()))))} for x in (fact, question)]
    tokens, found = np.empty(len(spans), np.int64), ([], [])
    for i, (a, b) in enumerate(spans):
        piece = source[a:b]
        tokens[i] = len(TOKEN.findall(piece))
        for term in set(TERM.findall(piece.lower())):
            for own, at in zip(wanted, found, strict=True):
                if term in own:
                    at.append((i, own[term]))
    ends = window_ends(tokens, cap)
    f, q = (distinct_inside(*np.array(at, np.int64).reshape(-1, 2).T, ends) for at in found)
    total = np.cumsum(tokens)
    size = total[np.maximum(ends, 0)] - total + tokens
    starts = np.flatnonzero(ends >= np.arange(len(ends)))
    if not len(starts):
        return None
    i = int(starts[np.lexsort((starts, -size[starts], -(f + q)[starts], -(2 * f + q)[starts]))[0]])
    return i, int(ends[i] - i + 1), int(size[i]), int(f[i]), int(q[i]), source[spans[i][0] : spans[ends[i]][1]]


def with_best_window(df: DataFrame, source: Column, fact: Column, question: Column, name: str = "window") -> DataFrame:
    """Adds a struct of where the window begins (a word's number), its words, tokens, terms of fact and question, and its text."""

    @F.pandas_udf(RESULT)
    def windows(sources: pd.Series, facts: pd.Series, questions: pd.Series) -> pd.DataFrame:
        made = [best_window(*x) or (None,) * 6 for x in zip(sources, facts, questions, strict=True)]
        frame = pd.DataFrame(made, columns=["start", "words", "tokens", "fact_terms", "question_terms", "span"])
        return frame.astype({c: "Int32" for c in frame.columns[:-1]})

    return df.withColumn(name, windows(source, fact, question))
