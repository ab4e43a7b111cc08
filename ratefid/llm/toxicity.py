"""A toxicity classifier that swapping identity terms must not sway."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, parts, written
from .shingles import ALPHANUMERIC, prefix_hashes, small_bytes

#: At most so many labelled rows of each class are learned from; they are chosen by a hash of doc_id.
MAX_ROWS_PER_CLASS = 10_000
BITS = 18
#: A feature is used if so many learned rows have it, and the classes differ in it by so many standard errors.
LEAST_ROWS, LEAST_Z = 3, 2.0
#: Besides whole words, their first bytes are features, so endings do not hide a stem.
PREFIXES = (4, 5, 6)

#: Terms that name groups of people, by kind; a term is swapped for the next one of its row.
IDENTITY_TERMS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("woman", "man"),
    ("women", "men"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("african", "european", "american", "arab", "mexican", "chinese", "indian"),
    ("immigrant", "citizen", "refugee"),
    ("immigrants", "citizens", "refugees"),
    ("deaf", "blind", "disabled"),
    ("old", "young"),
    ("musulman", "chrétien", "juif", "athée"),
    ("femme", "homme"),
    ("femmes", "hommes"),
    ("frau", "mann"),
    ("frauen", "männer"),
    ("mujer", "hombre"),
    ("mujeres", "hombres"),
)


def text_features(text: str) -> np.ndarray:
    """The distinct features of a text: its words and their prefixes, hashed to BITS bits."""
    return np.unique(prefix_hashes(*small_bytes(text, ALPHANUMERIC), PREFIXES) >> np.uint64(64 - BITS)).astype(np.int32)


_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
_WORD = re.compile(r"\w+")


def swapped_sentences(text: str, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> list[tuple[str, str]]:
    """Each sentence that names a group, with the same sentence in which every such term is the next of its kind."""
    following = {t: row[(i + 1) % len(row)] for row in terms for i, t in enumerate(row)}
    out = []
    if not following:
        return out
    for m in _SENTENCE.finditer(text):
        other = _WORD.sub(lambda w: following.get(w[0].lower(), w[0]), m[0])
        if other != m[0]:
            out.append((m[0], other))
    return out


def mentioned(text: str, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> tuple[str, str] | None:
    """A sentence of the text in which a group is named in the place of one word, and the same with the next group of its kind.

    Sentence, word and group come from a hash of the text. So every labelled row, also where a corpus names no group at all, has a
    sentence whose score must not depend on the group; None where there is no word.
    """
    h = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    sentences = [m[0] for m in _SENTENCE.finditer(text) if _WORD.search(m[0])]
    if not sentences or not terms:
        return None
    sentence = sentences[h % len(sentences)]
    words = list(_WORD.finditer(sentence))
    place, row = words[(h >> 8) % len(words)], terms[(h >> 4) % len(terms)]
    at = (h >> 16) % len(row)
    return tuple(sentence[: place.start()] + row[i % len(row)] + sentence[place.end() :] for i in (at, at + 1))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    n_swaps: int = 0
    terms: tuple[tuple[str, ...], ...] = ()

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[features].sum(dtype=np.float64), -30, 30))))


def telling(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Which features at least LEAST_ROWS rows have, in shares that differ between the classes by LEAST_Z standard errors."""
    counts = [np.bincount(np.concatenate([np.zeros(0, np.int32), *(r for r, y in zip(rows, labels, strict=True) if y == c)]), minlength=1 << BITS) for c in (0, 1)]
    sizes = [(labels == c).sum() for c in (0, 1)]
    shares = [(n + 0.1) / (size + 0.2) for n, size in zip(counts, sizes, strict=True)]
    both = (counts[0] + counts[1]) / max(1, sum(sizes))
    error = np.sqrt(both * (1 - both) * sum(1 / max(1, size) for size in sizes)) + 1e-9
    return (counts[0] + counts[1] >= LEAST_ROWS) & (np.abs(shares[1] - shares[0]) >= LEAST_Z * error)


def fit(rows: list[np.ndarray], labels: np.ndarray, importance: np.ndarray, swaps: list[tuple[np.ndarray, np.ndarray]], penalty: float = 4.0, l1: float = 1.0, epochs: int = 12, batch: int = 128) -> Model:
    """Logistic regression by proximal follow-the-leader steps (sparse weights), in a fixed order.

    To the log loss comes ``penalty`` times the mean squared change of the log-odds over the swapped sentences, given as the features that
    go and come by the swap; these are always used, so that the penalty reaches them.
    """
    n = 1 << BITS
    z, g2 = np.zeros(n + 1), np.zeros(n + 1)  # the last place is the bias
    alpha, beta = 1.0, 1.0
    rng = np.random.default_rng(7)

    def weights(at: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - np.where(at == n, 0, l1), 0)
        return -shrunk * alpha / (beta + np.sqrt(g2[at]))

    def step(at: np.ndarray, w: np.ndarray, gradient: np.ndarray) -> None:
        total = g2[at] + gradient**2
        z[at] += gradient - (np.sqrt(total) - np.sqrt(g2[at])) / alpha * w
        g2[at] = total

    def grouped(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat, owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        at, place = np.unique(flat, return_inverse=True)
        return at, place, owner

    used = telling(rows, labels)
    for both in swaps:
        for side in both:
            used[side] = True
    rows = [r[used[r]] for r in rows]
    changes = [(np.concatenate((gone, come)), np.concatenate((np.ones(len(gone)), -np.ones(len(come))))) for gone, come in swaps if len(gone) + len(come)]
    order = np.arange(len(rows))
    for _ in range(epochs):
        rng.shuffle(order)
        for low in range(0, len(order), batch):
            own = order[low : low + batch]
            at, place, owner = grouped([np.append(rows[i], n) for i in own])
            w = weights(at)
            odds = np.bincount(owner, w[place], len(own))
            wrong = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - labels[own]) * importance[own]
            step(at, w, np.bincount(place, wrong[owner], len(at)))
        for low in range(0, len(changes), batch):
            own = changes[low : low + batch]
            at, place, owner = grouped([c[0] for c in own])
            sign, w = np.concatenate([c[1] for c in own]), weights(at)
            change = np.bincount(owner, w[place] * sign, len(own))
            step(at, w, np.bincount(place, 2 * penalty * change[owner] * sign, len(at)))
    every = weights(np.arange(n + 1))
    return Model(every[:n].astype(np.float32), float(every[n]), len(changes))


def learn(docs: DataFrame, labels: DataFrame, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, penalty: float = 4.0) -> Model:
    """Fit on rows of ``labels`` (doc_id, toxic) whose document is not held out, at most MAX_ROWS_PER_CLASS of each class.

    Swapped are all sentences of these rows that name a group of ``terms``, and of each row one into which such a name is put.
    Only these rows' features, a bounded number, come to the driver. Rows with a null doc_id or label are not used; of several
    labels of a document the highest counts. Without any label all documents score one half.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    picks = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_ROWS_PER_CLASS) for c in (0, 1)]
    picked = picks[0].unionByName(picks[1])

    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", "text")
    rows = written(rows, "labelled")

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.list_(pa.list_(pa.int32()))
        for part in parts(batches, 2):
            features, gone, come = [], [], []
            for text in part.column(2).to_pylist():
                features.append(text_features(text or ""))
                put = mentioned(text or "", terms)
                swaps = swapped_sentences(text or "", terms) + ([put] if put else [])
                both = [(text_features(a), text_features(b)) for a, b in swaps]
                gone.append([np.setdiff1d(a, b).tolist() for a, b in both])
                come.append([np.setdiff1d(b, a).tolist() for a, b in both])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(features, pa.list_(pa.int32())), pa.array(gone, lists), pa.array(come, lists)],
                names=["doc_id", "toxic", "features", "gone", "come"],
            )

    schema = "doc_id long, toxic int, features array<int>, gone array<array<int>>, come array<array<int>>"
    table = rows.mapInArrow(job, schema).toArrow().combine_chunks()
    if not table.num_rows:
        return Model(np.zeros(1 << BITS, np.float32), 0.0)
    table = table.sort_by("doc_id")
    y = table.column("toxic").to_numpy().astype(float)
    lists = table.column("features").combine_chunks()
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    features = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    swaps = [
        (np.array(a, np.int32), np.array(b, np.int32))
        for gone, come in zip(table.column("gone").to_pylist(), table.column("come").to_pylist(), strict=True)
        for a, b in zip(gone, come, strict=True)
    ]
    total = sum(sizes.values())
    share = np.array([sizes.get(c, 0) / total / max(1, (y == c).sum()) for c in (0, 1)]) * len(y)  # classes weigh as in all labels
    model = fit(features, y, share[y.astype(int)], swaps, penalty)
    model.terms = terms
    return model


def held_out(doc_id: str):
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string"), "utf-8")), F.lit(5)) == 0, F.lit(False))


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with score (0 to 1, from the whole text alone), which replaces a caller's score. A null text scores as an empty one."""
    weights = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([weights.value.score(text_features(t or "")) for t in texts], dtype="float64")

    return docs.withColumn("score", score(F.coalesce("text", F.lit(""))))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents; repeated rows score alike, a row without doc_id is not held out."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long"), "text")
    scored = toxicity(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
