"""Bootstrap intervals in one pass: of each row its weights in all replicates are an array, and only sums of arrays are ever shuffled.

In a replicate a cluster counts as often as a Poisson(1) draw says. The draws are read from SHA-256 of seed, block and cluster
key, so all rows of a cluster, in any task and any attempt, have the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Draws of 16 bits that a digest of 256 bits has.
DRAWS = 16
#: A draw of at least the k-th of these counts k + 1 times or more: 65536 times the chance of k or fewer.
STEPS = tuple(int(65536 * sum(exp(-1) / factorial(i) for i in range(k + 1))) for k in range(8))
#: Groups whose sums a task holds at once.
GROUPS = 4_096


def draws(key: Column, replicates: int, seed: str) -> Column:
    """Binary of 16 bits a replicate."""
    parts = [F.unhex(F.sha2(F.concat(F.lit(f"{seed}:{b}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)) for b in range(-(-replicates // DRAWS))]
    return F.concat(*parts)


def weights(binary: list[bytes], replicates: int) -> np.ndarray:
    """How often each row counts in each replicate."""
    found = np.frombuffer(b"".join(binary), ">u2").reshape(len(binary), -1)[:, :replicates]
    return np.searchsorted(np.array(STEPS), found, "right").astype(np.float64)


def _runs(frame: pd.DataFrame) -> np.ndarray:
    """A number for each row that grows where any column differs from the row before, nulls being equal."""
    change = np.zeros(len(frame), bool)
    for name in frame.columns:
        codes = pd.factorize(frame[name], use_na_sentinel=True)[0]
        change[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(change)


def weighted_sums(rows: DataFrame, by: list[str], key: str, value: str, replicates: int, seed: str) -> DataFrame:
    """by, n (rows), total (sum of ``value``), and arrays ns and totals with the same of each replicate. Rows with a null value do not count.

    A task hands on one row a group; ``key`` is the cluster.
    """
    types = dict(rows.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in by], "n double, total double, ns array<double>, totals array<double>"])
    flat = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"), draws(F.col(key), replicates, seed).alias("_d"))

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def out() -> pa.RecordBatch:
            frame = pd.DataFrame([(*k, v[0], v[1], v[2].tolist(), v[3].tolist()) for k, v in held.items()], columns=names)
            return pa.RecordBatch.from_pandas(frame, schema=arrow, preserve_index=False)

        names, arrow = [*by, "n", "total", "ns", "totals"], None
        for batch in batches:
            if arrow is None:
                double = pa.list_(pa.float64())
                arrow = pa.schema([*[batch.schema.field(c) for c in by], ("n", pa.float64()), ("total", pa.float64()), ("ns", double), ("totals", double)])
            if not batch.num_rows:
                continue
            w, v = weights(batch.column(len(by) + 1).to_pylist(), replicates), batch.column(len(by)).to_numpy()
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(len(by))], strict=True)) if by else [()] * batch.num_rows
            codes, unique = pd.factorize(pd.Series(keys, dtype=object))
            for code, k in enumerate(unique):
                own = codes == code
                new = [own.sum(), v[own].sum(), w[own].sum(axis=0), v[own] @ w[own]]
                held[k] = [a + b for a, b in zip(held[k], new, strict=True)] if k in held else new
            if len(held) > GROUPS:
                yield out()
                held.clear()
        if held:
            yield out()

    def summed(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.iloc[:1][list(by)].copy()
        first["n"], first["total"] = frame["n"].sum(), frame["total"].sum()
        first["ns"], first["totals"] = [np.sum(frame["ns"].tolist(), axis=0).tolist()], [np.sum(frame["totals"].tolist(), axis=0).tolist()]
        return first

    return flat.mapInArrow(job, schema).groupBy(*by).applyInPandas(summed, schema)


def bounds(values: Column, level: float = 0.95) -> tuple[Column, Column]:
    """The lower and upper percentile of an array's values that are not null: the one at floor(share * (n - 1)) in order."""
    known = F.array_sort(F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v)))
    at = lambda share: F.get(known, F.floor(F.lit(share) * (F.size(known) - 1) + 1e-9).cast("int"))
    return at((1 - level) / 2), at(1 - (1 - level) / 2)


def mean_interval(rows: DataFrame, by: list[str], key: str, value: str, replicates: int, seed: str) -> DataFrame:
    """by, n, mean, low, high, and means of all replicates (null where no cluster was drawn)."""
    sums = weighted_sums(rows, by, key, value, replicates, seed)
    means = F.zip_with("totals", "ns", lambda t, n: t / F.nullif(n, F.lit(0.0)))
    low, high = bounds(F.col("means"))
    return sums.withColumn("means", means).select(*by, F.col("n").cast("long").alias("n"), (F.col("total") / F.col("n")).alias("mean"), low.alias("low"), high.alias("high"), "means")


class _Segment:
    """Rows of one group in a range of scores: weights of positives and negatives in each replicate, and how many pairs inside are in order."""

    def __init__(self, low, high, p: np.ndarray, n: np.ndarray, s: np.ndarray):
        self.low, self.high, self.p, self.n, self.s = low, high, p, n, s

    def then(self, other: _Segment) -> _Segment:
        """Both, where ``other`` begins at this one's end: all of its positives are above these negatives, or tie with them at one value."""
        if self.low == self.high == other.low == other.high:
            p, n = self.p + other.p, self.n + other.n
            return _Segment(self.low, self.high, p, n, p * n / 2)
        return _Segment(self.low, other.high, self.p + other.p, self.n + other.n, self.s + other.s + other.p * self.n)


def _joined(segments: list[_Segment]) -> list[_Segment]:
    """Segments in order as at most three: those of the first and the last value stay apart, since neighbours may have rows of these values."""
    out: list[_Segment] = []
    for s in segments:
        if out and out[-1].low == out[-1].high == s.low == s.high:
            out[-1] = out[-1].then(s)
        else:
            out.append(s)
    if len(out) > 3:
        inner = out[1]
        for s in out[2:-1]:
            inner = inner.then(s)
        out = [out[0], inner, out[-1]]
    return out


def auc_interval(rows: DataFrame, by: list[str], key: str, score: str, label: str, replicates: int, seed: str) -> DataFrame:
    """by, auc, low, high, n_positive, n_negative, aucs: the area under the ROC curve, ties as one half, and its percentile bounds.

    Rows are put in ranges of (by, score) and sorted there; a task adds up the weights of positives and negatives of all
    replicates as it passes them and hands on three segments a group. Rows of one score may be in several tasks: a hash of the
    cluster deals them. Segments of a group then join in order. Null scores and labels do not count; a replicate of one class
    alone has no area and is left out of the bounds.
    """
    types = dict(rows.dtypes)
    head = ", ".join(f"`{c}` {types[c]}" for c in by)
    schema = (f"{head}, " if by else "") + "lo double, hi double, p array<double>, n array<double>, s array<double>"
    flat = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(*by, F.col(score).cast("double").alias("_s"), (F.col(label) > 0).alias("_y"), F.col(key).alias("_k"))
    tie = F.xxhash64("_k")
    flat = flat.repartitionByRange(*[F.col(c) for c in by], F.col("_s"), tie).sortWithinPartitions(*by, "_s")
    flat = flat.select(*by, "_s", "_y", draws(F.col("_k"), replicates, seed).alias("_d"))

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, arrow = None, [], None

        def out() -> pa.RecordBatch:
            made = [(*group, s.low, s.high, s.p.tolist(), s.n.tolist(), s.s.tolist()) for s in held]
            return pa.RecordBatch.from_pandas(pd.DataFrame(made, columns=arrow.names), schema=arrow, preserve_index=False)

        for batch in batches:
            if arrow is None:
                lists = pa.list_(pa.float64())
                arrow = pa.schema([*[batch.schema.field(c) for c in by], ("lo", pa.float64()), ("hi", pa.float64()), ("p", lists), ("n", lists), ("s", lists)])
            if not batch.num_rows:
                continue
            # The first column is the plain table, in which every row counts once.
            w = np.hstack([np.ones((batch.num_rows, 1)), weights(batch.column(len(by) + 2).to_pylist(), replicates)])
            v, y = batch.column(len(by)).to_numpy(), batch.column(len(by) + 1).to_numpy(zero_copy_only=False).astype(bool)
            keys = batch.select(list(range(len(by)))).to_pandas() if by else pd.DataFrame({"_": np.zeros(batch.num_rows)})
            runs = _runs(keys)
            for r in range(runs[-1] + 1):
                at = slice(int(np.searchsorted(runs, r)), int(np.searchsorted(runs, r, "right")))
                own = tuple(batch.column(i)[at.start].as_py() for i in range(len(by)))
                if group is not None and own != group:
                    yield out()
                    held = []
                group = own
                starts = np.flatnonzero(np.r_[True, v[at][1:] != v[at][:-1]])
                p, n = np.add.reduceat(w[at] * y[at][:, None], starts, axis=0), np.add.reduceat(w[at] * ~y[at][:, None], starts, axis=0)
                values = v[at][starts]
                held += [_Segment(values[0], values[0], p[0], n[0], p[0] * n[0] / 2)]
                if len(values) > 2:
                    before = n[1:-1].cumsum(axis=0) - n[1:-1]
                    held.append(_Segment(values[1], values[-2], p[1:-1].sum(axis=0), n[1:-1].sum(axis=0), (p[1:-1] * (before + n[1:-1] / 2)).sum(axis=0)))
                if len(values) > 1:
                    held.append(_Segment(values[-1], values[-1], p[-1], n[-1], p[-1] * n[-1] / 2))
                held = _joined(held)
        if held:
            yield out()

    result = (f"{head}, " if by else "") + "auc double, n_positive long, n_negative long, aucs array<double>"

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["lo", "hi"], kind="stable")
        parts = [_Segment(r.lo, r.hi, np.asarray(r.p), np.asarray(r.n), np.asarray(r.s)) for r in frame.itertuples()]
        # An inner segment of one value alone ties with a neighbour of that value; _joined has merged it or it is the only one of that value.
        every = _joined(parts)
        total = every[0]
        for s in every[1:]:
            total = total.then(s)
        with np.errstate(divide="ignore", invalid="ignore"):
            area = np.where(total.p * total.n > 0, total.s / (total.p * total.n), np.nan)
        first = frame.iloc[:1][list(by)].copy()
        first["auc"], first["n_positive"], first["n_negative"] = None if np.isnan(area[0]) else area[0], int(total.p[0]), int(total.n[0])
        first["aucs"] = [[None if np.isnan(a) else float(a) for a in area[1:]]]
        return first

    found = flat.mapInArrow(job, schema).groupBy(*by).applyInPandas(whole, result)
    low, high = bounds(F.col("aucs"))
    return found.select(*by, "auc", low.alias("low"), high.alias("high"), "n_positive", "n_negative", "aucs")
