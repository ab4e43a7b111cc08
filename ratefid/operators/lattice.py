"""The lattice of packet subsets of each example, as a long table of states or as arrays indexed by mask."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bit(packet: Column | str) -> Column:
    """1 << packet."""
    packet = F.col(packet) if isinstance(packet, str) else packet
    return F.pow(F.lit(2), packet).cast("int")


def has(mask: Column | str, packet: Column | int) -> Column:
    mask = F.col(mask) if isinstance(mask, str) else mask
    one = F.lit(1 << packet) if isinstance(packet, int) else bit(packet)
    return mask.bitwiseAND(one) != 0


def lexicographic(mask: Column, n: int) -> Column:
    """A number that orders masks as the tuples of their bits are ordered, packet 0 first."""
    total = F.lit(0)
    for i in range(n):
        total = total + F.when(has(mask, i), F.lit(1 << (n - 1 - i))).otherwise(F.lit(0))
    return total


def mask_to_state(mask: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: has(mask, i).cast("int"))


def state_to_mask(state: Column) -> Column:
    return F.aggregate(F.transform(state, lambda x, i: F.when(x > 0, bit(i)).otherwise(0)), F.lit(0), lambda a, b: a + b)


def binary_lattice(examples: DataFrame, n: int) -> DataFrame:
    return examples.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))))


def ternary_lattice(examples: DataFrame, n: int) -> DataFrame:
    """Every state of n digits 0, 1, 2; the first digit is the most significant."""
    rows = examples.withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(3**n - 1))))
    digits = F.transform(F.sequence(F.lit(n - 1), F.lit(0), F.lit(-1)), lambda i: (F.floor(F.col("number") / F.pow(F.lit(3), i)) % 3).cast("int"))
    return rows.withColumn("state", digits).drop("number")


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).ravel(), type=kind))


def scored_subsets(rows: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """key, overlaps (question terms of each packet), and of all 2**n states by mask: tokens, fidelity (F1 of the distinct terms
    against the question's) and recall.

    ``rows`` has words (of each of n packets an array of terms) and asked (the distinct terms of the question, at least one). Terms
    are counted by the set of packets that hold them, so a text is read once for all states; the work of a row grows with its words.
    """
    size = 1 << n
    masks, one = np.arange(size), 1 << np.arange(n)
    meets = (masks[:, None] & masks != 0).astype(np.int64)
    holds = (one[:, None] & masks != 0).astype(np.int64)
    schema = f"{key} {dict(rows.dtypes)[key]}, overlaps array<int>, tokens array<bigint>, fidelity array<double>, recall array<double>"

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = len(batch)
            if not count:
                continue
            packets, asked = batch.column("words").flatten(), batch.column("asked")
            sizes, wanted = packets.value_lengths().to_numpy(), asked.value_lengths().to_numpy()
            terms = pa.concat_arrays([packets.flatten(), asked.flatten()]).dictionary_encode()
            slot = np.concatenate([np.repeat((np.arange(count)[:, None] * (n + 1) + np.arange(n)).ravel(), sizes), np.repeat(np.arange(count) * (n + 1) + n, wanted)])
            row, place = np.divmod(slot, n + 1)
            found = np.sort((row * len(terms.dictionary) + terms.indices.to_numpy()) * (n + 1) + place)
            term, place = np.divmod(found, n + 1)
            first = np.flatnonzero(np.diff(term, prepend=-1))
            sets = np.bitwise_or.reduceat(1 << place, first)
            # By row, whether the question has the term, and the packets that do.
            many = np.bincount(term[first] // len(terms.dictionary) * 2 * size + sets, minlength=count * 2 * size).reshape(count, 2, size)
            both, n_terms, n_asked = many[:, 1] @ meets, many.sum(1) @ meets, many[:, 1].sum(1)[:, None]
            made = [batch.column(key), _lists(both[:, one], pa.int32()), _lists(sizes.reshape(count, n) @ holds, pa.int64())]
            made += [_lists(2.0 * both / (n_terms + n_asked), pa.float64()), _lists(both / n_asked, pa.float64())]
            yield pa.RecordBatch.from_arrays(made, names=[key, "overlaps", "tokens", "fidelity", "recall"])

    return rows.select(key, "asked", "words").mapInArrow(job, schema)


def worked_out(lattices: DataFrame, fields: dict[str, str], work: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], key: str = "doc_id") -> DataFrame:
    """The rows with more columns, arrays of int or bigint: ``work`` makes them of tokens and fidelity, tables of a line a row and a
    column a mask, so its programs over masks take an Arrow batch of rows at once."""
    kinds = {"int": pa.int32(), "bigint": pa.int64()}
    kept = [c for c in lattices.columns if c not in fields]
    schema = ", ".join([*(f"{c} {t}" for c, t in lattices.dtypes if c in kept), *(f"{c} array<{t}>" for c, t in fields.items())])

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                made = work(*(batch.column(c).flatten().to_numpy().reshape(len(batch), -1) for c in ("tokens", "fidelity")))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(_lists(made[c], kinds[t]) for c, t in fields.items())], names=[*kept, *fields])

    return lattices.select(kept).mapInArrow(job, schema)


def minima(values: np.ndarray, down: bool = True) -> np.ndarray:
    """``zeta`` of a line a row: of each mask the least value among its subsets (or supersets)."""
    out, size = values.copy(), values.shape[1]
    for b in range(size.bit_length() - 1):
        pair = out.reshape(len(out), -1, 2, 1 << b)
        low, high = pair[:, :, 0], pair[:, :, 1]
        np.minimum(low, high, out=high if down else low)
    return out


def dense(states: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per example: arrays of tokens and fidelity indexed by mask. A table that has these already is taken as it is."""
    if "mask" not in states.columns:
        return states.select(key, "tokens", "fidelity")
    rows = states.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("mask", "tokens", "fidelity"))).alias("s"))
    return rows.select(key, F.col("s.tokens").alias("tokens"), F.col("s.fidelity").alias("fidelity"))


def zeta(df: DataFrame, column: str, n: int, down: bool = True) -> DataFrame:
    """The column's subset (or superset) minima: one pass over the array for each packet, folded so that each pass is kept."""
    test = "<>" if down else "="
    fold = f"aggregate(sequence(0, {n - 1}), {column}, (a, b) -> transform(a, (x, m) -> IF((m & shiftleft(1, b)) {test} 0, least(x, a[m ^ shiftleft(1, b)]), x)))"
    return df.withColumn(column, F.expr(fold))


def completeness(states: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """What is wrong with each example's lattice: count, repeated masks, values out of range."""
    found = states.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_states"),
        F.count_distinct("mask").alias("n_masks"),
        F.min("mask").alias("low"),
        F.max("mask").alias("high"),
        F.sum(F.when(~F.col("fidelity").between(0, 1) | F.col("fidelity").isNull(), 1).otherwise(0)).alias("bad_fidelity"),
        F.sum(F.when(F.col("tokens") < 0, 1).otherwise(0)).alias("bad_tokens"),
    )
    tests = {
        "count": F.col("n_states") != (1 << n),
        "repeated": F.col("n_masks") != F.col("n_states"),
        "range": (F.col("low") < 0) | (F.col("high") >= (1 << n)),
        "fidelity": F.col("bad_fidelity") > 0,
        "tokens": F.col("bad_tokens") > 0,
    }
    return found.select(key, "n_states", F.array_join(F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()])), ",").alias("errors"))


def attained(states: DataFrame, levels: tuple[float, ...], epsilon: float = 1e-12) -> DataFrame:
    """How many levels each state reaches."""
    reached = F.size(F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: F.col("fidelity") + epsilon >= x))
    return states.withColumn("reached", reached)


def profile(states: DataFrame, level: float, n: int, key: str = "doc_id") -> DataFrame:
    """Of each example's states at the level: number, sizes, packets in all and in any of them, whether the full one is."""
    good = F.col("fidelity") >= level
    return states.groupBy(key).agg(
        F.count(F.when(good, 1)).alias("n_positive"),
        F.min(F.when(good, F.col("size"))).alias("min_size"),
        F.max(F.when(good, F.col("size"))).alias("max_size"),
        F.bit_and(F.when(good, F.col("mask"))).alias("in_all"),
        F.bit_or(F.when(good, F.col("mask"))).alias("in_any"),
        F.max(F.when(F.col("mask") == (1 << n) - 1, good.cast("int"))).alias("full"),
    )


def neighbours(states: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """Each state without a packet beside the one with it: mask, packet, fidelity and tokens before and after."""
    low = states.select(key, "mask", F.col("fidelity").alias("before"), F.col("tokens").alias("tokens_before"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("packet"))
    low = low.where(~has("mask", F.col("packet"))).withColumn("with_mask", F.col("mask") + bit("packet"))
    high = states.select(key, F.col("mask").alias("with_mask"), F.col("fidelity").alias("after"), F.col("tokens").alias("tokens_after"))
    return low.join(high, [key, "with_mask"])
