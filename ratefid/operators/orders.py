"""Orders of the packets against the lattice of their subsets: repairs, stable and local orders, linear extensions, chains of fixed sizes.

Each works in the row of its example, on arrays by mask (``tokens``, ``fidelity``) and the order ``own``, an array of packets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frontier import FAR
from .lattice import zeta
from .trajectory import _bound

_IN, _OUT = "(m & shiftleft(1, b)) <> 0", "(m & shiftleft(1, b)) = 0"


def chain_at_counts(lattices: DataFrame, levels: tuple[float, ...], counts: tuple[int, ...], n: int, key: str = "doc_id") -> DataFrame:
    """Nested states of given sizes, a size for each level: fewest levels missed, then fewest tokens, then smaller masks.

    key, level_id, mask, tokens, violations (of the whole chain). Levels missed, tokens and mask travel in one number.
    """
    size = 1 << n
    df = lattices.select(key, "tokens", "fidelity")
    for k, (level, count) in enumerate(zip(levels, counts, strict=True)):
        before = "0L" if k == 0 else f"shiftright(best{k - 1}[m], {n})"
        reached = "TRUE" if k == 0 else f"best{k - 1}[m] < {FAR}L"
        own = f"shiftleft(IF(fidelity[m] >= {level}D, 0L, 1L), 40) + t + {before}"
        df = _bound(df, **{f"cost{k}": f"transform(tokens, (t, m) -> IF(bit_count(m) = {count} AND {reached}, ({own}) * {size} + m, {FAR}L))"})
        df = zeta(df.withColumn(f"best{k}", F.col(f"cost{k}")), f"best{k}", n)
    last = len(levels) - 1
    df = df.withColumn(f"at{last}", F.array_min(f"cost{last}"))
    for k in reversed(range(last)):
        df = df.withColumn(f"at{k}", F.expr(f"best{k}[CAST(at{k + 1} % {size} AS INT)]"))
    masks = [f"CAST(at{k} % {size} AS INT)" for k in range(last + 1)]
    rows = ", ".join(f"struct({k} AS level_id, {m} AS mask, tokens[{m}] AS tokens)" for k, m in enumerate(masks))
    return df.select(key, F.expr(f"shiftright(at{last}, {40 + n})").alias("violations"), F.inline(F.expr(f"array({rows})")))


def nearest_stable_order(walks: DataFrame, good: str, n: int, key: str = "doc_id") -> DataFrame:
    """Of the orders with three good prefixes one after another, that of fewest inversions against ``own``; ties to the smaller order.

    A fold over masks keeps, by the length of the run that a mask ends (3 for good), the best order of the mask's packets.
    """
    far = "named_struct('v', 999, 'o', CAST(array() AS array<int>))"
    turned = f"size(filter(slice(own, 1, CAST(array_position(own, b) AS INT) - 1), p -> (m & shiftleft(1, p)) = 0))"
    before = lambda r: f"a[m ^ shiftleft(1, b)][{r}]"
    grown = lambda r: f"array_min(transform(filter(sequence(0, {n - 1}), b -> {_IN}), b -> named_struct('v', {before(r)}.v + {turned}, 'o', concat({before(r)}.o, array(b)))))"
    bad_row = f"array(least({grown(0)}, {grown(1)}, {grown(2)}), {far}, {far}, {grown(3)})"
    good_row = f"array({far}, {grown(0)}, {grown(1)}, least({grown(2)}, {grown(3)}))"
    start = f"array(array(named_struct('v', 0, 'o', CAST(array() AS array<int>)), {far}, {far}, {far}))"
    fold = f"aggregate(sequence(1, {(1 << n) - 1}), {start}, (a, m) -> concat(a, array(IF({good}[m], {good_row}, {bad_row}))))"
    out = _bound(walks, end=f"{fold}[{(1 << n) - 1}][3]")
    return out.select(key, F.expr("IF(end.v < 999, end.v, NULL)").alias("inversions"), F.expr("IF(end.v < 999, array_join(transform(end.o, p -> string(p)), ','), NULL)").alias("packet_order"))


def local_orders(walks: DataFrame, n: int) -> DataFrame:
    """near: ``own`` and all orders at most two inversions from it."""
    swapped = lambda o: f"transform({o}, (x, k) -> CASE k WHEN i THEN {o}[i + 1] WHEN i + 1 THEN {o}[i] ELSE x END)"
    every = lambda o: f"transform(sequence(0, {n - 2}), i -> {swapped(o)})"
    once = _bound(walks, once=every("own"))
    return _bound(once, near=f"array_distinct(concat(array(own), once, flatten(transform(once, y -> {every('y')}))))").drop("once")


def linear_extensions(df: DataFrame, good: str, n: int) -> DataFrame:
    """How many orders agree with the preferences, and how many of these pass a good state: extensions, hitting.

    ``before`` is an array by packet: the mask of those that must come first.
    """
    may = f"filter(sequence(0, {n - 1}), b -> {_IN} AND (before[b] & ~(m ^ shiftleft(1, b))) = 0)"
    ways = lambda f: f"aggregate({may}, 0L, (s, b) -> s + a[m ^ shiftleft(1, b)].{f})"
    step = f"named_struct('t', {ways('t')}, 'h', IF({good}[m], {ways('t')}, {ways('h')}))"
    fold = f"aggregate(sequence(1, {(1 << n) - 1}), array(named_struct('t', 1L, 'h', IF({good}[0], 1L, 0L))), (a, m) -> concat(a, array({step})))"
    out = _bound(df, ways=f"{fold}[{(1 << n) - 1}]")
    return out.select("*", F.col("ways.t").alias("extensions"), F.col("ways.h").alias("hitting")).drop("ways")


def closest_repairs(walks: DataFrame, levels: tuple[float, ...], n: int, keys: list[str]) -> DataFrame:
    """Of each level the state that takes the fewest inversions across its border, then tokens, then the smaller mask; 0 is a prefix.

    missing: its packets that the prefix of its size lacks; intruders: what that prefix has instead (masks).
    """
    cross = "aggregate(own, named_struct('x', 0, 'v', 0), (s, p) -> IF((m & shiftleft(1, p)) <> 0, named_struct('x', s.x, 'v', s.v + s.x), named_struct('x', s.x + 1, 'v', s.v)), s -> s.v)"
    df = _bound(walks, every=f"transform(tokens, (t, m) -> struct({cross} AS inversions, t AS tokens, m AS mask, fidelity[m] AS fidelity))")
    found = ", ".join(f"struct({k} AS level_id, array_min(filter(every, x -> x.fidelity >= {x}D)) AS r)" for k, x in enumerate(levels))
    df = df.select(*keys, "own", F.inline(F.expr(f"array({found})"))).where("r IS NOT NULL")
    prefix = "aggregate(slice(own, 1, bit_count(r.mask)), 0, (s, p) -> s | shiftleft(1, p))"
    return df.select(*keys, "level_id", "r.inversions", "r.tokens", "r.mask", F.expr(f"r.mask & ~({prefix})").alias("missing"), F.expr(f"({prefix}) & ~r.mask").alias("intruders"))
