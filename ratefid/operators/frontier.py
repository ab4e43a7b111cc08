"""Frontiers and nested chains over scored states."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lattice import dense, has, lexicographic, minima, worked_out, zeta

FAR = (1 << 62)


def at_levels(states: DataFrame, levels: tuple[float, ...]) -> DataFrame:
    grid = F.array(*[F.struct(F.lit(i).alias("level_id"), F.lit(float(x)).alias("level")) for i, x in enumerate(levels)])
    return states.withColumn("_l", F.explode(grid)).select("*", "_l.level_id", "_l.level").drop("_l")


def parse_levels(text: str) -> tuple[float, ...]:
    """A grid written as numbers between commas: strictly rising, in (0, 1]."""
    grid = tuple(float(x) for x in text.split(","))
    if not grid or any(not 0 < x <= 1 for x in grid) or any(a >= b for a, b in zip(grid, grid[1:])):
        raise ValueError(f"levels must rise strictly in (0, 1]: {text}")
    return grid


def independent_frontier(states: DataFrame, levels: tuple[float, ...], n: int, key: str = "doc_id") -> DataFrame:
    """The cheapest state of each (example, level): fewest tokens, then packets, then the smallest tuple; unreachable levels have nulls."""
    if "mask" not in states.columns:
        return _frontier_of_arrays(states, levels, n, key)
    good = F.col("fidelity") >= F.col("level")
    order = F.struct("tokens", "size", lexicographic(F.col("mask"), n).alias("lex"))
    best = F.min_by(F.struct("tokens", "mask", "fidelity"), F.when(good, order))
    out = at_levels(states, levels).groupBy(key, "level_id", "level").agg(best.alias("b"), F.max(good).alias("feasible"))
    out = out.withColumn("b", F.when(F.col("feasible"), F.col("b")))
    return out.select(key, "level_id", "level", "feasible", "b.tokens", "b.mask", F.col("b.fidelity").alias("fidelity"))


def _frontier_of_arrays(lattices: DataFrame, levels: tuple[float, ...], n: int, key: str) -> DataFrame:
    """The same from arrays by mask, inside each example's row."""
    every = F.transform(
        F.arrays_zip("tokens", "fidelity"),
        lambda x, m: F.struct(x["tokens"].alias("tokens"), F.bit_count(m).alias("size"), lexicographic(m, n).alias("lex"), m.alias("mask"), x["fidelity"].alias("fidelity")),
    )
    rows = lattices.select(key, F.inline(F.array(F.struct(every.alias("every")))))
    reaching = lambda level: lambda x: x["fidelity"] >= level
    best = [F.array_min(F.filter("every", reaching(level))) for level in levels]
    grid = F.array(*[F.struct(F.lit(i).alias("level_id"), F.lit(float(x)).alias("level"), b.alias("b")) for i, (x, b) in enumerate(zip(levels, best, strict=True))])
    rows = rows.select(key, F.inline(grid))
    return rows.select(key, "level_id", "level", F.col("b").isNotNull().alias("feasible"), "b.tokens", "b.mask", F.col("b.fidelity").alias("fidelity"))


def tied_optima(states: DataFrame, levels: tuple[float, ...], key: str = "doc_id") -> DataFrame:
    """All states of least tokens at each level."""
    good = at_levels(states, levels).where("fidelity >= level")
    least = F.min("tokens").over(Window.partitionBy(key, "level_id"))
    return good.withColumn("least", least).where("tokens = least").select(key, "level_id", "mask", "tokens")


def attainable_levels(states: DataFrame, gap: float = 1e-12, key: str = "doc_id") -> DataFrame:
    """The distinct positive fidelities of an example; those within ``gap`` of the one before count as the lowest of them."""
    by = Window.partitionBy(key).orderBy("fidelity")
    rows = states.where("fidelity > 0").select(key, "fidelity").distinct()
    rows = rows.withColumn("new", F.coalesce((F.col("fidelity") - F.lag("fidelity").over(by) > gap).cast("int"), F.lit(1)))
    rows = rows.withColumn("island", F.sum("new").over(by))
    return rows.groupBy(key, "island").agg(F.min("fidelity").alias("level")).withColumnRenamed("island", "rank")


def nested_chain(states: DataFrame, levels: tuple[float, ...], n: int, key: str = "doc_id") -> DataFrame:
    """The cheapest sequence of nested states, one for each level up to the last reachable: level_id, mask, tokens, cumulative.

    Cost and mask travel in one number; subset minima of an array give each state's best predecessor, ties to the smaller mask.
    """
    size = 1 << n
    df = dense(states, key)
    for k, level in enumerate(levels):
        own = F.zip_with("tokens", "fidelity", lambda t, f: F.when(f >= level, t))
        if k == 0:
            cost = F.transform(own, lambda t, m: F.when(t.isNotNull(), t * size + m).otherwise(F.lit(FAR)))
        else:
            total = F.zip_with(own, f"best{k - 1}", lambda t, b: F.when(t.isNotNull() & (b < FAR), t + _div(b, size)))
            cost = F.transform(total, lambda t, m: F.when(t.isNotNull(), t * size + m).otherwise(F.lit(FAR)))
        packed = cost
        df = df.withColumn(f"cost{k}", packed).withColumn(f"best{k}", packed)
        df = zeta(df, f"best{k}", n)
        df = df.withColumn(f"end{k}", F.array_min(f"cost{k}"))
    active = sum((F.when(F.col(f"end{k}") < FAR, 1).otherwise(0) for k in range(len(levels))), F.lit(0))
    df = df.withColumn("active", active)
    for k in reversed(range(len(levels))):
        last = F.when(F.col("active") == k + 1, F.col(f"end{k}"))
        if k + 1 < len(levels):
            last = F.when(F.col("active") > k + 1, F.get(F.col(f"best{k}"), F.col(f"mask{k + 1}"))).otherwise(last)
        df = df.withColumn(f"at{k}", last).withColumn(f"mask{k}", (F.col(f"at{k}") % size).cast("int"))
    rows = F.array(*[F.struct(F.lit(k).alias("level_id"), F.lit(float(x)).alias("level"), F.col(f"mask{k}").alias("mask"), F.get("tokens", F.col(f"mask{k}")).alias("tokens"), _div(F.col(f"at{k}"), size).alias("cumulative")) for k, x in enumerate(levels)])
    return df.select(key, F.explode(rows).alias("r")).select(key, "r.*").where("mask IS NOT NULL")


def _div(value, by: int):
    return F.shiftright(value, by.bit_length() - 1)


def structural_gaps(independent: DataFrame, chain: DataFrame, key: str = "doc_id") -> DataFrame:
    """What nesting costs at each level: tokens of the chain minus those of the independent optimum, and that by the latter."""
    nested = chain.select(key, "level_id", F.col("tokens").alias("nested_tokens"))
    rows = independent.select(key, "level_id", F.col("tokens").alias("independent_tokens")).join(nested, [key, "level_id"], "left")
    gap = F.col("nested_tokens") - F.col("independent_tokens")
    return rows.withColumn("gap", gap).withColumn("gap_share", gap / F.nullif(F.col("independent_tokens"), F.lit(0)))


def diagnostics(independent: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adjacent reachable levels of an example: switches of state, switches to a state that does not contain the last, rises of tokens."""
    by = Window.partitionBy(key).orderBy("level_id")
    rows = independent.where("feasible").select(key, "mask", "tokens", F.lead("mask").over(by).alias("next"), F.lead("tokens").over(by).alias("next_tokens"))
    pair = F.col("next").isNotNull()
    count = lambda test: F.count(F.when(pair & test, 1))
    out = rows.groupBy(key).agg(
        count(F.lit(True)).alias("pairs"),
        count(F.col("next") != F.col("mask")).alias("switches"),
        count(F.col("mask").bitwiseAND(F.col("next")) != F.col("mask")).alias("not_nested"),
        count(F.col("next_tokens") > F.col("tokens")).alias("rises"),
    )
    verdict = F.when(F.col("not_nested") > 0, "not nested").when(F.col("switches") > 0, "nested").otherwise("constant")
    return out.withColumn("verdict", verdict)


def frontier_summary(rows: DataFrame, n_levels: int) -> DataFrame:
    """By level: examples, feasible ones, mean tokens of both frontiers, mean gap; of rows of ``with_frontiers``.

    Violations are states that the next level's state does not hold whole; rate decreases are next states with fewer tokens.
    """
    at = lambda c, k: F.when(F.get(c, F.lit(k)) >= 0, F.get(c, F.lit(k)))
    level = lambda k: F.struct(F.lit(k).alias("level_id"), *[at(c, k).alias(c) for c in ("own_mask", "own_tokens", "nested_tokens")], at("own_mask", k + 1).alias("mask"), at("own_tokens", k + 1).alias("tokens"))
    rows = rows.select(F.inline(F.array(*map(level, range(n_levels)))))
    gap = F.col("nested_tokens") - F.col("own_tokens")
    return rows.groupBy("level_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("own_mask").alias("n_feasible"),
        F.avg("own_tokens").alias("independent_tokens"),
        F.avg("nested_tokens").alias("nested_tokens"),
        F.avg(gap).alias("gap"),
        F.count(F.when(gap > 0, 1)).alias("n_gap"),
        F.count(F.when(F.col("own_mask").bitwiseAND(F.bitwise_not("mask")) != 0, 1)).alias("violations"),
        F.count(F.when(F.col("tokens") < F.col("own_tokens"), 1)).alias("rate_decreases"),
    )


def nested_reuse(optima: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adjacent levels with a strict rise of tokens: whether any and whether all pairs of tied optima are nested."""
    low = optima.select(key, "level_id", F.col("mask").alias("low"), F.col("tokens").alias("low_tokens"))
    high = optima.select(key, (F.col("level_id") - 1).alias("level_id"), F.col("mask").alias("high"), F.col("tokens").alias("high_tokens"))
    rows = low.join(high, [key, "level_id"]).where("high_tokens > low_tokens")
    inside = F.col("low").bitwiseAND(F.col("high")) == F.col("low")
    return rows.groupBy(key, "level_id").agg(F.bool_or(inside).alias("any_nested"), F.bool_and(inside).alias("all_nested"))


def chain_membership(states: DataFrame, levels: tuple[float, ...], n: int, slacks: tuple[float, ...], key: str = "doc_id") -> DataFrame:
    """The states of each level that lie in some chain whose cost is within slack * levels * full tokens of the best.

    Costs from below are subset minima, costs from above superset minima; they are computed once for all slacks.
    """
    df = dense(states, key)
    best = F.array_max("fidelity")
    df = df.withColumn("active", sum((F.when(best >= x, 1).otherwise(0) for x in levels), F.lit(0)))
    top = len(levels)
    for k, level in enumerate(levels):
        own = F.zip_with("tokens", "fidelity", lambda t, f: F.when(f >= level, t).otherwise(F.lit(FAR)))
        df = df.withColumn(f"own{k}", own)
        step = F.col(f"own{k}") if k == 0 else F.zip_with(f"own{k}", f"below{k - 1}", lambda a, b: F.least(F.lit(FAR), F.when((a < FAR) & (b < FAR), a + b).otherwise(F.lit(FAR))))
        df = df.withColumn(f"upto{k}", step).withColumn(f"below{k}", step)
        df = zeta(df, f"below{k}", n)
    for k in reversed(range(top)):
        # What the levels after k cost at least, from each state; nothing after the last active one.
        if k + 1 == top:
            after = F.transform(f"own{k}", lambda t: F.lit(0).cast("long"))
        else:
            after = F.when(F.col("active") <= k + 1, F.transform(f"own{k}", lambda t: F.lit(0).cast("long"))).otherwise(F.col(f"above{k + 1}"))
        df = df.withColumn(f"after{k}", after)
        step = F.zip_with(f"own{k}", f"after{k}", lambda a, b: F.when((a < FAR) & (b < FAR), a + b).otherwise(F.lit(FAR)))
        df = df.withColumn(f"above{k}", step)
        df = zeta(df, f"above{k}", n, down=False)
    whole = [F.zip_with(f"upto{k}", f"after{k}", lambda a, b: F.when((a < FAR) & (b < FAR), a + b)) for k in range(top)]
    rows = F.array(*[F.struct(F.lit(k).alias("level_id"), w.alias("cost")) for k, w in enumerate(whole)])
    df = df.select(key, "active", F.get("tokens", F.lit((1 << n) - 1)).alias("full"), F.explode(rows).alias("r")).where(F.col("r.level_id") < F.col("active"))
    df = df.withColumn("optimum", F.array_min("r.cost"))
    df = df.select(key, "active", "full", "optimum", "r.level_id", F.posexplode("r.cost").alias("mask", "cost")).where("cost IS NOT NULL")
    df = df.withColumn("slack", F.explode(F.array(*[F.lit(float(s)) for s in slacks])))
    bound = F.col("optimum") + F.col("slack") * F.col("active") * F.col("full") + 1e-9
    return df.where(F.col("cost") <= bound).select(key, "slack", "level_id", "mask", "cost")


def _sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where((a < FAR) & (b < FAR), a + np.where(b < FAR, b, 0), FAR)


def with_member_counts(lattices: DataFrame, levels: tuple[float, ...], n: int, slacks: tuple[float, ...], key: str = "doc_id") -> DataFrame:
    """What ``membership_summary`` and ``precedence`` need of the states of ``chain_membership``, in the row of a lattice.

    Adds flat arrays: of each slack and level n_members, of each of these and packet n_having (members with it), of each slack and
    packet lacks (the packets that some member with it has not, as bits).
    """
    full, masks = (1 << n) - 1, np.arange(1 << n)
    holds = (masks[:, None] >> np.arange(n) & 1).astype(np.int64)

    def work(tokens: np.ndarray, fidelity: np.ndarray) -> dict[str, np.ndarray]:
        active = sum((fidelity.max(1) >= x).astype(np.int64) for x in levels)
        own = [np.where(fidelity >= x, tokens, FAR) for x in levels]
        upto, after, nothing = [own[0]], [None] * len(levels), np.zeros_like(tokens)
        for o in own[1:]:
            upto.append(_sum(o, minima(upto[-1])))
        above = nothing
        for k in reversed(range(len(levels))):
            after[k] = np.where((active <= k + 1)[:, None], nothing, above)
            above = minima(_sum(own[k], after[k]), down=False)
        inside = []
        for slack in slacks:
            for k in range(len(levels)):
                cost = _sum(upto[k], after[k])
                bound = cost.min(1) + slack * active * tokens[:, full] + 1e-9
                inside.append((cost < FAR) & (cost <= bound[:, None]) & (active > k)[:, None])
        members = np.stack(inside, 1)
        some = members.reshape(len(tokens), len(slacks), len(levels), -1).any(2)
        lacks = [np.bitwise_or.reduce(np.where(some & (holds[:, p] > 0), full ^ masks, 0), axis=2) for p in range(n)]
        flat = lambda x: x.reshape(len(tokens), -1)
        return {"n_members": members.sum(2), "n_having": flat(members.astype(np.int64) @ holds), "lacks": flat(np.stack(lacks, 2))}

    return worked_out(lattices, {"n_members": "int", "n_having": "int", "lacks": "int"}, work, key)


def preferred(n: int, at: int = 0, lacks: str = "lacks") -> Column:
    """The pairs of ``precedence`` as an array of structs (winner, loser) in their order; ``at`` is the slack's place."""
    misses = lambda a, b: F.get(lacks, F.lit(at * n) + a).bitwiseAND(F.get(F.array(*[F.lit(1 << i) for i in range(n)]), b)) != 0
    pairs = F.array(*[F.struct(F.lit(a).alias("winner"), F.lit(b).alias("loser")) for a in range(n) for b in range(n) if a != b])
    return F.filter(pairs, lambda x: misses(x["winner"], x["loser"]) & ~misses(x["loser"], x["winner"]))


def with_frontiers(lattices: DataFrame, levels: tuple[float, ...], n: int, key: str = "doc_id") -> DataFrame:
    """Both frontiers in the row of a lattice: arrays by level own_mask and own_tokens (of ``independent_frontier``), nested_mask and
    nested_tokens (of ``nested_chain``), -1 where there is none."""
    size, masks = 1 << n, np.arange(1 << n)
    bits = masks[:, None] >> np.arange(n) & 1
    by_size = np.lexsort((bits @ (1 << np.arange(n)[::-1]), bits.sum(1)))
    place = np.argsort(by_size)

    def work(tokens: np.ndarray, fidelity: np.ndarray) -> dict[str, np.ndarray]:
        rows, own, nested, best, ends = np.arange(len(tokens)), [], [], [], []
        for x in levels:
            good = fidelity >= x
            least = np.where(good, tokens * size + place, FAR).min(1)
            own.append(np.where(least < FAR, by_size[least % size], -1))
            cost = _sum(np.where(good, tokens, FAR), np.where(best[-1] < FAR, best[-1] >> n, FAR) if best else np.zeros_like(tokens))
            cost = np.where(cost < FAR, cost * size + masks, FAR)
            best.append(minima(cost))
            ends.append(cost.min(1))
        later = np.full(len(tokens), -1)
        for k in reversed(range(len(levels))):
            at = np.where(later >= 0, best[k][rows, later], ends[k])
            later = np.where(at < FAR, at % size, -1)
            nested.insert(0, later)
        own, nested = np.stack(own, 1), np.stack(nested, 1)
        cost = lambda m: np.where(m >= 0, np.take_along_axis(tokens, m, 1), -1)
        return {"own_mask": own, "own_tokens": cost(own), "nested_mask": nested, "nested_tokens": cost(nested)}

    return worked_out(lattices, {"own_mask": "int", "own_tokens": "bigint", "nested_mask": "int", "nested_tokens": "bigint"}, work, key)


def membership_summary(members: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """Of each packet, the share of a level's admissible states that have it: always, never or ambiguous."""
    rows = members.withColumn("packet", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rows = rows.groupBy(key, "slack", "level_id", "packet").agg(F.avg(has("mask", F.col("packet")).cast("double")).alias("share"))
    kind = F.when(F.col("share") == 1, "always").when(F.col("share") == 0, "never").otherwise("ambiguous")
    return rows.withColumn("kind", kind)


def precedence(members: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """Pairs (winner, loser): some admissible state has the winner without the loser and none has it the other way.

    Of each packet one bitwise sum tells which packets some state with it lacks, so members are grouped once and none is multiplied.
    """
    full = (1 << n) - 1
    lacks = [F.bit_or(F.when(has("mask", F.lit(p)), F.lit(full).bitwiseXOR(F.col("mask"))).otherwise(0)).alias(f"_{p}") for p in range(n)]
    rows = members.groupBy(key, "slack").agg(*lacks).select(key, "slack", F.array(*[F.col(f"_{p}") for p in range(n)]).alias("_l"))
    bit = lambda a, b: F.shiftright(F.get("_l", a), 0).bitwiseAND(F.get(F.array(*[F.lit(1 << i) for i in range(n)]), b)) != 0
    pairs = F.array(*[F.struct(F.lit(a).alias("winner"), F.lit(b).alias("loser")) for a in range(n) for b in range(n) if a != b])
    return rows.select(key, "slack", F.inline(F.filter(pairs, lambda x: bit(x["winner"], x["loser"]) & ~bit(x["loser"], x["winner"]))))


def reveal_thresholds(chain: DataFrame, packets: DataFrame, n_levels: int, key: str = "doc_id") -> DataFrame:
    """The lowest level of a chain that has the packet; 1 and the last bin if none does."""
    rows = packets.select(key, "packet_id").join(chain.select(key, "level_id", "level", "mask"), key)
    inside = has("mask", F.col("packet_id"))
    out = rows.groupBy(key, "packet_id").agg(F.min(F.when(inside, F.col("level"))).alias("t"), F.min(F.when(inside, F.col("level_id"))).alias("b"))
    return out.select(key, "packet_id", F.coalesce("t", F.lit(1.0)).alias("threshold"), F.coalesce("b", F.lit(n_levels)).alias("bin"))


def order_from_thresholds(thresholds: DataFrame, key: str = "doc_id") -> DataFrame:
    order = F.array_sort(F.collect_list(F.struct("bin", "packet_id")))
    return thresholds.groupBy(key).agg(order.alias("o")).select(key, F.array_join(F.transform("o", lambda x: x["packet_id"].cast("string")), ",").alias("packet_order"))


def state_at_level(thresholds: DataFrame, levels: tuple[float, ...], key: str = "doc_id") -> DataFrame:
    """The packets whose threshold a level reaches, as a mask."""
    from .lattice import bit

    rows = at_levels(thresholds, levels)
    return rows.groupBy(key, "level_id").agg(F.sum(F.when(F.col("level") >= F.col("threshold"), bit("packet_id")).otherwise(0)).alias("mask"))


def prefix_chain(walks: DataFrame, levels: tuple[float, ...], group: list[str]) -> DataFrame:
    """Cheapest rising depths of a fixed order that reach the levels in turn, up to the last that the order reaches: cost and depths.

    ``walks`` has a row an order, with arrays tokens and fidelity by depth. The fold over depths holds, of each level, the cheapest
    choice so far that ends with it; ties go to the lesser depths.
    """
    kind = "struct<cost: bigint, depths: array<int>>"
    grid = f"array({', '.join(f'{x}D' for x in levels)})"
    own = "IF(fidelity[d] >= l, IF(k = 0, named_struct('cost', tokens[d], 'depths', array(d)), IF(s.prev IS NULL, NULL, named_struct('cost', tokens[d] + s.prev.cost, 'depths', concat(s.prev.depths, array(d))))), NULL)"
    step = (
        f"aggregate(transform({grid}, (l, k) -> struct(l, k)), named_struct('prev', CAST(NULL AS {kind}), 'out', CAST(array() AS array<{kind}>)), "
        f"(s, x) -> transform(transform(array(x), y -> transform(array(y.l), l -> transform(array(y.k), k -> array_min(array(a[k], CAST({own} AS {kind}))))[0])[0]), z -> named_struct('prev', z, 'out', concat(s.out, array(z))))[0]).out"
    )
    fold = f"aggregate(sequence(0, size(tokens) - 1), transform({grid}, l -> CAST(NULL AS {kind})), (a, d) -> {step})"
    out = walks.select(*group, F.expr(f"filter({fold}, x -> x IS NOT NULL)").alias("ends"))
    last = F.get("ends", F.size("ends") - 1)
    return out.select(*group, last["cost"].alias("cost"), F.array_join(F.transform(last["depths"], lambda d: d.cast("string")), ",").alias("depths"))


def nondominated(points: DataFrame, group: list[str], gain: str, cost: str) -> DataFrame:
    """Points that no other point of the group beats: at least the gain for at most the cost, and one of them strictly."""
    other = points.select(*group, F.col(gain).alias("_g"), F.col(cost).alias("_c"))
    beaten = (other["_g"] >= points[gain]) & (other["_c"] <= points[cost]) & ((other["_g"] > points[gain]) | (other["_c"] < points[cost]))
    same = [points[g].eqNullSafe(other[g]) for g in group]
    on = beaten
    for s in same:
        on = on & s
    return points.join(other, on, "left_anti")


def dominance(candidate: DataFrame, base: DataFrame, group: list[str]) -> DataFrame:
    """How a candidate's hits compare with a base's over the active levels."""
    rows = candidate.select(*group, "level_id", F.col("hit").alias("c")).join(base.select(*group, "level_id", F.col("hit").alias("b")), [*group, "level_id"])
    out = rows.groupBy(*group).agg(F.coalesce(F.bool_or(F.col("c") & ~F.col("b")), F.lit(False)).alias("up"), F.coalesce(F.bool_or(F.col("b") & ~F.col("c")), F.lit(False)).alias("down"))
    kind = F.when(F.col("up") & F.col("down"), "mixed").when(F.col("up"), "better").when(F.col("down"), "worse").otherwise("equal")
    return out.select(*group, kind.alias("class"))
