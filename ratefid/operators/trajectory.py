"""Values of trajectories through a lattice: dynamic programs over packet subsets as folds over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reachable(df: DataFrame, good: str, n: int) -> DataFrame:
    """Whether a good state lies above each mask (itself included); ``good`` is an array of booleans by mask."""
    fold = f"aggregate(sequence(0, {n - 1}), {good}, (a, b) -> transform(a, (x, m) -> x OR ((m & shiftleft(1, b)) = 0 AND a[m ^ shiftleft(1, b)])))"
    return df.withColumn("reach", F.expr(fold))


def path_counts(df: DataFrame, good: str, n: int) -> DataFrame:
    """How many of the n! orders pass a state in ``good`` (paths: an array by mask of orders of the rest that do).

    Masks come in falling order, so each finds the counts of its supersets already in the accumulator.
    """
    size = 1 << n
    factorial = F.expr("1L")
    rest = f"CASE bit_count(m) " + " ".join(f"WHEN {k} THEN {_factorial(n - k)}L" for k in range(n + 1)) + " END"
    step = f"CASE WHEN {good}[m] THEN {rest} ELSE aggregate(filter(sequence(0, {n - 1}), b -> (m & shiftleft(1, b)) = 0), 0L, (s, b) -> s + a[{size - 1} - (m | shiftleft(1, b))]) END"
    fold = f"aggregate(transform(sequence(0, {size - 1}), i -> {size - 1} - i), CAST(array() AS array<bigint>), (a, m) -> concat(a, array({step})))"
    return df.withColumn("paths", F.reverse(F.expr(fold)))


def _factorial(k: int) -> int:
    out = 1
    for i in range(2, k + 1):
        out *= i
    return out


def longest_run(df: DataFrame, good: str, n: int) -> DataFrame:
    """The longest run of good states that some way up from each mask can begin with (0 where the mask is not good)."""
    size = 1 << n
    above = f"array_max(transform(sequence(0, {n - 1}), b -> IF((m & shiftleft(1, b)) = 0, a[{size - 1} - (m | shiftleft(1, b))], 0)))"
    step = f"IF({good}[m], 1 + coalesce({above}, 0), 0)"
    fold = f"aggregate(transform(sequence(0, {size - 1}), i -> {size - 1} - i), CAST(array() AS array<int>), (a, m) -> concat(a, array({step})))"
    return df.withColumn("run", F.reverse(F.expr(fold)))


def best_order(df: DataFrame, weights: Column, n: int) -> DataFrame:
    """The total order of largest pairwise weight. ``weights`` is a flat array: place i*n+j is what i before j gains.

    Of each set of packets placed first, the best value and its order; ties go to the smaller order, place by place.
    """
    size = 1 << n
    gain = f"aggregate(filter(sequence(0, {n - 1}), j -> (m & shiftleft(1, j)) = 0), 0D, (s, j) -> s + w[i * {n} + j])"
    option = f"struct(-(a[m ^ shiftleft(1, i)].v + {gain}) AS v, concat(a[m ^ shiftleft(1, i)].o, array(i)) AS o)"
    best = f"array_min(transform(filter(sequence(0, {n - 1}), i -> (m & shiftleft(1, i)) <> 0), i -> {option}))"
    start = "array(struct(0D AS v, CAST(array() AS array<int>) AS o))"
    fold = f"aggregate(sequence(1, {size - 1}), {start}, (a, m) -> concat(a, array(named_struct('v', -{best}.v, 'o', {best}.o))))"
    return df.withColumn("w", weights).withColumn("best", F.expr(f"{fold}[{size - 1}]"))


#: Values hold what is lost above these bits and the tokens below.
COST_BITS = 40


def _bound(df: DataFrame, **columns: str) -> DataFrame:
    """Columns worked out once for a row, by a generator of one row."""
    fields = ", ".join(f"{expression} AS {name}" for name, expression in columns.items())
    return df.select("*", F.inline(F.array(F.expr(f"struct({fields})"))))


def attained_levels(fidelity: str, levels: tuple[float, ...], epsilon: float = 1e-12) -> str:
    """SQL of an array: how many levels each state reaches."""
    grid = f"array({', '.join(f'{x}D' for x in levels)})"
    return f"transform({fidelity}, f -> size(filter({grid}, l -> f + {epsilon}D >= l)))"


def trajectory_values(lattices: DataFrame, levels: tuple[float, ...], n: int) -> DataFrame:
    """``lattices`` (tokens and fidelity by mask) with attained and value: of each mask, by levels reached before, the best that follows.

    A packet is added at a time. A level counts when it is first reached and costs the tokens of that state; most levels come
    first, then least tokens. As fidelity may fall again, what was reached is part of the state. value packs (levels not
    reached, tokens); masks come in falling order, so each finds its supersets in the accumulator. worth is the value of coming to
    a mask, its own tokens included: a state's value is the least worth of the masks one packet above it.
    """
    if "attained" not in lattices.columns:
        lattices = _bound(lattices, attained=attained_levels("fidelity", levels))
    size, k = 1 << n, len(levels)
    above = "array(" + ", ".join("array(" + ", ".join(str(size - 1 - (m | 1 << b)) for b in range(n) if not m >> b & 1) + ")" for m in reversed(range(size - 1))) + ")"
    own = lambda values, m: f"transform({values}, (v, r) -> IF(r < attained[{m}], {values}[attained[{m}]] + (attained[{m}] - r) * tokens[{m}], v))"
    last = f"transform(sequence(0, {k}), r -> shiftleft({k}L - r, {COST_BITS}))"
    both = lambda z, m: f"transform(array({z}), z -> named_struct('v', z, 'w', {own('z', m)}))[0]"
    step = both(f"transform(sequence(0, {k}), r -> array_min(transform(x, i -> a[i].w[r])))", f"{size - 1} - size(a)")
    rows = _bound(lattices, _a=f"reverse(aggregate({above}, array({both(last, size - 1)}), (a, x) -> concat(a, array({step}))))")
    return rows.select("*", F.col("_a.v").alias("value"), F.col("_a.w").alias("worth")).drop("_a")


def _above(n: int) -> str:
    """SQL of an array by mask of the actions there: packet b and the mask m that it leads to."""
    size = 1 << n
    lists = ["array(" + ", ".join(f"named_struct('b', {b}, 'm', {m | 1 << b})" for b in range(n) if not m >> b & 1) + ")" for m in range(size - 1)]
    return "array(" + ", ".join([*lists, "CAST(array() AS array<struct<b: int, m: int>>)"]) + ")"


def action_value(reached: str, mask: str) -> str:
    """SQL of the value of adding packet b to ``mask``: the worth of the mask that it leads to."""
    return f"worth[{mask} | shiftleft(1, b)][{reached}]"


def state_actions(valued: DataFrame, n: int, states: str, key: str = "doc_id") -> DataFrame:
    """key, mask, reached, best, full, most, options (an array of packet and after): a row for each of the ``states`` that has actions."""
    made = f"transform(filter({states}, s -> s.m < {(1 << n) - 1}), s -> struct(s.m AS mask, s.r AS reached, value[s.m][s.r] AS best, transform(ways[s.m], y -> struct(y.b AS packet, worth[y.m][s.r] AS after)) AS options))"
    rows = valued.select(key, F.element_at("tokens", -1).alias("full"), F.array_max("tokens").alias("most"), F.expr(made.replace("ways[", f"{_above(n)}[")).alias("_s"))
    rows = _bound(rows, _states="_s").drop("_s")
    return rows.select(key, "full", "most", F.explode("_states").alias("_s")).select(key, "_s.mask", "_s.reached", "_s.best", "full", "most", "_s.options")


def actions(valued: DataFrame, n: int, states: str, key: str = "doc_id") -> DataFrame:
    """key, mask, reached, packet, value, best: every action of the states in the array ``states`` of structs (m, r)."""
    rows = state_actions(valued, n, states, key)
    return rows.select(key, "mask", "reached", "best", "full", "most", F.explode("options").alias("_o")).select(key, "mask", "reached", "best", "full", "most", "_o.packet", "_o.after")


def order_actions(valued: DataFrame, order: str, masks: Column, *keep: str) -> DataFrame:
    """``keep``, depth, mask, reached, packet, best, after, most: the actions that an order (an array of packets, passing ``masks``) takes, in its row."""
    rows = valued.select("*", F.inline(F.array(F.struct(masks.alias("_masks")))))
    rows = rows.select("*", F.inline(F.array(F.struct(F.transform("_masks", lambda m: F.get("attained", m)).alias("_att")))))
    rows = rows.select(*keep, "_masks", "_att", "value", "worth", F.array_max("tokens").alias("most"), F.posexplode(order).alias("depth", "packet"))
    rows = rows.select(*keep, "depth", "packet", "_masks", "value", "worth", "most", F.get("_masks", "depth").alias("mask"), F.array_max(F.slice("_att", F.lit(1), F.col("depth") + 1)).alias("reached"))
    best, after = F.get(F.get("value", "mask"), "reached"), F.get(F.get("worth", F.get("_masks", F.col("depth") + 1)), "reached")
    return rows.select(*keep, "depth", "mask", "reached", "packet", best.alias("best"), after.alias("after"), "most")


def every_state(n: int, k: int) -> str:
    return f"flatten(transform(sequence(0, {(1 << n) - 1}), m -> transform(sequence(0, {k}), r -> struct(m AS m, r AS r))))"


def is_optimal(after: Column, k: int, slack: float = 0.0) -> Column:
    """Whether an action reaches as much as the best and costs at most ``slack`` * levels * full tokens more."""
    low = (1 << COST_BITS) - 1
    least = F.col("best").bitwiseAND(low)
    return (F.shiftright(after, COST_BITS) == F.shiftright("best", COST_BITS)) & (after.bitwiseAND(low) <= least + slack * k * F.col("full") + 1e-9)


def advantage(after: Column, k: int) -> tuple[Column, Column, Column]:
    """What an action loses against the best: levels, tokens as a share of levels * most tokens, and 2 * levels + tokens."""
    low = (1 << COST_BITS) - 1
    lost = F.shiftright(after, COST_BITS) - F.shiftright("best", COST_BITS)
    share = (after.bitwiseAND(low) - F.col("best").bitwiseAND(low)) / F.nullif(k * F.col("most"), F.lit(0))
    return lost, share, F.greatest(F.lit(0.0), 2.0 * lost + share)


def advantages(rows: DataFrame, k: int) -> DataFrame:
    """Adds lost, token_share and advantage of each action."""
    lost, share, gain = advantage(F.col("after"), k)
    return rows.withColumns({"lost": lost, "token_share": share, "advantage": gain})


def canonical_rollout(valued: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """The smallest best action again and again: the order, levels reached, cumulative tokens, and how many best actions there were."""
    after = action_value("a.r", "a.m")
    best = f"filter(sequence(0, {n - 1}), b -> (a.m & shiftleft(1, b)) = 0 AND {after} = value[a.m][a.r])"
    now = "(a.m | shiftleft(1, x[0]))"
    step = (
        f"transform(array({best}), x -> named_struct('m', {now}, 'r', greatest(a.r, attained[{now}]), "
        f"'c', a.c + (greatest(a.r, attained[{now}]) - a.r) * tokens[{now}], 'o', concat(a.o, array(x[0])), 's', concat(a.s, array(size(x)))))[0]"
    )
    start = "named_struct('m', 0, 'r', attained[0], 'c', attained[0] * tokens[0], 'o', CAST(array() AS array<int>), 's', CAST(array() AS array<int>))"
    out = _bound(valued, walk=f"aggregate(sequence(1, {n}), {start}, (a, i) -> {step})")
    shown = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return out.select(key, shown("walk.o").alias("packet_order"), F.col("walk.r").alias("reached"), F.col("walk.c").alias("tokens"), shown("walk.s").alias("n_best"))


def with_seen(valued: DataFrame, n: int) -> DataFrame:
    """Adds seen: of each mask, what some order of its packets has reached on its way; sets of levels are bits, masks rise."""
    below = "array(" + ", ".join("array(" + ", ".join(str(m ^ 1 << b) for b in range(n) if m >> b & 1) + ")" for m in range(1, 1 << n)) + ")"
    past = "aggregate(x, 0, (s, y) -> s | a[y])"
    step = f"transform(array({past}), s -> transform(array(attained[size(a)]), t -> (s & ~(shiftleft(1, t) - 1)) | IF((s & (shiftleft(1, t + 1) - 1)) <> 0, shiftleft(1, t), 0))[0])[0]"
    return _bound(valued, seen=f"aggregate({below}, array(shiftleft(1, attained[0])), (a, x) -> concat(a, array({step})))")


def seen_states(k: int) -> str:
    """SQL of the states that orders come to, as ``every_state``."""
    return f"flatten(transform(seen, (x, m) -> transform(filter(sequence(0, {k}), r -> (x & shiftleft(1, r)) <> 0), r -> struct(m AS m, r AS r))))"


def reachable_histories(valued: DataFrame, n: int, k: int, key: str = "doc_id") -> DataFrame:
    """key, mask, reached: a row for each state that orders come to."""
    return with_seen(valued, n).select(key, F.explode(F.expr(seen_states(k))).alias("_s")).select(key, F.col("_s.m").alias("mask"), F.col("_s.r").alias("reached"))


def history_dependence(valued: DataFrame, n: int, k: int, key: str = "doc_id") -> DataFrame:
    """key, n_masks with actions that orders come to, n_several (with different levels reached) and n_differ (whose best actions then differ), in its row."""
    best = f"transform(filter(sequence(0, {k}), r -> (x.s & shiftleft(1, r)) <> 0), r -> aggregate(x.o, 0, (s, y) -> s | IF(worth[y.m][r] = x.v[r], shiftleft(1, y.b), 0)))"
    states = f"slice(transform(arrays_zip(seen, value, {_above(n)}), x -> named_struct('s', x.seen, 'v', x.value, 'o', x.`2`)), 1, {(1 << n) - 1})"
    rows = _bound(with_seen(valued, n), _sets=f"transform({states}, x -> {best})").select(key, "_sets")
    count = lambda test: F.size(F.filter("_sets", test)).cast("long")
    return rows.select(
        key, count(lambda s: F.size(s) > 0).alias("n_masks"), count(lambda s: F.size(s) > 1).alias("n_several"), count(lambda s: F.size(F.array_distinct(s)) > 1).alias("n_differ")
    )


def supervision_histories(valued: DataFrame, n: int, k: int, seed: str, best_runs: int = 4, random_runs: int = 4, slack: float = 0.0, key: str = "doc_id") -> DataFrame:
    """key, history (packets so far), mask, reached, actions (the best ones there), source, n_runs: what to learn from, each history once.

    Runs go through all packets: ``best_runs`` by best actions, one for each depth that takes the nearest action that is not a best
    one there (a best one if there is no other), ``random_runs`` by any action. Where a run may choose, the least hash of seed,
    key, run, depth and packet does, so the same seed gives the same rows. ``source`` is the first run that has the history,
    n_runs how many do. A fold per run in the row of its lattice: nothing is shuffled.
    """
    bit = "shiftleft(1, b)"
    after = action_value("a.r", "a.m")
    low = (1 << COST_BITS) - 1
    best = f"shiftright({after}, {COST_BITS}) = shiftright(value[a.m][a.r], {COST_BITS}) AND ({after} & {low}L) <= (value[a.m][a.r] & {low}L) + {slack}D * {k} * tokens[{(1 << n) - 1}] + 1e-9D"
    pick = f"array_min(transform({{}}, b -> struct(md5(concat_ws(':', '{seed}', {key}, x.no, d, b)) AS h, b AS b))).b"
    nearest = f"array_min(transform(array_except(free, opt), b -> struct({after} AS v, b AS b))).b"
    chosen = f"CASE WHEN x.kind = 'random' THEN {pick.format('free')} WHEN x.kind = 'deviation' AND x.which = d AND size(opt) < size(free) THEN {nearest} ELSE {pick.format('opt')} END"
    moved = "a.m | shiftleft(1, p)"
    step = (
        f"transform(array(filter(sequence(0, {n - 1}), b -> (a.m & {bit}) = 0)), free -> transform(array(filter(free, b -> {best})), opt -> transform(array({chosen}), p -> "
        f"named_struct('m', {moved}, 'r', greatest(a.r, attained[{moved}]), 'h', concat(a.h, array(p)), "
        "'rows', concat(a.rows, array(named_struct('history', a.h, 'mask', a.m, 'reached', a.r, 'actions', opt)))))[0])[0])[0]"
    )
    start = "named_struct('m', 0, 'r', attained[0], 'h', CAST(array() AS array<int>), 'rows', CAST(array() AS array<struct<history: array<int>, mask: int, reached: int, actions: array<int>>>))"
    kinds = [("best", i) for i in range(best_runs)] + [("deviation", i) for i in range(n)] + [("random", i) for i in range(random_runs)]
    runs = "array(" + ", ".join(f"named_struct('kind', '{kind}', 'which', {which}, 'no', {no})" for no, (kind, which) in enumerate(kinds)) + ")"
    walks = f"transform({runs}, x -> transform(aggregate(sequence(0, {n - 1}), {start}, (a, d) -> {step}).rows, y -> named_struct('source', concat(x.kind, '_', x.which), 'row', y)))"
    rows = _bound(valued, met=f"flatten({walks})")
    rows = _bound(rows, firsts="array_distinct(transform(met, z -> z.row.history))")
    one = "transform(firsts, f -> transform(array(filter(met, z -> z.row.history = f)), own -> named_struct('history', f, 'mask', own[0].row.mask, 'reached', own[0].row.reached, 'actions', own[0].row.actions, 'source', own[0].source, 'n_runs', size(own)))[0])"
    return rows.select(key, F.inline(F.expr(one)))
