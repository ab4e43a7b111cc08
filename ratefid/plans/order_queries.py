"""Queries that change, repair or count orders, and chains of restricted states."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import functions as F

from ..operators import frontier as fr
from ..operators import lattice as lt
from ..operators import orders as od
from ..operators import trajectory as tr
from . import base
from .registry import query
from .sql import TABLES

N, LEVELS = base.N_PACKETS, base.LEVELS
K = len(LEVELS)
GOOD = LEVELS[0]
TARGET = LEVELS[1]
COUNTS = (1, 2, 3, 5)
DEPTHS = (2, 4)
SLACK = 0.02

_PAIRS = list(itertools.combinations(range(N), 2))
_NAMES = "abcdef"
_ROWS = ", ".join(f"bits {x}" for x in _NAMES)
_ALL = " + ".join(f"(1 << {x}.packet)" for x in _NAMES)
_DISTINCT = " AND ".join(f"{x}.packet <> {y}.packet" for x, y in itertools.combinations(_NAMES, 2))
_SIG = " + ".join(f"CAST(list_position(o, {i}) < list_position(o, {j}) AS INT) * {1 << k}" for k, (i, j) in enumerate(_PAIRS))
TABLES["perms"] = f"""SELECT o, array_to_string(o, ',') AS name, {_SIG} AS sig, list_transform(range(1, {N + 1}), lambda d: CAST(list_sum(list_transform(o[1:d], lambda p: 1 << p)) AS INT)) AS m
    FROM (SELECT [{", ".join(f"{x}.packet" for x in _NAMES)}] AS o FROM {_ROWS} WHERE {_DISTINCT})"""
TABLES["arm_perms"] = "SELECT doc_id, arm, name, sig, m FROM (SELECT doc_id, arm, string_agg(packet_id, ',' ORDER BY pos) AS name FROM orders GROUP BY ALL) x JOIN perms USING (name)"
TABLES["state_lists"] = f"SELECT doc_id, list(fidelity ORDER BY mask) AS f, list(tokens ORDER BY mask) AS t FROM states GROUP BY doc_id"
TABLES["pair_ids"] = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {j}, {k})" for k, (i, j) in enumerate(_PAIRS)) + ") v(low, high, id)"


def walks(spark, sf_dir, arm=None):
    """The lattice with arm, own (its order) and path: the masks that it passes, from the empty one on."""
    rows = base._ordered(spark, sf_dir).withColumnRenamed("order", "own")
    rows = rows if arm is None else rows.where(F.col("arm") == arm)
    return tr._bound(rows, path="aggregate(own, array(0), (a, p) -> concat(a, array(element_at(a, -1) | shiftleft(1, p))))")


_RUN = " OR ".join(" AND ".join(f"f[m[{d + i}] + 1] >= {GOOD}" for i in range(3)) for d in range(1, N - 1))


@query(f"""found AS (SELECT s.doc_id, min(struct_pack(v := bit_count(xor(p.sig, q.sig)), o := q.name)) AS best FROM state_lists s JOIN arm_perms p ON p.doc_id = s.doc_id AND p.arm = 'learned' CROSS JOIN (SELECT name, sig, m AS m FROM perms) q
    WHERE {_RUN.replace("m[", "q.m[")} GROUP BY s.doc_id) SELECT s.doc_id, CAST(best.v AS INT) AS inversions, best.o AS packet_order FROM state_lists s LEFT JOIN found USING (doc_id)""")
def g16_nearest_stable_order(spark, sf_dir):
    rows = tr._bound(walks(spark, sf_dir, "learned"), good=f"transform(fidelity, f -> f >= {GOOD}D)")
    return od.nearest_stable_order(rows, "good", N)


_ATT = "att AS (SELECT doc_id, list(att ORDER BY mask) AS a, list(tokens ORDER BY mask) AS t FROM attained GROUP BY doc_id)"
_HITS = lambda p: " + ".join(f"a[{p}.m[{d}] + 1]" for d in DEPTHS)


@query(f"""{_ATT}, near AS (SELECT x.doc_id, q.name, {_HITS("q")} AS hits, {_HITS("q").replace("a[", "t[")} AS tokens, {" AND ".join(f"a[q.m[{d}] + 1] >= a[p.m[{d}] + 1]" for d in DEPTHS)} AS safe
    FROM att x JOIN arm_perms p ON p.doc_id = x.doc_id AND p.arm = 'learned' JOIN perms q ON bit_count(xor(p.sig, q.sig)) <= 2)
SELECT doc_id, count(*) AS n_orders, count(*) FILTER (safe) AS n_safe, CAST(first(hits ORDER BY hits DESC, tokens, name) FILTER (safe) AS INT) AS hits, CAST(first(tokens ORDER BY hits DESC, tokens, name) FILTER (safe) AS BIGINT) AS tokens, first(name ORDER BY hits DESC, tokens, name) FILTER (safe) AS packet_order FROM near GROUP BY doc_id""")
def g17_local_orders(spark, sf_dir):
    """Orders at most two inversions away that break no level at the fixed depths; of these most levels, then least tokens."""
    rows = od.local_orders(tr._bound(walks(spark, sf_dir, "learned"), attained=tr.attained_levels("fidelity", LEVELS)), N)
    at = lambda d: f"aggregate(slice(y, 1, {d}), 0, (s, p) -> s | shiftleft(1, p))"
    scored = ", ".join(f"attained[{at(d)}] AS a{d}, tokens[{at(d)}] AS t{d}" for d in DEPTHS)
    rows = tr._bound(rows, scored=f"transform(near, y -> struct({scored}, y AS o))")
    safe = " AND ".join(f"x.a{d} >= attained[path[{d}]]" for d in DEPTHS)
    total = lambda c: " + ".join(f"x.{c}{d}" for d in DEPTHS)
    rows = tr._bound(rows, safe=f"transform(filter(scored, x -> {safe}), x -> struct(-({total('a')}) AS lost, {total('t')} AS tokens, x.o AS o))")
    rows = rows.select("doc_id", F.size("near").cast("long").alias("n_orders"), F.size("safe").cast("long").alias("n_safe"), F.array_min("safe").alias("b"))
    return rows.select("doc_id", "n_orders", "n_safe", (-F.col("b.lost")).alias("hits"), "b.tokens", F.expr("array_join(transform(b.o, p -> string(p)), ',')").alias("packet_order"))


@query(f"""c AS (SELECT doc_id, bit_or(1 << id) AS care, bit_or(CASE WHEN winner < loser THEN 1 << id ELSE 0 END) AS val FROM precedences JOIN pair_ids ON low = least(winner, loser) AND high = greatest(winner, loser) WHERE slack = {SLACK} GROUP BY doc_id)
SELECT s.doc_id, count(*) FILTER (ok) AS extensions, count(*) FILTER (ok AND hit) AS hitting, count(*) FILTER (ok AND hit) / nullif(count(*) FILTER (ok), 0) AS share FROM (
    SELECT s.doc_id, p.sig & coalesce(care, 0) = coalesce(val, 0) AS ok, f[1] >= {TARGET} OR {" OR ".join(f"f[p.m[{d}] + 1] >= {TARGET}" for d in range(1, N + 1))} AS hit FROM state_lists s LEFT JOIN c USING (doc_id) CROSS JOIN perms p) s GROUP BY s.doc_id""")
def g20_linear_extensions(spark, sf_dir):
    rows = base._once(fr.with_member_counts(base.lattice(spark, sf_dir), LEVELS, N, (SLACK,)), pairs=fr.preferred(N))
    rows = tr._bound(rows, before=f"transform(sequence(0, {N - 1}), b -> aggregate(filter(pairs, p -> p.loser = b), 0, (s, p) -> s | shiftleft(1, p.winner)))")
    rows = od.linear_extensions(tr._bound(rows, good=f"transform(fidelity, f -> f >= {TARGET}D)"), "good", N)
    return rows.select("doc_id", "extensions", "hitting", (F.col("hitting") / F.nullif("extensions", F.lit(0))).alias("share"))


TABLES["border_crossings"] = """SELECT a.doc_id, a.arm, m.mask, count(*) FILTER ((m.mask >> a.packet_id) & 1 = 0 AND (m.mask >> b.packet_id) & 1 = 1) AS inversions
    FROM orders a JOIN orders b ON a.doc_id = b.doc_id AND a.arm = b.arm AND a.pos < b.pos CROSS JOIN masks m GROUP BY ALL"""


@query("""r AS (SELECT doc_id, arm, level_id, min(struct_pack(i := inversions, t := tokens, m := mask)) AS r FROM border_crossings JOIN states USING (doc_id, mask) JOIN levels ON fidelity >= level GROUP BY ALL)
SELECT r.doc_id, r.arm, r.level_id, CAST(r.r.i AS INT) AS inversions, r.r.t AS tokens, r.r.m AS mask, r.r.m & ~p.mask AS missing, p.mask & ~r.r.m AS intruders FROM r JOIN prefix_masks p ON p.doc_id = r.doc_id AND p.arm = r.arm AND p.depth = bit_count(r.r.m) WHERE r.r.i > 0""")
def g25_closest_repair(spark, sf_dir):
    """Orders with no prefix at a level that some state reaches, and the nearest such state."""
    return od.closest_repairs(walks(spark, sf_dir), LEVELS, N, ["doc_id", "arm"]).where("inversions > 0")


def _renamed(body: str) -> str:
    return re.sub(r"\b(states|up\d|ends|tops|link\d|chain)\b", r"tri_\1", body)


TABLES["tri_states"] = """SELECT s.* FROM states s JOIN (SELECT doc_id, list(1 << gist ORDER BY unit) AS g, list(1 << residual ORDER BY unit) AS r FROM (
    SELECT doc_id, unit, first(packet_id ORDER BY tokens, packet_id) AS gist, last(packet_id ORDER BY tokens, packet_id) AS residual FROM halves GROUP BY ALL) GROUP BY doc_id) USING (doc_id)
    WHERE """ + " AND ".join(f"(mask & r[{u}] = 0 OR mask & g[{u}] <> 0)" for u in range(1, N // 2 + 1))
for _name in [*(f"up{k}" for k in range(K)), "ends", "tops", *(f"link{k}" for k in range(K)), "chain"]:
    TABLES[f"tri_{_name}"] = _renamed(TABLES[_name])


@query("SELECT doc_id, level_id, " + " || ".join(f"CAST(bit_count(mask & {3 << 2 * u}) AS VARCHAR)" for u in range(N // 2)) + " AS state, tokens, cumulative FROM tri_chain")
def f06_tri_state_chain(spark, sf_dir):
    """Units of two packets, hidden, shown by the smaller one, or whole: the chain over these states only."""
    bit = lambda test, u: f"IF(tokens[{1 << 2 * u}] {test} tokens[{2 << 2 * u}], {1 << 2 * u}, {2 << 2 * u})"
    allowed = " AND ".join(f"((m & {bit('>', u)}) = 0 OR (m & {bit('<=', u)}) <> 0)" for u in range(N // 2))
    rows = base.lattice(spark, sf_dir).select("doc_id", "tokens", F.expr(f"transform(fidelity, (f, m) -> IF({allowed}, f, -1D))").alias("fidelity"))
    digits = [F.bit_count(F.col("mask").bitwiseAND(3 << 2 * u)).cast("string") for u in range(N // 2)]
    return fr.nested_chain(rows, LEVELS, N).select("doc_id", "level_id", F.concat(*digits).alias("state"), "tokens", "cumulative")


for _k, (_x, _c) in enumerate(zip(LEVELS, COUNTS, strict=True)):
    _own = f"CASE WHEN s.fidelity >= {_x} THEN 0 ELSE {1 << 40} END + s.tokens"
    TABLES[f"sized{_k}"] = (
        f"SELECT s.doc_id, s.mask, {_own} AS cost, 0 AS parent FROM states s WHERE s.size = {_c}"
        if _k == 0
        else f"SELECT s.doc_id, s.mask, {_own} + min(d.cost) AS cost, arg_min(d.mask, d.cost * 64 + d.mask) AS parent FROM states s JOIN pairs ON hi = s.mask JOIN sized{_k - 1} d ON d.doc_id = s.doc_id AND d.mask = lo WHERE s.size = {_c} GROUP BY s.doc_id, s.mask, s.tokens, s.fidelity"
    )
for _k in reversed(range(K)):
    TABLES[f"sized_link{_k}"] = (
        f"SELECT doc_id, arg_min(mask, cost * 64 + mask) AS mask, min(cost) >> 40 AS violations FROM sized{_k} GROUP BY doc_id"
        if _k == K - 1
        else f"SELECT doc_id, parent AS mask, violations FROM sized_link{_k + 1} JOIN sized{_k + 1} USING (doc_id, mask)"
    )
TABLES["sized_chain"] = " UNION ALL ".join(f"SELECT l.doc_id, {k} AS level_id, mask, tokens, CAST(violations AS BIGINT) AS violations FROM sized_link{k} l JOIN states USING (doc_id, mask)" for k in range(K))


def _sized(spark, sf_dir):
    return od.chain_at_counts(base.lattice(spark, sf_dir), LEVELS, COUNTS, N)


@query("SELECT * FROM sized_chain")
def f21_chain_at_counts(spark, sf_dir):
    return _sized(spark, sf_dir)


TABLES["four_arms"] = f"""SELECT doc_id, 'free order, free cut' AS arm, level_id, mask FROM chain
    UNION ALL SELECT doc_id, 'free order, fixed cut', level_id, mask FROM sized_chain
    UNION ALL SELECT doc_id, 'learned order, fixed cut', level_id, mask FROM prefixes JOIN (VALUES {", ".join(f"({k}, {c})" for k, c in enumerate(COUNTS))}) c(level_id, count) ON depth = c.count WHERE arm = 'learned'
    UNION ALL SELECT doc_id, 'learned order, free cut', CAST(level_id AS INT), mask FROM (SELECT doc_id, generate_subscripts(depths, 1) - 1 AS level_id, unnest(depths) AS depth FROM (
        SELECT doc_id, first(depths ORDER BY cost, depths) AS depths FROM (SELECT * FROM walks WHERE arm = 'learned' QUALIFY k = max(k) OVER (PARTITION BY doc_id)) GROUP BY doc_id)) JOIN (SELECT doc_id, depth, mask FROM prefixes WHERE arm = 'learned') USING (doc_id, depth)"""


@query("""SELECT a.arm, a.level_id, count(*) AS n, count(*) FILTER (s.fidelity >= level) AS successes, avg(s.tokens) AS tokens FROM four_arms a JOIN states s USING (doc_id, mask) JOIN levels USING (level_id) GROUP BY ALL""")
def i03_order_and_cut(spark, sf_dir):
    """What the order costs and what the cut costs: each of the two free (best for the document) or as it is."""
    lattices = base.lattice(spark, sf_dir)
    learned = base.prefixes(spark, sf_dir).where("arm = 'learned'").select("doc_id", "depth", "mask", "tokens", "fidelity")
    named = lambda df, arm: df.select("doc_id", F.lit(arm).alias("arm"), "level_id", "mask")
    grid = F.array(*[F.struct(F.lit(k).alias("level_id"), F.lit(c).alias("count")) for k, c in enumerate(COUNTS)])
    fixed = learned.select("doc_id", "mask", "depth", F.inline(grid)).where("depth = count")
    cut = fr.prefix_chain(base.walks(spark, sf_dir).where("arm = 'learned'"), LEVELS, ["doc_id", "arm"]).where("depths IS NOT NULL")
    cut = cut.select("doc_id", F.posexplode(F.split("depths", ",")).alias("level_id", "d")).select("doc_id", "level_id", F.col("d").cast("int").alias("depth"))
    arms = named(fr.nested_chain(lattices, LEVELS, N), "free order, free cut").unionByName(named(_sized(spark, sf_dir), "free order, fixed cut"))
    arms = arms.unionByName(named(fixed, "learned order, fixed cut")).unionByName(named(learned.join(cut, ["doc_id", "depth"]), "learned order, free cut"))
    rows = arms.join(lattices.select("doc_id", F.col("tokens").alias("t"), F.col("fidelity").alias("f")), "doc_id")
    level = F.get(F.array(*[F.lit(x) for x in LEVELS]), F.col("level_id"))
    rows = rows.select("arm", "level_id", F.get("t", F.col("mask")).alias("tokens"), (F.get("f", F.col("mask")) >= level).alias("hit"))
    return rows.groupBy("arm", "level_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("hit"), 1)).alias("successes"), F.avg("tokens").alias("tokens"))


@query(f"""e AS (SELECT p.doc_id, p.winner, p.loser, q.winner IS NOT NULL AS safety FROM precedences p LEFT JOIN precedences q ON q.doc_id = p.doc_id AND q.winner = p.winner AND q.loser = p.loser AND q.slack = 0.1 WHERE p.slack = {SLACK}),
g AS (SELECT e.doc_id, e.winner, e.loser, e.safety, sum(greatest(0.0, w.share - l.share)) AS mass FROM e JOIN shares w ON w.doc_id = e.doc_id AND w.slack = {SLACK} AND w.packet = e.winner JOIN shares l ON l.doc_id = e.doc_id AND l.slack = {SLACK} AND l.packet = e.loser AND l.level_id = w.level_id GROUP BY ALL),
t AS (SELECT doc_id, packet_id, tokens / nullif(sum(tokens) OVER (PARTITION BY doc_id), 0) AS part FROM packets),
r AS (SELECT g.doc_id, CASE WHEN safety THEN 'safety' ELSE 'rate' END AS kind, winner, loser, mass, mass * part AS exposure, CASE WHEN safety THEN 1 + mass + mass * part ELSE mass * part END AS raw FROM g JOIN t ON t.doc_id = g.doc_id AND t.packet_id = g.loser)
SELECT doc_id, kind, winner, loser, mass, exposure, raw / avg(raw) OVER (PARTITION BY doc_id, kind) AS weight FROM r WHERE kind = 'safety' OR raw > 0""")
def g24_tail_cost_edges(spark, sf_dir):
    """Preferences with what they weigh: how much more often the winner is in near-optimal states, times the loser's share of tokens.

    Those that hold under a larger slack too are safety edges. Weights have mean 1 in each document and kind.
    """
    rows = fr.with_member_counts(base.lattice(spark, sf_dir), LEVELS, N, (SLACK, 0.10))
    share = lambda p: f"n_having[k * {N} + p.{p}] / n_members[k]"
    mass = f"aggregate(filter(sequence(0, {K - 1}), k -> n_members[k] > 0), 0D, (s, k) -> s + greatest(0D, {share('winner')} - {share('loser')}))"
    part = f"tokens[shiftleft(1, p.loser)] / nullif(tokens[{(1 << N) - 1}], 0)"
    rows = base._once(rows, pairs=fr.preferred(N), wide=fr.preferred(N, 1))
    rows = tr._bound(rows, pairs_by_mass=f"transform(pairs, p -> struct(array_contains(wide, p) AS safety, p.winner AS winner, p.loser AS loser, {mass} AS mass, {part} AS part))")
    raw = "IF(x.safety, 1 + x.mass + x.mass * x.part, x.mass * x.part)"
    rows = tr._bound(rows, edges=f"filter(transform(pairs_by_mass, x -> struct(x.*, x.mass * x.part AS exposure, {raw} AS raw)), x -> x.safety OR x.raw > 0)".replace("x.*", "x.safety AS safety, x.winner AS winner, x.loser AS loser, x.mass AS mass"))
    mean = "aggregate(filter(edges, x -> {}), struct(0D AS s, 0L AS n), (a, x) -> struct(a.s + x.raw AS s, a.n + 1 AS n), a -> a.s / nullif(a.n, 0))".format
    rows = tr._bound(rows, safe=mean("x.safety"), rate=mean("NOT x.safety")).select("doc_id", "safe", "rate", F.inline("edges"))
    kind = F.when(F.col("safety"), "safety").otherwise("rate").alias("kind")
    return rows.select("doc_id", kind, "winner", "loser", "mass", "exposure", (F.col("raw") / F.when(F.col("safety"), F.col("safe")).otherwise(F.col("rate"))).alias("weight"))
