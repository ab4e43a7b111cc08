"""Queries over lattices and frontiers of the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frontier as fr
from ..operators import lattice as lt
from . import base
from .base import LEVELS, N_PACKETS
from .registry import query
from .sql import TABLES

N = N_PACKETS
LEX = " + ".join(f"((mask >> {i}) & 1) * {1 << (N - 1 - i)}" for i in range(N))
FULL = (1 << N) - 1
K = len(LEVELS)

TABLES["pairs"] = "SELECT a.mask AS lo, b.mask AS hi FROM masks a, masks b WHERE a.mask & b.mask = a.mask"
TABLES["frontier"] = f"""SELECT doc_id, level_id, level, count(*) FILTER (fidelity >= level) > 0 AS feasible, first(tokens ORDER BY tokens, size, lex) FILTER (fidelity >= level) AS tokens,
    first(mask ORDER BY tokens, size, lex) FILTER (fidelity >= level) AS mask, first(fidelity ORDER BY tokens, size, lex) FILTER (fidelity >= level) AS fidelity
    FROM (SELECT *, {LEX} AS lex FROM states), levels GROUP BY doc_id, level_id, level"""
for _k, _x in enumerate(LEVELS):
    TABLES[f"up{_k}"] = (
        f"SELECT doc_id, mask, tokens AS cost, 0 AS parent FROM states WHERE fidelity >= {_x}"
        if _k == 0
        else f"SELECT s.doc_id, s.mask, s.tokens + min(d.cost) AS cost, arg_min(d.mask, d.cost * 64 + d.mask) AS parent FROM states s JOIN pairs ON hi = s.mask JOIN up{_k - 1} d ON d.doc_id = s.doc_id AND d.mask = lo WHERE s.fidelity >= {_x} GROUP BY s.doc_id, s.mask, s.tokens"
    )
TABLES["ends"] = " UNION ALL ".join(f"SELECT doc_id, {k} AS level_id, arg_min(mask, cost * 64 + mask) AS mask, min(cost) AS cumulative FROM up{k} GROUP BY doc_id" for k in range(K))
TABLES["tops"] = "SELECT * FROM ends QUALIFY level_id = max(level_id) OVER (PARTITION BY doc_id)"
for _k in reversed(range(K)):
    _top = f"SELECT doc_id, mask FROM tops WHERE level_id = {_k}"
    TABLES[f"link{_k}"] = _top if _k == K - 1 else f"{_top} UNION ALL SELECT doc_id, parent FROM link{_k + 1} JOIN up{_k + 1} USING (doc_id, mask)"
TABLES["chain"] = " UNION ALL ".join(f"SELECT l.doc_id, {k} AS level_id, CAST({x} AS DOUBLE) AS level, l.mask, s.tokens, u.cost AS cumulative FROM link{k} l JOIN states s USING (doc_id, mask) JOIN up{k} u USING (doc_id, mask)" for k, x in enumerate(LEVELS))
TABLES["gaps"] = """SELECT f.doc_id, f.level_id, f.tokens AS independent_tokens, c.tokens AS nested_tokens, c.tokens - f.tokens AS gap, (c.tokens - f.tokens) / nullif(f.tokens, 0) AS gap_share
    FROM frontier f LEFT JOIN chain c USING (doc_id, level_id)"""
TABLES["optima"] = "SELECT doc_id, level_id, mask, tokens FROM states, levels WHERE fidelity >= level QUALIFY tokens = min(tokens) OVER (PARTITION BY doc_id, level_id)"


def _states(spark, sf_dir):
    return base.states(spark, sf_dir)


def _lattice(spark, sf_dir):
    return base.lattice(spark, sf_dir)


@query("SELECT doc_id, printf('%d%d%d%d', d1, d2, d3, d4) AS state FROM documents, (SELECT a.range AS d1, b.range AS d2, c.range AS d3, d.range AS d4 FROM range(3) a, range(3) b, range(3) c, range(3) d)")
def e01_ternary_lattice(spark, sf_dir):
    rows = lt.ternary_lattice(base.table(spark, sf_dir, "documents").select("doc_id"), 4)
    return rows.select("doc_id", F.array_join(F.transform("state", lambda x: x.cast("string")), "").alias("state"))


@query(f"SELECT doc_id, mask, array_to_string(list_transform(range({N}), lambda i: (mask >> i) & 1), '') AS state, mask AS again FROM states")
def e03_mask_state(spark, sf_dir):
    rows = _states(spark, sf_dir).select("doc_id", "mask", lt.mask_to_state(F.col("mask"), N).alias("s"))
    return rows.select("doc_id", "mask", F.array_join(F.transform("s", lambda x: x.cast("string")), "").alias("state"), lt.state_to_mask(F.col("s")).alias("again"))


@query("SELECT doc_id, count(*) AS n_states, '' AS errors FROM states GROUP BY doc_id")
def e06_completeness(spark, sf_dir):
    return lt.completeness(_states(spark, sf_dir), N)


@query("SELECT doc_id, reached, count(*) AS n FROM (SELECT doc_id, mask, count(level) FILTER (fidelity + 1e-12 >= level) AS reached FROM states, levels GROUP BY ALL) GROUP BY ALL")
def e07_attained_levels(spark, sf_dir):
    return lt.attained(_states(spark, sf_dir), LEVELS).groupBy("doc_id", "reached").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT doc_id, count(*) FILTER (fidelity >= 0.1) AS n_positive, min(size) FILTER (fidelity >= 0.1) AS min_size, max(size) FILTER (fidelity >= 0.1) AS max_size,
    bit_and(mask) FILTER (fidelity >= 0.1) AS in_all, bit_or(mask) FILTER (fidelity >= 0.1) AS in_any, max(CASE WHEN mask = {FULL} THEN CAST(fidelity >= 0.1 AS INT) END) AS "full" FROM states GROUP BY doc_id""")
def e09_lattice_profile(spark, sf_dir):
    return lt.profile(_states(spark, sf_dir), 0.10, N)


@query("""profile AS (SELECT doc_id, count(*) FILTER (fidelity >= 0.1) AS p, min(size) FILTER (fidelity >= 0.1) AS m FROM states GROUP BY doc_id)
SELECT lang, CASE WHEN p = 0 THEN 'none' WHEN p <= 8 THEN 'few' ELSE 'many' END AS stratum, count(*) AS n, avg(p) AS mean_positive, median(p) AS median_positive, min(m) AS min_size, max(m) AS max_size
FROM profile JOIN documents USING (doc_id) GROUP BY ALL""")
def e10_profile_by_family(spark, sf_dir):
    rows = lt.profile(_states(spark, sf_dir), 0.10, N).join(base.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    p = F.col("n_positive")
    rows = rows.withColumn("stratum", F.when(p == 0, "none").when(p <= 8, "few").otherwise("many"))
    return rows.groupBy("lang", "stratum").agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_positive"), F.median(p).alias("median_positive"), F.min("min_size").alias("min_size"), F.max("min_size").alias("max_size")
    )


@query("SELECT doc_id, hi AS mask, min(tokens) AS least FROM states s JOIN pairs ON s.mask = lo AND fidelity >= 0.05 GROUP BY doc_id, hi")
def e12_subset_minimum(spark, sf_dir):
    df = lt.dense(_lattice(spark, sf_dir)).withColumn("v", F.zip_with("tokens", "fidelity", lambda t, f: F.when(f >= 0.05, t).otherwise(F.lit(fr.FAR))))
    return lt.zeta(df, "v", N).select("doc_id", F.posexplode("v").alias("mask", "least")).where(F.col("least") < fr.FAR)


@query("SELECT doc_id, lo AS mask, min(tokens) AS least FROM states s JOIN pairs ON s.mask = hi AND fidelity >= 0.05 GROUP BY doc_id, lo")
def e12_superset_minimum(spark, sf_dir):
    df = lt.dense(_lattice(spark, sf_dir)).withColumn("v", F.zip_with("tokens", "fidelity", lambda t, f: F.when(f >= 0.05, t).otherwise(F.lit(fr.FAR))))
    return lt.zeta(df, "v", N, down=False).select("doc_id", F.posexplode("v").alias("mask", "least")).where(F.col("least") < fr.FAR)


@query("SELECT level_id, level, count(*) AS n_states FROM states JOIN levels ON fidelity >= level GROUP BY ALL")
def f01_level_grid(spark, sf_dir):
    grid = fr.parse_levels(",".join(str(x) for x in LEVELS))
    return fr.at_levels(_states(spark, sf_dir), grid).where("fidelity >= level").groupBy("level_id", "level").agg(F.count(F.lit(1)).alias("n_states"))


@query("""steps AS (SELECT doc_id, fidelity, coalesce(CAST(fidelity - lag(fidelity) OVER (PARTITION BY doc_id ORDER BY fidelity) > 1e-12 AS INT), 1) AS new FROM (SELECT DISTINCT doc_id, fidelity FROM states WHERE fidelity > 0)),
islands AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY fidelity) AS rank FROM steps)
SELECT doc_id, CAST(rank AS BIGINT) AS rank, min(fidelity) AS level FROM islands GROUP BY ALL""")
def f02_attainable_levels(spark, sf_dir):
    return fr.attainable_levels(_states(spark, sf_dir))


@query("SELECT * FROM frontier")
def f03_independent_frontier(spark, sf_dir):
    return fr.independent_frontier(_lattice(spark, sf_dir), LEVELS, N)


@query("SELECT * FROM optima")
def f04_tied_optima(spark, sf_dir):
    return fr.tied_optima(_states(spark, sf_dir), LEVELS)


@query("SELECT s.doc_id, count(*) AS n_pairs FROM states s JOIN pairs ON lo = s.mask JOIN states t ON t.doc_id = s.doc_id AND t.mask = hi WHERE s.fidelity >= 0.05 AND t.fidelity >= 0.1 GROUP BY s.doc_id")
def f05_nested_pairs(spark, sf_dir):
    """Of each low state the high ones above it are counted by one fold over the packets."""
    above = f"aggregate(sequence(0, {N - 1}), transform(fidelity, f -> IF(f >= 0.1D, 1L, 0L)), (a, b) -> transform(a, (x, m) -> x + IF((m & shiftleft(1, b)) = 0, a[m | shiftleft(1, b)], 0L)))"
    rows = base._once(base.lattice(spark, sf_dir), above=F.expr(above))
    low = F.zip_with("fidelity", "above", lambda f, n: F.when(f >= 0.05, n).otherwise(0))
    return rows.select("doc_id", F.aggregate(low, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_pairs")).where("n_pairs > 0")


@query("SELECT * FROM chain")
def f07_nested_chain(spark, sf_dir):
    return fr.nested_chain(_lattice(spark, sf_dir), LEVELS, N)


@query("SELECT f.doc_id, f.level_id, f.feasible, f.tokens, f.mask, c.tokens AS nested_tokens, c.mask AS nested_mask, c.cumulative FROM frontier f LEFT JOIN chain c USING (doc_id, level_id)")
def f08_both_frontiers(spark, sf_dir):
    s = _lattice(spark, sf_dir)
    chain = fr.nested_chain(s, LEVELS, N).select("doc_id", "level_id", F.col("tokens").alias("nested_tokens"), F.col("mask").alias("nested_mask"), "cumulative")
    return fr.independent_frontier(s, LEVELS, N).select("doc_id", "level_id", "feasible", "tokens", "mask").join(chain, ["doc_id", "level_id"], "left")


@query("SELECT * FROM gaps")
def f09_structural_gaps(spark, sf_dir):
    s = _lattice(spark, sf_dir)
    return fr.structural_gaps(fr.independent_frontier(s, LEVELS, N), fr.nested_chain(s, LEVELS, N))


@query("""steps AS (SELECT doc_id, mask, tokens, lead(mask) OVER w AS next, lead(tokens) OVER w AS next_tokens FROM frontier WHERE feasible WINDOW w AS (PARTITION BY doc_id ORDER BY level_id)),
counts AS (SELECT doc_id, count(next) AS pairs, count(*) FILTER (next <> mask) AS switches, count(*) FILTER (mask & next <> mask) AS not_nested, count(*) FILTER (next_tokens > tokens) AS rises FROM steps GROUP BY doc_id)
SELECT *, CASE WHEN not_nested > 0 THEN 'not nested' WHEN switches > 0 THEN 'nested' ELSE 'constant' END AS verdict FROM counts""")
def f10_frontier_diagnostics(spark, sf_dir):
    return fr.diagnostics(fr.independent_frontier(_lattice(spark, sf_dir), LEVELS, N))


@query("""x AS (SELECT doc_id, level_id, feasible, mask & ~lead(mask) OVER w & 63 <> 0 AS broken, lead(tokens) OVER w < tokens AS falls FROM frontier WINDOW w AS (PARTITION BY doc_id ORDER BY level_id))
SELECT level_id, count(*) AS n, count(*) FILTER (feasible) AS n_feasible, count(*) FILTER (broken) AS violations, count(*) FILTER (falls) AS rate_decreases, avg(independent_tokens) AS independent_tokens, avg(nested_tokens) AS nested_tokens, avg(gap) AS gap, count(*) FILTER (gap > 0) AS n_gap
FROM x JOIN gaps USING (doc_id, level_id) GROUP BY level_id""")
def f11_frontier_summary(spark, sf_dir):
    return fr.frontier_summary(fr.with_frontiers(_lattice(spark, sf_dir), LEVELS, N), K)


@query("SELECT l.doc_id, l.level_id, bool_or(l.mask & h.mask = l.mask) AS any_nested, bool_and(l.mask & h.mask = l.mask) AS all_nested FROM optima l JOIN optima h ON h.doc_id = l.doc_id AND h.level_id = l.level_id + 1 AND h.tokens > l.tokens GROUP BY ALL")
def f12_nested_reuse(spark, sf_dir):
    return fr.nested_reuse(fr.tied_optima(_states(spark, sf_dir), LEVELS))


SLACKS = (0.0, 0.02, 0.10)
_best = "(SELECT doc_id, max(level_id) + 1 AS active FROM levels, best WHERE best.best >= level GROUP BY doc_id)"
TABLES["actives"] = f"SELECT doc_id, active, tokens AS \"full\" FROM {_best} JOIN states USING (doc_id) WHERE mask = {FULL}"
for _k in reversed(range(K)):
    _x = LEVELS[_k]
    TABLES[f"down{_k}"] = (
        f"SELECT doc_id, mask, tokens AS cost, 0 AS after FROM states JOIN actives USING (doc_id) WHERE fidelity >= {_x} AND active = {_k + 1}"
        + ("" if _k == K - 1 else f" UNION ALL SELECT s.doc_id, s.mask, s.tokens + min(d.cost), min(d.cost) FROM states s JOIN actives a ON a.doc_id = s.doc_id AND a.active > {_k + 1} JOIN pairs ON lo = s.mask JOIN down{_k + 1} d ON d.doc_id = s.doc_id AND d.mask = hi WHERE s.fidelity >= {_x} GROUP BY s.doc_id, s.mask, s.tokens")
    )
TABLES["whole_costs"] = " UNION ALL ".join(f"SELECT doc_id, {k} AS level_id, mask, u.cost + d.after AS cost FROM up{k} u JOIN down{k} d USING (doc_id, mask)" for k in range(K))
TABLES["members"] = f"""SELECT doc_id, slack, level_id, mask, CAST(cost AS BIGINT) AS cost FROM whole_costs JOIN actives USING (doc_id), (VALUES {", ".join(f"(CAST({s} AS DOUBLE))" for s in SLACKS)}) v(slack)
    QUALIFY cost <= min(cost) OVER (PARTITION BY doc_id) + slack * active * "full" + 1e-9"""
TABLES["bits"] = f"SELECT CAST(range AS INT) AS packet FROM range({N})"
TABLES["shares"] = "SELECT doc_id, slack, level_id, packet, avg(CAST((mask >> packet) & 1 AS DOUBLE)) AS share FROM members, bits GROUP BY ALL"
TABLES["precedences"] = """SELECT doc_id, slack, w.packet AS winner, l.packet AS loser FROM members, bits w, bits l WHERE w.packet <> l.packet GROUP BY ALL
    HAVING bool_or((mask >> w.packet) & 1 = 1 AND (mask >> l.packet) & 1 = 0) AND NOT bool_or((mask >> l.packet) & 1 = 1 AND (mask >> w.packet) & 1 = 0)"""


def _members(spark, sf_dir):
    return fr.chain_membership(_lattice(spark, sf_dir), LEVELS, N, SLACKS)


@query("SELECT * FROM members WHERE slack = 0.02")
def f13_chain_membership(spark, sf_dir):
    return fr.chain_membership(_lattice(spark, sf_dir), LEVELS, N, (0.02,))


@query("SELECT doc_id, slack, level_id, count(*) AS n FROM members GROUP BY ALL")
def f14_membership_by_slack(spark, sf_dir):
    return _members(spark, sf_dir).groupBy("doc_id", "slack", "level_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT *, CASE share WHEN 1 THEN 'always' WHEN 0 THEN 'never' ELSE 'ambiguous' END AS kind FROM shares")
def f15_membership_summary(spark, sf_dir):
    return fr.membership_summary(_members(spark, sf_dir), N)


@query("SELECT * FROM precedences")
def f16_precedence_pairs(spark, sf_dir):
    return fr.precedence(_members(spark, sf_dir), N)


@query("""pairs_of AS (SELECT doc_id, slack, string_agg(winner || '>' || loser, ',' ORDER BY winner, loser) AS preferences, count(*) AS n_preferences FROM precedences GROUP BY ALL),
never AS (SELECT doc_id, slack, string_agg(packet, ',' ORDER BY packet) AS never_reveal FROM (SELECT doc_id, slack, packet FROM shares GROUP BY ALL HAVING max(share) = 0) GROUP BY ALL)
SELECT doc_id, slack, coalesce(preferences, '') AS preferences, coalesce(n_preferences, 0) AS n_preferences, coalesce(never_reveal, '') AS never_reveal FROM (SELECT DISTINCT doc_id, slack FROM members) LEFT JOIN pairs_of USING (doc_id, slack) LEFT JOIN never USING (doc_id, slack)""")
def f17_oracle_rows(spark, sf_dir):
    rows = fr.with_member_counts(_lattice(spark, sf_dir), LEVELS, N, SLACKS).where("n_members[0] > 0")
    listed = lambda c, show: F.array_join(F.transform(c, show), ",")
    found = lambda at, p: F.aggregate(F.sequence(F.lit(0), F.lit(K - 1)), F.lit(0), lambda s, k: s + F.get("n_having", (at * K + k) * N + p))
    never = lambda at: F.filter(F.sequence(F.lit(0), F.lit(N - 1)), lambda p: found(at, p) == 0)
    each = [F.struct(F.lit(float(s)).alias("slack"), fr.preferred(N, at).alias("pairs"), never(at).alias("never")) for at, s in enumerate(SLACKS)]
    rows = rows.select("doc_id", F.inline(F.array(*each)))
    pair = lambda p: F.concat_ws(">", p["winner"].cast("string"), p["loser"].cast("string"))
    return rows.select(
        "doc_id", "slack", listed("pairs", pair).alias("preferences"), F.size("pairs").cast("long").alias("n_preferences"), listed("never", lambda p: p.cast("string")).alias("never_reveal")
    )


TABLES["thresholds"] = f"SELECT p.doc_id, p.packet_id, coalesce(min(level) FILTER ((mask >> p.packet_id) & 1 = 1), 1.0) AS threshold, coalesce(min(level_id) FILTER ((mask >> p.packet_id) & 1 = 1), {K}) AS bin FROM packets p JOIN chain USING (doc_id) GROUP BY ALL"


def _thresholds(spark, sf_dir):
    return fr.reveal_thresholds(fr.nested_chain(_lattice(spark, sf_dir), LEVELS, N), base.packets(spark, sf_dir), K)


@query("SELECT * FROM thresholds")
def f18_reveal_thresholds(spark, sf_dir):
    return _thresholds(spark, sf_dir)


@query("SELECT doc_id, level_id, CAST(sum(CASE WHEN level >= threshold THEN 1 << packet_id ELSE 0 END) AS BIGINT) AS mask FROM thresholds, levels GROUP BY ALL")
def b15_state_at_level(spark, sf_dir):
    return fr.state_at_level(_thresholds(spark, sf_dir), LEVELS)


@query("SELECT doc_id, string_agg(packet_id, ',' ORDER BY bin, packet_id) AS packet_order FROM thresholds GROUP BY doc_id")
def f19_order_from_chain(spark, sf_dir):
    return fr.order_from_thresholds(_thresholds(spark, sf_dir))


for _k, _x in enumerate(LEVELS):
    TABLES[f"walk{_k}"] = (
        f"SELECT doc_id, arm, depth, tokens AS cost, [depth] AS depths FROM prefixes WHERE fidelity >= {_x}"
        if _k == 0
        else f"SELECT p.doc_id, p.arm, p.depth, p.tokens + min(w.cost) AS cost, list_append(first(w.depths ORDER BY w.cost, w.depths), p.depth) AS depths FROM prefixes p JOIN walk{_k - 1} w ON w.doc_id = p.doc_id AND w.arm = p.arm AND w.depth <= p.depth WHERE p.fidelity >= {_x} GROUP BY p.doc_id, p.arm, p.depth, p.tokens"
    )
TABLES["walks"] = " UNION ALL ".join(f"SELECT doc_id, arm, {k} AS k, cost, depths FROM walk{k}" for k in range(K))


@query("""last AS (SELECT * FROM walks QUALIFY k = max(k) OVER (PARTITION BY doc_id, arm)), lowest AS (SELECT doc_id, arm, first(cost ORDER BY cost, depths) AS cost, first(depths ORDER BY cost, depths) AS depths FROM last GROUP BY ALL)
SELECT doc_id, arm, cost, array_to_string(depths, ',') AS depths FROM (SELECT DISTINCT doc_id, arm FROM prefixes) LEFT JOIN lowest USING (doc_id, arm)""")
def f20_prefix_chain(spark, sf_dir):
    return fr.prefix_chain(base.walks(spark, sf_dir), LEVELS, ["doc_id", "arm"])


_POINTS = "points AS (SELECT arm, depth, count(*) FILTER (hit) AS success, CAST(sum(tokens) AS BIGINT) AS cost FROM hits GROUP BY ALL)"


@query(f"""{_POINTS} SELECT * FROM points p WHERE NOT EXISTS (SELECT 1 FROM points o WHERE o.arm = p.arm AND o.success >= p.success AND o.cost <= p.cost AND (o.success > p.success OR o.cost < p.cost))""")
def f22_pareto_depths(spark, sf_dir):
    points = base.hits(spark, sf_dir).groupBy("arm", "depth").agg(F.count(F.when(F.col("hit"), 1)).alias("success"), F.sum("tokens").alias("cost"))
    return fr.nondominated(points, ["arm"], "success", "cost")


@query("""joined AS (SELECT c.doc_id, c.depth, coalesce(bool_or(c.hit AND NOT b.hit), false) AS up, coalesce(bool_or(b.hit AND NOT c.hit), false) AS down FROM hits c JOIN hits b ON c.doc_id = b.doc_id AND c.depth = b.depth AND c.level_id = b.level_id WHERE c.arm = 'learned' AND b.arm = 'control' GROUP BY ALL)
SELECT doc_id, depth, CASE WHEN up AND down THEN 'mixed' WHEN up THEN 'better' WHEN down THEN 'worse' ELSE 'equal' END AS class FROM joined""")
def f23_dominance_class(spark, sf_dir):
    rows = base.hits(spark, sf_dir)
    return fr.dominance(rows.where("arm = 'learned'"), rows.where("arm = 'control'"), ["doc_id", "depth"])
