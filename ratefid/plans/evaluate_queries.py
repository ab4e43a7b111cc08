"""Queries that evaluate orders, policies and scores over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import frontier as fr
from ..operators import lattice as lt
from ..operators.split import range_rank
from . import base
from .registry import query
from .sql import TABLES

N, LEVELS = base.N_PACKETS, base.LEVELS
K = len(LEVELS)


def _labelled(spark, sf_dir):
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return base.table(spark, sf_dir, "labels").join(docs, "doc_id")


TABLES["labelled"] = "SELECT l.*, d.lang, d.source, d.n_chars FROM labels l JOIN documents d USING (doc_id)"
TABLES["sides"] = "SELECT b.doc_id, b.depth, b.level_id, b.hit AS base, c.hit AS candidate, c.hit AND NOT b.hit AS repair, b.hit AND NOT c.hit AS break, b.tokens AS base_tokens, c.tokens AS candidate_tokens FROM hits b JOIN hits c USING (doc_id, depth, level_id) WHERE b.arm = 'control' AND c.arm = 'learned'"


def _sides(spark, sf_dir):
    return base.sides(spark, sf_dir)


@query("""h AS (SELECT h.*, max(h.level_id) FILTER (h.active) OVER d AS top, bool_and(hit) OVER d AS every, CASE WHEN hit THEN h.tokens - f.tokens END AS regret
    FROM hits h JOIN frontier f ON f.doc_id = h.doc_id AND f.level_id = h.level_id WINDOW d AS (PARTITION BY h.doc_id, arm, depth))
SELECT arm, depth, level_id, grouping(level_id)::INT AS pooled, avg(hit::INT) AS success, count(hit) AS n_active, avg(tokens) AS tokens, avg(every::INT) FILTER (level_id = top) AS all_success,
    count(*) FILTER (level_id = top) AS n_highest, avg(regret) AS regret FROM h GROUP BY GROUPING SETS ((arm, depth, level_id), (arm, depth))""")
def i02_arm_summary(spark, sf_dir):
    """By arm, depth and level, and pooled over levels. all_success counts documents, each under its highest reachable level."""
    rows = base.regrets(spark, sf_dir).groupingSets([["arm", "depth", "level_id"], ["arm", "depth"]], "arm", "depth", "level_id")
    return rows.agg(
        F.grouping("level_id").cast("int").alias("pooled"),
        ev.rate("hit").alias("success"),
        F.count("hit").alias("n_active"),
        F.avg("tokens").alias("tokens"),
        ev.rate(F.when(F.col("top"), F.col("hit"))).alias("all_success"),
        F.count(F.when(F.col("top"), 1)).alias("n_highest"),
        F.avg("regret").alias("regret"),
    )


@query("""m AS (SELECT arm, depth, avg(hit::INT) AS success, avg(tokens) AS tokens FROM hits GROUP BY ALL)
SELECT arm, depth, concat_ws(',', CASE WHEN NOT coalesce(success >= 0.5, false) THEN 'success' END, CASE WHEN NOT coalesce(tokens <= 400, false) THEN 'tokens' END) AS failed, coalesce(success >= 0.5, false) AND coalesce(tokens <= 400, false) AS passed FROM m""")
def i06_threshold_gate(spark, sf_dir):
    m = base.hits(spark, sf_dir).groupBy("arm", "depth").agg(ev.rate("hit").alias("success"), F.avg("tokens").alias("tokens"))
    return ev.gate(m, {"success": ("success", "min", 0.5), "tokens": ("tokens", "max", 400)}, ["arm", "depth"])


@query("""s AS (SELECT arm, level_id, depth, avg(hit::INT) AS success FROM hits GROUP BY ALL), f AS (SELECT arm, level_id, coalesce(min(depth) FILTER (success >= 0.6), 6) AS own FROM s GROUP BY ALL)
SELECT arm, level_id, max(own) OVER (PARTITION BY arm ORDER BY level_id) AS depth FROM f""")
def i09_monotone_calibration(spark, sf_dir):
    s = base.hits(spark, sf_dir).groupBy("arm", "level_id", "depth").agg(ev.rate("hit").alias("success"))
    own = s.groupBy("arm", "level_id").agg(F.coalesce(F.min(F.when(F.col("success") >= 0.6, F.col("depth"))), F.lit(N)).alias("own"))
    return own.select("arm", "level_id", F.max("own").over(Window.partitionBy("arm").orderBy("level_id")).alias("depth"))


@query("SELECT arm, depth, count(DISTINCT doc_id) FILTER (active) AS eligible, avg(ok::INT) AS complete FROM (SELECT arm, depth, doc_id, bool_or(active) AS active, coalesce(bool_and(hit), true) AS ok FROM hits GROUP BY ALL) GROUP BY ALL")
def i10_fixed_depth_metrics(spark, sf_dir):
    rows = base.hits(spark, sf_dir).groupBy("arm", "depth", "doc_id").agg(F.bool_or("active").alias("active"), F.coalesce(F.bool_and("hit"), F.lit(True)).alias("ok"))
    return rows.groupBy("arm", "depth").agg(F.count(F.when(F.col("active"), 1)).alias("eligible"), ev.rate("ok").alias("complete"))


@query("""r AS (SELECT doc_id, lang, quality, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM labelled)
SELECT lang, fraction, count(*) AS covered, sum(1 - quality)::BIGINT AS risk FROM r, (SELECT unnest([0.1::DOUBLE, 0.25, 0.5, 1.0]) AS fraction) WHERE k <= ceil(n * fraction) GROUP BY ALL""")
def i11_risk_coverage(spark, sf_dir):
    rows = range_rank(_labelled(spark, sf_dir), ["lang"], [-F.col("n_chars"), F.col("doc_id")])
    rows = rows.withColumn("fraction", F.explode(F.array(*[F.lit(x) for x in (0.1, 0.25, 0.5, 1.0)]))).where(F.col("position") <= F.ceil(F.col("size") * F.col("fraction")))
    return rows.groupBy("lang", "fraction").agg(F.count(F.lit(1)).alias("covered"), F.sum(1 - F.col("quality")).alias("risk"))


@query("""s AS (SELECT *, level_id = max(level_id) FILTER (base IS NOT NULL) OVER d AS top, bool_and(base) OVER d AS b, bool_and(candidate) OVER d AS c FROM sides WINDOW d AS (PARTITION BY doc_id, depth))
SELECT depth, level_id, count(*) FILTER (candidate) AS successes, count(*) FILTER (repair) AS repairs, count(*) FILTER (break) AS breaks, CAST(sum(candidate_tokens - base_tokens) AS BIGINT) AS token_delta,
    count(*) FILTER (top AND c AND NOT b) AS complete_repairs, count(*) FILTER (top AND b AND NOT c) AS complete_breaks FROM s GROUP BY ALL""")
def i12_paired_summary(spark, sf_dir):
    """By depth and level. Complete repairs and breaks concern all levels that a document can reach; each counts under the highest of them."""
    n = lambda c: F.count(F.when(c, 1))
    return _sides(spark, sf_dir).groupBy("depth", "level_id").agg(
        n(F.col("candidate")).alias("successes"),
        n(F.col("repair")).alias("repairs"),
        n(F.col("break")).alias("breaks"),
        F.sum(F.col("candidate_tokens") - F.col("base_tokens")).alias("token_delta"),
        n(F.col("top") & F.col("repair")).alias("complete_repairs"),
        n(F.col("top") & F.col("break")).alias("complete_breaks"),
    )


@query("""d AS (SELECT doc_id, depth, count(*) FILTER (repair) AS repairs, coalesce(bool_or(break), false) AS breaks, max(candidate_tokens) AS tokens, max(base_tokens) AS base_tokens FROM sides GROUP BY ALL)
SELECT doc_id, first(depth ORDER BY repairs DESC, tokens, depth) AS depth FROM d WHERE NOT breaks AND tokens <= base_tokens GROUP BY doc_id""")
def i13_no_break_choice(spark, sf_dir):
    rows = _sides(spark, sf_dir).groupBy("doc_id", "depth").agg(
        F.count(F.when(F.col("repair"), 1)).alias("repairs"), F.coalesce(F.bool_or("break"), F.lit(False)).alias("breaks"), F.max("candidate_tokens").alias("tokens"), F.max("base_tokens").alias("base_tokens")
    )
    return rows.where("NOT breaks AND tokens <= base_tokens").groupBy("doc_id").agg(F.min_by("depth", F.struct(-F.col("repairs"), "tokens", "depth")).alias("depth"))


@query("""d AS (SELECT doc_id, depth, coalesce(bool_or(repair), false) AS r, coalesce(bool_or(break), false) AS b, max(candidate_tokens) < max(base_tokens) AS less FROM sides GROUP BY ALL)
SELECT depth, CASE WHEN r AND b THEN 'mixed_break' WHEN b THEN 'break' WHEN r THEN 'repair' WHEN less THEN 'safe_token_saving' ELSE 'no_gain' END AS class, count(*) AS n FROM d GROUP BY ALL""")
def i14_value_class(spark, sf_dir):
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    rows = _sides(spark, sf_dir).groupBy("doc_id", "depth").agg(some("repair").alias("r"), some("break").alias("b"), (F.max("candidate_tokens") < F.max("base_tokens")).alias("less"))
    kind = F.when(F.col("r") & F.col("b"), "mixed_break").when(F.col("b"), "break").when(F.col("r"), "repair").when(F.col("less"), "safe_token_saving").otherwise("no_gain")
    return rows.groupBy("depth", kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("""m AS (SELECT doc_id, arm, depth, coalesce(string_agg(level_id, ',' ORDER BY level_id) FILTER (NOT hit), '') AS failed FROM hits GROUP BY ALL) SELECT arm, depth, failed, count(*) AS n FROM m GROUP BY ALL""")
def i15_failure_masks(spark, sf_dir):
    failed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("hit"), F.col("level_id")))), lambda x: x.cast("string")), ",")
    rows = base.hits(spark, sf_dir).groupBy("doc_id", "arm", "depth").agg(failed.alias("failed"))
    return rows.groupBy("arm", "depth", "failed").agg(F.count(F.lit(1)).alias("n"))


@query("""f AS (SELECT doc_id, arm, depth, level_id, count(*) OVER (PARTITION BY doc_id, arm, depth) AS k FROM hits WHERE NOT hit)
SELECT x.arm, x.depth, x.level_id AS a, y.level_id AS b, count(*) AS n, count(*) FILTER (x.k = 1) AS alone FROM f x JOIN f y ON x.doc_id = y.doc_id AND x.arm = y.arm AND x.depth = y.depth AND x.level_id <= y.level_id GROUP BY ALL""")
def i15_failure_pairs(spark, sf_dir):
    """Documents that fail both of two levels, by arm and depth; with a = b those that fail it, and alone those that fail no other."""
    levels = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(float(x)).alias("level")) for i, x in enumerate(LEVELS)])
    rows = base.walks(spark, sf_dir).select("arm", "best", F.posexplode("fidelity").alias("depth", "f"))
    failed = F.transform(F.filter(levels, lambda x: (F.col("best") >= x["level"]) & (F.col("f") < x["level"])), lambda x: x["id"])
    rows = rows.select("arm", "depth", failed.alias("failed")).groupBy("arm", "depth", "failed").agg(F.count(F.lit(1)).alias("k"))  # at most 2 ** levels sets
    pairs = F.flatten(F.transform("failed", lambda x: F.transform(F.filter("failed", lambda y: y >= x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    rows = rows.select("arm", "depth", "k", F.when(F.size("failed") == 1, F.col("k")).otherwise(0).alias("own"), F.inline(pairs))
    return rows.groupBy("arm", "depth", "a", "b").agg(F.sum("k").alias("n"), F.sum("own").alias("alone"))


@query("""t AS (SELECT doc_id, arm, depth, tokens - lag(tokens) OVER w AS added, fidelity < lag(fidelity) OVER w AS rollback FROM prefixes WINDOW w AS (PARTITION BY doc_id, arm ORDER BY depth)),
f AS (SELECT doc_id, count(*) FILTER (tokens > 0) AS n_filled FROM packets GROUP BY doc_id)
SELECT arm, n_filled, depth, count(*) AS n, avg(added) AS added, avg(rollback::INT) AS rollbacks FROM t JOIN f USING (doc_id) WHERE added IS NOT NULL GROUP BY ALL""")
def i16_transitions(spark, sf_dir):
    """Steps along an order by arm, number of packets with tokens, and depth."""
    steps = F.transform(F.sequence(F.lit(1), F.lit(N)), lambda d: F.struct(d.alias("depth"), (F.get("tokens", d) - F.get("tokens", d - 1)).alias("tokens"), (F.get("fidelity", d) < F.get("fidelity", d - 1)).alias("rollback")))
    rows = base.walks(spark, sf_dir).select("arm", steps.alias("steps"))
    rows = rows.select("arm", F.size(F.filter("steps", lambda s: s["tokens"] > 0)).cast("long").alias("n_filled"), F.inline("steps"))
    return rows.groupBy("arm", "n_filled", "depth").agg(F.count(F.lit(1)).alias("n"), F.avg("tokens").alias("added"), ev.rate("rollback").alias("rollbacks"))


@query("""p AS (SELECT *, coalesce(bool_or(hit) OVER (PARTITION BY doc_id, arm, level_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM hits WHERE depth IN (2, 4, 6) AND active)
SELECT doc_id, arm, level_id, min(depth) FILTER (hit) AS first_success, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS cost FROM p WHERE NOT done GROUP BY ALL""")
def i17_probe_schedule(spark, sf_dir):
    before = Window.partitionBy("doc_id", "arm", "level_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    rows = base.hits(spark, sf_dir).where("depth IN (2, 4, 6) AND active").withColumn("done", F.coalesce(F.bool_or("hit").over(before), F.lit(False)))
    return rows.where("NOT done").groupBy("doc_id", "arm", "level_id").agg(F.min(F.when(F.col("hit"), F.col("depth"))).alias("first_success"), F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("cost"))


@query("""c AS (SELECT doc_id, arm, level_id, coalesce(min(depth) FILTER (hit), 6) AS depth FROM hits WHERE active GROUP BY ALL)
SELECT arm, level_id, depth, count(*) AS n FROM c GROUP BY ALL""")
def i20_depth_histogram(spark, sf_dir):
    rows = base.hits(spark, sf_dir).where("active").groupBy("doc_id", "arm", "level_id").agg(F.coalesce(F.min(F.when(F.col("hit"), F.col("depth"))), F.lit(N)).alias("depth"))
    return rows.groupBy("arm", "level_id", "depth").agg(F.count(F.lit(1)).alias("n"))


@query("""p AS (SELECT *, max(tokens) OVER (PARTITION BY doc_id, arm) AS whole FROM prefixes),
c AS (SELECT doc_id, arm, any_value(whole) AS whole, coalesce(min(depth) FILTER (recall >= 0.5), 6) AS "first", arg_max(depth, (recall - coalesce(tokens / nullif(whole, 0), 0), -depth)) AS best FROM p GROUP BY ALL),
r AS (SELECT doc_id, arm, whole, 'first' AS rule, "first" AS chosen FROM c UNION ALL SELECT doc_id, arm, whole, 'best', best FROM c),
d AS (SELECT doc_id, arm, rule, chosen, level_id, bool_or(hit) AS reachable, min(depth) FILTER (hit) AS own, bool_or(hit) FILTER (depth = chosen) AS ok, max(tokens) FILTER (depth = chosen) / nullif(any_value(whole), 0) AS share
    FROM r JOIN hits USING (doc_id, arm) WHERE active GROUP BY doc_id, arm, rule, chosen, level_id)
SELECT arm, rule, level_id, count(*) AS n, count(*) FILTER (ok) AS safe, avg(ok::INT) FILTER (reachable) AS hit_given_reachable, count(*) FILTER (NOT ok AND chosen < own) AS early, count(*) FILTER (NOT ok AND chosen > own) AS late,
    avg(share) AS context, avg(share) FILTER (ok) AS context_of_hits, avg(CASE WHEN ok THEN share ELSE 1 + share END) AS context_with_failures FROM d GROUP BY ALL""")
def i20_decision_metrics(spark, sf_dir):
    """What two stopping rules reach. A miss is early before the first depth that hits, late after it; a failure pays for the whole text too."""
    grid = F.array(*[F.struct(F.lit(i).alias("level_id"), F.lit(float(x)).alias("level")) for i, x in enumerate(LEVELS)])
    rows = base.choices(spark, sf_dir).select("*", F.inline(grid)).where("best >= level")
    own = F.array_position(F.transform("fidelity", lambda f: f >= F.col("level")), F.lit(True))
    rows = rows.select("arm", "rule", "level_id", "chosen", F.when(own > 0, own - 1).alias("own"), (F.get("fidelity", F.col("chosen")) >= F.col("level")).alias("ok"), (F.get("tokens", F.col("chosen")) / F.nullif(F.col("whole"), F.lit(0))).alias("share"))
    n = lambda c: F.count(F.when(c, 1))
    ok, share = F.col("ok"), F.col("share")
    return rows.groupBy("arm", "rule", "level_id").agg(
        F.count(F.lit(1)).alias("n"),
        n(ok).alias("safe"),
        ev.rate(F.when(F.col("own").isNotNull(), ok)).alias("hit_given_reachable"),
        n(~ok & (F.col("chosen") < F.col("own"))).alias("early"),
        n(~ok & (F.col("chosen") > F.col("own"))).alias("late"),
        F.avg(share).alias("context"),
        F.avg(F.when(ok, share)).alias("context_of_hits"),
        F.avg(F.when(ok, share).otherwise(1 + share)).alias("context_with_failures"),
    )


@query("""o AS (SELECT doc_id, level_id, mask AS oracle, tokens AS oracle_tokens FROM chain), p AS (SELECT doc_id, arm, depth, mask, tokens FROM prefixes WHERE depth = 3),
x AS (SELECT arm, level_id, p.mask AS mask, oracle, p.tokens - oracle_tokens AS excess, e.tokens AS extra_tokens, m.tokens AS missing_tokens FROM p JOIN o USING (doc_id)
    JOIN states e ON e.doc_id = p.doc_id AND e.mask = p.mask & ~oracle & 63 JOIN states m ON m.doc_id = p.doc_id AND m.mask = oracle & ~p.mask & 63)
SELECT arm, level_id, avg(bit_count(mask & ~oracle & 63)::INT) AS extra, avg(bit_count(oracle & ~mask & 63)::INT) AS missing, avg(extra_tokens) AS extra_tokens, avg(missing_tokens) AS missing_tokens,
    avg(excess) AS excess, min(excess) AS least_excess, median(excess) AS median_excess, max(excess) AS most_excess FROM x GROUP BY ALL""")
def i21_regret_decomposition(spark, sf_dir):
    """Half an order against the best nested chain: packets and tokens too many and too few."""
    oracle = fr.nested_chain(base.lattice(spark, sf_dir), LEVELS, N).select("doc_id", "level_id", F.col("mask").alias("oracle"), F.col("tokens").alias("oracle_tokens"))
    rows = base.half_walks(spark, sf_dir).join(oracle, "doc_id")
    only = lambda a, b: F.col(a).bitwiseAND(F.bitwise_not(F.col(b)))
    extra, missing = only("mask", "oracle"), only("oracle", "mask")
    rows = rows.select("arm", "level_id", extra.alias("e"), missing.alias("m"), F.get("tokens", extra).alias("et"), F.get("tokens", missing).alias("mt"), (F.get("tokens", F.col("mask")) - F.col("oracle_tokens")).alias("x"))
    return rows.groupBy("arm", "level_id").agg(
        F.avg(F.bit_count("e")).alias("extra"), F.avg(F.bit_count("m")).alias("missing"), F.avg("et").alias("extra_tokens"), F.avg("mt").alias("missing_tokens"),
        F.avg("x").alias("excess"), F.min("x").alias("least_excess"), F.median("x").alias("median_excess"), F.max("x").alias("most_excess"),
    )


@query("""h AS (SELECT doc_id, arm, level_id, depth, hit, tokens FROM hits WHERE active)
SELECT a.arm, a.level_id, count(*) AS n, count(*) FILTER (a.hit) AS early, count(*) FILTER (NOT a.hit AND b.hit) AS rescued, CAST(sum(a.tokens + CASE WHEN a.hit THEN 0 ELSE b.tokens END) AS BIGINT) AS compute FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.arm = b.arm AND a.level_id = b.level_id AND a.depth = 2 AND b.depth = 5 GROUP BY ALL""")
def i27_two_stage_oracle(spark, sf_dir):
    rows = base.hits(spark, sf_dir).where("active")
    key = ["doc_id", "arm", "level_id"]
    a = rows.where("depth = 2").select(*key, F.col("hit").alias("a"), F.col("tokens").alias("ta"))
    b = rows.where("depth = 5").select(*key, F.col("hit").alias("b"), F.col("tokens").alias("tb"))
    return a.join(b, key).groupBy("arm", "level_id").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("a"), 1)).alias("early"), F.count(F.when(~F.col("a") & F.col("b"), 1)).alias("rescued"), F.sum(F.col("ta") + F.when(F.col("a"), 0).otherwise(F.col("tb"))).alias("compute")
    )


@query("""r AS (SELECT doc_id, level_id, bool_or(active) AS reachable, bool_or(hit) FILTER (arm = 'learned') AS own, bool_or(hit) AS anyone FROM hits GROUP BY ALL)
SELECT level_id, CASE WHEN own THEN 'order reaches' WHEN anyone THEN 'pool reaches' WHEN reachable THEN 'lattice reaches' ELSE 'infeasible' END AS verdict, count(*) AS n FROM r GROUP BY ALL""")
def i30_failure_ladder(spark, sf_dir):
    rows = base.hits(spark, sf_dir).groupBy("doc_id", "level_id").agg(F.bool_or("active").alias("reachable"), F.bool_or(F.when(F.col("arm") == "learned", F.col("hit"))).alias("own"), F.bool_or("hit").alias("anyone"))
    kind = F.when(F.col("own"), "order reaches").when(F.col("anyone"), "pool reaches").when(F.col("reachable"), "lattice reaches").otherwise("infeasible")
    return rows.groupBy("level_id", kind.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


_by = "PARTITION BY doc_id, arm, level_id ORDER BY depth"
TABLES["run_rows"] = f"""SELECT *, sum((hit AND NOT coalesce(before, false))::INT) OVER ({_by}) AS run FROM (SELECT *, lag(hit) OVER ({_by}) AS before FROM hits WHERE hit IS NOT NULL)"""


@query("""runs AS (SELECT doc_id, arm, level_id, run, count(*) AS length FROM run_rows WHERE hit GROUP BY ALL), found AS (SELECT doc_id, arm, level_id, count(*) AS n_runs, max(length) FILTER (run = 1) AS first_length, max(length) AS longest FROM runs GROUP BY ALL)
SELECT r.doc_id, r.arm, r.level_id, coalesce(max(n_runs), 0) AS n_runs, coalesce(max(first_length), 0) AS first_length, coalesce(max(longest), 0) AS longest, count(*) FILTER (before AND NOT hit) AS rollbacks FROM run_rows r LEFT JOIN found USING (doc_id, arm, level_id) GROUP BY ALL""")
def g13_success_windows(spark, sf_dir):
    return ev.windows_of_success(base.hits(spark, sf_dir), ["doc_id", "arm", "level_id"])


@query("""p AS (SELECT a.doc_id, a.packet_id, a.pos AS x, b.pos AS y FROM orders a JOIN orders b ON a.doc_id = b.doc_id AND a.packet_id = b.packet_id WHERE a.arm = 'learned' AND b.arm = 'control')
SELECT p.doc_id, count(*) FILTER (p.x < q.x AND p.y > q.y) AS inversions FROM p JOIN p q ON p.doc_id = q.doc_id GROUP BY p.doc_id""")
def g15_kendall_distance(spark, sf_dir):
    rows = base.orders(spark, sf_dir)
    side = lambda arm, c: rows.where(F.col("arm") == arm).select("doc_id", "packet_id", F.col("pos").alias(c))
    p = side("learned", "x").join(side("control", "y"), ["doc_id", "packet_id"])
    q = p.select("doc_id", F.col("x").alias("x2"), F.col("y").alias("y2"))
    return p.join(q, "doc_id").groupBy("doc_id").agg(F.count(F.when((F.col("x") < F.col("x2")) & (F.col("y") > F.col("y2")), 1)).alias("inversions"))


@query("SELECT a.doc_id, min(a.pos) FILTER (a.packet_id <> b.packet_id) AS first_divergence FROM orders a JOIN orders b ON a.doc_id = b.doc_id AND a.pos = b.pos WHERE a.arm = 'learned' AND b.arm = 'control' GROUP BY a.doc_id")
def g15_first_divergence(spark, sf_dir):
    rows = base.orders(spark, sf_dir)
    side = lambda arm, c: rows.where(F.col("arm") == arm).select("doc_id", "pos", F.col("packet_id").alias(c))
    both = side("learned", "a").join(side("control", "b"), ["doc_id", "pos"])
    return both.groupBy("doc_id").agg(F.min(F.when(F.col("a") != F.col("b"), F.col("pos"))).alias("first_divergence"))


@query("""n AS (SELECT s.doc_id, packet, s.fidelity AS f, t.fidelity AS g FROM states s, bits JOIN states t ON t.doc_id = s.doc_id AND t.mask = s.mask + (1 << packet) WHERE (s.mask >> packet) & 1 = 0)
SELECT doc_id, packet, level_id, count(*) FILTER (f < level AND g >= level) AS critical, count(*) FILTER (f >= level AND g < level) AS harmful FROM n, levels GROUP BY ALL""")
def g22_boundary_edges(spark, sf_dir):
    rows = fr.at_levels(lt.neighbours(base.states(spark, sf_dir), N), LEVELS)
    low, high = F.col("before") < F.col("level"), F.col("after") < F.col("level")
    return rows.groupBy("doc_id", "packet", "level_id").agg(F.count(F.when(low & ~high, 1)).alias("critical"), F.count(F.when(~low & high, 1)).alias("harmful"))


@query("""n AS (SELECT s.doc_id, packet, t.fidelity - s.fidelity AS delta FROM states s, bits JOIN states t ON t.doc_id = s.doc_id AND t.mask = s.mask + (1 << packet) WHERE (s.mask >> packet) & 1 = 0)
SELECT doc_id, packet, min(delta) AS low, max(delta) AS high, min(delta) < 0 AND max(delta) > 0 AS flips FROM n GROUP BY ALL""")
def g23_harm_stability(spark, sf_dir):
    delta = F.col("after") - F.col("before")
    out = lt.neighbours(base.states(spark, sf_dir), N).groupBy("doc_id", "packet").agg(F.min(delta).alias("low"), F.max(delta).alias("high"))
    return out.withColumn("flips", (F.col("low") < 0) & (F.col("high") > 0))


@query("SELECT doc_id, arm, level_id, coalesce(bool_or(hit), false) AS success, min(tokens) FILTER (hit) AS earliest FROM hits GROUP BY ALL")
def g27_order_outcome(spark, sf_dir):
    return base.hits(spark, sf_dir).groupBy("doc_id", "arm", "level_id").agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("success"), F.min(F.when(F.col("hit"), F.col("tokens"))).alias("earliest"))


@query("SELECT doc_id, arm, string_agg(packet_id, ',' ORDER BY CASE pos WHEN 3 THEN -1 ELSE pos END) AS promoted FROM orders GROUP BY ALL")
def g28_promoted_order(spark, sf_dir):
    key = F.when(F.col("pos") == 3, -1).otherwise(F.col("pos"))
    rows = base.orders(spark, sf_dir).groupBy("doc_id", "arm").agg(F.array_sort(F.collect_list(F.struct(key.alias("k"), "packet_id"))).alias("o"))
    return rows.select("doc_id", "arm", F.array_join(F.transform("o", lambda x: x["packet_id"].cast("string")), ",").alias("promoted"))


@query("""p AS (SELECT doc_id, depth, mask, fidelity >= 0.1 AS base FROM prefixes WHERE arm = 'learned')
SELECT s.doc_id, s.mask, bit_count(s.mask & ~p.mask & 63)::INT AS added, bit_count(p.mask & ~s.mask & 63)::INT AS removed, CASE WHEN base AND fidelity >= 0.1 THEN 'both' WHEN base THEN 'break' WHEN fidelity >= 0.1 THEN 'repair' ELSE 'neither' END AS class FROM states s JOIN p ON p.doc_id = s.doc_id AND p.depth = s.size""")
def g29_counterfactual_pairs(spark, sf_dir):
    own = base.prefixes(spark, sf_dir).where("arm = 'learned'").select("doc_id", F.col("depth").cast("int").alias("size"), F.col("mask").alias("own"), (F.col("fidelity") >= 0.1).alias("base"))
    rows = base.states(spark, sf_dir).withColumn("size", F.col("size").cast("int")).join(own, ["doc_id", "size"])
    hit = F.col("fidelity") >= 0.1
    kind = F.when(F.col("base") & hit, "both").when(F.col("base"), "break").when(hit, "repair").otherwise("neither")
    only = lambda a, b: F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(F.col(b))))
    return rows.select("doc_id", "mask", only("mask", "own").alias("added"), only("own", "mask").alias("removed"), kind.alias("class"))


@query("""e AS (SELECT doc_id, winner, loser FROM precedences WHERE slack = 0.02), r AS (SELECT doc_id, winner AS x, loser AS y FROM e UNION SELECT r.doc_id, r.x, e.loser FROM r JOIN e ON e.doc_id = r.doc_id AND e.winner = r.y)
SELECT doc_id, bool_or(x = y) AS cyclic FROM r GROUP BY doc_id""".replace("e AS", "RECURSIVE e AS", 1))
def g21_cycle_test(spark, sf_dir):
    """Transitive closure by doubling: N packets need at most ceil(log2 N) joins."""
    members = fr.chain_membership(base.lattice(spark, sf_dir), LEVELS, N, (0.02,))
    edges = fr.precedence(members, N).groupBy("doc_id").agg(F.collect_set(F.struct("winner", "loser")).alias("e"))
    reach = edges.withColumn("r", F.col("e"))
    for _ in range(3):
        step = F.flatten(F.transform("r", lambda a: F.transform(F.filter("r", lambda b: b["winner"] == a["loser"]), lambda b: F.struct(a["winner"].alias("winner"), b["loser"].alias("loser")))))
        reach = reach.select("doc_id", F.array_union("r", step).alias("r"))
    return reach.select("doc_id", F.exists("r", lambda p: p["winner"] == p["loser"]).alias("cyclic"))


@query("SELECT lang, source, count(*) AS n, sum(quality)::BIGINT AS k, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) AS low, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) AS high FROM (SELECT lang, source, quality, count(*) OVER w::DOUBLE AS n, avg(quality) OVER w AS p, 1.959963984540054::DOUBLE AS z FROM labelled WINDOW w AS (PARTITION BY lang, source)) GROUP BY lang, source, n, p, z".replace("count(*) OVER w::DOUBLE", "CAST(count(*) OVER w AS DOUBLE)"))
def k02_wilson(spark, sf_dir):
    rows = _labelled(spark, sf_dir).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("k"))
    low, high = ev.wilson(F.col("k"), F.col("n").cast("double"))
    return rows.select("lang", "source", "n", "k", low.alias("low"), high.alias("high"))


@query("SELECT lang, (avg((quality = toxic)::INT) - (avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)))) / nullif(1 - (avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic))), 0) AS kappa FROM labelled GROUP BY lang")
def k03_kappa(spark, sf_dir):
    return _labelled(spark, sf_dir).groupBy("lang").agg(ev.kappa(F.col("quality"), F.col("toxic")).alias("kappa"))


@query("""r AS (SELECT lang, quality, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0::DOUBLE AS mid FROM labelled)
SELECT lang, (sum(mid) FILTER (quality = 1) - sum(quality) * (sum(quality) + 1) / 2.0::DOUBLE) / nullif(sum(quality) * sum(1 - quality), 0)::DOUBLE AS auc, sum(quality)::BIGINT AS n_positive, sum(1 - quality)::BIGINT AS n_negative FROM r GROUP BY lang""")
def k04_auc(spark, sf_dir):
    return ev.auc(_labelled(spark, sf_dir), "n_chars", "quality", ["lang"])


@query("""r AS (SELECT lang, quality, row_number() OVER w AS k, sum(quality) OVER w AS h FROM labelled WINDOW w AS (PARTITION BY lang ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING)) SELECT lang, avg(h / k) FILTER (quality = 1) AS ap FROM r GROUP BY lang""")
def k05_average_precision(spark, sf_dir):
    return ev.average_precision(_labelled(spark, sf_dir), "n_chars", "quality", "doc_id", ["lang"])


@query("""r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM labelled)
SELECT lang, quantile_cont(n_chars, 0.9) AS p90, median(n_chars) AS p50, max(n_chars) FILTER (k - 1 = round_even((n - 1) * 0.9::DOUBLE, 0)) AS p90_nearest, max(n_chars) FILTER (k = ceil(n * 0.9::DOUBLE)) AS p90_ceiling FROM r GROUP BY lang""")
def k12_percentiles(spark, sf_dir):
    """Linear, at the nearest rank (halves to even), and at the rank rounded up."""
    rows = range_rank(_labelled(spark, sf_dir), ["lang"], [F.col("n_chars"), F.col("doc_id")])
    at = lambda k: F.max(F.when(F.col("position") == k, F.col("n_chars")))
    return rows.groupBy("lang").agg(
        F.percentile("n_chars", F.lit(0.9)).alias("p90"),
        F.median("n_chars").alias("p50"),
        at(F.rint((F.col("size") - 1) * F.lit(0.9)) + 1).alias("p90_nearest"),
        at(F.ceil(F.col("size") * F.lit(0.9))).alias("p90_ceiling"),
    )


@query(r"""t AS (SELECT item_id, term, count(*)::DOUBLE AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(question), '[\p{L}\p{N}_]+')) AS term FROM questions) GROUP BY ALL), d AS (SELECT term, count(*)::DOUBLE AS df FROM t GROUP BY term HAVING count(*) >= 2),
w AS (SELECT item_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM questions)) / (1 + df)) + 1) AS w FROM t JOIN d USING (term))
SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS weight FROM w""")
def k14_tf_idf(spark, sf_dir):
    return ev.tf_idf(base.questions(spark, sf_dir).select("item_id", base.terms(F.col("question")).alias("terms")), "item_id")


@query("s AS (SELECT lang, avg(n_chars) AS m, stddev_samp(n_chars) AS sd FROM labelled WHERE quality = 1 GROUP BY lang) SELECT doc_id, (n_chars - m) / nullif(sd, 0) AS z FROM labelled JOIN s USING (lang)")
def k16_standardised(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    s = rows.where("quality = 1").groupBy("lang").agg(F.avg("n_chars").alias("m"), F.stddev_samp("n_chars").alias("sd"))
    return rows.join(s, "lang").select("doc_id", ((F.col("n_chars") - F.col("m")) / F.nullif(F.col("sd"), F.lit(0.0))).alias("z"))


@query("""o AS (SELECT doc_id, arm, list(packet_id ORDER BY pos) AS l FROM orders GROUP BY ALL),
c AS (SELECT a.doc_id, coalesce(list_position(list_transform(list_zip(a.l, b.l), lambda x: x[1] = x[2]), false) - 1, 6)::INT AS common FROM o a JOIN o b ON a.doc_id = b.doc_id WHERE a.arm = 'learned' AND b.arm = 'control')
SELECT c.doc_id, common, CAST(p.tokens AS DOUBLE) / nullif(w.tokens, 0) AS reusable FROM c JOIN prefixes p ON p.doc_id = c.doc_id AND p.arm = 'control' AND p.depth = common JOIN prefixes w ON w.doc_id = c.doc_id AND w.arm = 'control' AND w.depth = 6""")
def k20_common_prefix(spark, sf_dir):
    """Packets that both orders of a document begin with, and their share of its tokens, which a cache of prefixes saves."""
    rows = base.both_orders(spark, sf_dir)
    at = F.array_position(F.zip_with("a", "b", lambda x, y: x == y), F.lit(False)).cast("int")
    rows = rows.withColumn("common", F.when(at == 0, F.lit(N)).otherwise(at - 1))
    held = F.aggregate(F.slice("a", F.lit(1), F.col("common")), F.lit(0), lambda m, p: m.bitwiseOR(F.pow(F.lit(2), p).cast("int")))
    return rows.select("doc_id", "common", (F.get("tokens", held) / F.nullif(F.element_at("tokens", -1), F.lit(0))).alias("reusable"))
