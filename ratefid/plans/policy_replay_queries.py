"""Queries that replay stopping and choice policies over fixed tables of outcomes, and the supervision made from histories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evaluate as ev
from ..operators import frontier as fr
from ..operators import lattice as lt
from ..operators import trajectory as tr
from . import base
from .order_queries import walks
from .registry import query
from .sql import TABLES
from .trajectory_queries import _path_actions, _valued

N, LEVELS = base.N_PACKETS, base.LEVELS
K = len(LEVELS)
PROBE, WHOLE = 2, 5
SCHEDULE = (2, 3, 4, 5)
FRACTIONS = (0.1, 0.25, 0.5, 0.75, 1.0)
RATES = (0.0, 0.25, 0.5, 0.75, 1.0)


@query("""b AS (SELECT doc_id, mask, reached, count(*) AS n_actions, count(*) FILTER (after = best) AS n_best, string_agg(packet || ':' || lost, ',' ORDER BY packet) AS costs FROM acts JOIN gains USING (doc_id, mask, reached, packet) JOIN seen USING (doc_id, mask, reached) GROUP BY ALL)
SELECT doc_id, mask, reached, n_actions, n_best, costs, true AS agrees FROM b""")
def g07_histories_with_costs(spark, sf_dir):
    """Reachable histories with what each action loses; the free ones must be just the best actions, worked out apart."""
    rows = tr.state_actions(tr.with_seen(_valued(spark, sf_dir), N), N, tr.seen_states(K))

    def judged(o):
        lost, _, gain = tr.advantage(o["after"], K)
        return F.struct(o["packet"].alias("packet"), lost.alias("lost"), (gain == 0).alias("free"), (o["after"] == F.col("best")).alias("is_best"))

    rows = base._once(rows, a=F.transform("options", judged))
    shown = F.array_join(F.transform("a", lambda x: F.concat_ws(":", x["packet"].cast("string"), x["lost"].cast("string"))), ",")
    n_best = F.size(F.filter("a", lambda x: x["is_best"])).cast("long")
    return rows.select("doc_id", "mask", "reached", F.size("a").cast("long").alias("n_actions"), n_best.alias("n_best"), shown.alias("costs"), (F.size(F.filter("a", lambda x: x["free"])) == n_best).alias("agrees"))


_PATH_SQL = "path AS (SELECT p.doc_id, p.arm, p.depth, p.mask, max(att) OVER (PARTITION BY p.doc_id, p.arm ORDER BY p.depth) AS reached, lead(p.mask) OVER (PARTITION BY p.doc_id, p.arm ORDER BY p.depth) - p.mask AS step FROM prefixes p JOIN attained USING (doc_id, mask))"


@query(f"""{_PATH_SQL}, w AS (SELECT path.*, g.packet, g.lost, g.token_share FROM path JOIN gains g ON g.doc_id = path.doc_id AND g.mask = path.mask AND g.reached = path.reached AND 1 << g.packet = step)
SELECT doc_id, arm, depth, mask, reached, packet, 'retention' AS kind FROM w WHERE lost = 0 AND token_share = 0
UNION ALL SELECT DISTINCT w.doc_id, arm, depth, mask, reached, packet, 'boundary' FROM w JOIN precedences p ON p.doc_id = w.doc_id AND p.slack = 0.02 AND p.loser = w.packet AND (w.mask >> p.winner) & 1 = 0""")
def g30_boundary_and_retention(spark, sf_dir):
    """Histories of the orders where the next packet is a best action, and those where it comes before one that should precede it."""
    rows = tr.advantages(_path_actions(spark, sf_dir), K)
    key = ["doc_id", "arm", "depth", "mask", "reached", "packet"]
    kept = rows.where("lost = 0 AND token_share = 0").select(*key, F.lit("retention").alias("kind"))
    pairs = fr.precedence(fr.chain_membership(base.lattice(spark, sf_dir), LEVELS, N, (0.02,)), N).groupBy("doc_id", "loser").agg(F.bit_or(lt.bit("winner")).alias("winners"))
    early = rows.join(pairs.withColumnRenamed("loser", "packet"), ["doc_id", "packet"]).where(F.col("winners").bitwiseAND(F.bitwise_not("mask")) != 0)
    return kept.unionByName(early.select(*key, F.lit("boundary").alias("kind")))


_FRACTIONS = ", ".join(f"(CAST({x} AS DOUBLE))" for x in FRACTIONS)
TABLES["two_depths"] = f"""SELECT a.doc_id, a.level_id, a.hit AS early, b.hit AS late, a.tokens AS early_tokens, b.tokens AS late_tokens FROM hits a JOIN hits b USING (doc_id, arm, level_id) WHERE arm = 'learned' AND a.depth = {PROBE} AND b.depth = {WHOLE}"""


def _two_depths(spark, sf_dir):
    """doc_id, level_id, early, late (hits at the two depths of the learned order) and their tokens."""
    rows = base.hits(spark, sf_dir).where("arm = 'learned'").where(F.col("depth").isin(PROBE, WHOLE))
    at = lambda d, c: F.max(F.when(F.col("depth") == d, F.col(c)))
    return rows.groupBy("doc_id", "level_id").agg(at(PROBE, "hit").alias("early"), at(WHOLE, "hit").alias("late"), at(PROBE, "tokens").alias("early_tokens"), at(WHOLE, "tokens").alias("late_tokens"))


@query(f"""s AS (SELECT doc_id, CAST(round(recall * 1000000) AS BIGINT) AS score FROM prefixes WHERE arm = 'learned' AND depth = {PROBE}), c AS (SELECT score, sum(count(*)) OVER (ORDER BY score DESC) AS upto FROM s GROUP BY score),
d AS (SELECT fraction, doc_id, upto <= fraction * (SELECT count(*) FROM s) AS exits FROM s JOIN c USING (score), (VALUES {_FRACTIONS}) f(fraction)),
o AS (SELECT fraction, level_id, exits, early, late, CASE WHEN exits THEN early ELSE late END AS hit, CASE WHEN exits THEN late_tokens - early_tokens ELSE 0 END AS saved FROM d JOIN two_depths USING (doc_id))
SELECT fraction, level_id, count(hit) AS n, count(*) FILTER (exits AND hit IS NOT NULL) AS exits, count(*) FILTER (hit) AS successes, count(*) FILTER (hit AND NOT late) AS repairs, count(*) FILTER (late AND NOT hit) AS breaks, CAST(sum(saved) AS BIGINT) AS saved FROM o GROUP BY ALL""")
def i24_early_exit_replay(spark, sf_dir):
    """Documents of the best probe scores stop there, the rest go on: ties at the border go on together.

    Scores are ranked by counts of the distinct ones, of which there are at most a million.
    """
    score = F.round(F.col("recall") * 1000000).cast("long")
    scores = base.prefixes(spark, sf_dir).where("arm = 'learned'").where(F.col("depth") == PROBE).select("doc_id", score.alias("score"))
    counts = scores.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = counts.select("score", F.sum("n").over(Window.orderBy(F.desc("score"))).alias("upto"), F.sum("n").over(whole).alias("total"))
    rows = scores.join(counts, "score").join(_two_depths(spark, sf_dir), "doc_id").withColumn("fraction", F.explode(F.array(*[F.lit(x) for x in FRACTIONS])))
    rows = rows.withColumn("exits", F.col("upto") <= F.col("fraction") * F.col("total"))
    rows = rows.withColumn("hit", F.when(F.col("exits"), F.col("early")).otherwise(F.col("late"))).withColumn("saved", F.when(F.col("exits"), F.col("late_tokens") - F.col("early_tokens")).otherwise(0))
    n = lambda test: F.count(F.when(test, 1))
    return rows.groupBy("fraction", "level_id").agg(
        F.count("hit").alias("n"), n(F.col("exits") & F.col("hit").isNotNull()).alias("exits"), n(F.col("hit")).alias("successes"), n(F.col("hit") & ~F.col("late")).alias("repairs"), n(F.col("late") & ~F.col("hit")).alias("breaks"), F.sum("saved").alias("saved")
    )


_RATES = ", ".join(f"(CAST({x} AS DOUBLE))" for x in RATES)


@query(f"""c AS (SELECT level_id, count(*)::DOUBLE AS n, count(*) FILTER (early AND late) AS stay, count(*) FILTER (late AND NOT early) AS rescue, count(*) FILTER (early AND NOT late) AS harm, sum(early_tokens)::DOUBLE AS probe, coalesce(sum(late_tokens) FILTER (late AND NOT early), 0)::DOUBLE AS needed, coalesce(sum(late_tokens) FILTER (early OR NOT late), 0)::DOUBLE AS idle, sum(late_tokens)::DOUBLE AS always FROM two_depths WHERE early IS NOT NULL GROUP BY level_id),
g AS (SELECT r.x AS recall, f.x AS false_continue, level_id, (stay + r.x * rescue + (1 - f.x) * harm) / n AS success, (stay + rescue) / n AS target, (probe + r.x * needed + f.x * idle) / always AS cost FROM c, (VALUES {_RATES}) r(x), (VALUES {_RATES}) f(x))
SELECT recall, false_continue, avg(success) AS success, product(success) AS complete, avg(cost) AS cost, bool_and(success >= target - 0.02) AS good, avg(cost) <= 1.1 AS cheap FROM g GROUP BY ALL""")
def i28_operating_region(spark, sf_dir):
    """What a stopper would give at each pair of rates: it goes on where that helps (recall) and where it does not (false_continue).

    Classes are counted first, so the grid meets one row a level.
    """
    n = lambda test: F.count(F.when(test, 1))
    e, l = F.col("early"), F.col("late")
    rows = _two_depths(spark, sf_dir).where("early IS NOT NULL").groupBy("level_id").agg(
        F.count(F.lit(1)).alias("n"), n(e & l).alias("stay"), n(l & ~e).alias("rescue"), n(e & ~l).alias("harm"), F.sum("early_tokens").alias("probe"),
        F.coalesce(F.sum(F.when(l & ~e, F.col("late_tokens"))), F.lit(0)).alias("needed"), F.coalesce(F.sum(F.when(e | ~l, F.col("late_tokens"))), F.lit(0)).alias("idle"), F.sum("late_tokens").alias("always"),
    )
    rates = F.array(*[F.lit(x) for x in RATES])
    rows = rows.withColumn("recall", F.explode(rates)).withColumn("false_continue", F.explode(rates))
    success = (F.col("stay") + F.col("recall") * F.col("rescue") + (1 - F.col("false_continue")) * F.col("harm")) / F.col("n")
    cost = (F.col("probe") + F.col("recall") * F.col("needed") + F.col("false_continue") * F.col("idle")) / F.col("always")
    rows = rows.withColumn("success", success).withColumn("cost", cost).withColumn("enough", success >= (F.col("stay") + F.col("rescue")) / F.col("n") - 0.02)
    complete = F.aggregate(F.collect_list("success"), F.lit(1.0), lambda a, x: a * x)
    return rows.groupBy("recall", "false_continue").agg(F.avg("success").alias("success"), complete.alias("complete"), F.avg("cost").alias("cost"), F.bool_and("enough").alias("good"), (F.avg("cost") <= 1.1).alias("cheap"))


TABLES["allowed_stops"] = f"""SELECT p.doc_id, p.arm, l.level_id, p.depth, p.tokens FROM prefixes p CROSS JOIN levels l JOIN (VALUES {", ".join(f"({k}, {d})" for k, d in enumerate(SCHEDULE))}) s(level_id, base_depth) ON s.level_id = l.level_id
    JOIN prefixes b ON b.doc_id = p.doc_id AND b.arm = p.arm AND b.depth = s.base_depth WHERE b.fidelity < l.level OR p.fidelity >= l.level"""
for _k in range(K):
    TABLES[f"stops{_k}"] = (
        "SELECT doc_id, arm, depth, tokens AS cost FROM allowed_stops WHERE level_id = 0"
        if _k == 0
        else f"SELECT a.doc_id, a.arm, a.depth, a.tokens + min(s.cost) AS cost FROM allowed_stops a JOIN stops{_k - 1} s ON s.doc_id = a.doc_id AND s.arm = a.arm AND s.depth <= a.depth WHERE a.level_id = {_k} GROUP BY a.doc_id, a.arm, a.depth, a.tokens"
    )


@query(f"""b AS (SELECT doc_id, arm, CAST(sum(tokens) AS BIGINT) AS base_cost FROM prefixes WHERE depth IN ({", ".join(map(str, SCHEDULE))}) GROUP BY ALL)
SELECT doc_id, arm, CAST(min(cost) AS BIGINT) AS cost, base_cost FROM stops{K - 1} JOIN b USING (doc_id, arm) GROUP BY ALL""")
def i29_clairvoyant_stops(spark, sf_dir):
    """The cheapest rising depths, one a level, that keep every level that the fixed schedule reaches."""
    schedule, grid = f"array({', '.join(map(str, SCHEDULE))})", f"array({', '.join(f'{x}D' for x in LEVELS)})"
    rows = tr._bound(walks(spark, sf_dir), t="transform(path, m -> tokens[m])", f="transform(path, m -> fidelity[m])")
    ok = f"f[{schedule}[k]] < {grid}[k] OR f[d] >= {grid}[k]"
    fold = f"aggregate(sequence(0, {K - 1}), array_repeat(0L, {N + 1}), (a, k) -> transform(a, (x, d) -> IF({ok}, t[d] + array_min(slice(a, 1, d + 1)), {fr.FAR}L)))"
    return rows.select("doc_id", "arm", F.array_min(F.expr(fold)).alias("cost"), F.expr(f"aggregate({schedule}, 0L, (s, d) -> s + t[d])").alias("base_cost"))


TABLES["choices"] = "SELECT doc_id, depth, count(*) FILTER (repair) AS repairs, count(*) FILTER (break) AS breaks, count(*) FILTER (repair) - count(*) FILTER (break) AS net, max(candidate_tokens) AS tokens FROM (SELECT c.doc_id, c.depth, c.hit AND NOT b.hit AS repair, b.hit AND NOT c.hit AS break, c.tokens AS candidate_tokens FROM hits c JOIN hits b USING (doc_id, level_id) WHERE c.arm = 'learned' AND b.arm = 'control' AND b.depth = 3 AND c.depth BETWEEN 1 AND 5) GROUP BY ALL"


@query("""w AS (SELECT depth AS fixed FROM choices GROUP BY depth ORDER BY sum(net) DESC, sum(tokens), depth LIMIT 1), chosen AS (SELECT doc_id, min(struct_pack(a := -net, b := tokens, c := depth)).c AS best FROM choices GROUP BY doc_id),
p AS (SELECT 'fixed choice' AS policy, doc_id, depth, TRUE AS moved FROM choices, w WHERE depth = fixed UNION ALL SELECT 'oracle gate', doc_id, depth, net > 0 FROM choices, w WHERE depth = fixed
    UNION ALL SELECT 'oracle choice', doc_id, best, TRUE FROM chosen UNION ALL SELECT 'full oracle', doc_id, best, net > 0 FROM chosen JOIN choices USING (doc_id) WHERE depth = best UNION ALL SELECT 'stay', doc_id, 1, FALSE FROM chosen)
SELECT policy, count(*) AS n, count(*) FILTER (moved) AS n_moved, CAST(coalesce(sum(repairs) FILTER (moved), 0) AS BIGINT) AS repairs, CAST(coalesce(sum(breaks) FILTER (moved), 0) AS BIGINT) AS breaks FROM p JOIN choices USING (doc_id, depth) GROUP BY policy""")
def i31_gate_and_choice(spark, sf_dir):
    """Moving from the control order at depth 3 to a depth of the learned one: never, always to the same, gated, chosen, or both by an oracle."""
    rows = base.hits(spark, sf_dir)
    own = rows.where("arm = 'control' AND depth = 3").select("doc_id", "level_id", F.col("hit").alias("base"))
    rows = rows.where("arm = 'learned' AND depth BETWEEN 1 AND 5").join(own, ["doc_id", "level_id"])
    n = lambda test: F.count(F.when(test, 1))
    acts = rows.groupBy("doc_id", "depth").agg(n(F.col("hit") & ~F.col("base")).alias("repairs"), n(F.col("base") & ~F.col("hit")).alias("breaks"), F.max("tokens").alias("tokens"))
    acts = acts.withColumn("net", F.col("repairs") - F.col("breaks"))
    fixed = acts.groupBy("depth").agg(F.sum("net").alias("net"), F.sum("tokens").alias("tokens")).orderBy(F.desc("net"), "tokens", "depth").limit(1).select(F.col("depth").alias("fixed"))
    act = F.struct(-F.col("net"), "tokens", "depth", "repairs", "breaks")
    docs = acts.join(F.broadcast(fixed)).groupBy("doc_id").agg(F.min(act).alias("best"), F.min(F.when(F.col("depth") == F.col("fixed"), act)).alias("same"))
    policy = lambda name, a, moved: F.struct(F.lit(name).alias("policy"), F.col(f"{a}.repairs").alias("repairs"), F.col(f"{a}.breaks").alias("breaks"), moved.alias("moved"))
    gains = lambda a: F.col(f"{a}.repairs") > F.col(f"{a}.breaks")
    rows = docs.select(F.inline(F.array(
        policy("stay", "best", F.lit(False)), policy("fixed choice", "same", F.lit(True)), policy("oracle gate", "same", gains("same")), policy("oracle choice", "best", F.lit(True)), policy("full oracle", "best", gains("best")),
    )))
    moved = lambda c: F.coalesce(F.sum(F.when(F.col("moved"), F.col(c))), F.lit(0)).alias(c)
    return rows.groupBy("policy").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("moved"), 1)).alias("n_moved"), moved("repairs"), moved("breaks"))


@query("""v AS (SELECT h.doc_id, h.unit, h.packet_id, t.term, CASE WHEN w.term IS NULL THEN 'Answer: no' ELSE '<answer>Yes.</answer>' END AS verdict, row_number() OVER (PARTITION BY h.doc_id, h.unit, t.term ORDER BY h.tokens, h.packet_id) = 1 AS gist
    FROM halves h JOIN asked USING (doc_id) JOIN question_terms t USING (item_id) LEFT JOIN packet_words w ON w.doc_id = h.doc_id AND w.packet_id = h.packet_id AND w.term = t.term),
f AS (SELECT doc_id, unit, term, bool_or(verdict LIKE '%Yes%') FILTER (gist) AS gist, bool_or(verdict LIKE '%Yes%') AS "full" FROM v GROUP BY ALL)
SELECT doc_id, unit, count(*) AS n_facts, count(*) FILTER (gist) AS n_gist, count(*) FILTER ("full") AS n_full FROM f GROUP BY ALL""")
def h09_fact_coverage(spark, sf_dir):
    """Verdicts of a judge on each fact and packet, as texts: parsed, and a fact that the gist has counts for the whole unit too."""
    rows = base._worded(spark, sf_dir).select("doc_id", "asked", "held", F.explode(F.sequence(F.lit(0), F.lit(N // 2 - 1))).alias("unit"), "words")
    gist = F.expr("IF(size(words[2 * unit]) <= size(words[2 * unit + 1]), 0, 1)")
    judged = lambda p: lambda w: F.when(F.array_contains(p, w), "<answer>Yes.</answer>").otherwise("Answer: no")
    at = lambda k: F.get("held", 2 * F.col("unit") + k)
    yes = lambda texts: F.transform(texts, lambda t: F.lower(tx.parsed_answer(t)).startswith("yes"))
    rows = rows.select("doc_id", "unit", F.size("asked").alias("n"), yes(F.transform("asked", judged(at(gist)))).alias("gist"), yes(F.transform("asked", judged(at(1 - gist)))).alias("rest"))
    count = lambda c: F.size(F.filter(c, lambda x: x)).cast("long")
    return rows.select("doc_id", "unit", F.col("n").cast("long").alias("n_facts"), count(F.col("gist")).alias("n_gist"), count(F.zip_with("gist", "rest", lambda a, b: a | b)).alias("n_full"))
