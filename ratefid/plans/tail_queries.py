"""Further checks, filters and summaries over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import frontier as fr
from ..operators import lattice as lt
from . import base
from .registry import query
from .sql import TABLES
from .text_queries import _answers

N, LEVELS = base.N_PACKETS, base.LEVELS

TABLES["nevers"] = "SELECT doc_id, packet AS packet_id, max(share) = 0 AS never FROM shares WHERE slack = 0.02 GROUP BY ALL"


def _nevers(spark, sf_dir):
    members = fr.chain_membership(base.lattice(spark, sf_dir), LEVELS, N, (0.02,))
    rows = fr.membership_summary(members, N).groupBy("doc_id", "packet").agg((F.max("share") == 0).alias("never"))
    return rows.withColumnRenamed("packet", "packet_id")


@query("SELECT o.doc_id, o.arm, string_agg(o.packet_id, ',' ORDER BY n.never, o.pos) AS projected FROM orders o JOIN nevers n USING (doc_id, packet_id) GROUP BY ALL")
def g19_never_reveal_tail(spark, sf_dir):
    rows = base.orders(spark, sf_dir).join(_nevers(spark, sf_dir), ["doc_id", "packet_id"])
    out = rows.groupBy("doc_id", "arm").agg(F.array_sort(F.collect_list(F.struct("never", "pos", "packet_id"))).alias("o"))
    return out.select("doc_id", "arm", F.array_join(F.transform("o", lambda x: x["packet_id"].cast("string")), ",").alias("projected"))


@query("""d AS (SELECT a.doc_id, min(a.pos) FILTER (a.packet_id <> b.packet_id) AS f FROM orders a JOIN orders b ON a.doc_id = b.doc_id AND a.pos = b.pos WHERE a.arm = 'learned' AND b.arm = 'control' GROUP BY a.doc_id)
SELECT lang, count(*) AS n, count(f) AS diverged, avg(f) AS mean_depth, median(f) AS median_depth FROM d JOIN documents USING (doc_id) GROUP BY lang""")
def g26_divergence_summary(spark, sf_dir):
    rows = base.orders(spark, sf_dir)
    side = lambda arm, c: rows.where(F.col("arm") == arm).select("doc_id", "pos", F.col("packet_id").alias(c))
    d = side("learned", "a").join(side("control", "b"), ["doc_id", "pos"]).groupBy("doc_id").agg(F.min(F.when(F.col("a") != F.col("b"), F.col("pos"))).alias("f"))
    out = d.join(base.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang")
    return out.agg(F.count(F.lit(1)).alias("n"), F.count("f").alias("diverged"), F.avg("f").alias("mean_depth"), F.median("f").alias("median_depth"))


@query("SELECT o.arm, o.pos >= 4 AS predicted, n.never AS robust, count(*) AS n FROM orders o JOIN nevers n USING (doc_id, packet_id) GROUP BY ALL")
def i05_never_reveal_confusion(spark, sf_dir):
    rows = base.orders(spark, sf_dir).join(_nevers(spark, sf_dir), ["doc_id", "packet_id"])
    return rows.groupBy("arm", (F.col("pos") >= 4).alias("predicted"), F.col("never").alias("robust")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT level_id, count(independent_tokens) AS feasible, count(nested_tokens) AS nested, avg(gap_share) AS mean_share, quantile_cont(gap, 0.9) AS p90_gap FROM gaps GROUP BY level_id")
def i08_gate_metrics(spark, sf_dir):
    s = base.states(spark, sf_dir)
    rows = fr.structural_gaps(fr.independent_frontier(s, LEVELS, N), fr.nested_chain(s, LEVELS, N))
    return rows.groupBy("level_id").agg(
        F.count("independent_tokens").alias("feasible"), F.count("nested_tokens").alias("nested"), F.avg("gap_share").alias("mean_share"), F.percentile("gap", F.lit(0.9)).alias("p90_gap")
    )


@query("""d AS (SELECT doc_id, depth, CASE WHEN coalesce(bool_and(candidate), true) AND coalesce(bool_or(repair), false) THEN 0 WHEN coalesce(bool_or(repair), false) AND NOT coalesce(bool_or(break), false) THEN 1 WHEN NOT coalesce(bool_or(break), false) AND max(candidate_tokens) < max(base_tokens) THEN 2 ELSE 3 END AS priority FROM sides GROUP BY ALL)
SELECT doc_id, depth, priority FROM d QUALIFY priority = min(priority) OVER (PARTITION BY doc_id)""")
def i32_preferred_actions(spark, sf_dir):
    from .evaluate_queries import _sides

    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    d = _sides(spark, sf_dir).groupBy("doc_id", "depth").agg(
        F.coalesce(F.bool_and("candidate"), F.lit(True)).alias("done"), some("repair").alias("r"), some("break").alias("b"), (F.max("candidate_tokens") < F.max("base_tokens")).alias("less")
    )
    d = d.withColumn("priority", F.when(F.col("done") & F.col("r"), 0).when(F.col("r") & ~F.col("b"), 1).when(~F.col("b") & F.col("less"), 2).otherwise(3))
    best = F.min("priority").over(Window.partitionBy("doc_id"))
    return d.withColumn("best", best).where("priority = best").select("doc_id", "depth", "priority")


@query("SELECT doc_id, n_units, n_supporting FROM (SELECT doc_id, count(*) AS n_units, count(*) FILTER (supporting) AS n_supporting FROM support GROUP BY doc_id) WHERE n_units >= 6 AND n_supporting BETWEEN 1 AND 5")
def b03_fixed_size_pilot(spark, sf_dir):
    from .text_queries import _support

    rows = _support(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_units"), F.count(F.when(F.col("supporting"), 1)).alias("n_supporting"))
    return rows.where("n_units >= 6 AND n_supporting BETWEEN 1 AND 5")


@query("""p AS (SELECT doc_id, unit, count(*) AS n, min(tokens) AS gist, sum(tokens) AS source FROM halves GROUP BY ALL)
SELECT doc_id, unit, concat_ws(',', CASE WHEN n <> 2 THEN 'blocks' END, CASE WHEN gist * 2 > source THEN 'gist' END, CASE WHEN gist < 10 THEN 'short' END) AS errors FROM p""")
def b11_partition_check(spark, sf_dir):
    rows = base.packets(spark, sf_dir).withColumn("unit", F.floor(F.col("packet_id") / 2).cast("int"))
    rows = rows.groupBy("doc_id", "unit").agg(F.count(F.lit(1)).alias("n"), F.min("tokens").alias("gist"), F.sum("tokens").alias("source"))
    tests = {"blocks": F.col("n") != 2, "gist": F.col("gist") * 2 > F.col("source"), "short": F.col("gist") < 10}
    return rows.select("doc_id", "unit", F.array_join(F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()])), ",").alias("errors"))


@query("""h AS (SELECT DISTINCT s.doc_id, s.idx FROM sentence_terms s JOIN question_terms q ON q.item_id = s.item_id AND list_contains(s.t, q.term) AND length(q.term) >= 3)
SELECT s.doc_id, count(h.idx) AS positives, count(*) - count(h.idx) AS negatives FROM sentences s LEFT JOIN h USING (doc_id, idx) GROUP BY s.doc_id HAVING count(h.idx) > 0 AND count(h.idx) < count(*)""")
def b29_sentence_triplets(spark, sf_dir):
    rows = base.sentences(spark, sf_dir).join(base.asked(spark, sf_dir), "doc_id").join(base.questions(spark, sf_dir), "item_id")
    wanted = F.filter(base.terms(F.col("question")), lambda w: F.length(w) >= 3)
    rows = rows.withColumn("hit", F.arrays_overlap(base.terms(F.col("sentence")), wanted).cast("int"))
    out = rows.groupBy("doc_id").agg(F.sum("hit").alias("positives"), F.sum(1 - F.col("hit")).alias("negatives"))
    return out.where("positives > 0 AND negatives > 0")


@query("SELECT lang, count(*) AS n, avg((recall >= 0.1 AND tokens <= 256)::INT) AS kept, avg(recall) AS mean_recall FROM states JOIN documents USING (doc_id) WHERE size = 1 GROUP BY lang")
def b30_summary_filter(spark, sf_dir):
    rows = base.states(spark, sf_dir).where("size = 1").join(base.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    good = ((F.col("recall") >= 0.1) & (F.col("tokens") <= 256)).cast("double")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg(good).alias("kept"), F.avg("recall").alias("mean_recall"))


@query("SELECT doc_id, mask, least(fidelity, recall) AS fidelity FROM states")
def h08_rescored_fidelity(spark, sf_dir):
    return base.states(spark, sf_dir).select("doc_id", "mask", F.least("fidelity", "recall").alias("fidelity"))


@query("""SELECT conv_id, turn, ln(1 + len(p)) AS log_p, ln(1 + len(g)) AS log_g, p <> g AS changed, len(list_intersect(p, g))::DOUBLE / nullif(len(list_distinct(list_concat(p, g))), 0) AS jaccard FROM answers""")
def k19_behaviour_features(spark, sf_dir):
    share = F.size(F.array_intersect("p", "g")) / F.nullif(F.size(F.array_union("p", "g")), F.lit(0))
    return _answers(spark, sf_dir).select(
        "conv_id", "turn", F.log(1 + F.size("p")).alias("log_p"), F.log(1 + F.size("g")).alias("log_g"), (F.array_join("p", " ") != F.array_join("g", " ")).alias("changed"), share.alias("jaccard")
    )


@query("SELECT s.doc_id, count(*) AS n_sentences, (SELECT count(*) FROM packets p WHERE p.doc_id = s.doc_id) AS n_packets, CAST(sum(tokens) AS BIGINT) AS sentence_tokens, (SELECT CAST(sum(tokens) AS BIGINT) FROM packets p WHERE p.doc_id = s.doc_id) AS packet_tokens FROM packet_sentences s GROUP BY s.doc_id")
def l08_structure_check(spark, sf_dir):
    s = base.packet_sentences(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum("tokens").alias("sentence_tokens"))
    p = base.packets(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_packets"), F.sum("tokens").alias("packet_tokens"))
    return s.join(p, "doc_id")


@query("""p AS (SELECT doc_id, packet_id // 2 AS unit, max(CASE WHEN packet_id % 2 = 0 THEN text END) AS g, max(CASE WHEN packet_id % 2 = 1 THEN text END) AS r FROM packets GROUP BY ALL),
w AS (SELECT doc_id, unit, regexp_extract_all(g, '[^ ]+') AS g, regexp_extract_all(r, '[^ ]+') AS r FROM p), k AS (SELECT *, CAST(least(len(g), 45 * (len(g) + len(r)) // 100) AS BIGINT) AS k FROM w)
SELECT doc_id, unit, k AS n_gist, CAST(len(g) - k AS BIGINT) AS n_moved, md5(array_to_string(g[1:k], ' ')) AS gist, md5(array_to_string(list_concat(g[k + 1:], r), ' ')) AS residual,
    len(list_filter(list_concat(g[k + 1:], r), lambda x: NOT list_contains(list_transform(g[1:k], lambda y: lower(y)), lower(x)))) = 0 AS redundant FROM k""")
def b25_rebalanced_gist(spark, sf_dir):
    """A unit's first packet as its gist: the words beyond 45 hundredths of the unit's go over to the residual, none is lost."""
    rows = base.packets(spark, sf_dir).groupBy("doc_id", F.floor(F.col("packet_id") / 2).cast("int").alias("unit"))
    side = lambda odd: F.regexp_extract_all(F.max(F.when(F.col("packet_id") % 2 == odd, F.col("text"))), F.lit("[^ ]+"), 0)
    rows = rows.agg(side(0).alias("g"), side(1).alias("r")).withColumn("k", F.least(F.size("g").cast("long"), F.expr("(45 * (size(g) + size(r))) div 100")))
    gist = F.slice("g", F.lit(1), F.col("k").cast("int"))
    rest = F.concat(F.slice("g", (F.col("k") + 1).cast("int"), (F.size("g") - F.col("k")).cast("int")), F.col("r"))
    small = lambda c: F.transform(c, F.lower)
    shown = lambda c: F.md5(F.encode(F.array_join(c, " "), "utf-8"))
    redundant = F.size(F.array_except(small(rest), small(gist))) == 0
    return rows.select("doc_id", "unit", F.col("k").alias("n_gist"), (F.size("g") - F.col("k")).alias("n_moved"), shown(gist).alias("gist"), shown(rest).alias("residual"), redundant.alias("redundant"))
