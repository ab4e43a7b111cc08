"""Queries of statistics over arms, and of what each action still allows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frontier as fr
from ..operators import lattice as lt
from . import base
from .registry import query
from .sql import TABLES

N, LEVELS = base.N_PACKETS, base.LEVELS
TOP = 50


@query("""r AS (SELECT level_id, depth, arm, avg(1.0 - CAST(hit AS INT)) AS risk, count(*) AS n FROM hits WHERE active GROUP BY ALL),
w AS (SELECT level_id, depth, sum(n) / sum(sum(n)) OVER (PARTITION BY level_id) AS w FROM r GROUP BY level_id, depth)
SELECT level_id, sum(w * risk) FILTER (arm = 'learned') AS learned, sum(w * risk) FILTER (arm = 'control') AS control,
    sum(w * risk) FILTER (arm = 'learned') / nullif(sum(w * risk) FILTER (arm = 'control'), 0) AS ratio FROM r JOIN w USING (level_id, depth) GROUP BY level_id""")
def k08_standardised_ratio(spark, sf_dir):
    """Risk of missing a level, arm against arm, with each depth weighing as in both arms together."""
    risk = F.avg(1.0 - F.col("hit").cast("int"))
    rows = base.hits(spark, sf_dir).where("active").groupBy("level_id", "depth", "arm").agg(risk.alias("risk"), F.count(F.lit(1)).alias("n"))
    side = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c)))
    rows = rows.groupBy("level_id", "depth").agg(F.sum("n").alias("n"), side("learned", "risk").alias("one"), side("control", "risk").alias("other"))
    rows = rows.groupBy("level_id").agg((F.sum(F.col("n") * F.col("one")) / F.sum("n")).alias("learned"), (F.sum(F.col("n") * F.col("other")) / F.sum("n")).alias("control"))
    return rows.withColumn("ratio", F.col("learned") / F.nullif("control", F.lit(0.0)))


@query(f"""x AS (SELECT doc_id, toxic, n_chars FROM labels JOIN documents USING (doc_id)), c AS (SELECT count(*) AS big, sum(toxic) AS marked FROM x),
t AS (SELECT count(*) AS n, sum(toxic) AS k FROM (SELECT toxic FROM x ORDER BY n_chars DESC, doc_id LIMIT {TOP}))
SELECT CAST(big AS BIGINT) AS population, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, n * marked / big AS expected, k / nullif(n * marked / big, 0) AS lift,
    (SELECT coalesce(sum(exp(lgamma(marked + 1) - lgamma(i + 1) - lgamma(marked - i + 1) + lgamma(big - marked + 1) - lgamma(n - i + 1) - lgamma(big - marked - n + i + 1) - lgamma(big + 1) + lgamma(n + 1) + lgamma(big - n + 1))), 0)
     FROM range({TOP + 1}) r(i) WHERE i BETWEEN k AND n AND i <= marked AND n - i <= big - marked) AS tail FROM c, t""")
def k09_enrichment(spark, sf_dir):
    """Marked rows among the TOP longest against random picks: the hypergeometric tail, from sums of at most TOP logarithms."""
    rows = base.table(spark, sf_dir, "labels").select("doc_id", "toxic").join(base.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    whole = rows.agg(F.count(F.lit(1)).alias("big"), F.sum("toxic").cast("long").alias("marked"))
    top = rows.orderBy(F.desc("n_chars"), "doc_id").limit(TOP).agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").cast("long").alias("k"))
    both = whole.crossJoin(top)  # a row each
    up_to = lambda i: F.filter(F.sequence(F.lit(0), F.lit(TOP)), lambda j: j < i)
    choose = lambda total, i: F.aggregate(up_to(i), F.lit(0.0), lambda a, j: a + F.log((total - j) / (j + 1.0)))
    ways = F.filter(F.sequence(F.lit(0), F.lit(TOP)), lambda i: (i >= F.col("k")) & (i <= F.col("n")) & (i <= F.col("marked")) & (F.col("n") - i <= F.col("big") - F.col("marked")))
    tail = F.aggregate(ways, F.lit(0.0), lambda a, i: a + F.exp(choose(F.col("marked"), i) + choose(F.col("big") - F.col("marked"), F.col("n") - i) - choose(F.col("big"), F.col("n"))))
    expected = F.col("n") * F.col("marked") / F.col("big")
    return both.select(F.col("big").alias("population"), "n", "k", expected.alias("expected"), (F.col("k") / F.nullif(expected, F.lit(0.0))).alias("lift"), tail.alias("tail"))


TABLES["above"] = "SELECT s.doc_id, lo AS mask, level_id, min(tokens) AS least FROM states s JOIN pairs ON s.mask = hi JOIN levels ON fidelity >= level GROUP BY ALL"


@query("""a AS (SELECT p.doc_id, p.depth, packet, string_agg(coalesce(CAST(least AS VARCHAR), '-'), ',' ORDER BY l.level_id) AS signature FROM prefixes p JOIN bits ON (p.mask >> packet) & 1 = 0 CROSS JOIN levels l
    LEFT JOIN above u ON u.doc_id = p.doc_id AND u.mask = p.mask + (1 << packet) AND u.level_id = l.level_id WHERE p.arm = 'learned' GROUP BY ALL)
SELECT doc_id, depth, count(*) AS n_actions, count(DISTINCT signature) AS n_signatures, count(*) FILTER (signature LIKE '%-%') AS n_closing FROM a GROUP BY ALL""")
def g11_action_consequences(spark, sf_dir):
    """What each next packet still allows: of each level the cheapest state above, or none. Equal ones have one signature."""
    df = base.lattice(spark, sf_dir)
    reaching = lambda x: lambda t, f: F.when(f >= x, t).otherwise(F.lit(fr.FAR))
    for k, x in enumerate(LEVELS):
        df = lt.zeta(df.withColumn(f"above{k}", F.zip_with("tokens", "fidelity", reaching(x))), f"above{k}", N, down=False)
    above = [f"above{k}" for k in range(len(LEVELS))]
    rows = base.prefixes(spark, sf_dir).where("arm = 'learned'").select("doc_id", "depth", "mask").join(df.select("doc_id", *above), "doc_id")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(N - 1))).alias("packet")).where(~lt.has("mask", F.col("packet")))
    at = lambda c: F.get(c, F.col("mask") + lt.bit("packet"))
    signature = F.concat_ws(",", *[F.when(at(c) < fr.FAR, at(c).cast("string")).otherwise("-") for c in above])
    rows = rows.select("doc_id", "depth", signature.alias("signature"))
    return rows.groupBy("doc_id", "depth").agg(F.count(F.lit(1)).alias("n_actions"), F.count_distinct("signature").alias("n_signatures"), F.count(F.when(F.col("signature").contains("-"), 1)).alias("n_closing"))
