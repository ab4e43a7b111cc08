"""Intervals by resampled clusters: means, areas under curves, standardised ratios."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratefid.operators import bootstrap as bs

from . import base
from .evaluate_queries import _labelled, _sides
from .registry import query
from .sql import TABLES

REPLICATES = 200


def _draws_sql(ids: str, key: str, seed: str) -> str:
    hex_ = f"substr(sha256('{seed}:' || (r // {bs.DRAWS}) || ':' || {key}), CAST(r % {bs.DRAWS} AS INT) * 4 + 1, 4)"
    count = " + ".join(f"({hex_} >= '{s:04x}')::INT" for s in bs.STEPS if s < 65536)
    return f"SELECT {key}, CAST(r AS INT) AS replicate, {count} AS w FROM (SELECT DISTINCT {key} FROM {ids}), range({REPLICATES}) t(r)"


def _bounds_sql(value: str) -> str:
    known = f"list_sort(list({value}) FILTER ({value} IS NOT NULL))"
    at = lambda share: f"{known}[1 + CAST(floor({share} * (len({known}) - 1) + 1e-9) AS INT)]"
    return f"{at(0.025)} AS low, {at(0.975)} AS high"


TABLES["units"] = "SELECT doc_id, count(*) FILTER (repair) - count(*) FILTER (break) AS net FROM sides WHERE depth = 3 GROUP BY doc_id"
TABLES["k06_draws"] = _draws_sql("units", "doc_id", "k06")
TABLES["k06_means"] = "SELECT replicate, sum(w * net)::DOUBLE / nullif(sum(w), 0) AS mean FROM units JOIN k06_draws USING (doc_id) GROUP BY replicate"


def _net(spark, sf_dir):
    count = lambda c: F.count(F.when(F.col(c), 1))
    return _sides(spark, sf_dir).where("depth = 3").groupBy("doc_id").agg((count("repair") - count("break")).alias("net"))


@query("SELECT * FROM k06_means")
def k06_bootstrap(spark, sf_dir):
    """Replicate means of the repairs minus breaks of a document at depth 3."""
    found = bs.mean_interval(_net(spark, sf_dir), [], "doc_id", "net", REPLICATES, "k06")
    return found.select(F.posexplode("means").alias("replicate", "mean"))


@query(f"SELECT (SELECT count(*) FROM units) AS n, (SELECT avg(net) FROM units) AS mean, {_bounds_sql('mean')} FROM k06_means")
def k06_paired_interval(spark, sf_dir):
    """The mean of repairs minus breaks with its percentile interval over resampled documents."""
    return bs.mean_interval(_net(spark, sf_dir), [], "doc_id", "net", REPLICATES, "k06").select("n", "mean", "low", "high")


def _auc_sql(seed: str, cluster: str) -> tuple[str, str]:
    TABLES[f"{seed}_draws"] = _draws_sql("labelled", cluster, seed)
    TABLES[f"{seed}_values"] = f"SELECT lang, n_chars, replicate, sum(w * quality)::DOUBLE AS p, sum(w * (1 - quality))::DOUBLE AS n FROM labelled JOIN {seed}_draws USING ({cluster}) GROUP BY ALL"
    TABLES[f"{seed}_areas"] = f"""SELECT lang, replicate, sum(p * (below + n / 2)) / nullif(sum(p) * sum(n), 0) AS auc FROM (SELECT *, sum(n) OVER (PARTITION BY lang, replicate ORDER BY n_chars) - n AS below FROM {seed}_values) GROUP BY ALL"""
    return f"""r AS (SELECT lang, quality, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0::DOUBLE AS mid FROM labelled),
    plain AS (SELECT lang, (sum(mid) FILTER (quality = 1) - sum(quality) * (sum(quality) + 1) / 2.0::DOUBLE) / nullif(sum(quality) * sum(1 - quality), 0)::DOUBLE AS auc FROM r GROUP BY lang),
    b AS (SELECT lang, {_bounds_sql('auc')} FROM {seed}_areas GROUP BY lang)
    SELECT plain.lang, auc, low, high FROM plain JOIN b ON plain.lang IS NOT DISTINCT FROM b.lang""", seed


@query(_auc_sql("k07", "doc_id")[0])
def k07_auc_interval(spark, sf_dir):
    """Of each language how well the length of a document tells its quality, and how sure that is over resampled documents."""
    return bs.auc_interval(_labelled(spark, sf_dir), ["lang"], "doc_id", "n_chars", "quality", REPLICATES, "k07").select("lang", "auc", "low", "high")


@query(_auc_sql("k07c", "source")[0])
def k07_auc_interval_by_source(spark, sf_dir):
    """As before, but whole sources are drawn: all documents of a source count alike."""
    return bs.auc_interval(_labelled(spark, sf_dir), ["lang"], "source", "n_chars", "quality", REPLICATES, "k07c").select("lang", "auc", "low", "high")


TABLES["k08_draws"] = _draws_sql("documents", "doc_id", "k08")


@query(f"""c AS (SELECT level_id, depth, arm, count(*)::DOUBLE AS n FROM hits WHERE active GROUP BY ALL),
w AS (SELECT level_id, depth, sum(n) / sum(sum(n)) OVER (PARTITION BY level_id) AS w FROM c GROUP BY level_id, depth),
r AS (SELECT level_id, depth, arm, replicate, sum(w * (1.0 - hit::INT))::DOUBLE / nullif(sum(w), 0) AS risk FROM hits JOIN k08_draws USING (doc_id) WHERE active GROUP BY ALL),
s AS (SELECT level_id, replicate, sum(w * risk) FILTER (arm = 'learned') / nullif(sum(w * risk) FILTER (arm = 'control'), 0) AS ratio, count(*) FILTER (risk IS NULL) AS gaps FROM r JOIN w USING (level_id, depth) GROUP BY ALL)
SELECT level_id, {_bounds_sql('ratio')}, count(ratio) AS replicates FROM (SELECT level_id, replicate, CASE WHEN gaps = 0 THEN ratio END AS ratio FROM s) GROUP BY level_id""")
def k08_ratio_interval(spark, sf_dir):
    """The interval of k08_standardised_ratio over resampled documents; depths weigh as in the table itself. Replicates with an empty cell are left out."""
    rows = base.hits(spark, sf_dir).where("active").select("doc_id", "level_id", "depth", "arm", (1 - F.col("hit").cast("int")).alias("miss"))
    cells = bs.weighted_sums(rows, ["level_id", "depth", "arm"], "doc_id", "miss", REPLICATES, "k08")
    cells = cells.withColumn("risks", F.zip_with("totals", "ns", lambda t, n: t / F.nullif(n, F.lit(0.0))))
    sides = cells.groupBy("level_id", "depth").agg(F.sum("n").alias("n"), *[F.max(F.when(F.col("arm") == a, F.col("risks"))).alias(a) for a in ("learned", "control")])
    # A level's depths are few: their weighted risks add up in one row.
    depths = sides.groupBy("level_id").agg(F.collect_list(F.struct("n", "learned", "control")).alias("d"))
    side = lambda a, i: F.aggregate(F.col("d"), F.lit(0.0), lambda s, x: s + x["n"] * F.get(x[a], i))
    ratios = F.transform(F.sequence(F.lit(0), F.lit(REPLICATES - 1)), lambda i: side("learned", i) / F.nullif(side("control", i), F.lit(0.0)))
    rows = depths.select("level_id", ratios.alias("r"))
    low, high = bs.bounds(F.col("r"))
    return rows.select("level_id", low.alias("low"), high.alias("high"), F.size(F.filter("r", lambda v: v.isNotNull())).cast("long").alias("replicates"))
