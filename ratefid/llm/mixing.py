"""Mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, written

#: Documents of one source that are scheduled together.
BLOCK_ROWS = 16
#: Rows of one source that one task puts in order, about.
BUCKET_ROWS = 50_000
#: Target weights are whole shares; the stock ones add up to about this.
PARTS = 1000
#: Stock weights are in proportion to a source's rows to this power, so large sources weigh less than their rows.
POWER = 0.7
#: Rows of the schedule that may be broadcast.
FEW = 500_000


def stock_shares(docs: DataFrame) -> DataFrame:
    """source, share: whole numbers in proportion to rows ** POWER, at least one."""
    sizes = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum(F.pow("n", F.lit(POWER))).alias("total"))
    share = F.round(PARTS * F.pow("n", F.lit(POWER)) / F.col("total"))
    return sizes.join(F.broadcast(total)).select("source", F.greatest(share.cast("long"), F.lit(1).cast("long")).alias("share"))


def cycles(sources: DataFrame) -> DataFrame:
    """What each cycle holds: first, last (cycles alike), base (slots before), size (slots of one), and the blocks of each source.

    ``sources`` has source, share and n_blocks. A cycle gives every source that still has them ``share`` blocks; a source's last
    cycle gives what is left. So there are at most two kinds of cycle for each source, in one more.
    """
    full = F.floor(F.col("n_blocks") / F.col("share"))
    ends = sources.select(F.explode(F.array(F.lit(0).cast("long"), full, F.ceil(F.col("n_blocks") / F.col("share")))).alias("first")).distinct()
    ends = ends.withColumn("last", F.lead("first").over(Window.orderBy("first")) - 1).where("last IS NOT NULL")  # a row for each source and end
    every = sources.agg(F.array_sort(F.collect_list(F.struct("source", "share", "n_blocks"))).alias("all"))
    kinds = ends.join(F.broadcast(every))
    left = F.transform("all", lambda s: F.least(s["share"], F.greatest(F.lit(0).cast("long"), s["n_blocks"] - F.col("first") * s["share"])))
    before = F.transform("all", lambda s: F.least(s["n_blocks"], F.col("first") * s["share"]))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + b)
    return kinds.withColumn("blocks", left).withColumn("size", total("blocks")).withColumn("base", total(before)).where("size > 0")


def schedule(kinds: DataFrame) -> DataFrame:
    """source, nth (its block of the cycle), slot, for each kind of cycle: earliest deadline first among the released.

    Block j of a source with m of a cycle's s slots is released at floor(j*s/m) and due at ceil((j+1)*s/m), so in every prefix each
    source has less than one block more or less than its weight; all shares of a cycle fill it, so all deadlines can be met.
    """
    release = lambda done, m: F.floor(done * F.col("size") / m)
    due = lambda done, m: F.ceil((done + 1) * F.col("size") / m)

    def pick(done, slot):
        waiting = F.transform(
            F.arrays_zip(done.alias("d"), F.col("blocks").alias("m")),
            lambda s, i: F.when((s["d"] < s["m"]) & (release(s["d"], s["m"]) <= slot), F.struct(due(s["d"], s["m"]).alias("due"), i.alias("i"))),
        )
        return F.array_min(waiting)["i"]

    def step(state, slot):
        i = pick(state["done"], slot)
        return F.struct(
            F.transform(state["done"], lambda d, at: F.when(at == i, d + 1).otherwise(d)).alias("done"),
            F.concat(state["order"], F.array(i)).alias("order"),
        )

    start = F.struct(F.transform("blocks", lambda b: b * 0).alias("done"), F.array().cast("array<int>").alias("order"))
    run = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("size") - 1), start, step, lambda s: s["order"])
    slots = kinds.select("first", "last", "base", "size", "all", F.posexplode(run).alias("slot", "i"))
    nth = F.row_number().over(Window.partitionBy("first", "i").orderBy("slot")) - 1
    return slots.select("first", "last", "base", "size", F.get(F.col("all"), F.col("i"))["source"].alias("source"), nth.cast("long").alias("nth"), F.col("slot").cast("long").alias("slot"))


def mixed(docs: DataFrame, shares: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All columns of ``docs`` with _block and _place (in its source) and _slot (of the block in the mixture), which replace such columns.

    In every run of blocks from the start each source is within one block of its weight among the sources that are not used up
    yet; when one is, the others share its slots in proportion. No row is dropped or repeated: the mixture is an order.
    Rows of a source come in order of the MD5 of doc_id. A null source is the source ''; a source that ``shares`` (source, share)
    does not list has share 1. Rows without doc_id come in any order among themselves. No rows give no rows.
    """
    n_buckets = max(1, -(-docs.count() // BUCKET_ROWS))
    # Rows without doc_id are told apart by where they are read, so they do not fall into one bucket.
    known = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")))
    order = F.md5(F.encode(known, "utf-8"))
    name = F.coalesce(F.col("source"), F.lit(""))
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), name.alias("_source"), order.alias("_order"))
    rows = rows.withColumn("_bucket", F.floor(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") * n_buckets / (1 << 32)))
    sizes = rows.groupBy("_source", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_source").orderBy("_bucket")) - F.col("_n")  # a row for each bucket of a source
    sizes = written(sizes.withColumn("_before", before), "mix-sizes")
    counts = sizes.groupBy(F.col("_source").alias("source")).agg(F.sum("_n").alias("n"))
    shares = (stock_shares(docs) if shares is None else shares).select("source", F.col("share").cast("long"))
    sources = counts.join(shares, "source", "left").select("source", F.coalesce("share", F.lit(1).cast("long")).alias("share"), F.ceil(F.col("n") / block_rows).alias("n_blocks"))
    sources = written(sources, "mix-sources")
    plan = written(schedule(cycles(sources)), "mix-plan")
    small = plan.count() <= FEW
    plan = plan.select(F.col("source").alias("_source"), F.col("nth").alias("_nth"), *[F.col(c).alias(f"_{c}") for c in ("first", "last", "base", "size")], F.col("slot").alias("_at"))
    place = F.row_number().over(Window.partitionBy("_source", "_bucket").orderBy("_order", "_id")) - 1
    rows = rows.withColumn("_nth_row", place).join(_few(sizes.drop("_n"), sizes), ["_source", "_bucket"])
    rows = rows.join(_few(sources.select(F.col("source").alias("_source"), F.col("share").alias("_share")), sources), "_source")
    at = F.col("_nth_row") + F.col("_before")
    rows = rows.withColumn("_block", F.floor(at / block_rows)).withColumn("_place", at % block_rows)
    rows = rows.withColumn("_cycle", F.floor(F.col("_block") / F.col("_share"))).withColumn("_nth", F.col("_block") % F.col("_share"))
    plan = F.broadcast(plan) if small else plan
    rows = rows.join(plan, ["_source", "_nth"]).where(F.col("_cycle").between(F.col("_first"), F.col("_last")))
    slot = F.col("_base") + (F.col("_cycle") - F.col("_first")) * F.col("_size") + F.col("_at")
    made = F.struct("_block", "_place", slot.alias("_slot")).alias("_made")
    rows = rows.select("_row", made)
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c not in ("_block", "_place", "_slot")], "_made.*")


def _few(df: DataFrame, counted: DataFrame) -> DataFrame:
    return F.broadcast(df) if counted.count() <= FEW else df


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot of every document in the mixture; null sources, repeats and rows without doc_id as ``mixed`` says."""
    out = mixed(documents(spark, sf_dir).select("doc_id", "source"))
    return out.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.col("_block").alias("block"), F.col("_place").alias("place"), F.col("_slot").alias("slot"))


OP5_SQL = f"""
WITH RECURSIVE docs AS (
    SELECT doc_id, coalesce(source, '') AS source, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(coalesce(cast(doc_id AS VARCHAR), '')), doc_id) - 1 AS nr FROM documents
), counts AS (
    SELECT source, count(*) AS n FROM docs GROUP BY source
), sources AS (
    SELECT source, greatest(1, cast(round({PARTS} * pow(n, {POWER}) / sum(pow(n, {POWER})) OVER ()) AS BIGINT)) AS share, (n + {BLOCK_ROWS - 1}) // {BLOCK_ROWS} AS n_blocks FROM counts
), numbered AS (
    SELECT *, row_number() OVER (ORDER BY source) AS i FROM sources
), starts AS (
    SELECT 0 AS first UNION SELECT n_blocks // share FROM sources UNION SELECT (n_blocks + share - 1) // share FROM sources
), kinds AS (
    SELECT first, list(greatest(0, least(share, n_blocks - first * share)) ORDER BY i) AS m, sum(greatest(0, least(share, n_blocks - first * share)))::BIGINT AS size,
        sum(least(n_blocks, first * share))::BIGINT AS base FROM starts, numbered GROUP BY first
), run AS (
    SELECT first, m, size, 0 AS t, list_transform(m, lambda x: 0) AS done, 0::BIGINT AS i FROM kinds WHERE size > 0
    UNION ALL
    SELECT first, m, size, t + 1, list_transform(done, lambda d, nr: d + (nr = pick)::INT), pick FROM (
        SELECT *, list_min(list_filter(list_transform(m, lambda x, nr: CASE WHEN done[nr] < x AND done[nr] * size // x <= t
            THEN ((done[nr] + 1) * size + x - 1) // x * 1000000 + nr END), lambda v: v IS NOT NULL)) % 1000000 AS pick FROM run WHERE t < size)
), plan AS (
    SELECT first, i, t - 1 AS slot, row_number() OVER (PARTITION BY first, i ORDER BY t) - 1 AS nth FROM run WHERE t > 0
), placed AS (
    SELECT doc_id, source, nr // {BLOCK_ROWS} AS block, nr % {BLOCK_ROWS} AS place, nr // {BLOCK_ROWS} // share AS cycle, nr // {BLOCK_ROWS} % share AS nth, i FROM docs JOIN numbered USING (source)
), phased AS (
    SELECT p.*, (SELECT max(first) FROM kinds WHERE first <= cycle) AS first FROM placed p
)
SELECT doc_id, source, block, place, base + (cycle - first) * size + slot AS slot FROM phased JOIN kinds USING (first) JOIN plan USING (first, i, nth)
"""
