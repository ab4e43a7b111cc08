"""Queries that compare policies, folds and arms, and that run user functions, over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators.split import range_rank
from ..operators import frontier as fr
from ..operators import lattice as lt
from ..operators import relational as rel
from ..operators import scoring as sc
from ..operators import split as sp
from . import base
from .registry import query
from .sql import TABLES

N, LEVELS = base.N_PACKETS, base.LEVELS
FULL = (1 << N) - 1


@query("""SELECT a.doc_id, a.level_id, count(*) AS n_pairs FROM optima a JOIN (SELECT doc_id, level_id, mask AS high FROM optima) b ON a.doc_id = b.doc_id AND b.level_id = a.level_id + 1 AND a.mask & high = a.mask GROUP BY ALL""")
def j04_subset_join(spark, sf_dir):
    rows = fr.tied_optima(base.states(spark, sf_dir), LEVELS)
    high = rows.select("doc_id", (F.col("level_id") - 1).alias("level_id"), F.col("mask").alias("high"))
    both = rows.join(high, ["doc_id", "level_id"]).where(F.col("mask").bitwiseAND(F.col("high")) == F.col("mask"))
    return both.groupBy("doc_id", "level_id").agg(F.count(F.lit(1)).alias("n_pairs"))


@query("""r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('pool:' || doc_id), doc_id) AS position, (SELECT count(*) FROM documents) AS n FROM documents)
SELECT doc_id, position FROM r WHERE position > floor(n * 0.5) AND position <= floor(n * 0.75)""")
def d05_pool_slice(spark, sf_dir):
    n = base.table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"))
    rows = sp.hash_rank(base.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "pool").join(F.broadcast(n))
    return rows.where((F.col("position") > F.floor(F.col("n") * 0.5)) & (F.col("position") <= F.floor(F.col("n") * 0.75))).select("doc_id", "position")


@query("""f AS (SELECT doc_id, max(fidelity) FILTER (mask = 63) AS full_f FROM states GROUP BY doc_id)
SELECT doc_id, lang, full_f, row_number() OVER (PARTITION BY lang ORDER BY sha256('answerable:' || doc_id), doc_id) AS position FROM f JOIN documents USING (doc_id) WHERE full_f > 0.02""")
def d12_answerable(spark, sf_dir):
    full = base.states(spark, sf_dir).where(F.col("mask") == FULL).select("doc_id", F.col("fidelity").alias("full_f")).where("full_f > 0.02")
    return sp.hash_rank(full.join(base.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id"), "doc_id", "answerable", ["lang"]).select("doc_id", "lang", "full_f", "position")


@query("""r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('screen:' || doc_id), doc_id) AS position, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang, CASE WHEN position <= floor(n * 0.3) THEN 'screen' WHEN position <= floor(n * 0.9) THEN 'design' END AS cohort FROM r""")
def d14_cohorts(spark, sf_dir):
    rows = sp.label_slices(base.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "screen", {"screen": 0.3, "design": 0.6}, ["lang"])
    return rows.select("doc_id", "lang", F.col("slice").alias("cohort"))


@query("""o AS (SELECT doc_id, depth, max(CASE WHEN arm = 'learned' THEN hit END) AS a, max(CASE WHEN arm = 'control' THEN hit END) AS b FROM hits WHERE level_id = 0 GROUP BY ALL)
SELECT depth, k, count(*) FILTER (CASE k WHEN 1 THEN a ELSE a OR b END) AS covered, count(a) AS n FROM o, (SELECT unnest([1, 2]) AS k) GROUP BY ALL""")
def c13_pool_coverage(spark, sf_dir):
    of = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("hit")))
    o = base.hits(spark, sf_dir).where("level_id = 0").groupBy("doc_id", "depth").agg(of("learned").alias("a"), of("control").alias("b"))
    o = o.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    return o.groupBy("depth", "k").agg(F.count(F.when(F.when(F.col("k") == 1, F.col("a")).otherwise(F.col("a") | F.col("b")), 1)).alias("covered"), F.count("a").alias("n"))


@query("""u AS (SELECT doc_id, depth, fidelity FROM prefixes WHERE arm = 'learned' AND depth <= 4), b AS (SELECT doc_id, first(depth ORDER BY fidelity DESC, depth) AS best, max(fidelity) AS top FROM u GROUP BY doc_id)
SELECT doc_id, CASE WHEN top >= fidelity + 0.01 THEN best ELSE 6 END AS depth FROM b JOIN prefixes USING (doc_id) WHERE arm = 'learned' AND depth = 6""".replace("SELECT doc_id, CASE WHEN top", "SELECT b.doc_id, CASE WHEN top").replace("AND depth = 6", "AND prefixes.depth = 6"))
def c14_threshold_or_anchor(spark, sf_dir):
    p = base.prefixes(spark, sf_dir).where("arm = 'learned'")
    best = p.where("depth <= 4").groupBy("doc_id").agg(F.min_by("depth", F.struct(-F.col("fidelity"), "depth")).alias("best"), F.max("fidelity").alias("top"))
    rows = p.where(F.col("depth") == N).select("doc_id", "fidelity").join(best, "doc_id")
    return rows.select("doc_id", F.when(F.col("top") >= F.col("fidelity") + 0.01, F.col("best")).otherwise(N).alias("depth"))


@query("SELECT doc_id, max(fidelity) FILTER (mask = 63) AS \"full\", max(fidelity) FILTER (mask = 0) AS empty, max(fidelity) FILTER (mask = 63) - max(fidelity) FILTER (mask = 0) AS gain FROM states GROUP BY doc_id")
def h15_context_gain(spark, sf_dir):
    at = lambda m: F.max(F.when(F.col("mask") == m, F.col("fidelity")))
    out = base.states(spark, sf_dir).groupBy("doc_id").agg(at(FULL).alias("full"), at(0).alias("empty"))
    return out.withColumn("gain", F.col("full") - F.col("empty"))


@query("""p AS (SELECT doc_id, arm, depth, tokens FROM prefixes), c AS (SELECT doc_id, level_id, level, tokens AS oracle FROM chain)
SELECT h.doc_id, h.arm, h.depth, count(*) FILTER (h.hit) AS successes, CASE WHEN bool_and(h.hit) THEN sum(h.tokens - c.oracle) / (count(*) * max(f.tokens)) END AS regret FROM hits h JOIN c USING (doc_id, level_id) JOIN (SELECT doc_id, tokens FROM states WHERE mask = 63) f USING (doc_id) GROUP BY ALL""")
def i01_arm_rows(spark, sf_dir):
    rows = fr.with_frontiers(base.lattice(spark, sf_dir), LEVELS, N).select("doc_id", "overlaps", "tokens", "fidelity", F.filter("nested_tokens", lambda t: t >= 0).alias("oracle"))
    rows = base._once(base._arms(rows.where("size(oracle) > 0")), masks=base._masks(), least=F.aggregate("oracle", F.lit(0).cast("long"), lambda a, t: a + t), n=F.size("oracle"), whole=F.element_at("tokens", -1))
    rows = rows.select("doc_id", "arm", "tokens", "fidelity", "n", "least", "whole", F.posexplode("masks").alias("depth", "mask"))
    # The levels of a chain are the first n, and a state that reaches one of them reaches those before it.
    hits = sum((F.when((F.col("n") > k) & (F.get("fidelity", F.col("mask")) >= x), 1).otherwise(0) for k, x in enumerate(LEVELS)), F.lit(0)).cast("long")
    regret = (F.get("tokens", F.col("mask")) * F.col("n") - F.col("least")) / (F.col("n") * F.col("whole"))
    return rows.select("doc_id", "arm", "depth", hits.alias("successes"), F.when(hits == F.col("n"), regret).alias("regret"))


@query("""x AS (SELECT p.doc_id, o.arm, o.pos < l.pos AS ok FROM precedences p JOIN orders o ON o.doc_id = p.doc_id AND o.packet_id = p.winner JOIN orders l ON l.doc_id = p.doc_id AND l.packet_id = p.loser AND l.arm = o.arm WHERE p.slack = 0.02)
SELECT arm, count(*) AS n_pairs, avg(ok::INT) AS accuracy FROM x GROUP BY arm""")
def i04_pair_accuracy(spark, sf_dir):
    rows = fr.with_member_counts(base.lattice(spark, sf_dir), LEVELS, N, (0.02,))
    rows = base._once(base._arms(base._once(rows, pairs=fr.preferred(N)).where("size(pairs) > 0").select("doc_id", "overlaps", "pairs")), pos=F.transform(base._ids(), lambda p: F.array_position("order", p)))
    right = F.filter("pairs", lambda x: F.get("pos", x["winner"]) < F.get("pos", x["loser"]))
    rows = rows.groupBy("arm").agg(F.sum(F.size("pairs")).alias("n_pairs"), F.sum(F.size(right)).alias("right"))
    return rows.select("arm", "n_pairs", (F.col("right") / F.col("n_pairs")).alias("accuracy"))


@query("""m AS (SELECT arm, depth, avg(hit::INT) AS success FROM hits GROUP BY ALL) SELECT depth, count(*) AS runs, avg(success) AS mean_success, min(success) AS worst FROM m GROUP BY depth""")
def i07_mean_over_runs(spark, sf_dir):
    m = base.hits(spark, sf_dir).groupBy("arm", "depth").agg(ev.rate("hit").alias("success"))
    return m.groupBy("depth").agg(F.count(F.lit(1)).alias("runs"), F.avg("success").alias("mean_success"), F.min("success").alias("worst"))


TABLES["folded"] = "SELECT l.doc_id, l.quality, d.n_chars, CAST(CAST('0x' || substr(sha256(CAST(l.doc_id AS VARCHAR)), 1, 16) AS UBIGINT) % 5 AS INT) AS fold FROM labels l JOIN documents d USING (doc_id)"


def _folded(spark, sf_dir):
    rows = base.table(spark, sf_dir, "labels").join(base.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select("doc_id", "quality", "n_chars", sp.prefix_fold(F.col("doc_id"), 5).cast("int").alias("fold"))


@query("""t AS (SELECT f.fold, n_chars, row_number() OVER (PARTITION BY f.fold ORDER BY n_chars, x.doc_id) AS k, count(*) OVER (PARTITION BY f.fold) AS n FROM (SELECT unnest(range(5)) AS fold) f JOIN folded x ON x.fold <> f.fold), c AS (SELECT fold, n_chars AS cut FROM t WHERE k = ceil(0.8 * n))
SELECT x.fold, c.cut, count(*) FILTER (n_chars >= cut) AS above, count(*) AS n FROM folded x JOIN c USING (fold) GROUP BY ALL""")
def i19_out_of_fold_thresholds(spark, sf_dir):
    rows = _folded(spark, sf_dir)
    train = rows.withColumn("other", F.col("fold")).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("fold <> other")
    ranked = range_rank(train, ["fold"], [F.col("n_chars"), F.col("doc_id")])
    cuts = ranked.where(F.col("position") == F.ceil(0.8 * F.col("size"))).select("fold", F.col("n_chars").alias("cut"))
    return rows.join(cuts, "fold").groupBy("fold", "cut").agg(F.count(F.when(F.col("n_chars") >= F.col("cut"), 1)).alias("above"), F.count(F.lit(1)).alias("n"))


@query("""r AS (SELECT fold, quality, rank() OVER (PARTITION BY fold ORDER BY n_chars) + (count(*) OVER (PARTITION BY fold, n_chars) - 1) / 2.0::DOUBLE AS mid FROM folded UNION ALL SELECT -1, quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0::DOUBLE FROM folded)
SELECT fold, (sum(mid) FILTER (quality = 1) - sum(quality) * (sum(quality) + 1) / 2.0::DOUBLE) / nullif(sum(quality) * sum(1 - quality), 0)::DOUBLE AS auc FROM r GROUP BY fold""")
def i34_fold_and_pooled_auc(spark, sf_dir):
    rows = _folded(spark, sf_dir)
    both = rows.unionByName(rows.withColumn("fold", F.lit(-1)))
    return ev.auc(both, "n_chars", "quality", ["fold"]).select("fold", "auc")


@query("SELECT arm, depth, avg(s.tokens / f.tokens) AS keep_rate, avg(fidelity) AS fidelity, avg(fidelity - full_f) AS delta FROM prefixes s JOIN (SELECT doc_id, tokens, fidelity AS full_f FROM states WHERE mask = 63) f USING (doc_id) GROUP BY ALL".replace("avg(fidelity)", "avg(s.fidelity)").replace("avg(fidelity -", "avg(s.fidelity -"))
def i23_keep_rate_table(spark, sf_dir):
    rows = base._once(base._ordered(spark, sf_dir), masks=base._masks(), whole=F.element_at("tokens", -1), full_f=F.element_at("fidelity", -1))
    rows = rows.select("arm", "tokens", "fidelity", "whole", "full_f", F.posexplode("masks").alias("depth", "mask"))
    at = lambda c: F.get(c, F.col("mask")).alias(c)
    rows = rows.select("arm", "depth", "whole", "full_f", at("tokens"), at("fidelity"))
    # A text without words keeps 0 of 0 tokens, which is not a number, as in the SQL.
    rate = F.coalesce(F.col("tokens") / F.nullif("whole", F.lit(0)), F.lit(float("nan")))
    return rows.groupBy("arm", "depth").agg(F.avg(rate).alias("keep_rate"), F.avg("fidelity").alias("fidelity"), F.avg(F.col("fidelity") - F.col("full_f")).alias("delta"))


@query("c AS (SELECT source, reached, count(*) AS n FROM reached_states JOIN documents USING (doc_id) GROUP BY ALL) SELECT source, reached, n, n / sum(n) OVER (PARTITION BY source) AS share FROM c")
def i35_role_statistics(spark, sf_dir):
    rows = lt.attained(base.states(spark, sf_dir), LEVELS).join(base.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    out = rows.groupBy("source", F.col("reached").cast("long").alias("reached")).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("source")))


@query("""w AS (SELECT doc_id, mask, fidelity, fidelity >= 0.1 AS pos FROM states) SELECT p.doc_id, avg((p.fidelity > q.fidelity)::INT) AS accuracy, count(*) AS n FROM (SELECT doc_id, tokens AS fidelity FROM states WHERE fidelity >= 0.1) p JOIN (SELECT doc_id, tokens AS fidelity FROM states WHERE fidelity < 0.1) q USING (doc_id) GROUP BY p.doc_id""")
def k11_pair_accuracy(spark, sf_dir):
    """How often a state at the level has more tokens than one below it: the score is the token count."""
    side = lambda test: F.transform(F.filter(F.arrays_zip("fidelity", "tokens"), lambda x: test(x["fidelity"])), lambda x: x["tokens"])
    rows = base._once(base.lattice(spark, sf_dir), p=side(lambda f: f >= 0.1), q=side(lambda f: f < 0.1)).where("size(p) > 0 AND size(q) > 0")
    n = F.size("p").cast("long") * F.size("q")
    right = F.aggregate(F.transform("p", lambda x: F.size(F.filter("q", lambda y: y < x)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("doc_id", (right / n).alias("accuracy"), n.alias("n"))


@query("""SELECT doc_id, mask, CASE WHEN doc_id % 11 = 4 AND mask = 9 THEN 'missing in stored' ELSE 'fidelity' END AS difference FROM states
WHERE doc_id % 11 = 4 AND mask = 9 OR doc_id % 7 = 3 AND mask = 5""")
def l05_recomputed_fidelity(spark, sf_dir):
    """All stored fidelities against ones computed anew. Some rows are stored wrong, some not at all, and some within the tolerance."""
    from ..sources import files

    own = base.states(spark, sf_dir).select("doc_id", "mask", "fidelity")
    wrong = F.when((F.col("doc_id") % 7 == 3) & (F.col("mask") == 5), 0.5).when(F.col("doc_id") % 5 == 2, 1e-14).otherwise(0.0)
    stored = own.where(~((F.col("doc_id") % 11 == 4) & (F.col("mask") == 9))).withColumn("fidelity", F.col("fidelity") + wrong)
    return rel.reconcile(files.round_trip(stored, "fidelity"), own, ["doc_id", "mask"])


@query("""roles2 AS (SELECT role, count(*) AS n, count(DISTINCT doc_id) AS n_ids FROM roles GROUP BY role) SELECT role, n, n_ids, n = n_ids AS unique_ids, (SELECT count(*) FROM roles r WHERE r.role = roles2.role AND r.doc_id NOT IN (SELECT doc_id FROM documents)) AS outside FROM roles2""")
def l07_lineage_audit(spark, sf_dir):
    from .split_queries import _roles

    known = base.table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("k"))
    rows = _roles(spark, sf_dir).join(known, "doc_id", "left")
    out = rows.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_ids"), F.count(F.when(F.col("k").isNull(), 1)).alias("outside"))
    return out.withColumn("unique_ids", F.col("n") == F.col("n_ids"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS symbols, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS words, len(list_filter(string_split_regex(text, '[ \t\n]+'), lambda w: w <> '')) AS blanks FROM documents")
def m03_tokenizers(spark, sf_dir):
    docs = base.table(spark, sf_dir, "documents")
    return docs.select("doc_id", *[f(F.col("text")).cast("long").alias(n) for n, f in sc.TOKENIZERS.items()])


@query("""SELECT doc_id, packet_id, upper(substr(md5(text), 1, 8)) AS answer FROM packets""")
def m01_user_function(spark, sf_dir):
    """A user's function over batches; this one stands for a model and returns a digest of the text."""

    def make():
        import hashlib

        return lambda batch: batch["text"].map(lambda t: hashlib.md5(t.encode()).hexdigest()[:8].upper())

    return sc.score_with(base.packets(spark, sf_dir).drop("tokens"), ["text"], make).drop("text")


@query("""s AS (SELECT doc_id, packet_id AS idx, overlap FROM packet_overlap)
SELECT policy, doc_id, idx FROM (SELECT 'overlap' AS policy, doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, idx) AS k FROM s UNION ALL SELECT 'first', doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY idx) FROM s UNION ALL SELECT 'last', doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY idx DESC) FROM s) WHERE k <= 2""")
def m02_policies(spark, sf_dir):
    held = base.packet_terms(spark, sf_dir).withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(N - 1)))).where(lt.has("mask", F.col("idx")))
    held = held.groupBy("doc_id", "idx").agg(F.count(F.lit(1)).alias("o"))
    rows = base.packets(spark, sf_dir).select("doc_id", F.col("packet_id").alias("idx")).join(held, ["doc_id", "idx"], "left").withColumn("overlap", F.coalesce("o", F.lit(0)))
    out = None
    for name, order in sc.POLICIES.items():
        k = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order()))
        own = rows.withColumn("k", k).where("k <= 2").select(F.lit(name).alias("policy"), "doc_id", "idx")
        out = own if out is None else out.unionByName(own)
    return out
