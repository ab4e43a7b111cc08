"""Queries that sample, split, join and check whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import relational as rel
from ..operators import split as sp
from . import base
from .registry import query
from .sql import TABLES


def _docs(spark, sf_dir):
    return base.table(spark, sf_dir, "documents")


def _labels(spark, sf_dir):
    return base.table(spark, sf_dir, "labels")


@query("SELECT doc_id, lang, length(text) AS n FROM documents")
def a03_scan_by_format(spark, sf_dir):
    return spark.read.format("parquet").load(f"{sf_dir}/documents.parquet").select("doc_id", "lang", F.length("text").cast("long").alias("n"))


@query("SELECT d.doc_id, d.source FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels)")
def a04_projected_id_scan(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", "source").join(_labels(spark, sf_dir).select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id, lang, source FROM documents")
def a09_merge_shards(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "lang", "source")
    english = F.col("lang").eqNullSafe("en")
    return rel.merge_shards("doc_id", docs.where(english), docs.where(~english))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def a10_resume_missing(spark, sf_dir):
    return rel.without(_docs(spark, sf_dir).select("doc_id", "source"), "doc_id", _labels(spark, sf_dir))


@query("SELECT count(*) AS n_in, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS n_out, count(*) - count(DISTINCT doc_id) AS n_repeated FROM documents")
def a11_filter_counts(spark, sf_dir):
    marked = _docs(spark, sf_dir).select("doc_id").join(_labels(spark, sf_dir).select("doc_id", F.lit(1).alias("m")).distinct(), "doc_id", "left")
    return marked.agg(F.count(F.lit(1)).alias("n_in"), F.count("m").alias("n_out"), (F.count(F.lit(1)) - F.count_distinct("doc_id")).alias("n_repeated"))


@query("""hashed AS (SELECT lang, sha256(coalesce(CAST(doc_id AS VARCHAR), chr(0)) || chr(31) || coalesce(text, chr(0))) AS h FROM documents)
SELECT lang, count(*) AS n_rows, """ + ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS BIGINT) AS part{i}" for i in range(4)) + " FROM hashed GROUP BY lang")
def a12_table_digest(spark, sf_dir):
    return rel.table_digest(_docs(spark, sf_dir), ["lang"], ["doc_id", "text"])


@query("SELECT l.doc_id, l.quality, l.toxic, d.source FROM labels l JOIN documents d USING (doc_id)")
def j01_strict_join(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "source")
    return rel.strict_join(_labels(spark, sf_dir).select("doc_id", "quality", "toxic"), docs, "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def j02_semi_join(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", "lang").join(_labels(spark, sf_dir).where("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM labels WHERE quality = 0)")
def j03_anti_join_union(spark, sf_dir):
    lab = _labels(spark, sf_dir)
    return rel.without(_docs(spark, sf_dir).select("doc_id", "lang"), "doc_id", lab.where("toxic = 1"), lab.where("quality = 0"))


@query("SELECT a.doc_id, a.packet_id AS first, b.packet_id AS second FROM packets a JOIN packets b ON a.doc_id = b.doc_id AND a.packet_id < b.packet_id")
def j05_unordered_pairs(spark, sf_dir):
    return rel.unordered_pairs(base.packets(spark, sf_dir), "doc_id", "packet_id")


@query("SELECT f.doc_id, f.level_id, f.mask AS independent_mask, c.mask AS nested_mask FROM frontier f JOIN chain c USING (doc_id, level_id)")
def j06_level_rows(spark, sf_dir):
    from ..operators import frontier as fr

    s = base.lattice(spark, sf_dir)
    own = fr.independent_frontier(s, base.LEVELS, base.N_PACKETS).select("doc_id", "level_id", F.col("mask").alias("independent_mask"))
    return own.join(fr.nested_chain(s, base.LEVELS, base.N_PACKETS).select("doc_id", "level_id", F.col("mask").alias("nested_mask")), ["doc_id", "level_id"])


@query("""SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing in computed' ELSE 'n' END AS difference FROM (SELECT doc_id, n_chars AS n FROM documents) d LEFT JOIN (SELECT doc_id, n_chars + toxic AS n FROM labels JOIN documents USING (doc_id)) l USING (doc_id) WHERE l.doc_id IS NULL OR d.n <> l.n""")
def j07_reconcile(spark, sf_dir):
    stored = _docs(spark, sf_dir).select("doc_id", F.col("n_chars").alias("n"))
    computed = _docs(spark, sf_dir).join(_labels(spark, sf_dir), "doc_id").select("doc_id", (F.col("n_chars") + F.col("toxic")).alias("n"))
    return rel.reconcile(stored, computed, ["doc_id"])


@query("SELECT s.doc_id, s.mask, packet, s.fidelity AS before, t.fidelity AS after, t.tokens - s.tokens AS added FROM states s, bits JOIN states t ON t.doc_id = s.doc_id AND t.mask = s.mask + (1 << packet) WHERE (s.mask >> packet) & 1 = 0")
def j08_bit_flip_neighbours(spark, sf_dir):
    from ..operators.lattice import neighbours

    rows = neighbours(base.states(spark, sf_dir), base.N_PACKETS)
    return rows.select("doc_id", "mask", "packet", "before", "after", (F.col("tokens_after") - F.col("tokens_before")).alias("added"))


TABLES["roles"] = "SELECT doc_id, 'good' AS role FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'all' FROM documents"


def _roles(spark, sf_dir):
    lab, role = _labels(spark, sf_dir), lambda df, r: df.select("doc_id", F.lit(r).alias("role"))
    return role(lab.where("quality = 1"), "good").unionByName(role(lab.where("toxic = 1"), "toxic")).unionByName(role(_docs(spark, sf_dir), "all"))


@query("""names AS (SELECT DISTINCT role FROM roles), ids AS (SELECT DISTINCT doc_id, role FROM roles)
SELECT a.role AS first, b.role AS second, (SELECT count(*) FROM ids x JOIN ids y USING (doc_id) WHERE x.role = a.role AND y.role = b.role) AS n FROM names a JOIN names b ON a.role < b.role""")
def j09_role_overlaps(spark, sf_dir):
    return rel.overlaps(_roles(spark, sf_dir), "doc_id", "role")


@query("SELECT arm, level_id, count(*) AS n FROM (SELECT doc_id FROM documents), (SELECT unnest(['learned', 'control']) AS arm), levels GROUP BY ALL")
def j10_grid(spark, sf_dir):
    arms = F.explode(F.array(F.lit("learned"), F.lit("control")))
    rows = _docs(spark, sf_dir).select("doc_id", arms.alias("arm")).join(F.broadcast(base.level_table(spark)))
    return rows.groupBy("arm", "level_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, row_number() OVER (ORDER BY sha256('pilot:' || doc_id), doc_id) AS position FROM documents WHERE n_chars >= 200 QUALIFY position <= 100")
def d01_lowest_hashes(spark, sf_dir):
    rows = sp.lowest_hashes(_docs(spark, sf_dir).where("n_chars >= 200").select("doc_id"), "doc_id", "pilot", 100)
    return sp.hash_rank(rows, "doc_id", "pilot")


@query("""ranked AS (SELECT doc_id, lang, row_number() OVER w AS position, count(*) OVER (PARTITION BY lang) AS n FROM documents WINDOW w AS (PARTITION BY lang ORDER BY sha256('slices:' || doc_id), doc_id))
SELECT doc_id, lang, position, CASE WHEN position <= floor(n * 0.6) THEN 'train' WHEN position <= floor(n * 0.8) THEN 'dev' WHEN position <= floor(n * 1.0) THEN 'test' END AS slice FROM ranked""")
def d02_hash_slices(spark, sf_dir):
    return sp.label_slices(_docs(spark, sf_dir).select("doc_id", "lang"), "doc_id", "slices", {"train": 0.6, "dev": 0.2, "test": 0.2}, ["lang"])


@query("""ranked AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('roles:' || doc_id), doc_id) AS position FROM documents JOIN best USING (doc_id) WHERE best >= 0.05)
SELECT doc_id, lang, CASE WHEN position % 2 = 1 THEN 'one' ELSE 'two' END AS role FROM ranked""")
def d03_attainable_slices(spark, sf_dir):
    reach = base.states(spark, sf_dir).groupBy("doc_id").agg(F.max("fidelity").alias("best")).where("best >= 0.05")
    rows = sp.hash_rank(_docs(spark, sf_dir).select("doc_id", "lang").join(reach, "doc_id"), "doc_id", "roles", ["lang"])
    return rows.select("doc_id", "lang", F.when(F.col("position") % 2 == 1, "one").otherwise("two").alias("role"))


@query("""ranked AS (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('reserve:' || doc_id), doc_id) AS position, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, position FROM ranked WHERE position > floor(n * 0.75)""")
def d04_reserve(spark, sf_dir):
    rows = sp.label_slices(_docs(spark, sf_dir).select("doc_id", "lang"), "doc_id", "reserve", {"used": 0.75, "reserve": 0.25}, ["lang"])
    return rows.where("slice = 'reserve'").select("doc_id", "position")


@query("""f AS (SELECT doc_id, max(fidelity) FILTER (mask = 63) AS full_f, max(fidelity) FILTER (mask = 0) AS empty_f, max(fidelity) AS top FROM states GROUP BY doc_id)
SELECT doc_id, full_f, top FROM f WHERE full_f >= 0.03 AND empty_f <= 0.01 AND top - full_f >= 0.005""")
def d06_eligibility(spark, sf_dir):
    at = lambda m: F.max(F.when(F.col("mask") == m, F.col("fidelity")))
    rows = base.states(spark, sf_dir).groupBy("doc_id").agg(at(63).alias("full_f"), at(0).alias("empty_f"), F.max("fidelity").alias("top"))
    return rows.where((F.col("full_f") >= 0.03) & (F.col("empty_f") <= 0.01) & (F.col("top") - F.col("full_f") >= 0.005)).select("doc_id", "full_f", "top")


@query("""sizes AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), quotas AS (SELECT lang, source, floor(n * 0.2) + CAST(row_number() OVER (ORDER BY n * 0.2::DOUBLE - floor(n * 0.2::DOUBLE) DESC, lang, source) <= floor(sum(n) OVER () * 0.2) - sum(floor(n * 0.2)) OVER () AS INT) AS quota FROM sizes)
SELECT doc_id, lang, source FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('strata:' || doc_id), doc_id) AS position FROM documents) JOIN quotas USING (lang, source) WHERE position <= quota""")
def d07_stratified_split(spark, sf_dir):
    return sp.stratified(_docs(spark, sf_dir).select("doc_id", "lang", "source"), "doc_id", ["lang", "source"], 0.2, "strata")


@query("SELECT doc_id, CAST(CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16) AS UBIGINT) % 5 AS INT) AS fold FROM documents")
def d08_stable_folds(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", sp.prefix_fold(F.col("doc_id"), 5).cast("int").alias("fold"))


@query("""SELECT doc_id, CAST(list_reduce(list_transform(string_split(sha256('fold:' || doc_id), ''), lambda d: CAST('0x' || d AS BIGINT)), lambda a, d: (a * 16 + d) % 7) AS INT) AS fold FROM documents""")
def d08_digest_folds(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", sp.digest_fold(F.col("doc_id"), 7, "fold:").cast("int").alias("fold"))


@query("""ranked AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('curve:' || doc_id), doc_id) AS position, count(*) OVER () AS n FROM documents)
SELECT doc_id, position, share FROM ranked, (SELECT unnest([0.25::DOUBLE, 0.5, 1.0]) AS share) WHERE position <= ceil(n * share)""")
def d09_nested_subsets(spark, sf_dir):
    rows = sp.nested_subsets(_docs(spark, sf_dir).select("doc_id"), "doc_id", "curve", (0.25, 0.5, 1.0))
    return rows.select("doc_id", "position", "share")


TABLES["reached_states"] = "SELECT doc_id, mask, count(level) FILTER (fidelity + 1e-12 >= level) AS reached FROM states, levels GROUP BY ALL"


@query("""ranked AS (SELECT doc_id, mask, reached, row_number() OVER (PARTITION BY doc_id, reached ORDER BY CAST(mask IN (0, 63) AS INT) DESC, sha256(doc_id || ':' || mask)) AS position, count(*) OVER (PARTITION BY doc_id, reached) AS n FROM reached_states)
SELECT doc_id, mask, reached, least(n, 4) / n AS probability FROM ranked WHERE position <= 4""")
def d10_class_sample(spark, sf_dir):
    from ..operators.lattice import attained

    rows = attained(base.states(spark, sf_dir), base.LEVELS)
    key = F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("mask").cast("string")), 256)
    by = Window.partitionBy("doc_id", "reached")
    rows = rows.withColumn("position", F.row_number().over(by.orderBy(F.desc(F.col("mask").isin(0, 63).cast("int")), key))).withColumn("n", F.count(F.lit(1)).over(by))
    return rows.where("position <= 4").select("doc_id", "mask", F.col("reached").cast("long").alias("reached"), (F.least("n", F.lit(4)) / F.col("n")).alias("probability"))


@query("""capped AS (SELECT doc_id, mask, reached, sha256('s:' || doc_id || ':' || mask) AS h FROM reached_states QUALIFY row_number() OVER (PARTITION BY doc_id, reached ORDER BY h) <= 2)
SELECT doc_id, mask, reached FROM capped""")
def d11_capped_stratum(spark, sf_dir):
    from ..operators.lattice import attained

    rows = attained(base.states(spark, sf_dir), base.LEVELS)
    h = F.sha2(F.concat(F.lit("s:"), F.concat_ws(":", F.col("doc_id").cast("string"), F.col("mask").cast("string"))), 256)
    rows = rows.withColumn("p", F.row_number().over(Window.partitionBy("doc_id", "reached").orderBy(h)))
    return rows.where("p <= 2").select("doc_id", "mask", F.col("reached").cast("long").alias("reached"))


@query("""classed AS (SELECT doc_id, arm, CASE WHEN bool_or(hit) IS NULL THEN 'inactive' WHEN bool_or(hit) THEN 'hit' ELSE 'miss' END AS class FROM hits WHERE depth = 3 GROUP BY ALL)
SELECT class, arm, doc_id FROM classed QUALIFY row_number() OVER (PARTITION BY class, doc_id ORDER BY sha256(arm || ':' || doc_id)) = 1""")
def d13_case_picks(spark, sf_dir):
    hit = F.bool_or("hit")
    rows = base.hits(spark, sf_dir).where("depth = 3").groupBy("doc_id", "arm").agg(F.when(hit.isNull(), "inactive").when(hit, "hit").otherwise("miss").alias("class"))
    h = F.sha2(F.concat_ws(":", "arm", F.col("doc_id").cast("string")), 256)
    return rows.withColumn("p", F.row_number().over(Window.partitionBy("class", "doc_id").orderBy(h))).where("p = 1").select("class", "arm", "doc_id")
