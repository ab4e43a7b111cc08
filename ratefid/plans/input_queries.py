"""Queries that read, segment, map and check inputs, and choose sentences by paragraph."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import bounds as bd
from ..operators import relational as rel
from ..operators import retrieval as rt
from ..operators import segment as sg
from ..sources import files
from . import base
from .evaluate_queries import _labelled
from .policy_queries import _folded
from .registry import query
from .sql import TABLES
from .text_queries import _answers, _bm25_sql, _chosen, _retrievable

N = base.N_PACKETS
TARGET, MOST = 48, 64
ALPHA, BOUND = 0.05, 0.4
SLOTS = 512
OPEN_END = r"(^|[^\p{L}\p{N}_])\p{L}{1,2}$"
MARK = "\nSource evidence: "


@query("SELECT doc_id, quality, toxic FROM labels")
def a01_read_jsonl(spark, sf_dir):
    """Written as lines of JSON with a blank line after each, then read into a fixed schema."""
    rows = base.table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    path = f"{files.shared_folder(spark)}/a01-{uuid.uuid4().hex}"
    rows.select(F.explode(F.array(F.to_json(F.struct("*")), F.lit(""))).alias("value")).write.text(path)
    return files.read_jsonl(spark, path, rows.schema)


TABLES["sentence_overlaps"] = """SELECT s.doc_id, s.idx, s.packet_id, s.sentence, s.tokens, count(q.term) AS overlap FROM packet_sentences s JOIN asked USING (doc_id)
    LEFT JOIN (SELECT DISTINCT doc_id, idx, unnest(t) AS term FROM sentence_terms) w ON w.doc_id = s.doc_id AND w.idx = s.idx LEFT JOIN question_terms q ON q.item_id = asked.item_id AND q.term = w.term GROUP BY ALL"""


def _overlaps(spark, sf_dir):
    """doc_id, idx, packet_id, sentence, tokens, overlap with the question."""
    asked = base.asked(spark, sf_dir).join(base.questions(spark, sf_dir), "item_id").select("doc_id", base.terms(F.col("question")).alias("q"))
    rows = base.packet_sentences(spark, sf_dir).join(asked, "doc_id")
    return rows.select("doc_id", "idx", "packet_id", "sentence", "tokens", F.size(F.array_intersect(base.terms(F.col("sentence")), "q")).cast("long").alias("overlap"))


@query("""u AS (SELECT doc_id, packet_id, string_agg(trim(sentence), ' ' ORDER BY idx) AS text, bool_or(overlap >= 2) AS supporting FROM sentence_overlaps GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY packet_id) - 1 AS unit_id, 'P' || packet_id AS title, md5(text) AS text, supporting FROM u""")
def b01_normalized_units(spark, sf_dir):
    """Nested rows: paragraphs are the packets, facts the sentences that have two of the question's terms."""
    asked = base.asked(spark, sf_dir).join(base.questions(spark, sf_dir), "item_id").select("doc_id", base.terms(F.col("question")).alias("q"))
    rows = base._packed(spark, sf_dir).join(asked, "doc_id")
    title = lambda p: F.concat(F.lit("P"), p.cast("string"))
    told = F.flatten(F.transform("parts", lambda x, p: F.filter(F.transform(x, lambda s, i: F.struct(title(p).alias("title"), i.alias("sent_id"), (F.size(F.array_intersect(base.terms(s), F.col("q"))) >= 2).alias("ok"))), lambda f: f["ok"])))
    rows = rows.withColumn("f", told)
    context = F.struct(F.transform("parts", lambda x, p: title(p)).alias("title"), F.col("parts").alias("sentences"))
    raw = rows.select("doc_id", context.alias("context"), F.struct(F.col("f.title").alias("title"), F.col("f.sent_id").alias("sent_id")).alias("supporting_facts"))
    return sg.normalized_units(raw, "doc_id").select("doc_id", "unit_id", "title", F.md5(F.encode("text", "utf-8")).alias("text"), "supporting")


@query()
def b05_chunks(spark, sf_dir):
    """Chunks near TARGET words of each line of a document; the tests cut them by hand."""
    docs = base.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("paragraph", "line"))
    rows = docs.select("doc_id", "paragraph", base.sentence_array(F.col("line")).alias("s")).where(F.size("s") > 0)
    return sg.chunked(rows, "s", base.terms, TARGET, MOST).select("doc_id", "paragraph", "chunk", "tokens", F.md5(F.encode("text", "utf-8")).alias("text"))


@query()
def b06_segmented_examples(spark, sf_dir):
    """Packets cut into chunks that keep their title and whether they support, numbered anew; the tests cut them by hand."""
    parts = base._worded(spark, sf_dir).select("doc_id", F.transform("held", lambda h: F.arrays_overlap(h, F.col("asked"))).alias("ok"))
    rows = base._packed(spark, sf_dir).join(parts, "doc_id").select("doc_id", "ok", F.posexplode("parts").alias("packet_id", "s")).where(F.size("s") > 0)
    rows = sg.chunked(rows, "s", base.terms, TARGET, MOST)
    unit = F.row_number().over(Window.partitionBy("doc_id").orderBy("packet_id", "chunk")) - 1
    return rows.select("doc_id", unit.alias("unit_id"), F.concat(F.lit("P"), F.col("packet_id").cast("string")).alias("title"), F.get("ok", F.col("packet_id")).alias("supporting"), "tokens", F.md5(F.encode("text", "utf-8")).alias("text"))


_NORM = lambda c: f"trim(regexp_replace(lower({c}), '[ \\t\\n]+', ' ', 'g'))"
TABLES["facts"] = "SELECT doc_id, idx, packet_id // 3 AS title, sentence FROM sentence_overlaps WHERE overlap > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, idx) <= 2"
TABLES["mapped"] = f"""SELECT f.doc_id, f.idx, f.title, count(p.packet_id) AS n_matches, CASE WHEN count(p.packet_id) = 1 THEN min(p.packet_id) END AS unit, CASE count(p.packet_id) WHEN 1 THEN 'mapped' WHEN 0 THEN 'missing' ELSE 'ambiguous' END AS status
    FROM facts f LEFT JOIN packets p ON p.doc_id = f.doc_id AND p.packet_id // 3 = f.title AND contains({_NORM("p.text")}, {_NORM("f.sentence")}) GROUP BY ALL"""


def _mapped(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("overlap"), "idx"))
    block = F.floor(F.col("packet_id") / 3).cast("int").alias("title")
    facts = _overlaps(spark, sf_dir).where("overlap > 0").withColumn("r", rank).where("r <= 2").select("doc_id", "idx", block, "sentence")
    units = base.packets(spark, sf_dir).select("doc_id", block, F.col("packet_id").alias("unit"), "text")
    return sg.mapped_facts(facts, units, "doc_id", ["idx"], sg.blank_normal)


@query("SELECT * FROM mapped")
def b17_mapped_facts(spark, sf_dir):
    return _mapped(spark, sf_dir)


@query("SELECT doc_id, idx, CASE WHEN doc_id % 11 = 0 THEN 'missing in stored' ELSE 'n_matches,status' END AS difference FROM mapped WHERE doc_id % 11 = 0 OR doc_id % 7 = 0")
def l03_fact_check(spark, sf_dir):
    """A stored mapping with rows left out and rows falsified, against the one worked out again: just these must come back."""
    fresh = _mapped(spark, sf_dir).select("doc_id", "idx", "n_matches", "unit", "status")
    bad = F.col("doc_id") % 7 == 0
    stored = fresh.where("doc_id % 11 <> 0").withColumn("n_matches", F.col("n_matches") + F.when(bad, 1).otherwise(0)).withColumn("status", F.when(bad, F.concat("status", F.lit("?"))).otherwise(F.col("status")))
    return rel.reconcile(stored, fresh, ["doc_id", "idx"])


@query("SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 AND turn % 2 = 0 THEN 'em,f1' WHEN conv_id % 5 = 0 THEN 'f1' ELSE 'tokens' END AS difference FROM answers WHERE conv_id % 5 = 0 OR conv_id % 3 = 0")
def l04_cached_answers_check(spark, sf_dir):
    """Stored metrics of answers, some falsified, against those worked out again."""
    f1 = tx.token_f1(F.col("p"), F.col("g"))
    fresh = _answers(spark, sf_dir).select("conv_id", "turn", tx.exact_match(F.col("pred"), F.col("gold")).alias("em"), f1.alias("f1"), tx.count_tokens(F.col("pred")).cast("long").alias("tokens"))
    five, three = F.col("conv_id") % 5 == 0, F.col("conv_id") % 3 == 0
    stored = fresh.withColumn("em", F.when(five & (F.col("turn") % 2 == 0), ~F.col("em")).otherwise(F.col("em")))
    stored = stored.withColumn("f1", F.when(five, F.col("f1") + 0.25).otherwise(F.col("f1"))).withColumn("tokens", F.when(three & ~five, F.col("tokens") + 1).otherwise(F.col("tokens")))
    return rel.reconcile(stored, fresh, ["conv_id", "turn"])


@query("""SELECT doc_id, first(idx ORDER BY tokens, sentence, idx) FILTER (overlap > 0) AS proof, first(idx ORDER BY overlap DESC, idx) AS answer_sentence, CAST(max(overlap) AS BIGINT) AS overlap FROM sentence_overlaps GROUP BY doc_id""")
def b22_proof_and_sentence(spark, sf_dir):
    """The shortest sentence that has a term of the question, and the one that has most."""
    rows = _overlaps(spark, sf_dir)
    proof = F.min_by("idx", F.when(F.col("overlap") > 0, F.struct("tokens", "sentence", "idx")))
    return rows.groupBy("doc_id").agg(F.when(F.max("overlap") > 0, proof).alias("proof"), F.min_by("idx", F.struct(-F.col("overlap"), "idx")).alias("answer_sentence"), F.max("overlap").alias("overlap"))


@query(rf"""s AS (SELECT doc_id, idx, sentence, CASE WHEN lag(regexp_matches(sentence, '{OPEN_END}')) OVER (PARTITION BY doc_id ORDER BY idx) THEN 0 ELSE 1 END AS starts FROM sentences),
u AS (SELECT doc_id, idx, sentence, sum(starts) OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS unit FROM s)
SELECT doc_id, CAST(unit AS BIGINT) AS unit, string_agg(idx, ',' ORDER BY idx) AS members, md5(string_agg(sentence, '.' ORDER BY idx)) AS text FROM u GROUP BY ALL""")
def b23_merged_pieces(spark, sf_dir):
    """Sentences cut after an initial are one unit with the next."""
    rows = sg.merged_at(base.sentences(spark, sf_dir), "doc_id", "idx", "sentence", OPEN_END)
    return rows.select("doc_id", "unit", F.array_join(F.transform("members", lambda i: i.cast("string")), ",").alias("members"), F.md5(F.encode(F.array_join("pieces", "."), "utf-8")).alias("text"))


@query("""p AS (SELECT doc_id, packet_id, 'P' || packet_id || chr(10) || 'Source evidence: ' || text AS packet FROM packets)
SELECT doc_id, packet_id, split_part(packet, chr(10), 1) AS title, md5(substr(packet, instr(packet, chr(10)) + 18)) AS evidence, len(list_filter(string_split(substr(packet, instr(packet, chr(10)) + 18), '.'), lambda x: trim(x) <> '')) AS n_components FROM p""")
def b31_evidence_components(spark, sf_dir):
    """Packets written as a title and its source evidence, taken apart again."""
    packet = F.concat(F.lit("P"), F.col("packet_id").cast("string"), F.lit(MARK), F.col("text"))
    rows = base.packets(spark, sf_dir).select("doc_id", "packet_id", packet.alias("packet"))
    evidence = F.substring("packet", F.instr("packet", MARK) + len(MARK), F.length("packet"))
    rows = rows.select("doc_id", "packet_id", F.substring_index("packet", MARK, 1).alias("title"), evidence.alias("e"))
    return rows.select("doc_id", "packet_id", "title", F.md5(F.encode("e", "utf-8")).alias("evidence"), F.size(F.filter(F.split("e", "[.]", -1), lambda x: F.trim(x) != "")).cast("long").alias("n_components"))


TABLES["packet_rows"] = f"SELECT doc_id, packet_id AS idx, text AS sentence, {N} AS n FROM packets"
TABLES["bm25_packets"] = _bm25_sql(1.2, False).replace("FROM sentences", "FROM packet_rows")


@query("""t AS (SELECT doc_id, idx AS packet_id FROM bm25_packets QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, idx) <= 3),
r AS (SELECT b.doc_id, b.idx, s.packet_id, row_number() OVER (PARTITION BY b.doc_id ORDER BY round(score, 9) DESC, b.idx) AS rank, row_number() OVER (PARTITION BY b.doc_id, s.packet_id ORDER BY round(score, 9) DESC, b.idx) AS inside FROM bm25_scores b JOIN packet_sentences s USING (doc_id, idx)),
m AS (SELECT r.doc_id, r.idx, r.rank, t.packet_id IS NOT NULL AND inside <= 2 AS chosen FROM r LEFT JOIN t USING (doc_id, packet_id))
SELECT doc_id, idx, chosen FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY chosen DESC, rank) <= 6""")
def c04_hierarchical(spark, sf_dir):
    """Two sentences of each of the three best packets, filled up to six by the rank among all."""
    rows = base._once(_chosen(spark, sf_dir), at=F.transform("s", lambda x, i: F.floor(i * N / F.size("s")).cast("int")))
    rows = base._once(rows, packets=F.transform(F.sequence(F.lit(0), F.lit(N - 1)), lambda p: F.flatten(F.filter("terms", lambda t, i: F.get("at", i) == p))))
    rows = rt.with_bm25(rows, "packets", F.col("asked"), "packet_scores")
    best = F.slice(rt.ranked(F.col("packet_scores")), 1, 3)
    rows = base._once(rows, two=F.flatten(F.transform(best, lambda p: F.slice(F.filter("order", lambda i: F.get("at", i) == p), 1, 2))))
    picks = rt.filled(F.col("two"), F.col("order"), 6)
    return rows.select("doc_id", F.explode(F.transform(picks, lambda i: F.struct(i.alias("idx"), F.array_contains("two", i).alias("chosen")))).alias("x")).select("doc_id", "x.idx", "x.chosen")


TABLES["policy_picks"] = """SELECT 0 AS place, 'bm25' AS policy, doc_id, idx FROM top_sentences UNION ALL SELECT 1, 'distinct', doc_id, idx FROM bm25_distinct QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, idx) <= 6
    UNION ALL SELECT 2, 'lead', doc_id, idx FROM sentences WHERE idx < 6"""


@query("""c AS (SELECT p.place, p.policy, p.doc_id, count(DISTINCT q.term) AS covered FROM policy_picks p JOIN sentence_terms s USING (doc_id, idx) LEFT JOIN question_terms q ON q.item_id = s.item_id AND list_contains(s.t, q.term) GROUP BY ALL),
m AS (SELECT place, policy, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 1) < '8' AS dev, avg(covered / n) AS coverage, count(*) AS n FROM c JOIN asked USING (doc_id) JOIN (SELECT item_id, count(*)::DOUBLE AS n FROM question_terms GROUP BY item_id) USING (item_id) GROUP BY ALL),
w AS (SELECT place FROM m WHERE dev ORDER BY round(coverage, 9) DESC, place LIMIT 1)
SELECT policy, dev, coverage, n, coverage >= 0.2 AS passed FROM m JOIN w USING (place)""")
def c08_policy_on_dev(spark, sf_dir):
    """The policy of most coverage on the development half, ties to the one named first; then its coverage on the other half, against a gate."""
    rows = rt.with_bm25(_chosen(spark, sf_dir), "terms", F.col("asked"), "distinct_scores", k1=1.5, distinct_terms=True)
    rows = base._once(rows, wanted=F.array_distinct("asked")).where(F.size("wanted") > 0)
    policies = {"bm25": F.col("picks"), "distinct": F.slice(rt.ranked(F.col("distinct_scores")), 1, 6), "lead": F.slice(F.sequence(F.lit(0), F.size("s") - 1), 1, 6)}
    covered = lambda picks: F.size(F.array_intersect("wanted", F.flatten(F.transform(picks, lambda i: F.get("terms", i))))) / F.size("wanted")
    own = [F.struct(F.lit(at).alias("at"), F.lit(name).alias("policy"), covered(picks).alias("covered")) for at, (name, picks) in enumerate(policies.items())]
    dev = F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 1) < "8"
    rows = rows.select(dev.alias("dev"), F.inline(F.array(*own)))
    m = rows.groupBy("at", "policy", "dev").agg(F.avg("covered").alias("coverage"), F.count(F.lit(1)).alias("n"))
    # Six rows at most: the best one of the development half comes first.
    by = Window.orderBy(F.desc("dev"), F.desc(F.round("coverage", 9)), "at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    m = m.withColumn("best", F.first(F.when(F.col("dev"), F.col("at")), ignorenulls=True).over(by)).where("at = best")
    return m.select("policy", "dev", "coverage", "n", (F.col("coverage") >= 0.2).alias("passed"))


_TAIL = lambda k, p: f"coalesce(list_sum(list_transform(range({k}, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p})))), 0)"


@query(f"""RECURSIVE g AS (SELECT lang, source, count(*) AS n, sum(quality)::BIGINT AS k FROM labelled GROUP BY ALL),
b AS (SELECT lang, source, n, k, 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high FROM g UNION ALL
    SELECT lang, source, n, k, step + 1, CASE WHEN {_TAIL("k", "((low + high) / 2)")} <= {ALPHA} THEN (low + high) / 2 ELSE low END, CASE WHEN {_TAIL("k", "((low + high) / 2)")} <= {ALPHA} THEN high ELSE (low + high) / 2 END FROM b WHERE step < 45)
SELECT lang, source, n, k, CASE WHEN k = 0 THEN 0.0 ELSE low END AS lower, (SELECT min(x) FROM range(1, n + 1) r(x) WHERE {_TAIL("x", str(BOUND) + "::DOUBLE")} <= {ALPHA}) AS n_needed FROM b WHERE step = 45""")
def k01_exact_bounds(spark, sf_dir):
    rows = _labelled(spark, sf_dir).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("k"))
    return bd.exact_bounds(rows, "k", "n", ALPHA, BOUND)


@query(rf"""w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS t FROM documents),
g AS (SELECT doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS g FROM w),
h AS (SELECT doc_id, CAST('0x' || substr(md5(g), 1, 7) AS BIGINT) AS h FROM g), s AS (SELECT doc_id, CAST((h // 2) % {SLOTS} AS INT) AS slot, sum(1 - 2 * (h % 2))::DOUBLE AS s FROM h GROUP BY ALL HAVING sum(1 - 2 * (h % 2)) <> 0)
SELECT doc_id, slot, s / sqrt(sum(s * s) OVER (PARTITION BY doc_id)) AS value FROM s""")
def k13_hashed_features(spark, sf_dir):
    return bd.hashed_features(base.table(spark, sf_dir, "documents").select("doc_id", base.terms(F.col("text")).alias("terms")), "doc_id", SLOTS)


@query()
def k15_held_out_probe(spark, sf_dir):
    """Quality told from length and words, each fold by a fit on the others; the tests hold it against a fit by hand."""
    words = base.table(spark, sf_dir, "documents").select("doc_id", base.terms(F.col("text")).alias("t"))
    words = words.select("doc_id", F.log1p(F.size("t")).alias("n_words"), (F.size(F.array_distinct("t")) / F.greatest(F.size("t"), F.lit(1))).alias("variety"))
    # Each fold fits and applies a model to the rows: they are written, so that the texts are read once.
    rows = files.round_trip(_folded(spark, sf_dir).join(words, "doc_id").withColumn("length", F.log1p("n_chars")), "probe")
    return bd.held_out_probe(rows, "doc_id", ["length", "n_words", "variety"], "quality", "fold", 5)


def _over(items: str, queries: str) -> str:
    """BM25 of the items (doc_id, idx, t) of a table for the terms (doc_id, q) of another."""
    return f"""SELECT i.doc_id, i.idx, coalesce(x.score, 0.0) AS score FROM {items} i LEFT JOIN (
        SELECT doc_id, idx, sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM (
            SELECT doc_id, idx, term, n, len, mean, tf, count(*) OVER (PARTITION BY doc_id, term)::DOUBLE AS df FROM (
                SELECT doc_id, idx, n, len, mean, term, count(*)::DOUBLE AS tf FROM (
                    SELECT doc_id, idx, n, len, mean, unnest(t) AS term FROM (SELECT doc_id, idx, t, len(t)::DOUBLE AS len, avg(len(t)) OVER (PARTITION BY doc_id) AS mean, count(*) OVER (PARTITION BY doc_id)::DOUBLE AS n FROM {items}))
                GROUP BY ALL))
        JOIN (SELECT doc_id, term, count(*)::DOUBLE AS qf FROM (SELECT doc_id, unnest(q) AS term FROM {queries}) GROUP BY ALL) USING (doc_id, term) GROUP BY doc_id, idx) x USING (doc_id, idx)"""


_TERMS = lambda c: rf"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+')"
_PLAIN = lambda c: "array_to_string(" + _TERMS(rf"regexp_replace(lower({c}), '\s*\([^)]*\)\s*$', '')") + ", ' ')"
TABLES["titled"] = f"""SELECT doc_id, idx, packet_id, sentence, array_to_string(first_value({_TERMS('sentence')}) OVER (PARTITION BY doc_id, packet_id ORDER BY idx)[1:2], ' ') AS title FROM packet_sentences"""
TABLES["title_groups"] = """SELECT doc_id, title, row_number() OVER (PARTITION BY doc_id ORDER BY min(idx)) - 1 AS idx, 'Title: ' || title || chr(10) || string_agg(sentence, ' ' ORDER BY idx) AS paragraph FROM titled GROUP BY doc_id, title"""
TABLES["title_items"] = f"SELECT doc_id, idx, {_TERMS('paragraph')} AS t FROM title_groups"
TABLES["title_asked"] = f"SELECT doc_id, {_TERMS('question')} AS q FROM asked JOIN questions USING (item_id)"
TABLES["title_scores"] = _over("title_items", "title_asked")
TABLES["title_shares"] = f"""SELECT doc_id, idx, title, {_PLAIN('title')} AS plain, {_PLAIN('paragraph')} AS body, CASE WHEN max(score) OVER (PARTITION BY doc_id) > 0 THEN score / max(score) OVER (PARTITION BY doc_id) ELSE 0 END AS share FROM title_groups JOIN title_scores USING (doc_id, idx)"""
TABLES["title_pairs"] = """SELECT a.doc_id, a.idx AS l, b.idx AS r, a.title AS lt, b.title AS rt, round(a.share + b.share + CASE WHEN length(a.plain) >= 3 AND contains(b.body, a.plain) OR length(b.plain) >= 3 AND contains(a.body, b.plain) THEN 1.5 ELSE 0 END, 9) AS points
    FROM title_shares a JOIN title_shares b ON a.doc_id = b.doc_id AND a.idx < b.idx QUALIFY row_number() OVER (PARTITION BY a.doc_id ORDER BY points DESC, l, r) = 1"""
TABLES["shown_items"] = f"SELECT doc_id, idx, {_TERMS(chr(39) + 'Title: ' + chr(39) + ' || title || chr(10) || sentence')} AS t FROM titled"
TABLES["shown_asked"] = f"SELECT doc_id, {_TERMS('concat_ws(' + chr(39) + ' ' + chr(39) + ', question, lt, rt)')} AS q FROM asked JOIN questions USING (item_id) LEFT JOIN title_pairs USING (doc_id)"
TABLES["shown_scores"] = _over("shown_items", "shown_asked")


@query("""r AS (SELECT doc_id, idx, l, r, CASE WHEN title = lt THEN 0 WHEN title = rt THEN 1 END AS side, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, idx) AS rank,
    row_number() OVER (PARTITION BY doc_id, title ORDER BY round(score, 9) DESC, idx) AS inside FROM shown_scores JOIN titled USING (doc_id, idx) LEFT JOIN title_pairs USING (doc_id)),
p AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(side IS NOT NULL AND inside <= 3, false) DESC, rank) <= 6)
SELECT doc_id, any_value(l) AS l, any_value(r) AS r, string_agg(idx, ',' ORDER BY idx) AS picks FROM p GROUP BY doc_id""")
def c05_linked_title_pair(spark, sf_dir):
    """Paragraphs are packets, titled by their first two words."""
    rows = base._once(_retrievable(spark, sf_dir), at=F.transform("s", lambda x, i: F.floor(i * N / F.size("s")).cast("int")))
    first = lambda p: F.get(F.filter("terms", lambda t, i: F.get("at", i) == p), F.lit(0))
    rows = base._once(rows, titles=F.transform(F.sequence(F.lit(0), F.lit(N - 1)), lambda p: F.array_join(F.slice(first(p), 1, 2), " ")))
    rows = base._once(rows, candidates=F.transform("s", lambda s, i: F.struct(F.get("titles", F.get("at", i)).alias("title"), s.alias("sentence"))))
    rows = rt.linked_title_pair(rows.select("doc_id", "question", "candidates"), "candidates", F.col("question"), base.terms)
    return rows.select("doc_id", F.col("pair.left").alias("l"), F.col("pair.right").alias("r"), F.array_join(F.transform("picks", lambda i: i.cast("string")), ",").alias("picks"))
