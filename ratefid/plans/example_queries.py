"""Stress examples, relation rules, provenance and exchanges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratefid.functions.text import normalized_answer
from ratefid.operators import evidence as evd
from ratefid.operators import examples as ex

from . import base
from .evidence_queries import ANSWERS, MOST_TOKENS, claims
from .registry import query
from .sql import TABLES
from .text_queries import _retrievable

N = base.N_PACKETS

TABLES["fact_units"] = "SELECT doc_id, idx, packet_id AS title, overlap, overlap >= 3 AS supporting, sentence FROM sentence_overlaps"
TABLES["fact_sizes"] = "SELECT d.doc_id, coalesce(n, 0) AS n, coalesce(others, 0) AS others FROM documents d LEFT JOIN (SELECT doc_id, count(*) FILTER (supporting) AS n, count(*) FILTER (NOT told) AS others FROM (SELECT *, bool_or(supporting) OVER (PARTITION BY doc_id, title) AS told FROM fact_units) GROUP BY doc_id) USING (doc_id)"
TABLES["fact_fates"] = "SELECT doc_id, n, CASE WHEN n < 3 THEN 'too few facts' WHEN n > 5 THEN 'too many facts' WHEN others < 6 - n THEN 'too few distractors' ELSE 'built' END AS fate FROM fact_sizes"


@query("""u AS (SELECT *, bool_or(supporting) OVER (PARTITION BY doc_id, title) AS told FROM fact_units),
r AS (SELECT doc_id, idx, title, supporting, sentence, CASE WHEN supporting THEN 0 ELSE row_number() OVER (PARTITION BY doc_id, supporting OR told ORDER BY overlap DESC, idx) END AS rank, told FROM u),
c AS (SELECT doc_id, string_agg(idx || CASE WHEN supporting THEN '*' ELSE '' END, ',' ORDER BY title, idx) AS units, md5(string_agg(sentence, chr(10) || chr(10) ORDER BY title, idx)) AS context FROM r JOIN fact_fates USING (doc_id) WHERE fate = 'built' AND (supporting OR NOT told AND rank <= 6 - n) GROUP BY doc_id)
SELECT doc_id, fate, units, context FROM fact_fates LEFT JOIN c USING (doc_id)""")
def b18_fact_atomic_examples(spark, sf_dir):
    """A fact is a sentence with three of its question's terms, a title a packet; every document has its fate."""
    rows = base._once(_retrievable(spark, sf_dir), q=F.array_distinct(F.coalesce("asked", F.array().cast("array<string>"))))
    unit = lambda s, i: F.struct(F.floor(i * N / F.size("s")).cast("int").alias("title"), i.alias("sentence"), s.alias("text"), (F.size(F.array_intersect("q", F.array_distinct(base.terms(s)))) >= 3).alias("supporting"))
    rows = base._once(rows, units=F.transform("s", unit))
    rows = ex.fact_atomic(rows, "q", "units", base.terms)
    shown = F.array_join(F.transform("chosen", lambda u: F.concat(u["sentence"].cast("string"), F.when(u["supporting"], "*").otherwise(""))), ",")
    made = rows.select("doc_id", "fate", shown.alias("units"), F.md5(F.encode(F.array_join(F.transform("chosen", lambda u: u["text"]), "\n\n"), "utf-8")).alias("context"))
    every = base.table(spark, sf_dir, "documents").select("doc_id")
    return every.join(made, "doc_id", "left").withColumn("fate", F.coalesce("fate", F.lit(ex.FATES[0])))


def judged_answers(spark, sf_dir):
    """doc_id, question, candidate: questions by template over a document's words, candidates that have the names and cues in most rows."""
    words = F.filter(base.terms(F.coalesce("text", F.lit(""))), lambda w: w.rlike("^[a-z]+$"))
    rows = base._once(base.table(spark, sf_dir, "documents").select("doc_id", "text"), w=F.slice(words, 1, 40)).where(F.size("w") >= 12)
    a, b = F.concat_ws(" ", F.get("w", F.lit(2)), F.get("w", F.lit(5))), F.get("w", F.lit(7))
    made = F.array(
        F.concat(F.lit("Which film has "), a, F.lit(" as a member of its cast and was directed by "), b, F.lit("?")), F.concat(F.lit("which film has "), a, F.lit(" as a member of its cast")),
        F.concat(F.lit("Who played for the "), b, F.lit(" F.C.?")), F.concat(F.lit("Who was born in "), a, F.lit("?")), F.concat(F.lit("Who is or was buried in "), b), F.concat(F.lit("How old is "), a, F.lit("?")),
        F.concat(F.lit("Which album has "), a, F.lit(" as performer?")),
    )
    cue = F.array(F.lit("starring"), F.lit("played"), F.lit("was born in"), F.lit("buried at"), F.lit("an album made by"))
    names = F.when(F.col("doc_id") % 6 == 5, F.get("w", F.lit(9))).otherwise(F.concat_ws(", ", a, b))
    candidate = F.concat(F.get("w", F.lit(0)), F.when(F.col("doc_id") % 4 == 3, " ").otherwise("; "), names, F.lit(" "), F.get(cue, (F.floor(F.col("doc_id") / 7) % 5).cast("int")), F.lit("."))
    return rows.select("doc_id", F.get(made, (F.col("doc_id") % 7).cast("int")).alias("question"), candidate.alias("candidate"))


_ASK = ["'Which film has ' || a || ' as a member of its cast and was directed by ' || b || '?'", "'which film has ' || a || ' as a member of its cast'", "'Who played for the ' || b || ' F.C.?'", "'Who was born in ' || a || '?'", "'Who is or was buried in ' || b", "'How old is ' || a || '?'", "'Which album has ' || a || ' as performer?'"]
TABLES["judged_answers"] = rf"""SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]+'))[1:40] AS w, w[3] || ' ' || w[6] AS a, w[8] AS b, [{', '.join(_ASK)}][doc_id % 7 + 1] AS question,
    w[1] || CASE WHEN doc_id % 4 = 3 THEN ' ' ELSE '; ' END || CASE WHEN doc_id % 6 = 5 THEN w[10] ELSE a || ', ' || b END || ' ' || ['starring', 'played', 'was born in', 'buried at', 'an album made by'][doc_id // 7 % 5 + 1] || '.' AS candidate FROM documents WHERE len(w) >= 12"""
_ORACLE_RULES = ", ".join("({}, '{}', '{}', '{}')".format(i, *(x.replace("'", "''") for x in r)) for i, r in enumerate(ex.RULES))
_BARE = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))".format
_HAS = lambda c: f"len(list_filter(string_split(trim(regexp_replace(' ' || {_BARE(c)} || ' ', '( fc| f| c)+ $', '')), ' '), lambda x: x = '' OR NOT list_contains(string_split({_BARE('candidate')}, ' '), x))) = 0"


@query(rf"""rules AS (SELECT * FROM (VALUES {_ORACLE_RULES}) t(rule, template, cue, label)),
m AS (SELECT doc_id, rule, label, candidate, cue, regexp_extract(question, '(?i)^(?:' || template || ')\??$', 1) AS x, CASE WHEN rule = 0 THEN regexp_extract(question, '(?i)^(?:' || template || ')\??$', 2) ELSE '' END AS y FROM judged_answers, rules WHERE regexp_full_match(question, '(?i)(?:' || template || ')\??')),
f AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n_rules FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rule) = 1)
SELECT j.doc_id, f.rule, coalesce(f.label, 'UNKNOWN') AS label, coalesce(n_rules, 0) AS n_rules, coalesce({_HAS('x')} AND (y = '' OR {_HAS('y')}) AND regexp_matches(' ' || {_BARE("CASE WHEN contains(j.candidate, ';') THEN substr(j.candidate, instr(j.candidate, ';') + 1) ELSE j.candidate END")} || ' ', ' (?:' || cue || ') '), false) AS accepted
FROM judged_answers j LEFT JOIN f USING (doc_id)""".replace("lower(candidate)", "lower(j.candidate)"))
def h16_relation_checks(spark, sf_dir):
    return ex.relation_checks(judged_answers(spark, sf_dir), ex.rule_table(spark)).select("doc_id", "rule", "label", "n_rules", "accepted")


@query("""j AS (SELECT a.doc_id, k IN (SELECT unnest(keys) FROM unit_texts u WHERE u.doc_id = a.doc_id) AS title_hit, reason = '' AND trim(s.sentence) = proof AS proof_hit,
    len(list_filter(rel, lambda t: list_contains(regexp_extract_all(lower(s.sentence), '[\\p{L}\\p{N}_]+'), t))) > 0 AS term_hit, o.pos < 3 AS early
    FROM atoms a JOIN packet_sentences s ON s.doc_id = a.doc_id AND s.idx = a.no JOIN claim_questions c ON c.doc_id = a.doc_id JOIN orders o ON o.doc_id = a.doc_id AND o.packet_id = s.packet_id AND o.arm = 'learned')
SELECT early, title_hit, proof_hit, term_hit, count(*) AS n FROM j GROUP BY ALL""")
def h17_fragment_provenance(spark, sf_dir):
    """Whether a sentence's claim is among its record's answers, is its certified proof word for word, and says a term of the relation; by when its order comes to it."""
    rows = evd.once(claims(spark, sf_dir, "s", "w", "asks"), rel=evd.relation_terms(F.col("question"), F.col("entities")), overlaps=base._overlaps("w", "asks"))
    rows = evd.once(rows, first=F.slice(base._learned_order(), 1, 3))
    packet = lambda i: F.floor(i * N / F.size("w")).cast("int")
    told = lambda w, i: F.struct(F.array_contains("first", packet(i)).alias("early"), F.arrays_overlap("rel", w).alias("term_hit"))
    rows = evd.once(rows, told=F.transform("w", told)).drop("w", "asks", "overlaps", "first", "rel")
    rows = evd.candidate_records(evd.once(evd.certified(rows), kept=F.col("atoms")), F.lit(False), ANSWERS, MOST_TOKENS)
    rows = rows.select("keys", F.inline(F.arrays_zip("kept", "s", "told")))
    facts = {
        "title_hit": F.array_contains("keys", normalized_answer(F.col("kept.answer"))),
        "proof_hit": (F.col("kept.reason") == "") & F.coalesce(F.trim("s") == F.col("kept.proof"), F.lit(False)),
        "term_hit": F.col("told.term_hit"),
    }
    rows = rows.select(F.col("told.early").alias("early"), *[c.alias(k) for k, c in facts.items()])
    return rows.groupBy("early", *facts).agg(F.count(F.lit(1)).alias("n"))


TABLES["exchange_pieces"] = """SELECT s.doc_id, CASE pos WHEN 2 THEN 'delay' ELSE 'promote' END AS kind, s.idx, s.tokens, trim(s.sentence) AS text FROM packet_sentences s JOIN orders o USING (doc_id, packet_id) WHERE o.arm = 'learned' AND (pos = 5 OR pos = 2 AND NOT EXISTS (
    SELECT 1 FROM packets p JOIN orders e USING (doc_id, packet_id) WHERE p.doc_id = s.doc_id AND e.arm = 'learned' AND e.pos < 2 AND contains(p.text, trim(s.sentence))))"""


@query("""d AS (SELECT * FROM exchange_pieces x WHERE kind = 'delay' AND NOT EXISTS (SELECT 1 FROM exchange_pieces y WHERE y.doc_id = x.doc_id AND y.kind = 'promote' AND y.text = x.text))
SELECT d.doc_id, d.idx AS delayed, arg_max(p.idx, p.tokens * 1000000 - p.idx) AS promoted, count(*) AS n_promotable, max(p.tokens) - any_value(d.tokens) AS delta, 3 * (max(p.tokens) - any_value(d.tokens)) AS cumulative
FROM d JOIN exchange_pieces p ON p.doc_id = d.doc_id AND p.kind = 'promote' AND p.tokens <= d.tokens GROUP BY d.doc_id, d.idx""")
def g34_neutral_exchanges(spark, sf_dir):
    """A sentence of the third packet of the order is delayed to the last depth for one of the last packet: three depths change."""
    rows = base._once(_retrievable(spark, sf_dir), q=F.coalesce("asked", F.array().cast("array<string>")))
    rows = base._once(rows, overlaps=base._overlaps("terms", "q")).select("doc_id", "s", "tokens", "overlaps")
    rows = base._once(rows, order=base._learned_order(), units=F.transform("s", lambda s, i: F.struct(i.alias("idx"), F.get("tokens", i).alias("tokens"), F.trim(s).alias("text"))))
    at = lambda c, pos: base._part(c, F.get("order", F.lit(pos)))
    # No sentence holds a line end, so none is found across two of them.
    rows = base._once(rows, before=F.array_join(F.concat(at("s", 0), at("s", 1)), "\n"), third=at("units", 2), promote=at("units", 5)).select("doc_id", "before", "third", "promote")
    rows = rows.select("doc_id", "promote", F.filter("third", lambda x: ~F.contains("before", x["text"])).alias("delay"))
    return ex.exchanges_in_row(rows, "doc_id").withColumn("cumulative", 3 * F.col("delta"))
