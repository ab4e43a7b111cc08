"""Answers in words: sentences, outputs of models taken apart, lists with aliases, states answered and scored."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratefid.functions import text as tx
from ratefid.operators import retrieval as rt
from ratefid.operators import scoring as sc

from . import base
from .registry import query
from .sql import TABLES
from .text_queries import _answer_sets, _norm_sql, _retrievable, _tokens_sql

N = base.N_PACKETS
_WS = r"[ \t\n\x0b\f\r]"
CJK = " 他说“好。” 她笑了！真的？是 \"Yes.\" (No!) ok.) Then"


@query(rf"""t AS (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 4 = 0 THEN '{CJK}' ELSE '' END AS t FROM documents),
p AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(t, '([.!?。！？])["''”’)]*{_WS}+', '\1' || chr(1), 'g'), '([。！？])', '\1' || chr(1), 'g'), chr(1)),
    lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x <> '') AS s FROM t)
SELECT doc_id, generate_subscripts(s, 1) - 1 AS idx, md5(unnest(s)) AS sentence FROM p""")
def b04_sentences(spark, sf_dir):
    """Whole texts in sentences; a fourth of them have sentences with CJK ends and closing quotes put after them."""
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 4 == 0, CJK).otherwise(""))
    rows = base.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.split_sentences(text)).alias("idx", "sentence"))
    return rows.select("doc_id", "idx", F.md5(F.encode("sentence", "utf-8")).alias("sentence"))


#: How a model may wrap an answer; %s is where it stands.
WRAPS = ("%s", "<think>no, %s</think>\n%s", "a <Answer>\n %s </answer> b <answer>c</answer>", "Final Answer: %s", "answer : %s\nmore", "  Yes, %s", "no: %s", "<think>a</think><think>b</think> <ANSWER>%s</ANSWER>")
_WRAPPED = "CASE (conv_id * 3 + turn) % 8 " + " ".join(f"WHEN {i} THEN " + " || text || ".join("'" + part.replace("\n", "' || chr(10) || '") + "'" for part in w.split("%s")) for i, w in enumerate(WRAPS)) + " END"


@query(rf"""w AS (SELECT conv_id, turn, {_WRAPPED} AS raw FROM conversations),
s AS (SELECT *, regexp_replace(regexp_replace(raw, '(?s)^.*</think>', ''), '^{_WS}+|{_WS}+$', '', 'g') AS said FROM w),
l AS (SELECT *, regexp_replace(regexp_extract(regexp_replace(said, '(?i)^(?:final answer|answer){_WS}*:{_WS}*', ''), '^([^\n\r\x0b\f]*)', 1), '^{_WS}+|{_WS}+$', '', 'g') AS line FROM s)
SELECT conv_id, turn, CASE WHEN regexp_matches(said, '(?is)<answer>.*?</answer>') THEN regexp_replace(regexp_extract(said, '(?is)<answer>(.*?)</answer>', 1), '^{_WS}+|{_WS}+$', '', 'g')
    WHEN regexp_matches(line, '(?i)^(yes|no){_WS}*[,;:!.?]') THEN lower(regexp_extract(line, '(?i)^(yes|no)', 1)) ELSE line END AS answer FROM l""")
def b26_parsed_answer(spark, sf_dir):
    """Texts wrapped in eight ways, by thought, tag, prefix, line and yes or no, and unwrapped."""
    raw = None
    for i, wrap in enumerate(WRAPS):
        parts = wrap.split("%s")
        made = F.concat(*[x for j, p in enumerate(parts) for x in ((F.lit(p),) if j == 0 else (F.col("text"), F.lit(p)))])
        test = (F.col("conv_id") * 3 + F.col("turn")) % 8 == i
        raw = F.when(test, made) if raw is None else raw.when(test, made)
    return base.table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.parsed_answer(raw).alias("answer"))


_LIST = "array_to_string({}, ',')".format
TABLES["selection_texts"] = f"""SELECT doc_id, arm, CASE kind WHEN 0 THEN '{{"indices":[' || {_LIST('l')} || ']}}' WHEN 1 THEN 'Here: {{"indices": [' || {_LIST('l')} || ']}} done' WHEN 2 THEN '```json' || chr(10) || '{{"indices":[' || {_LIST('l')} || ']}}' || chr(10) || '```'
    WHEN 3 THEN '{{"indices":[' || {_LIST('list_concat(l[1:5], l[1:1])')} || ']}}' WHEN 4 THEN '{{"indices":[' || {_LIST('l[1:5]')} || ',9]}}' WHEN 5 THEN '{{"indices":[' || {_LIST('l[1:5]')} || ']}}' WHEN 6 THEN '{{"indices":[' || {_LIST('l[1:5]')} || ',true]}}'
    WHEN 7 THEN '{{"indices":[' || {_LIST('l')} || '],"why":"x"}}' WHEN 8 THEN '{{"indices":[' || {_LIST('l')} WHEN 9 THEN '{{"indices":[' || {_LIST('l[1:5]')} || ',1.5]}}' ELSE 'none' END AS text
    FROM (SELECT doc_id, arm, list(packet_id ORDER BY pos) AS l, (doc_id * 2 + CASE arm WHEN 'learned' THEN 1 ELSE 0 END) % 11 AS kind FROM orders GROUP BY ALL)"""


@query("""j AS (SELECT doc_id, arm, CASE WHEN json_valid(text) THEN text ELSE regexp_extract(text, '(?s)(\\{[^{}]*\\})', 1) END AS t FROM selection_texts),
v AS (SELECT *, CASE WHEN json_valid(t) THEN t END AS o FROM j),
n AS (SELECT *, json_keys(o) AS keys, list_transform(json_extract(o, '$.indices[*]'), lambda x: json_type(x)) AS types, TRY_CAST(json_extract(o, '$.indices') AS BIGINT[]) AS l FROM v)
SELECT doc_id, arm, CASE WHEN o IS NULL THEN 'not json' WHEN keys <> ['indices'] THEN 'keys' WHEN len(types) <> 6 OR len(list_filter(types, lambda x: x NOT IN ('UBIGINT', 'BIGINT'))) > 0 THEN 'count'
    WHEN len(list_distinct(l)) <> 6 THEN 'repeated' WHEN list_max(l) > 5 OR list_min(l) < 0 THEN 'range' ELSE 'ok' END AS verdict FROM n""")
def b27_strict_json(spark, sf_dir):
    """Selections written in eleven ways, most of them faulty, and parsed back."""
    rows = base._ordered(spark, sf_dir).select("doc_id", "arm", "order")
    listed = lambda c: F.array_join(F.transform(c, lambda p: p.cast("string")), ",")
    short, kind = F.slice("order", 1, N - 1), (F.col("doc_id") * 2 + (F.col("arm") == "learned").cast("int")) % 11
    whole = F.concat(F.lit('{"indices":['), listed(F.col("order")), F.lit("]}"))
    of = lambda c, more="": F.concat(F.lit('{"indices":['), listed(c), F.lit(f"{more}]}}"))
    texts = [
        whole, F.concat(F.lit('Here: {"indices": ['), listed(F.col("order")), F.lit("]} done")), F.concat(F.lit("```json\n"), whole, F.lit("\n```")), of(F.concat(short, F.slice("order", 1, 1))), of(short, ",9"), of(short), of(short, ",true"),
        F.concat(F.lit('{"indices":['), listed(F.col("order")), F.lit('],"why":"x"}')), F.concat(F.lit('{"indices":['), listed(F.col("order"))), of(short, ",1.5"), F.lit("none"),
    ]
    return rows.select("doc_id", "arm", tx.selection_verdict(F.get(F.array(*texts), kind.cast("int")), N, N).alias("verdict"))


_GISTS = ("{\"gist\": \"a%s\", \"residual\": \"b\"}", "Sure: {\"gist\":\"a%s\",\"residual\":\"{x}\"} ok", "```json\n{\"residual\":\"b\",\"gist\":\"%s\"}\n```", "{\"gist\":\"%s\"}", "{\"gist\":1,\"residual\":\"%s\"}", "{\"gist\":\"%s\",\"residual\":\"b\",\"c\":\"d\"}", "{\"gist\":\"%s\"", "%s")
_GIST_SQL = "CASE (doc_id + packet_id) % 8 " + " ".join(f"WHEN {i} THEN " + " || packet_id || ".join("'" + part.replace("\n", "' || chr(10) || '") + "'" for part in g.split("%s")) for i, g in enumerate(_GISTS)) + " END"


@query(rf"""t AS (SELECT doc_id, packet_id, {_GIST_SQL} AS text FROM packets),
j AS (SELECT *, CASE WHEN regexp_matches(text, '(?s)```(json)?\s*\{{.*?\}}\s*```') THEN regexp_extract(text, '(?s)```(?:json)?\s*(\{{.*?\}})\s*```', 1) WHEN regexp_matches(text, '(?s)\{{.*\}}') THEN regexp_extract(text, '(?s)(\{{.*\}})', 1) ELSE text END AS o FROM t)
SELECT doc_id, packet_id, CASE WHEN NOT json_valid(o) THEN 'not json' WHEN json_type(o) <> 'OBJECT' OR list_sort(json_keys(o)) <> ['gist', 'residual'] THEN 'keys' WHEN json_type(o, '$.gist') <> 'VARCHAR' OR json_type(o, '$.residual') <> 'VARCHAR' THEN 'strings' ELSE 'ok' END AS verdict FROM j""")
def b27_packet_json(spark, sf_dir):
    """Packets as two strings, in fences, prose, with other keys, other types, or cut short."""
    number = F.col("packet_id").cast("string")
    texts = [F.concat(*[x for j, p in enumerate(g.split("%s")) for x in ((F.lit(p),) if j == 0 else (number, F.lit(p)))]) for g in _GISTS]
    text = F.get(F.array(*texts), ((F.col("doc_id") + F.col("packet_id")) % 8).cast("int"))
    return base.packets(spark, sf_dir).select("doc_id", "packet_id", tx.packet_verdict(text).alias("verdict"))


@query("""bm25 AS (SELECT 'bm25' AS policy, doc_id, false AS changed FROM sentences GROUP BY doc_id),
flags AS (SELECT s.doc_id, s.idx, n, coalesce(overlap >= 2, false) AS flag FROM sentences s LEFT JOIN sentence_overlaps USING (doc_id, idx)),
leaky AS (SELECT 'supported first' AS policy, doc_id, list_sort(list(idx) FILTER (k <= 6)) <> list_sort(list(idx) FILTER (idx < 6)) AS changed FROM (SELECT doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY flag DESC, idx) AS k FROM flags) GROUP BY doc_id)
SELECT policy, count(*) AS n, count(*) FILTER (changed) AS n_changed FROM (SELECT * FROM bm25 UNION ALL SELECT * FROM leaky) GROUP BY policy""")
def c09_label_invariance(spark, sf_dir):
    """Each policy chooses from rows with their labels and again from rows whose labels are erased: a policy that looks at none changes no choice.

    The rows that a policy gets have the question, the sentences, and the labels (what supports). One policy reads the labels, to show that the audit finds that.
    """
    rows = base._once(_retrievable(spark, sf_dir), q=F.array_distinct(F.coalesce("asked", F.array().cast("array<string>"))))
    rows = base._once(rows, flags=F.transform("terms", lambda t: F.size(F.array_intersect("q", F.array_distinct(t))) >= 2))

    def by_bm25(df):
        return rt.with_bm25(df, "terms", F.col("asked")).select("doc_id", F.array_sort(F.slice(rt.ranked(F.col("scores")), 1, 6)).alias("picks"))

    def by_flags(df):
        order = F.array_sort(F.transform("flags", lambda f, i: F.struct(F.when(f, 0).otherwise(1).alias("o"), i.alias("i"))))
        return df.select("doc_id", F.array_sort(F.transform(F.slice(order, 1, 6), lambda x: x["i"])).alias("picks"))

    out = None
    for name, policy in (("bm25", by_bm25), ("supported first", by_flags)):
        erased = rows.withColumn("flags", F.transform("flags", lambda f: F.lit(False)))
        both = policy(rows).join(policy(erased).withColumnRenamed("picks", "again"), "doc_id")
        own = both.agg(F.lit(name).alias("policy"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("picks") != F.col("again"), 1)).alias("n_changed"))
        out = own if out is None else out.unionByName(own)
    return out


TABLES["gold_atoms"] = """SELECT doc_id, term AS answer, row_number() OVER (PARTITION BY doc_id ORDER BY term) - 1 AS i, [reverse(term), term || 's'] AS aliases FROM asked JOIN question_terms USING (item_id) WHERE length(term) >= 4"""
TABLES["atom_names"] = f"SELECT doc_id, k, min(i) AS i FROM (SELECT doc_id, i, {_norm_sql('unnest(list_concat([answer], aliases))')} AS k FROM gold_atoms) WHERE k <> '' GROUP BY ALL"
TABLES["said_terms"] = f"""SELECT s.doc_id, s.mask, t.term, CASE length(t.term) % 4 WHEN 0 THEN reverse(t.term) WHEN 1 THEN 'The ' || t.term || '.' WHEN 2 THEN t.term || 's' ELSE t.term END AS said FROM (SELECT doc_id, mask FROM states) s JOIN packet_terms t ON t.doc_id = s.doc_id AND t.is_q = 1 AND t.mask & s.mask <> 0"""


def _atoms(spark, sf_dir):
    """doc_id, atoms: the longer terms of a document's question, each with two aliases; null where there are none."""
    asked = base.asked(spark, sf_dir).join(base.questions(spark, sf_dir), "item_id")
    long = F.array_sort(F.filter(F.array_distinct(base.terms(F.col("question"))), lambda t: F.length(t) >= 4))
    return asked.select("doc_id", F.transform(long, lambda t: F.struct(t.alias("answer"), F.array(F.reverse(t), F.concat(t, F.lit("s"))).alias("aliases"))).alias("atoms")).where(F.size("atoms") > 0)


def _spoken(term):
    """How a term is said: reversed, decorated, in the plural, or as it stands."""
    kind = F.length(term) % 4
    return F.when(kind == 0, F.reverse(term)).when(kind == 1, F.concat(F.lit("The "), term, F.lit("."))).when(kind == 2, F.concat(term, F.lit("s"))).otherwise(term)


@query(f"""g AS (SELECT doc_id, count(*) AS gold FROM gold_atoms GROUP BY doc_id),
p AS (SELECT a.doc_id, a.arm, a.depth, {_norm_sql('said')} AS k FROM answer_sets a JOIN said_terms s ON s.doc_id = a.doc_id AND s.term = a.term AND s.mask = 63),
m AS (SELECT x.doc_id, x.arm, x.depth, count(DISTINCT p.k) AS predicted, count(DISTINCT n.i) AS correct FROM prefix_masks x JOIN g USING (doc_id) LEFT JOIN p ON p.doc_id = x.doc_id AND p.arm = x.arm AND p.depth = x.depth AND p.k <> '' LEFT JOIN atom_names n ON n.doc_id = p.doc_id AND n.k = p.k GROUP BY ALL)
SELECT doc_id, arm, depth, correct, predicted, gold, CASE WHEN predicted = 0 THEN 0.0 ELSE correct / predicted END AS precision, correct / gold AS recall, CASE WHEN predicted + gold = 0 THEN 0.0 ELSE 2.0::DOUBLE * correct / (predicted + gold) END AS f1 FROM m JOIN g USING (doc_id)""")
def h06_list_metrics(spark, sf_dir):
    """Answers of each prefix of an order, said in other forms, against atoms with aliases; a name of two atoms is the first one's."""
    rows = _answer_sets(spark, sf_dir).join(sc.with_atom_names(_atoms(spark, sf_dir), "atoms"), "doc_id")
    return sc.with_alias_metrics(rows, F.transform("terms", _spoken), "m").select("doc_id", "arm", "depth", "m.*")


TABLES["packet_answers"] = r"""SELECT p.doc_id, p.packet_id, overlap, array_to_string(regexp_extract_all(lower(p.text), '[\p{L}\p{N}_]+')[1:5], ' ') AS said FROM packets p JOIN packet_overlap USING (doc_id, packet_id)"""
TABLES["single_gold"] = "SELECT doc_id, 'The ' || said || '!' AS gold FROM packet_answers QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, packet_id) = 1"
TABLES["state_answers"] = f"""SELECT s.doc_id, s.mask, s.tokens, coalesce(a.said, '') AS answer, gold, {_tokens_sql("coalesce(a.said, '')")} AS p, {_tokens_sql("gold")} AS g FROM states s JOIN single_gold USING (doc_id)
    LEFT JOIN packet_answers a ON a.doc_id = s.doc_id AND s.mask & (1 << a.packet_id) <> 0 QUALIFY row_number() OVER (PARTITION BY s.doc_id, s.mask ORDER BY overlap DESC, a.packet_id) = 1"""


@query("""held AS (SELECT doc_id, bit_or(CASE WHEN supporting THEN 1 << packet_id ELSE 0 END) AS held FROM support GROUP BY doc_id),
x AS (SELECT s.doc_id, s.mask, tokens, answer, array_to_string(p, ' ') = array_to_string(g, ' ') AS em, coalesce(list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda y: y = w)), len(list_filter(g, lambda y: y = w))))), 0) AS same,
    len(p) + len(g) AS size, (len(p) = 1 AND p[1] IN ('yes', 'no', 'noanswer') OR len(g) = 1 AND g[1] IN ('yes', 'no', 'noanswer')) AND array_to_string(p, ' ') <> array_to_string(g, ' ') AS closed,
    CASE WHEN held = 0 THEN 1.0 ELSE bit_count(s.mask & held)::DOUBLE / bit_count(held) END AS support_recall FROM state_answers s JOIN held USING (doc_id)),
f AS (SELECT *, CASE WHEN closed THEN 0.0 WHEN size = 0 THEN 1.0 WHEN same = 0 THEN 0.0 ELSE 2.0::DOUBLE * same / size END AS f1 FROM x)
SELECT doc_id, mask, tokens, answer, em, f1, support_recall, least(f1, support_recall) AS fidelity FROM f""")
def e04_scored_single_answers(spark, sf_dir):
    """Every state's context is answered in words and scored: exact match, token F1, recall of what supports, and the lesser of both.

    The answerer reads a state's packets and gives the first five words of the one that has most of the question's terms (nothing
    from no context); the answer wanted is what it says of the whole text, written otherwise.
    """
    docs = base._worded(spark, sf_dir)
    docs = base._once(docs, said=F.transform("words", lambda w: F.array_join(F.slice(w, 1, 5), " ")), overlap=F.transform("held", lambda w: F.size(F.array_intersect(w, F.col("asked")))), costs=F.transform("words", lambda w: F.size(w).cast("long")))
    order = F.transform(F.array_sort(F.transform("overlap", lambda o, p: F.struct((-o).alias("o"), p.alias("p")))), lambda x: x["p"])
    docs = base._once(docs, order=order)
    gold = F.concat(F.lit("The "), F.get("said", F.get("order", F.lit(0))), F.lit("!"))
    docs = base._once(docs, gold=gold, supports=F.aggregate(F.transform("overlap", lambda o, p: F.when(o > 0, F.pow(F.lit(2), p).cast("int")).otherwise(0)), F.lit(0), lambda a, x: a + x))
    docs = base._once(docs, f1s=F.transform("said", lambda s: tx.token_f1(tx.answer_tokens(s), tx.answer_tokens(F.col("gold")))), ems=F.transform("said", lambda s: tx.exact_match(s, F.col("gold"))))
    empty = F.struct(tx.exact_match(F.lit(""), F.col("gold")).alias("em"), tx.token_f1(tx.answer_tokens(F.lit("")), tx.answer_tokens(F.col("gold"))).alias("f1"))
    inside = lambda m, p: F.get(F.array(*[F.lit(1 << i) for i in range(N)]), p).bitwiseAND(m) != 0
    masks = F.sequence(F.lit(0), F.lit(base.N_STATES - 1))
    docs = base._once(docs, empty=empty, tokens=F.transform(masks, lambda m: F.aggregate(F.filter("costs", lambda c, p: inside(m, p)), F.lit(0).cast("long"), lambda a, c: a + c)), read=F.transform(masks, lambda m: F.get(F.filter("order", lambda p: inside(m, p)), F.lit(0))))
    rows = docs.select("doc_id", "said", "f1s", "ems", "empty", "supports", F.posexplode(F.arrays_zip("tokens", "read")).alias("mask", "x"))
    share = F.bit_count(F.col("mask").bitwiseAND(F.col("supports"))) / F.nullif(F.bit_count("supports"), F.lit(0))
    at = lambda c, none: F.when(F.col("x.read").isNull(), none).otherwise(F.get(c, F.col("x.read")))
    rows = rows.select("doc_id", "mask", "x.tokens", at("said", F.lit("")).alias("answer"), at("ems", F.col("empty.em")).alias("em"), at("f1s", F.col("empty.f1")).alias("f1"), F.coalesce(share, F.lit(1.0)).alias("support_recall"))
    return rows.withColumn("fidelity", F.least("f1", "support_recall"))


@query(f"""g AS (SELECT doc_id, count(*) AS gold FROM gold_atoms GROUP BY doc_id),
p AS (SELECT doc_id, mask, {_norm_sql('said')} AS k FROM said_terms),
m AS (SELECT s.doc_id, s.mask, s.tokens, gold, count(DISTINCT p.k) AS predicted, count(DISTINCT n.i) AS correct FROM states s JOIN g USING (doc_id) LEFT JOIN p ON p.doc_id = s.doc_id AND p.mask = s.mask AND p.k <> '' LEFT JOIN atom_names n ON n.doc_id = p.doc_id AND n.k = p.k GROUP BY ALL)
SELECT doc_id, mask, tokens, correct, predicted, correct = gold AND predicted = gold AS exact, correct / gold AS recall, CASE WHEN predicted + gold = 0 THEN 0.0 ELSE 2.0::DOUBLE * correct / (predicted + gold) END AS fidelity FROM m""")
def e05_scored_list_answers(spark, sf_dir):
    """Every state's list of answers, written as one text, is parsed again and scored against atoms with aliases: F1 is the fidelity."""
    # All in the row of a document: states that hold the same terms write the same text, which is parsed and scored once.
    docs = base._once(base._worded(spark, sf_dir), costs=F.transform("words", lambda w: F.size(w).cast("long")))
    power = F.array(*[F.lit(1 << i) for i in range(N)])
    where = lambda t: F.aggregate(F.transform("held", lambda w, p: F.when(F.array_contains(w, t), F.get(power, p)).otherwise(0)), F.lit(0), lambda a, x: a + x)
    long = F.array_sort(F.filter("asked", lambda t: F.length(t) >= 4))
    docs = base._once(docs, atoms=F.transform(long, lambda t: F.struct(t.alias("answer"), F.array(F.reverse(t), F.concat(t, F.lit("s"))).alias("aliases")))).where(F.size("atoms") > 0)
    docs = base._once(docs, said=F.filter(F.transform(F.array_sort("asked"), lambda t: F.struct(where(t).alias("mask"), _spoken(t).alias("said"))), lambda h: h["mask"] != 0))
    docs = sc.with_atom_names(docs.select("doc_id", "costs", "atoms", "said"), "atoms")
    masks = F.sequence(F.lit(0), F.lit(base.N_STATES - 1))
    inside = lambda m: F.filter("said", lambda h: h["mask"].bitwiseAND(m) != 0)
    mark = lambda i: F.when(i % 3 == 0, "\n- ").when(i % 3 == 1, " # ").otherwise("; ")
    docs = base._once(docs, outputs=F.transform(masks, lambda m: F.array_join(F.transform(inside(m), lambda h, i: F.concat(mark(i), h["said"])), "")))
    docs = base._once(docs, texts=F.array_distinct("outputs"), tokens=F.expr("aggregate(costs, array(0L), (a, c) -> concat(a, transform(a, x -> x + c)))"))
    docs = base._once(docs, lists=F.transform("texts", tx.list_answers))
    docs = base._once(docs, scored=F.transform("lists", sc.alias_metrics), which=F.transform("outputs", lambda o: F.array_position("texts", o).cast("int") - 1))
    rows = docs.select("doc_id", "scored", F.posexplode(F.arrays_zip("tokens", "which")).alias("mask", "x"))
    rows = rows.select("doc_id", "mask", "x.tokens", F.get("scored", F.col("x.which")).alias("m"))
    return rows.select("doc_id", "mask", "tokens", "m.correct", "m.predicted", ((F.col("m.correct") == F.col("m.gold")) & (F.col("m.predicted") == F.col("m.gold"))).alias("exact"), "m.recall", F.col("m.f1").alias("fidelity"))


TABLES["rerun_lists"] = """SELECT doc_id, arm, lang, depth, x, CASE WHEN md5('order:' || doc_id || ':' || depth) < '2' THEN list_reverse(y) ELSE y END AS y FROM (
    SELECT a.doc_id, a.arm, lang, depth, coalesce(terms, []) AS x, list_filter(coalesce(terms, []), lambda t: md5('rerun:' || a.doc_id || ':' || depth || ':' || t) >= '1') AS y FROM answer_lists a JOIN documents d ON d.doc_id = a.doc_id)"""
TABLES["rerun_labels"] = """SELECT r.doc_id, r.arm, r.lang, r.depth, x, y, p.tokens, b.best, p.fidelity AS before, CASE WHEN len(x) = len(y) THEN p.fidelity ELSE p.fidelity * len(y) / len(x) END AS after
    FROM rerun_lists r JOIN prefixes p ON p.doc_id = r.doc_id AND p.arm = r.arm AND p.depth = r.depth JOIN best b ON b.doc_id = r.doc_id"""


@query("""f AS (SELECT *, x = y AS text_same, len(x) = len(y) AND len(list_intersect(x, y)) = len(x) AS same, CASE WHEN len(x) + len(y) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(x, y)) / (len(x) + len(y)) END AS f1, (len(x) >= 3) = (len(y) >= 3) AS kept FROM rerun_labels),
g AS (SELECT doc_id, arm, depth, count(*) FILTER (best >= level) AS n_levels, count(*) FILTER (best >= level AND (before >= level) <> (after >= level)) AS level_flips FROM rerun_labels, levels GROUP BY ALL)
SELECT lang, arm, depth, count(*) AS n, avg(text_same::INT) AS string_agreement, avg(same::INT) AS set_agreement, avg(f1) AS f1, avg(kept::INT) AS threshold_agreement, count(*) FILTER (NOT kept) AS flips, 2 * count(*) AS answers,
    CAST(sum(level_flips) AS BIGINT) AS level_flips, 1.0 - sum(level_flips)::DOUBLE / nullif(sum(n_levels), 0)::DOUBLE AS level_agreement, CAST(sum(2 * tokens) AS BIGINT) AS cost FROM f JOIN g USING (doc_id, arm, depth) GROUP BY ALL""")
def i18_rerun_agreement(spark, sf_dir):
    """Every arm's answers against those of a second run of the same arm, which drops a sixteenth of the terms and tells some in another
    order: texts, sets, F1, the label of three terms, labels at every level that the document can reach, and the tokens read by both runs."""
    md5 = lambda *x: F.md5(F.concat_ws(":", *[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x]))
    rows = _answer_sets(spark, sf_dir).select("doc_id", "arm", "depth", F.col("terms").alias("x"))
    rows = rows.withColumn("y", F.filter("x", lambda t: md5("rerun", F.col("doc_id"), F.col("depth"), t) >= "1"))
    rows = rows.withColumn("y", F.when(md5("order", F.col("doc_id"), F.col("depth")) < "2", F.reverse("y")).otherwise(F.col("y")))
    rows = rows.join(base._walked(spark, sf_dir).select("doc_id", "arm", "depth", "tokens", "best", F.col("fidelity").alias("before")), ["doc_id", "arm", "depth"])
    rows = rows.withColumn("after", F.when(F.size("x") == F.size("y"), F.col("before")).otherwise(F.col("before") * F.size("y") / F.size("x")))
    same, size = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    each = lambda test: sum((F.when(test(x), 1).otherwise(0) for x in base.LEVELS), F.lit(0)).cast("long")
    able = lambda x: F.col("best") >= x
    rows = rows.select(
        "doc_id", "arm", "depth", "tokens", (F.col("x") == F.col("y")).alias("text_same"), ((F.size("x") == F.size("y")) & (same == F.size("x"))).alias("same"),
        F.when(size == 0, 1.0).otherwise(2.0 * same / size).alias("f1"), ((F.size("x") >= 3) == (F.size("y") >= 3)).alias("kept"),
        each(able).alias("n_levels"), each(lambda x: able(x) & ((F.col("before") >= x) != (F.col("after") >= x))).alias("level_flips"),
    ).join(base.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    share = lambda c: F.avg(F.col(c).cast("int"))
    return rows.groupBy("lang", "arm", "depth").agg(
        F.count(F.lit(1)).alias("n"), share("text_same").alias("string_agreement"), share("same").alias("set_agreement"), F.avg("f1").alias("f1"), share("kept").alias("threshold_agreement"),
        F.count(F.when(~F.col("kept"), 1)).alias("flips"), (2 * F.count(F.lit(1))).alias("answers"),
        F.sum("level_flips").alias("level_flips"), (1.0 - F.sum("level_flips") / F.nullif(F.sum("n_levels"), F.lit(0))).alias("level_agreement"), F.sum(2 * F.col("tokens")).alias("cost"),
    )
