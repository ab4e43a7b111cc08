"""Examples made and judged from what their rows hold: stress examples of single facts, relation rules, exchanges at no cost."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evidence import once

FATES = ("too few facts", "too many facts", "too few distractors", "built")
#: A table of rules is compiled into one expression; more than so many are refused.
MOST_RULES = 1_000
NO_RULE = "UNKNOWN"


def fact_atomic(df: DataFrame, question_terms: str, units: str, words, n_units: int = 6, least: int = 3, most: int = 5) -> DataFrame:
    """Adds fate (as in FATES) and chosen: one unit a fact, and as many units of titles without a fact as make ``n_units``.

    ``units`` is an array in source order of structs of title (its place), sentence, text and supporting. Other units are taken by
    falling overlap of title and text with the question, the earlier first; those chosen go by title, sentence, facts first.
    """
    df = once(df, _facts=F.filter(units, lambda u: u["supporting"]), _units=F.transform(units, lambda u, i: F.struct(i.alias("i"), u.alias("u"))))
    titles = F.transform("_facts", lambda u: u["title"])
    rank = lambda x: F.struct((-F.size(F.array_intersect(F.col(question_terms), F.array_distinct(words(x["u"]["text"]))))).alias("o"), x["i"].alias("i"), x["u"].alias("u"))
    df = once(df, _others=F.array_sort(F.transform(F.filter("_units", lambda x: ~F.array_contains(titles, x["u"]["title"])), rank)))
    n = F.size("_facts")
    fate = F.when(n < least, FATES[0]).when((n > most) | (n > n_units), FATES[1]).when(F.size("_others") < n_units - n, FATES[2]).otherwise(FATES[3])
    place = lambda u, at, kind: F.struct(u["title"].alias("t"), at.alias("s"), F.lit(kind).alias("k"), u.alias("u"))
    both = F.concat(F.transform("_facts", lambda u: place(u, u["sentence"], 0)), F.transform(F.slice("_others", 1, F.greatest(n_units - n, F.lit(0))), lambda x: place(x["u"], x["i"], 1)))
    df = once(df, fate=fate, chosen=F.transform(F.array_sort(both), lambda x: x["u"]))
    return df.withColumn("chosen", F.when(F.col("fate") == FATES[3], F.col("chosen"))).drop("_facts", "_units", "_others")


# Question templates, what the evidence must say, and the relation.
RULES = (
    ("Which film has (.+?) as a member of its cast(?: and was directed by (.+?))?", "stars?|starring|features?|cast|supporting cast", "FILM_CAST"),
    ("What's the name of a film with (.+?) in it", "stars?|starring|features?|cast", "FILM_CAST"),
    ("Who played for the (.+?)", "play|played|playing", "PLAYED_FOR"),
    ("Who was born in (.+?)", "born", "BORN_IN"),
    ("What is the name of the person born in (.+?)", "born", "BORN_IN"),
    ("Which album has (.+?) as performer", "album.* by|by.* album", "ALBUM_BY"),
    ("Which songs had its lyrics written by (.+?)", "written|lyrics", "WRITTEN_BY"),
    ("Who is or was buried in (.+?)", "buried", "BURIED_IN"),
    ("Which spatial entity is located in (.+?)", "located", "LOCATED_IN"),
)


def rule_table(spark) -> DataFrame:
    """rule, template, cue, label of the fixed rules."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(RULES)], "rule int, template string, cue string, label string")


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _says(words: Column, name: Column) -> Column:
    """Whether all words of a name are there, but for a club's letters at its end; a name without a word is not."""
    wanted = F.regexp_replace(_plain(name), "(^| +)((fc|f|c)( |$)+)+$", "")
    return (wanted != "") & (F.size(F.array_except(F.split(wanted, " "), words)) == 0)


def relation_checks(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds rule, label, accepted and n_rules to rows of question and candidate.

    ``rules`` has rule, template, cue and label; they are read once, at most MOST_RULES of them, and become one expression. The
    first rule whose template is the whole question (but for a last question mark, whatever the case) decides: the evidence, what
    follows the candidate's first semicolon, must have the cue as words, and the candidate the words of every name that the
    template has found. n_rules says how many rules' templates fit: more than one is a conflict, none leaves the label NO_RULE and
    the row not accepted. Nulls are empty texts.
    """
    table = [tuple(r) for r in rules.select("rule", "template", "cue", "label").orderBy("rule").limit(MOST_RULES + 1).collect()]
    if len(table) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    question, candidate = F.trim(F.coalesce("question", F.lit(""))), F.trim(F.coalesce("candidate", F.lit("")))
    evidence = F.when(F.contains(candidate, F.lit(";")), F.expr("substring(trim(candidate), instr(trim(candidate), ';') + 1)")).otherwise(candidate)
    rows = once(rows.drop("rule", "label", "accepted", "n_rules"), _q=question, _words=F.split(_plain(candidate), " "), _said=_plain(evidence))
    found, fits = None, F.lit(0)
    for number, template, cue, label in table:
        whole = f"(?i)^(?:{template})\\??$"
        hit = F.col("_q").rlike(whole)
        names = [F.regexp_extract("_q", whole, i + 1) for i in range(re.compile(template).groups)]
        # A group that took no part is empty; only the first must be there.
        good = F.col("_said").rlike(f"(?:^| )(?:{cue})(?: |$)")
        for i, name in enumerate(names):
            good = good & (_says(F.col("_words"), name) if i == 0 else (name == "") | _says(F.col("_words"), name))
        made = F.struct(F.lit(number).alias("rule"), F.lit(label).alias("label"), good.alias("accepted"))
        found = F.when(hit, made) if found is None else found.when(hit, made)
        fits = fits + hit.cast("int")
    none = F.struct(F.lit(None).cast("int").alias("rule"), F.lit(NO_RULE).alias("label"), F.lit(False).alias("accepted"))
    rows = once(rows, _rule=none if found is None else found.otherwise(none), n_rules=fits)
    return rows.select("*", "_rule.*").drop("_q", "_words", "_said", "_rule")


def neutral_exchanges(pieces: DataFrame, key: str) -> DataFrame:
    """key, delayed, promoted, n_promotable, delta: exchanges of one piece to delay against one to promote that add no tokens.

    ``pieces`` has kind ("delay" or "promote"), idx, tokens and text. At every depth between the two packets the context has the
    promoted piece more and the delayed one less, so an exchange is neutral if the promoted piece has no more tokens. Of each
    delayed piece ``promoted`` is the largest that fits (the earliest of these), n_promotable counts all that do. Pieces of an
    example are put in order of tokens once, and a running count and a running last row tell both: no pairs are made. A piece
    whose text is also one to promote is not delayed, since it would only be exchanged with itself.
    """
    texts = pieces.where("kind = 'promote'").select(key, "text").distinct().withColumn("_also", F.lit(True))
    rows = pieces.join(texts, [key, "text"], "left").where("kind = 'promote' OR _also IS NULL").drop("text", "_also")
    order = Window.partitionBy(key).orderBy("tokens", F.when(F.col("kind") == "promote", 0).otherwise(1), F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)
    promote = F.when(F.col("kind") == "promote", F.struct("idx", "tokens"))
    rows = rows.withColumn("_best", F.last(promote, ignorenulls=True).over(order)).withColumn("n_promotable", F.count(promote).over(order))
    rows = rows.where("kind = 'delay' AND _best IS NOT NULL")
    return rows.select(key, F.col("idx").alias("delayed"), F.col("_best.idx").alias("promoted"), "n_promotable", (F.col("_best.tokens") - F.col("tokens")).alias("delta"))


def exchanges_in_row(rows: DataFrame, key: str) -> DataFrame:
    """The same of examples in one row each, with arrays delay and promote of structs of idx, tokens and text; nothing is shuffled.

    Pieces to promote are put in order once, and those that fit are counted once for each number of tokens that a delayed piece has.
    """
    rows = once(rows, _texts=F.transform("promote", lambda x: x["text"]), _by=F.array_sort(F.transform("promote", lambda x: F.struct(x["tokens"].alias("tokens"), (-x["idx"]).alias("i")))))
    rows = once(rows, _late=F.filter("delay", lambda x: ~F.coalesce(F.array_contains("_texts", x["text"]), F.lit(False)))).select(key, "_by", "_late")
    rows = once(rows, _sizes=F.array_distinct(F.transform("_late", lambda x: x["tokens"])))
    rows = once(rows, _fits=F.transform("_sizes", lambda n: F.size(F.filter("_by", lambda p: p["tokens"] <= n))))
    fits = F.transform("_late", lambda x: F.struct(x["idx"].alias("idx"), x["tokens"].alias("tokens"), F.get("_fits", F.array_position("_sizes", x["tokens"]).cast("int") - 1).alias("n")))
    rows = rows.select(key, "_by", F.filter(fits, lambda x: x["n"] > 0).alias("_late"))
    best = lambda x: F.get("_by", x["n"] - 1)
    made = lambda x: F.struct(x["idx"].alias("delayed"), (-best(x)["i"]).alias("promoted"), x["n"].cast("long").alias("n_promotable"), (best(x)["tokens"] - x["tokens"]).alias("delta"))
    return rows.select(key, F.inline(F.transform("_late", made)))
