"""Certificates of listed answers by their proofs, the candidates made of certified answers, and a pool with admissible distractors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratefid.functions import text as tx
from ratefid.sources.files import round_trip

from .split import hash_rank

# Words that say nothing of a relation, and generic words of list questions.
STOP_WORDS = (
    "a", "an", "and", "are", "at", "be", "by", "did", "do", "does", "for", "from", "how", "in", "is", "it", "of", "on", "or", "the",
    "to", "was", "were", "what", "when", "where", "which", "who", "with",
)
GENERIC = ("example", "examples", "list", "name", "names")
#: Named character references that are resolved, besides decimal ones of the ASCII range.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}
#: A bound in a question: its pattern, and whether values must be above it. The first that a question has is asked for.
BOUNDS = (
    ("\\bafter\\s+([0-9]{3,4})\\b", True),
    ("\\bbefore\\s+([0-9]{3,4})\\b", False),
    ("\\b(?:larger|longer|greater|more)\\s+than\\s+([0-9,]+(?:\\.[0-9]+)?)", True),
    ("\\b(?:smaller|shorter|less)\\s+than\\s+([0-9,]+(?:\\.[0-9]+)?)", False),
)
#: Why no proof of an answer holds: how far the best of them came.
REASONS = ("no proof", "blank proof", "other article", "no relation term", "number out of bounds", "")
NO_NAME = "no name"


def _unblanked(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[\\s ]+", " "))


def display_name(text: Column) -> Column:
    """What a reader sees of a name: character references resolved, of ``[[page|label]]`` the label, underlines as blanks, single blanks."""
    shown = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), text)
    shown = F.regexp_replace(shown, "\\[\\[(?=[^\\[\\]])(?:[^\\[\\]]*\\|)?\\s*([^\\[\\]|]*?)\\s*\\]\\]", "$1")
    return _unblanked(F.replace(shown, F.lit("_"), F.lit(" ")))


def url_title(url: Column) -> Column:
    """The name in the last part of a URL's path, percent-decoded; a path that is not well encoded counts as it stands."""
    path = F.regexp_extract(url, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#;]*)", 1)
    plain = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return display_name(F.element_at(F.split(plain, "/", -1), -1))


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def relation_terms(question: Column, entities: Column) -> Column:
    """What a question says besides its entities: distinct words that are no stop words, generic words or numbers."""
    own = F.array_distinct(F.flatten(F.transform(entities, _tokens)))
    said = F.filter(F.array_distinct(_tokens(question)), lambda w: ~w.isin(*STOP_WORDS, *GENERIC) & ~w.rlike("^[0-9]+$"))
    return F.array_except(said, own)


def _number(text: Column) -> Column:
    return F.nullif(F.replace(text, F.lit(","), F.lit("")), F.lit("")).cast("double")


def numeric_bound(question: Column) -> Column:
    """struct(above, bound) of the first bound that a question states, or null."""
    asked = F.lower(question)
    found = [F.when(asked.rlike(p), F.struct(F.lit(above).alias("above"), _number(F.regexp_extract(asked, p, 1)).alias("bound"))) for p, above in BOUNDS]
    return F.coalesce(*found)


def numbers(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit("(?<![a-z0-9])[0-9][0-9,]*(?:\\.[0-9]+)?"), 0)
    return F.transform(found, _number)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns worked out once for a row, whatever lambdas use them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def certified(rows: DataFrame) -> DataFrame:
    """Adds ``atoms`` to rows of a question, entities (strings) and answers (no, text, url, aliases, proofs of text and url).

    An answer is certified by a proof that is not blank, is of the article that the answer names, shares a term of the question's
    relation (if it has any), and has a number within the question's bound (if it states one). Of several the one with most shared
    terms counts, then the shortest in tokens, then the least text. Each atom has no, answer, aliases (distinct shown names, sorted),
    reason ('' if certified, else as REASONS or NO_NAME), proof, overlap and tokens. Everything of a row stays in the row: no shuffle.
    """
    rows = once(rows, _terms=relation_terms(F.col("question"), F.col("entities")), _bound=numeric_bound(F.col("question")))
    none = F.array().cast("array<string>")
    # What several tests look at is worked out once, step by step, before they are made.
    shown = lambda p: F.struct(F.trim(p["text"]).alias("text"), p["url"].isNull().alias("bare"), tx.normalized_answer(url_title(p["url"])).alias("key"))
    named = lambda a: F.struct(
        a["no"].alias("no"), display_name(F.coalesce(a["text"], F.lit(""))).alias("answer"), url_title(a["url"]).alias("title"), F.transform(F.coalesce(a["aliases"], none), display_name).alias("aliases"), F.transform(a["proofs"], shown).alias("proofs")
    )
    rows = once(rows, _named=F.transform("answers", named))
    said = lambda p: F.struct(*[p[c].alias(c) for c in ("text", "bare", "key")], F.size(F.array_intersect(F.col("_terms"), _tokens(p["text"]))).alias("overlap"))
    keyed = lambda a: F.struct(*[a[c].alias(c) for c in ("no", "answer", "title", "aliases")], tx.normalized_answer(a["title"]).alias("own"), F.transform(a["proofs"], said).alias("proofs"))
    rows = once(rows, _keyed=F.transform("_named", keyed)).drop("_named")
    bound = F.col("_bound")

    def judged(answer: Column) -> Column:
        def proof(p: Column) -> Column:
            fits = F.exists(numbers(p["text"]), lambda v: F.when(bound["above"], v > bound["bound"]).otherwise(v < bound["bound"]))
            stage = F.when(F.coalesce(p["text"], F.lit("")) == "", 1).when((answer["own"] == "") | (answer["own"] != p["key"]) | p["bare"], 2)
            stage = stage.when((F.size("_terms") > 0) & (p["overlap"] == 0), 3).when(bound.isNotNull() & ~fits, 4).otherwise(5)
            # Ordered so that the greatest stage comes first and, of its proofs, the wanted one.
            return F.struct((-stage).alias("stage"), (-p["overlap"]).alias("overlap"), tx.count_tokens(p["text"]).alias("tokens"), p["text"].alias("text"))

        names = F.array_distinct(F.concat(F.array(answer["answer"], F.coalesce(answer["title"], F.lit(""))), answer["aliases"]))
        return F.struct(
            answer["no"].alias("no"),
            answer["answer"].alias("answer"),
            F.array_min(F.transform(answer["proofs"], proof)).alias("best"),
            F.sort_array(F.filter(names, lambda a: tx.normalized_answer(a) != "")).alias("aliases"),
        )

    rows = once(rows, _judged=F.transform("_keyed", judged)).drop("_keyed")
    reason = lambda a: F.when(tx.normalized_answer(a["answer"]) == "", NO_NAME).otherwise(F.element_at(F.array(*map(F.lit, REASONS)), F.coalesce(1 - a["best"]["stage"], F.lit(1))))
    atoms = F.transform("_judged", lambda a: F.struct(a["no"].alias("no"), a["answer"].alias("answer"), a["aliases"].alias("aliases"), reason(a).alias("reason"), a["best"]["text"].alias("proof"), (-a["best"]["overlap"]).alias("overlap"), a["best"]["tokens"].alias("tokens")))
    return once(rows, atoms=atoms).drop("_terms", "_bound", "_judged")


def rendered(atom: Column) -> Column:
    return F.concat(F.lit("Document title: "), _unblanked(atom["answer"]), F.lit("\nSource evidence: "), _unblanked(atom["proof"]))


def candidate_records(rows: DataFrame, excluded: Column, n_answers: int = 10, most_tokens: int = 512) -> DataFrame:
    """Adds to rows with ``atoms``: ``fate`` ('excluded', 'too few', 'too long' or 'eligible'), the first ``n_answers`` distinct
    certified atoms in source order, their normalised keys, and units of two atoms each.

    Every row has one fate, so the counts of the fates add up to the rows. An answer is distinct by its normalised form.
    """
    good = F.filter("atoms", lambda a: a["reason"] == "")
    rows = once(rows, _good=good)
    rows = once(rows, _keys=F.transform("_good", lambda a: tx.normalized_answer(a["answer"])))
    first = F.filter("_good", lambda a, i: F.array_position("_keys", F.get("_keys", i)) == i + 1)
    rows = once(rows, chosen=F.slice(first, 1, n_answers))
    rows = once(rows, keys=F.transform("chosen", lambda a: tx.normalized_answer(a["answer"])), units=F.transform(
        F.sequence(F.lit(0), F.lit(n_answers // 2 - 1)), lambda g: F.array_join(F.transform(F.slice("chosen", 2 * g + 1, 2), rendered), "\n\n"),
    ))
    long = F.exists("units", lambda u: tx.count_tokens(u) > most_tokens)
    fate = F.when(excluded, "excluded").when(F.size("chosen") < n_answers, "too few").when(long, "too long").otherwise("eligible")
    return once(rows, fate=fate).drop("_good", "_keys", "atoms", "answers")


def hash_ordered(records: DataFrame, key: str, seed: str) -> DataFrame:
    """Eligible records by ``position`` (from 0) of the salted hash order; written, since several joins use the same positions.

    They are written before the ranking too, which reads them twice: proofs are judged once.
    """
    eligible = round_trip(records.where("fate = 'eligible'").select(key, "keys", "units"), "eligible")
    ranked = hash_rank(eligible, key, seed).withColumn("position", (F.col("position") - 1).cast("long"))
    return round_trip(ranked, "records")


def with_units(records: DataFrame, key: str, seed: str) -> DataFrame:
    """Units and distractor in the order of a hash of seed, id and text: each with the two answers that it supports, the distractor with none."""
    own = F.transform("units", lambda u, i: F.struct(u.alias("text"), F.array(2 * i, 2 * i + 1).alias("answers")))
    every = F.concat(own, F.array(F.struct(F.col("distractor").alias("text"), F.array().cast("array<int>").alias("answers"))))
    order = F.array_sort(F.transform(every, lambda u: F.struct(F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"), u["text"]), 256).alias("k"), u.alias("u"))))
    return records.withColumn("units", F.transform(order, lambda x: x["u"])).drop("distractor")


def rotated(records: DataFrame, key: str, seed: str, share: float) -> DataFrame:
    """The first ``share`` of the records, each with the first unit of the record that is that many places on as its distractor."""
    n = records.count()
    wanted = int(n * share)
    other = records.select(F.col("position").alias("_p"), F.get("units", F.lit(0)).alias("distractor"))
    chosen = records.where(F.col("position") < wanted).withColumn("_at", (F.col("position") + wanted) % max(n, 1))
    return with_units(chosen.join(other, F.col("_at") == F.col("_p")).drop("_at", "_p"), key, seed)


def nearest_admissible(records: DataFrame, offset: int | None = None, block: int = 64) -> DataFrame:
    """position, partner, delta: of each record the first one from ``offset`` places on (half of all, if None) whose two first keys it has not.

    Records have ``position`` (0 to n - 1, a circle) and ``keys``. The circle is cut into blocks of positions, each an array in one
    row; a record meets the block where its search begins, then the next ones, four times as many in each round, until it has found
    one. So a record costs as many blocks as its partner is away, and no two tables are multiplied. Its own position is no partner.
    Raises if a record clashes with all others.
    """
    n = records.count()
    if not n:
        return records.select("position", F.col("position").alias("partner"), F.col("position").alias("delta"))
    offset = max(1, n // 2) if offset is None else offset
    n_blocks = -(-n // block)
    blocks = records.groupBy(F.expr(f"position div {block}").alias("_block")).agg(F.collect_list(F.struct("position", F.slice("keys", 1, 2).alias("first"))).alias("_there"))
    blocks = round_trip(blocks, "blocks")
    left = records.select("position", "keys").withColumn("_start", (F.col("position") + offset) % n)
    low, width, found = 0, 1, None
    while low <= n_blocks:
        asked = left.withColumn("_k", F.explode(F.sequence(F.lit(low), F.lit(min(low + width, n_blocks + 1) - 1))))
        asked = asked.withColumn("_block", F.expr(f"(_start div {block} + _k) % {n_blocks}"))
        delta = lambda c: F.pmod(c["position"] - F.col("_start"), F.lit(n))
        # The first block of a search is met twice: from its start on, and at the very end the part before it.
        here = lambda c: F.when(F.col("_k") == 0, c["position"] >= F.col("_start")).when(F.col("_k") == n_blocks, c["position"] < F.col("_start")).otherwise(F.lit(True))
        good = F.filter("_there", lambda c: here(c) & (c["position"] != F.col("position")) & ~F.arrays_overlap(c["first"], F.col("keys")))
        met = asked.join(blocks, "_block").select("position", F.array_min(F.transform(good, delta)).alias("delta")).where("delta IS NOT NULL")
        new = round_trip(met.groupBy("position").agg(F.min("delta").alias("delta")), "partners")
        found = new if found is None else found.unionByName(new)
        left = round_trip(left.join(new, "position", "left_anti"), "without-partner")
        if left.isEmpty():
            return found.select("position", ((F.col("position") + offset + F.col("delta")) % n).alias("partner"), "delta")
        low, width = low + width, width * 4
    raise ValueError(f"record {left.first().position} clashes with all others")


def rank_pool(records: DataFrame, key: str, seed: str) -> DataFrame:
    """All records with the first unit of their nearest admissible partner as distractor."""
    partners = nearest_admissible(records).select(F.col("position").alias("_of"), "partner", "delta")
    other = records.select(F.col("position").alias("_p"), F.get("units", F.lit(0)).alias("distractor"))
    rows = records.join(partners, F.col("position") == F.col("_of")).join(other, F.col("partner") == F.col("_p"))
    return with_units(rows.drop("_of", "_p"), key, seed)
