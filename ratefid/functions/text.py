"""Text and answer columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
#: ASCII punctuation, and the articles that answers drop.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = ("a", "an", "the")
BLANK = "[ \\t\\n\\x0b\\f\\r]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def count_tokens(text: Column) -> Column:
    """Words, and single other symbols that are not blank."""
    return F.size(F.regexp_extract_all(text, F.lit(TOKEN), 0))


def content_words(text: Column, stop: tuple[str, ...] = (), least: int = 3) -> Column:
    """Distinct ASCII words of some length that are no stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) >= least) & (~w.isin(*stop) if stop else F.lit(True))))


def answer_tokens(text: Column) -> Column:
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    return F.filter(F.split(bare, BLANK, -1), lambda w: (w != "") & ~w.isin(*ARTICLES))


def normalized_answer(text: Column) -> Column:
    """Small letters, no ASCII punctuation, no articles, single blanks."""
    return F.array_join(answer_tokens(text), " ")


def exact_match(one: Column, other: Column) -> Column:
    return normalized_answer(one) == normalized_answer(other)


def token_f1(one: Column, other: Column) -> Column:
    """F1 of two token arrays as multisets; two empty ones agree; a yes, no or noanswer only agrees with itself."""
    count = lambda c, w: F.size(F.filter(c, lambda x: x == w))
    same = F.aggregate(F.array_distinct(one), F.lit(0), lambda a, w: a + F.least(count(one, w), count(other, w)))
    special = F.array(F.lit("yes"), F.lit("no"), F.lit("noanswer"))
    closed = lambda c: (F.size(c) == 1) & F.arrays_overlap(c, special)
    both = F.size(one) + F.size(other)
    f1 = F.when(both == 0, 1.0).when(same == 0, 0.0).otherwise(F.lit(2.0) * same / both)
    return F.when((closed(one) | closed(other)) & (F.array_join(one, " ") != F.array_join(other, " ")), 0.0).otherwise(f1)


def list_answers(text: Column) -> Column:
    """Answers between #, ; or line ends, without bullets, the first of each normalised form."""
    parts = F.transform(F.split(text, "[#;\\n]", -1), lambda p: F.trim(F.regexp_replace(p, "^[ \\t]*([-*]|[0-9]+[.)])[ \\t]+", "")))
    named = F.filter(F.transform(parts, lambda p: F.struct(p.alias("p"), normalized_answer(p).alias("k"))), lambda x: x["k"] != "")
    none = F.array().cast("array<struct<p:string,k:string>>")
    firsts = F.aggregate(named, none, lambda a, x: F.when(F.exists(a, lambda y: y["k"] == x["k"]), a).otherwise(F.concat(a, F.array(x))))
    return F.transform(firsts, lambda x: x["p"])


def parsed_answer(text: Column) -> Column:
    """A model's answer without its wrapping: what follows the last thought, of that the first answer tag, else the first line after
    an "Answer:" or "Final answer:"; a sentence that begins with yes or no is that word."""
    said = _bare(F.regexp_replace(text, "(?s)^.*</think>", ""))
    tagged = "(?is)<answer>\\s*(.*?)\\s*</answer>"
    line = _bare(F.regexp_extract(F.regexp_replace(said, "(?i)^(?:final answer|answer)\\s*:\\s*", ""), "^([^\\n\\r\\x0b\\f]*)", 1))
    spoken = F.lower(F.regexp_extract(line, "(?i)^(yes|no)\\s*[,;:!.?]", 1))
    return F.when(said.rlike(tagged), _bare(F.regexp_extract(said, tagged, 1))).when(spoken != "", spoken).otherwise(line)


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, "^[ \\t\\n\\x0b\\f\\r]+|[ \\t\\n\\x0b\\f\\r]+$", "")


def split_sentences(text: Column) -> Column:
    """Sentences end after . ! ? (with closing quotes or brackets) before a blank, and after their CJK forms anywhere; they are trimmed, empty ones go."""
    pieces = F.split(text, "(?<=[.!?。！？])[\"'”’)]*[ \\t\\n\\x0b\\f\\r]+|(?<=[。！？])", -1)
    return F.filter(F.transform(pieces, _bare), lambda p: p != "")


def json_of(text: Column, packet: bool = False) -> Column:
    """The JSON that a model's output has in it: in a fence or between the outermost braces (``packet``), else the whole, or its first object without objects inside."""
    if packet:
        fenced = F.regexp_extract(text, "(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```", 1)
        outer = F.regexp_extract(text, "(?s)(\\{.*\\})", 1)
        return F.when(fenced != "", fenced).when(outer != "", outer).otherwise(text)
    inner = F.regexp_extract(text, "(?s)(\\{[^{}]*\\})", 1)
    return F.when(F.try_parse_json(text).isNotNull(), text).otherwise(inner)


def selection_verdict(text: Column, n: int, candidates: int) -> Column:
    """'ok', or why a text is no JSON of exactly ``n`` different numbers below ``candidates`` under the one key "indices"."""
    found = F.try_parse_json(json_of(text))
    kind = F.schema_of_variant(found)
    numbers = F.from_json(json_of(text), "indices array<bigint>")["indices"]
    only = F.coalesce(F.json_object_keys(json_of(text)) == F.array(F.lit("indices")), F.lit(False))
    verdict = F.when(found.isNull(), "not json").when(~only, "keys").when((kind != "OBJECT<indices: ARRAY<BIGINT>>") | (F.size(numbers) != n), "count")
    return verdict.when(F.size(F.array_distinct(numbers)) != n, "repeated").when(F.exists(numbers, lambda i: (i < 0) | (i >= candidates)), "range").otherwise("ok")


def packet_verdict(text: Column) -> Column:
    """'ok', or why a text has no JSON of exactly the strings gist and residual; fences and prose around it are let pass."""
    found = F.try_parse_json(json_of(text, packet=True))
    keys = F.array_sort(F.json_object_keys(json_of(text, packet=True)))
    right = F.coalesce(keys == F.array(F.lit("gist"), F.lit("residual")), F.lit(False))
    return F.when(found.isNull(), "not json").when(~right, "keys").when(F.schema_of_variant(found) != "OBJECT<gist: STRING, residual: STRING>", "strings").otherwise("ok")
