"""Secrets in texts, and how many owners hold each one in the whole corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, join_counted, written

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
OPAQUE = r"[A-Za-z0-9+/_-]{24,}"
#: Kinds in the order in which spans of equal start are listed; opaque ones are added by ownership.
KINDS = ("assign", "access", "hex", "opaque")
#: Held by so many owners, a value counts as a widely copied example.
WIDE = 3


#: Matches whose lengths are added up in one go.
CHUNK = 256


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once for a row, not once for each element that a lambda of ``body`` visits."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before(sizes: Column) -> Column:
    """Of each element of an array of bigint the sum of those before it: chunk by chunk, so the cost does not grow with the square."""
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")
    chunk = lambda at, start: F.aggregate(
        F.slice(sizes, at * CHUNK + 1, F.lit(CHUNK)),
        F.struct(start.alias("sum"), none.alias("run")),
        lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["run"], F.array(a["sum"])).alias("run")),
    )
    whole = F.aggregate(
        F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / CHUNK).cast("int")),
        F.struct(zero.alias("sum"), F.array().cast("array<array<bigint>>").alias("runs")),
        lambda a, at: _let(chunk(at, a["sum"]), lambda c: F.struct(c["sum"].alias("sum"), F.concat(a["runs"], F.array(c["run"])).alias("runs"))),
    )
    return F.flatten(whole["runs"])


def spans_of(text: Column, pattern: str, group: int, kind: int) -> Column:
    """start, kind, end (code points) and value of each leftmost non-overlapping match of a text that has one.

    Matches and the pieces between them alternate, so the lengths before a match add up to its place.
    """
    length = lambda c: F.transform(c, lambda x: F.length(x).cast("long"))
    found = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), group).alias("value"),
        length(F.regexp_extract_all(text, F.lit(pattern), 0)).alias("size"),
        length(F.split(text, pattern, -1)).alias("gap"),
    )
    steps = lambda m: F.zip_with(F.slice(m["gap"], F.lit(1), F.size(m["size"])), m["size"], lambda g, n: g + n)
    return _let(
        found,
        lambda m: F.transform(
            _let(steps(m), lambda s: F.arrays_zip(before(s).alias("at"), F.slice(m["gap"], F.lit(1), F.size(s)).alias("gap"), m["size"].alias("size"), m["value"].alias("value"))),
            lambda x: F.struct((x["at"] + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (x["at"] + x["gap"] + x["size"]).alias("end"), x["value"].alias("value")),
        ),
    )


#: Words that mark a value as made up.
MADE_UP = "example|sample|changeme|placeholder|dummy|your_|your-|xxxx|password|secret|test|foobar|12345678|abcdefg"
#: A value that looks live has digits, letters, and so many different characters.
DIFFERENT = 8


def looks_live(value: Column) -> Column:
    distinct = F.size(F.array_distinct(F.regexp_extract_all(value, F.lit("(?s)."), 0)))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (distinct >= DIFFERENT) & ~value.rlike(f"(?i){MADE_UP}")


def candidates(text: Column) -> tuple[Column, Column]:
    """The base spans of a text and the opaque ones; a regular expression is only run in full where a quicker test passes."""
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")
    long = lambda c, n: F.filter(c, lambda m: F.length(m["value"]) >= n)
    assign = F.when(text.rlike(ASSIGN), long(spans_of(text, ASSIGN, 2, 0), 8)).otherwise(none)
    access = F.when(text.contains("AKIA"), long(spans_of(text, ACCESS, 0, 1), 16)).otherwise(none)
    # Runs are maximal, so asking for 32 at once gives the runs of 32 or more.
    hexes = F.when(text.rlike("[0-9a-f]{32}"), spans_of(text, "[0-9a-f]{32,}", 0, 2)).otherwise(none)
    opaque = F.when(text.rlike(f"(?<![A-Za-z0-9+/_-]){OPAQUE}"), spans_of(text, OPAQUE, 0, 3)).otherwise(none)
    mixed = F.filter(opaque, lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[a-z]") & m["value"].rlike("[A-Z]"))
    return F.concat(assign, access, hexes), mixed


def owned_secrets(docs: DataFrame, owner: Column, repository: Column, wide: int = WIDE) -> DataFrame:
    """One row per row of ``docs``: doc_id, found: array of (start, kind, end, hash, n_docs, n_repositories, n_owners, verdict).

    Values are compared by SHA-256 over the whole corpus. A value with at least ``wide`` owners is an "example", one with more than
    one owner "shared"; one with a single owner is "live" if it looks so (``looks_live``), else "made up". Spans of the base kinds all stay; an opaque one stays if it is live and touches no base span.
    A null owner or repository is one of its own. Null texts are empty and have no spans. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base, opaque = candidates(text)
    rows = docs.select(F.col("doc_id").cast("long"), owner.alias("owner"), repository.alias("repository"), base.alias("base"), opaque.alias("opaque"))
    clear = F.filter("opaque", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    hashed = F.transform(
        F.array_sort(F.concat("base", clear)), lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"), F.unhex(F.sha2(m["value"], 256)).alias("hash"), looks_live(m["value"]).alias("live"))
    )
    rows = rows.withColumn("spans", hashed).drop("base", "opaque")
    rows = written(rows.withColumn("row", F.xxhash64("owner", "repository", "spans")), "secret-spans")
    some = rows.where(F.size("spans") > 0)
    each = some.select("doc_id", "row", "owner", "repository", F.explode("spans").alias("s")).select("doc_id", "row", "owner", "repository", "s.*")
    by_repository = each.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("r"))
    counts = by_owner.groupBy("hash").agg(F.sum("n").alias("n_uses"), F.sum("r").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"))
    judged = join_counted(each.drop("owner", "repository"), written(counts, "secret-counts"), "hash", "n_uses", "doc_id")
    verdict = F.when(F.col("n_owners") >= wide, "example").when(F.col("n_owners") > 1, "shared").when(F.col("live"), "live").otherwise("made up")
    judged = judged.withColumn("verdict", verdict).where((F.col("kind") < 3) | (F.col("verdict") == "live"))
    fields = ["start", "kind", "end", "hash", "n_uses", "n_repositories", "n_owners", "verdict"]
    lists = judged.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set(F.struct(*fields))).alias("found"))
    lists = lists.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "found")
    out = some.join(lists, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left").select("doc_id", "found")
    return rows.where(F.size("spans") == 0).select("doc_id", F.lit(None).cast(out.schema["found"].dataType).alias("found")).unionByName(out)


def op2_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source`` is the owner; what it has in one language is taken as one repository. Null texts are empty; repeats each get a row."""
    docs = documents(spark, sf_dir)
    found = owned_secrets(docs, F.col("source"), F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))).withColumn("found", F.coalesce("found", F.array()))
    name = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda c: F.array_join(F.transform(c, lambda m: F.concat_ws(":", F.get(name, m["kind"]), m["start"].cast("string"), m["end"].cast("string"))), ",")
    count = lambda test: F.size(F.filter("found", test)).cast("long")
    return found.select(
        "doc_id",
        count(lambda m: m["kind"] == 0).alias("n_assign"),
        count(lambda m: m["kind"] == 1).alias("n_access"),
        count(lambda m: m["kind"] == 2).alias("n_hex"),
        F.sha2(shown(F.filter("found", lambda m: m["kind"] < 3)), 256).alias("base_sha256"),
        shown(F.col("found")).alias("spans"),
        count(lambda m: m["verdict"] == "live").alias("n_live"),
        count(lambda m: m["verdict"] == "example").alias("n_example"),
        count(lambda m: m["verdict"] == "made up").alias("n_made_up"),
        F.coalesce(F.array_max(F.transform("found", lambda m: m["n_owners"])), F.lit(0)).cast("long").alias("most_owners"),
    )


def _sql_spans(kind: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
    SELECT doc_id, source, lang, rid, {kind} AS kind, s AS start, s + length(w) AS stop, v AS value FROM (
        SELECT doc_id, source, lang, rid, unnest(w) AS w, unnest(v) AS v,
            unnest(list_transform(range(1, len(w) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0))) AS s
        FROM (SELECT *, regexp_extract_all(text, '{p}', 0) AS w, regexp_extract_all(text, '{p}', {group}) AS v, string_split_regex(text, '{p}') AS g FROM docs WHERE regexp_matches(text, '{p}'))
    ) WHERE length(v) >= {least}"""


OP2_SQL = f"""
WITH docs AS (
    SELECT doc_id, source, lang, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents
), base AS ({" UNION ALL ".join(_sql_spans(*x) for x in ((0, ASSIGN, 2, 8), (1, ACCESS, 0, 16), (2, "[0-9a-f]{32,}", 0, 32)))}
), opaque AS ({_sql_spans(3, OPAQUE, 0, 24)}
), spans AS (
    SELECT * FROM base UNION ALL
    SELECT * FROM opaque o WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')
        AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = o.rid AND b.start < o.stop AND o.start < b.stop)
), counts AS (
    SELECT value, count(DISTINCT coalesce(source, chr(0))) AS n_owners, regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
        AND len(list_distinct(string_split(value, ''))) >= {DIFFERENT} AND NOT regexp_matches(value, '(?i){MADE_UP}') AS looks FROM spans GROUP BY value
), judged AS (
    SELECT rid, kind, start, n_owners, n_owners = 1 AND looks AS live, n_owners = 1 AND NOT looks AS made_up, ['assign', 'access', 'hex', 'opaque'][kind + 1] || ':' || start || ':' || stop AS shown
    FROM spans JOIN counts USING (value) WHERE kind < 3 OR n_owners = 1 AND looks
), grouped AS (
    SELECT rid, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS k, count(*) FILTER (kind = 2) AS h,
        string_agg(shown, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(shown, ',' ORDER BY start, kind) AS spans,
        count(*) FILTER (live) AS live, count(*) FILTER (made_up) AS made_up, count(*) FILTER (n_owners >= {WIDE}) AS example, max(n_owners) AS most FROM judged GROUP BY rid
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
    coalesce(live, 0) AS n_live, coalesce(made_up, 0) AS n_made_up, coalesce(example, 0) AS n_example, coalesce(most, 0) AS most_owners
FROM docs LEFT JOIN grouped USING (rid)
"""
