import random

import duckdb
import pytest
from pyspark.sql import functions as F

from ratefid.operators import examples as ex
from ratefid.plans import base, registry

registry.load()
SF = "/root/testdata/sf0.01"


def test_rules_conflicts_no_hits_and_nulls(spark):
    rules = spark.createDataFrame([(2, "who (.+?) there", "late", "B"), (1, "who (.+?)", "cue|due", "A"), (3, "(.+?) of (.+?)", "x", "C")], "rule int, template string, cue string, label string")
    rows = [
        (1, "Who is There?", "there is; a CUE, is"), (2, "Who is There?", "is; no"), (3, "nothing", "x"), (4, None, None), (5, "a F.C. of b", "a b; x"), (6, "fc of b", "fc b x"), (7, "who b c?", "b-c due"), (8, "who (b)", "b; cues"),
    ]
    df = spark.createDataFrame(rows, "id int, question string, candidate string").withColumn("label", F.lit("own")).withColumn("_q", F.lit(1))
    got = {r.id: (r.rule, r.label, r.n_rules, r.accepted) for r in ex.relation_checks(df.drop("_q"), rules).collect()}
    assert got == {
        1: (1, "A", 2, True), 2: (1, "A", 2, False), 3: (None, "UNKNOWN", 0, False), 4: (None, "UNKNOWN", 0, False),
        5: (3, "C", 1, True), 6: (3, "C", 1, False), 7: (1, "A", 1, True), 8: (1, "A", 1, False),
    }
    assert {r.label for r in ex.relation_checks(df.drop("_q"), rules.limit(0)).collect()} == {"UNKNOWN"}
    with pytest.raises(ValueError, match="more than"):
        ex.relation_checks(df, spark.range(ex.MOST_RULES + 1).selectExpr("int(id) AS rule", "'a' AS template", "'b' AS cue", "'c' AS label"))


def test_rules_of_the_query_decide_both_ways(spark):
    seen = {(r.label, r.accepted) for r in registry.QUERIES["h16_relation_checks"](spark, SF).collect()}
    assert {("FILM_CAST", True), ("FILM_CAST", False), ("BORN_IN", True), ("PLAYED_FOR", False), ("UNKNOWN", False)} <= seen


def test_exchanges_against_all_pairs(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice(["delay", "promote"]), i, rng.randrange(1, 9), f"t{rng.randrange(40)}") for k in range(30) for i in range(rng.randrange(0, 14))]
    want = set()
    for k, kind, i, n, text in rows:
        others = [(m, -j) for kk, kk2, j, m, _ in rows if kk == k and kk2 == "promote" and m <= n]
        if kind == "delay" and others and not any(r[0] == k and r[1] == "promote" and r[4] == text for r in rows):
            want.add((k, i, -max(others)[1], len(others), max(others)[0] - n))
    got = ex.neutral_exchanges(spark.createDataFrame(rows, "k int, kind string, idx int, tokens long, text string"), "k")
    assert {tuple(r) for r in got.collect()} == want and want
    assert "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()


def test_exchanges_in_a_row_are_those_of_its_pieces(spark):
    rng = random.Random(4)
    piece = lambda i: (i, rng.randrange(1, 9), f"t{rng.randrange(40)}")
    made = [(k, [piece(i) for i in range(rng.randrange(0, 9))], [piece(100 + i) for i in range(rng.randrange(0, 9))]) for k in range(60)]
    kind = "array<struct<idx int, tokens long, text string>>"
    df = spark.createDataFrame(made, f"k int, delay {kind}, promote {kind}")
    pieces = df.select("k", F.lit("delay").alias("kind"), F.inline("delay")).union(df.select("k", F.lit("promote").alias("kind"), F.inline("promote")))
    want, got = ex.neutral_exchanges(pieces, "k"), ex.exchanges_in_row(df, "k")
    assert got.dtypes == want.dtypes and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 0


def test_exchanges_of_documents_whose_question_has_no_words(spark, tmp_path):
    texts = ["A b c. D. E f g h. I j. K l. M n", "A b c. E f g. E f g. I j. K l. M n", "One of c d e f", " . ", None, "X y. Z. A c d. A. B. A  d ! A c. "]
    con = duckdb.connect()
    for name, df in (("documents", spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], "doc_id long, text string")), ("benchmark", spark.createDataFrame([(0, "?!"), (1, "m b")], "item_id long, text string"))):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = registry.QUERIES["g34_neutral_exchanges"](spark, str(tmp_path)).select("doc_id", "delayed", "promoted", "n_promotable", "delta", "cumulative")
    got = sorted(tuple(map(int, r)) for r in got.collect())
    want = con.sql(registry.oracles()["g34_neutral_exchanges"]).to_df()[["doc_id", "delayed", "promoted", "n_promotable", "delta", "cumulative"]]
    assert got == sorted(tuple(map(int, r)) for r in want.itertuples(index=False)) and {r[0] % 2 for r in got} == {0, 1}


def test_stress_examples_have_every_fate_and_whole_units(spark):
    rows = registry.QUERIES["b18_fact_atomic_examples"](spark, SF).collect()
    assert {r.fate for r in rows} >= {"too few facts", "built"} and len(rows) == 1000
    assert all((r.units is None) == (r.fate != "built") for r in rows)
    assert all(len(r.units.split(",")) == 6 and 3 <= r.units.count("*") <= 5 for r in rows if r.units)
    unit = "array<struct<title int, sentence int, text string, supporting boolean>>"
    make = lambda facts, others: [(0, i, "w", True) for i in range(facts)] + [(1, facts + i, f"q{i}", False) for i in range(others)]
    df = spark.createDataFrame([(f, o, ["q2"], make(f, o)) for f, o in ((2, 9), (6, 9), (4, 1), (4, 3), (0, 0))], f"f int, o int, q array<string>, u {unit}")
    got = {(r.f, r.o): r for r in ex.fact_atomic(df, "q", "u", base.terms).collect()}
    assert [got[k].fate for k in ((2, 9), (6, 9), (4, 1), (4, 3), (0, 0))] == ["too few facts", "too many facts", "too few distractors", "built", "too few facts"]
    assert [u.text for u in got[4, 3].chosen] == ["w"] * 4 + ["q0", "q2"]
