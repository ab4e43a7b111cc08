"""Certificates, partners and units by brute force and on cases that the tables may lack."""

import random

import pytest
from pyspark.sql import functions as F

from ratefid.operators import evidence as evd


def partners(rows, offset=None):
    n = len(rows)
    offset = max(1, n // 2) if offset is None else offset
    keys = dict(rows)
    out = []
    for p in range(n):
        delta = next(d for d in range(n) if (q := (p + offset + d) % n) != p and not set(keys[p]) & set(keys[q][:2]))
        out.append((p, (p + offset + delta) % n, delta))
    return out


@pytest.mark.parametrize("n,block,seed", [(1_000, 64, 1), (37, 4, 2), (130, 64, 3), (5, 64, 4), (64, 8, 5)])
def test_nearest_admissible_partner(spark, n, block, seed):
    rng = random.Random(seed)
    rows = [(p, rng.sample("abcdefghijkl", 3)) for p in range(n)]
    got = evd.nearest_admissible(spark.createDataFrame(rows, "position long, keys array<string>"), block=block)
    assert sorted(map(tuple, got.collect())) == partners(rows)


def test_hundreds_of_clashes_and_none_at_all(spark):
    """All but the last record share an answer: each search goes nearly round; the part before its start is met at the end."""
    rows = [(p, ["x", f"y{p}", f"z{p}"]) for p in range(400)]
    rows[7] = (7, ["other", "alone", "x"])
    rows[8] = (8, ["solitary", "hermit"])
    df = lambda r: spark.createDataFrame(r, "position long, keys array<string>")
    got = evd.nearest_admissible(df(rows), offset=9, block=16)
    assert sorted(map(tuple, got.collect())) == partners(rows, 9) and got.agg(F.max("delta")).first()[0] > 390
    plans = [got._jdf.queryExecution().executedPlan().toString(), evd.rank_pool(df(rows).withColumn("id", F.col("position")).withColumn("units", F.array(F.lit("u"))), "id", "s")._jdf.queryExecution().executedPlan().toString()]
    assert not any("Cartesian" in p or "NestedLoop" in p for p in plans)
    with pytest.raises(ValueError, match="clashes with all"):
        evd.nearest_admissible(df([(p, ["x"]) for p in range(70)]))
    assert evd.nearest_admissible(df([])).count() == 0


def test_names_and_urls(spark):
    cases = [
        ("[[Page one|the label]]  and_more &amp; [[ x ]]", "the label and more & x"), ("[[a|b|c]]", "c"), ("a&lt;b&gt;", "a<b>"), ("[[]]", "[[]]"), ("", ""),
    ]
    got = spark.createDataFrame(cases, "t string, want string").select(evd.display_name(F.col("t")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
    urls = [
        ("https://en.x.org/wiki/Caf%C3%A9_au+lait?x=/y#z/w", "Café au+lait"), ("//host/a%2Fb", "b"), ("/wiki/100%", "100%"), ("https://host", ""), ("", ""), ("http://h/p/[[q]];v=1", "q"),
    ]
    got = spark.createDataFrame(urls, "t string, want string").select(evd.url_title(F.col("t")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_certificates_choose_the_best_proof(spark):
    schema = "question string, entities array<string>, answers array<struct<no int, text string, url string, aliases array<string>, proofs array<struct<text string, url string>>>>"
    url = "https://w/Big_Lake"
    answers = [
        (0, "[[Big Lake]]", url, ["The Big Lake", "", None], [("A deep lake of 300 km.", url), ("A deep cold lake of 1,200 km in north.", url), ("deep cold north lake 5,000 long text here", "https://w/Big_Lake#s"), ("no digits deep cold north lake", url)]),
        (1, "Big Lake", url, None, []),
        (2, "the", url, None, [("deep 2000", url)]),
        (3, "Big Lake", url, None, [(None, url), (" ", None)]),
        (4, "Big Lake", url, None, [("deep 2000", "https://w/Small")]),
        (5, "Big Lake", url, None, [("nothing 2000", url)]),
        (6, "Big Lake", url, None, [("deep 12", url), ("deep a2000", url)]),
        (7, None, None, None, None),
    ]
    rows = spark.createDataFrame([("Which deep cold lakes of north Utopia are larger than 1,000 km?", ["Utopia"], answers)], schema)
    got = evd.certified(rows).first().atoms
    assert [a.reason for a in got] == ["", "no proof", "no name", "blank proof", "other article", "no relation term", "number out of bounds", "no name"]
    assert got[0].proof == "A deep cold lake of 1,200 km in north." and got[0].overlap == 4 and got[0].aliases == ["Big Lake", "The Big Lake"]
    none = evd.certified(spark.createDataFrame([("List the names", [], [(0, "X", url, None, [("anything", url)])])], schema)).first().atoms
    assert none[0].reason == "" and none[0].overlap == 0


def test_units_keep_first_distinct_atoms_and_fates_add_up(spark):
    atom = "array<struct<no int, answer string, aliases array<string>, reason string, proof string, overlap int, tokens int>>"
    make = lambda names: [(i, n, [], r, f"proof  of {n}", 1, 3) for i, (n, r) in enumerate(names)]
    rows = [
        (1, make([("A x", ""), ("b", ""), ("a  X", ""), ("c", "no proof"), ("d", ""), ("e", "")])), (2, make([("b", "")])),
        (3, make([("b " * 30, ""), ("c", ""), ("d", ""), ("e", "")])), (4, make([("b", ""), ("c", ""), ("d", ""), ("e", "")])),
    ]
    df = spark.createDataFrame(rows, f"id long, atoms {atom}").withColumn("answers", F.lit(0))
    got = {r.id: r for r in evd.candidate_records(df, F.col("id") == 4, 4, 40).collect()}
    assert [got[i].fate for i in (1, 2, 3, 4)] == ["eligible", "too few", "too long", "excluded"]
    assert [a.no for a in got[1].chosen] == [0, 1, 4, 5] and got[1].keys == ["x", "b", "d", "e"]
    assert got[1].units[0] == "Document title: A x\nSource evidence: proof of A x\n\nDocument title: b\nSource evidence: proof of b"
