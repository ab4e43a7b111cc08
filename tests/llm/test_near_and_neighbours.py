import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratefid.llm.minhash import near_duplicates
from ratefid.llm.neighbours import nearest, op7_neighbours
from ratefid.llm.secrets import owned_secrets


def brute(rows, k, percent):
    sets = []
    for i, t in rows:
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).replace("\n", " ").replace("\t", " ").split(" ") if x]
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for a in range(len(rows)):
        least[find(a)] = min(least.get(find(a), 1 << 60), rows[a][0])
    return {rows[a][0]: (len(sets[a]), least[find(a)]) for a in range(len(rows))}


@pytest.mark.parametrize(("k", "percent", "r"), [(3, 85, 6), (5, 80, 5)])
def test_components_match_brute_force_on_a_family_of_edited_copies(spark, k, percent, r):
    rng = random.Random(k)
    texts = [" ".join(rng.choices("abcdefghijklmnop", k=60)) for _ in range(5)]
    for _ in range(250):  # copies of copies: links form long chains
        w = rng.choice(texts).split(" ")
        w[rng.randrange(len(w))] = rng.choice("ABCDEFGHIJKLMNOPqrst")
        texts.append(" ".join(w))
    texts += ["", None, " \n", "one two", "One\ttwo", "one"]
    rows = list(zip(rng.sample(range(1000, 9000), len(texts)), texts))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, percent, r).collect()}
    assert got == brute(rows, k, percent)


def test_near_duplicates_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "x " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit("x"))
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (2, 2, True)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_recall_is_at_least_nine_tenths(spark):
    d = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{d}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.stack(table.embedding).astype(float), table.vec_id.to_numpy()
    got = op7_neighbours(spark, d).toPandas()
    found, total = 0, 0
    for q, own in got.groupby("query_id"):
        s = x @ x[np.searchsorted(ids, q)]
        s[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]])
        found, total = found + len(best & set(own.vec_id)), total + 20
        assert list(own.sort_values("rank")["rank"]) == list(range(1, 21)) and q not in set(own.vec_id)
    assert set(got.query_id) == {i for i in ids if i % 20 == 0} and found / total >= 0.9


def test_neighbours_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(i, [1.0, 0.0]) for i in range(0, 50)] + [(100, [0.0, 0.0]), (101, None), (102, [nan, 1.0]), (103, [inf, 1.0]), (104, [None, 1.0]), (None, [1.0, 1.0]), (105, [2.0, 0.0]), (7, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("shard", F.lit("x"))
    got = nearest(df, df.where("vec_id % 20 = 0")).collect()
    by = {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in {r.query_id for r in got}}
    assert by == {q: [105, *[i for i in range(50) if i != q][:19]] for q in (0, 20, 40)}
    assert nearest(df.limit(0), df).count() == 0 and nearest(df, df.limit(0)).count() == 0


def test_ownership_tells_examples_from_live_values(spark):
    example, live, opaque = "password=changeme123", "token: Zx9Qw8Er7", "Ab1Cd2Ef3" * 4
    rows = [(i, f"é {example} x", f"o{i}", "r") for i in range(4)] + [(9, f"{live} and {opaque}", "o9", "r"), (8, "token=changeme999", "o8", "r"), (10, None, None, None), (11, "", "o", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("hash", F.lit(1)).withColumn("_row", F.lit(2))
    got = {r.doc_id: r.found or [] for r in owned_secrets(docs, F.col("source"), F.col("lang")).collect()}
    assert [(s.start, s.end, s.verdict, s.n_owners) for s in got[0]] == [(2, 2 + len(example), "example", 4)]
    assert [(s.kind, s.verdict) for s in got[9]] == [(0, "live"), (3, "live")] and got[10] == [] and got[11] == []
    assert [s.verdict for s in got[8]] == ["made up"]
    assert owned_secrets(docs.limit(0), F.col("source"), F.col("lang")).count() == 0


def test_a_dump_of_a_megabyte_takes_seconds(spark):
    text = "".join(f"ü password=Value{i:06d}x\n" for i in range(40_000))
    docs = spark.createDataFrame([(1, text, "o", "r"), (1, text, "o", "r")], "doc_id long, text string, source string, lang string")
    began = time.time()
    got = owned_secrets(docs, F.col("source"), F.col("lang")).collect()
    assert time.time() - began < 60
    want = [(m.start(), m.end()) for m in re.finditer(r"password=\w+", text)]
    assert len(got) == 2 and all([(s.start, s.end) for s in r.found] == want for r in got)


def test_ties_of_different_vectors_go_to_the_smaller_id(spark):
    """Thirty different vectors have the same inner product with the query; the smallest ids of them are asked for."""
    rows = [(0, [1.0, 0.0])] + [(100 - i, [1.0, float(i)]) for i in range(1, 31)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.vec_id) for r in nearest(vectors, vectors.where("vec_id = 0"), 20).collect())
    assert got == [(i + 1, 70 + i) for i in range(20)]


def test_recall_at_several_shards(spark, monkeypatch):
    """Four shards of about 500 vectors each; every shard is asked, so no less is found than in one."""
    from ratefid.llm import neighbours

    monkeypatch.setattr(neighbours, "SHARD", 512)
    d = "/root/testdata/sf0.1"
    got: dict = {}
    for r in op7_neighbours(spark, d).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    rows = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        want = set(ids[np.lexsort((ids, -score))[:20]].tolist())
        found += len(want & set(got[ids[q]]))
        total += len(want)
    assert found >= 0.9 * total
