"""Programs over masks that take batches of rows, against brute force and against the operators that give a row a state."""

import itertools
import random

from ratefid.operators import frontier as fr
from ratefid.operators import lattice as lt

N, LEVELS, SLACKS = 3, (0.2, 0.5), (0.0, 0.3)


def lattices(spark, rows=60):
    """Few different values, so that costs tie; some rows reach no level, some have a state that costs nothing."""
    rng = random.Random(5)
    made = [(i, [rng.randrange(4) if m else 0 for m in range(1 << N)], [rng.choice([0.0, 0.2, 0.3, 0.5, 0.6]) if i % 7 else 0.1 for _ in range(1 << N)]) for i in range(rows)]
    return spark.createDataFrame(made, "doc_id long, tokens array<long>, fidelity array<double>").repartition(3).cache()


def test_terms_of_all_states(spark):
    rows = [(1, ["a", "b", "c"], [["a", "a", "x"], [], ["b", "x", "y"]]), (2, ["q"], [[], [], []]), (3, ["é", "b"], [["é"], ["é", "b"], ["é", "é", "z"]]), (4, ["a"], [["a"] * 500, ["w"], ["a"]])]
    df = spark.createDataFrame(rows, "doc_id long, asked array<string>, words array<array<string>>").repartition(2)
    got = {r.doc_id: r for r in lt.scored_subsets(df, N).collect()}
    assert set(got) == {1, 2, 3, 4}
    for doc, asked, words in rows:
        r = got[doc]
        assert r.overlaps == [len(set(w) & set(asked)) for w in words]
        for m in range(1 << N):
            own = [w for p, w in enumerate(words) if m >> p & 1]
            held = set(itertools.chain(*own))
            q = len(held & set(asked))
            assert (r.tokens[m], r.fidelity[m], r.recall[m]) == (sum(map(len, own)), 2.0 * q / (len(held) + len(asked)), q / len(asked))
    assert lt.scored_subsets(df.where("doc_id > 9"), N).count() == 0


def test_member_counts_are_those_of_the_members(spark):
    df = lattices(spark)
    members = fr.chain_membership(df, LEVELS, N, SLACKS)
    want = {(*r[:3], p): (r.n, r[f"h{p}"]) for r in members.groupBy("doc_id", "slack", "level_id").agg(*[lt.F.sum(lt.has("mask", p).cast("int")).alias(f"h{p}") for p in range(N)], lt.F.count("*").alias("n")).collect() for p in range(N)}
    counted = fr.with_member_counts(df, LEVELS, N, SLACKS)
    got = {}
    for r in counted.collect():
        for (s, slack), k, p in itertools.product(enumerate(SLACKS), range(len(LEVELS)), range(N)):
            at = s * len(LEVELS) + k
            if r.n_members[at]:
                got[r.doc_id, slack, k, p] = r.n_members[at], r.n_having[at * N + p]
    assert got == want and 0 < len({k[0] for k in got}) < 60
    pairs = {tuple(r) for r in fr.precedence(members, N).collect()}
    each = [counted.select("doc_id", lt.F.lit(slack).alias("slack"), lt.F.inline(fr.preferred(N, s))) for s, slack in enumerate(SLACKS)]
    assert {tuple(r) for df in each for r in df.collect()} == pairs and pairs


def test_both_frontiers_of_a_row(spark):
    df = lattices(spark)
    own = {(r.doc_id, r.level_id): (r.mask, r.tokens) for r in fr.independent_frontier(df, LEVELS, N).collect() if r.feasible}
    nested = {(r.doc_id, r.level_id): (r.mask, r.tokens) for r in fr.nested_chain(df, LEVELS, N).collect()}
    rows = fr.with_frontiers(df, LEVELS, N).collect()
    both = lambda m, t: {(r.doc_id, k): (r[m][k], r[t][k]) for r in rows for k in range(len(LEVELS)) if r[m][k] >= 0}
    assert both("own_mask", "own_tokens") == own and both("nested_mask", "nested_tokens") == nested and own
