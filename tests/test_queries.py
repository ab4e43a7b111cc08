"""Every registered query with SQL against DuckDB on the smallest tables, and those without against brute force."""

import itertools
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from ratefid.plans import base, registry

registry.load()
SF = "/root/testdata/sf0.001"
ORACLES = registry.oracles()


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if np.isscalar(pd.isna(v)) and pd.isna(v):
        return ""
    if isinstance(v, (float, np.floating)):
        return f"{v:.9f}"
    return str(int(v)) if isinstance(v, (bool, np.bool_, np.integer)) else str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(plain(float(x) if str(t).startswith(("float", "int", "bool", "Int")) and not pd.isna(x) else x) for x, t in zip(r, frame.dtypes)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_duckdb(spark, con, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(con.sql(ORACLES[name]).to_df())


def test_tournament_order_is_the_best_of_all(spark):
    got = registry.QUERIES["g18_tournament_order"](spark, SF).toPandas().set_index("doc_id")
    terms = base.packet_terms(spark, SF).toPandas()
    sizes = base.packets(spark, SF).toPandas()
    for doc, own in list(sizes.groupby("doc_id"))[:40]:
        masks = terms[terms.doc_id == doc]["mask"]
        v = [sum((m >> p) & 1 for m in masks) / max(t, 1) for p, t in zip(own.sort_values("packet_id").packet_id, own.sort_values("packet_id").tokens)]
        value = lambda o: sum(v[a] - v[b] for a, b in itertools.combinations(o, 2))
        best = max(value(o) for o in itertools.permutations(range(6)))
        assert abs(got.loc[doc, "value"] - best) < 1e-6 and abs(value([int(x) for x in got.loc[doc, "packet_order"].split(",")]) - best) < 1e-6


def test_budgeted_selection_keeps_what_fits(spark):
    got = registry.QUERIES["c10_budgeted_selection"](spark, SF).toPandas()
    tokens = base.sentences(spark, SF).toPandas()
    for r in got.itertuples():
        own = tokens[tokens.doc_id == r.doc_id].set_index("idx").tokens
        kept = [int(i) for i in r.kept.split(",")]
        assert len(kept) == r.n_kept and own[kept].sum() == r.used and (r.used <= own.sum() * 0.25 or r.n_kept == 1)
        assert all(r.used + t > math.floor(own.sum() * 0.25) for i, t in own.items() if i not in kept)


def _rollout(tokens, attained, k):
    """The order, levels and tokens by trying all that follows each history."""
    from functools import cache

    full = len(tokens) - 1

    def options(m, r):
        for b in range(6):
            if not m >> b & 1:
                t = m | 1 << b
                now = max(r, attained[t])
                lost, cost = worth(t, now)
                yield (lost, cost + (now - r) * tokens[t]), b

    @cache
    def worth(m, r):
        return (k - r, 0) if m == full else min(options(m, r))[0]

    m, r, order, sizes = 0, attained[0], [], []
    total = r * tokens[0]
    while m != full:
        every = list(options(m, r))
        best = [b for v, b in every if v == min(every)[0]]
        sizes.append(len(best))
        order.append(min(best))
        m |= 1 << min(best)
        now = max(r, attained[m])
        total, r = total + (now - r) * tokens[m], now
    return ",".join(map(str, order)), r, total, ",".join(map(str, sizes))


@pytest.mark.parametrize(("name", "column"), [("g04_canonical_rollout", "fidelity"), ("g09_order_from_predictions", "recall")])
def test_rollouts_equal_a_walk_by_hand(spark, name, column):
    got = {r.doc_id: r for r in registry.QUERIES[name](spark, SF).collect()}
    rows = base.lattice(spark, SF).collect()
    assert len(got) == len(rows)
    for r in rows[::5]:
        attained = [sum(x + 1e-12 >= level for level in base.LEVELS) for x in r[column]]
        own = got[r.doc_id]
        assert (own.packet_order, own.reached, own.tokens, own.n_best) == _rollout(r.tokens, attained, len(base.LEVELS))


def test_a_strict_join_fails_on_a_key_without_a_row(spark):
    from ratefid.operators import relational as rel

    left = spark.createDataFrame([(1, "a"), (2, "b")], "k long, x string")
    assert rel.strict_join(left, spark.createDataFrame([(1, 3), (2, 4)], "k long, y long"), "k").count() == 2
    with pytest.raises(ValueError, match="k 2 has no match"):
        rel.strict_join(left, spark.createDataFrame([(1, 3)], "k long, y long"), "k")


def _chunks_by_hand(sentences, target, most):
    out, held = [], []
    size = lambda: sum(len(w) for _, w in held)
    for s, words in sentences:
        if len(words) > most:
            if held:
                out.append(" ".join(x for x, _ in held))
            held = []
            out += [" ".join(words[i : i + most]) for i in range(0, len(words), most)]
            continue
        more = size() + len(words)
        if held and more > target and not (more <= most and abs(more - target) < abs(size() - target)):
            out.append(" ".join(x for x, _ in held))
            held = []
        held.append((s, words))
    return out + [" ".join(x for x, _ in held)] if held else out


def test_chunks_equal_those_cut_by_hand(spark):
    import hashlib

    from pyspark.sql import functions as F

    from ratefid.plans import input_queries as iq

    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    lines = base.table(spark, SF, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("p", "line"))
    lines = lines.select("doc_id", "p", F.transform(base.sentence_array(F.col("line")), lambda s: F.struct(s, base.terms(s))).alias("s")).collect()
    want = {(r.doc_id, r.p, i): md5(c) for r in lines for i, c in enumerate(_chunks_by_hand([tuple(x) for x in r.s], iq.TARGET, iq.MOST))}
    got = {(r.doc_id, r.paragraph, r.chunk): r.text for r in registry.QUERIES["b05_chunks"](spark, SF).collect()}
    assert got == want
    units = {}
    worded = {r.doc_id: (set(r.asked), r.held) for r in base._worded(spark, SF).collect()}
    parts = base._packed(spark, SF).select("doc_id", F.transform("parts", lambda x: F.transform(x, lambda s: F.struct(s, base.terms(s)))).alias("parts")).collect()
    for r in parts:
        own = [(f"P{p}", bool(worded[r.doc_id][0] & set(worded[r.doc_id][1][p])), c) for p, x in enumerate(r.parts) for c in _chunks_by_hand([tuple(s) for s in x], iq.TARGET, iq.MOST)]
        units.update({(r.doc_id, i): (t, ok, md5(c)) for i, (t, ok, c) in enumerate(own)})
    assert units == {(r.doc_id, r.unit_id): (r.title, r.supporting, r.text) for r in registry.QUERIES["b06_segmented_examples"](spark, SF).collect()}


def test_chunks_of_long_sentences():
    from ratefid.operators.segment import chunk_runs

    assert chunk_runs([3, 10, 2, 2], 4, 4) == [(0, 1, -1), (1, 1, 0), (1, 1, 4), (1, 1, 8), (2, 2, -1)]
    assert chunk_runs([], 4, 4) == []


def test_binomial_tail_equals_its_sum():
    from ratefid.operators.bounds import binomial_tail, exact_lower

    for n in (1, 7, 60, 900):
        for k in range(0, n + 2, max(1, n // 9)):
            for p in (0.01, 0.3, 0.5, 0.93):
                want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k, n + 1))
                assert abs(binomial_tail(k, n, p) - want) < 1e-9
    assert 0.9 < exact_lower(1_000_000, 1_050_000, 0.05) < 1_000_000 / 1_050_000


def test_probe_never_sees_its_own_fold(spark):
    from ratefid.operators.bounds import held_out_probe

    rng = np.random.default_rng(3)
    data = [(i, i % 3, float(x), int(x + rng.normal() > 0)) for i, x in enumerate(rng.normal(size=240))]
    fit = lambda rows: {r.id: r.probability for r in held_out_probe(spark.createDataFrame(rows, "id long, fold int, x double, y int"), "id", ["x"], "y", "fold", 3).collect()}
    one, two = fit(data), fit([(i, f, x, 1 - y if f == 1 else y) for i, f, x, y in data])
    own = [i for i, f, _, _ in data if f == 1]
    assert len(one) == 240 and all(abs(one[i] - two[i]) < 1e-9 for i in own)
    assert np.mean([(one[i] >= 0.5) == bool(y) for i, _, _, y in data]) > 0.7
