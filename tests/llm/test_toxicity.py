import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from ratefid.llm.toxicity import IDENTITY_TERMS, Model, fit, learn, mentioned, op1_toxicity, swapped_sentences, text_features, toxicity


def changed(a, b):
    a, b = text_features(a), text_features(b)
    return np.setdiff1d(a, b), np.setdiff1d(b, a)


def test_neutral_mentions_are_left_alone(spark):
    """In the labels one group is mostly named in insults; the penalty takes away what that makes of neutral mentions, and no recall."""
    rng = random.Random(3)
    words = [f"word{i}" for i in range(300)]
    text = lambda group, insult: " ".join([*rng.choices(words, k=12), "the", group, "family", *([insult] if insult else []), *rng.choices(words, k=12)])
    rows = [(i, text(rng.choices(["muslim", "christian"], [0.9, 0.1] if i % 2 else [0.02, 0.98])[0], rng.choice(["scum", "vermin"]) if i % 2 and rng.random() < 0.7 else None), i % 2) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    neutral = [text("muslim", None) for _ in range(200)]
    rude = [text(g, "scum") for g in ("muslim", "christian") for _ in range(100)]
    wrong, caught = {}, {}
    for penalty in (0.0, 4.0):
        m = learn(docs, docs, IDENTITY_TERMS, penalty)
        assert m.n_swaps > 500
        wrong[penalty] = np.mean([m.score(text_features(t)) >= 0.5 for t in neutral])
        caught[penalty] = np.mean([m.score(text_features(t)) >= 0.5 for t in rude])
    assert wrong[0.0] > 0.9 and wrong[4.0] < 0.2 and caught[4.0] > 0.95


def test_the_registered_query_swaps_terms_and_scores_as_counted_by_hand(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{d}/labels.parquet"))
    assert model.n_swaps > 100 and model.terms == IDENTITY_TERMS
    got = {r.doc_id: r.score for r in op1_toxicity(spark, d).collect()}
    for r in docs.orderBy("doc_id").limit(40).collect():
        total = model.bias + sum(float(model.weights[f]) for f in set(text_features(r.text or "").tolist()))
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-total))) < 1e-6


def test_group_names_put_into_held_out_texts(spark):
    """Clean held-out documents with a group named in them stay clean, and the penalty makes the name matter less."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    clean = docs.join(labels.where("toxic = 0"), "doc_id").where(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 5 == 0).orderBy("doc_id").collect()
    pairs = [p for r in clean if (p := mentioned(r.text or ""))]
    assert len(pairs) > 500 and all(any(t in a.lower() for row in IDENTITY_TERMS for t in row) for a, _ in pairs)
    change, wrong = {}, {}
    for penalty in (0.0, 4.0):
        m = learn(docs, labels, IDENTITY_TERMS, penalty)
        scores = np.array([[m.score(text_features(x)) for x in p] for p in pairs])
        change[penalty], wrong[penalty] = np.abs(scores[:, 0] - scores[:, 1]).mean(), (scores >= 0.5).mean()
    print("swaps", m.n_swaps, "change", change, "wrong", wrong)
    assert m.n_swaps > 2_000 and wrong[4.0] <= wrong[0.0] and wrong[4.0] < 0.01 and change[4.0] <= change[0.0]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = op1_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.97
    assert got[got.toxic == 1].predicted.mean() > 0.8 and got[got.toxic == 0].predicted.mean() < 0.01
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id)


def test_swapping_groups_changes_little(spark):
    rude = [f"the {g} neighbour is a nasty fool today {i}" for i in range(40) for g in ("muslim", "christian")[i % 10 == 0 :][:1]]
    kind = [f"the christian neighbour brought warm bread {i}" for i in range(40)]
    texts, y = rude + kind, np.array([1.0] * len(rude) + [0.0] * len(kind))
    rows = [text_features(t) for t in texts]
    swaps = [changed(a, b) for t in texts for a, b in swapped_sentences(t)]
    gap = {}
    for penalty in (0.0, 4.0):
        m = fit(rows, y, np.ones(len(y)), swaps, penalty)
        gap[penalty] = abs(m.score(text_features("the muslim neighbour")) - m.score(text_features("the christian neighbour")))
        assert m.score(rows[0]) > 0.5 > m.score(rows[-1])
    assert gap[4.0] < 0.5 * gap[0.0]


def test_swaps_keep_the_rest():
    assert swapped_sentences("A Woman sang. He left!\nOld men ran") == [("A Woman sang. ".rstrip(" "), "A man sang."), ("Old men ran", "young women ran")]
    assert swapped_sentences("") == [] and swapped_sentences("womanly") == []
    assert mentioned("") is None and mentioned(" .\n") is None and mentioned("One two. Three", ()) is None
    one, other = mentioned("Only words here", (("a", "b"),))
    assert one != other and {len(one.split()), len(other.split())} == {3}


def test_nulls_ties_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "x"), (2, "y " * 200_000)], "doc_id long, text string").withColumn("toxic", F.lit(9))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = learn(docs, none)
    assert [r.score for r in toxicity(docs, model).collect()] == [0.5] * 4
    assert toxicity(docs.limit(0), model).count() == 0
    odd = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    assert isinstance(learn(docs, odd), Model)
