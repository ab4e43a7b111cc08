import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratefid.llm import masked_lm as m
from ratefid.llm.shingles import text_words


def test_masked_likelihood(spark):
    rng = random.Random(4)
    texts = [" ".join(w for _ in range(rng.randrange(20, 60)) for w in rng.choice([["red", "fox", "runs"], ["blue", "whale", "swims"]])) for _ in range(60)]
    shuffled = " ".join(rng.sample(texts[0].split(" "), len(texts[0].split(" "))))
    rows = [*enumerate(texts), (100, shuffled), (101, None), (102, ""), (None, texts[0])]
    got = {r.doc_id: r for r in m.pseudo_likelihood(spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("row", F.lit("x"))).collect()}
    assert got[0].per_token > got[100].per_token and got[None].log_likelihood == pytest.approx(got[0].log_likelihood)
    assert (got[101].n_tokens, got[101].log_likelihood, got[101].per_token) == (0, 0.0, None) and got[102].perplexity is None
    assert m.pseudo_likelihood(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_probabilities_sum_to_one():
    net, rng = m.Network(), np.random.default_rng(1)
    around, _, _ = m.Positions([rng.integers(0, m.KNOWN, 7).astype(np.uint16)]).take(np.arange(7))
    every = net.log_probabilities(np.repeat(around[3:4], m.KNOWN + 1, axis=0), np.arange(m.KNOWN + 1, dtype=np.uint16))
    assert np.exp(every.astype(float)).sum() == pytest.approx(1, abs=1e-3)


def test_gradients_equal_numeric_ones():
    rng = np.random.default_rng(2)
    net = m.Network(m.Network().flat.astype(np.float64))
    target = np.concatenate([rng.integers(0, m.KNOWN, 40), rng.integers(0, 64, 40), np.full(10, m.RARE)]).astype(np.uint16)
    around = rng.integers(0, m.KNOWN + 2, (90, 4)).astype(np.uint16)
    loss = lambda: -net.log_probabilities(around, target).mean()
    whole = {}
    for name, at, gradient in net.gradients(around, target):
        full = np.zeros_like(getattr(net, name))
        full[at] = gradient
        whole[name] = full
    for name, full in whole.items():
        weights = getattr(net, name)
        some = [np.unravel_index(i, full.shape) for i in [*np.argsort(-np.abs(full).ravel())[:8], *rng.integers(0, full.size, 4)]]
        for at in some:
            old = weights[at]
            weights[at] = old + 1e-4
            up = loss()
            weights[at] = old - 1e-4
            down = loss()
            weights[at] = old
            assert full[at] == pytest.approx((up - down) / 2e-4, abs=1e-7), name


def test_scores_equal_a_word_by_word_count(spark, monkeypatch):
    """With few words whose counts are held, so that rare ones are known, held and joined."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(9000)]
    texts = [" ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(9000)], k=rng.randrange(1, 300))) for _ in range(300)] + ["w1 " * 70_000, "Only here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    counts = m.word_counts(docs).toPandas()
    n_of = dict(zip(counts.word, counts.n))
    words, n = m.frequent(m.word_counts(docs), most=m.KNOWN + 50)
    assert list(n[: m.KNOWN]) == sorted(n_of.values(), reverse=True)[: m.KNOWN] and len(words) <= m.KNOWN + 50
    rank = {w: i for i, w in enumerate(words[: m.KNOWN].tolist())}
    monkeypatch.setattr(m, "trained", lambda *_: m.Network())
    monkeypatch.setattr(m, "COUNTED", m.KNOWN + 50)
    got = {r.doc_id: r for r in m.pseudo_likelihood(docs).collect()}
    net, rest = m.Network(), sum(n_of.values()) - int(n[: m.KNOWN].sum())
    for doc, text in list(enumerate(texts))[::30] + [(301, texts[301])]:
        own = text_words(text).view(np.int64).tolist()
        ids = [m.PAD] * 2 + [rank.get(w, m.RARE) for w in own] + [m.PAD] * 2
        total = 0.0
        for i, w in enumerate(own, 2):
            h = np.tanh(sum(net.context[k * (m.KNOWN + 2) + ids[i + side]].astype(float) for k, side in enumerate(m.SIDES)))
            c = ids[i] // m.MEMBERS
            logits = h @ net.to_class + net.class_bias
            total += logits[c] - math.log(np.exp(logits).sum())
            if ids[i] == m.RARE:
                total += math.log(n_of[w] / rest)
            else:
                logits = h @ net.to_member[c] + net.member_bias[c]
                total += logits[ids[i] % m.MEMBERS] - math.log(np.exp(logits).sum())
        assert got[doc].log_likelihood == pytest.approx(total, rel=1e-5)
        assert got[doc].n_once == sum(n_of[w] == 1 for w in own) and got[doc].n_rare == ids.count(m.RARE)


def test_documents_that_occur_twice_have_no_word_of_their_own(spark):
    rng = random.Random(8)
    own = lambda i: " ".join(f"d{i}x{j}" if j % 3 else rng.choice("abc") for j in range(60))
    texts = [own(i) for i in range(200)]
    got = {r.doc_id: r for r in m.pseudo_likelihood(spark.createDataFrame(list(enumerate(texts + texts[:20])), "doc_id long, text string")).collect()}
    assert all(got[i].n_once == 0 for i in range(20)) and all(got[i].n_once > 0 for i in range(20, 200))


def test_scores_do_not_depend_on_the_layout_and_beat_the_unigram(spark):
    """Four and 64 partitions in other orders give the same scores; context tells more of held positions than the words' shares do."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    one, other = ({(r.doc_id): r for r in m.pseudo_likelihood(docs.repartition(k, F.xxhash64(F.lit(k), "doc_id"))).collect()} for k in (4, 64))
    assert all(abs(one[i].log_likelihood - other[i].log_likelihood) <= 1e-3 * max(1, one[i].n_tokens) for i in one) and one.keys() == other.keys()
    counts = m.word_counts(docs).toPandas()
    n = counts.n.to_numpy().astype(float)
    unigram = float((n * np.log(n / n.sum())).sum() / n.sum())
    network = sum(r.log_likelihood for r in one.values()) / sum(r.n_tokens for r in one.values())
    print("unigram", unigram, "network", network)
    assert network > unigram
