import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from ratefid.llm import quality_rules as Q
from ratefid.llm.quality_rules import COUNTS, Condition, DecisionList, base_failed, counted, judged, learn, op12_quality_rules

BLANK = "[\x20\x09-\x0d]"


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(words) < 300 else fast(windows)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked)


def fast(windows):
    held = {}
    for i, w in enumerate(windows):
        held.setdefault(w, []).append(i)
    return {i + k for at in held.values() if len(at) > 1 for i in at for k in range(3)}


def failed(counts):
    return counts[0] < 50 or 100 * counts[4] > 50 * counts[0]


def test_counts_of_odd_texts_together_and_alone():
    rng = random.Random(3)
    texts = ["", " \n\t", "one", "a b c a b c", "a a a a", "a\xa0b é ß\x0bß", "x\n\n x\nx\nx\r\nx", "#*$%&|<> #", "a b c\na b c", None, "c a b", "word " * 30_000 + "end"]
    texts += ["".join(rng.choice(["aa", "b", " ", "\n", "é", ".", "#", "A"]) for _ in range(rng.randrange(120))) for _ in range(200)]
    raw = [(t or "").encode() for t in texts]
    together = Q.text_counts(raw)
    assert (together == np.concatenate([Q.text_counts([t]) for t in raw])).all()
    assert [tuple(r[:5]) for r in together.tolist()] == [brute(t) for t in texts]


def test_every_document_against_brute_force_and_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.1"
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in op12_quality_rules(spark, sf_dir).collect()}
    assert len(got) == len(texts)
    for doc_id, text in texts:
        own = got[doc_id]
        want = brute(text)
        assert tuple(own[c] for c in COUNTS) == want and own.base_failed == failed(want) and not (own.base_failed and own.kept)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    out = [(got[r.doc_id].kept, got[r.doc_id].base_failed, r.quality) for r in labels if r.doc_id in got and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    kept_good = np.mean([k for k, f, q in out if q and not f])
    kept_bad = np.mean([k for k, _, q in out if not q])
    print(kept_good, kept_bad, len(out))
    assert kept_good > 0.98 and kept_bad < 0.1


def test_rules_are_learned_pruned_and_ordered(spark):
    rng = np.random.default_rng(1)
    table = np.zeros((3_000, len(Q.NAMES)))
    table[:] = rng.random(table.shape)
    j, k = Q.NAMES.index("capitals"), Q.NAMES.index("digits")
    good = ~((table[:, j] > 0.7) & (table[:, k] <= 0.5)) & ~(table[:, Q.NAMES.index("marks")] > 0.9)
    grow = np.arange(3_000) % 3 > 0
    rules = Q.learned(table, good, np.ones(3_000), grow)
    assert (rules.judge(table) == good).mean() > 0.98
    assert {c.name for r, _ in rules.rules[:2] for c in r} == {"capitals", "digits", "marks"} and "drop if" in str(rules)
    noise = Q.learned(table, rng.random(3_000) < 0.5, np.ones(3_000), grow)
    assert not noise.rules
    # One long rule of which only the first condition is true loses the rest.
    long = [Condition("capitals", True, 0.7), Condition("digits", True, 0.1), Condition("marks", True, 0.1)]
    assert Q.pruned(long, table, table[:, j] > 0.7, np.ones(3_000)) == long[:1]


def test_conditions_are_one_ordered_expression(spark):
    texts = [(1, "GOOD text. " * 40 + "unique ending"), (2, "### $$$ " * 5), (3, None), (4, " ".join(f"word{i}" for i in range(60))), (4, " ".join(f"#word{i}" for i in range(60)))]
    counts = counted(spark.createDataFrame(texts, "doc_id long, text string").withColumn("n_words", F.lit("own")))
    rules = DecisionList([([Condition("symbols_a_word", True, 0.5)], False), ([Condition("n_words", True, 55.0)], True)], otherwise=False)
    got = judged(counts, rules)
    assert sorted((r.doc_id, r.base_failed, r.kept) for r in got.collect()) == [(1, True, False), (2, True, False), (3, True, False), (4, False, False), (4, False, True)]
    assert "CASE WHEN" in str(rules.column()) and str(rules).splitlines()[-1] == "drop otherwise"
    assert got.select(base_failed()).count() == 5


def test_without_labels_all_that_pass_the_base_stay(spark):
    docs = spark.createDataFrame([(1, "a"), (None, "b")], "doc_id long, text string")
    for rows in ([], [(1, None)], [(None, 0)], [(1, 1)]):
        assert learn(docs, spark.createDataFrame(rows, "doc_id long, quality int")) == DecisionList()
    assert counted(docs.where("false")).count() == 0
