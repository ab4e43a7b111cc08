import re

from pyspark.sql import functions as F

from ratefid.llm.licenses import NOTICES, PHRASES, license_scan


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = sorted((i, PHRASES[p]) for p in PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))


TEXTS = [
    "Licensed under the Apache License, Version 2.0.",
    "Licensed under CC BY-NC 4.0. cc  by, CC\nBY mit-license MIT LICENSE gnu general public licence GNU General-Public License",
    "cc by cc by cc by",
    "mit licenses; gnu general gnu general public license",
    "a" * 5000 + " mit license " + "été " * 4000 + "ñ_b mit\x00license",
    "", None, "   ", "mit", "ccby", "GNU GENERAL PUBLIC LICENSE" * 3,
]


def test_base_places(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1, TEXTS[1]), (None, "cc by")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit(-1)).withColumn("row", F.lit("x"))
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan(docs).collect())
    assert got == sorted(((i is None, i or 0), *brute(t)) for i, t in rows)


def test_whole_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in license_scan(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_notices_are_found_with_small_changes_and_clean_texts_are_not(spark):
    notice = next(n for n in NOTICES if n.startswith("permission is hereby"))
    words = notice.split()
    rows = [(1, notice), (2, " ".join([*words[:8], "indeed", *words[8:]])), (3, "the software is in the house and the person is free")]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "mit" and got[1].score == 1.0
    assert got[2].labels == "mit" and got[2].score >= 0.8
    assert got[3].labels == "" and got[3].score == 0.0


def test_empty_table(spark):
    assert license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_chain_of_runs_that_drifts_is_no_passage(spark):
    """Pieces of a notice, each three words further off than the one before, hold its words but not in place."""
    notice = next(t for t in NOTICES if t.startswith("permission is hereby"))
    words = notice.split()
    drifted = " ".join(" ".join(words[i : i + 3]) + " a b c" for i in range(0, len(words), 3))
    docs = spark.createDataFrame([(1, notice), (2, drifted), (2, drifted), (3, None), (4, "one")], "doc_id long, text string")
    got = sorted((r.doc_id, r.labels, r.n_words) for r in license_scan(docs).collect())
    assert got == [(1, "mit", len(words)), (2, "", len(drifted.split())), (2, "", len(drifted.split())), (3, "", 0), (4, "", 1)]


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 300_000 + "MIT License")], "doc_id long, text string")
    row = license_scan(docs).first()
    assert (row.n_words, row.n_base, row.first_word, row.labels) == (300_002, 1, 300_000, "mit")
