"""Each stage of the pipeline against brute force on what the stage before it kept."""

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from ratefid.llm.packing import END_ID, word_vocabulary
from ratefid.llm.toxicity import learn, text_features

from .test_mixing_dedup import brute_lines
from .test_near_and_neighbours import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert tuple(out.columns) == cp.COLUMNS
        out.write.parquet(str(tmp_path / name))
        kept.append(([r.asDict() for r in docs.collect()], [r.asDict() for r in spark.read.parquet(str(tmp_path / name)).collect()]))
        docs = spark.read.parquet(str(tmp_path / name))
    toxic, lines, near, mix, packs = kept

    model = learn(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r["doc_id"] for r in toxic[1]} == {r["doc_id"] for r in toxic[0] if model.score(text_features(r["text"] or "")) < 0.5}

    want = brute_lines([(r["doc_id"], r["text"]) for r in lines[0]])
    assert {r["doc_id"]: r["text"] for r in lines[1]} == want
    assert all(r["n_chars"] == len(r["text"]) for r in lines[1] if r["text"] != next(x["text"] for x in lines[0] if x["doc_id"] == r["doc_id"]))

    groups = brute([(r["doc_id"], r["text"]) for r in near[0]], 5, 80)
    assert {r["doc_id"] for r in near[1]} == {i for i, (_, c) in groups.items() if i == c}

    key = lambda r: r["doc_id"]
    assert sorted(mix[0], key=key) == sorted(mix[1], key=key)

    tok, texts = Tokenizer.from_file(word_vocabulary()), {r["doc_id"]: r["text"] for r in packs[0]}
    own: dict = {}
    for r in sorted(packs[1], key=lambda r: r["start"]):
        own.setdefault(r["doc_id"], []).append(np.frombuffer(r["ids"], "<u4"))
    assert {i: np.concatenate(p).tolist() for i, p in own.items()} == {i: [*tok.encode(t, add_special_tokens=False).ids, END_ID] for i, t in texts.items()}


def test_an_empty_table_passes_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
