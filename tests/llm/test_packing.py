import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ratefid.llm.packing import END_ID, Windows, WordTokenizer, in_table_order, op9_packing, packed, word_vocabulary

ODD = ["", " \n ", "it's. 's .'s a.'s dogs'. I'll", "a.b,c;D:e!F?g 2.0 a2.b3", "é.è e.́x é. ́.a", "<|endoftext|> x.<|EndOfText|>.y<|startoftext|>", "a\x1cb\x85c\xa0d\x0be", "İstanbul ΣΑΣ. ẞ ﬁ"]


def test_ids_equal_the_tokenizers():
    texts = ODD + ["".join(random.Random(i).choices("abcDE.,;:!?'́é \n2<|>ſK", k=200)) for i in range(200)] + ["x y." * 50_000]
    whole, own = Tokenizer.from_file(word_vocabulary()), WordTokenizer(word_vocabulary())
    for at in range(0, len(texts), 50):
        part = texts[at : at + 50]
        for text, ids in zip(part, own.texts(pa.array(part)), strict=True):
            assert ids.tolist() == [*whole.encode(text, add_special_tokens=False).ids, END_ID], text[:80]


def test_round_trip(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = op9_packing(spark, d).collect()
    tok = Tokenizer.from_file(word_vocabulary())
    pieces: dict = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert pieces.keys() == docs.keys()
    for doc, own in pieces.items():
        ids = np.array([*tok.encode(docs[doc] or "", add_special_tokens=False).ids, END_ID], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    windows: dict = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)


def test_the_rule_matches_trying_every_level():
    w, counts, rng = Windows(2048, 0, 32), np.zeros(33, int), random.Random(3)
    for _ in range(3000):
        n, tops, taken = rng.randrange(1, 2048), w.tops.copy(), 2048 - w.short[0] if w.short else 0
        rest = n - min(n, taken)
        if rest:
            best = None
            for level in range(32):
                if level and not counts[level] or tops[level] + rest > 2048:
                    continue
                after = counts.copy()
                after[level] -= level > 0
                after[-(-(tops[level] + rest) // 64)] += 1
                key = (int((after[1:32] ** 2).sum()), -level)
                best = min(best or (key, after), (key, after), key=lambda x: x[0])
            counts = best[1]
        w.place(0, np.zeros(n, np.uint32))
        assert (w.counts[1:] == counts[1:32]).all()


def test_windows_are_filled_by_the_rule_and_the_end_moves_little():
    rng, w, rows, total = random.Random(5), Windows(2048, 0), [], 0
    for i in range(20_000):
        ids = np.arange(rng.randrange(1, 4000), dtype=np.uint32)
        total += len(ids)
        w.place(i, ids)
        rows += w.taken()
    w.finish()
    rows += w.taken()
    assert sum(len(r[2]) for r in rows) == total
    assert w.placed["rule"] > 0.3 * total and w.placed["end"] < 0.01 * total and w.placed["rest"] < 0.05 * total
    sizes: dict = {}
    for r in rows:
        sizes[r[4]] = sizes.get(r[4], 0) + len(r[2])
    assert all(x & (x - 1) == 0 for x in sizes.values()) and sum(x < 2048 for x in sizes.values()) <= 11


def test_a_table_is_packed_in_the_order_it_was_written(spark, tmp_path):
    docs = spark.range(40_000).selectExpr("id AS doc_id", "concat('word ', id % 7) AS text", "xxhash64(id) AS slot")
    docs.repartitionByRange(16, "slot").sortWithinPartitions("slot").drop("slot").write.parquet(str(tmp_path / "t"))
    rows = packed(in_table_order(spark.read.parquet(str(tmp_path / "t"))), word_vocabulary()).join(docs, "doc_id").select("sequence_id", "slot").collect()
    assert len({r.sequence_id >> 32 for r in rows}) > 1
    last: dict = {}
    for r in rows:
        low, high = last.get(r.sequence_id >> 32, (r.slot, r.slot))
        last[r.sequence_id >> 32] = (min(low, r.slot), max(high, r.slot))
    ranges = [last[k] for k in sorted(last)]
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))


def test_table_order_keeps_clashing_columns(spark, tmp_path):
    docs = spark.range(20).selectExpr("id AS doc_id", "'a b' AS text", "1 AS _place", "2 AS place", "3 AS caller")
    docs.write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    got = in_table_order(table)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.collect()))
    assert in_table_order(docs).columns == docs.columns


def test_nulls_ties_long_texts_and_empty_tables(spark):
    rows = [(1, None), (1, ""), (None, "a b"), (2, "word " * 10_000), (2, "word " * 10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("x")).coalesce(1)
    got = packed(docs, word_vocabulary()).toPandas()
    assert got.length.sum() == 1 + 1 + 3 + 2 * 10_001 and got[got.doc_id.isna()].length.sum() == 3
    assert packed(docs.limit(0), word_vocabulary()).count() == 0
