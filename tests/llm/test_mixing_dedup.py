import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from ratefid.llm.exact_dedup import DigestIndex
from ratefid.llm.line_dedup import CuckooFilter, LineIndex
from ratefid.llm.mixing import mixed


def test_every_prefix_is_within_a_block_of_its_weights(spark):
    sizes = {"a": 700, "b": 130, "c": 61, "d": 5}
    rows = [(i, s) for s, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame([(k, s) for k, (_, s) in enumerate(rows)], "doc_id long, source string")
    shares = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "source string, share long")
    got = mixed(docs, shares, block_rows=4).select("doc_id", "source", "_block", "_place", "_slot").collect()
    assert sorted(r.doc_id for r in got) == list(range(len(rows)))
    slots = sorted({(r._slot, r.source) for r in got})
    assert [s for s, _ in slots] == list(range(len(slots)))
    weight = {"a": 5, "b": 3, "c": 2, "d": 1}
    left = {s: -(-n // 4) for s, n in sizes.items()}
    done, due = dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0.0)
    at = 0
    while any(left.values()):
        cycle = {s: min(weight[s], left[s]) for s in sizes}
        total = sum(cycle.values())
        for _ in range(total):
            done[slots[at][1]] += 1
            for s in sizes:
                due[s] += cycle[s] / total
            assert all(abs(done[s] - due[s]) < 1 for s in sizes)
            at += 1
        for s in sizes:
            left[s] -= cycle[s]


def test_mixing_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, "a"), (2, "")], "doc_id long, source string").withColumn("slot", F.lit("x"))
    got = mixed(docs).collect()
    assert len(got) == 4 and "slot" in got[0].asDict()
    assert mixed(docs.limit(0)).count() == 0


def test_mixing_keeps_callers_columns(spark):
    docs = spark.createDataFrame([(i if i % 5 else None, f"s{i % 3}") for i in range(300)], "doc_id long, source string")
    for name in ("_source", "_share", "_order", "_bucket", "_row", "_id", "_slot", "_made", "_n", "slot"):
        docs = docs.withColumn(name, F.lit("x"))
    got = mixed(docs).collect()
    assert len({(r._slot, r._place) for r in got}) == 300 and {r._source for r in got} == {"x"} == {r.slot for r in got}


def test_digest_index_is_incremental(spark):
    one = spark.createDataFrame([(5, "a  b"), (3, "a\tb"), (4, None), (6, ""), (None, "z"), (7, " ")], "doc_id long, text string").withColumn("digest", F.lit(1))
    index = DigestIndex(spark, n_buckets=4)
    said = lambda docs: {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in index.resolve(docs).collect()}
    index.ingest(one, "one")
    assert said(one) == {(5, 3, 2, False), (3, 3, 2, True), (4, 4, 2, True), (6, 4, 2, False), (None, None, 1, True), (7, 7, 1, True)}
    two = spark.createDataFrame([(1, "a b"), (9, "new"), (9, "new")], "doc_id long, text string")
    for _ in range(2):  # a retried batch counts once
        index.ingest(two, "two")
        index.ingest(one, "one")
    assert said(two) == {(1, 3, 3, False), (9, 9, 2, True)} and (5, 3, 3, False) in said(one)
    index.ingest(spark.createDataFrame([(0, "a b" + " x" * 500_000), (11, "a b")], "doc_id long, text string"), "three")
    assert (1, 3, 4, False) in said(two) and index.table().where("kept").count() == 6
    index.ingest(one.limit(0))
    assert said(one.limit(0)) == set()
    assert {r.text_sha256 for r in index.resolve(one.where("doc_id = 5")).collect()} == {hashlib.sha256(b"a b").hexdigest()}
    index.drop()
    assert not spark.catalog.tableExists(index.name)


def test_cuckoo_filter_inserts_and_deletes():
    import numpy as np

    keys = np.array([random.Random(i).getrandbits(64) for i in range(3000)], np.uint64)
    f = CuckooFilter.sized(3000)
    assert f.insert(keys) and f.contains(keys).all()
    other = np.array([random.Random(10_000 + i).getrandbits(64) for i in range(20_000)], np.uint64)
    assert f.contains(other).mean() < 0.001
    f.delete(keys[:1000])
    assert CuckooFilter.load(f.dump()).contains(keys[1000:]).all() and f.contains(keys[:1000]).mean() < 0.01


def test_cuckoo_filter_holds_keys_of_any_residue():
    """Nearly full filters of hashes that agree in their low bits or that come in batches lose none, or say so."""
    import numpy as np

    random_hashes = np.random.default_rng(5).integers(0, 1 << 63, 400_000, np.uint64)
    for step in (1, 16, 64, 100):
        some = random_hashes[random_hashes % np.uint64(step) == 3 % step][:3_200]
        assert CuckooFilter.holding(some).contains(some).all()
    f = CuckooFilter(1024)
    assert all(f.insert(random_hashes[i : i + 80]) for i in range(0, 3_840, 80)) and f.contains(random_hashes[:3_840]).all()
    assert not f.insert(random_hashes[3_840:5_000])
    f = CuckooFilter.holding(np.r_[random_hashes[:500], random_hashes[:500]])
    f.delete(random_hashes[:500])
    assert f.contains(random_hashes[:500]).all()
    f.delete(random_hashes[:500])
    assert not f.table.any() and CuckooFilter.holding(random_hashes[:0]).insert(random_hashes[:0])


@pytest.mark.parametrize("shards", [16, 17, 64])
def test_thousands_of_heavy_lines_all_go(spark, shards):
    """6,500 lines of four documents in batches: filters outgrow their size and are made anew, then half of the lines are taken back."""
    df = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    text = lambda a, b: "\n".join(f"this is the long line with number {i}" for i in range(a, b))
    index = LineIndex(spark, shards)
    index.insert(df([(i, text(0, 300)) for i in range(4)]))
    index.insert(df([(i, text(300, 6_500)) for i in range(10, 14)]))
    rows = [(i, text(0, 300)) for i in range(4)] + [(i, text(300, 6_500)) for i in range(10, 14)]
    assert {r.doc_id: r.n_dropped for r in index.dedup(df(rows)).collect()} == {0: 300, 1: 300, 2: 300, 3: 0, 10: 6_200, 11: 6_200, 12: 6_200, 13: 0}
    index.delete(df([(13, text(300, 6_500)), (12, text(300, 6_500))]))
    index.insert(df([(20, text(6_000, 6_200))]))
    rows = rows[:6] + [(20, text(6_000, 6_200))]
    assert {r.doc_id: r.n_dropped for r in index.dedup(df(rows)).collect()} == {0: 300, 1: 300, 2: 300, 3: 0, 10: 200, 11: 200, 20: 0}


def test_line_dedup_equals_sql_at_a_larger_size(spark):
    import duckdb

    from ratefid.llm.line_dedup import OP4_SQL, op4_line_dedup

    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.1/documents.parquet'")
    got = op4_line_dedup(spark, "/root/testdata/sf0.1").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(OP4_SQL).fetchall())


def brute_lines(docs):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\f\r"))
    holders = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(i)
    gone = {k: max(h) for k, h in holders.items() if len(h) >= 3}
    return {i: "\n".join(x for x in (t or "").split("\n") if not (key(x) in gone and gone[key(x)] != i)) for i, t in docs}


def test_line_dedup_can_be_taken_back(spark):
    rng = random.Random(2)
    lines = [f"line number {i} " + "x" * rng.randrange(0, 20) for i in range(30)]
    rows = [(i, "\n".join(rng.choice([x, x.upper(), f" {x}\t"]) for x in rng.choices(lines, k=8))) for i in range(40)] + [(98, None), (99, "")]
    df = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    index = LineIndex(spark, shards=3)
    texts = lambda r: {x.doc_id: x.t for x in index.dedup(df(r)).select("doc_id", F.array_join("kept", "\n").alias("t")).collect()}
    index.insert(df(rows[:25]))
    assert texts(rows[:25]) == brute_lines(rows[:25])
    index.insert(df(rows[25:]))
    assert texts(rows) == brute_lines(rows)
    index.delete(df(rows[10:30]))
    assert texts(rows[:10] + rows[30:]) == brute_lines(rows[:10] + rows[30:])


def test_line_dedup_odd_rows(spark):
    """Nulls, repeated rows, clashing columns, a very long text, one line a hundred thousand times in a document."""
    line = "this line is in many documents"
    rows = [(1, line), (2, f"{line}\nshort"), (2, f"{line}\nshort"), (3, f"{line}\n" * 100_000 + "own " * 50_000), (None, f"a\n{line.upper()} "), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("gone", "row", "lines", "caller", "own_id", "_id", "_gone", "kept", "places", "key"):
        docs = docs.withColumn(name, F.lit(1))
    index = LineIndex(spark, shards=2)
    index.insert(docs)
    got = index.dedup(docs).withColumn("t", F.array_join("kept", "\n")).collect()
    assert sorted((r.doc_id or -1, r.t[:10], r.n_dropped) for r in got) == sorted([(1, "", 1), (2, "short", 1), (2, "short", 1), (3, line[:10], 0), (-1, "a", 1), (5, "", 0), (6, "", 0)])
    empty = spark.createDataFrame([], "doc_id long, text string")
    none = LineIndex(spark, shards=2)
    none.insert(empty)
    assert none.dedup(empty).count() == 0 and index.dedup(empty).count() == 0


def test_a_small_batch_reads_its_own_shards(spark):
    """The log's scan of a later batch has a filter on its shards, and other shards' filters are left as they are."""
    df = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    index = LineIndex(spark, shards=64)
    index.insert(df([(i, "\n".join(f"line {j} of all of the documents" for j in range(200))) for i in range(3)]))
    before = {r.shard: bytes(r.filter) for r in index.filters.collect()}
    batch = df([(10 + i, f"one line of this batch {i % 2} only") for i in range(10)])
    own = {r.shard for r in index.keys(batch).select("shard").distinct().collect()}
    plan = index._of_shards(index._log("*"), index.keys(batch))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(shard" in plan or "PushedFilters: [EqualTo(shard" in plan
    index.insert(batch)
    after = {r.shard: bytes(r.filter) for r in index.filters.collect()}
    assert {s for s in after if after[s] != before.get(s)} <= own and len(own) <= 2
