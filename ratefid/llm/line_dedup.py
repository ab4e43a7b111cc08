"""Reversible line dedup: sharded cuckoo filters backed by exact reference counts."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, join_counted, new_path, parts, written
from .shingles import BLANKS, SMALL

SLOTS = 4
KICKS = 500


class CuckooFilter:
    """A set of 64-bit hashes held as 16-bit fingerprints, each in one of two buckets of four; entries can be removed."""

    def __init__(self, n_buckets: int = 64, table: np.ndarray | None = None):
        self.table = np.zeros((n_buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        return cls(1 << max(4, int(np.ceil(np.log2(max(1, n) / SLOTS / 0.8)))))

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = hashes.astype(np.uint64)
        mark = (h >> np.uint64(48)).astype(np.uint16)
        mark = np.where(mark == 0, np.uint16(1), mark)
        one = (h & np.uint64(len(self.table) - 1)).astype(np.int64)
        return mark, one, one ^ self._hop(mark)

    def _hop(self, mark: np.ndarray) -> np.ndarray:
        return (mark.astype(np.int64) * 0x5BD1E995) & (len(self.table) - 1)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(hashes)
        return ((self.table[one] == mark[:, None]) | (self.table[two] == mark[:, None])).any(axis=1)

    def _exchange(self, at: np.ndarray, was: np.ndarray, to: np.ndarray) -> np.ndarray:
        """In bucket ``at`` of each entry, one slot that holds ``was`` gets ``to``, each slot for one entry; says which entries found none."""
        order = np.lexsort((was, at))
        at, was, to = at[order], was[order], to[order]
        new = np.r_[True, (at[1:] != at[:-1]) | (was[1:] != was[:-1])] if len(at) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        rank = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
        nth = np.cumsum(self.table[at] == was[:, None], axis=1)
        found = rank < nth[:, -1]
        self.table[at[found], np.argmax(nth == rank[:, None] + 1, axis=1)[found]] = to[found]
        left = np.zeros(len(at), bool)
        left[order] = ~found
        return left

    def insert(self, hashes: np.ndarray) -> bool:
        """False if there was no room: entries are lost then, and the filter must be made anew from all its keys, larger."""
        mark, one, two = self._places(hashes)
        left = self._exchange(one, np.zeros_like(mark), mark)
        mark, at = mark[left], two[left]
        left = self._exchange(at, np.zeros_like(mark), mark)
        mark, at = mark[left], at[left]
        random = np.random.default_rng(len(hashes))
        for _ in range(KICKS):
            if not len(mark):
                return True
            _, some = np.unique(at, return_index=True)
            slot = random.integers(0, SLOTS, len(some))
            moved = self.table[at[some], slot]
            self.table[at[some], slot] = mark[some]
            mark[some], at[some] = moved, at[some] ^ self._hop(moved)
            left = self._exchange(at, np.zeros_like(mark), mark)
            mark, at = mark[left], at[left]
        return not len(mark)

    @classmethod
    def holding(cls, hashes: np.ndarray) -> CuckooFilter:
        """A filter that holds all these hashes: twice the size until they fit."""
        made = cls.sized(len(hashes))
        while not made.insert(hashes):
            if len(made.table) > 64 * max(16, len(hashes)):
                raise ValueError(f"no cuckoo filter holds these {len(hashes)} hashes: too many are alike")
            made = cls(2 * len(made.table))
        return made

    def delete(self, hashes: np.ndarray) -> None:
        mark, one, two = self._places(hashes)
        left = self._exchange(one, mark, np.zeros_like(mark))
        self._exchange(two[left], mark[left], np.zeros_like(mark[left]))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: str, least: int) -> dict[bytes, list[int]]:
    """128 bits of each line without outer blanks, A-Z made small, that has ``least`` code points: its places in the text."""
    held: dict[bytes, list[int]] = {}
    for place, line in enumerate(text.encode("utf-8", "surrogatepass").translate(SMALL).split(b"\n")):
        if len(line) >= least:
            line = line.strip(BLANKS)
            # A code point has four bytes at most.
            if len(line) >= 4 * least or len(line) >= least and len(line.decode("utf-8", "surrogatepass")) >= least:
                held.setdefault(md5(line).digest(), []).append(place)
    return held


def _hash64(keys: pd.Series) -> np.ndarray:
    """The half of a key that its shard is not taken from, so the keys of one shard have all buckets."""
    return np.frombuffer(b"".join(bytes(k)[8:16] for k in keys), np.uint64)


class LineIndex:
    """What a corpus's lines need for dedup that can be taken back.

    The log has a row (shard, key, doc_id, delta) for each document that came (+1) or went (-1) with a line; its sums are the
    exact reference counts. For each shard of the keys there is a cuckoo filter with the keys that at least ``min_docs``
    documents hold; it settles most lines of a document without the counts, and what it lets through is checked with them. A filter that
    has no room for its keys is made anew from the exact counts, as large as holds them all.

    A batch only counts the keys that it has anew: the log is sorted by shard, so of the older batches the pages of other shards
    are not read, and filters of shards without a change are left. Shards are as many as keep one filter and the lines that ask
    it small; their number is fixed when the index is made.
    """

    LOG = "shard int, key binary, doc_id long, delta int"

    def __init__(self, spark: SparkSession, shards: int, min_docs: int = 3, min_chars: int = 20):
        self.spark, self.shards, self.min_docs, self.min_chars = spark, shards, min_docs, min_chars
        self.log_path = new_path(spark, "line-log")
        self.batches = 0
        self.refs: DataFrame | None = None
        self.filters: DataFrame | None = None

    def keys(self, docs: DataFrame) -> DataFrame:
        """doc_id, row (a hash of the text), shard, key and places of each distinct line of a text that is long enough."""
        shards, least = self.shards, self.min_chars

        def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts(batches, 2, 1 << 22):
                owner, keys, places = [], [], []
                for i, text in enumerate(part.column(2).to_pylist()):
                    held = line_keys(text or "", least)
                    owner += [i] * len(held)
                    keys += held.keys()
                    places += held.values()
                shard = np.frombuffer(b"".join(keys), np.dtype("<u8"))[::2] % np.uint64(shards)
                at = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), part.column(1).take(at), pa.array(shard.astype(np.int32)), pa.array(keys, pa.binary()), pa.array(places, pa.list_(pa.int32()))],
                    names=["doc_id", "row", "shard", "key", "places"],
                )

        rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), "text")
        return rows.mapInArrow(job, "doc_id long, row long, shard int, key binary, places array<int>")

    def insert(self, docs: DataFrame) -> None:
        self._apply(docs, 1)

    def delete(self, docs: DataFrame) -> None:
        """Take back documents that were inserted, with the texts that they had then."""
        self._apply(docs, -1)

    def _log(self, batches: str) -> DataFrame:
        return self.spark.read.schema(self.LOG).parquet(f"{self.log_path}/{batches}")

    def _apply(self, docs: DataFrame, delta: int) -> None:
        new = self.keys(docs).where("doc_id IS NOT NULL").select("shard", "key", "doc_id").distinct().withColumn("delta", F.lit(delta))
        new.sortWithinPartitions("shard").write.parquet(f"{self.log_path}/{self.batches}")
        log, old, had = self._log("*"), self.refs, self.filters
        if self.batches:
            asked = self._log(str(self.batches)).select("shard", "key").distinct()
            log = self._of_shards(log, asked).join(asked, ["shard", "key"], "left_semi")
            same, old = old.join(asked, ["shard", "key"], "left_anti"), old.join(asked, ["shard", "key"], "left_semi")
        held = log.groupBy("shard", "key", "doc_id").agg(F.sum("delta").alias("held")).where("held > 0")
        refs = held.groupBy("shard", "key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
        refs = written(refs.where(F.col("n_docs") >= self.min_docs), "line-refs")
        one = lambda rows, n: rows.select("shard", "key", F.lit(n).alias("delta"))
        if self.batches:
            changes = one(refs.join(old, ["shard", "key"], "left_anti"), 1).unionByName(one(old.join(refs, ["shard", "key"], "left_anti"), -1))
            changes = written(changes, "line-changes")
            touched = changes.select("shard").distinct()
            rest, had = had.join(touched, "shard", "left_anti"), had.join(touched, "shard", "left_semi")
        else:
            changes, had = one(refs, 1), self.spark.createDataFrame([], "shard int, filter binary")
        changed = changes.groupBy("shard").cogroup(had.groupBy("shard")).applyInPandas(_updated, "shard int, filter binary, full boolean")
        changed = written(changed, "line-filters")
        every = written(same.unionByName(refs), "line-refs") if self.batches else refs
        good = changed.where("NOT full").drop("full")
        if not changed.where("full").isEmpty():  # these are made anew from the exact counts, as large as holds them
            again = every.join(changed.where("full").select("shard"), "shard", "left_semi").select("shard", "key")
            made = again.groupBy("shard").applyInPandas(_rebuilt, "shard int, filter binary")
            good = written(good.unionByName(made), "line-filters")
        self.refs, self.filters = every, written(rest.unionByName(good), "line-filters") if self.batches else good
        self.batches += 1

    def _of_shards(self, log: DataFrame, asked: DataFrame) -> DataFrame:
        """The log's rows of the shards that ``asked`` has, by a filter that reaches the scan if these are few."""
        few = [r.shard for r in asked.select("shard").distinct().limit(1_001).collect()]
        return log.where(F.col("shard").isin(few)) if len(few) <= 1_000 else log

    def dropped(self, docs: DataFrame) -> DataFrame:
        """doc_id, row and places of each distinct line of ``docs`` that goes."""
        refs = self.refs.select("key", "n_docs", "last_doc")
        total = refs.agg(F.sum("n_docs")).first()[0] or 0
        hot = refs.where(F.col("n_docs") > max(1_000, total // 10_000)).select("key", F.lit(True).alias("hot"))
        lines = self.keys(docs).join(F.broadcast(hot), "key", "left")  # at most 10,000 keys; the filters need not be asked about them
        asked = lines.where("hot IS NULL").drop("hot").groupBy("shard").cogroup(self.filters.groupBy("shard"))
        asked = asked.applyInArrow(_probe, "doc_id long, row long, key binary, places array<int>")
        known = lines.where("hot").select("doc_id", "row", "key", "places")
        found = join_counted(asked.unionByName(known), refs, "key", "n_docs", "doc_id").where("n_docs IS NOT NULL")
        return found.where(~F.col("doc_id").eqNullSafe(F.col("last_doc"))).select("doc_id", "row", "places")

    def dedup(self, docs: DataFrame) -> DataFrame:
        """``docs`` with kept (the lines that stay, in an array), n_lines and n_dropped; columns of these names are replaced.

        Null and empty texts are one empty line. A row without doc_id counts for no line and loses each that goes elsewhere;
        rows that share a doc_id are one document, and each loses its own lines. No rows give no rows.
        """
        gone = self.dropped(docs).groupBy("doc_id", "row").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("gone"))
        own = docs.select(F.struct("*").alias("caller"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64("text").alias("own_row"), lines_of(F.col("text")).alias("lines"))
        out = own.join(gone, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_row") == F.col("row")), "left")
        places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
        kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(places, lambda i: F.get(F.col("lines"), i)))
        facts = {
            "kept": kept,
            "n_lines": F.size("lines").cast("long"),
            "n_dropped": F.coalesce(F.size(F.when(F.col("gone").isNotNull(), F.col("gone"))), F.lit(0)).cast("long"),
        }
        out = out.select("caller", F.struct(*[c.alias(k) for k, c in facts.items()]).alias("facts"))
        return out.select(*[F.col("caller").getField(c).alias(c) for c in docs.columns if c not in facts], "facts.*")


def _updated(key, changes: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
    more, less = _hash64(changes.key[changes.delta > 0]), _hash64(changes.key[changes.delta < 0])
    if not len(have):
        return pd.DataFrame({"shard": [int(key[0])], "filter": [CuckooFilter.holding(more).dump()], "full": [False]})
    held = CuckooFilter.load(have["filter"].iloc[0])
    held.delete(less)
    fits = held.insert(more)
    return pd.DataFrame({"shard": [int(key[0])], "filter": [held.dump()], "full": [not fits]})


def _rebuilt(key: tuple, refs: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"shard": [int(key[0])], "filter": [CuckooFilter.holding(_hash64(refs.key)).dump()]})


def _probe(key, lines: pa.Table, filters: pa.Table) -> pa.Table:
    out = lines.select(["doc_id", "row", "key", "places"])
    if not filters.num_rows or not lines.num_rows:
        return out.slice(0, 0)
    held = CuckooFilter.load(filters.column("filter")[0].as_py())
    return out.filter(pa.array(held.contains(_hash64(out.column("key").to_pylist()))))


def shards_for(docs: DataFrame) -> int:
    """As many shards as leave each the lines of about 2,000 documents."""
    return max(16, docs.count() // 2_000)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated lines; null texts, repeats and rows without doc_id as ``LineIndex.dedup`` says."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    index = LineIndex(spark, shards_for(docs))
    index.insert(docs)
    out = index.dedup(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH lines AS (
    SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
    SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), refs AS (
    SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), judged AS (
    SELECT doc_id, pos, line, last_doc IS NOT NULL AND doc_id <> last_doc AS gone FROM keyed LEFT JOIN refs USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
