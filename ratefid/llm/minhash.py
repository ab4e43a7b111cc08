"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard similarity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected, documents, join_counted, written
from .shingles import mix64, text_shingles, text_words

#: How often a pair just at the threshold may share no band.
MISS = 1e-7
#: Documents of one side in a block of the exact comparison.
BLOCK = 1024
#: Ids that may be broadcast: 16 MB.
FEW = 1_000_000
#: The circular shift between neighbouring coordinates; odd, so all shifts differ.
STEP = 0x9E3779B1


def n_bands(threshold: float, rows: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**rows))


def _second(x: np.ndarray) -> np.ndarray:
    """The second permutation, of 32-bit words, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Coordinate i is the least value of the second permutation, shifted circularly i steps, after the first one."""
    first = mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)).astype(np.uint32)
    shifts = np.arange(size, dtype=np.uint32) * np.uint32(STEP)
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(first), 4096):
        part = first[at : at + 4096]
        step = max(1, 65536 // len(part))
        for i in range(0, size, step):
            low = _second(part[None, :] + shifts[i : i + step, None]).min(axis=1)
            np.minimum(out[i : i + step], low, out=out[i : i + step])
    return out


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` coordinates; keys of different bands differ too."""
    table = values.reshape(-1, rows).astype(np.uint64)
    key = np.arange(1, len(table) + 1, dtype=np.uint64)
    for i in range(rows):
        key = mix64(key * np.uint64(0xC2B2AE3D27D4EB4F) + table[:, i])
    return key.view(np.int64)


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, hash of the word sequence (128 bits), number of shingles, band keys and sketch (null without shingles).

    The sketch is the last byte of each coordinate.
    """

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, counts, keys, sketches = batch.column(0), [], [], [], []
            for text in batch.column(1).to_pylist():
                w = text_words(text or "")
                s = text_shingles(w, words)
                place = mix64(np.arange(1, len(w) + 1, dtype=np.uint64))
                hashes.append(np.array([np.sum(w * (place | np.uint64(1))), np.sum(mix64(w ^ place))], np.uint64).tobytes())
                counts.append(len(s))
                values = signature(s, bands * rows) if len(s) else None
                keys.append(None if values is None else band_keys(values, rows))
                sketches.append(None if values is None else values.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(hashes, pa.binary()), pa.array(counts, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                names=["doc_id", "h", "n_shingles", "bands", "sketch"],
            )

    schema = "doc_id long, h binary, n_shingles long, bands array<long>, sketch binary"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(job, schema)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """rep, shingles: the full sets, as sorted 64-bit hashes."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [text_shingles(text_words(t or ""), words).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "shingles"])

    return docs.select("rep", "text").mapInArrow(job, "rep long, shingles array<long>")


def least_agreement(threshold: float, size: int) -> int:
    """Equal bytes that sketches of two sets at the threshold have at least, six standard deviations below the mean."""
    p = threshold + (1 - threshold) / 256
    return max(1, math.floor(size * p - 6 * math.sqrt(size * p * (1 - p))))


def _sketches(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, size)


def likely_pairs(pairs: DataFrame, sketches: DataFrame, least: int, size: int) -> DataFrame:
    """The pairs (leader, rep) whose sketches agree in at least ``least`` places."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            equal = (_sketches(batch.column(2), size) == _sketches(batch.column(3), size)).sum(axis=1)
            yield batch.select([0, 1]).filter(pa.array(equal >= least))

    first = sketches.select(F.col("rep").alias("leader"), F.col("sketch").alias("one"))
    joined = pairs.join(first, "leader").join(sketches, "rep").select("leader", "rep", "one", "sketch")
    return joined.mapInArrow(job, "leader long, rep long")


def _likely_rows(least: int, size: int):
    """Of a block pair, the rows that agree with some row of another component well enough to be compared in full."""

    def job(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        comp, marks = table.column("component").to_numpy(), _sketches(table.column("sketch"), size)
        side, use = np.flatnonzero(~asks), np.zeros(len(asks), bool)
        for q in np.flatnonzero(asks):
            near = side[((marks[side] == marks[q]).sum(axis=1) >= least) & (comp[side] != comp[q])]
            if len(near):
                use[q] = True
                use[near] = True
        return table.select(["key", "i", "j", "rep", "component", "asks"]).filter(pa.array(use))

    return job


def _block_links(percent: int):
    """Compare the documents asked about with all others of a block pair; returns links that join different components."""

    def job(table: pa.Table) -> pa.Table:
        rep, comp = table.column("rep").to_numpy(), table.column("component").to_numpy()
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        lists = table.column("shingles").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        size = np.diff(ends)
        side = np.flatnonzero(~asks)
        owner = np.repeat(np.arange(len(rep)), size)
        flat = flat[ends[0] : ends[-1]]
        ends = ends - ends[0]
        mine = ~asks[owner]
        values, who = flat[mine], owner[mine]
        order = np.argsort(values, kind="stable")
        values, who = values[order], who[order]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        links: list[tuple[int, int]] = []
        for q in np.flatnonzero(asks):
            own = flat[ends[q] : ends[q + 1]]
            low, high = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
            n = high - low
            if not n.sum():
                continue
            at = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            both = np.bincount(who[at], minlength=len(rep))[side]
            close = side[(100 * both >= percent * (size[side] + len(own) - both)) & (both > 0) & (comp[side] != comp[q])]
            for d in close:
                a, b = find(int(comp[q])), find(int(comp[d]))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    links.append((int(comp[q]), int(comp[d])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return job


def _bytes(column: str) -> Column:
    """The eight bytes of a bigint."""
    return F.unhex(F.lpad(F.hex(column), 16, "0"))


def _semi(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows with a ``rep`` of ``wanted``, by broadcast if these are few enough, else by a shuffle of both."""
    return rows.join(F.broadcast(wanted) if wanted.count() <= FEW else wanted, "rep", "left_semi")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """The shingle sets of the wanted documents alone, from a second look at the texts."""
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text")
    return written(shingle_sets(_semi(texts, written(wanted, "wanted")), words), "sets")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, rows: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents whose sets of distinct ``words``-word shingles have 100 * intersection >= ``percent`` * union are linked, and a
    component is what links connect. Equal word sequences collapse to the smallest doc_id first. In each bucket of equal band keys all
    are compared with the smallest id, then, where more than one component is left, every pair of different components in
    blocks inside tasks, so no task sees more than two blocks. Whole sets are only fetched for documents whose sketches agree as
    pairs at the threshold do but for six standard deviations; a link always rests on whole sets.

    Null and empty texts have no shingles and are linked with nothing: component_id is the doc_id. A row without doc_id takes
    part in no link; its component_id is null and it is kept. Rows that share a doc_id are one document, linked by any of
    their texts. Other columns are not read. No rows give no rows.
    """
    bands = n_bands(percent / 100, rows)
    size, least = bands * rows, least_agreement(percent / 100, bands * rows)
    sig = written(signatures(docs, words, bands, rows), "signatures")
    usable = sig.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(usable.groupBy("h").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_rows")), "classes")
    reps = usable.join(classes.select("h", F.col("rep").alias("doc_id")), ["h", "doc_id"], "left_semi")
    keys = reps.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("band"))
    buckets = keys.groupBy("band").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("n"), F.max("rep").alias("top"))
    buckets = written(buckets.where("leader <> top").select(_bytes("band").alias("key"), "leader", "n"), "buckets")
    members = join_counted(keys.select(_bytes("band").alias("key"), "rep"), buckets, "key", "n", "rep")
    members = written(members.where("leader IS NOT NULL").distinct(), "members")
    wanted = members.select("rep").distinct()
    sketches = _semi(usable.withColumnRenamed("doc_id", "rep"), wanted).join(classes.select("h", "rep"), ["h", "rep"], "left_semi")
    sketches = written(sketches.groupBy("rep").agg(F.first("sketch").alias("sketch")), "sketches")

    pairs = members.where("rep <> leader").select("leader", "rep").distinct()
    pairs = written(likely_pairs(pairs, sketches, least, size), "likely-pairs")
    sets = _sets(docs, pairs.select("rep").unionByName(pairs.select(F.col("leader").alias("rep"))).distinct(), words)
    first = sets.select(F.col("rep").alias("leader"), F.col("shingles").alias("one"))
    shared = F.size(F.array_intersect("one", "shingles"))
    union = F.size("one") + F.size("shingles") - shared
    close = pairs.join(first, "leader").join(sets, "rep").where(100 * shared >= percent * union)
    stars = written(connected(close.select(F.col("rep").alias("a"), F.col("leader").alias("b"))), "stars")

    placed = members.join(stars.select(F.col("node").alias("rep"), "component"), "rep", "left")
    placed = placed.withColumn("component", F.coalesce("component", "rep"))
    leader = stars.select(F.col("node").alias("leader"), F.col("component").alias("main"))
    placed = placed.join(leader, "leader", "left").withColumn("main", F.coalesce("main", "leader"))
    placed = written(placed.withColumn("minor", F.col("component") != F.col("main")), "placed")
    open_ = placed.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_all"),
        F.sum(F.col("minor").cast("long")).alias("n_minor"),
        F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who"),
    )
    # In a bucket of two all are compared. Buckets with the same members count once.
    open_ = open_.where("n_all > 2 AND n_minor > 0").groupBy("who", "n_all", "n_minor").agg(F.min("key").alias("key"))
    open_ = written(open_.drop("who"), "open-buckets")
    rest = join_counted(placed.drop("n"), open_.withColumn("n", F.col("n_all")), "key", "n", "rep").where("n_all IS NOT NULL")
    chunks, minors = F.ceil(F.col("n_all") / BLOCK).cast("int"), F.ceil(F.col("n_minor") / BLOCK).cast("int")
    own = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    asks = rest.where("minor").select("key", "rep", "component", F.lit(True).alias("asks"), own(minors).alias("i"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("j"))
    told = rest.select("key", "rep", "component", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), minors - 1)).alias("i"), own(chunks).alias("j"))
    blocks = asks.unionByName(told).join(sketches, "rep").groupBy("key", "i", "j")
    blocks = blocks.applyInArrow(_likely_rows(least, size), "key binary, i int, j int, rep long, component long, asks boolean")
    blocks = written(blocks, "likely-blocks")
    sets = _sets(docs, blocks.select("rep").distinct(), words)
    more = blocks.join(sets, "rep").groupBy("key", "i", "j").applyInArrow(_block_links(percent), "a long, b long")
    merged = connected(more)
    top = stars.join(merged.withColumnRenamed("component", "final"), stars["component"] == merged["node"], "left").select(
        stars["node"].alias("rep"), F.coalesce("final", stars["component"]).alias("component_id")
    )
    alone = merged.join(stars, "node", "left_anti").select(F.col("node").alias("rep"), F.col("component").alias("component_id"))
    found = written(classes.join(top.unionByName(alone), "rep", "left").select("h", F.coalesce("component_id", "rep").alias("component_id"), "n_rows"), "found")
    out = join_counted(sig.select("doc_id", "n_shingles", "h"), found, "h", "n_rows", "doc_id")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = out.withColumn("component_id", F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class at 3 words and 0.85; nulls, short texts, repeats and empty tables as ``near_duplicates`` says."""
    return near_duplicates(documents(spark, sf_dir), words=3, percent=85, rows=6)


OP10_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * shared.n >= 85 * (a.n + b.n - shared.n)
), reach AS (
    SELECT doc_id AS x, doc_id AS y FROM sizes
    UNION
    SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), components AS (
    SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id, doc_id = coalesce(c, doc_id) AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN components USING (doc_id)
"""
