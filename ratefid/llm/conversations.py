"""Conversation structure repair: cheapest edits by dynamic programming, the least of them by prefix doubling.

A conversation's rows are layers of a graph with four nodes each, the states of the role grammar ``(s?(ua)+)?``: nothing yet,
after system, after user, after assistant. Edits are its arcs. Costs to the end are worked out from the last layer to the first; what
is left are the arcs on cheapest paths, at most one of each edit from a node. Ranks of nodes by their next 1, 2, 4, ... edits
are doubled with the pointers to where those edits end, and the least path of an entry is read from the doubled pointers.

Spark sorts the rows by conversation; a task works on many conversations at once, with numpy. A conversation with more than
BLOCK_ROWS rows or BLOCK_CHARS characters is cut into blocks, which are tasks' units like whole conversations are: costs cross a
block as a 4 x 4 matrix of (minimum, plus), and paths as the four states in which its four entries leave it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_key, join_counted, written

BLOCK_ROWS, BLOCK_CHARS = 2_048, 1 << 24
#: So many long conversations at most are broadcast; more are joined by their keys.
BROADCAST = 100_000
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3
#: Edits by rank: the order of their letters.
LETTERS = np.array([b"", b"D", b"I", b"K", b"R"])
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a user or assistant row leads to, whichever the grammar allows there.
NEXT = np.array([USER, USER, ASSISTANT, USER])
#: The states in which a row of each state's role may come.
BEFORE = {SYSTEM: [START], USER: [START, SYSTEM, ASSISTANT], ASSISTANT: [USER]}
FAULTS = ("blank", "duplicate", "truncated")
BLANKS = "[\\x20\\x09-\\x0D]"
FAR = 1 << 40

STEPS = "conv_id {key}, block int, step int, edit string, turn long, old_role string, role string, text string, fault int, own_cost int"


def closed(cost: np.ndarray) -> np.ndarray:
    """Costs with rows that may be inserted before; the last axis is the state."""
    out = cost.copy()
    out[..., USER] = np.minimum(cost[..., USER], INSERT + cost[..., ASSISTANT])
    out[..., ASSISTANT] = np.minimum(cost[..., ASSISTANT], INSERT + cost[..., USER])
    for q in (START, SYSTEM):
        out[..., q] = np.minimum(cost[..., q], INSERT + out[..., USER])
    return out


#: Costs at the end of a conversation: the grammar ends with nothing or after an assistant.
END = closed(np.array([0, FAR, FAR, 0], np.int64))


def row_costs(after: np.ndarray, state: np.ndarray, must_go: np.ndarray, unfinished: np.ndarray) -> np.ndarray:
    """Costs of deleting, keeping or reroling a row before what ``after`` says: (3 edits, rows, ..., 4)."""
    wide = (slice(None),) + (None,) * (after.ndim - 1)
    out = np.full((3, *after.shape), FAR, np.int64)
    out[0] = DELETE + after
    extra = np.where(must_go, FAR, np.where(unfinished, UNFINISHED, 0))[wide]
    for role, states in BEFORE.items():
        own = state == role
        for q in states:
            out[1, own, ..., q] = KEEP + after[own][..., role] + extra[own][..., 0]
    out[2] = REROLE + after[..., NEXT] + extra
    return out


def costs_to_end(first: np.ndarray, size: np.ndarray, ends: np.ndarray, state: np.ndarray, must_go: np.ndarray, unfinished: np.ndarray) -> np.ndarray:
    """Costs from every layer of every block: block b has the layers ``first[b] + b`` to ``first[b] + size[b] + b``, the last given in ``ends``."""
    cost = np.empty((len(state) + len(size), *ends.shape[1:]), np.int64)
    last = first + size + np.arange(len(size))
    cost[last] = ends
    order = np.argsort(-size, kind="stable")
    live = np.searchsorted(-size[order], -np.arange(size.max(initial=0)), "left")
    for back, n in enumerate(live):
        own = order[:n]
        rows = first[own] + size[own] - 1 - back
        cost[last[own] - 1 - back] = closed(row_costs(cost[last[own] - back], state[rows], must_go[rows], unfinished[rows]).min(axis=0))
    return cost


def doubled(rank: np.ndarray, pointer: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ranks of all nodes by their least path to the end, and pointers 1, 2, 4, ... edits on; the end points to itself with rank 0."""
    pointers = [pointer]
    while rank[pointers[-1]].any():
        both = rank.astype(np.int64) * (len(rank) + 5) + rank[pointers[-1]]
        rank = np.unique(both, return_inverse=True)[1]
        rank -= rank.min() if len(rank) else 0
        pointers.append(pointers[-1][pointers[-1]])
    return rank, pointers


class Blocks:
    """Whole blocks of rows in order, with their faults and the graph of their edits."""

    def __init__(self, table: pa.Table, starts: np.ndarray):
        self.table, self.first, self.size = table, starts, np.diff(np.r_[starts, table.num_rows])
        column = lambda name: table.column(name).to_numpy(zero_copy_only=False)
        self.owner = np.repeat(np.arange(len(starts)), self.size)
        self.initial = pc.utf8_slice_codeunits(table.column("role"), 0, 1).to_pandas()
        self.state = self.initial.map({"s": SYSTEM, "u": USER, "a": ASSISTANT}).fillna(-1).to_numpy().astype(int)
        keys = pd.DataFrame({"owner": self.owner, "role": table.column("role").to_pandas(), "text": table.column("text").to_pandas()})
        again = keys.duplicated().to_numpy() | column("seen").astype(bool)
        blank = column("blank").astype(bool)
        self.fault = np.where(blank, 1, np.where(again, 2, np.where(column("unfinished").astype(bool), 3, 0)))

    def costs(self, ends: np.ndarray) -> np.ndarray:
        return costs_to_end(self.first, self.size, ends, self.state, (self.fault == 1) | (self.fault == 2), self.fault == 3)

    def graph(self, ends: np.ndarray, final: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Ranks of the nodes' next edits, doubled pointers, and the first node of each block; ``final`` blocks may be filled up at their end."""
        cost = self.costs(ends)
        layers, blocks = len(cost), np.arange(len(self.size))
        node = np.arange(layers)[:, None] * 4 + np.arange(4)
        rank, pointer = np.zeros((layers, 4), np.int64), node.copy()
        last = np.zeros(layers, bool)
        last[self.first + self.size + blocks] = True
        inner = np.flatnonzero(~last)
        del_cost, keep_cost, role_cost = row_costs(cost[inner + 1], self.state, (self.fault == 1) | (self.fault == 2), self.fault == 3)
        insert_cost = INSERT + cost[inner][:, NEXT]
        kept = np.broadcast_to(np.maximum(self.state, 0)[:, None], del_cost.shape)
        on = (inner[:, None] + 1) * 4
        # From the greatest letter to the least, so the least arc of those on a cheapest path is what stays.
        choices = ((4, role_cost, on + NEXT), (3, keep_cost, on + kept), (2, insert_cost, inner[:, None] * 4 + NEXT), (1, del_cost, on + np.arange(4)))
        own_rank, own_pointer = rank[inner], pointer[inner]
        for letter, price, to in choices:
            best = price == cost[inner]
            own_rank[best], own_pointer[best] = letter, np.broadcast_to(to, best.shape)[best]
        rank[inner], pointer[inner] = own_rank, own_pointer
        for q in (SYSTEM, USER):
            tails = (self.first + self.size + blocks)[final]
            rank[tails, q], pointer[tails, q] = 2, tails * 4 + NEXT[q]
        label = rank.ravel()
        _, pointers = doubled(label, pointer.ravel())
        return label, pointers, (self.first + blocks) * 4

    def exits(self, ends: np.ndarray, final: np.ndarray) -> np.ndarray:
        """The state in which the least path from each of the four entries leaves each block."""
        _, pointers, entry = self.graph(ends, final)
        return pointers[-1][entry[:, None] + np.arange(4)] % 4

    def steps(self, ends: np.ndarray, final: np.ndarray, entries: np.ndarray) -> pa.RecordBatch:
        """The edits of the least path of each block from its entry, in order."""
        label, pointers, entry = self.graph(ends, final)
        at = entry + entries
        # Rows and at most two inserted before each and after the last.
        most = 3 * (self.size + 1)
        low = np.r_[0, np.cumsum(most)]
        step = np.arange(low[-1]) - np.repeat(low[:-1], most)
        path = np.repeat(at, most)
        for k, jump in enumerate(pointers):
            path = np.where(step >> k & 1, jump[path], path)
        some = (label[path] > 0) & (step < 1 << len(pointers))
        path, step = path[some], step[some]
        to = pointers[0][path] % 4
        layer, edit = path // 4, label[path]
        block = np.searchsorted((self.first + self.size + np.arange(len(self.size))), layer, "left")
        row = layer - block
        inserted = edit == 2
        rows = pa.array(np.where(inserted, -1, row), pa.int64(), mask=inserted)
        roles = pa.array(["", "system", "user", "assistant"])
        old = self.table.column("role").combine_chunks().take(rows)
        made = pc.if_else(pa.array((edit == 2) | (edit == 4)), roles.take(pa.array(to)), old)
        fault = np.where(inserted, 0, self.fault[np.minimum(row, len(self.fault) - 1)] if len(self.fault) else 0)
        price = np.array([0, DELETE, INSERT, KEEP, REROLE])[edit] + np.where((fault == 3) & (edit != 1), UNFINISHED, 0)
        first = pa.array(self.first[block])
        return pa.RecordBatch.from_arrays(
            [
                self.table.column("conv_id").combine_chunks().take(first),
                self.table.column("block").combine_chunks().take(first),
                pa.array(step.astype(np.int32)),
                pa.array(LETTERS[edit].astype(str).tolist(), pa.string()),
                self.table.column("turn").combine_chunks().take(rows),
                old,
                pc.if_else(pa.array(edit == 1), pa.scalar(None, pa.string()), made),
                pc.fill_null(self.table.column("text").combine_chunks().take(rows), ""),
                pa.array(fault.astype(np.int32)),
                pa.array(price.astype(np.int32)),
            ],
            names=["conv_id", "block", "step", "edit", "turn", "old_role", "role", "text", "fault", "own_cost"],
        )


def _starts(table: pa.Table, columns: tuple[str, ...]) -> np.ndarray:
    """Where runs of equal values of the columns begin, nulls being equal."""
    change = np.zeros(table.num_rows, bool)
    change[:1] = True
    for name in columns:
        codes = table.column(name).combine_chunks().dictionary_encode(null_encoding="encode")
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(change)


def by_blocks(job: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that gives ``job`` tables of whole blocks and where each block begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            at = _starts(table, ("conv_id", "block"))
            if len(at) > 1:
                yield from job(table.slice(0, at[-1]).combine_chunks(), at[:-1])
                held = table.slice(at[-1]).combine_chunks().to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield from job(table.combine_chunks(), np.zeros(1, np.int64))

    return run


def flagged(conversations: DataFrame) -> DataFrame:
    """conv_id, block 0, turn, role, text (null: one space), blank, unfinished, seen of each row."""
    text = F.coalesce(F.col("text"), F.lit(" "))
    return conversations.select(
        "conv_id", F.lit(0).alias("block"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"),
        (~text.rlike("[^\\x20\\x09-\\x0D]")).alias("blank"), (~text.rlike(f"[.!?]{BLANKS}*\\z")).alias("unfinished"), F.lit(False).alias("seen"),
    )


ORDER = ("turn", "role", "text")


class Repair:
    """The rows of conversations (conv_id, turn, role, text), their faults and the cheapest edits that mend their roles.

    Rows go by turn, nulls first, and rows of one turn by role and text; a null role or text is one space, and rows without
    conv_id are one conversation. Keep costs 0, rerole 3, delete 4, insert 3, and an unfinished row that stays 3 more; blank and
    repeated rows must go. Of the cheapest edits those come out whose letters are the least. No rows give no rows; other columns are not read.
    """

    def __init__(self, conversations: DataFrame, block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS):
        self.rows, self.block_rows, self.block_chars = flagged(conversations), block_rows, block_chars
        self.key = dict(self.rows.dtypes)["conv_id"]
        sizes = self.rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
        self.long = written(sizes.where((F.col("n") > block_rows) | (F.col("chars") > block_chars)), "long-conversations")
        self.n_long = self.long.count()

    def _split(self) -> tuple[DataFrame, DataFrame]:
        """Rows of other and of long conversations."""
        if not self.n_long:
            return self.rows, self.rows.where("false")
        marks = self.long.select(as_key("conv_id").alias("k0"), "n").select(F.coalesce("k0", F.lit(b"\xff")).alias("k"), "n", F.lit(True).alias("is_long"))
        rows = self.rows.withColumn("k", F.coalesce(as_key("conv_id"), F.lit(b"\xff")))
        joined = rows.join(F.broadcast(marks), "k", "left") if self.n_long <= BROADCAST else join_counted(rows, marks, "k", "n", "text")
        own = self.rows.columns
        return joined.where("is_long IS NULL").select(*own), joined.where("is_long").select(*own)

    def steps(self) -> DataFrame:
        """One row an edit: conv_id, block and step in order, edit, turn and old_role of its row, role and text after it, fault (1 blank, 2 duplicate, 3 truncated), own_cost.

        The role of a deleted row is null. Rows of a task are in order; blocks of a long conversation may be in several.
        """
        short, long = self.parts()
        return short.unionByName(long) if long is not None else short

    def parts(self) -> tuple[DataFrame, DataFrame | None]:
        """Steps of other conversations, each whole and in order in one task, and of long ones."""
        schema = STEPS.format(key=self.key)
        short, long = self._split()

        def job(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            n = len(starts)
            yield Blocks(table, starts).steps(np.tile(END, (n, 1)), np.ones(n, bool), np.zeros(n, int))

        ordered = short.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER)
        return ordered.mapInArrow(by_blocks(job), schema), self._long_steps(long, schema) if self.n_long else None

    def _long_steps(self, rows: DataFrame, schema: str) -> DataFrame:
        key = self.key
        n = self.long.agg(F.sum(F.ceil(F.greatest(F.col("n") / self.block_rows, F.col("chars") / self.block_chars)))).first()[0]
        # Ranges of the order, told apart among equal rows by a hash of nothing but their place in the scan.
        rows = written(rows.withColumn("tie", F.xxhash64(F.monotonically_increasing_id())), "long-rows")
        rows = rows.repartitionByRange(max(1, int(n) + self.n_long), "conv_id", *ORDER, "tie").withColumn("block", F.spark_partition_id())
        rows = written(rows, "long-blocks")
        # A row is a repeat if an earlier block has it; repeats inside a block are found there.
        texts = rows.where("NOT blank").select("conv_id", "block", "role", F.sha2("text", 256).alias("sha")).distinct()
        firsts = texts.groupBy("conv_id", "role", "sha").agg(F.min("block").alias("first"), F.count(F.lit(1)).alias("blocks")).where("blocks > 1")
        same = lambda a, b: a.eqNullSafe(b)
        t, f = texts.alias("t"), firsts.alias("f")
        later = t.join(f, same(F.col("t.conv_id"), F.col("f.conv_id")) & (F.col("t.role") == F.col("f.role")) & (F.col("t.sha") == F.col("f.sha")) & (F.col("t.block") > F.col("f.first")))
        later = later.select("t.conv_id", "t.block", "t.role", "t.sha").withColumn("again", F.lit(True))
        r, a = rows.withColumn("sha", F.sha2("text", 256)).alias("r"), later.alias("a")
        on = same(F.col("r.conv_id"), F.col("a.conv_id")) & (F.col("r.block") == F.col("a.block")) & (F.col("r.role") == F.col("a.role")) & (F.col("r.sha") == F.col("a.sha"))
        names = [c for c in self.rows.columns if c != "seen"]
        rows = written(r.join(a, on, "left").select(*[F.col(f"r.{c}").alias(c) for c in names], F.coalesce("a.again", F.lit(False)).alias("seen")), "long-seen")

        def spread(extra: DataFrame | None = None) -> DataFrame:
            held = rows if extra is None else rows.join(extra.withColumnRenamed("conv_id", "_c").withColumnRenamed("block", "_b"), same(F.col("conv_id"), F.col("_c")) & (F.col("block") == F.col("_b"))).drop("_c", "_b")
            return held.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", *ORDER)

        def crossing(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            unit = np.where(np.eye(4, dtype=bool), 0, FAR).astype(np.int64)
            # Costs from each entry to each exit: the exits are an axis before the states.
            found = Blocks(table, starts).costs(np.tile(unit[None], (len(starts), 1, 1)))[starts + np.arange(len(starts))]
            yield _block_rows(table, starts, "costs", [m.T.ravel().tolist() for m in found])

        def leaving(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            found = Blocks(table, starts).exits(*_given(table, starts)[:2])
            yield _block_rows(table, starts, "costs", found.tolist())

        def steps(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield Blocks(table, starts).steps(*_given(table, starts))

        small = f"conv_id {key}, block int, costs array<long>"
        costs = written(spread().mapInArrow(by_blocks(crossing), small), "crossing-costs")
        ends = written(costs.groupBy("conv_id").applyInPandas(_exit_costs, f"conv_id {key}, block int, ends array<long>, final boolean"), "exit-costs")
        exits = written(spread(ends).mapInArrow(by_blocks(leaving), small), "exits")
        entries = written(exits.groupBy("conv_id").applyInPandas(_entries, f"conv_id {key}, block int, entry int"), "entries")
        both = ends.alias("x").join(entries.alias("y"), same(F.col("x.conv_id"), F.col("y.conv_id")) & (F.col("x.block") == F.col("y.block"))).select("x.*", "y.entry")
        return spread(both).mapInArrow(by_blocks(steps), schema)


def _block_rows(table: pa.Table, starts: np.ndarray, name: str, values: list[list[int]]) -> pa.RecordBatch:
    at = pa.array(starts)
    columns = [table.column(c).combine_chunks().take(at) for c in ("conv_id", "block")]
    return pa.RecordBatch.from_arrays([*columns, pa.array(values, pa.list_(pa.int64()))], names=["conv_id", "block", name])


def _given(table: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = pa.array(starts)
    ends = np.array(table.column("ends").combine_chunks().take(at).to_pylist(), np.int64).reshape(-1, 4)
    entry = table.column("entry").combine_chunks().take(at).to_numpy() if "entry" in table.column_names else np.zeros(len(starts), int)
    return ends, table.column("final").combine_chunks().take(at).to_numpy(zero_copy_only=False), entry


def _exit_costs(blocks: pd.DataFrame) -> pd.DataFrame:
    """One conversation's blocks, a row of 16 numbers each: what its end costs from the end of every block."""
    blocks = blocks.sort_values("block")
    ends, now = [], END
    for costs in reversed(blocks.costs.tolist()):
        ends.append(now.tolist())
        now = (np.asarray(costs).reshape(4, 4) + now).min(axis=1)
    return pd.DataFrame({"conv_id": blocks.conv_id, "block": blocks.block, "ends": ends[::-1], "final": [False] * (len(blocks) - 1) + [True]})


def _entries(blocks: pd.DataFrame) -> pd.DataFrame:
    """The state in which the least path of one conversation enters each of its blocks."""
    blocks = blocks.sort_values("block")
    entry, now = [], START
    for exits in blocks.costs:
        entry.append(now)
        now = int(exits[now])
    return pd.DataFrame({"conv_id": blocks.conv_id, "block": blocks.block, "entry": entry})


SUMMARY = "conv_id {key}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LEGAL = ("su", "ua", "au")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation, from its steps in order; a conversation that crosses batches is carried as sums and a hash."""
    sums = ("blank", "duplicate", "truncated", "illegal", "cost", "turns")
    carry: dict | None = None

    def finished(c: dict) -> tuple:
        gaps = int(c["high"] - c["low"] + 1 - c["turns"]) if c["low"] is not None else 0
        return (c["conv_id"], gaps, *[int(c[s]) for s in sums[:5]], "".join(c["audit"]), c["hash"].hexdigest())

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names=["conv_id", "gaps", *sums[:5], "audit", "repaired_sha256"])

    types: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        types = types or [batch.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string()]
        table = pa.Table.from_batches([batch])
        at = _starts(table, ("conv_id",))
        ids, edit = table.column("conv_id").combine_chunks().take(pa.array(at)).to_pylist(), "".join(table.column("edit").to_pylist())
        # Rows that came, not those inserted, one after another.
        came = np.flatnonzero(pc.not_equal(table.column("edit"), "I").to_numpy())
        initial = pc.utf8_slice_codeunits(table.column("old_role"), 0, 1).take(pa.array(came)).to_pylist()
        pairs = pd.Series([a + b for a, b in zip(initial[:-1], initial[1:], strict=True)], dtype=object)
        bad = np.r_[False, ~pairs.isin(LEGAL).to_numpy()] if len(initial) else np.zeros(0, bool)
        turn = table.column("turn").take(pa.array(came))
        known, number = pc.is_valid(turn).to_numpy(), pc.fill_null(turn, 0).to_numpy()
        low = np.searchsorted(came, at)
        high = np.r_[low[1:], len(came)]
        bad[low[low < high]] = False
        fresh = known & np.r_[True, (number[1:] != number[:-1]) | ~known[:-1]][: len(known)]
        fresh[low[low < high]] = known[low[low < high]]
        total = lambda mask, a, b, s=None: (s := np.r_[0, np.cumsum(mask)])[b] - s[a]
        fault, ends = table.column("fault").to_numpy(), np.r_[at[1:], table.num_rows]
        found = {name: total(fault == i + 1, at, ends) for i, name in enumerate(FAULTS)}
        found |= {"illegal": total(bad, low, high), "turns": total(fresh, low, high), "cost": total(table.column("own_cost").to_numpy(), at, ends)}
        nulls = total(~known, low, high)  # they come first
        stay = np.flatnonzero(pc.is_valid(table.column("role")).to_numpy())
        pieces = pc.binary_join_element_wise(table.column("role").take(pa.array(stay)), table.column("text").take(pa.array(stay)), ":").to_pylist()
        cut, cut_end = np.searchsorted(stay, at), np.searchsorted(stay, ends)
        rows = []
        for i, conv in enumerate(ids):
            a, b, some = low[i], high[i], nulls[i] < high[i] - low[i]
            own = {s: found[s][i] for s in sums} | {"conv_id": conv, "audit": [edit[at[i] : ends[i]]]}
            own |= {"low": number[a + nulls[i]] if some else None, "high": number[b - 1] if some else None}
            own |= {"first": initial[a] if a < b else None, "last": initial[b - 1] if a < b else None, "some": cut_end[i] > cut[i]}
            text = "\n".join(pieces[cut[i] : cut_end[i]]).encode("utf-8", "surrogatepass")
            if carry is not None and i == 0 and (carry["conv_id"] == conv):
                for s in sums:
                    carry[s] += own[s]
                if carry["last"] is not None and own["first"] is not None:
                    carry["illegal"] += carry["last"] + own["first"] not in LEGAL
                if own["low"] is not None:
                    carry["turns"] -= carry["high"] == own["low"]
                    carry["low"] = own["low"] if carry["low"] is None else carry["low"]
                    carry["high"] = own["high"]
                carry["last"] = own["last"] if own["last"] is not None else carry["last"]
                carry["audit"] += own["audit"]
                carry["hash"].update(b"\n" + text if carry["some"] and own["some"] else text)
                carry["some"] |= own["some"]
                continue
            if carry is not None:
                rows.append(finished(carry))
            carry = own | {"hash": hashlib.sha256(text)}
        if rows:
            yield made(rows)
    if carry is not None:
        yield made([finished(carry)])


def summaries(repair: Repair) -> DataFrame:
    """One row a conversation: gaps, counts of faults, illegal neighbours, cost, audit, and the hash of the repaired rows.

    A hash of one long text is taken in order, so a long conversation's steps are sorted into one task here, which holds one batch of them.
    """
    schema = SUMMARY.format(key=repair.key)
    short, long = repair.parts()
    out = short.mapInArrow(_summaries, schema)
    if long is not None:
        out = out.unionByName(long.repartition("conv_id").sortWithinPartitions("conv_id", "block", "step").mapInArrow(_summaries, schema))
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the faults that crc32(``conv_id:turn``) % 20 asks for: 0 none left, 1 no text, 2 no ends, 3 twice, 4 user's; nulls there are one space."""
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fate = F.crc32(F.encode(F.concat(part("conv_id"), F.lit(":"), part("turn")), "utf-8")) % 20
    text = F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.translate(part("text"), ".!?", "")).otherwise(part("text"))
    role = F.when(F.col("fate") == 4, F.lit("user")).otherwise(part("role"))
    times = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return conversations.withColumn("fate", fate).where("fate <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the table, damaged and mended; one that lost all its rows has zeros, no audit and the hash of nothing."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = summaries(Repair(damaged(rows)))
    every = rows.select(F.col("conv_id").alias("own")).distinct()
    out = every.join(found, F.col("own").eqNullSafe(F.col("conv_id")), "left")
    number = lambda name: F.coalesce(F.col(name), F.lit(0).cast("long")).alias(name)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    numbers: list[Column] = [number(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("own").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
