"""Conversation repair against a search over all edits, one edit at a time, cheapest first."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ratefid.llm import conversations as C
from ratefid.llm.conversations import Repair, damaged, op13_conversation_repair, summaries

ROWS = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """Facts of one conversation's rows (turn, role, text), already in order; edits by a uniform cost search over (cost, letters)."""
    fault = faults(rows)
    heap, best = [(0, "", 0, "", ())], {}
    full = re.compile(r"(s?(ua)+)?")
    while True:
        cost, audit, i, roles, made = heapq.heappop(heap)
        state = roles[-1:] if roles else ""
        if best.setdefault((i, state), (cost, audit)) < (cost, audit):
            continue
        if i == len(rows) and full.fullmatch(roles):
            break
        grows = lambda r: any(full.fullmatch(roles + r + tail) for tail in ("", "a", "ua"))
        if i < len(rows):
            _, role, text = rows[i]
            extra = 3 * (fault[i] == "truncated")
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles, made))
            if fault[i] not in ("blank", "duplicate"):
                if role[:1] in ("s", "u", "a") and grows(role[:1]):
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, roles + role[:1], (*made, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if grows(new[0]):
                        heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, roles + new[0], (*made, f"{new}:{text}")))
        for new in ("user", "assistant"):
            if grows(new[0]) and cost < 8 * len(rows) + 10:
                heapq.heappush(heap, (cost + 3, audit + "I", i, roles + new[0], (*made, f"{new}:")))
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(fault.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest(),
    )


def brute_all(rows, damage=False):
    held = {}
    for conv, turn, role, text in rows:
        part = lambda x: " " if x is None else str(x)
        own = held.setdefault(conv, [])
        role, text = part(role), part(text)
        fate = zlib.crc32(f"{part(conv)}:{part(turn)}".encode()) % 20 if damage else 9
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        own += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return {c: brute(sorted(own, key=order)) for c, own in held.items()}


def found(df):
    rows = df.select(*NAMES).collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


def invented(seed, conversations, longest, roles=("user", "assistant", "system", "user", "assistant", "tool", "", None)):
    rng, rows = random.Random(seed), []
    texts = ["Yes.", "No!", "Why?", "and so", "", " \t", None, "ç.", "end. \n", "x", "Tell me."]
    for c in range(conversations):
        for t in range(rng.randrange(1, longest + 1)):
            turn = None if rng.random() < 0.03 else t + rng.choice([0, 0, 0, 0, 1, 3])
            rows.append((c if c else None, turn, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"Line {rng.randrange(99)}."))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("blocks", [{}, {"block_rows": 3}])
def test_repair_is_the_cheapest_and_least(spark, blocks):
    """Nulls in all columns, unknown roles, ties of a turn, repeats: alike in one block and in many."""
    rows = invented(3, 150 if not blocks else 40, 11) + [(900, None, None, None), (901, None, "user", "Only."), (902, 5, "system", "Alone."), (902, 5, "system", "Alone.")]
    df = spark.createDataFrame(rows, ROWS).withColumn("block", F.lit("own")).withColumn("fault", F.lit(1)).withColumn("k", F.lit(None).cast("int"))
    want = brute_all([(c, t, "" if r == "" else r, x) for c, t, r, x in rows])
    assert found(summaries(Repair(df, **blocks))) == want
    steps = Repair(df, **blocks).steps().where("conv_id = 902").orderBy("block", "step").collect()
    assert [(s.edit, s.old_role, s.role) for s in steps if s.edit != "I"][0][1] == "system"


def test_damaged_tables_equal_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    want = brute_all(rows, damage=True)
    assert found(op13_conversation_repair(spark, "/root/testdata/sf0.01")) == want
    assert any(w[6] for w in want.values()) and all(sum(w[i] for w in want.values()) for i in range(6))
    odd = rows[:40] + [(None, None, None, None), (None, 3, "user", None), (7, None, None, "x."), (7, None, None, "x.")]
    got = summaries(Repair(damaged(spark.createDataFrame(odd, ROWS).withColumn("fate", F.lit("own")).withColumn("copy", F.lit(1)))))
    assert found(got) == {c: w for c, w in brute_all(odd, damage=True).items() if w[6] or any(r[0] == c and zlib.crc32(f"{' ' if c is None else c}:{' ' if r[1] is None else r[1]}".encode()) % 20 for r in odd)}


def test_one_conversation_of_many_rows(spark):
    """Five thousand rows in blocks of a few hundred: the cost, the letters and the hash are those of one graph over all of it."""
    rng = random.Random(1)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice([f"Text {t}.", "again.", "open", ""])) for t in range(5_000)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    df = spark.createDataFrame(rows, ROWS)
    whole = found(summaries(Repair(df, block_rows=1 << 20)))
    assert found(summaries(Repair(df, block_rows=400))) == whole and whole[2][-2] == "KK"
    assert len(whole[1][-2]) >= 5_000


def test_long_texts_and_no_rows(spark):
    text = "word " * 400_000
    rows = [(1, 0, "user", text + "."), (1, 1, "assistant", text), (1, 2, "user", text + ".")]
    assert found(summaries(Repair(spark.createDataFrame(rows, ROWS), block_chars=1_000_000))) == brute_all(rows)
    empty = Repair(spark.createDataFrame([], ROWS))
    assert empty.steps().count() == 0 and summaries(empty).count() == 0


def test_doubling_ranks_whole_paths():
    """Ranks by doubled prefixes order all nodes as their letters do."""
    rng = random.Random(8)
    import numpy as np

    n = 200
    pointer = np.array([0] + [rng.randrange(0, i) for i in range(1, n)])
    label = np.array([0] + [rng.choice([1, 2, 3, 4]) for _ in range(1, n)])
    spelled = lambda i: () if i == 0 else (label[i], *spelled(pointer[i]))
    rank, _ = C.doubled(label, pointer)
    words = [spelled(i) for i in range(n)]
    order = sorted(set(words))
    assert [order.index(w) for w in words] == rank.tolist()
