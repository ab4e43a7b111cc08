"""Scoring documents by masked pseudo-likelihood: every token is predicted from both sides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, parts, written
from .shingles import text_words

#: Classes, and words of a class: the network tells CLASSES * MEMBERS most frequent words apart; all others are the class RARE.
CLASSES = MEMBERS = 64
KNOWN = CLASSES * MEMBERS
RARE, PAD = KNOWN, KNOWN + 1
#: Places before and after the token that the network sees.
SIDES = (-2, -1, 1, 2)
WIDTH = 24
#: In each round every shard learns from its share of the positions; after the last one each position was learned from once.
ROUNDS = 2
#: Tokens of a shard. Shards are dealt by a hash of the rows, so what is learned depends on the texts alone, not on tasks or executors.
SHARD_TOKENS = 4_000_000
BATCH = 4096
RATE = 0.15
#: The weights travel in pieces, and at most so many tasks' pieces are averaged in one place.
PIECES, FAN_IN = 32, 64
#: Words whose counts every task holds, at most; counts of all others are joined.
COUNTED = 1 << 18
#: Positions that are scored at once, and bytes of texts that a task holds at once.
BLOCK, PART_BYTES = 1 << 16, 1 << 20


class Network:
    """Embeddings of the window's words, one table a place, are summed and squashed; a class and then its member are predicted."""

    SHAPES = {
        "context": (len(SIDES) * (KNOWN + 2), WIDTH),
        "to_class": (WIDTH, CLASSES + 1),
        "class_bias": (CLASSES + 1,),
        "to_member": (CLASSES, WIDTH, MEMBERS),
        "member_bias": (CLASSES, MEMBERS),
    }

    def __init__(self, flat: np.ndarray | None = None):
        sizes = [int(np.prod(s)) for s in self.SHAPES.values()]
        if flat is None:
            flat = np.zeros(sum(sizes), np.float32)
            flat[: sizes[0]] = np.random.default_rng(11).normal(0, 0.1, sizes[0])
            flat[sizes[0] :] = np.random.default_rng(12).normal(0, 0.02, sum(sizes[1:]))
        self.flat, at = flat, 0
        for (name, shape), n in zip(self.SHAPES.items(), sizes, strict=True):
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def unigram(cls, counts: np.ndarray, total: int) -> Network:
        """A start that gives every known word, and rare ones together, about their share of ``total`` tokens whatever is around them."""
        net = cls()
        known = np.zeros(KNOWN)
        known[: len(counts)] = counts[:KNOWN]
        by_class = known.reshape(CLASSES, MEMBERS)
        sums = np.append(by_class.sum(axis=1), max(0, total - known.sum()))
        net.class_bias[:] = np.log((sums + 0.5) / (sums + 0.5).sum())
        net.member_bias[:] = np.log((by_class + 0.5) / (by_class + 0.5).sum(axis=1, keepdims=True))
        return net

    def hidden(self, places: np.ndarray) -> np.ndarray:
        """places: rows of ``context``, those around one position in a row."""
        total = self.context.take(places[:, 0], axis=0)
        more = np.empty_like(total)
        for i in range(1, len(SIDES)):
            total += self.context.take(places[:, i], axis=0, out=more, mode="clip")  # clip, as out is buffered otherwise; all places are there
        return np.tanh(total, out=total)

    def large(self) -> bool:
        """Whether some logit may be too large for its exponential; what is hidden lies between -1 and 1."""
        most = [np.abs(w).sum(axis=-2) + np.abs(b) for w, b in ((self.to_class, self.class_bias), (self.to_member, self.member_bias))]
        return max(x.max() for x in most) > MOST

    def log_probabilities(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of each position the logarithm of what its word, or that it is a rare one, is given by the words around it."""
        order, classes, members, starts = _by_class(target)
        clip, h = self.large(), self.hidden(_places(around[order]))
        own = _log_softmax(_logits(h, self.to_class, self.class_bias), classes, clip)
        for c in np.flatnonzero(np.diff(starts)).tolist():
            at = slice(starts[c], starts[c + 1])
            own[at] += _log_softmax(_logits(h[at], self.to_member[c], self.member_bias[c]), members[at], clip)
        out = np.empty_like(own)
        out[order] = own
        return out

    def gradients(self, around: np.ndarray, target: np.ndarray) -> list[tuple[str, object, np.ndarray]]:
        """Of the mean log loss: name of the weights, which of them, and their gradient."""
        n = np.float32(1 / len(target))
        order, classes, members, starts = _by_class(target)
        places = _places(around[order])
        clip, h = self.large(), self.hidden(places)
        wrong = _softmax(_logits(h, self.to_class, self.class_bias), clip)
        wrong[np.arange(len(h)), classes] -= 1
        wrong *= n
        back = wrong @ self.to_class.T
        by_member, biases = np.zeros_like(self.to_member), np.zeros_like(self.member_bias)
        sizes = np.diff(starts)
        room = _rooms(sizes)
        for r in np.unique(room[sizes > 0]).tolist():  # classes of about one size go through together
            own = np.flatnonzero((room == r) & (sizes > 0))
            used = np.arange(r) < sizes[own][:, None]
            rows = np.minimum(starts[own][:, None] + np.arange(r), len(h) - 1)
            part = h.take(rows, axis=0)
            weights = self.to_member[own]
            miss = _softmax(_logits(part, weights, self.member_bias[own][:, None, :]), clip)
            kept = rows[used]
            at = np.flatnonzero(used)
            miss.reshape(-1, MEMBERS)[at, members[kept]] -= 1
            miss[~used] = 0
            miss *= n
            back[kept] += np.matmul(miss, weights.transpose(0, 2, 1)).reshape(-1, WIDTH)[at]
            by_member[own] = np.matmul(part.transpose(0, 2, 1), miss)
            biases[own] = miss.sum(axis=1)
        back *= 1 - h * h
        flat = places.ravel()
        by_place = np.argsort(flat, kind="stable")  # a radix sort, as places have 16 bits
        ids = flat[by_place]
        first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        context = np.add.reduceat(back.take(by_place // len(SIDES), axis=0), first, axis=0)
        every = slice(None)
        return [("to_class", every, h.T @ wrong), ("class_bias", every, wrong.sum(axis=0)), ("to_member", every, by_member), ("member_bias", every, biases), ("context", ids[first], context)]

    def learn(self, around: np.ndarray, target: np.ndarray, squares: Network) -> None:
        """One Adagrad step; ``squares`` holds the sums of squared gradients."""
        for name, at, gradient in self.gradients(around, target):
            own, total = getattr(self, name), getattr(squares, name)
            sums = total[at] + gradient * gradient
            total[at] = sums
            gradient *= RATE
            gradient /= np.sqrt(sums, out=sums) + np.float32(1e-6)
            own[at] -= gradient


#: Logits beyond this count as it; so exponentials stay finite without looking for each row's largest.
MOST = 40


def _logits(h: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    x = np.matmul(h, weights)
    x += bias
    return x


def _exponentials(x: np.ndarray, clip: bool) -> tuple[np.ndarray, np.ndarray]:
    """In place."""
    if clip:
        np.clip(x, -MOST, MOST, out=x)
    np.exp(x, out=x)
    return x, x @ np.ones(x.shape[-1], x.dtype)


def _softmax(x: np.ndarray, clip: bool) -> np.ndarray:
    e, total = _exponentials(x, clip)
    e /= total[..., None]
    return e


def _log_softmax(x: np.ndarray, at: np.ndarray, clip: bool) -> np.ndarray:
    """Of each row the one logarithm asked for."""
    own = x[np.arange(len(x)), at]
    if clip:
        np.clip(own, -MOST, MOST, out=own)
    return own - np.log(_exponentials(x, clip)[1])


def _rooms(sizes: np.ndarray) -> np.ndarray:
    """Sizes rounded up, by a quarter at most, to few different ones."""
    step = 1 << np.maximum(3, np.log2(np.maximum(sizes, 1)).astype(np.int64) - 2)
    return -(-sizes // step) * step


def _places(around: np.ndarray) -> np.ndarray:
    """Rows of the context table for ids at each of SIDES."""
    return around + np.arange(len(SIDES), dtype=np.uint16) * np.uint16(KNOWN + 2)


def _by_class(target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An order by class, class and member in that order, and where each class but RARE begins (and the last one ends) there."""
    order = np.argsort(target, kind="stable")
    classes, members = np.divmod(target[order], np.uint16(MEMBERS))
    return order, classes, members, np.searchsorted(classes, np.arange(CLASSES + 1))


class Positions:
    """The positions of some texts, whose ids lie one after the other between pads."""

    def __init__(self, texts: list[np.ndarray]):
        reach = max(SIDES)
        pad = np.full(reach, PAD, np.uint16)
        self.flat = np.concatenate([pad, *(x for t in texts for x in (t, pad))])
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.reach = reach

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def take(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the asked positions: ids around each, the id there, and which text it is in."""
        owner = np.searchsorted(self.ends, own, "right")
        at = own + self.reach * (owner + 1)
        return self.flat[at[:, None] + np.array(SIDES)], self.flat[at], owner


def word_counts(docs: DataFrame) -> DataFrame:
    """word (a 64-bit hash), n: over all whole texts."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 0, 8 * PART_BYTES):
            words, n = np.unique(np.concatenate([text_words(t or "") for t in part.column(0).to_pylist()]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    return docs.select("text").mapInArrow(job, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Words and counts, most frequent first (ties to the smaller hash): the KNOWN first ones at least, ``most`` (COUNTED) in all at most.

    The least count comes from a histogram, so no task sorts the words.
    """
    size = F.floor(F.log2("n") * 4)
    sums, least = 0, None
    for r in sorted(counts.groupBy(size.alias("b")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).collect(), reverse=True):
        sums += r.k
        if sums > (most or COUNTED):
            break
        least = r.least
    table = counts.where(F.col("n") >= (least if least is not None else 1 << 62)).toPandas()
    if len(table) < KNOWN:
        table = counts.orderBy(F.desc("n"), "word").limit(KNOWN).toPandas()
    table = table.sort_values(["n", "word"], ascending=[False, True])
    return table["word"].to_numpy(np.int64), table["n"].to_numpy(np.int64)


def encoded(docs: DataFrame, words: np.ndarray, counts: np.ndarray) -> DataFrame:
    """row, doc_id, ids (unsigned 16 bit: the rank of each known word, or RARE), logs, once, rest.

    logs adds up the logarithms of the rare words' counts that ``counts`` has, once counts words whose count is 1; rest has the words, with repeats,
    whose counts are not there. ``row`` is only the same in a table that is written.
    """
    order = np.argsort(words)
    held = docs.sparkSession.sparkContext.broadcast((words[order], np.minimum(order, RARE).astype(np.uint16), counts[order]))  # at most COUNTED words

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank, n = held.value
        row = TaskContext.get().partitionId() << 33
        for part in parts(batches, 1, PART_BYTES):
            ids, logs, once, rest = [], [], [], []
            texts = [text_words(text or "").view(np.int64) for text in part.column(1).to_pylist()]
            words, which = np.unique(np.concatenate(texts), return_inverse=True)  # each word of the part is looked up once
            at = np.minimum(np.searchsorted(known, words), max(0, len(known) - 1))
            there = known[at] == words if len(known) else np.zeros(len(words), bool)
            ranks = np.where(there, rank[at] if len(known) else RARE, RARE).astype("<u2")
            counts = np.where(there, n[at] if len(known) else 0, 0)
            for w, at in zip(texts, np.split(which, np.cumsum([len(w) for w in texts])[:-1]), strict=True):
                own, found, n_own = ranks[at], there[at], counts[at]
                ids.append(own.tobytes())
                logs.append(float(np.log(n_own[found & (own == RARE)]).sum()))
                once.append(int((n_own == 1).sum()))
                rest.append(w[~found])
            number = pa.array(np.arange(row, row + part.num_rows))
            row += part.num_rows
            yield pa.RecordBatch.from_arrays(
                [number, part.column(0), pa.array(ids, pa.binary()), pa.array(logs, pa.float64()), pa.array(once, pa.int64()), pa.array(rest, pa.list_(pa.int64()))],
                names=["row", "doc_id", "ids", "logs", "once", "rest"],
            )

    schema = "row long, doc_id long, ids binary, logs double, once long, rest array<long>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(job, schema)


def _texts(part: pa.RecordBatch, column: int) -> list[np.ndarray]:
    return [np.frombuffer(x, np.dtype("<u2")) for x in part.column(column).to_pylist()]


def trained(ids: DataFrame, rounds: int = ROUNDS, start: Network | None = None, shards: int = 1) -> Network:
    """Every shard learns on from the common weights over all its texts; the weights are averaged by tokens, level by level, in Spark.

    Rows are dealt to shards, and sorted there, by a hash of id and words: the same texts give the same network however they
    are laid out. Only the averaged weights, of fixed size, come to the driver. Without any token the network stays as it starts.
    """
    spark, now = ids.sparkSession, start or Network()
    key = F.xxhash64("ids", "doc_id")
    ids = ids.select("ids", F.pmod(key, F.lit(shards)).alias("shard"), key.alias("key"))
    ids = ids.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "key")
    for turn in range(rounds):
        start = spark.sparkContext.broadcast(now.flat)

        def job(batches: Iterator[pa.RecordBatch], turn=turn, start=start) -> Iterator[pa.RecordBatch]:
            net, squares, seen, own = None, None, 0, None
            held, size = [], 0

            def learn() -> int:
                here = Positions([np.frombuffer(x, np.dtype("<u2")) for x in held])
                n = 0
                for at in range(turn, len(here), rounds * BATCH):
                    around, target, _ = here.take(np.arange(at, min(len(here), at + rounds * BATCH), rounds))
                    net.learn(around, target, squares)
                    n += len(target)
                held.clear()
                return n

            def weights() -> pa.RecordBatch:
                pieces = [p.tobytes() for p in np.array_split(net.flat, PIECES)]
                return pa.RecordBatch.from_arrays(
                    [pa.array([own] * PIECES, pa.int64()), pa.array(range(PIECES), pa.int32()), pa.array([float(seen)] * PIECES), pa.array(pieces, pa.binary())], names=["task", "piece", "n", "weights"]
                )

            for batch in batches:
                for text, shard in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if shard != own or size >= PART_BYTES:  # parts are cut by bytes alone, wherever batches end
                        seen, size = seen + (learn() if held else 0), 0
                    if shard != own:
                        if seen:
                            yield weights()
                        net, squares, seen, own = Network(start.value.copy()), Network(np.full_like(start.value, 1e-4)), 0, shard
                    held.append(text)
                    size += len(text)
            if held:
                seen += learn()
            if seen:
                yield weights()

        schema, n_tasks = "task long, piece int, n double, weights binary", shards
        held = ids.select("ids", "shard").mapInArrow(job, schema)
        while True:
            held = held.withColumn("task", F.floor(F.col("task") / FAN_IN)).groupBy("task", "piece").applyInArrow(_averaged, schema)
            n_tasks = -(-n_tasks // FAN_IN)
            if n_tasks == 1:
                break
        rows = sorted(held.collect(), key=lambda r: r.piece)
        if rows:
            now = Network(np.concatenate([np.frombuffer(r.weights, np.float32) for r in rows]).copy())
    return now


def _averaged(table: pa.Table) -> pa.Table:
    total, n = None, 0.0
    for weights, k in sorted(zip(table.column("weights").to_pylist(), table.column("n").to_pylist(), strict=True)):
        part = np.frombuffer(weights, np.float32).astype(np.float64) * k
        total, n = part if total is None else total + part, n + k
    return pa.table(
        {
            "task": table.column("task").slice(0, 1),
            "piece": table.column("piece").slice(0, 1),
            "n": pa.array([n]),
            "weights": pa.array([(total / n).astype(np.float32).tobytes()], pa.binary()),
        }
    )


def network_scores(ids: DataFrame, net: Network) -> DataFrame:
    """row, doc_id, n_tokens, n_rare, log_likelihood (of known words, and of there being a rare one), logs, once."""
    weights = ids.sparkSession.sparkContext.broadcast(net.flat)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(weights.value)
        for part in parts(batches, 2, PART_BYTES):
            texts = _texts(part, 2)
            here, sums = Positions(texts), np.zeros(len(texts))
            for low in range(0, len(here), BLOCK):
                around, target, owner = here.take(np.arange(low, min(len(here), low + BLOCK)))
                sums += np.bincount(owner, net.log_probabilities(around, target).astype(np.float64), len(texts))
            rare = [int((t == RARE).sum()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([len(t) for t in texts], pa.int64()), pa.array(rare, pa.int64()), pa.array(sums), part.column(3), part.column(4)],
                names=["row", "doc_id", "n_tokens", "n_rare", "log_likelihood", "logs", "once"],
            )

    schema = "row long, doc_id long, n_tokens long, n_rare long, log_likelihood double, logs double, once long"
    return ids.select("row", "doc_id", "ids", "logs", "once").mapInArrow(job, schema)


def pseudo_likelihood(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, log_likelihood, per_token, perplexity, n_rare, n_once.

    Tokens are the words between blanks, A-Z made small. The counts of all words of all texts give the known ones (ties to the smaller
    hash); the network learns from every position of every text. A rare word is predicted as one, and then by its share of all rare
    words of the corpus; n_rare counts these, n_once those that the corpus has only here. The counts are joined by word; no word
    that is joined has over 1 / COUNTED of all tokens, so none is a hot key.

    Null and empty texts have no tokens, a log_likelihood of 0, and null per_token and perplexity. Repeated rows score alike; other
    columns are not read. No rows give no rows.
    """
    counts = written(word_counts(docs), "word-counts")
    words, n = frequent(counts)
    total = counts.agg(F.sum("n")).first()[0] or 0
    ids = written(encoded(docs, words, n), "encoded")
    rest = ids.select("row", F.explode("rest").alias("word")).join(counts, "word").groupBy("row")
    rest = rest.agg(F.sum(F.log("n")).alias("more_logs"), F.count(F.when(F.col("n") == 1, 1)).alias("more_once"))
    net = trained(ids, rounds, Network.unigram(n[:KNOWN], total), max(1, -(-total // SHARD_TOKENS)))
    out = network_scores(ids, net).join(rest, "row", "left")
    scale = float(np.log(max(1, total - int(n[:KNOWN].sum()))))
    rare = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_rare") * F.lit(scale)
    out = out.withColumn("log_likelihood", F.col("log_likelihood") + rare).withColumn("n_once", F.col("once") + F.coalesce("more_once", F.lit(0)))
    per_token = F.col("log_likelihood") / F.when(F.col("n_tokens") > 0, F.col("n_tokens"))
    return out.select("doc_id", "n_tokens", "log_likelihood", per_token.alias("per_token"), F.exp(-per_token).alias("perplexity"), "n_rare", "n_once")


def op3_masked_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pseudo-likelihood; null and empty texts, repeats and rows without doc_id as ``pseudo_likelihood`` says."""
    return pseudo_likelihood(documents(spark, sf_dir))
