"""Packing documents into fixed windows of tokens by the online sum-of-squares rule."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, parts

WINDOW = 2048
END_ID = 1
#: Fill levels of a window: one for every so many tokens.
LEVELS = 32
#: Pieces are handed on in batches of about so many ids.
BATCH_IDS = 1 << 18
#: Bytes of text that are tokenised at once.
PART_BYTES = 1 << 21
#: Distinct words whose ids a process remembers, about 60 MB.
CACHED_WORDS = 250_000


def _apart(texts: pa.Array) -> pa.Array:
    """A-Z made small, and a space put where a letter a-z meets a sentence mark; texts that may hold a special token are left."""
    small = pc.ascii_lower(texts)
    small = pc.replace_substring_regex(small, r"([a-z])([.,;:!?])", r"\1 \2")
    small = pc.replace_substring_regex(small, r"([.,;:!?])([a-z])", r"\1 \2")
    return pc.if_else(pc.match_substring(texts, "<|"), texts, small)


class WordTokenizer:
    """Ids of whole texts, made from the ids of their words.

    The vocabulary drops white space, makes letters small, and never joins letters with a full stop, comma or the like, so each
    distinct word between these needs the tokenizer only once in a process.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = self.tokenizer.get_added_tokens_decoder().items()
        self.mark = next(((t.content, i) for i, t in sorted(special) if t.special and not t.normalized and t.content.startswith("<|")), None)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ends = np.zeros(1 << 16, np.int64)  # a word's ids end where the next one's begin
        self.ids = np.zeros(1 << 16, np.uint32)
        self.uses = np.zeros(1 << 16, np.int64)  # parts of texts that had the word

    def _forget(self) -> None:
        """Leave the words that were used most, half of CACHED_WORDS at most."""
        n, least = len(self.known), 2
        while (self.uses[:n] >= least).sum() > CACHED_WORDS // 2:
            least *= 2
        keep = np.flatnonzero(self.uses[:n] >= least)
        starts, sizes = self.ends[keep], self.ends[keep + 1] - self.ends[keep]
        after = np.cumsum(sizes)
        ids = self.ids[np.repeat(starts - after + sizes, sizes) + np.arange(sizes.sum())]
        words = np.array(list(self.known), object)[keep]
        self.clear()
        self._add(words.tolist(), ids, after)

    def _learn(self, words: list[str]) -> None:
        alone = words if self.mark is None else [w for w in words if "<|" in w]
        for at in range(0, len(alone), 4096):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(alone[at : at + 4096], add_special_tokens=False)]
            self._add(alone[at : at + 4096], np.array([i for x in found for i in x], np.uint32), np.cumsum([len(x) for x in found]))
        if len(alone) == len(words):
            return
        rest = [w for w in words if "<|" not in w] if alone else words
        mark, number = self.mark
        for at in range(0, len(rest), 256):  # with a special token after each word, many go in at once
            part = rest[at : at + 256]
            ids = np.array(self.tokenizer.encode(mark.join(part) + mark, add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(ids == number)
            self._add(part, ids[ids != number], ends - np.arange(len(part)))

    def _add(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        if not words:
            return
        first, end = len(self.known), int(self.ends[len(self.known)])
        while end + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while first + len(words) >= len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
            self.uses = np.concatenate((self.uses, np.zeros_like(self.uses)))
        self.ids[end : end + len(ids)] = ids
        self.ends[first + 1 : first + 1 + len(words)] = end + ends
        self.known.update(zip(words, range(first, first + len(words)), strict=True))

    def texts(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, then END_ID."""
        if len(self.known) > CACHED_WORDS:
            self._forget()
        whole = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = whole.take(pa.array(np.arange(len(whole))))  # a copy: kernels may misread the offsets of a slice
        pieces = pc.ascii_split_whitespace(_apart(whole))
        words = pieces.flatten().dictionary_encode()
        table = words.dictionary.to_pylist()
        self._learn([w for w in table if w not in self.known])
        place = np.fromiter(map(self.known.__getitem__, table), np.int64, len(table))
        self.uses[place] += 1
        starts = self.ends[place]
        sizes, index = self.ends[place + 1] - starts, words.indices.to_numpy()
        n = sizes[index]
        after = np.cumsum(n)
        ids = self.ids[np.repeat(starts[index] - after + n, n) + np.arange(after[-1] if len(after) else 0)]
        ends = np.concatenate(([0], after))[np.cumsum(pc.list_value_length(pieces).to_numpy())]
        low = 0
        for high in ends.tolist():
            yield np.append(ids[low:high], np.uint32(END_ID))
            low = high


class Windows:
    """Partly filled windows by fill level. A piece goes to the level at which the sum of squared counts grows least.

    A window at level k has more than (k-1)/levels of its room filled, at most k/levels. One that reaches the last level is
    done but for a rest smaller than a level, which the next document's first tokens fill.
    """

    def __init__(self, size: int, first_id: int, levels: int = LEVELS):
        self.size, self.levels, self.grain, self.next_id = size, levels, size // levels, first_id
        self.counts = np.zeros(levels, np.int64)  # the level array; level 0 is a new window and stays 0
        self.tops = np.zeros(levels, np.int64)  # tokens in the window of each level that is taken first
        self.open: list[list[list]] = [[] for _ in range(levels)]  # of each level windows as [tokens, pieces]
        self.short: list | None = None
        self.closed: list[tuple] = []
        self.placed = {"whole": 0, "rest": 0, "rule": 0, "end": 0}  # tokens: whole windows, the small rests, by the rule, moved at the end

    def place(self, doc: int | None, ids: np.ndarray) -> None:
        start, tokens = 0, len(ids)
        if self.short:
            start = min(self.size - self.short[0], tokens)
            self._add(self.short, (doc, 0, ids[:start].copy(), tokens))
            self.placed["rest"] += start
        while tokens - start >= self.size:
            self._close([(doc, start, ids[start : start + self.size].copy(), tokens)])
            self.placed["whole"] += self.size
            start += self.size
        if start < tokens:
            self.placed["rule"] += tokens - start
            self._by_rule((doc, start, ids[start:].copy(), tokens))

    def _by_rule(self, piece: tuple) -> None:
        n = len(piece[2])
        filled = self.tops + n
        target = -(-filled // self.grain)
        # A level that is left loses 2c-1, one that is reached gains 2c+1, the last one counts for nothing.
        gain = np.where(target < self.levels, 2 * self.counts[np.minimum(target, self.levels - 1)] + 1, 0)
        growth = gain - 2 * self.counts + 1
        growth[0] -= 1
        growth[target == np.arange(self.levels)] = 0
        growth[(filled > self.size) | ((self.counts == 0) & (np.arange(self.levels) > 0))] = np.iinfo(np.int64).max
        level = self.levels - 1 - int(np.argmin(growth[::-1]))  # of equals the fullest
        window = [0, []]
        if level:
            window = self.open[level].pop()
            self._count(level, -1)
        self._add(window, piece)

    def _count(self, level: int, by: int) -> None:
        self.counts[level] += by
        self.tops[level] = self.open[level][-1][0] if self.open[level] else 0

    def _add(self, window: list, piece: tuple) -> None:
        window[0] += len(piece[2])
        window[1].append(piece)
        level = -(-window[0] // self.grain)
        if level < self.levels:
            self.open[level].append(window)
            self._count(level, 1)
            return
        full = window[0] == self.size
        self.short = None if full else window
        if full:
            self._close(window[1])

    def _close(self, window: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, tokens in window:
            self.closed.append((doc, start, ids, tokens, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def finish(self) -> None:
        """Close what is open. The fullest windows are filled up from the emptiest; the last one is cut to powers of two."""
        rest = [w for level in self.open for w in level] + ([self.short] if self.short else [])
        rest.sort(key=lambda w: w[0])
        self.counts[:], self.tops[:], self.open, self.short = 0, 0, [[] for _ in range(self.levels)], None
        first = 0
        while rest:
            filled, pieces = rest.pop()
            while filled < self.size and first < len(rest):
                doc, start, ids, tokens = rest[first][1].pop()
                part = ids[: self.size - filled]
                pieces.append((doc, start, part, tokens))
                filled += len(part)
                rest[first][0] -= len(part)
                self.placed["end"] += len(part)
                if len(part) < len(ids):
                    rest[first][1].append((doc, start + len(part), ids[len(part) :], tokens))
                first += not rest[first][1]
            if filled == self.size:
                self._close(pieces)
            else:
                self._powers(pieces, filled)
            if first >= len(rest):
                break

    def _powers(self, pieces: list[tuple], left: int) -> None:
        window, room = [], 0
        for doc, start, ids, tokens in pieces:
            while len(ids):
                room = room or 1 << (left.bit_length() - 1)
                part = ids[:room]
                window.append((doc, start, part, tokens))
                start, ids, room, left = start + len(part), ids[room:], room - len(part), left - len(part)
                if not room:
                    self._close(window)
                    window = []

    def taken(self) -> list[tuple]:
        out, self.closed = self.closed, []
        return out


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    """One for each path in a process; what it remembers does not change any result."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    long = lambda values: pa.array(values, pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            long([r[0] for r in rows]),
            long([r[1] for r in rows]),
            long([len(r[2]) for r in rows]),
            pa.array([r[2].astype("<u4").tobytes() for r in rows], pa.binary()),
            long([r[3] for r in rows]),
            long([r[4] for r in rows]),
            long([r[5] for r in rows]),
        ],
        names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
    )


def packed(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32 bit), doc_tokens, sequence_id, offset.

    Each task packs its own rows as they come, so nothing is shuffled: whole windows are cut from a long document, what is left is
    placed by the rule. A window that is filled but for less than a level takes the first tokens of the next document. When a
    task ends, its fullest open windows are filled from its emptiest, and the last one is cut to powers of two, so nothing is
    padded. Sequence ids hold the task's number in the high bits and are the same if the task runs again on the same rows.

    A null or empty text has the closing id alone. Rows without doc_id and repeated rows are packed like others. Other columns
    are not read. No rows give no rows.
    """

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, windows = _tokenizer(tokenizer), Windows(window, TaskContext.get().partitionId() << 32)
        waiting, n_waiting = [], 0
        for part in parts(batches, 1, PART_BYTES):
            for doc, ids in zip(part.column(0).to_pylist(), words.texts(part.column(1)), strict=True):
                windows.place(doc, ids)
                rows = windows.taken()
                waiting += rows
                n_waiting += sum(len(r[2]) for r in rows)
                if n_waiting >= BATCH_IDS:
                    yield _batch(waiting)
                    waiting, n_waiting = [], 0
        windows.finish()
        yield _batch(waiting + windows.taken())

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(job, SCHEMA)


def in_table_order(docs: DataFrame) -> DataFrame:
    """The rows of a Parquet table in the order in which they were written, which a plain scan does not keep.

    Spark numbers a table's files as the sorted ranges that they were written from; rows are dealt to tasks by file and place.
    A DataFrame that does not come from files is left as it is.
    """
    place = F.struct(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int").alias("f"), F.col("_metadata.file_name").alias("n"), F.col("_metadata.row_index").alias("r"))
    try:
        rows = docs.select(F.struct(*docs.columns).alias("caller"), place.alias("place"))
    except AnalysisException:
        return docs
    n = max(1, docs.rdd.getNumPartitions())
    return rows.repartitionByRange(n, "place").sortWithinPartitions("place").select(*[F.col("caller").getField(c).alias(c) for c in docs.columns])


def word_vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece of every document, ids as their CRC-32; null texts, repeats and rows without doc_id as ``packed`` says."""
    pieces = packed(documents(spark, sf_dir), word_vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
