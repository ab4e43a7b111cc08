"""Quality rules: an ordered list of threshold conjunctions, learned by sequential covering and applied as Spark conditions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, parts, written
from .shingles import NOT_BLANK, rolling, word_hashes
from .toxicity import held_out

#: Labelled rows that rules are learned from, of each class; all counts and all verdicts cover every row.
MAX_ROWS_PER_CLASS = 20_000
#: Conditions of a rule and rules of a list, at most: a list stays readable.
CONDITIONS, RULES = 4, 24
#: A rule must be right so often on the rows kept aside for pruning.
PRECISION = 0.9
#: Candidate thresholds of a feature, by quantile of the labelled rows.
CUTS = 64
SYMBOLS = b"#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Further counts of a text, of which the features are shares.
MORE = ("n_lines", "n_upper", "n_letters", "n_digits", "n_marks", "n_ended_words", "n_short_words", "n_distinct_words", "n_alone_words", "top_word")

IS = {
    "symbol": bytes(int(b in SYMBOLS) for b in range(256)),
    "upper": bytes(int(65 <= b <= 90) for b in range(256)),
    "letter": bytes(int(65 <= b <= 90 or 97 <= b <= 122 or b >= 192) for b in range(256)),
    "digit": bytes(int(48 <= b <= 57) for b in range(256)),
    "mark": bytes(int(33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126) for b in range(256)),
    "point": bytes(int(not 128 <= b < 192) for b in range(256)),
}
TABLES = {k: np.frombuffer(v, np.uint8) for k, v in IS.items()}
BLANK = np.frombuffer(NOT_BLANK, np.uint8) == 0


def text_counts(texts: list[bytes]) -> np.ndarray:
    """COUNTS and MORE of each text, for many at once: a row of numbers a text."""
    n = len(texts)
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    begins = np.r_[0, ends[:-1] + 1] if n else ends
    per_text = lambda mask: (s := np.r_[0, np.cumsum(mask, dtype=np.int64)])[ends] - s[begins]
    word = ~BLANK[data]
    starts, hashes = word_hashes(data, word)
    stops = np.flatnonzero(np.diff(np.r_[word, False].astype(np.int8)) == -1) + 1
    owner = np.searchsorted(ends, starts, "right")
    n_words = np.bincount(owner, minlength=n)
    own = hashes ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    points = np.r_[0, np.cumsum(TABLES["point"][data], dtype=np.int64)]
    length = points[stops] - points[starts]

    # Words in windows of three that their text has twice.
    windows = rolling(own, 3)
    windows = windows[owner[2:] == owner[:-2]] if len(windows) else windows
    at = np.flatnonzero(owner[2:] == owner[:-2]) if len(owner) > 2 else np.zeros(0, np.int64)
    _, place, times = np.unique(windows, return_inverse=True, return_counts=True)
    again = at[times[place] > 1] if len(at) else at
    covered = np.zeros(len(owner) + 3, np.int64)
    for k in range(3):
        covered[again + k] = 1
    repeat = np.bincount(owner, covered[: len(owner)], n) if len(owner) else np.zeros(n)

    different, where, often = np.unique(own, return_index=True, return_counts=True)
    distinct = np.bincount(owner[where], minlength=n)
    alone = np.bincount(owner[where], often == 1, n) if len(where) else np.zeros(n)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, owner[where], often)
    last = data[stops - 1] if len(stops) else data[:0]
    ended = np.bincount(owner, TABLES["mark"][last], n) if len(owner) else np.zeros(n)
    short = np.bincount(owner, length <= 2, n) if len(owner) else np.zeros(n)
    dup = np.array([_repeated_lines(t) for t in texts], np.int64)
    columns = [
        n_words, per_text(TABLES["point"][data] * word), per_text(TABLES["symbol"][data]), dup, repeat,
        per_text(data == 10) + 1, *(per_text(TABLES[k][data]) for k in ("upper", "letter", "digit", "mark")), ended, short, distinct, alone, top,
    ]
    return np.stack([np.asarray(c, np.int64) for c in columns], axis=1) if n else np.zeros((0, len(COUNTS) + len(MORE)), np.int64)


def _repeated_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\n\x0b\f\r")]
    return len(lines) - len(set(lines))


def counted(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of its whole text; a null text has no words."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 1):
            found = text_counts([t or b"" for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.int64()) for c in found.T]], names=["doc_id", *COUNTS, *MORE])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in (*COUNTS, *MORE))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("text"))
    return rows.mapInArrow(job, schema)


#: Each feature is a share or a mean of two counts; the same expressions serve learning and judging.
FEATURES = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbols_a_word": ("n_symbols", "n_words"),
    "repeated_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "words_a_line": ("n_words", "n_lines"),
    "capitals": ("n_upper", "n_letters"),
    "digits": ("n_digits", "word_chars"),
    "marks": ("n_marks", "word_chars"),
    "ended_words": ("n_ended_words", "n_words"),
    "short_words": ("n_short_words", "n_words"),
    "distinct_words": ("n_distinct_words", "n_words"),
    "words_once": ("n_alone_words", "n_words"),
    "commonest_word": ("top_word", "n_words"),
}


def feature(name: str) -> Column:
    """A feature as a Spark expression of the counts; 0 where there is nothing to divide by."""
    if name == "n_words":
        return F.col(name).cast("double")
    over, under = FEATURES[name]
    return F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(F.lit(0.0))


NAMES = ("n_words", *FEATURES)


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    cut: float

    def column(self) -> Column:
        return feature(self.name) > self.cut if self.above else feature(self.name) <= self.cut

    def holds(self, table: np.ndarray) -> np.ndarray:
        values = table[:, NAMES.index(self.name)]
        return values > self.cut if self.above else values <= self.cut

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass
class DecisionList:
    """Rules in order; the first whose conditions all hold gives its verdict, else ``otherwise`` is the verdict."""

    rules: list[tuple[list[Condition], bool]] = field(default_factory=list)
    otherwise: bool = True

    def column(self) -> Column:
        """Whether a row is kept, as one CASE expression over the counts."""
        out: Column | None = None
        for conditions, verdict in self.rules:
            both = conditions[0].column()
            for c in conditions[1:]:
                both = both & c.column()
            out = F.when(both, F.lit(verdict)) if out is None else out.when(both, F.lit(verdict))
        return F.lit(self.otherwise) if out is None else out.otherwise(F.lit(self.otherwise))

    def judge(self, table: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(table), self.otherwise), np.ones(len(table), bool)
        for conditions, verdict in self.rules:
            hit = open_ & covered(conditions, table)
            out[hit], open_ = verdict, open_ & ~hit
        return out

    def __str__(self) -> str:
        lines = [f"{'keep' if verdict else 'drop'} if {' and '.join(map(str, conditions))}" for conditions, verdict in self.rules]
        return "\n".join([*lines, "keep otherwise" if self.otherwise else "drop otherwise"])


def covered(conditions: list[Condition], table: np.ndarray) -> np.ndarray:
    out = np.ones(len(table), bool)
    for c in conditions:
        out &= c.holds(table)
    return out


def grown(table: np.ndarray, bad: np.ndarray, weight: np.ndarray) -> list[Condition]:
    """Conditions one by one, each of the greatest information gain over the rows of the wanted class, until only these are left."""
    rule: list[Condition] = []
    while len(rule) < CONDITIONS:
        own = covered(rule, table)
        p0, n0 = weight[own & bad].sum(), weight[own & ~bad].sum()
        if not p0 or not n0:
            break
        best: tuple[float, Condition] | None = None
        for j, name in enumerate(NAMES):
            values, w = table[own, j], weight[own]
            order = np.argsort(values, kind="stable")
            values, w, wanted = values[order], w[order], bad[own][order]
            p, n = np.cumsum(w * wanted), np.cumsum(w * ~wanted)
            cuts = np.flatnonzero(values[1:] > values[:-1])
            if len(cuts) > CUTS * 16:
                cuts = cuts[np.linspace(0, len(cuts) - 1, CUTS * 16).astype(int)]
            for above in (False, True):
                ps, ns = (p0 - p[cuts], n0 - n[cuts]) if above else (p[cuts], n[cuts])
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(ps > 0, ps * (np.log2(ps / (ps + ns)) - np.log2(p0 / (p0 + n0))), -np.inf)
                if len(gain) and (best is None or gain.max() > best[0]):
                    at = cuts[int(np.argmax(gain))]
                    best = float(gain.max()), Condition(name, above, float((values[at] + values[at + 1]) / 2))
        if best is None or best[0] <= 1e-9:
            break
        rule.append(best[1])
    return rule


def worth(rule: list[Condition], table: np.ndarray, bad: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(p - n) / (p + n) and p over the rows that a rule covers."""
    own = covered(rule, table)
    p, n = weight[own & bad].sum(), weight[own & ~bad].sum()
    return ((p - n) / (p + n) if p + n else -1.0), p


def pruned(rule: list[Condition], table: np.ndarray, bad: np.ndarray, weight: np.ndarray) -> list[Condition]:
    """The rule without the last conditions that do not help on rows it was not grown from; the shortest of the best."""
    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r, table, bad, weight), -len(r)))


def learned(table: np.ndarray, good: np.ndarray, weight: np.ndarray, for_growing: np.ndarray) -> DecisionList:
    """Sequential covering of the bad rows: a rule is grown, pruned, and its rows are taken away; it ends with the first poor rule."""
    out, left = DecisionList(), np.ones(len(table), bool)
    bad = ~good
    for _ in range(RULES):
        grow, prune = left & for_growing, left & ~for_growing
        if not bad[grow].any():
            break
        rule = grown(table[grow], bad[grow], weight[grow])
        if not rule:
            break
        rule = pruned(rule, table[prune], bad[prune], weight[prune])
        value, p = worth(rule, table[prune], bad[prune], weight[prune])
        if (value + 1) / 2 < PRECISION or not p:
            break
        out.rules.append((rule, False))
        left &= ~covered(rule, table)
    return out


def learn(docs: DataFrame, labels: DataFrame) -> DecisionList:
    """Rules from the documents of labelled rows (doc_id, quality) that are not held out, at most MAX_ROWS_PER_CLASS of each class by hash order.

    Rows with a null id or label are not used; of several labels of a document the lowest counts. Classes weigh as in all labels.
    Two thirds of the rows, by hash, grow rules and the others prune them. With labels of one class only, or none, all is kept.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IS NOT NULL")
    known = known.where(~held_out("doc_id")).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sizes = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    picks = [known.where(F.col("quality") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_ROWS_PER_CLASS) for c in (0, 1)]
    picked = written(picks[0].unionByName(picks[1]), "labelled")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi")
    rows = counted(own).join(F.broadcast(picked), "doc_id")
    share = F.pmod(F.xxhash64(F.lit("prune"), "doc_id"), F.lit(3)) != 0
    found = rows.select("doc_id", "quality", share.alias("grow"), *[feature(n).alias(n) for n in NAMES]).toArrow().combine_chunks()
    if found.num_rows == 0:
        return DecisionList()
    found = found.sort_by([(c, "ascending") for c in ("doc_id", *NAMES)])
    good = found.column("quality").to_numpy() > 0
    if good.all() or not good.any():
        return DecisionList()
    per_row = {c: sizes[c] / max(1, (good == bool(c)).sum()) for c in (0, 1)}
    table = np.stack([found.column(n).to_numpy() for n in NAMES], axis=1)
    return learned(table, good, np.where(good, per_row[1], per_row[0]), found.column("grow").to_numpy(zero_copy_only=False))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judged(counts: DataFrame, rules: DecisionList) -> DataFrame:
    """The counts with base_failed and kept: the base rules first, then the learned list."""
    return counts.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.column())


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its counts and verdict; a null text has no words and fails, repeated rows fare alike."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rules = learn(docs, labels)
    return judged(counted(docs), rules).select("doc_id", *COUNTS, "base_failed", "kept")
