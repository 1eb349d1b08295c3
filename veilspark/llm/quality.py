"""Quality rules: rule statistics per document, judged by an isolation forest.

rule_stats measures every whole text. A forest has TREES random-split trees, each grown where it is
drawn, on SAMPLE documents of its own out of the whole table (those of least hash of id and tree;
subsampling is the method's own); a row's mean path length over the trees, against the length
expected of an unsuccessful search, gives its anomaly score in (0, 1). fit sets the score above
which a document goes, from all labelled rows, counted by score in BINS bins: the cut with the
best share of bad rows caught, less GOOD_COST times the share of good ones; where no cut
separates them, or there are no labels, nothing is rejected by score. A quarter of the labelled
rows is held out from that and gives Forest.held_out.

Defined cases: a null or empty text has zero counts and fails the base rules; a null doc_id is
carried along and never sampled; repeated rows each get their result; an empty table gives an
empty result; columns beyond those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import _tables, _text

TREES, SAMPLE, SEED, GOOD_COST, BINS = 100, 256, 7, 10.0, 1 << 16
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: What the forest sees: ratios drawn towards 0 in short texts (as if PRIOR more clean characters stood there).
FEATURES = ("symbols", "symbol_words", "capitals", "marks", "stutters", "repetition", "word_length")
PRIOR = 100
_SYMBOL, _UPPER, _MARK = (np.zeros(256, bool) for _ in range(3))
_SYMBOL[[*b"#*$%&|<>"]] = True
_UPPER[0x41:0x5B] = True
_MARK[[*b"!?~^"]] = True


def _measure(block: _text.Block) -> tuple[np.ndarray, np.ndarray]:
    """Base statistics (n, 5) and features (n, 7) of a block's rows."""
    data, offs, n = block.data, block.offs, block.n
    starts, ends, at = block.words(_text.SPACE)
    running = _text.over_bytes(data)
    words = np.diff(at)
    in_word = ~_text.SPACE[data]
    chars = _text.row_sums(in_word & ((data & 0xC0) != 0x80), offs)
    symbols = _text.row_sums(_SYMBOL[data], offs)

    ls, le, lrow = block.lines()
    full = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    keys = _text.mix(running.of(ls, le) + _text.mix(lrow.astype(np.uint64) + np.uint64(1)))[full]
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[order[1:]] = keys[order][1:] == keys[order][:-1]
    dup_lines = np.bincount(lrow[full][again], minlength=n)

    hashes = running.of(starts, ends)
    row = np.repeat(np.arange(n), words)
    salted = _text.mix(row.astype(np.uint64) + np.uint64(1))
    w = np.arange(max(0, len(starts) - 4))
    w = w[row[w] == row[w + 4]] if len(w) else w
    keys = _text.mix(_text.Running(hashes).of(w, w + 5) + salted[w])
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(w), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    repeats = _text.row_sums(_text.cover(w[twice], 5, len(starts)), at)

    base = np.stack([words, chars, symbols, dup_lines, repeats], 1).astype(np.int64)
    drawn = lambda count, total, prior: count / (total + prior)
    of = lambda table: drawn(_text.row_sums(table[data], offs), chars, PRIOR)
    marked = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SYMBOL[data], out=marked[1:])
    odd = _text.row_sums(marked[ends] > marked[starts], at)
    stutter = np.zeros(len(starts), bool)
    stutter[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    # Repeated words and lines together; how far from 5 characters a word is on average.
    length = np.abs(np.log((chars + PRIOR) / (words + PRIOR / 5) / 5))
    features = np.stack([of(_SYMBOL), drawn(odd, words, PRIOR / 5), of(_UPPER), of(_MARK), drawn(_text.row_sums(stutter, at), words, PRIOR / 5), drawn(repeats + dup_lines, words, PRIOR / 5), length], 1)
    return base, features


def rule_stats(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, features array<double>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0)
            for block in _text.blocks(batch.column(1)):
                base, features = _measure(block)
                yield pa.RecordBatch.from_arrays([key.slice(block.lo, block.n).cast(pa.int64()), *(pa.array(base[:, i]) for i in range(5)), pa.array(list(features), pa.list_(pa.float64()))], names=names)

    schema = f"doc_id long, {BASE}, features array<double>"
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """Trees as flat arrays: split feature (-1: leaf), cut, children, path length at the leaf."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        size = min(sample, len(rows))
        self._set([self.tree(rows[rng.choice(len(rows), size, replace=False)], size, rng) for _ in range(trees)], size)

    def _set(self, trees: list[tuple[np.ndarray, ...]], size: int) -> None:
        self.trees, self.size = trees, size
        self.threshold, self.held_out = np.inf, None

    @classmethod
    def of(cls, trees: list[tuple[np.ndarray, ...]], size: int) -> Forest:
        """Of trees that are grown, each on size rows."""
        out = cls.__new__(cls)
        out._set(trees, size)
        return out

    @staticmethod
    def tree(rows: np.ndarray, size: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, path = [], [], [], [], []
        limit = max(1, int(np.ceil(np.log2(max(size, 2)))))

        def grow(part: np.ndarray, depth: int) -> int:
            me = len(feature)
            for x, v in zip((feature, cut, left, right, path), (-1, 0.0, 0, 0, 0.0), strict=True):
                x.append(v)
            lo, hi = part.min(0), part.max(0)
            usable = np.flatnonzero(hi > lo)
            if depth >= limit or len(part) < 2 or not len(usable):
                path[me] = depth + float(_mean_path(len(part)))
                return me
            f = int(rng.choice(usable))
            c = float(rng.uniform(lo[f], hi[f]))
            feature[me], cut[me] = f, c
            below = part[:, f] < c
            if below.all() or not below.any():
                below = part[:, f] <= lo[f]
                cut[me] = float(np.nextafter(lo[f], np.inf))
            left[me], right[me] = grow(part[below], depth + 1), grow(part[~below], depth + 1)
            return me

        grow(rows, 0)
        return np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(path)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for rows that few splits isolate."""
        total, each = np.zeros(len(rows)), np.arange(len(rows))
        for feature, cut, left, right, path in self.trees:
            node = np.zeros(len(rows), np.int64)
            while True:
                f = feature[node]
                if not (inner := f >= 0).any():
                    break
                node = np.where(inner, np.where(rows[each, f] < cut[node], left[node], right[node]), node)
            total += path[node]
        return 2.0 ** (-total / len(self.trees) / max(float(_mean_path(self.size)), 1e-9))

    def calibrate(self, bins: np.ndarray, good: np.ndarray, out: np.ndarray, count: np.ndarray, good_cost: float) -> None:
        """Set the threshold from counts of labelled rows by score (in steps of 1 / BINS, rounded up) but those held out; held_out: of these, the shares of good ones kept and of bad ones caught, and their numbers."""
        table = np.zeros((2, 2, BINS + 1), np.int64)  # held out, good
        np.add.at(table, (out.astype(int), good.astype(int), bins), count)
        above = table.sum(2)[:, :, None] - table.cumsum(2)  # rows beyond each cut
        bad, seen = table[0].sum(1)
        if seen and bad:
            caught, lost = above[0]
            best = int(np.argmax(caught - good_cost * lost * bad / seen))
            # A cut is used only where it catches bad rows at a far higher rate than good ones.
            if caught[best] / bad > 5 * lost[best] / seen:
                self.threshold = best / BINS
        bad, seen = table[1].sum(1)
        over = np.zeros(2) if self.threshold == np.inf else above[1][:, int(self.threshold * BINS)]
        self.held_out = float(1 - over[1] / seen) if seen else float("nan"), float(over[0] / bad) if bad else float("nan"), int(seen), int(bad)


def _subsamples(rows: DataFrame, share: float) -> DataFrame:
    """tree, hash, features: for each tree the documents whose hash lies under that share of all hashes."""
    bound = np.uint64(min(int(share * 2**63), 2**63 - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0)).view(np.uint64)
            for tree in range(TREES):
                h = _text.mix(_text.mix(ids) ^ _text.mix(np.array([SEED * TREES + tree + 1], np.uint64))) >> np.uint64(1)
                use = np.flatnonzero(h <= bound)
                if len(use):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(use), tree, np.int32)), pa.array(h[use].view(np.int64)), batch.column(1).take(pa.array(use))], names=["tree", "hash", "features"])

    drawn = rows.select("doc_id", "features").mapInArrow(run, "tree int, hash long, features array<double>")
    return drawn.groupBy("tree", "hash").agg(F.min("features").alias("features"))


def _grown(stats: DataFrame) -> Forest | None:
    """The forest of a whole table; the driver gets its trees and no rows. None on an empty table."""
    rows = stats.where("n_words >= 10 and doc_id is not null")
    n = rows.agg(F.count_distinct("doc_id")).first()[0]
    if not n:
        return None
    size = min(SAMPLE, n)

    def grow(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("hash").slice(0, size)
        tree = key[0].as_py()
        part = np.array(group.column("features").to_pylist(), float).reshape(-1, len(FEATURES))
        grown = Forest.tree(part, size, np.random.default_rng([SEED, tree]))
        return pa.table({"tree": pa.array([tree], pa.int32())} | {k: pa.array([x], pa.list_(pa.float64())) for k, x in zip(names, grown, strict=True)})

    names = ("feature", "cut", "left", "right", "path")
    # Twice as many as a tree takes lie under the bound on average; fewer than it takes do with odds of some exp(-78).
    drawn = _subsamples(rows, 2 * SAMPLE / n)
    got = drawn.groupBy("tree").applyInArrow(grow, "tree int, " + ", ".join(f"{k} array<double>" for k in names)).orderBy("tree").collect()
    whole = lambda k, x: np.array(x, float if k in ("cut", "path") else np.int64)
    return Forest.of([tuple(whole(k, r[k]) for k in names) for r in got], size)


def fit(stats: DataFrame, labels: DataFrame | None, good_cost: float = GOOD_COST) -> Forest | None:
    """The forest, and its threshold from all labelled rows that the base rules leave; None on an empty table."""
    forest = _grown(stats)
    if forest is None or labels is None:
        return forest
    model = stats.sparkSession.sparkContext.broadcast(forest)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            scores = model.value.score(flat) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.ceil(scores * BINS).astype(np.int64))], names=["doc_id", "bin"])

    marked = labels.where("doc_id is not null and quality is not null").selectExpr("cast(doc_id as long) doc_id", "quality").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    fair = stats.where("n_words >= 10 and 100 * n_repeat_words <= 20 * n_words and doc_id is not null").select("doc_id", "features")
    binned = _tables.likely(fair, "doc_id", marked).mapInArrow(bins, "doc_id long, bin long").groupBy("doc_id").agg(F.min("bin").alias("bin"))
    out = (F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(4)) == 0).alias("out")
    got = binned.join(marked, "doc_id").groupBy("bin", "good", out).count().collect()
    if got:
        column = lambda k: np.array([r[k] for r in got])
        forest.calibrate(column("bin"), column("good"), column("out"), column("count"), good_cost)
    return forest


def judge(stats: DataFrame, forest: Forest | None) -> DataFrame:
    """stats with base_failed, anomaly (double) and kept."""
    base = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    if forest is None:
        return stats.withColumn("anomaly", F.lit(0.0)).withColumn("base_failed", base).withColumn("kept", ~base).drop("features")
    model = stats.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.asarray(batch.column(batch.num_columns - 1).flatten()).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.value.score(flat) if batch.num_rows else np.zeros(0))], names=names)

    names = ["doc_id", *(x.split()[0] for x in BASE.split(", ")), "anomaly"]
    scored = stats.select("doc_id", *names[1:-1], "features").mapInArrow(run, f"doc_id long, {BASE}, anomaly double")
    return scored.withColumn("base_failed", base).withColumn("kept", ~base & (F.col("anomaly") <= F.lit(float(forest.threshold))))


def accepted(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """The rows of docs, with all their columns, that judge() keeps; nothing is shuffled."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(forest)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            keep = [np.zeros(0, bool)]
            for block in _text.blocks(batch.column(text)):
                base, features = _measure(block)
                good = (base[:, 0] >= 10) & (100 * base[:, 4] <= 20 * base[:, 0])
                keep.append(good if m is None else good & (m.score(features) <= m.threshold))
            yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)


def filter_quality(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """docs without the documents that the base rules or the forest reject."""
    stats = _tables.written(rule_stats(docs), "rules")
    forest = fit(stats, labels)
    _tables.dropped(stats)
    return accepted(docs, forest)


def quality(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    stats = _tables.written(rule_stats(docs), "rules")
    return judge(stats, fit(stats, labels))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
