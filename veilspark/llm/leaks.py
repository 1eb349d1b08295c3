"""Benchmark decontamination over a positional inverted index of the whole corpus.

build_index tokenises the corpus once and stores, shard by shard (a shard is a block of
documents), the postings of every word: the distinct terms in order, how often each occurs, and
its positions. The search takes a phrase's terms in order of corpus frequency, rarest first: the
rarest term's postings, moved by its offset in the phrase, propose starts; each further term's
list, moved likewise, intersects them, until all terms agree (exact phrase). For proximity,
windows of slop + 1 words around the rarest term are searched that hold every term as often as
the phrase does.

The benchmark is read in blocks of BLOCK_BYTES of text at most; a block's terms and phrases are
what is broadcast, so their size is bounded whatever the benchmark's. The index is written once
to the shared folder; every block reads it for its terms' frequencies and for its search.

Defined cases: null text has no words; an item without item_id is ignored, as is one without
words; rows with the same item_id are one item; a null doc_id is carried along; repeated rows
each get their result; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import _packed, _tables, _text
from veilspark.llm.suffixes import _ranges

WINDOW, SLOP, BLOCK_BYTES = 10, 11, 4 << 20
#: Candidate starts that are intersected at a time; further ones follow in the next round.
ROUND = 1 << 20

_INDEX = "shard long, doc_ids array<long>, n_words array<int>, terms binary, counts binary, positions binary"


def _tokens(block: _text.Block) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and where each row's words begin."""
    data = _text.LOWER[block.data]
    starts, ends, at = _text.Block(data, block.offs, 0).words(_text.NOT_ALNUM)
    return _text.over_bytes(data).of(starts, ends), at


class Phrases:
    """The windows of a block of benchmark items, over the block's own term numbers."""

    def __init__(self, items: pa.Table, window: int = WINDOW):
        names = items.column(0).to_pylist()
        self.items = sorted(set(names))
        number = {x: k for k, x in enumerate(self.items)}
        item = np.array([number[x] for x in names], np.int64)
        found = [_tokens(block) for block in _text.blocks(items.column(1))]
        words = np.concatenate([h for h, _ in found]) if found else np.zeros(0, np.uint64)
        n = np.concatenate([np.diff(at) for _, at in found]) if found else np.zeros(0, np.int64)
        self.hashes, term = np.unique(words, return_inverse=True)
        many = np.where(n > 0, np.maximum(n - window + 1, 1), 0)
        row = np.repeat(np.arange(len(n)), many)
        start = _ranges(np.cumsum(n) - n, many)
        inside = np.arange(window) < n[row][:, None]
        cells = np.where(inside, start[:, None] + np.arange(window), 0)
        windows = np.where(inside, term.astype(np.int32)[cells], -1) if len(row) else np.zeros((0, window), np.int32)
        self.words, phrase = np.unique(windows, axis=0, return_inverse=True)
        pairs = np.unique(phrase.reshape(-1).astype(np.int64) * max(len(self.items), 1) + item[row])
        self.owner = pairs % max(len(self.items), 1)
        self.owner_at = np.searchsorted(pairs // max(len(self.items), 1), np.arange(len(self.words) + 1))

    def ordered(self, frequency: np.ndarray, near: bool = False) -> Phrases:
        """Arrange each phrase's terms by frequency, rarest first, and list phrases by their rarest term."""
        real = self.words >= 0
        self.size = real.sum(1)
        often = np.where(real, frequency[np.maximum(self.words, 0)] if len(frequency) else 0, np.iinfo(np.int64).max)
        order = np.argsort(often, axis=1, kind="stable")
        self.term, self.shift = np.take_along_axis(self.words, order, 1), order.astype(np.int16)
        anchors = self.term[:, 0]
        self.by_anchor = np.argsort(anchors, kind="stable")
        self.anchor_at = np.searchsorted(anchors[self.by_anchor], np.arange(len(self.hashes) + 1))
        # How often a phrase has a term, at the term's first place in the order.
        self.need = np.zeros((len(self.words), self.words.shape[1] if near else 0), np.int16)
        for k in range(self.need.shape[1]):
            same = self.term == self.term[:, k : k + 1]
            self.need[:, k] = np.where(same[:, :k].any(1) | (self.term[:, k] < 0), 0, same.sum(1))
        del self.words
        return self


def build_index(docs: DataFrame) -> DataFrame:
    """One row a shard: its documents and their numbers of words, and the postings of all its words.

    terms (uint64, ascending), counts (uint32) and positions (int32, by term, as differences) are
    compressed. A shard's documents stand one word apart, from position 1 on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            for block in _text.blocks(batch.column(1)):
                hashes, at = _tokens(block)
                words = np.diff(at)
                place = np.arange(len(hashes)) + np.repeat(np.arange(block.n), words) + 1
                order = np.argsort(hashes, kind="stable")
                terms, counts = np.unique(hashes[order], return_counts=True)
                positions = np.diff(place[order], prepend=0).astype(np.int32)
                rows = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                packed = [pa.array([_packed.squeezed(x.tobytes())], pa.binary()) for x in (terms, counts.astype(np.uint32), positions)]
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), rows(batch.column(0).slice(block.lo, block.n)), rows(pa.array(words, pa.int32())), *packed], names=[x.split()[0] for x in _INDEX.split(", ")])
                shard += 1

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, _INDEX)


def _unpacked(value: pa.Scalar, kind: str) -> np.ndarray:
    data = value.as_py()
    return np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd"), kind)


def _known(terms: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of a shard's terms the benchmark has, and their numbers there; both ascend."""
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    spot = np.minimum(np.searchsorted(hashes, terms), len(hashes) - 1)
    use = np.flatnonzero(hashes[spot] == terms)
    return use, spot[use]


def _frequencies(index: DataFrame, hashes) -> np.ndarray:
    """Occurrences of each term over all documents; at most as many rows as the block has terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(hashes.value), np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column(0), batch.column(1), strict=True):
                use, number = _known(_unpacked(terms, "u8"), hashes.value)
                total[number] += _unpacked(counts, "u4")[use]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["term", "n"])

    rows = index.select("terms", "counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(hashes.value), np.int64)
    out[rows["term"].to_numpy(int)] = rows["n"].to_numpy(int)
    return out


class _Shard:
    """A shard's postings of the block's terms, as one ascending list of term * size + position."""

    def __init__(self, p: Phrases, row: dict[str, pa.Scalar]):
        self.words = np.asarray(row["n_words"].values).astype(np.int64)
        self.base = np.cumsum(self.words + 1) - self.words  # position of a document's first word
        use, number = _known(_unpacked(row["terms"], "u8"), p.hashes)
        counts = _unpacked(row["counts"], "u4").astype(np.int64)
        self.place = np.cumsum(_unpacked(row["positions"], "i4"), dtype=np.int64)[_ranges((np.cumsum(counts) - counts)[use], counts[use])]
        self.term = np.repeat(number, counts[use])
        # Positions beyond either end that a phrase may ask for belong to no list.
        self.size = int(self.words.sum()) + len(self.words) + p.term.shape[1] + 2
        self.lists = self.term * self.size + self.place

    def row(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, place, side="right") - 1

    def holds(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether a term's list has a position."""
        want = term * np.int64(self.size) + place
        spot = np.minimum(np.searchsorted(self.lists, want), len(self.lists) - 1)
        return self.lists[spot] == want

    def within(self, term: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First entry of a term's list between two positions, and how many there are."""
        first = np.searchsorted(self.lists, term * np.int64(self.size) + lo)
        return first, np.searchsorted(self.lists, term * np.int64(self.size) + hi, side="right") - first

    def proposed(self, p: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Phrases and a place of their rarest term, some rounds at a time."""
        fan = np.diff(p.anchor_at)[self.term]
        use = np.flatnonzero(fan)
        total = np.concatenate([[0], np.cumsum(fan[use])])
        lo = 0
        while lo < len(use):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + ROUND, side="right")) - 1)
            part = use[lo:hi]
            yield p.by_anchor[_ranges(p.anchor_at[self.term[part]], fan[part])], np.repeat(self.place[part], fan[part])
            lo = hi

    def exact(self, p: Phrases, phrase: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrase, first place and end of each match: lists moved by their terms' offsets and intersected, rarest first."""
        start = place - p.shift[phrase, 0]
        for k in range(1, p.term.shape[1]):
            want = p.term[phrase, k]
            keep = (want < 0) | self.holds(want, start + p.shift[phrase, k])
            start, phrase = start[keep], phrase[keep]
        return phrase, start, start + p.size[phrase]

    def near(self, p: Phrases, phrase: np.ndarray, place: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Phrase, first place and end of each window of slop + 1 words that holds the rarest term's place and all terms, and begins with a term."""
        row = self.row(place)
        lo, end = np.maximum(place - slop, self.base[row]), (self.base + self.words)[row]

        def filled(phrase: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            keep = np.arange(len(phrase))
            for k in range(p.need.shape[1]):
                of = phrase[keep]
                keep = keep[self.within(p.term[of, k], lo[keep], hi[keep])[1] >= p.need[of, k]]
            return keep

        some = filled(phrase, lo, np.minimum(place + slop, end - 1))
        step = max(1, ROUND // (slop + 1))
        for at in range(0, len(some), step):
            part = some[at : at + step]
            which, starts = [], []
            for k in range(p.need.shape[1]):
                use = part[p.need[phrase[part], k] > 0]
                first, many = self.within(p.term[phrase[use], k], lo[use], place[use])
                which.append(np.repeat(use, many))
                starts.append(self.lists[_ranges(first, many)] % self.size)
            which, start = np.concatenate(which), np.concatenate(starts)
            fits = filled(phrase[which], start, np.minimum(start + slop, end[which] - 1))
            which, start = which[fits], start[fits]
            yield phrase[which], start, np.minimum(start + slop + 1, end[which])


class _Found:
    """Matches of a shard: covered places, and the items of each document."""

    def __init__(self, p: Phrases, shard: _Shard):
        self.p, self.shard, self.pairs = p, shard, []
        self.delta = np.zeros(shard.size + 1, np.int32)

    def add(self, phrase: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        np.add.at(self.delta, start, 1)
        np.add.at(self.delta, end, -1)
        many = np.diff(self.p.owner_at)[phrase]
        own = self.p.owner[_ranges(self.p.owner_at[phrase], many)]
        self.pairs.append(np.unique(np.repeat(self.shard.row(start), many) * len(self.p.items) + own))

    def columns(self) -> list[pa.Array]:
        """starts and ends of the merged spans, and items, of each document."""
        n, base = len(self.shard.words), self.shard.base
        edge = np.diff((np.cumsum(self.delta) > 0).astype(np.int8), prepend=0)
        begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # documents stand apart, so spans do
        row = self.shard.row(begins)
        offsets = pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32())
        spans = [pa.ListArray.from_arrays(offsets, pa.array(v - base[row], pa.int32())) for v in (begins, ends)]
        pairs = np.unique(np.concatenate(self.pairs)) if self.pairs else np.zeros(0, np.int64)
        names = [self.p.items[x] for x in (pairs % max(len(self.p.items), 1)).tolist()]
        at = np.searchsorted(pairs // max(len(self.p.items), 1), np.arange(n + 1))
        return [*spans, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(names, pa.string()))]


def _search(index: DataFrame, phrases, slop: int | None) -> DataFrame:
    """shard, row, doc_id, n_words, starts, ends array<int> (word spans of matches, merged), items array<string>; with slop the same of proximity matches."""
    kinds = ["starts array<int>", "ends array<int>", "items array<string>"]
    schema = ", ".join(["shard long", "row int", "doc_id long", "n_words long", *kinds, *(f"near_{k}" for k in kinds if slop is not None)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = phrases.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
                shard = _Shard(p, row)
                exact, near = _Found(p, shard), _Found(p, shard)
                for phrase, place in shard.proposed(p):
                    exact.add(*shard.exact(p, phrase, place))
                    for match in shard.near(p, phrase, place, slop) if slop is not None else ():
                        near.add(*match)
                n = len(shard.words)
                columns = [pa.array(np.full(n, row["shard"].as_py())), pa.array(np.arange(n), pa.int32()), row["doc_ids"].values, pa.array(shard.words), *exact.columns(), *(near.columns() if slop is not None else ())]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    return index.mapInArrow(run, schema)


def _merged(prefix: str) -> F.Column:
    """Spans of several blocks, of which some overlap, as spans that do not."""
    return F.expr(f"""aggregate(array_sort(flatten({prefix}spans)), cast(array() as array<struct<starts:int,ends:int>>), (a, x) ->
        if(size(a) > 0 and element_at(a, -1).ends >= x.starts,
           concat(slice(a, 1, size(a) - 1), array(named_struct('starts', element_at(a, -1).starts, 'ends', greatest(element_at(a, -1).ends, x.ends)))),
           concat(a, array(x))))""")


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, starts, ends (hit word spans), items (ids that occur).

    With slop also near_starts, near_ends, near_items: a phrase is near where slop + 1 words in a row
    hold all its terms, in any order, each as often as the phrase; such words from a term on are its span.
    """
    spark = docs.sparkSession
    items = benchmark.where("item_id is not null and text is not null").selectExpr("cast(item_id as string) item_id", "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(1.5 * total / block_bytes))
    index = _tables.written(build_index(docs), "postings")
    results = []
    for part in range(parts):
        rows = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        block = Phrases(rows.toArrow(), window)
        frequency = _frequencies(index, spark.sparkContext.broadcast(block.hashes))
        results.append(_search(index, spark.sparkContext.broadcast(block.ordered(frequency, near=slop is not None)), slop))
    prefixes = ["", "near_"][: 1 + (slop is not None)]
    every = results[0]
    if parts > 1:  # a document's spans and items come from several blocks
        for more in results[1:]:
            every = every.unionAll(more)
        several = [x for q in prefixes for x in (F.collect_list(F.arrays_zip(F.col(f"{q}starts").alias("starts"), F.col(f"{q}ends").alias("ends"))).alias(f"{q}spans"), F.array_distinct(F.flatten(F.collect_list(f"{q}items"))).alias(f"{q}items"))]
        every = every.groupBy("shard", "row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *several)
        for q in prefixes:
            every = every.withColumn(f"{q}spans", _merged(q)).withColumn(f"{q}starts", F.col(f"{q}spans.starts")).withColumn(f"{q}ends", F.col(f"{q}spans.ends"))
    hit = F.expr("cast(aggregate(zip_with(starts, ends, (a, b) -> b - a), 0, (s, x) -> s + x) as long)")
    spans = [x for q in prefixes for x in (F.col(f"{q}starts"), F.col(f"{q}ends"), F.array_sort(f"{q}items").alias(f"{q}items"))]
    return every.select("doc_id", "n_words", hit.alias("n_hit"), *spans)


def op2_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), slop=SLOP)
    size, sha = lambda c: F.size(c).cast("long"), lambda c: F.sha2(F.array_join(c, ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", size("items").alias("n_items"), sha("items").alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), size("near_items").alias("n_near"), sha("near_items").alias("near_sha256"))
