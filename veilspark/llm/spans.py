"""Removal of repeated word windows, found through difference-cover anchors.

A window is WINDOW consecutive words of one document. Anchors are hashes of ANCHOR words at the
word positions that are, modulo PERIOD, in COVER: a set in which every difference modulo PERIOD
occurs, so two equal windows, wherever they start, have an anchor at the same offset in both.
Three passes, each dealing the documents into buckets whose number grows with their text:
1. anchors meet by hash; those that occur at two places are answered to their documents;
2. windows around such anchors meet by a 96-bit hash of all their words; all but the first
   (least document, then start) are answered as removed;
3. documents drop every word that a removed window covers.
In 1 and 2 a sender keeps one record a hash and answers its own repeats itself. Answers name a
row by its doc_id and a 32-bit digest of its text.

Defined cases: null or empty text has no words; a row without doc_id is not compared and loses
nothing; rows with the same doc_id are each judged by their own text, and of windows that start
at one place of one doc_id none is later; a shorter text than a window loses nothing; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import _packed, _tables, _text

WINDOW = 20
#: Difference cover and its period; with WINDOW words, anchors have WINDOW - PERIOD + 1 words.
COVER, PERIOD = (0, 1, 3, 9), 13
#: Anchors that a map task holds before it deals them out.
HELD = 1 << 20


class _Words:
    """Words of a block, their hashes, and the document of each row."""

    def __init__(self, block: _text.Block, ids: np.ndarray, known: np.ndarray):
        self.starts, self.ends, self.at = block.words(_text.SPACE)
        self.size = np.diff(self.at)
        self.row = np.repeat(np.arange(block.n), self.size)
        self.place = np.arange(len(self.row)) - self.at[self.row]
        self.left = self.size[self.row] - self.place
        self.ids, self.known = ids[block.lo : block.lo + block.n], known[block.lo : block.lo + block.n]
        self.block = block
        whole = memoryview(block.data)
        self.digest = np.array([zlib.crc32(whole[lo:hi]) for lo, hi in itertools.pairwise(block.offs.tolist())], np.uint32)

    def hashes(self) -> _text.Running:
        return _text.Running(_text.over_bytes(self.block.data).of(self.starts, self.ends))

    def places(self, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, text digest and place of words."""
        row = self.row[use]
        return self.ids[row], self.digest[row], self.place[use].astype(np.uint32)


def _firsts(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For sorted rows: which begin a new key."""
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return new


def _anchors(n: int, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    width = window - PERIOD + 1
    cover = np.isin(np.arange(PERIOD), COVER)

    def deal(parts: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[int, bytes]]:
        hashes, docs, texts, places = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((places, docs, hashes))
        new = _firsts(order, hashes)
        repeated = np.zeros(len(order), bool)
        repeated[order[~new]] = True
        heads = np.flatnonzero(new)
        several = np.diff(np.append(heads, len(order))) > 1
        repeated[order[heads[several]]] = True
        first = np.sort(order[heads])
        yield from _packed.dealt((hashes[first] % np.uint64(n)).astype(np.int64), hashes[first], docs[first], texts[first], places[first])
        own = np.flatnonzero(repeated)
        yield from ((_packed.direct(b), p) for b, p in _packed.dealt(_packed.id_bucket(docs[own], n), docs[own], texts[own], places[own]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        held, size = [], 0
        for batch in batches:
            ids, known = _text.ids(batch.column(0))
            for block in _text.blocks(batch.column(1)):
                w = _Words(block, ids, known)
                use = np.flatnonzero(cover[w.place % PERIOD] & (w.left >= width) & (w.size[w.row] >= window) & w.known[w.row])
                held.append((w.hashes().of(use, use + width), *w.places(use)))
                size += len(use)
                if size >= HELD:
                    yield from deal(held)
                    held, size = [], 0
        if held:
            yield from deal(held)

    return lambda batches: _packed.batches(rows(batches))


def _shared_anchors(n: int):
    def reduce(payloads: list[bytes]) -> Iterator[tuple[int, bytes]]:
        hashes, docs, texts, places = _packed.unpack(payloads, "u8", "i8", "u4", "u4")
        order = np.lexsort((places, docs, hashes))
        heads = np.flatnonzero(_firsts(order, hashes))
        many = np.diff(np.append(heads, len(order)))
        use = np.sort(order[np.repeat(many > 1, many)])
        yield from _packed.dealt(_packed.id_bucket(docs[use], n), docs[use], texts[use], places[use])

    return reduce


def _marked(w: _Words, docs: np.ndarray, texts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Word indexes in the block of (document, text digest, word place), which are sorted."""
    lo, hi = np.searchsorted(docs, w.ids, "left"), np.searchsorted(docs, w.ids, "right")
    lo, hi = np.where(w.known, lo, 0), np.where(w.known, hi, 0)
    many = hi - lo
    row = np.repeat(np.arange(len(many)), many)
    ends = np.cumsum(many)
    which = np.repeat(lo - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)
    spot = places[which].astype(np.int64)
    fits = (texts[which] == w.digest[row]) & (spot < w.size[row])
    return (w.at[row] + spot)[fits]


def _sorted_marks(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    docs, texts, places = _packed.unpack(payloads, "i8", "u4", "u4")
    order = np.lexsort((places, docs))
    return docs[order], texts[order], places[order]


def _windows(n: int, window: int):
    width = window - PERIOD + 1

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        marks = _sorted_marks(_packed.payloads(answers))
        if not len(marks[0]):
            return _packed.table(())
        ids, known = _text.ids(docs.column("doc_id"))
        parts = []
        for block in _text.blocks(docs.column("text")):
            w = _Words(block, ids, known)
            anchors = _marked(w, *marks)
            if not len(anchors):
                continue
            # Starts of windows that hold the whole anchor; those of another row are cut by left and place.
            delta = np.zeros(len(w.row) + 1, np.int64)
            np.add.at(delta, np.maximum(anchors - (window - width), w.at[w.row[anchors]]), 1)
            np.add.at(delta, anchors + 1, -1)
            use = np.flatnonzero((np.cumsum(delta[:-1]) > 0) & (w.left >= window))
            parts.append((*w.hashes().pair(use, use + window), *w.places(use)))
        if not parts:
            return _packed.table(())
        return _packed.table(_first_windows(n, parts))

    return run


def _first_windows(n: int, parts: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[int, bytes]]:
    hashes, checks, docs, texts, places = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((places, docs, checks, hashes))
    new = _firsts(order, hashes, checks)
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = (docs[order] != docs[head]) | (places[order] != places[head])
    first, own = np.sort(order[new]), np.sort(order[later])
    yield from _packed.dealt((hashes[first] % np.uint64(n)).astype(np.int64), hashes[first], checks[first], docs[first], texts[first], places[first])
    yield from ((_packed.direct(b), p) for b, p in _packed.dealt(_packed.id_bucket(docs[own], n), docs[own], texts[own], places[own]))


def _later_windows(n: int):
    def reduce(payloads: list[bytes]) -> Iterator[tuple[int, bytes]]:
        hashes, checks, docs, texts, places = _packed.unpack(payloads, "u8", "u4", "i8", "u4", "u4")
        order = np.lexsort((places, docs, checks, hashes))
        new = _firsts(order, hashes, checks)
        head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        later = np.sort(order[(docs[order] != docs[head]) | (places[order] != places[head])])
        yield from _packed.dealt(_packed.id_bucket(docs[later], n), docs[later], texts[later], places[later])

    return reduce


def _kept(window: int, keep_text: bool):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        marks = _sorted_marks(_packed.payloads(answers))
        ids, known = _text.ids(docs.column("doc_id"))
        sizes, removed, sums, texts = [], [], [], []
        for block in _text.blocks(docs.column("text")):
            w = _Words(block, ids, known)
            gone = _text.cover(_marked(w, *marks), window, len(w.row))
            lost = _text.row_sums(gone, w.at)
            for i in range(block.n):
                words = block.text(i).split()
                if lost[i]:
                    words = itertools.compress(words, ~gone[w.at[i] : w.at[i + 1]])
                joined = b" ".join(words)
                sums.append(hashlib.sha256(joined).hexdigest())
                if keep_text:
                    texts.append(joined.decode())
            sizes.append(w.size)
            removed.append(lost)
        number = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
        out = {"doc_id": docs.column("doc_id"), "n_words": number(sizes), "n_removed": number(removed), "kept_sha256": pa.array(sums, pa.string())}
        return pa.table(out | ({"text": pa.array(texts, pa.string())} if keep_text else {}))

    return run


def with_bucket(docs: DataFrame, n: int) -> DataFrame:
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").withColumn("bucket", _packed.id_bucket_column("doc_id", n, "text"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, keep_text: bool = False, bucket_bytes: int = _tables.BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept words joined by blanks."""
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    spark = docs.sparkSession
    n = _packed.prime(_tables.buckets(docs, bucket_bytes))
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    by_bucket = lambda df: _tables.dealt(df, n).groupBy("bucket")
    rows = with_bucket(docs, n)
    anchors = _tables.written(_packed.grouped(texts.mapInArrow(_anchors(n, window), _packed.SCHEMA), n, _shared_anchors(n)), "anchors")
    _tables.free(spark)
    removed = _tables.written(_packed.grouped(by_bucket(rows).cogroup(by_bucket(anchors)).applyInArrow(_windows(n, window), _packed.SCHEMA), n, _later_windows(n)), "repeats")
    _tables.dropped(anchors)
    kind = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * keep_text
    return by_bucket(rows).cogroup(by_bucket(removed)).applyInArrow(_kept(window, keep_text), kind)


def op4_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
