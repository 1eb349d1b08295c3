"""Near-copies by SuperMinHash: signatures, banding, verification on full sets, union-find groups.

A document's set holds the hashes of its distinct SHINGLE-word sequences. Each element fills the
slots of the signature along its own random permutation, one more slot a round, with values that
grow with the round; a row stops as soon as all its slots are filled, since later values cannot
be smaller. Documents with one set are one class, represented by its least doc_id; all further
steps see representatives only. Signatures are cut into BANDS bands of ROWS slots. The
least class of a band is its pivot; all classes that share bands with one pivot form its star.
Within a star every two classes are compared on full sets, as products of element matrices, and
only links that tie groups together leave the task. A star beyond BLOCK_ELEMENTS is cut into
blocks: first each block with the pivot, then the members that are not in the pivot's group
with all blocks. So no candidate pair is dropped, and none is shuffled. At similarity 0.75 a
link is missed by all bands with odds of 5e-6. Union-find joins the links.

Defined cases: null or empty text has the empty set and links with nothing; fewer words than a
shingle make one element; a row without doc_id is not compared, is kept and has no component;
rows that share a doc_id are each judged by their own text; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import _tables, _text

SHINGLE, BANDS, ROWS, PERCENT = 5, 32, 4, 75
#: A block of a star has about so many elements and members at most; elements are counted so many at a time.
BLOCK_ELEMENTS, BLOCK_ROWS, COLUMNS = 1_000_000, 1000, 1024
#: Elements of the small stars that share a group, on average; their number of groups follows from it.
BUCKET_ELEMENTS = 250_000
#: So many links at most (some 100 MB of Python objects) are joined in one task.
LOCAL_LINKS = 500_000
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sets(block: _text.Block, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of each distinct element, by row and hash; where each row begins."""
    data = _text.LOWER[block.data]
    starts, ends, at = _text.Block(data, block.offs, 0).words(_text.SPACE)
    size = np.diff(at)
    row = np.repeat(np.arange(block.n), size)
    place = np.arange(len(row)) - at[row]
    width = np.minimum(size[row], shingle)
    use = np.flatnonzero(place + width <= size[row])
    hashes = _text.Running(_text.over_bytes(data).of(starts, ends)).of(use, use + width[use])
    row = row[use]
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    row, hashes = row[new], hashes[new]
    return row, hashes, np.searchsorted(row, np.arange(block.n + 1))


def signatures(row: np.ndarray, hashes: np.ndarray, n: int, slots: int) -> np.ndarray:
    """SuperMinHash of n sets given as (row, element hash) pairs: (n, slots) of round * 2**32 + draw."""
    out = np.full(n * slots, _EMPTY)
    low, shift = np.uint64(0xFFFFFFFF), np.uint64(32)
    history: list[np.ndarray] = []
    table: np.ndarray | None = None
    for j in range(slots):
        if not len(row):
            break
        x = _text.mix(hashes + np.uint64((0x9E3779B97F4A7C15 * (j + 1)) & 0xFFFFFFFFFFFFFFFF))
        swap = j + (((x >> shift) * np.uint64(slots - j)) >> shift).astype(np.int64)
        if table is None:
            slot = swap
            for past in range(j - 1, -1, -1):
                slot = np.where(slot == history[past], past, slot)
            history.append(swap)
        else:
            each = np.arange(len(row))
            slot = table[each, swap].astype(np.int64)
            table[each, swap] = table[:, j]
            table[:, j] = slot
        np.minimum.at(out, row * slots + slot, (np.uint64(j) << shift) | (x & low))
        open_rows = (out.reshape(n, slots) == _EMPTY).any(1)
        stay = open_rows[row]
        if not stay.all():
            row, hashes = row[stay], hashes[stay]
            history = [h[stay] for h in history]
            table = table[stay] if table is not None else None
        if table is None and j == 5 and len(row):
            table = np.tile(np.arange(slots, dtype=np.uint16), (len(row), 1))
            each = np.arange(len(row))
            for past, h in enumerate(history):
                held = table[each, h].copy()
                table[each, h] = table[:, past]
                table[:, past] = held
            history = []
    return out.reshape(n, slots)


def sketch(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, first and second long (the set's digest), bands array<long>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _text.blocks(batch.column(1)):
                row, hashes, at = _sets(block, shingle)
                slots = signatures(row, hashes, block.n, bands * rows).reshape(block.n, bands, rows)
                key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (block.n, bands))
                for k in range(rows):
                    key = _text.mix(key * np.uint64(0x9FB21C651E98DF25) + slots[:, :, k])
                digests = []
                for salt in (0x1B873593, 0x85EBCA6B):
                    total = np.zeros(len(hashes) + 1, np.uint64)
                    np.cumsum(_text.mix(hashes ^ np.uint64(salt)), out=total[1:])
                    digests.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
                size = np.diff(at)
                edges = np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))])
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(key[size > 0].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, block.n), pa.array(size, pa.int64()), *(pa.array(d) for d in digests), lists], names=["doc_id", "n_shingles", "first", "second", "bands"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, first long, second long, bands array<long>")


def _full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id and its sorted elements, array<long>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _text.blocks(batch.column(1)):
                _, hashes, at = _sets(block, shingle)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, block.n), lists], names=["id", "elements"])

    return docs.select("doc_id", "text").mapInArrow(run, "id long, elements array<long>")


def _common(rows: list[np.ndarray], others: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of sets, each with each (of rows, or of rows with others)."""
    many = len(rows)
    sets = rows + (others or [])
    sizes = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    elements, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    use = shared[column]
    owner, column = owner[use], number[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((many, len(others) if others else many), np.float32)
    edges = np.searchsorted(column, np.arange(0, int(shared.sum()) + COLUMNS, COLUMNS))
    for k in range(len(edges) - 1):
        lo, hi = edges[k], edges[k + 1]
        grid = np.zeros((len(sets), COLUMNS), np.float32)
        grid[owner[lo:hi], column[lo:hi] - k * COLUMNS] = 1
        out += grid[:many] @ (grid[many:] if others else grid).T
    return out.astype(np.int64)


def _alike(common: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (left[:, None] + right[None, :] - common)


def _links(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that tie together all sets that are alike, directly or through others: one a node at most."""
    n = len(ids)
    size = np.array([len(x) for x in sets], np.int64)
    label = np.arange(n)
    if n <= 6:
        for i in range(n):
            for j in range(i + 1, n):
                if label[i] != label[j] and 100 * min(size[i], size[j]) >= percent * max(size[i], size[j]):
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * common >= percent * (size[i] + size[j] - common):
                        label[label == max(label[i], label[j])] = min(label[i], label[j])
    else:
        near = _alike(_common(sets), size, size, percent)
        np.fill_diagonal(near, True)
        while True:
            least = np.where(near, label, n).min(1)
            least = least[least]
            if (least == label).all():
                break
            label = least
    return [(ids[i], ids[label[i]]) for i in range(n) if label[i] != i]


def _set_of(rows: pa.Table) -> list[np.ndarray]:
    column = rows.column("elements").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    values, at = np.asarray(column.values), np.asarray(column.offsets)
    return [values[lo:hi] for lo, hi in zip(at[:-1], at[1:], strict=True)]


def _pair_table(links: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def _star_links(percent: int):
    """Links within each star (pivot) of a group."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("pivot", "ascending"), ("id", "ascending")])
        pivot, ids, sets = np.asarray(rows.column("pivot")), rows.column("id").to_pylist(), _set_of(rows)
        heads = np.flatnonzero(np.concatenate([[True], pivot[1:] != pivot[:-1]])).tolist()
        links: list[tuple[int, int]] = []
        for lo, hi in zip(heads, [*heads[1:], len(ids)], strict=True):
            links += _links(ids[lo:hi], sets[lo:hi], percent)
        return _pair_table(links)

    return run


def _cross_links(percent: int):
    """Links between a block of a star's members and a block of its members that are in other groups."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        loose = np.asarray(rows.column("loose"))
        ids, roots, sets = np.asarray(rows.column("id")), np.asarray(rows.column("root")), _set_of(rows)
        left, right = np.flatnonzero(loose), np.flatnonzero(~loose)
        if not len(left) or not len(right):
            return _pair_table([])
        size = np.array([len(x) for x in sets], np.int64)
        near = _alike(_common([sets[i] for i in left], [sets[i] for i in right]), size[left], size[right], percent)
        near &= roots[left][:, None] != roots[right][None, :]
        links: set[tuple[int, int]] = set()
        for i, j in zip(*np.nonzero(near), strict=True):  # one link a pair of groups is enough
            a, b = int(roots[left[i]]), int(roots[right[j]])
            links.add((max(a, b), min(a, b)))
        return _pair_table(sorted(links))

    return run


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition to (node, least node it reaches in this partition)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    stars = [(x, r) for x in parent if (r := find(x)) != x]
    for lo in range(0, len(stars), 100_000):
        part = stars[lo : lo + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([r for _, r in part], pa.int64())], names=["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """node and the least node it is connected with, for all nodes of links (a, b) but the least ones.

    Up to LOCAL_LINKS links are one task's union-find. More are dealt out: each round joins links
    within partitions by union-find, ties the roots that a node has in several partitions, and
    moves each node on to its root's root; it ends when every node has one root and no root has.
    """
    if links.count() <= LOCAL_LINKS:
        return _tables.written(links.coalesce(1).mapInArrow(_union_find, "node long, root long"), "groups")
    stars = _tables.written(links.repartition("a").mapInArrow(_union_find, "node long, root long"), "ties")
    while True:
        roots = stars.groupBy("node").agg(F.collect_set("root").alias("roots")).withColumn("root", F.array_min("roots"))
        tied = _tables.written(roots.select(F.explode(F.concat(F.array("node"), "roots")).alias("node"), "root").where("node != root").distinct(), "ties")
        over = tied.select(F.col("node").alias("root"), F.col("root").alias("over"))
        several = tied.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if several.isEmpty() and tied.join(over, "root", "left_semi").isEmpty():
            return tied
        stars = _tables.written(tied.join(over, "root", "left").select("node", F.coalesce("over", "root").alias("root")).where("node != root").unionAll(tied.join(over.select("root"), "root", "left_semi").select("node", "root")).distinct().repartition("node").mapInArrow(_union_find, "node long, root long"), "ties")


def near_copies(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    made = _tables.written(sketch(docs, shingle, bands, rows), "sketch")
    digest = ["n_shingles", "first", "second"]
    classes = _tables.written(made.where("n_shingles > 0 and doc_id is not null").groupBy(*digest).agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")), "classes")

    members = classes.select("id", "n_shingles", F.explode("bands").alias("band"))
    pivots = members.groupBy("band").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    star = _tables.written(members.join(pivots.select("band", "pivot"), "band").select("id", "pivot", "n_shingles").distinct(), "stars")
    sets = _tables.written(_full_sets(_tables.likely(docs.selectExpr("cast(doc_id as long) doc_id", "text").where("doc_id is not null"), "doc_id", star.select(F.col("id").alias("doc_id"))), shingle), "sets")

    # A star is cut into blocks by its members' weight; its pivot is in every block.
    weight = F.greatest(F.ceil(F.sum("n_shingles") / BLOCK_ELEMENTS), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS)).cast("int")
    cut = _tables.written(star.groupBy("pivot").agg(weight.alias("cuts")), "cuts")
    block = F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int").alias("block")
    placed = star.where("id != pivot").join(cut, "pivot").select("id", "pivot", "cuts", block).unionAll(cut.select(F.col("pivot").alias("id"), "pivot", "cuts", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("block")))
    weights = star.agg(F.sum("n_shingles")).first()[0] or 0
    n = max(8, math.ceil(weights / BUCKET_ELEMENTS))
    bucket = F.pmod(F.xxhash64("pivot"), F.lit(n)).cast("int").alias("bucket")
    grouped = placed.join(sets, "id").select("id", "pivot", "elements", bucket, "block", F.when(F.col("cuts") > 1, F.col("pivot")).alias("hot"))
    links = _tables.written(grouped.repartition(n, "bucket", "hot", "block").groupBy("bucket", "hot", "block").applyInArrow(_star_links(percent), "a long, b long"), "links")
    groups = components(links)

    # Stars of several blocks: members outside the pivot's group meet all blocks.
    rooted = star.join(cut.where("cuts > 1"), "pivot").join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    if not cut.where("cuts > 1").isEmpty():
        home = rooted.where("id = pivot").select("pivot", F.col("root").alias("home"))
        rooted = _tables.written(rooted.join(home, "pivot").withColumn("loose", F.col("root") != F.col("home")), "rooted")
        free = rooted.where("loose").groupBy("pivot").agg(weight.alias("parts"))
        rooted = rooted.join(free, "pivot")  # a star without loose members is done
        part = F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int")
        columns = ["id", "pivot", "root", "block", "part", "loose"]
        fixed = rooted.withColumn("block", block).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("loose", F.lit(False)).select(*columns)
        moved = rooted.where("loose").withColumn("part", part).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).select(*columns)
        more = _tables.written(fixed.unionAll(moved).join(sets, "id").groupBy("pivot", "block", "part").applyInArrow(_cross_links(percent), "a long, b long"), "links")
        if not more.isEmpty():
            groups = components(links.unionAll(more))

    of_class = classes.select(*digest, "id").join(groups.withColumnRenamed("node", "id"), "id", "left").select(*digest, F.coalesce("root", "id").alias("component_id"))
    out = made.select("doc_id", *digest).join(of_class, digest, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op6_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
