"""Exchange of packed arrays: one shuffled row holds all that a map task has for one bucket.

A bucket's payload is a sequence of equally long columns, so millions of small records cross
the shuffle as thousands of binary rows and are grouped with array operations. Every sender
keeps one record a key (its first), so a key that a third of all rows share arrives at its
bucket once a sender and not once a row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "bucket long, payload binary"


def prime(n: int) -> int:
    """The first prime from n on: buckets of arithmetic progressions of ids stay even."""
    n = max(n, 3)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def id_bucket(ids: np.ndarray, n: int) -> np.ndarray:
    """As id_bucket_column, in numpy."""
    return (ids ^ (ids.view(np.uint64) >> np.uint64(20)).view(np.int64)) % n


def id_bucket_column(name: str, n: int, otherwise: str):
    """Bucket of a document by its id; rows without id are dealt by their text."""
    return F.coalesce(F.expr(f"pmod({name} ^ shiftrightunsigned({name}, 20), {n}L)"), F.pmod(F.xxhash64(otherwise), F.lit(n)))


def pack(*columns: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def unpack(payloads: Iterable[bytes], *kinds: str) -> list[np.ndarray]:
    """The columns of several payloads, joined; kinds are numpy type names in packing order."""
    types = [np.dtype(k) for k in kinds]
    width = sum(t.itemsize for t in types)
    parts: list[list[np.ndarray]] = [[] for _ in types]
    for payload in payloads:
        n, at = len(payload) // width, 0
        for part, t in zip(parts, types, strict=True):
            part.append(np.frombuffer(payload, t, n, at))
            at += n * t.itemsize
    return [np.concatenate(p) if p else np.zeros(0, t) for p, t in zip(parts, types, strict=True)]


def dealt(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, payload) for each bucket that occurs; rows keep their order."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    heads = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    columns = [c[order] for c in columns]
    for lo, hi in zip(heads, [*heads[1:], len(order)], strict=True):
        yield int(sorted_[lo]), pack(*(c[lo:hi] for c in columns))


def squeezed(payload: bytes) -> bytes:
    """The payload compressed, after its size: shuffles and tables hold about half of what lz4 leaves."""
    return len(payload).to_bytes(8, "little") + pa.compress(payload, "zstd", asbytes=True)


def payloads(group: pa.Table) -> list[bytes]:
    """The payloads of a group's rows, as they were before squeezed()."""
    return [pa.decompress(p[8:], int.from_bytes(p[:8], "little"), "zstd", asbytes=True) for p in group.column("payload").to_pylist()]


#: A batch of rows to Spark closes at so many bytes.
BATCH_BYTES = 8 << 20


def batches(rows: Iterable[tuple[int, bytes]], names: tuple[str, str] = ("bucket", "payload")) -> Iterator[pa.RecordBatch]:
    keys, packed, size = [], [], 0
    make = lambda: pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(packed, pa.binary())], names=list(names))
    for key, payload in rows:
        keys.append(key)
        packed.append(squeezed(payload))
        size += len(packed[-1])
        if size >= BATCH_BYTES:
            yield make()
            keys, packed, size = [], [], 0
    if keys:
        yield make()


def table(rows: Iterable[tuple[int, bytes]]) -> pa.Table:
    """For functions that return a whole group's rows."""
    rows = [(k, squeezed(p)) for k, p in rows]
    return pa.table({"bucket": pa.array([k for k, _ in rows], pa.int64()), "payload": pa.array([p for _, p in rows], pa.binary())})


def direct(bucket: int) -> int:
    """Marks an answer for a document bucket that passes the next grouping unchanged."""
    return -1 - bucket


def grouped(sent: DataFrame, n: int, reduce) -> DataFrame:
    """Bring each of n buckets' payloads to reduce(list of payloads) -> rows; direct answers pass through."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        if bucket < 0:
            return pa.table({"bucket": pa.array([direct(bucket)] * group.num_rows, pa.int64()), "payload": group.column("payload")})
        return table(reduce(payloads(group)))

    return sent.repartition(n, "bucket").groupBy("bucket").applyInArrow(run, SCHEMA)
