"""Removal of byte strings that earlier documents hold, decided by suffix arrays.

A string is LENGTH bytes. Its key is the least hash of the GRAM-byte grams in it, so equal
strings have equal keys; successive strings of a document with one key form a stretch. Passes,
over buckets whose number grows with the text:
1. keys meet by value; those that two documents hold are answered to their documents. Keys with
   more than HOT different stretches are marked in a bitmap of fixed size;
2. stretches with shared keys meet by key, a marked key's as single strings keyed by all their
   bytes. The stretches of each key are put into suffix order (suffixes.py), where equal strings
   are neighbours, compared byte by byte; so each string gets the least document that holds it;
3. documents drop each byte that a string with a smaller document covers.
A sender keeps one record a key (1) or stretch (2), with its least document, and finds its own
documents' runs again in 3, so nothing is sent once an occurrence. Of records with one text, two
are sorted: the one of the least document, and another whose answer holds for the rest. A bitmap
slot that several keys share only makes more keys hot, for all documents alike.

Defined cases: null or empty text has no bytes; a row without doc_id is not compared and loses
nothing; rows with the same doc_id are one document; a text shorter than LENGTH loses nothing;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import _packed, _tables, _text
from veilspark.llm.spans import _firsts, with_bucket
from veilspark.llm.suffixes import _ranges, suffix_order, suffix_orders

LENGTH, GRAM = 50, 20
#: (key, document) pairs that a map task holds before it deals them out; bytes of stretches that are
#: looked at together (more where one key has more); bytes hashed and codes sorted at once.
HELD, SLICE, BLOCK, SORTED, TOGETHER = 1 << 20, 8 << 20, 1 << 20, 1 << 19, 16
#: Codes of a key's stretches beyond which its strings are dealt to smaller units before they are sorted.
HEAVY = 512
#: Different stretches of a key beyond which it is taken apart, and bits of the bitmap of such keys.
HOT, HOT_BITS = 20_000, 22


class _Stretches:
    """A block's stretches: key, first string, number of strings, row."""

    def __init__(self, block: _text.Block, known: np.ndarray, length: int, gram: int):
        self.running = _text.over_bytes(block.data)
        n = len(block.data)
        strings = n - length + 1
        if strings <= 0:
            self.key = np.zeros(0, np.uint64)
            self.start = self.count = self.row = np.zeros(0, np.int64)
            return
        least, size, width = self.running.grams(gram), 1, length - gram + 1
        while 2 * size <= width:
            least, size = np.minimum(least[:-size], least[size:]), 2 * size
        if size < width:
            least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
        # No string begins in the last bytes of a row, or in a row without id.
        begins, ends = block.offs[:-1], block.offs[1:]
        edge = np.zeros(n + 1, np.int8)
        np.add.at(edge, np.where(known, np.maximum(begins, ends - length + 1), begins), 1)
        np.add.at(edge, ends, -1)
        inside = np.cumsum(edge, dtype=np.int8)[:strings] == 0
        new = np.ones(strings, bool)
        new[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
        new[begins[begins < strings]] = True
        heads = np.flatnonzero(new)
        count = np.diff(np.append(heads, strings))
        use = inside[heads]
        self.start, self.count = heads[use], count[use]
        self.key, self.row = least[self.start], np.searchsorted(block.offs, self.start, side="right") - 1


def _is_hot(keys: np.ndarray, hot: np.ndarray | None) -> np.ndarray:
    """Which keys the bitmap marks."""
    if hot is None:
        return np.zeros(len(keys), bool)
    slot = _text.mix(keys) >> np.uint64(64 - HOT_BITS)
    return (hot[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


def _apart(running: _text.Running, start: np.ndarray, count: np.ndarray, key: np.ndarray, length: int, hot: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Stretches, those with hot keys as single strings with keys of their own, and which stretch each is of."""
    each = np.arange(len(start))
    loose = _is_hot(key, hot)
    if not loose.any():
        return start, count, key, each
    many = np.where(loose, count, 1)
    of = np.repeat(each, many)
    begin = start[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    single = loose[of]
    key = key[of]
    key[single] = running.of(begin[single], begin[single] + length)
    return begin, np.where(single, 1, count[of]), key, of


def _token(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """One number for a key in a document; a chance match only brings a candidate more."""
    return _text.mix(keys ^ _text.mix(docs.view(np.uint64)))


def _ordered(keys: np.ndarray, more: np.ndarray) -> np.ndarray:
    """As np.lexsort((more, keys)), equal rows in any order; only equal keys take more than a sort of plain numbers."""
    order = np.argsort(keys)
    fresh = _firsts(order, keys)
    tied = ~fresh
    tied[:-1] |= ~fresh[1:]
    at = np.flatnonzero(tied)
    if len(at):
        part, group = order[at], np.cumsum(fresh)[at]
        second = more[part]
        lo, hi = int(second.min()), int(second.max())
        if hi < 1 << 62 and lo > -(1 << 62) and (hi - lo + 1) * (len(keys) + 1) < 1 << 62:
            by = np.argsort(group * (hi - lo + 1) + (second.astype(np.int64) - lo))
        else:
            by = np.lexsort((second, group))
        order[at] = part[by]
    return order


class _Places:
    """np.searchsorted in ascending hashes that are spread evenly: their high bits tell nearly where."""

    def __init__(self, table: np.ndarray):
        bits = max(1, len(table).bit_length())
        self.shift = np.uint64(64 - bits)
        self.edges = np.searchsorted(table, np.arange(1 << bits, dtype=np.uint64) << self.shift)
        self.table = np.append(table, np.uint64(2**64 - 1))

    def of(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each is or would be, and whether it is there."""
        at = self.edges.take((wanted >> self.shift).view(np.int64))
        left = (self.table.take(at) < wanted).nonzero()[0]
        while len(left):
            at[left] += 1
            left = left.take((self.table.take(at.take(left)) < wanted.take(left)).nonzero()[0])
        return at, (self.table.take(at) == wanted) & (at < len(self.table) - 1)


def _heads(keys: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows in order, where each key begins among them, and how many it has."""
    order = _ordered(keys, more)
    order = order[_firsts(order, keys, more)]
    heads = np.flatnonzero(_firsts(order, keys))
    return order, heads, np.diff(np.append(heads, len(order)))


def _keys(n: int, length: int, gram: int):
    def deal(parts: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[int, bytes]]:
        keys, docs, names = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, heads, many = _heads(keys, docs)
        by_name, name_heads, different = _heads(keys, names)
        own, first = order[np.repeat(many > 1, many)], order[heads]
        yield from _packed.dealt((_text.mix(keys[first]) % np.uint64(n)).astype(np.int64), keys[first], docs[first], names[by_name[name_heads]], different.astype(np.uint32))
        yield from ((_packed.direct(b), p) for b, p in _packed.dealt(_packed.id_bucket(docs[own], n), _token(keys[own], docs[own])))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        held, size = [], 0
        for batch in batches:
            ids, known = _text.ids(batch.column(0))
            for block in _text.blocks(batch.column(1)):
                s = _Stretches(block, known[block.lo : block.lo + block.n], length, gram)
                names = s.running.quick(s.start, s.start + s.count + length - 1).astype(np.uint32)
                held.append((s.key, ids[block.lo + s.row], names))
                size += len(s.key)
                if size >= HELD:
                    yield from deal(held)
                    held, size = [], 0
        if held:
            yield from deal(held)

    return lambda batches: _packed.batches(rows(batches))


def _shared_keys(n: int, hot: int):
    """Answers shared keys to their documents; keys with more than hot different stretches go to bucket n."""

    def reduce(payloads: list[bytes]) -> Iterator[tuple[int, bytes]]:
        keys, docs, names, different = _packed.unpack(payloads, "u8", "i8", "u4", "u4")
        order, _, many = _heads(keys, docs)
        use = order[np.repeat(many > 1, many)]
        yield from _packed.dealt(_packed.id_bucket(docs[use], n), _token(keys[use], docs[use]))
        by_name, heads, firsts = _heads(keys, names)
        by_key = np.argsort(keys)
        more = np.add.reduceat(different[by_key].astype(np.int64) - 1, np.flatnonzero(_firsts(by_key, keys))) if len(keys) else firsts
        found = keys[by_name[heads[firsts + more > hot]]]
        if len(found):
            yield n, _packed.pack(found)

    return reduce


def _hot_keys(keys: DataFrame, n: int) -> np.ndarray | None:
    """The bitmap of hot keys: 2 ** HOT_BITS bits, whatever their number."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (found,) = _packed.unpack(_packed.payloads(pa.Table.from_batches([batch])), "u8")
            slot = _text.mix(found) >> np.uint64(64 - HOT_BITS)
            bit = np.uint64(1) << (slot & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(6)).astype(np.int64)), pa.array(bit.view(np.int64))], names=["word", "bits"])

    rows = keys.where(f"bucket = {n}").mapInArrow(spread, "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).collect()
    if not rows:
        return None
    out = np.zeros(1 << (HOT_BITS - 6), np.int64)
    out[[r["word"] for r in rows]] = [r["bits"] for r in rows]
    return out.view(np.uint64)


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Those pieces of data, joined; the places of BLOCK bytes at a time are in memory."""
    total = np.cumsum(sizes)
    out = np.empty(int(total[-1]) if len(total) else 0, np.uint8)
    for lo, hi in _cuts(total, BLOCK):
        out[total[lo] - sizes[lo] : total[hi - 1]] = data[_ranges(starts[lo:hi], sizes[lo:hi])]
    return out


def _candidates(n: int, length: int, gram: int, hot):
    """A document bucket's distinct stretches with shared keys, each with its least document, to the keys' buckets."""

    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        (tokens,) = _packed.unpack(_packed.payloads(answers), "u8")
        tokens = np.unique(tokens)
        if not len(tokens):
            return _packed.table(())
        tokens = _Places(tokens)
        ids, known = _text.ids(docs.column("doc_id"))
        names, keys, owners, sizes, texts = [], [], [], [], []
        for block in _text.blocks(docs.column("text")):
            s = _Stretches(block, known[block.lo : block.lo + block.n], length, gram)
            owner = ids[block.lo + s.row]
            token = _token(s.key, owner)
            use = np.flatnonzero(tokens.of(token)[1])
            if len(use):
                start, count, found, of = _apart(s.running, s.start[use], s.count[use], s.key[use], length, hot.value)
                size = count + length - 1
                names.append(s.running.of(start, start + size))
                keys.append(found)
                owners.append(owner[use[of]])
                sizes.append(size)
                texts.append(_gather(block.data, start, size))
        if not names:
            return _packed.table(())
        names, keys, owners, sizes, texts = (np.concatenate(x) for x in (names, keys, owners, sizes, texts))
        starts = np.cumsum(sizes) - sizes
        order = _ordered(names, owners)
        heads = np.flatnonzero(_firsts(order, names))
        first = order[heads]
        several = (np.maximum.reduceat(owners[order], heads) != owners[first]).astype(np.uint8)
        bucket = (_text.mix(keys[first]) % np.uint64(n)).astype(np.int64)

        def rows() -> Iterator[tuple[int, bytes]]:
            by = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.concatenate([[True], bucket[by][1:] != bucket[by][:-1]]))
            for lo, hi in zip(edges, [*edges[1:], len(by)], strict=True):
                k = by[lo:hi]
                f = first[k]
                head = struct.pack("<qq", key[0].as_py(), len(k))
                yield int(bucket[k[0]]), head + _packed.pack(keys[f], owners[f], several[k], sizes[f].astype(np.uint32), _gather(texts, starts[f], sizes[f]))

        return _packed.table(rows())

    return run


def _read(payloads: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of each record by key: origin bucket, key, least document, whether of several, size; and their texts, joined."""
    parts = []
    for payload in payloads:
        origin, n = struct.unpack_from("<qq", payload)
        columns, at = [np.full(n, origin)], 16
        for kind in ("u8", "i8", "u1", "u4"):
            columns.append(np.frombuffer(payload, kind, n, at))
            at += columns[-1].nbytes
        parts.append((*columns, np.frombuffer(payload, np.uint8, -1, at)))
    origins, keys, docs, several, sizes, data = (np.concatenate(x) for x in zip(*parts, strict=True))
    sizes = sizes.astype(np.int64)
    order = np.argsort(keys)
    texts = _gather(data, (np.cumsum(sizes) - sizes)[order], sizes[order])
    return origins[order], keys[order], docs[order], several[order], sizes[order], texts


def _equal(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the strings of length bytes at a and b are equal, eight bytes at a time."""
    wide = min(length, 8)
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(8, np.uint8)]), 8).copy().view("<u8")[:, 0]
    mask = np.uint64((1 << (8 * wide)) - 1)
    same = np.ones(len(a), bool)
    for k in (*range(0, length - wide, wide), length - wide):
        same &= (words[a + k] ^ words[b + k]) & mask == 0
    return same


def least_documents(text: np.ndarray, sizes: np.ndarray, docs: np.ndarray, units: np.ndarray, length: int) -> np.ndarray:
    """For each string of length bytes in each record, the least document of its unit's records that hold it.

    text holds the records one after the other, units where each unit's records begin (and their end).
    """
    ends = np.cumsum(sizes)
    record = np.repeat(np.arange(len(sizes)), sizes)
    codes = np.zeros(len(text) + len(sizes), np.int64)  # 0 parts the records
    codes[np.arange(len(text)) + record] = text.astype(np.int64) + 1
    edge = np.concatenate([[0], ends + np.arange(1, len(sizes) + 1)])[units]
    if len(edge) == 2:
        order = np.array(suffix_order(codes.tolist()), np.int64)
    else:
        order = suffix_orders(codes, edge)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    place = order - owner[order]  # in text
    whole = (codes[order] > 0) & (place + length <= ends[owner[order]])
    place = place[whole]
    strings = np.maximum(sizes - length + 1, 0)
    answer = np.repeat(docs, strings)
    if len(place):
        heads = np.flatnonzero(np.concatenate([[True], ~_equal(text, place[1:], place[:-1], length)]))
        of = record[place]
        least = np.repeat(np.minimum.reduceat(docs[of], heads), np.diff(np.append(heads, len(place))))
        first = np.cumsum(strings) - strings
        answer[first[of] + place - (ends - sizes)[of]] = least
    return answer


def _representatives(keys: np.ndarray, docs: np.ndarray, sizes: np.ndarray, text: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which records stand for all with their text, two at most of each; and the record each one takes its answer from.

    The record of the least document stands for itself, that of the next one for all others.
    """
    order = np.lexsort((docs, names, keys))
    head = np.flatnonzero(_firsts(order, keys, names))
    many = np.diff(np.append(head, len(order)))
    nth = np.arange(len(order)) - np.repeat(head, many)
    second = np.repeat(order[head + np.minimum(many - 1, 1)], many)
    stands, source = np.ones(len(keys), bool), np.arange(len(keys))
    more = order[nth > 1]
    if len(more):
        like = second[nth > 1]
        starts = np.cumsum(sizes) - sizes
        alike = sizes[more] == sizes[like]
        more, like = more[alike], like[alike]
        alike = np.zeros(len(more), bool)
        for lo, hi in _cuts(np.cumsum(sizes[more]), BLOCK):
            a, b, size = starts[more[lo:hi]], starts[like[lo:hi]], sizes[more[lo:hi]]
            differ = text[_ranges(a, size)] != text[_ranges(b, size)]
            alike[lo:hi] = ~np.logical_or.reduceat(differ, np.cumsum(size) - size)
        stands[more[alike]] = False
        source[more[alike]] = like[alike]
    return stands, source


def _least(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, docs: np.ndarray, heads: np.ndarray, many: np.ndarray, length: int) -> np.ndarray:
    """As least_documents, of units with any numbers of records (from heads on, many of them) anywhere in text."""
    strings = sizes - length + 1
    first = np.cumsum(strings) - strings
    answer = np.repeat(docs, strings)
    weight = np.add.reduceat(sizes + 1, heads) if len(heads) else many
    # Units of one record need no order; the others by weight, so that those sorted together take equally long.
    left = np.flatnonzero(many > 1)
    left = left[np.argsort(weight[left], kind="stable")]
    for lo, hi in _cuts(np.cumsum(weight[left]), SORTED):
        unit = left[lo:hi]
        # A step of the common sort costs as much as some TOGETHER codes of a sort by itself.
        for part in [unit] if weight[unit].sum() >= TOGETHER * weight[unit[-1]] else unit[:, None]:
            use = _ranges(heads[part], many[part])
            found = least_documents(_gather(text, starts[use], sizes[use]), sizes[use], docs[use], np.concatenate([[0], np.cumsum(many[part])]), length)
            answer[_ranges(first[use], strings[use])] = found
    return answer


def _taken_apart(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, docs: np.ndarray, keys: np.ndarray, length: int) -> np.ndarray:
    """As least_documents, of all records of some keys, sorted in units that do not grow with a key.

    Strings whose hash one document holds alone are found nowhere else. The others are joined where the
    same one follows at every occurrence: all occurrences of such a segment are equal unless hashes
    collide, and meet as records of a key of their own. Equal strings come to the same segments.
    """
    strings = sizes - length + 1
    place = _ranges(starts, strings)
    record = np.repeat(np.arange(len(sizes)), strings)
    hashes = np.zeros(len(place), np.uint64)
    at = np.concatenate([[0], np.cumsum(strings)])
    for lo, hi in _cuts(np.cumsum(sizes), BLOCK):
        part = sizes[lo:hi]
        begin = _ranges(np.cumsum(part) - part, strings[lo:hi])
        hashes[at[lo] : at[hi]] = _text.over_bytes(_gather(text, starts[lo:hi], part)).of(begin, begin + length)
    hashes ^= _text.mix(keys)[record]
    answer = docs[record]
    order = np.argsort(hashes)
    fresh = _firsts(order, hashes)
    heads = np.flatnonzero(fresh)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    same = lambda x: (np.minimum.reduceat(x[order], heads) == np.maximum.reduceat(x[order], heads))[group]
    shared = ~same(answer)
    both = shared[1:] & shared[:-1] & (record[1:] == record[:-1])
    after, before = np.full((2, len(order)), -1)
    after[:-1][both], before[1:][both] = group[1:][both], group[:-1][both]
    begins = shared.copy()
    begins[1:] &= ~(both & same(after)[:-1] & same(before)[1:])
    head = np.flatnonzero(begins)
    if not len(head):
        return answer
    count = np.bincount(np.cumsum(begins)[shared] - 1, minlength=len(head))
    by = np.argsort(group[head], kind="stable")
    head, count = head[by], count[by]
    size = count + length - 1
    key = group[head].view(np.uint64)
    stands, source, found = _standing(key, docs[record[head]], size, _gather(text, place[head], size), key, length, False)
    many = count[stands]
    each = (np.cumsum(stands) - 1)[source]
    answer[_ranges(head, count)] = found[_ranges((np.cumsum(many) - many)[each], count)]
    return answer


def _standing(keys: np.ndarray, docs: np.ndarray, sizes: np.ndarray, text: np.ndarray, names: np.ndarray, length: int, apart: bool = True) -> tuple[np.ndarray, ...]:
    """_representatives, and the least document of each string of those that stand; records of one key stand together."""
    stands, source = _representatives(keys, docs, sizes, text, names)
    chosen = np.flatnonzero(stands)
    starts, sizes, docs, keys = (np.cumsum(sizes) - sizes)[chosen], sizes[chosen], docs[chosen], keys[chosen]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    many = np.diff(np.append(heads, len(keys)))
    weight = np.add.reduceat(sizes + 1, heads)
    heavy = (weight > HEAVY) & (many > 1) & apart
    if not heavy.any():
        return stands, source, _least(text, starts, sizes, docs, heads, many, length)
    strings = sizes - length + 1
    first = np.cumsum(strings) - strings
    answer = np.zeros(int(strings.sum()), np.int64)
    light = np.flatnonzero(~heavy)
    use = _ranges(heads[light], many[light])
    answer[_ranges(first[use], strings[use])] = _least(text, starts[use], sizes[use], docs[use], np.cumsum(many[light]) - many[light], many[light], length)
    heavy = np.flatnonzero(heavy)
    for lo, hi in _cuts(np.cumsum(weight[heavy]), SORTED):
        use = _ranges(heads[heavy[lo:hi]], many[heavy[lo:hi]])
        answer[_ranges(first[use], strings[use])] = _taken_apart(text, starts[use], sizes[use], docs[use], keys[use], length)
    return stands, source, answer


def _string_documents(keys: np.ndarray, docs: np.ndarray, sizes: np.ndarray, text: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of strings with one least document: record, document, first and last + 1 string; names of the records.

    Records of one key are all here and stand together.
    """
    starts, ends = np.cumsum(sizes) - sizes, np.cumsum(sizes)
    names = np.zeros(len(keys), np.uint64)
    for lo, hi in _cuts(ends, BLOCK):
        begin = starts[lo]
        names[lo:hi] = _text.over_bytes(text[begin : ends[hi - 1]]).of(starts[lo:hi] - begin, ends[lo:hi] - begin)
    stands, source, answer = _standing(keys, docs, sizes, text, names, length)
    strings = sizes[stands] - length + 1
    first = np.cumsum(strings) - strings
    owner = np.repeat(np.arange(len(strings)), strings)
    new = np.ones(len(answer), bool)
    new[1:] = (answer[1:] != answer[:-1]) | (owner[1:] != owner[:-1])
    run = np.flatnonzero(new)
    begin = run - first[owner[run]]
    end = begin + np.diff(np.append(run, len(answer)))
    # Each record has the runs of the one it takes its answer from.
    place = (np.cumsum(stands) - 1)[source]
    run_at = np.searchsorted(owner[run], np.arange(len(strings) + 1))
    each = np.diff(run_at)[place]
    which = _ranges(run_at[place], each)
    return np.repeat(np.arange(len(keys)), each), answer[run[which]], begin[which].astype(np.uint32), end[which].astype(np.uint32), names


def _cuts(total: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of items of about size in all, one item at least; total: running sums."""
    lo = 0
    while lo < len(total):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + size, side="right")))
        yield lo, hi
        lo = hi


def _answers(length: int):
    def reduce(payloads: list[bytes]) -> Iterator[tuple[int, bytes]]:
        origins, keys, docs, several, sizes, text = _read(payloads)
        fresh = np.append(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])), len(keys))
        weight = np.cumsum(sizes)
        out = []
        for a, b in _cuts(weight[fresh[1:] - 1], SLICE):  # whole keys
            lo, hi = int(fresh[a]), int(fresh[b])
            record, least, begin, end, names = _string_documents(keys[lo:hi], docs[lo:hi], sizes[lo:hi], text[weight[lo] - sizes[lo] : weight[hi - 1]], length)
            use = (least < docs[lo + record]) | (several[lo + record] > 0)
            record = record[use]
            out.append((origins[lo + record], names[record], least[use], begin[use], end[use]))
        yield from _packed.dealt(*(np.concatenate(x) for x in zip(*out, strict=True)))

    return reduce


def _kept(length: int, gram: int, keep_text: bool, hot):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        names, least, lo, hi = _packed.unpack(_packed.payloads(answers), "u8", "i8", "u4", "u4")
        order = np.argsort(names)
        heads = np.flatnonzero(_firsts(order, names))
        of_name = np.append(np.diff(np.append(heads, len(order))), 0)
        places, heads = _Places(names[order[heads]]), np.append(heads, 0)
        names, least, lo, hi = names[order], least[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
        ids, known = _text.ids(docs.column("doc_id"))
        sizes, removed, spans, sums, texts = [], [], [], [], []
        for block in _text.blocks(docs.column("text")):
            gone = np.zeros(len(block.data), bool)
            if len(names):
                s = _Stretches(block, known[block.lo : block.lo + block.n], length, gram)
                start, count, _, of = _apart(s.running, s.start, s.count, s.key, length, hot.value)
                name = s.running.of(start, start + count + length - 1)
                at, found = places.of(name)
                a, many = heads[at], np.where(found, of_name[at], 0)
                ends = np.cumsum(many)
                stretch = np.repeat(np.arange(len(many)), many)
                which = np.repeat(a - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)
                use = (least[which] < ids[block.lo + s.row[of[stretch]]]) & (hi[which] <= count[stretch])
                stretch, which = stretch[use], which[use]
                gone = _text.cover(start[stretch] + lo[which], hi[which] - lo[which] + length - 1, len(block.data))
            lost = _text.row_sums(gone, block.offs)
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            edge = block.offs[:-1][block.offs[:-1] < len(gone)]
            begins[edge] = gone[edge]
            spans.append(_text.row_sums(begins, block.offs))
            sizes.append(np.diff(block.offs))
            removed.append(lost)
            for i in range(block.n):
                a, b = block.offs[i], block.offs[i + 1]
                kept = (block.data[a:b][~gone[a:b]] if lost[i] else block.data[a:b]).tobytes()
                sums.append(hashlib.sha256(kept).hexdigest())
                if keep_text:
                    texts.append(kept.decode(errors="ignore"))
        number = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
        out = {"doc_id": docs.column("doc_id"), "n_bytes": number(sizes), "n_removed": number(removed), "n_spans": number(spans), "kept_sha256": pa.array(sums, pa.string())}
        return pa.table(out | ({"text": pa.array(texts, pa.string())} if keep_text else {}))

    return run


def remove_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_text: bool = False, bucket_bytes: int = _tables.BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the text that is left.

    In that text the bytes of a character that was cut through are dropped.
    """
    if not 1 <= gram <= length:
        raise ValueError("a gram is no longer than a string")
    spark = docs.sparkSession
    n = _packed.prime(_tables.buckets(docs, bucket_bytes))
    rows = with_bucket(docs, n)
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    by_bucket = lambda df: _tables.dealt(df, n).groupBy("bucket")
    keys = _tables.written(_packed.grouped(texts.mapInArrow(_keys(n, length, gram), _packed.SCHEMA), n, _shared_keys(n, HOT)), "keys")
    _tables.free(spark)
    hot = spark.sparkContext.broadcast(_hot_keys(keys, n))
    answers = _tables.written(_packed.grouped(by_bucket(rows).cogroup(by_bucket(keys.where(f"bucket < {n}"))).applyInArrow(_candidates(n, length, gram, hot), _packed.SCHEMA), n, _answers(length)), "least")
    _tables.dropped(keys)
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * keep_text
    return by_bucket(rows).cogroup(by_bucket(answers)).applyInArrow(_kept(length, gram, keep_text, hot), kind)


def op9_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
