"""SentencePiece encoding with original offsets, and decoding.

Normalisation takes, at each place, the longest rule of the model's compiled character map (a
double-array trie) and records where in the original bytes every normalised byte comes from.
Pieces of the normalised text are then projected through that record to byte spans.

Merges never cross a place where no piece has those two characters side by side (before a run of
blanks; between letters and other signs, if no piece has both; beside characters that only stand
alone), so a text is cut there. Merged segments are remembered in two generations of about
MEMO_ROWS, some 70 MB a worker; that changes speed and not results.

Defined cases: null or empty text has no pieces and decodes to the empty text; a null doc_id is
carried along; repeated rows each get their result; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MEMO_ROWS, SHORT = 160_000, 32
SPACE = "▁"
NOTHING = np.zeros(0, np.int32)


def _fields(buf: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """Field number, wire type and value of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = buf[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(buf):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: int | bytes = varint()
        elif kind == 2:
            n = varint()
            value, at = buf[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = buf[at : at + n], at + n
        yield tag >> 3, kind, value


class CharMap:
    """Longest-prefix rules of a compiled character map: byte length of the trie, trie units, replacements."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        #: Bytes that begin a rule; no rule applies where another stands.
        self.leads = np.zeros(256, bool)
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.replacements = blob[4 + size :]
            root = self._child(0)
            for x in range(256):
                self.leads[x] = (root ^ x) < len(self.units) and (self.units[root ^ x] & 0x800000FF) == x
        self._known: dict[bytes, tuple[int, bytes] | None] = {}

    def _child(self, node: int) -> int:
        """Where the children of a node are."""
        unit = self.units[node]
        return node ^ (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest rule that data has at this place, and its replacement."""
        if not self.units or not self.leads[data[at]]:
            return None
        units, best = self.units, None
        base = self._child(0)
        for i in range(at, len(data)):
            node = base ^ data[i]
            if node >= len(units) or (units[node] & 0x800000FF) != data[i]:
                break
            base = self._child(node)
            if units[node] & 256:
                best = i + 1 - at, units[base] & 0x7FFFFFFF
        if best is None:
            return None
        end = self.replacements.index(b"\0", best[1])
        return best[0], self.replacements[best[1] : end]

    def parts(self, data: bytes, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Where rules apply, from the left, the longest at each place: first byte, bytes replaced, replacement.

        Only places with a leading byte of a rule at a character's begin are looked at.
        """
        where, sizes, out, done = [], [], [], 0
        for at in (self.leads[codes] & ((codes & 0xC0) != 0x80)).nonzero()[0].tolist() if self.units else ():
            if at >= done and (rule := self.longest(data, at)):
                where.append(at)
                sizes.append(rule[0])
                out.append(rule[1])
                done = at + rule[0]
        return np.array(where, np.int64), np.array(sizes, np.int64), out


class Memo(dict):
    """Segment -> its ids, decimal and comma-joined; looks in the generation before as well."""

    def __init__(self, model: PieceModel, before: dict | None = None):
        self.model, self.before = model, before or {}

    def __missing__(self, segment: str) -> str:
        out = self.before.get(segment)
        if out is None:
            out = ",".join(map(str, self.model.merge(segment)))
        if len(segment) <= SHORT:
            self[segment] = out
        return out


class PieceModel:
    """A BPE SentencePiece model, read from the bytes of its .model file."""

    def __init__(self, blob: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        charmap, self.prefix, self.squeeze, self.escape = b"", True, True, True
        for number, _, value in _fields(blob):
            if number == 1:
                piece = {"piece": "", "score": 0.0, "type": 1}
                for n, _, v in _fields(value):
                    if n == 1:
                        piece["piece"] = v.decode()
                    elif n == 2:
                        (piece["score"],) = struct.unpack("<f", v)
                    elif n == 3:
                        piece["type"] = v
                self.pieces.append((piece["piece"], piece["score"], piece["type"]))
            elif number == 3:
                for n, _, v in _fields(value):
                    if n == 2:
                        charmap = v
                    elif n == 3:
                        self.prefix = bool(v)
                    elif n == 4:
                        self.squeeze = bool(v)
                    elif n == 5:
                        self.escape = bool(v)
        self.charmap = CharMap(charmap)
        self.rank = {p: (-s, i) for i, (p, s, t) in enumerate(self.pieces) if t == 1}
        self.score = {p: r[0] for p, r in self.rank.items()}.get
        self.unknown = next((i for i, x in enumerate(self.pieces) if x[2] == 2), 0)
        self.byte = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == 6}
        joined = {c for p in self.rank if len(p) > 1 for c in p} - {SPACE}
        inner = any(SPACE in p.lstrip(SPACE) for p in self.rank)
        mixed = any(len({c.isalpha() for c in p.lstrip(SPACE)}) > 1 for p in self.rank)
        kinds = [joined] if mixed else [{c for c in joined if c.isalpha()}, {c for c in joined if not c.isalpha()}]
        runs = [f"{SPACE}*[{''.join(map(re.escape, sorted(k)))}]+" for k in kinds if k]
        inside = "".join(map(re.escape, sorted(joined | {SPACE})))
        self.segment = re.compile("|".join([*runs, f"{SPACE}+", f"[^{inside}]"]) if not inner else ".+", re.S).findall
        self.memo = Memo(self)
        # Characters of a piece (a byte piece: that it ends one), and the pieces of bytes inside a character.
        self.chars = np.array([len(p) if t == 1 else 1 for p, _, t in self.pieces], np.int32)
        self.inner = np.zeros(len(self.pieces), bool)
        self.inner[[i for b, i in self.byte.items() if b & 0xC0 == 0x80]] = True
        self.shown: dict[str, bytes] = {}
        for i, (p, _, t) in enumerate(self.pieces):
            self.shown[str(i)] = bytes([int(p[3:5], 16)]) if t == 6 else b"" if t == 3 else " ⁇ ".encode() if t == 2 else p.replace(SPACE, " ").encode()

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes (and its end) the original byte it comes from.

        Stretches without a rule are taken over whole, with a running count as their source; a
        replacement comes from the first byte of what it replaces.
        """
        data = text.encode()
        codes = np.frombuffer(data, np.uint8)
        where, sizes, replaced = self.charmap.parts(data, codes)
        if len(where):
            plain, sources, done = [], [], 0
            for at, size, piece in zip(where.tolist(), sizes.tolist(), replaced, strict=True):
                plain += [data[done:at], piece]
                sources += [np.arange(done, at), np.full(len(piece), at)]
                done = at + size
            out = np.frombuffer(b"".join([*plain, data[done:]]), np.uint8)
            source = np.concatenate([*sources, np.arange(done, len(data))])
        else:
            out, source = codes, np.arange(len(data))
        end = len(data)
        if self.squeeze:
            # Blanks before the text and after another blank go.
            blank = out == 32
            keep = ~(blank & np.append(True, blank[:-1])[: len(blank)])
            out, source = out[keep], source[keep]
        if self.prefix and len(out):
            out, source = np.append(np.uint8(32), out), np.append(source[0], source)
        if self.escape and (out == 32).any():
            blank = out == 32
            times = np.where(blank, len(SPACE.encode()), 1)
            normal, source = out.tobytes().replace(b" ", SPACE.encode()).decode(), np.repeat(source, times)
        else:
            normal = out.tobytes().decode()
        if self.squeeze:  # blanks after the text go, and the text ends where they begin
            space = SPACE if self.escape else " "
            left = normal.rstrip(space)
            if len(left) < len(normal):
                size = len(source) - (len(normal) - len(left)) * len(space.encode())
                end, normal, source = int(source[size]), left, source[:size]
        return normal, np.append(source, end).astype(np.int32)

    def merge(self, segment: str) -> list[int]:
        """Ids of a segment: the best-scored pair is merged first, the leftmost of equals."""
        parts = self._merge_short(segment) if len(segment) <= SHORT else self._merge_long(segment)
        rank = self.rank
        out: list[int] = []
        for p in parts:
            if p in rank:
                out.append(rank[p][1])
            elif self.byte:
                out.extend(self.byte[b] for b in p.encode())
            else:
                out.append(self.unknown)
        return out

    def _merge_short(self, segment: str) -> list[str]:
        """Pieces by looking through all pairs for the best; quicker than a queue for a word."""
        score, none = self.score, math.inf
        parts = list(segment)
        pairs = [score(a + b, none) for a, b in itertools.pairwise(parts)]
        while pairs and (best := min(pairs)) < none:
            i = pairs.index(best)
            parts[i] = now = parts[i] + parts.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = score(parts[i - 1] + now, none)
            if i < len(pairs):
                pairs[i] = score(now + parts[i + 1], none)
        return parts

    def _merge_long(self, segment: str) -> list[str]:
        """Pieces by a queue of pairs, for any length."""
        rank = self.rank
        parts: list[str | None] = list(segment)
        before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        queue = [(rank[p][0], i, i + 1, p) for i in range(len(parts) - 1) if (p := segment[i : i + 2]) in rank]
        heapq.heapify(queue)
        while queue:
            _, i, j, p = heapq.heappop(queue)
            if parts[i] is None or j >= len(parts) or after[i] != j or parts[j] is None or parts[i] + parts[j] != p:
                continue
            parts[i], parts[j] = p, None
            after[i] = k = after[j]
            if k < len(parts):
                before[k] = i
                if (q := p + parts[k]) in rank:
                    heapq.heappush(queue, (rank[q][0], i, k, q))
            if (h := before[i]) >= 0 and (q := parts[h] + p) in rank:
                heapq.heappush(queue, (rank[q][0], h, i, q))
        return [p for p in parts if p is not None]

    def _joined(self, normal: str) -> str:
        if len(self.memo) > MEMO_ROWS:
            self.memo.before = {}
            self.memo = Memo(self, self.memo)
        return ",".join(map(self.memo.__getitem__, self.segment(normal)))

    def joined_spans(self, text: str | None) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a whole text, decimal and comma-joined, then ids, first and end bytes in the original text.

        Of one character's byte pieces only the last spans it.
        """
        normal, source = self.normalise(text) if text else ("", NOTHING)
        if not normal:
            return "", NOTHING, NOTHING, NOTHING
        source = source[np.append(_heads(normal.encode()), -1)]  # of characters
        joined = self._joined(normal)
        ids = np.fromstring(joined, np.int32, sep=",")
        chars = self.chars[ids]
        chars[:-1][self.inner[ids[1:]]] = 0
        ends = np.cumsum(chars)
        starts = source[ends - chars]
        return joined, ids, starts, np.maximum(starts, source[ends])

    def joined_ids(self, text: str | None) -> str:
        """Ids of a whole text, decimal and comma-joined."""
        return self.joined_spans(text)[0]

    def encode(self, text: str | None) -> list[int]:
        return [int(x) for x in self.joined_ids(text).split(",") if x]

    def encode_spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(id, first byte, end byte) in the original text; of one character's byte pieces only the last spans it."""
        return list(zip(*(x.tolist() for x in self.joined_spans(text)[1:]), strict=True))

    def decode_joined(self, joined: str) -> str:
        if not joined:
            return ""
        ids = joined.split(",")
        text = _replaced(b"".join(map(self.shown.__getitem__, ids)))
        return text[self._led(ids) :] if self.prefix or self.squeeze else text

    def _led(self, ids: list[str]) -> int:
        """Blanks that decoding leaves out: the first of the text; with squeezing, that of each piece until one shows something."""
        out = 0
        for i in ids:
            piece, _, kind = self.pieces[int(i)]
            if kind == 3:
                continue
            led = kind not in (2, 6) and piece.startswith(SPACE)
            out += led
            if kind in (2, 6) or len(piece) > led or not self.squeeze:
                break
        return out

    def decode(self, ids: list[int]) -> str:
        return self.decode_joined(",".join(map(str, ids)))


def _heads(data: bytes) -> np.ndarray:
    """Where the characters of UTF-8 begin."""
    return np.flatnonzero(np.frombuffer(data, np.int8) >= -64)


def _replaced(data: bytes) -> str:
    """UTF-8, with each byte that is part of no character as U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


_LOADED: dict[bytes, PieceModel] = {}


def loaded(blob: bytes) -> PieceModel:
    """The model, parsed once a worker."""
    if (key := hashlib.md5(blob).digest()) not in _LOADED:
        _LOADED[key] = PieceModel(blob)
    return _LOADED[key]


def _sha(joined: str) -> str:
    return hashlib.sha256(joined.encode()).hexdigest()


def tokenise(docs: DataFrame, path: str | None = None, spans: bool = False, decoded: bool = False) -> DataFrame:
    """The rows of docs as doc_id, ids array<int>, with spans: starts, ends (byte offsets) array<int>, and with decoded: decoded_sha256 of what the ids decode to.

    path is read on the driver; executors get the model's bytes.
    """
    with open(path or model_path(), "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    names = ["doc_id", "ids", *["starts", "ends"] * spans, *["decoded_sha256"] * decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = loaded(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [m.joined_spans(t) for t in part.column(1).to_pylist()]
                columns = [pa.array([f[k] for f in found], pa.list_(pa.int32())) for k in range(1, 4 if spans else 2)]
                if decoded:
                    columns.append(pa.array([_sha(m.decode_joined(f[0])) for f in found], pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>" + ", starts array<int>, ends array<int>" * spans + ", decoded_sha256 string" * decoded)


def digests(docs: DataFrame, path: str | None = None, spans: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encode, then decode what was encoded; with spans: spans_sha256.

    spans_sha256 is over the pieces' first bytes, then their end bytes, each as 4 bytes, low byte first.
    """
    with open(path or model_path(), "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["spans_sha256"] * spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = loaded(model.value)
        for batch in batches:
            n, ids, back, where = [], [], [], []
            for text in batch.column(1):
                joined, found, starts, ends = m.joined_spans(text.as_py())
                n.append(len(found))
                ids.append(_sha(joined))
                back.append(_sha(m.decode_joined(joined)))
                where.append(hashlib.sha256(np.concatenate([starts, ends]).astype("<i4").tobytes()).hexdigest())
            columns = [pa.array(n, pa.int64()), *(pa.array(x, pa.string()) for x in (ids, back, where)[: 2 + spans])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", spans_sha256 string" * spans)


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), spans=True)
