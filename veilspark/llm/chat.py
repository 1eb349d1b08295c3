"""Chat formatting by token-level assembly.

Each text is escaped and encoded by itself, map-side, row by row; only then are the turns of a
conversation brought together and reserved ids spliced between their token lists, so no content
can produce a control token. The loss mask is a running sum of +1 and -1 at segment edges.

Rendered form of a turn:  <s>[ROLE] role [/ROLE] text </s>  (without the blanks shown here).
A control string inside a content is broken by a backslash after its first character, and a
backslash is doubled, so removing the escapes gives back every text exactly.

Defined cases: a null text is empty, a null role is the empty role and bears no loss; each row
without conv_id is a conversation of its own; turns are taken by (turn, role, text), null
turns first; repeated rows are repeated turns; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Control strings, in the order of their reserved ids, which follow those of the vocabulary.
CONTROL = ("<s>", "</s>", "[ROLE]", "[/ROLE]")
#: Further strings of other templates that are escaped as well.
FOREIGN = ("[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<unk>")
LOSS_ROLES = ("assistant",)
_ESCAPE = re.compile("|".join([r"\\", *map(re.escape, (*CONTROL, *FOREIGN))]))
_UNESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


class Vocabulary:
    """Byte-level BPE read from tiktoken ranks; loses no byte."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.first = max(table.values()) + 2  # the id after the ranks is another use's
        self.bpe = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.control = {c: self.first + i for i, c in enumerate(CONTROL)}

    def encode(self, text: str) -> list[int]:
        return self.bpe.encode_ordinary(text)

    def decode(self, ids: list[int]) -> str:
        return self.bpe.decode_bytes(ids).decode()

    def render(self, ids: np.ndarray) -> str:
        """The formatted text: contents as decoded, reserved ids as their control strings."""
        out, at = [], 0
        for k in np.flatnonzero(ids >= self.first):
            out += [self.decode(ids[at:k].tolist()), CONTROL[int(ids[k]) - self.first]]
            at = k + 1
        return "".join([*out, self.decode(ids[at:].tolist())])


_LOADED: dict[tuple, Vocabulary] = {}


def loaded(ranks: bytes, pattern: str) -> Vocabulary:
    key = hashlib.md5(ranks).digest(), pattern
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(ranks, pattern)
    return _LOADED[key]


def _vocabulary(df: DataFrame, path: str | None, pattern: str | None):
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast((f.read(), pattern))


def _packed(values: np.ndarray) -> bytes:
    return np.asarray(values, np.int32).tobytes()


def assemble(turns: list[tuple[str, list[int], list[int]]], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids and loss mask of a conversation from (role, role ids, text ids) of its turns."""
    open_, close, role_open, role_close = (vocabulary.control[c] for c in CONTROL)
    parts, edges, at = [], [], 0
    for role, role_ids, text_ids in turns:
        parts.append(np.array([open_, role_open, *role_ids, role_close, *text_ids, close], np.int32))
        begin = at + 3 + len(role_ids)
        if role in LOSS_ROLES:
            edges.append((begin, begin + len(text_ids)))
        at += len(parts[-1])
    delta = np.zeros(at + 1, np.int32)
    for lo, hi in edges:
        delta[lo] += 1
        delta[hi] -= 1
    return np.concatenate([np.zeros(0, np.int32), *parts]), np.cumsum(delta[:-1]).astype(np.int8)


def read_back(ids: np.ndarray, mask: np.ndarray, vocabulary: Vocabulary) -> tuple[list[tuple[str, str]], list[str]]:
    """The turns (role, text) of a formatted conversation, and the texts under its mask, from its tokens alone."""
    open_, close, role_open, role_close = (vocabulary.control[c] for c in CONTROL)
    turns, marked = [], []
    middles = np.flatnonzero(ids == role_close)
    for lo, mid, hi in zip(np.flatnonzero(ids == role_open), middles, np.flatnonzero(ids == close), strict=True):
        text = unescape(vocabulary.decode(ids[mid + 1 : hi].tolist()))
        turns.append((unescape(vocabulary.decode(ids[lo + 1 : mid].tolist())), text))
    edge = np.diff(np.concatenate([[0], mask, [0]]))
    for lo, hi in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        marked.append(unescape(vocabulary.decode(ids[lo:hi].tolist())))
    return turns, marked


def format_chat(rows: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """conv_id, tokens binary (int32, little-endian), mask binary (int8), n_turns long, text string."""
    vocabulary = _vocabulary(rows, path, pattern)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = loaded(*vocabulary.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                roles, texts = (part.column(i).to_pylist() for i in (2, 3))
                ids = [pa.array([_packed(v.encode(escape(x or ""))) for x in xs], pa.binary()) for xs in (roles, texts)]
                yield pa.RecordBatch.from_arrays([*part.columns, *ids], names=["conv_id", "turn", "role", "text", "role_ids", "text_ids"])

    kinds = "conv_id long, turn long, role string, text string, role_ids binary, text_ids binary"
    coded = rows.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text").mapInArrow(encode, kinds)
    order = F.struct("turn", "role", "text", "role_ids", "text_ids")
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    whole = coded.withColumn("alone", alone).groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list(order)).alias("turns"))
    whole = whole.selectExpr("conv_id", "transform(turns, t -> struct(t.role, t.role_ids, t.text_ids)) turns")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = loaded(*vocabulary.value)
        ints = lambda b: np.frombuffer(b, np.int32).tolist()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                turns = part.column(1).to_pylist()
                done = [assemble([(t["role"], ints(t["role_ids"]), ints(t["text_ids"])) for t in ts], v) for ts in turns]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_packed(i) for i, _ in done], pa.binary()), pa.array([m.tobytes() for _, m in done], pa.binary()), pa.array([len(t) for t in turns], pa.int64()), pa.array([v.render(i) for i, _ in done], pa.string())], names=["conv_id", "tokens", "mask", "n_turns", "text"])

    return whole.mapInArrow(join, "conv_id long, tokens binary, mask binary, n_turns long, text string")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text")
    formatted = format_chat(rows.unionByName(extra))
    vocabulary = _vocabulary(formatted, None, None)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = loaded(*vocabulary.value)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [read_back(np.frombuffer(t, np.int32), np.frombuffer(m, np.int8), v) for t, m in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                loss = ["".join(m) for _, m in rows]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t, _ in rows], pa.int64()), pa.array([sha("".join(f"{r}\n{x}\n" for r, x in t)) for t, _ in rows]), pa.array([len(x) for x in loss], pa.int64()), pa.array([sha(x) for x in loss]), pa.array([len(x) for x in part.column(3).to_pylist()], pa.int64())], names=names)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [x.split()[0] for x in schema.split(", ")]
    return formatted.selectExpr("conv_id", "tokens", "mask", "text").mapInArrow(digest, schema)
