"""Language of words and documents by a linear-chain conditional random field.

Each word has affix, byte n-gram and lexicon features, hashed into BUCKETS weights a label; the
weights of label changes are learned with them. Training maximises the likelihood of labelled
words in sequences that splice pieces of documents of different languages, so changes within a
text are learned too; forward-backward then gives every word its label probabilities, and a
document the mean of its words'.

Words are runs of letters (ASCII, and all characters beyond). The recursion is cut into
pieces of PIECE words whose transfer products are chained exactly, so long texts need no long
loops and nothing is truncated.

The model is fitted on the driver on at most TRAIN_ROWS labelled documents (the least hashed id
of each of so many slots) of at most TRAIN_TEXT bytes each and TRAIN_BYTES in all. Defined cases: a null text, or one without a letter,
is `und` with score 0; a row without doc_id is judged, never learned from, and not held out;
without any labelled row every text is `und`; repeated rows each get their result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import _tables, _text

TRAIN_ROWS, TRAIN_BYTES, TRAIN_TEXT, BUCKETS, PIECE, EPOCHS, SEED = 1200, 16 << 20, 100_000, 1 << 17, 64, 5, 11
_SPLIT = np.ones(256, bool)
_SPLIT[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_ASCII = ~_SPLIT
_ASCII[0x80:] = False


class _Words:
    """Words of a lower-cased block: the distinct ones, which each word is, and where rows begin."""

    def __init__(self, block: _text.Block):
        self.block = block
        starts, ends, at = block.words(_SPLIT)
        hashes = _text.over_bytes(block.data).of(starts, ends)
        self.hash, first, self.which = np.unique(hashes, return_index=True, return_inverse=True)
        self.start, self.end = starts[first], ends[first]
        letters = np.concatenate([[0], np.cumsum(_ASCII[block.data])])
        has = letters[self.end] > letters[self.start]
        for k in np.flatnonzero(~has):  # words wholly beyond ASCII: letters or signs
            has[k] = any(c.isalpha() for c in block.data[self.start[k] : self.end[k]].tobytes().decode(errors="ignore"))
        keep = has[self.which]
        self.which = self.which[keep]
        total = np.concatenate([[0], np.cumsum(keep)])
        self.at = total[at]

    def features(self, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight numbers of all distinct words, one after the other, and where each word's begin."""
        running, start, end, n = _text.over_bytes(self.block.data), self.start, self.end, len(self.start)
        size = end - start
        owner, value = [], []

        def add(words: np.ndarray, hashes: np.ndarray, salt: int) -> None:
            owner.append(words)
            value.append(_text.mix(hashes + np.uint64(salt * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)))

        each = np.arange(n)
        for k in (1, 2, 3, 4):
            use = each[size >= k]
            add(use, running.quick(start[use], start[use] + k), k)
            add(use, running.quick(end[use] - k, end[use]), 8 + k)
        for k in (2, 3):
            many = np.maximum(size - k + 1, 0)
            ends = np.cumsum(many)
            spot = np.repeat(start - (ends - many), many) + np.arange(ends[-1] if n else 0)
            add(np.repeat(each, many), running.quick(spot, spot + k), 16 + k)
        found = np.zeros(n, bool)
        if len(lexicon):
            found = lexicon[np.minimum(np.searchsorted(lexicon, self.hash), len(lexicon) - 1)] == self.hash
        add(each, np.where(found, self.hash, np.uint64(1)), 32)
        owner, value = np.concatenate(owner), np.concatenate(value)
        order = np.argsort(owner, kind="stable")
        return (value[order] >> np.uint64(64 - 17)).astype(np.int64), np.searchsorted(owner[order], np.arange(n + 1))


def _norm(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(-1, keepdims=True), 1e-30)


def forward_backward(emission: np.ndarray, change: np.ndarray, begin: np.ndarray, at: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label probabilities of each word, and the forward and backward messages they are made of.

    emission: (words, labels) positive factors; change: (labels, labels) factors of label pairs;
    begin: factors of first labels; at: where each sequence begins.
    """
    n, labels = emission.shape
    sizes = np.diff(at)
    first = at[:-1][sizes > 0]
    emission = emission.copy()
    emission[first] *= begin / change.sum(0)
    pieces = -(-sizes // piece)
    owner = np.repeat(np.arange(len(sizes)), pieces)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    word = at[owner] + number * piece
    spot = word[:, None] + np.arange(piece)
    real = spot < at[owner + 1][:, None]
    e = np.where(real[:, :, None], emission[np.where(real, spot, 0)], 1.0)
    transfer = np.broadcast_to(np.eye(labels), (len(owner), labels, labels)).copy()
    for t in range(piece):
        step = (transfer @ change) * e[:, t, None, :]
        step /= np.maximum(step.max((1, 2), keepdims=True), 1e-30)
        transfer = np.where(real[:, t, None, None], step, transfer)
    into, out = np.ones((len(owner), labels)) / labels, np.ones((len(owner), labels)) / labels
    head = np.cumsum(pieces) - pieces
    for k in range(1, int(pieces.max(initial=0))):
        own = head[pieces > k] + k
        into[own] = _norm(np.einsum("ni,nij->nj", into[own - 1], transfer[own - 1]))
    for k in range(int(pieces.max(initial=0)) - 2, -1, -1):
        own = head[pieces > k + 1] + k
        out[own] = _norm(np.einsum("nij,nj->ni", transfer[own + 1], out[own + 1]))
    ahead, behind = np.empty((len(owner), piece, labels)), np.empty((len(owner), piece, labels))
    a = into
    for t in range(piece):
        a = np.where(real[:, t, None], _norm((a @ change) * e[:, t]), a)
        ahead[:, t] = a
    b = out
    for t in range(piece - 1, -1, -1):
        behind[:, t] = b
        b = np.where(real[:, t, None], _norm((e[:, t] * b) @ change.T), b)
    ahead, behind = ahead[real], behind[real]
    return _norm(ahead * behind), ahead, behind


class Tagger:
    """Weights of a fitted field."""

    def __init__(self, labels: list[str], lexicon: np.ndarray):
        self.labels, self.lexicon = labels, lexicon
        k = len(labels)
        self.weights, self.change, self.begin = np.zeros((BUCKETS, k)), np.zeros((k, k)), np.zeros(k)

    def emissions(self, words: _Words) -> np.ndarray:
        """Factors of each distinct word."""
        number, at = words.features(self.lexicon)
        if not len(at[1:]):
            return np.zeros((0, len(self.labels)))
        score = np.add.reduceat(self.weights[number], at[:-1])
        return np.exp(score - score.max(1, keepdims=True))

    def probabilities(self, words: _Words) -> np.ndarray:
        return forward_backward(self.emissions(words)[words.which], np.exp(self.change), np.exp(self.begin), words.at)[0]

    def tag(self, text: str) -> list[tuple[str, str, float]]:
        """Word, label and probability of each word of a text."""
        data = text.lower().encode()
        words = _Words(_text.Block(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 0))
        p = self.probabilities(words)
        return [(data[words.start[w] : words.end[w]].decode(), self.labels[int(x.argmax())], float(x.max())) for w, x in zip(words.which, p, strict=True)]


def train(texts: list[str], langs: list[str], epochs: int = EPOCHS, seed: int = SEED) -> Tagger | None:
    """Fit by Adagrad on sequences of 2 * PIECE words, in which languages take turns by pieces of 8 to 40 words."""
    if not texts:
        return None
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)
    column = pa.array([t.lower() for t in texts], pa.large_string())
    offs, data = _text.strings(column)
    words = _Words(_text.Block(data, offs, 0))
    counts = np.bincount(words.which, minlength=len(words.hash))
    model = Tagger(labels, np.sort(words.hash[counts >= 3]))
    if not len(words.which):
        return model
    label_of = np.array([labels.index(x) for x in langs])
    # Pieces of documents by language, then a random walk over languages.
    parts: dict[int, list[np.ndarray]] = {k: [] for k in range(len(labels))}
    for d, (lo, hi) in enumerate(zip(words.at[:-1], words.at[1:], strict=True)):
        while lo < hi:
            step = int(rng.integers(8, 41))
            parts[int(label_of[d])].append(words.which[lo : min(lo + step, hi)])
            lo += step
    for p in parts.values():
        rng.shuffle(p)
    line, gold, now = [], [], int(rng.integers(len(labels)))
    while any(parts.values()):
        if not parts[now] or rng.random() < 0.3:
            left = [k for k in parts if parts[k]]
            now = int(rng.choice(left))
        line.append(parts[now].pop())
        gold.append(np.full(len(line[-1]), now))
    line, gold = np.concatenate(line), np.concatenate(gold)
    length = 2 * PIECE
    edges = np.append(np.arange(0, len(line), length), len(line))
    number, at = words.features(model.lexicon)
    spread = np.repeat(np.arange(len(at) - 1), np.diff(at))
    square_w, square_c, square_b = np.full_like(model.weights, 1e-6), np.full_like(model.change, 1e-6), np.full_like(model.begin, 1e-6)
    k, rate = len(labels), 0.25
    batches = np.array_split(np.arange(len(edges) - 1), max(1, len(edges) // 400))
    for _ in range(epochs):
        for b in (batches[i] for i in rng.permutation(len(batches))):
            lo, hi = edges[b[0]], edges[b[-1] + 1]
            which, want, seq = line[lo:hi], gold[lo:hi], edges[b[0] : b[-1] + 2] - lo
            score = np.add.reduceat(model.weights[number], at[:-1])
            e = np.exp(score - score.max(1, keepdims=True))[which]
            change, begin = np.exp(model.change), np.exp(model.begin)
            p, ahead, behind = forward_backward(e, change, begin, seq)
            slope = p
            slope[np.arange(len(want)), want] -= 1
            inner = np.setdiff1d(np.arange(1, len(want)), seq[1:-1])
            both = ahead[inner - 1][:, :, None] * change * (e[inner] * behind[inner])[:, None, :]
            both /= np.maximum(both.sum((1, 2), keepdims=True), 1e-30)
            pairs = np.bincount(want[inner - 1] * k + want[inner], minlength=k * k).reshape(k, k)
            size = len(seq) - 1
            of_change = (both.sum(0) - pairs) / size + 1e-3 * model.change
            of_begin = slope[seq[:-1]].sum(0) / size + 1e-3 * model.begin
            by_word = np.stack([np.bincount(which, slope[:, j], minlength=len(at) - 1) for j in range(k)], 1) / size
            of_weight = np.stack([np.bincount(number, by_word[spread, j], minlength=BUCKETS) for j in range(k)], 1) + 1e-6 * model.weights
            for value, of, square in ((model.weights, of_weight, square_w), (model.change, of_change, square_c), (model.begin, of_begin, square_b)):
                square += of * of
                value -= rate * of / np.sqrt(square)
    return model


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> Tagger | None:
    """Learn from text and lang of labelled rows whose crc32(doc_id) mod 4 is not 2.

    Ids and sizes are picked first; only the texts of those that fit in TRAIN_BYTES come to the driver.
    """
    use = docs.selectExpr("cast(doc_id as long) doc_id", "text", "lang").where("text is not null and lang is not null and crc32(cast(cast(doc_id as string) as binary)) % 4 != 2").where(F.octet_length("text") <= TRAIN_TEXT)
    picked, size = [], 0
    for r in sorted(_tables.sampled(use.select("doc_id", F.octet_length("text").alias("size")), rows, 0, "size").collect()):
        size += r["size"]
        if size > TRAIN_BYTES:
            break
        picked.append(r["doc_id"])
    if not picked:
        return None
    # A picked id's least text, should it have several.
    wanted = docs.sparkSession.createDataFrame([(i,) for i in picked], "doc_id long")
    found = use.join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("r")).select("doc_id", "r.*").collect()
    texts = {r["doc_id"]: r for r in found}
    return train([texts[i]["text"] for i in picked], [texts[i]["lang"] for i in picked])


def identify(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """doc_id, lang_pred, score, shares array<double> (mean probability of each label), n_changes long."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for block in _text.blocks(pc.utf8_lower(batch.column(1))):
                pred, score, shares, changes = ["und"] * block.n, np.zeros(block.n), np.zeros((block.n, len(m.labels) if m else 0)), np.zeros(block.n, np.int64)
                words = _Words(block)
                if m and len(words.which):
                    p = m.probabilities(words)
                    some = np.flatnonzero(np.diff(words.at) > 0)
                    shares[some] = np.add.reduceat(p, words.at[some]) / np.diff(words.at)[some, None]
                    best = p.argmax(1)
                    moved = np.concatenate([[False], best[1:] != best[:-1]])
                    moved[words.at[some]] = False
                    changes = _text.row_sums(moved, words.at)
                    for i in some.tolist():
                        pred[i] = m.labels[int(shares[i].argmax())]
                    score[some] = np.minimum(shares[some].max(1), 1.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, block.n), pa.array(pred, pa.string()), pa.array(score), pa.array(list(shares), pa.list_(pa.float64())), pa.array(changes, pa.int64())], names=["doc_id", "lang_pred", "score", "shares", "n_changes"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, shares array<double>, n_changes long")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"), F.lit(False))
    return identify(docs, fit(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score", "n_changes")
