"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

A word's vector has two parts, both random indexing: the sum of the sparse random index vectors of its
character trigrams and of its character-class trigrams (so that no word is without one), and its context,
the sum of the index vectors of the words next to it over the training sample, for the CONTEXT_WORDS most
frequent words. A document is the mean and the standard deviation of its words' vectors, and, for order,
the mean of each word's trigram vector bound (multiplied entry by entry) with that of the word one to LAGS
places before; a word bound with itself has no negative entry, so the network sees repetition there. The
network is numpy: one hidden layer, then a logistic unit whose temperature is fitted on rows kept back from
training.

The network and contexts learn from at most TRAIN_ROWS labelled rows of the training fold, a bounded
sample by a hash of doc_id. Scoring reads whole texts.

Defined results: null and empty texts pool to the zero vector and get the network's score of it;
repeated rows give a row each; a null doc_id is in no held-out fold; without any labelled row of the
training fold every score is 0.5; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_model, id_remainder, labelled_sample, ragged_take, read_table, slices, words_of

FOLDS, HELD = 3, 1
TRAIN_ROWS = 4000
DIMENSIONS = 24
NONZERO = 6
BUCKETS = 4096
CONTEXT_WORDS = 20_000
LAGS = 3
HIDDEN = 32
EPOCHS = 150
BLOCK = 1 << 16
#: Text bytes that are scored at once: the vectors of their distinct words are the most that a task holds.
SLICE = 3 << 20


def index_vectors(n: int, seed: int) -> np.ndarray:
    """n sparse random vectors with NONZERO entries of +1 or -1 (the last row is the zero vector)."""
    rng = np.random.default_rng(seed)
    out = np.zeros((n + 1, DIMENSIONS), np.float32)
    rows = np.arange(n)[:, None]
    out[rows, rng.random((n, DIMENSIONS)).argsort(axis=1)[:, :NONZERO]] = rng.choice([-1.0, 1.0], (n, NONZERO))
    return out


def _classes() -> np.ndarray:
    """Character classes of bytes: upper case, lower case, digit, other letters, each punctuation mark."""
    out = np.arange(256, dtype=np.int64)
    out[65:91], out[97:123], out[48:58], out[128:] = 1, 2, 3, 4
    return out


def _trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each word's trigrams by byte and by class, and their offsets; words stand in <>."""
    raw = pc.binary_join_element_wise("<", column, ">", "").cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.int64)
    offsets = offsets - offsets[0]
    lengths = np.maximum(np.diff(offsets) - 2, 0)
    at = ragged_take(offsets[:-1], lengths)
    if not len(at):
        return at, at, np.zeros(len(column) + 1, np.int64)
    kinds = _classes()[data]
    mixed = [(x[at] * 961 + x[at + 1] * 31 + x[at + 2]) * 0x9E3779B1 >> 7 & (BUCKETS - 1) for x in (data, kinds)]
    return mixed[0], mixed[1], np.concatenate([[0], np.cumsum(lengths)])


def _sums(table: np.ndarray, rows: np.ndarray, offsets: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """Per segment the sum of table[rows], each multiplied by table[times] if given, a block at a time."""

    def taken(i: int, j: int) -> np.ndarray:
        found = table[rows[i:j]]
        return found if times is None else found * (found if times is rows else table[times[i:j]])

    n = len(offsets) - 1
    out = np.zeros((n, table.shape[1]), np.float64)
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + BLOCK, side="right")) - 1)
        if stop == start + 1 and offsets[stop] - offsets[start] > BLOCK:  # one long segment
            for i in range(int(offsets[start]), int(offsets[stop]), BLOCK):
                out[start] += taken(i, min(i + BLOCK, int(offsets[stop]))).sum(axis=0)
        else:
            lo, hi = int(offsets[start]), int(offsets[stop])
            full = np.flatnonzero(np.diff(offsets[start : stop + 1]) > 0)
            if len(full):
                out[start + full] = np.add.reduceat(taken(lo, hi), offsets[start + full] - lo, axis=0)
        start = stop
    return out


@dataclass
class Model:
    context: pa.Array | None  # frequent words, whose vectors are the rows of `vectors`
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float


BYTES, KINDS, NEXT = index_vectors(BUCKETS, 1), index_vectors(BUCKETS, 2), index_vectors(BUCKETS, 3)


def word_vectors(words: pa.Array, context: pa.Array | None, vectors: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """The vectors of distinct words, a block of words at a time."""
    return np.concatenate([_word_vectors(words.slice(i, block), context, vectors) for i in range(0, len(words), block)])


def _word_vectors(words: pa.Array, context: pa.Array | None, vectors: np.ndarray) -> np.ndarray:
    """Character part, class part, context part (zero if unknown)."""
    by_byte, by_kind, offsets = _trigrams(words)
    root = np.sqrt(np.maximum(np.diff(offsets), 1))[:, None]
    parts = [_sums(BYTES, by_byte, offsets) / root, _sums(KINDS, by_kind, offsets) / root]
    if context is not None:
        at = pc.fill_null(pc.index_in(words, context), len(context)).to_numpy().astype(np.int64)
        parts.append(vectors[at])
    return np.concatenate(parts, axis=1).astype(np.float32)


def pooled(texts: pa.Array, context: pa.Array | None, vectors: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of the word vectors of each text and its bound vectors; zeros for a text without words."""
    codes, offsets, words = words_of(texts)
    if not len(codes):
        return np.zeros((len(texts), 2 * DIMENSIONS * (3 if context is not None else 2) + DIMENSIONS * LAGS))
    table = word_vectors(words, context, vectors)
    n = np.maximum(np.diff(offsets), 1)[:, None]
    mean = _sums(table, codes, offsets) / n
    square = _sums(table, codes, offsets, times=codes) / n
    parts = [mean, np.sqrt(np.maximum(square - mean * mean, 0.0))]
    # The word `lag` before is bound if it is in the same text; the last row stands for none.
    own = np.concatenate([table[:, :DIMENSIONS], np.zeros((1, DIMENSIONS), np.float32)])
    place = np.arange(len(codes)) - np.repeat(offsets[:-1], np.diff(offsets))
    for lag in range(1, LAGS + 1):
        before = np.full(len(codes), len(table))
        before[lag:] = np.where(place[lag:] >= lag, codes[:-lag], len(table))
        parts.append(_sums(own, codes, offsets, times=before) / n)
    return np.concatenate(parts, axis=1)


def contexts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Frequent words and, for each, the normalised sum of the index vectors of the words beside it."""
    codes, offsets, words = words_of(texts)
    counts = np.bincount(codes, minlength=len(words))
    top = np.sort(np.argsort(-counts, kind="stable")[:CONTEXT_WORDS])
    top = top[counts[top] > 1]
    place = np.full(len(words), -1)
    place[top] = np.arange(len(top))
    by_byte, _, at = _trigrams(words)
    bucket = np.zeros(len(words), np.int64)
    full = np.diff(at) > 0
    bucket[full] = np.add.reduceat(by_byte, at[:-1][full]) % BUCKETS if full.any() else 0
    sums = np.zeros((len(top) + 1, DIMENSIONS), np.float64)
    same = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for shift in (1, 2):
        left, right = codes[:-shift], codes[shift:]
        inside = same[:-shift] == same[shift:]
        for a, b in ((left, right), (right, left)):
            use = inside & (place[a] >= 0)
            np.add.at(sums, place[a[use]], NEXT[bucket[b[use]]])
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    return words.take(pa.array(top)), (sums / np.maximum(norm, 1e-9)).astype(np.float32)


def _forward(x: np.ndarray, layers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum(x @ layers[0] + layers[1], 0.0)
    return hidden, hidden @ layers[2] + layers[3]


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit(texts: pa.Array, labels: np.ndarray) -> Model:
    context, vectors = contexts(texts)
    if not len(context):
        context = None
    # A few texts at a time, so that training holds no more than scoring does.
    x = np.concatenate([pooled(texts.slice(i, 256), context, vectors) for i in range(0, len(texts), 256)])
    rng = np.random.default_rng(7)
    order = rng.permutation(len(x))
    kept = order[: max(1, len(x) // 5)]
    learn = order[len(kept) :] if len(x) > 5 else order
    mean, scale = x[learn].mean(axis=0), x[learn].std(axis=0) + 1e-3
    z = (x - mean) / scale
    layers = [rng.normal(0, np.sqrt(2 / z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(2 / HIDDEN), HIDDEN), np.zeros(1)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in layers]
    step = 0
    for _ in range(EPOCHS):
        for block in np.array_split(rng.permutation(learn), max(1, len(learn) // 256)):
            hidden, out = _forward(z[block], layers)
            slope = (_logistic(out) - labels[block]) / len(block)
            back = np.outer(slope, layers[2]) * (hidden > 0)
            slopes = [z[block].T @ back + 1e-4 * layers[0], back.sum(axis=0), hidden.T @ slope + 1e-4 * layers[2], slope.sum(keepdims=True)]
            step += 1
            for p, g, m in zip(layers, slopes, moments, strict=True):
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.999 * m[1] + 0.001 * g * g
                p -= 2e-3 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    out = _forward(z[kept], layers)[1]
    y = labels[kept]

    def loss(t: float) -> float:
        p = np.clip(_logistic(out / t), 1e-6, 1 - 1e-6)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    return Model(context, vectors, mean, scale, layers, min((0.5 * 1.25**k for k in range(20)), key=loss))


def train(spark: SparkSession, sf_dir: str) -> Model | None:
    texts, labels = labelled_sample(spark, sf_dir, "quality", FOLDS, HELD, TRAIN_ROWS)
    return fit(texts, labels) if len(labels) else None


def _probabilities(texts: pa.Array, own: Model | None) -> np.ndarray:
    if own is None:
        return np.full(len(texts), 0.5)
    x = (pooled(texts, own.context, own.vectors) - own.mean) / own.scale
    return _logistic(_forward(x, own.layers)[1] / own.temperature)


def accepted(documents: DataFrame, model: Model | None) -> DataFrame:
    """The rows of documents, all columns, whose score is 0.5 or more."""
    shared = broadcast_model(documents.sparkSession, model)
    place = documents.columns.index("text")

    def run(batches):
        own = shared()
        for batch in slices(batches, most=SLICE):
            yield batch.filter(pa.array(_probabilities(batch.column(place), own) >= 0.5))

    return documents.mapInArrow(run, documents.schema)


def score(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = broadcast_model(documents.sparkSession, model)  # bounded by CONTEXT_WORDS

    def run(batches):
        own = shared()
        for batch in slices(batches, most=SLICE):
            p = _probabilities(batch.column(1), own)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (id_remainder("doc_id", FOLDS) == HELD).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"), train(spark, sf_dir))
