"""Language ID by segmentation-marginalised unigrams.

The vocabulary is that of a public sentence-piece model and stays fixed, every piece of it; each language has
a probability of every piece. A word's probability in a language is the sum over all ways to cut it into
pieces, which a forward pass gives for all languages at once; a text's is the product over its words. The
piece probabilities are fitted by expectation maximisation over the same lattice (forward and backward) from
all words, long ones too, of at most TRAIN_ROWS rows of the training fold, a bounded sample by a hash of
doc_id. Sums are kept as logarithms per position, so that words of any length have their value.

Distinct words are scored once per slice of a task, and workers keep a table, bounded in bytes, of words they
have scored, so the cost follows the distinct words.

Defined results: null texts and texts without a letter get `und` and score 0; of equal scores the first
language by name wins; score is the softmax over languages at a temperature fitted on the training rows;
rows with a null lang teach nothing; repeated rows give a row each; a null doc_id counts as fold 0 (held
out); without any training row every text is `und`; other columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Numbered, broadcast_model, id_remainder, kept_by_worker, read_table, segment_sums, slices, words_of

FOLDS = 5
TRAIN_ROWS = 2000
ROUNDS = 3
START = "▁"
#: Probability of a character outside the vocabulary.
UNKNOWN = 1e-7
#: Bytes of scored words that a worker keeps.
KEPT = 64 << 20
#: Positions (words by characters) of a lattice.
CELLS = 1 << 18


@dataclass
class Model:
    languages: list[str]
    pieces: list[str]
    prob: np.ndarray  # (pieces + 1, languages); the last row is that of an unknown character
    temperature: float


def public_pieces(model_file: str) -> list[str]:
    """The vocabulary's pieces, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class Pieces:
    """The vocabulary as an automaton that finds every piece in a string."""

    def __init__(self, pieces: list[str]):
        self.sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.longest = int(self.sizes.max(initial=1))
        self.unknown = len(pieces)
        self.automaton = ahocorasick.Automaton()
        for k, piece in enumerate(pieces):
            self.automaton.add_word(piece, k)
        self.automaton.make_automaton()

    def found(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces end (their last character), in order, and which they are."""
        if not len(self.sizes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]


class Lattice:
    """All pieces of a list of words as edges (word, start, end, piece); words have no white space."""

    def __init__(self, pieces: Pieces, words: list[str]):
        self.n, self.longest = len(words), pieces.longest
        self.lengths = np.fromiter((len(w) + 1 for w in words), np.int64, self.n)
        joined = "".join(f"{START}{w}\n" for w in words)
        last, piece = pieces.found(joined)
        size = pieces.sizes[piece]
        alone = np.zeros(len(joined), bool)
        alone[last[size == 1]] = True
        starts = np.concatenate([[0], np.cumsum(self.lengths + 1)])
        alone[starts[1:] - 1] = True  # the ends of words are no characters
        missing = np.flatnonzero(~alone)
        if len(missing):  # characters outside the vocabulary
            last, piece, size = np.concatenate([last, missing]), np.concatenate([piece, np.full(len(missing), pieces.unknown)]), np.concatenate([size, np.ones(len(missing), np.int64)])
            order = np.argsort(last, kind="stable")
            last, piece, size = last[order], piece[order], size[order]
        word = np.repeat(np.arange(self.n, dtype=np.int32), self.lengths + 1)[last]
        self.word, self.piece = word, piece.astype(np.int32)
        self.end = (last + 1 - starts[word]).astype(np.int32)
        self.start = (self.end - size).astype(np.int32)

    def _order(self, by: np.ndarray):
        """Edges in order of by, then of word (their own order), and where each value begins."""
        most = int(self.lengths.max(initial=0))
        order = np.argsort(by.astype(np.int16) if most < 1 << 15 else by, kind="stable")
        return order, np.concatenate([[0], np.cumsum(np.bincount(by, minlength=most + 1))])

    def _sums(self, flow: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words of w, which is sorted, and the sums of flow over each."""
        first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        return w[first], np.add.reduceat(flow, first, axis=0)

    def forward(self, prob: np.ndarray) -> np.ndarray:
        """The logarithm of each word's probability in each language."""
        most = int(self.lengths.max(initial=0))
        ring = self.longest + 1
        logs = np.zeros((ring, self.n, prob.shape[1]))  # of the sums up to a position; the last `longest` of them
        total = np.zeros((self.n, prob.shape[1]))
        order, cuts = self._order(self.end)
        by_length = np.argsort(self.lengths, kind="stable")
        ends = np.searchsorted(self.lengths[by_length], np.arange(most + 2))
        for j in range(1, most + 1):
            e = order[cuts[j] : cuts[j + 1]]
            w = self.word[e]
            before = logs[(j - 1) % ring]
            flow = prob[self.piece[e]]
            far = np.flatnonzero(self.start[e] != j - 1)
            flow[far] *= np.exp(logs[self.start[e[far]] % ring, w[far]] - before[w[far]])
            live, sums = self._sums(flow, w)
            logs[j % ring, live] = before[live] + np.log(sums)
            done = by_length[ends[j] : ends[j + 1]]
            total[done] = logs[j % ring, done]
        return total

    def expected_counts(self, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in each language, words weighted by weight[word, language]."""
        most = int(self.lengths.max(initial=0))
        ahead = np.zeros((most + 1, self.n, prob.shape[1]))  # logarithms of the sums up to a position
        back = np.zeros_like(ahead)  # and from it
        order, cuts = self._order(self.end)
        for j in range(1, most + 1):
            e = order[cuts[j] : cuts[j + 1]]
            w = self.word[e]
            live, sums = self._sums(prob[self.piece[e]] * np.exp(ahead[self.start[e], w] - ahead[j - 1, w]), w)
            ahead[j, live] = ahead[j - 1, live] + np.log(sums)
        order, cuts = self._order(self.start)
        for i in range(most - 1, -1, -1):
            e = order[cuts[i] : cuts[i + 1]]
            w = self.word[e]
            live, sums = self._sums(prob[self.piece[e]] * np.exp(back[self.end[e], w] - back[i + 1, w]), w)
            back[i, live] = back[i + 1, live] + np.log(sums)
        whole = ahead[self.lengths, np.arange(self.n)]
        use = prob[self.piece] * np.exp(ahead[self.start, self.word] + back[self.end, self.word] - whole[self.word]) * weight[self.word]
        return np.column_stack([np.bincount(self.piece, use[:, k], minlength=len(prob)) for k in range(prob.shape[1])])


def blocks_of(lengths: np.ndarray, most: int = 1 << 14):
    """Numbers of words, shortest first, in blocks of about CELLS positions: a long word costs no other anything."""
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        size = max(1, min(most, CELLS // (int(lengths[order[min(at + most, len(order)) - 1]]) + 1)))
        yield order[at : at + size]
        at += size


def fit(texts: pa.Array, languages: np.ndarray, pieces: list[str]) -> Model:
    """texts and their languages -> piece probabilities by expectation maximisation."""
    names = sorted(set(languages.tolist()))
    index = Pieces(pieces)
    codes, offsets, distinct = words_of(texts)
    which = np.repeat(np.searchsorted(names, languages), np.diff(offsets))
    weight = np.bincount(codes * len(names) + which, minlength=len(distinct) * len(names)).astype(float).reshape(len(distinct), len(names))
    words = distinct.to_pylist()
    prob = np.full((len(pieces) + 1, len(names)), 1.0 / (len(pieces) + 1))
    prob[-1] = UNKNOWN
    blocks = [b.tolist() for b in blocks_of(np.fromiter(map(len, words), np.int64, len(words)), 1 << 13)]
    lattices = [Lattice(index, [words[k] for k in b]) for b in blocks]
    for _ in range(ROUNDS):
        counts = sum((lattice.expected_counts(prob, weight[b]) for b, lattice in zip(blocks, lattices, strict=True)), np.zeros_like(prob))
        shared = counts.sum(axis=1, keepdims=True) + 0.1
        prob = counts + 5.0 * shared / shared.sum() * 100
        prob /= prob.sum(axis=0)
        prob[-1] = UNKNOWN
    logs = np.zeros((len(words), len(names)))
    for b, lattice in zip(blocks, lattices, strict=True):
        logs[b] = lattice.forward(prob)
    sums = segment_sums(logs[codes], offsets)
    truth = np.searchsorted(names, languages)
    used = np.diff(offsets) > 0
    best = min((2.0**k for k in range(0, 9)), key=lambda t: _loss(sums[used] / t, truth[used]))
    return Model(names, pieces, prob, best)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _loss(x: np.ndarray, truth: np.ndarray) -> float:
    return float(-np.log(np.maximum(_softmax(x)[np.arange(len(x)), truth], 1e-12)).mean()) if len(x) else 0.0


def train(spark: SparkSession, documents: DataFrame, model_file: str) -> Model | None:
    """A model from a bounded sample of the training fold, one text an id; None if that has no row."""
    rows = documents.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_remainder("doc_id", FOLDS) != 0))
    total = rows.count()
    if total > TRAIN_ROWS:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24)) < int((1 << 24) * TRAIN_ROWS / total))
    # One text of an id, so that an id that repeats without end is one row.
    table = rows.groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("one")).select("doc_id", "one.text", "one.lang").toArrow()
    table = table.sort_by("doc_id")
    if not table.num_rows:
        return None
    return fit(table["text"].combine_chunks(), np.array(table["lang"].to_pylist(), dtype=object), public_pieces(model_file))


def predict(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row; only `text` is looked at."""
    spark = documents.sparkSession
    shared = broadcast_model(spark, model)  # the vocabulary's size, whatever the input
    name = uuid.uuid4().hex  # of the model, for the words that workers have scored with it

    def run(batches):
        own = shared()
        index = kept_by_worker(("langid", name), lambda: [Pieces(own.pieces), Numbered(), np.zeros((0, len(own.languages)))]) if own else []
        for batch in slices(batches):
            text = pc.fill_null(batch.column(1), "")
            if own is None:
                names, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            else:
                codes, offsets, distinct = words_of(text)
                if index[1].known.nbytes + index[2].nbytes > KEPT:
                    index[1:] = [Numbered(), index[2][:0]]
                rows, fresh = index[1].find(distinct)
                words, values = fresh.to_pylist(), np.zeros((len(fresh), len(own.languages)))
                for block in blocks_of(pc.utf8_length(fresh).to_numpy(zero_copy_only=False)):
                    values[block] = Lattice(index[0], [words[k] for k in block.tolist()]).forward(own.prob)
                index[1].add(fresh)
                table = index[2] = np.concatenate([index[2], values])
                sums = segment_sums(table[rows][codes], offsets)
                share = _softmax(sums / own.temperature)
                best = sums.argmax(axis=1)
                lettered = pc.match_substring_regex(text, r"\pL").to_numpy(zero_copy_only=False)
                names = [own.languages[k] if ok else "und" for k, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
                score = np.where(lettered, share[np.arange(len(best)), best], 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (id_remainder("doc_id", FOLDS) == 0).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = read_table(spark, sf_dir, "documents")
    return predict(documents, train(spark, documents, public_tokenizers.path("piece_bpe_32k.model")))
