"""Toxicity by a support vector machine on a gap-weighted subsequence kernel with Nystroem landmarks.

The kernel of two words counts their common letter triples, in order but not necessarily adjacent; each
occurrence weighs DECAY to the power of the characters that it spans (at most SPAN), and the kernel is
normalised. So letters that are inserted into an insult, or gaps in it, cost little. Every character
that is no letter is a gap. LANDMARKS training words span the space that the machine is fitted in
(Nystroem: K(x, L) K(L, L)^-1/2). The decision function is then a sum over landmarks, which collapses to
one weight per triple: scoring a word costs its triples, whatever the number of landmarks, and is exact.

Sentences inherit the label of their text, so training is by multiple instances: a toxic text has a word
that is, all words of a clean text are not. The start is by the letter runs that toxic texts have and
clean ones lack; then the machine is fitted and each toxic text's best word chosen anew, ROUNDS times,
the hardest words of clean texts always among the negatives. A logistic unit over a text's two best words
and the number of its suspect words calibrates the score, on texts kept out of the machine's training.

A run of three or more single characters between spaces is read as a word too ("i d i o t"). A word of
more than WIDTH characters is read in overlapping windows, all of it.

Training takes at most TRAIN_ROWS labelled rows of the training fold, a bounded sample by a hash of
doc_id, and of their clean words at most NEGATIVES by chance and the HARD hardest. Scoring reads whole texts.

Defined results: null and empty texts, and texts without a letter triple, get the score of the least
toxic word; repeated rows give a row each; a null doc_id counts as held out; without labelled rows of
both kinds in the training fold every score is the share of toxic ones (0 if there is none); other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Numbered, broadcast_model, id_remainder, labelled_sample, read_table, slices, words_of

FOLDS = 5
TRAIN_ROWS = 4000
LANDMARKS = 400
DECAY = 0.7
SPAN = 9
WIDTH = 16
ROUNDS = 4
#: Bytes of scored words that a task keeps.
KEPT = 48 << 20
#: Words of clean training texts that are negatives in every round, and the hardest ones that join them in each:
#: bounds of the fit, like TRAIN_ROWS.
NEGATIVES, HARD = 12_000, 3_000
LETTERS = 64
#: Characters of the words that are scored at once.
BLOCK = 1 << 20
#: Stands before and after a word, as a letter of its own.
EDGE = "\x02"
#: The score of a text without any letter triple.
FLOOR = -2.0
_SPACED = r"(?:^|\s)\S(?:\s\S){2,}(?:\s|$)"
_SPACED_RUN = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")


def letter_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes 1 .. 62 of letters, 63 of a word's edge, 0 of everything else, and the word lengths; words are lower case."""
    joined = "".join(words)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
    plain = (points >= 97) & (points <= 122)
    wide = np.zeros(len(points), bool)
    for point in np.unique(points[points > 127]).tolist():
        if chr(point).isalpha():
            wide |= points == point
    codes = np.where(plain, points - 96, np.where(wide, 27 + points % 36, np.where(points == ord(EDGE), 63, 0)))
    return codes, np.fromiter(map(len, words), np.int64, len(words))


def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index triples i < j < k < n that span at most SPAN characters, and their weights."""
    found = [(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, min(n, i + SPAN))]
    at = np.array(found, np.int64).reshape(-1, 3)
    return at, DECAY ** (at[:, 2] - at[:, 0] + 1.0)


def features(words: list[str]):
    """Blocks of (positions of the words, their triples' numbers, weights) with normalised weights.

    Words are windows of at most WIDTH characters; a word without a letter triple is in no block.
    """
    codes, lengths = letter_codes(words)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
    for n in np.unique(lengths).tolist():
        if n < 3:
            continue
        at, weight = _triples(n)
        own = np.flatnonzero(lengths == n)
        for block in np.array_split(own, -(-len(own) * len(at) // (1 << 20))):
            letters = codes[starts[block][:, None] + np.arange(n)]
            a, b, c = (letters[:, at[:, k]] for k in range(3))
            number = (a * LETTERS + b) * LETTERS + c
            value = np.where((a > 0) & (b > 0) & (c > 0), weight, 0.0)
            # The norm adds up equal triples first.
            order = np.argsort(number, axis=1, kind="stable")
            sorted_number, sorted_value = np.take_along_axis(number, order, 1), np.take_along_axis(value, order, 1)
            new = np.ones_like(sorted_number, bool)
            new[:, 1:] = sorted_number[:, 1:] != sorted_number[:, :-1]
            sums = np.add.reduceat(sorted_value.ravel(), np.flatnonzero(new.ravel()))
            which = np.flatnonzero(new.ravel()) // len(at)
            norm = np.sqrt(np.bincount(which, sums * sums, minlength=len(block)))
            live = norm > 0
            yield block[live], number[live], value[live] / norm[live, None]


def scores(words: list[str], weight: np.ndarray, bias: float) -> np.ndarray:
    """The decision value of each window; FLOOR where it has no triple."""
    out = np.full(len(words), FLOOR)
    for block, number, value in features(words):
        out[block] = np.einsum("ij,ij->i", weight[number], value) + bias
    return out


def windows(word: str) -> list[str]:
    word = EDGE + word.replace(EDGE, "") + EDGE
    if len(word) <= WIDTH:
        return [word]
    return [word[i : i + WIDTH] for i in range(0, len(word) - WIDTH // 2, WIDTH // 2)]


def word_scores(words: list[str], weight: np.ndarray, bias: float) -> np.ndarray:
    """The largest decision value over each word's windows, a block of words at a time."""
    out = [np.zeros(0)]
    ends = np.cumsum([len(w) for w in words])
    i = 0
    while i < len(words):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BLOCK)))
        parts = [windows(w) for w in words[i:j]]
        at = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]).astype(np.int64)
        out.append(np.maximum.reduceat(scores([p for ps in parts for p in ps], weight, bias), at))
        i = j
    return np.concatenate(out)


def text_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes, offsets and distinct lower-case words of the texts, spaced-out words included."""
    lowered = pc.utf8_lower(pc.fill_null(texts, ""))
    spaced = pc.match_substring_regex(lowered, _SPACED).to_numpy(zero_copy_only=False)
    if spaced.any():
        more = [t + " " + " ".join(re.sub(r"\s", "", m.group()) for m in _SPACED_RUN.finditer(t)) if s else t for t, s in zip(lowered.to_pylist(), spaced.tolist(), strict=True)]
        lowered = pa.array(more, pa.string())
    return words_of(lowered)


def evidence(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text: the two largest word values (FLOOR if there is none), and the logarithms of one plus the
    words above zero and of ten plus all words."""
    above = np.concatenate([[0], np.cumsum(values > 0)])
    counts = above[offsets[1:]] - above[offsets[:-1]]
    return np.column_stack([two_best(values, offsets), np.log1p(counts), np.log(np.diff(offsets) + 10.0)])


def two_best(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text the largest and second largest word value (FLOOR if there is none)."""
    out = np.full((len(offsets) - 1, 2), FLOOR)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if not len(full):
        return out
    best = np.maximum.reduceat(values, offsets[full])
    out[full, 0] = best
    rest = values.copy()
    owner = np.repeat(np.arange(len(full)), np.diff(offsets)[full])
    top = np.flatnonzero(values == best[owner])
    first = top[np.unique(owner[top], return_index=True)[1]]
    rest[first] = FLOOR
    out[full, 1] = np.maximum.reduceat(rest, offsets[full])
    return np.maximum(out, FLOOR)


@dataclass
class Model:
    weight: np.ndarray  # one weight per triple
    bias: float
    slope: np.ndarray
    shift: float


class _Space:
    """The Nystroem space of the landmarks."""

    def __init__(self, landmarks: list[str]):
        self.n = len(landmarks)
        # Only triples of a landmark have a row; all others share row 0, which stays zero.
        self.numbers = np.unique(np.concatenate([np.zeros(1, np.int64), *(number[value > 0] for _, number, value in features(landmarks))]))
        self.row = np.zeros(LETTERS**3, np.int32)
        self.row[self.numbers] = np.arange(len(self.numbers))
        self.row[0] = 0
        self.table = np.zeros((len(self.numbers), self.n), np.float32)
        for block, number, value in features(landmarks):
            np.add.at(self.table, (self.row[number], block[:, None]), value)
        kernel = self.kernel(landmarks)
        values, vectors = np.linalg.eigh((kernel + kernel.T) / 2)
        self.root = vectors / np.sqrt(np.maximum(values, 1e-6))

    def kernel(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.n))
        for block, number, value in features(words):
            for i in range(0, len(block), 64):
                out[block[i : i + 64]] = np.einsum("wtl,wt->wl", self.table[self.row[number[i : i + 64]]], value[i : i + 64], optimize=True)
        return out

    def map(self, words: list[str]) -> np.ndarray:
        return self.kernel(words) @ self.root

    def collapse(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(LETTERS**3)
        out[self.numbers] = self.table @ (self.root @ w)
        return out


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared-hinge support vector machine by Newton steps. y: -1 or 1; cost: per row."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(12):
        slack = 1 - y * (x @ w)
        on = slack > 0
        rows = x[on] * cost[on, None]
        fresh = np.linalg.solve(ridge + rows.T @ x[on], rows.T @ y[on])
        if np.abs(fresh - w).max() < 1e-6:
            break
        w = fresh
    return w[:-1], float(w[-1])


def _start_words(texts: list[list[str]], labels: np.ndarray) -> list[str]:
    """Of each toxic text, the word with the letter run that most speaks for toxicity."""
    def runs(word):
        return {word[i : i + 4] for i in range(max(1, len(word) - 3))}

    in_toxic, in_all = Counter(), Counter()
    sets = [{r for w in words for r in runs(w)} for words in texts]
    for found, y in zip(sets, labels.tolist(), strict=True):
        in_all.update(found)
        if y:
            in_toxic.update(found)
    prior = max(labels.mean(), 1e-6)
    worth = {r: in_toxic[r] * np.log(max((in_toxic[r] + 0.1 * prior) / (n + 0.1) / prior, 1e-9)) for r, n in in_all.items()}
    return [max(words, key=lambda w: (max(map(worth.__getitem__, runs(w))), w)) for words, y in zip(texts, labels.tolist(), strict=True) if y and words]


def fit(texts: pa.Array, labels: np.ndarray) -> Model:
    share = float(labels.mean()) if len(labels) else 0.0
    if not 0 < share < 1:
        p = min(max(share, 1e-9), 1 - 1e-9)
        return Model(np.zeros(LETTERS**3, np.float32), 0.0, np.zeros(4), float(np.log(p / (1 - p))) if len(labels) else -40.0)
    rng = np.random.default_rng(11)
    codes, offsets, distinct = text_words(texts)
    distinct = distinct.to_pylist()
    # Windows stand for long words in training, too.
    own = [sorted({p for k in set(codes[i:j].tolist()) for p in windows(distinct[k]) if len(p) > 2}) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    fold = rng.random(len(own)) < 0.7
    learn = np.flatnonzero(fold)
    if labels[learn].min() == labels[learn].max():
        learn = np.arange(len(own))
    chosen = _start_words([own[k] for k in learn], labels[learn])
    clean = sorted({w for k in learn if not labels[k] for w in own[k]})
    toxic_docs = [own[k] for k in learn if labels[k] and own[k]]
    pick = [clean[k] for k in rng.permutation(len(clean))[:NEGATIVES]]
    common = [w for w, _ in Counter(chosen).most_common(LANDMARKS // 2)]
    space = _Space(list(dict.fromkeys(common + pick))[:LANDMARKS])
    negatives, weight, bias = list(pick), None, 0.0
    clean_set = set(clean)
    for _ in range(ROUNDS):
        positives = [w for w in chosen if w not in clean_set] or chosen
        counts = Counter(positives)
        words = list(counts) + negatives
        y = np.array([1.0] * len(counts) + [-1.0] * len(negatives))
        cost = np.array([min(8.0, 2.0 * c) for c in counts.values()] + [1.0] * len(negatives))
        w, bias = _machine(space.map(words), y, cost)
        weight = space.collapse(w)
        value = dict(zip(clean, scores(clean, weight, bias).tolist(), strict=True))
        hard = sorted(clean, key=lambda x: -value[x])[:HARD]
        negatives = list(dict.fromkeys(hard + pick))
        flat = sorted({x for words in toxic_docs for x in words})
        value = dict(zip(flat, scores(flat, weight, bias).tolist(), strict=True))
        chosen = []
        for words in toxic_docs:
            ranked = sorted((x for x in words if x not in clean_set), key=lambda x: -value[x])
            chosen += [x for x in ranked[:4] if value[x] > 0] or ranked[:1]
    kept = np.setdiff1d(np.arange(len(own)), learn) if len(learn) < len(own) else learn
    values = word_scores(distinct, weight, bias)[codes]
    best = evidence(values, offsets)
    slope, shift = _calibrate(best[kept], labels[kept])
    return Model(weight.astype(np.float32), bias, slope, shift)


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps with a little shrinkage."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.array([2.0] + [0.0] * x.shape[1])
    shrink = np.diag([0.05] * x.shape[1] + [0.01])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + shrink, z.T @ (y - p) - shrink @ w)
        w = w + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
    return w[:-1], float(w[-1])


def train(spark: SparkSession, sf_dir: str) -> Model:
    texts, labels = labelled_sample(spark, sf_dir, "toxic", FOLDS, 0, TRAIN_ROWS)
    return fit(texts, labels)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every row; only `text` is looked at."""
    shared = broadcast_model(documents.sparkSession, model)  # one weight per triple, whatever the input

    def run(batches):
        own = shared()
        known, table = Numbered(), np.zeros(0)
        for batch in slices(batches):
            codes, offsets, words = text_words(batch.column(1))
            if known.known.nbytes + table.nbytes > KEPT:
                known, table = Numbered(), table[:0]
            rows, fresh = known.find(words)
            known.add(fresh)
            table = np.concatenate([table, word_scores(fresh.to_pylist(), own.weight, own.bias)])
            best = evidence(table[rows][codes] if len(codes) else np.zeros(0), offsets)
            p = 1 / (1 + np.exp(-np.clip(best @ own.slope + own.shift, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (id_remainder("doc_id", FOLDS) == 0).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"), train(spark, sf_dir))
