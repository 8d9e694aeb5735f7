"""Secret scans: fixed base rules, and a character convolutional network over every other candidate.

Base rules give `assign`, `access` and `hex` spans. A candidate is any run of CANDIDATE or more token
characters with a digit and a letter in it that no base span touches; the network reads its characters
with LEFT and RIGHT characters of context and adds a `model` span where its probability reaches the
threshold. A longer candidate is read in overlapping windows, all of it, and keeps the largest value.

The network is numpy: character vectors, one convolution, the largest activation of each filter in the
left context, the candidate and the right context, and a logistic unit. It learns from labelled findings:
those of the base rules in a bounded sample of TRAIN_DOCS documents (by a hash of doc_id), as negatives those
candidates of these documents that have a harmless form (HARMLESS), of either PER_DOC a document, and generated findings of public credential
formats and look-alikes, labelled by construction. Other candidates may be secrets, so nothing is learned from them; and each
harmless one is paired with a generated credential in its place, so that the words around it tell nothing. Probabilities are calibrated by a temperature. The threshold
is, of all that keep RECALL of the held-back positives, the one with the fewest held-back errors, and the least
of equals (EVEN counts too where it keeps RECALL); EVEN alone if no positive is held back.

Defined results: null counts as empty; spans are code points, end exclusive, in order of start and then
of kind; repeated rows give a row each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_model, read_table, slices

#: The kinds in their order, and the base patterns.
KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

CANDIDATE = 16
_TOKEN = "A-Za-z0-9+/_=-"
_RUN = re.compile(rf"(?<![{_TOKEN}])(?=[{_TOKEN}]*[0-9])(?=[{_TOKEN}]*[A-Za-z])[{_TOKEN}]{{{CANDIDATE},}}")
#: The least text that any rule or candidate needs; linear-time, so every text can be put to it.
_ANY = rf"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{{{LEAST_HEX}}}"
_LONG = rf"[{_TOKEN}]{{{CANDIDATE}}}"

#: Forms that are no credentials: UUIDs, dates, and paths and slugs of words and numbers.
_WORD = "(?:[a-z]{1,15}|[A-Z][a-z]{0,14}|[0-9]{1,8})"
HARMLESS = re.compile(
    r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|[0-9A-F]{8}(?:-[0-9A-F]{4}){3}-[0-9A-F]{12}"
    r"|[0-9]{4}([-/_])[0-9]{2}\1[0-9]{2}[T_-][0-9]{2}(?:-?[0-9]{2}){0,2}Z?"
    rf"|/?{_WORD}(?:[/_-]{_WORD}){{2,}}/?"
)

LEFT, BODY, RIGHT = 32, 64, 16
WIDTH = LEFT + BODY + RIGHT
SYMBOLS, VECTOR, FILTERS, KERNEL = 97, 8, 16, 5
TRAIN_DOCS = 6000
#: Base spans, and harmless candidates, of one text that training takes at most; of each its first BODY characters.
PER_DOC = 4
GENERATED = 1200
EPOCHS = 10
#: Windows that the network reads at once.
BATCH = 1 << 12
RECALL = 0.95
EVEN = 0.5


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules, sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    return sorted(out)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Token runs that no taken span touches."""
    out, at = [], 0
    spans = sorted((s, e) for s, _, e in taken)
    reach = -1
    for m in _RUN.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            reach = max(reach, spans[at][1])
            at += 1
        if reach <= m.start():
            out.append(m.span())
    return out


def _symbols(part: str) -> np.ndarray:
    raw = np.frombuffer(part.encode("ascii", "replace"), np.uint8).astype(np.int64)
    return np.where((raw >= 32) & (raw < 127), raw - 31, 96)


def window_blocks(text: str, start: int, end: int, most: int = 1 << 12):
    """Symbol rows of a candidate, LEFT before it, BODY of it and RIGHT after it (0 pads), in blocks of at most `most`."""
    places = range(start, max(end - BODY // 2, start + 1), BODY // 2) if end - start > BODY else range(start, start + 1)
    before, after = _symbols(text[max(0, start - LEFT) : start]), _symbols(text[end : end + RIGHT])
    for k in range(0, len(places), most):
        own = places[k : k + most]
        rows = np.zeros((len(own), WIDTH), np.uint8)
        rows[:, LEFT - len(before) : LEFT] = before
        rows[:, LEFT + BODY : LEFT + BODY + len(after)] = after
        body = np.zeros((len(own) + 1) * (BODY // 2), np.uint8)
        there = _symbols(text[own[0] : min(end, own[0] + len(body))])
        body[: len(there)] = there
        rows[:, LEFT : LEFT + BODY] = np.lib.stride_tricks.sliding_window_view(body, BODY)[:: BODY // 2]
        yield rows


def windows(text: str, start: int, end: int) -> np.ndarray:
    """All symbol rows of a candidate."""
    return np.concatenate(list(window_blocks(text, start, end)))


ZONES = (slice(0, LEFT), slice(LEFT, LEFT + BODY), slice(LEFT + BODY, WIDTH))


@dataclass
class Network:
    vectors: np.ndarray
    kernel: np.ndarray  # (KERNEL, VECTOR, FILTERS)
    shift: np.ndarray
    dense: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = EVEN
    recall: float | None = None  # share of the held-back positives that reach the threshold

    def parameters(self) -> list[np.ndarray]:
        return [self.vectors, self.kernel, self.shift, self.dense, self.bias]

    def _convolve(self, rows: np.ndarray):
        padded = np.pad(rows, ((0, 0), (KERNEL // 2, KERNEL // 2)))
        x = self.vectors[padded]
        out = sum((x[:, k : k + WIDTH] @ self.kernel[k] for k in range(KERNEL)), np.zeros((len(rows), WIDTH, FILTERS)))
        return padded, x, out + self.shift

    def logits(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows))
        for i in range(0, len(rows), 512):
            c = np.maximum(self._convolve(rows[i : i + 512])[2], 0)
            out[i : i + 512] = np.concatenate([c[:, z].max(axis=1) for z in ZONES], axis=1) @ self.dense + self.bias
        return out

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(rows) / self.temperature, -40, 40)))

    def slopes(self, rows: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        padded, x, c = self._convolve(rows)
        a = np.maximum(c, 0)
        tops = [a[:, z].argmax(axis=1) + z.start for z in ZONES]
        pooled = np.concatenate([np.take_along_axis(a, t[:, None], 1)[:, 0] for t in tops], axis=1)
        p = 1 / (1 + np.exp(-np.clip(pooled @ self.dense + self.bias, -40, 40)))
        d = (p - y) / len(y)
        back = np.zeros_like(a)
        for k, t in enumerate(tops):
            part = np.outer(d, self.dense[k * FILTERS : (k + 1) * FILTERS])
            np.put_along_axis(back, t[:, None], np.take_along_axis(back, t[:, None], 1) + part[:, None], 1)
        back *= c > 0
        kernel = np.stack([np.tensordot(x[:, k : k + WIDTH], back, ([0, 1], [0, 1])) for k in range(KERNEL)])
        dx = np.zeros_like(x)
        for k in range(KERNEL):
            dx[:, k : k + WIDTH] += back @ self.kernel[k].T
        vectors = np.zeros_like(self.vectors)
        np.add.at(vectors, padded, dx)
        vectors[0] = 0
        return [vectors, kernel, back.sum(axis=(0, 1)), pooled.T @ d, d.sum(keepdims=True)]


#: A context of more findings than this is split between learned and held-back findings.
TEMPLATE = 16


def generated(rng: np.random.Generator, n: int) -> list[tuple[str, str, str, int]]:
    """(left, candidate, right, label): credentials of public formats, and look-alikes that are none."""

    def some(letters: str, size: int) -> str:
        return "".join(rng.choice(list(letters), size))

    lower, upper, digits, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    mixed, base64 = lower + upper + digits, lower + upper + digits + "+/"
    secrets = [
        lambda: "ghp_" + some(mixed, 36),
        lambda: "xoxb-" + some(digits, 12) + "-" + some(mixed, 24),
        lambda: "AIza" + some(mixed + "_-", 35),
        lambda: "sk_live_" + some(mixed, 24),
        lambda: some(base64, 40),
        lambda: some(mixed, int(rng.integers(20, 48))),
        lambda: some(hexa.upper(), int(rng.integers(24, 64))),
        lambda: "eyJ" + some(mixed, 60),
    ]
    names = ["pwd=", "auth: ", "Authorization: Bearer ", "client_key = ", "credential: ", "AWS_ACCESS=", "private_key: ", "", "", " "]
    harmless = [
        lambda: "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12)),
        lambda: f"{some(digits, 4)}-{some(digits, 2)}-{some(digits, 2)}T{some(digits, 2)}-{some(digits, 2)}",
        lambda: "/".join(some(lower, int(rng.integers(3, 9))) for _ in range(4)) + "/" + some(digits, 3),
        lambda: "-".join(some(lower, int(rng.integers(3, 9))) for _ in range(4)) + "-" + some(digits, 2),
        lambda: some(lower, int(rng.integers(15, 30))) + some(digits, int(rng.integers(1, 3))),
        lambda: "+" + some(digits, 3) + "-" + some(digits, 4) + "-" + some(digits, 7) + some(lower, 1),
        lambda: some(lower, 8) + "_" + some(lower, 9) + "_" + some(digits, 2),
        lambda: "=" * 18 + some(digits, 1) + some(lower, 2),
    ]
    near = ["see page ", "id ", "http://", "on ", "version ", "file ", "", ", ", "the "]

    def words() -> str:
        return " ".join(some(lower, int(rng.integers(2, 9))) for _ in range(5))

    out = []
    for k in range(n):
        good = k % 2 == 0
        make, lead = (secrets, names) if good else (harmless, near)
        out.append((words() + " " + lead[int(rng.integers(len(lead)))], make[int(rng.integers(len(make)))](), " " + words(), int(good)))
    return out


def recall_threshold(positive: np.ndarray, negative: np.ndarray) -> tuple[float, float | None]:
    """The threshold for the probabilities of held-back positives and negatives, and the recall that it reaches."""
    if not len(positive):
        return EVEN, None
    positive = np.sort(positive)
    most = positive[int(np.floor((1 - RECALL) * len(positive)))]  # any larger threshold loses too many
    choices = np.unique(np.append(positive[positive <= most], min(EVEN, most)))
    errors = np.searchsorted(positive, choices) + len(negative) - np.searchsorted(np.sort(negative), choices)
    threshold = float(choices[errors.argmin()])
    return threshold, float((positive >= threshold).mean())


def fit(findings: list[tuple[str, str, str, int]]) -> Network:
    """A network from labelled findings (left, candidate, right, label)."""
    rng = np.random.default_rng(5)
    findings = findings + generated(rng, GENERATED)
    rows = np.concatenate([windows(a + b + c, len(a), len(a) + len(b))[:1] for a, b, c, _ in findings])
    y = np.array([f[3] for f in findings], float)
    # A fifth of the contexts is held back, so that what is learned of a context does not count for its recall. Of a
    # context that many findings share (a template of the corpus) a fifth of the findings is.
    _, context, shared = np.unique([f"{a}\0{c}" for a, _, c, _ in findings], return_inverse=True, return_counts=True)
    unit = np.where(shared[context] > TEMPLATE, len(shared) + np.arange(len(y)), context)
    units = np.unique(unit)
    held_back = np.isin(unit, rng.permutation(units)[: len(units) // 5])
    kept, learn = np.flatnonzero(held_back), np.flatnonzero(~held_back)
    net = Network(rng.normal(0, 0.5, (SYMBOLS, VECTOR)), rng.normal(0, np.sqrt(2 / (KERNEL * VECTOR)), (KERNEL, VECTOR, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, 3 * FILTERS), np.zeros(1))
    net.vectors[0] = 0
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in net.parameters()]
    step = 0
    for _ in range(EPOCHS):
        for block in np.array_split(rng.permutation(learn), max(1, len(learn) // 64)):
            step += 1
            for p, g, m in zip(net.parameters(), net.slopes(rows[block], y[block]), moments, strict=True):
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.999 * m[1] + 0.001 * g * g
                p -= 4e-3 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    z, truth = net.logits(rows[kept]), y[kept]

    def loss(t: float) -> float:
        p = np.clip(1 / (1 + np.exp(-np.clip(z / t, -40, 40))), 1e-6, 1 - 1e-6)
        return float(-(truth * np.log(p) + (1 - truth) * np.log(1 - p)).mean())

    net.temperature = min((0.5 * 1.25**k for k in range(16)), key=loss)
    p = net.probabilities(rows[kept])
    net.threshold, net.recall = recall_threshold(p[truth == 1], p[truth == 0])
    return net


def findings(documents: DataFrame) -> list[tuple[str, str, str, int]]:
    """Labelled findings of a bounded sample: base spans (1) and untouched harmless candidates (0), PER_DOC each a text.

    The sample is by a hash of doc_id. An id that repeats (null is one) is in it with as many findings as one text
    has, those that are first in order.
    """

    def run(batches):
        for batch in slices(batches):
            out = []
            may = _may_hold(batch.column(0))
            for place, text in zip(batch.column(1).filter(may).to_pylist(), batch.column(0).filter(may).to_pylist(), strict=True):
                taken = base_spans(text)
                harmless = [(s, e, 0) for s, e in candidates(text, taken) if HARMLESS.fullmatch(text, s, e)]
                spans = [(s, e, 1) for s, _, e in taken[:PER_DOC] if e - s >= CANDIDATE] + harmless[:PER_DOC]
                out += [(text[max(0, s - LEFT) : s], text[s : min(e, s + BODY)], text[e : e + RIGHT], y, place, k) for k, (s, e, y) in enumerate(spans)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.string()] * 3 + [pa.int32(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["before", "found", "after", "label", "id", "place"])

    rows = documents.where(F.col("text").isNotNull())
    total = rows.count()
    if total > TRAIN_DOCS:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24)) < int((1 << 24) * TRAIN_DOCS / total))
    all_found = rows.select("text", F.col("doc_id").cast("long").alias("id")).mapInArrow(run, "before string, found string, after string, label int, id long, place int")
    got = all_found.groupBy("id", "place").agg(F.min(F.struct("before", "found", "after", "label")).alias("one")).select("one.*").toArrow()
    labelled = sorted(zip(*(got[k].to_pylist() for k in ("before", "found", "after", "label")), strict=True))
    harmless = [f for f in labelled if f[3] == 0]
    made = [g for g in generated(np.random.default_rng(6), 2 * len(harmless)) if g[3]]
    return labelled + [(before, g[1], after, 1) for (before, _, after, _), g in zip(harmless, made, strict=True)]


def _may_hold(texts: pa.Array) -> pa.Array:
    """Which texts can hold a base span or a candidate."""
    texts = pc.fill_null(texts, "")
    return pc.or_(pc.match_substring_regex(texts, _ANY), pc.and_(pc.match_substring_regex(texts, _LONG), pc.match_substring_regex(texts, "[0-9]")))


def train(documents: DataFrame) -> Network:
    return fit(findings(documents))


def find(texts: pa.Array, net: Network) -> list[list[tuple[int, int, int]]]:
    """Per text its spans (start, kind, end), sorted."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    may = _may_hold(texts).to_numpy(zero_copy_only=False)
    where: list[tuple[int, int, int]] = []  # candidates
    best: dict[int, float] = {}  # and the largest value of each
    rows, owner = [], []

    def read() -> None:
        for k, value in zip(owner, net.probabilities(np.concatenate(rows)).tolist(), strict=True):
            best[k] = max(best.get(k, 0.0), value)
        rows.clear()
        owner.clear()

    for i in np.flatnonzero(may).tolist():
        text = texts[i].as_py()
        out[i] = base_spans(text)
        for start, end in candidates(text, out[i]):
            for block in window_blocks(text, start, end):
                rows.append(block)
                owner += [len(where)] * len(block)
                if len(owner) >= BATCH:
                    read()
            where.append((i, start, end))
    if rows:
        read()
    for k, (i, start, end) in enumerate(where):
        if best[k] >= net.threshold:
            out[i].append((start, 3, end))
    return [sorted(spans) for spans in out]


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(documents: DataFrame, net: Network) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row."""
    shared = broadcast_model(documents.sparkSession, net)  # a fixed size

    def run(batches):
        own = shared()
        for batch in slices(batches):
            found = find(batch.column(1), own)
            base = [[x for x in spans if x[1] < 3] for spans in found]
            counts = [pa.array([sum(x[1] == k for x in spans) for spans in base], pa.int64()) for k in range(3)]
            hashes = pa.array([hashlib.sha256(_written(spans).encode()).hexdigest() for spans in base], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, hashes, pa.array([_written(x) for x in found], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(documents: DataFrame, net: Network, mark: str = "[SECRET]") -> DataFrame:
    """documents with every span of text replaced by `mark` and n_chars, if there, counted anew; all rows stay."""
    shared = broadcast_model(documents.sparkSession, net)
    place = documents.columns.index("text")
    count = documents.columns.index("n_chars") if "n_chars" in documents.columns else None

    def run(batches):
        own = shared()
        for batch in slices(batches):
            texts = batch.column(place).to_pylist()
            sizes = batch.column(count).to_pylist() if count is not None else [None] * len(texts)
            for i, spans in enumerate(find(batch.column(place), own)):
                if spans:
                    parts, at = [], 0
                    for start, _, end in spans:
                        if end > at:
                            if start >= at:
                                parts += [texts[i][at:start], mark]
                            at = end
                    texts[i] = "".join([*parts, texts[i][at:]])
                    sizes[i] = len(texts[i])
            columns = list(batch.columns)
            columns[place] = pa.array(texts, pa.string())
            if count is not None:
                columns[count] = pa.array(sizes, batch.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return documents.mapInArrow(run, documents.schema)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return scan(documents, train(documents))
