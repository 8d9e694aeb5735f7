"""Substring dedup with fixed-block anchors.

A window of 20 words holds a whole block of 10 at an offset that is a multiple of 10 in its document, so
reference blocks that do not overlap index every window ten times over-sparsely, and nothing is missed.

1. Every document's blocks are indexed and every other rolling 10-word window probes the index. They travel
   packed and sorted, as 32 bits of hash each, one row per chunk and part of the hash range; a chunk names a
   hash once, so that a block that a third of all rows share costs one entry a chunk.
2. A hash that is a block and occurs anywhere else is an anchor; its chunks get it back.
3. Anchors are extended: each 20-word window that holds one is hashed (96 bits) in its chunk. Of equal
   windows in one chunk only the first goes on; the others are repeats already.
4. Equal windows of different chunks meet; all but the first are repeats. Consecutive repeats are the
   maximal exact repeat; no pair of documents is ever formed, so a passage or document that a third of
   all rows shares costs one row a chunk and window.
5. Repeats return to their chunk, which removes the words they cover.

A chunk is CHUNK consecutive rows of one input partition. Positions are words within a chunk. The hash range
has PARTS parts for each task of the shuffles, and these are as many as read the input (or the session's
number, where that is more): a task holds one part at a time, which does not grow with the input.

Rows are numbered by their place in the input, which is read three times and must come alike each time. Files
do (`stable`); anything else is written to the checkpoint folder first.

Defined results: null texts have no words; a text without words keeps the hash of the empty string;
rows that repeat a doc_id are ordered by their place in the input; null doc_ids are the smallest; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, mix64, read_table, slices, tasks_for, words_of

WINDOW, BLOCK = 20, 10
CHUNK_BITS = 10
PARTS = 8
FACTORS = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)


def rolled(words: np.ndarray, factor: np.uint64) -> np.ndarray:
    """A hash of each run of BLOCK words; the last runs reach into zeros."""
    padded = np.append(words, np.zeros(BLOCK, np.uint64))
    out = np.zeros(len(words), np.uint64)
    for k in range(BLOCK):
        out = out * factor + padded[k : k + len(words)]
    return out


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and the offsets of the texts."""
    codes, offsets, distinct = words_of(texts)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, distinct.to_pylist()), np.uint64, len(distinct))
    return hashes[codes], offsets


def packed_positions(at: np.ndarray) -> bytes:
    """Increasing positions (or hashes) as byte planes of their steps; the upper planes are mostly zeros."""
    steps = np.diff(at, prepend=0).astype("<u4")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes()


def unpacked_positions(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64))


def _by_part(part: np.ndarray):
    """(part, indices in order) of each part that occurs."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
    for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
        yield int(part[order[i]]), order[i:j]


def _chunked(batches, columns: int):
    """Slices of rows of one chunk each: (chunk, first row's number in it, batch)."""
    for batch in slices(batches):
        chunk = batch.column(0).to_numpy() >> CHUNK_BITS
        cuts = np.flatnonzero(np.diff(chunk, prepend=-1))
        for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(chunk)], strict=True):
            yield int(chunk[i]), batch.slice(i, j - i)


def _record(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


#: Kinds of step 1, in this order in a part: blocks, blocks that their own chunk has once more, probes.
BLOCKS, ANCHORS, OTHERS = 0, 1, 2
PROBES = [("part", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), ("hashes", pa.binary())]
HITS = [("chunk", pa.int64()), ("kind", pa.int32()), ("seq", pa.int64()), ("ids", pa.binary()), ("body", pa.binary())]
WINDOWS = [("part", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("at", pa.binary()), ("ids", pa.binary()), ("rows", pa.binary())]


def _schema(fields: list[tuple[str, pa.DataType]]) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{n} {names[t]}" for n, t in fields)


def _keys(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the 10-word windows of texts of WINDOW words or more, whether they are blocks, and their hashes."""
    sizes = np.diff(offsets)
    place = np.arange(len(words)) - np.repeat(offsets[:-1], sizes)
    size = np.repeat(sizes, sizes)
    use = np.flatnonzero((place + BLOCK <= size) & (size >= WINDOW))
    return use, place[use] % BLOCK == 0, mix64(rolled(words, FACTORS[0])[use])


def anchors_of(rows: DataFrame, parts: int) -> DataFrame:
    """Step 1: blocks and probes of every chunk, each hash once, packed by part."""

    def run(batches):
        for chunk, batch in _chunked(batches, 3):
            words, offsets = word_hashes(batch.column(2))
            if not len(words):
                continue
            _, block, key = _keys(words, offsets)
            hashes, inverse = np.unique(key, return_inverse=True)
            is_block = np.bincount(inverse, block, minlength=len(hashes)) > 0
            kind = np.where(is_block, np.where(np.bincount(inverse, minlength=len(hashes)) > 1, ANCHORS, BLOCKS), OTHERS)
            part = ((hashes >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
            low = (hashes & np.uint64(0xFFFFFFFF)).astype(np.int64)
            order = np.lexsort((low, kind, part))
            both = (part * 3 + kind)[order]
            cuts = np.flatnonzero(np.diff(both, prepend=-1))
            low = low[order]
            for at in range(0, len(cuts), 512):
                out = []
                for i, j in zip(cuts[at : at + 512].tolist(), [*cuts, len(low)][at + 1 : at + 513], strict=True):
                    out.append((int(both[i]) // 3, int(both[i]) % 3, chunk, packed_positions(low[i:j])))
                yield _record(out, PROBES)

    return rows.mapInArrow(run, _schema(PROBES))


def hits_of(probes: DataFrame) -> DataFrame:
    """Step 2: the hashes of anchors by chunk. Rows of a partition come by part, blocks before probes."""

    def run(batches):
        now = None
        blocks: list[tuple[int, np.ndarray, bool]] = []
        index = None

        def build():
            hashes = np.concatenate([b[1] for b in blocks]) if blocks else np.zeros(0, np.int64)
            sure = np.repeat([b[2] for b in blocks], [len(b[1]) for b in blocks]) if blocks else np.zeros(0, bool)
            distinct, group = np.unique(hashes, return_inverse=True)
            return distinct, (np.bincount(group, minlength=len(distinct)) > 1) | (np.bincount(group, sure, minlength=len(distinct)) > 0)

        def close():
            distinct, hit = index if index is not None else build()
            anchors = distinct[hit]
            out = []
            for chunk, own, _ in blocks:
                mine = own[hit[np.searchsorted(distinct, own)]] if len(anchors) else own[:0]
                if len(mine):
                    out.append((chunk, 0, 0, b"", packed_positions(mine)))
            return out

        for batch in batches:
            out = []
            for part, kind, chunk, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    if now is not None:
                        out += close()
                    now, blocks, index = part, [], None
                low = unpacked_positions(hashes)
                if kind != OTHERS:
                    blocks.append((chunk, low, kind == ANCHORS))
                    continue
                if index is None:
                    index = build()
                distinct, hit = index
                if not len(distinct):
                    continue
                found = np.minimum(np.searchsorted(distinct, low), len(distinct) - 1)
                met = distinct[found] == low
                if met.any():
                    hit[found[met]] = True
                    out.append((chunk, 0, 0, b"", packed_positions(low[met])))
            yield _record(out, HITS)
        if now is not None:
            yield _record(close(), HITS)

    return probes.mapInArrow(run, _schema(HITS))


def packed_texts(rows: DataFrame) -> DataFrame:
    """Texts (kind 1) of every chunk in order, compressed, with their doc_ids."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        now, seq = None, 0
        for chunk, batch in _chunked(batches, 3):
            if chunk != now:
                now, seq = chunk, 0
            texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            sizes = np.array([len(t) for t in texts], "<i8")
            known = np.array([x is not None for x in batch.column(1).to_pylist()], "<i8")
            ids = batch.column(1).fill_null(-(1 << 63)).to_numpy().astype("<i8")
            yield _record([(chunk, 1, seq, np.concatenate([ids, known, sizes]).tobytes(), squeeze.compress(b"".join(texts)))], HITS)
            seq += 1

    return rows.mapInArrow(run, _schema(HITS))


def _texts(ids: bytes, body: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """doc_ids, whether they are known, and the texts of a packed row."""
    numbers = np.frombuffer(ids, "<i8").reshape(3, -1)
    raw = zstandard.ZstdDecompressor().decompress(body, max_output_size=int(numbers[2].sum()) + 1) if numbers[2].sum() else b""
    offsets = np.concatenate([[0], np.cumsum(numbers[2])]).astype(np.int64)
    texts = pa.LargeStringArray.from_buffers(len(numbers[0]), pa.py_buffer(offsets), pa.py_buffer(raw)).cast(pa.string()) if len(raw) < (1 << 31) else None
    return numbers[0], numbers[1], texts


class _Marks:
    """Marked positions (or hashes) of one chunk, as the sorted parts come in."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.all: np.ndarray | None = None

    def add(self, raw: bytes) -> None:
        self.parts.append(unpacked_positions(raw))

    def _close(self) -> None:
        if self.all is None:
            self.all = np.sort(np.concatenate(self.parts)) if self.parts else np.zeros(0, np.int64)
            self.parts = []

    def hold(self, values: np.ndarray) -> np.ndarray:
        """Which of the values are marked."""
        self._close()
        if not len(self.all):
            return np.zeros(len(values), bool)
        return self.all[np.minimum(np.searchsorted(self.all, values), len(self.all) - 1)] == values

    def flags(self, base: int, n: int) -> np.ndarray:
        """Flags of positions base .. base + n - 1."""
        self._close()
        out = np.zeros(n, bool)
        i, j = np.searchsorted(self.all, [base, base + n])
        out[self.all[i:j] - base] = True
        return out


def windows_of(together: DataFrame, parts: int) -> DataFrame:
    """Step 3: hashes of the windows that hold an anchor; repeats within a chunk have a part below zero."""

    def run(batches):
        now, base, marks = None, 0, _Marks()
        for batch in batches:
            for chunk, kind, _, ids, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chunk != now:
                    now, base, marks = chunk, 0, _Marks()
                if kind == 0:
                    marks.add(body)
                    continue
                doc_ids, _, texts = _texts(ids, body)
                words, offsets = word_hashes(texts)
                flags = np.zeros(len(words), bool)
                use, _, key = _keys(words, offsets)
                # Parts are not told apart here: an anchor too many costs some windows and changes nothing.
                flags[use] = marks.hold((key & np.uint64(0xFFFFFFFF)).astype(np.int64))
                if flags.any():
                    sizes = np.diff(offsets)
                    owner = np.repeat(np.arange(len(sizes)), sizes)
                    place = np.arange(len(words)) - offsets[owner]
                    before = np.concatenate([[0], np.cumsum(flags)])
                    start = np.flatnonzero(place + WINDOW <= sizes[owner])
                    start = start[before[start + BLOCK + 1] > before[start]]
                    first, second = (rolled(words, f) for f in FACTORS)
                    one = mix64(mix64(first[start]) * FACTORS[1] + first[start + BLOCK])
                    two = (mix64(mix64(second[start]) * FACTORS[0] + second[start + BLOCK]) & np.uint64(0xFFFFFFFF)).astype("<u4")
                    # Equal windows here: the first by (doc_id, row, place) goes on.
                    order = np.lexsort((start, doc_ids[owner[start]], two, one))
                    new = np.ones(len(order), bool)
                    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
                    repeat = np.sort(start[order[~new]])
                    out = [(-1 - chunk % parts, chunk, b"", packed_positions(base + repeat), b"", b"")] if len(repeat) else []
                    on = np.sort(order[new])
                    part = (one[on] % np.uint64(parts)).astype(np.int32)
                    for p, own in _by_part(part):
                        k = on[own]
                        rows, runs = np.unique(owner[start[k]], return_counts=True)
                        out.append((p, chunk, one[k].tobytes() + two[k].tobytes(), packed_positions(base + start[k]), doc_ids[rows].tobytes(), runs.astype("<u4").tobytes()))
                        if len(out) >= 512:
                            yield _record(out, WINDOWS)
                            out = []
                    yield _record(out, WINDOWS)
                base += len(words)

    return together.mapInArrow(run, _schema(WINDOWS))


def repeats_of(windows: DataFrame) -> DataFrame:
    """Step 4: positions of repeats by chunk. Rows of a partition come by part."""

    def run(batches):
        now, held = None, []

        def close():
            if not held:
                return []
            sizes = [len(h[2]) for h in held]
            one, two, at, ids = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3, 4))
            chunk = np.repeat(np.array([h[0] for h in held], np.int64), sizes)
            # The chunk number grows with the row's place in the input, and the position within a chunk.
            order = np.lexsort((at, chunk, ids, two, one))
            same = np.zeros(len(order), bool)
            same[1:] = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
            mine = np.sort(order[same])
            source = np.repeat(np.arange(len(held)), sizes)[mine]
            return [(held[k][0], 0, 0, b"", packed_positions(at[mine[own]])) for k, own in _by_part(source)] if len(mine) else []

        for batch in batches:
            out = []
            for part, chunk, keys, at, ids, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part < 0:
                    out.append((chunk, 0, 0, b"", at))
                    continue
                if part != now:
                    out += close()
                    now, held = part, []
                n = len(keys) // 12
                held.append((chunk, np.frombuffer(keys[: 8 * n], "<u8"), np.frombuffer(keys[8 * n :], "<u4"), unpacked_positions(at), np.repeat(np.frombuffer(ids, "<i8"), np.frombuffer(rows, "<u4"))))
            yield _record(out, HITS)
        yield _record(close(), HITS)

    return windows.mapInArrow(run, _schema(HITS))


def removed_of(together: DataFrame, keep_text: bool) -> DataFrame:
    """Step 5: words that repeats cover leave their documents."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text

    def run(batches):
        now, base, marks = None, 0, _Marks()
        for batch in batches:
            for chunk, kind, _, ids, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chunk != now:
                    now, base, marks = chunk, 0, _Marks()
                if kind == 0:
                    marks.add(body)
                    continue
                doc_ids, known, texts = _texts(ids, body)
                words = [t.split() for t in texts.cast(pa.binary()).to_pylist()]
                sizes = np.fromiter(map(len, words), np.int64, len(words))
                flags = marks.flags(base, int(sizes.sum()))
                # A repeat at p covers p .. p + WINDOW - 1, all of one document.
                step = np.zeros(len(flags) + WINDOW + 1, np.int32)
                step[: len(flags)] += flags
                step[WINDOW : WINDOW + len(flags)] -= flags
                covered = np.cumsum(step)[: len(flags)] > 0
                ends = np.cumsum(sizes)
                out = []
                for k, own in enumerate(words):
                    gone = covered[ends[k] - sizes[k] : ends[k]]
                    lost = int(gone.sum())
                    kept = b" ".join([w for w, g in zip(own, gone.tolist(), strict=True) if not g] if lost else own)
                    out.append((int(doc_ids[k]) if known[k] else None, len(own), lost, hashlib.sha256(kept).hexdigest(), *([kept.decode()] if keep_text else [])))
                kinds = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept_text", pa.string())] * keep_text
                yield _record(out, kinds)
                base += len(flags)

    return together.mapInArrow(run, schema)


def _dealt(df: DataFrame, n: int, key: str, *order: str) -> DataFrame:
    return df.repartition(n, key).sortWithinPartitions(key, *order)


def substring_dedup(docs: DataFrame, keep_text: bool = False, stable: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) for every row of docs.

    stable: docs gives the same rows in the same order whenever it is read, as a table of files does.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not stable:
        docs = checkpointed(docs)
    n = tasks_for(docs)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    texts = packed_texts(rows)
    hits = hits_of(_dealt(anchors_of(rows, PARTS * n), n, "part", "kind"))
    windows = windows_of(_dealt(hits.unionByName(texts), n, "chunk", "kind", "seq"), PARTS * n)
    repeats = repeats_of(_dealt(windows, n, "part"))
    return removed_of(_dealt(repeats.unionByName(texts), n, "chunk", "kind", "seq"), keep_text)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_table(spark, sf_dir, "documents"), stable=True)
