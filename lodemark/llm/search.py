"""Ranked lexical search by sort-based accumulation.

Two passes over the documents: one counts documents, terms and document frequencies of the items' terms, one scores. A
task looks the terms of a slice of documents up in the items' vocabulary and concatenates arrays of (item, document,
impact); packed keys are radix-sorted, np.add.reduceat sums the impacts of each pair, and a heap of an item's best
documents runs through the task. What the tasks found is dealt out by ranges of items, where heaps select again. All
arithmetic but the term weight is in 64-bit integers. Items are searched in blocks of bounded size, each against all
documents, so that what is broadcast does not grow with their number.

Defined results: null and empty texts have no terms; such documents count nowhere and such items find nothing; texts of
any length are read whole; rows of items that repeat item_id and text are one item, other rows with the same id are
ranked each for itself; repeated documents are ranked each, equal scores by doc_id, null last; other columns are
ignored; empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_model, checkpointed, ragged_take, read_table, slices, tasks_for, words_of

BEST = 20
#: Items, and bytes of their texts, that are searched at once.
BLOCK_ITEMS, BLOCK_BYTES = 10_000, 16 << 20
#: (item, document, impact) entries that are sorted at once.
ENTRIES = 2 << 20

# Bytes that are no part of a term become spaces, A-Z become a-z; bytes of other characters than ASCII stay.
BYTES = np.array([b + 32 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else b if b > 127 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The terms of each text: codes, offsets (one more than texts), distinct terms."""
    column = pa.concat_arrays([pc.fill_null(column, "").cast(pa.string())])
    if not len(column):
        return np.zeros(0, np.int64), np.zeros(1, np.int64), pa.array([], pa.string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return words_of(pa.StringArray.from_buffers(len(column), pa.py_buffer(at - at[0]), pa.py_buffer(BYTES[raw])))


class Items:
    """A block of items: the vocabulary, and for each term the items that hold it and how often."""

    def __init__(self, ids: list, texts: pa.Array):
        codes, offsets, self.terms = terms_of(texts)
        self.ids = ids
        pairs, self.times = np.unique(codes * len(ids) + np.repeat(np.arange(len(ids)), np.diff(offsets)), return_counts=True)
        self.item = pairs % max(len(ids), 1)
        self.at = np.searchsorted(pairs // max(len(ids), 1), np.arange(len(self.terms) + 1))
        self.weights = np.zeros(len(self.terms), np.int64)

    def found(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms of each text, all of them; then for every text and term of the block in it: text, term, occurrences, by text and term."""
        codes, offsets, distinct = terms_of(texts)
        lengths = np.diff(offsets)
        term = pc.fill_null(pc.index_in(distinct, value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
        text = np.repeat(np.arange(len(texts)), lengths)[term >= 0]
        pairs, times = np.unique(text * len(self.terms) + term[term >= 0], return_counts=True)
        return lengths, pairs // max(len(self.terms), 1), pairs % max(len(self.terms), 1), times


def radix_order(keys: np.ndarray) -> np.ndarray:
    """A stable order of keys (0 or more), 16 bits at a time from the lowest; digits in order already take no pass."""
    order = None
    for shift in range(0, max(int(keys.max(initial=0)).bit_length(), 1), 16):
        digit = ((keys if order is None else keys[order]) >> shift).astype(np.uint16)
        if (digit[1:] >= digit[:-1]).all():
            continue
        step = np.argsort(digit, kind="stable")  # numpy sorts 16-bit integers by radix
        order = step if order is None else order[step]
    return np.arange(len(keys)) if order is None else order


def pair_scores(items: Items, text: np.ndarray, term: np.ndarray, impact: np.ndarray):
    """Sums of impacts: yields (item, text, score), by item and text, for some texts after the other."""
    fan = items.at[term + 1] - items.at[term]
    ends = np.cumsum(fan)
    start = 0
    while start < len(term):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + ENTRIES, side="right"))
        if stop < len(term):  # whole texts only; one text has no more entries than the block of items
            stop = int(np.searchsorted(text, text[stop], side="left"))
        if stop <= start:
            stop = int(np.searchsorted(text, text[start], side="right"))
        here = slice(start, stop)
        entry = ragged_take(items.at[term[here]], fan[here])
        bits = max(1, int(text[stop - 1] - text[start]).bit_length())
        keys = (items.item[entry] << bits) | np.repeat(text[here] - text[start], fan[here])
        worth = np.repeat(impact[here], fan[here]) * items.times[entry]
        order = radix_order(keys)
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        yield keys[first] >> bits, (keys[first] & ((1 << bits) - 1)) + text[start], np.add.reduceat(worth[order], first)
        start = stop


class Best:
    """For each item a heap of its best documents so far; the worst of them is on top."""

    def __init__(self, most: int):
        self.most = most
        self.heaps: dict[int, list[tuple[int, bool, int]]] = {}

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        heap = self.heaps.setdefault(item, [])
        least = heap[0][0] if len(heap) == self.most else 1
        if len(scores) > self.most:
            least = max(least, int(np.partition(scores, len(scores) - self.most)[len(scores) - self.most]))
        for k in np.flatnonzero(scores >= least).tolist():
            entry = (int(scores[k]), bool(known[k]), -int(ids[k]))
            if len(heap) < self.most:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)

    def batch(self, ranked: bool = False) -> pa.RecordBatch:
        items, ranks, docs, scores = [], [], [], []
        for item, heap in self.heaps.items():
            for rank, (score, known, negative) in enumerate(sorted(heap, reverse=True), 1):
                items.append(item)
                ranks.append(rank)
                docs.append(-negative if known else None)
                scores.append(score)
        columns = [pa.array(items, pa.int64()), pa.array(ranks, pa.int32()), pa.array(docs, pa.int64()), pa.array(scores, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["item", "rank", "doc_id", "score"])


def _add_all(best: Best, item: np.ndarray, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
    """Rows in order of item."""
    edge = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1], [True]])) if len(item) else np.zeros(1, np.int64)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        best.add(int(item[a]), score[a:b], ids[a:b], known[a:b])


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False), pc.is_valid(column).to_numpy(zero_copy_only=False)


def statistics(docs: DataFrame, items: Items) -> tuple[int, int, np.ndarray]:
    """N, L and the document frequency of each term of the items."""
    shared = broadcast_model(docs.sparkSession, items)  # bounded by BLOCK_ITEMS and BLOCK_BYTES

    def run(batches):
        own = shared()
        frequency, n, total = np.zeros(len(own.terms), np.int64), 0, 0
        for batch in slices(batches):
            lengths, _, term, _ = own.found(batch.column("text"))
            frequency += np.bincount(term, minlength=len(frequency))
            n, total = n + int((lengths > 0).sum()), total + int(lengths.sum())
        held = np.flatnonzero(frequency)
        what, count = np.concatenate([held, [-1, -2]]), np.concatenate([frequency[held], [n, total]])
        yield pa.RecordBatch.from_arrays([pa.array(what, pa.int64()), pa.array(count, pa.int64())], ["what", "count"])

    counted = docs.select("text").mapInArrow(run, "what long, count long").groupBy("what").agg(F.sum("count").alias("count"))
    found = {r["what"]: r["count"] for r in counted.toLocalIterator()}  # one row a term of the block
    return found.get(-1, 0), found.get(-2, 0), np.array([found.get(k, 0) for k in range(len(items.terms))], np.int64)


def weigh(n: int, frequency: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) if df else 0 for df in frequency.tolist()], np.int64)


def impacts(weight: np.ndarray, times: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """What an occurrence of a term in an item adds to the score of a document with `length` terms."""
    norm = 75 + (25 * length.astype(np.int64) * n) // total
    return weight * ((1_000_000_000 * times.astype(np.int64)) // (1000 * times.astype(np.int64) + 12 * norm))


def _search_block(docs: DataFrame, items: Items, most: int) -> DataFrame:
    n, total, frequency = statistics(docs, items)
    items.weights = weigh(n, frequency)
    shared = broadcast_model(docs.sparkSession, (items, n, total))

    def run(batches):
        own, n, total = shared()
        best = Best(most)
        for batch in slices(batches):
            ids, known = _ids(batch.column("doc_id"))
            lengths, text, term, times = own.found(batch.column("text"))
            if not len(text):
                continue
            impact = impacts(own.weights[term], times, lengths[text], n, total)
            for item, place, score in pair_scores(own, text, term, impact):
                _add_all(best, item, score, ids[place], known[place])
        yield best.batch()

    def select(batches):
        best = Best(most)
        for batch in batches:
            item = batch.column("item").to_numpy()
            order = np.argsort(item, kind="stable")
            ids, known = _ids(batch.column("doc_id"))
            _add_all(best, item[order], batch.column("score").to_numpy()[order], ids[order], known[order])
        yield best.batch()

    schema = "item long, rank int, doc_id long, score long"
    found = checkpointed(docs.mapInArrow(run, schema))  # ranges are taken from a sample, which would score twice
    ranked = found.repartitionByRange(tasks_for(found), "item").mapInArrow(select, schema)
    names = docs.sparkSession.createDataFrame(pa.table({"item": pa.array(range(len(items.ids)), pa.int64()), "item_id": pa.array(items.ids, pa.int64())}))
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # at most BLOCK_ITEMS names


def search(docs: DataFrame, items: DataFrame, most: int = BEST) -> DataFrame:
    """The `most` best documents of every item: item_id, rank, doc_id, score."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    size = items.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    blocks = max(1, math.ceil(size["n"] / BLOCK_ITEMS), math.ceil((size["b"] or 0) / BLOCK_BYTES))
    results = []
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow()
        own = Items(block["item_id"].to_pylist(), pa.concat_arrays([pa.array([], pa.string()), *[c.cast(pa.string()) for c in block["text"].chunks]]))
        if len(own.terms):
            results.append(_search_block(docs, own, most))
    if not results:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    while len(results) > 1:  # a balanced tree of unions
        results = [a.unionByName(b[0]) if b else a for a, *b in (results[i : i + 2] for i in range(0, len(results), 2))]
    return results[0]


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_TERM = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11_SQL = f"""
WITH doc_lists AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS terms FROM documents),
item_terms AS (
    SELECT item_id, term, count(*) AS times
    FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM benchmark) GROUP BY item_id, term
),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM doc_lists WHERE len(terms) > 0),
postings AS (
    SELECT doc_id, term, count(*) AS tf, any_value(n) AS n
    FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM doc_lists)
    WHERE term IN (SELECT term FROM item_terms) GROUP BY doc_id, term
),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
    FROM postings, totals GROUP BY term, n_docs
),
impacts AS (
    SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) AS impact
    FROM postings JOIN weights USING (term), totals
),
scores AS (
    SELECT item_id, doc_id, CAST(sum(times * impact) AS BIGINT) AS score
    FROM impacts JOIN item_terms USING (term) GROUP BY item_id, doc_id
),
ranked AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {BEST}
"""
