"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every hash of a five-word shingle below a fixed fraction of the hash range, SHARE (1/4), the
same for every text, so that what two sketches share estimates what their texts share, however unequal they
are, and the sketch of a union is the union of the sketches. Beside them it keeps the LEAST smallest hashes
wherever they lie, also in every text, so that a short text's sketch is not left empty. A sketch thus knows
all hashes of its text up to its reach: to the threshold, or to the LEAST-th smallest hash where that lies
beyond, or all of them if there are fewer than LEAST. Two sketches are compared up to the smaller reach.

What that gives: between texts of fewer than LEAST shingles likeness is exact. A short text against a long
one is seen through its hashes below the threshold: one of n shingles has none with probability
(1 - SHARE)^n, 6 % at ten shingles and 1 % at sixteen, and then the answer is 0; in all other cases a text
that the other holds whole gets exactly 1. The standard error of a containment c is sqrt(c (1 - c) / (n SHARE)).

A fingerprint is the base64 of the sorted hashes as little-endian unsigned 32-bit integers. Equal texts have
equal fingerprints.

Defined results: null counts as empty; a text of fewer than five words has one shingle, all of it, and a
text without words none; likeness to a sketch without hashes is 1 if both have none, else 0; the next
document is the one with the next smaller doc_id, rows that repeat a doc_id are in order of a hash of the
text and of the text, null doc_ids come last, and the last document's next is the first; a single document is
its own next; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, read_table, slices, tasks_for, words_of

SHINGLE = 5
#: The fraction of all hashes that every sketch keeps, and the threshold for hashes of 32 bits.
SHARE = 0.25
LIMIT = int(SHARE * (1 << 32))
#: Smallest hashes that a sketch keeps whether they are below the threshold or not.
LEAST = 32
ALL = 1 << 32
#: Buckets for each task of the shuffle, so that tasks that get several of them are alike.
BUCKETS = 8
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of all shingles of the texts, repeats included, and the text that each is of."""
    codes, offsets, distinct = words_of(texts)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, distinct.to_pylist()), np.uint64, len(distinct))
    words = np.append(hashes[codes], np.zeros(SHINGLE, np.uint64))
    sizes = np.diff(offsets)
    rolled = np.zeros(len(codes), np.uint64)
    for k in range(SHINGLE):
        rolled = rolled * FACTOR + words[k : k + len(codes)]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(codes)) - offsets[owner]
    whole = place + SHINGLE <= sizes[owner]
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    extra = np.zeros(len(short), np.uint64)
    for k in range(SHINGLE - 1):
        there = sizes[short] > k
        extra[there] = extra[there] * FACTOR + words[offsets[short[there]] + k]
    extra += sizes[short].astype(np.uint64)
    both = mix64(np.concatenate([rolled[whole], extra])) >> np.uint64(32)
    return both, np.concatenate([owner[whole], short])


class Sketches:
    """Sketches of a list of texts: their sorted distinct hashes one after another."""

    def __init__(self, texts: pa.Array):
        hashes, owner = shingles(texts)
        both = np.unique((owner.astype(np.uint64) << np.uint64(32)) | hashes)
        own, low = (both >> np.uint64(32)).astype(np.int64), both & np.uint64(0xFFFFFFFF)
        begin = np.searchsorted(own, np.arange(len(texts)))
        keep = (low < LIMIT) | (np.arange(len(both)) - begin[own] < LEAST)
        self.hashes = low[keep].astype(np.uint32)
        self.at = np.searchsorted(own[keep], np.arange(len(texts) + 1))

    def of(self, k: int) -> np.ndarray:
        return self.hashes[self.at[k] : self.at[k + 1]]


def written(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u4").tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def reach(sketch: np.ndarray) -> int:
    """All hashes of the text below this are in the sketch."""
    if len(sketch) < LEAST:
        return ALL
    return max(LIMIT, int(sketch[-1]) + 1)


def _to(sketch: np.ndarray, limit: int) -> np.ndarray:
    return sketch if limit >= ALL else sketch[: np.searchsorted(sketch, limit)]


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of both texts' shingles."""
    both = np.union1d(a, b)
    return both[: max(LEAST, int(np.searchsorted(both, LIMIT)))]


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has; where nothing of a is below both reaches, 1 if both sketches are empty, else 0."""
    limit = min(reach(a), reach(b))
    x, y = _to(a, limit), _to(b, limit)
    if not len(x):
        return float(not len(a) and not len(b))
    return len(np.intersect1d(x, y, assume_unique=True)) / len(x)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The larger of both containments: how much of the smaller sketch the larger one holds."""
    limit = min(reach(a), reach(b))
    return containment(a, b) if len(_to(a, limit)) <= len(_to(b, limit)) else containment(b, a)


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, look, doc_id, text) that lie together, and in order, with the row that follows each.

    Buckets are ranges of doc_id, downwards; an id (or null) that holds more than one bucket's share of the rows
    has buckets by ranges of the text's hash. The first row of a bucket is also sent, as a look-ahead, to the end
    of the bucket before, so that no order over all rows is ever made in one task.
    """
    spark, n = docs.sparkSession, tasks_for(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), "text")
    m = BUCKETS * n
    quantiles = [int(x) for x in rows.stat.approxQuantile("doc_id", [k / m for k in range(1, m)], 0.2 / m)]
    bounds = sorted(set(quantiles))
    split = {b: quantiles.count(b) for b in bounds if quantiles.count(b) > 1}
    known, nulls = rows.agg(F.count("doc_id"), F.count(F.when(F.col("doc_id").isNull(), 1))).first()
    split[None] = max(1, round(m * nulls / max(1, known + nulls)))
    # Ids from bounds[k-1] on are in bucket len(bounds) - k; the number of a hash range comes below that. The
    # search is on doubles, where ids that are equal then share a bucket, and so are in order still.
    edges = [-float("inf"), *sorted({float(b) for b in bounds}), float("inf")]
    found = Bucketizer(splits=edges, inputCol="as_double", outputCol="place", handleInvalid="keep") if len(edges) > 2 else None
    placed = rows.withColumn("as_double", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("nan"))))
    placed = found.transform(placed) if found else placed.withColumn("place", F.lit(0.0))
    pieces = spark.createDataFrame([(b, k) for b, k in split.items()], "heavy long, pieces int")  # m rows at most
    placed = placed.join(F.broadcast(pieces), F.col("doc_id").eqNullSafe(F.col("heavy")), "left")
    part = F.when(F.col("pieces").isNull(), F.lit(0)).otherwise(1 + F.least(F.col("pieces") - 1, F.floor((F.col("hash") / 2.0**64 + 0.5) * F.col("pieces"))))
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(edges))).otherwise(len(edges) - 2 - F.col("place"))
    placed = placed.select((bucket.cast("long") * (1 << 20) + part).alias("bucket"), "doc_id", "hash", "text")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("down"), "hash"))
    heads = [(r["bucket"], *r["first"]) for r in placed.groupBy("bucket").agg(first.alias("first")).orderBy("bucket").collect()]  # about m rows
    ahead = spark.createDataFrame([(None if none else ~down, h, heads[k - 1][0]) for k, (_, none, down, h) in enumerate(heads)], "head long, first long, ahead long")
    same = F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("hash") == F.col("first"))
    looked = placed.join(F.broadcast(ahead), same, "left")
    own = F.struct(F.col("bucket"), F.lit(False).alias("look"))
    places = F.when(F.col("ahead").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("ahead").alias("bucket"), F.lit(True).alias("look"))))
    spread = looked.select(F.explode(places).alias("at"), "doc_id", "hash", "text").select("at.bucket", "at.look", "doc_id", "hash", "text")
    return spread.repartition(n, "bucket").sortWithinPartitions("bucket", "look", F.desc_nulls_last("doc_id"), "hash", "text").select("bucket", "look", "doc_id", "text")


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row."""

    def run(batches):
        held = None
        for batch in slices(batches, most=8 << 20):
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), [t or "" for t in batch.column(3).to_pylist()], strict=True))
            if held is not None:
                rows.insert(0, held)
            held = rows[-1]
            pairs = [k for k in range(len(rows) - 1) if not rows[k][1] and rows[k][0] == rows[k + 1][0]]
            texts = [r[3] for r in rows]
            edited = [texts[k][: len(texts[k]) - len(texts[k]) // 2] + texts[k + 1][: len(texts[k]) // 2] for k in pairs]
            plain, changed = Sketches(pa.array(texts, pa.string())), Sketches(pa.array(edited, pa.string()))
            out = []
            for n, k in enumerate(pairs):
                a, b, c = plain.of(k), changed.of(n), plain.of(k + 1)
                out.append((rows[k][2], len(texts[k]), hashlib.sha256(edited[n].encode()).hexdigest(), written(a), written(b), likeness(a, b), likeness(a, c)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(run, schema)


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(read_table(spark, sf_dir, "documents"))
