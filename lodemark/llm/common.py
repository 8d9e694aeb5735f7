"""Helpers that the training-data operators share.

Text reaches Python as Arrow record batches and leaves the same way; every helper here works on
whole texts and holds one bounded slice of a batch at a time.
"""

from __future__ import annotations

import builtins
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one Python step holds at once (a single longer text is a slice of its own).
SLICE_BYTES = 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_model(spark: SparkSession, model):
    """A function that gives the model on a worker. It travels by value, class and all."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    return lambda: pickle.loads(sent.value)  # noqa: S301  made three lines above


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo: the fold that decides what may be learned from."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus, F.lit(0)).cast("int")


def set_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the cluster's shared folder; sets one only where none is configured (local tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if shared:
            context.setCheckpointDir(shared)
        elif context.master.startswith("local[") or context.master == "local":
            import tempfile

            context.setCheckpointDir(tempfile.mkdtemp(prefix="lodemark-checkpoint-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and read back, so that its lineage ends."""
    set_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks_for(df: DataFrame) -> int:
    """Tasks for a shuffle of df: the session's number, or as many as read df where that is more, so that
    what a task gets does not grow with the input."""
    return max(partitions_for(df.sparkSession), df.rdd.getNumPartitions())


#: A key is hot if it has this share of the rows or more: 1/HOT keys at most.
HOT = 1 / 1000


def join_by_key(rows: DataFrame, names: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows joined with names on key. names: one row a key, and in size how many of the `total` rows have it.

    The names of hot keys, 1/HOT at most, are broadcast, so that their rows stay where they are; the rest shuffle.
    """
    least = max(64, int(total * HOT))
    hot = names.where(F.col(size) >= least)
    few = rows.join(F.broadcast(hot), key)
    many = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(names.where(F.col(size) < least), key)
    return few.unionByName(many)


class Numbered:
    """Distinct strings by number, in order of arrival, as one Arrow array."""

    def __init__(self):
        self.known = pa.array([], pa.string())

    def __len__(self) -> int:
        return len(self.known)

    def find(self, strings: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """The number of each string; the unknown ones, given once each, count on from the known ones."""
        at = pc.index_in(strings, value_set=self.known)
        new = pc.is_null(at)
        coded = strings.filter(new).dictionary_encode()
        which = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        which[new.to_numpy(zero_copy_only=False)] = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + len(self.known)
        return which, coded.dictionary

    def add(self, strings: pa.Array) -> None:
        self.known = pa.concat_arrays([self.known, strings])


def kept_by_worker(key: tuple, make):
    """What make() gives, once per Python worker: workers live on from task to task.

    For memos only: results must not depend on what is in it.
    """
    kept = builtins.__dict__.setdefault("_lodemark_kept", {})
    if key not in kept:
        kept.clear()
        kept[key] = make()
    return kept[key]


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in order, cut so that each holds at most `most` text bytes or a single row.

    What Arrow's pool keeps of a slice goes back to the system before the next batch and at the end.
    """
    for batch in batches:
        pa.default_memory_pool().release_unused()
        if batch.num_rows == 0:
            continue
        column = batch.column(text)
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Whole texts; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Whitespace words of each text: codes, offsets (one more than texts), distinct words.

    Null texts have no words. Empty pieces that the splitter makes at the ends are dropped.
    """
    column = pc.fill_null(column, "")
    lists = pc.ascii_split_whitespace(column)
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = coded.dictionary
    empty = pc.index(distinct, pa.scalar("", distinct.type)).as_py()
    if empty >= 0:
        keep = codes != empty
        kept_before = np.concatenate([[0], np.cumsum(keep)])
        offsets = kept_before[offsets]
        codes = codes[keep]
    return codes, offsets, distinct


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i+1]]; an empty segment sums to zero."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), dtype=values.dtype)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0)
    return out


def ragged_take(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges starts[i] .. starts[i]+lengths[i]-1."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return shift + np.arange(total, dtype=np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def labelled_sample(spark: SparkSession, sf_dir: str, label: str, modulus: int, held: int, most: int):
    """(texts, labels) of about `most` labelled rows outside the held-out fold, or of all if fewer.

    The sample is by a hash of doc_id, and an id that repeats has one text (the least), so its size is bounded
    whatever the input; nulls and repeated labels of one document are dropped.
    """
    labels = (
        read_table(spark, sf_dir, "labels")
        .select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (id_remainder("doc_id", modulus) != held))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    total = labels.count()
    kept = labels
    if total > most:
        kept = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * most / total))
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text").where(F.col("text").isNotNull())
    # kept has about `most` ids, a fixed bound, so that the texts need no shuffle
    table = documents.join(F.broadcast(kept), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).toArrow()
    order = np.argsort(table["doc_id"].to_numpy(), kind="stable")
    table = table.take(pa.array(order))
    return table["text"].combine_chunks(), table["y"].to_numpy().astype(np.int64)
