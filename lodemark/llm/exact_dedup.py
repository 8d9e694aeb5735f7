"""Exact dedup by a heavy-hitter split.

Misra-Gries summaries of each partition find the digests that can be frequent. Their winners are then
counted exactly (that verifies them), and the at most HEAVY verified rows are broadcast, so that rows of
hot digests never shuffle. The remaining digests take an ordinary shuffle.

Defined results: null text counts as the empty text; a null doc_id is smaller than any other; rows that
repeat a doc_id count separately and the largest doc_id of a group is its keep_id, and of several rows
with that doc_id and text exactly one is `kept`; other columns of the input are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, read_table

#: Counters of a Misra-Gries summary: no digest of more than a 1/(COUNTERS+1) share of a task's rows is missed.
COUNTERS = 1024
#: A digest is heavy from this share of all rows, which is more than that: it keeps a counter in some task at least.
SHARE = 1 / 1000
#: The most digests that are ever broadcast; 1/SHARE can be heavy.
HEAVY = 1024

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(text: Column) -> Column:
    """The text with A-Z in lower case and all else as it is; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    # Of a text of single bytes lower() changes A-Z only, and is quicker.
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def digest_rows(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, digest (SHA-256 of the lowered text) and row: the column key (a long), or else a number of its own."""
    row = F.col(key) if key else F.monotonically_increasing_id()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(lowered(F.col("text")), 256)).alias("digest"), row.alias("row"))


def merge_summaries(summary: dict, other: dict, counters: int = COUNTERS) -> dict:
    """Adds the counts and subtracts the (counters+1)-th largest from all: the Misra-Gries merge.

    Whatever has more than a 1/(counters+1) share of all that was merged is in the result.
    """
    total = Counter(summary)
    total.update(other)
    if len(total) <= counters:
        return dict(total)
    cut = sorted(total.values(), reverse=True)[counters]
    return {k: v - cut for k, v in total.items() if v > cut}


def frequent_digests(rows: DataFrame) -> DataFrame:
    """Digests of at least SHARE of the rows (and 64), each with its verified winner and count (HEAVY rows at most)."""

    def run(batches):
        # A batch is counted in full and then merged; the summary keeps COUNTERS entries, those of 1 as well: a
        # digest may be heavy over all tasks and yet occur once in each.
        summary: dict = {}
        for batch in batches:
            summary = merge_summaries(summary, Counter(batch.column(0).to_pylist()))
        kept = list(summary.items())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.binary()), pa.array([v for _, v in kept], pa.int64())], ["digest", "low"])

    total = rows.count()
    least = max(64, int(total * SHARE))
    found = (
        rows.select("digest").mapInArrow(run, "digest binary, low long")
        .groupBy("digest").agg(F.sum("low").alias("low"))
        .orderBy(F.desc("low"), "digest").limit(HEAVY).select("digest")
    )
    # HEAVY rows at most, a proven bound
    return (
        rows.join(F.broadcast(found), "digest")
        .groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") >= least)
        .select("digest", F.col("top.doc_id").alias("keep_id"), F.col("top.row").alias("keep_row"), "group_size")
    )


def exact_dedup(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs, and its column key if one is named."""
    rows = checkpointed(digest_rows(docs, key))
    heavy = checkpointed(frequent_digests(rows))
    marked = rows.join(F.broadcast(heavy), "digest", "left")  # bounded by HEAVY
    hot = marked.where(F.col("group_size").isNotNull())
    # The same left-out test on the other side: no digest is lost and none is in both.
    cold = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    group = Window.partitionBy("digest")
    cold = cold.withColumns({"top": F.max(F.struct("doc_id", "row")).over(group), "group_size": F.count(F.lit(1)).over(group)}).select(
        "digest", "doc_id", "row", F.col("top.doc_id").alias("keep_id"), F.col("top.row").alias("keep_row"), "group_size"
    )
    return hot.unionByName(cold).select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), *([F.col("row").alias(key)] if key else []))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


OP8_SQL = f"""
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM t
"""
