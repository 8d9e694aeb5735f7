"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemark.llm import exact_dedup as exact
from lodemark.llm import packing, quality, secrets, simhash
from lodemark.llm.common import checkpointed, read_table, set_checkpoint_dir
from lodemark.session import discard


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.5) go.

    Null and empty texts get the score of a text without words; texts of any length are read whole; equal texts
    have equal scores; repeated rows stay or go together; other columns pass through as they are; an empty
    table gives no rows.
    """
    return quality.accepted(docs, quality.train(spark, sf_dir))


#: A number of its own for each row of a dedup stage's input.
ROW = "_lodemark_row"
#: Tables with that number that stages wrote; run() removes them when it has written what they were for.
_keyed_tables: list[str] = []


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with ROW, written to the shared checkpoint folder: a row has the same key whenever it is read."""
    set_checkpoint_dir(docs.sparkSession)
    path = f"{docs.sparkSession.sparkContext.getCheckpointDir()}/keyed-{uuid.uuid4().hex}"
    docs.withColumn(ROW, F.monotonically_increasing_id()).write.parquet(path)
    _keyed_tables.append(path)
    return docs.sparkSession.read.parquet(path)


def _only(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows whose ROW is in kept, without it."""
    return rows.join(kept, ROW, "left_semi").drop(ROW)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts (A-Z and a-z alike) one with the largest doc_id stays; null doc_ids are smaller than any other.

    Null and empty texts are one text; texts of any length are hashed whole; of several rows with the same text and
    doc_id one stays; other columns, whatever their names, stay with their row; an empty table gives no rows.
    """
    rows = _keyed(docs)
    return _only(rows, checkpointed(exact.exact_dedup(rows, ROW).where("kept").select(ROW)))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose fingerprints are connected one with the smallest doc_id stays; null doc_ids come last.

    Null, empty and blank texts have fingerprint zero and are linked like any other; texts of any length are read
    whole; of several rows with the same smallest doc_id the first stays; other columns stay with their row; an
    empty table gives no rows.
    """
    rows = _keyed(docs)
    return _only(rows, checkpointed(simhash.survivors(rows, ROW)))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret that the scan finds is replaced by a mark; all documents stay.

    Null texts stay null and empty ones empty; texts of any length are read whole; spans that overlap become one
    mark; repeated rows are treated alike; n_chars, if there, follows the text, other columns pass through; an
    empty table gives no rows.
    """
    return secrets.redact(docs, secrets.train(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids: one row a piece of a document.

    Null and empty texts are the end id alone; texts of any length are cut into pieces; repeated rows and ids, and
    missing ids, are packed each; other columns are ignored; an empty table gives no rows.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("secret_scan", secrets_stage),
    ("packing", packing_stage),
]

#: No SQL: the classifier, the fingerprints and the tokenizer are not expressible in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared checkpoint folder.

    A stage's table goes once the next one is written, and so do the tables that a stage wrote for itself; the one
    that the result is read from stays.
    """
    set_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = read_table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        known, path = len(_keyed_tables), f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        for done in [*_keyed_tables[known:], *([before] if before else [])]:
            discard(spark, done)
        del _keyed_tables[known:]
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
