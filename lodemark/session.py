"""Session helpers: configuration for local runs and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What the engine expects of any session.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int = 8, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lodemark").config("spark.driver.memory", memory).config("spark.ui.enabled", "false")
    for k, v in CONF.items():
        builder = builder.config(k, v)
    return builder.config("spark.sql.shuffle.partitions", str(partitions or cores)).getOrCreate()


def _shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir (a folder of its own only in local mode)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lodemark-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, large_rows: bool = False) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, and the table's path, for discard() once nothing reads it any more.

    large_rows: of about a megabyte each. A reader holds a row group of few rows whole, and a writer looks at its size
    every hundred rows only, so that both would hold hundreds of megabytes a task.
    """
    path = f"{_shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    small = {"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 2, "parquet.block.size.row.check.max": 8, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false"}
    df.write.options(**(small if large_rows else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Removes a stored table."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
