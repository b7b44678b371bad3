"""Shared folder for intermediate tables: a written table ends the lineage and outlives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch: texts are long, and a Python worker holds a batch and what it makes of it.
BATCH_ROWS = 256


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows in this session, for operators that pass whole texts.

    Spark reads the setting when a query starts, after the operator has
    returned its DataFrame, so it stays set; a smaller one is left alone.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``; where it is unset, a temporary one on a single machine (tests) and an error on a cluster."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df``, written to the shared folder and read back: the lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
