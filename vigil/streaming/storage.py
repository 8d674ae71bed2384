"""Tables between steps and micro-batches, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it; without a setting one in the warehouse, which is shared too."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_steps"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One folder per micro-batch: a batch that is run again after a failure replaces its own output."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def read_batch(spark: SparkSession, path: str, schema, batch_id: int) -> DataFrame:
    """One batch's folder; nothing when the batch was never written."""
    folder = f"{path}/batch={batch_id}"
    return read_batches(spark, path, schema, [batch_id]) if _exists(spark, folder) else spark.createDataFrame([], schema)


def read_batches(spark: SparkSession, path: str, schema, batch_ids: list[int]) -> DataFrame:
    """Several batches that were written, in one scan."""
    return spark.read.schema(schema).parquet(*[f"{path}/batch={i}" for i in batch_ids])


def _exists(spark: SparkSession, folder: str) -> bool:
    try:
        spark.read.schema("x int").parquet(folder)
    except Exception as exc:
        if "PATH_NOT_FOUND" in str(exc):
            return False
        raise
    return True


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """The same rows read back from a table in the shared folder: later steps start from there, also after a loss."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
