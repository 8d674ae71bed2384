"""Readers and append sinks, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.exprs import or_else


def read_raw_logs(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """JSON lines kept as text in ``raw``: the schema is open and a broken line must still reach quarantine."""
    reader = spark.readStream if streaming else spark.read
    return reader.format("text").load(path).select(
        F.col("value").alias("raw"), F.col("_metadata.file_name").alias("file_name")
    )


def tail_text_logs(spark: SparkSession, path: str, streaming: bool = False, modified_after: str | None = None):
    """Access or error log lines. Rotate finished files into the folder; the stream's checkpoint remembers which were read."""
    reader = (spark.readStream if streaming else spark.read).format("text")
    if modified_after and not streaming:
        reader = reader.option("modifiedAfter", modified_after)
    lines = reader.load(path).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("file_name"))
    return with_line_kind(lines)


def with_line_kind(lines: DataFrame) -> DataFrame:
    """Drop blank lines and take the kind (access or error) from the file name."""
    kind = F.when(F.lower("file_name").contains("error"), "error").otherwise("access")
    return lines.where(F.length(F.trim("line")) > 0).withColumn("kind", kind)


def read_logs(stored: DataFrame) -> DataFrame:
    """Stored history with defaults for missing text; metadata text that is not an object becomes an empty map."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return stored.withColumns(
        {
            "metadata": F.coalesce(F.from_json("metadata", "map<string,string>"), empty),
            "record_number": F.col("record_number").try_cast("bigint"),
            "source": or_else(F.col("source"), F.lit("unknown")),
            "event_type": or_else(F.col("event_type"), F.lit("unknown")),
            "message": F.coalesce("message", F.lit("")),
            "severity": or_else(F.col("severity"), F.lit("info")),
        }
    )


def write_events(df: DataFrame, path: str, day_of: str) -> None:
    """Append, partitioned by UTC day. Rows of a day meet before they are written, so a day has few files; a busy day's rows
    are split over as many tasks as its size asks for."""
    day = F.date_format(F.timestamp_micros(day_of), "yyyy-MM-dd")
    df.withColumn("day", day).hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)


def watermark(df: DataFrame, id_col: str, last_id: int, on_reset: str = "current") -> DataFrame:
    """One row: the id to continue from. A maximum below ``last_id`` means the source was cleared."""
    top = F.coalesce(F.max(id_col), F.lit(0)).cast("bigint")
    after_reset = top if on_reset == "current" else F.lit(0).cast("bigint")
    return df.agg(
        top.alias("max_id"), F.when(top < last_id, after_reset).otherwise(F.lit(last_id)).alias("continue_from")
    )
