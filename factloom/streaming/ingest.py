"""Append-only ingestion of observations with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.facts import validate_observations
from ..schemas import OBSERVATION


def observation_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet observations as they arrive in a folder, with their structural errors."""
    return validate_observations(spark.readStream.schema(OBSERVATION).parquet(folder), tolerate_predicate=True)


def ingest(stream: DataFrame, good: str, bad: str, checkpoint: str) -> StreamingQuery:
    """Well-formed rows to one table, others with their errors to another; every file once, also after a restart."""

    def write(batch: DataFrame, epoch: int) -> None:
        # a batch that is repeated replaces its own folder
        batch.where(F.size("errors") == 0).drop("errors").write.mode("overwrite").parquet(f"{good}/epoch={epoch}")
        batch.where(F.size("errors") > 0).write.mode("overwrite").parquet(f"{bad}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
