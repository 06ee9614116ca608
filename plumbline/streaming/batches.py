"""Requests as a stream: each micro-batch runs the batch plan and appends its responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from plumbline.plans.pipeline import Analysis
from plumbline.sources import candidates


def respond(requests: DataFrame, now_year: int) -> DataFrame:
    """Responses of a bounded table of requests, without the texts of nodes."""
    return Analysis(candidates.corpus(requests, now_year)).responses


def start(spark: SparkSession, path: str, out: str, checkpoint: str, now_year: int) -> StreamingQuery:
    """Runs over the JSON request files that arrive in path; a batch writes a folder of its
    own, so that one that is run again after a failure replaces what it wrote."""
    def write(batch: DataFrame, number: int) -> None:
        respond(batch, now_year).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{out}/batch={number}")

    stream = spark.readStream.schema(candidates.REQUEST).json(path)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
