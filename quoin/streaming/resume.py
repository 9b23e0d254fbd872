"""Resumable inference as a stream: new item files are scored once, whatever is replayed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def score_stream(spark: SparkSession, items: str, schema: str, out: str, checkpoint: str, score: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Scores JSON-line items as their files arrive and appends to ``out``; an id already there is left alone, so a
    batch that is replayed after a failure adds nothing twice."""

    def append(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates(["id"])
        try:
            done = spark.read.parquet(out).select("id")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        else:
            new = new.join(done, "id", "left_anti")
        score(new).write.mode("append").parquet(out)

    stream = spark.readStream.schema(schema).json(items)
    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
