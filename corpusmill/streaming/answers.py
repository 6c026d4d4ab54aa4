"""Answers to a stream of questions against a served index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def answer_stream(questions: DataFrame, respond: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Write ``respond(batch)`` of each micro-batch of questions ``(qid, query)`` to parquet files below ``path``.

    A batch is written under its own number, so one that runs again after a failure takes its own place.
    """

    def write(batch: DataFrame, number: int) -> None:
        respond(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return questions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
