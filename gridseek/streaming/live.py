"""Queries that arrive as a stream against a feature table built once (extension of X21)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gridseek.operators.vectors import top_k


def answer_stream(queries: DataFrame, bank: DataFrame, k: int, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start a stream that gives every micro-batch of queries ``(query_id, feat)`` its ``k`` nearest bank rows.

    The bank is static; ``sink(result, batch_id)`` should be idempotent by batch, as batches may repeat.
    """

    def run(batch: DataFrame, number: int) -> None:
        sink(top_k(batch, bank, k), number)

    writer = queries.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
