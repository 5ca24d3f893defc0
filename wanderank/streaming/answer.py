"""A stream of sources answered micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import PprEngine


def answer_stream(engine: PprEngine, sources: DataFrame, k: int, out: str, checkpoint: str, algorithm: str = "push_walk") -> StreamingQuery:
    """Top-k lists of the streamed (source) rows, as Parquet below ``out``, one folder per batch, so that a retried batch replaces itself."""

    def answer(batch: DataFrame, batch_id: int) -> None:
        asked = batch.select(F.col("source").cast("bigint").alias("source")).distinct()
        engine.topk(asked, k, algorithm).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return sources.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
