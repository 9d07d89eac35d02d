"""Streams of documents through the batch plans: every operator up to verification works on single documents, so each
micro-batch is a batch of its own and needs neither state nor watermark. Only running coverage keeps state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexweave.common import scope


def stream_documents(documents: DataFrame, plan: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes ``plan`` of each micro-batch to Parquet under ``path``, one folder a batch; a batch that runs again after a
    failure replaces its folder, so no row comes twice. Tables that the plan needs on the way go with the batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        with scope():
            plan(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def rolling_coverage(matches: DataFrame, time: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window_start, total_items, processed_items): coverage counts by event time, for streams of match rows."""
    hit = F.count_if(F.col("status").isin("MATCHED", "NEAR_MATCH"))
    rows = matches.withWatermark(time, late).groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("total_items"), hit.alias("processed_items"))
    return rows.select(F.col("w.start").alias("window_start"), "total_items", "processed_items")
