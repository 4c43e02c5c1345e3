"""Streaming forms: row-local operators run unchanged, keyed results are written once per key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions import rules


def decide(requests: DataFrame, slots: list[str]) -> DataFrame:
    """Guard decisions of a stream (or table) of requests."""
    return requests.withColumn("decision", rules.guard_input([F.col(s) for s in slots]))


def upsert(stream: DataFrame, path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """SNK-02, JOI-10: appends what is not there yet, batch by batch; a replayed batch adds nothing."""
    from corpusloom.sources.writers import append_new

    return stream.writeStream.foreachBatch(lambda df, _id: append_new(df, path, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_available(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """SRC-03: all files there are, then stop."""
    return transform(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_per_key(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """DED-07 on a stream: one row a key within the watermark (an extension: the state is bounded by delay)."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
