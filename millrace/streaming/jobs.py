"""Streams: answering, expiry of the answer cache, filtered appends.

Each runs over all that is there and ends (trigger availableNow); the checkpoint
remembers what has been done, so a rerun goes on from there, and a batch that is
run again gives the same rows in the same place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.chat import feedback_rows, severe_logs
from millrace.sources import corpus


def each_batch(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start()


def append_stream(stream: DataFrame, keep: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    return keep(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def json_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def answer_stream(requests: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Requests answered against the tables that `answer` holds, a folder of rows for each batch."""
    return each_batch(requests, checkpoint, lambda batch, number: answer(batch).write.mode("overwrite").parquet(f"{path}/batch={number}"))


def feedback_stream(spark: SparkSession, source: str, path: str, checkpoint: str) -> StreamingQuery:
    """Valid feedback requests appended as feedback rows."""
    return append_stream(json_stream(spark, source, corpus.FEEDBACK), feedback_rows, path, checkpoint)


def log_stream(logs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Log rows of level WARNING and above, appended."""
    return append_stream(logs, severe_logs, path, checkpoint)


def expired_answers(cache: DataFrame, max_age_ms: int = 86_400_000) -> DataFrame:
    """cache_id, written of entries (cache_id, ts timestamp) older than max_age_ms by event time, once each.

    State is one timestamp an entry; a later entry of the same id renews it.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            written = state.get[0]
            state.remove()
            yield pd.DataFrame({"cache_id": [key[0]], "written": [pd.Timestamp(written, unit="ms")]})
            return
        newest = max(int(p["ms"].max()) for p in parts)
        if state.exists:
            newest = max(newest, state.get[0])
        state.update((newest,))
        state.setTimeoutTimestamp(max(newest + max_age_ms, state.getCurrentWatermarkMs() + 1))

    rows = cache.withWatermark("ts", "0 seconds").select("cache_id", "ts", (F.unix_millis("ts")).alias("ms"))
    return rows.groupBy("cache_id").applyInPandasWithState(step, "cache_id string, written timestamp", "newest long", "append", GroupStateTimeout.EventTimeTimeout)
