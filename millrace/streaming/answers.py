"""Answering as streams: a cache of answers kept in state, and the newest index for what it lacks.

Requests and answers meet in keyed state (topic, selected sub-topics, bucket):
an answer is an entry of its group and leaves by an event-time timer when it is
over its age; a request reads the entries that are valid at its own time, so
results do not depend on when a timer fires. What is found, or not, goes to a
table of lookups. A second stream takes these, answers the rest from the newest
version of the index, and writes answers and new cache entries, which the first
stream reads in turn.

Entries of a group are dealt to `buckets`, so that a topic with many answers is many
tasks; a request goes to all of them and the best entry of any counts.

transformWithState needs the RocksDB state store: STATE is the setting.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from millrace.functions.models import hashed_embedding
from millrace.functions.text import row_id
from millrace.operators import chat
from millrace.operators.answering import SOURCES, answer_prepared, prepare_requests
from millrace.sources import index_store
from millrace.sources.staging import staged

STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
REQUEST = "qid long, query string, topic_id string, sub_topics array<string>, history array<struct<role:string,text:string>>, asked_at timestamp"
CACHED = f"cache_id string, topic_id string, sub_topics_key string, embedding array<double>, answer string, sources {SOURCES}, ts timestamp"
_PREPARED = "qid long, topic_id string, sub_topics array<string>, query string, has_config boolean, embedding array<double>, words array<string>, sub_topics_key string, asked_at timestamp"
_LOOKUP = "qid long, payload string, score double, answer string, sources string"


class AnswerCache(StatefulProcessor):
    """Entries of one group by id; rows of kind `put` add or renew them, rows of kind `get` are answered."""

    def __init__(self, max_age_ms: int, late_ms: int, min_score: float) -> None:
        self.max_age_ms, self.late_ms, self.min_score = max_age_ms, late_ms, min_score

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "cache_id string", "vector binary, answer string, sources string, ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        held = []
        for part in rows:
            for r in part[part["kind"] == "put"].itertuples():
                vector = np.asarray(r.embedding, float)
                size = np.linalg.norm(vector)
                if np.isfinite(size) and size > 0:
                    self.entries.updateValue((r.id,), ((vector / size).tobytes(), r.answer, r.sources, int(r.ms)))
                    # The watermark is late_ms behind the newest event, whose time is what the age counts from.
                    self.handle.registerTimer(int(r.ms) + self.max_age_ms - self.late_ms + 1)
            held.append(part[part["kind"] == "get"])
        asked = pd.concat(held)
        if asked.empty:
            return
        known = [(k[0], *v) for k, v in self.entries.iterator()]
        known.sort(key=lambda e: e[0])  # ties go to the smaller id
        out = []
        for r in asked.itertuples():
            best, score = None, self.min_score
            vector = np.asarray(r.embedding if r.embedding is not None else [], float)
            size = np.linalg.norm(vector)
            usable = [e for e in known if len(e[1]) == 8 * len(vector) and e[4] <= r.ms <= e[4] + self.max_age_ms]
            if usable and np.isfinite(size) and size > 0:
                scores = np.round(np.stack([np.frombuffer(e[1]) for e in usable]) @ (vector / size), 6)
                at = int(scores.argmax())
                best, score = (usable[at], float(scores[at])) if scores[at] >= score else (None, score)
            out.append((int(r.qid), r.payload, score if best else None, best[2] if best else None, best[3] if best else None))
        yield pd.DataFrame(out, columns=["qid", "payload", "score", "answer", "sources"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        for k in [k for k, v in self.entries.iterator() if v[3] + self.max_age_ms - self.late_ms < at]:
            self.entries.removeKey(k)
        return iter(())

    def close(self) -> None:
        pass


def _triggered(writer, once: bool):  # noqa: ANN001, ANN202
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")


def look_up(requests: DataFrame, cached: DataFrame, sub_topics: DataFrame, lookups: str, checkpoint: str, buckets: int = 8, max_age_ms: int = 86_400_000, min_score: float = 0.97, late_ms: int = 604_800_000, once: bool = True, embed_model: Callable[[list[str]], np.ndarray] = hashed_embedding) -> StreamingQuery:
    """Valid requests with the cached answer that is nearest, if one is near enough and valid, appended to lookups.

    requests are a stream of REQUEST, cached one of CACHED. Event time is
    asked_at and ts; a request sees entries that came in its batch or before.
    Requests more than late_ms behind the newest are dropped by Spark, which is
    why it is long: entries leave at their age all the same.
    """
    prepared = prepare_requests(requests, sub_topics, embed_model).select(*(c.split(" ")[0] for c in _PREPARED.split(", ")))
    none = F.lit(None).cast("string")
    gets = prepared.select("topic_id", "sub_topics_key", F.col("asked_at").alias("ts"), F.lit("get").alias("kind"), none.alias("id"), "qid", "embedding", F.to_json(F.struct(*prepared.columns)).alias("payload"), none.alias("answer"), none.alias("sources"), F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    puts = cached.where("topic_id is not null and sub_topics_key is not null and cache_id is not null and embedding is not null").select("topic_id", "sub_topics_key", "ts", F.lit("put").alias("kind"), F.col("cache_id").alias("id"), F.lit(None).cast("long").alias("qid"), "embedding", none.alias("payload"), "answer", F.to_json("sources").alias("sources"), F.pmod(F.xxhash64("cache_id"), F.lit(buckets)).cast("int").alias("bucket"))
    # The bucket is nullable by type in every batch's plan, also where one side is empty: the state's key may not change.
    events = gets.unionByName(puts).where("ts is not null").withColumns({"ms": F.unix_millis("ts"), "bucket": F.nullif("bucket", F.lit(-1))}).withWatermark("ts", f"{late_ms} milliseconds")
    out = events.groupBy("topic_id", "sub_topics_key", "bucket").transformWithStateInPandas(AnswerCache(max_age_ms, late_ms, min_score), _LOOKUP, "Append", "EventTime")
    return _triggered(out.writeStream.format("parquet").option("path", lookups).option("checkpointLocation", checkpoint).outputMode("append"), once).start()


def _write_once(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Written unless a run before has done so: readers of the folder never lose a file."""
    if not index_store.complete(spark, path):
        rows.write.mode("overwrite").parquet(path)


def answer_lookups(spark: SparkSession, lookups: str, index: str, answers: str, cache: str, checkpoint: str, once: bool = True, **models) -> StreamingQuery:
    """Lookups to answers/batch=N, and what is worth keeping to cache/batch=N.

    Each batch reads the index version that is newest when it begins. models
    are the hooks of answer_prepared.
    """

    def handle(batch: DataFrame, number: int) -> None:
        best = batch.groupBy("qid", "payload").agg(F.max(F.when(F.col("answer").isNotNull(), F.struct("score", "answer", "sources"))).alias("hit"))
        found = staged(best.select(F.from_json("payload", _PREPARED).alias("asked"), "hit"), "lookups")
        asked = found.select("asked.*")
        hits = found.where("hit is not null").select("asked.qid", F.col("hit.answer").alias("cached_answer"), F.from_json("hit.sources", SOURCES).alias("cached_sources"))
        with index_store.pinned(spark, index) as version:
            chunks, parents, *posted = (index_store.read_table(spark, index, name, version) for name in ("chunks", "parents", "postings", "terms"))
            out = staged(answer_prepared(asked, hits, chunks, parents, posted=tuple(posted), **models), "answered").withColumn("index_version", F.lit(version).cast("long"))
        new = chat.cacheable(out.where("status = 'success' and not cached")).join(asked.select("qid", "sub_topics_key", "embedding", "asked_at"), "qid")
        entries = new.select(row_id(F.lit(checkpoint), F.lit(number), F.col("qid")).alias("cache_id"), "topic_id", "sub_topics_key", "embedding", "answer", "sources", F.col("asked_at").alias("ts"))
        _write_once(spark, entries, f"{cache}/batch={number}")
        _write_once(spark, out, f"{answers}/batch={number}")

    stream = spark.readStream.schema(_LOOKUP).parquet(lookups)
    return _triggered(stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle), once).start()


def cached_stream(spark: SparkSession, cache: str) -> DataFrame:
    """The entries that answer_lookups writes, as a stream."""
    return spark.readStream.schema(CACHED).option("recursiveFileLookup", True).parquet(cache)
