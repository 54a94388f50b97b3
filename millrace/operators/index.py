"""Upkeep of the index: replacement, renames, inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SOURCE = ["source", "topic_id", "sub_topic_id"]


def replace_sources(old: DataFrame, new: DataFrame, done: DataFrame) -> DataFrame:
    """Old rows of sources that are not done, and the new rows."""
    return old.join(done.select(SOURCE).distinct(), SOURCE, "left_anti").unionByName(new)


def index_stats(chunks: DataFrame, approx: bool = False) -> DataFrame:
    source = F.nullif("source", F.lit(""))
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks"), (F.approx_count_distinct(source) if approx else F.countDistinct(source)).alias("n_sources"))


def list_topics(chunks: DataFrame) -> DataFrame:
    return chunks.select("topic_id").where("topic_id is not null").distinct().orderBy("topic_id")


def topic_tree(chunks: DataFrame) -> DataFrame:
    topic, sub = F.coalesce("topic_id", F.lit("SCONOSCIUTO")), F.coalesce("sub_topic_id", F.lit("NON_ASSEGNATO"))
    return chunks.select(topic.alias("topic_id"), sub.alias("s")).groupBy("topic_id").agg(F.sort_array(F.collect_set("s")).alias("sub_topics"))


def chunk_counts(parents: DataFrame, chunks: DataFrame) -> DataFrame:
    a = parents.groupBy("source").agg(F.count(F.lit(1)).alias("n_parents"))
    b = chunks.groupBy("source").agg(F.count(F.lit(1)).alias("n_children"))
    return a.join(b, "source", "full").select("source", F.coalesce("n_parents", F.lit(0)).alias("n_parents"), F.coalesce("n_children", F.lit(0)).alias("n_children"))


def run_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("topic_id", "sub_topic_id").agg(F.count(F.lit(1)).alias("n_files"), F.count_if("ok").alias("n_ok"))


def find_text(chunks: DataFrame, needle: str, excerpt: int = 150) -> DataFrame:
    return chunks.where(F.lower("content").contains(needle.lower())).select("chunk_id", "topic_id", F.substring("content", 1, excerpt).alias("excerpt"))


def backfill_sub_topic(chunks: DataFrame, default: str) -> DataFrame:
    return chunks.withColumn("sub_topic_id", F.coalesce(F.nullif("sub_topic_id", F.lit("")), F.lit(default)))


def rename_sub_topic(chunks: DataFrame, old: str, new: str, topic: str | None = None) -> DataFrame:
    hit = (F.col("sub_topic_id") == old) & (F.lit(True) if topic is None else F.col("topic_id") == topic)
    return chunks.withColumn("sub_topic_id", F.when(hit, new).otherwise(F.col("sub_topic_id")))


def rename_topic(rows: DataFrame, old: str, new: str) -> DataFrame:
    return rows.withColumn("topic_id", F.when(F.col("topic_id") == old, new).otherwise(F.col("topic_id")))


def cascade_topics(sub_topics: DataFrame, topics: DataFrame, renames: DataFrame) -> DataFrame:
    """Sub-topics after topic renames (old_id, new_id) and without those of deleted topics."""
    moved = sub_topics.join(renames, F.col("topic_id") == F.col("old_id"), "left").withColumn("topic_id", F.coalesce("new_id", "topic_id")).drop("old_id", "new_id")
    return moved.join(topics.select("topic_id"), "topic_id", "left_semi")


def rename_topic_everywhere(chunks: DataFrame, parents: DataFrame, cache: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks and parents under the new topic, and the cache without the old topic's answers."""
    return rename_topic(chunks, old, new), rename_topic(parents, old, new), cache.where(F.coalesce(F.col("topic_id") != old, F.lit(True)))


def list_config(sub_topics: DataFrame, topic: str | None = None) -> DataFrame:
    """topic_id, sub_topic_id, description of a topic's sub-topics; the id where there is no description."""
    rows = sub_topics if topic is None else sub_topics.where(F.col("topic_id") == topic)
    return rows.select("topic_id", "sub_topic_id", F.coalesce(F.nullif("description", F.lit("")), F.col("sub_topic_id")).alias("description"))
