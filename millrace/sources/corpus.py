"""Reading corpora, routing, configuration, outcomes and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.text import artifact_name, file_name, linked_files, page_text, resolved, strip, suffix
from millrace.sources.staging import exists, staged

FEEDBACK = "query string, answer string, topic_id string, rating int, history array<struct<role:string,text:string>>, comment string"
REQUEST = "qid bigint, query string, topic_id string, sub_topics array<string>, history array<struct<role:string,text:string>>"


def placed(files: DataFrame, root: str) -> DataFrame:
    """topic_id, sub_topic_id, rel_path and name of path, two levels under root."""
    rest = F.regexp_replace(F.col("path"), rf"^.*?\Q{root.rstrip('/').removeprefix('file://')}\E/", "")
    parts = F.split(rest, "/")
    return files.where(F.size(parts) >= 3).withColumns({"topic_id": parts[0], "sub_topic_id": parts[1], "rel_path": F.array_join(F.slice(parts, F.lit(3), F.size(parts)), "/"), "name": F.element_at(parts, -1)})


def scan_corpus(spark: SparkSession, root: str) -> DataFrame:
    return placed(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root), root)


def decoded(content: Column) -> Column:
    """Bytes as text with line ends as one newline; null where they are no UTF-8."""
    return F.regexp_replace(F.try_validate_utf8(content.cast("string")), r"\r\n?", "\n")


def read_text_docs(spark: SparkSession, root: str) -> DataFrame:
    """Text and markdown files, whatever the case of their suffix, with their whole text."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{[tT][xX][tT],[mM][dD]}").load(root)
    return placed(found.select("path", F.col("modificationTime").alias("modified"), decoded(F.col("content")).alias("text")), root)


def read_url_seeds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(strip(F.col("value")).alias("url")).where(F.col("url").startswith("http"))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REQUEST).json(path)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEEDBACK).json(path)


def load_config(spark: SparkSession, topics: str, sub_topics: str, kind: str = "parquet", **options: str) -> tuple[DataFrame, DataFrame]:
    """Tables of topics and sub-topics: paths of files, or table names where kind is jdbc and options name the database."""
    def load(name: str) -> DataFrame:
        reader = spark.read.format(kind).options(**options)
        return reader.option("dbtable", name).load() if kind == "jdbc" else reader.load(name)

    return load(topics), load(sub_topics)


def pages_to_documents(pages: DataFrame, extractor: Callable[[Column], Column] = page_text) -> DataFrame:
    """pages (url, html) with text, source (the URL) and is_markdown (false), without pages that have no text."""
    found = pages.withColumns({"text": extractor(F.col("html")), "source": F.col("url"), "is_markdown": F.lit(False)}).drop("html")
    return found.where(F.coalesce(F.col("text"), F.lit("")) != "")


def linked_documents(pages: DataFrame, kind: str = "pdf") -> DataFrame:
    """url (the page), link, source (the link's own URL) and name of each linked file."""
    links = pages.select("url", F.explode(F.array_distinct(linked_files(F.col("html"), kind))).alias("link"))
    return links.withColumn("source", resolved(F.col("url"), F.col("link"))).withColumn("name", file_name(F.col("source")))


def resolve_source(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    return files.join(sidecars, "path", "left").withColumn("source", F.coalesce(F.nullif(strip(F.col("origin_url")), F.lit("")), F.col("rel_path"))).drop("origin_url")


def exclude_artifacts(files: DataFrame, strict: bool = False) -> DataFrame:
    kinds = "meta|ocr|md" if strict else "meta|ocr"
    return files.where(~F.col("name").rlike(rf"\.({kinds})$") & (F.col("name") != "urls.txt"))


def route_files(files: DataFrame) -> DataFrame:
    """Adds route (null: none) and is_markdown; PDFs and images become markdown."""
    kind = suffix(F.col("name"))
    route = F.when(kind == ".pdf", "pdf").when(kind.isin(".png", ".jpg", ".jpeg"), "image").when(kind.isin(".txt", ".md"), "text")
    return files.withColumns({"route": route, "is_markdown": F.coalesce(route.isin("pdf", "image"), F.lit(False)) | (kind == ".md")})


def route_pages(pages: DataFrame, min_chars: int = 50) -> DataFrame:
    return pages.withColumn("route", F.when(F.length(strip(F.coalesce("text", F.lit("")))) < min_chars, "image").otherwise("markdown"))


def apply_config(docs: DataFrame, sub_topics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with their sizes, and those without a chunk size. Zero counts as unset."""
    def unset(c: str, default: int):
        return F.when(F.col(c).isNull() | (F.col(c) == 0), default).otherwise(F.col(c)).alias(c)

    sizes = sub_topics.select("topic_id", "sub_topic_id", "chunk_size", unset("chunk_overlap", 50), unset("parent_chunk_size", 1500))
    joined = docs.join(sizes, ["topic_id", "sub_topic_id"], "left")
    valid = F.coalesce(F.col("chunk_size") > 0, F.lit(False))
    return joined.where(valid), joined.where(~valid)


def split_outcomes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with text, and those without, with a message. White space counts as text."""
    empty = F.col("text").isNull() | (F.col("text") == "")
    return docs.where(~empty), docs.where(empty).withColumn("error", F.lit("no text"))


def latest(files: DataFrame) -> DataFrame:
    """The newest of each (source, topic, sub-topic); ties go to the later path."""
    w = Window.partitionBy("source", "topic_id", "sub_topic_id").orderBy(F.desc("modified"), F.desc("path"))
    return files.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def assemble_pages(pages: DataFrame) -> DataFrame:
    """One text a source, pages in order, ruled off."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: F.coalesce(p["text"], F.lit("")))
    return pages.groupBy("source").agg(F.array_join(ordered, "\n\n---\n\n").alias("text"), F.count(F.lit(1)).alias("n_pages"))


def write_artifacts(docs: DataFrame, path: str) -> None:
    """Extracted texts by artefact name, in place of earlier ones of the same folder and name.

    Only the folders (topic, sub-topic) that docs has are written anew.
    """
    place = ["topic_id", "sub_topic_id", "artifact_name"]
    spark = docs.sparkSession
    new = docs.select("topic_id", "sub_topic_id", artifact_name(F.col("rel_path"), F.col("is_markdown")).alias("artifact_name"), "text").groupBy(*place).agg(F.max("text").alias("text"))
    rows = staged(new, "artifacts")
    if exists(spark, path):
        old = spark.read.schema("artifact_name string, text string, topic_id string, sub_topic_id string").parquet(path)
        kept = old.join(rows.select(place[:2]).distinct(), place[:2], "left_semi").join(rows, place, "left_anti")
        rows = staged(rows.unionByName(kept.select(rows.columns)), "artifacts")  # read before its folders are written over
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*place[:2]).parquet(path)


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
