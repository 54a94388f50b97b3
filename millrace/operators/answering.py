"""Requests to answers in one job: scope, rewriting, cache, retrieval, reranking, context, the topic's prompt, generation, outcome, cache entries."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.models import ask_keywords, embed, extract_answer, generate, hashed_embedding, rewrite_query, shared_words
from millrace.functions.text import render, strip, sub_topics_key
from millrace.operators import chat, retrieval
from millrace.sources.staging import staged

TEMPLATE = "{context_str}\n\nQuestion: {query}"
SOURCES = "array<struct<file:string,sub_topic:string>>"


#: What models are asked: texts of prompts by name. A topic names the one that its answers take.
REWRITER, KEYWORDS, GENERAL = "query_rewriter", "extract_keywords", "general"


def prepare_requests(
    requests: DataFrame,
    sub_topics: DataFrame,
    embed_model: Callable[[list[str]], np.ndarray] = hashed_embedding,
    query_model: Callable[[list[str]], list[str]] | None = None,
    keyword_model: Callable[[list[str]], list[str]] | None = None,
    prompts: dict[str, str] | None = None,
) -> DataFrame:
    """Valid requests (qid, query, topic_id, sub_topics, history, ...) with their scope, rewritten query, vector, keywords and cache key.

    has_config is false where the topic has no sub-topics; embedding is null
    where the model failed. prompts: texts by name, of which REWRITER
    (history_str, query) and KEYWORDS (query) are taken.
    """
    texts = {REWRITER: "{history_str}\n{query}", KEYWORDS: "{query}", **(prompts or {})}
    valid = retrieval.resolve_scope(chat.validate_requests(requests).where("reason is null").drop("reason"), sub_topics)
    asked = valid.withColumn("query", rewrite_query(F.col("query"), F.col("history"), query_model, texts[REWRITER])).drop("history")
    return asked.withColumns({"has_config": F.size("sub_topics") > 0, "embedding": embed(F.col("query"), embed_model).cast("array<double>"), "words": ask_keywords(F.col("query"), keyword_model, texts[KEYWORDS]), "sub_topics_key": sub_topics_key(F.col("sub_topics"))})


def topic_prompt(asked: DataFrame, topics: DataFrame | None, prompts: dict[str, str], template: str) -> DataFrame:
    """Adds to asked (topic_id, query, context) the text for the answer model: the prompt that its topic names, GENERAL where it names none, template where there is no such text."""
    named = asked.withColumn("prompt", F.lit(GENERAL)) if topics is None else chat.resolve_prompt(asked, topics)
    fill = lambda text: render(text, context_str=F.col("context"), query=F.col("query"))
    text = fill(template)
    for name, other in prompts.items():
        text = F.when(F.col("prompt") == name, fill(other)).otherwise(text)
    return named.withColumn("prompt", text)


def answer_prepared(
    asked: DataFrame,
    hits: DataFrame,
    chunks: DataFrame,
    parents: DataFrame,
    score_model: Callable[[list[tuple[str, str]]], list[float]] = shared_words,
    answer_model: Callable[[list[str]], list[str]] = extract_answer,
    min_score: float = 0.6,
    template: str = TEMPLATE,
    posted: tuple[DataFrame, DataFrame] | None = None,
    topics: DataFrame | None = None,
    prompts: dict[str, str] | None = None,
) -> DataFrame:
    """qid, topic_id, answer, sources, cached, status of prepared requests; hits: qid, cached_answer, cached_sources of those answered already.

    asked is read several times: give it from a table. What models made is
    written once, so no model sees an item twice. posted: postings and terms of
    the index, where it has them; without, chunks are searched for keywords.
    topics (topic_id, prompt) name the prompts of answers, see topic_prompt.
    """
    open_ = asked.where("has_config and size(embedding) > 0").join(hits, "qid", "left_anti")
    keyword = retrieval.keyword_topk(open_, chunks) if posted is None else retrieval.posted_topk(open_, *posted)
    fused = retrieval.fuse(retrieval.vector_topk(open_, chunks, 30, min_score), keyword)
    found, context = retrieval.fetch_context(retrieval.rerank(fused, open_, chunks, score_model, carried=("parent_id",)), parents)
    context = topic_prompt(open_.select("qid", "topic_id", "query").join(context, "qid"), topics, prompts or {}, template)
    answers = context.select("qid", strip(generate(F.col("prompt"), answer_model)).alias("answer"), F.col("n_parents").alias("found"))
    made = answers.join(retrieval.cite_sources(found), "qid")
    rows = asked.select("qid", "topic_id", "has_config", "embedding").join(hits, "qid", "left").join(made, "qid", "left")
    flags = rows.withColumns({"service_ok": F.col("embedding").isNotNull(), "failed": F.lit(False), "has_embedding": F.size("embedding") > 0, "cached": F.col("cached_answer").isNotNull(), "n_context": F.coalesce("found", F.lit(0)), "generated": F.col("answer").isNotNull()})
    return chat.classify_outcome(flags).select("qid", "topic_id", F.coalesce("cached_answer", "answer").alias("answer"), F.coalesce("cached_sources", "sources").alias("sources"), "cached", "status")


def answer_requests(
    requests: DataFrame,
    chunks: DataFrame,
    parents: DataFrame,
    sub_topics: DataFrame,
    cache: DataFrame | None = None,
    embed_model: Callable[[list[str]], np.ndarray] = hashed_embedding,
    score_model: Callable[[list[tuple[str, str]]], list[float]] = shared_words,
    answer_model: Callable[[list[str]], list[str]] = extract_answer,
    min_score: float = 0.6,
    template: str = TEMPLATE,
    query_model: Callable[[list[str]], list[str]] | None = None,
    keyword_model: Callable[[list[str]], list[str]] | None = None,
    topics: DataFrame | None = None,
    prompts: dict[str, str] | None = None,
    entries: str | None = None,
) -> DataFrame:
    """qid, topic_id, answer, sources, cached, status of every valid request (qid, query, topic_id, sub_topics, history).

    Tables are those of the index and its configuration; cache has cache_id,
    topic_id, sub_topics_key, embedding, answer and sources (array of file and
    sub_topic). topics and prompts: see topic_prompt and prepare_requests.
    entries: a folder to which new answers worth keeping are added as rows of a
    cache, with their query and the time of writing (ts).
    """
    asked = staged(prepare_requests(requests, sub_topics, embed_model, query_model, keyword_model, prompts), "asked")
    hits = asked.select("qid").limit(0).select("qid", F.lit("").alias("cached_answer"), F.lit(None).cast(SOURCES).alias("cached_sources"))
    if cache is not None:
        near = staged(retrieval.cache_lookup(asked.where("has_config"), cache).drop("score"), "near")
        known = cache.select("cache_id", F.col("answer").alias("cached_answer"), F.col("sources").alias("cached_sources"))
        hits = staged(retrieval.meeting(known, near, "cache_id", 1_000_000).drop("cache_id"), "hits")
    out = answer_prepared(asked, hits, chunks, parents, score_model, answer_model, min_score, template, topics=topics, prompts=prompts)
    if entries is None:
        return out
    out = staged(out, "answers")
    new = chat.cacheable(out.where("status = 'success' and not cached")).join(asked.select("qid", "query", "sub_topics_key", "embedding"), "qid")
    new.select(F.uuid().alias("cache_id"), "topic_id", "sub_topics_key", "embedding", "answer", "sources", "query", F.current_timestamp().alias("ts")).write.mode("append").parquet(entries)
    return out
