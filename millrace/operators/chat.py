"""Requests, outcomes, feedback, cache admission and chat turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import history_json, strip


def validate_requests(requests: DataFrame) -> DataFrame:
    """Adds reason (null: valid) and cuts history to those of its first 20 items that have a role and a text, empty ones included."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    reason = F.when(empty(F.col("topic_id")) | empty(strip(F.col("query"))), "bad_request").when(F.length("query") > 2000, "too_large")
    return requests.withColumn("reason", reason).withColumn("history", F.filter(F.slice("history", 1, 20), lambda h: h["role"].isNotNull() & h["text"].isNotNull()))


def validate_feedback(feedback: DataFrame) -> DataFrame:
    full = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return feedback.where(full("user_query") & full("ai_response") & F.col("rating").isNotNull())


def cacheable(answers: DataFrame) -> DataFrame:
    return answers.where((F.length("answer") > 20) & ~F.lower("answer").contains("could not find"))


def prune_cache(cache: DataFrame, now: float, max_age_s: float = 86_400) -> DataFrame:
    return cache.where(F.col("timestamp") >= now - max_age_s)


def severe_logs(logs: DataFrame) -> DataFrame:
    return logs.where(F.upper("log_level").isin("WARNING", "ERROR", "CRITICAL"))


def resolve_prompt(queries: DataFrame, topics: DataFrame) -> DataFrame:
    return queries.join(topics.select("topic_id", "prompt"), "topic_id", "left").withColumn("prompt", F.coalesce(F.nullif("prompt", F.lit("")), F.lit("general")))


def classify_outcome(results: DataFrame) -> DataFrame:
    """Adds status from has_config, service_ok, has_embedding, cached, n_context, generated and failed.

    The first step that did not succeed names it. failed (an unforeseen error)
    and a step that should have run but left a null are internal errors.
    """
    inner = "Internal Processing Error"
    no = lambda c: ~F.col(c)
    status = (
        F.when(no("has_config"), "Configuration Error").when(F.coalesce("failed", F.lit(False)) | F.col("has_config").isNull(), inner)
        .when(no("service_ok"), "AI Service Unavailable").when(F.col("service_ok").isNull(), inner).when(no("has_embedding"), "Embedding Failed").when(F.col("has_embedding").isNull(), inner)
        .when(F.col("cached"), "success").when(F.col("n_context") == 0, "No Relevant Documents").when(F.col("n_context").isNull(), inner)
        .when(no("generated"), "Generation Failed").when(F.col("generated"), "success").otherwise(inner)
    )
    return results.withColumn("status", status)


def _with_first_turns(turns: DataFrame, most: int) -> DataFrame:
    """Adds counts (role and text, or null if the turn is no part of histories) and first: the conversation's first `most` of them.

    The array is made once for a conversation, so work grows with its turns.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    counts = F.when(~F.coalesce(F.col("role"), F.lit("")).isin("system", "error"), F.struct("role", "text"))
    out = turns.withColumn("counts", counts).withColumn("nth", F.count("counts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    early = F.when(F.col("counts").isNotNull() & (F.col("nth") <= most), F.struct("nth", "counts"))
    ordered = F.array_sort(F.collect_list(early).over(Window.partitionBy("conv_id")))
    return out.withColumn("first", F.transform(ordered, lambda x: x["counts"]))


def chat_history(turns: DataFrame, most: int = 20) -> DataFrame:
    """conv_id, turn, text, n_before: each user turn with the number and text of earlier turns that count, the oldest `most`."""
    out = _with_first_turns(turns, most).where("role = 'user'")
    before = F.slice("first", F.lit(1), F.least(F.lit(most), F.col("nth").cast("int") - 1))
    return out.select("conv_id", "turn", F.size(before).alias("n_before"), F.array_join(F.transform(before, lambda h: F.concat(h["role"], F.lit(": "), h["text"])), "\n").alias("history"))


def feedback_pairs(turns: DataFrame, most: int = 20) -> DataFrame:
    """conv_id, turn, question, answer, n_before, history: each answer with the turn before it and what counts before that.

    history is a JSON array, oldest first, of at most `most` items; n_before counts all.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    out = _with_first_turns(turns, most).withColumns({"question": F.lag("text").over(w), "n_before": F.count("counts").over(w.rowsBetween(Window.unboundedPreceding, -2))})
    answers = out.where(F.col("role").isin("assistant", "model") & F.col("question").isNotNull())
    history = F.slice("first", F.lit(1), F.least(F.lit(most), F.col("n_before").cast("int")))
    return answers.select("conv_id", "turn", "question", F.col("text").alias("answer"), "n_before", history_json(history).alias("history"))


def feedback_rows(feedback: DataFrame) -> DataFrame:
    """Valid feedback requests as rows of the feedback table."""
    ok = validate_feedback(feedback.withColumnsRenamed({"query": "user_query", "answer": "ai_response"}))
    return ok.select("user_query", "ai_response", "topic_id", "rating", history_json(F.col("history")).alias("chat_history"), F.coalesce("comment", F.lit("")).alias("comment"))
