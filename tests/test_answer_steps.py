"""Every step of answering in one job: rewriting, keywords by a model, the cache, the topic's prompt, new cache entries."""

from pyspark.sql import functions as F

from millrace.functions import models, splitting
from millrace.operators import answering
from millrace.plans import queries

HISTORY = "array<struct<role:string,text:string>>"


def test_answers_are_rewritten_prompted_by_topic_and_kept(spark, tmp_path):
    docs = spark.createDataFrame([("t", "s", "d1", "apples grow on trees in the garden"), ("t", "s", "d2", "rivers run to the sea"), ("u", "s", "d3", "apples are red")], "topic_id string, sub_topic_id string, source string, text string").withColumns({"chunk_size": F.lit(50), "chunk_overlap": F.lit(5), "parent_chunk_size": F.lit(100)})
    parents, chunks = splitting.chunk_documents(docs)
    chunks = chunks.withColumn("embedding", models.embed(F.col("content")))
    rows = [(1, "where do they grow", "t", [("user", "apples")]), (2, "apples", "u", None), (3, "sea", "t", [])]
    asked = spark.createDataFrame(rows, f"qid long, query string, topic_id string, history {HISTORY}").withColumn("sub_topics", F.array().cast("array<string>"))
    topics = spark.createDataFrame([("t", "own"), ("u", None)], "topic_id string, prompt string")
    prompts = {"own": "OWN {query}", "general": "GENERAL {query}", answering.REWRITER: "<{history_str}> {query}", answering.KEYWORDS: "words of {query}"}
    seen = tmp_path / "seen"

    def rewrite(texts):
        return [" apples" if t == "<user: apples> where do they grow" else "?" for t in texts]

    def words(texts):
        with open(seen, "a") as f:
            f.writelines(t + "\n" for t in texts)
        return [t.removeprefix("words of ") for t in texts]

    def answer(texts):
        return [f" answer, which is long enough, to {t}\n" if t != "OWN sea" else "short" for t in texts]

    kept = f"file://{tmp_path}/entries"
    ask = lambda cache: {r.qid: r for r in answering.answer_requests(asked, chunks, parents, docs.select("topic_id", "sub_topic_id").distinct(), cache, answer_model=answer, min_score=0.3, query_model=rewrite, keyword_model=words, topics=topics, prompts=prompts, entries=kept).collect()}
    got = ask(None)
    assert {q: r.answer for q, r in got.items()} == {1: "answer, which is long enough, to OWN apples", 2: "answer, which is long enough, to GENERAL apples", 3: "short"}
    assert set(seen.read_text().split("\n")) - {""} == {"words of apples", "words of sea"}
    entries = spark.read.parquet(kept)
    assert {(r.topic_id, r.query, r.sub_topics_key, r.answer) for r in entries.collect()} == {("t", "apples", "s", got[1].answer), ("u", "apples", "s", got[2].answer)}
    again = ask(entries.localCheckpoint())
    assert {q: r.cached for q, r in again.items()} == {1: True, 2: True, 3: False} and again[1].sources == got[1].sources
    assert spark.read.parquet(kept).count() == 2  # what came from the cache or is short is not added


def test_the_answered_query_looks_into_its_cache(spark, tmp_path):
    texts = {0: "rivers run to the sea and back", 5: "hills stand above the sea", 7: "rivers run far away", 100: " ".join(f"word{i}" for i in range(60)), 200: "too short", 300: "stars shine at night above the hills"}
    spark.createDataFrame([(i, x, "en", "src1", len(x)) for i, x in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(100, 0, "user", "what of the hills"), (100, 1, "system", "no part of it")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.qid: r for r in queries.answered(spark, str(tmp_path)).collect()}
    assert set(got) == {0, 100, 200, 300} and {r.status for r in got.values()} == {"success"}
    assert {q for q, r in got.items() if r.cached} == {0, 300} and got[0].answer == texts[0] and got[300].sources == '[{"file":"doc_300","sub_topic":"src1"}]'
    assert "doc_5" in got[100].sources  # only what was said before names hills
