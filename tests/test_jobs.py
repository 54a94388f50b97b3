"""Sinks, hooks, markdown chunking, answering and streams, each on small input."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import models, splitting, text
from millrace.operators import answering, nearest, retrieval
from millrace.sources import corpus
from millrace.streaming import jobs

SUBS = "topic_id string, sub_topic_id string, description string, chunk_size int, chunk_overlap int, parent_chunk_size int"


def test_configuration_and_artifacts(spark, tmp_path):
    subs = spark.createDataFrame([("t", "s", "", 100, 20, 400)], SUBS)
    subs.write.parquet(str(tmp_path / "subs"))
    topics, got = corpus.load_config(spark, str(tmp_path / "subs"), str(tmp_path / "subs"))
    assert got.collect() == subs.collect() == topics.collect()
    docs = spark.createDataFrame([("t", "s", "a.md", True, "x"), ("t", "s", "b.txt", False, "y")], "topic_id string, sub_topic_id string, rel_path string, is_markdown boolean, text string")
    corpus.write_artifacts(docs, str(tmp_path / "artifacts"))
    more = spark.createDataFrame([("t", "s", "a.md", True, "new"), ("t", "u", "a.md", True, "z")], docs.schema)
    corpus.write_artifacts(more, str(tmp_path / "artifacts"))
    assert sorted((r.sub_topic_id, r.artifact_name, r.text) for r in spark.read.parquet(str(tmp_path / "artifacts")).collect()) == [("s", "a.md.md", "new"), ("s", "b.txt.ocr", "y"), ("u", "a.md.md", "z")]
    corpus.append_rows(docs, f"{tmp_path}/rows")
    corpus.append_rows(docs, f"{tmp_path}/rows")
    assert spark.read.parquet(f"{tmp_path}/rows").count() == 4


def test_requests_seeds_and_pages(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"qid": 1, "query": "q", "topic_id": "t", "history": [{"role": "user", "text": ""}]}))
    assert corpus.read_requests(spark, str(tmp_path / "r.json")).first().history[0].text == ""
    (tmp_path / "urls.txt").write_text(" https://a.example/x \nftp://no\n\n")
    assert [r.url for r in corpus.read_url_seeds(spark, str(tmp_path / "urls.txt")).collect()] == ["https://a.example/x"]
    pages = spark.createDataFrame([("https://e.org/a/b.html", "<nav>m</nav><!-- c --><p>One &amp; two<a href=c.pdf>x</a><a href='/d/'>n</a>"), ("https://e.org/z", "<nav>only</nav>"), ("https://e.org/n", None)], "url string, html string")
    assert [(r.source, r.text, r.is_markdown) for r in corpus.pages_to_documents(pages).collect()] == [("https://e.org/a/b.html", "One & two x n", False)]
    assert [(r.source, r.name) for r in corpus.linked_documents(pages).collect()] == [("https://e.org/a/c.pdf", "c.pdf")]
    names = spark.createDataFrame([("https://e.org",), ("https://e.org/a/?q=/x.pdf",), ("https://e.org/a/f.pdf#p",)], "u string").select(text.file_name(F.col("u")).alias("n"))
    got = [r.n for r in names.collect()]
    assert got[2] == "f.pdf" and all(n.startswith("dl_") and len(n) == 11 for n in got[:2])


def test_markdown_is_chunked_by_section(spark):
    md = "# A\none two three four five\n\n## B\nsix seven eight"
    docs = spark.createDataFrame([("t", "s", "m", md, True), ("t", "s", "p", md, False), ("t", "s", "bad", md, True)], "topic_id string, sub_topic_id string, source string, text string, is_markdown boolean").withColumns({"chunk_size": F.lit(4), "chunk_overlap": F.when(F.col("source") == "bad", 9).otherwise(0), "parent_chunk_size": F.lit(50)})
    parents, chunks = splitting.chunk_documents(docs)
    got = {(r.source, r.parent_index): (r.content, r.headers) for r in parents.collect()}
    assert got == {("m", 0): ("# A\none two three four five", {"Header 1": "A"}), ("m", 1): ("## B\nsix seven eight", {"Header 1": "A", "Header 2": "B"}), ("p", 0): (md, {})}
    assert chunks.join(parents, "parent_id", "left_anti").count() == 0 and chunks.where("source = 'bad'").count() == 0


def test_sizes_can_be_tokens_of_a_vocabulary():
    tokenizers = pytest.importorskip("public_tokenizers")
    count = splitting.counter(tokenizers.path("byte_bpe_50k.tiktoken"))
    parts = splitting.split_text("several ordinary words, and then unbelievably longer ones. " * 20, splitting.CHILD, 12, 3, count)
    assert len(parts) > 10 and all(0 < count(p) <= 12 for p in parts)


def test_hooks(spark):
    frame = spark.createDataFrame([(1, "q", "a b", [("user", "x")]), (2, "r", None, []), (3, "s", "c", None)], "i int, query string, passage string, history array<struct<role:string,text:string>>")

    def fails(pairs):
        raise RuntimeError("down")

    out = frame.select("i", models.score_pairs(F.col("query"), F.col("passage"), fails).alias("s"), models.generate(F.col("query"), fails).alias("g"), models.ask_keywords(F.lit("Which words, remain")).alias("k"), models.rewrite_query(F.col("query"), F.col("history"), lambda p: [x.upper() for x in p]).alias("w"), models.rewrite_query(F.col("query"), F.col("history")).alias("same"))
    rows = out.orderBy("i").collect()
    assert all(r.s is None and r.g is None and r.k == ["which", "words,", "remain"] for r in rows)
    assert [r.w for r in rows] == ["USER: X\nQ", "r", "s"] and [r.same for r in rows] == ["q", "r", "s"]
    images = spark.createDataFrame([(bytearray(b"ab-\ncd "),), (None,), (bytearray(b"!"),)], "content binary")

    def read(parts):
        if parts[0] == b"!":
            raise ValueError("unreadable")
        return [p.decode() for p in parts]

    assert [r[0] for r in images.select(models.ocr(F.col("content"), read)).collect()] == ["abcd", None, None]
    assert np.allclose(np.linalg.norm(models.hashed_embedding(["a b", "c"]), axis=1), 1)


def test_rerank_falls_back_for_the_queries_that_the_model_fails(spark):
    queries = spark.createDataFrame([(1, "good words"), (2, "bad")], "qid long, query string")
    chunks = spark.createDataFrame([(c, "good words here" if c % 2 else "x" * 2000) for c in range(6)], "chunk_id long, content string")
    fused = spark.createDataFrame([(q, c, 0.5 + c / 100) for q in (1, 2) for c in range(6)], "qid long, chunk_id long, vec_score double")
    def model(pairs):
        assert all(len(d) <= 1200 for _, d in pairs)
        if any(q == "bad" for q, _ in pairs):
            raise RuntimeError("overloaded")
        return models.shared_words(pairs)

    out = retrieval.rerank(fused, queries, chunks, model, k=3).collect()
    assert [r.chunk_id for r in sorted((r for r in out if r.qid == 2), key=lambda r: r.rank)] == [5, 4, 3] and all(r.prob is None for r in out if r.qid == 2)
    assert len([r for r in out if r.qid == 1]) == 3


def test_answers_and_their_outcomes(spark):
    docs = spark.createDataFrame([("t", "s", "d1", "apples grow on trees in the garden"), ("t", "s", "d2", "rivers run to the sea")], "topic_id string, sub_topic_id string, source string, text string").withColumns({"chunk_size": F.lit(50), "chunk_overlap": F.lit(5), "parent_chunk_size": F.lit(100)})
    parents, chunks = splitting.chunk_documents(docs)
    chunks = chunks.withColumn("embedding", models.embed(F.col("content")))
    subs = docs.select("topic_id", "sub_topic_id").distinct()
    cache = spark.createDataFrame([("c1", "t", "s", [float(x) for x in models.hashed_embedding(["known question"])[0]], "kept answer", [("f", "s")])], "cache_id string, topic_id string, sub_topics_key string, embedding array<double>, answer string, sources array<struct<file:string,sub_topic:string>>")
    asked = spark.createDataFrame([(1, "apples in the garden", "t"), (2, "known question", "t"), (3, "zzz", "t"), (4, "apples", "none"), (5, " ", "t")], "qid long, query string, topic_id string").withColumns({"sub_topics": F.array().cast("array<string>"), "history": F.array().cast("array<struct<role:string,text:string>>")})
    got = {r.qid: r for r in answering.answer_requests(asked, chunks, parents, subs, cache, min_score=0.3).collect()}
    assert {q: (r.status, r.cached) for q, r in got.items()} == {1: ("success", False), 2: ("success", True), 3: ("No Relevant Documents", False), 4: ("Configuration Error", False)}
    assert "apples grow" in got[1].answer and got[1].sources[0].file == "d1" and got[2].answer == "kept answer"


def test_answers_feedback_and_logs_as_streams(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()
    (asked / "1.json").write_text(json.dumps({"qid": 7, "query": "q", "topic_id": "t"}))
    known = spark.createDataFrame([("t", "yes")], "topic_id string, answer string")
    stream = jobs.json_stream(spark, f"file://{asked}", corpus.REQUEST)
    assert jobs.answer_stream(stream, lambda b: b.join(known, "topic_id").select("qid", "answer"), f"file://{tmp_path}/answers", f"file://{tmp_path}/c1").awaitTermination(60)
    assert [(r.qid, r.answer, r.batch) for r in spark.read.parquet(f"file://{tmp_path}/answers").collect()] == [(7, "yes", 0)]
    given = tmp_path / "feedback"
    given.mkdir()
    (given / "1.json").write_text("\n".join(json.dumps(x) for x in ({"query": "q", "answer": "a", "rating": 0, "topic_id": "t"}, {"query": "q", "answer": "", "rating": 1}, {"query": "q", "answer": "a"})))
    assert jobs.feedback_stream(spark, f"file://{given}", f"file://{tmp_path}/rows", f"file://{tmp_path}/c2").awaitTermination(60)
    assert [(r.user_query, r.rating, r.chat_history, r.comment) for r in spark.read.parquet(f"file://{tmp_path}/rows").collect()] == [("q", 0, "[]", "")]
    spark.createDataFrame([("INFO", "x"), ("error", "y")], "log_level string, message string").write.json(f"file://{tmp_path}/logs")
    assert jobs.log_stream(jobs.json_stream(spark, f"file://{tmp_path}/logs", "log_level string, message string"), f"file://{tmp_path}/severe", f"file://{tmp_path}/c3").awaitTermination(60)
    assert [r.message for r in spark.read.parquet(f"file://{tmp_path}/severe").collect()] == ["y"]


def test_cached_answers_expire_once(spark, tmp_path):
    source = tmp_path / "cache"
    source.mkdir()
    day = 86_400
    put_rows = lambda name, rows: (source / name).write_text("\n".join(json.dumps({"cache_id": c, "s": s}) for c, s in rows))

    def run():
        rows = jobs.json_stream(spark, f"file://{source}", "cache_id string, s long").withColumn("ts", F.timestamp_seconds("s"))
        jobs.append_stream(rows, jobs.expired_answers, f"file://{tmp_path}/expired", f"file://{tmp_path}/checkpoint").awaitTermination(120)
        return sorted(r.cache_id for r in spark.read.parquet(f"file://{tmp_path}/expired").collect())

    put_rows("1.json", [("a", 60), ("b", day // 2), ("c", 10 * day)])
    first = run()
    put_rows("2.json", [("d", 10 * day + 1)])
    assert set(first) <= {"a", "b"} and run() == ["a", "b"]


def test_vector_search_equals_plain_python(spark):
    rng = np.random.default_rng(3)
    vec = lambda: [float(x) for x in rng.normal(size=8)]
    chunks = spark.createDataFrame([(i, "t" if i % 3 else "u", f"s{i % 2}", vec() if i % 7 else None) for i in range(200)] + [(200 + i, "t", "s1", v) for i, v in enumerate(([], [1.0], [0.0] * 8, [float("nan")] * 8, [float("inf")] * 8, [1.0] * 9, [1e200] * 8))], "chunk_id long, topic_id string, sub_topic_id string, embedding array<double>").repartition(5)
    queries = spark.createDataFrame([(q, "t", ["s1"] if q % 2 else [], vec()) for q in range(9)], "qid long, topic_id string, sub_topics array<string>, embedding array<double>")
    few, many = retrieval.vector_topk(queries, chunks, 5, 0.1), retrieval.vector_topk(queries, chunks, 5, 0.1, broadcast_bytes=0)
    rows = lambda df: sorted(tuple(r) for r in df.select("qid", "rank", "chunk_id", "score").collect())
    want = []
    for q in queries.collect():
        near = []
        for c in chunks.collect():
            if c.topic_id == q.topic_id and (not q.sub_topics or c.sub_topic_id in q.sub_topics) and c.embedding is not None and len(c.embedding) == len(q.embedding):
                u, v = np.array(q.embedding), np.array(c.embedding)
                if np.isfinite(v).all() and v.any():
                    near.append((-round(float(u @ v / np.linalg.norm(u) / np.linalg.norm(v)), 6), c.chunk_id))
        want += [(q.qid, n + 1, c, -s) for n, (s, c) in enumerate(sorted(near)[:5]) if -s >= 0.1]
    assert rows(few) == rows(many) == sorted(want) and few.count() > 20
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "BroadcastHashJoin" in plan


def test_first_k_with_ties():
    scores = np.array([[0.5, 0.9, 0.9, 0.9, 0.1], [0.2, 0.2, 0.1, -np.inf, 0.0]])
    row, column = nearest.first_k(scores, 2, 0.15)
    assert list(zip(row.tolist(), column.tolist(), strict=True)) == [(0, 1), (0, 2), (1, 0), (1, 1)]


def test_a_keyword_starts_at_its_rarest_token(spark):
    rows = [(f"c{i:03}", "t" if i % 10 else "u", f"s{i % 2}", "everywhere " * (i % 9 > 0) + ("rare " if i in (7, 12, 63) else "") + f"w{i}") for i in range(100)]
    chunks = spark.createDataFrame(rows, "chunk_id string, topic_id string, sub_topic_id string, content string")
    asked = [(1, "t", [], ["everywhere-rare"]), (2, "t", ["s1"], ["rare"]), (3, "t", [], ["everywhere"]), (4, "t", [], ["everywhere-missing", "!!"]), (5, "t", [], ["rare", "everywhere-w5", "rare w12"]), (6, None, [], ["rare"]), (7, "u", None, ["everywhere"])]
    queries = spark.createDataFrame(asked, "qid long, topic_id string, sub_topics array<string>, words array<string>")
    found = retrieval.postings(chunks)
    starts = {(r.qid, r.word): (r.token, r.rest) for r in retrieval.starting_tokens(queries, retrieval.terms(found)).collect()}
    assert starts[1, 0] == ("rare", ["everywhere"]) and (4, 0) not in starts and starts[5, 1] == ("w5", ["everywhere"])
    read = found.join(queries.where("qid = 1").select("topic_id"), "topic_id").where("token = 'rare'").count()
    assert read == 3  # the chunks that the first query's keyword is tested on, not the 80 of its longest token
    got = sorted(tuple(r) for r in retrieval.posted_topk(queries, found, retrieval.terms(found), 30).select("qid", "chunk_id", "rank").collect())
    assert got == sorted(tuple(r) for r in retrieval.keyword_topk(queries, chunks, 30).select("qid", "chunk_id", "rank").collect())
    assert [c for q, c, _ in got if q == 1] == ["c007", "c012"] and len([1 for q, *_ in got if q == 3]) == 30
