"""What answering stages and shuffles grows with its input, not with questions times files."""

import numpy as np
import pyarrow as pa

from millrace.operators import nearest, retrieval

STRINGS = "array<string>"


def test_a_task_sends_on_k_hits_a_question_whatever_the_number_of_blocks():
    rng = np.random.default_rng(5)
    unit = lambda n: (lambda v: v / np.linalg.norm(v, axis=1)[:, None])(np.round(rng.normal(size=(n, 4)), 1) + 0.01)
    asked, found = unit(7), unit(60)
    ids = [f"c{i:02}" for i in rng.permutation(60)]
    block = lambda at: pa.record_batch([pa.array([4], pa.int32()), pa.array([asked.tobytes()]), pa.array([list(range(7))], pa.list_(pa.int64())), pa.array([[None] * 7], pa.list_(pa.list_(pa.string()))), pa.array([found[at : at + 10].tobytes()]), pa.array([ids[at : at + 10]]), pa.array([["s"] * 10])], names=["size", "asked", "qids", "wanted", "vectors", "ids", "sub"])
    scores = np.round(asked @ found.T, 6)
    for by_id in (False, True):
        rows = [r for b in nearest._met(3, 0.1, by_id)(iter([block(at) for at in range(0, 60, 10)])) for r in b.to_pylist()]
        want = []
        for q in range(7):
            near = sorted((0 if by_id else -scores[q, i], ids[i], scores[q, i]) for i in range(60) if scores[q, i] >= 0.1)[:3]
            want += [(q, c, s) for _, c, s in near]
        assert sorted((r["qid"], r["chunk_id"], r["score"]) for r in rows) == sorted(want) and len(rows) <= 7 * 3


def test_a_token_sends_on_its_first_chunks_once_where_all_select_all(spark, monkeypatch):
    rows = {}

    def counted(df, name):
        out = keep(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    keep, pivot = retrieval.staged, retrieval._pivot
    monkeypatch.setattr(retrieval, "staged", counted)
    monkeypatch.setattr(retrieval, "_pivot", lambda ids: pivot(ids, least=1, parts=4))
    texts = {i: "hot" + (" cold" if i % 10 == 0 else "") + (" rare" if i in (7, 301, 450) else "") for i in range(500)}
    sub = lambda i: None if i % 25 == 24 else f"s{i % 8}"
    chunks = spark.createDataFrame([(i, "t", sub(i), x) for i, x in texts.items()], "chunk_id long, topic_id string, sub_topic_id string, content string")
    for many in (False, True):
        rows.clear()
        every = [f"s{n}" for n in range(8)]
        asked = [(n, "t", [every, every, every] if not many else [every, [], ["s1", "s2"]], [["hot"], ["rare", "cold"], ["absent"]][n % 3]) for n in range(30)]
        asked = [(n, t, subs[n % 7 % 3], words) for n, t, subs, words in asked]
        queries = spark.createDataFrame(asked, f"qid long, topic_id string, sub_topics {STRINGS}, words {STRINGS}")
        want = []
        for n, _, subs, words in asked:
            held = [i for i, x in texts.items() if (not subs or sub(i) in subs) and set(words) & set(x.split())]
            want += [(n, i, r + 1) for r, i in enumerate(held[:40])]
        assert sorted(tuple(r) for r in retrieval.keyword_topk(queries, chunks).select("qid", "chunk_id", "rank").collect()) == want
        # Three tokens that are there, 40 chunks of each: of every sub-topic alone it would be over four times as many.
        assert many or rows["holders"] <= 2 * 40 + 3
        assert rows["early-holders"] > 0 and rows["late-holders"] > 0  # one token is full before the pivot, others are not


def test_context_is_fetched_for_the_blocks_that_fit_only(spark, monkeypatch):
    columns = {}
    keep = retrieval.staged
    monkeypatch.setattr(retrieval, "staged", lambda df, name: columns.update({name: df.columns}) or keep(df, name))
    parents = spark.createDataFrame([(f"p{i}", None if i == 3 else f"f{i}", None if i == 4 else "s", " \n " if i == 2 else None if i == 6 else f"é{i}" * 10) for i in range(9)], "parent_id string, source string, sub_topic_id string, content string")
    kept = spark.createDataFrame([(q, (f"p{(q * 5 + n) % 9}" if n != 4 else None), n + 1) for q in range(6) for n in range(8)], "qid long, parent_id string, rank int")
    plain = retrieval.expand_parents(kept, parents)
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    for most in (1_000_000, 20, 1):
        found, context = retrieval.fetch_context(kept, parents, 120, most)
        cols = ["qid", "rank", "parent_id", "source", "sub_topic_id"]
        assert rows(found.select(cols)) == rows(plain.select(cols)) and rows(context) == rows(retrieval.build_context(plain, 120))
    assert not any("content" in c for c in columns.values())
