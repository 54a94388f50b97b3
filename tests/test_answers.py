"""Requests answered by streams: from the newest index, and from a cache kept in state."""

import datetime
import json
import time

import numpy as np
import pytest

from millrace.functions import models
from millrace.operators import answering
from millrace.sources import index_store
from millrace.streaming import answers

HOUR = 3600


@pytest.fixture
def stateful(spark):
    old = {k: spark.conf.get(k, None) for k in answers.STATE}
    for k, v in answers.STATE.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Service:
    def __init__(self, spark, tmp_path, **hooks):
        self.spark, self.at, self.n, self.hooks = spark, tmp_path, 0, hooks
        self.index = f"file://{tmp_path}/index"
        (tmp_path / "asked").mkdir()
        (tmp_path / "cache").mkdir()
        self.subs = spark.createDataFrame([("t", "s")], "topic_id string, sub_topic_id string")

    def know(self, batch, **texts):
        rows = [(f"c-{s}", f"p-{s}", "t", "s", s, 0, x, [float(v) for v in models.hashed_embedding([x])[0]]) for s, x in texts.items()]
        parents = [(f"p-{s}", "t", "s", s, 0, x, {}) for s, x in texts.items()]
        make = lambda data, name: (self.spark.createDataFrame(data, index_store.TABLES[name]), {("t", "s")})
        index_store.write_version(self.spark, self.index, {"chunks": make(rows, "chunks"), "parents": make(parents, "parents")}, "test", batch)

    def ask(self, *requests):
        """requests: (qid, query, hours since the start)."""
        self.n += 1
        lines = [json.dumps({"qid": q, "query": text, "topic_id": "t", "asked_at": datetime.datetime.fromtimestamp(1_700_000_000 + h * HOUR, datetime.UTC).isoformat()}) for q, text, h in requests]
        (self.at / "asked" / f"{self.n}.json").write_text("\n".join(lines))

    def look_up(self):
        where = lambda name: f"file://{self.at}/{name}"
        requests = self.spark.readStream.schema(answers.REQUEST).json(where("asked"))
        assert answers.look_up(requests, answers.cached_stream(self.spark, where("cache")), self.subs, where("lookups"), where("c1"), buckets=3).awaitTermination(120)

    def answer(self, once=True):
        where = lambda name: f"file://{self.at}/{name}"
        return answers.answer_lookups(self.spark, where("lookups"), self.index, where("answers"), where("cache"), where("c2"), once=once, min_score=0.3, **self.hooks)

    def start(self):
        self.look_up()
        assert self.answer().awaitTermination(120)

    def got(self):
        return {r.qid: r for r in self.spark.read.option("recursiveFileLookup", True).parquet(f"file://{self.at}/answers").collect()}


def test_hit_before_and_miss_after_a_day_of_event_time(stateful, tmp_path):
    calls = tmp_path / "calls"

    def model(prompts):
        with open(calls, "a") as f:
            f.write("x" * len(prompts))
        return [p.split("\n\n")[0] for p in prompts]

    s = Service(stateful, tmp_path, answer_model=model)
    s.know(0, d1="apples grow on trees in the old garden")
    s.ask((1, "apples grow on trees", 0), (2, "apples on moons of the sea", 0))
    s.start()
    got = s.got()
    assert not got[1].cached and "apples grow" in got[1].answer and got[1].status == "success"
    first = len(calls.read_text())
    s.ask((3, "apples grow on trees", 23), (4, "something else entirely", 23))
    s.start()
    got = s.got()
    assert got[3].cached and got[3].answer == got[1].answer and got[3].sources == got[1].sources and not got[4].cached
    assert len(calls.read_text()) == first  # no model for a hit, nor for a request without context
    s.ask((5, "apples grow on trees", 25))
    s.start()
    assert not s.got()[5].cached and s.got()[5].status == "success"
    s.ask((6, "apples grow on trees", 26))
    s.start()
    assert s.got()[6].cached  # by the answer of hour 25
    rows = stateful.read.format("statestore").option("stateVarName", "entries").load(f"file://{tmp_path}/c1").count()
    assert rows == 1  # the entries of hour 0 are gone from the state


def test_a_running_stream_answers_from_the_newest_index(stateful, tmp_path):
    s = Service(stateful, tmp_path)
    s.know(0, d1="stars shine above the hills at night")
    running = None
    try:
        for qid in (1, 2):
            if qid == 2:
                s.know(1, d2="stars shine above the hills at night and by day over the wide sea")
            s.ask((qid, "stars shine above the hills at night", 30 * qid))
            s.look_up()
            running = running or s.answer(once=False)
            for _ in range(120):
                if (tmp_path / "answers" / f"batch={qid - 1}" / "_SUCCESS").exists():
                    break
                time.sleep(0.5)
        assert running.isActive
    finally:
        running.stop()
    got = s.got()
    assert [x.file for x in got[1].sources] == ["d1"] and [x.file for x in got[2].sources] == ["d2"]
    assert (got[1].index_version, got[2].index_version) == (0, 1) and not got[2].cached


def test_an_empty_index_and_failing_models(spark, tmp_path):
    subs = spark.createDataFrame([("t", "s")], "topic_id string, sub_topic_id string")
    asked = spark.createDataFrame([(1, "ok words", "t"), (2, "fails", "t"), (3, "empty", "t"), (4, "x", "none")], "qid long, query string, topic_id string").selectExpr("*", "cast(array() as array<string>) sub_topics", "cast(array() as array<struct<role:string,text:string>>) history")

    def model(texts):
        if "fails" in texts:
            raise RuntimeError("down")
        return [np.zeros(0) if t == "empty" else np.ones(4) for t in texts]

    chunks, parents = (spark.createDataFrame([], index_store.TABLES[n]) for n in ("chunks", "parents"))
    got = {r.qid: r.status for r in answering.answer_requests(asked, chunks, parents, subs, embed_model=model).collect()}
    assert got == {1: "No Relevant Documents", 2: "AI Service Unavailable", 3: "Embedding Failed", 4: "Configuration Error"}
