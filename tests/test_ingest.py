"""Ingest of files into the index, in batches, and the versions of the index."""

import os
from urllib.parse import unquote

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import models
from millrace.operators import answering
from millrace.sources import corpus, index_store
from millrace.streaming import ingest

SUBS = "topic_id string, sub_topic_id string, description string, chunk_size int, chunk_overlap int, parent_chunk_size int"


def put(root, topic, sub, name, content):
    folder = root / topic / sub
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).parent.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(content if isinstance(content, bytes) else content.encode())


class Corpus:
    def __init__(self, spark, tmp_path, **hooks):
        self.spark, self.root, self.index, self.outcomes = spark, tmp_path / "watch", f"file://{tmp_path}/index", f"file://{tmp_path}/outcomes"
        self.checkpoint, self.disk, self.hooks = f"file://{tmp_path}/checkpoint", tmp_path / "index", hooks
        self.subs = spark.createDataFrame([("t", "s", "", 100, 20, 400), ("t", "other", "", 100, 0, 400), ("u", "s", "", 5, 9, 10)], SUBS)

    def run(self):
        query = ingest.ingest_stream(self.spark, f"file://{self.root}", self.subs, self.index, self.outcomes, self.checkpoint, **self.hooks)
        assert query.awaitTermination(180)

    def chunks(self):
        return {(r.sub_topic_id, r.source): r.content for r in index_store.read_index(self.spark, self.index)[0].collect()}

    def messages(self):
        return {(unquote(os.path.basename(r.path)), r.message) for r in self.spark.read.parquet(self.outcomes).collect()}


def test_two_drops_are_answered_from_the_index_alone(spark, tmp_path):
    c = Corpus(spark, tmp_path)
    put(c.root, "t", "s", "a.txt", "apples grow on trees in the garden")
    put(c.root, "t", "s", "b.MD", "# H\nrivers run to the sea")
    c.run()
    put(c.root, "t", "other", "new/c d%.TXT", "stars shine at night\r\nabove the hills")
    c.run()
    assert set(c.chunks()) == {("s", "a.txt"), ("s", "b.MD"), ("other", "new/c d%.TXT")}
    assert c.chunks()["other", "new/c d%.TXT"] == "stars shine at night\nabove the hills"
    chunks, parents = index_store.read_index(spark, c.index)
    assert chunks.where("embedding is null").count() == 0 and {r.source: r.headers for r in parents.collect()}["b.MD"] == {"Header 1": "H"}
    posted, counts = (index_store.read_table(spark, c.index, name) for name in ("postings", "terms"))
    assert {(r.sub_topic_id, r.n) for r in counts.where("token = 'the'").collect()} == {("s", 2), ("other", 1)} and posted.where("token = 'apples'").join(chunks, "chunk_id").count() == 1
    assert {(r.artifact_name, r.text) for r in index_store.read_table(spark, c.index, "artifacts").collect()} == {("a.txt.ocr", "apples grow on trees in the garden"), ("b.MD.md", "# H\nrivers run to the sea"), ("new/c d%.TXT.ocr", "stars shine at night\nabove the hills")}
    asked = spark.createDataFrame([(1, "apples in the garden", "t"), (2, "stars shine at night", "t")], "qid long, query string, topic_id string").withColumns({"sub_topics": F.array().cast("array<string>"), "history": F.array().cast("array<struct<role:string,text:string>>")})
    got = {r.qid: r for r in answering.answer_requests(asked, chunks, parents, c.subs, min_score=0.3).collect()}
    assert got[1].sources[0].file == "a.txt" and got[2].sources[0].file == "new/c d%.TXT" and {r.status for r in got.values()} == {"success"}


def test_untouched_partitions_keep_their_files_and_a_rerun_changes_nothing(spark, tmp_path):
    c = Corpus(spark, tmp_path)
    put(c.root, "t", "s", "a.txt", "first")
    put(c.root, "t", "other", "b.txt", "second")
    c.run()
    of = lambda sub: {r.f for r in index_store.read_index(spark, c.index)[0].where(F.col("sub_topic_id") == sub).select(F.input_file_name().alias("f")).collect()}
    kept, replaced = of("s"), of("other")
    put(c.root, "t", "other", "b2.txt", "third")
    c.run()
    assert of("s") == kept and not of("other") & replaced
    files = sorted(str(p) for p in c.disk.rglob("*.parquet"))
    batch = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"file://{c.root}/t/other")
    ingest.Ingest(f"file://{c.root}", c.subs, c.index, c.outcomes, c.checkpoint)(batch, 1)
    assert sorted(str(p) for p in c.disk.rglob("*.parquet")) == files and len(c.chunks()) == 3


def test_every_file_is_indexed_or_rejected_with_its_reason(spark, tmp_path):
    def fragile(texts):
        if any("poison" in x for x in texts):
            raise RuntimeError("cannot embed")
        return models.hashed_embedding(texts)

    c = Corpus(spark, tmp_path, embed_model=fragile)
    put(c.root, "t", "s", "good.txt", "fine words")
    put(c.root, "t", "s", "poison.txt", "old words")
    put(c.root, "t", "s", "bytes.txt", b"\xff\xfe\xfa")
    put(c.root, "t", "s", "log.xyz", "unknown kind")
    put(c.root, "t", "s", "scan.pdf", b"%PDF")
    put(c.root, "t", "none", "c.txt", "no configuration")
    put(c.root, "u", "s", "sizes.txt", "overlap over size")
    put(c.root, "t", "", "shallow.txt", "too high up")
    c.run()
    reasons = {("good.txt", None), ("poison.txt", None), ("bytes.txt", ingest.NO_TEXT), ("log.xyz", ingest.NO_TEXT), ("scan.pdf", ingest.NO_TEXT), ("c.txt", ingest.NO_CONFIG), ("sizes.txt", ingest.BAD_SIZES), ("shallow.txt", ingest.NO_PLACE)}
    assert c.messages() == reasons
    assert set(c.chunks()) == {("s", "good.txt"), ("s", "poison.txt")}
    put(c.root, "t", "s", "more.txt", "more fine words")
    put(c.root, "t", "s", "poison.txt.meta", "")
    put(c.root, "t", "s", "sub/poison.txt", "poison here")
    put(c.root, "t", "s", "sub/poison.txt.meta", "poison.txt")
    c.run()
    assert c.messages() - reasons == {("more.txt", None), ("poison.txt", ingest.NOT_EMBEDDED)}
    assert c.chunks() == {("s", "good.txt"): "fine words", ("s", "poison.txt"): "old words", ("s", "more.txt"): "more fine words"}
    assert {r.message for r in ingest.rejects(spark, c.outcomes).collect()} == {m for _, m in c.messages() if m}


@pytest.mark.parametrize("order", ["with", "before", "after"])
def test_sidecars_name_sources_whenever_they_come(spark, tmp_path, order):
    url = "https://example.org/page"
    c = Corpus(spark, tmp_path)
    put(c.root, "t", "s", "other.txt", "another")
    if order != "after":
        put(c.root, "t", "s", "w.txt.meta", f" {url}\n")
    if order == "before":
        c.run()
    put(c.root, "t", "s", "w.txt", "saved page")
    c.run()
    if order == "after":
        assert ("s", "w.txt") in c.chunks()
        put(c.root, "t", "s", "w.txt.meta", url)
        c.run()
    assert c.chunks() == {("s", "other.txt"): "another", ("s", url): "saved page"}
    put(c.root, "t", "s", "w2.txt", "saved again")
    put(c.root, "t", "s", "w2.txt.meta", url)
    c.run()
    assert c.chunks() == {("s", "other.txt"): "another", ("s", url): "saved again"}
    assert {r.source for r in index_store.read_index(spark, c.index)[1].collect()} == {"other.txt", url}


def test_newest_of_equal_sources_in_a_batch(spark, tmp_path):
    c = Corpus(spark, tmp_path)
    for i, name in enumerate(("x.txt", "y.txt")):
        put(c.root, "t", "s", name, f"text {name}")
        put(c.root, "t", "s", f"{name}.meta", "https://e.org")
        os.utime(c.root / "t" / "s" / name, (1_000_000 + i, 1_000_000 + i))
    c.run()
    assert c.chunks() == {("s", "https://e.org"): "text y.txt"} and c.messages() == {("x.txt", ingest.OLDER), ("y.txt", None)}


def test_pages_and_images_reach_the_index_in_order(spark, tmp_path):
    def pages(files):
        """A made-up format: pages parted by form feeds; a page of `*` and bytes is an image."""
        out = []
        for raw in files:
            if raw.startswith(b"broken"):
                raise ValueError("unreadable")
            out.append([("", p[1:]) if p.startswith(b"*") else (p.decode(), None) for p in raw.split(b"\f")])
        return out

    def read(images):
        if images[0] == b"dark":
            raise ValueError("nothing seen")
        return [f"seen {x.decode()}" for x in images]

    c = Corpus(spark, tmp_path, pages_model=pages, ocr_model=read)
    long = "a page whose own text is long enough to be taken as it stands"
    put(c.root, "t", "s", "mixed.PDF", f"{long}\f*two\f{long} too".encode())
    put(c.root, "t", "s", "dark.pdf", b"*one\f*dark")
    put(c.root, "t", "s", "broken.pdf", b"broken")
    put(c.root, "t", "s", "photo.JPG", b"three")
    c.run()
    text = c.chunks()["s", "mixed.PDF"]
    assert text.index("as it stands") < text.index("seen two") < text.index("stands too") and c.chunks()["s", "photo.JPG"] == "seen three"
    assert c.messages() == {("mixed.PDF", None), ("photo.JPG", None), ("dark.pdf", ingest.NO_TEXT), ("broken.pdf", ingest.NO_TEXT)}


def test_disk_stays_bounded_and_readers_keep_their_version(spark, tmp_path):
    c = Corpus(spark, tmp_path)
    put(c.root, "t", "other", "still.txt", "never touched")
    put(c.root, "t", "s", "a.txt", "text 0")
    c.run()
    sizes = []
    with index_store.pinned(spark, c.index) as version:
        held = index_store.read_index(spark, c.index, version)[0]
        for i in range(1, 4):
            put(c.root, "t", "s", f"a{i}.txt", f"text {i}")
            put(c.root, "t", "s", f"a{i}.txt.meta", "a.txt")
            c.run()
        assert {r.content for r in held.collect()} == {"never touched", "text 0"} and index_store.versions(spark, c.index) == [0, 2, 3]
    for i in range(4, 6):
        put(c.root, "t", "s", f"a{i}.txt", f"text {i}")
        put(c.root, "t", "s", f"a{i}.txt.meta", "a.txt")
        c.run()
        sizes.append(len(list((c.disk / "chunks").rglob("*.parquet"))))
    assert index_store.versions(spark, c.index) == [4, 5] and len(set(sizes)) == 1
    assert c.chunks() == {("other", "still.txt"): "never touched", ("s", "a.txt"): "text 5"}
    index_store.sweep(spark, c.index, keep=1)
    assert index_store.versions(spark, c.index) == [5] and len(c.chunks()) == 2


def test_versions_of_partitions(spark, tmp_path):
    index = f"file://{tmp_path}/index"
    row = lambda topic, sub, source, n: (f"{source}{n}", "p", topic, sub, source, n, f"c{n}", [1.0])
    frame = lambda rows: spark.createDataFrame(rows, index_store.TABLES["chunks"])
    assert index_store.read_index(spark, index) is None and index_store.read_table(spark, index, "chunks").count() == 0
    odd = ("a=b:c/é", "1")
    assert index_store.write_version(spark, index, {"chunks": (frame([row(*odd, "x", 0), row("t", "2", "y", 0)]), {odd, ("t", "2")})}, "w", 0) == 0
    assert index_store.write_version(spark, index, {"chunks": (frame([row(*odd, "x", 1)]), {odd})}, "w", 1) == 1
    assert index_store.write_version(spark, index, {"chunks": (frame([]), {odd})}, "w", 1) == 1
    got = lambda v=None, only=None: sorted((r.topic_id, r.sub_topic_id, r.child_index) for r in index_store.read_table(spark, index, "chunks", v, only).collect())
    assert got() == [(*odd, 1), ("t", "2", 0)] and got(0) == [(*odd, 0), ("t", "2", 0)] and got(None, {odd}) == [(*odd, 1)]
    assert index_store.write_version(spark, index, {"chunks": (frame([]), {odd})}, "w", 2) == 2 and got() == [("t", "2", 0)]
    with pytest.raises(ValueError, match="embedding"):
        index_store.write_version(spark, index, {"chunks": (frame([]).drop("embedding"), {odd})}, "w", 3)


def test_models_load_once_in_a_worker(spark, tmp_path):
    log = str(tmp_path / "loads")

    def factory():
        import os

        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda texts: np.ones((len(texts), 2))

    model = models.Loaded("ones", factory)
    frame = spark.range(400).repartition(8)
    for _ in range(3):
        assert frame.select(models.embed(F.col("id").cast("string"), model, 10).alias("v")).where("v[1] = 1").count() == 400
    loads = open(log).read().split()
    assert 1 <= len(loads) == len(set(loads)) <= 8


def test_one_bad_text_fails_alone(spark):
    def model(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return models.hashed_embedding(texts)

    rows = spark.createDataFrame([(i, "bad" if i == 7 else f"t{i}") for i in range(60)], "i int, t string").coalesce(1)
    assert [r.i for r in rows.where(models.embed(F.col("t"), model).isNull()).collect()] == [7]


def test_text_docs_of_any_case(spark, tmp_path):
    for name, content in (("README.MD", "a"), ("b.Txt", "b"), ("c d.txt", "c\rd"), ("x.log", "x")):
        put(tmp_path, "t", "s", name, content)
    got = {(r.name, r.text) for r in corpus.read_text_docs(spark, str(tmp_path)).collect()}
    assert got == {("README.MD", "a"), ("b.Txt", "b"), ("c d.txt", "c\nd")}
