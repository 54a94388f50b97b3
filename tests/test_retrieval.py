import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.functions import splitting, text
from millrace.operators import chat, index, retrieval
from millrace.plans import queries
from millrace.sources import corpus

SF = "/root/testdata/sf0.001"
T = "one two three. four five\nsix seven eight nine ten\n\neleven twelve"
WORDS = splitting.COUNTERS["words"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "events"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted(tuple(map(str, r)) for r in got.select(*cols).collect())
    want = db.sql(f"select {', '.join(cols)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert rows == sorted(tuple(map(str, r)) for r in want)


def test_splitter():
    assert splitting.split_text(T, splitting.PARENT, 6, 0, WORDS) == ["one two three. four five", "six seven eight nine ten", "eleven twelve"]
    assert splitting.split_text(T, splitting.CHILD, 4, 1, WORDS) == ["one two three", ". four five", "six seven eight nine", "nine ten", "eleven twelve"]
    assert splitting.split_text("a b c d e f", splitting.CHILD, 3, 1, WORDS) == ["a b c", "c d e", "e f"]
    assert splitting.split_text("   \n ", splitting.PARENT, 5, 0, WORDS) == []
    assert splitting.split_text("a b", splitting.PARENT, 1, 0, WORDS) == ["a", " b"]
    with pytest.raises(ValueError):
        splitting.split_text("a", splitting.CHILD, 1, 2, WORDS)


def test_markdown():
    md = "intro\n\n# A\n## B\ntext b\n\nmore b\n```\n# not header\n\nx\n```\n## C\nc\n# D\nd\n#nospace"
    assert splitting.markdown_sections(md) == [
        ("intro", {}),
        ("# A  \n## B\ntext b  \nmore b\n```\n# not header\n\nx\n```", {"Header 1": "A", "Header 2": "B"}),
        ("## C\nc", {"Header 1": "A", "Header 2": "C"}),
        ("# D\nd\n#nospace", {"Header 1": "D"}),
    ]


def test_text_functions(spark):
    row = spark.range(1).select(
        text.clean_text(F.lit("foo-\nbar  baz\n"), False).alias("raw"), text.clean_text(F.lit("foo-\nbar  baz\n"), True).alias("md"), text.clean_text(F.lit(None), True).alias("null"),
        text.keywords(F.lit("Alpha, beta. a of Beta")).alias("k"), text.fallback_keywords(F.lit("Alpha, beta. a of Beta")).alias("f"), text.sub_topics_key(F.array(F.lit("b"), F.lit("a"), F.lit("a"))).alias("key"),
        text.linked_files(F.lit('<a href="x.pdf?v=1"> <A HREF=y.PDF> <a href=\'z.html\'>')).alias("links"), text.safe_sigmoid(F.lit(-101.0)).alias("s"), text.source_url(F.lit("b"), F.lit("t"), F.lit(""), F.lit("f")).alias("url"),
    ).first()
    assert (row.raw, row.md, row.null) == ("foobar baz", "foobar  baz", "")
    assert (row.k, row.f) == (["alpha", "beta"], ["alpha,", "beta.", "beta"])
    assert (row.key, row.links, row.s, row.url) == ("a,a,b", ["x.pdf", "y.PDF"], 0.0, "b/t/f")


def test_cuts_and_context(spark):
    scored = spark.createDataFrame([(1, c, x) for c, x in enumerate([2.2, -5.0, -6.0])], "qid long, chunk_id long, logit double")
    assert retrieval.rerank_cut(scored).count() == 2
    two = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "a", "x")], "qid long, rank int, source string, content string")
    assert retrieval.build_context(two, 30).first().n_parents == 1


def test_sources(spark, tmp_path):
    (tmp_path / "t" / "s").mkdir(parents=True)
    (tmp_path / "t" / "s" / "a.txt").write_text("hello\nworld")
    docs = corpus.read_text_docs(spark, str(tmp_path))
    assert [(r.topic_id, r.sub_topic_id, r.rel_path, r.text) for r in docs.collect()] == [("t", "s", "a.txt", "hello\nworld")]
    names = spark.createDataFrame([(n,) for n in ("a.md", "a.MD", "a.log", "urls.txt", "b.PDF", "c.JPG", "d.tif", "a.txt.meta")], "name string")
    out = {r.name: (r.route, r.is_markdown) for r in corpus.route_files(corpus.exclude_artifacts(names, strict=True)).collect()}
    assert out == {"a.MD": ("text", True), "a.log": (None, False), "b.PDF": ("pdf", True), "c.JPG": ("image", True), "d.tif": (None, False)}


def test_replacement_keeps_failed_sources(spark):
    old = spark.createDataFrame([("A", "t", "s", 1), ("B", "t", "s", 2), ("A", "t", "other", 3)], "source string, topic_id string, sub_topic_id string, n int")
    new = spark.createDataFrame([("A", "t", "s", 9)], old.schema)
    assert sorted(r.n for r in index.replace_sources(old, new, new).collect()) == [2, 3, 9]


def test_feedback_pairs(spark):
    turns = spark.createDataFrame([(1, 1, "user", "q1"), (1, 2, "model", "a1"), (1, 3, "error", "e"), (1, 4, "user", "q2"), (1, 5, "model", "a2")], "conv_id long, turn long, role string, text string")
    assert [(r.answer, r.question, r.n_before, r.history) for r in chat.feedback_pairs(turns).orderBy("turn").collect()] == [("a1", "q1", 0, "[]"), ("a2", "q2", 2, '[{"role":"user","text":"q1"},{"role":"model","text":"a1"}]')]
