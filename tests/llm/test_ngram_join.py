"""The n-gram join: repeated ids, hot keys, sorted intersection."""

import numpy as np

from millrace.llm import ngram_join


def test_rows_that_repeat_an_id_are_one_document(spark):
    rows = [(3, "a b c d e f g"), (3, "q r s t u v w"), (2, "q r s t u v w"), (5, None), (5, "a b c d e f g"), (7, "x"), (None, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.near_duplicate_groups(frame).collect())
    assert got == [(0, 1, None), (2, 3, 2), (3, 3, 2), (3, 3, 2), (5, 0, 2), (5, 3, 2), (7, 1, 7)]


def test_an_id_with_many_texts_joins_all_their_groups(spark):
    rows = [(i, f"t{i} b c d e f g") for i in range(10, 20)] + [(1, f"t{i} b c d e f g") for i in range(10, 20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in ngram_join.near_duplicate_groups(frame).collect()} == {1}


def test_hot_signatures_and_shingles_give_the_same_groups(spark, monkeypatch):
    base = [f"w{k}" for k in range(40)]
    rows = [(i, " ".join(base)) for i in range(0, 40)] + [(i, " ".join([*base, f"x{i}"])) for i in range(40, 80)] + [(i, f"alone {i} b c d e") for i in range(80, 90)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    plain = {r.doc_id: r.component_id for r in ngram_join.near_duplicate_groups(frame).collect()}
    assert plain == {i: 0 if i < 80 else i for i in range(90)}
    found = ngram_join.frequent_shingles
    monkeypatch.setattr(ngram_join, "frequent_shingles", lambda *a: found(*a[:2], 1, 2, a[4], 2))
    split = ngram_join._of_class
    monkeypatch.setattr(ngram_join, "_of_class", lambda rows, classes, hot: split(rows, classes, 5))
    assert {r.doc_id: r.component_id for r in ngram_join.near_duplicate_groups(frame, parts=3).collect()} == plain


def test_sorted_intersection():
    rng = np.random.default_rng(2)
    for _ in range(50):
        x, y = (np.unique(rng.integers(-50, 50, rng.integers(0, 60))) for _ in range(2))
        assert ngram_join.common(x, y) == len(set(x.tolist()) & set(y.tolist()))
