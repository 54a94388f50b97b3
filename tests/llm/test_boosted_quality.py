"""Boosted trees against a plain walk, held-out labels and odd texts."""

import numpy as np

from millrace.llm import boosted_quality, queries

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, good int"


def test_arrays_walk_like_single_trees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 6)).round(1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    trees = boosted_quality.boost(x, y, rounds=30)

    def plain(row):
        total = trees.start
        for statistic, limit, value in zip(trees.statistic, trees.limit, trees.value, strict=True):
            at = 0
            for _ in range(trees.depth):
                at = 2 * at + (2 if row[statistic[at]] > limit[at] else 1)
            total += value[at - len(limit)]
        return 1 / (1 + np.exp(-total))

    scores = trees.scores(x)
    assert np.allclose(scores, [plain(r) for r in x]) and ((scores >= 0.5) == (y == 1)).mean() > 0.98


def test_first_cut_is_the_best_of_all_cuts():
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 20, size=(200, 3)).astype(float), rng.integers(0, 2, size=200).astype(float)
    trees = boosted_quality.boost(x, y, rounds=1, depth=1, bins=64, least=0.0)
    p = (y.sum() + 0.5) / (len(y) + 1)
    g, curve = p - y, p * (1 - p)
    gains = {}
    for f in range(3):
        for cut in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= cut
            gains[f, cut] = sum(g[s].sum() ** 2 / (s.sum() * curve + 1) for s in (left, ~left)) - g.sum() ** 2 / (len(y) * curve + 1)
    assert gains[int(trees.statistic[0, 0]), float(trees.limit[0, 0])] == max(gains.values())


def test_held_out_labels(spark):
    got = queries.op11_boosted_quality(spark, SF)
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality is not None}
    held = [(rows[i].predicted, q) for i, q in labels.items() if rows[i].held_out]
    assert len(held) > 80 and np.mean([p == q for p, q in held]) > 0.97


def test_odd_texts_and_labels(spark):
    words = "the of and to in is that it was for".split()
    clean = [(i, " ".join(words[(i + k * (k + i)) % 10] + "abc"[k % 3] * (k % 4) for k in range(60)), "en", "s", 1, 0.5, 1) for i in range(60)]
    junk = [(100 + i, "$$$ ### " * (20 + i), "en", "s", 1, 0.5, 0) for i in range(60)]
    odd = [(500, None, None, None, None, None, None), (501, "", "en", "s", 0, 0.0, 0), (501, "", "en", "s", 0, 0.0, 0), (None, "é" * 300_000, "xx", "s", 1, 0.0, 0), (502, " \n\t ", "en", "s", 1, 0.0, 1), (503, "the " * 400_000, "en", "s", 1, 0.0, 1)]
    docs = spark.createDataFrame(clean + junk + odd, DOCS)
    rows = [(d[0], d[6]) for d in clean + junk] + [(0, 1), (100, 1), (700, 1), (None, 0)]
    labels = spark.createDataFrame([*rows, (1, None)], "doc_id long, quality int")
    out = boosted_quality.quality_scores(docs, labels).collect()
    assert len(out) == len(clean + junk + odd)
    by = {r.doc_id: r for r in out if r.doc_id not in (None, 501)}
    assert [by[d[0]].predicted for d in clean] == [1] * 60 and [by[d[0]].predicted for d in junk] == [0] * 60
    assert len({r.score for r in out if r.doc_id == 501}) == 1 and all(np.isfinite(r.score) for r in out)
    assert [r.held_out for r in out if r.doc_id is None] == [True]
    none = boosted_quality.quality_scores(docs, labels.where("quality is null")).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.5, 1)}
    one = {r.score for r in boosted_quality.quality_scores(docs, labels.where("quality = 1 and doc_id < 100")).collect()}
    assert len(one) == 1 and 0.9 < one.pop() < 1
    assert boosted_quality.quality_scores(docs.where("doc_id < 0"), labels).collect() == []


def test_junk_inside_a_long_text_shows():
    plain = "some words of a longer text that goes on, " * 2000
    a, b = boosted_quality.statistics(plain), boosted_quality.statistics(plain + "### $$$ *** " * 60)
    names = list(boosted_quality.NAMES)
    assert a[names.index("most_symbol")] == 0 and b[names.index("most_symbol")] > 0.5
    assert len(a) == len(names) and boosted_quality.statistics(None).tolist() == [0.0] * len(names)
