"""The neighbour graph on shifted, huge and odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import ann_graph


def table(spark, x):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")


@pytest.mark.parametrize(("scale", "shift"), [(1.0, 1e4), (1e20, 0.0), (1e-12, 5.0), (1.0, 0.0)])
def test_recall_does_not_depend_on_where_vectors_lie(spark, scale, shift):
    x = np.random.default_rng(4).normal(size=(900, 32)) * scale + shift
    v = ann_graph.usable(table(spark, x))
    got = {}
    for r in ann_graph.nearest(v, v.where("id % 30 = 0"), shard_rows=400).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
        assert r.score == float(np.sqrt(((x[r.query_id] - x[r.vec_id]) ** 2).sum()))
    hits = []
    for q, found in got.items():
        far = ((x - x[q]) ** 2).sum(1)
        far[q] = np.inf
        hits.append(len(found & set(np.argsort(far, kind="stable")[:10].tolist())) / 10)
    assert len(got) == 30 and np.mean(hits) >= 0.9


@pytest.mark.parametrize("kind", ["outlier", "huge", "halves", "clusters"])
def test_recall_with_outliers_and_far_clusters(spark, kind):
    x = np.random.default_rng(7).normal(size=(2000, 32))
    if kind in ("outlier", "huge"):
        x[1] = 1e12 if kind == "outlier" else 1e300
    elif kind == "halves":
        x[1000:] += 1e7
    else:
        x += np.repeat(np.random.default_rng(8).normal(size=(10, 32)) * 1e7, 200, 0)
    v = ann_graph.usable(table(spark, x))
    got = {}
    for r in ann_graph.nearest(v, v.where("id % 50 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for q, found in got.items():
        with np.errstate(over="ignore"):
            far = ((x - x[q]) ** 2).sum(1)
        far[q] = np.inf
        hits.append(len(found & set(np.argsort(far, kind="stable")[:10].tolist())) / 10)
    assert len(got) == 40 and np.mean(hits) >= 0.9


def test_empty_repeated_and_extra(spark):
    x = np.random.default_rng(5).normal(size=(60, 4))
    frame = table(spark, x).withColumn("id", F.lit("clash")).withColumn("v", F.lit(1))
    v = ann_graph.usable(frame.unionByName(frame))
    once, twice = (ann_graph.nearest(ann_graph.usable(f), ann_graph.usable(f).where("id % 20 = 0")) for f in (frame, frame.unionByName(frame)))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) and once.count() == 30
    none = v.limit(0)
    assert ann_graph.nearest(none, none).count() == 0 and ann_graph.nearest(v, none).count() == 0
