"""The Merkle manifest against plain Python and its own SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import merkle, queries

KIND = "doc_id long, text string, lang string, source string, n_chars long, leaf string, place int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row[:5]
    shown = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, None if n_chars is None else n_chars + more, text)]
    return h(*shown)


def tree(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def path(levels, i, arity):
    out = []
    for level in levels[:-1]:
        start = i - i % arity
        out.append(("".join(level[start:i]), "".join(level[i + 1 : start + arity])))
        i //= arity
    return out


def expected(rows, arity=2):
    by = {}
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        by.setdefault(row[2], []).append(row)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([leaf(r) for r in by[x]], arity) for x in langs}
    top = tree([trees[x][-1][0] for x in langs], arity)
    out = []
    for k, x in enumerate(langs):
        for i, row in enumerate(by[x]):
            proof = path(trees[x], i, arity) + path(top, k, arity)
            touched = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node = leaf(row, int(touched))
            for left, right in proof:
                node = h(left, node, right)
            out.append((row[0], leaf(row), trees[x][-1][0], top[-1][0], h(*(a + b for a, b in proof)), node, node == top[-1][0]))
    return sorted(out, key=str)


def sample(n=150):
    rng = random.Random(4)
    rows = [(i if i % 31 else None, rng.choice(["", None, "é\n" * i, "word " * i, "x" * 100_000]), rng.choice([None, "", "en", "en", "en", "é", "zz"]) if i else "lone", rng.choice([None, "a", "b:c"]), rng.choice([None, i, -i]), "clash", 7) for i in range(n)]
    return rows + [rows[5], rows[5], (5, "other", rows[5][2], "a", 1, "clash", 7)]


@pytest.mark.parametrize("block_levels", [1, 3, 10])
def test_manifest_equals_plain_trees(spark, block_levels):
    rows = sample()
    docs = spark.createDataFrame(rows, KIND).repartition(3)
    found = merkle.manifest(merkle.document_leaves(docs), block_levels=block_levels)
    node = F.coalesce(F.lower(F.hex("tampered")), F.col("leaf"))
    got = found.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256), merkle.folded(node, F.col("proof")).alias("f"), F.expr("root")).collect()
    assert sorted(((*r[:6], r[5] == r[3]) for r in got), key=str) == expected(rows)


def test_more_nodes_in_a_run(spark):
    rows = [(i, f"t{i}", "en" if i < 17 else "de", "s", i, "c", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, KIND)
    got = merkle.manifest(merkle.document_leaves(docs), arity=3, block_levels=2).select("leaf", "subroot", "root", merkle.folded(F.col("leaf"), F.col("proof")).alias("f"), merkle.siblings(F.col("proof")).alias("s")).collect()
    want = {(r[1], r[2], r[3], r[4]) for r in expected(rows, 3)}
    assert {(r.leaf, r.subroot, r.root, h(r.s)) for r in got} == want and all(r.f == r.root for r in got)


def test_documents_manifest_of_odd_tables(spark):
    rows = sample(40)
    docs = spark.createDataFrame(rows, KIND)
    got = merkle.documents_manifest(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)
    assert {r.verified for r in got.collect()} == {True, False}
    assert merkle.documents_manifest(docs.where("doc_id < 0")).collect() == []
    lone = merkle.documents_manifest(docs.where("doc_id = 1")).collect()
    assert len(lone) == 1 and lone[0].leaf == lone[0].subroot == lone[0].root and lone[0].proof_sha256 == h("")


def test_query_equals_its_sql(spark):
    where = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{where}/documents.parquet'")
    got = queries.op13_merkle_manifest(spark, where)
    want = db.sql(f"select {', '.join(got.columns)} from ({queries.ORACLE_SQL['op13_merkle_manifest']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 200
