"""The numbered queries: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import ann_graph, boosted_quality, html_region, langid, merkle, mixing, ngram_join, packing, quality, secrets, token_count, toxicity, whitening
from millrace.llm.shared import table

#: Public vocabulary files; the operators take paths as parameters.
WORD_BPE, PIECE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op1_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicate_groups(table(spark, sf_dir, "documents"))


def op3_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann_graph.usable(table(spark, sf_dir, "embeddings"))
    return ann_graph.nearest(vectors, vectors.where(F.col("id") % 100 == 0))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), PIECE_BPE)


def op6_html_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_region.main_text(table(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boosted_quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.documents_manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_divergence, op2_ngram_jaccard, op3_graph_neighbours, op4_best_fit_packing, op5_token_counts, op6_html_region, op7_language_id, op8_secret_scan, op9_source_mixing, op10_toxicity, op11_boosted_quality, op12_lanczos_whitening, op13_merkle_manifest)}
#: SQL where it can say the same: learned models, hashing of shingles and iteration have no form that DuckDB runs on whole tables.
ORACLE_SQL: dict[str, str] = {
    "op13_merkle_manifest": """
with recursive
crc(i, c, k) as (
  select range, range, 0 from range(256)
  union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from crc where k < 8
),
crcs as (select list(c order by i) as t from crc where k = 8),
fields as (
  select doc_id, n_chars, coalesce('=' || lang, '-') as tree,
    coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as head,
    coalesce(strlen(text) || ':' || text, '-') as tail
  from documents
),
leaves as (
  select doc_id, tree, sha256(head || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || tail) as leaf,
    sha256(head || coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1), '-') || tail) as changed,
    coalesce(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0, false) as tampered
  from fields, crcs
),
placed as (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by tree) as n from leaves
),
nodes(tree, lvl, i, h, n) as (
  select tree, 0, i, leaf, n from placed
  union all select tree, lvl + 1, i // 2, sha256(string_agg(h, '' order by i)), (n + 1) // 2 from nodes where n > 1 group by tree, lvl, i // 2, n
),
subroots as (
  select tree, h, row_number() over (order by tree) - 1 as i, count(*) over () as n from nodes where n = 1
),
upper(lvl, i, h, n) as (
  select 0, i, h, n from subroots
  union all select lvl + 1, i // 2, sha256(string_agg(h, '' order by i)), (n + 1) // 2 from upper where n > 1 group by lvl, i // 2, n
),
walk(doc_id, leaf, tree, first, lvl, i, n, node, proof) as (
  select doc_id, leaf, tree, i, 0, i, n, case when tampered then changed else leaf end, '' from placed
  union all
  select w.doc_id, w.leaf, w.tree, w.first, w.lvl + 1, w.i // 2, (w.n + 1) // 2,
    sha256(case when w.i % 2 = 1 then coalesce(s.h, '') || w.node else w.node || coalesce(s.h, '') end), w.proof || coalesce(s.h, '')
  from walk w left join nodes s on s.tree = w.tree and s.lvl = w.lvl and s.i = w.i + 1 - 2 * (w.i % 2)
  where w.n > 1
),
climb(doc_id, leaf, tree, first, subroot, lvl, i, n, node, proof) as (
  select w.doc_id, w.leaf, w.tree, w.first, r.h, 0, r.i, r.n, w.node, w.proof from walk w join subroots r on r.tree = w.tree where w.n = 1
  union all
  select c.doc_id, c.leaf, c.tree, c.first, c.subroot, c.lvl + 1, c.i // 2, (c.n + 1) // 2,
    sha256(case when c.i % 2 = 1 then coalesce(s.h, '') || c.node else c.node || coalesce(s.h, '') end), c.proof || coalesce(s.h, '')
  from climb c left join upper s on s.lvl = c.lvl and s.i = c.i + 1 - 2 * (c.i % 2)
  where c.n > 1
)
select doc_id, leaf, subroot, h as root, sha256(proof) as proof_sha256, node as folded_root, node = h as verified
from climb c, (select h from upper where n = 1) where c.n = 1
""",
}
