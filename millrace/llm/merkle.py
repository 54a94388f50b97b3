"""Merkle manifest of a dataset: a root over all rows and a proof for each.

Rows become leaves, leaves of a group form a tree in a stated order, and the
groups' roots form a tree in the order of the groups. A level of an aligned
block of leaves is one string of hex digests: parents are hashes of its
fixed-width substrings, and the substrings left and right of a node in its run
are its siblings. The roots of blocks are the leaves of the next blocks, so a
group of any size is never in one task: a block holds at most
arity ** block_levels nodes.

Places come from a table sorted by range: each of its files is a run of the
order, so a row's place is its row index in the file and what came before the
file. Only counts of files and groups are summed for that.

Defined results: a null field is hashed as `-`, an empty text as `0:`; null
groups and null ids come first; rows that repeat an id are ordered by their
leaf, and equal rows are leaves of their own; a lone leaf is its group's root and
has no siblings there; an empty table gives an empty result; texts are hashed
whole, whatever their length, and stay where they are read; further columns of
the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import stored

#: Characters of a hex digest.
WIDTH = 64
#: Rows of a side that is broadcast at most: counts of files, or proofs of blocks (about 2 KB each).
BROADCAST_ROWS = 20_000
PROOF = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex sha256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf(*fields: Column) -> Column:
    """Digest of a row's fields: `-` if null, else length in bytes, `:`, value."""
    texts = [f.cast("string") for f in fields]
    return digest(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def folded(node: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, node, lambda at, step: digest(step["left"], at, step["right"]))


def siblings(proof: Column) -> Column:
    """All siblings of a proof as one string, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


def _checked(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small


def placed(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds place (from 0, inside the group) and total (rows of the group), without a window over a group."""
    keys = [group, *order]
    sorted_ = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys), name)
    at = sorted_.withColumns({"file": F.col("_metadata.file_name"), "row": F.col("_metadata.row_index")})
    runs = at.groupBy("file", group).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("least"))
    # A file is a run of the order: its rows of a group stand together, so there are about as many runs as files.
    w = Window.partitionBy(group)
    before = F.coalesce(F.sum("n").over(w.orderBy("least", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumns({"before": before, "total": F.sum("n").over(w)}).select("file", group, "first", "before", "total")
    runs = stored(runs, f"{name}-runs")
    return at.join(_checked(runs), ["file", group]).withColumn("place", F.col("before") + F.col("row") - F.col("first")).drop("file", "row", "first", "before")


def _raised(level: Column, arity: int) -> Column:
    """The level above: a digest of every run of `arity` nodes; the last run may have fewer."""
    run = arity * WIDTH
    starts = F.sequence(F.lit(0), F.ceil(F.octet_length(level) / run).cast("int") - 1)
    return F.array_join(F.transform(starts, lambda i: F.sha2(F.substring(level, i * run + 1, F.lit(run)), 256)), "").cast("binary")


def _levels(rows: Column, several: Column, arity: int, block_levels: int) -> Column:
    """Strings of a block's levels, lowest first.

    Kept as binary, whose substrings need no walk over characters. A block
    among several of its group is raised block_levels times, a lone one until
    one node is left.
    """
    lowest = F.array_join(F.transform(rows, lambda r: F.lower(F.hex(r["leaf"]))), "").cast("binary")
    more = lambda found: several | (F.octet_length(F.element_at(found, -1)) > WIDTH)
    return F.aggregate(F.sequence(F.lit(1), F.lit(block_levels)), F.array(lowest), lambda found, _: F.when(more(found), F.concat(found, F.array(_raised(F.element_at(found, -1), arity)))).otherwise(found))


def _flanks(levels: Column, at: Column, arity: int) -> Column:
    """The proof of leaf `at` (from 0) inside a block: the rest of its run on each level but the last."""

    def step(level: Column, height: Column) -> Column:
        node = F.floor(at / F.pow(F.lit(arity), height)).cast("int")
        start = node - node % arity
        end = F.least(start + arity, (F.octet_length(level) / WIDTH).cast("int"))
        cut = lambda a, b: F.substring(level, a * WIDTH + 1, (b - a) * WIDTH).cast("string")
        return F.struct(cut(start, node).alias("left"), cut(node + 1, end).alias("right"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), step)


def _climb(nodes: DataFrame, arity: int, block_levels: int, name: str) -> list[DataFrame]:
    """Tables of blocks (tree, block, several, rows, top), lowest first, of nodes (tree, place, total, leaf binary, data).

    Each table's tops are the nodes of the next; a tree ends where it has one block.
    """
    size, tables = arity**block_levels, []
    while True:
        keys = nodes.withColumns({"block": F.floor(F.col("place") / size).cast("long"), "several": F.col("total") > size, "blocks": F.ceil(F.col("total") / size).cast("long")})
        rows = F.array_sort(F.collect_list(F.struct("place", "leaf", "data")))
        blocks = keys.groupBy("tree", "block", "several", "blocks").agg(rows.alias("rows"))
        blocks = blocks.withColumn("top", F.unhex(F.element_at(_levels(F.col("rows"), F.col("several"), arity, block_levels), -1).cast("string")))
        tables.append(stored(blocks, f"{name}-{len(tables)}"))
        above = tables[-1].where("several")
        if above.isEmpty():
            return tables
        nodes = above.select("tree", F.col("block").alias("place"), F.col("blocks").alias("total"), F.col("top").alias("leaf"), F.lit(None).cast("int").alias("data"))


def _ends(tables: list[DataFrame]) -> DataFrame:
    """tree and top of every tree: its one block that has no other beside it."""
    lone = [t.where("not several").select("tree", "top") for t in tables]
    out = lone[0]
    for more in lone[1:]:
        out = out.unionByName(more)
    return out


def _descend(tables: list[DataFrame], beyond: DataFrame | None, arity: int, block_levels: int, name: str) -> DataFrame:
    """tree, end (its root), leaf, data and proof of every lowest node; beyond: tree and upper, the proof of each tree's own root."""
    passed = found = None
    for height in reversed(range(len(tables))):
        upper = tables[height].where("not several").select("tree", "block", F.col("top").alias("end"))
        upper = upper.withColumn("upper", F.array().cast(PROOF)) if beyond is None else upper.join(_checked(beyond), "tree")
        upper = upper if passed is None else passed.unionByName(upper)
        blocks = tables[height].join(_checked(upper), ["tree", "block"]).withColumn("levels", _levels(F.col("rows"), F.col("several"), arity, block_levels))
        node = lambda r, i: F.struct(r["place"].alias("place"), r["leaf"].alias("leaf"), r["data"].alias("data"), F.concat(_flanks(F.col("levels"), i, arity), F.col("upper")).alias("proof"))
        found = blocks.select("tree", "end", F.explode(F.transform("rows", node)).alias("node")).select("tree", "end", "node.*")
        if height:
            passed = stored(found.select("tree", F.col("place").alias("block"), "end", F.col("proof").alias("upper")), f"{name}-proofs-{height}")
    return found.drop("place")


def manifest(rows: DataFrame, group: str = "lang", order: str = "doc_id", arity: int = 2, block_levels: int = 10) -> DataFrame:
    """rows (group, order, leaf, and any more columns) with subroot, root and proof.

    proof lists, from the leaf up to the root, the siblings left and right of
    each node on the way; `folded` leads from leaf and proof to the root.
    """
    kept = [c for c in rows.columns if c != "leaf"]
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))  # null first, no null in joins
    leaves = rows.select(tree.alias("tree"), F.col(order).alias("key"), F.unhex("leaf").alias("leaf"), F.struct(*kept).alias("data"))
    nodes = placed(stored(leaves, "merkle-leaves"), "tree", ["key", "leaf"], "merkle-sorted")
    tables = _climb(nodes, arity, block_levels, "merkle-blocks")
    roots = _ends(tables).select(F.lit("").alias("tree"), F.col("tree").alias("data"), F.col("top").alias("leaf"))
    upper = _climb(placed(roots, "tree", ["data"], "merkle-roots"), arity, block_levels, "merkle-trees")
    beyond = stored(_descend(upper, None, arity, block_levels, "merkle-trees"), "merkle-beyond")
    root = beyond.select("end").first()
    proofs = _descend(tables, beyond.select(F.col("data").alias("tree"), F.col("proof").alias("upper")), arity, block_levels, "merkle-blocks")
    text = lambda c: F.lower(F.hex(c))
    return proofs.select("data.*", text("leaf").alias("leaf"), text("end").alias("subroot"), F.lit(None if root is None else root.end.hex()).cast("string").alias("root"), "proof")


def document_leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf of documents, and tampered: the leaf after one is added to n_chars where 7 divides crc32 of the id, else null."""
    doc_id, n_chars = F.col("doc_id").cast("long"), F.col("n_chars").cast("long")
    whole = lambda n: leaf(doc_id, F.col("source"), F.col("lang"), n, F.col("text"))
    chosen = F.crc32(doc_id.cast("string")) % 7 == 0
    return docs.select(doc_id.alias("doc_id"), F.col("lang").cast("string").alias("lang"), whole(n_chars).alias("leaf"), F.unhex(F.when(chosen, whole(F.try_add(n_chars, F.lit(1))))).alias("tampered"))


def documents_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document."""
    found = manifest(document_leaves(docs))
    node = F.coalesce(F.lower(F.hex("tampered")), F.col("leaf"))
    out = found.withColumns({"proof_sha256": F.sha2(siblings(F.col("proof")), 256), "folded_root": folded(node, F.col("proof"))})
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
