"""Approximate nearest neighbours on sharded, robust-pruned directed graphs.

Vectors are dealt to shards by hash, each centred and scaled. In a shard a graph is
built in batches: a greedy beam search proposes neighbours of each new vector,
relaxed distance pruning (factor alpha) keeps diverse edges, reverse edges are
added and pruned alike. A query runs a beam search on every shard, and its best
k over all shards are its result, scored on the original vectors in double
precision. The built shards are a stored table with a row for each, so the
index is reread, not rebuilt, if an executor is lost.

Equal vectors are one node; its smallest ids stand for it, which is exact since
ties go to the smaller id.

Defined results: a vector that is null, zero, or holds a null or non-finite
component takes no part, neither as query nor as candidate; vectors are only
held against those of their own length; a null id takes no part; rows that
repeat an id count once for a vector; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import stored


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, v (doubles) of the vectors that take part."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.col("id").isNotNull() & v.isNotNull() & F.coalesce(sound, F.lit(False)))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists of doubles, as rows."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks])
    return flat.to_numpy().reshape(len(column), -1)


class Frame:
    """Where a shard's vectors lie: walks use them centred on the medians and scaled by a median deviation.

    Distances are sums of squared differences in double precision, so neither a
    common shift, nor far clusters, nor single vectors of any finite size cost
    the others their precision. Results are scored on the vectors themselves.
    """

    def __init__(self, v: np.ndarray) -> None:
        self.centre = np.median(v, 0)
        with np.errstate(over="ignore"):
            off = np.nan_to_num(np.abs(v - self.centre)).max(1)
        self.spread = float(np.median(off)) or float(off[off > 0].min(initial=np.inf)) if off.any() else 1.0

    def of(self, v: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = np.nan_to_num((v - self.centre) / self.spread)
        far = np.abs(out).max(1, keepdims=True, initial=0)
        return np.where(far > _FAR, out / np.maximum(far, 1) * _FAR, out)


#: A vector this many spreads away is walked to in its direction at this distance, whose square is finite.
_FAR = 1e140
#: Nodes at which each walk begins: half of them far from each other, so that every far cluster has one, half at random.
ENTRIES = 32


def entries(x: np.ndarray, most: int = ENTRIES) -> np.ndarray:
    """The medoid, nodes each farthest from those before, and random ones."""
    n = len(x)
    found = [int(((x - np.median(x, 0)) ** 2).sum(1).argmin())]
    least = np.full(n, np.inf)
    while len(found) < min(most // 2, n):
        least = np.minimum(least, ((x - x[found[-1]]) ** 2).sum(1))
        found.append(int(least.argmax()))
    more = np.random.default_rng(2).permutation(n)[: most - len(found)]
    return np.unique(np.concatenate([found, more])).astype(np.int32)


def beam_search(x: np.ndarray, links: np.ndarray, starts: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of q the beam nearest nodes that a greedy walk finds, and squared distances.

    links holds -1 where a node has fewer neighbours. All queries walk at once;
    a step opens the nearest unopened node of each beam.
    """
    ids = np.full((len(q), beam), -1, np.int32)
    far = np.full((len(q), beam), np.inf)
    opened = np.ones((len(q), beam), bool)
    first = np.stack([((q - x[s]) ** 2).sum(1) for s in starts], 1)
    order = np.argsort(first, axis=1, kind="stable")[:, :beam]
    ids[:, : order.shape[1]], opened[:, : order.shape[1]] = starts[order], False
    far[:, : order.shape[1]] = np.take_along_axis(first, order, 1)
    seen = np.zeros((len(q), len(x)), bool)
    seen[:, starts] = True
    live = np.arange(len(q))
    while len(live):
        at = np.where(opened[live], np.inf, far[live]).argmin(1)
        opened[live, at] = True
        near = links[ids[live, at]]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        i, j = np.nonzero(fresh)
        if len(i):
            nodes = near[i, j]
            seen[live[i], nodes] = True
            d = np.full(near.shape, np.inf)
            step = x[nodes] - q[live[i]]
            d[i, j] = np.einsum("ij,ij->i", step, step)
            all_far = np.concatenate([far[live], d], 1)
            order = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
            take = lambda a: np.take_along_axis(a, order, 1)
            far[live] = take(all_far)
            ids[live] = take(np.concatenate([ids[live], near], 1))
            opened[live] = take(np.concatenate([opened[live], np.zeros(near.shape, bool)], 1)) | np.isinf(far[live])
        live = live[~opened[live].all(1)]
    order = np.argsort(far, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)


def robust_prune(x: np.ndarray, of: np.ndarray, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to degree diverse neighbours of each node of `of` among its candidates near (-1: none).

    The nearest candidate stays; a later one goes if it is, by the factor
    alpha, nearer to one that stays than to the node.
    """
    near = np.where(near == of[:, None], -1, near)
    y = x[near] - x[of][:, None]  # seen from the node, so that neighbours of a far cluster stay apart
    d = (y * y).sum(2)
    d[near < 0] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    near, d, y = np.take_along_axis(near, order, 1), np.take_along_axis(d, order, 1), np.take_along_axis(y, order[:, :, None], 1)
    d[:, 1:][(near[:, 1:] == near[:, :-1])] = np.inf
    out = np.full((len(of), degree), -1, np.int32)
    rows = np.arange(len(of))
    y2 = np.einsum("ijk,ijk->ij", y, y)
    for k in range(degree):
        at = d.argmin(1)
        good = np.isfinite(d[rows, at])
        if not good.any():
            break
        out[good, k] = near[good, at[good]]
        between = y2 + y2[rows, at][:, None] - 2 * (y @ y[rows, at][:, :, None])[:, :, 0]
        d[(alpha * alpha) * between <= d] = np.inf
        d[rows, at] = np.inf
    return out


def build_graph(x: np.ndarray, degree: int, beam: int, alpha: float, batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Links (-1: none) and entry nodes of the graph over the rows of x."""
    n = len(x)
    starts = entries(x)
    links = np.full((n, degree), -1, np.int32)
    order = np.random.default_rng(1).permutation(n).astype(np.int32)
    order = np.concatenate([starts, order[~np.isin(order, starts)]]).astype(np.int32)
    done = len(starts)
    if done > 1:  # the entries know each other
        links[starts] = robust_prune(x, starts, np.tile(starts, (done, 1)), degree, alpha)
    while done < n:
        new = order[done : done + min(batch, max(1, done))]
        found, _ = beam_search(x, links, starts, x[new], beam)
        links[new] = robust_prune(x, new, found, degree, alpha)
        source = np.repeat(new, degree)
        target = links[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        for size in (degree, int(count.max(initial=0))):  # the common small case apart from crowded nodes
            part = (count <= degree) if size == degree else (count > degree)
            if not part.any():
                continue
            of, f, c = nodes[part], first[part], count[part]
            back = np.full((len(of), size), -1, np.int32)
            rows = np.repeat(np.arange(len(of)), c)
            cols = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            back[rows, cols] = source[np.repeat(f, c) + cols]
            both = np.concatenate([links[of], back], 1)
            room = (both >= 0).sum(1) <= degree
            if room.any():
                links[of[room]] = np.take_along_axis(both[room], np.argsort(both[room] < 0, axis=1, kind="stable")[:, :degree], 1)
            if (~room).any():
                links[of[~room]] = robust_prune(x, of[~room], both[~room], degree, alpha)
        done += len(new)
    return links, starts


def _build(degree: int, beam: int, alpha: float):
    def run(key: tuple[pa.Scalar, ...], data: pa.Table) -> pa.Table:
        v = matrix(data.column("v"))
        links, starts = build_graph(Frame(v).of(v), min(degree, max(1, len(v) - 1)), beam, alpha)
        return pa.table({"dim": pa.array([v.shape[1]], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), "n": pa.array([len(v)], pa.int32()), "starts": pa.array([starts.tobytes()], pa.binary()), "vectors": pa.array([v.tobytes()], pa.binary()), "links": pa.array([links.tobytes()], pa.binary()), "ids": pa.array([data.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64())))})

    return run


_INDEX = "dim int, shard int, n int, starts binary, vectors binary, links binary, ids array<array<long>>"


def build_index(vectors: DataFrame, k: int = 10, shard_rows: int | None = None, shard_bytes: int = 128 << 20, degree: int = 24, build_beam: int = 48, alpha: float = 1.2) -> DataFrame:
    """The stored shards over usable() vectors. A node keeps its k + 1 smallest ids.

    shard_rows: by default a 64th of the nodes, at least 4,096 and at most what
    shard_bytes of vectors hold, so that shards grow with the table first and
    only then in number.
    """
    ranked = vectors.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("rank") <= k + 1)
    nodes = stored(ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "nodes")
    n, dims = nodes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    shards = max(1, -(-n // (shard_rows or max(1, min(shard_bytes // (8 * (dims or 1)), max(4096, n // 64))))))
    keyed = nodes.select(F.size("v").alias("dim"), F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.lit(shards)).cast("int").alias("shard"), "v", "ids").repartition(4 * shards, "dim", "shard")
    return stored(keyed.groupBy("dim", "shard").applyInArrow(_build(degree, build_beam, alpha), _INDEX), "index")


def _search(k: int, beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                v = np.frombuffer(row["vectors"]).reshape(row["n"], row["dim"])
                links = np.frombuffer(row["links"], np.int32).reshape(row["n"], -1)
                q = np.frombuffer(row["queries"]).reshape(-1, row["dim"])
                frame, starts = Frame(v), np.frombuffer(row["starts"], np.int32)
                x = frame.of(v)
                out = []
                for at in range(0, len(q), 512):
                    part = q[at : at + 512]
                    found, far = beam_search(x, links, starts, frame.of(part), beam)
                    for i, qid in enumerate(row["query_ids"][at : at + 512]):
                        near = found[i][np.isfinite(far[i])]
                        exact = np.sqrt(((v[near] - part[i]) ** 2).sum(1))
                        got = sorted((s, m) for s, node in zip(exact.tolist(), near.tolist(), strict=True) for m in row["ids"][node] if m != qid)
                        out += [(qid, m, s) for s, m in got[:k]]
                if out:
                    a, b, c = zip(*out, strict=True)
                    yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def _pack(key: tuple[pa.Scalar, ...], data: pa.Table) -> pa.Table:
    v = matrix(data.column("v"))
    return pa.table({"dim": pa.array([v.shape[1]], pa.int32()), "queries": pa.array([v.tobytes()], pa.binary()), "query_ids": pa.array([data.column("id").to_pylist()], pa.list_(pa.int64()))})


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, query_rows: int = 2048, beam: int = 80, index: DataFrame | None = None, **build) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest that the graphs give each query.

    Both inputs have id and v, as usable() returns them. Queries travel in
    packed blocks of about query_rows, and each block visits every shard once.
    """
    index = build_index(vectors, k, **build) if index is None else index
    blocks = max(1, -(-queries.count() // query_rows))
    packed = queries.groupBy(F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).applyInArrow(_pack, "dim int, queries binary, query_ids array<long>")
    count = max(1, index.select("shard").distinct().count())
    visits = stored(packed, "queries").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).repartition(4 * count, "dim", "shard")
    found = index.join(visits, ["dim", "shard"]).mapInArrow(_search(k, beam), "query_id long, vec_id long, score double")
    ranked = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
