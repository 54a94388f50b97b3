"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Vectors become whole numbers, x = floor(64 c) + 1000000 for each entry c. The
centred matrix X is reduced to an upper bidiagonal one by products Xv and X'u,
with full reorthogonalisation on both sides; the singular values and right
singular vectors of the small bidiagonal matrix give the components and their
deviations.

The left vectors, as long as the table, are never stored: each is X p for a
short vector p, so a scan makes u = X p block by block, and X'u, u'u and the
overlaps of u with all earlier left vectors in the same pass. What leaves a task
is three short vectors; they are added in Spark, and the driver holds as many
short vectors as there were steps, at most as many as there are dimensions. A
step is thus one scan of the packed rows (8 bytes an entry).

Steps end when the wanted components have converged and what is left of the
trace is too small to hide another one, or when the steps span all dimensions.
An exhausted direction, as with vectors of low rank or equal deviations, is
followed by a new one at random, orthogonal to all before.

Defined results: null vectors, and those with null or non-finite entries, are
dropped, as are empty ones; if lengths differ, the most frequent length stays
(the longer of equal ones) and other rows are dropped, since they have no place
in one covariance; an entry whose x is beyond 2**53 counts as that bound, with
its sign; a null id stays null; repeated rows count and are returned each; a
component whose deviation is zero, to rounding (1e-12 of the largest), is not
returned, as nothing can be divided by it; an exact `deviation` beyond a long is
null; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import give_back, slices, stored

BOUND = 1 << 53
#: An entry is split here, so that sums of a task stay in 64 bits.
_SPLIT = 27


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists as doubles, null as NaN, and the lists' lengths (null: 0)."""
    lengths = np.nan_to_num(np.array(column.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), lengths


def whole(values: np.ndarray) -> np.ndarray:
    """floor(64 c) + 1000000 as a long, inside the bound."""
    return np.clip(np.floor(64 * values) + 1_000_000, -BOUND, BOUND).astype(np.int64)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors as blocks of one length: ids, their matrix in bytes, sums of its columns in two parts."""
    for batch in batches:
        values, lengths = _flat(batch.column("embedding"))
        starts = np.cumsum(lengths) - lengths
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
        fine = (lengths > 0) & (bad[starts + lengths] == bad[starts])
        for size in np.unique(lengths[fine]):
            at = np.flatnonzero(fine & (lengths == size))
            step = max(1, (4 << 20) // (8 * int(size)))
            for part in (at[i : i + step] for i in range(0, len(at), step)):
                x = whole(values[starts[part][:, None] + np.arange(size)])
                high, low = (x >> _SPLIT).sum(0), (x & ((1 << _SPLIT) - 1)).sum(0)
                yield pa.record_batch([pa.array([size], pa.int32()), pa.array([len(part)], pa.int64()), pa.array([batch.column("id").take(pa.array(part)).to_pylist()], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary()), pa.array([high], pa.list_(pa.int64())), pa.array([low], pa.list_(pa.int64()))], names=["size", "n", "ids", "x", "high", "low"])
    give_back()


class Table:
    """Packed vectors in the shared folder, with their number and exact sums by dimension."""

    def __init__(self, vectors: DataFrame) -> None:
        kind = "size int, n long, ids array<long>, x binary, high array<long>, low array<long>"
        self.blocks = stored(vectors.mapInArrow(_pack, kind), "whitening")
        sizes = self.blocks.groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
        self.size, self.n = (0, 0) if sizes is None else (sizes["size"], sizes.n)
        self.blocks = self.blocks.where(F.col("size") == self.size)
        parts = {}
        for name in ("high", "low"):
            rows = self.blocks.select(F.posexplode(name).alias("i", "s")).groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
            parts[name] = {r.i: int(r.s) for r in rows.collect()}
        self.sums = [(parts["high"][i] << _SPLIT) + parts["low"][i] for i in range(self.size)]
        self.base = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = np.array([s % self.n / self.n for s in self.sums])

    def centred(self) -> Callable[[bytes], np.ndarray]:
        """x - S/n in double: the whole part is taken off before anything is rounded."""
        size, base, rest = self.size, self.base, self.rest
        return lambda raw: (np.frombuffer(raw, np.int64).reshape(-1, size) - base).astype(float) - rest

    def summed(self, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Sum over all blocks of a short vector made from each block's centred matrix."""
        centred = self.centred()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in slices(batches, 16):
                for raw in batch.column("x"):
                    part = of(centred(raw.as_buffer()))
                    total = part if total is None else total + part
            if total is not None:
                yield pa.record_batch({"i": pa.array(np.arange(len(total), dtype=np.int32)), "s": pa.array(total)})

        rows = self.blocks.select("x").mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).toArrow()
        out = np.zeros(rows.num_rows)
        out[rows.column("i").to_numpy()] = rows.column("s").to_numpy()
        return out


def _orthogonal(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """v without its parts in the basis (columns), taken off twice."""
    for _ in range(2):
        v = v - basis @ (basis.T @ v)
    return v


def components(table: Table, wanted: int = 32, seed: int = 12, tolerance: float = 1e-13) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of the covariance, at most `wanted`, and its trace."""
    d, n = table.size, table.n
    rng = np.random.default_rng(seed)
    squares = table.summed(lambda x: (x * x).sum(0))
    trace = float(squares.sum()) / n
    if trace == 0:
        return np.zeros(0), np.zeros((d, 0)), 0.0
    scale = np.sqrt(squares.sum())
    right = np.zeros((d, 0))  # v, orthonormal
    short = np.zeros((d, 0))  # p: u = X p, orthonormal in u
    back = np.zeros((d, 0))  # X'u
    small = np.zeros((d, d))  # bidiagonal
    v, beta = rng.normal(size=d), 0.0
    v /= np.linalg.norm(v)
    k = min(wanted, d)
    for j in range(d):
        p = v - (beta * short[:, -1] if j else 0)
        seen = short
        got = table.summed(lambda x, p=p, seen=seen: (lambda u, earlier: np.concatenate([x.T @ u, earlier.T @ u, [u @ u]]))(x @ p, x @ seen))
        z, overlap, square = got[:d], got[d:-1], got[-1]
        # Full reorthogonalisation of u: its parts in earlier left vectors go, in p and in X'u alike.
        p, z = p - short @ overlap, z - back @ overlap
        alpha = np.sqrt(max(0.0, square - overlap @ overlap))
        right = np.column_stack([right, v])
        if alpha > tolerance * scale:
            short, back = np.column_stack([short, p / alpha]), np.column_stack([back, z / alpha])
        else:
            alpha = 0.0
            short, back = np.column_stack([short, np.zeros(d)]), np.column_stack([back, np.zeros(d)])
        small[j, j] = alpha
        if j:
            small[j - 1, j] = beta
        left, sigma, turn = np.linalg.svd(small[: j + 1, : j + 1])
        w = _orthogonal(back[:, -1], right)
        beta = float(np.linalg.norm(w))
        hidden = trace - float((sigma**2).sum()) / n
        if j + 1 >= k and hidden < 0.5 * sigma[k - 1] ** 2 / n and beta * np.abs(left[-1, :k]).max() <= tolerance * sigma[k - 1]:
            break
        if j + 1 == d:
            break
        if beta <= tolerance * scale:
            w, beta = _orthogonal(rng.normal(size=d), right), 0.0
            v = w / np.linalg.norm(w)
        else:
            v = w / beta
        v = _orthogonal(v, right)
        v /= np.linalg.norm(v)
    values, vectors = sigma[:k] ** 2 / n, right @ turn[:k].T
    live = sigma[:k] > 1e-12 * sigma[0]
    vectors = vectors[:, live]
    vectors = vectors / np.linalg.norm(vectors, axis=0) * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1, 1)
    return values[live], vectors, trace


def _deviations(x: np.ndarray, sums: list[int], n: int) -> list[int | None]:
    """Exact sum over dimensions of (n x - S) squared; null beyond a long."""
    most = max(max(abs(n * int(a) - s), abs(n * int(b) - s)) for a, b, s in zip(x.min(0), x.max(0), sums, strict=True))
    if most**2 * len(sums) < 1 << 63 and n * int(np.abs(x).max()) < 1 << 63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    found = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return [f if f < 1 << 63 else None for f in found]


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, id_col: str = "vec_id", wanted: int = 32) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of every usable vector and component."""
    table = Table(vectors.select(F.col(id_col).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")))
    if not table.n:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    values, axes, trace = components(table, wanted)
    k, n, size, sums, centred = len(values), table.n, table.size, table.sums, table.centred()
    turn = axes / np.sqrt(values)
    error = float(np.abs(table.summed(lambda x: ((x @ turn).T @ (x @ turn)).ravel()).reshape(k, k) / n - np.eye(k)).max()) if k else 0.0
    explained = values / trace if k else values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for ids, raw in zip(batch.column("ids"), batch.column("x"), strict=True):
                buffer = raw.as_buffer()
                x = np.frombuffer(buffer, np.int64).reshape(-1, size)
                far = pa.array(_deviations(x, sums, n), pa.int64())
                for at in range(0, len(x), 2048):
                    part = centred(buffer[at * size * 8 : (at + 2048) * size * 8]) @ turn
                    rows = pa.array(np.repeat(np.arange(at, at + len(part)), k))
                    m = len(rows)
                    yield pa.record_batch([ids.values.take(rows), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))), pa.array(np.full(m, n)), far.take(rows), pa.array(part.ravel()), pa.array(np.tile(explained, len(part))), pa.array(np.full(m, error))], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
        give_back()

    return table.blocks.select("ids", "x").mapInArrow(run, SCHEMA)
