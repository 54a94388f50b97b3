"""Exact nearest vectors inside a topic, many questions at a time.

Vectors are packed into blocks, a topic and a length each; blocks of questions
meet blocks of candidates by a join on both, and numpy takes the first k of
every question in a pair of blocks. So candidates are scanned once whatever the
number of questions, nothing comes to the driver, and a task holds the first k of
each question over all blocks that it meets and sends these on at its end. Tasks
are TASKS for each core at most, so what is shuffled grows with the questions and
not with their product with the files of candidates.

Questions are broadcast while their vectors fit `broadcast_bytes`. More of them
are dealt to salted topics, so that a topic with a third of all rows is many
tasks.

No hits: vectors that are null, of no length or with null or non-finite
entries, those of another length than the question's, null topics, and,
where a question selects sub-topics, candidates of none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of vectors in a block, of either side.
BLOCK_BYTES = 2 << 20
#: Tasks a core that scan candidates, and hits that a task holds before it sends them on.
TASKS = 2
MOST_HELD = 2_000_000


def _packed(rows: DataFrame, key: str, scope: str, kind: str) -> DataFrame:
    """topic, size, keys, scopes, vectors (unit length, doubles): blocks of rows (topic, key, scope, embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding")
            values = vectors.flatten().to_numpy(zero_copy_only=False)
            lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.cumsum(lengths) - lengths
            topics = batch.column("topic").dictionary_encode()
            codes = topics.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for code in np.unique(codes[codes >= 0]):
                for size in np.unique(lengths[(codes == code) & (lengths > 0)]):
                    at = np.flatnonzero((codes == code) & (lengths == size))
                    step = max(1, BLOCK_BYTES // (8 * int(size)))
                    for part in (at[i : i + step] for i in range(0, len(at), step)):
                        block = values[starts[part][:, None] + np.arange(size)]
                        norms = np.linalg.norm(block, axis=1)
                        fine = np.isfinite(norms) & (norms > 0)
                        if not fine.any():
                            continue
                        chosen = pa.array(part[fine])
                        column = lambda c, chosen=chosen, batch=batch: pa.array([batch.column(c).take(chosen).to_pylist()], pa.list_(batch.schema.field(c).type))
                        yield pa.record_batch([topics.dictionary.take(pa.array([code])), pa.array([size], pa.int32()), column(key), column(scope), pa.array([(block[fine] / norms[fine, None]).tobytes()], pa.binary())], names=["topic", "size", key, scope, "vectors"])

    return rows.mapInArrow(run, f"topic string, size int, {kind}, vectors binary")


def first_k(scores: np.ndarray, k: int, least: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest scores of each row that are `least` (one for all, or one a row) or more; ties go to earlier columns."""
    floor = np.full(len(scores), least)
    many = np.flatnonzero(np.count_nonzero(scores >= floor[:, None], axis=1) > k)
    if len(many):
        floor[many] = -np.partition(-scores[many], k - 1, axis=1)[:, k - 1]
    row, column = np.nonzero(scores >= floor[:, None])
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


class _Held:
    """The first k hits of each question of a block, over the candidates met so far: rows of (row, score, id)."""

    def __init__(self, qids: pa.Array, k: int, by_id: bool) -> None:
        self.qids, self.k, self.hits = qids, k, None
        self.order = [("row", "ascending"), *([] if by_id else [("score", "descending")]), ("id", "ascending")]
        self.floor = np.full(len(qids), -np.inf)
        self.by_id = by_id

    def add(self, row: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        both = pa.table({"row": row, "score": score, "id": ids})
        if self.hits is not None:
            both = pa.concat_tables([self.hits, both]).combine_chunks()
        both = both.take(pc.sort_indices(both, sort_keys=self.order))
        row = both.column("row").to_numpy()
        place = np.arange(len(row)) - np.searchsorted(row, row)
        self.hits = both.filter(pa.array(place < self.k)).combine_chunks()
        if not self.by_id:  # what scores less than a question's k-th is no hit of it any more
            last = place == self.k - 1
            self.floor[row[last]] = both.column("score").to_numpy()[last]

    def batches(self) -> Iterator[pa.RecordBatch]:
        for part in self.hits.to_batches(max_chunksize=100_000):
            yield pa.record_batch([self.qids.take(part.column("row")), part.column("id"), part.column("score")], names=["qid", "chunk_id", "score"])


def _met(k: int, least: float, by_id: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, _Held] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                size = batch.column("size")[i].as_py()
                asked = np.frombuffer(batch.column("asked")[i].as_buffer()).reshape(-1, size)
                found = np.frombuffer(batch.column("vectors")[i].as_buffer()).reshape(-1, size)
                ids = batch.column("ids")[i].values
                order = np.array(pc.sort_indices(ids))
                scores = np.round(asked @ found[order].T, 6)
                subs = batch.column("sub")[i].values.take(pa.array(order)).dictionary_encode()
                names = subs.dictionary.to_pylist()
                codes = subs.indices.fill_null(len(names)).to_numpy(zero_copy_only=False)
                wanted = batch.column("wanted")[i].as_py()
                allowed = np.array([[True] * (len(names) + 1) if not w else [*(n in set(w) for n in names), False] for w in wanted])
                if not allowed.all():
                    scores[~allowed[:, codes]] = -np.inf
                qids = batch.column("qids")[i].values
                best = held.setdefault(qids.to_numpy(zero_copy_only=False).tobytes() + asked[:1].tobytes(), _Held(qids, k, by_id))
                # Columns ascend by id: where every score that is enough counts alike, the first ids come first.
                row, column = first_k((scores >= max(least, -2.0)) * 1.0, k, 1.0) if by_id else first_k(scores, k, np.maximum(best.floor, max(least, -2.0)))
                if len(row):
                    best.add(row, scores[row, column], ids.take(pa.array(order[column])))
            if sum(len(b.hits) for b in held.values() if b.hits is not None) > MOST_HELD:
                yield from (x for b in held.values() if b.hits is not None for x in b.batches())
                held.clear()
        yield from (x for b in held.values() if b.hits is not None for x in b.batches())

    return run


def nearest(queries: DataFrame, chunks: DataFrame, k: int, min_score: float, broadcast_bytes: int = 64 << 20, salts: int = 32, by_id: bool = False) -> DataFrame:
    """qid, chunk_id, score: for each query at least its k best chunks by cosine (6 decimals) of min_score or more; ties by chunk_id.

    by_id: of the chunks of min_score or more, those with the smallest ids.
    queries (qid, topic_id, sub_topics, embedding), chunks (chunk_id,
    topic_id, sub_topic_id, embedding). The caller cuts the rows to k.
    """
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    asked = queries.where("embedding is not null").select(F.col("topic_id").cast("string").alias("topic"), F.col("qid").cast("long").alias("qids"), F.col("sub_topics").cast("array<string>").alias("wanted"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = chunks.where("embedding is not null").select(F.col("topic_id").cast("string").alias("topic"), F.col("chunk_id").alias("ids"), F.col("sub_topic_id").cast("string").alias("sub"), F.col("embedding").cast("array<double>").alias("embedding"))
    held = asked.agg((F.count(F.lit(1)) * F.max(F.size("embedding")) * 8).alias("bytes")).first()["bytes"] or 0
    # Blocks of a topic, full ones where there are many questions; a frequent topic is more than one task.
    dealt = asked.repartition("topic", F.pmod(F.xxhash64("qids"), F.lit(1 + held // (4 * BLOCK_BYTES))))
    questions = _packed(dealt, "qids", "wanted", "qids array<long>, wanted array<array<string>>").withColumnRenamed("vectors", "asked")
    found = _packed(rows.coalesce(TASKS * rows.sparkSession.sparkContext.defaultParallelism), "ids", "sub", f"ids array<{kind}>, sub array<string>")
    if held <= broadcast_bytes:
        pairs = found.join(F.broadcast(questions), ["topic", "size"])
    else:
        salted = questions.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        pairs = found.withColumn("salt", F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.lit(salts)).cast("int")).join(salted, ["topic", "size", "salt"])
    return pairs.select("size", "asked", "qids", "wanted", "vectors", "ids", "sub").mapInArrow(_met(k, min_score, by_id), f"qid long, chunk_id {kind}, score double")
