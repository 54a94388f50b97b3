"""Best-fit packing of tokenized documents by a configuration linear program.

Documents become pieces of at most `capacity` tokens. The histogram of piece
lengths (at most `capacity` numbers, whatever the corpus) is packed on the
driver: a fractional packing over configurations, that is multisets of lengths
which fit one sequence, is found by multiplicative weights; the pricing problem
is a knapsack over lengths, solved by dynamic programming. The solution is
rounded, again over what is left, and the last few pieces are packed best-fit.
The plan is a small table of runs, (length, first rank, count, ...), and each piece finds its
place by its rank among the pieces of its length, which Spark counts in
parallel: ranks inside small buckets plus the buckets' running sums.

Defined results: a null or empty text has no token but the closing id 0, so it
is one piece of length 1; rows that repeat a doc_id are packed one by one, equal
rows too, in any order among themselves; a null doc_id is kept; a text of any
length is packed whole; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import in_batches, slices, stored

END = b"\0\0\0\0"
#: UTF-8 of runs of a-z and the lower-case letters of Latin-1: one pre-token that no normalizer changes.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


def _byte_letters() -> dict[int, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in printable)}


BYTE_LETTERS = _byte_letters()


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class ChunkIds(dict):
    """Token ids, as little-endian bytes, of what stands between spaces.

    The tokenizer drops white space and never joins across it, so a text's ids
    are its chunks' ids in turn. A full stop or comma after an ASCII letter is
    always a token of its own, so such a chunk comes from the bare word's ids.
    A task owns its chunks: at most 2 * `most`, those met last.
    """

    def __init__(self, path: str, most: int = 200_000) -> None:
        super().__init__()
        self.tokenizer, self.most = _tokenizer(path), most
        self.older: dict[bytes, bytes] = {}
        self.merges = self.tokenizer.model.tokenize
        self.stops = {ord(c): self._encode(c.encode()) for c in ".,"}

    def _encode(self, chunk: bytes) -> bytes:
        found = self.tokenizer.encode(chunk.decode("utf-8", "replace"), add_special_tokens=False)
        return np.array(found.ids, "<u4").tobytes()

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        found = self.older.get(chunk)
        if found is not None:
            pass
        elif chunk[-1:] in (b".", b",") and chunk[-2:-1].isalpha():
            found = self[chunk[:-1]] + self.stops[chunk[-1]]
            if len(chunk) > 8:  # seldom seen again; the bare word is kept
                return found
        elif PLAIN.fullmatch(chunk):  # one pre-token that no normalizer changes: the merges alone
            word = chunk.decode() if chunk.isascii() else chunk.decode("latin-1").translate(BYTE_LETTERS)
            found = array("I", [t.id for t in self.merges(word)]).tobytes()
        else:
            found = self._encode(chunk) if chunk else b""
        self[chunk] = found
        return found

    def of(self, text: str | None) -> bytes:
        raw = (text or "").encode("utf-8", "replace").replace(b"\n", b" ")
        if b"<|" not in raw:
            return b"".join(map(self.__getitem__, raw.lower().split(b" ")))
        # A special token counts only as it is written, so such a chunk keeps its case.
        return b"".join(self._encode(c) if b"<|" in c else self[c.lower()] for c in raw.split(b" "))


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ChunkIds(path)
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = known.of(text) + END
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)

    return run


_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def pieces(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's pieces."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.transform(in_batches, _pieces(path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_values(price: np.ndarray, need: np.ndarray, capacity: int) -> np.ndarray:
    """Largest total price of pieces within each capacity up to the given one.

    A knapsack by dynamic programming; need bounds the copies of a length, in
    powers of two (the usual binary splitting).
    """
    value = np.zeros(capacity + 1)
    for length in np.flatnonzero(need).tolist():
        left, copies, p = min(int(need[length]), capacity // length), 1, price[length]
        while left:
            n = min(copies, left)
            np.maximum(value[n * length :], value[: capacity + 1 - n * length] + n * p, out=value[n * length :])
            left, copies = left - n, copies * 2
    return value


Configuration = tuple[tuple[int, int], ...]


def fractional(need: np.ndarray, capacity: int, rounds: int, rate: float, slack: float) -> tuple[dict[Configuration, float], float]:
    """Configurations ((length, copies), ...) with their fractional times, which cover need, and the bound of the dual prices.

    Multiplicative weights over the covering rows of the configuration program:
    a length's price is its size times a weight that falls with the share of its
    pieces covered ahead of the round's schedule. In a round every length behind
    schedule gets the configurations that hold it and come, by dynamic
    programming, within `slack` of each part's best price; among those the
    longest lengths behind schedule are taken, else the least covered. Prices
    over the best configuration's price are feasible in the dual program, so
    their total over all pieces bounds the number of sequences from below.
    """
    lengths = np.flatnonzero(need)
    n = need[lengths].astype(float)
    cover, bound = np.zeros(len(lengths)), 0.0
    used: dict[Configuration, float] = {}
    fit = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for turn in range(1, rounds + 1):
        due = turn / rounds
        price = np.zeros(capacity + 1)
        price[lengths] = lengths * np.exp(-rate * np.clip(cover / n - (turn - 1) / rounds, -1, 1))
        value = best_values(price, need, capacity)
        w = price[lengths]
        bound = max(bound, float(w @ n / value[capacity]))
        for i in range(len(lengths) - 1, -1, -1):
            lack = n[i] * due - cover[i]
            if lack <= 1e-9:
                continue
            taken, gap = Counter([i]), capacity - int(lengths[i])
            while k := fit[gap]:
                total = w[:k] + value[gap - lengths[:k]]
                total[[j for j, copies in taken.items() if j < k and copies >= n[j]]] = -np.inf
                if (best := total.max()) == -np.inf:
                    break
                near = total >= best - slack * lengths[:k]
                share = np.where(near, cover[:k] / n[:k], np.inf)
                late = np.flatnonzero(share < due)
                j = int(late[-1]) if len(late) else int(share.argmin())
                taken[j] += 1
                gap -= int(lengths[j])
            step = lack / taken[i]
            for j, copies in taken.items():
                cover[j] += copies * step
            key = tuple(sorted((int(lengths[j]), copies) for j, copies in taken.items()))
            used[key] = used.get(key, 0.0) + step
    return used, bound


def solve(histogram: dict[int, int], capacity: int, rounds: int = 16, rate: float = 0.5, slack: float = 0.01) -> list[tuple[dict[int, int], int]]:
    """Configurations and how many sequences use each; together they hold every piece.

    The fractional program is rounded: the whole times of each configuration
    first, then one more of those used most, while their pieces last. The program
    is solved anew over what is left until it places under a tenth of that, and
    the last pieces are packed best-fit. Where the sequences then exceed the dual
    bound, configurations that leave a gap are opened again and join the last
    pieces. Where best fit alone needs fewer sequences than all that, its plan is
    taken. The work follows the histogram, not the corpus.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    plain = _remainder(left, capacity)
    plan: Counter[Configuration] = Counter()
    least = 0.0
    while total := int(left.sum()):
        used, bound = fractional(left, capacity, rounds, rate, slack)
        least = least or bound
        often = sorted(used.items(), key=lambda x: (-x[1], x[0]))
        for key, times in [*((k, int(y)) for k, y in often), *((k, 1) for k, _ in often)]:
            n = min([times, *(int(left[x]) // c for x, c in key)])
            if n > 0:
                plan[key] += n
                for x, c in key:
                    left[x] -= n * c
        if left.sum() > 0.9 * total:
            break
    best = [(dict(k), n) for k, n in plan.items()] + _remainder(left, capacity)
    if sum(n for _, n in best) > ceil(least - 1e-6):
        full = [(dict(k), n) for k, n in plan.items() if sum(x * c for x, c in k) == capacity]
        for key, n in plan.items():
            if sum(x * c for x, c in key) < capacity:
                for x, c in key:
                    left[x] += n * c
        best = min(best, full + _remainder(left, capacity), plain, key=lambda p: sum(n for _, n in p))
    return best


def _remainder(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Rows that rounding left: the longest first, completed to the fullest sequence, in bulk.

    The longest remaining length opens a sequence, the gap is filled with the
    largest lengths that fit (best fit), and the configuration is repeated as
    often as its lengths last, so steps follow distinct lengths, not pieces.
    """
    plan = []
    present = [int(x) for x in np.flatnonzero(left)]
    left = left.copy()
    while present:
        gap, config = capacity, {}
        at = len(present)
        while gap and at:
            at = bisect_left(present, gap + 1, 0, at)
            if not at:
                break
            x = present[at - 1]
            n = min(int(left[x]) - config.get(x, 0), gap // x)
            if n:
                config[x] = config.get(x, 0) + n
                gap -= n * x
            at -= 1
        exchanged = _close_gap(config, gap, left, present)
        times = min(int(left[x]) // n for x, n in exchanged.items())
        plan.append((exchanged, times))
        for x, n in exchanged.items():
            left[x] -= n * times
            if not left[x]:
                present.pop(bisect_left(present, x))
    return plan


def _close_gap(config: dict[int, int], gap: int, left: np.ndarray, present: list[int]) -> dict[int, int]:
    """Exchange the last length taken for a longer one, if one fits the gap better."""
    if gap and config:
        last = min(config)
        at = bisect_left(present, last + gap + 1) - 1
        while at >= 0 and present[at] > last:
            x = present[at]
            if left[x] > config.get(x, 0):
                config = dict(config)
                config[last] -= 1
                if not config[last]:
                    del config[last]
                config[x] = config.get(x, 0) + 1
                break
            at -= 1
    return config


def runs(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """length, first rank, count, first sequence, copies in a sequence, offset of the first copy."""
    out, next_rank, sequence = [], {}, 0
    for config, times in plan:
        offset = 0
        for length, copies in sorted(config.items(), reverse=True):
            rank = next_rank.get(length, 0)
            out.append((length, rank, copies * times, sequence, copies, offset))
            next_rank[length] = rank + copies * times
            offset += length * copies
        sequence += times
    return out


def pack(found: DataFrame, capacity: int = 2048, bucket_rows: int = 2000) -> DataFrame:
    """Adds sequence_id and offset to pieces(); found must not change between reads."""
    spark = found.sparkSession
    sizes = found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    histogram = {r.length: r.n for r in sizes}
    rows = runs(solve(histogram, capacity))
    # Rank of a piece in its length: buckets of a few thousand pieces, then the buckets' running sums.
    parts = max(1, -(-sum(histogram.values()) // bucket_rows))
    keyed = stored(found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts))).withColumn("nth", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1), "ranked")
    sums = stored(keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "sums")
    groups = sums.withColumn("group", F.col("bucket") % 64)
    wide = groups.groupBy("length", "group").agg(F.sum("n").alias("n"))
    run_sum = lambda keys, order: F.sum("n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    bases = groups.withColumn("in_group", F.coalesce(run_sum(["length", "group"], "bucket"), F.lit(0))).drop("n").join(wide.withColumn("base", F.coalesce(run_sum(["length"], "group"), F.lit(0))).drop("n"), ["length", "group"])
    placed = keyed.join(bases, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("in_group") + F.col("nth"))
    # A length has several runs; the array of its runs' first ranks tells which one holds the rank.
    by_length: dict[int, list[tuple]] = {}
    for r in rows:
        by_length.setdefault(r[0], []).append(r[1:])
    schema = "length long, firsts array<long>, plan array<struct<first:long,count:long,sequence:long,copies:long,offset:long>>"
    table = spark.createDataFrame([(x, [r[0] for r in rs], rs) for x, rs in by_length.items()], schema)
    run = F.get("plan", F.size(F.filter("firsts", lambda f: f <= F.col("rank"))) - 1)
    out = placed.join(F.broadcast(table), "length").withColumn("run", run)
    within = F.col("rank") - F.col("run.first")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("run.sequence") + F.floor(within / F.col("run.copies"))).alias("sequence_id"), (F.col("run.offset") + F.col("length") * (within % F.col("run.copies"))).alias("offset"))


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    return pack(stored(pieces(docs, path, capacity), "pieces"), capacity)
