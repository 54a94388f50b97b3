"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every text, as a whole, gives a fixed row of statistics: classes of characters,
lengths and repetition of words, lines, and the extremes of the same classes
over pieces of 512 bytes, so that junk inside a long text shows. Labelled rows
teach boosted trees: statistics are cut into at most `bins` bins at quantiles,
and each tree level sums gradients by node, statistic and bin. The trees are
kept as arrays (statistic, limit, leaf value), which numpy walks for all rows
and trees at a time.

At most about `label_rows` labelled documents, drawn by hash of the id, teach the
trees; their statistics (under 400 bytes a document) are what the driver
holds. Everything else is done where the rows are.

Defined results: a null or empty text has the statistics of no words and gets a
score like any other; with no labelled row every score is 0.5, with labels of
one class only that class's smoothed share; a document that labels list twice
counts as good if all its rows say so; null labels teach nothing; an id that
repeats among documents teaches once, by the smallest of its statistics, and each
of its rows is scored; equal texts get equal scores; a null id is held out; an
empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.quality import _TABLE, CLASSES, class_counts, repeated_words
from millrace.llm.shared import drawn, give_back, in_batches, slices

#: Bytes of a piece whose classes are counted by themselves.
PIECE = 512
NAMES = (
    *(f"share_{c}" for c in CLASSES), *(f"most_{c}" for c in CLASSES), *(f"least_{c}" for c in CLASSES),
    "marks", "bars", "log_words", "word_length", "word_spread", "longest_word", "distinct_words", "top_word", "same_as_last", "capital_words", "shouted_words", "marked_words",
    "lines", "line_length", "repeated_lines", "repeated_windows", "entropy", "distinct_pairs",
)


def held_out(key: Column) -> Column:
    """crc32 of the id as text, modulo three, is one. A null id is held out."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(True))


def statistics(text: str | None) -> np.ndarray:
    """The statistics of a whole text, in the order of NAMES."""
    out = np.zeros(len(NAMES))
    if not text:
        return out
    raw = text.encode("utf-8", "surrogatepass")
    k = len(CLASSES)
    counts = class_counts(raw).astype(float)
    chars = counts.sum()
    out[:k] = counts / chars
    kinds = np.frombuffer(raw.translate(_TABLE), np.uint8)
    pieces = max(1, round(len(kinds) / PIECE))
    by_piece = np.zeros((pieces, k + 1))
    for p, part in enumerate(np.array_split(kinds, pieces)):
        by_piece[p] = np.bincount(part, minlength=k + 1)
    shares = by_piece[:, :k] / np.maximum(by_piece[:, :k].sum(1, keepdims=True), 1)
    out[k : 2 * k], out[2 * k : 3 * k] = shares.max(0), shares.min(0)
    words = raw.split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    rest = [raw.count(b"!") / chars, raw.count(b"|") / chars, np.log1p(n)]
    if n:
        lengths = np.fromiter(map(len, words), np.int64, n)
        seen = Counter(words)
        last = kinds_of_ends(words)
        rest += [lengths.mean(), lengths.std(), np.log1p(lengths.max()), len(seen) / n, max(seen.values()) / n, sum(map(bytes.__eq__, words[1:], words)) / n, *last]
        rest += [np.log1p(len(lines)), np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), repeated_words(words) / n]
        often = np.fromiter(seen.values(), float, len(seen)) / n
        rest += [float(-(often * np.log2(often)).sum()) / max(1.0, np.log2(n)), len(set(zip(words, words[1:], strict=False))) / max(1, n - 1)]
    out[3 * k : 3 * k + len(rest)] = rest
    return out


def kinds_of_ends(words: list[bytes]) -> tuple[float, float, float]:
    """Shares of words that begin with a capital, are all capitals (two letters or more), and end with a symbol or exclamation mark."""
    n = len(words)
    capital = sum(1 for w in words if 65 <= w[0] <= 90)
    shouted = sum(1 for w in words if len(w) > 1 and w.isupper())
    marked = sum(1 for w in words if w[-1] in b"#*$%&|<>!")
    return capital / n, shouted / n, marked / n


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [statistics(t) for t in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("doc_id"), batch.column("good"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "good", "x"])


class Trees:
    """Boosted trees of one depth as arrays, nodes numbered from the root, level by level."""

    def __init__(self, depth: int, start: float) -> None:
        self.depth, self.start = depth, start
        self.statistic = np.zeros((0, 2**depth - 1), np.int32)
        self.limit = np.zeros((0, 2**depth - 1))
        self.value = np.zeros((0, 2**depth))

    def add(self, statistic: np.ndarray, limit: np.ndarray, value: np.ndarray) -> None:
        self.statistic, self.limit, self.value = np.vstack([self.statistic, statistic[None]]), np.vstack([self.limit, limit[None]]), np.vstack([self.value, value[None]])

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row: all rows walk all trees together."""
        trees, rows = np.arange(len(self.value))[None, :], np.arange(len(x))[:, None]
        at = np.zeros((len(x), len(self.value)), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, self.statistic[trees, at]] > self.limit[trees, at])
        sums = self.start + self.value[trees, at - (2**self.depth - 1)].sum(1)
        return 1 / (1 + np.exp(-np.clip(sums, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, penalty: float = 1.0, least: float = 2.0) -> Trees:
    """Trees fitted to labels y (0 or 1) of rows x by Newton steps on the logistic loss.

    least: smallest sum of second derivatives on either side of a cut. A node
    without a cut that gains sends all rows to its left.
    """
    share = (y.sum() + 0.5) / (len(y) + 1)
    trees = Trees(depth, float(np.log(share / (1 - share))))
    if y.min() == y.max():
        return trees
    n, m = x.shape
    # A limit is the upper end of a bin, itself inside: equal values share a bin.
    limits = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="inverted_cdf")) for f in range(m)]
    binned = np.stack([np.searchsorted(limits[f], x[:, f], "left") for f in range(m)], 1)
    cell = binned + np.arange(m) * bins
    sums = np.full(n, trees.start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-sums))
        gradient, curve = p - y, p * (1 - p)
        statistic, limit = np.zeros(2**depth - 1, np.int32), np.full(2**depth - 1, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width = 2**level
            place = (cell + (node * m * bins)[:, None]).ravel()
            g, h = (np.bincount(place, np.repeat(w, m), width * m * bins).reshape(width, m, bins).cumsum(2) for w in (gradient, curve))
            all_g, all_h = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + penalty) + (all_g - g) ** 2 / (all_h - h + penalty) - all_g**2 / (all_h + penalty)
            gain[(h < least) | (all_h - h < least)] = 0
            for f in range(m):
                gain[:, f, len(limits[f]) :] = 0
            best = gain.reshape(width, -1).argmax(1)
            cut = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            f, b = best // bins, best % bins
            first = width - 1
            statistic[first : first + width] = np.where(cut, f, 0)
            limit[first : first + width] = [limits[i][j] if c else np.inf for i, j, c in zip(f, b, cut, strict=True)]
            node = 2 * node + (cut[node] & (binned[np.arange(n), f[node]] > b[node]))
        g, h = np.bincount(node, gradient, 2**depth), np.bincount(node, curve, 2**depth)
        value = -rate * g / (h + penalty)
        trees.add(statistic, limit, value)
        sums = sums + value[node]
    return trees


def train(docs: DataFrame, labels: DataFrame, label_rows: int = 20_000) -> Trees | None:
    """Trees from labelled documents that are not held out; None where there is no such row."""
    truth = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") > 0).cast("int").alias("good"))
    truth = truth.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("good").alias("good"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    taught = texts.join(F.broadcast(drawn(truth, F.col("doc_id"), label_rows)), "doc_id").select("doc_id", "good", "text")
    measured = in_batches(taught, _measure, "doc_id long, good int, x array<double>")
    found = measured.groupBy("doc_id", "good").agg(F.min("x").alias("x")).toArrow()
    if not found.num_rows:
        return None
    order = np.argsort(found.column("doc_id").to_numpy())
    x = found.column("x").combine_chunks().flatten().to_numpy().reshape(found.num_rows, -1)[order]
    trees = boost(x, found.column("good").to_numpy()[order].astype(float))
    del found, x
    give_back()
    return trees


def _score(trees: Trees | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([statistics(t) for t in batch.column("text").to_pylist()])
            scores = np.full(len(x), 0.5) if trees is None else trees.scores(x)
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, label_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""
    trees = train(docs, labels, label_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    return in_batches(rows, _score(trees), "doc_id long, held_out boolean, score double, predicted int")
