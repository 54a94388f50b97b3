"""Language identification by multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams (1 to 3 letters of lower-cased text, words padded by
spaces) of all rows that may teach, in Spark: a task sums dense counts for each
language and sends its non-zero buckets on. The log-probability matrix has one
row a language and `buckets` columns, so its size is bounded by the number of
languages, which is checked, and it is broadcast. Scoring looks up a batch's
n-grams in numpy.

Defined results: `und` with score 0 for a text that is null or has no letter, or
if nothing could be learned; a null language teaches nothing; ties go to the
language that sorts first; rows that repeat an id are scored one by one; an
empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import held_out, in_batches, slices

BITS = 15
ORDERS = 3
_A, _B = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


def ngram_buckets(text: str, bits: int = BITS) -> np.ndarray:
    """Buckets of all n-grams of a whole text, repeats included.

    Every character that is no letter counts as a space, and runs of spaces as
    one, which padded words share.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    plain = np.where(_LETTER[np.minimum(codes, 0x2FF)] | (codes > 0x2FF), codes, 32).astype(np.uint32)
    keep = np.ones(len(plain), bool)
    keep[1:] = (plain[1:] != 32) | (plain[:-1] != 32)
    c = np.concatenate([[32], plain[keep], [32]]).astype(np.uint32)
    out = []
    h = np.zeros(len(c), np.uint32)
    for n in range(ORDERS):
        h = (h[: len(c) - n] ^ c[n:]) * _A
        h ^= h >> np.uint32(15)
        out.append((h * _B + np.uint32(n)) >> np.uint32(32 - bits))
        h = h[:-1]
    return np.concatenate(out)


_LETTER = np.array([chr(c).isalpha() for c in range(0x300)])


def _train(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if lang not in counts:
                    if len(counts) > 500:
                        raise ValueError("lang has too many values to be a language code")
                    counts[lang], docs[lang] = np.zeros(1 << bits, np.int64), 0
                counts[lang] += np.bincount(ngram_buckets(text, bits), minlength=1 << bits)
                docs[lang] += 1
        for lang, c in counts.items():
            on = np.flatnonzero(c)
            yield pa.record_batch({"lang": pa.array([lang] * (len(on) + 1), pa.string()), "bucket": pa.array([-1, *on.tolist()], pa.int32()), "n": pa.array([docs[lang], *c[on].tolist()], pa.int64())})

    return run


def train(docs: DataFrame, bits: int = BITS, smoothing: float = 0.5, max_languages: int = 500) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log priors, log probabilities [language, bucket], from lang and text of docs."""
    rows = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    # Languages are counted before anything comes to the driver.
    if (seen := rows.select("lang").distinct().limit(max_languages + 1).count()) > max_languages:
        raise ValueError(f"lang has over {seen - 1} values")
    sums = rows.transform(in_batches, _train(bits), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(sums.column("lang").to_pylist()))
    place = {x: i for i, x in enumerate(langs)}
    counts = np.zeros((len(langs), (1 << bits) + 1))
    at = np.array([place[x] for x in sums.column("lang").to_pylist()], int)
    counts[at, sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()  # bucket -1: documents
    grams = counts[:, :-1] + smoothing
    return langs, np.log(counts[:, -1] / max(1.0, counts[:, -1].sum())) if langs else np.empty(0), np.log(grams / grams.sum(1, keepdims=True))


def _counted(buckets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and how often each occurs; few are sorted, many counted in a dense row."""
    if len(buckets) < 1 << (bits - 5):
        return np.unique(buckets, return_counts=True)
    dense = np.bincount(buckets, minlength=1 << bits)
    on = np.flatnonzero(dense)
    return on, dense[on]


def _predict(langs: list[str], prior, matrix, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket = np.ascontiguousarray(matrix.value.T) if langs else None
        for batch in slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                if not text or not langs or not any(map(str.isalpha, text)):
                    out.append(("und", 0.0))
                    continue
                on, found = _counted(ngram_buckets(text, bits), bits)
                logs = prior + found @ by_bucket[on]
                best = int(logs.argmax())
                out.append((langs[best], float(1 / np.exp(logs - logs[best]).sum())))
            a, b = zip(*out, strict=True)
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(a), pa.array(b)], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model, bits: int = BITS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text."""
    langs, prior, matrix = model
    shared = docs.sparkSession.sparkContext.broadcast(matrix)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    return rows.transform(in_batches, _predict(langs, prior, shared, bits), "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Trains on the rows that are not held out, scores all."""
    return predict(docs, train(docs.where(~held_out(F.col("doc_id"))), bits), bits)
