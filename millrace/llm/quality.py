"""Quality rules by distribution divergence.

A document's histogram of character classes and its histogram of common words
are held against references of its language, by Jensen-Shannon distance. The
references are sums over all documents of the language, so they follow the
corpus. Short documents have histograms too thin to judge: under a minimum
length a distance is not used.

Defined results: a null text counts as empty and fails the base rules; a
document of unknown language is held against every reference and takes its
smallest distances; without any reference only the base rules decide; repeated
rows are judged one by one; an empty table gives an empty result; further
columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import in_batches, slices

CLASSES = ("lower", "upper", "beyond_ascii", "digit", "space", "stop", "symbol", "other")
SYMBOLS = "#*$%&|<>"
_SKIP = len(CLASSES)  # continuation bytes of UTF-8
WINDOW = 8


def _class_table() -> bytes:
    kind = bytearray([7] * 256)
    for code in range(256):
        char = chr(code)
        if code >= 0x80:
            kind[code] = _SKIP if code < 0xC0 else 2
        elif char.islower():
            kind[code] = 0
        elif char.isupper():
            kind[code] = 1
        elif char.isdigit():
            kind[code] = 3
        elif char.isspace():
            kind[code] = 4
        elif char in ".,;:?'\"-()":
            kind[code] = 5
        elif char in SYMBOLS:
            kind[code] = 6
    return bytes(kind)


_TABLE = _class_table()


def class_counts(raw: bytes) -> np.ndarray:
    """Code points of UTF-8 text by class."""
    return np.bincount(np.frombuffer(raw.translate(_TABLE), dtype=np.uint8), minlength=_SKIP + 1)[:_SKIP]


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    spaces = sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    symbols = sum(raw.count(c.encode()) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows that occur twice or more in the list."""
    if len(words) <= width:
        return 0
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    starts = [i for i, w in enumerate(windows) if seen[w] > 1]
    return width + sum(min(width, b - a) for a, b in pairwise(starts))


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2

    def part(a: np.ndarray) -> float:
        on = a > 0
        return float((a[on] * np.log2(a[on] / m[on])).sum())

    return max(0.0, (part(p) + part(q)) / 2) ** 0.5


def _partials(flush: int):
    """Counts of classes and words by language, from the rows of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def out():
            for lang, c in counts.items():
                keys = list(c)
                yield pa.record_batch({"lang": pa.array([lang] * len(keys), pa.string()), "item": pa.array(keys, pa.binary()), "n": pa.array([c[k] for k in keys], pa.int64())})
            counts.clear()

        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not text or lang is None:
                    continue
                raw = text.encode("utf-8", "surrogatepass")
                c = counts.setdefault(lang, Counter())
                c.update(raw.lower().split())
                for k, n in enumerate(class_counts(raw)):
                    if n:
                        c[b" class %d" % k] += int(n)
            if sum(map(len, counts.values())) > flush:
                yield from out()
        yield from out()

    return run


def references(docs: DataFrame, n_common: int = 64, flush: int = 400_000, max_languages: int = 2000) -> dict[str, tuple[np.ndarray, dict[bytes, int], np.ndarray]]:
    """By language: class histogram, common words, and their histogram (rest last).

    Counted over all documents in Spark; what comes to the driver is n_common
    words and eight class counts for a language. Over max_languages values of
    lang this raises, since the column is then no language code.
    """
    sums = docs.select("lang", "text").transform(in_batches, _partials(flush), "lang string, item binary, n long").groupBy("lang", "item").agg(F.sum("n").alias("n"))
    word = ~F.substring("item", 1, 1).eqNullSafe(F.lit(b" "))
    ranked = Window.partitionBy("lang", "word").orderBy(F.desc("n"), "item")
    kept = sums.withColumn("word", word).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= n_common)
    totals = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where(F.col("lang").isNotNull())
    langs = totals.limit(max_languages + 1).count()
    if langs > max_languages:
        raise ValueError(f"lang has over {max_languages} values")
    found: dict[str, dict[bytes, int]] = {}
    for row in kept.select("lang", "item", "n").collect():
        found.setdefault(row.lang, {})[bytes(row.item)] = row.n
    out = {}
    for lang, items in found.items():
        classes = np.array([items.pop(b" class %d" % k, 0) for k in range(_SKIP)], float)
        words = sorted(items, key=lambda w: (-items[w], w))
        out[lang] = classes, {w: i for i, w in enumerate(words)}, np.array([items[w] for w in words], float)
    return out


def distances(raw: bytes, words: list[bytes], reference) -> tuple[float, float]:
    """Class and common-word distance of a text from one reference.

    The word histograms are over the reference's common words alone; a text
    that has none of them is at distance 1.
    """
    classes, common, counts = reference
    hits = [common[w] for w in words if w in common]
    near = js_distance(np.bincount(hits, minlength=len(counts)).astype(float), counts) if hits else 1.0
    return js_distance(class_counts(raw).astype(float), classes), near


def _judge(refs, limits: tuple[float, float, int, int]):
    class_limit, word_limit, min_chars, min_words = limits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, text, lang in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "lang")), strict=True):
                counts = base_counts(text)
                n_words, _, _, _, n_repeat = counts
                failed = n_words < 20 or 100 * n_repeat > 30 * n_words
                by_class = by_word = None
                if text and refs and (len(text) >= min_chars or n_words >= min_words):
                    raw = text.encode("utf-8", "surrogatepass")
                    words = raw.lower().split()
                    both = [distances(raw, words, r) for r in ([refs[lang]] if lang in refs else refs.values())]
                    by_class = min(x for x, _ in both) if len(text) >= min_chars else None
                    by_word = min(x for _, x in both) if n_words >= min_words else None
                kept = not (failed or (by_class or 0) > class_limit or (by_word or 0) > word_limit)
                rows.append((doc_id, *counts, failed, kept, by_class, by_word))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)

    return run


_NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"]
_TYPES = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()] * 2
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"


def quality(docs: DataFrame, class_limit: float = 0.24, word_limit: float = 0.75, min_chars: int = 200, min_words: int = 60, refs: dict | None = None) -> DataFrame:
    """Base counts and the divergence verdict for every document.

    class_distance and word_distance are null where the text is under
    min_chars or min_words. kept is false if a base rule fails or a distance
    in use is over its limit.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    refs = references(docs) if refs is None else refs
    return docs.transform(in_batches, _judge(refs, (class_limit, word_limit, min_chars, min_words)), SCHEMA)
