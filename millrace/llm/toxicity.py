"""Toxicity by weak supervision.

Voters are lexicon terms (words and word beginnings) and patterns (an address
followed by a term, shouting, exclamation, repeated terms). Terms are mined in
Spark from rows that may teach: those much more frequent in toxic documents.
A generative label model gives each voter a rate of voting for either class,
fitted by expectation maximization from the given labels, and discounts voters
by the correlation of their votes inside a class. Its posterior labels train a
linear classifier (logistic regression) on the voters' votes, and that scores
every whole text.

All labelled documents that are not held out teach the lexicon; of its terms the
`most` of largest weight are voters, which bounds the features of the classifier. At
most `label_rows` of these documents, drawn by hash of the id, teach the label model
and the classifier.

Defined results: a null or empty text is scored like a text without a vote; with
no labelled row at all every score is 0; a document that labels list twice counts
as toxic if one row says so; null labels teach nothing; rows that repeat an id
are scored one by one; an empty table gives an empty result; further columns of
the input are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import drawn, give_back, held_out, in_batches, slices

_WORDS = re.compile(r"[^\W_]+")
#: Lengths of word beginnings that may be terms; shorter ones are too common.
STEMS = (4, 5, 6)
#: A form of address before a term, in the corpus's languages.
ADDRESS = frozenset("you your youre du dein ihr euch tu vous ton votre eres vosotros usted tus".split())
#: Labelled ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 4_000_000
PATTERNS = ("addressed", "shouting", "exclaiming", "many_terms")


def terms_of(words: set[str]) -> set[str]:
    """Words, and their beginnings marked by a trailing star."""
    found = set(words)
    for n in STEMS:
        found.update(w[:n] + "*" for w in words if len(w) > n)
    return found


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = Counter(), Counter()

    def out():
        items = list(counts[0].keys() | counts[1].keys())
        yield pa.record_batch({"term": pa.array(items, pa.string()), "clean": pa.array([counts[0][t] for t in items], pa.int64()), "toxic": pa.array([counts[1][t] for t in items], pa.int64())})
        counts[0].clear()
        counts[1].clear()

    for batch in slices(batches):
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts[toxic].update(terms_of(set(_WORDS.findall((text or "").lower()))))
            counts[toxic][""] += 1  # documents of the class
        if len(counts[0]) + len(counts[1]) > 100_000:
            yield from out()
    yield from out()


def lexicon(rows: DataFrame, most: int = 2000, least: int = 5, odds: float = 8.0, evidence: float = 20.0) -> list[str]:
    """Terms whose share of toxic documents is `odds` times that of clean ones, at least.

    evidence: least product of toxic documents and log odds, against chance.
    """
    sums = rows.transform(in_batches, _mine, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    total = sums.where("term = ''").first()
    if total is None or not total.toxic or not total.clean:
        return []
    ratio = ((F.col("toxic") + 0.5) / (total.toxic + 1)) / ((F.col("clean") + 0.5) / (total.clean + 1))
    found = sums.where((F.col("term") != "") & (F.col("toxic") >= least)).withColumn("ratio", ratio).withColumn("weight", F.col("toxic") * F.log("ratio")).where((F.col("ratio") >= odds) & (F.col("weight") >= evidence))
    return [r.term for r in found.orderBy(F.desc("weight"), "term").limit(most).collect()]


class Voters:
    """Votes of a text: places of the voters that call it toxic."""

    def __init__(self, terms: list[str]) -> None:
        self.names = [*terms, *PATTERNS]
        self.words = {t: i for i, t in enumerate(terms) if not t.endswith("*")}
        self.stems = {t[:-1]: i for i, t in enumerate(terms) if t.endswith("*")}
        self.lengths = [n for n in STEMS if any(len(s) == n for s in self.stems)]
        self.first = len(terms)

    def votes(self, text: str | None) -> list[int]:
        if not text:
            return []
        lower = text.lower()
        words = set(_WORDS.findall(lower))
        found = {self.words[w] for w in words & self.words.keys()}
        stems: set[str] = set()
        for n in self.lengths:
            hits = {w[:n] for w in words} & self.stems.keys()
            if hits:
                stems |= hits
                found.update(self.stems[s] for s in hits if any(len(w) > n and w.startswith(s) for w in words))
        out = sorted(found)
        if out:
            if ADDRESS & words and self._addressed(lower):
                out.append(self.first)
            if len(out) > 3:
                out.append(self.first + 3)
        letters = len(text) - text.count(" ")
        if letters > 40 and sum(map(str.isupper, text)) * 2 > letters:
            out.append(self.first + 1)
        if text.count("!") * 20 > letters:
            out.append(self.first + 2)
        return out

    def _addressed(self, lower: str) -> bool:
        before: list[str] = []
        for w in _WORDS.findall(lower):
            if (w in self.words or any(w[:n] in self.stems for n in self.lengths)) and ADDRESS.intersection(before[-4:]):
                return True
            before.append(w)
            if len(before) > 8:
                del before[:4]
        return False


def _blocks(votes: np.ndarray, rows: int = 2048) -> Iterator[tuple[slice, np.ndarray]]:
    """Blocks of votes in double precision, so that no whole copy is made."""
    for at in range(0, len(votes), rows):
        yield slice(at, at + rows), votes[at : at + rows].astype(float)


def _times(votes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.concatenate([v @ weights for _, v in _blocks(votes)] or [np.zeros(0)])


def _sums(votes: np.ndarray, part: np.ndarray) -> np.ndarray:
    return sum((part[at] @ v for at, v in _blocks(votes)), np.zeros(votes.shape[1]))


def _gram(votes: np.ndarray, part: np.ndarray) -> np.ndarray:
    return sum(((v * part[at][:, None]).T @ v for at, v in _blocks(votes)), np.zeros((votes.shape[1],) * 2))


def label_model(votes: np.ndarray, labels: np.ndarray, times: np.ndarray, rounds: int = 8, trust: float = 0.9) -> np.ndarray:
    """Posterior that each row is toxic, from its votes (0/1 matrix) and noisy labels.

    A row stands for `times` documents of equal votes and label. The labels vote
    too, with accuracy `trust`. A voter that does not fire abstains; a row on
    which none fires has one vote for clean. Voters that fire together inside
    a class count less: the log odds of each is divided by one plus the sum of
    its positive correlations with the others.
    """
    q = np.where(labels > 0, trust, 1 - trust)
    given = np.log(q / (1 - q))
    silent = votes.sum(1) == 0
    for _ in range(rounds):
        parts = q * times, (1 - q) * times
        fired = [_sums(votes, part) for part in parts]
        a, b = ((on + 0.5) / (part.sum() + 1) for on, part in zip(fired, parts, strict=True))
        weight = np.zeros(len(a))
        for part, on, rate in zip(parts, fired, (a, b), strict=True):
            off = np.outer(on, rate)
            cov = (_gram(votes, part) - off - off.T + np.outer(rate, rate) * part.sum()) / max(part.sum(), 1e-9)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-6))
            corr = np.clip(cov / sd[:, None] / sd[None, :], 0, 1)
            np.fill_diagonal(corr, 0)
            weight = np.maximum(weight, corr.sum(1))
        quiet = [np.log(((part * silent).sum() + 0.5) / (part.sum() + 1)) for part in parts]
        log_odds = given + _times(votes, np.log(a / b) / (1 + weight)) + silent * (quiet[0] - quiet[1])
        q = np.clip(1 / (1 + np.exp(-np.clip(log_odds, -30, 30))), 1e-4, 1 - 1e-4)
    return q


def linear_classifier(votes: np.ndarray, posterior: np.ndarray, times: np.ndarray, rounds: int = 30, penalty: float = 1.0) -> np.ndarray:
    """Weights (bias last) of a logistic regression on posterior labels, by Newton steps."""
    x = np.concatenate([votes, np.ones((len(votes), 1), votes.dtype)], 1)
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(_times(x, w), -30, 30)))
        step = np.linalg.solve(_gram(x, times * p * (1 - p)) + np.diag(ridge), _sums(x, times * (posterior - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _vote(terms: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(terms)
        for batch in slices(batches):
            yield pa.record_batch([batch.column("toxic"), pa.array([voters.votes(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))], names=["toxic", "votes"])

    return run


def train(docs: DataFrame, labels: DataFrame, label_rows: int = 20_000) -> tuple[list[str], np.ndarray]:
    """Terms and linear weights, from labelled documents that are not held out."""
    truth = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    truth = truth.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Whole texts are not shuffled while the ids fit a broadcast.
    terms = lexicon(texts.join(F.broadcast(truth) if truth.count() <= BROADCAST_IDS else truth, "doc_id").select("text", "toxic"))
    rows = texts.join(F.broadcast(drawn(truth, F.col("doc_id"), label_rows)), "doc_id").select("text", "toxic")
    found = rows.transform(in_batches, _vote(terms), "toxic int, votes array<int>").groupBy("toxic", "votes").agg(F.count(F.lit(1)).alias("times")).orderBy("toxic", "votes").toArrow()
    y = found.column("toxic").to_numpy().astype(float)
    if not len(y):
        return terms, np.zeros(0)
    votes = np.zeros((len(y), len(terms) + len(PATTERNS)), np.uint8)
    lists = found.column("votes").combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    votes[np.repeat(np.arange(len(y)), sizes), lists.flatten().to_numpy()] = 1
    times = found.column("times").to_numpy().astype(float)
    del found, lists
    weights = linear_classifier(votes, label_model(votes, y, times), times)
    del votes
    give_back()
    return terms, weights


def _score(terms: list[str], weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(terms)
        for batch in slices(batches):
            if not len(weights):
                scores = np.zeros(batch.num_rows)
            else:
                sums = [weights[-1] + weights[v].sum() for v in map(voters.votes, batch.column("text").to_pylist())]
                scores = 1 / (1 + np.exp(-np.clip(sums, -30, 30)))
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, label_rows: int = 20_000, model=None) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""
    terms, weights = train(docs, labels, label_rows) if model is None else model
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    return rows.transform(in_batches, _score(terms, weights), "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, label_rows: int = 20_000) -> DataFrame:
    """The documents that are not called toxic, with the columns of docs, in one pass."""
    terms, weights = train(docs, labels, label_rows)
    scores = _flags(terms, weights, next(i for i, c in enumerate(docs.columns) if c.lower() == "text"))
    wide = docs.select(F.struct(*docs.columns).alias("row"))
    kind = wide.schema["row"].dataType.simpleString()
    return wide.transform(in_batches, scores, f"row {kind}").select("row.*")


def _flags(terms: list[str], weights: np.ndarray, place: int):
    """The rows that are not called toxic; the text is field `place` of a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(terms)
        for batch in slices(batches):
            texts = pc.struct_field(batch.column("row"), place).to_pylist()
            keep = [not len(weights) or weights[-1] + weights[voters.votes(t)].sum() < 0 for t in texts]
            yield pa.record_batch([batch.column("row").filter(pa.array(keep, pa.bool_()))], names=["row"])

    return run
