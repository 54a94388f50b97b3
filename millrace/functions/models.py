"""Hooks for models: embedding, pair scoring, text generation. Defaults are deterministic stand-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import clean_text, fallback_keywords, history_text, keywords, render, strip


def hashed_embedding(texts: list[str], size: int = 64) -> np.ndarray:
    """Signed hashed word counts, of length 1. For tests; no meaning is claimed."""
    out = np.zeros((len(texts), size))
    for row, text in zip(out, texts, strict=True):
        for w in (text or "").lower().split():
            h = xxhash.xxh3_64_intdigest(w)
            row[h % size] += 1 if h >> 63 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class Loaded:
    """A hook whose model is made once in each Python worker, at its first call.

    factory takes no argument and gives the function that does the work; name
    tells models of one worker apart. Only name and factory travel with a task.
    """

    def __init__(self, name: str, factory: Callable[[], Callable]) -> None:
        self.name, self.factory = name, factory

    def __call__(self, items: list) -> object:
        if self.name not in _MODELS:
            _MODELS[self.name] = self.factory()
        return _MODELS[self.name](items)


_MODELS: dict[str, Callable] = {}


def _one_by_one(model: Callable[[list], object], items: list) -> list:
    """The model's results; if it fails on all items together, those of each alone, None for the ones it fails on."""
    try:
        found = list(model(items))
        if len(found) == len(items):
            return found
    except Exception:  # whatever the model raises
        pass
    if len(items) == 1:
        return [None]
    return [x for item in items for x in _one_by_one(model, [item])]


def embed(text: Column, model: Callable[[list[str]], np.ndarray] = hashed_embedding, batch: int = 50) -> Column:
    """The model's vector of each text; null for a text on which it fails."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            found: list = []
            for at in range(0, len(part), batch):
                found += [None if v is None else np.asarray(v, np.float32) for v in _one_by_one(model, part.iloc[at : at + batch].fillna("").tolist())]
            yield pd.Series(found, index=part.index, dtype=object)

    return run(text)


def pages_of(content: Column, model: Callable[[list[bytes]], list[list[tuple[str | None, bytes | None]]]]) -> Column:
    """The model's pages (text, image) of each file, in order; null where it fails. There is no default model."""

    @F.pandas_udf("array<struct<text:string,image:binary>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            found = [None if raw is None else _one_by_one(model, [bytes(raw)])[0] for raw in part]
            yield pd.Series([None if f is None else [{"text": t, "image": i} for t, i in f] for f in found], index=part.index, dtype=object)

    return run(content)


def shared_words(pairs: list[tuple[str, str]]) -> list[float]:
    """Logit-like score of a pair: words of the query that the passage has."""
    return [float(len(set(q.lower().split()) & set(d.lower().split()))) - 1 for q, d in pairs]


def score_pairs(query: Column, passage: Column, model: Callable[[list[tuple[str, str]]], list[float]] = shared_words, batch: int = 32) -> Column:
    """The model's score of each pair; null for the pairs of a batch on which the model fails."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, d in parts:
            pairs = list(zip(q.fillna(""), d.fillna(""), strict=True))
            found: list[float | None] = []
            for at in range(0, len(pairs), batch):
                part = pairs[at : at + batch]
                try:
                    found += model(part)
                except Exception:  # whatever the model raises: its queries fall back to unscored order
                    found += [None] * len(part)
            yield pd.Series(found, dtype=float)

    return run(query, passage)


def extract_answer(prompts: list[str]) -> list[str]:
    """Stand-in for generation: the first block of the prompt, cut at 300 characters. No meaning is claimed."""
    return [(p.split("\n\n")[0])[:300] for p in prompts]


def generate(prompt: Column, model: Callable[[list[str]], list[str]] = extract_answer) -> Column:
    """The model's text for each prompt; null for a batch on which it fails."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            try:
                found = list(model(part.fillna("").tolist()))
            except Exception:  # as above: the row's outcome says that generation failed
                found = [None] * len(part)
            yield pd.Series(found, index=part.index, dtype=object)

    return run(prompt)


def last_words(prompts: list[str]) -> list[str]:
    """Stand-in for rewriting: the last 400 characters of the prompt, which are the query and what was said before. No meaning is claimed."""
    return [p[-400:] for p in prompts]


def rewrite_query(query: Column, history: Column, model: Callable[[list[str]], list[str]] | None = None, template: str = "{history_str}\n{query}") -> Column:
    """The query as it stands without a history or model, else the model's text for the template with history and query."""
    if model is None:
        return query
    asked = strip(generate(render(template, history_str=history_text(history), query=query), model))
    return F.when(F.coalesce(F.size(history), F.lit(0)) <= 0, query).otherwise(F.coalesce(asked, query))


def ask_keywords(query: Column, model: Callable[[list[str]], list[str]] | None = None, template: str = "{query}") -> Column:
    """Keywords of the model's answer to the template with the query, or of the query itself without a model or where it fails."""
    plain = fallback_keywords(query)
    return plain if model is None else F.coalesce(keywords(generate(render(template, query=query), model)), plain)


def ocr(content: Column, model: Callable[[list[bytes]], list[str]]) -> Column:
    """The model's text of images or pages, cleaned as markdown; null where it fails. There is no default model."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            found = []
            for raw in part:
                try:
                    found.append(None if raw is None else model([bytes(raw)])[0])
                except Exception:  # one unreadable image rejects its own source only
                    found.append(None)
            yield pd.Series(found, index=part.index, dtype=object)

    text = run(content)
    return F.when(text.isNotNull(), clean_text(text, True))
