"""Column functions for texts, keywords, scores and keys."""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's strip() and split() see it.
_SPACE = r"(?U)\s+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_text(c: Column, as_markdown: bool) -> Column:
    """Null gives ''; hyphenated line ends are joined; outside markdown white space becomes one space; stripped."""
    text = F.replace(F.coalesce(c, F.lit("")), F.lit("-\n"), F.lit(""))
    return strip(text if as_markdown else F.regexp_replace(text, _SPACE, " "))


def safe_sigmoid(x: Column) -> Column:
    return F.when(x < -100, F.lit(0.0)).otherwise(1 / (1 + F.exp(-x)))


def _split(c: Column) -> Column:
    return F.filter(F.split(c, _SPACE), lambda w: w != "")


def keywords(answer: Column) -> Column:
    """Commas part words, full stops go, over two letters, lower case, first of each kept."""
    words = _split(F.replace(F.replace(answer, F.lit(","), F.lit(" ")), F.lit("."), F.lit("")))
    return F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) > 2), F.lower))


def fallback_keywords(query: Column) -> Column:
    """Words of over three characters, lower case, punctuation and repeats kept."""
    return F.transform(F.filter(_split(query), lambda w: F.length(w) > 3), F.lower)


def index_tokens(text: Column) -> Column:
    """Distinct lower-case words of 2 to 20 letters or digits."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w).between(2, 20)))


def sub_topics_key(subs: Column) -> Column:
    return F.array_join(F.array_sort(subs), ",")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null where one has no length."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def linked_files(html: Column, suffix: str = "pdf") -> Column:
    """Targets of links that end in the suffix."""
    return F.regexp_extract_all(html, F.lit(rf"""(?i)href=['"]?([^'" >]+\.{re.escape(suffix)})"""), F.lit(1))


def history_text(history: Column) -> Column:
    """role: text, a line each; role defaults to user."""
    return F.array_join(F.transform(history, lambda h: F.concat(F.coalesce(h["role"], F.lit("user")), F.lit(": "), F.coalesce(h["text"], F.lit("")))), "\n")


def render(template: str, **columns: Column) -> Column:
    """Placeholders {name} replaced in one pass; what is put in isn't scanned again."""
    parts = re.split(r"\{(" + "|".join(map(re.escape, columns)) + r")\}", template)
    return F.concat(*[F.coalesce(columns[p], F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def row_id(*keys: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", *[k.cast("string") for k in keys]), 256)


def source_url(base: Column, topic: Column, sub: Column, file: Column) -> Column:
    return F.concat_ws("/", base, topic, F.nullif(sub, F.lit("")), file)


def history_json(history: Column) -> Column:
    """The history as a JSON array; null as an empty one."""
    return F.to_json(F.coalesce(history, F.array().cast("array<struct<role:string,text:string>>")))


def suffix(name: Column) -> Column:
    """Lower-case suffix with its dot; '' without one."""
    return F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))


def artifact_name(rel_path: Column, is_markdown: Column) -> Column:
    return F.concat(rel_path, F.when(is_markdown, ".md").otherwise(".ocr"))


def meta_name(path: Column) -> Column:
    """Path of the sidecar that holds a file's origin."""
    return F.concat(path, F.lit(".meta"))


#: Elements whose text is no content, and the character references that are decoded (the ampersand last).
OUTSIDE = ("script", "style", "noscript", "nav", "header", "footer", "aside", "form", "title")
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def page_text(html: Column) -> Column:
    """Text of a page without comments and the elements of OUTSIDE, white space as one space. A plain default; any column function may take its place."""
    text = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in OUTSIDE:
        text = F.regexp_replace(text, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for name, char in REFERENCES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " "))


def resolved(base: Column, link: Column) -> Column:
    """Links against their page's URL; null where either is null or no URL."""

    def one(a: str | None, b: str | None) -> str | None:
        try:
            return None if a is None or b is None else urljoin(a, b)
        except ValueError:
            return None

    @F.pandas_udf("string")
    def run(bases: pd.Series, links: pd.Series) -> pd.Series:
        return pd.Series([one(a, b) for a, b in zip(bases, links, strict=True)], dtype=object)

    return run(base, link)


def file_name(url: Column) -> Column:
    """Last part of the URL's path; without one a name drawn from the URL."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")
    return F.coalesce(F.nullif(F.element_at(F.split(path, "/"), -1), F.lit("")), F.concat(F.lit("dl_"), F.substring(F.sha2(url, 256), 1, 8)))
