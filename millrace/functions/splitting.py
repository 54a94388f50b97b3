"""Recursive text splitting and markdown sections, as pandas UDFs over whole columns.

Sizes are counted by a named counter: "words" (words and punctuation marks),
"chars", or the path of a .tiktoken file, whose tokens count. No vocabulary is
assumed or fetched.
"""

from __future__ import annotations

import base64
import re
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARENT = ("\n\n", "\n", ". ", " ")
CHILD = (*PARENT, "")
_WORD = re.compile(r"\w+|[^\w\s]")
#: Rows whose pieces are held and sent on at once, whatever the rows of an Arrow batch.
ROWS = 100
COUNTERS: dict[str, Callable[[str], int]] = {"words": lambda s: len(_WORD.findall(s)), "chars": len}
#: How byte-level vocabularies part a text before they merge: a public, fixed pattern.
PARTS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def counter(name: str) -> Callable[[str], int]:
    """The named counter, or the tokens of the vocabulary at a path."""
    if name in COUNTERS:
        return COUNTERS[name]
    import tiktoken

    with open(name, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("file", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={})
    return lambda s: len(encoding.encode_ordinary(s))


def split_text(text: str, separators: tuple[str, ...], size: int, overlap: int, count: Callable[[str], int]) -> list[str]:
    """Chunks of at most `size` where separators allow, each keeping `overlap` of the one before."""
    if overlap > size:
        raise ValueError("overlap is larger than size")
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    separator, deeper = separators[at], separators[at + 1 :]
    pieces = list(text) if not separator else [p for p in re.split(f"(?={re.escape(separator)})", text) if p]
    out: list[str] = []
    small: list[tuple[str, int]] = []
    for piece in pieces:
        n = count(piece)
        if n < size:
            small.append((piece, n))
            continue
        out += _joined(small, size, overlap)
        small = []
        out += split_text(piece, deeper, size, overlap, count) if deeper else [piece]
    return out + _joined(small, size, overlap)


def _joined(pieces: list[tuple[str, int]], size: int, overlap: int) -> list[str]:
    out: list[str] = []
    window: deque[tuple[str, int]] = deque()
    total = 0
    for piece, n in pieces:
        if window and total + n > size:
            out.append("".join(p for p, _ in window).strip())
            while window and (total > overlap or (total + n > size and total > 0)):
                total -= window.popleft()[1]
        window.append((piece, n))
        total += n
    out.append("".join(p for p, _ in window).strip())
    return [x for x in out if x]


def markdown_sections(text: str) -> list[tuple[str, dict[str, str]]]:
    """Sections under headings of levels 1 to 4, heading lines kept; fenced lines are content."""
    blocks: list[tuple[list[str], dict[str, str]]] = []
    open_headings: list[tuple[int, str]] = []
    lines: list[str] = []
    fence = ""

    def flush() -> None:
        if lines:
            blocks.append((list(lines), {f"Header {n}": t for n, t in open_headings}))
            lines.clear()

    for raw in text.split("\n"):
        line = "".join(c for c in raw.strip() if c.isprintable())
        if fence:
            lines.append(line)
            fence = "" if line.startswith(fence) else fence
            continue
        if (line.startswith("```") and line.count("```") == 1) or line.startswith("~~~"):
            fence = line[:3]
            lines.append(line)
        elif m := re.fullmatch(r"(#{1,4})(?: (.*))?", line):
            flush()
            level = len(m[1])
            open_headings = [h for h in open_headings if h[0] < level] + [(level, (m[2] or "").strip())]
            lines.append(line)
        elif line:
            lines.append(line)
        else:
            flush()
    flush()
    merged: list[tuple[str, dict[str, str]]] = []
    for block, heads in blocks:
        content = "\n".join(block)
        if merged and (merged[-1][1] == heads or (len(merged[-1][1]) < len(heads) and merged[-1][0].split("\n")[-1].startswith("#"))):
            content = merged.pop()[0] + "  \n" + content
        merged.append((content, heads))
    return merged


def _few(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[tuple[pd.Series, ...]]:
    """Batches of columns in slices of at most ROWS rows."""
    for part in parts:
        for at in range(0, len(part[0]), ROWS):
            yield tuple(column.iloc[at : at + ROWS] for column in part)


def split_column(text: Column, size: Column, overlap: Column, children: bool, name: str = "words") -> Column:
    """Array of chunks; null where the overlap is over the size."""
    separators = CHILD if children else PARENT

    @F.pandas_udf("array<string>")
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        count = counter(name)
        for t, s, o in _few(parts):
            yield pd.Series([None if b > a else split_text(x or "", separators, int(a), int(b), count) for x, a, b in zip(t, s, o, strict=True)], dtype=object)

    return run(text, size, overlap)


def sections_column(text: Column) -> Column:
    """Array of sections with their headers."""

    @F.pandas_udf("array<struct<content:string,headers:map<string,string>>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for (t,) in _few((part,) for part in parts):
            yield pd.Series([[{"content": c, "headers": h} for c, h in markdown_sections(x or "")] for x in t], dtype=object)

    return run(text)


def parents_column(text: Column, is_markdown: Column, size: Column, name: str = "words") -> Column:
    """Array of parents (content, headers) of each document: inside sections where it is markdown."""

    @F.pandas_udf("array<struct<content:string,headers:map<string,string>>>")
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        count = counter(name)
        for t, m, s in _few(parts):
            out = []
            for x, marked, most in zip(t, m, s, strict=True):
                sections = markdown_sections(x or "") if marked else [(x or "", {})]
                out.append([{"content": c, "headers": h} for content, h in sections for c in split_text(content, PARENT, int(most), 0, count)])
            yield pd.Series(out, dtype=object)

    return run(text, is_markdown, size)


_KEY = ["topic_id", "sub_topic_id", "source"]


def document_parents(docs: DataFrame, name: str = "words") -> DataFrame:
    """Parents of documents with chunk_size, chunk_overlap, parent_chunk_size columns; the first two go with them."""
    from millrace.functions.text import row_id

    marked = F.coalesce(F.col("is_markdown"), F.lit(False)) if "is_markdown" in docs.columns else F.lit(False)
    found = docs.where(F.col("chunk_overlap") <= F.col("chunk_size")).select(*_KEY, "chunk_size", "chunk_overlap", F.posexplode(parents_column(F.col("text"), marked, F.col("parent_chunk_size"), name)).alias("parent_index", "parent"))
    return found.select(*_KEY, "chunk_size", "chunk_overlap", "parent_index", "parent.*").withColumn("parent_id", row_id(*map(F.col, [*_KEY, "parent_index"])))


def parent_chunks(parents: DataFrame, name: str = "words") -> DataFrame:
    """Chunks of document_parents."""
    from millrace.functions.text import row_id

    chunks = parents.select("parent_id", *_KEY, F.posexplode(split_column(F.col("content"), F.col("chunk_size"), F.col("chunk_overlap"), True, name)).alias("child_index", "content"))
    return chunks.withColumn("chunk_id", row_id(F.col("parent_id"), F.col("child_index")))


def chunk_documents(docs: DataFrame, name: str = "words") -> tuple[DataFrame, DataFrame]:
    """(parents, chunks) of documents with chunk_size, chunk_overlap, parent_chunk_size columns.

    Where is_markdown holds, parents are split inside sections and have their
    headers; plain documents have an empty map. A document whose overlap is over
    its chunk size gives nothing.
    """
    parents = document_parents(docs, name)
    return parents.drop("chunk_size", "chunk_overlap"), parent_chunks(parents, name)
