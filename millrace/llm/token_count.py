"""Token counts of a unigram tokenizer, without making the tokens.

Aho-Corasick enumerates the vocabulary pieces that end at each position of a
word; dynamic programming carries the best score and the number of pieces of
the best path. Ties go as in the exact tokenizer: of two paths of equal score to
a position, the one whose last piece starts earlier stays. Where no piece of one
character starts, an unknown piece of that character is possible, at the
smallest vocabulary score less 10; neighbouring unknown pieces count as one.

The text is split at white space (Unicode White_Space) and each word gets the
word-start mark, so a count is a sum over words and words are remembered.

Defined results: a null, empty or blank text has 0 tokens; rows that repeat an
id are counted one by one; an empty table gives an empty result; further columns
of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import in_batches, slices

MARK = "▁"
#: str.split() also splits at U+001C to U+001F, which are no White_Space.
_RARE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[" + "".join(c for c in map(chr, range(0x3001)) if c.isspace() and not "\x1c" <= c <= "\x1f") + "]+")
UNKNOWN_PENALTY = 10.0


def unigram_vocabulary(model_path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file, special and byte pieces left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = range(model.get_piece_size())
    return [(model.id_to_piece(i), model.get_score(i)) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class UnigramCounter(dict):
    """(tokens, unknown tokens) of a word with its start mark, remembered."""

    def __init__(self, vocabulary: Iterable[tuple[str, float]], most: int = 500_000) -> None:
        super().__init__()
        import ahocorasick

        pieces = dict(vocabulary)
        self.machine, self.most = ahocorasick.Automaton(), most
        for piece, score in pieces.items():
            self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.single = frozenset(p for p in pieces if len(p) == 1)
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= self.most:
            self.clear()
        found = self.count(MARK + word)
        self[word] = found
        return found

    def count(self, text: str) -> tuple[int, int]:
        n = len(text)
        best = [0.0] * (n + 1)
        made = [0] * (n + 1)
        missed = [-1] * (n + 1)  # unknown pieces so far, -1 where nothing ends yet
        last_unknown = [False] * (n + 1)
        missed[0] = 0
        single, unknown = self.single, self.unknown
        at = 0

        def finish(end: int) -> None:
            """The unknown edge of one character comes last: it starts latest."""
            start = end - 1
            if text[start] not in single:
                score = best[start] + unknown
                if missed[end] < 0 or score > best[end]:
                    again = not last_unknown[start]
                    best[end], made[end], missed[end], last_unknown[end] = score, made[start] + again, missed[start] + again, True

        for stop, (size, piece_score) in self.machine.iter(text):
            end = stop + 1
            while at < stop:
                at += 1
                finish(at)
            start = end - size
            score = best[start] + piece_score
            if missed[end] < 0 or score > best[end]:
                best[end], made[end], missed[end], last_unknown[end] = score, made[start] + 1, missed[start], False
        while at < n:
            at += 1
            finish(at)
        return made[n], missed[n]

    def text(self, text: str | None) -> tuple[int, int, int]:
        """Words, tokens and unknown tokens of a whole text."""
        if not text:
            return 0, 0, 0
        words = [w for w in _SPACE.split(text) if w] if _RARE.search(text) else text.split()
        if not words:
            return 0, 0, 0
        tokens, unknown = zip(*map(self.__getitem__, words), strict=True)
        return len(words), sum(tokens), sum(unknown)


@lru_cache(maxsize=2)
def _counter(path: str) -> UnigramCounter:
    return UnigramCounter(unigram_vocabulary(path))


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in slices(batches):
            rows = [counter.text(t) for t in batch.column("text").to_pylist()]
            words, tokens, unknown = zip(*rows, strict=True)
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (words, tokens, unknown))], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return run


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of every whole text, by the vocabulary at path."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.transform(in_batches, _count(path), "doc_id long, n_words long, n_tokens long, n_unknown long")
