"""The configuration program of packing, against its dual bound and the exact tokenizer."""

from collections import Counter
from math import ceil

import numpy as np
import pytest

from millrace.llm import packing
from millrace.llm.queries import WORD_BPE


def sequences(plan):
    return sum(n for _, n in plan)


def held(plan):
    out = Counter()
    for config, n in plan:
        for x, c in config.items():
            out[x] += c * n
    return out


def lengths(seed, n, low, high):
    return Counter(np.random.default_rng(seed).integers(low, high, n).tolist())


@pytest.mark.parametrize("histogram", [Counter({2048: 40}) + lengths(1, 3000, 2, 900), lengths(2, 400, 500, 1400), lengths(3, 50_000, 1, 300), Counter({700: 3000, 650: 3000, 300: 1000})])
def test_the_program_places_most_pieces_near_its_bound(histogram):
    need = np.zeros(2049, np.int64)
    for x, n in histogram.items():
        need[x] = n
    used, bound = packing.fractional(need, 2048, 16, 0.5, 0.01)
    cover = Counter()
    for config, times in used.items():
        assert sum(x * c for x, c in config) <= 2048
        for x, c in config:
            cover[x] += c * times
    assert all(cover[x] >= n - 1e-6 for x, n in histogram.items())
    plan = packing.solve(dict(histogram), 2048)
    assert held(plan) == histogram and all(sum(x * c for x, c in config.items()) <= 2048 for config, _ in plan)
    best_fit = sequences(packing._remainder(need, 2048))
    assert ceil(bound - 1e-6) <= sequences(plan) <= min(1.04 * bound + 2, 1.002 * best_fit + 1)


def test_best_values_are_those_of_all_multisets():
    price = np.zeros(13)
    price[[3, 5, 7]] = 3.1, 5.0, 6.0
    need = np.zeros(13, np.int64)
    need[[3, 5, 7]] = 9, 2, 1
    best = [max(3.1 * a + 5 * b + 6 * c for a in range(5) for b in range(3) for c in range(2) if 3 * a + 5 * b + 7 * c <= n) for n in range(13)]
    assert packing.best_values(price, need, 12) == pytest.approx(best)


def test_solve_small():
    assert packing.solve({}, 2048) == []
    assert packing.solve({1: 3}, 2048) == [({1: 3}, 1)]
    assert sequences(packing.solve({2048: 2, 1: 1}, 2048)) == 3


def test_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    exact, known = Tokenizer.from_file(WORD_BPE), packing.ChunkIds(WORD_BPE, most=8)
    for text in ("a <|ENDOFTEXT|> b", "x<|endoftext|>Y Z", "<|EndOfText|>, Über <| ABC", "The cat. İstanbul ǅ", "one two three four five six seven eight nine ten one two. nine", "", " \t\n"):
        for _ in range(2):
            assert np.frombuffer(known.of(text), "<u4").tolist() == exact.encode(text, add_special_tokens=False).ids
    assert len(known) <= 9 and len(known.older) <= 9


@pytest.mark.parametrize("most", [64, 512, 2048])
def test_never_above_best_fit_on_uniform_lengths(most):
    rng = np.random.default_rng(most)
    need = np.bincount(rng.integers(1, most + 1, 100_000), minlength=2049)
    plan = packing.solve({int(x): int(need[x]) for x in np.flatnonzero(need)}, 2048)
    held = np.zeros_like(need)
    for config, times in plan:
        assert sum(x * n for x, n in config.items()) <= 2048
        for x, n in config.items():
            held[x] += n * times
    assert (held == need).all()
    assert sum(t for _, t in plan) <= sum(t for _, t in packing._remainder(need, 2048))
