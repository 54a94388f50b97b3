"""Operators and the pipeline against plain Python, row by row."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from millrace.llm import langid, secrets, toxicity
from millrace.llm.queries import WORD_BPE

SF = "/root/testdata/sf0.001"
MASK = (1 << 32) - 1


def grams(text):
    chars, out = [" "], []
    for c in text.lower():
        c = c if c.isalpha() or ord(c) >= 0x300 else " "
        if not (c == " " and len(chars) > 1 and chars[-1] == " "):
            chars.append(c)
    chars.append(" ")
    for n in (1, 2, 3):
        for i in range(len(chars) - n + 1):
            h = 0
            for c in chars[i : i + n]:
                h = ((h ^ ord(c)) * 0x9E3779B1) & MASK
                h ^= h >> 15
            out.append(((h * 0x85EBCA77 + n - 1) & MASK) >> 17)
    return out


def test_language_equals_plain_naive_bayes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r for r in docs.select("doc_id", "text", "lang").collect() if r.text is not None]
    seen, n_docs = defaultdict(Counter), Counter()
    for r in rows:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            seen[r.lang].update(grams(r.text))
            n_docs[r.lang] += 1
    total = {x: sum(c.values()) + 0.5 * (1 << 15) for x, c in seen.items()}
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    for r in rows[:80]:
        if not any(map(str.isalpha, r.text)):
            assert got[r.doc_id].lang_pred == "und"
            continue
        counts = Counter(grams(r.text))
        logs = {x: math.log(n_docs[x] / sum(n_docs.values())) + sum(n * math.log((seen[x][g] + 0.5) / total[x]) for g, n in counts.items()) for x in sorted(seen)}
        best = max(logs, key=logs.get)
        assert got[r.doc_id].lang_pred == best
        assert got[r.doc_id].score == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()), abs=1e-6)


def plain_label_model(votes, labels, times, rounds=8, trust=0.9):
    """Expectation maximization with loops instead of matrices."""
    n, m = len(votes), len(votes[0])
    q = [trust if y > 0 else 1 - trust for y in labels]
    given = [math.log(p / (1 - p)) for p in q]
    silent = [not any(v) for v in votes]
    for _ in range(rounds):
        parts = [[q[i] * times[i] for i in range(n)], [(1 - q[i]) * times[i] for i in range(n)]]
        weight, rates, quiet = [0.0] * m, [], []
        for part in parts:
            size = sum(part)
            fired = [sum(part[i] for i in range(n) if votes[i][j]) for j in range(m)]
            rate = [(f + 0.5) / (size + 1) for f in fired]
            rates.append(rate)
            quiet.append(math.log((sum(p for p, s in zip(part, silent, strict=True) if s) + 0.5) / (size + 1)))
            cov = [[sum(part[i] * (votes[i][a] - rate[a]) * (votes[i][b] - rate[b]) for i in range(n)) / max(size, 1e-9) for b in range(m)] for a in range(m)]
            sd = [math.sqrt(max(cov[j][j], 1e-6)) for j in range(m)]
            weight = [max(weight[a], sum(min(1, max(0, cov[a][b] / sd[a] / sd[b])) for b in range(m) if b != a)) for a in range(m)]
        odds = [given[i] + sum(votes[i][j] * math.log(rates[0][j] / rates[1][j]) / (1 + weight[j]) for j in range(m)) + silent[i] * (quiet[0] - quiet[1]) for i in range(n)]
        q = [min(1 - 1e-4, max(1e-4, 1 / (1 + math.exp(-min(30, max(-30, o)))))) for o in odds]
    return q


def test_label_model_equals_plain_loops():
    rng = np.random.default_rng(6)
    truth = rng.random(60) < 0.4
    votes = (rng.random((60, 5)) < np.where(truth[:, None], [0.7, 0.6, 0.6, 0.3, 0.1], [0.05, 0.1, 0.1, 0.2, 0.1])).astype(np.uint8)
    votes[:, 2] = votes[:, 1]  # two voters that always agree
    labels = np.where(rng.random(60) < 0.9, truth, ~truth).astype(float)
    times = rng.integers(1, 9, 60).astype(float)
    got = toxicity.label_model(votes, labels, times)
    assert got == pytest.approx(plain_label_model(votes.tolist(), labels.tolist(), times.tolist()), abs=1e-7)


def groups(rows):
    """Smallest id of each group of documents that plain Jaccard links."""
    sets = {}
    for r in rows:
        w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in (r.text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if x]
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    return {i: root(i) for i in sets}


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as p
    from millrace.llm.shared import stored

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = stored(p.reject_toxic(spark, docs, SF), "t1")
    called = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - called

    single = stored(p.drop_near_copies(spark, clean, SF), "t2")
    least = groups(clean.collect())
    assert sorted(r.doc_id for r in single.collect()) == sorted({r for r in least.values()})

    told = stored(p.redact_secrets(spark, single, SF), "t3")
    found = defaultdict(list)
    for r in secrets.scan(single).collect():
        found[r.doc_id].append(r)
    before, after = ({r.doc_id: r.text for r in d.collect()} for d in (single, told))
    assert before.keys() == after.keys() and all(after[i] == before[i] or i in found for i in before) and told.columns == docs.columns

    mixed = stored(p.mix_sources(spark, told, SF), "t4")
    kept = {r.doc_id: r.text for r in mixed.collect()}
    assert kept.items() <= after.items() and len(kept) > 0.5 * len(after)

    packed = p.pack_sequences(spark, mixed, SF).collect()
    tokenizer, by_doc, by_sequence = Tokenizer.from_file(WORD_BPE), defaultdict(list), defaultdict(list)
    for r in packed:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == kept.keys()
    for i, text in kept.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(r.start, r.length, r.ids_crc32) for r in pieces] == [(a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for a in range(0, len(ids), 2048)]
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as p

    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert p.run(spark, str(tmp_path)).collect() == []
