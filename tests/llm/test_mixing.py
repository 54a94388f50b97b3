"""Mixing against plain iterative proportional fitting, and what the sample holds."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing

SF = "/root/testdata/sf0.01"


def plain_targets(cells, stated):
    total = sum(cells.values())
    out = []
    for m, name in enumerate(mixing.MARGINS):
        seen = defaultdict(float)
        for key, tokens in cells.items():
            seen[key[m]] += tokens / total
        if name in stated:
            others = sum(v for k, v in seen.items() if k not in stated[name])
            rest = max(0.0, 1 - sum(stated[name].values()))
            wanted = {k: stated[name].get(k, v * rest / others if others else 0.0) for k, v in seen.items()}
        else:
            wanted = {k: v ** mixing.TEMPER[name] * mixing.WEIGHTS.get(name, {}).get(k, 1.0) for k, v in seen.items()}
        out.append({k: v / sum(wanted.values()) for k, v in wanted.items()})
    return out


def plain_rake(cells, targets, rounds=12, tolerance=2e-3):
    weight = {k: v / sum(cells.values()) for k, v in cells.items()}

    def sums(m):
        out = defaultdict(float)
        for key, w in weight.items():
            out[key[m]] += w
        return out

    for _ in range(rounds):
        for m in range(3):
            now = sums(m)
            weight = {k: w * targets[m][k[m]] / now[k[m]] for k, w in weight.items()}
        if max(abs(w - targets[m][k]) for m in range(3) for k, w in sums(m).items()) <= tolerance:
            break
    return weight


@pytest.fixture(scope="module")
def rows(spark):
    return mixing.celled(spark.read.parquet(f"{SF}/documents.parquet"))


@pytest.mark.parametrize("stated", [{}, {"lang": {"en": 0.4, "de": 0.3}}, {"lang": {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}, "topic": {"general": 0.5}}])
@pytest.mark.parametrize("task_cells", [100_000, 0])
def test_weights_equal_plain_fitting(rows, stated, task_cells):
    cells = rows.groupBy(*mixing.MARGINS).agg(F.sum("n_tokens").alias("tokens"))
    plain = {(r.source, r.lang, r.topic): r.tokens for r in cells.collect() if r.tokens}
    want = plain_rake(plain, plain_targets(plain, stated))
    got = {(r.source, r.lang, r.topic): r.weight for r in mixing.rake(cells, stated, task_cells=task_cells).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_the_sample_is_nearer_to_every_margin_than_the_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = mixing.mix(docs).collect()
    assert len(out) == docs.count() and all(0 < r.probability <= 1 for r in out) and max(r.probability for r in out) == 1
    cells, kept = defaultdict(int), defaultdict(int)
    for r in out:
        cells[r.source, r.lang, r.topic] += r.n_tokens
        kept[r.source, r.lang, r.topic] += r.n_tokens * r.kept
    targets = plain_targets({k: v for k, v in cells.items() if v}, {})

    def off(found, m):
        sums, total = defaultdict(float), sum(found.values())
        for key, tokens in found.items():
            sums[key[m]] += tokens / total
        return sum(abs(sums[k] - t) for k, t in targets[m].items())

    for m in range(3):
        assert off(kept, m) < off(cells, m)
    assert sum(kept.values()) > 0.5 * sum(cells.values())


def test_topics_are_told_by_words(spark):
    texts = {1: "licensed under the Apache License", 2: "see https and www", 3: "you and your du", 4: "plain words", 5: None, 6: "you license"}
    frame = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = {r.id: r.topic for r in frame.select("id", mixing.word_topic(F.coalesce("text", F.lit("")), mixing.TOPICS).alias("topic")).collect()}
    assert got == {1: "licence", 2: "technical", 3: "address", 4: "general", 5: "general", 6: "licence"}


def test_sampled_are_the_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("probability", F.lit("clash")).withColumn("draw", F.lit(1))
    kept = {r.doc_id for r in mixing.mix(docs).where("kept").collect()}
    out = mixing.sampled(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == kept


def plain_draw(rows, raked, bins=1024):
    """Ids kept and probability of each cell: whole bins of draws, a source's last ones taken so that its errors cancel."""
    cells = defaultdict(lambda: defaultdict(int))
    for r in rows:
        cells[r.source, r.lang, r.topic][int(r.draw * bins)] += r.n_tokens
    tokens = {k: sum(v.values()) for k, v in cells.items()}
    most = max((w / tokens[k] for k, w in raked.items()), default=0)
    odds = {k: min(1.0, w / tokens[k] / most) for k, w in raked.items()}
    limit, last = {}, defaultdict(list)
    for k, p in odds.items():
        limit[k] = 1.0 if p >= 1 else 0.0
        before = 0
        for b in sorted(x for x, n in cells[k].items() if n):
            if 0 < p < 1 and before <= p * tokens[k] < before + cells[k][b]:
                last[k[0]].append((-cells[k][b], k, p * tokens[k] - before, b))
            before += cells[k][b]
    for found in last.values():
        off = 0.0
        for size, k, over, b in sorted(found):
            off -= over
            take = abs(off - size) < abs(off)
            off += -size if take else 0
            limit[k] = (b + take) / bins
    return {r.doc_id for r in rows if r.n_tokens == 0 or r.draw < limit[r.source, r.lang, r.topic]}, odds


def plain_fit(rows, stated):
    cells = defaultdict(int)
    for r in rows:
        cells[r.source, r.lang, r.topic] += r.n_tokens
    cells = {k: v for k, v in cells.items() if v}
    if not stated:
        return plain_rake(cells, plain_targets(cells, {}))
    at = [mixing.MARGINS.index(m) for m in stated]
    alone = plain_targets(cells, stated)
    base = {k: v for k, v in cells.items() if all(alone[m][k[m]] for m in at)}
    assert len(at) == 1
    sums = defaultdict(float)
    for k, v in base.items():
        sums[k[at[0]]] += v
    base = {k: v * alone[at[0]][k[at[0]]] / sums[k[at[0]]] for k, v in base.items()}
    return {**dict.fromkeys(cells, 0.0), **plain_rake(base, plain_targets(base, stated))}


@pytest.mark.parametrize("stated", [{}, {"lang": {"en": 0.5, "de": 0.5}}])
def test_the_draw_equals_a_plain_one(spark, rows, stated):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = rows.collect()
    want, odds = plain_draw(held, plain_fit(held, stated))
    got = mixing.mix(docs, targets=stated).collect()
    assert {r.doc_id for r in got if r.kept} == want
    for r in got:
        assert r.probability == pytest.approx(odds[r.source, r.lang, r.topic] if r.n_tokens else 1, abs=1e-9)
        assert not (r.kept and r.probability == 0)


def test_stated_halves_stay_halves_of_a_large_sample(spark):
    docs, stated = spark.read.parquet(f"{SF}/documents.parquet"), {"lang": {"en": 0.5, "de": 0.5}}
    out = mixing.mix(docs, targets=stated)
    tokens = {r.lang: (r.all, r.held) for r in out.groupBy("lang").agg(F.sum("n_tokens").alias("all"), F.sum(F.when(F.col("kept"), F.col("n_tokens")).otherwise(0)).alias("held")).collect()}
    held = sum(h for _, h in tokens.values())
    assert tokens["fr"][1] == tokens["es"][1] == 0
    assert held > 0.7 * 2 * tokens["de"][0]  # no sample with halves has more than twice the German tokens
    for r in mixing.margins_met(out, stated).collect():
        # Eighty cells of a few documents each, drawn whole; errors cancel within a source only.
        assert r.target == pytest.approx(r.share, abs=0.05 if r.margin == "topic" else 0.03)


def test_a_loss_lets_a_sample_grow_past_its_smallest_cell(spark):
    rows = [(i, "a", "en", "x", "w " * 100) for i in range(400)] + [(1000 + i, "a", "de", "x", "w " * 100) for i in range(400)]
    rows += [(2000 + i, "b", "de", "y", "w " * 100) for i in range(400)] + [(3000, "b", "en", "y", "w " * 100)]
    docs, how = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, text string"), {"targets": {"lang": {"en": 0.5, "de": 0.5}, "topic": {"x": 0.5, "y": 0.5}}, "temper": {"source": 1.0}, "weights": {}}
    share = lambda out: {r.lang: r.share for r in mixing.margins_met(out, **how).where("margin = 'lang'").withColumnRenamed("value", "lang").collect()}
    exact, loose = mixing.mix(docs, **how), mixing.mix(docs, loss=0.04, **how)
    assert 20 < exact.where("kept").count() < 80 and loose.where("kept").count() > 700
    assert all(abs(v - 0.5) < 0.05 for v in share(loose).values())
