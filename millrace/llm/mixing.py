"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of (source, language, topic). The cells' token
weights are raked, one margin after another, until the sums by source, language
and topic have their target shares. The raked weights over the present tokens,
scaled to the sample's size, are the cells' probabilities. The size is the
largest at which no cell needs more than it has, so in expectation the sample
meets every margin. A caller may allow a `loss`: then the size is the largest at
which what cells need beyond what they have is at most that share of the sample,
and cells are raked again with what they have as their bound, so that others make
up for them. margins_met() says what a sample holds beside its targets.
A document's draw is a hash of its id; a cell
keeps the draws below a threshold at which its kept tokens are, to a document or
a thousandth, its probability's share of its tokens; a source's cells are rounded
one after another, so that their errors cancel. A rerun draws the same documents. Every
step is a DataFrame operation: sums with map-side combination, joins on the
margin, one written table a round.

Targets of a margin are stated shares (values without one divide the rest by
their observed shares), or else the observed shares to the power `temper`, times
the value's weight, scaled to sum to 1. Margins with stated targets are raked
first, and the shares observed then are those that the other margins temper, since
halves of two languages cannot keep the topics and sources of four. Tempering lifts small values and holds
down large ones. Stated targets that no document can meet are left out and the
rest rescaled; a cell whose target is 0 has probability 0 and none of its tokens
is kept. Where margins cannot all be met, the last fitted is met exactly.

A column `topic` of the input is the topic if there is one. Otherwise the words
of the text tell: the topic of TOPICS with most of its words in the text (ties to
the first), else "general".

Defined results: null source, language or topic is the value "(none)"; a null
or empty text has no token, probability 1 and is kept; a text of any length counts whole; a row
with a null id is drawn by its text; rows that repeat an id are drawn alike, by
the threshold of each row's cell; an empty table gives an empty result; further
columns are ignored by mix() and kept by sampled().
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import stored

MARGINS = ("source", "lang", "topic")
#: Words that tell a topic, in the corpus's languages. A fixed choice of this operator, to be replaced by the caller's.
TOPICS: dict[str, tuple[str, ...]] = {
    "licence": ("licence", "license", "licensed", "copyright", "warranty", "apache", "gnu", "lizenz", "licencia", "droits"),
    "technical": ("http", "https", "www", "html", "com", "org", "net", "api", "token", "password", "key", "error", "code", "server", "data"),
    "address": ("you", "your", "du", "dein", "ihr", "euch", "vous", "votre", "tu", "tus", "usted", "vosotros"),
}
#: Power of observed shares and weights of values where no target is stated: large sources are held down, and so are English and licence texts.
TEMPER = {"source": 0.8, "lang": 1.0, "topic": 1.0}
WEIGHTS = {"lang": {"en": 0.95}, "topic": {"licence": 0.7}}


def word_topic(text: Column, topics: dict[str, tuple[str, ...]]) -> Column:
    """The topic with most of its words in the text, ties to the first; "general" without any."""
    hits = [F.regexp_count(text, F.lit(rf"(?i)\b(?:{'|'.join(map(re.escape, words))})\b")) for words in topics.values()]
    if not hits:
        return F.lit("general")
    most = F.greatest(*hits) if len(hits) > 1 else hits[0]
    found = reduce(lambda at, x: at.when(x[1] == most, x[0]), zip(topics, hits, strict=True), F.when(most == 0, "general"))
    return found


def cell_columns(docs: DataFrame, topics: dict[str, tuple[str, ...]] = TOPICS) -> dict[str, Column]:
    """The margins, n_tokens (words) and draw (uniform in 0 to 1) of a document."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    named = lambda c: F.coalesce(docs[c].cast("string"), F.lit("(none)"))
    tokens = F.regexp_count(text, F.lit(r"\S+")).cast("long")
    draw = F.pmod(F.xxhash64(F.coalesce(docs["doc_id"].cast("string"), text), F.lit("draw")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return {"source": named("source"), "lang": named("lang"), "topic": named("topic") if "topic" in docs.columns else word_topic(text, topics), "n_tokens": tokens, "draw": draw}


def celled(docs: DataFrame, topics: dict[str, tuple[str, ...]] = TOPICS) -> DataFrame:
    """doc_id and the cell_columns() of every document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(k) for k, c in cell_columns(docs, topics).items()])


def _share(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with name: column over its sum, 0 where that is 0."""
    total = df.agg(F.sum(F.col(column).cast("double"))).first()[0] or 0.0
    return df.withColumn(name, F.col(column) / F.lit(total) if total else F.lit(0.0))


def target_shares(cells: DataFrame, margin: str, stated: dict[str, float] | None, temper: float, weights: dict[str, float], observed: str = "tokens") -> DataFrame:
    """The margin's values and target shares, which sum to 1 over the values present; `observed` is summed for present shares."""
    seen = _share(cells.groupBy(margin).agg(F.sum(observed).alias("seen")), "seen", "share")

    def named(values: dict[str, float], otherwise: Column) -> Column:
        return reduce(lambda c, kv: c.when(F.col(margin) == kv[0], F.lit(float(kv[1]))), values.items(), F.when(F.lit(False), F.lit(0.0))).otherwise(otherwise)

    if stated is None:
        wanted = F.pow("share", F.lit(temper)) * named(weights, F.lit(1.0))
    else:
        rest = max(0.0, 1.0 - sum(stated.values()))
        others = seen.where(~F.col(margin).isin(list(stated))).agg(F.sum("share")).first()[0] or 0.0
        wanted = named(stated, F.col("share") * (rest / others if others else 0.0))
    return _share(seen.select(margin, wanted.alias("wanted")), "wanted", "target").select(margin, "target")


def goal_shares(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: dict[str, float] | None = None, weights: dict[str, dict[str, float]] | None = None, observed: str = "tokens") -> dict[str, DataFrame]:
    """target_shares() of each margin."""
    temper, weights = TEMPER | (temper or {}), WEIGHTS if weights is None else weights
    return {m: target_shares(cells, m, (targets or {}).get(m), temper[m], weights.get(m, {}), observed) for m in MARGINS}


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: dict[str, float] | None = None, weights: dict[str, dict[str, float]] | None = None, tolerance: float = 2e-3, most_rounds: int = 12, size: float | None = None, observed: str = "tokens", margins: tuple[str, ...] = MARGINS, task_cells: int = 100_000) -> DataFrame:
    """Adds weight to cells (margins, tokens): raked shares of the token total, from those of the column `observed`.

    Stops when every margin is within tolerance of its target, or, where empty
    cells make that impossible, after most_rounds. With a size, no cell's weight
    is above its tokens over the size. Up to task_cells cells are one partition,
    so that a round shuffles and broadcasts nothing; beyond, sums are shuffled.
    """
    cells = stored(cells.where("tokens > 0"), "cells")
    small = cells.count() <= task_cells
    cells = cells.coalesce(1) if small else cells
    goals = goal_shares(cells, targets, temper, weights, observed)
    # Cells carry their targets, so a round joins nothing but the margin's sums.
    now = _share(cells, observed, "weight").select(*MARGINS, "tokens", "weight")
    for m in margins:
        goal = goals[m].withColumnRenamed("target", f"target_{m}")
        now = now.join(goal.hint("merge") if small else goal, m)
    now = stored(now, "raked")
    for _ in range(most_rounds):
        now = now.coalesce(1) if small else now
        for m in margins:
            factor = now.groupBy(m).agg(F.sum("weight").alias("sum"), F.first(f"target_{m}").alias("goal")).select(m, F.coalesce(F.col("goal") / F.nullif("sum", F.lit(0.0)), F.lit(0.0)).alias("factor"))
            grown = F.col("weight") * F.col("factor")
            now = now.join(factor.hint("merge") if small else factor, m).withColumn("weight", grown if size is None else F.least(grown, F.col("tokens") / F.lit(size))).drop("factor")
        now = stored(now.select(*MARGINS, "tokens", "weight", *(f"target_{m}" for m in margins)), "raked")
        values = F.array(*[F.struct(F.lit(m).alias("margin"), F.col(m).alias("value"), F.col(f"target_{m}").alias("target")) for m in margins])
        sums = (now.coalesce(1) if small else now).select("weight", F.explode(values).alias("v")).groupBy("v").agg(F.sum("weight").alias("sum"))
        off = sums.agg(F.max(F.abs(F.col("sum") - F.col("v.target")))).first()[0]
        if off is None or off <= tolerance:
            break
    return now.select(*MARGINS, "tokens", "weight")


def stated_first(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """cells with base: their tokens, or, where targets are stated, their weights after the stated margins alone are raked."""
    if not targets:
        return cells.withColumn("base", F.col("tokens"))
    return rake(cells, targets, margins=tuple(m for m in MARGINS if m in targets)).withColumnRenamed("weight", "base")


def sample_size(raked: DataFrame, loss: float, steps: int = 256) -> float:
    """Tokens of the largest sample in which cells lack at most the share `loss` of what their weights ask.

    Sizes between that of no loss and all tokens are tried in `steps` equal
    ratios, in one scan.
    """
    most, total = raked.agg(F.max(F.col("weight") / F.col("tokens")), F.sum("tokens").cast("double")).first()
    if not most:
        return 0.0
    exact = 1.0 / most
    if total <= exact:
        return exact
    sizes = [exact * (total / exact) ** (i / steps) for i in range(steps + 1)]
    asked = F.array(*[F.lit(s) for s in sizes])
    lacks = raked.select(F.posexplode(F.transform(asked, lambda s: F.greatest(F.lit(0.0), F.col("weight") - F.col("tokens") / s))).alias("i", "lack"))
    fits = lacks.groupBy("i").agg(F.sum("lack").alias("lack")).where(F.col("lack") <= loss)
    return sizes[fits.agg(F.max("i")).first()[0] or 0]


def probabilities(raked: DataFrame, size: float | None = None) -> DataFrame:
    """Adds probability to raked cells: weight over present tokens times the size, by default the largest at which no cell needs more than it has."""
    ratio = F.col("weight") / F.col("tokens")
    most = (raked.agg(F.max(ratio)).first()[0] or 0.0) if size is None else 1 / size
    return raked.withColumn("probability", F.least(F.lit(1.0), ratio / F.lit(most)) if most else F.lit(0.0))


def thresholds(rows: DataFrame, odds: DataFrame, bins: int = 1024) -> DataFrame:
    """Margins, probability and threshold of each cell: draws below it hold the probability's share of the cell's tokens.

    Draws are counted by bin first, so a cell is at most `bins` rows here, and
    what a source collects is bounded by its languages and topics.
    """
    binned = rows.where("n_tokens > 0").groupBy(*MARGINS, F.floor(F.col("draw") * bins).alias("bin")).agg(F.sum("n_tokens").alias("in_bin"))
    before = F.coalesce(F.sum("in_bin").over(Window.partitionBy(*MARGINS).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = binned.withColumn("before", before).join(odds, list(MARGINS)).withColumn("over", F.col("probability") * F.col("tokens") - F.col("before"))
    last = met.where((F.col("over") >= 0) & (F.col("over") < F.col("in_bin")) & (F.col("probability") > 0) & (F.col("probability") < 1))
    # The bin that holds the goal is kept or not, so that the source's kept tokens come nearest its goal; largest bins first.
    kind = "array<struct<lang:string,topic:string,take:boolean>>"
    cells = last.groupBy("source").agg(F.array_sort(F.collect_list(F.struct((-F.col("in_bin")).alias("order"), "lang", "topic", "over", "in_bin"))).alias("cells"))

    def decide(so_far: Column, x: Column) -> Column:
        without = so_far["off"] - x["over"]
        take = F.abs(without + x["in_bin"]) < F.abs(without)
        return F.struct((without + F.when(take, x["in_bin"]).otherwise(0)).alias("off"), F.concat(so_far["out"], F.array(F.struct(x["lang"].alias("lang"), x["topic"].alias("topic"), take.alias("take")))).alias("out"))

    chosen = F.aggregate("cells", F.struct(F.lit(0.0).alias("off"), F.array().cast(kind).alias("out")), decide, lambda x: x["out"])
    taken = cells.select("source", F.explode(chosen).alias("c")).select("source", "c.*")
    at = last.join(taken, list(MARGINS)).select(*MARGINS, ((F.col("bin") + F.col("take").cast("int")) / bins).alias("threshold"))
    return odds.join(at, list(MARGINS), "left").select(*MARGINS, "probability", F.when(F.col("probability") >= 1, 1.0).when(F.col("probability") <= 0, 0.0).otherwise(F.coalesce("threshold", F.lit(1.0))).alias("threshold"))


def cell_odds(rows: DataFrame, broadcast_cells: int = 100_000, targets: dict[str, dict[str, float]] | None = None, loss: float = 0.0, **how) -> DataFrame:
    """thresholds() of the raked cells of celled() rows.

    The cells are marked for broadcast only up to broadcast_cells of them;
    beyond, a join with them shuffles, and adaptive execution splits the cells
    that hold most rows.
    """
    cells = rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"))
    cells, size = stated_first(cells, targets), None
    raked = rake(cells, targets, observed="base", **how)
    if loss:
        size = sample_size(raked, loss)
        raked = rake(cells, targets, size=size, observed="base", **how) if size else raked
    odds = stored(thresholds(rows, probabilities(raked, size)), "odds")
    return F.broadcast(odds) if odds.count() <= broadcast_cells else odds


def mix(docs: DataFrame, topics: dict[str, tuple[str, ...]] = TOPICS, **how) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability, kept of every document."""
    rows = stored(celled(docs, topics), "celled")
    out = rows.join(cell_odds(rows, **how), list(MARGINS), "left")
    return out.select("doc_id", *MARGINS, "n_tokens", F.when(F.col("n_tokens") == 0, 1.0).otherwise(F.coalesce("probability", F.lit(1.0))).alias("probability"), _kept().alias("kept"))


def margins_met(mixed: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: dict[str, float] | None = None, weights: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """margin, value, target and share (of the kept tokens) for every value of the rows of mix(), which was called alike."""
    cells = mixed.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"), F.sum(F.when(F.col("kept"), F.col("n_tokens")).otherwise(0)).alias("held"))
    cells = stored(cells.where("tokens > 0"), "held")
    goals = goal_shares(stated_first(cells, targets), targets, temper, weights, "base")
    shares = {m: _share(cells.groupBy(m).agg(F.sum("held").alias("held")), "held", "share") for m in MARGINS}
    return reduce(DataFrame.unionByName, [shares[m].join(goals[m], m).select(F.lit(m).alias("margin"), F.col(m).alias("value"), "target", "share") for m in MARGINS])


def _kept() -> Column:
    return (F.col("n_tokens") == 0) | (F.col("draw") < F.coalesce("threshold", F.lit(1.0)))


def sampled(docs: DataFrame, topics: dict[str, tuple[str, ...]] = TOPICS, **how) -> DataFrame:
    """The documents that are drawn, with the columns of docs."""
    odds = cell_odds(stored(celled(docs, topics), "celled"), **how)
    wide = docs.select(F.struct(*docs.columns).alias("row"), *[c.alias(k) for k, c in cell_columns(docs, topics).items()])
    return wide.join(odds, list(MARGINS), "left").where(_kept()).select("row.*")
