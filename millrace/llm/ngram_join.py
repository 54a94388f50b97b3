"""Exact n-gram Jaccard self-join of documents, and the groups it forms.

A document is its set of distinct word shingles, as 64-bit hashes. Equal sets
are one class from the start. Classes meet where they share a shingle of their
prefixes: under one order of all shingles, two sets of Jaccard similarity t or
more share one of their first n - ceil(t n) + 1 elements, so no link is lost.
The order puts frequent shingles last; which ones count as frequent comes from
a sample and changes only the cost, never the result.

Members of a prefix shingle are first held against one hub each, so a group of
near copies costs a comparison a member and not one a pair. What then still
lies in different components meets in tiles: (shingle, size band, two salt
blocks). In a tile, sizes and the places of the common shingle bound the
overlap; for each pair that passes, once, parity bitmaps of the sets bound it
by their bit counts, and what is left is compared by exact intersection of the
sorted arrays.

No task gets a hot key's rows whole: signatures of many copies meet their class
by a broadcast of a bounded number of classes, and prefix shingles that a sample
finds very frequent are dealt to salted parts with a hub each.

Defined results: a null or blank text has no shingle and links with nothing; a
text under the shingle width is one shingle of all its words; texts of any
length are compared whole; rows that repeat a doc_id are one document: each has
the number of shingles of its own text, and all have one component, which joins
what any of them links with; a null doc_id takes part as no document and gets a
null component; an empty table gives an empty result; further columns of the
input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import in_batches, slices, stored

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_R23, _R41, _R29 = np.uint64(23), np.uint64(41), np.uint64(29)
#: 64-bit words of a bitmap signature, and of the second one that sets of more
#: than LONG shingles have. From about 36,000 shingles on that one is too full
#: to reject anything either, and such pairs go straight to the exact overlap.
BIT_WORDS, WIDE_WORDS, LONG = 32, 256, 4096


class WordHashes(dict):
    """Hash of a word, remembered; forgets all when it has grown large."""

    def __init__(self, most: int = 100_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def shingles(text: str | None, known: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a whole text."""
    if not text:
        return np.empty(0, np.int64)
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64)
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(width, len(w))
    rows = len(w) - size + 1
    h = np.full(rows, size, np.uint64)
    for i in range(size):
        h = ((h << _R23) | (h >> _R41)) ^ w[i : i + rows]
        h *= _M1
    h ^= h >> _R29
    h *= _M2
    return np.unique(h.view(np.int64))


def prefix(found: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The first n - ceil(t n) + 1 elements, frequent shingles last."""
    n = len(found)
    if not n:
        return found
    p = n - -(-n * percent // 100) + 1

    def is_frequent(x: np.ndarray) -> np.ndarray:
        if not len(frequent):
            return np.zeros(len(x), bool)
        return frequent[np.minimum(np.searchsorted(frequent, x), len(frequent) - 1)] == x

    head = found[: p + p // 4 + 8]
    plain = head[~is_frequent(head)]
    if len(plain) < p:
        late = is_frequent(found)
        plain = np.concatenate([found[~late], found[late]])
    return plain[:p]


def bitmap(found: np.ndarray, words: int = BIT_WORDS) -> np.ndarray:
    """Parity of the set's elements on each of the bitmap's positions."""
    bits = np.bincount((found & (64 * words - 1)), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))


def _signatures(width: int, percent: int, frequent: np.ndarray):
    """doc_id, n, sig, bits, wide and items, the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches):
            sets = [shingles(t, known, width) for t in batch.column("text").to_pylist()]
            sigs = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            items = [prefix(s, frequent, percent) for s in sets]
            yield pa.record_batch([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary()), _lists([bitmap(x) for x in sets]), _lists([bitmap(x, WIDE_WORDS) if len(x) > LONG else x[:0] for x in sets]), _lists(items)], names=["doc_id", "n", "sig", "bits", "wide", "items"])

    return run


_SIGNATURES = "doc_id long, n long, sig binary, bits array<long>, wide array<long>, items array<long>"


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches):
            sets = [shingles(t, known, width) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), _lists(sets)], names=["id", "items"])

    return run


def _sorted_sets(width: int):
    """id and the sorted shingles as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches):
            yield pa.record_batch([batch.column("doc_id"), pa.array([shingles(t, known, width).tobytes() for t in batch.column("text").to_pylist()], pa.binary())], names=["id", "items"])

    return run


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct numbers."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def _linked(percent: int):
    """The pairs (a, b) whose sorted sets x and y link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for left, right in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.int64) for v in (left, right))
                both = common(x, y)
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id, component of every node of links (a, b): the smallest id reachable.

    Alternating large and small stars; each round is a written table. A node
    with very many links is a skewed join key, which adaptive execution splits.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")

    def mark(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(edges)
    for _ in range(most_rounds if before[0] else 0):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = stored(small, "star")
        if (after := mark(edges)) == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    grouped = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return grouped.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _may_link(a: str, b: str, percent: int) -> Column:
    """By sizes and bit counts: the overlap bound is half of what the differing bits leave."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.get(f"{a}.bits", i).bitwiseXOR(F.get(f"{b}.bits", i))) for i in range(BIT_WORDS)])
    wide = F.aggregate(F.zip_with(f"{a}.wide", f"{b}.wide", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    within = lambda apart: (100 + percent) * F.least(n, m, F.floor((n + m - apart) / 2)) >= percent * (n + m)
    return F.when(~within(apart), False).when((n > LONG) & (m > LONG), within(wide)).otherwise(True)


def _ids(pairs: DataFrame, name: str, broadcast_ids: int) -> DataFrame:
    """The ids in pairs, once each, broadcast if there are at most broadcast_ids."""
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias(name)).distinct(), "ids")
    return F.broadcast(ids) if ids.count() <= broadcast_ids else ids


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, percent: int, width: int, broadcast_ids: int) -> DataFrame:
    """The pairs (a, b) that link: bit counts first, then the exact overlap.

    Only the bitmaps of sets that met are joined to pairs, and only texts of
    pairs that the bit counts let through are made into sets again.
    """
    pairs = stored(pairs, "pairs")
    near = _ids(pairs, "id", broadcast_ids)
    signs = stored(reps.select("id", "n", "bits", "wide").join(near, "id", "left_semi"), "signs")
    met = pairs.alias("p").join(signs.alias("x"), F.col("p.a") == F.col("x.id")).join(signs.alias("y"), F.col("p.b") == F.col("y.id"))
    allowed = stored(met.where(_may_link("x", "y", percent)).select("a", "b"), "allowed")
    near = _ids(allowed, "doc_id", broadcast_ids)
    sets = docs.join(near, "doc_id", "left_semi").transform(in_batches, _sorted_sets(width), "id long, items binary")
    both = allowed.alias("p").join(sets.alias("x"), F.col("p.a") == F.col("x.id")).join(sets.alias("y"), F.col("p.b") == F.col("y.id"))
    both = both.select("a", "b", F.col("x.items").alias("x"), F.col("y.items").alias("y"))
    return both.transform(in_batches, _linked(percent), "a long, b long").distinct()


def frequent_shingles(docs: DataFrame, width: int, one_in: int, least: int, most: int, hot: int = 256, most_hot: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in at least `least` sets of a sample, at most `most`, the most frequent; and those in `hot`, at most `most_hot`.

    Only the order of shingles and the salting of hot ones depend on it, so no
    bound can lose a link. A shingle beyond most_hot has a share of all rows
    under 1 / most_hot.
    """
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0)
    sets = sample.transform(in_batches, _sets(width), "id long, items array<long>")
    counts = stored(sets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least), "frequent")
    by_count = sorted(map(tuple, counts.groupBy("n").count().collect()), reverse=True)

    def top(least: int, most: int) -> np.ndarray:
        floor, kept = None, 0
        for n, rows in by_count:
            if n < least or (kept := kept + rows) > most:
                break
            floor = n
        if floor is None:
            return np.empty(0, np.int64)
        return np.sort(counts.where(F.col("n") >= floor).select("item").toArrow().column("item").to_numpy())

    return top(least, most), top(hot, most_hot)


def _of_class(rows: DataFrame, classes: DataFrame, hot_rows: int) -> DataFrame:
    """rows left-joined with classes (sig, m, ...) on sig.

    Classes of hot_rows rows (m) or more are broadcast, so that their rows stay
    where they are; the others are joined by a shuffle.
    """
    found = [c for c in classes.columns if c not in ("sig", "m")]
    hot = F.broadcast(classes.where(F.col("m") >= hot_rows).select("sig", F.struct(*found).alias("hot")))
    split = rows.join(hot, "sig", "left")
    cold = split.where("hot is null").drop("hot").join(classes.where(F.col("m") < hot_rows).drop("m"), "sig", "left")
    return split.where("hot is not null").select(*rows.columns, "hot.*").unionByName(cold.select(*rows.columns, *found))


def near_duplicate_groups(docs: DataFrame, percent: int = 80, width: int = 5, block: int = 512, hub_rounds: int = 2, one_in: int = 16, least: int = 4, most: int = 1_000_000, broadcast_ids: int = 4_000_000, broadcast_copies: int = 1_000_000, parts: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id: groups of texts linked at percent or more.

    broadcast_ids: up to so many ids of compared sets are broadcast, at 8 bytes
    each; beyond it their rows are found by a shuffled join. broadcast_copies:
    the same for the ids and 16-byte signatures of exact copies. parts: salted
    parts of a hot prefix shingle.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    frequent, hot = frequent_shingles(docs, width, one_in, least, most)
    signed = stored(docs.transform(in_batches, _signatures(width, percent, frequent), _SIGNATURES), "shingles")
    usable = signed.where("sig is not null and doc_id is not null")
    # Classes of equal sets: all that the later steps need, and the prefixes, each once.
    slim = usable.groupBy("sig").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("doc_id", "n", "bits", "wide")).alias("r"))
    reps = stored(slim.select("sig", "m", F.col("r.doc_id").alias("id"), "r.n", "r.bits", "r.wide"), "classes")
    hot_rows = max(1000, signed.count() // 10_000)  # at most 10,000 classes have so many
    copies = stored(_of_class(usable.select("sig", "doc_id"), reps.select("sig", "m", "id"), hot_rows).where("doc_id <> id").select("sig", "doc_id").distinct(), "copies")
    known = F.broadcast(copies) if copies.count() <= broadcast_copies else copies
    first = usable.join(known, ["sig", "doc_id"], "left_anti")

    # Rows of prefix shingles that two classes or more have, with the hub of their bucket.
    place = F.shiftleft(F.col("n"), 32) + F.col("pos")
    rows = first.select("doc_id", "n", F.posexplode("items").alias("pos", "item")).select("item", F.col("doc_id").alias("id"), place.alias("place"))
    if len(hot):
        salted = docs.sparkSession.createDataFrame(pa.table({"item": hot, "salted": np.ones(len(hot), bool)}))
        rows = rows.join(F.broadcast(salted), "item", "left").withColumn("part", F.when(F.col("salted"), F.pmod(F.xxhash64("id"), F.lit(parts)) + 1).otherwise(0).cast("int"))
    else:
        rows = rows.withColumn("part", F.lit(0))
    bucket = Window.partitionBy("item", "part").orderBy("id")
    hub = F.first(F.struct("id", "place")).over(bucket.rowsBetween(Window.unboundedPreceding, 0))
    shared = rows.select("item", "id", "place", hub.alias("hub"), F.lead("id").over(bucket).alias("after"), "part").where("hub.id <> id or after <> id or part > 0")
    unpacked = lambda c: [F.shiftright(c, 32).cast("int").alias("n"), c.bitwiseAND((1 << 32) - 1).cast("int").alias("pos")]
    shared = stored(shared.select("item", "id", *unpacked(F.col("place")), F.struct(F.col("hub.id").alias("id"), *unpacked(F.col("hub.place"))).alias("hub")), "shared")

    compare = lambda pairs: verified(pairs, reps, docs, percent, width, broadcast_ids)
    of_hubs = lambda met: met.where(_may_meet(F.struct("n", "pos"), F.col("hub"), percent)).select(F.col("id").alias("a"), F.col("hub.id").alias("b")).distinct()
    links = stored(compare(of_hubs(shared.where("hub.id <> id"))), "star-links")
    shared = shared.select("item", "id", "n", "pos")
    for turn in range(1, hub_rounds + 1):
        belongs = stored(components(links), "components")
        members = shared.join(belongs, "id", "left").withColumn("component", F.coalesce("component", "id"))
        state = members.groupBy("item").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("m"), F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("order"), "id", "n", "pos", "component")).alias("hub"))
        members = stored(members.join(state.where("low <> high").select("item", "m", "hub"), "item"), "open")
        if turn < hub_rounds:
            pairs = of_hubs(members.where("component <> hub.component"))
            shared = members.select("item", "id", "n", "pos")
        else:
            pairs = _tiles(members, percent, block)
        links = stored(links.unionByName(compare(pairs)), "links-so-far")
    belongs = components(links)
    of_class = reps.select("sig", "m", "id").join(belongs, "id", "left").select("sig", "m", F.coalesce("component", "id").alias("component"))
    found = stored(_of_class(signed.select("doc_id", "n", "sig"), of_class, hot_rows), "of-class")
    found = _one_component_an_id(found, broadcast_ids)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def _one_component_an_id(found: DataFrame, broadcast_ids: int) -> DataFrame:
    """found (doc_id, n, sig, component), where components that share a doc_id are one."""
    pairs = found.where("doc_id is not null").select("doc_id", F.coalesce("component", "doc_id").alias("component")).distinct()
    torn = stored(pairs.groupBy("doc_id").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high"), "torn")
    if torn.isEmpty():
        return found
    joined = stored(components(pairs.join(torn, "doc_id").select(F.col("component").alias("a"), F.col("low").alias("b"))).select(F.col("id").alias("component"), F.col("component").alias("whole")), "joined")
    if joined.count() <= broadcast_ids:
        joined = F.broadcast(joined)
    own = found.withColumn("component", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    return own.join(joined, "component", "left").withColumn("component", F.coalesce("whole", "component"))


def _may_meet(x: Column, y: Column, percent: int) -> Column:
    """By sizes and the places of a common shingle, if it is the first that both have.

    All that two sets share lies from their first common shingle on, in the
    order of shingles. Each linking pair meets at that shingle too, so a row
    may be dropped by it without losing the pair.
    """
    rest = F.least(x["n"] - x["pos"], y["n"] - y["pos"]).cast("long")
    return (100 + percent) * rest >= percent * (x["n"].cast("long") + y["n"])


def _tiles(members: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs of different components that sizes and places allow, met in tiles.

    The smaller set of a pair comes from its own size band, the larger from the
    same or the next one. Tile rows carry no bitmaps: those are joined to the
    distinct pairs, once each.
    """
    rows = members.select("item", "id", "n", "pos", "component", F.ceil(F.col("m") / block).cast("int").alias("parts"))
    rows = rows.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent))).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("item", "id", "n", "pos", "component", "band", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
    x = rows.where((100 + percent) * (F.col("n") - F.col("pos")).cast("long") >= 2 * percent * F.col("n").cast("long")).alias("x")
    y = rows.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") - 1))).alias("y")
    meet = reduce(lambda a, b: a & b, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("item", "p", "q", "band")])
    ordered = ((F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.id") < F.col("y.id")))) & (F.col("x.component") != F.col("y.component"))
    allowed = _may_meet(F.struct("x.n", "x.pos"), F.struct("y.n", "y.pos"), percent)
    return x.join(y, meet & ordered & allowed).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def keep_first(docs: DataFrame, broadcast_ids: int = 4_000_000, **how) -> DataFrame:
    """The documents without all but the smallest doc_id of each group. Rows with a null id stay."""
    groups = near_duplicate_groups(docs, **how).where("doc_id <> component_id")
    rest = stored(groups.select("doc_id").distinct(), "rest")
    if rest.count() <= broadcast_ids:  # then whole texts need no shuffle
        rest = F.broadcast(rest)
    return docs.join(rest, "doc_id", "left_anti").select(docs.columns)
