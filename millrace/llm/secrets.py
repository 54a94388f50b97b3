"""Secret scans: candidates by pattern, false positives removed by a random forest.

All steps are DataFrame and SQL functions and Spark ML, so they run in the JVM.
One pattern extracts candidate strings: long runs of key characters, with or
without a digit, an assignment's value, or a private key block; with each come the
BEFORE characters before it and the AFTER characters behind it. A candidate's
features are its length, its characters and their transitions, how much of it words
of the dictionary cover, whether it looks like a path or URL, and whether the words
beside it speak of secrets or of harmless strings, before and behind it. The
dictionary is counted from all documents: words of `least_docs` texts or more,
candidates left out. A candidate's shape (letters and digits folded) is no feature,
so the forest generalizes beyond the formats that taught it.

Labelled findings: strings of well-known formats (access keys with a fixed
prefix, assigned passwords and tokens, private key blocks) and opaque strings whose
neighbours speak of secrets are secrets, strings of well-known harmless formats
(card-like numbers, dates, addresses, paths, prose, UUIDs) are not, unless assigned
or told of as secrets, and bare digests are not where their neighbours say so; up to `label_rows` distinct candidates of
each, drawn by hash, train the forest. Where a table lacks one of the kinds, the
rules' own prototypes, made from a seed, complete the training rows, among them
opaque strings of no known format.

Defined results: a null or empty text has no finding; equal strings in one text
are one finding with its number of places and the neighbours of all of them; rows that repeat a doc_id are scanned
one by one, and each is redacted of the secrets of all of them; rows whose doc_id
is null count as repeats of one id in this; a secret is redacted wherever its text
has it as a whole, so not inside a longer run of letters and digits, and where two
begin at one place the longer one counts; texts of any length are scanned whole; an
empty table gives an empty result; further columns of the input are ignored by scan()
and kept by redacted(), whatever their names.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import drawn, stored

#: A character of a key.
KEY = r"[A-Za-z0-9+/_=.\-]"
BLOCK = r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?"
#: A whole run, however long, of 16 or more key characters, or a shorter one that is assigned to a telling name.
RUN = r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-][A-Za-z0-9+/_=.\-]{14,}[A-Za-z0-9+/_=\-]"
ASSIGNED = r"""(?i:(?:passw(?:or)?d|pwd|secret|token|api[_-]?key|access[_-]?key|auth)["']?\s{0,3}[:=]\s{0,3}["']?[^\s"',;]{6,})"""
CANDIDATE = f"{BLOCK}|{ASSIGNED}|{RUN}"
#: Characters of a text before and behind a candidate that are its neighbours.
BEFORE, AFTER = 40, 24
#: Neighbours that speak of a secret, and of harmless strings that look like one.
TELLS_SECRET = r"(?i)(?<![a-z])(?:secrets?|passw(?:or)?ds?|pwd|passphrase|passwort|kennwort|schl(?:ü|ue)ssel|geheim\w*|mot de passe|contrase(?:ñ|n)a|clave|keys?|api[_-]?key|tokens?|bearer|auth|authorization|credentials?)(?![a-z])"
TELLS_HARMLESS = r"(?i)(?<![a-z])(?:sha-?(?:1|256|512)?|md5|commit|revision|rev|git|hash|checksum|digest|fingerprint|etag|uuid|guid|isbn|issn|doi|version|build|public)(?![a-z])"
_NAME = r"""(?i)^(?:passw(?:or)?d|pwd|secret|token|api[_-]?key|access[_-]?key|auth)["']?\s{0,3}[:=]\s{0,3}["']?"""
#: Public key formats that teach "secret".
KNOWN = r"^(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_\-]{35}|sk_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_\-]{10,}\.eyJ[A-Za-z0-9_.\-]+|-----BEGIN .*)"
#: And harmless ones.
HARMLESS = r"^(?:[0-9][0-9 .:/_\-]*|(?:https?:)?//?.*|[a-z]+(?:[-_/.][a-z0-9]{1,19})+/?|[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|[A-Za-z]+|[A-Z]+(?:_[A-Z]+)+|[^A-Za-z0-9]+)$"
FEATURES = ["length", "digits", "uppers", "lowers", "marks", "turns", "distinct", "covered", "longest_word", "path_like", "assigned", "hex_only", "digit_only", "vowels", "secret_before", "secret_behind", "harmless_before", "harmless_behind"]
#: Letter runs of a candidate, and the words of a text in their usual case, that the dictionary may hold.
PIECES, WORD = r"[A-Z]?[a-z]{3,}|[A-Z]{4,}", r"(?<![A-Za-z0-9+/_=.\-])[A-Z]?[a-z]{3,}(?![A-Za-z0-9+/_=\-])"


def _of(value: Column, pattern: str) -> Column:
    """Share of the characters that match."""
    return F.length(F.regexp_replace(value, pattern, "")) / F.greatest(F.length(value), F.lit(1))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, raw (as in the text), places, before and behind (the neighbours of all places): distinct candidate strings of each text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # \G: a match starts where the last one ended, so steps are the text between candidates and a candidate each.
    step = F.lit(f"(?s)\\G.*?({CANDIDATE})")
    steps = texts.select("doc_id", "text", F.regexp_extract_all("text", step, F.lit(0)).alias("steps"), F.regexp_extract_all("text", step, F.lit(1)).alias("raws")).where(F.size("raws") > 0)
    rest = F.substr("text", F.aggregate("steps", F.lit(1), lambda n, x: n + F.length(x)))
    gap = F.zip_with("steps", "raws", lambda x, raw: F.left(x, F.length(x) - F.length(raw)))
    gaps = steps.select("doc_id", "raws", F.concat(gap, F.array(rest)).alias("gaps"))
    place = F.zip_with("raws", F.sequence(F.lit(0), F.size("raws") - 1), lambda raw, i: F.struct(raw.alias("raw"), F.right(F.get("gaps", i), F.lit(BEFORE)).alias("before"), F.left(F.get("gaps", i + 1), F.lit(AFTER)).alias("behind")))
    found = gaps.select("doc_id", F.array_distinct("raws").alias("raws"), place.alias("found")).select("doc_id", "found", F.explode("raws").alias("raw"))
    own = found.select("doc_id", "raw", F.filter("found", lambda x: x["raw"] == F.col("raw")).alias("own"))
    return own.select("doc_id", "raw", F.size("own").cast("long").alias("places"), *(F.array_join(F.col("own").getField(k), "\n").alias(k) for k in ("before", "behind")))


def dictionary(docs: DataFrame, least_docs: int = 5) -> DataFrame:
    """word: those of at least least_docs texts, counted over all of them without their candidates."""
    text = F.regexp_replace(F.col("text").cast("string"), CANDIDATE, " ")
    words = docs.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))).alias("word"))
    return words.groupBy("word").count().where(F.col("count") >= least_docs).select("word")


def spelled(found: DataFrame, words: DataFrame) -> DataFrame:
    """Adds words: those letter runs of each distinct raw string that the dictionary holds."""
    pieces = found.select("raw").distinct().select("raw", F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.regexp_replace("raw", _NAME, ""), F.lit(PIECES), F.lit(0)), F.lower))).alias("word"))
    known = pieces.join(words, "word").groupBy("raw").agg(F.collect_set("word").alias("words"))
    return found.join(known, "raw", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))


def described(found: DataFrame) -> DataFrame:
    """Adds the secret (without its name and quotes) and the features; found has the columns of candidates and spelled."""
    s = F.col("secret")
    out = found.withColumn("secret", F.regexp_replace("raw", _NAME, ""))
    body = F.regexp_replace(s, r"[^A-Za-z0-9]", "")
    spelt = F.filter(F.regexp_extract_all(s, F.lit(PIECES), F.lit(0)), lambda w: F.array_contains(F.col("words"), F.lower(w)))
    covered = F.aggregate(spelt, F.lit(0), lambda a, w: a + F.length(w))
    longest = F.aggregate(spelt, F.lit(0), lambda a, w: F.greatest(a, F.length(w)))
    n = F.greatest(F.length(s), F.lit(1))
    # Borders between runs of one class: what is left of each run is one character.
    borders = F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0"), "[^aA0]+", "-"))
    columns = {
        "length": F.least(F.length(s), F.lit(200)).cast("double"),
        "digits": _of(s, "[^0-9]"),
        "uppers": _of(s, "[^A-Z]"),
        "lowers": _of(s, "[^a-z]"),
        "marks": _of(s, "[A-Za-z0-9]"),
        "turns": borders / n,
        "distinct": F.size(F.array_distinct(F.split(body, ""))) / F.least(n, F.lit(64)),
        "covered": covered / n,
        "longest_word": longest.cast("double"),
        "path_like": F.when(s.rlike(r"^(https?:)?//|^/|^[a-z]+([-_/.][a-z0-9]{1,19})+/?$|\.(com|net|org|html?|js|css|png|jpg|py)\b"), 1.0).otherwise(0.0),
        "assigned": F.when(F.col("raw") != s, 1.0).otherwise(0.0),
        "hex_only": F.when(s.rlike("^[0-9a-fA-F]+$"), 1.0).otherwise(0.0),
        "digit_only": F.when(s.rlike(r"^[0-9 .:/_\-]+$"), 1.0).otherwise(0.0),
        "vowels": _of(s, "(?i)[^aeiou]"),
        **{f"{name}_{side}": F.when(F.col(side).rlike(pattern), 1.0).otherwise(0.0) for name, pattern in (("secret", TELLS_SECRET), ("harmless", TELLS_HARMLESS)) for side in ("before", "behind")},
    }
    return out.withColumns(columns)


def labelled(found: DataFrame) -> DataFrame:
    """Adds label: 1 by a known format, 0 by a harmless one, null where neither tells."""
    s, tells = F.col("secret"), F.col("raw") != F.col("secret")
    beside = F.greatest("secret_before", "secret_behind") > 0
    harmless = F.greatest("harmless_before", "harmless_behind") > 0
    opaque = s.rlike(r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_=\-]{20,}$") & (F.col("path_like") == 0) & (F.col("covered") < 0.3)
    real = s.rlike(KNOWN) | (tells & s.rlike(r"^(?=.*[0-9])(?=.*[A-Za-z])[^\s]{8,}$") & ~s.rlike(r"(?i)example|changeme|placeholder|xxxx|\$\{|<")) | (beside & ~harmless & opaque)
    bare = ~tells & ~beside & s.rlike(HARMLESS)
    return found.withColumn("label", F.when(real, 1.0).when(bare | (~tells & harmless & s.rlike("^[0-9a-fA-F]+$")), 0.0))


def prototypes(spark: SparkSession, rows: int = 400, seed: int = 7) -> DataFrame:
    """Strings of the formats above with their neighbours, from a seed: the least that training has of each kind."""
    def chars(alphabet: str, count: int, salt: int) -> Column:
        pick = lambda i: F.substring(F.lit(alphabet), (F.pmod(F.xxhash64("id", i, F.lit(seed * 100 + salt)), F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(count)), pick), "")

    upper, digits, hexes = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789", "0123456789abcdef"
    mixed = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    words = F.array(*[F.lit(x) for x in ("data", "page", "index", "list", "main", "news", "home", "item")])
    spelt = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.element_at(words, (F.pmod(F.xxhash64("id", i), F.lit(8)) + 1).cast("int")))
    syllables = F.array_join(spelt, "-")
    made = F.array(
        F.concat(F.lit("AKIA"), chars(upper, 16, 1)), F.concat(F.lit("password="), chars(hexes, 16, 2)), F.concat(F.lit('token = "'), chars(hexes, 40, 3)), F.concat(F.lit("ghp_"), chars(mixed, 36, 4)), F.concat(F.lit("api_key="), chars(mixed, 32, 5)), F.concat(F.lit("eyJ"), chars(mixed, 20, 9), F.lit(".eyJ"), chars(mixed, 30, 10)),
        F.concat(F.lit("4"), chars(digits, 15, 6)), F.concat(syllables, F.lit("-2")), F.concat(F.lit("/"), syllables, F.lit("/"), chars(digits, 4, 8)), F.concat(chars(digits, 4, 11), F.lit("-"), chars(digits, 2, 12), F.lit("-"), chars(digits, 2, 13), F.lit("-"), chars(digits, 8, 14)),
        F.concat(chars(hexes, 8, 15), F.lit("-"), chars(hexes, 4, 16), F.lit("-"), chars(hexes, 4, 17), F.lit("-"), chars(hexes, 4, 18), F.lit("-"), chars(hexes, 12, 19)),
        F.concat(F.lit("AKIA"), chars(upper[:26], 16, 20)), F.array_join(spelt, ""), F.upper(F.array_join(spelt, "_")), F.expr("repeat('-', int(16 + id % 48))"),
    )
    beside = F.array(
        *(F.struct(chars(hexes, n, 21 + k).alias("raw"), F.lit(before).alias("before")) for k, (n, before) in enumerate(((40, "the secret key is "), (32, "Authorization: Bearer "), (40, "commit "), (64, "sha256 "), (32, "md5 checksum ")))),
        F.struct(chars(mixed, 40, 30).alias("raw"), F.lit("access token ").alias("before")),
    )
    # Opaque strings of no known format: a short name, a separator and drawn characters. They are secrets wherever they stand.
    name = chars("abcdefghijklmnopqrstuvwxyz", 4, 31)
    opaque = F.array(
        F.concat(name, F.lit("-"), chars(mixed, 24, 32)), F.concat(name, F.lit("_"), chars(mixed, 32, 33)), F.concat(name, F.lit("_"), chars(hexes, 48, 34)), F.concat(chars(upper[:26], 3, 35), F.lit("."), chars(mixed, 24, 36), F.lit("."), chars(mixed, 36, 37)), chars(mixed, 44, 38),
    )
    kind = lambda x, label: F.struct(x.alias("raw"), F.lit("").alias("before"), F.lit(label).cast("double").alias("own"))
    every = F.concat(F.transform(made, lambda x: kind(x, None)), F.transform(beside, lambda x: x.withField("own", F.lit(None).cast("double"))), F.transform(opaque, lambda x: kind(x, 1.0)))
    return spark.range(rows).select(F.explode(every).alias("x"), words.alias("words")).select("x.raw", "x.before", F.lit("").alias("behind"), "words", "x.own")


def train(found: DataFrame, label_rows: int = 20_000, trees: int = 20) -> PipelineModel:
    """The forest, from up to label_rows labelled candidates of either label and the prototypes."""
    own = stored(labelled(described(found.select("raw", "before", "behind", "words").distinct())).where("label is not null"), "labelled")
    ranked = [drawn(own.where(F.col("label") == y), F.col("raw"), label_rows) for y in (0.0, 1.0)]
    rows = ranked[0].unionByName(ranked[1]).unionByName(labelled(described(prototypes(found.sparkSession))).withColumn("label", F.coalesce("own", "label")).drop("own").where("label is not null"))
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=8, seed=1)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(rows.select(*FEATURES, "label").coalesce(4))


def scan(docs: DataFrame, model: PipelineModel | None = None, threshold: float = 0.5, label_rows: int = 20_000) -> DataFrame:
    """doc_id, secret, raw, places, score, is_secret of every candidate."""
    found = stored(spelled(stored(candidates(docs), "candidates"), dictionary(docs)), "spelled")
    model = train(found, label_rows) if model is None else model
    score = F.get(vector_to_array("probability"), F.lit(1))
    return model.transform(described(found)).select("doc_id", "secret", "raw", "places", score.alias("score"), (score >= threshold).alias("is_secret"))


def redacted(docs: DataFrame, findings: DataFrame, mark: str = "[SECRET]", broadcast_ids: int = 1_000_000) -> DataFrame:
    """docs with each secret of findings replaced in its text; other rows and columns as they were.

    Up to broadcast_ids ids with secrets are broadcast, so texts stay where they
    are; beyond that only rows that hold a candidate are shuffled.
    """
    longest_first = lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0)
    edge = lambda s, at, look: F.when(s.rlike(at), look).otherwise("")
    quoted = lambda s: F.concat(F.lit("\\Q"), F.replace(s, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    whole = lambda s: F.concat(edge(s, "^[A-Za-z0-9]", "(?<![A-Za-z0-9])"), quoted(s), edge(s, r"[A-Za-z0-9]\z", "(?![A-Za-z0-9])"))
    found = findings.where("is_secret").groupBy(F.col("doc_id").alias("id")).agg(F.array_sort(F.collect_set("secret"), longest_first).alias("secrets"))
    secrets = stored(found.select("id", F.array_join(F.transform("secrets", whole), "|").alias("pattern")), "secrets")
    wide = docs.select(F.struct(*docs.columns).alias("row"))
    plain_mark = mark.replace("\\", "\\\\").replace("$", "\\$")
    text = F.regexp_replace(F.col("row.text").cast("string"), F.col("pattern"), F.lit(plain_mark))

    def replaced(rows: DataFrame, found: DataFrame) -> DataFrame:
        joined = rows.join(found, F.col("row.doc_id").cast("long").eqNullSafe(F.col("id")), "left")
        return joined.select(*[F.when(F.col("pattern").isNotNull(), text).otherwise(F.col("row.text")).alias(c) if c.lower() == "text" else F.col(f"row.`{c}`") for c in docs.columns])

    if secrets.count() <= broadcast_ids:
        return replaced(wide, F.broadcast(secrets))
    holds = F.coalesce(F.col("row.text").cast("string").rlike(CANDIDATE), F.lit(False))
    return replaced(wide.where(holds), secrets).unionByName(wide.where(~holds).select("row.*"))
