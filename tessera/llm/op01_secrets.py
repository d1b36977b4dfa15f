"""Secret scan: candidate findings of whole texts, with a random forest that removes false positives.

A candidate is a word with digits and at least LEAST characters, every value of a key in such a word, or the value after
a key name, in the same word or the next. Its features are length,
character classes and transitions (also against the character bigrams of the corpus dictionary), how much of it
dictionary words cover, the path, and the neighbouring words. The forest is trained on labelled findings. All steps are
built-in functions and the JVM's random forest; values are reported as digests only.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import read, small, stage

LEAST = 12
#: Documents that hold a dictionary word, at least.
DICTIONARY_DOCUMENTS = 5
#: Labelled findings that the forest is trained on, at most (an even choice by hash), and its shape.
LABELLED, TREES, LEVELS, SEED = 20_000, 40, 8, 17
#: Probability from which a finding is kept.
KEPT = 0.5
_KEY = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key)"
#: A name, then a sign, each with a quote or without.
_NAME, _SIGN = r"(?<![\p{L}\p{N}_.-])([\p{L}_][\p{L}\p{N}_.-]*+)", r"[\"']?[=:]++[\"']?"
#: Pairs with signs in the value, one after another; pairs without, also those in the value of another.
_PAIRS = (_NAME + _SIGN + r"([^\s\"'=:,;](?:[^\s\"',;&]|&(?![\p{L}_][\p{L}\p{N}_.-]*+=)){5,})", _NAME + _SIGN + r"(?=([^\s\"'=:,;&]{6,}+=*+))")
_HARMLESS = r"(?i)(commit|sha|md5|checksum|digest|hash|revision|uuid|guid|\bid\b|version|build|etag|file|mail|phone|card|isbn)"
_ALPHABET = "abcdefghijklmnopqrstuvwxyz0"
_BIGRAMS = (len(_ALPHABET) + 1) ** 2
FEATURES = ["length", "digits", "upper", "lower", "marks", "transitions", "distinct", "bigram", "coverage", "key_near", "harmless_near", "key_after", "harmless_after", "assigned", "quoted", "test_path", "hex", "dotted", "at"]


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, position (of the word), value, key, before2, before1, after1, quoted, path: one row for each candidate.

    docs: doc_id, text, path.
    """
    # as explode makes it, the list is split once, not again for each word that looks into it
    words = docs.select("doc_id", "path", F.explode(F.array(F.split("text", r"\s+"))).alias("__w")).where("__w is not null")
    keyed = lambda w: w.rlike(r"[=:]") & w.rlike(_KEY + r"[\w.-]*[\"']?[=:]+[\"']?[^\s\"'=:,;][^\s\"',;]{5,}")
    word = lambda i: F.coalesce(F.get("__w", i), F.lit(""))
    signed = lambda i: word(i - 1).rlike(r"[=:]>?$") & F.concat_ws(" ", word(i - 2), word(i - 1)).rlike(_KEY + r"[\w.-]*[\"'\])]*\s?[=:]+>?$")
    led = lambda w, i: w.rlike("^[=:]") & word(i - 1).rlike(_KEY + r"[\w.-]*[\"'\])]*$")
    is_one = lambda w, i: (F.length(w) >= LEAST) & w.rlike(r"[0-9]") | keyed(w) | (F.length(w) >= 6) & (signed(i) | led(w, i))
    # places of the candidates; the other words become -1
    places = F.filter(F.transform("__w", lambda w, i: F.when(is_one(w, i), i).otherwise(F.lit(-1))), lambda i: i >= 0)
    at = words.withColumn("__p", places).where(F.size("__p") > 0).select("doc_id", "path", "__w", F.explode("__p").alias("position"))
    near = lambda d: word(F.col("position") + d)
    picked = at.select("doc_id", "path", "position", near(0).alias("word"), near(-2).alias("before2"), near(-1).alias("before1"), near(1).alias("after1"))
    pair = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    pairs = [F.zip_with(*[F.regexp_extract_all("word", F.lit(p), F.lit(g)) for g in (1, 2)], pair) for p in _PAIRS]
    # the word itself, unless it begins with a pair
    starts = F.col("word").rlike(r"^[^\p{L}\p{N}_]*" + _NAME + _SIGN + r"[^\s\"'=:,;][^\s\"',;]{5,}")
    key = F.when(F.col("word").rlike("^[=:]"), F.regexp_extract("before1", r"[\p{L}_][\p{L}\p{N}_.-]*", 0)).otherwise(F.lit(""))
    whole = F.filter(F.array(pair(key, F.col("word"))), lambda _: ~starts)
    split = picked.withColumn("__v", F.explode(F.array_distinct(F.concat(*pairs, whole))))
    bare = F.regexp_replace("__v.value", r"^[^\p{L}\p{N}/+_-]+|[^\p{L}\p{N}/+=_-]+$", "")
    return split.withColumns({"value": bare, "key": F.col("__v.key"), "quoted": F.col("word").rlike("[\"']")}).where("value != ''").drop("word", "__v")


def dictionary(docs: DataFrame, documents: int = DICTIONARY_DOCUMENTS) -> DataFrame:
    """word: the words of letters that at least this many documents hold, counted over all docs (text)."""
    words = F.filter(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")), lambda w: F.length(w).between(3, 20))
    counted = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return stage(counted.where(F.col("n") >= documents), "dictionary")


def _pairs(text: Column) -> Column:
    """Codes of neighbouring characters: letters a to z, any digit, anything else."""
    plain = F.regexp_replace(F.lower(text), "[0-9]", "0")
    code = lambda i: F.instr(F.lit(_ALPHABET), F.substring(plain, i, 1))
    return F.when(F.length(text) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: code(i) * F.lit(len(_ALPHABET) + 1) + code(i + 1))).otherwise(F.array().cast("array<int>"))


def bigram_logs(words: DataFrame) -> list[float]:
    """Log-probability of a character after another in the dictionary's words, for each pair of codes."""
    n = [1.0] * _BIGRAMS
    for r in words.select(F.explode(_pairs(F.col("word"))).alias("p")).groupBy("p").count().collect():  # _BIGRAMS rows at most
        n[r["p"]] += r["count"]
    wide = len(_ALPHABET) + 1
    return [math.log(x / sum(n[k // wide * wide : (k // wide + 1) * wide])) for k, x in enumerate(n)]


def featured(found: DataFrame, words: DataFrame, logs: list[float]) -> DataFrame:
    """found with the columns FEATURES. found: value, key, before2, before1, after1, quoted, path."""
    values = found.select("value").distinct()
    runs = values.select("value", F.explode_outer(F.regexp_extract_all(F.lower("value"), F.lit(r"\p{L}{3,}"), F.lit(0))).alias("word"))
    known = runs.join(small(words.select("word", F.lit(1).alias("known"))), "word", "left")
    covered = stage(known.groupBy("value").agg(F.sum(F.coalesce(F.length("word") * F.col("known"), F.lit(0))).alias("covered")), "covered")
    length = F.length("value")
    share = lambda pattern: F.regexp_count("value", F.lit(pattern)) / length
    logs_of = F.transform(_pairs(F.col("value")), lambda p: F.get(F.array(*map(F.lit, logs)), p))
    context = F.concat_ws(" ", "key", "before2", "before1")
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return found.join(small(covered), "value").withColumns({
        "length": length.cast("double"), "digits": share("[0-9]"), "upper": share(r"\p{Lu}"), "lower": share(r"\p{Ll}"), "marks": share(r"[^\p{L}\p{N}]"),
        # places where letters, digits and marks, or cases, change
        "transitions": F.regexp_count("value", F.lit(r"(?<=\d)(?=\D)|(?<=\D)(?=\d)|(?<=\p{Ll})(?=\p{Lu})|(?<=[\p{L}\d])(?=[^\p{L}\d])")) / length,
        "distinct": F.size(F.array_distinct(F.split("value", ""))) / length,
        "bigram": F.coalesce(F.aggregate(logs_of, F.lit(0.0), lambda a, x: a + x) / F.greatest(length - 1, F.lit(1)), F.lit(0.0)),
        "coverage": F.coalesce(F.col("covered") / length, F.lit(0.0)),
        "key_near": number(context.rlike(_KEY)), "harmless_near": number(context.rlike(_HARMLESS)),
        "key_after": number(F.col("after1").rlike(_KEY)), "harmless_after": number(F.col("after1").rlike(_HARMLESS)),
        "assigned": number((F.col("key") != "") | F.col("before1").rlike(r"[=:]$")), "quoted": number(F.col("quoted")),
        "test_path": number(F.col("path").rlike(r"(?i)(test|example|sample|fixture|doc|mock)")),
        "hex": number(F.col("value").rlike(r"^(?i)[0-9a-f]+$")), "dotted": number(F.col("value").rlike(r"^[\d.:T+-]+$")), "at": number(F.col("value").contains("@")),
    }).drop("covered")


def train(labelled: DataFrame, words: DataFrame, logs: list[float]) -> RandomForestClassificationModel:
    """labelled: the columns of candidates() that featured() needs, and secret (0, 1)."""
    chosen = labelled.where("secret is not null and value is not null").orderBy(F.xxhash64("value", F.lit(SEED))).limit(LABELLED)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(featured(stage(chosen, "labelled"), words, logs))
    forest = RandomForestClassifier(labelCol="secret", featuresCol="features", numTrees=TREES, maxDepth=LEVELS, seed=SEED)
    return forest.fit(rows.select("features", F.col("secret").cast("double").alias("secret")))


def scan(docs: DataFrame, labelled: DataFrame, kept: float = KEPT) -> DataFrame:
    """doc_id, position, value_sha256, length, key, probability: the findings of docs that the forest keeps.

    docs: doc_id, text, path; other columns are not looked at. labelled: see train(). Words are split at white space,
    position counts them from 0. Texts of any length are read whole; null and empty texts have no findings, a null path
    is an unknown one, null ids are kept, and repeated rows give repeated findings. A probability of just kept is kept;
    an empty table gives no rows.
    """
    words = dictionary(docs)
    logs = bigram_logs(words)
    model = train(labelled, words, logs)
    found = stage(candidates(docs).withColumn("path", F.coalesce("path", F.lit(""))), "candidates")
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(featured(found, words, logs))
    scored = model.transform(rows).withColumn("chance", vector_to_array("probability")[1])
    return scored.where(F.col("chance") >= kept).select(
        "doc_id", "position", F.sha2("value", 256).alias("value_sha256"), F.col("length").cast("int").alias("length"), "key", F.col("chance").alias("probability")
    )


def made_findings(spark: SparkSession, n: int = 6_000) -> DataFrame:
    """Labelled findings by rule, for corpora without any: random keys, tokens and passwords beside the usual look-alikes.

    No table of the corpus labels findings, so the forest learns from these: seeded, the same at every size.
    """
    pick = lambda salt, *xs: F.get(F.array(*map(F.lit, xs)), F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(xs))).cast("int"))
    digest = lambda salt: F.sha2(F.concat_ws("/", F.lit(salt), F.col("id")), 256)
    mixed = lambda salt, k: F.substring(F.translate(F.base64(F.unhex(F.concat(digest(salt), digest(salt + "+")))), "=", "x"), 1, k)
    hexed = lambda salt, k: F.substring(digest(salt), 1, k)
    digits = lambda salt, k: F.substring(F.translate(digest(salt), "abcdef", "123456"), 1, k)
    below = lambda salt, k: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(k)).cast("string")
    plain = ("the", "of", "and", "in", "with", "from", "value", "see", "line", "for", "que", "die", "les", "una", "")
    word = lambda salt: pick(salt, "user", "config", "render", "table", "stream", "window", "report", "client", "number", "matrix", "handler", "service")
    key = lambda salt: pick(salt, "password", "token", "secret", "api_key", "passwd", "access_key", "auth_token", "client_secret", "pwd")
    none, eq = F.lit(""), F.lit("=")
    calm, calm2 = pick("c1", *plain), pick("c2", *plain)
    # value, key, before2, before1, quoted, secret
    kinds = [
        (hexed("a", 40), none, key("k1"), pick("e", "=", ":"), True, 1),
        (hexed("b", 18), key("k2"), calm, calm2, False, 1),
        (F.concat(F.lit("AKIA"), F.translate(F.upper(mixed("d", 16)), "+/01", "QRST")), none, calm, calm2, False, 1),
        (mixed("f", 40), none, key("k3"), eq, True, 1),
        (F.concat(pick("p", "ghp_", "glpat-", "sk-", "xoxb-"), F.translate(mixed("g", 36), "+/", "ab")), none, calm, calm2, False, 1),
        (F.concat(F.lit("eyJ"), F.translate(mixed("h", 30), "+/", "ab"), F.lit("."), F.translate(mixed("i", 40), "+/", "ab")), none, calm, pick("t", "Bearer", "token:", "jwt"), False, 1),
        (F.translate(mixed("j", 20), "+/", "!#"), key("k4"), calm, calm2, True, 1),
        (F.concat_ws("-", hexed("l", 8), hexed("m", 4), hexed("n", 4), hexed("o", 4), hexed("p", 12)), none, calm, pick("u", "id", "uuid", "request", "guid:"), False, 0),
        (hexed("q", 40), none, calm, pick("v", "commit", "sha1", "checksum", "revision", "digest:"), False, 0),
        (F.concat(word("w1"), F.lit("."), below("n1", 99), F.lit("@mail"), below("n2", 9), F.lit(".example.com")), none, calm, calm2, False, 0),
        (F.concat_ws(".", below("n3", 255), below("n4", 255), below("n5", 255), below("n6", 255)), none, calm, calm2, False, 0),
        (F.concat(digits("r", 16), none), none, calm, calm2, False, 0),
        (F.concat(F.lit("20"), digits("s", 2), F.lit("-01-0"), below("n7", 9), F.lit("T03:04:0"), below("n8", 9)), none, calm, calm2, False, 0),
        (F.concat_ws("_", word("w2"), word("w3"), below("n9", 999)), none, calm, calm2, False, 0),
        (F.concat(F.lit("/"), word("w4"), F.lit("/"), word("w5"), below("n10", 99), F.lit(".py")), none, calm, pick("x", "file", "see", "open"), False, 0),
        (F.concat(pick("y", "changeme", "example", "placeholder", "yourpassword"), below("n11", 999)), key("k5"), calm, calm2, True, 0),
        (F.concat(word("w6"), word("w7"), word("w8"), below("n12", 9)), none, calm, calm2, False, 0),
    ]
    kind = F.pmod("id", F.lit(len(kinds)))
    chosen = lambda k: F.coalesce(*[F.when(kind == i, F.lit(x[k]) if isinstance(x[k], (bool, int)) else x[k]) for i, x in enumerate(kinds)])
    # what follows a value: mostly plain words, with secrets now and then another key, with look-alikes what they are
    after = F.when(F.pmod(F.xxhash64("id", F.lit("f")), F.lit(4)) > 0, calm).when(chosen(5) == 1, pick("f1", "token", "password", "key", "expires")).otherwise(pick("f2", "commit", "uuid", "version", "file"))
    path = F.when(chosen(5) == 1, pick("z", "src", "config/app.yml", "deploy", "tests/data")).otherwise(pick("z", "src", "docs/guide", "tests/unit", "lib"))
    return spark.range(n).select(chosen(0).alias("value"), chosen(1).alias("key"), chosen(2).alias("before2"), chosen(3).alias("before1"), after.alias("after1"), chosen(4).alias("quoted"), path.alias("path"), chosen(5).alias("secret"))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept findings of all documents; the source of a document is its path."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("path"))
    return scan(docs, made_findings(spark))
