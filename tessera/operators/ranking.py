"""Postings, corpus statistics and BM25 over analysed fields."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.blocks import once
from tessera.functions.text import stemmed as stem
from tessera.functions.text import stop_tokens, term_counts, tokens_of, words
from tessera.sources.staging import staged

K1, B = 1.2, 0.75
#: Folders of a stored index.
FOLDERS = 64
#: Weight of each analysed view of the text.
BOOSTS = {"code": 1.0, "ru": 1.3, "en": 1.2}
SYMBOL_BOOST = 1.0
#: Analysers whose terms are not the tokens themselves: characters at the end of a term, at most, that its tokens may not begin with.
STEMMED = {"ru": 0, "en": 3}


def postings(docs: DataFrame, analyser: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, tf): the inverted index of one field; store it partitioned or sorted by term."""
    return term_counts(docs, analyser, key, text)


def document_lengths(posted: DataFrame, key: str = "doc_id") -> DataFrame:
    return posted.groupBy(key).agg(F.sum("tf").cast("long").alias("dl"))


def term_statistics(posted: DataFrame) -> DataFrame:
    """(term, df, cf): documents that hold a term, and its occurrences."""
    return posted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("cf"))


def query_terms(spark, question: str, analyser: str) -> list[str]:
    """Distinct analysed terms of a question (a few words)."""
    asked = spark.createDataFrame([(0, question)], "doc_id int, text string")
    return sorted(r["term"] for r in term_counts(asked, analyser).select("term").collect())


def idf(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def _scored(hits: DataFrame, df: DataFrame, n: Column, average: Column, key: str) -> DataFrame:
    """(key, score) of hits (key, term, tf, dl), with df (term, df) of the question's terms."""
    # one row for a query term
    rows = hits.join(F.broadcast(df), "term")
    tf = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / average))
    # rounded, as the order of the sum differs between runs and would break ties at random
    return rows.groupBy(key).agg(F.round(F.sum(idf(n, F.col("df")) * tf), 9).alias("score"))


def bm25(posted: DataFrame, terms: list[str], documents: int | None = None, key: str = "doc_id", within: DataFrame | None = None) -> DataFrame:
    """(key, score) of the documents with any of the terms, of postings that are asked once (else see StoredIndex; of texts bm25_texts).

    posted: postings of the whole corpus. Statistics are the whole corpus's, also when within (keys) filters the result:
    the filter is applied before the scores are summed. documents: size of the corpus if some have no terms at all.
    The postings are aggregated once, to one row for a document with its length and its counts of the terms.
    """
    asked = F.array(*map(F.lit, sorted(set(terms)))) if terms else F.array().cast("array<string>")
    counts = F.collect_list(F.when(F.array_contains(asked, F.col("term")), F.struct("term", "tf")))  # nulls are left out
    per = posted.groupBy(key).agg(F.sum("tf").cast("long").alias("dl"), counts.alias("__t"))
    # one row: size, length, and each term's documents
    with_term = lambda term: F.count_if(F.exists("__t", lambda s: s["term"] == term))
    held = F.create_map(*[x for t in sorted(set(terms)) for x in (F.lit(t), with_term(t))]) if terms else F.create_map().cast("map<string,bigint>")
    facts = per.agg(F.count("*").alias("__n"), F.avg("dl").alias("__avg"), held.alias("__df"))
    if documents is not None:
        facts = facts.withColumns({"__avg": F.col("__avg") * F.col("__n") / documents, "__n": F.lit(documents)})
    if within is not None:
        per = per.join(within, key, "left_semi")
    rows = per.where(F.size("__t") > 0).crossJoin(F.broadcast(facts))
    tf = lambda x: x["tf"] / (x["tf"] + K1 * (1 - B + B * F.col("dl") / F.col("__avg")))
    part = lambda x: idf(F.col("__n"), F.try_element_at("__df", x["term"])) * tf(x)
    return rows.select(key, F.round(F.aggregate(F.array_sort("__t"), F.lit(0.0), lambda s, x: s + part(x)), 9).alias("score"))


def _like(terms: list[str], tail: int) -> str:
    """Expression of the tokens that can become one of the terms: they begin like it."""
    begins = sorted({t[: max(1, len(t) - tail)] for t in terms})
    return "^(?:" + "|".join(re.sub("[её]", "[её]", re.escape(b)) for b in begins) + ")"


def _field(own: Column, name: str, terms: list[str]) -> Column:
    """(dl, near) of a text's words: how many are terms of the field, and those that may be asked terms, repeats too."""
    stop = stop_tokens(name)
    kept = lambda x: F.filter(x, lambda w: ~w.isin(stop)) if stop else x
    asked = lambda w: (w.rlike(_like(terms, STEMMED[name])) if name in STEMMED else w.isin(terms)) if terms else F.lit(False)
    return once(kept(tokens_of(own, name)), lambda x: F.struct(F.size(x).cast("long").alias("dl"), F.filter(x, asked).alias("near")))


def _hits(per: DataFrame, name: str, terms: list[str]) -> Column:
    """The asked terms among a document's near tokens. Each distinct token is stemmed once; few become a term, as only some endings do."""
    near = F.col(f"{name}.near")
    if name not in STEMMED or not terms:
        return near
    tokens = per.select(F.explode(near).alias("token")).distinct().withColumn("term", stem("token", name))
    forms = {r["token"]: r["term"] for r in tokens.where(F.col("term").isin(terms)).collect()}
    if not forms:
        return F.array().cast("array<string>")
    term = F.create_map(*[F.lit(x) for pair in sorted(forms.items()) for x in pair])
    return F.transform(F.filter(near, lambda w: w.isin(sorted(forms))), lambda w: F.try_element_at(term, w))


def bm25_texts(docs: DataFrame, asked: dict[str, list[str]], key: str = "doc_id", text: str = "text", within: DataFrame | None = None) -> dict[str, DataFrame]:
    """For each analyser of asked (its terms): what bm25() gives of the texts' postings.

    For a corpus that is asked once: no postings are made, as the lengths and the counts of the asked terms are enough.
    These are staged, one row for a document, in one pass over the texts for all fields.
    """
    terms = {n: sorted(set(ts)) for n, ts in asked.items()}
    kinds = {n: "__simple" if n == "simple" else "__standard" for n in asked}
    given = docs.select(key, *[words(text, n).alias(column) for column, n in {column: n for n, column in kinds.items()}.items()])
    fields = given.select(key, *[_field(F.col(kinds[n]), n, terms[n]).alias(n) for n in asked])
    all_near = lambda n: F.flatten(F.collect_list(F.when(F.size(f"{n}.near") > 0, F.col(f"{n}.near"))))
    per = staged(fields.groupBy(key).agg(*[F.struct(F.sum(f"{n}.dl").alias("dl"), all_near(n).alias("near")).alias(n) for n in asked]))
    hits = per.select(key, *[F.struct(F.col(f"{n}.dl").alias("dl"), _hits(per, n, terms[n]).alias("hits")).alias(n) for n in asked])
    some = {n: F.col(f"{n}.dl") > 0 for n in asked}
    held = lambda n: F.array(*[F.count_if(F.array_contains(f"{n}.hits", t)) for t in terms[n]]).cast("array<long>")
    facts = hits.agg(*[F.struct(F.count_if(some[n]).alias("n"), F.avg(F.when(some[n], F.col(f"{n}.dl"))).alias("average"), held(n).alias("df")).alias(n) for n in asked]).first()
    rows = hits if within is None else hits.join(within, key, "left_semi")
    return {n: _rated(rows, key, n, terms[n], facts[n]) for n in asked}


def _count(terms: str, term: str) -> Column:
    return F.size(F.filter(terms, lambda x: x == term))


def _rated(rows: DataFrame, key: str, field: str, terms: list[str], facts) -> DataFrame:
    hit = rows.where(F.size(f"{field}.hits") > 0).select(key, F.col(f"{field}.dl").alias("dl"), F.col(f"{field}.hits").alias("hits"))
    score = F.lit(0.0)
    for term, df in zip(terms, facts["df"], strict=True):
        count = _count("hits", term)
        tf = count / (count + K1 * (1 - B + B * F.col("dl") / F.lit(facts["average"])))
        score = score + F.when(count > 0, idf(F.lit(facts["n"]), F.lit(df)) * tf).otherwise(0.0)
    return hit.select(key, F.round(score, 9).alias("score"))


class StoredIndex:
    """An inverted index on disk: postings with their documents' lengths, in folders by a hash of the term, and statistics.

    A question reads the folders of its terms, and in them, as rows are sorted by term, the row groups that can hold them.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @staticmethod
    def build(docs: DataFrame, analyser: str, path: str, key: str = "doc_id", text: str = "text", folders: int = FOLDERS) -> StoredIndex:
        index = StoredIndex(docs.sparkSession, path)
        posted = staged(postings(docs, analyser, key, text))
        lengths = document_lengths(posted, key)
        placed = posted.join(lengths, key).select("term", key, "tf", "dl", _folder(F.col("term"), folders).alias("folder"))
        placed.repartition("folder", F.pmod(F.hash(key), F.lit(8))).sortWithinPartitions("folder", "term").write.partitionBy("folder").parquet(f"{index.path}/postings")
        stats = posted.groupBy("term").agg(F.count("*").alias("df")).withColumn("folder", _folder(F.col("term"), folders))
        stats.repartition("folder").sortWithinPartitions("folder", "term").write.partitionBy("folder").parquet(f"{index.path}/terms")
        facts = lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("average"), F.lit(folders).alias("folders"), F.first(F.lit(key)).alias("key"))
        facts.coalesce(1).write.parquet(f"{index.path}/facts")
        return index

    def bm25(self, terms: list[str], within: DataFrame | None = None) -> DataFrame:
        """As bm25()."""
        facts = self.spark.read.parquet(f"{self.path}/facts").first()
        key, wanted = facts["key"] or "doc_id", sorted(set(terms))
        folders = [r[0] for r in self.spark.createDataFrame([(t,) for t in wanted], "term string").select(_folder(F.col("term"), facts["folders"])).collect()]
        of_terms = lambda name: self.spark.read.parquet(f"{self.path}/{name}").where(F.col("folder").isin(folders) & F.col("term").isin(wanted))
        hits = of_terms("postings")
        if within is not None:
            hits = hits.join(within, key, "left_semi")
        return _scored(hits, of_terms("terms").select("term", "df"), F.lit(facts["n"]), F.lit(facts["average"]), key)


def _folder(term: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(folders)).cast("int")


def best_field(scored: dict[str, DataFrame], boosts: dict[str, float] | None = None, key: str = "doc_id") -> DataFrame:
    """(key, score): the largest boosted score of any field."""
    weights, all_fields = boosts or BOOSTS, None
    for name, part in scored.items():
        weighted = part.select(key, (F.col("score") * weights.get(name, 1.0)).alias("score"))
        all_fields = weighted if all_fields is None else all_fields.unionByName(weighted)
    return all_fields.groupBy(key).agg(F.max("score").alias("score"))


def symbol_hit(symbols: Column, wanted: list[str] | None) -> Column:
    """Whether a block names one of the wanted symbols; blanks are ignored, case does not matter."""
    names = [s.lower() for s in wanted or [] if s]
    if not names:
        return F.lit(False)
    return F.coalesce(F.arrays_overlap(F.transform(symbols, F.lower), F.array(*map(F.lit, names))), F.lit(False))


def with_symbols(text_scores: DataFrame, chunks: DataFrame, wanted: list[str] | None, boost: float = SYMBOL_BOOST, key: str = "id") -> DataFrame:
    """(key, score) of the chunks with a text score or a symbol: a symbol adds boost once, however many match."""
    named = chunks.where(symbol_hit(F.col("symbols"), wanted)).select(key, F.lit(boost).alias("score"))
    return text_scores.select(key, "score").unionByName(named).groupBy(key).agg(F.sum("score").alias("score"))


def top(scored: DataFrame, k: int, key: str = "doc_id", score: str = "score") -> DataFrame:
    """The k best, ties to the smaller key, with rank from 1. Only k rows are numbered."""
    best = scored.orderBy(F.desc(score), key).limit(k)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("o"), F.col(key), F.col(score))))
    listed = best.agg(ordered.alias("l")).select(F.posexplode("l").alias("r", "x"))
    return listed.select(F.col(f"x.{key}").alias(key), F.col(f"x.{score}").alias(score), (F.col("r") + 1).cast("int").alias("rank"))
