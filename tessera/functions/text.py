"""Text cleaning and the analysers of the full-text index."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tessera.functions.stemmers import ENGLISH_STOP, english, russian

#: Analysed views of a text: words as they are, code words, Russian, English.
ANALYSERS = ("simple", "code", "ru", "en")


@pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def cleaned(text: Column | str) -> Column:
    """Compatibility forms composed, invisible marks dropped, hyphenated line ends joined, white space squeezed."""
    out = nfkc(F.col(text) if isinstance(text, str) else text)
    for pattern, new in ((r"[\u200b\u200e\u200f\u202a-\u202e]", ""), (r"(?U)(\w)-\n(\w)", "$1$2"), (r"(?U)\s*\n\s*", "\n"), (r"[ \t]+", " "), (r"(?U)^\s+|\s+$", "")):
        out = F.regexp_replace(out, pattern, new)
    return out


def ascii_only(text: Column | str) -> Column:
    return (F.col(text) if isinstance(text, str) else text).rlike(r"^[\x00-\x7f]*$")


#: Words of letters, digits and underscores; ., : and ' stay between letters, . and , between digits.
_STANDARD = r"[\p{L}\p{M}\p{N}_]+(?:(?:(?<=\p{L})[.:'’·](?=\p{L})|(?<=\p{N})[.,;'](?=\p{N}))[\p{L}\p{M}\p{N}_]+)*"
_SIMPLE = r"[\p{L}\p{N}_]+"


def words(text: Column | str, analyser: str) -> Column:
    """Lower-case words in order. All analysers but simple have the same."""
    source = F.lower(F.col(text) if isinstance(text, str) else text)
    return F.regexp_extract_all(source, F.lit(_SIMPLE if analyser == "simple" else _STANDARD), F.lit(0))


def tokens_of(words: Column, analyser: str) -> Column:
    """Tokens of words(), in order, before stop words and stems."""
    if analyser != "code":
        return words
    # lower case comes first, so a change of case splits nothing: parts end at marks and between letters and digits
    parts = lambda w: F.regexp_extract_all(w, F.lit(r"[\p{L}\p{M}]+|\p{N}+"), F.lit(0))
    whole = lambda w: w.rlike(r"^(?:[\p{L}\p{M}]+|\p{N}+)$")  # noqa: E731  most words: one part
    return F.flatten(F.transform(words, lambda w: F.when(whole(w), F.array(w)).otherwise(F.array_distinct(F.concat(F.array(w), parts(w))))))


def tokens(text: Column | str, analyser: str) -> Column:
    """Lower-case tokens, in order, before stop words and stems."""
    return tokens_of(words(text, analyser), analyser)


def stop_tokens(analyser: str) -> list[str]:
    """Tokens that are no terms."""
    if analyser == "ru":
        return sorted(StopWordsRemover.loadDefaultStopWords("russian"))
    return sorted(w + end for w in ENGLISH_STOP for end in ("", "'s", "’s")) if analyser == "en" else []


def stemmed(token: Column | str, analyser: str) -> Column:
    """The term of a token."""
    token = F.col(token) if isinstance(token, str) else token
    if analyser == "en":
        return _stem_english(F.regexp_replace(token, "['’]s$", ""))
    return _stem_russian(token) if analyser == "ru" else token


@pandas_udf(T.StringType())
def _stem_english(word: pd.Series) -> pd.Series:
    return word.map(english, na_action="ignore")


@pandas_udf(T.StringType())
def _stem_russian(word: pd.Series) -> pd.Series:
    return word.map(russian, na_action="ignore")


def term_counts(docs: DataFrame, analyser: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, tf): how often each term occurs. Stems are taken of counted words, once for each in a document."""
    if analyser not in ANALYSERS:
        raise ValueError(f"no analyser {analyser}")
    counted = docs.select(key, F.explode(tokens(text, analyser)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    if analyser in ("simple", "code"):
        return counted
    terms = counted.where(~F.col("term").isin(stop_tokens(analyser))).withColumn("term", stemmed("term", analyser))
    return terms.groupBy(key, "term").agg(F.sum("tf").alias("tf"))
