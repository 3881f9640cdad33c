"""Basic statistics, histograms and readability of documents.

Defined results for odd input: a null or wordless text gives a row of nulls
(``on_empty="null"``), none (``"drop"``), or ends the query (``"error"``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stats as S
from ..functions.tokens import SentSpec, WordSpec

ON_EMPTY = ("null", "drop", "error")


def _check(docs: DataFrame, text_col: str, on_empty: str) -> None:
    if on_empty not in ON_EMPTY:
        raise ValueError(f"on_empty is one of {ON_EMPTY}")
    if text_col in docs.columns and not isinstance(docs.schema[text_col].dataType, T.StringType):
        raise TypeError("texts must be strings")


def cut(docs: DataFrame, sents: SentSpec = SentSpec(), words: WordSpec = WordSpec(), id_col: str = "doc_id", text_col: str = "text", words_col: str | None = None, sents_col: str | None = None, alphabet: S.Alphabet = S.RU) -> DataFrame:
    """(id, text, words, sents, syllables): the arrays that all statistics share.

    Texts that come cut already give ``words_col`` and ``sents_col``; their words stay as they are.
    """
    text = F.col(text_col)
    w = F.col(words_col) if words_col else words.column(text)
    s = F.col(sents_col) if sents_col else sents.column(text)
    rows = docs.select(F.col(id_col).alias(id_col), text.alias("text"), w.alias("words"), s.alias("sents"))
    return rows.withColumn("syllables", F.transform("words", lambda x: S.count_syllables(x, alphabet)))


def basic_stats(docs: DataFrame, sents: SentSpec = SentSpec(), words: WordSpec = WordSpec(), normalize: bool = False, alphabet: S.Alphabet = S.RU, on_empty: str = "null", id_col: str = "doc_id", text_col: str = "text", words_col: str | None = None, sents_col: str | None = None, as_struct: bool = False) -> DataFrame:
    """The thirteen counts, with ``normalize`` the nine ratios: one projection, no shuffle."""
    _check(docs, text_col, on_empty)
    rows = cut(docs, sents, words, id_col, text_col, words_col, sents_col, alphabet)
    empty = F.coalesce(F.size("words"), F.lit(0)) <= 0
    if on_empty == "drop":
        rows = rows.where(~empty)
    if on_empty == "error":
        rows = rows.withColumn("words", F.when(empty, F.raise_error(F.lit("the text has no words"))).otherwise(F.col("words")))
    counts = S.basic_counts(F.col("text"), F.col("words"), F.col("sents"), F.col("syllables"), alphabet)
    out = rows.select(id_col, *(F.when(~empty, v).alias(k) for k, v in counts.items()))
    if normalize:
        out = out.select("*", *(v.alias(k) for k, v in S.ratios().items()))
    if as_struct:
        out = out.select(id_col, F.struct(*(c for c in out.columns if c != id_col)).alias("basic"))
    return out


def histogram(docs: DataFrame, of: str = "letters", words: WordSpec = WordSpec(), alphabet: S.Alphabet = S.RU, id_col: str = "doc_id", text_col: str = "text", words_col: str | None = None) -> DataFrame:
    """(id, key, cnt): how many words have how many characters (``letters``) or vowels (``syllables``)."""
    if of not in ("letters", "syllables"):
        raise ValueError("a histogram is of letters or syllables")
    w = F.col(words_col) if words_col else words.column(F.col(text_col))
    rows = docs.select(id_col, w.alias("_words")).select(id_col, F.explode("_words").alias("word"))
    key = F.length("word") if of == "letters" else S.count_syllables(F.col("word"), alphabet)
    return rows.groupBy(id_col, key.alias("key")).agg(F.count("*").alias("cnt"))


def histogram_map(hist: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A histogram as one map for each document, keys ascending; a document has few keys, so its group is small."""
    pairs = F.array_sort(F.collect_list(F.struct("key", "cnt")))
    return hist.groupBy(id_col).agg(F.map_from_entries(pairs).alias("histogram"))


def readability_stats(docs: DataFrame, as_struct: bool = False, id_col: str = "doc_id", **kw) -> DataFrame:
    """The six readability indices; arguments as for ``basic_stats``."""
    counts = basic_stats(docs, id_col=id_col, **kw)
    out = counts.select(id_col, *(v.alias(k) for k, v in S.readability().items()))
    return out.select(id_col, F.struct(*S.READABILITY).alias("readability")) if as_struct else out


#: Bounds from which a value belongs to the next band.
BANDS = {"flesch_reading_easy": (30, 50, 60, 70, 80, 90), "lix": (30, 40, 50, 60), "automated_readability_index": tuple(range(2, 13))}


def band(metric: str) -> Column:
    """Number of the interpretation band of a readability index, from 0."""
    if metric not in BANDS:
        raise KeyError(metric)
    return sum((F.when(F.col(metric) >= b, 1).otherwise(0) for b in BANDS[metric]), F.lit(0))
