"""The word table of documents, words with lemmas from a lexicon, and the most frequent words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import WordSpec
from ..sources.shared import checkpointed


#: Words of a lexicon that is sent to every task, at most; a longer one is met by a shuffle of distinct words.
MAX_SENT = 300_000
#: Parts over which a frequent word's occurrences are spread when they get back what the lexicon says of it.
PARTS = 32


def word_table(docs: DataFrame, spec: WordSpec = WordSpec(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, word), one row for each word, positions from 0; row-local."""
    return docs.select(id_col, spec.column(F.col(text_col)).alias("_words")).select(id_col, F.posexplode("_words").alias("pos", "word"))


def listed_words(lists: DataFrame, id_col: str = "doc_id", words_col: str = "words") -> DataFrame:
    """The word table of texts that come cut into words; the words stay as they are."""
    return lists.select(id_col, F.posexplode(words_col).alias("pos", "word"))


def first_analyses(lexicon: DataFrame, rank_col: str | None = None) -> DataFrame:
    """One analysis for each word of a lexicon, keyed by lower case: the first by ``rank_col``, else by its fields in order.

    Combined before its one shuffle; a lexicon that is larger than a broadcast still works.
    """
    fields = [c for c in lexicon.columns if c not in ("word", rank_col)]
    order = F.struct(*([F.col(rank_col)] if rank_col else []), *(F.coalesce(F.col(c), F.lit("￿")).alias(c) for c in fields))
    return lexicon.where("word is not null").groupBy(F.lower("word").alias("key")).agg(F.min_by(F.struct(*fields), order).alias("a")).select("key", "a.*")


def meet(tokens: DataFrame, entries: DataFrame, spread: str, max_sent: int = MAX_SENT, parts: int = PARTS) -> DataFrame:
    """Tokens (with ``key``) with the columns of a lexicon's entries (one row a key); null where there is none.

    A lexicon of at most ``max_sent`` words goes to every task, and no token moves.  From a longer one the
    distinct words of the tokens, combined before the shuffle, pick their entries, one row each; those
    are repeated ``parts`` times, and the tokens meet them by key and a hash of ``spread``, so the
    occurrences of the commonest word are spread over as many tasks.
    """
    entries = checkpointed(entries)
    if entries.count() <= max_sent:
        return tokens.join(F.broadcast(entries), "key", "left")
    used = entries.join(tokens.select("key").distinct(), "key", "left_semi")
    used = used.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return tokens.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int")).join(used, ["key", "_part"], "left").drop("_part")


def extract_words(docs: DataFrame, spec: WordSpec, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_col: str | None = None) -> DataFrame:
    """(id, words) with lemmas from a lexicon table, see ``meet``.

    A word that the lexicon doesn't know is its own lemma, in lower case.
    """
    cut = docs.select(id_col, replace(spec, use_lexemes=False).tokens(F.col(text_col)).alias("_words"))
    tokens = cut.select(id_col, F.posexplode_outer("_words").alias("pos", "word"))
    lemmas = first_analyses(lexicon, rank_col).select("key", F.col("normal_form").alias("lemma"))
    met = meet(tokens.withColumn("key", F.lower("word")), lemmas, id_col).withColumn("lemma", F.coalesce("lemma", "key"))
    listed = met.groupBy(id_col).agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "lemma")))).alias("w"))
    return listed.select(id_col, spec.finish(F.col("w.lemma")).alias("words"))


def without_stopwords(words: DataFrame, stopwords: DataFrame) -> DataFrame:
    """A word table without the words of a stop list of any length."""
    return words.join(stopwords.select("word").distinct(), "word", "left_anti")


def ngram_counts(docs: DataFrame, spec: WordSpec, text_col: str = "text") -> DataFrame:
    """(word, cnt, docs): how often each word or n-gram of the spec occurs over all texts, and in how many.

    A text is one row, so its distinct words are known there; one shuffle, combined before it, of words alone.
    """
    each = F.transform("_words", lambda w: F.struct(w.alias("word"), F.lit(1).alias("cnt"), F.lit(0).alias("docs")))
    once = F.transform(F.array_distinct("_words"), lambda w: F.struct(w.alias("word"), F.lit(0).alias("cnt"), F.lit(1).alias("docs")))
    rows = docs.select(spec.column(F.col(text_col)).alias("_words")).select(F.explode(F.concat(each, once)).alias("x"))
    return rows.groupBy(F.col("x.word").alias("word")).agg(F.sum("x.cnt").alias("cnt"), F.sum("x.docs").alias("docs"))


def top_words_of(docs: DataFrame, n: int = 10, spec: WordSpec = WordSpec(), id_col: str = "doc_id", text_col: str = "text", words_col: str | None = None) -> DataFrame:
    """(id, word, cnt, first_pos, rank): the n most frequent words of each text, ties to the earlier one.

    A text is one row, so its words are counted where it is read: no shuffle.  ``top_words`` is for word tables.
    """
    if n < 1:
        raise ValueError("n is less than 1")
    id_type = dict(docs.dtypes)[id_col]
    w = F.col(words_col) if words_col else spec.column(F.col(text_col))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, words in zip(b["id"], b["words"]):
                if words is None:
                    continue
                words = words.tolist()
                first = {x: k for k, x in zip(range(len(words) - 1, -1, -1), reversed(words))}
                out += [(i, x, c, first[x], k) for k, (x, c) in enumerate(Counter(words).most_common(n), 1)]
            yield pd.DataFrame(out, columns=["id", "word", "cnt", "first_pos", "rank"])

    rows = docs.select(F.col(id_col).alias("id"), w.alias("words")).mapInPandas(run, f"id {id_type}, word string, cnt bigint, first_pos int, rank int")
    return rows.withColumnRenamed("id", id_col)


def top_words(words: DataFrame, n: int = 10, by: str | None = "doc_id") -> DataFrame:
    """The n most frequent words of each document, or of all if ``by`` is None; ties go to the earlier word.

    The counts are combined before the shuffle; over all documents the top is taken task by task.
    """
    if n < 1:
        raise ValueError("n is less than 1")
    if by is None:
        counts = words.groupBy("word").agg(F.count("*").alias("cnt"))
        return counts.orderBy(F.desc("cnt"), "word").limit(n)
    counts = words.groupBy(by, "word").agg(F.count("*").alias("cnt"), F.min("pos").alias("first_pos"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("cnt"), "first_pos"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)
