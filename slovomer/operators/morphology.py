"""Morphology through a lexicon table: tags of every word, their counts, and the explanation of a text.

The lexicon has ``word``, ``normal_form`` and the grammemes, each null where it does not
apply; a word with several analyses has its first, one without any has none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import WordSpec
from .words import first_analyses, listed_words, meet, word_table

CATEGORIES = ("pos", "animacy", "aspect", "case", "gender", "involvement", "mood", "number", "person", "tense", "transitivity", "voice")


_SEP = "\x1f"


def checked(names: tuple[str, ...]) -> tuple[str, ...]:
    """The chosen categories, all if none is named; an unknown one is a KeyError."""
    for n in names:
        if n not in CATEGORIES:
            raise KeyError(f"{n}: choose from {', '.join(CATEGORIES)}")
    return names or CATEGORIES


def tagged(words: DataFrame, lexicon: DataFrame, case_col: str = "gram_case", rank_col: str | None = None) -> DataFrame:
    """A word table (id, pos, word) with the twelve grammemes in a struct ``tag``.

    The lexicon is reduced to one row a word before the join, see ``meet``.
    """
    if case_col in lexicon.columns and case_col != "case":
        lexicon = lexicon.withColumnRenamed(case_col, "case")
    code = F.concat_ws(_SEP, *(F.coalesce(F.col(c), F.lit("")) for c in CATEGORIES))
    first = first_analyses(lexicon, rank_col).select("key", "normal_form", F.struct(*CATEGORIES).alias("tag"), code.alias("code"))
    spread = next(c for c in words.columns if c not in ("pos", "word"))
    return meet(words.withColumn("key", F.lower("word")), first, spread).drop("key")


def analyse(docs: DataFrame, lexicon: DataFrame, words: WordSpec = WordSpec(), id_col: str = "doc_id", text_col: str = "text", words_col: str | None = None, **kw) -> DataFrame:
    table = listed_words(docs, id_col, words_col) if words_col else word_table(docs, words, id_col, text_col)
    return tagged(table, lexicon, **kw)


def morph_stats(tags: DataFrame, *names: str, filter_none: bool = False, id_col: str = "doc_id") -> DataFrame:
    """(id, category, value, cnt) of the chosen categories; ``filter_none`` leaves out words without a value."""
    chosen = checked(names)
    # combine equal tags first, by one string that the lexicon side made: the unpivot then runs over tags, not words
    few = tags.groupBy(id_col, "code").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    few = few.withColumn("values", F.split("code", _SEP, -1))
    pairs = F.array(*(F.struct(F.lit(c).alias("category"), F.nullif(F.get("values", F.lit(CATEGORIES.index(c))), F.lit("")).alias("value")) for c in chosen))
    long = few.select(id_col, "n", "first_pos", F.explode(pairs).alias("p")).select(id_col, "p.*", "n", "first_pos")
    if filter_none:
        long = long.where("value is not null")
    return long.groupBy(id_col, "category", "value").agg(F.sum("n").alias("cnt"), F.min("first_pos").alias("first_pos"))


def ordered_stats(stats: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts with their rank in a category: the most frequent first, ties by first occurrence."""
    w = Window.partitionBy(id_col, "category").orderBy(F.desc("cnt"), "first_pos")
    return stats.withColumn("rank", F.row_number().over(w))


def explain(tags: DataFrame, *names: str, filter_none: bool = False, id_col: str = "doc_id") -> DataFrame:
    """(id, pos, word, tags): each word in order with a map of its chosen grammemes."""
    chosen = checked(names)
    m = F.create_map(*(x for c in chosen for x in (F.lit(c), F.col(f"tag.{c}"))))
    if filter_none:
        m = F.map_filter(m, lambda k, v: v.isNotNull())
    return tags.select(id_col, "pos", "word", m.alias("tags"))
