"""Lexical diversity of documents: all measures row by row, or by aggregation of a word table.

Defined results for odd input: a null list has null measures; an empty one has 0 for
all but ``mamtld`` (1) and ``hdd`` (-1), by aggregation no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.diversity import MEASURES, MIN_LEN, SAMPLE, SEGMENT, WINDOW, diversity_udf
from ..functions.stats import safe_divide
from ..functions.tokens import WordSpec

LOWER = WordSpec(lowercase=True)


def diversity_stats(docs: DataFrame, words: WordSpec = LOWER, id_col: str = "doc_id", text_col: str = "text", words_col: str | None = None, as_struct: bool = False, only: tuple[str, ...] = MEASURES, **sizes) -> DataFrame:
    """The fourteen measures, or those in ``only``: one Arrow pass over the word lists, no shuffle."""
    w = F.col(words_col) if words_col else words.column(F.col(text_col))
    out = docs.select(id_col, diversity_udf(only=only, **sizes)(w).alias("diversity"))
    return out if as_struct else out.select(id_col, *(F.col(f"diversity.{m}").alias(m) for m in only))


def frequencies(words: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, word, f) of a word table; a document's words are together, so nearly all is summed before the shuffle."""
    return words.groupBy(id_col, "word").agg(F.count("*").alias("f"))


def frequency_measures(words: DataFrame, id_col: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """The measures that follow from frequencies, from one frequency table: the ratios, HD-D, Simpson's and the hapax index."""
    f = frequencies(words, id_col)
    f = f.withColumn("n", F.sum("f").over(Window.partitionBy(id_col)))
    n, freq = F.col("n"), F.col("f")
    absent = F.aggregate(F.sequence(F.lit(0), F.lit(max(sample, 1) - 1)), F.lit(1.0), lambda a, i: a * safe_divide(F.greatest(F.lit(0), n - freq - i), n - i))
    part = F.when((F.lit(sample) <= 0) | (F.lit(sample) > n), F.lit(0.0)).otherwise((1 - absent) / F.lit(float(max(sample, 1))))
    f = f.select(id_col, "f", F.col("n").alias("size"), part.alias("part"))
    a = f.groupBy(id_col).agg(F.max("size").alias("n"), F.count("*").alias("v"), F.sum("part").alias("hdd"), F.sum(freq * (freq - 1)).alias("pairs"), F.count_if(freq == 1).alias("hapaxes"))
    n, v = F.col("n"), F.col("v")
    ln, lv = F.log10("n"), F.log10("v")
    return a.select(
        id_col,
        safe_divide(v, n).alias("ttr"),
        safe_divide(v, F.sqrt(n)).alias("rttr"),
        safe_divide(v, F.sqrt(2 * n)).alias("cttr"),
        safe_divide(lv, ln).alias("httr"),
        F.when((n <= 1) | (v <= 1), 0.0).otherwise(safe_divide(F.log10(lv), F.log10(ln))).alias("sttr"),
        safe_divide(ln - lv, ln * ln).alias("mttr"),
        safe_divide(ln * ln, F.when(n == v, 0.0).otherwise(ln - lv)).alias("dttr"),
        F.when(n < 50, -1.0).otherwise(F.col("hdd")).alias("hdd"),
        safe_divide(n * (n - 1), F.col("pairs")).alias("simpson_index"),
        safe_divide(100 * ln, F.when(F.col("hapaxes") == v, 0.0).otherwise(1 - safe_divide(F.col("hapaxes"), v))).alias("hapax_index"),
    )


def mattr(words: DataFrame, window: int = WINDOW, id_col: str = "doc_id") -> DataFrame:
    """Moving-average ratio in closed form: a word counts in the windows that start after its previous occurrence."""
    w = Window.partitionBy(id_col, "word").orderBy("pos")
    t = words.withColumn("prev", F.coalesce(F.lag("pos").over(w), F.lit(-1))).withColumn("n", F.count("*").over(Window.partitionBy(id_col)))
    fresh = F.least("pos", F.col("n") - window) - F.greatest(F.col("prev") + 1, F.col("pos") - window + 1, F.lit(0)) + 1
    a = t.groupBy(id_col).agg(F.max("n").alias("n"), F.sum(F.greatest(F.lit(0), fresh)).alias("fresh"), F.count_if(F.col("prev") < 0).alias("v"))
    return a.select(id_col, F.when(F.col("n") < window + 1, safe_divide(F.col("v"), F.col("n"))).otherwise(safe_divide(F.col("fresh"), window * (F.col("n") - window + 1))).alias("mattr"))


def msttr(words: DataFrame, segment: int = SEGMENT, id_col: str = "doc_id") -> DataFrame:
    """Mean ratio of full segments: distinct words of each, counted by document and segment."""
    t = words.withColumn("n", F.count("*").over(Window.partitionBy(id_col))).withColumn("seg", F.floor(F.col("pos") / segment))
    short = F.col("n") < segment + 1
    t = t.withColumn("seg", F.when(short, 0).otherwise(F.col("seg"))).where(short | (F.col("seg") < F.floor(F.col("n") / segment)))
    a = t.groupBy(id_col, "seg", "word").agg(F.max("n").alias("n")).groupBy(id_col).agg(F.max("n").alias("n"), F.count("*").alias("d"))
    return a.select(id_col, F.when(F.col("n") < segment + 1, safe_divide(F.col("d"), F.col("n"))).otherwise(safe_divide(F.col("d"), F.floor(F.col("n") / segment) * segment)).alias("msttr"))


def one_measure(docs: DataFrame, name: str, words: WordSpec = LOWER, **kw) -> DataFrame:
    """(id, measure): one of the fourteen by name."""
    if name not in MEASURES:
        raise KeyError(name)
    return diversity_stats(docs, words, only=(name,), **kw)


def ttr(words: Column) -> Column:
    """Type-token ratio of an array of words, as an expression; 0 for an empty one."""
    return safe_divide(F.size(F.array_distinct(words)), F.size(words))


__all__ = ["MIN_LEN", "diversity_stats", "frequencies", "frequency_measures", "mattr", "msttr", "one_measure", "ttr"]
