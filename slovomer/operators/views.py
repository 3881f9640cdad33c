"""Tables behind three pictures of texts: rank-frequency curve, fingerprint, word tree."""

from __future__ import annotations

from collections.abc import Callable
from math import log10

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tokens import span
from ..sources.shared import checkpointed
from .diversity import ttr


def zipf_ranks(words: DataFrame, num_words: int | None = None) -> DataFrame:
    """(rank, word, cnt): ranks by frequency, ties by word.

    The whole vocabulary gets its ranks without one task seeing all: the counts are split by ranges of
    (count, word), each range is numbered by itself, and starts where the ones before end.  With ``num_words``
    only the top is sorted.
    """
    counts = words if "cnt" in words.columns else words.groupBy("word").agg(F.count("*").alias("cnt"))
    if num_words:
        top = counts.orderBy(F.desc("cnt"), "word").limit(num_words)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cnt"), "word")).cast("bigint")).select("rank", "word", "cnt")
    # a global sort is one by ranges; the id's lower 33 bits number the rows of a range
    ranged = checkpointed(counts.orderBy(F.desc("cnt"), "word").select("word", "cnt", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("k")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = ranged.groupBy("part").agg(F.count("*").alias("size")).select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    return ranged.join(F.broadcast(starts), "part").select((F.col("start") + F.col("k") + 1).alias("rank"), "word", "cnt")


def zipf_labels(num_points: int, num_labels: int = 10) -> list[int]:
    """Indices of the points that get a label, spread evenly on a logarithmic scale."""
    return [int(x) for x in np.logspace(-0.5, log10(max(num_points - 1, 1)), num_labels)] if num_labels > 0 else []


def zipf_theory(spark: SparkSession, size: float, num_ranks: int, alpha: float = 1.5) -> DataFrame:
    """(rank, frequency) of the law itself, scaled to ``size`` at rank 1; defined for alpha above 1."""
    if alpha <= 1:
        raise ValueError("alpha must be greater than 1")
    r = F.col("rank")
    return spark.range(1, num_ranks + 1).select(F.col("id").cast("int").alias("rank")).withColumn("frequency", F.lit(float(size)) * F.pow(r.cast("double"), F.lit(-float(alpha))))


def fingerprint(lists: DataFrame, segment_len: int = 10, metric: Callable[[Column], Column] | Callable[[list[str]], float] | None = None, python_metric: bool = False, id_col: str = "doc_id", words_col: str = "words") -> DataFrame:
    """(id, seg_pos, metric) of sliding segments, a tenth of their length apart, and of the rest, which always comes last.

    ``metric`` is an expression over an array of words (type-token ratio by default), or with
    ``python_metric`` a function of a word list.
    """
    step = max(1, int(0.1 * segment_len))
    w = F.col(words_col)
    n = F.size(w)
    k = F.when(n >= segment_len, F.floor((n - segment_len) / step) + 1).otherwise(0).cast("int")
    starts = F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
    pieces = F.concat(F.transform(starts, lambda i: span(w, i * step, segment_len)), F.array(F.slice(w, k * step + 1, F.greatest(n - k * step, F.lit(0)))))
    if python_metric and metric is not None:

        @F.pandas_udf("double")
        def measured(segments: pd.Series) -> pd.Series:
            return segments.map(lambda s: float(metric(list(s))))

        # segments first, then the function: it can't be evaluated inside a generator
        segments = lists.where(w.isNotNull()).select(id_col, F.posexplode(pieces).alias("seg_pos", "segment"))
        return segments.select(id_col, "seg_pos", measured("segment").alias("metric"))
    return lists.where(w.isNotNull()).select(id_col, F.posexplode(F.transform(pieces, metric or ttr)).alias("seg_pos", "metric"))


def fingerprint_grid(prints: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds the cell of each segment (grid_row, grid_col) and its shade: value by the greatest of all, 0 where that is 0.

    A text of m segments has ceil(m / 8) columns, filled row by row.
    """
    m = F.count("*").over(Window.partitionBy(id_col))
    cols = F.greatest(F.ceil(m / 8), F.lit(1)).cast("int")
    most = prints.agg(F.max("metric")).scalar()
    out = prints.withColumn("cols", cols)
    return out.select(id_col, "seg_pos", "metric", F.floor(F.col("seg_pos") / F.col("cols")).cast("int").alias("grid_row"), (F.col("seg_pos") % F.col("cols")).cast("int").alias("grid_col"), F.coalesce(F.try_divide(F.col("metric"), most), F.lit(0.0)).alias("shade"))


def keyword_ngrams(lists: DataFrame, keyword: str, max_n: int = 5, words_col: str = "words") -> DataFrame:
    """(ngram, n, forward, freq): n-grams of 2 to ``max_n`` words that begin or end with a keyword, over all texts.

    Only places where the keyword stands are looked at; the counts are combined before the shuffle.
    """
    w = F.col(words_col)
    places = F.filter(F.transform(w, lambda x, i: F.when(x == keyword, i)), lambda i: i.isNotNull())

    def around(p: Column) -> Column:
        after = [F.when(p + n <= F.size(w), span(w, p, n)) for n in range(2, max_n + 1)]
        # an n-gram with the keyword at both ends is found where it begins
        before = [F.when((p - n + 1 >= 0) & (F.get(w, F.greatest(p - n + 1, F.lit(0))) != keyword), span(w, p - n + 1, n)) for n in range(2, max_n + 1)]
        return F.array(*after, *before)

    grams = lists.where(F.array_contains(w, keyword)).select(F.explode(F.flatten(F.transform(places, around))).alias("ngram")).where("ngram is not null")
    return grams.groupBy("ngram").agg(F.count("*").alias("freq")).select("ngram", F.size("ngram").alias("n"), (F.element_at("ngram", 1) == keyword).alias("forward"), "freq")


def top_ngrams(ngrams: DataFrame, max_per_n: int = 8) -> DataFrame:
    """The most frequent n-grams of each direction and length, ties by the words in order; ``order`` is their rank over all."""
    w = Window.partitionBy("forward", "n").orderBy(F.desc("freq"), "ngram")
    top = ngrams.withColumn("k", F.row_number().over(w)).where(F.col("k") <= max_per_n).drop("k")
    return top.withColumn("order", F.row_number().over(Window.orderBy(F.desc("freq"), "ngram", "forward")))  # at most 2 (max_n - 1) max_per_n rows


def tree_edges(top: DataFrame, keyword: str) -> DataFrame:
    """The word tree as edges: (direction, depth, path, parent_path, word, freq).

    A node has the frequency of the n-gram that ends there, else that of the first n-gram through it.
    """
    back = F.reverse(F.slice("ngram", 1, F.size("ngram") - 1))
    branches = top.select("freq", "order", F.explode(F.array(
        F.struct(F.lit("forward").alias("direction"), F.when(F.element_at("ngram", 1) == keyword, F.slice("ngram", 2, F.size("ngram"))).alias("branch")),
        F.struct(F.lit("backward").alias("direction"), F.when(F.element_at("ngram", -1) == keyword, back).alias("branch")),
    )).alias("b")).select("freq", "order", "b.*").where("branch is not null")
    nodes = branches.select("direction", "freq", "order", F.size("branch").alias("size"), F.explode(F.transform(F.sequence(F.lit(1), F.size("branch")), lambda i: F.slice("branch", 1, i))).alias("p"))
    exact = F.max(F.when(F.col("size") == F.size("p"), F.col("freq")))
    g = nodes.groupBy("direction", "p").agg(F.coalesce(exact, F.min_by("freq", "order")).alias("freq"))
    path = lambda x: F.array_join(x, " ")
    return g.select("direction", F.size("p").alias("depth"), path(F.col("p")).alias("path"), path(F.slice("p", 1, F.size("p") - 1)).alias("parent_path"), F.element_at("p", -1).alias("word"), "freq")


def font_sizes(edges: DataFrame, smallest: int = 12, largest: int = 30, interpolate: Callable[[Column], Column] | None = None) -> DataFrame:
    """Adds the font size of each node: the cube root (or ``interpolate``) of its share of the most frequent first word."""
    most = edges.where("depth = 1").agg(F.max("freq")).scalar()
    share = F.try_divide(F.col("freq").cast("double"), most.cast("double"))
    return edges.withColumn("font_size", F.floor((interpolate or F.cbrt)(share) * (largest - smallest) + smallest).cast("int"))
