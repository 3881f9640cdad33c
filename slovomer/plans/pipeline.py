"""Statistics as pipeline stages that can be saved, and as SQL functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions.diversity import MEASURES, MIN_LEN, SAMPLE, SEGMENT, WINDOW, diversity_udf, measures_many
from ..functions.patterns import BOUNDARY_RE, PUNCTUATIONS, RU_LETTERS, RU_VOWELS, SPACES, TOKEN_RE
from ..functions.tokens import SentSpec, WordSpec
from ..operators import diversity, morphology


def _told(spec: SentSpec | WordSpec) -> dict:
    """A spec as plain values, from which ``_spec`` makes it again; a Python function can't be saved."""
    out = dict(vars(spec))
    if isinstance(out["tokenizer"], re.Pattern):
        out["tokenizer"] = [out["tokenizer"].pattern, out["tokenizer"].flags]
    return out


def _spec(kind: type, told: dict) -> SentSpec | WordSpec:
    values = {k: tuple(v) if isinstance(v, list) and k != "tokenizer" else v for k, v in told.items()}
    if isinstance(values.get("tokenizer"), list):
        values["tokenizer"] = re.compile(*values["tokenizer"])
    return kind(**values)


class _Stage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds one struct column with the results; its name is the stage's, or another."""

    default = ""
    default_words = WordSpec()

    name = Param(Params._dummy(), "name", "the result column", TypeConverters.toString)
    text_col = Param(Params._dummy(), "text_col", "the column of texts", TypeConverters.toString)
    words_col = Param(Params._dummy(), "words_col", "a column of words to use in place of the text's", TypeConverters.toString)
    sents_col = Param(Params._dummy(), "sents_col", "a column of sentences to use in place of the text's", TypeConverters.toString)
    sents = Param(Params._dummy(), "sents", "how texts are cut into sentences", TypeConverters.identity)
    words = Param(Params._dummy(), "words", "how texts are cut into words", TypeConverters.identity)

    def __init__(self, name: str | None = None, text_col: str = "text", words_col: str | None = None, sents_col: str | None = None, sents: SentSpec | None = None, words: WordSpec | None = None):
        super().__init__()
        self._setDefault(name=self.default, text_col="text", sents=_told(SentSpec()), words=_told(self.default_words))
        given = {"name": name, "text_col": text_col, "words_col": words_col, "sents_col": sents_col, "sents": sents and _told(sents), "words": words and _told(words)}
        self._set(**{k: v for k, v in given.items() if v is not None})

    def _of(self, param: Param) -> str | None:
        return self.getOrDefault(param) if self.isDefined(param) else None

    def _words(self) -> Column:
        given = self._of(self.words_col)
        return F.col(given) if given else _spec(WordSpec, self._of(self.words)).column(F.col(self._of(self.text_col)))

    def _sents(self) -> Column:
        given = self._of(self.sents_col)
        return F.col(given) if given else _spec(SentSpec, self._of(self.sents)).column(F.col(self._of(self.text_col)))

    def _columns(self, rows: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self._columns(dataset)


class _RowStage(_Stage):
    def _columns(self, rows: DataFrame) -> DataFrame:
        kept = rows.columns
        t = rows.withColumns({"_w": self._words(), "_s": self._sents()})
        t = t.withColumn("_y", F.transform("_w", lambda x: S.count_syllables(x)))
        counts = S.basic_counts(F.col(self._of(self.text_col)), F.col("_w"), F.col("_s"), F.col("_y"))
        t = t.withColumn("_b", F.when(F.size("_w") > 0, F.struct(*(v.alias(k) for k, v in counts.items()))))
        return t.select(*kept, self._result().alias(self._of(self.name)))

    def _result(self) -> Column:
        return F.col("_b")


class BasicStage(_RowStage):
    default = "basic"


class ReadabilityStage(_RowStage):
    default = "readability"

    def _result(self) -> Column:
        return F.struct(*(v.alias(k) for k, v in S.readability(lambda c: F.col(f"_b.{c}")).items()))


class DiversityStage(_Stage):
    """The fourteen measures over the words in lower case, or over those of another extractor."""

    default = "diversity"
    default_words = diversity.LOWER

    def _columns(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(self._of(self.name), diversity_udf()(self._words()))


#: Key of the words without a grammeme in the maps of ``MorphStage``.
NONE = "None"


class MorphStage(_Stage):
    """Adds a map of category to a map of value to count, words without a value under ``NONE``; needs the lexicon and an id column.

    The lexicon is a table, so it isn't saved with the stage: give a loaded stage its ``lexicon`` again.
    """

    default = "morph"

    id_col = Param(Params._dummy(), "id_col", "the column that names a text", TypeConverters.toString)
    filter_none = Param(Params._dummy(), "filter_none", "leave out words without a value", TypeConverters.toBoolean)

    def __init__(self, lexicon: DataFrame | None = None, id_col: str = "doc_id", filter_none: bool = False, **kw):
        super().__init__(**kw)
        self.lexicon = lexicon
        self._set(id_col=id_col, filter_none=filter_none)

    def _columns(self, rows: DataFrame) -> DataFrame:
        if self.lexicon is None:
            raise ValueError("the stage has no lexicon")
        key = self._of(self.id_col)
        lists = rows.select(key, self._words().alias("_w"))
        tags = morphology.analyse(lists, self.lexicon, id_col=key, words_col="_w")
        long = morphology.morph_stats(tags, filter_none=self._of(self.filter_none), id_col=key)
        pair = F.struct(F.coalesce("value", F.lit(NONE)).alias("value"), "cnt")
        per = long.groupBy(key, "category").agg(F.map_from_entries(F.array_sort(F.collect_list(pair))).alias("m"))
        whole = per.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("category", "m"))).alias(self._of(self.name)))
        return rows.join(whole, key, "left")


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _in(text: str, characters: str) -> str:
    return f"length({text}) - length(translate({text}, {_sql(characters)}, ''))"


_PER = "try_divide(CAST({} AS DOUBLE), CAST({} AS DOUBLE))".format


def _bodies() -> dict[str, tuple[str, str]]:
    """Arguments and body of each SQL function."""
    syl, words, sents, letters = "n_syllables BIGINT", "n_words BIGINT", "n_sents BIGINT", "n_letters BIGINT"
    coefficients = "a DOUBLE DEFAULT {}, b DOUBLE DEFAULT {}, c DOUBLE DEFAULT {}".format
    w_s, y_w, l_w = _PER("n_words", "n_sents"), _PER("n_syllables", "n_words"), _PER("n_letters", "n_words")
    return {
        "words": ("text STRING", f"filter(regexp_extract_all(text, {_sql(TOKEN_RE)}, 0), w -> NOT contains({_sql(PUNCTUATIONS)}, w))"),
        "sentences": ("text STRING", f"CASE WHEN text RLIKE '\\\\S' THEN split(regexp_replace(text, {_sql(BOUNDARY_RE)}, '$1\\u0001$2'), '\\u0001', -1) WHEN text IS NOT NULL THEN CAST(array() AS ARRAY<STRING>) END"),
        "ngrams": ("words ARRAY<STRING>, n INT", "CASE WHEN size(words) >= n THEN transform(sequence(0, size(words) - n), i -> concat_ws('_', slice(words, i + 1, n))) WHEN words IS NOT NULL THEN CAST(array() AS ARRAY<STRING>) END"),
        "syllables": ("word STRING", _in("word", RU_VOWELS)),
        "count_syllables": ("word STRING", _in("word", RU_VOWELS)),
        "count_letters": ("text STRING", _in("text", RU_LETTERS)),
        "count_spaces": ("text STRING", _in("text", SPACES)),
        "count_punctuations": ("text STRING", _in("text", PUNCTUATIONS)),
        "count_chars": ("text STRING", "length(replace(text, '\\n', ''))"),
        "type_token_ratio": ("words ARRAY<STRING>", f"coalesce({_PER('size(array_distinct(words))', 'size(words)')}, 0D)"),
        "calc_flesch_kincaid_grade": (f"{syl}, {words}, {sents}, {coefficients('0.49', '7.3', '16.59')}", f"a * {w_s} + b * {y_w} - c"),
        "calc_flesch_reading_easy": (f"{syl}, {words}, {sents}, {coefficients('1.3', '60.1', '206.835')}", f"c - a * {w_s} - b * {y_w}"),
        "calc_coleman_liau_index": (f"{letters}, {words}, {sents}, {coefficients('0.055', '0.35', '20.33')}", f"a * {l_w} * 100 - b * {_PER('n_sents', 'n_words')} * 100 - c"),
        "calc_smog_index": (f"n_complex BIGINT, {sents}, {coefficients('1.1', '64.6', '0.05')}", f"a * sqrt(b * {_PER('n_complex', 'n_sents')}) + c"),
        "calc_automated_readability_index": (f"{letters}, {words}, {sents}, {coefficients('6.26', '0.2805', '31.04')}", f"a * {l_w} + b * {w_s} - c"),
        "calc_lix": (f"n_long_words BIGINT, {words}, {sents}", f"{w_s} + 100 * {_PER('n_long_words', 'n_words')}"),
    }


#: Measures with a size of their own, which is their SQL function's second argument.
_SIZED = {"mattr": ("window", WINDOW), "msttr": ("segment", SEGMENT), "mtld": ("min_len", MIN_LEN), "mamtld": ("min_len", MIN_LEN), "hdd": ("sample", SAMPLE)}


def _measure_udf(name: str):
    """One measure as a vectorised function of (words) or (words, size)."""
    argument, usual = _SIZED.get(name, ("", 0))

    def of(lists: pd.Series, size: int = usual) -> pd.Series:
        told = iter(measures_many([w for w in lists if w is not None], only=(name,), **({argument: size} if argument else {})))
        return lists.map(lambda w: None if w is None else next(told)[0])

    def plain(words: pd.Series) -> pd.Series:
        return of(words)

    def sized(words: pd.Series, size: pd.Series) -> pd.Series:
        return of(words, int(size.iloc[0])) if len(words) else of(words)

    return F.pandas_udf(sized if argument else plain, "double")


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """SQL functions of single texts: bodies of expressions are inlined by Catalyst, the diversity measures are vectorised Python.

    ``calc_mattr``, ``calc_msttr``, ``calc_mtld``, ``calc_mamtld`` and ``calc_hdd`` take (words, size), the other measures (words).
    """
    bodies = _bodies()
    for name, (args, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({args}) RETURN {body}")
    for m in MEASURES:
        spark.udf.register(f"{prefix}calc_{m}", _measure_udf(m))
    spark.udf.register(f"{prefix}diversity", diversity_udf())
    return [*(prefix + n for n in bodies), *(f"{prefix}calc_{m}" for m in MEASURES), f"{prefix}diversity"]


__all__ = ["MEASURES", "BasicStage", "DiversityStage", "MorphStage", "ReadabilityStage", "register"]
