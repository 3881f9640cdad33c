"""Queries of the text operators over the tables of a directory, and SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import stats as S
from .functions.diversity import MEASURES
from .functions.patterns import BOUNDARY_RE, PUNCTUATIONS, RU_LETTERS, RU_VOWELS, SPACES, TOKEN_RE
from .functions.tokens import SentSpec, WordSpec
from .operators import diversity, morphology, stats, views, words
from .sources import corpus

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# SQL of the shared steps
_TOKENS = f"regexp_extract_all(text, {_q(TOKEN_RE)})"
_WORDS = f"list_filter({_TOKENS}, lambda w: not contains({_q(PUNCTUATIONS)}, w))"
_SENTS = f"case when regexp_matches(text, '\\S') then string_split(regexp_replace(text, {_q(BOUNDARY_RE)}, '\\1' || chr(1) || '\\2', 'g'), chr(1)) when text is not null then [] end"


def _in(text: str, characters: str) -> str:
    return f"length({text}) - length(translate({text}, {_q(characters)}, ''))"


def _counts(source: str, key: str, wanted: str = "", alphabet: S.Alphabet = S.RU) -> str:
    """SQL of the counts of (key, text); ``wanted`` is the select list over them."""
    n = lambda cond: f"len(list_filter(y, lambda v: {cond}))"
    return f"""with cut as (select {key}, text, {_WORDS} as w, {_SENTS} as s from {source}),
c as (select *, list_transform(w, lambda x: {_in("x", alphabet.vowels)}) as y from cut),
b as (select {key}, len(s) as n_sents, len(w) as n_words, len(list_distinct(list_transform(w, lambda x: lower(x)))) as n_unique_words, len(list_filter(w, lambda x: length(x) >= 6)) as n_long_words,
 {n("v >= 4")} as n_complex_words, {n("v > 0 and v < 4")} as n_simple_words, {n("v = 1")} as n_monosyllable_words, {n("v > 1")} as n_polysyllable_words, length(replace(text, chr(10), '')) as n_chars,
 {_in("text", alphabet.letters)} as n_letters, {_in("text", SPACES)} as n_spaces, coalesce(list_sum(y), 0)::bigint as n_syllables, {_in("text", PUNCTUATIONS)} as n_punctuations from c where len(w) > 0)
select d.{key}, {wanted or ", ".join("b." + c for c in S.COUNTS)} from {source} d left join b using ({key})"""


_RATIOS = ", ".join(f"round(b.n_{x} / nullif(b.n_words, 0)::double, 9) as p_{x}" for x in S.WORD_RATIOS) + ", " + ", ".join(f"round(b.n_{x} / nullif(b.n_chars, 0)::double, 9) as p_{x}" for x in S.CHAR_RATIOS)
_INDICES = """round(0.49 * n_words / nullif(n_sents, 0)::double + 7.3 * n_syllables / n_words::double - 16.59, 9) as flesch_kincaid_grade,
round(206.835 - 1.3 * n_words / nullif(n_sents, 0)::double - 60.1 * n_syllables / n_words::double, 9) as flesch_reading_easy,
round(0.055 * n_letters / n_words::double * 100 - 0.35 * n_sents / n_words::double * 100 - 20.33, 9) as coleman_liau_index,
round(1.1 * sqrt(64.6 * n_complex_words / nullif(n_sents, 0)::double) + 0.05, 9) as smog_index,
round(6.26 * n_letters / n_words::double + 0.2805 * n_words / nullif(n_sents, 0)::double - 31.04, 9) as automated_readability_index,
round(n_words / nullif(n_sents, 0)::double + 100 * n_long_words / n_words::double, 9) as lix"""


@query(_counts("documents", "doc_id"))
def basic_stats(spark: SparkSession, folder: str) -> DataFrame:
    return stats.basic_stats(_t(spark, folder, "documents"))


@query(_counts("documents", "doc_id", alphabet=S.LATIN))
def basic_stats_latin(spark: SparkSession, folder: str) -> DataFrame:
    return stats.basic_stats(_t(spark, folder, "documents"), alphabet=S.LATIN)


@query(_counts("documents", "doc_id", _RATIOS))
def basic_stats_ratios(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(stats.basic_stats(_t(spark, folder, "documents"), normalize=True).select("doc_id", *S.RATIOS))


@query(_counts("documents", "doc_id", _INDICES))
def readability(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(stats.readability_stats(_t(spark, folder, "documents")))


_STATE = "(select distinct rec_id, text from primer_records)"


@query(_counts(_STATE, "rec_id", _INDICES))
def readability_primer(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(stats.readability_stats(_t(spark, folder, "primer_records").select("rec_id", "text").distinct(), id_col="rec_id"))


def _hist(key: str) -> str:
    return f"select doc_id, {key} as key, count(*) as cnt from (select doc_id, unnest({_WORDS}) as w from documents) group by all"


@query(_hist("length(w)"))
def hist_word_length(spark: SparkSession, folder: str) -> DataFrame:
    return stats.histogram(_t(spark, folder, "documents"), "letters")


@query(_hist(_in("w", RU_VOWELS)))
def hist_syllables(spark: SparkSession, folder: str) -> DataFrame:
    return stats.histogram(_t(spark, folder, "documents"), "syllables")


@query(f"select doc_id, string_agg(key || ':' || cnt, ' ' order by key) as histogram from ({_hist('length(w)')}) group by doc_id")
def hist_word_length_map(spark: SparkSession, folder: str) -> DataFrame:
    """The map of each document, shown as its entries."""
    maps = stats.histogram_map(stats.histogram(_t(spark, folder, "documents"), "letters"))
    return maps.select("doc_id", F.array_join(F.transform(F.map_entries("histogram"), lambda e: F.concat_ws(":", e["key"], e["value"])), " ").alias("histogram"))


# Two texts with known results.
GOLDEN = {
    1: "Ног нет, а хожу, рта нет, а скажу: когда спать, когда вставать, когда работу начинать",
    2: "Существуют три вида лжи: ложь, наглая ложь и статистика",
}
_VALUES = "(values " + ", ".join(f"({k}::bigint, {_q(v)})" for k, v in GOLDEN.items()) + ") as golden(doc_id, text)"
_GOLDEN_SQL = f"(select * from {_VALUES})"


def _golden(spark: SparkSession) -> DataFrame:
    return spark.sql("select * from values " + ", ".join(f"({k}L, {_q(v)})" for k, v in GOLDEN.items()) + " as golden(doc_id, text)")


@query(_counts(_GOLDEN_SQL, "doc_id"))
def basic_ru_golden(spark: SparkSession, folder: str) -> DataFrame:
    return stats.basic_stats(_golden(spark))


@query(_counts(_GOLDEN_SQL, "doc_id", _INDICES))
def readability_ru_golden(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(stats.readability_stats(_golden(spark)))


def _listed(df: DataFrame, column, name: str, key: str = "doc_id") -> DataFrame:
    return df.select(key, F.posexplode(column).alias("pos", name))


def _unnested(expr: str, name: str, source: str = "documents", key: str = "doc_id") -> str:
    return f"select {key}, (unnest(range(len(l))))::int as pos, unnest(l) as {name} from (select {key}, {expr} as l from {source})"


@query(_unnested(_SENTS, "sent"))
def sentences_default(spark: SparkSession, folder: str) -> DataFrame:
    return _listed(_t(spark, folder, "documents"), SentSpec().column(F.col("text")), "sent")


@query(_unnested("string_split_regex(text, '[;.]')", "sent"))
def sentences_regex(spark: SparkSession, folder: str) -> DataFrame:
    return _listed(_t(spark, folder, "documents"), SentSpec(re.compile("[;.]")).column(F.col("text")), "sent")


@query(_unnested(f"list_filter({_SENTS}, lambda s: length(s) between 20 and 200)", "sent"))
def sentence_len_filter(spark: SparkSession, folder: str) -> DataFrame:
    return _listed(_t(spark, folder, "documents"), SentSpec(min_len=20, max_len=200).column(F.col("text")), "sent")


def _word_query(spec: WordSpec) -> Query:
    return lambda spark, folder: words.word_table(_t(spark, folder, "documents"), spec)


_STOP = ("и", "а", "с", "в", "на", "не")
_LOWER = f"list_transform({_WORDS}, lambda w: lower(w))"
for _name, _spec, _sql in (
    ("words_default", WordSpec(), _WORDS),
    ("words_with_punctuation", WordSpec(filter_punct=False), _TOKENS),
    ("words_regex_split", WordSpec(re.compile(r"[ \n,.!?…]+")), f"list_filter(string_split_regex(text, '[ \\n,.!?…]+'), lambda w: not contains({_q(PUNCTUATIONS)}, w))"),
    ("words_nums_filtered", WordSpec(filter_nums=True), f"list_filter({_WORDS}, lambda w: not regexp_full_match(w, '\\p{{N}}+'))"),
    ("words_stopwords", WordSpec(stopwords=_STOP), f"list_filter({_WORDS}, lambda w: w not in ({', '.join(map(_q, _STOP))}))"),
    ("words_lower", WordSpec(lowercase=True), _LOWER),
    ("words_len", WordSpec(min_len=3, max_len=8), f"list_filter({_WORDS}, lambda w: length(w) between 3 and 8)"),
):
    QUERIES[_name] = _word_query(_spec)
    SQL[_name] = _unnested(_sql, "word")


@query(f"""with tok as (select doc_id, (unnest(range(len(l))))::int as pos, unnest(l) as word from (select doc_id, {_LOWER} as l from documents)),
t as (select doc_id, word, lead(word) over w as b, lead(word, 2) over w as c from tok window w as (partition by doc_id order by pos)),
g as (select doc_id, word from t union all select doc_id, word || '_' || b from t where b is not null union all select doc_id, word || '_' || b || '_' || c from t where c is not null)
select word, count(*) as cnt, count(distinct doc_id) as docs from g group by word""")
def ngrams_1_3(spark: SparkSession, folder: str) -> DataFrame:
    return words.ngram_counts(_t(spark, folder, "documents"), WordSpec(lowercase=True, ngram_range=(1, 3)))


_FIELDS = ("normal_form", "pos", "animacy", "aspect", "gram_case", "gender", "involvement", "mood", "number", "person", "tense", "transitivity", "voice")
_FIRST = "first as (select key, a.* from (select lower(word) as key, arg_min({" + ", ".join(f"'{c}': {c}" for c in _FIELDS) + "}, row(" + ", ".join(f"coalesce({c}, '￿')" for c in _FIELDS) + ")) as a from lexicon where word is not null group by 1))"
_PLAIN = f"tok as (select doc_id, (unnest(range(len(l))))::int as pos, unnest(l) as word from (select doc_id, {_WORDS} as l from documents))"


@query(f"with {_FIRST}, {_PLAIN} select doc_id, array_to_string(list(coalesce(normal_form, lower(word)) order by tok.pos), ' ') as lemmas from tok left join first on key = lower(word) group by doc_id")
def words_lemmas(spark: SparkSession, folder: str) -> DataFrame:
    out = words.extract_words(_t(spark, folder, "documents"), WordSpec(use_lexemes=True), _t(spark, folder, "lexicon"))
    return out.where("size(words) > 0").select("doc_id", F.array_join("words", " ").alias("lemmas"))


_TOP_PER_DOC = f"with {_PLAIN} select doc_id, word, count(*) as cnt, min(pos) as first_pos, row_number() over (partition by doc_id order by count(*) desc, min(pos))::int as rank from tok group by doc_id, word qualify rank <= 10"


@query(_TOP_PER_DOC)
def top_words_per_doc(spark: SparkSession, folder: str) -> DataFrame:
    return words.top_words_of(_t(spark, folder, "documents"), 10)


@query(_TOP_PER_DOC)
def top_words_of_table(spark: SparkSession, folder: str) -> DataFrame:
    return words.top_words(words.word_table(_t(spark, folder, "documents")), 10)


@query(f"with {_PLAIN} select doc_id, tok.pos, word from tok where word not in (select word from common_words where word is not null)")
def words_without_stoplist(spark: SparkSession, folder: str) -> DataFrame:
    return words.without_stopwords(words.word_table(_t(spark, folder, "documents")), _t(spark, folder, "common_words"))


@query(_unnested("string_split(text, ';')", "sent"))
def sentences_by_function(spark: SparkSession, folder: str) -> DataFrame:
    return _listed(_t(spark, folder, "documents"), SentSpec(lambda text: text.split(";")).column(F.col("text")), "sent")


@query(_unnested(f"list_filter(string_split(text, ' '), lambda w: not contains({_q(PUNCTUATIONS)}, w))", "word"))
def words_by_function(spark: SparkSession, folder: str) -> DataFrame:
    return words.word_table(_t(spark, folder, "documents"), WordSpec(lambda text: text.split(" ")))


@query(f"with {_PLAIN} select word, count(*) as cnt from tok group by word order by cnt desc, word limit 100")
def top_words_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return words.top_words(words.word_table(_t(spark, folder, "documents")), 100, None)


_LOW = f"tok as (select doc_id, (unnest(range(len(l))))::int as pos, unnest(l) as word from (select doc_id, {_LOWER} as l from documents))"


def _lower_table(spark: SparkSession, folder: str) -> DataFrame:
    return words.word_table(_t(spark, folder, "documents"), diversity.LOWER)


_FREQUENCY = f"""with {_LOW}, f as (select doc_id, word, count(*) as f from tok group by all), g as (select *, sum(f) over (partition by doc_id)::bigint as n from f),
p as (select *, case when 42 > n then 0 else (1 - list_reduce(list_transform(range(42), lambda i: greatest(0, n - f - i) / nullif(n - i, 0)::double), lambda x, y: x * y)) / 42 end as h from g),
a as (select doc_id, max(n) as n, count(*) as v, sum(h) as h, sum(f * (f - 1))::bigint as pairs, count(*) filter (f = 1) as hx from p group by doc_id), b as (select *, log10(n) as ln, log10(v) as lv from a)
select doc_id, round(v / n::double, 9) as ttr, round(v / sqrt(n), 9) as rttr, round(v / sqrt(2 * n), 9) as cttr, round(coalesce(lv / nullif(ln, 0), 0), 9) as httr,
 round(case when n <= 1 or v <= 1 then 0 when ln = 1 then 0 else log10(lv) / log10(ln) end, 9) as sttr, round(coalesce((ln - lv) / nullif(ln * ln, 0), 0), 9) as mttr,
 round(case when n = v then 0 else ln * ln / (ln - lv) end, 9) as dttr, round(case when n < 50 then -1 else h end, 9) as hdd, round(coalesce(n * (n - 1) / nullif(pairs, 0)::double, 0), 9) as simpson_index,
 round(case when hx = v then 0 else 100 * ln / (1 - hx / v::double) end, 9) as hapax_index from b"""
_MATTR = f"""with {_LOW}, p as (select doc_id, pos, coalesce(lag(pos) over (partition by doc_id, word order by pos), -1) as prev, count(*) over (partition by doc_id) as n from tok)
select doc_id, round(case when max(n) < 51 then count(*) filter (prev < 0) / max(n)::double else sum(greatest(0, least(pos, n - 50) - greatest(prev + 1, pos - 49, 0) + 1)) / (50.0::double * (max(n) - 49)) end, 9) as mattr from p group by doc_id"""
_MSTTR = f"""with {_LOW}, s as (select doc_id, word, pos, count(*) over (partition by doc_id) as n from tok), q as (select distinct doc_id, n, case when n < 51 then 0 else pos // 50 end as seg, word from s where n < 51 or pos // 50 < n // 50)
select doc_id, round(case when max(n) < 51 then count(*) / max(n)::double else count(*) / ((max(n) // 50) * 50.0::double) end, 9) as msttr from q group by doc_id"""
_BY_FREQUENCY = ("ttr", "rttr", "cttr", "httr", "sttr", "mttr", "dttr", "hdd", "simpson_index", "hapax_index")


def _measured(spark: SparkSession, folder: str, *names: str) -> DataFrame:
    """Measures of the texts that have words, row by row."""
    lists = _t(spark, folder, "documents").select("doc_id", diversity.LOWER.column(F.col("text")).alias("words")).where("size(words) > 0")
    return _rounded(diversity.diversity_stats(lists, words_col="words", only=names))


@query(_FREQUENCY)
def frequency_measures(spark: SparkSession, folder: str) -> DataFrame:
    return _measured(spark, folder, *_BY_FREQUENCY)


@query(_FREQUENCY)
def frequency_measures_of_table(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(diversity.frequency_measures(_lower_table(spark, folder)))


@query(_MATTR)
def mattr(spark: SparkSession, folder: str) -> DataFrame:
    return _measured(spark, folder, "mattr")


@query(_MATTR)
def mattr_of_table(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(diversity.mattr(_lower_table(spark, folder)))


@query(_MSTTR)
def msttr(spark: SparkSession, folder: str) -> DataFrame:
    return _measured(spark, folder, "msttr")


@query(_MSTTR)
def msttr_of_table(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(diversity.msttr(_lower_table(spark, folder)))


# positions of the occurrence before, read forwards (f) and backwards (b)
_BEFORE = f"""{_LOW}, p as (select doc_id, pos, coalesce(lag(pos) over w, -1) as f, coalesce(count(*) over (partition by doc_id) - 1 - lead(pos) over w, -1) as b, count(*) over (partition by doc_id) as n
 from tok window w as (partition by doc_id, word order by pos)),
l as (select doc_id, max(n) as n, list(f order by pos) as f, list(b order by pos desc) as b from p group by doc_id)"""


def _factors(before: str) -> str:
    """SQL of the number of factors of a list: a fold with the start (s), types (t) and factors (f) so far."""
    step = f"list_transform({before}, lambda p, i: {{'k': i::bigint, 's': 0::bigint, 't': 0::bigint, 'f': 0::double, 'p': p::bigint}})"
    types, size = "(a.t + (x.p < a.s)::bigint)", "(x.k - a.s)"
    full = f"({size} >= 10 and {types} / {size}::double < 0.72)"
    return (
        f"list_reduce(list_prepend({{'k': 0::bigint, 's': 0::bigint, 't': 0::bigint, 'f': 0::double, 'p': 0::bigint}}, {step}), lambda a, x: {{'k': x.k, 's': case when x.k < n and {full} then x.k else a.s end, "
        f"'t': case when x.k < n and {full} then 0 else {types} end, 'f': case when x.k = n then a.f + (1 - {types} / {size}::double) / (1 - 0.72::double) when {full} then a.f + 1 else a.f end, 'p': x.p}}).f"
    )


def _moving(before: str) -> str:
    """SQL of the mean size of the first factor from each start."""
    grown = f"select a.doc_id, a.pos as s, b.pos - a.pos + 1 as z, sum((b.prev < a.pos)::int) over (partition by a.doc_id, a.pos order by b.pos) as t from {before} a join {before} b on a.doc_id = b.doc_id and b.pos >= a.pos"
    return f"select doc_id, sum(z) / count(*)::double as m from (select doc_id, s, min(z) as z from ({grown}) where z >= 10 and t / z::double < 0.72 group by 1, 2) group by 1"


_MTLD = f"m as (select doc_id, (coalesce(n / nullif({_factors('f')}, 0), 0) + coalesce(n / nullif({_factors('b')}, 0), 0)) / 2 as mtld from l)"
_MAMTLD = f"""fw as (select doc_id, pos, f as prev from p), bw as (select doc_id, n - 1 - pos as pos, b as prev from p), xs as ({_moving('fw')}), ys as ({_moving('bw')}),
mm as (select l.doc_id, (coalesce(xs.m, 1) + coalesce(ys.m, 1)) / 2 as mamtld from l left join xs using (doc_id) left join ys using (doc_id))"""


def _of_all(values: dict[str, tuple[str, float]], joins: str) -> str:
    """A select list over all documents: null for a null text, a value of its own for one without words."""
    return "select d.doc_id, " + ", ".join(f"case when d.text is not null then round(coalesce({x}, {none}), 9) end as {name}" for name, (x, none) in values.items()) + f" from documents d {joins}"


@query(f"with {_BEFORE}, {_MTLD} " + _of_all({"mtld": ("m.mtld", 0)}, "left join m using (doc_id)"))
def mtld(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(diversity.one_measure(_t(spark, folder, "documents"), "mtld"))


@query(f"with {_BEFORE}, {_MAMTLD} " + _of_all({"mamtld": ("mm.mamtld", 1)}, "left join mm using (doc_id)"))
def mamtld(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(diversity.one_measure(_t(spark, folder, "documents"), "mamtld"))


_ALL = {**{x: (f"fq.{x}", -1 if x == "hdd" else 0) for x in _BY_FREQUENCY}, "mattr": ("ma.mattr", 0), "msttr": ("ms.msttr", 0), "mtld": ("m.mtld", 0), "mamtld": ("mm.mamtld", 1)}


@query(f"with {_BEFORE}, {_MTLD}, {_MAMTLD}, fq as ({_FREQUENCY}), ma as ({_MATTR}), ms as ({_MSTTR}) " + _of_all(_ALL, " ".join(f"left join {t} using (doc_id)" for t in ("m", "mm", "fq", "ma", "ms"))))
def diversity_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(diversity.diversity_stats(_t(spark, folder, "documents")))


@query("select doc_id, len(words) as n, round(case when len(words) = 0 then 0 else len(list_distinct(words)) / len(words)::double end, 9) as ttr from token_lists where words is not null")
def diversity_listed(spark: SparkSession, folder: str) -> DataFrame:
    lists = _t(spark, folder, "token_lists").where("words is not null")
    out = diversity.diversity_stats(lists, words_col="words").select("doc_id", "ttr")
    return _rounded(lists.select("doc_id", F.size("words").cast("bigint").alias("n")).join(out, "doc_id").select("doc_id", "n", "ttr"))


@query(f"with {_LOW}, c as (select word, count(*) as cnt from tok group by word) select row_number() over (order by cnt desc, word) as rank, word, cnt from c")
def zipf_ranks(spark: SparkSession, folder: str) -> DataFrame:
    return views.zipf_ranks(_lower_table(spark, folder))


@query(f"with {_LOW}, c as (select word, count(*) as cnt from tok group by word) select row_number() over (order by cnt desc, word) as rank, word, cnt from c qualify rank <= 50")
def zipf_top(spark: SparkSession, folder: str) -> DataFrame:
    return views.zipf_ranks(_lower_table(spark, folder), 50)


@query("select i::int as rank, round(1000.0::double * pow(i, -1.5), 9) as frequency from range(1, 101) t(i)")
def zipf_theory(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(views.zipf_theory(spark, 1000.0, 100, 1.5))


@query("select i::int as label, floor(pow(10, -0.5 + i * (log10(999.5) + 0.5) / 9) + 1e-9)::int as point from range(10) t(i)")
def zipf_labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(views.zipf_labels(1000.5, 10))), "label int, point int")


_PRINT = """s as (select doc_id, words, len(words) as n, case when len(words) >= 10 then len(words) - 10 + 1 else 0 end as k from token_lists where words is not null),
g as (select doc_id, list_concat(list_transform(range(k), lambda i: words[i + 1 : i + 10]), [words[k + 1 :]]) as segs from s),
e as (select doc_id, unnest(range(len(segs)))::int as seg_pos, unnest(segs) as seg from g),
m as (select doc_id, seg_pos, case when len(seg) = 0 then 0 else len(list_distinct(seg)) / len(seg)::double end as metric from e)"""


@query(f"with {_PRINT} select doc_id, seg_pos, round(metric, 9) as metric from m")
def fingerprint_ttr(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(views.fingerprint(_t(spark, folder, "token_lists")))


@query(f"with {_PRINT.replace('m as (select doc_id, seg_pos, case when len(seg) = 0 then 0 else len(list_distinct(seg)) / len(seg)::double end', 'm as (select doc_id, seg_pos, case when len(seg) = 0 then 0 else list_sum(list_transform(seg, lambda w: length(w))) / len(seg)::double end')} select doc_id, seg_pos, round(metric, 9) as metric from m")
def fingerprint_by_function(spark: SparkSession, folder: str) -> DataFrame:
    """Mean word length of each segment, by a Python function."""
    return _rounded(views.fingerprint(_t(spark, folder, "token_lists"), metric=lambda seg: sum(map(len, seg)) / len(seg) if seg else 0.0, python_metric=True))


@query(f"""with {_PRINT}, c as (select *, greatest(ceil(count(*) over (partition by doc_id) / 8.0), 1)::int as cols from m)
select doc_id, seg_pos, round(metric, 9) as metric, (seg_pos // cols)::int as grid_row, (seg_pos % cols)::int as grid_col, round(metric / (select max(metric) from m), 9) as shade from c""")
def fingerprint_grid(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(views.fingerprint_grid(views.fingerprint(_t(spark, folder, "token_lists"))))


KEYWORD = "брат"
_GRAMS = f"""t as (select row_number() over () as r, words from token_lists where words is not null), n as (select unnest([2, 3, 4, 5]) as n),
g as (select words[i + 1 : i + n] as ngram, n from (select words, n, unnest(range(greatest(len(words) - n + 1, 0))) as i from t, n)),
c as (select ngram, n::int as n, ngram[1] = {_q(KEYWORD)} as forward, count(*) as freq from g where ngram[1] = {_q(KEYWORD)} or ngram[-1] = {_q(KEYWORD)} group by all)"""
_TOP = _GRAMS + """, top as (select *, row_number() over (order by freq desc, ngram, forward) as o from (select * from c qualify row_number() over (partition by forward, n order by freq desc, ngram) <= 8)),
br as (select freq, o, 'forward' as direction, ngram[2:] as b from top where ngram[1] = '{k}' union all select freq, o, 'backward', list_reverse(ngram[:-2]) from top where ngram[-1] = '{k}'),
nd as (select direction, freq, o, len(b) as size, b[1:d] as p from (select *, unnest(range(1, len(b) + 1)) as d from br)),
tree as (select direction, len(p)::int as depth, array_to_string(p, ' ') as path, array_to_string(p[:-2], ' ') as parent_path, p[-1] as word, coalesce(max(freq) filter (size = len(p)), arg_min(freq, o)) as freq from nd group by direction, p)""".replace("{k}", KEYWORD)


def _grams(spark: SparkSession, folder: str) -> DataFrame:
    return views.keyword_ngrams(_t(spark, folder, "token_lists"), KEYWORD)


@query(f"with {_GRAMS} select array_to_string(ngram, ' ') as ngram, n, forward, freq from c")
def wordtree_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    return _grams(spark, folder).withColumn("ngram", F.array_join("ngram", " "))


@query(f"with {_TOP} select * from tree")
def wordtree_edges(spark: SparkSession, folder: str) -> DataFrame:
    return views.tree_edges(views.top_ngrams(_grams(spark, folder)), KEYWORD)


@query(f"with {_TOP} select *, floor(round(pow(freq / (select max(freq) from tree where depth = 1)::double, 1 / 3.0::double), 9) * 18 + 12)::int as font_size from tree")
def wordtree_fonts(spark: SparkSession, folder: str) -> DataFrame:
    edges = views.tree_edges(views.top_ngrams(_grams(spark, folder)), KEYWORD)
    return views.font_sizes(edges, interpolate=lambda s: F.round(F.cbrt(s), 9))


_LISTED = "tok as (select doc_id, (unnest(range(len(words))))::int as pos, unnest(words) as word from token_lists)"
_NAMED = {c: "gram_case" if c == "case" else c for c in morphology.CATEGORIES}


def _morph_sql(source: str, where: str = "", chosen: tuple[str, ...] = morphology.CATEGORIES) -> str:
    parts = " union all ".join(f"select doc_id, pos, '{c}' as category, {_NAMED[c]} as value from tag" for c in chosen)
    return f"with {_FIRST}, {source}, tag as (select doc_id, tok.pos, word, {', '.join('first.' + _NAMED[c] + (' as pos_tag' if c == 'pos' else '') for c in morphology.CATEGORIES)} from tok left join first on key = lower(word)), l as ({parts.replace(', pos as value', ', pos_tag as value')}) select doc_id, category, value, count(*) as cnt, min(pos) as first_pos from l {where} group by doc_id, category, value"


@query(_morph_sql(_PLAIN))
def morph_stats(spark: SparkSession, folder: str) -> DataFrame:
    return morphology.morph_stats(morphology.analyse(_t(spark, folder, "documents"), _t(spark, folder, "lexicon")))


@query(_morph_sql(_LISTED, "where value is not null", ("pos", "tense")))
def morph_stats_listed(spark: SparkSession, folder: str) -> DataFrame:
    tags = morphology.analyse(_t(spark, folder, "token_lists"), _t(spark, folder, "lexicon"), words_col="words")
    return morphology.morph_stats(tags, "pos", "tense", filter_none=True)


@query("select doc_id, category, value, cnt, first_pos, row_number() over (partition by doc_id, category order by cnt desc, first_pos)::int as rank from (" + _morph_sql(_LISTED, "", ("pos", "number")) + ")")
def morph_ordered(spark: SparkSession, folder: str) -> DataFrame:
    tags = morphology.analyse(_t(spark, folder, "token_lists"), _t(spark, folder, "lexicon"), words_col="words")
    return morphology.ordered_stats(morphology.morph_stats(tags, "pos", "number"))


@query(f"with {_FIRST}, {_LISTED} select doc_id, tok.pos, word, first.pos as part, gram_case as case_, number from tok left join first on key = lower(word)")
def morph_explain(spark: SparkSession, folder: str) -> DataFrame:
    tags = morphology.analyse(_t(spark, folder, "token_lists"), _t(spark, folder, "lexicon"), words_col="words")
    told = morphology.explain(tags, "pos", "case", "number")
    return told.select("doc_id", "pos", "word", F.col("tags")["pos"].alias("part"), F.col("tags")["case"].alias("case_"), F.col("tags")["number"].alias("number"))


_STRIP = "regexp_replace(content, '^[\\s\\x{85}\\x{a0}\\x{2028}\\x{2029}\\p{Z}\\x{b}\\x{1c}-\\x{1f}]+|[\\s\\x{85}\\x{a0}\\p{Z}\\x{b}\\x{1c}-\\x{1f}]+$', '', 'g')"


def _parsed(layout: corpus.Layout) -> str:
    """SQL of a layout's records from raw_files."""
    number = lambda k: f"case when regexp_full_match(trim(v[{k}]), '[+-]?[0-9]+') then try_cast(trim(v[{k}]) as int) end"
    of = {"int": number, "boolean": lambda k: f"({number(k)}) <> 0", "string": lambda k: f"v[{k}]"}
    typed = ", ".join(f"{of[t](k)} as {n}" for k, (n, t) in enumerate(layout.fields, 1))
    good = " and ".join(f"{n} is not null" for n in layout.names)
    return f"""named as (select path, string_split({_STRIP}, chr(10) || chr(10)) as parts from raw_files where regexp_matches(list_last(string_split(path, '/')), '^[0-9]')),
h as (select path, parts, list_transform(string_split(parts[1], chr(10)), lambda x: case when len(string_split(x, ':')) > 1 then substring(string_split(x, ':')[2], 2) end) as v from named),
t as (select path, parts, v, {typed} from h),
p as (select path as file, coalesce(len(parts) = 2 and len(v) >= 7 and {good}, false) as ok, {", ".join(layout.names)}, parts[2] as text from t)"""


_PARSED = _parsed(corpus.PRIMER)
# works records written as files again
_WORKS_HEADS = (("Том", "volume"), ("Год", "year"), ("Тип", "type"), ("Перевод", "is_translation"), ("Источник", "source"), ("Название", "subject"), ("Тема", "topic"))
_WORKS_RAW = "raw_files as (select file as path, " + " || chr(10) || ".join(f"'{h}: ' || coalesce({c + '::int' if c == 'is_translation' else c}::varchar, '')" for h, c in _WORKS_HEADS) + " || chr(10) || chr(10) || coalesce(text, '') as content from works_records)"


@query(f"with {_PARSED} select file, grade, book, year, category, type, subject, author, text from p where ok")
def corpus_parse(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.parse_files(_t(spark, folder, "raw_files"), corpus.PRIMER, malformed="drop")


@query(f"with {_PARSED} select file from p where not ok")
def corpus_malformed(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.parse_files(_t(spark, folder, "raw_files"), corpus.PRIMER, malformed="keep").where("not ok").select("file")


@query(f"with {_WORKS_RAW}, {_parsed(corpus.WORKS)} select file, volume, year, type, is_translation, source, subject, topic, text from p where ok")
def corpus_parse_works(spark: SparkSession, folder: str) -> DataFrame:
    heads = [F.concat(F.lit(f"{h}: "), F.coalesce(F.col(c).cast("int").cast("string") if c == "is_translation" else F.col(c).cast("string"), F.lit(""))) for h, c in _WORKS_HEADS]
    raw = _t(spark, folder, "works_records").select(F.col("file").alias("path"), F.concat_ws("\n", *heads, F.lit(""), F.coalesce("text", F.lit(""))).alias("content"))
    return corpus.parse_files(raw, corpus.WORKS, malformed="drop").select("file", "volume", "year", "type", "is_translation", "source", "subject", "topic", "text")


@query("select rec_id, category, length(text) as n from primer_records where category = 'Зима' and length(text) <= 500")
def corpus_filter_category(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.filter_records(_t(spark, folder, "primer_records"), category="Зима", max_len=500).select("rec_id", "category", F.length("text").cast("bigint").alias("n"))


@query("select rec_id, grade, year, type, category from primer_records where grade = 3 and type = 'Рассказ' and length(text) >= 100 and length(text) <= 600")
def corpus_filter_primer(spark: SparkSession, folder: str) -> DataFrame:
    got = corpus.filter_records(_t(spark, folder, "primer_records"), grade=3, text_type="Рассказ", min_len=100, max_len=600)
    return got.select("rec_id", "grade", "year", "type", "category")


@query("select rec_id, book, author from primer_records where regexp_matches(book, '(?i)^.*родник') and regexp_matches(author, '(?i)^.*шур')")
def corpus_filter_regex(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.filter_records(_t(spark, folder, "primer_records"), book="родник", author="шур").select("rec_id", "book", "author")


@query("select file, loaded_at::varchar is not null as loaded, volume, year, is_translation, topic from works_records where volume = 5 and is_translation = false and regexp_matches(source, '(?i)^.*газета')")
def corpus_filter_works(spark: SparkSession, folder: str) -> DataFrame:
    got = corpus.filter_records(_t(spark, folder, "works_records"), volume=5, is_translation=False, source="газета")
    return got.select("file", F.col("loaded_at").isNotNull().alias("loaded"), "volume", "year", "is_translation", "topic")


@query("select text from works_records where type = 'Письмо' and length(text) >= 200")
def corpus_texts(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.filter_records(_t(spark, folder, "works_records"), text_type="Письмо", min_len=200).select("text")


@query("select rec_id, file from primer_records where year = 1950 order by file, rec_id limit 25")
def corpus_limit(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.filter_records(_t(spark, folder, "primer_records").select("rec_id", "file", "year", "text", "grade"), year=1950, limit=25, order=("file", "rec_id")).select("rec_id", "file")


@query("select count(*) as texts, sum(n_words)::bigint as n_words, sum(n_sents)::bigint as n_sents from (" + _counts("documents", "doc_id") + ")")
def stream_basic_stats(spark: SparkSession, folder: str) -> DataFrame:
    """The row-local statistics over a stream of the documents, summed when it has ended."""
    from .streaming.live import landed, live_stats, read_stream

    docs = read_stream(spark, f"{folder}/documents.parquet*", _t(spark, folder, "documents").schema)
    return landed(live_stats(docs)).agg(F.count("*").alias("texts"), F.sum("n_words").alias("n_words"), F.sum("n_sents").alias("n_sents"))


@query(f"select strftime(added_at, '%Y-%m-%d') as day, count(*) as texts, sum(coalesce(len({_WORDS}), 0))::bigint as words from documents where added_at is not null group by 1")
def stream_words_by_day(spark: SparkSession, folder: str) -> DataFrame:
    from .streaming.live import landed, read_stream, words_by_window

    docs = read_stream(spark, f"{folder}/documents.parquet*", _t(spark, folder, "documents").schema)
    daily = landed(words_by_window(docs, width="1 day"), ("window_start", "window_end"))
    return daily.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "texts", "words")


@query(_counts("documents", "doc_id"))
def stage_basic(spark: SparkSession, folder: str) -> DataFrame:
    from .plans.pipeline import BasicStage

    return BasicStage().transform(_t(spark, folder, "documents")).select("doc_id", *(F.col(f"basic.{c}").alias(c) for c in S.COUNTS))


@query(_counts("documents", "doc_id", _INDICES))
def stage_readability(spark: SparkSession, folder: str) -> DataFrame:
    from .plans.pipeline import ReadabilityStage

    return _rounded(ReadabilityStage("r").transform(_t(spark, folder, "documents")).select("doc_id", *(F.col(f"r.{c}").alias(c) for c in S.READABILITY)))


@query(f"select doc_id, round(case when len(w) = 0 then 0 else len(list_distinct(w)) / len(w)::double end, 9) as ttr, round(case when len(w) = 0 then 0 else len(list_distinct(w)) / sqrt(len(w)) end, 9) as rttr from (select doc_id, list_filter({_WORDS}, lambda x: length(x) >= 4) as w from documents)")
def stage_diversity(spark: SparkSession, folder: str) -> DataFrame:
    """With an extractor of its own: words of four letters and more, in their case."""
    from .plans.pipeline import DiversityStage

    out = DiversityStage(words=WordSpec(min_len=4)).transform(_t(spark, folder, "documents"))
    return _rounded(out.select("doc_id", F.col("diversity.ttr").alias("ttr"), F.col("diversity.rttr").alias("rttr")))


@query("select doc_id, category, coalesce(value, 'None') as value, cnt from (" + _morph_sql(_PLAIN) + ")")
def stage_morph(spark: SparkSession, folder: str) -> DataFrame:
    from .plans.pipeline import MorphStage

    out = MorphStage(_t(spark, folder, "lexicon")).transform(_t(spark, folder, "documents"))
    return out.select("doc_id", F.explode("morph").alias("category", "m")).select("doc_id", "category", F.explode("m").alias("value", "cnt"))


@query(_counts("documents", "doc_id", _INDICES))
def sql_functions(spark: SparkSession, folder: str) -> DataFrame:
    """Readability by the registered SQL functions."""
    from .plans.pipeline import register

    register(spark, "t_")
    docs = _t(spark, folder, "documents").selectExpr("doc_id", "text", "t_words(text) as w", "t_sentences(text) as s")
    cut = docs.selectExpr("doc_id", f"size(w) as n", "size(s) as m", "t_count_letters(text) as letters", "size(filter(w, x -> length(x) >= 6)) as long", "t_count_syllables(array_join(w, ' ')) as y",
                          f"size(filter(w, x -> length(x) - length(translate(x, '{RU_VOWELS}', '')) >= 4)) as hard").selectExpr("*", "n > 0 as told")
    told = {
        "flesch_kincaid_grade": "t_calc_flesch_kincaid_grade(y, n, m)", "flesch_reading_easy": "t_calc_flesch_reading_easy(y, n, m)", "coleman_liau_index": "t_calc_coleman_liau_index(letters, n, m)",
        "smog_index": "t_calc_smog_index(hard, m)", "automated_readability_index": "t_calc_automated_readability_index(letters, n, m)", "lix": "t_calc_lix(long, n, m)",
    }
    return _rounded(cut.selectExpr("doc_id", *(f"if(told, {e}, null) as {k}" for k, e in told.items())))


@query("select doc_id, round(ttr, 9) as ttr, round(hdd, 9) as hdd, round(mattr, 9) as mattr from (" + _of_all({k: _ALL[k] for k in ("ttr", "hdd", "mattr")}, "left join fq using (doc_id) left join ma using (doc_id)").join((f"with fq as ({_FREQUENCY}), ma as ({_MATTR}) ", ")")))
def sql_diversity_functions(spark: SparkSession, folder: str) -> DataFrame:
    from .plans.pipeline import register

    register(spark, "t_")
    docs = _t(spark, folder, "documents").selectExpr("doc_id", "transform(t_words(text), w -> lower(w)) as w")
    return _rounded(docs.selectExpr("doc_id", "t_calc_ttr(w) as ttr", "t_calc_hdd(w, 42) as hdd", "t_calc_mattr(w, 50) as mattr"))


#: What bench.py times.
HEADLINES = ("basic_stats", "readability", "hist_word_length", "sentences_default", "words_default", "ngrams_1_3", "top_words_per_doc", "frequency_measures", "mattr", "msttr", "diversity_stats", "zipf_ranks", "morph_stats", "words_lemmas", "corpus_parse")
__all__ = ["HEADLINES", "MEASURES", "QUERIES", "SQL"]
