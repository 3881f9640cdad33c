import re

import pytest
from pyspark.sql import functions as F

from slovomer.functions.tokens import SentSpec, WordSpec
from slovomer.operators import words

T4 = "Не имей 100 рублей, а имей 100 друзей"


def run(spark, spec, text):
    return spark.createDataFrame([(text,)], "text string").select(spec.column(F.col("text")).alias("x")).first().x


def test_sentences(spark):
    assert run(spark, SentSpec(), "Дом стоит. Лес шумит! «Да».") == ["Дом стоит.", "Лес шумит!", "«Да»."]
    assert run(spark, SentSpec(), "  ") == [] and run(spark, SentSpec(), None) is None
    assert run(spark, SentSpec(re.compile("[;.]")), "а;б.в.") == ["а", "б", "в", ""]
    assert run(spark, SentSpec(re.compile(", ")), T4) == ["Не имей 100 рублей", "а имей 100 друзей"]
    assert run(spark, SentSpec(lambda t: t.split("|"), min_len=2), "аа|б|вв") == ["аа", "вв"]
    assert run(spark, SentSpec(min_len=3, max_len=20), "Да. Очень длинное предложение здесь. Нет.") == ["Да.", "Нет."]


def test_words(spark):
    assert run(spark, WordSpec(), 'Дом, "..." какой-либо 33.5 + 99') == ["Дом", "какой-либо", "33.5", "99"]
    assert run(spark, WordSpec(filter_nums=True), "33.5 99 ½ дом") == ["33.5", "дом"]
    assert run(spark, WordSpec(re.compile(r"[^\w]+")), "мама мыла, раму.") == ["мама", "мыла", "раму"]
    assert run(spark, WordSpec(str.split, filter_punct=False), "а , б") == ["а", ",", "б"]
    assert run(spark, WordSpec(stopwords=("и", "не")), "Не и не дом") == ["Не", "дом"]
    assert run(spark, WordSpec(lowercase=True, min_len=2, max_len=3), "А Дом стоит") == ["дом"]
    assert run(spark, WordSpec(ngram_range=(1, 3)), "а б в") == ["а", "б", "в", "а_б", "б_в", "а_б_в"]
    assert run(spark, WordSpec(ngram_range=(3, 3)), "а б") == []
    got = run(spark, WordSpec(use_lexemes=True, lemmas={"имей": "иметь", "рублей": "рубль", "друзей": "друг"}, stopwords=("не", "а"), filter_nums=True, ngram_range=(1, 2)), T4)
    assert got == ["иметь", "рубль", "иметь", "друг", "иметь_рубль", "рубль_иметь", "иметь_друг"]


def test_bad_arguments(spark):
    for bad in (lambda: SentSpec(min_len=5, max_len=2), lambda: WordSpec(min_len=5, max_len=2), lambda: WordSpec(ngram_range=(2, 1))):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        WordSpec("[a-z]")
    with pytest.raises(Exception, match="tokenizer failed"):
        run(spark, WordSpec(lambda t: 1 / 0), "а")


def test_top_words_and_lemmas(spark):
    docs = spark.createDataFrame([(1, "б а б в а г"), (2, None), (3, "")], "doc_id long, text string")
    table = words.word_table(docs)
    assert [(r.word, r.cnt) for r in words.top_words(table, 2).orderBy("rank").collect()] == [("б", 2), ("а", 2)]
    assert [r.word for r in words.top_words(table, 1, None).collect()] == ["а"]
    with pytest.raises(ValueError):
        words.top_words(table, 0)
    stop = spark.createDataFrame([("б",), ("б",)], "word string")
    assert words.without_stopwords(table, stop).count() == 4
    lexicon = spark.createDataFrame([("имей", "иметь", "VERB"), ("имей", "имя", "NOUN")], "word string, normal_form string, pos string")
    got = words.extract_words(spark.createDataFrame([(1, T4)], "doc_id long, text string"), WordSpec(use_lexemes=True, filter_nums=True), lexicon).first().words
    assert got == ["не", "иметь", "рублей", "а", "иметь", "друзей"]


def test_word_table_of_a_function(spark):
    docs = spark.createDataFrame([(1, "а б"), (2, None)], "doc_id long, text string")
    assert [(r.pos, r.word) for r in words.word_table(docs, WordSpec(str.split)).orderBy("pos").collect()] == [(0, "а"), (1, "б")]
