import pytest
from pyspark.sql import functions as F

from slovomer.functions import stats as S
from slovomer.operators import stats
from slovomer.plans import pipeline, render
from slovomer.queries import GOLDEN

T2 = {"n_words": 15, "n_unique_words": 11, "n_syllables": 25, "n_letters": 65, "n_chars": 85, "n_spaces": 14, "n_punctuations": 6, "n_sents": 1}
T3 = {"n_sents": 1, "n_words": 9, "n_unique_words": 8, "n_long_words": 3, "n_complex_words": 2, "n_simple_words": 7, "n_monosyllable_words": 5, "n_polysyllable_words": 4, "n_chars": 55, "n_letters": 45, "n_spaces": 8, "n_syllables": 18, "n_punctuations": 2}
READ = {"flesch_kincaid_grade": 2.926666666666666, "flesch_reading_easy": 87.16833333333334, "smog_index": 0.05, "automated_readability_index": 0.2941666666666656, "lix": 35.0, "coleman_liau_index": 1.17}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([*GOLDEN.items(), (3, None), (4, ""), (5, "+ _")], "doc_id long, text string")


def test_goldens(docs):
    rows = {r.doc_id: r.asDict() for r in stats.basic_stats(docs, normalize=True).collect()}
    assert {k: rows[1][k] for k in T2} == T2
    assert {k: rows[2][k] for k in T3} == T3
    assert rows[2]["p_long_words"] == pytest.approx(3 / 9) and rows[2]["p_letters"] == pytest.approx(45 / 55)
    got = {r.doc_id: r.asDict() for r in stats.readability_stats(docs).collect()}
    assert {k: got[1][k] for k in READ} == pytest.approx(READ, abs=1e-9)
    assert got[4]["lix"] is None


def test_histograms(docs):
    got = {r.doc_id: r.histogram for r in stats.histogram_map(stats.histogram(docs)).collect()}
    assert got[2] == {1: 1, 3: 2, 4: 3, 6: 1, 10: 2}
    got = {r.doc_id: r.histogram for r in stats.histogram_map(stats.histogram(docs, "syllables")).collect()}
    assert got[2] == {1: 5, 2: 1, 3: 1, 4: 2}
    with pytest.raises(ValueError):
        stats.histogram(docs, "x")


def test_empty_texts(docs, spark):
    assert [r.doc_id for r in stats.basic_stats(docs).where("n_words is null").orderBy("doc_id").collect()] == [3, 4, 5]
    assert stats.basic_stats(docs, on_empty="drop").count() == 2
    with pytest.raises(Exception, match="no words"):
        stats.basic_stats(docs, on_empty="error").collect()
    with pytest.raises(ValueError):
        stats.basic_stats(docs, on_empty="x")
    with pytest.raises(TypeError):
        stats.basic_stats(spark.createDataFrame([(1, 666)], "doc_id long, text int"))


def test_given_words(spark):
    df = spark.createDataFrame([(1, "а , Б", ["а", ",", "Б"], ["а , Б"])], "doc_id long, text string, w array<string>, s array<string>")
    r = stats.basic_stats(df, words_col="w", sents_col="s").first()
    assert (r.n_words, r.n_sents, r.n_punctuations) == (3, 1, 1)


def test_safe_divide(spark):
    r = spark.range(1).select(S.safe_divide(F.lit(1), F.lit(5)).alias("a"), S.safe_divide(F.lit(1), F.lit(0)).alias("b"), S.safe_divide(F.lit(1), F.lit(None).cast("int"), -1).alias("c")).first()
    assert tuple(r) == (0.2, 0.0, -1.0)


def test_tables_and_bands(docs):
    row = stats.basic_stats(docs).where("doc_id = 1").first().asDict()
    assert render.basic_table(row).count("|") == 14
    row = stats.readability_stats(docs).where("doc_id = 1").first().asDict()
    assert render.readability_table(row).count("|") == 7 and "2.93" in render.readability_table(row)
    assert stats.readability_stats(docs).where("doc_id = 1").select(stats.band("lix")).first()[0] == 1


def test_stages_and_functions(docs, spark):
    from pyspark.ml import Pipeline

    out = Pipeline(stages=[pipeline.BasicStage(), pipeline.ReadabilityStage("read"), pipeline.DiversityStage()]).fit(docs).transform(docs)
    assert out.columns == ["doc_id", "text", "basic", "read", "diversity"]
    r = out.where("doc_id = 1").first()
    assert r.basic.n_words == 15 and r.read.lix == pytest.approx(35.0) and r.diversity.ttr == pytest.approx(11 / 15)
    pipeline.register(spark, "t_")
    assert spark.sql("select t_syllables('молоко'), size(t_words('а б, в')), t_type_token_ratio(array('а', 'а'))").first()[:3] == (3, 3, 0.5)


def test_saved_stages(docs, tmp_path):
    import re

    from slovomer.functions.tokens import SentSpec, WordSpec

    spec = WordSpec(re.compile(r"[ ,]+", re.IGNORECASE), lowercase=True, min_len=3, stopwords=("нет",))
    for stage in (pipeline.BasicStage("b", words=spec, sents=SentSpec(min_len=2)), pipeline.DiversityStage(words=spec), pipeline.DiversityStage()):
        stage.write().overwrite().save(str(tmp_path / "stage"))
        again = type(stage).load(str(tmp_path / "stage"))
        assert sorted(map(repr, again.transform(docs).collect())) == sorted(map(repr, stage.transform(docs).collect()))


def test_diversity_stage_uses_its_words(docs):
    from slovomer.functions.tokens import WordSpec

    got = pipeline.DiversityStage(words=WordSpec(min_len=99)).transform(docs).where("doc_id = 1").first()
    assert got.diversity.ttr == 0 and pipeline.DiversityStage().transform(docs).where("doc_id = 1").first().diversity.ttr > 0


def test_sql_functions(docs, spark):
    names = pipeline.register(spark, "s_")
    assert "s_calc_mtld" in names and "s_calc_smog_index" in names
    r = spark.sql("select s_ngrams(array('а', 'б', 'в'), 2), s_ngrams(array('а'), 2), s_sentences('Да. Нет!'), s_calc_lix(1, 4, 2), s_calc_smog_index(4, 2, 1, 2, 0), s_calc_ttr(array('а', 'а')), s_calc_msttr(array('а', 'б', 'а', 'б'), 2), s_calc_ttr(null)").first()
    assert tuple(r) == (["а_б", "б_в"], [], ["Да.", "Нет!"], 27.0, 2.0, 0.5, 1.0, None)
