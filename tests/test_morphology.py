import pytest

from slovomer.operators import morphology as M
from slovomer.plans import pipeline, render

COLS = ("word", "normal_form", "pos", "animacy", "aspect", "gram_case", "gender", "involvement", "mood", "number", "person", "tense", "transitivity", "voice")
ROWS = {  # word: pos, aspect, involvement, mood, number, person, tense, transitivity
    "постарайтесь": ("VERB", "perf", "excl", "impr", "plur", None, None, "intr"), "получить": ("INFN", "perf", None, None, None, None, None, "tran"), "то": ("CONJ",) + (None,) * 7, "что": ("CONJ",) + (None,) * 7,
    "любите": ("VERB", "impf", None, "indc", "plur", "2per", "pres", "tran"), "иначе": ("ADVB",) + (None,) * 7, "придется": ("VERB", "perf", None, "indc", "sing", "3per", "futr", "intr"),
    "полюбить": ("INFN", "perf", None, None, None, None, None, "tran"), "получили": ("VERB", "perf", None, "indc", "plur", None, "past", "tran"),
}
TEXT = "Постарайтесь получить то, что любите, иначе придется полюбить то, что получили"


@pytest.fixture(scope="module")
def tags(spark):
    rows = [(w, w, p, None, a, None, None, i, m, n, pe, t, tr, None) for w, (p, a, i, m, n, pe, t, tr) in ROWS.items()]
    lexicon = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in COLS))
    docs = spark.createDataFrame([(1, TEXT), (2, None)], "doc_id long, text string")
    return docs, lexicon, M.analyse(docs, lexicon).cache()


def test_tags(tags):
    got = [r.tag.pos for r in tags[2].orderBy("pos").collect()]
    assert got == ["VERB", "INFN", "CONJ", "CONJ", "VERB", "ADVB", "VERB", "INFN", "CONJ", "CONJ", "VERB"]


def test_stats(tags):
    rows = {(r.category, r.value): r.cnt for r in M.morph_stats(tags[2]).collect()}
    assert rows["pos", "VERB"] == 4 and rows["pos", "CONJ"] == 4 and rows["voice", None] == 11 and rows["tense", "past"] == 1 and rows["tense", None] == 8
    few = M.morph_stats(tags[2], "pos", "tense", filter_none=True).collect()
    assert {r.category for r in few} == {"pos", "tense"} and all(r.value for r in few)
    with pytest.raises(KeyError):
        M.morph_stats(tags[2], "x")


def test_explain_and_table(tags):
    told = M.explain(tags[2], "pos", "tense", filter_none=True).orderBy("pos").collect()
    assert told[0].word == "Постарайтесь" and told[0].tags == {"pos": "VERB"} and told[4].tags == {"pos": "VERB", "tense": "pres"}
    rows = [(r.category, r.value, r.cnt) for r in M.ordered_stats(M.morph_stats(tags[2])).orderBy("category", "rank").collect()]
    assert render.morph_table(rows).count("|") == 29 and render.morph_table(rows, "pos", "tense").count("|") == 8


def test_stage(tags):
    docs, lexicon, _ = tags
    got = {r.doc_id: r.morph for r in pipeline.MorphStage(lexicon).transform(docs).collect()}
    assert set(got[1]["pos"]) - {"None"} == {"ADVB", "CONJ", "INFN", "VERB"} and sum(got[1]["tense"].values()) == sum(got[1]["pos"].values())
    got = {r.doc_id: r.morph for r in pipeline.MorphStage(lexicon, filter_none=True).transform(docs).collect()}
    assert got[1]["pos"] == {"ADVB": 1, "CONJ": 4, "INFN": 2, "VERB": 4} and got[2] is None


def test_long_lexicons(tags, monkeypatch):
    """What a lexicon too long to be sent says is the same."""
    from slovomer.operators import words as W

    docs, lexicon, _ = tags
    want = sorted(map(repr, M.morph_stats(M.analyse(docs, lexicon)).collect()))
    monkeypatch.setattr(W.meet, "__defaults__", (0, 3))
    assert sorted(map(repr, M.morph_stats(M.analyse(docs, lexicon)).collect())) == want
