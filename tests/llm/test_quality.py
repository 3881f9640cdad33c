import numpy as np
import pytest

from slovomer.llm import quality as Q

COMMON = frozenset("и в на не что с the and of der und".split())
PROSE = "Тихий лес стоял на берегу реки, и дом не спал. Что старик искал в лесу?"
CASES = {
    "\n".join(f"{k}) дом" for k in range(1, 9)): True, "\n".join(f"лес | {1900 + k} | {k}77 | нет" for k in range(9)): True, "\n".join(f"дом{'.' * 20} {k}" for k in range(9)): True,
    "Q2FtZWxvdCBpcyBhIHNpbGx5IHBsYWNl" * 3: True, "ля " * 60: True, "***": True, "№ 17": True, "+ _": True, "=|^>+*\n!_%&\\?@#/": True, "  3346    9442     806    4763\n  8201    3283    9900    1200": True,
    "Главная » Поиск » Печать » Вход » Каталог » Назад » Далее": True, "нзшкжз ржгщлсдктвпджплр фкзрплгшфцзр лйзсхщф мнйсзйхзг": True,
    PROSE: False, "Тихий лес\nстоял у реки,\nи дом не спал…": False, "— Куда ты идёшь? — спросил волк.\n— В лес и на реку.": False, PROSE * 5 + "\n- дом\n- лес\n- сад": False, "Der Wald und die Mühle der Nacht, und das alte Boot.": False,
    "面包了早晨的，早晨了村庄有古老。": False, "ไปเช้าเป็นเรือมีเรือในตะเกียงในเช้า": False, "के नदी से पुराना गाँव और बाग है।": False, "": False, " \n ": False, "Рассказ": False,
    PROSE.encode("cp1251").decode("latin-1"): False, PROSE.encode().decode("cp1251", "replace"): False, PROSE.encode("koi8-r").decode("cp1251"): False,
}


@pytest.mark.parametrize("text,flagged", CASES.items(), ids=range(len(CASES)))
def test_found(text, flagged):
    assert bool((Q.measure(text, COMMON)[-2] or 0) > 0.5) is flagged


def test_divergence():
    p = np.array([[0.5, 0.5, 0.0], [1.0, 0.0, 0.0]])
    d = Q.divergence(p, p)
    assert d[0, 0] == pytest.approx(0, abs=1e-9) and d[0, 1] == d[1, 0] and 0 < d[0, 1] < 1
    assert Q.divergence(np.array([[1.0, 0.0]]), np.array([[0.0, 1.0]]))[0, 0] == pytest.approx(1.0)


def test_counts():
    chars, words, lines, mean, symbols, stops, common, digits, *_ = Q.measure("Лес и дом.\nНе 12 #", COMMON)
    assert (chars, words, lines) == (18, 4, 2) and mean == pytest.approx(9 / 4) and stops == 0.5 and common == 0.5 and digits > 0 and symbols > 0


def test_together_as_alone():
    texts = [*CASES, None, *CASES]
    assert Q.measure_many(texts, COMMON) == [Q.measure(t, COMMON) for t in texts]


def test_operator(spark):
    docs = spark.createDataFrame([(1, PROSE, 5), (2, None, 5), (3, "***", 5), (3, "***", 5), (4, "а" * 200_000, 5)], "doc_id long, text string, words int")
    common = spark.createDataFrame([(w,) for w in COMMON] + [(None,)], "word string")
    stats = Q.quality_statistics(docs, common)
    assert {r.doc_id: r.profile for r in stats.collect() if r.doc_id != 4} == {1: "prose", 2: "blank", 3: "signs"}
    assert [r.doc_id for r in Q.mostly_structure(stats).where("doc_id < 4").collect()] == [3, 3]
    assert Q.quality_statistics(docs.where("false"), common).count() == 0


def test_fitted_profiles(spark):
    """Languages get profiles of their own from clean lines, structures from lines of their shape; rare kinds stay as they are."""
    texts = ["Лес и дом на реке, и старик не спал в лесу" + " тихо" * (k % 3) for k in range(12)] + ["The boat of the river and the old house in it" + " now" * (k % 3) for k in range(12)] + ["\n".join(f"{k}) дом у реки" for k in range(1, 20))] + [None, " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    languages = {"ru": frozenset("и на не в".split()), "en": frozenset("the of and in it".split())}
    names, profiles = Q.fit_profiles(docs, languages, least=5)
    assert {"prose ru", "prose en", "garbled koi8_u as cp1251"} <= set(names) and np.allclose(profiles.sum(1), 1, atol=0.02)
    assert tuple(profiles[names.index("table")]) == Q.PROFILES["table"] and tuple(profiles[names.index("list")]) != Q.PROFILES["list"]
    assert Q.measure_many([texts[0], texts[12]], languages["ru"] | languages["en"], (names, profiles))[1][-1] == "prose en"
    assert Q.fit_profiles(docs.where("false"), languages)[0] == list(Q.PROFILES)
