import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from slovomer.llm import lookalikes as L


@pytest.mark.parametrize(
    "a,b",
    [("Дом", "Дoм"), ("йод", "йод"), ("Ｆｉｇ．１", "Fig.1"), ("а б", "а б"), ("ко​т", "кот"), ("ランプ", "ﾗﾝﾌﾟ"), ("ガラス", "ｶﾞﾗｽ"), ("Οкно", "Окно"), ("аb\r\nc", "аb\nc"), ("lettеr", "letter"), ("ор", "op"), ("schön", "schön")],
)
def test_same_look(a, b):
    assert L.look(L.normal_form(a)) == L.look(L.normal_form(b))


@pytest.mark.parametrize("a,b", [("й", "и"), ("ё", "е"), ("дом", "дым"), ("1", "l"), ("№", "No"), ("½", "1/2"), ("а б", "аб"), ("З", "3"), ("О", "0"), ("дом", "Дом"), ("é", "e"), ("…", "...")])
def test_other_look(a, b):
    assert L.look(L.normal_form(a)) != L.look(L.normal_form(b))


def test_spelling_is_consistent():
    assert L.normal_form("Кoмпaс и леc") == "Компас и лес"
    assert L.normal_form("the lеttеr") == "the letter"
    assert L.normal_form("текст и Crème") == "текст и Crème"
    assert L.normal_form(None) is None and L.look(None) is None


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="абвгдеёжзорсух aceopxy ABHІЇ.​", max_size=30), st.randoms(use_true_random=False))
def test_replacing_doubles_keeps_the_look(text, rng):
    double = {c: [d for d in g if d not in (c, ".")] for g in L.DOUBLES for c in g if c != "."}
    changed = "".join(rng.choice([c, *double.get(c, [])]) for c in unicodedata.normalize("NFC", text))
    assert L.look(L.normal_form(changed)) == L.look(L.normal_form(text))
    assert L.look(L.normal_form(L.normal_form(text))) == L.look(L.normal_form(text))


def test_pairs(spark):
    rng = random.Random(4)
    base = ["Дом стоит у реки", "Лес шумел", "Река текла", "", "  "]
    texts = [None, *base, *base[:2]]
    for t in base * 4:
        texts.append("".join({"о": "o", "е": "e", " ": " "}.get(c, c) if rng.random() < 0.5 else c for c in t))
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, look_key string")
    got = sorted(tuple(r) for r in L.lookalike_pairs(L.normalise_lookalikes(df)).collect())
    keys = [L.look(L.normal_form(t)) if t and t.strip() else None for t in texts]
    want = sorted((a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if keys[a] is not None and keys[a] == keys[b] and texts[a] != texts[b])
    assert got == want and want
    assert L.lookalike_pairs(L.normalise_lookalikes(df.where("false"))).count() == 0


def test_long_text():
    assert L.normal_form("ก" * 200_000 + " дoм и Ω") is not None
