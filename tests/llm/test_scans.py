import pytest

from slovomer.llm import scans as S

WORDS = "лес дом стоял у реки тихий широкий мельница непосредственная последовательность интерпретация рассматривала перераспределение юго-западнее и в на противопоставление осуществляла городок маленький вечер старик купил красную шапку".split()
TEXT = """ТРОПИНКА
— 144 —
Широкий лес рассматрива-
ла мельница и тихий вечер
стоял у реки Юго-
западнее непосредственная
послеgовательность и интер=
— 145 —
ТРОПИНКА
претация иптерпретация у
старик купил кра■сную

шапку тихий дoм стоял у."""


@pytest.fixture(scope="module")
def lexicon():
    return S.Lexicon({w: 50 for w in WORDS}, {}, ["тропинка"])


def test_judge(lexicon):
    scanned, defects, fixed = S.judge(TEXT, lexicon)
    assert scanned
    assert defects == sorted([(1, "furniture"), (2, "furniture"), (3, "broken_word"), (5, "broken_word"), (7, "misread"), (7, "broken_word"), (8, "furniture"), (9, "furniture"), (10, "misread"), (11, "misread")])
    assert "рассматривала мельница" in fixed and "последовательность и интерпретация интерпретация" in fixed and "Юго-западнее" in fixed and "красную" in fixed and "ТРОПИНКА" not in fixed and "145" not in fixed


@pytest.mark.parametrize("text", [None, "", " ", "Одна строка.", "1\nЛес стоял\nу реки.\n\n2\nДом\nи вечер.", "— Да?\n— Нет.\n— Да!"])
def test_sound(lexicon, text):
    assert S.judge(text, lexicon) == (False, [], text)


@pytest.mark.parametrize("token,right", [("лec", None), ("вечep", None), ("в3чер", None), ("5-й", None), ("1956", None), ("ме1ьница", "ме1ьница"), ("uнтерпретация", "интерпретация"), ("мeJIьница", "мельница"), ("|<упил", "купил"), ("Маларин", None), ("вечеp", None), ("ди", None)])
def test_misread(lexicon, token, right):
    got = S.misread(token, lexicon)
    if token in ("в3чер", "ме1ьница"):
        assert got  # a digit in a word is wrong even if the right letter isn't known
    else:
        assert got == right


def test_distance():
    assert S.distance("дом", "дом") == 0 and S.distance("лес", "дес") == 0.3 and S.distance("лес", "вес") == 1.0 and S.distance("лес", "ле") == 1.0


def test_context_decides():
    lx = S.Lexicon({"вода": 5, "нода": 5, "тихая": 9}, {"ая да": 9}, [])
    assert lx.repair("пода", "тихая") in ("вода", "нода")
    lx = S.Lexicon({"вор": 5, "ноп": 5, "воры": 9, "норы": 1}, {"ая ры": 1}, [])
    assert lx.repair("поры") == "воры"
    lx = S.Lexicon({"воры": 9, "норы": 1}, {"ая ры": 1, "=глубокие норы": 4}, [])
    assert lx.repair("поры", "глубокие") == "норы" and lx.repair("поры", "ночные") == "воры"
    assert S.mistakable(["вода", "нода", "лес", "норы", "воры"]) == {"вода", "нода", "норы", "воры"}
    assert "=тихая вода" in S.term_counter(frozenset(["вода"]))("Тихая вода, тихая река")


def test_operator(spark):
    docs = spark.createDataFrame([(k, TEXT, "x") for k in range(6)] + [(9, None, None), (10, "", None)], "doc_id long, text string, defects string")
    words = spark.createDataFrame([(w,) for w in WORDS], "word string")
    lx = S.corpus_lexicon(docs, words)
    assert lx.knows("мельница") and "тропинка" in lx.heads
    got = S.damaged_lines(S.scan_defects(docs, lx))
    assert got.where("doc_id = 0").count() == 9 and got.count() == 54  # a misread form as frequent as the right one is a word
    assert S.scan_defects(docs.where("false"), S.corpus_lexicon(docs.where("false"), words)).count() == 0


def test_heads_repeated_in_one_text(lexicon):
    text = TEXT.replace("ТРОПИНКА", "Лесные голоса")
    assert [d for d in S.judge(text, lexicon)[1] if d[1] == "furniture"] == [(k, "furniture") for k in (1, 2, 8, 9)]


def test_below_the_share(spark, monkeypatch):
    """Words and heads of a few documents are known whatever the size of the collection."""
    text = TEXT.replace("ТРОПИНКА\n— 144 —\n", "").replace("ТРОПИНКА", "Лесные голоса")
    docs = spark.createDataFrame([(k, text) for k in range(6)] + [(7, text.replace("старик", "стaрuк"))] + [(100 + k, f"Поле {k}") for k in range(20)], "doc_id long, text string")
    few = S.corpus_lexicon(docs)
    whole = sorted(map(str, S.scan_defects(docs, few).collect()))
    assert few.rest is None and "лесные голоса" in few.heads and len(whole) == 7 and "broken_word" in whole[0]
    monkeypatch.setattr(S, "LEXICON_SHARE", 0.9)
    monkeypatch.setattr(S, "HEAD_SHARE", 0.9)
    lx = S.corpus_lexicon(docs)
    assert not lx.words and not lx.heads
    assert sorted(map(str, S.scan_defects(docs, lx).collect())) == whole


def test_several_misread_letters(lexicon):
    assert S.misread("послсдоватсльность", lexicon) == "последовательность"
    assert S.misread("лсе", lexicon) is None


def test_many_signs_of_several_letters():
    word = "ташотшатштут"
    lx = S.Lexicon({word: 9, "лес": 9})
    token = word.replace("т", "m").replace("ш", "m")
    assert token.count("m") > 4 and S.misread(token, lx) == word and S.misread(token[:3] + "■" + token[3:], lx) == word
    assert S.misread("m" * 500 + "а" * 500, lx) == "т" * 500 + "а" * 500
    assert S.Widened(S.Lexicon({"лес": 9}), {word: 5}, []).spellings(token)[0] == word


def test_all_odd_line(lexicon):
    text = TEXT.replace("старик купил кра■сную", "сmарик куп■ил кра■сную шаn■ку")
    scanned, defects, fixed = S.judge(text, lexicon)
    assert (11, "misread") in defects and "старик купил красную шапку" in fixed


def test_wide_heads():
    head = "О чём рассказывала мельница старому рыбаку у реки за лесом"
    wide = f"{head}  у дома   144"
    assert 60 < len(wide) <= 100 and S.running_heads(wide + "\nЛес") == [S.head_key(head + " у дома")]
