import random

import pytest

from slovomer.llm import sentences as S


def units(text, **kw):
    out, a = [], 0
    for e in S.sentence_ends(text, **kw):
        out.append(text[a:e].strip())
        a = e
    return out


CASES = [
    ["Дом стоял с 1956 г.", "Зерно росло в г. Рисемарск, на ул. Лесной, д. 11.", "Т. е. нет."],
    ["А. В. Баритавов увидел у А. Веливеров и др. мастеров дом.", "Проф. Лесов спал на рис. 28.5.", "В 31 г. до н. э. пели!"],
    ["«Подожди!» — крикнул волк.", "Волк сказал: «Старик купил село!»", "Лес шумел (река пела громко!), а дом стоял."],
    ["Но… красный дом стоял…", "Снег шёл?!", "Всё..."],
    ["Длина 32.8 м, а ширина 28,2 м.", "Поезд отошёл в 9.54, и т. д.", "Конец"],
    ["Die Mühle, z. B. Boot, 3.5 km.", "Am 9. Mai 1961 auf Lehrer.", "Dr. Wälder sagte: „Lampe und Boot.“", "Der Fluss."],
    ["“Song of garden. Window!” said the teacher.", "Dr. Window came at 4 p.m. the old road (fig. 33.1).", "End, e.g. the bread."],
    ["和灯到信……小船？", "他说：“在小船到！”", "的窗户是古老。", "“到灯到安静。”古老说。"],
    ["村で村を。", "「が庭が道を古い！」と叫んだ。", "石庭が石。"],
    ["में नाव पृ. 1912 पर है।", "उसने कहा, “है रोटी।”", "डॉ. गीत!"],
    ["Երգ նամակ։", "Հաց այգի:", "Մի գետ։"],
]


@pytest.mark.parametrize("case", CASES, ids=range(len(CASES)))
def test_units(case):
    glue = "" if "。" in "".join(case) else " "
    text = glue.join(case)
    assert units(text) == case
    assert units("\n\n".join(case)) == case


def test_paragraphs_and_verse():
    assert units("Заголовок\n\nЛес шумел\nу реки,\nа дом спал.\nСнег\n\n— Да? — спросил он.\n— Нет.") == ["Заголовок", "Лес шумел\nу реки,\nа дом спал.", "Снег", "— Да? — спросил он.", "— Нет."]
    assert units("лес.Дом стоял.") == ["лес.", "Дом стоял."]
    assert units("ไปป่า 1954 ปี เป็นป่า ฯลฯ มีครู") == ["ไปป่า 1954 ปี", "เป็นป่า ฯลฯ มีครู"]
    assert units("Лес шумел.​ Дом спал.") == ["Лес шумел.", "​ Дом спал.".strip()]
    assert S.sentence_ends("") == S.sentence_ends(None) == S.sentence_ends(" \n ") == [] and units("без точки") == ["без точки"]


def random_text(rng, n):
    parts = ["Лес", "дом", ". ", "! ", "… ", "«", "»", "(", ")", " — ", "\n", "\n\n", "г. ", "А. ", "“", "”", '"', "「", "」", "。", ": ", ", ", "5.3 ", "ул. ", "\t", " " * 60, "." * 60, "\n— ", "ไป ", "ป่า" + " " * 50, "\n" + " " * 70]
    return "".join(rng.choice(parts) for _ in range(n))


@pytest.mark.parametrize("seed", range(60))
def test_scan_equals_whole(seed):
    """Composed chunk functions give what one pass over the whole text gives, wherever it is cut."""
    text = random_text(random.Random(seed), 300)
    want = S.sentence_ends(text, 1 << 30)
    for chunk in (7, 60, 120, 500):
        assert S.sentence_ends(text, chunk) == want


def test_lines_longer_than_the_context():
    line = "Имя\tвозраст и ещё очень много слов, которых хватит, чтобы строка стала длиннее"
    text = f"{line}\nСтрока вторая"
    assert S.sentence_ends(text, 1 << 30) == S.sentence_ends(text, 40) == [len(line), len(text)]
    assert S.sentence_ends("да\n" + " " * 100 + "нет", 20) == S.sentence_ends("да\n" + " " * 100 + "нет", 1 << 30)
    reply = "— " + "Подожди меня у старой мельницы, я скоро вернусь к тебе с хлебом. — Потом он ушёл."
    assert units(reply) == [reply] and units(reply, chunk=30) == [reply]
    told = "Рассказ начался. " + reply[2:]
    assert len(units(told)) == 3 and units("— Да.\n" + told)[1:] == units(told)


def test_composition():
    """The functions of two pieces compose to the function of both."""
    text = random_text(random.Random(99), 200).translate(S._WIDE)
    cut = len(text) // 2
    f, g, h = (S.chunk_function(text, a, b, 0)[0] for a, b in ((0, cut), (cut, len(text)), (0, len(text))))
    assert bytes(g[s] for s in f) == h


def test_operator(spark):
    rng = random.Random(7)
    texts = [None, "", "  ", "Лес.", "Дом стоял. Лес шумел.", "Дом стоял. Лес шумел.", *(random_text(rng, 400) for _ in range(12))]
    df = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, end_pos long")
    want = sorted((k, e) for k, t in enumerate(texts) for e in S.sentence_ends(t))
    for chunk, block in ((S.CHUNK, S.BLOCK), (150, 2), (150, 100), (40, 3)):
        got = S.sentence_units(df, chunk=chunk, block=block).collect()
        assert sorted((r.doc_id, r.end_pos) for r in got) == want
        assert all(r.start_pos <= r.end_pos for r in got)
    assert S.sentence_units(df.where("false")).count() == 0
