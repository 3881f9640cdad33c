import pytest

from slovomer.llm import encoding as E

TEXT = "Широкий стог стоял у тихой реки, а мокрый лес ждал рядом. Потом добрый доктор искал свою шапку! Мельница спала."
WORDS = TEXT.lower().replace(".", " ").replace(",", " ").replace("!", " ").split() + "дом лес река мост трава звезда мальчик тропинка индустриализация обоснование преобразование соответствовал старик рыбак осень".split() * 3


@pytest.fixture(scope="module")
def model():
    return E.LetterModel(WORDS)


@pytest.mark.parametrize("shown", ["cp1252", "cp1251", "cp866", "koi8_u"])
def test_multibyte_round_trip(model, shown):
    table = {b: chr(c) for c, b in E.BYTEVIEW[shown].items() if b < 256 and c != 0xFFFD}
    garbled = "".join(chr(b) if b < 128 else table[b] for b in TEXT.encode())
    assert E.repair(garbled, model)[::2] == (True, TEXT)
    mixed = "Тихая река.\n" + garbled
    assert E.repair(mixed, model)[2] == "Тихая река.\n" + TEXT


@pytest.mark.parametrize("shown,real", E.SINGLE_BYTE_PAIRS[:7])
def test_single_byte_round_trip(model, shown, real):
    table = {b: chr(c) for c, b in E.BYTEVIEW[shown].items() if b < 256 and c != 0xFFFD}
    garbled = "".join(chr(b) if b < 128 else table.get(b, "�") for b in TEXT.encode(real))
    bad, kinds, fixed = E.repair(garbled, model)
    assert bad and sum(a == b for a, b in zip(fixed, TEXT)) > (0.7 if (shown, real) == ("cp1252", "cp866") else 0.95) * len(TEXT)


def test_twice(model):
    once = TEXT.encode().decode("latin-1")
    assert E.repair(once.encode().decode("latin-1"), model)[2] == TEXT


@pytest.mark.parametrize("text", [TEXT, "", None, "  ", "Надпись «Crème № 4».", "Der müde Wälder sagte: „Früh“ — schön!", "Рідний їжак у селі. Річка тиха…", "СИНИЙ ВЕЧЕР. БЕРЕСТЯНОЙ КОРОБ", "маль■чик шёл°домой", "в 5 °С ± 2, §3 ©"])
def test_sound_texts(model, text):
    assert E.repair(text, model) == (False, None, text)


def test_operator(spark):
    words = spark.createDataFrame([(w,) for w in WORDS] + [(None,)], "word string")
    rows = [(1, TEXT), (2, TEXT.encode("cp1251").decode("latin-1")), (3, None), (4, ""), (2, TEXT.encode("cp1251").decode("latin-1"))]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, kinds string")
    got = E.repair_encoding(df, words).collect()
    assert [(r.doc_id, r.restored, r.whole) for r in got] == [(2, TEXT, True)] * 2
    assert E.repair_encoding(df.where("false"), words).count() == 0


OTHERS = ["Straße müde zu Lampe, war „schön“ — Hütte.", "Հայաստանը գեղեցիկ երկիր է։", "साहित्य में नदी बहती है।", "საქართველო ლამაზი ქვეყანაა.", "كان الولد في البيت.", "河水很清，老人说：你好。", "川の水はきれいだ。", "แม่น้ำไหลช้า"]


@pytest.mark.parametrize("shown", ["cp1251", "koi8_u", "cp866"])
@pytest.mark.parametrize("text", OTHERS)
def test_multibyte_of_other_scripts(model, text, shown):
    table = {b: chr(c) for c, b in E.BYTEVIEW[shown].items() if b < 256 and c != 0xFFFD} | ({0x98: "�"} if shown == "cp1251" else {})
    garbled = "".join(chr(b) if b < 128 else table[b] for b in text.encode())
    assert E.re.search(E.SUSPECT, garbled)
    bad, kinds, fixed = E.repair(garbled, model)
    assert bad and kinds == f"utf_8 as {shown}" and (fixed == text or "�" in garbled)


@pytest.mark.parametrize("text", [*OTHERS, "Класс «Г», цех «В» и ТОРГ» рядом", "моєї твоєї СВІТІ ДІТІ ПІДІЙДІТЬ", "Еіn Fеnѕtеr und Еѕ wаr", "├─┐src\n│ └──┐main", "шалфей чем цел ход хлеб"])
def test_sound_texts_of_other_scripts(model, text):
    assert E.repair(text, model) == (False, None, text)


@pytest.mark.parametrize("n", [5, 8, 20])
def test_all_runs_of_a_line(model, n):
    sound = "Тихая река и мокрый лес стоял рядом у старой мельницы"
    part = "добрый доктор искал свою шапку и потом спала мельница"
    line = " ".join(f"{sound} {part.encode('koi8_u').decode('cp1251')}" for _ in range(n))
    assert E.repair(line, model)[::2] == (True, " ".join(f"{sound} {part}" for _ in range(n)))


def test_five_times_over(model):
    text = "Широкий стог стоял у тихой реки."
    garbled = text
    for _ in range(5):
        garbled = garbled.encode().decode("latin-1")
    assert E.repair(garbled, model)[::2] == (True, text)


def test_long_line_without_spaces(model):
    garbled = "мельницастоялаурекиимокрыйлес".encode().decode("latin-1") * 3000
    assert E.repair(garbled, model)[2] == "мельницастоялаурекиимокрыйлес" * 3000


def test_best_runs_against_brute_force():
    import random

    rng = random.Random(3)

    def brute(steps, lo, hi):
        best = max(((sum(steps[i:j]), -(j - i), -i, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0,))
        if best[0] <= 0:
            return []
        i, j = best[3:]
        return [*brute(steps, lo, i), (best[0], i, j), *brute(steps, j, hi)]

    for _ in range(300):
        steps = [rng.choice([-7.3, -3.1, -1.7, 0.9, 2.3, 5.9]) * rng.uniform(0.9, 1.1) for _ in range(rng.randrange(14))]
        want = [(round(s, 6), i, j) for s, i, j in brute(steps, 0, len(steps)) if s >= 2]
        assert [(round(s, 6), i, j) for s, i, j in E.best_runs(steps, 2)] == want


def test_model_of_all_words(spark):
    latin = spark.range(200_001).selectExpr("concat('a', hex(id)) as word")
    words = latin.unionByName(spark.createDataFrame([(w,) for w in [*WORDS, "ЛЕС", "", None]], "word string"))  # these come last in order
    assert E.fit_letter_model(words).pairs == E.LetterModel({r.word.lower() for r in words.collect() if r.word}).pairs
    df = spark.createDataFrame([(1, TEXT), (2, TEXT.encode("cp1251").decode("latin-1"))], "doc_id long, text string")
    assert [(r.doc_id, r.restored) for r in E.repair_encoding(df, words).collect()] == [(2, TEXT)]
    assert E.fit_letter_model(words.where("false")).pairs == {}


@pytest.mark.parametrize("words", [[], ["а"], WORDS, ["Лес", "x" * 70_000, "a\U0001f600b", "水", "два слова"]])
def test_count_pairs_one_by_one(words):
    padded = [f" {w.lower()} " for w in words]
    assert E.count_pairs(words) == E.Counter(w[k : k + 2] for w in padded for k in range(len(w) - 1))
