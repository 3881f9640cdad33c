"""Results as text: fixed-width tables and the graph language for word trees."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from ..operators.morphology import CATEGORIES, checked

# Labels of the results.
BASIC_LABELS = {
    "n_sents": "Предложения", "n_words": "Слова", "n_unique_words": "Уникальные слова", "n_long_words": "Длинные слова", "n_complex_words": "Сложные слова", "n_simple_words": "Простые слова",
    "n_monosyllable_words": "Односложные слова", "n_polysyllable_words": "Многосложные слова", "n_chars": "Символы", "n_letters": "Буквы", "n_spaces": "Пробелы", "n_syllables": "Слоги", "n_punctuations": "Знаки препинания",
}
READABILITY_LABELS = {
    "flesch_kincaid_grade": "Тест Флеша-Кинкайда", "flesch_reading_easy": "Индекс удобочитаемости Флеша", "coleman_liau_index": "Индекс Колман-Лиау", "smog_index": "Индекс SMOG",
    "automated_readability_index": "Автоматический индекс удобочитаемости", "lix": "Индекс удобочитаемости LIX",
}
DIVERSITY_LABELS = {
    "ttr": "Type-Token Ratio (TTR)", "rttr": "Root Type-Token Ratio (RTTR)", "cttr": "Corrected Type-Token Ratio (CTTR)", "httr": "Herdan Type-Token Ratio (HTTR)", "sttr": "Summer Type-Token Ratio (STTR)",
    "mttr": "Mass Type-Token Ratio (MTTR)", "dttr": "Dugast Type-Token Ratio (DTTR)", "mattr": "Moving Average Type-Token Ratio (MATTR)", "msttr": "Mean Segmental Type-Token Ratio (MSTTR)",
    "mtld": "Measure of Textual Lexical Diversity (MTLD)", "mamtld": "Moving Average Measure of Textual Lexical Diversity (MTLD)", "hdd": "Hypergeometric Distribution D (HD-D)", "simpson_index": "Индекс Симпсона", "hapax_index": "Гапакс-индекс",
}
CATEGORY_LABELS = {
    "pos": "Часть речи", "animacy": "Одушевленность", "aspect": "Вид", "case": "Падеж", "gender": "Род", "involvement": "Совместность", "mood": "Наклонение", "number": "Число", "person": "Лицо", "tense": "Время",
    "transitivity": "Переходность", "voice": "Залог",
}
VALUE_LABELS = {
    "NOUN": "Имя существительное", "ADJF": "Имя прилагательное (полное)", "ADJS": "Имя прилагательное (краткое)", "COMP": "Компаратив", "VERB": "Глагол (личная форма)", "INFN": "Глагол (инфинитив)",
    "PRTF": "Причастие (полное)", "PRTS": "Причастие (краткое)", "GRND": "Деепричастие", "NUMR": "Числительное", "ADVB": "Наречие", "NPRO": "Местоимение-существительное", "PRED": "Предикатив", "PREP": "Предлог",
    "CONJ": "Союз", "PRCL": "Частица", "INTJ": "Междометие", "anim": "Одушевлённое", "inan": "Неодушевлённое", "perf": "Совершенный", "impf": "Несовершенный", "nomn": "Именительный", "gent": "Родительный",
    "datv": "Дательный", "accs": "Винительный", "ablt": "Творительный", "loct": "Предложный", "voct": "Звательный", "gen1": "Первый родительный", "gen2": "Второй родительный (частичный)",
    "acc2": "Второй винительный", "loc1": "Первый предложный", "loc2": "Второй предложный (местный)", "masc": "Мужской", "femn": "Женский", "neut": "Средний", "ms-f": "Общий",
    "incl": "Говорящий включён в действие", "excl": "Говорящий не включён в действие", "indc": "Изъявительное", "impr": "Повелительное", "sing": "Единственное", "plur": "Множественное",
    "1per": "1", "2per": "2", "3per": "3", "pres": "Настоящее", "past": "Прошедшее", "futr": "Будущее", "tran": "Переходный", "intr": "Непереходный", "actv": "Действительный", "pssv": "Страдательный",
}
UNKNOWN = "Неизвестно"


def _table(title: str, labels: Mapping[str, str], row: Mapping[str, object], wide: int, number: str, head: int) -> str:
    lines = [f"{title:^{head}}|{'Значение':^10}", "-" * (wide + 10)]
    return "\n".join(lines + [f"{label:{wide}}|{row[k]:^10{number}}" for k, label in labels.items()])


def basic_table(row: Mapping[str, object]) -> str:
    return _table("Статистика", BASIC_LABELS, row, 20, "", 20)


def readability_table(row: Mapping[str, object]) -> str:
    return _table("Метрика", READABILITY_LABELS, row, 40, ".2f", 40)


def diversity_table(row: Mapping[str, object]) -> str:
    return _table("Метрика", DIVERSITY_LABELS, row, 60, ".2f", 60)


def morph_table(rows: Sequence[tuple[str, str | None, int]], *names: str, filter_none: bool = False) -> str:
    """Of one document's (category, value, count), most frequent first."""
    out = []
    for c in checked(names) if names else CATEGORIES:
        out.append(f"{CATEGORY_LABELS[c]:-^40}")
        mine = [(v, n) for k, v, n in rows if k == c and not (filter_none and v is None)]
        out += [f"{UNKNOWN if v is None else VALUE_LABELS.get(v, v):30}|{n:^10}" for v, n in sorted(mine, key=lambda x: -x[1])]
        out.append("")
    return "\n".join(out)


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def tree_dot(edges: Sequence[Mapping[str, object]], keyword: str, largest: int = 30) -> str:
    """A word tree in DOT from the rows of ``tree_edges`` with font sizes; ValueError if the keyword has no context."""
    if not edges:
        raise ValueError("the keyword is in no text")
    body = ["graph [rankdir=LR]", "node [fontname=helvetica shape=plaintext]", f"{_quoted(keyword)} [label={_quoted(keyword)} fontsize={largest}]"]
    for direction in ("backward", "forward"):
        for e in sorted((e for e in edges if e["direction"] == direction), key=lambda e: (e["path"], e["depth"])):
            node = f"{e['path']} {direction}"
            parent = f"{e['parent_path']} {direction}" if e["depth"] > 1 else keyword
            ends = (parent, node) if direction == "forward" else (node, parent)
            body.append(f"{_quoted(node)} [label={_quoted(str(e['word']))} fontsize={e['font_size']}]")
            body.append(f"{_quoted(ends[0])} -> {_quoted(ends[1])}")
    return "digraph {\n\t" + "\n\t".join(body) + "\n}\n"
