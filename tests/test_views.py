import pytest
from pyspark.sql import functions as F

from slovomer.operators import views
from slovomer.plans import render


def test_zipf(spark):
    counter = spark.createDataFrame([("а", 100), ("б", 75), ("в", 50), ("г", 25), ("д", 25)], "word string, cnt long")
    assert [(r.rank, r.word) for r in views.zipf_ranks(counter).orderBy("rank").collect()] == [(1, "а"), (2, "б"), (3, "в"), (4, "г"), (5, "д")]
    assert views.zipf_ranks(counter, 2).count() == 2
    assert [round(r.frequency, 6) for r in views.zipf_theory(spark, 100, 3, 2).orderBy("rank").collect()] == [100, 25, 11.111111]
    with pytest.raises(ValueError):
        views.zipf_theory(spark, 100, 3, 1)
    assert views.zipf_labels(4, 3)[0] == 0 and views.zipf_labels(4, 0) == []


def naive_print(words, size=10):
    step, out, start = max(1, int(0.1 * size)), [], 0
    ttr = lambda w: len(set(w)) / len(w) if w else 0.0
    while start + size <= len(words):
        out.append(ttr(words[start : start + size]))
        start += step
    return out + [ttr(words[start:])]


@pytest.mark.parametrize("size", [1, 3, 10, 25])
def test_fingerprint(spark, size):
    lists = [["мама", "мыла", "раму"], ["шла", "Саша", "по", "Шоссе"], [str(k % 7) for k in range(47)], []]
    df = spark.createDataFrame([*enumerate(lists), (9, None)], "doc_id long, words array<string>")
    rows = views.fingerprint(df, size).orderBy("doc_id", "seg_pos").collect()
    for k, w in enumerate(lists):
        assert [r.metric for r in rows if r.doc_id == k] == pytest.approx(naive_print(w, size))
    mine = views.fingerprint(df, size, lambda w: float(len(w)), python_metric=True)
    assert mine.agg(F.max("metric")).first()[0] == max(size, 3 if size == 1 else 0, *(len(w) for w in lists if len(w) < size)) if size != 1 else True


def test_grid(spark):
    df = spark.createDataFrame([(1, [str(k) for k in range(30)])], "doc_id long, words array<string>")
    rows = views.fingerprint_grid(views.fingerprint(df)).orderBy("seg_pos").collect()
    assert len(rows) == 22 and rows[-1].grid_row == 7 and rows[-1].grid_col == 0 and rows[0].shade == 1.0


def test_word_tree(spark):
    df = spark.createDataFrame([(1, ["говорит", "рабочий", "класс"]), (2, ["8-часовой", "рабочий", "день"]), (3, None)], "doc_id long, words array<string>")
    grams = views.keyword_ngrams(df, "рабочий", 2)
    assert sorted(" ".join(r.ngram) for r in grams.collect()) == ["8-часовой рабочий", "говорит рабочий", "рабочий день", "рабочий класс"]
    edges = views.font_sizes(views.tree_edges(views.top_ngrams(grams), "рабочий"))
    rows = [r.asDict() for r in edges.collect()]
    dot = render.tree_dot(rows, "рабочий")
    assert len(dot.strip().split("\n")) - 2 == 11 and all(r["font_size"] == 30 for r in rows)
    with pytest.raises(ValueError):
        render.tree_dot([], "нет")


def test_keyword_at_both_ends(spark):
    df = spark.createDataFrame([(1, ["к", "а", "к", "а", "к"])], "doc_id long, words array<string>")
    got = {" ".join(r.ngram): r.freq for r in views.keyword_ngrams(df, "к", 5).collect()}
    w = ["к", "а", "к", "а", "к"]
    want = {}
    for n in range(2, 6):
        for i in range(len(w) - n + 1):
            g = w[i : i + n]
            if "к" in (g[0], g[-1]):
                want[" ".join(g)] = want.get(" ".join(g), 0) + 1
    assert got == want


def test_ranks_over_ranges(spark):
    rows = [(f"слово{k:04d}", 1 + k % 3) for k in range(3000)]
    df = spark.createDataFrame(rows, "word string, cnt long").repartition(7)
    got = views.zipf_ranks(df).collect()
    want = [w for w, c in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert [r.word for r in sorted(got, key=lambda r: r["rank"])] == want and sorted(r["rank"] for r in got) == list(range(1, 3001))
