import random

import numpy as np
import pytest

from slovomer.llm import reading as R


def make(rng, grade, n=14):
    words = []
    for _ in range(n):
        size = max(2, int(rng.gauss(2 + 2 * grade, 1)))
        sentence = [(f"слово{rng.randrange(40)}абвг" if rng.random() < 0.08 * grade else f"лес{rng.randrange(9)}").translate(str.maketrans("0123456789", "абвгдежзик")) for _ in range(size)]
        words.append(" ".join(sentence).capitalize() + ".")
    return " ".join(words)


@pytest.fixture(scope="module")
def levels(spark):
    rng = random.Random(1)
    rows = [(k, g, make(rng, g)) for k, g in enumerate(g for g in range(1, 12) for _ in range(25))]
    wrong = {3: 10, 4: 9, 270: 1, 260: 2}
    rows = [(k, wrong.get(k, g), t) for k, g, t in rows]
    rows += [(900, None, make(rng, 5)), (901, 99, make(rng, 9)), (902, 3, None), (903, 3, " . "), rows[0], (904, 2, "длинно " * 30_000)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "rec_id long, grade int, text string, level double")
    return df, wrong, R.reading_levels(df).cache()


def test_levels(levels):
    df, wrong, out = levels
    rows = {r.rec_id: r for r in out.collect()}
    assert len(rows) == out.count() == df.select("rec_id").distinct().count()
    off = [abs(rows[k].level - rows[k].grade) for k in range(275) if k not in wrong]
    assert np.mean(off) < 0.8 and max(off) < 3.5
    assert abs(rows[900].level - 5) < 2 and abs(rows[901].level - 9) < 2 and rows[902].level is None and rows[903].level is None


def test_misgraded(levels):
    found = {r.rec_id for r in R.misgraded(levels[2]).collect()}
    assert found - {904} == set(levels[1])


def test_empty(levels):
    df = levels[0]
    assert R.reading_levels(df.where("false")).count() == 0
    assert R.reading_levels(df.where("grade is null")).first().level is None


def test_own_share_is_taken_out():
    import pandas as pd

    b = pd.DataFrame({"nodes": [[0, 128]], "counts": [[1, 2]], "y": [7.0]})
    sums, weights = np.zeros(R.NODES), np.zeros(R.NODES)
    sums[0], weights[0], sums[128], weights[128] = 7.0, 1.0, 14.0, 2.0
    assert np.isnan(R._levels(b, sums, weights, np.zeros(3))).all()


def test_all_words_teach_the_repair(spark):
    rng = random.Random(2)
    rows = [(k, g, make(rng, g)) for k, g in enumerate(g for g in range(1, 12) for _ in range(4))]
    text = make(rng, 6)
    df = spark.createDataFrame([*rows, (100, None, text), (101, None, text.encode("cp1251").decode("latin-1"))], "rec_id long, grade int, text string")
    own = spark.createDataFrame([(w,) for w in text.lower().replace(".", "").split()], "word string")
    words = spark.range(200_001).selectExpr("concat('a', hex(id)) as word").unionByName(own)  # those of the text come last
    level = {r.rec_id: r.level for r in R.reading_levels(df, words).where("grade is null").collect()}
    assert level[100] is not None and level[101] == pytest.approx(level[100])
