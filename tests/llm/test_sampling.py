import random
import time
from collections import Counter

import pytest

from slovomer.llm import sampling as S

PRIMER = "rec_id long, type string, year int, category string, file string, loaded_at string, plan_id int"
PLANS, TARGETS = "plan_id int, sample_size long, of_table string", "plan_id int, target_id int, type string, year_from int, year_to int, category string, share double, min_records long"


@pytest.mark.parametrize("label", ["Рассказ", "рАССКАЗ", " «Рассказ» ", "Pacскaз", "Рас​сказ.", "РАССКАЗ\t"])
def test_label_key(label):
    assert S.label_key(label) == S.label_key("рассказ")


def test_label_key_differences():
    assert S.label_key("Весёлый  двор") == S.label_key("веселый двор") != S.label_key("Весёлые дворы")
    assert S.label_key(None) is None and S.label_key(" . ") is None


def test_swap_repair_never_worse_than_start():
    rng = random.Random(3)
    for _ in range(20):
        stock = {frozenset(k for k in range(4) if rng.random() < 0.4): rng.randrange(1, 60) for _ in range(8)}
        wishes, floors = {k: rng.randrange(0, 40) for k in range(4)}, {k: rng.randrange(0, 5) for k in range(4)}
        size = 50
        got = S.swap_repair(stock, wishes, floors, size, random.Random(1))
        assert sum(got.values()) == min(size, sum(stock.values())) and all(0 < n <= stock[s] for s, n in got.items())
        has = {t: sum(n for s, n in got.items() if t in s) for t in wishes}
        room = {t: sum(n for s, n in stock.items() if t in s) for t in wishes}
        assert all(has[t] >= min(floors[t], room[t], size // 8) for t in wishes)

        def cost(h):
            return sum((h[t] - wishes[t]) ** 2 / max(wishes[t], 1) for t in wishes)

        for a in got:  # no exchange of one record helps, unless it breaks a floor
            for b in stock:
                if stock[b] > got.get(b, 0):
                    h = dict(has)
                    for t in a:
                        h[t] -= 1
                    for t in b:
                        h[t] += 1
                    if all(h[t] >= min(floors[t], has[t]) for t in a - b):
                        assert cost(h) >= cost(has) - 1e-6


def data(spark, n=400):
    rng = random.Random(5)
    rows = []
    for k in range(n):
        kind = rng.choice(["Рассказ", "рассказ", "Pассказ", "Басня", None])
        rows.append((k, kind, rng.choice([1900, 1950, None, 99999]), rng.choice(["Зима", "ЗИМА", "Лето", ""]), f"f{k % 300}", f"2021-01-{1 + k % 28:02d}", None))
    rows += rows[:20] + [(9999, "Рассказ", 1950, "Зима", None, None, 1)]
    targets = [(1, 1, "Рассказ", None, None, None, 0.5, 3), (1, 2, None, 1940, 1960, "Зима", 0.3, 0), (1, 3, "Былина", None, None, None, 0.1, 2), (1, 4, None, None, 1900, None, 0.1, None), (1, 5, None, None, None, None, None, None)]
    return rows, spark.createDataFrame(rows, PRIMER), spark.createDataFrame([(1, 100, "primer_records"), (2, None, None)], PLANS), spark.createDataFrame(targets + targets[:1], TARGETS), targets


def test_sample(spark):
    rows, df, plans, targets, cells = data(spark)
    sample, report = S.sample_to_targets(df, plans, targets)
    last = {}
    for r in rows:
        if r[4] is not None and (r[4] not in last or (r[5] or "", r[0]) > (last[r[4]][5] or "", last[r[4]][0])):
            last[r[4]] = r
    drawn = sample.collect()
    assert len(drawn) == 100 and len({r.file for r in drawn}) == 100 and all(last[r.file][0] == r.rec_id for r in drawn)

    def holds(r, c):
        return (c[2] is None or S.label_key(r[1]) == S.label_key(c[2]) and r[1]) and (c[5] is None or S.label_key(r[3]) == S.label_key(c[5])) and (c[3] is None or r[2] is not None and r[2] >= c[3]) and (c[4] is None or r[2] is not None and r[2] <= c[4])

    got = {r.target_id: r for r in report.collect()}
    for c in cells:
        has = sum(bool(holds(r, c)) for r in last.values())
        need = max(int((c[6] or 0) * 100 + 0.5), c[7] or 0)
        assert (got[c[1]].available, got[c[1]].wanted, got[c[1]].met, got[c[1]].reached) == (has, need, has >= need, got[c[1]].drawn >= need)
        assert got[c[1]].drawn == sum(bool(holds(last[r.file], c)) for r in drawn)
    assert [r.target_id for r in S.unmet_targets(report).collect()] == [3]
    assert sorted(map(tuple, S.sample_to_targets(df, plans, targets)[0].collect())) == sorted(map(tuple, drawn))


def test_empty(spark):
    _, df, plans, targets, _ = data(spark, 5)
    sample, report = S.sample_to_targets(df.where("false"), plans, targets)
    assert sample.count() == 0 and Counter(r.met for r in report.collect()) == {False: 4, True: 1}
    sample, report = S.sample_to_targets(df, plans.where("false"), targets.where("false"))
    assert sample.count() == 0 and report.count() == 0


def test_too_many_plans(spark, monkeypatch):
    monkeypatch.setattr(S, "MAX_TARGETS", 2)
    plans = spark.createDataFrame([(k, 5) for k in range(3)], "plan_id int, sample_size long")
    rows = spark.read.parquet("/root/testdata/sf0.001/primer_records.parquet")
    targets = spark.read.parquet("/root/testdata/sf0.001/sample_targets.parquet").limit(1)
    with pytest.raises(ValueError, match="plans"):
        S.sample_to_targets(rows, plans, targets)


def test_many_signatures():
    rng = random.Random(6)
    stock = {frozenset(k for k in range(60) if rng.random() < 0.1): rng.randrange(1, 400) for _ in range(600)}
    wishes, floors = {k: rng.randrange(0, 900) for k in range(60)}, {k: rng.randrange(0, 9) for k in range(60)}
    began = time.time()
    got = S.swap_repair(stock, wishes, floors, 9000, random.Random(1))
    assert sum(got.values()) == 9000 and time.time() - began < 60


def test_small_cells_are_not_emptied():
    """A cell that wishes 9 of 95 keeps them though a large one of the same size could use the places."""
    stock = {frozenset([0]): 2000, frozenset([1]): 95, frozenset([0, 2]): 40}
    got = S.swap_repair(stock, {0: 1100, 1: 9, 2: 30}, {}, 1000, random.Random(1))
    assert got[frozenset([1])] >= 7


def test_too_many_signatures(spark, monkeypatch):
    _, df, plans, targets, _ = data(spark)
    monkeypatch.setattr(S, "MAX_SIGNATURES", 2)
    with pytest.raises(ValueError, match="combinations"):
        S.sample_to_targets(df, plans, targets)
