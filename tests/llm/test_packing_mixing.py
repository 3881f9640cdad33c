import random

import pytest

from slovomer.llm import mixing as M
from slovomer.llm import packing as P
from slovomer.llm.sizes import sized


@pytest.mark.parametrize("seed", range(12))
def test_pack(seed):
    rng = random.Random(seed)
    cap = rng.choice([1, 7, 100, 512])
    sizes = [rng.randrange(0, cap + 1) if rng.random() < 0.8 else 0 for _ in range(rng.randrange(0, 300))]
    bins = P.pack(sizes, cap)
    load, large = {}, {}
    for s, b in zip(sizes, bins):
        load[b] = load.get(b, 0) + s
        large[b] = large.get(b, 0) + (3 * s > cap)
    assert len(bins) == len(sizes) and all(b >= 0 for b in bins) and all(x <= cap for x in load.values())
    first_fit = []
    for s in sorted(sizes, reverse=True):
        k = next((i for i, x in enumerate(first_fit) if x + s <= cap), None)
        if k is None:
            first_fit.append(s)
        else:
            first_fit[k] += s
    assert len(load) <= 1.2 * len(first_fit) + 1


def test_flight_keeps_totals():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 10, 500):
        items = [(k, rng.randrange(1, 1000), 0.37) for k in range(n)]
        out = M.flight(items, rng)
        assert sorted(x[0] for x in out) == list(range(n)) and sum(0 < x[2] < 1 for x in out) <= 2
        assert sum(x[2] for x in out) == pytest.approx(0.37 * n, abs=1e-6) and sum(x[1] * x[2] for x in out) == pytest.approx(sum(0.37 * x[1] for x in items), abs=1e-3)


def test_flight_keeps_expectations():
    rng = random.Random(2)
    items = [(k, s, 0.4) for k, s in enumerate([5, 1, 9, 3, 3, 7])]
    hits = [0.0] * 6
    for _ in range(4000):
        for i, _, x in M.flight(items, rng):
            hits[i] += x
    assert all(abs(h / 4000 - 0.4) < 0.04 for h in hits)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = [(k, "слово " * rng.randrange(0, 60), rng.choice(["a", "a", "a", "b", "c", None])) for k in range(400)] + [(900, None, "b"), (901, "", None), (902, "x " * 5000, "c")]
    return sized(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_containers(spark, docs):
    specs = spark.createDataFrame([(1, None, 100), (2, "a", 64), (2, "a", 64), (3, "nix", 10), (4, "b", None), (5, "b", 0)], "spec_id int, source string, capacity long")
    rows = {r.id: r for r in docs.collect()}
    for shard in (10**6, 50):
        got = P.pack_containers(docs, specs, shard).collect()
        for spec, cap, mine in ((1, 100, list(rows)), (2, 64, [i for i, r in rows.items() if r.source == "a"])):
            parts, load = {}, {}
            for r in got:
                if r.spec_id == spec:
                    parts.setdefault(r.doc_id, []).append(r)
                    load[r.container] = load.get(r.container, 0) + r.size
            assert sorted(parts) == sorted(mine) and all(x <= cap for x in load.values())
            for i, ps in parts.items():
                assert sum(p.size for p in ps) == rows[i].size and sorted(p.part for p in ps) == list(range(ps[0].parts)) and (len(ps) > 1) == (rows[i].size > cap)
        assert {r.spec_id for r in got} == {1, 2}
    c = P.pack_containers(docs, specs)
    assert sorted(tuple(r) for r in P.split_documents(c).collect()) == sorted((s, i) for s, cap, src in ((1, 100, None), (2, 64, "a")) for i, r in rows.items() if r.size > cap and (src is None or r.source == src))
    assert P.container_fill(c).where("spec_id = 1").first().used > 0.9
    assert P.pack_containers(docs.where("false"), specs).count() == 0 and P.pack_containers(docs, specs.where("false")).count() == 0


def test_mix(spark, docs):
    plans = spark.createDataFrame([(1, 9000), (2, None), (3, 20)], "mix_id int, budget_tokens long")
    targets = spark.createDataFrame([(1, "a", 0.3, 1), (1, "a", 0.3, 1), (1, "b", 0.3, 9), (1, "nix", 0.1, 2), (1, None, 0.1, 1), (1, "c", None, 1), (2, "a", 1.0, 1), (3, "a", 1.0, None)], "mix_id int, source string, weight double, max_uses int")
    w = M.wanted(docs, plans, targets)
    size = {}
    for r in docs.collect():
        size[r.source] = size.get(r.source, 0) + r.size
    for shard in (10**6, 40):
        uses = M.mix_sources(docs, w, shard=shard)
        rows = uses.collect()
        assert all(1 <= r.uses <= {"a": 1, "b": 9}[r.source] for r in rows if r.mix_id == 1)
        rep = {(r.mix_id, r.source): r for r in M.mix_report(uses, w).collect()}
        a, b = rep[1, "a"], rep[1, "b"]
        assert a.wanted_tokens == pytest.approx(0.3 / 0.8 * 9000) and a.reached == (a.wanted_tokens <= size["a"])
        assert abs(a.given_tokens - min(a.wanted_tokens, size["a"])) <= 120 and abs(b.given_tokens - min(b.wanted_tokens, 9 * size["b"])) <= 120
        assert not rep[1, "nix"].reached and not rep[1, None].reached and (1, "c") not in rep and (2, "a") not in rep and rep[3, "a"].reached
    assert M.mix_sources(docs.where("false"), w.where("false")).count() == 0


def test_landing_has_the_least_error():
    rng = random.Random(8)
    for _ in range(200):
        items = [(0, 50, 1.0), *((k, rng.randrange(1, 400), rng.random()) for k in (1, 2)), (3, 7, 0.0)]
        out = M.land(items, rng)
        want = sum(s * p for _, s, p in items)
        errors = [abs(50 + items[1][1] * a + items[2][1] * b - want) for a in (0, 1) for b in (0, 1)]
        assert {x[2] for x in out} <= {0.0, 1.0} and abs(sum(s * p for _, s, p in out) - want) == pytest.approx(min(errors))


def test_sources_with_a_large_document(spark):
    """A document of half a source can't spoil its tokens."""
    rng = random.Random(4)
    rows = [(k, "a", rng.randrange(50, 400)) for k in range(150)] + [(999, "a", 30_000)]
    docs = spark.createDataFrame(rows, "id long, source string, size long")
    total = sum(r[2] for r in rows)
    for part in (0.3, 0.55, 0.8):
        plans = spark.createDataFrame([(1, int(part * total))], "mix_id int, budget_tokens long")
        targets = spark.createDataFrame([(1, "a", 1.0, 1)], "mix_id int, source string, weight double, max_uses int")
        w = M.wanted(docs, plans, targets)
        uses = M.mix_sources(docs, w)
        r = M.mix_report(uses, w).first()
        assert abs(r.given_tokens - r.wanted_tokens) < 0.03 * r.wanted_tokens and r.most_uses == 1 and uses.count() == r.documents
