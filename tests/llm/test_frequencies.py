import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from slovomer.llm import frequencies as Q


def brute(texts, pattern=Q.TERM):
    n, d = Counter(), Counter()
    for t in texts:
        terms = re.findall(pattern, (t or "").lower())
        n.update(terms)
        d.update(set(terms))
    return {t: (n[t], d[t]) for t in n}


def test_terms_and_bands(spark):
    rng = random.Random(2)
    texts = [None, "", "Дом дом ДОМ", "x-ray 5 ёж Ёж"] + [" ".join(rng.choice(["и", "лес", f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}"]) for _ in range(30)) for _ in range(60)] + ["и " * 50_000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "term long, text string")  # the id's name clashes with the result's
    want = brute(texts)
    for kw in ({}, {"flush": 50, "split_rows": 200, "partitions": 2}):
        got = {r.term: (r.n, r.docs) for r in Q.term_frequencies(df, **kw).collect()}
        assert got == want
    n = len([t for t in texts if t is not None])
    marked = {r.term: r.band for r in Q.marked_terms(Q.bands(Q.term_frequencies(df), df)).collect()}
    assert marked == {t: "rare" if d < 3 else "common" for t, (_, d) in want.items() if d < 3 or d > 0.3 * n}


def test_values_and_empty(spark):
    df = spark.createDataFrame([("А",), ("а",), ("А",), (None,)], "v string")
    assert {r.term: r.n for r in Q.value_frequencies(df, "v").collect()} == {"А": 2, "а": 1}
    assert Q.term_frequencies(df.where("false"), "v").count() == 0


@pytest.mark.parametrize("shared", ["hdfs://name/shared", "s3a://bucket/x"])
def test_spills_without_a_shared_file_system(tmp_path, monkeypatch, shared):
    monkeypatch.setenv("SPARK_LOCAL_DIRS", f"{tmp_path},/other")
    assert Q._spill_folder(shared) == str(tmp_path) and Q._spill_folder("file:///a/b") == "/a/b"
    rows = pa.RecordBatch.from_pydict({"term": [f"{'слово' * 8}{k % 300_000}" for k in range(600_000)], "n": [1] * 600_000, "docs": [1] * 600_000})
    got = pa.Table.from_batches(list(Q._aggregate(shared, 50_000_000, "64MB")(iter([rows]))))
    assert got.num_rows == 300_000 and set(got["n"].to_pylist()) == {2} and not list(tmp_path.iterdir())


def test_partitions_of_unknown_input(spark):
    """Rows that don't come from files have no size to go by."""
    df = spark.createDataFrame([(k, "дом лес") for k in range(9)], "doc_id long, text string")
    assert Q._input_bytes(df) < Q.UNKNOWN_BYTES and Q.term_frequencies(df).rdd.getNumPartitions() <= 4
