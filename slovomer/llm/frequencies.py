"""Frequency of every distinct value or term (problem 4).

Method: recursive radix spilling.  The terms of each partition of the table are
counted as they are read, then partitioned by bits of their hash to disk (the
shuffle); each radix partition is aggregated out of core by DuckDB, which splits a
partition that is still too large by further bits of the hash and works the parts
off one by one.

Scale: what is shuffled is one row for each term and task, not for each occurrence; a
term that a third of all rows hold still is one row for each task.  No term list ever
is whole in one task or on the driver.

Defined results for odd input: null and empty texts have no term, and null texts don't
count as documents; very long texts are cut into terms whole; equal rows count each;
an empty table gives an empty table.  Terms are runs of ``[a-zа-яё]`` in the lower-cased
raw text; other patterns and plain values can be counted instead.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

TERM = "[a-zа-яё]+"
RARE_DOCUMENTS, COMMON_SHARE = 3, 0.3
#: Distinct terms that a task counts in memory before it passes them on.
FLUSH_TERMS = 400_000
#: Rows from which a radix partition is split further, and the bits of one split.
SPLIT_ROWS, SPLIT_BITS = 2_000_000, 4
MEMORY = "256MB"
#: Bytes of input for one radix partition, and how many there are at most.
BYTES, MAX_PARTITIONS = 1 << 30, 50_000
#: An estimate from here on says that the optimizer knows no size.
UNKNOWN_BYTES = 1 << 55


def _finder(pattern: str) -> Callable[[str], list[str]]:
    matches = re.compile(pattern).findall
    return lambda text: matches(text.lower())


def _count(find: Callable[[str], list[str]], flush: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        docs: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            terms = list(total)
            batch = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([total[t] for t in terms], pa.int64()), pa.array([docs[t] for t in terms], pa.int64())], ["term", "n", "docs"])
            total.clear()
            docs.clear()
            return batch

        for b in batches:
            for text in b.column(0).to_pylist():
                if text:
                    terms = find(text)
                    total.update(terms)
                    docs.update(set(terms))
                    if len(total) > flush:
                        yield out()
        if total:
            yield out()

    return run


def _spill_folder(shared: str) -> str:
    """Where a task may spill: the shared folder if it is a file system, else the executor's own folders for spills, as Spark's shuffle does."""
    if shared.startswith("file:") or "://" not in shared:
        return re.sub("^file:(//)?", "", shared)
    for name in ("SPARK_LOCAL_DIRS", "LOCAL_DIRS"):
        if folders := os.environ.get(name):
            return folders.split(",")[0]
    return os.getcwd()


def _aggregate(folder: str, split_rows: int, memory: str):
    """Sums of one radix partition, out of core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        spill = os.path.join(_spill_folder(folder), f"radix-{uuid.uuid4().hex}")
        db = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": spill})
        try:
            db.execute("create table part (term varchar, n bigint, docs bigint)")
            rows = 0
            for b in batches:
                if b.num_rows:
                    arrived = pa.Table.from_batches([b])  # noqa: F841 (DuckDB reads it by name)
                    db.execute("insert into part select * from arrived")
                    rows += b.num_rows

            def sums(table: str, size: int, shift: int) -> Iterator[pa.RecordBatch]:
                if size <= split_rows or shift >= 60:
                    with db.cursor() as reader:  # its result stays open while other parts are made
                        yield from reader.sql(f"select term, sum(n)::bigint n, sum(docs)::bigint docs from {table} group by term").to_arrow_reader(100_000)
                    return
                for k in range(1 << SPLIT_BITS):
                    name = f"{table}_{k}"
                    db.execute(f"create table {name} as select * from {table} where (hash(term) >> {shift}) & {(1 << SPLIT_BITS) - 1} = {k}")
                    part = db.execute(f"select count(*) from {name}").fetchall()[0][0]
                    yield from sums(name, part, shift + SPLIT_BITS if part < size else 60)
                    db.execute(f"drop table {name}")

            if rows:
                for b in sums("part", rows, 0):
                    yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1).cast(pa.int64()), b.column(2).cast(pa.int64())], ["term", "n", "docs"])
        finally:
            db.close()
            shutil.rmtree(spill, ignore_errors=True)

    return run


def _input_bytes(rows: DataFrame) -> int:
    """The optimizer's estimate of a table's size; 0 where it has none, as for rows that don't come from files."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < UNKNOWN_BYTES else 0


def term_frequencies(docs: DataFrame, text_col: str = "text", pattern: str | Callable[[str], list[str]] = TERM, partitions: int | None = None, flush: int = FLUSH_TERMS, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(term, n, docs): how often each term occurs, and in how many rows.

    ``pattern`` is matched against the lower-cased text, or is a function from the text to its terms.
    """
    find = _finder(pattern) if isinstance(pattern, str) else pattern
    spark = docs.sparkSession
    schema = "term string, n bigint, docs bigint"
    counted = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null").mapInArrow(_count(find, flush), schema)
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), min(_input_bytes(docs) // BYTES, MAX_PARTITIONS))
    radix = counted.repartition(n, F.shiftrightunsigned(F.xxhash64("term"), 40))
    return radix.mapInArrow(_aggregate(shared_folder(spark), split_rows, MEMORY), schema)


def value_frequencies(rows: DataFrame, col: str, **kw) -> DataFrame:
    """(term, n, docs) of the whole values of a column: n and docs are equal."""
    return term_frequencies(rows.select(F.col(col).cast("string").alias("text")), "text", lambda value: [value], **kw)


def bands(terms: DataFrame, docs: DataFrame, text_col: str = "text", rare: int = RARE_DOCUMENTS, common: float = COMMON_SHARE) -> DataFrame:
    """Adds ``band``: rare (in fewer than ``rare`` documents), common (in more than the share ``common`` of those with a text), or useful."""
    n = docs.agg(F.count(F.col(text_col))).scalar()
    return terms.withColumn("band", F.when(F.col("docs") < rare, "rare").when(F.col("docs") > n * F.lit(common), "common").otherwise("useful"))


def marked_terms(banded: DataFrame) -> DataFrame:
    return banded.where("band <> 'useful'").select("term", "band")


