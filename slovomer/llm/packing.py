"""Filling fixed-capacity containers with items (problem 8).

Method: large-item matching.  A document above the capacity is split into full
containers and a rest.  Items above a third of the capacity go at most two to a
container: from the largest down, each is matched with the largest other that still
fits.  The smaller ones follow, best fit first, into the gaps that are left.

Scale: a plan's documents are spread by a hash of their id over shards of about
``SHARD`` items, each packed by one task from (id, size) alone; a shard leaves at most
one poorly filled container, so the loss is a container in some tens of thousands.

Defined results for odd input: a null text or size 0 takes no room and is placed
in a container like any item; a null or non-positive capacity gives no containers; a
null source of a plan takes all documents; a plan that occurs twice is taken once;
documents without a source belong only to plans of all documents; equal rows are
separate items; empty tables give empty results.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items that one task packs, about.
SHARD = 40_000
#: Plans that are broadcast, at most.
MAX_SPECS = 10_000


def pack(sizes: list[int], capacity: int) -> list[int]:
    """Container number of each item; none may exceed the capacity."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bins, gap = [-1] * len(sizes), []
    large = [i for i in order if 3 * sizes[i] > capacity]
    # ascending (size, item) of the large items not yet placed
    free = sorted((sizes[i], i) for i in large)
    for i in large:
        if bins[i] >= 0:
            continue
        at = bisect_left(free, (sizes[i], i))
        del free[at]
        left = capacity - sizes[i]
        bins[i] = len(gap)
        k = bisect_left(free, (left + 1, -1)) - 1
        if k >= 0:
            size, j = free.pop(k)
            bins[j] = len(gap)
            left -= size
        gap.append(left)
    gaps = sorted((g, b) for b, g in enumerate(gap) if g)
    for i in order:
        if bins[i] >= 0:
            continue
        size = sizes[i]
        k = bisect_left(gaps, (size, -1))
        if k < len(gaps):
            left, b = gaps.pop(k)
        elif size == 0 and gap:
            bins[i] = len(gap) - 1
            continue
        else:
            left, b = capacity, len(gap)
            gap.append(capacity)
        bins[i] = b
        if left - size:
            insort(gaps, (left - size, b))
    return bins


def pack_containers(sizes: DataFrame, specs: DataFrame, shard: int = SHARD) -> DataFrame:
    """Containers with their documents: spec_id, container, doc_id, part, parts, size, capacity.

    ``sizes`` is (id, source, size), see ``sized``; ``specs`` (spec_id, source, capacity).
    """
    specs = specs.select("spec_id", "source", "capacity").where("capacity > 0").distinct()
    if specs.limit(MAX_SPECS + 1).count() > MAX_SPECS:
        raise ValueError("too many container plans to broadcast")
    keyed = specs.select("spec_id", F.col("capacity").cast("bigint").alias("capacity"), F.struct(F.col("source").isNull().alias("whole"), F.coalesce("source", F.lit("")).alias("name")).alias("of"))
    # a document has two keys, its source and "all documents", so plans meet it in an equi-join
    all_key, own_key = F.struct(F.lit(True).alias("whole"), F.lit("").alias("name")), F.struct(F.lit(False).alias("whole"), F.col("source").alias("name"))
    docs = sizes.select("id", "size", F.explode(F.when(F.col("source").isNull(), F.array(all_key)).otherwise(F.array(all_key, own_key))).alias("of"))
    items = docs.join(F.broadcast(keyed), "of").select("spec_id", "capacity", "id", "size", F.greatest(F.ceil(F.col("size") / F.col("capacity")), F.lit(1)).cast("int").alias("parts"))
    # the number of shards comes from the rows of each key, a small table
    counts = docs.groupBy("of").count()
    shards = keyed.join(counts, "of").select("spec_id", F.ceil(F.col("count") / F.lit(shard)).cast("int").alias("shards"))
    items = items.join(F.broadcast(shards), "spec_id").withColumn("shard", F.pmod(F.xxhash64("id", "spec_id"), F.col("shards")).cast("int"))
    id_type = dict(sizes.dtypes)["id"]
    spec_type = dict(specs.dtypes)["spec_id"]
    schema = f"spec_id {spec_type}, container string, doc_id {id_type}, part int, parts int, size bigint, capacity bigint"

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        capacity = int(pdf["capacity"].iloc[0])
        rows, full = [], []
        for i, size, parts in zip(pdf["id"], pdf["size"], pdf["parts"]):
            for p in range(parts - 1):
                full.append((i, p, parts, capacity))
            rows.append((i, parts - 1, parts, size - (parts - 1) * capacity))
        bins = pack([r[3] for r in rows], capacity)
        base = max(bins, default=-1) + 1
        out = [(key[0], f"{key[1]}-{b}", *r, capacity) for b, r in zip(bins, rows)]
        out += [(key[0], f"{key[1]}-{base + k}", *r, capacity) for k, r in enumerate(full)]
        return pd.DataFrame(out, columns=["spec_id", "container", "doc_id", "part", "parts", "size", "capacity"])

    return items.groupBy("spec_id", "shard").applyInPandas(fill, schema)


def container_fill(containers: DataFrame) -> DataFrame:
    """For each plan: containers, documents, tokens, and the share of the room that is used."""
    bins = containers.groupBy("spec_id", "container").agg(F.sum("size").alias("size"), F.max("capacity").alias("capacity"), F.count("*").alias("pieces"))
    return bins.groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("size").alias("tokens"), F.sum("capacity").alias("room"), F.max("size").alias("fullest")).withColumn("used", F.try_divide("tokens", "room"))


def split_documents(containers: DataFrame) -> DataFrame:
    """Documents larger than their plan's capacity: (spec_id, doc_id), one row each."""
    return containers.where("parts > 1 and part = 0").select("spec_id", "doc_id")
