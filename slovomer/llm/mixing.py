"""Mixing sources to target weights (problem 9).

Method: cube-method balanced sampling.  A source that must give T tokens of the S it
has uses each document floor(T / S) times and draws the rest: all its documents start
with the inclusion probability (T / S) mod 1, and the flight phase moves three of them
at a time along the null space of the two constraints (number of documents, tokens)
until one is decided, so both totals stay what they are.  It runs in shards; the two
documents that each leaves undecided fly again together, by source, and the last two
land where the source's tokens, then its number of documents, come nearest to what they should be.

Documents above ``LARGE`` of what their source has to give are decided first, in the same way; the
others then share what is left, so a large document that ends in or out is made up for by many
small ones and a source misses its tokens by half of ``LARGE`` at most, unless it has only large documents.

Defined results for odd input: a null or non-positive weight, or a null budget, asks for nothing; a
null ``max_uses`` sets no cap; a null source of a target names no documents; null texts
have size 0; a source without documents gives none and is reported as not reached;
copies of a target row count once; empty tables give empty results.
"""

from __future__ import annotations

import random
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed

SHARD = 20_000
MAX_TARGETS = 100_000
#: Share of a source's tokens from which a document is decided before the others.
LARGE = 0.02


def flight(items: list[tuple[int, int, float]], rng: random.Random) -> list[tuple[int, int, float]]:
    """Cube flight over (index, size, probability): all come back, decided (0 or 1) but for two at most.

    Each step moves three items along (t2 - t3, t3 - t1, t1 - t2), which changes neither the
    sum of probabilities nor that of sizes, to one of the two ends, with the odds that keep
    every expected value.
    """
    done, pool = [], []
    for item in items:
        if 1e-9 < item[2] < 1 - 1e-9:
            pool.append(item)
        else:
            done.append((item[0], item[1], float(round(item[2]))))
        while len(pool) == 3:
            (a, s, p), (b, t, q), (c, u, r) = pool
            v = (t - u, u - s, s - t)
            if v == (0, 0, 0):
                v = (1, -1, 0)
            up, down = 1e18, 1e18
            for x, d in zip((p, q, r), v):
                if d > 0:
                    up, down = min(up, (1 - x) / d), min(down, x / d)
                elif d < 0:
                    up, down = min(up, x / -d), min(down, (1 - x) / -d)
            step = up if rng.random() * (up + down) < down else -down
            pool = []
            for i, size, x, d in ((a, s, p, v[0]), (b, t, q, v[1]), (c, u, r, v[2])):
                x += step * d
                if 1e-9 < x < 1 - 1e-9:
                    pool.append((i, size, x))
                else:
                    done.append((i, size, float(round(x))))
    return done + pool


def land(items: list[tuple[int, int, float]], rng: random.Random) -> list[tuple[int, int, float]]:
    """Decides what a flight has left, two items at most: of all ways the one with the least error in tokens, then in documents, then any."""
    open_ = [k for k, x in enumerate(items) if 0 < x[2] < 1]
    tokens, number = sum(items[k][1] * items[k][2] for k in open_), sum(items[k][2] for k in open_)
    best = min(
        product((0.0, 1.0), repeat=len(open_)),
        key=lambda way: (round(abs(sum(items[k][1] * x for k, x in zip(open_, way)) - tokens), 6), round(abs(sum(way) - number), 6), rng.random()),
    )
    told = dict(zip(open_, best))
    return [(i, s, told.get(k, p)) for k, (i, s, p) in enumerate(items)]


def wanted(sizes: DataFrame, plans: DataFrame, targets: DataFrame) -> DataFrame:
    """What each target asks for and how it can be met, one row for each target with a positive wish.

    mix_id, source, wanted_tokens, has_tokens, has_docs, max_uses, full_uses (each document at
    least so often), p (chance of one use more), reached.
    """
    t = targets.select("mix_id", "source", F.col("weight").cast("double").alias("weight"), "max_uses").distinct()
    if t.limit(MAX_TARGETS + 1).count() > MAX_TARGETS:
        raise ValueError("too many targets to broadcast")
    sums = t.where("weight > 0").groupBy("mix_id").agg(F.sum("weight").alias("weights"))
    asked = t.where("weight > 0").join(F.broadcast(sums), "mix_id").join(F.broadcast(plans.where("budget_tokens is not null").groupBy("mix_id").agg(F.max("budget_tokens").alias("budget_tokens"))), "mix_id")
    has = sizes.where("source is not null").groupBy("source").agg(F.sum("size").alias("has_tokens"), F.count("*").alias("has_docs"))
    rate = F.try_divide("wanted_tokens", "has_tokens")
    return (
        asked.select("mix_id", "source", (F.col("weight") / F.col("weights") * F.col("budget_tokens")).alias("wanted_tokens"), "max_uses")
        .join(has, "source", "left")
        .fillna(0, ["has_tokens", "has_docs"])
        .withColumn("reached", F.coalesce(~(F.col("wanted_tokens") > F.col("max_uses") * F.col("has_tokens")), F.col("has_tokens") > 0))
        .withColumn("rate", F.least(F.coalesce(rate, F.lit(0.0)), F.coalesce(F.col("max_uses").cast("double"), rate, F.lit(0.0))))
        .withColumn("full_uses", F.floor("rate").cast("int"))
        .withColumn("p", F.col("rate") - F.col("full_uses"))
        .drop("rate")
    )


def mix_sources(sizes: DataFrame, wishes: DataFrame, seed: int = 7, shard: int = SHARD) -> DataFrame:
    """The uses of documents: mix_id, source, doc_id, size, uses (> 0).

    ``sizes`` is (id, source, size), see ``sized``; ``wishes`` comes from ``wanted``.  Only ids and sizes move.
    """
    keys = ["mix_id", "source"]
    asked = wishes.where("has_docs > 0").select(*keys, "full_uses", "p", (F.col("p") * F.col("has_tokens")).alias("due"), F.ceil(F.col("has_docs") / F.lit(shard)).cast("int").alias("shards"))
    items = sizes.join(F.broadcast(asked), "source").withColumn("shard", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("shards")).cast("int"))
    is_large = (F.col("p") > 0) & (F.col("size") > F.lit(LARGE) * F.col("due"))
    id_type, mix_type = dict(sizes.dtypes)["id"], dict(wishes.dtypes)["mix_id"]
    schema = f"mix_id {mix_type}, source string, id {id_type}, size bigint, full_uses int, p double"

    def fly(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
        rng = random.Random(repr((seed, *key)))
        order = list(range(len(pdf)))
        rng.shuffle(order)
        size, p = pdf["size"].tolist(), pdf["p"].tolist()
        for i, _, x in flight([(i, size[i], p[i]) for i in order], rng):
            p[i] = x
        return pdf.assign(p=p)[["mix_id", "source", "id", "size", "full_uses", "p"]]

    def last(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
        rng = random.Random(repr((seed, "last", *key)))
        size, p = pdf["size"].tolist(), pdf["p"].tolist()
        for i, _, x in land(flight([(i, size[i], p[i]) for i in range(len(pdf))], rng), rng):
            p[i] = x
        return pdf.assign(p=p)[["mix_id", "source", "id", "size", "full_uses", "p"]]

    def decide(items: DataFrame) -> DataFrame:
        # the first flight is kept, so the second sees the same undecided ones and it isn't run twice
        flown = checkpointed(items.groupBy("mix_id", "source", "shard").applyInPandas(fly, schema))
        open_ = "p > 0 and p < 1"
        return flown.where(f"not ({open_})").unionByName(flown.where(open_).groupBy("mix_id", "source").applyInPandas(last, schema))

    large = checkpointed(decide(items.where(is_large)))
    taken = large.groupBy(*keys).agg(F.sum(F.col("size") * F.col("p")).alias("taken"))
    rest = items.where(~is_large)
    left = rest.groupBy(*keys).agg(F.sum("size").alias("size"), F.max("due").alias("due")).join(taken, keys, "left")  # a row for each target
    chance = F.coalesce(F.least(F.greatest(F.try_divide(F.col("due") - F.coalesce("taken", F.lit(0.0)), F.col("size").cast("double")), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    rest = rest.drop("p").join(F.broadcast(left.select(*keys, chance.alias("p"))), keys)
    uses = large.unionByName(decide(rest))
    return uses.select("mix_id", "source", F.col("id").alias("doc_id"), "size", (F.col("full_uses") + F.col("p").cast("int")).alias("uses")).where("uses > 0")


def mix_report(uses: DataFrame, wishes: DataFrame) -> DataFrame:
    """For each target: wanted and given tokens and shares, documents, uses, and whether the wish can be reached."""
    given = uses.groupBy("mix_id", "source").agg(F.sum(F.col("size") * F.col("uses")).alias("given_tokens"), F.count("*").alias("documents"), F.max("uses").alias("most_uses"))
    r = wishes.join(given, ["mix_id", "source"], "left").fillna(0, ["given_tokens", "documents", "most_uses"])
    w = Window.partitionBy("mix_id")  # a plan's targets, a few rows
    return r.select("mix_id", "source", "wanted_tokens", "given_tokens", F.try_divide("wanted_tokens", F.sum("wanted_tokens").over(w)).alias("wanted_share"), F.try_divide(F.col("given_tokens").cast("double"), F.sum("given_tokens").over(w)).alias("given_share"), "documents", "most_uses", "max_uses", "reached")


def unreached_targets(report: DataFrame) -> DataFrame:
    """Targets that the mix gives less than they want, of these the ones that no mix could reach."""
    return report.where("given_tokens < wanted_tokens and not reached").select("mix_id", "source")
