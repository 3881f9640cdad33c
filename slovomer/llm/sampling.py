"""Sample matching target category proportions (problem 1).

Method: swap repair.  Records are grouped by category signature, the set of target
cells that they lie in.  A random sample that keeps the wished minimum of every
cell (as far as there are records) is the start; then counts are exchanged between
signatures while that lowers the deviation from the targets (squared, each in units of what the
target wishes, so small cells aren't emptied for large ones), and at last each
signature's count is materialised by a random draw of its records.  The report counts
the drawn records.

Scale: labels and years are first reduced to those that the targets tell apart, so the
number of signatures is bounded by the targets, not by the records (more than
``MAX_SIGNATURES`` are refused); only their counts reach the driver.  The draw takes whole hash
bands of a signature and shuffles only the records of the one band in which its count falls.

Defined results for odd input: a null label or year lies in no cell that restricts it;
impossible years are compared as numbers; a label that reads as nothing (blank) is
null; a record is the latest row of its file by ``loaded_at`` (of several, the one with
the greatest id; null times come first); rows without a file are no records; a target
with a null share and minimum asks for nothing; a minimum above the plan's sample size is not kept, and
its target is reported as not reached; empty tables give an empty sample and
every target with a wish unmet; extra columns are not read.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import checkpointed
from .lookalikes import look, normal_form

#: Target rows that the driver reads, at most.
MAX_TARGETS = 20_000
#: Combinations of reduced labels and years whose counts the driver reads, at most.
MAX_SIGNATURES = 200_000
#: Hash bands of a signature.
BANDS = 4096
_SIGNS = re.compile(r"[\W_]+")


@lru_cache(maxsize=1 << 16)
def label_key(label: str | None) -> str | None:
    """The words of a label as they read, whatever their case, spacing, signs, ё or е, or characters."""
    if label is None:
        return None
    return _SIGNS.sub("", look(normal_form(normal_form(label).casefold()))).replace("ë", "e") or None


@F.pandas_udf(T.StringType())
def _label_key(labels: pd.Series) -> pd.Series:
    return labels.map(lambda x: label_key(x) if isinstance(x, str) else None).astype(object)


def latest_records(rows: DataFrame, file_col: str = "file", time_col: str = "loaded_at", id_col: str = "rec_id", columns: tuple[str, ...] = ("type", "year", "category")) -> DataFrame:
    """One row for each file, its latest state; one shuffle of the few columns read, combined before it."""
    order = F.struct(F.col(time_col).isNotNull().alias("known"), F.col(time_col).alias("time"), F.col(id_col).alias("id"))
    state = F.struct(F.col(id_col).alias("id"), *(F.col(c).alias(c) for c in columns))
    last = rows.where(F.col(file_col).isNotNull()).groupBy(F.col(file_col).alias("file")).agg(F.max_by(state, order).alias("s"))
    return last.select("file", F.col("s.id").alias(id_col), *(F.col(f"s.{c}").alias(c) for c in columns))


class Cells:
    """The cells of all plans, and the reduction of labels and years to what they tell apart."""

    def __init__(self, rows: list):
        self.rows = rows
        self.types = sorted({k for r in rows if (k := label_key(r.type))})
        self.categories = sorted({k for r in rows if (k := label_key(r.category))})
        cuts = {r.year_from for r in rows if r.year_from is not None} | {r.year_to + 1 for r in rows if r.year_to is not None}
        self.cuts = sorted(cuts)

    def reduced(self, records: DataFrame) -> DataFrame:
        """Adds type_key, category_key (null where no target names the label) and era (number of cuts at or before the year)."""
        era = F.when(F.col("year").isNotNull(), sum((F.when(F.col("year") >= c, 1).otherwise(0) for c in self.cuts), F.lit(0)))
        t, c = _label_key("type"), _label_key("category")
        keyed = records.withColumn("type_key", t).withColumn("category_key", c)
        return keyed.withColumn("type_key", F.when(F.col("type_key").isin(self.types), F.col("type_key"))).withColumn("category_key", F.when(F.col("category_key").isin(self.categories), F.col("category_key"))).withColumn("era", era.cast("int"))

    def holds(self, row, type_key: str | None, era: int | None, category_key: str | None) -> bool:
        if row.type is not None and (type_key is None or label_key(row.type) != type_key):
            return False
        if row.category is not None and (category_key is None or label_key(row.category) != category_key):
            return False
        if row.year_from is None and row.year_to is None:
            return True
        if era is None:
            return False
        low = -1 if row.year_from is None else self.cuts.index(row.year_from) + 1
        high = len(self.cuts) if row.year_to is None else self.cuts.index(row.year_to + 1)
        return low <= era <= high


def wish(share: float | None, size: int | None, least: int | None) -> int:
    """Records that a cell must have: its rounded share (half up), or the minimum."""
    return max(int((share or 0.0) * (size or 0) + 0.5), least or 0)


def swap_repair(stock: dict[frozenset[int], int], wishes: dict[int, int], floors: dict[int, int], size: int, rng: random.Random) -> dict[frozenset[int], int]:
    """Counts to draw of each signature (a set of targets).

    The start draws records at random for each floor, rarest cell first, then at random up to
    the size; the repair makes the exchange of records of two signatures that helps most, in the
    number of records that is best for it, until none lowers the deviation.  The deviation of n exchanged
    records is a parabola in n, so all pairs of signatures are judged at once by arrays.
    """
    size = min(size, sum(stock.values()))
    take: dict[frozenset[int], int] = defaultdict(int)
    has: dict[int, int] = defaultdict(int)
    sigs = sorted(stock, key=lambda s: (sorted(s), stock[s]))
    total = 0

    def put(s: frozenset[int], n: int) -> None:
        nonlocal total
        take[s] += n
        total += n
        for t in s:
            has[t] += n

    room = {t: sum(n for s, n in stock.items() if t in s) for t in floors}
    for t in sorted(floors, key=lambda t: (room[t], t)):
        need = min(floors[t], room[t]) - has[t]
        order = [s for s in sigs if t in s]
        rng.shuffle(order)
        for s in order:
            n = min(need, stock[s] - take[s], size - total)
            if n > 0:
                put(s, n)
                need -= n
    left = [s for s in sigs if stock[s] > take[s]]
    while total < size and left:  # at random, in proportion to what is left
        weights = [stock[s] - take[s] for s in left]
        whole, open_ = sum(weights), size - total
        for s, w in zip(left, weights):
            share = open_ * w / whole
            n = min(int(share) + (rng.random() < share % 1), w, size - total)
            if n > 0:
                put(s, n)
        left = [s for s in left if stock[s] > take[s]]
    return _repair(sigs, stock, take, has, wishes, {t: min(f, has[t]) for t, f in floors.items()})


#: Exchanges whose floors are looked at first; all others follow before the repair ends.
FIRST = 512
#: Pairs of signatures judged together.
PAIRS = 1 << 20


def _repair(sigs: list[frozenset[int]], stock: dict, take: dict, has: dict, wishes: dict[int, int], floor: dict[int, int]) -> dict[frozenset[int], int]:
    targets = sorted({*wishes, *floor, *(t for s in sigs for t in s)})
    at = {t: k for k, t in enumerate(targets)}
    holds = np.zeros((len(sigs), len(targets)), bool)
    for k, s in enumerate(sigs):
        holds[k, [at[t] for t in s]] = True
    wish = np.array([wishes.get(t, 0) for t in targets], float)
    least = np.array([floor.get(t, 0) for t in targets], float)
    now = np.array([has[t] for t in targets], float)
    weight = 1 / np.maximum(wish, 1)
    held = holds * weight
    own = held.sum(1)
    taken, left = (np.array([f(s) for s in sigs], float) for f in (lambda s: take[s], lambda s: stock[s] - take[s]))

    def limited(give: np.ndarray, get: np.ndarray) -> np.ndarray:
        """How many records each pair may exchange: what there is, and what the floors leave."""
        most = np.minimum(taken[give], left[get])
        for t in np.flatnonzero(now - least < most.max(initial=0)):
            most = np.where(holds[give, t] & ~holds[get, t], np.minimum(most, now[t] - least[t]), most)
        return most

    def judged(give: np.ndarray, get: np.ndarray, slope: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fall of the deviation, records) of the best number of records for each pair."""
        rise = slope[get] - slope[give]
        curve = own[give] + own[get] - 2 * (held[give] * holds[get]).sum(1)
        n = np.clip(np.rint(-rise / np.maximum(curve, 1e-12)), 1, np.maximum(most, 1))
        return np.where(most >= 1, -(2 * n * rise + n * n * curve), -1.0), n

    while True:
        slope = held @ (now - wish)
        givers, takers = np.flatnonzero(taken), np.flatnonzero(left)
        step = max(1, PAIRS // max(1, len(takers)))
        best = (1e-9, -1, -1, 0.0)
        for whole in (False, True):
            for k in range(0, len(givers), step):
                give, get = (x.ravel() for x in np.meshgrid(givers[k : k + step], takers, indexing="ij"))
                rise = slope[get] - slope[give]
                use = np.flatnonzero(rise < 0)  # no other exchange can help
                if not whole and len(use) > FIRST:
                    use = use[np.argpartition(rise[use], FIRST)[:FIRST]]
                give, get = give[use], get[use]
                if len(use):
                    gain, n = judged(give, get, slope, limited(give, get))
                    j = int(gain.argmax())
                    if gain[j] > best[0]:
                        best = (float(gain[j]), int(give[j]), int(get[j]), float(n[j]))
            if best[1] >= 0:
                break
        _, give, get, n = best
        if give < 0:
            return {s: int(x) for s, x in zip(sigs, taken) if x}
        for k, m in ((give, -n), (get, n)):
            taken[k] += m
            left[k] -= m
            now += m * holds[k]


def sample_to_targets(rows: DataFrame, plans: DataFrame, targets: DataFrame, seed: int = 11, keep: tuple[str, ...] = ("file", "rec_id")) -> tuple[DataFrame, DataFrame]:
    """(sample, report).

    sample: plan_id and the ``keep`` columns of the drawn records.  report: plan_id, target_id, wanted,
    available, drawn (counted in the sample), share, drawn_share, met (False where the records can't meet the
    target by themselves), reached (False where the sample doesn't, as other targets stand against it).
    """
    spark = rows.sparkSession
    plan_rows = plans.select("plan_id", "sample_size").where("plan_id is not null").distinct().limit(MAX_TARGETS + 1).collect()
    if len(plan_rows) > MAX_TARGETS:
        raise ValueError("too many plans for the driver")
    size_of = {r.plan_id: r.sample_size or 0 for r in plan_rows}
    cell_rows = targets.select("plan_id", "target_id", "type", "year_from", "year_to", "category", "share", "min_records").where("plan_id is not null and target_id is not null").distinct().limit(MAX_TARGETS + 1).collect()
    if len(cell_rows) > MAX_TARGETS:
        raise ValueError("too many targets for the driver")
    cells = Cells(cell_rows)
    signs = ["type_key", "era", "category_key"]
    records = checkpointed(cells.reduced(latest_records(rows)).select("file", "rec_id", *signs))
    counted = records.groupBy(*signs).count().limit(MAX_SIGNATURES + 1).collect()  # at most (types + 1) (eras + 1) (categories + 1) rows
    if len(counted) > MAX_SIGNATURES:
        raise ValueError("too many combinations of labels and years for the driver")
    report, quota, lies_in = [], [], []
    for plan in sorted(size_of):
        mine = [r for r in cell_rows if r.plan_id == plan]
        stock: dict[frozenset[int], int] = defaultdict(int)
        members: dict[frozenset[int], list] = defaultdict(list)
        for c in counted:
            s = frozenset(k for k, r in enumerate(mine) if cells.holds(r, c.type_key, c.era, c.category_key))
            stock[s] += c["count"]
            members[s].append(c)
        wishes = {k: int((r.share or 0.0) * size_of[plan] + 0.5) for k, r in enumerate(mine)}
        # a minimum above the size of the sample can't be kept, and would empty all other cells: the share stands alone
        floors = {k: r.min_records if (r.min_records or 0) <= size_of[plan] else 0 for k, r in enumerate(mine)}
        floors = {k: n or 0 for k, n in floors.items()}
        drawn = swap_repair(dict(stock), wishes, floors, size_of[plan], random.Random(seed * 1000 + hash(plan)))
        for number, s in enumerate(sorted(stock, key=sorted)):
            lies_in += [(plan, number, mine[k].target_id) for k in s]
            for c in members[s]:
                quota.append((plan, number, c.type_key, c.era, c.category_key, drawn.get(s, 0)))
        for k, r in enumerate(mine):
            report.append((plan, r.target_id, wish(r.share, size_of[plan], r.min_records), sum(n for s, n in stock.items() if k in s), r.share))
    quotas = spark.createDataFrame(quota, f"plan_id int, signature int, {', '.join(f'{c} {t}' for c, t in records.dtypes if c in signs)}, quota bigint").where("quota > 0")
    sample = draw(records, quotas, signs, seed)
    got = sample.groupBy("plan_id", "signature").agg(F.count("*").alias("n"))
    cell = F.broadcast(spark.createDataFrame(lies_in, "plan_id int, signature int, target_id int").distinct())  # signatures by targets, both bounded
    of_cell = got.join(cell, ["plan_id", "signature"]).groupBy("plan_id", "target_id").agg(F.sum("n").alias("drawn"))
    of_plan = got.groupBy("plan_id").agg(F.sum("n").alias("total"))
    asked = spark.createDataFrame(report, "plan_id int, target_id int, wanted bigint, available bigint, share double")
    reports = asked.join(of_cell, ["plan_id", "target_id"], "left").join(of_plan, "plan_id", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    return sample.select("plan_id", *keep), reports.select(
        "plan_id", "target_id", "wanted", "available", "drawn", "share", F.try_divide(F.col("drawn").cast("double"), F.col("total").cast("double")).alias("drawn_share"),
        (F.col("available") >= F.col("wanted")).alias("met"), (F.col("drawn") >= F.col("wanted")).alias("reached"),
    )


def draw(records: DataFrame, quotas: DataFrame, signs: list[str], seed: int) -> DataFrame:
    """For each plan and signature the quota's number of records, at random and exactly.

    Records get a random number from a hash of their file.  Bands of it below the quota are
    taken whole where they are read; only the records of the band that the quota cuts are shuffled and
    sorted: 1 / ``BANDS`` of a signature.
    """
    same = [F.col(f"q.{c}").eqNullSafe(F.col(f"r.{c}")) for c in signs]
    on: Column = same[0] & same[1] & same[2]
    chance = F.xxhash64("r.file", "q.plan_id", F.lit(seed))
    hit = records.alias("r").join(F.broadcast(quotas.alias("q")), on).select("r.file", "r.rec_id", "q.plan_id", "q.signature", "q.quota", chance.alias("chance"))
    hit = hit.withColumn("band", F.pmod("chance", F.lit(BANDS)).cast("int"))
    bands = hit.groupBy("plan_id", "signature", "band").agg(F.count("*").alias("n"), F.max("quota").alias("quota"))
    w = Window.partitionBy("plan_id", "signature").orderBy("band")  # at most BANDS rows
    last = bands.withColumn("before", F.sum("n").over(w) - F.col("n")).where("before < quota")
    last = last.groupBy("plan_id", "signature").agg(F.max_by(F.struct("band", (F.col("quota") - F.col("before")).alias("still"), "n"), "band").alias("cut"))
    joined = hit.join(F.broadcast(last), ["plan_id", "signature"])  # no more rows than quotas
    whole = joined.where("band < cut.band or band = cut.band and cut.n <= cut.still").drop("cut")
    order = Window.partitionBy("plan_id", "signature").orderBy("chance", "file")
    cut = joined.where("band = cut.band and cut.n > cut.still").withColumn("rank", F.row_number().over(order)).where("rank <= cut.still").drop("rank", "cut")
    return whole.unionByName(cut)


def unmet_targets(report: DataFrame) -> DataFrame:
    """Targets that the sample doesn't reach, of these the ones that no sample could."""
    return report.where("not reached and not met").select("plan_id", "target_id")
