"""Reading level of each document (problem 7).

Method: a graph joins each document to nodes for its words, the lengths of its words
and of its sentences.  Graded documents are clamped to their grade, and difficulty
spreads by harmonic iterations: a node takes the weighted mean of its documents, a document
without a grade that of its nodes, until the free documents rest.  Then every document, also a
graded one, is read off from its nodes with its own share taken out, one mean for each kind of
node; a robust fit over all graded documents weighs the three kinds, and the medians of
the grades put the result on the scale of ``grade``.

Scale: word nodes are hash classes, ``NODES`` in all, so the table of nodes has a fixed size
(4 MB) whatever the vocabulary, and is the only thing that the driver gathers and sends out.
Texts are read once; the clamped documents' share of the node table is summed once, and an
iteration is a pass over the node numbers of the free documents alone, without a shuffle but
for one row for each node and task.  Repeated deliveries are found by their ids before texts are read.

Defined results for odd input: null, blank and wordless texts have a null level; a null or
impossible grade (outside ``low``..``high``) leaves a document free; very long texts are read
whole; a delivery that occurs twice counts once; with no graded document every level is
null; an empty table gives an empty table; texts in hidden, look-alike or wrongly decoded
characters are read in their normal form; extra columns are not read.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import checkpointed
from .encoding import _SUSPECT, LetterModel, fit_letter_model, repair
from .lookalikes import normal_form

NODES = 1 << 18
#: Node numbers of sentence lengths, word lengths, words.
KINDS = (0, 64, 128, NODES)
#: The iterations end when no node's level moves by REST any more; if that takes more than ROUNDS, a warning says so.
ROUNDS, REST = 60, 0.01
#: Repeated deliveries whose ids are sent to every task; more are met by a shuffle.
MAX_REPEATED = 1_000_000
PRIOR = 5.0
_WORD = re.compile(r"[^\W\d_]+")
_STOP = re.compile(r"[.!?…]+(?=[\s»\"”)]|$)")


def nodes_of(text: str | None, model: LetterModel | None = None) -> tuple[list[int], list[int]]:
    """Node numbers and counts of a text."""
    if not text:
        return [], []
    if model is not None and _SUSPECT.search(text):
        text = repair(text, model)[2] or text
    words: list[str] = []
    lengths: Counter[int] = Counter()
    for sentence in _STOP.split(normal_form(text).lower()):
        if found := _WORD.findall(sentence):
            words += found
            lengths[min(len(found), 63)] += 1
    counts = Counter(words)
    by_length: Counter[int] = Counter()
    hashed: Counter[int] = Counter()
    for w, n in counts.items():
        by_length[64 + min(len(w), 63)] += n
        hashed[128 + crc32(w.encode()) % (NODES - 128)] += n
    all_ = [*lengths.items(), *by_length.items(), *hashed.items()]
    return [k for k, _ in all_], [n for _, n in all_]


def _flat(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document index, node and count of every edge in a batch."""
    size = b["nodes"].map(len).to_numpy()
    if not size.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.repeat(np.arange(len(b)), size), np.concatenate(b["nodes"].to_list()).astype(np.int64), np.concatenate(b["counts"].to_list()).astype(float)


def _levels(b: pd.DataFrame, sums: np.ndarray, weights: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """For each document of a batch and kind of node the mean level of its nodes, without its own share."""
    doc, node, n = _flat(b)
    y = b["y"].to_numpy(float)
    own = np.nan_to_num(y)[doc] * n
    has = ~np.isnan(y)[doc]
    s, w = sums[node] - np.where(has, own, 0), weights[node] - np.where(has, n, 0)
    kind = np.searchsorted(KINDS, node, "right") - 1
    value = (s + PRIOR * mean[kind]) / (np.maximum(w, 0) + PRIOR)
    use = np.where(w > 0.5, n, 0)
    at = doc * 3 + kind
    size = 3 * len(b)
    total = np.bincount(at, use, size)
    return np.where(total > 0, np.bincount(at, use * value, size) / np.maximum(total, 1e-9), np.nan).reshape(len(b), 3)


class _Graph:
    """The node table on the driver: two arrays of ``NODES`` numbers."""

    def __init__(self, sums: np.ndarray, weights: np.ndarray):
        self.sums, self.weights = sums, weights
        self.mean = np.array([sums[a:b].sum() / max(weights[a:b].sum(), 1e-9) for a, b in zip(KINDS, KINDS[1:])])

    @classmethod
    def gather(cls, docs: DataFrame, before: _Graph | None) -> _Graph:
        """Node sums of clamped documents, or of free ones at the level that a graph gives them."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums, weights = np.zeros(NODES), np.zeros(NODES)
            for b in batches:
                if before is not None:
                    b = b.assign(y=_blend(_levels(b, before.sums, before.weights, before.mean)))
                b = b[b["y"].notna()]
                doc, node, n = _flat(b)
                y = b["y"].to_numpy(float)
                sums += np.bincount(node, n * y[doc], NODES)
                weights += np.bincount(node, n, NODES)
            k = np.flatnonzero(weights)
            yield pd.DataFrame({"node": k.astype(np.int32), "s": sums[k], "w": weights[k]})

        got = docs.mapInPandas(run, "node int, s double, w double").groupBy("node").agg(F.sum("s").alias("s"), F.sum("w").alias("w")).toPandas()
        sums, weights = np.zeros(NODES), np.zeros(NODES)
        sums[got["node"]], weights[got["node"]] = got["s"], got["w"]
        return cls(sums, weights)

    def __add__(self, other: _Graph) -> _Graph:
        return _Graph(self.sums + other.sums, self.weights + other.weights)


def _blend(levels: np.ndarray) -> np.ndarray:
    """Mean of the kinds that a document has."""
    has = ~np.isnan(levels)
    return np.where(has.any(1), np.nansum(levels, 1) / np.maximum(has.sum(1), 1), np.nan)


def reading_levels(docs: DataFrame, words: DataFrame | None = None, id_col: str = "rec_id", text_col: str = "text", grade_col: str = "grade", low: int = 1, high: int = 11, rounds: int = ROUNDS) -> DataFrame:
    """(id, grade, level): the level that each text demands, on the scale of the grade (not cut off at its ends).

    ``words`` (column ``word``) teaches the repair of wrongly decoded texts; without it they are read as they are.
    """
    model = fit_letter_model(words) if words is not None else None
    id_type = dict(docs.dtypes)[id_col]
    given = F.col(grade_col).cast("int")
    read = _once(docs.select(F.col(id_col).alias("id"), given.alias("grade"), F.col(text_col).alias("text")))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [nodes_of(t, model) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "grade": b["grade"], "nodes": [x for x, _ in got], "counts": [x for _, x in got]})

    rows = read.mapInPandas(features, f"id {id_type}, grade int, nodes array<int>, counts array<int>")
    rows = checkpointed(rows.withColumn("y", F.when(F.col("grade").between(low, high), F.col("grade").cast("double"))))
    clamped, free_rows = _Graph.gather(rows.where("y is not null"), None), rows.where("y is null")
    graph, moved = clamped, np.inf
    for _ in range(rounds):
        after = clamped + _Graph.gather(free_rows, graph)
        both = (after.weights > 0) & (graph.weights > 0)
        moved = np.abs(after.sums[both] / after.weights[both] - graph.sums[both] / graph.weights[both]).max(initial=0)
        same, graph = (after.weights > 0).sum() == (graph.weights > 0).sum(), after
        if same and moved < REST:
            break
    else:
        warnings.warn(f"the levels still move by {moved:.3f} after {rounds} iterations", stacklevel=2)
    free = {"sums": graph.sums, "weights": graph.weights, "mean": graph.mean}

    def read_off(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            e = _levels(b, **free)
            yield pd.DataFrame({"id": b["id"], "grade": b["grade"], "y": b["y"], "e0": e[:, 0], "e1": e[:, 1], "e2": e[:, 2]})

    off = rows.mapInPandas(read_off, f"id {id_type}, grade int, y double, e0 double, e1 double, e2 double")
    off = off.select("id", "grade", "y", *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("e0", "e1", "e2")))
    off = checkpointed(off)
    beta = _robust_fit(off)
    if beta is None:
        return off.select(F.col("id").alias(id_col), "grade", F.lit(None).cast("double").alias("level"))
    raw = off.withColumn("raw", sum((F.coalesce(F.col(c), F.lit(float(m))) * F.lit(float(x)) for c, m, x in zip(("e0", "e1", "e2"), free["mean"], beta)), F.lit(float(beta[3]))))
    raw = raw.withColumn("raw", F.when(F.col("e0").isNotNull() | F.col("e2").isNotNull(), F.col("raw")))
    medians = raw.where("y is not null and raw is not null").groupBy("y").agg(F.percentile_approx("raw", 0.5, 10_000).alias("m")).orderBy("y").collect()
    return raw.select(F.col("id").alias(id_col), "grade", _scale(medians).alias("level"))


def _once(rows: DataFrame) -> DataFrame:
    """One row for each id, of which there may be equal rows; only ids are compared, and only repeated rows move.

    Rows with a null id stay as they are.
    """
    repeated = checkpointed(rows.where("id is not null").groupBy("id").count().where("count > 1").select("id"))
    few = F.broadcast(repeated) if repeated.count() <= MAX_REPEATED else repeated
    copies = rows.join(few, "id", "left_semi").groupBy("id").agg(*(F.first(c).alias(c) for c in rows.columns if c != "id"))
    return rows.join(few, "id", "left_anti").unionByName(copies)


def _robust_fit(off: DataFrame, width: float = 3.0, steps: int = 5):
    """Least squares of the grade on the three means over all graded documents, again without those far off."""
    x = [F.col("e0"), F.col("e1"), F.col("e2"), F.lit(1.0)]
    known = off.where("y is not null and e0 is not null and e1 is not null and e2 is not null")
    beta = None
    for _ in range(steps):
        use = known if beta is None else known.where(F.abs(F.col("y") - sum((c * float(b) for c, b in zip(x, beta)), F.lit(0.0))) < width)
        cells = [F.sum(x[i] * x[j]).alias(f"a{i}{j}") for i in range(4) for j in range(i, 4)] + [F.sum(x[i] * F.col("y")).alias(f"b{i}") for i in range(4)]
        r = use.agg(F.count("*").alias("n"), *cells).first()
        if not r.n:
            return beta
        a = np.array([[r[f"a{min(i, j)}{max(i, j)}"] for j in range(4)] for i in range(4)])
        beta = np.linalg.lstsq(a + 1e-9 * np.eye(4) * max(r.n, 1), np.array([r[f"b{i}"] for i in range(4)]), rcond=None)[0]
    return beta


def _scale(medians: list):
    """Piecewise linear map from the medians of the grades to the grades, carried on beyond both ends."""
    points: list[tuple[float, float]] = []
    for r in medians:
        if not points or r.m > points[-1][0] + 1e-6:
            points.append((r.m, float(r.y)))
    raw = F.col("raw")
    if len(points) < 2:
        return F.when(raw.isNotNull(), F.lit(points[0][1]) if points else F.lit(None).cast("double"))
    out = None
    for (a, g), (b, h) in zip(points, points[1:]):
        line = F.lit(g) + (raw - F.lit(a)) * F.lit((h - g) / (b - a))
        out = line if out is None else F.when(raw >= F.lit(a), line).otherwise(out)
    return out


def misgraded(levels: DataFrame, by: float = 4.5, low: int = 1, high: int = 11, id_col: str = "rec_id") -> DataFrame:
    """Deliveries whose text is at least five whole grades easier or harder than their grade.

    Levels are estimates on a continuous scale; half a grade short of five rounds to five.
    """
    return levels.where(F.col("grade").between(low, high) & (F.abs(F.col("level") - F.col("grade")) >= by)).select(id_col)
