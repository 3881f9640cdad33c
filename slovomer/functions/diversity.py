"""Lexical diversity of a list of words: fourteen measures.

Measures that follow from word frequencies are aggregations (``operators.diversity``);
here is the row-local form, one vectorised pass over each list: words become numbers
once, and all measures share the frequencies and the previous occurrences.
"""

from __future__ import annotations

from math import log10, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

MEASURES = ("ttr", "rttr", "cttr", "httr", "sttr", "mttr", "dttr", "mattr", "msttr", "mtld", "mamtld", "hdd", "simpson_index", "hapax_index")
FULL_FACTOR = 0.72
WINDOW, SEGMENT, MIN_LEN, SAMPLE = 50, 50, 10, 42


def _quotient(a: float, b: float, default: float = 0.0) -> float:
    return a / b if b else default


def codes_of(words) -> np.ndarray:
    return pd.factorize(np.asarray(words, dtype=object), use_na_sentinel=False)[0] if len(words) else np.zeros(0, np.int64)


def previous(codes: np.ndarray) -> np.ndarray:
    """Position of the last occurrence of the same word before each position, -1 for none."""
    order = np.argsort(codes, kind="stable")
    out = np.full(len(codes), -1, np.int64)
    same = codes[order[1:]] == codes[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def _mattr(prev: np.ndarray, n: int, types: int, window: int) -> float:
    if n < window + 1:
        return _quotient(types, n)
    at = np.arange(n)
    # windows that start after the previous occurrence and hold the position count its word anew
    seen = np.minimum(at, n - window) - np.maximum(np.maximum(prev + 1, at - window + 1), 0) + 1
    return float(np.maximum(seen, 0).sum() / (window * (n - window + 1)))


def _msttr(prev: np.ndarray, n: int, types: int, segment: int) -> float:
    if n < segment + 1:
        return _quotient(types, n)
    full = n // segment * segment
    at = np.arange(full)
    return float((prev[:full] < at // segment * segment).sum() / full)


def _mtld_one_way(prev: np.ndarray, min_len: int) -> float:
    n, factors, start, types = len(prev), 0.0, 0, 0
    if not n:
        return 0.0
    for k, p in enumerate(prev.tolist()):
        types += p < start
        size = k + 1 - start
        if k + 1 == n:
            factors += (1 - types / size) / (1 - FULL_FACTOR)
        elif size >= min_len and types / size < FULL_FACTOR:
            factors, start, types = factors + 1, k + 1, 0
    return _quotient(n, factors)


def _mamtld_one_way(prevs: list[np.ndarray], min_len: int) -> np.ndarray:
    """For each of many lists: all their starts grow together, so short lists share the cost of a step."""
    sizes = np.array([len(p) for p in prevs], np.int64)
    first = np.cumsum(sizes) - sizes
    factors, total = np.zeros(len(prevs)), np.zeros(len(prevs))
    prev = np.concatenate([np.where(p < 0, -1, p + f) for p, f in zip(prevs, first)]) if len(prevs) else np.zeros(0, np.int64)
    start = np.arange(len(prev))
    doc = np.repeat(np.arange(len(prevs)), sizes)
    end, types, size = (first + sizes)[doc], np.zeros(len(prev), np.int64), 0
    while len(start):
        at = start + size
        keep = at < end  # a start that has reached the end of its list has no factor
        if not keep.all():
            start, doc, end, types, at = start[keep], doc[keep], end[keep], types[keep], at[keep]
            if not len(start):
                break
        types += prev[at] < start
        size += 1
        if size >= min_len:
            done = types / size < FULL_FACTOR
            if done.any():
                found = np.bincount(doc[done], minlength=len(prevs))
                factors += found
                total += found * size
                left = ~done
                start, doc, end, types = start[left], doc[left], end[left], types[left]
    return np.where(factors > 0, total / np.maximum(factors, 1), 1.0)


def mtld_of(codes: np.ndarray, min_len: int = MIN_LEN) -> float:
    return (_mtld_one_way(previous(codes), min_len) + _mtld_one_way(previous(codes[::-1]), min_len)) / 2


def mamtld_of(codes: np.ndarray, min_len: int = MIN_LEN) -> float:
    return float((_mamtld_one_way([previous(codes)], min_len) + _mamtld_one_way([previous(codes[::-1])], min_len))[0] / 2)


def hdd_of(freq: np.ndarray, n: int, sample: int = SAMPLE) -> float:
    if n < 50:
        return -1.0
    if sample <= 0 or sample > n:
        return 0.0
    f, many = np.unique(freq, return_counts=True)
    i = np.arange(sample)
    absent = (np.maximum(n - f[:, None] - i, 0) / (n - i)).prod(1)
    return float(((1 - absent) / sample * many).sum())


def measures(words, window: int = WINDOW, segment: int = SEGMENT, min_len: int = MIN_LEN, sample: int = SAMPLE) -> tuple[float, ...]:
    """All measures of a word list, in the order of ``MEASURES``."""
    return measures_many([words], window, segment, min_len, sample)[0]


#: Words of lists whose moving-average factors are grown together.
TOGETHER = 1 << 19


def measures_many(lists, window: int = WINDOW, segment: int = SEGMENT, min_len: int = MIN_LEN, sample: int = SAMPLE, only: tuple[str, ...] = MEASURES) -> list[tuple[float, ...]]:
    """The measures in ``only`` of each word list, in its order; what they don't need isn't computed."""
    out: list[tuple[float, ...]] = []
    group: list = []
    size = 0
    both = "mtld" in only or "mamtld" in only
    for k, words in enumerate(lists):
        group.append(words)
        size += len(words)
        if size > TOGETHER or k == len(lists) - 1:
            codes = [codes_of(w) for w in group]
            prev = [previous(c) for c in codes] if both or "mattr" in only or "msttr" in only else codes
            back = [previous(c[::-1]) for c in codes] if both else codes
            moving = ((_mamtld_one_way(prev, min_len) + _mamtld_one_way(back, min_len)) / 2).tolist() if "mamtld" in only else [0.0] * len(group)
            for c, p, q, m in zip(codes, prev, back, moving):
                told = _measures(c, p, q, m, window, segment, min_len, sample, only)
                out.append(tuple(told[x] for x in only))
            group, size = [], 0
    return out


def _measures(codes: np.ndarray, prev: np.ndarray, back: np.ndarray, moving: float, window: int, segment: int, min_len: int, sample: int, only: tuple[str, ...]) -> dict[str, float]:
    n = len(codes)
    freq = np.bincount(codes) if n else np.zeros(0, np.int64)
    v = len(freq)
    ln, lv = (log10(n), log10(v)) if n else (0.0, 0.0)
    rare = _quotient(int((freq == 1).sum()), v)
    out = {
        "ttr": _quotient(v, n),
        "rttr": _quotient(v, sqrt(n)),
        "cttr": _quotient(v, sqrt(2 * n)),
        "httr": _quotient(lv, ln),
        "sttr": 0.0 if n <= 1 or v <= 1 or not log10(ln) else log10(lv) / log10(ln),
        "mttr": _quotient(ln - lv, ln**2),
        "dttr": _quotient(ln**2, ln - lv),
        "mamtld": moving,
        "simpson_index": _quotient(n * (n - 1), int((freq * (freq - 1)).sum())),
        "hapax_index": _quotient(100 * ln, 1 - rare),
    }
    if "mattr" in only:
        out["mattr"] = _mattr(prev, n, v, window)
    if "msttr" in only:
        out["msttr"] = _msttr(prev, n, v, segment)
    if "mtld" in only:
        out["mtld"] = (_mtld_one_way(prev, min_len) + _mtld_one_way(back, min_len)) / 2
    if "hdd" in only:
        out["hdd"] = hdd_of(freq, n, sample)
    return out


def diversity_udf(window: int = WINDOW, segment: int = SEGMENT, min_len: int = MIN_LEN, sample: int = SAMPLE, only: tuple[str, ...] = MEASURES):
    """Array of words to a struct of the measures in ``only``, all fourteen by default; null for a null list."""

    @F.pandas_udf(", ".join(f"{m} double" for m in only))
    def run(lists: pd.Series) -> pd.DataFrame:
        given = [w for w in lists if w is not None]
        told = iter(measures_many(given, window, segment, min_len, sample, only))
        none = (None,) * len(only)
        return pd.DataFrame([none if w is None else next(told) for w in lists], columns=list(only))

    return run
