"""Per-document text quality statistics and structural profiles (problem 6).

Method: every line of a text becomes a distribution over character classes and
signs of structure (item markers, gaps, leaders, repeated words, function words).
Jensen-Shannon divergence compares it with the profiles of prose, one for each language
or script that the collection holds, of prose garbled by a wrong encoding, and of lists, tables,
indexes and junk; the nearest profile is the line's, and the profile of most of a text's
visible characters the text's.  Basic counts come along.

The profiles are fitted first, to the lines of ``FIT_DOCUMENTS`` documents (about as many, by
a hash of the id): clean lines with function words of a language give its prose, the same lines
put through pairs of encodings the garbled ones, and lines of a plain shape the structures.  A profile
of which fewer than ``FIT_LINES`` lines are found stays as it is in ``PROFILES``.

Defined results for odd input: null and blank texts get zero counts, null ratios and
the profile ``blank``; a text with signs but no letter in a word is ``signs``; very
long texts are read whole (memory is linear in one text); repeated rows are
judged each on its own; an empty table gives an empty table; only the id and text
columns are read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookalikes import _FORMS, _TOUCHED

CLASSES = ("vowel", "consonant", "letter", "capital", "digit", "space", "stop", "comma", "quote", "dash", "symbol", "separator", "marker", "gap", "leader", "repeat", "function", "unspaced")
_K = {c: k for k, c in enumerate(CLASSES)}
N_CHAR = 12  # the first twelve are classes of characters

#: Documents to which the profiles are fitted, about, and lines that a profile needs.
FIT_DOCUMENTS, FIT_LINES = 5_000, 30
# Profiles to start from, as shares over CLASSES in order.
PROFILES: dict[str, tuple[float, ...]] = {
    "garbled cp1251 as koi8_u": (0.0259, 0.0343, 0.0, 0.7965, 0.0004, 0.1148, 0.0099, 0.0073, 0.0, 0.0007, 0.0034, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0067, 0.0),
    "garbled cp866 as cp1251": (0.0625, 0.2014, 0.0, 0.2149, 0.0029, 0.1986, 0.0158, 0.0058, 0.0564, 0.0013, 0.1807, 0.0, 0.0, 0.0, 0.0, 0.0188, 0.0408, 0.0),
    "garbled koi8_u as cp1251": (0.0047, 0.0123, 0.0, 0.8367, 0.0032, 0.1169, 0.0125, 0.0069, 0.0002, 0.0009, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0001, 0.0054, 0.0),
    "garbled utf_8 as cp1251": (0.0592, 0.1222, 0.0, 0.5046, 0.002, 0.0749, 0.0094, 0.0033, 0.0325, 0.0024, 0.0943, 0.0, 0.0, 0.0, 0.0, 0.0464, 0.0489, 0.0),
    "garbled utf_8 as cp1252": (0.0328, 0.0827, 0.0, 0.3506, 0.0852, 0.0707, 0.0102, 0.0052, 0.0375, 0.003, 0.1924, 0.0, 0.0, 0.0, 0.0, 0.1195, 0.0103, 0.0),
    "index": (0.0897, 0.1289, 0.0, 0.0034, 0.0609, 0.0582, 0.3786, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.2793, 0.0009, 0.0, 0.0),
    "letters": (0.0, 0.9193, 0.0, 0.0, 0.0, 0.0807, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    "list": (0.1453, 0.2076, 0.0, 0.0031, 0.0273, 0.0595, 0.0061, 0.0058, 0.0127, 0.0137, 0.0104, 0.0, 0.5067, 0.0008, 0.0, 0.0008, 0.0001, 0.0),
    "menu": (0.1681, 0.1757, 0.0, 0.0649, 0.0122, 0.1331, 0.0, 0.0, 0.0608, 0.0, 0.0, 0.0, 0.0, 0.3651, 0.0, 0.0201, 0.0, 0.0),
    "numbers": (0.0047, 0.0074, 0.0, 0.0, 0.422, 0.2119, 0.0002, 0.0094, 0.0068, 0.0065, 0.0086, 0.0096, 0.0269, 0.2859, 0.0, 0.0, 0.0, 0.0),
    "prose": (0.3309, 0.446, 0.0003, 0.0137, 0.0033, 0.1125, 0.0126, 0.0078, 0.0007, 0.0037, 0.0008, 0.0001, 0.0, 0.0, 0.0, 0.0007, 0.067, 0.0),
    "prose_uncased": (0.0001, 0.0, 0.6441, 0.0055, 0.0176, 0.1765, 0.0281, 0.002, 0.001, 0.0, 0.0002, 0.0, 0.0, 0.0, 0.0, 0.0107, 0.1141, 0.0),
    "prose_unspaced": (0.0, 0.0, 0.8738, 0.0, 0.0119, 0.0073, 0.0666, 0.0275, 0.0116, 0.0, 0.0001, 0.0, 0.0, 0.0, 0.0, 0.0001, 0.0011, 0.0),
    "references": (0.1155, 0.1235, 0.0, 0.0817, 0.216, 0.1089, 0.0544, 0.0544, 0.0, 0.0272, 0.0, 0.0, 0.0, 0.0, 0.1633, 0.0159, 0.0391, 0.0),
    "repetition": (0.1454, 0.169, 0.0622, 0.0127, 0.0028, 0.1378, 0.0031, 0.0005, 0.0117, 0.0, 0.0, 0.0, 0.0, 0.0696, 0.0, 0.379, 0.0063, 0.0),
    "symbols": (0.0, 0.0003, 0.0, 0.0001, 0.0071, 0.0611, 0.0972, 0.0, 0.0, 0.0, 0.7494, 0.045, 0.0392, 0.0008, 0.0, 0.0, 0.0, 0.0),
    "table": (0.0885, 0.1292, 0.0, 0.0025, 0.2065, 0.0843, 0.0, 0.0288, 0.0, 0.004, 0.0, 0.065, 0.0, 0.3903, 0.0, 0.0009, 0.0, 0.0),
    "unspaced_run": (0.0414, 0.159, 0.0, 0.1982, 0.0842, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0162, 0.0, 0.0, 0.0, 0.0, 0.0005, 0.0016, 0.499),
}
PROSE_PREFIXES = ("prose", "garbled")
_STOPS = (*".!?…։。！？؟।»”“」\"",)


@cache
def _classes() -> np.ndarray:
    """Class of each code point below 0x30000, 255 for none."""
    table = np.full(0x30000, _K["letter"], np.uint8)
    vowels = set("аеёиоуыэюяіїєaeiouyäöüàáâãåèéêëìíîïòóôõùúûýÿαεηιουω")
    stops, commas, quotes, dashes, seps = set(".!?…։。！？؟।"), set(",;:，、；："), set("\"'«»„“”‘’()[]「」『』"), set("-—–‐"), set("\t|")
    for cp in range(0x30000):
        c = chr(cp)
        cat = unicodedata.category(c) if cp < 0x3400 or 0xA000 <= cp < 0xAC00 or 0xF900 <= cp < 0x10000 else "Lo"
        if c in stops:
            k = "stop"
        elif c in commas:
            k = "comma"
        elif c in seps:
            k = "separator"
        elif c in quotes:
            k = "quote"
        elif c in dashes:
            k = "dash"
        elif c in "  　" or cat == "Zs":
            k = "space"
        elif cat == "Lu":
            k = "capital"
        elif cat[0] == "L":
            k = "vowel" if c in vowels else "consonant" if cp < 0x530 else "letter"
        elif cat[0] == "M":
            k = "letter"
        elif cat[0] == "N":
            k = "digit"
        elif cat in ("Cf", "Cn", "Cs", "Co") or c in "\n\r":
            k = None
        else:
            k = "symbol"
        table[cp] = 255 if k is None else _K[k]
    return table


_WORD = re.compile(r"[^\W\d_]+")
_MARKER = re.compile(r"[ \t]*(?:\d{1,3}[).]|[-•*·▪◦‣–]|[^\W\d_]\))[ \t]+\S")
_GAP = re.compile(r"(?<=\S)(?: {3,}|\t+| [|»] )(?=\S)")
_LEADER = re.compile(r"[.·_]{4,}|(?:\. ){3,}")
_REFERENCE = re.compile(r"\d[–-]\d")
_SCRIPTS = {"kana": "\u3040-\u30ff", "han": "\u3400-\u9fff", "thai": "\u0e00-\u0e7f", "devanagari": "\u0900-\u097f", "arabic": "\u0600-\u06ff", "georgian": "\u10a0-\u10ff", "armenian": "\u0530-\u058f"}
_SCRIPT = {k: re.compile(f"[{v}]") for k, v in _SCRIPTS.items()}
_UNSPACED = re.compile(r"[A-Za-z0-9+/=]{24,}")


def line_table(text: str, common: frozenset[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of CLASSES in each line, and the lines' visible characters and (words, their letters, common ones, ends in a stop)."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _classes()
    kinds = table[np.minimum(codes, len(table) - 1)]
    lines = text.split("\n")
    n = len(lines)
    at = np.repeat(np.arange(n), [len(x) + 1 for x in lines])[: len(codes)]
    seen = kinds < N_CHAR
    counts = np.zeros((n, len(CLASSES)))
    counts[:, :N_CHAR] = np.bincount(at[seen] * N_CHAR + kinds[seen], minlength=n * N_CHAR).reshape(n, N_CHAR)
    marker, gap, leader, repeat, function, unspaced = (_K[x] for x in ("marker", "gap", "leader", "repeat", "function", "unspaced"))
    basics = np.zeros((n, 4), np.int64)
    for k, line in enumerate(lines):
        if not line:
            continue
        row = counts[k]
        words = _WORD.findall(line.lower())
        if words:
            if f := sum(map(common.__contains__, words)):
                row[function] = 2 * f
            if r := sum(map(eq, words, words[1:])):
                row[repeat] = 4 * r
            basics[k] = len(words), sum(map(len, words)), f, line.rstrip()[-1:] in _STOPS
        if _MARKER.match(line):
            row[marker] = 12
        if "   " in line or "\t" in line or " | " in line or " » " in line:
            row[gap] = 6 * len(_GAP.findall(line))
        if "..." in line or "···" in line or "___" in line or ". . ." in line:
            row[leader] = 12 * len(_LEADER.findall(line))
        if "–" in line or "-" in line:
            row[leader] += 6 * len(_REFERENCE.findall(line))
        if len(line) >= 24 and " " not in line and line.isascii() and (m := _UNSPACED.fullmatch(line.strip())):
            row[unspaced] = m.end()
    visible = counts[:, :N_CHAR].sum(1) - counts[:, _K["space"]]
    return counts, visible, basics


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence (bits) of each row of p from each row of q: H((p + q) / 2) - (H(p) + H(q)) / 2."""
    m = (p[:, None, :] + q[None, :, :]) / 2
    return _plogp(p)[:, None] / 2 + _plogp(q)[None, :] / 2 - _plogp(m)


def _plogp(p: np.ndarray) -> np.ndarray:
    return (p * np.log2(np.maximum(p, 1e-12))).sum(-1)


@cache
def _profiles() -> tuple[list[str], np.ndarray]:
    return list(PROFILES), np.array(list(PROFILES.values()))


Profiles = tuple[list[str], np.ndarray]


def measure_many(texts: list[str | None], common: frozenset[str], fitted: Profiles | None = None) -> list[tuple]:
    """For each text: characters, words, lines, mean word length, symbol ratio, stop-line share, common share,
    digit share, divergence from the nearest prose profile, share of structure, profile."""
    out: list[tuple] = [(len(t or ""), 0, 0, None, None, None, None, None, None, None, "blank") for t in texts]
    told = [k for k, t in enumerate(texts) if t and not t.isspace()]
    if not told:
        return out
    shown = [texts[k] if texts[k].isascii() or not _TOUCHED.search(texts[k]) else texts[k].translate(_FORMS) for k in told]
    counts, visible, basics = line_table("\n".join(shown), common)
    first = np.cumsum([0, *(t.count("\n") + 1 for t in shown[:-1])])
    names, profiles = fitted or _profiles()
    prose = np.array([x.startswith(PROSE_PREFIXES) for x in names])
    sums = np.maximum(counts.sum(1), 1)
    nearest = np.concatenate([divergence(counts[k : k + 4096] / sums[k : k + 4096, None], profiles).argmin(1) for k in range(0, len(counts), 4096)])
    weight = np.zeros((len(counts), len(names)))
    weight[np.arange(len(counts)), nearest] = visible
    weight = np.add.reduceat(weight, first)
    total, chars = np.add.reduceat(counts, first), np.add.reduceat(visible, first)
    lines, basic = np.add.reduceat(visible > 0, first, dtype=np.int64), np.add.reduceat(basics, first)
    far = divergence(total / np.maximum(total.sum(1), 1)[:, None], profiles[prose]).min(1)
    structure = 1 - weight[:, prose].sum(1) / np.maximum(chars, 1)
    best_prose, best_other = np.where(prose, weight, -1).argmax(1), np.where(prose, -1, weight).argmax(1)
    whole = np.maximum(total[:, :N_CHAR].sum(1), 1)
    letters = total[:, [_K[x] for x in ("vowel", "consonant", "letter", "capital")]].sum(1)
    for i, k in enumerate(told):
        if not chars[i]:
            continue
        n_words, n_letters, n_common, stops = map(int, basic[i])
        share, profile = float(structure[i]), names[int((best_other if structure[i] > 0.5 else best_prose)[i])]
        if not letters[i]:
            share, profile = 1.0, "signs"
        out[k] = (len(texts[k]), n_words, int(lines[i]), n_letters / n_words if n_words else None, float((total[i, _K["symbol"]] + total[i, _K["separator"]]) / whole[i]), stops / int(lines[i]),
                  n_common / n_words if n_words else None, float(total[i, _K["digit"]] / whole[i]), float(far[i]), share, profile)
    return out


def measure(text: str | None, common: frozenset[str]) -> tuple:
    return measure_many([text], common)[0]


#: Characters of texts measured together.
TOGETHER = 1 << 19


STATISTICS = "chars int, words int, lines int, mean_word_length double, symbol_ratio double, stop_line_share double, common_share double, digit_share double, divergence double, structure_share double, profile string"


def words_by_language(common_words: DataFrame) -> dict[str, frozenset[str]]:
    """Function words of each language (``""`` if the table has no ``lang``); more than 100,000 are refused."""
    lang = F.coalesce("lang", F.lit("")) if "lang" in common_words.columns else F.lit("")
    rows = common_words.where("word is not null").select(F.lower("word").alias("w"), lang.alias("lang")).distinct().limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("the list of common words is too long for the driver")
    return {x: frozenset(r.w for r in rows if r.lang == x) for x in sorted({r.lang for r in rows})}


def quality_statistics(docs: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text", fitted: Profiles | None = None) -> DataFrame:
    """One row of statistics and a structural profile for each document; row-local, no shuffle.

    ``common_words`` (columns ``word`` and, if it has one, ``lang``) is a short fixed list; ``fitted`` comes
    from ``fit_profiles``, which runs over ``docs`` if it isn't given.
    """
    languages = words_by_language(common_words)
    common = frozenset().union(*languages.values())
    if fitted is None:
        fitted = fit_profiles(docs, languages, id_col, text_col)
    id_type = dict(docs.dtypes)[id_col]
    names = [x.split()[0] for x in STATISTICS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, out, at, size = list(b["text"]), [], 0, 0
            for k, t in enumerate(texts):
                size += len(t or "")
                if size > TOGETHER or k == len(texts) - 1:
                    out += measure_many(texts[at : k + 1], common, fitted)
                    at, size = k + 1, 0
            table = pd.DataFrame(out, columns=names)
            table.insert(0, "id", b["id"].to_numpy())
            yield table

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {id_type}, {STATISTICS}").withColumnRenamed("id", id_col)


def mostly_structure(statistics: DataFrame) -> DataFrame:
    """Documents that are for the most part a list, a table or junk."""
    return statistics.where("structure_share > 0.5")


#: Encodings (written in, read as) through which clean lines are put to see what garbled prose is like.
GARBLINGS = (("utf-8", "cp1251"), ("utf-8", "cp1252"), ("koi8-u", "cp1251"), ("cp1251", "koi8-u"), ("cp866", "cp1251"))


def _shape(k: dict[str, float], v: float) -> str | None:
    """What a line is by its plain shape; "prose" for a line that has none and is long enough, None for no clear one."""
    letters = k["vowel"] + k["consonant"] + k["letter"] + k["capital"]
    if k["unspaced"] >= 24:
        return "unspaced_run"
    if k["repeat"] > max(12, 0.5 * v):
        return "repetition"
    if letters < 0.35 * v and k["digit"] > 0.5 * v:
        return "numbers"
    if letters < 0.35 * v and k["symbol"] > 0.3 * v:
        return "symbols"
    if k["gap"] >= 12:
        return "table" if k["digit"] > 0.1 * v else "menu"
    if k["leader"] >= 12:
        return "index"
    if k["leader"] >= 6 and k["digit"] > 0.15 * v:
        return "references"
    if k["marker"] and v < 60:
        return "list"
    if v > 20 and letters > 0.8 * v and k["vowel"] + k["letter"] == 0 and k["consonant"] > 0.8 * v:
        return "letters"
    if k["letter"] > 0.5 * v:
        return "prose_unspaced" if k["space"] < 0.08 * v else "prose_uncased"
    return "prose" if v > 20 and k["symbol"] < 0.05 * v and k["capital"] < 0.2 * v else None


def _spoken(line: str, shape: str, languages: dict[str, frozenset[str]]) -> str | None:
    """The language of a line of prose by its function words, if one has most and two at least, or its script."""
    if shape != "prose":
        found = {x: len(p.findall(line)) for x, p in _SCRIPT.items()}
        best = max(found, key=found.get)
        return "kana" if best == "han" and found["kana"] else best if found[best] else None
    words = set(_WORD.findall(line.lower()))
    hits = sorted(((len(words & known), x) for x, known in languages.items()), reverse=True)
    return hits[0][1] if hits and hits[0][0] >= 2 and (len(hits) < 2 or hits[0][0] > hits[1][0]) else None


def labelled_lines(text: str, languages: dict[str, frozenset[str]], common: frozenset[str]) -> Iterator[tuple[str, np.ndarray]]:
    """(label, shares over CLASSES) of the lines of a text that have a clear one, and of its clean prose lines as they look garbled."""
    counts, visible, _ = line_table(text, common)
    lines = text.split("\n")
    told: list[tuple[str, str]] = []
    for line, c, v in zip(lines, counts, visible):
        shape = _shape(dict(zip(CLASSES, c)), v) if v else None
        if shape is None:
            continue
        if not shape.startswith("prose"):
            yield shape, c / c.sum()
        elif spoken := _spoken(line, shape, languages):
            yield shape, c / c.sum()
            yield f"prose {spoken}", c / c.sum()
            if shape == "prose" and _CYRILLIC.search(line):
                for written, shown in GARBLINGS:
                    told.append((f"garbled {written.replace('-', '_')} as {shown.replace('-', '_')}", line.encode(written, "replace").decode(shown, "replace").replace("\n", " ")))
    if told:
        counts, visible, _ = line_table("\n".join(x for _, x in told), common)
        for (label, _), c, v in zip(told, counts, visible):
            if v:
                yield label, c / c.sum()


_CYRILLIC = re.compile("[а-яё]")


def fit_profiles(docs: DataFrame, languages: dict[str, frozenset[str]], id_col: str = "doc_id", text_col: str = "text", documents: int = FIT_DOCUMENTS, least: int = FIT_LINES) -> Profiles:
    """Names and shares of the profiles of a collection: sums of labelled lines, one row for each label and task."""
    common = frozenset().union(*languages.values())
    one_in = max(1, round(docs.count() / documents))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text in b["text"]:
                for label, shares in labelled_lines(text, languages, common):
                    a = sums.setdefault(label, np.zeros(len(CLASSES) + 1))
                    a[:-1] += shares
                    a[-1] += 1
        yield pd.DataFrame([(k, int(a[-1]), a[:-1].tolist()) for k, a in sums.items()], columns=["label", "n", "shares"])

    chosen = docs.where(F.pmod(F.xxhash64(id_col), F.lit(one_in)) == 0).select(F.col(text_col).alias("text")).where(F.col("text").rlike("\\S"))
    found = chosen.mapInPandas(run, "label string, n bigint, shares array<double>").groupBy("label").agg(F.sum("n").alias("n"), *(F.sum(F.get("shares", F.lit(k))).alias(f"s{k}") for k in range(len(CLASSES)))).collect()
    profiles = dict(PROFILES)
    for r in sorted(found, key=lambda r: r.label):
        if r.n >= least:
            profiles[r.label] = tuple(r[f"s{k}"] / r.n for k in range(len(CLASSES)))
    return list(profiles), np.array(list(profiles.values()))
