"""Garbled text from a wrong character encoding (problem 10).

Method: the characters of a text are mapped back to the bytes of a legacy
encoding, an automaton over the byte structure of UTF-8 finds the maximal
well-formed multibyte spans, and only those spans are decoded.  Spans that were
mistaken for one single-byte encoding in place of another carry no byte
structure; for them the same byte mapping is followed by a letter-pair model
and the spans with the highest gain (maximal scoring run of tokens) are decoded.

Defined results for odd input: null, empty and blank texts are not garbled and
come back as they are; very long texts are processed whole, line by line;
repeated rows are judged each on its own; an empty table gives an empty table;
columns of the input beyond id and text are not read, so their names can't clash.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Legacy encodings as whose characters UTF-8 bytes may have been shown.
MULTIBYTE_SHOWN_AS = ("cp1252", "cp1251", "cp866", "koi8_u")
#: (shown as, really is) for texts of single-byte encodings.
SINGLE_BYTE_PAIRS = (
    ("cp1252", "cp1251"), ("cp1251", "koi8_u"), ("koi8_u", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1251"),
    ("cp1252", "koi8_u"), ("cp1252", "cp866"), ("koi8_u", "cp866"), ("cp866", "koi8_u"), ("cp1251", "mac_cyrillic"), ("mac_cyrillic", "cp1251"),
)
#: Gain in natural-log likelihood from which a run of tokens counts as garbled.
MIN_GAIN = 14.0

_CONT_1252 = "\u0080-\u00bf\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u203a\u20ac\u2122"
_CONT_1251 = "\u0402\u0403\u201a\u0453\u201e\u2026\u2020\u2021\u20ac\u2030\u0409\u2039\u040a-\u040c\u040f\u0452\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u2122\u0459\u203a\u045a-\u045c\u045f\u00a0\u040e\u045e\u0408\u00a4\u0490\u00a6\u00a7\u0401\u00a9\u0404\u00ab\u00ac\u00ad\u00ae\u0407\u00b0\u00b1\u0406\u0456\u0491\u00b5\u00b6\u00b7\u0451\u2116\u0454\u00bb\u0458\u0405\u0455\u0457"
_CONT_KOI8 = "\u2320\u2219\u221a\u2248\u2264\u2265\u00a0\u2321\u00b0\u00b2\u00b7\u00f7\u0451\u0454\u0456\u0457\u0491\u0401\u0404\u0406\u0407\u0490"
#: A line in which none of these is found isn't of a single-byte encoding in place of another.
_SINGLE = "|".join(
    (
        "[\u0080-\u009f\ufffd\u2500-\u259f]",  # controls, lost characters, box drawing
        f"[\u00c2-\u00f4][{_CONT_1252}]",  # a lead byte of UTF-8 shown as Latin
        "[\u00c0-\u00ff]{3}",  # letters of the upper half in a row
        f"(?:[\u0412\u0420-\u0422][{_CONT_1251}]){{2}}",  # lead bytes of UTF-8 shown as Cyrillic
        "[а-яёєї][ЁЄЇЎ√∙■°№]",  # the upper half of the DOS page
        "[¤¦®©¬§][а-яЎўЈҐЁЄЇ«\u00a0\u00ad]",
        "[а-яё][ЯЮ€][а-яё]|[а-яё]{2}€|[Ђ-Џ†‡€‰‹][а-яё]{2}",  # the Macintosh page, whose small letters are the same
        "[а-яёіїєґ][А-ЯЁІЇЄҐ]{2}",  # case turned over
        "(?:[А-ЯЁ]{2,}[ ,.!?…]+){2}[А-ЯЁ]",
    )
)
_SMALL = "[а-яёіїєґ]"
_BEYOND = "[^\\x00-\\x7f\u0410-\u044f]"
#: A text in which none of these is found can't be garbled. It runs over every text, so each alternative begins at the one class that few
#: characters are in and looks back from there; it lets through all that _SINGLE does.
SUSPECT = "[^\\x00-\\x7fа-я](?:" + "|".join(
    (
        f"(?<=[\u0080-\u009f\ufffd\u2500-\u259f])|(?<={_SMALL}[ЁЄЇЎ√∙■°№€]|в[Ђ„]|рџ)",  # controls, lost signs; the DOS page, dashes and quotes
        f"(?<={_SMALL}[ЯЮ])[а-яё]|(?<={_SMALL}[А-ЯЁІЇЄҐ])[А-ЯЁІЇЄҐ]",  # the Macintosh page, case turned over
        f"(?<=[\u00c2-\u00f4])(?:[{_CONT_1252}]|(?<=[\u00c0-\u00f4])[\u00c0-\u00ff]{{2}})|(?<=[\u00c0\u00c1\u00f5-\u00ff])[\u00c0-\u00ff]{{2}}",
        f"(?<=[\u0412\u041e-\u042b]){_BEYOND}[\u0412\u041e-\u042b]{_BEYOND}",  # Cyrillic and other scripts
        f"(?<=[\u0413-\u0418]){_BEYOND}[A-Za-z]|(?<=[A-Za-z][\u0413-\u0418]){_BEYOND}",  # a letter with an accent in a Latin word
        f"(?<=[A-Za-z][цде][{_CONT_KOI8}])|(?<=[цде][{_CONT_KOI8}])[A-Za-z]",
        f"(?<=[а-п]{_BEYOND}){_BEYOND}[а-п]{_BEYOND}{{2}}",  # other scripts
        "(?<=[¤¦®©¬§])[а-яЎўЈҐЁЄЇ«\u00a0\u00ad]|(?<=[Ђ-Џ†‡€‰‹])[а-яё]{2}",
        "(?<=[А-ЯЁ])[А-ЯЁ]+[ ,.!?…]+[А-ЯЁ]{2,}[ ,.!?…]+[А-ЯЁ]",
    )
) + ")"
_SUSPECT = re.compile(_SINGLE)


def _to_bytes(encoding: str) -> dict[int, int]:
    """Character to byte (as code points below 256); bytes the encoding leaves open stand for themselves."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            table[ord(bytes([b]).decode(encoding))] = b
        except UnicodeDecodeError:
            pass
    for b in range(0x80, 0xA0):
        table.setdefault(b, b)
    return table


class _Byteview(dict):
    """Translation table: ASCII stays, mapped characters turn into bytes, any other breaks a span."""

    def __missing__(self, key: int) -> int:
        self[key] = value = key if key < 0x80 or key == 0xFFFD else 0x2FFFF
        return value


BYTEVIEW = {e: _Byteview(_to_bytes(e)) for e in {*MULTIBYTE_SHOWN_AS, *(a for a, _ in SINGLE_BYTE_PAIRS)}}

BYTEVIEW["cp1251"][0xFFFD] = 0x98  # the one byte that cp1251 can't show

#: The UTF-8 automaton over byte values; a continuation byte that was lost shows as U+FFFD.
_SEQ = "[\xc2-\xdf][\x80-\xbf�]|\xe0[\xa0-\xbf][\x80-\xbf�]|[\xe1-\xec\xee\xef][\x80-\xbf][\x80-\xbf�]|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}"
SPAN = re.compile(f"(?:{_SEQ})+")
SEQUENCE = re.compile(_SEQ)
_HIGH = re.compile("[\x80-\xff]")


_SIGNS = "«»„“”‘’—–…№° \xa0\xad\ufffd·•₴€‚"


def _decoded(span: str) -> str:
    return span.replace("�", "\x1a").encode("latin-1").decode("utf-8", "replace").replace("\x1a", "")


_PIECE = re.compile("[^ \n]+")
_ROW = re.compile("[^\n]+")


def _within(view: str, spans: list[re.Match], pieces: re.Pattern) -> Iterator[tuple[re.Match, list[re.Match]]]:
    """Each token (or line) that holds spans, with them; one walk over the view, however long a token is."""
    k = 0
    for piece in pieces.finditer(view) if spans else ():
        inside = []
        while k < len(spans) and spans[k].start() < piece.end():
            inside.append(spans[k])
            k += 1
        if inside:
            yield piece, inside
        if k == len(spans):
            return


def _high(view: str, m: re.Match) -> int:
    return len(_HIGH.findall(view, m.start(), m.end())) - view.count("\xa0", m.start(), m.end())


def _prevailing(view: str, spans: list[re.Match]) -> set[int]:
    """Starts of the spans in tokens of whose bytes of the upper half most belong to well-formed sequences."""
    return {
        m.start()
        for piece, inside in _within(view, spans, _PIECE)
        if 1.5 * sum(m.end() - m.start() for m in inside) >= _high(view, piece)
        for m in inside
    }


def _plausible(out: str, encoding: str) -> bool:
    """What comes out is letters and typographic signs, or again what the encoding garbles."""
    again = BYTEVIEW[encoding] if encoding in ("cp1252", "cp1251") else {}
    if encoding == "cp1252":
        good = sum(c.isalpha() or c in _SIGNS or again.get(ord(c), 0x2FFFF) < 0x100 for c in out)
    else:
        good = sum("\u0400" <= c < "\u0460" or c in "\u0490\u0491" or c in _SIGNS or again.get(ord(c), 0x2FFFF) < 0x100 for c in out)
    return good >= 0.8 * len(out)


_LATIN = re.compile("[\u00c0-\u017f\u0218-\u021b«»\u00a0-\u00bf\u2010-\u203a€№™]+")
_MARKS = re.compile("[\u2010-\u203a€№™\U0001f000-\U0001faff]+")
#: Shown characters that don't stand so in a Russian or Ukrainian word or a drawn table.
_ODD = re.compile("[^\\Wа-яёіїєґА-ЯЁІЇЄҐ]|[^\\w─│═║]|[а-яёіїєґ][А-ЯЁІЇЄҐ]")
_DRAWN = re.compile("[─│┌┐└┘├┤┬┴┼]+|[═║╔╗╚╝╠╣╦╩╬]+")
_SCRIPTS = ("\u0370\u03ff", "\u0530\u058f", "\u0590\u05ff", "\u0600\u06ff", "\u0900\u097f", "\u0e00\u0e7f", "\u10a0\u10ff", "\u3000\u9fff", "\uac00\ud7af")


def _of_one_script(out: str) -> bool:
    """What comes out is letters of one script besides Latin and Cyrillic, and signs."""
    letters = [c for c in out if c not in _SIGNS and not "\uff00" <= c <= "\uffef"]
    return bool(letters) and max(sum(a <= c <= b for c in letters) for a, b in _SCRIPTS) >= 0.8 * len(letters)


def _script_spans(text: str, view: str, spans: list[re.Match]) -> list[re.Match]:
    """Spans that are words of one such script, in lines whose other letters of the upper half are few."""
    found = [m for m in spans if _ODD.search(text, m.start(), m.end()) and _of_one_script(_decoded(m.group()))]
    return [m for line, ms in _within(view, found, _ROW) if sum(len(m.group()) for m in ms) >= 0.7 * _high(view, line) for m in ms]


def _latin_spans(text: str, view: str, spans: list[re.Match], encoding: str) -> list[re.Match]:
    """Spans that are accented letters in words otherwise Latin, or dashes, quotes and the like; one that can't be meant as it is shown is enough."""
    good, sure = [], 0.0
    for piece, inside in _within(view, spans, _PIECE):
        latin = None  # whether the token is Latin but for its spans
        for m in inside:
            if not ("\xc2" <= m.group()[0] <= "\xc8" or m.group()[0] in "\xe2\xf0"):
                continue
            out = _decoded(m.group())
            shown = text[m.start() : m.end()]
            odd = bool(_ODD.search(re.sub("Е[ѕј]", "", shown)))
            if _MARKS.fullmatch(out):
                good.append(m)
                sure += odd and encoding != "cp866"
            elif _LATIN.fullmatch(out):
                if latin is None:
                    rest = SPAN.sub(lambda x: "\x00" * len(x.group()), piece.group())
                    latin = any(r.isalpha() and r.isascii() for r in rest) and not any(c.isalpha() and not c.isascii() and r != "\x00" for r, c in zip(rest, text[piece.start() : piece.end()]))
                if latin:
                    good.append(m)
                    sure += (1 if odd else 0.5) * (any(map(str.isalpha, out)) and not _DRAWN.fullmatch(shown))
    return good if sure >= 1 else []


def decode_multibyte(text: str) -> tuple[str, list[str]]:
    """Decodes the well-formed multibyte spans of a text, again while their result is garbled in turn; every round shortens the text."""
    kinds: list[str] = []
    while True:
        best = None
        for encoding in MULTIBYTE_SHOWN_AS:
            view = text.translate(BYTEVIEW[encoding])
            spans = [(m, len(SEQUENCE.findall(m.group()))) for m in SPAN.finditer(view)]
            if not spans:
                continue
            most = _prevailing(view, [m for m, _ in spans])
            if encoding == "cp1252":  # its lead bytes with signs behind them occur in no language
                good = [m for m, _ in spans if m.start() in most and _plausible(_decoded(m.group()), encoding)]
            else:  # Cyrillic capitals with a sign behind occur singly
                near = [m for m, _ in spans if m.start() in most] if any(n >= 2 for _, n in spans) else []
                kept = {}
                for found in (
                    [m for m in near if _plausible(_decoded(m.group()), encoding)],
                    _script_spans(text, view, near),
                ):
                    if sum(len(SEQUENCE.findall(m.group())) for m in found) >= 3:
                        kept |= {m.start(): m for m in found}
                kept |= {m.start(): m for m in _latin_spans(text, view, [m for m, _ in spans], encoding)}
                good = [kept[k] for k in sorted(kept)]
            count = sum(len(SEQUENCE.findall(m.group())) for m in good)
            if not count:
                continue
            if best is None or count > best[0]:
                best = (count, encoding, view, good)
        if best is None:
            return text, kinds
        _, encoding, view, good = best
        parts, at = [], 0
        for m in good:
            parts += [text[at : m.start()], _decoded(m.group())]
            at = m.end()
        text = "".join(parts) + text[at:]
        kinds.append(f"utf_8 as {encoding}")
    return text, kinds


def count_pairs(words: Iterable[str]) -> Counter[str]:
    """Letter pairs of words, each with a space at both ends."""
    text = " " + "".join(f"{w.lower()} " for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    pairs, counts = np.unique(codes[:-1] << 32 | codes[1:], return_counts=True)
    return Counter({chr(p >> 32) + chr(p & 0xFFFFFFFF): n for p, n in zip(pairs.tolist(), counts.tolist())})


class LetterModel:
    """Log-likelihood of letter pairs, fitted to a word list or to the counts of its pairs; small, so it travels in the closure."""

    def __init__(self, words: Iterable[str] = (), counts: Mapping[str, int] | None = None):
        pairs, singles = count_pairs(words) if counts is None else counts, Counter()
        for p, n in pairs.items():
            singles[p[0]] += n
        self.pairs = {p: max(-9.0, math.log((n + 0.05) / (singles[p[0]] + 3))) for p, n in pairs.items()}
        self.floor = -9.0

    def score(self, token: str) -> float:
        """Likelihood of a token; its case must be that of a word, and signs inside cost."""
        core = token.strip("!\"'()*+,-./:;<=>?[\\]_«»„“”—–…\xa0")
        if not core:
            return 0.0 if token.isascii() else -2.0 * sum(not c.isascii() for c in token) if not token.strip("«»„“”—–…№°\xa0") == "" else 0.0
        if core.isascii():
            return 0.0
        total, pairs, before = 0.0, self.pairs, " "
        for c in core.lower() + " ":
            total += pairs.get(before + c, -9.0 if c.isalpha() or c == " " else -7.0)
            before = c
        if not (core.islower() or core.isupper() or core[1:].islower() or not core[1:]):
            total -= 4.0 + 2.0 * sum(a.islower() and b.isupper() for a, b in zip(core, core[1:]))
        elif core.isupper() and len(core) > 1:
            total -= 1.5
        return total


TOKEN = re.compile(r"[^ \t\n]+")
_UKRAINIAN = re.compile("[а-яіїєґ][іїєґ]|[іїєґ][а-яіїєґ]")


def best_runs(steps: list[float], least: float) -> list[tuple[float, int, int]]:
    """(sum, start, end) of all maximal scoring runs of a sequence, those with a sum of at least ``least``; linear time.

    A run is maximal if no part or extension of it sums higher: the best run of all, the best to its left and right, and so on.
    """
    runs: list[tuple[float, float, int, int]] = []  # (sum before, sum up to the end, start, end)
    total = 0.0
    for i, step in enumerate(steps):
        before, total = total, total + step
        if step <= 0:
            continue
        run = (before, total, i, i + 1)
        while True:
            kept: list[tuple[float, float, int, int]] = []
            while runs and runs[-1][0] >= run[0]:  # no run on the stack from here on can be joined
                kept.append(runs.pop())
            if not runs or runs[-1][1] >= run[1]:
                runs += reversed(kept)
                runs.append(run)
                break
            low = runs.pop()
            run = (low[0], run[1], low[2], run[3])
    return [(r - l, a, b) for l, r, a, b in runs if r - l >= least]


def _decode_run(part: str, wrong: str, right: str) -> str:
    view = part.translate(BYTEVIEW[wrong])
    fixed = "".join(c if ord(c) > 0xFF else bytes([ord(c)]).decode(right, "replace") for c in view.replace("\U0002ffff", "\x00"))
    return "".join(o if f == "\x00" else f for o, f in zip(part, fixed))


def decode_single_byte(text: str, model: LetterModel, min_gain: float = MIN_GAIN) -> tuple[str, list[str]]:
    """Decodes the runs of tokens that read as words only in another single-byte encoding.

    All runs of a line are found at once, of overlapping ones the best; the line is then looked at again, until
    no run gains: each decoded run raises the line's likelihood by ``min_gain`` at least, so that ends.
    """
    kinds: list[str] = []
    lines = text.split("\n")
    for k, line in enumerate(lines):
        if line.isascii() or not _SUSPECT.search(line):
            continue
        while True:
            tokens = [(m.start(), m.end()) for m in TOKEN.finditer(line)]
            scored = [model.score(line[a:b]) for a, b in tokens]
            found: list[tuple[float, int, int, int]] = []
            for number, (wrong, right) in enumerate(SINGLE_BYTE_PAIRS):
                if "mac_cyrillic" in (wrong, right) and _UKRAINIAN.search(line):
                    continue  # most of its letters are the same in both
                view = line.translate(BYTEVIEW[wrong])
                steps = []
                for (a, b), now in zip(tokens, scored):
                    piece = view[a:b]
                    if "\U0002ffff" in piece or "�" in piece:
                        steps.append(-6.0)
                    elif piece.isascii():
                        steps.append(0.0)
                    elif now == 0.0:
                        steps.append(-3.0)
                    else:
                        steps.append(model.score(piece.encode("latin-1").decode(right, "replace")) - now)
                found += [(-gain, number, i, j) for gain, i, j in best_runs(steps, min_gain)]
            if not found:
                break
            taken: list[tuple[int, int, int]] = []
            for _, number, i, j in sorted(found):
                if all(j <= a or b <= i for a, b, _ in taken):
                    taken.append((i, j, number))
            parts, at = [], 0
            for i, j, number in sorted(taken):
                a, b = tokens[i][0], tokens[j - 1][1]
                wrong, right = SINGLE_BYTE_PAIRS[number]
                parts += [line[at:a], _decode_run(line[a:b], wrong, right)]
                at = b
                kinds.append(f"{right} as {wrong}")
            line = "".join(parts) + line[at:]
        lines[k] = line
    return "\n".join(lines), kinds


_LETTER_LOST = re.compile("[^\\W\\d_]�|�[^\\W\\d_]|�{3}")


def repair(text: str | None, model: LetterModel) -> tuple[bool, str | None, str | None]:
    """(garbled, kinds, restored text)."""
    if not text or not text.strip():
        return False, None, text
    out, kinds = decode_multibyte(text)
    while True:
        out, more = decode_single_byte(out, model)
        again = []
        if more:  # UTF-8 may lie below
            out, again = decode_multibyte(out)
        kinds += more + again
        if not again:
            break
    if not kinds and _LETTER_LOST.search(text):
        kinds = ["lost characters"]
    return bool(kinds), ", ".join(dict.fromkeys(kinds)) or None, out


def fit_letter_model(words: DataFrame, word_col: str = "word") -> LetterModel:
    """Letter-pair model of all distinct words of a table; each task counts the pairs of its words, and only the counts come to the driver."""
    distinct = words.select(F.lower(word_col).alias("w")).where("w is not null and length(w) > 0").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()
        for b in batches:
            counts.update(count_pairs(b["w"]))
        yield pd.DataFrame(counts.items(), columns=["pair", "n"])

    rows = distinct.mapInPandas(run, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    return LetterModel(counts={r.pair: r.n for r in rows})


def repair_encoding(docs: DataFrame, words: DataFrame, id_col: str = "doc_id", text_col: str = "text", word_col: str = "word") -> DataFrame:
    """One row for each affected document: id, kinds, restored text, whether all of it was restored.

    Only rows that the scan's own filter can't rule out travel to Python; no shuffle.
    """
    model = fit_letter_model(words, word_col)
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").rlike(SUSPECT))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, *repair(t, model)) for i, t in zip(b["id"], b["text"])]
            out = [(i, kinds, fixed, "�" not in fixed) for i, bad, kinds, fixed in out if bad]
            yield pd.DataFrame(out, columns=["id", "kinds", "restored", "whole"])

    id_type = dict(docs.dtypes)[id_col]
    return kept.mapInPandas(run, f"id {id_type}, kinds string, restored string, whole boolean").withColumnRenamed("id", id_col)
