"""Noise in text from scanned pages (problem 2).

Method: a lexicon of the corpus's frequent words (and a given word table) is indexed by
symmetric deletes.  Words outside it are looked up among the words that share a
delete; a weighted edit distance in which the known confusions of recognition are
cheap ranks the candidates, and bigrams decide between those that are as near: that with
the word before, and, where it was never seen, that of the two words' endings.  Lines are judged on the way: running headers
and page numbers, words broken over lines, misread characters; and the text is put
together again in continuous paragraphs.

Scale: one pass counts the words (combined before the shuffle), a second judges each text
where it is read.  The lexicon that travels to the tasks holds the words of at least
``LEXICON_SHARE`` of all documents, so its size is bounded by the words of a text divided
by that share, however large the collection; the same holds for the bigrams and running heads.
Words and heads below the share, but in ``LEXICON_LEAST`` and ``HEAD_LEAST`` documents, stay a
table: what a scanned text asks for is joined with it by deletes, and each text is judged with
its own rows of it.  A head that repeats within one text needs no other.

Defined results for odd input: null and blank texts have no damage and come back as they
are; texts that aren't set in lines of one measure are not scanned; very long texts are
read whole; repeated rows are judged each on its own; without documents or words
the result is empty; only the id and text columns (and the word table's column) are read.
"""

from __future__ import annotations

import re
import zlib
from collections import ChainMap, Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import combinations, product
from math import prod

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import checkpointed
from .frequencies import term_frequencies

LEXICON_SHARE, LEXICON_LEAST = 0.0005, 5
HEAD_SHARE, HEAD_LEAST = 0.0002, 3
BIGRAM_SHARE = 0.001
#: Rows of the given word table that are read, at most.
MAX_WORDS = 300_000

# Confusions of recognition, right to wrong.
CONFUSIONS = {
    "о": "0", "з": "3", "б": "6", "в": "8п", "я": "9", "ч": "4", "л": "д", "т": "mг", "и": "u", "г": "r", "п": "n", "н": "п", "е": "с", "д": "g", "ц": "д", "ш": "m", "щ": "ш", "ы": "м", "у": "y", "а": "a",
}
# Signs that stand for one letter.
LIGATURES = (("JI", "л"), ("ЈІ", "л"), ("Jl", "л"), ("|<", "к"), ("I<", "к"), ("io", "ю"), ("lo", "ю"), ("ьi", "ы"), ("ьl", "ы"), ("ьI", "ы"), ("ь|", "ы"), ("}|{", "ж"), (")(", "х"), ("III", "ш"), ("iu", "ш"))
STRAY = "*~■^|°•_#<>{}\\@$%&+=`"
HYPHENS = "-­¬=‐"

_BACK: dict[str, str] = defaultdict(str)
for _right, _wrongs in CONFUSIONS.items():
    for _w in _wrongs:
        _BACK[_w] += _right
#: Signs that stand for one of several letters, and each such letter's sign; spellings of a token are listed up to MANY, beyond they are found by shape.
_SEVERAL = {w: r for w, r in _BACK.items() if len(r) > 1 and not "а" <= w <= "ё"}
_SIGN = {c: w for w, r in _SEVERAL.items() for c in r}
MANY = 16
#: Misread letters of an all-Cyrillic word: two from this length, three from twice as many letters.
LETTERS_OF_TWO = 6
#: The widest line of a page; a wider one is of no scan.
WIDEST = 100
_HOMOGLYPH = str.maketrans("aceopxyiABCEHKMOPTXëËïoοα", "асеорхуіАВСЕНКМОРТХёЁїооа")
_CYR = re.compile("[а-яё]", re.I)
_WORDS = re.compile("[а-яё]+(?:-[а-яё]+)*")
_NUMBER = r"[0-9lIОоO|ЗзбБSB]"
PAGE = re.compile(rf"^\s*(?:(?:[-—–·•\[(]\s*)?(?=[^\s]*[0-9lI]){_NUMBER}{{1,4}}\s*(?:[*\])]|[-—–·•])?|[сc][тm][рp]\.\s*{_NUMBER}{{1,4}})\s*$")
_AT_EDGE = re.compile(rf"^\s*(?:(?P<a>(?:[-—–·•\[]\s?)?(?=[^\s]*[0-9lI]){_NUMBER}{{1,4}}(?:\s?[-—–·•]|[*\]])?)\s{{2,}}(?P<t1>\S.*?)|(?P<t2>\S.*?)\s{{2,}}(?P<b>(?:[-—–·•\[]\s?|стр\. ?)?(?=[^\s]*[0-9lI]){_NUMBER}{{1,4}}(?:\s?[-—–·•]|[*\]])?)|(?:стр\. ?)(?P<c>{_NUMBER}{{1,4}})\s{{2,}}(?P<t3>\S.*?))\s*$")
_GAP_INSIDE = re.compile(r"\s\s|стр")
_AUTHOR = re.compile(r"^\s*[А-ЯЁ]\.\s?(?:[А-ЯЁ]\.\s?)?[А-ЯЁA-Z0-9|][^\s.,!?]{3,}\.?\s*$")
_BROKEN = re.compile(rf"[^\W\d_][0-9A-Za-zЀ-ӿ|<■^~°*]*[{HYPHENS}]\s*$")
_INVISIBLE = re.compile("[​‌‍⁠﻿‎‏]")
_TOKEN = re.compile(r"[^\s.,!?…:;«»„“”\"()\[\]—–/]+")
_FOREIGN = re.compile("[A-Za-z0-9" + re.escape(STRAY) + "]")


_MARK = re.compile(r"^\s*(?:[-—–·\[]\s?\d+\s?[-—–·\]]|стр\. \d+|\d+\*)\s*$")
_ODD_SIGN = re.compile(r"[а-яё](?:[0-9mugrn^~■°*|]|JI)[а-яё]")
_END = re.compile(r"[.!?…][»”\")]*$")


def head_key(line: str) -> str:
    """A title line by its letters only, in one case."""
    return re.sub("[^а-яё]+", " ", line.translate(_HOMOGLYPH).lower()).strip()


def _at_edge(line: str) -> re.Match | None:
    return _AT_EDGE.match(line) if _GAP_INSIDE.search(line) else None


def is_scanned(lines: list[str]) -> tuple[bool, int]:
    """Whether a text's lines are set to one measure: where a line ends, the next word didn't fit. And the number of such ends."""
    body = [x.rstrip() for x in lines]
    widths = [len(x) for x in body if x]
    if len(widths) < 2 or not 20 <= max(widths) <= WIDEST:
        return False, 0
    text = "".join(body)
    if 2 * len(_CYR.findall(text)) < len(text.replace(" ", "")):
        return False, 0
    page = [bool(PAGE.match(x)) for x in body]
    edge = [bool(_at_edge(x)) for x in body]
    measure = max((len(a) for a, b, p in zip(body, body[1:], page) if b and not p), default=0)
    fits = full = broken = 0
    for k, (a, b) in enumerate(zip(body, body[1:])):
        if not a or not b or page[k] or page[k + 1] or b.startswith("  ") or edge[k] or edge[k + 1]:
            continue
        if a[-1] in HYPHENS and _BROKEN.search(a):
            broken += 1
            continue
        if len(a) < 0.75 * measure and _ended(a):
            continue  # the last line of a paragraph
        if len(a) < 0.4 * measure and a[:1].isupper():
            continue  # a title
        word = b.split(" ", 1)[0]
        if len(a) + 1 + len(word) > measure - 1:
            full += 1
        else:
            fits += 1
    marks = sum(e or bool(_MARK.match(x)) for x, e in zip(body, edge))
    odd = len(_ODD_SIGN.findall(text))
    share = full / (full + fits) if full + fits else 0.0
    if share >= 0.7 and full >= 1:
        return True, full + broken
    return share >= 0.35 and full + fits > 0 and bool(broken or marks or odd) or bool(broken and full + fits <= 2) or bool(marks and odd), full + broken


class Lexicon:
    """Words with their document counts, indexed by deletes, and bigrams of word endings."""

    def __init__(self, words: dict[str, int], bigrams: dict[str, int] | None = None, heads: Iterable[str] = ()):
        self.words, self.bigrams = words, bigrams or {}
        self.deletes: dict[str, list[str]] = defaultdict(list)
        for w in words:
            if len(w) > 2:
                for d in {w[:i] + w[i + 1 :] for i in range(len(w))}:
                    self.deletes[d].append(w)
        self.shapes: dict[str, list[str]] = defaultdict(list)
        for w in words:
            if x := _shape(w):
                self.shapes[x].append(w)
        self.heads = {h for h in heads if h}
        self.head_deletes = {d for h in self.heads for d in _deletes(h)}
        self.look_up = lru_cache(maxsize=1 << 16)(self._look_up)
        #: (term, docs) of the words and "#" + heads that don't travel; stays on the driver.
        self.rest: DataFrame | None = None

    def __reduce__(self):
        return Lexicon, (self.words, self.bigrams, list(self.heads))

    def knows(self, word: str) -> bool:
        return word in self.words or "-" in word and all(p in self.words for p in word.split("-") if p)

    def _look_up(self, word: str) -> tuple[tuple[float, str], ...]:
        """Candidates for a Cyrillic word within one edit, nearest first."""
        near = {*self.deletes.get(word, ())}
        for i in range(len(word)):
            near.update(self.deletes.get(word[:i] + word[i + 1 :], ()))
            if word[:i] + word[i + 1 :] in self.words:
                near.add(word[:i] + word[i + 1 :])
        found = sorted((d, -self.words[w], w) for w in near if (d := distance(w, word)) <= 1.0)
        return tuple((d, w) for d, _, w in found)

    def repair(self, word: str, before: str = "", limit: float = 0.5) -> str | None:
        """The word that a misread Cyrillic word stands for, if one is near enough by the known confusions."""
        found = [c for c in self.look_up(word) if c[0] <= limit] or [(n, w) for n, w in several_confused(word) if w in self.words]
        if not found:
            return None
        best = found[0][0]
        ties = [w for d, w in found if d == best]
        return max(ties, key=lambda w: (self.bigrams.get(f"={before} {w}", 0), self.bigrams.get(f"{before[-2:]} {w[-2:]}", 0), self.words[w], w))

    def spellings(self, token: str) -> list[str]:
        """Cyrillic spellings of a token with wrong signs: all of them, or of too many to list those that are words, and the plain one."""
        options = _options(token)
        if prod(map(len, options)) <= MANY:
            return ["".join(x) for x in product(*options)]
        plain = "".join(o[0] for o in options)
        return [w for w in self.of_shape(_shape(plain)) if all(c in o for c, o in zip(w, [o for o in options if o != [""]]))] + [plain]

    def of_shape(self, shape: str) -> list[str]:
        return self.shapes.get(shape, [])

    def is_head(self, line: str) -> bool:
        key = head_key(line)
        return bool(key) and (key in self.heads or len(key) > 5 and (key in self.head_deletes or not self.head_deletes.isdisjoint(_deletes(key))))


class Widened(Lexicon):
    """A lexicon with some more words and heads for one text."""

    def __init__(self, base: Lexicon, words: dict[str, int], heads: Iterable[str]):
        self.base, self.own = base, Lexicon(words, None, heads)
        self.words, self.bigrams = ChainMap(words, base.words), base.bigrams

    def look_up(self, word: str) -> tuple[tuple[float, str], ...]:
        if not self.own.words:
            return self.base.look_up(word)
        return tuple(sorted({*self.base.look_up(word), *self.own._look_up(word)}, key=lambda c: (c[0], -self.words[c[1]], c[1])))

    def of_shape(self, shape: str) -> list[str]:
        return self.base.of_shape(shape) + self.own.of_shape(shape)

    def is_head(self, line: str) -> bool:
        return self.base.is_head(line) or self.own.is_head(line)


def _deletes(word: str) -> set[str]:
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def distance(right: str, wrong: str) -> float:
    """Weighted edit distance for words at most one edit apart: a known confusion costs 0.3, any other edit 1."""
    if right == wrong:
        return 0.0
    n, m = len(right), len(wrong)
    a = 0
    while a < min(n, m) and right[a] == wrong[a]:
        a += 1
    b = 0
    while b < min(n, m) - a and right[n - 1 - b] == wrong[m - 1 - b]:
        b += 1
    x, y = right[a : n - b], wrong[a : m - b]
    if len(x) == 1 and len(y) == 1:
        return 0.3 if y in CONFUSIONS.get(x, "") else 1.0
    return 1.0 if len(x) + len(y) == 1 else 2.0


def several_confused(word: str) -> Iterator[tuple[int, str]]:
    """(number, word) for which this one is misread by two known confusions, or by three if it is long; fewest first."""
    at = [i for i, c in enumerate(word) if c in _BACK]
    for n in range(2, 1 + (len(word) >= LETTERS_OF_TWO) + (len(word) >= 2 * LETTERS_OF_TWO)):
        for places in combinations(at, n):
            for right in product(*(_BACK[word[i]] for i in places)):
                letters = list(word)
                for i, c in zip(places, right):
                    letters[i] = c
                yield n, "".join(letters)


def _options(token: str) -> list[list[str]]:
    """What each sign of a token may stand for in Cyrillic, once its ligatures are taken apart."""
    t = token
    for wrong, right in LIGATURES:
        t = t.replace(wrong, right)
    out = []
    for c in t:
        low = c.lower()
        if c in STRAY:
            out.append([""])
        elif c in _BACK and not _CYR.match(c):
            out.append(list(_BACK[c]))
        elif low in _BACK and not _CYR.match(c):
            out.append(list(_BACK[low]))
        else:
            out.append([c.translate(_HOMOGLYPH).lower()])
    return out


def _shape(word: str) -> str:
    """A word with each letter that shares its sign with others replaced by that sign, if it has so many that not all its spellings are listed; else empty."""
    if prod(len(_SEVERAL[_SIGN[c]]) for c in word if c in _SIGN) <= MANY:
        return ""
    return "".join(_SIGN.get(c, c) for c in word)


_NUMBERED = re.compile(r"\d+-?[а-яё]{1,3}|\d+[а-яё]{1,4}|[а-яёА-ЯЁ]{1,3}\d{1,4}")
_TWO_SIGNS = re.compile("ьі|ЈІ|іо")
_TWO_SIGNS_ANY = re.compile(_TWO_SIGNS.pattern, re.I)


def misread(token: str, lexicon: Lexicon, before: str = "") -> str | None:
    """The right spelling of a token with a wrongly recognised or stray character; None for a sound one."""
    if token.lower() in lexicon.words or not _CYR.search(token):
        return None
    token = token.strip("'’")
    if _NUMBERED.fullmatch(token):
        return None
    core = token
    if not _FOREIGN.search(core):
        word = core.lower()
        if len(word) < 3 or lexicon.knows(word) or not _WORDS.fullmatch(word):
            return None
        return lexicon.repair(word, before)
    plain = core.translate(_HOMOGLYPH)
    if not _FOREIGN.search(plain) and not _TWO_SIGNS.search(plain):
        word = plain.lower()  # only look-alike letters: nothing that looks different
        if lexicon.knows(word) or len(word) < 3:
            return None
        return lexicon.repair(word, before)
    options = lexicon.spellings(core)
    for o in options:
        if lexicon.knows(o):
            return o
    for o in options:
        if r := lexicon.repair(o, before, 1.0):
            return r
    letters = sum(bool(_CYR.match(c)) for c in core)
    return options[-1 if len(options) > MANY else 0] if letters >= 2 and 2 * letters >= len(core) else None


def judge(text: str | None, lexicon: Lexicon) -> tuple[bool, list[tuple[int, str]], str | None]:
    """(scanned, [(line number, defect)], text in continuous paragraphs)."""
    if not text or "\n" not in text.strip():
        return False, [], text
    lines = [_INVISIBLE.sub("", x).replace(" ", " ") for x in text.split("\n")]
    scanned, _ = is_scanned(lines)
    if not scanned:
        return False, [], text
    repeated = [h for h, times in Counter(running_heads(text)).items() if times > 1]
    if repeated:
        lexicon = Widened(lexicon, {}, repeated)
    n = len(lines)
    measure = max(len(x.rstrip()) for x in lines)
    page = [bool(PAGE.match(x)) for x in lines]
    furniture = list(page)
    shown = [k for k in range(n) if lines[k].strip()]
    place = {k: i for i, k in enumerate(shown)}
    for k in shown:
        line = lines[k]
        if furniture[k] or len(line.strip()) > 0.8 * measure and len(line.strip()) > 45:
            continue
        if (m := _at_edge(line)) and (title := m.group("t1") or m.group("t2") or m.group("t3")) and (lexicon.is_head(title) or _AUTHOR.match(title) or title.isupper() or len(title.split()) <= 5 and title[:1].isupper()):
            furniture[k] = True
            continue
        i = place[k]
        near = i == 0 or i == len(shown) - 1 or any(page[shown[j]] for j in (i - 1, i + 1) if 0 <= j < len(shown))
        if lexicon.is_head(line) or _AUTHOR.match(line) and near:
            furniture[k] = True
        elif near and line.strip().isupper() and len(head_key(line)) > 3 and (i != 0 or k + 1 < n and lines[k + 1].strip()):
            furniture[k] = True
    defects = [(k + 1, "furniture") for k in shown if furniture[k]]
    body = [k for k in shown if not furniture[k]]
    out: list[str] = []
    carry = ""  # first half of a broken word, as read
    carry_fixed = ""
    bad: set[int] = set()
    for i, k in enumerate(body):
        line = lines[k]
        after = body[i + 1] if i + 1 < len(body) else None
        stripped = line.strip()
        tokens = [m.group() for m in _TOKEN.finditer(stripped)]
        follows = lines[after].strip() if after is not None else ""
        joined_head = ""
        if follows and (first := _TOKEN.match(follows)):
            joined_head = first.group()
        broken = False
        tail = tokens[-1] if tokens and stripped.endswith(tokens[-1]) else ""
        if tail and tail[-1] in HYPHENS and len(tail) > 1 and joined_head and _CYR.search(tail) and (_CYR.match(joined_head[0]) or _FOREIGN.match(joined_head[0])):
            broken = not joined_head[0].isupper() or tail[0].isupper() and tail.isupper()
            tail = tail[:-1]
        elif tail and joined_head and joined_head[0].islower() and _WORDS.fullmatch(tail.lower()) and _WORDS.fullmatch(joined_head) and len(tail) + len(joined_head) > 5:
            if not lexicon.knows(tail.lower()) and not lexicon.knows(joined_head) and lexicon.knows((tail + joined_head).lower()):
                broken = True
        if broken:
            defects.append((k + 1, "broken_word"))
        # words of this line; halves are judged on the whole word
        fixed: dict[str, str] = {}
        before = ""
        odd = unread = 0
        whole = None
        for j, token in enumerate(tokens):
            if j == 0 and carry:
                continue
            if broken and j == len(tokens) - 1:
                whole = _mend(tail, joined_head, lexicon, before)
                if whole[1]:
                    odd += 1
                    bad.add(k)
                if whole[2]:
                    bad.add(after)
                continue
            if token[-1:] in HYPHENS:
                token = token[:-1]
            if not token:
                continue
            right = misread(token, lexicon, before)
            if right is None and token in STRAY and _CYR.search(stripped):
                right = ""
            if right is not None:
                odd += 1
                unread += bool(right) and not lexicon.knows(right)
                fixed[token] = _cased(token, right)
            before = (right or token).lower()
        if len(tokens) > 3 and 2 * odd > len(tokens) and 2 * unread > odd:
            fixed = {}  # most of it reads as nothing: the line is garbled in some other way
        elif odd:
            bad.add(k)
        done = _TOKEN.sub(lambda m: fixed.get(m.group(), fixed.get(m.group()[:-1], m.group())), stripped) if fixed else stripped
        if carry and tokens:
            rest = done[len(tokens[0]) :] if done.startswith(tokens[0]) else done.partition(" ")[2]
            done = carry_fixed + rest
            out[-1] = out[-1][: -len(carry)].rstrip() if out[-1].endswith(carry) else out[-1]
        starts = not out or (k and not lines[k - 1].strip() and not carry and _ended(out[-1])) or (line.startswith("   ") and not carry and _ended(out[-1]))
        if starts or (out and _ended(out[-1]) and len(lines[body[i - 1]].strip()) < 0.7 * measure and not carry):
            out.append(done)
        else:
            out[-1] = (out[-1] + " " + done).strip()
        if broken:
            last = tokens[-1]
            carry, carry_fixed = last, whole[0]
        else:
            carry = carry_fixed = ""
    defects += [(k + 1, "misread") for k in sorted(bad)]
    return True, sorted(defects), "\n\n".join(out)


def _ended(text: str) -> bool:
    return bool(_END.search(text[-8:]))


def _cased(token: str, right: str) -> str:
    letters = [c for c in token if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return right.upper()
    return right[:1].upper() + right[1:] if token[:1].isupper() or token[:1] in "Ј" else right


def _mend(a: str, b: str, lexicon: Lexicon, before: str) -> tuple[str, bool, bool]:
    """A word from its halves: (spelling, first half misread, second half misread)."""
    a2, b2 = a.lower(), b.lower()
    if lexicon.knows(a2 + b2) and a2 + b2 in lexicon.words:
        return a + b, False, False
    if f"{a2}-{b2}" in lexicon.words:
        return f"{a}-{b}", False, False
    odd_a, odd_b = (bool(_FOREIGN.search(x.translate(_HOMOGLYPH))) or "ЈІ" in x for x in (a, b))
    if odd_a or odd_b:
        for w in (*lexicon.spellings(a + b), *lexicon.spellings(f"{a}-{b}")):
            if w in lexicon.words or "-" not in w and lexicon.knows(w):
                return _cased(a, w), odd_a, odd_b
        x, y = ("".join(o[0] for o in _options(h)) for h in (a, b))
        if right := lexicon.repair(x + y, before):
            at = next((i for i, (p, q) in enumerate(zip(right, x + y)) if p != q), len(right))
            return _cased(a, right), odd_a or at < len(x), odd_b or at >= len(x)
        return _cased(a, x + y), odd_a, odd_b
    whole = (a + b).translate(_HOMOGLYPH).lower()
    if lexicon.knows(whole):
        return a + b, False, False
    if right := lexicon.repair(whole, before):
        at = next((i for i, (p, q) in enumerate(zip(right, whole)) if p != q), len(right))
        return _cased(a, right), at < len(a), at >= len(a)
    hyphened = f"{a2}-{b2}".translate(_HOMOGLYPH)
    if right := lexicon.repair(hyphened, before):
        at = next((i for i, (p, q) in enumerate(zip(right, hyphened)) if p != q), len(right))
        return _cased(a, right), at < len(a), at >= len(a)
    return a + b, False, False


#: Lines that may be running heads: beside a page number, or sharing a line with one.
_CAPITAL = re.compile("[А-ЯЁ]")


def running_heads(text: str) -> list[str]:
    """Title lines beside a page number or on one line with it, each as often as it stands there."""
    heads: list[str] = []
    if "\n" in text and any(map(str.isdigit, text)):
        lines = [x for x in text.split("\n") if x and not x.isspace()]
        for k, line in enumerate(lines):
            if len(line) > WIDEST:
                continue
            if m := _at_edge(line):
                title = m.group("t1") or m.group("t2") or m.group("t3")
                if _CAPITAL.match(title):
                    heads.append(head_key(title))
            elif PAGE.match(line):
                for other in lines[max(0, k - 1) : k] + lines[k + 1 : k + 2]:
                    if len(other) < 45 and _CAPITAL.match(other.strip()) and not _AUTHOR.match(other) and not PAGE.match(other) and len(other.split()) < 6:
                        heads.append(head_key(other))
    return heads


def mistakable(words: Iterable[str]) -> frozenset[str]:
    """Words that may be misread as the same form as another one, so that only context tells them apart."""
    forms: dict[str, set[str]] = defaultdict(set)
    for w in words:
        for i, c in enumerate(w):
            for wrong in CONFUSIONS.get(c, ""):
                forms[w[:i] + wrong + w[i + 1 :]].add(w)
    return frozenset(w for found in forms.values() if len(found) > 1 for w in found)


def term_counter(told_apart: frozenset[str] = frozenset()) -> Callable[[str], list[str]]:
    """Terms of the counting pass: words, "ending ending" of neighbours, "=word word" before a mistakable one, and "#" + running heads."""

    def terms(text: str) -> list[str]:
        words = _WORDS.findall(text.lower())
        ends = [w[-2:] for w in words]
        pairs = [f"={a} {b}" for a, b in zip(words, words[1:]) if b in told_apart]
        return [*words, *map(" ".join, zip(ends, ends[1:])), *pairs, *("#" + h for h in running_heads(text))]

    return terms


def _asking(may: Callable[[str], bool]) -> Callable[[str, bool], tuple[str, ...]]:
    """The keys by which a word that isn't known is looked up, of them those that ``may`` be known; an odd one may also be an edit away."""

    @lru_cache(maxsize=1 << 16)
    def asked(w: str, odd: bool) -> tuple[str, ...]:
        if not _CYR.search(w):
            return ()
        keys = {w, *w.split("-"), *_confused(w), *(x for _, x in several_confused(w))}
        if x := _shape(w):
            keys.add("~" + x)
        if odd and len(w) > 2:
            keys |= _deletes(w)
        return tuple(k for k in keys if k and may(k))

    return asked


def _asked(lines: list[str], lexicon: Lexicon, may: Callable[[str], bool], asked: Callable[[str, bool], tuple[str, ...]] | None = None) -> set[str]:
    """What ``judge`` may look up in vain for these lines: words with their deletes, and "#" + heads with theirs; of them those that ``may`` be known."""
    asked = asked or _asking(may)
    words, odd, exact, keys = set(), set(), set(), set()
    shown = [x.strip() for x in lines if x.strip()]
    tokens = [[m.group().strip("'’") for m in _TOKEN.finditer(x)] for x in shown]
    measure = max((len(x.rstrip()) for x in lines), default=0)
    page, aside = [], []  # page numbers; lines that may be other furniture
    for line in shown:
        page.append(bool(PAGE.match(line)))
        if page[-1] or len(line) > 0.8 * measure and len(line) > 45:
            aside.append(False)
            continue
        m = _at_edge(line)
        heads = {head_key(line), head_key(m.group("t1") or m.group("t2") or m.group("t3")) if m else ""} - lexicon.heads - {""}
        known = {d for h in heads if len(h) <= WIDEST + 1 for d in ("#" + h, *(["#" + d for d in _deletes(h)] if len(h) > 5 and any(map(may, _ends_of(h))) else ())) if may(d)}
        keys |= known
        aside.append(bool(m or known or line.isupper() or _AUTHOR.match(line) or lexicon.is_head(line)))
    for k, line in enumerate(shown):
        for token in tokens[k]:
            if token.lower() in lexicon.words:
                continue
            for t in (token, token[:-1]) if token[-1:] in HYPHENS else (token,):
                (odd if _FOREIGN.search(t) else words).update(_spellings(t))
        if tokens[k] and line.endswith(tokens[k][-1]):
            tail = tokens[k][-1]
            broken = tail[-1:] in HYPHENS
            tail = tail[:-1] if broken else tail
            for after in range(k + 1, len(shown)):  # the next line that isn't furniture
                if page[after]:
                    continue
                head = tokens[after][0] if tokens[after] else ""
                if broken and head and (tail + head).lower() not in lexicon.words:
                    words |= {x for a in _spellings(tail) for b in _spellings(head) for x in (a + b, f"{a}-{b}")}
                elif head and tail.lower() not in lexicon.words and head not in lexicon.words:
                    exact.add((tail + head).lower())
                if not aside[after]:
                    break
    keys |= {k for k in exact if k not in lexicon.words and may(k)}
    for w in words | odd:
        if w not in lexicon.words:
            keys.update(asked(w, w in odd))
    return keys


def _ends_of(head: str) -> tuple[str, ...]:
    """Of two heads one edit apart either the first or the last four letters are the same, if they are so long; of short ones nothing is asked."""
    return ("<" + head[:4], ">" + head[-4:]) if len(head) > 9 else ("<",)


def _bits(rest: DataFrame) -> tuple[bytes, int]:
    """One bit for each hash of a key of ``rest``: what isn't set is no key. Only saves rows, so its size needn't grow for ever."""
    width = min(28, max(16, (512 * rest.count()).bit_length()))  # a term has ten keys or so

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(1 << width, dtype=bool)
        for b in batches:
            heads = {t[1:] for t in b["term"] if t[0] == "#"}
            keys = [*b["key"], "<", *("<" + h[:4] for h in heads), *(">" + h[-4:] for h in heads)]
            bits[[zlib.crc32(k.encode()) >> (32 - width) for k in keys]] = True
        yield pd.DataFrame([(zlib.compress(np.packbits(bits).tobytes(), 1),)], columns=["bits"])

    out = np.zeros(1 << (width - 3), dtype=np.uint8)
    for r in _keyed(rest).select("key", "term").coalesce(16).mapInPandas(mark, "bits binary").toLocalIterator():
        out |= np.frombuffer(zlib.decompress(r.bits), dtype=np.uint8)
    return out.tobytes(), width


def _may(bits: bytes, width: int) -> Callable[[str], bool]:
    def may(key: str) -> bool:
        at = zlib.crc32(key.encode()) >> (32 - width)
        return bool(bits[at >> 3] & (128 >> (at & 7)))

    return may


def _confused(word: str) -> list[str]:
    """The words for which this one is misread by one known confusion."""
    return [word[:i] + x + word[i + 1 :] for i, c in enumerate(word) for x in _BACK.get(c, "")]


_PLAIN = re.compile("[А-Яа-яЁё]+")


def _spellings(token: str) -> set[str]:
    if _PLAIN.fullmatch(token):
        return {token.lower()}
    plain = token.translate(_HOMOGLYPH).lower()
    return {token.lower(), plain, *(_listed(token) if _FOREIGN.search(token) or _TWO_SIGNS_ANY.search(token) else ())}


def _listed(token: str) -> list[str]:
    """The spellings of a token, of too many the plain one: the others are asked for by its shape."""
    options = _options(token)
    return ["".join(x) for x in (product(*options) if prod(map(len, options)) <= MANY else zip(*(o[:1] for o in options)))]


def _keyed(terms: DataFrame) -> DataFrame:
    """(key, term, docs): each term by itself and by its deletes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, t, n) for t, n in zip(b["term"], b["docs"]) for k in ({t} | ({"#" + d for d in _deletes(t[1:])} if t[0] == "#" else _deletes(t) | ({"~" + _shape(t)} if _shape(t) else set()) if len(t) > 2 else set()))]
            yield pd.DataFrame(rows, columns=["key", "term", "docs"])

    return terms.mapInPandas(run, "key string, term string, docs long")


def _rest(terms: DataFrame, lexicon: Lexicon, given: set[str]) -> DataFrame:
    """The terms below the share without forms that are one known confusion away from a more frequent or a given word.

    Misread forms recur as the collection grows, so in these, unlike the frequent words, a count is no evidence of a word.
    """
    shared = terms.sparkSession.sparkContext.broadcast((lexicon.words, given))

    def sound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, fixed = shared.value
        for b in batches:
            rows = [(t, n) for t, n in zip(b["term"], b["docs"]) if t[0] == "#" or t in fixed or not any(c in fixed or known.get(c, 0) > n for c in _confused(t))]
            yield pd.DataFrame(rows, columns=["term", "docs"])

    def rights(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(c, t, n) for t, n in zip(b["term"], b["docs"]) if t[0] != "#" and t not in shared.value[1] for c in _confused(t)]
            yield pd.DataFrame(rows, columns=["term", "wrong", "times"])

    right = terms.select("term", "docs").mapInPandas(rights, "term string, wrong string, times long")
    wrong = right.join(terms, "term").where("docs > times").select(F.col("wrong").alias("term")).distinct()
    return checkpointed(terms.join(wrong, "term", "left_anti").select("term", "docs").mapInPandas(sound, "term string, docs long"))


def corpus_lexicon(docs: DataFrame, words: DataFrame | None = None, text_col: str = "text", word_col: str = "word") -> Lexicon:
    """The lexicon of a collection: every text is counted; words, bigrams and heads of a fixed share of it are sent to the tasks, rarer words and heads stay a table."""
    n = docs.agg(F.count(F.col(text_col))).first()[0]
    given: set[str] = set()
    if words is not None:
        rows = words.select(F.lower(word_col).alias("w")).where("w is not null and w rlike '^[а-яё-]+$'").distinct().limit(MAX_WORDS + 1).collect()
        if len(rows) > MAX_WORDS:
            raise ValueError("the word table is too long to be sent to every task")
        given = {r.w for r in rows}
    is_bigram, is_head = F.col("term").contains(" ") & ~F.col("term").startswith("#"), F.col("term").startswith("#")
    least, least_head = max(LEXICON_LEAST, LEXICON_SHARE * n), max(HEAD_LEAST, HEAD_SHARE * n)
    counted = term_frequencies(docs, text_col, term_counter(mistakable(given))).where(
        F.when(is_head, F.col("docs") >= HEAD_LEAST).when(is_bigram, F.col("n") >= max(3, BIGRAM_SHARE * n)).otherwise(F.col("docs") >= LEXICON_LEAST)
    )
    all_sent = least <= LEXICON_LEAST and least_head <= HEAD_LEAST
    if not all_sent:
        counted = checkpointed(counted)
    sent = F.when(is_head, F.col("docs") >= least_head).when(is_bigram, True).otherwise(F.col("docs") >= least)
    kept = counted.where(sent).collect()
    lexicon = {r.term: r.docs for r in kept if " " not in r.term and r.term[0] != "#"}
    for w in given:
        lexicon.setdefault(w, 1)
    # a misread form that recurs is no word: it is known only if no far more frequent word is one confusion away
    probe = Lexicon(dict(lexicon))
    for w in [w for w in lexicon if w not in given and len(w) > 2]:
        if any(d <= 0.5 and probe.words[c] > 8 * probe.words[w] for d, c in probe.look_up(w) if c != w):
            del lexicon[w]
    out = Lexicon(lexicon, {r.term: r.n for r in kept if " " in r.term and r.term[0] != "#"}, [r.term[1:] for r in kept if r.term[0] == "#"])
    if not all_sent:
        out.rest = _rest(counted.where(~sent), probe, given)
    return out


#: A text with none of these isn't set in lines of one measure: two neighbouring lines of 15 to 100 characters, one Cyrillic.
MAYBE_SCANNED = "(?:^|\n)[^\n]{0,100}[а-яёА-ЯЁ][^\n]{0,100}\n"


def scan_defects(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each scanned document: id, defects (line_no, defect) and the text in continuous paragraphs."""
    id_type = dict(docs.dtypes)[id_col]
    lexicon_ = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t, more in zip(b["id"], b["text"], b["more"] if "more" in b else [None] * len(b)):
                known = lexicon_.value
                if more is not None and len(more):
                    known = Widened(known, {r["term"]: r["docs"] for r in more if r["term"][0] != "#"}, [r["term"][1:] for r in more if r["term"][0] == "#"])
                scanned, defects, fixed = judge(t, known)
                if scanned:
                    out.append((i, [{"line_no": k, "defect": d} for k, d in defects], fixed))
            yield pd.DataFrame(out, columns=["id", "defects", "repaired"])

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        may = _may(*bits.value)
        asked = _asking(may)
        for b in batches:
            out = []
            for i, t in zip(b["id"], b["text"]):
                lines = [_INVISIBLE.sub("", x).replace("\xa0", " ") for x in t.split("\n")]
                if is_scanned(lines)[0]:
                    out.append((i, t, list(_asked(lines, lexicon_.value, may, asked))))
            yield pd.DataFrame(out, columns=["id", "text", "keys"])

    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").rlike(MAYBE_SCANNED))
    if lexicon.rest is not None:
        bits = docs.sparkSession.sparkContext.broadcast(_bits(lexicon.rest))
        kept = checkpointed(kept.mapInPandas(ask, f"id {id_type}, text string, keys array<string>").withColumn("text_key", F.md5("text")))
        asked = kept.select("text_key", F.explode("keys").alias("key")).distinct()
        more = asked.join(_keyed(lexicon.rest), "key").groupBy("text_key").agg(F.collect_set(F.struct("term", "docs")).alias("more"))
        kept = kept.select("id", "text", "text_key").join(more, "text_key", "left").select("id", "text", "more")
    return kept.mapInPandas(run, f"id {id_type}, defects array<struct<line_no: int, defect: string>>, repaired string").withColumnRenamed("id", id_col)


def damaged_lines(scans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return scans.select(id_col, F.explode("defects").alias("d")).select(id_col, "d.line_no", "d.defect")
