"""Sentence boundaries across languages and scripts (problem 3).

Method: the boundary rules are compiled into a finite transducer.  Its input
symbols are the few characters that can open, close or end a sentence unit, each
classified by a bounded context (``LEFT`` characters before its end, ``RIGHT`` behind); its
states are what is open at that point (nothing, a quotation, a bracket, one inside
the other), whether the line began with a dash and whether it holds a tab; it puts out unit
ends.  A long text is cut into chunks.  Each chunk is turned, by itself, into its
state-transition function and, for every unit end that it may put out, the set of
entry states for which it does.  The functions are composed by a prefix scan in two
levels: those of a block of chunks into one, those of a document's blocks from its start;
each block is then entered in the right state and picks its ends.

Defined results for odd input: null, empty and blank texts have no unit; a text
without any stop is one unit; very long texts go through the scan in chunks of
``CHUNK`` characters, with the same result as in one piece; a document id that occurs twice
gives its units twice, unless the caller removes copies; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed
from .lookalikes import look

CHUNK, LEFT, RIGHT = 1 << 15, 48, 48
#: Chunks whose functions one task composes.
BLOCK = 64

# Shortened words after which a sentence goes on whatever follows, by language.
NEVER_LAST = """
ул им проф акад рис табл гл п пп д стр см с пер пл просп бул обл р-н ред изд им гр тов напр т.е т.к ср св
dr mr mrs ms prof st fig e.g i.e vs no vol ed p pp
z.b d.h nr bzw ca
вул буд див напр
წ გვ
डॉ पृ श्री
พ.ศ ค.ศ
""".split()
# Units, endings of enumerations and years, after which one may end.
LAST_BEFORE_CAPITAL = "г гг в вв м км см кг руб коп тыс млн млрд н.э т.д т.п др пр р рр usw etc p.m a.m st".split()
_NEVER = {look(w) for w in NEVER_LAST} - {look("с")} | {look("с")}
_MAY_END = {look(w) for w in LAST_BEFORE_CAPITAL if "." in w}
#: Those that name a place or person unless a number stands before.
_AFTER_NUMBER = {look(w) for w in ("г", "м", "р", "с", "д", "п", "в")}
_MONTHS = re.compile(r"\s+(?:Jan|Feb|Mär|Apr|Mai|Jun|Jul|Aug|Sep|Okt|Nov|Dez)")

_OPEN = {"«": 1, "„": 2, "“": 2, "(": 3, "[": 3, "（": 3, "「": 4, "『": 4, "‹": 1}
_CLOSE = {"»": (1,), "”": (2, 5), "“": (2,), ")": (3,), "]": (3,), "）": (3,), "」": (4,), "』": (4,), "›": (1,)}
_REPORTED = 5  # a quotation after a colon, in scripts without case

# What is open: 0 nothing; k; or 6 + 5 (outer - 1) + inner - 1 for two.
N_OPEN = 31
# States: what is open + N_OPEN (line began with a dash + 2 line holds a tab).
N_STATES = 4 * N_OPEN
IN_REPLY, WITH_TAB = N_OPEN, 2 * N_OPEN


def _push(state: int, kind: int) -> int:
    if state == 0:
        return kind
    return 6 + 5 * (state - 1) + kind - 1 if state < 6 else state


def _pop(state: int, kinds: tuple[int, ...]) -> int:
    if state == 0:
        return 0
    if state < 6:
        return 0 if state in kinds else state
    outer, inner = divmod(state - 6, 5)
    return outer + 1 if inner + 1 in kinds else 0 if outer + 1 in kinds else state


def _table(change) -> bytes:
    """A change of state as a table for bytes: of (what is open, flags)."""
    return bytes(change(s % N_OPEN, s - s % N_OPEN) for s in range(N_STATES)) + bytes(range(N_STATES, 256))


PUSH = {k: _table(lambda o, f, k=k: f + _push(o, k)) for k in range(1, 6)}
POP = {k: _table(lambda o, f, k=k: f + _pop(o, k)) for k in {*_CLOSE.values(), (2, 5)}}
TAB = _table(lambda o, f: o + f % WITH_TAB + WITH_TAB)
#: A line's end: of a paragraph or only after a tab; the next line begins with a dash or not.
LINE = {(ends, dash): _table(lambda o, f, ends=ends, dash=dash: (0 if ends or f >= WITH_TAB else o) + IN_REPLY * dash) for ends in (False, True) for dash in (False, True)}

_WIDE = {c: c - 0xFEE0 for c in (*range(0xFF10, 0xFF5F), 0xFF0E)} | {c: 0x20 for c in (0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)} | {0xFF01: "!", 0xFF1F: "?", 0xFF61: "。", 0xFF62: "「", 0xFF63: "」"}
_WIDE |= {c: "\x00" for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x200E, 0x200F)}  # invisible: keeps its place
_EVENT = re.compile(r"[.!?…։。؟।॥۔！？]+|(?<=[԰-֏]):|\n|\t|[«»„“”\"()\[\]「」『』]|(?<=[฀-๿])[ \x00]+(?=[฀-๿])")
_GAP = re.compile(r"[\s\x00]*")
_LEAD = re.compile(r"[\s\x00«„“\"(\[「『—–-]*")
_L = "(?:[^\\W\\d_]|[\u0300-\u036f\u0900-\u0903\u093a-\u094f\u0e31-\u0e4e\\x00])"  # a letter or a mark on it
_WORD_BEFORE = re.compile(rf"(?:{_L}+\.[ \x00]?)*{_L}+(?:-{_L}+)?$")
_NUMBER_BEFORE = re.compile(r"\d[\s\x00]*$")
_SECOND_PART = re.compile(r"[ \x00]*[^\W\d_]\.")
_CASED_LOWER = re.compile("[a-zß-öø-ɏа-џѐ-ԯά-ώա-և]")
_UPPER = re.compile("[A-ZÀ-ÖØ-ÞА-ЯЀ-ЏΑ-ΩԱ-Ֆ]")
_CJK = re.compile("[぀-ヿ㐀-鿿]")
_TERMINALS = frozenset(".!?…։。؟।॥۔！？")
_NEW_ITEM = re.compile(r"[ \t]*(?:[—–-] |[•*·] |\d{1,3}[).] |[\w-]+[\t|])")
_THAI_STAYS = re.compile("(?:ฯลฯ|พ\\.ศ|ค\\.ศ)")


def _begins(text: str, at: int) -> bool:
    """Whether what follows may begin a unit: not a small letter, unless capitals follow it (case turned over)."""
    k = _LEAD.match(text, at, at + RIGHT - 4).end()
    if k >= len(text) or k == at + RIGHT - 4:
        return True
    c = text[k]
    if not _CASED_LOWER.match(c):
        return not (c in ",;:" and k == at)
    return bool(_UPPER.match(text[k + 1 : k + 2])) and bool(_UPPER.match(text[k + 2 : k + 3]) or not text[k + 2 : k + 3].isalpha())


def _shortened(text: str, dot: int, after: int) -> bool:
    """Whether the full stop at ``dot`` only marks a shortened word, number or initial."""
    m = _WORD_BEFORE.search(text, max(0, dot - 24), dot)
    if not m:  # a number: goes on before a digit or, as a day, before a month
        return bool(_MONTHS.match(text, after, after + RIGHT)) and text[max(0, dot - 1) : dot].isdigit()
    parts = m.group().replace("\x00", "").replace(" ", "").split(".")
    last = parts[-1]
    if len(last) == 1 and _UPPER.match(last):  # an initial
        return not text[max(0, m.end() - 2) : m.end() - 1].isdigit()
    short = look(last.lower())
    if len(parts) > 1:
        pair = look(f"{parts[-2]}.{last}".lower())
        if pair in _MAY_END:
            return False
        if pair in _NEVER:
            return True
    if len(last) == 1 and _SECOND_PART.match(text, after, after + RIGHT):
        return True
    if short in _AFTER_NUMBER:
        if _NUMBER_BEFORE.search(text, max(0, m.end() - len(last) - 6), m.end() - len(last)):
            return False
        return short != look("в")
    return short in _NEVER


def _opens(text: str, at: int) -> bool:
    """Whether the sign “, which closes in German, opens here."""
    after, before = text[at + 1 : at + 2], text[at - 1 : at] if at else ""
    if _CJK.match(after):
        return True
    return bool(after.strip()) and (not before or before.isspace() or before in "(—:「\x00")


STOP, OPEN, CLOSE, NEWLINE, TABULATOR = range(5)


def _events(text: str, start: int, end: int) -> Iterator[tuple[int, int, object, object]]:
    """Symbols of the transducer that end in text[start:end]: (what, position, kind, whether a unit may end).

    Positions are ends, exclusive.  A unit may end never, always, if the line didn't begin with a dash ("reply"),
    or if the quotation was reported after a colon ("cjk").  The kind of a line's end is its table's key.
    """
    n = len(text)
    for m in _EVENT.finditer(text, max(0, start - LEFT)):
        a, b = m.span()
        if b > end:
            break
        if b <= start:
            continue
        a = max(a, b - LEFT)  # of a longer run of stops no more is looked at, wherever the chunk begins
        c = text[a]
        if c == "\n":
            k = _GAP.match(text, b, b + RIGHT).end()
            ends = "\n" in text[b:k] or k >= n and k < b + RIGHT or bool(_NEW_ITEM.match(text, b, b + RIGHT)) or "฀" <= text[max(0, a - 1) : a].strip("\r\x00") <= "๿"
            yield NEWLINE, a, (ends, _dashed(text, b)), ends
            continue
        if c == "\t":
            yield TABULATOR, b, None, False
            continue
        if c == "\"":
            before, after = text[a - 1 : a], text[b : b + 1]
            if (not before or before.isspace() or before in "(—") and not after.isspace():
                yield OPEN, b, 2, False
                continue
            yield CLOSE, b, (2,), bool(before) and before in _TERMINALS and _begins(text, b)
            continue
        if c in _OPEN and (c != "“" or _opens(text, a)):
            kind = _OPEN[c]
            if kind == 2 and c == "“" and a and text[a - 1] in "：:":
                kind = _REPORTED
            yield OPEN, b, kind, False
            continue
        if c in _CLOSE:
            kinds = _CLOSE[c]
            before = text[max(0, a - 4) : a].replace("\x00", "")[-1:]
            ends = before in _TERMINALS and bool(before) or before == ":" and bool(re.match("[԰-֏]", text[max(0, a - 2) : a - 1]))
            if ends:
                nxt = text[b : b + 1]
                if nxt in "」』" and nxt or nxt in _TERMINALS and nxt or nxt in ",，、)" and nxt:
                    ends = False
                elif _CJK.match(nxt):
                    # author's words follow a quotation that begins its sentence
                    ends = c == "”" and nxt not in "" or c in "」』" and nxt != "と"
                    yield CLOSE, b, kinds, (ends if c != "”" else "cjk")
                    continue
                else:
                    dash = _after_dash(text, b)
                    ends = dash != "always" and _begins(text, b) and (dash or True)
            yield CLOSE, b, kinds, ends
            continue
        if c in " \x00":  # a space between Thai words
            around = text[max(0, a - 4) : a], text[b : b + 4]
            if b - a < LEFT - 4 and not _THAI_STAYS.search(around[0]) and not _THAI_STAYS.match(around[1]):
                yield STOP, a, 0, True
            continue
        # a run of stops
        if text[b : b + 1] == "\"" or text[b : b + 1] in _CLOSE and not (text[b] == "“" and _opens(text, b)):
            continue  # the closing decides
        nxt = text[b : b + 1]
        if c == "." and b - a == 1:
            if nxt and not nxt.isspace() and nxt != "\x00":
                before = text[max(0, a - 2) : a]
                if not (_UPPER.match(nxt) and len(before) == 2 and before.isalpha() and before[-1:].islower() or _UPPER.match(nxt) and re.search(r"т\. ?[дп]$", text[max(0, a - 5) : a])):
                    continue
            if _shortened(text, a, b):
                continue
            if not _begins(text, b):
                continue
        elif set(text[a:b]) <= {"…", "."}:
            if _CJK.match(nxt) or not _begins(text, b) or nxt in ",;":
                continue
            if nxt and not nxt.isspace() and nxt != "\x00" and not _UPPER.match(nxt):
                continue
        else:
            if nxt in ",;" and nxt:
                continue
            if c in "!?…." and not _begins(text, b):
                continue
        dash = _after_dash(text, b)
        if dash != "always":
            yield STOP, b, 0, dash or True


_DASH = re.compile(r"[ \x00]+[—–-][ \x00]")


def _after_dash(text: str, at: int) -> str:
    """Whether author's words, or a further part of the same speech, follow on the same line: "always", "reply" if they do only within a reply, or ""."""
    m = _DASH.match(text, at, at + RIGHT - 1)
    if not m:
        return ""
    return "reply" if _UPPER.match(text[m.end() : m.end() + 1]) else "always"


def _dashed(text: str, at: int) -> bool:
    """Whether a line begins with a dash."""
    return text[at : at + RIGHT].lstrip(" \t\x00")[:1] in ("—", "–", "-")


def _last_visible(text: str, at: int, floor: int) -> int:
    while at > floor and (text[at - 1].isspace() or text[at - 1] == "\x00"):
        at -= 1
    return at


def _mask(states: bytes, may: object, before: bytes) -> int:
    """The entry states from which a unit ends at a symbol."""
    return sum(1 << e for e, s in enumerate(states) if s % N_OPEN == 0 and (may is True or (before[e] % N_OPEN == _REPORTED if may == "cjk" else s % WITH_TAB < IN_REPLY)))


def chunk_function(text: str, start: int, end: int, base: int) -> tuple[bytes, int, list[tuple[int, int]]]:
    """Transition function of text[start:end], the position of its last visible character, and its possible unit ends as (position, set of entry states).

    Positions are 1-based; 0 stands for the last visible character before the text that is given.
    """
    states, known = bytes(range(N_STATES)), {}
    ends: list[tuple[int, int]] = []
    if base == 0 and start == 0 and _dashed(text, 0):
        states = states.translate(LINE[False, True])
    for what, at, kind, may in _events(text, start, end):
        before = states
        if what == OPEN:
            states = states.translate(PUSH[kind])
        elif what == CLOSE:
            states = states.translate(POP[kind])
        elif what == TABULATOR:
            states = states.translate(TAB)
        elif what == NEWLINE:
            states = states.translate(LINE[kind])
        if what == NEWLINE:
            mask = (1 << N_STATES) - 1 if may else sum(1 << e for e, s in enumerate(before) if s >= WITH_TAB)
        elif not may:
            continue
        else:
            key = (states, may, before if may == "cjk" else b"")
            mask = known[key] if key in known else known.setdefault(key, _mask(states, may, before))
        if mask:
            seen = _last_visible(text, at, 0)
            ends.append((base + seen if seen else 0, mask))
    seen = _last_visible(text, end, 0)
    return states, base + seen if seen else 0, ends


def _single(text: str) -> list[int]:
    """Unit ends of a text that is one chunk: the transducer from its first state."""
    state, ends = IN_REPLY * _dashed(text, 0), []
    for what, at, kind, may in _events(text, 0, len(text)):
        before = state
        if what == OPEN:
            state = PUSH[kind][state]
        elif what == CLOSE:
            state = POP[kind][state]
        elif what == TABULATOR:
            state = TAB[state]
        elif what == NEWLINE:
            state = LINE[kind][state]
            if may or before >= WITH_TAB:
                ends.append(_last_visible(text, at, 0))
            continue
        if may and state % N_OPEN == 0 and (may is True or (before % N_OPEN == _REPORTED if may == "cjk" else state % WITH_TAB < IN_REPLY)):
            ends.append(_last_visible(text, at, 0))
    return ends


def _entered(state: int, visible: int, chunks: Iterable[tuple[bytes, int, list[tuple[int, int]]]]) -> tuple[int, int, list[int]]:
    """Runs chunks in order from an entry state: (state, last visible position, unit ends)."""
    out: list[int] = []
    for fn, seen, ends in chunks:
        out += [p or visible for p, mask in ends if mask >> state & 1]
        state, visible = fn[state], seen or visible
    return state, visible, out


def sentence_ends(text: str | None, chunk: int = CHUNK) -> list[int]:
    """1-based positions of the last characters of all units; the plain form of the operator."""
    if not text or not text.strip():
        return []
    view = text.translate(_WIDE)
    if len(view) <= chunk:
        ends = _single(view)
    else:
        pieces = ((max(0, a - LEFT), a) for a in range(0, len(view), chunk))
        ends = _entered(0, 0, (chunk_function(view[at : a + chunk + RIGHT], a - at, min(a + chunk, len(view)) - at, at) for at, a in pieces))[2]
    return sorted({*ends, _last_visible(view, len(view), 0)} - {0})


_ALL = ((1 << N_STATES) - 1).to_bytes(16, "little")


def sentence_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """Unit ends of each document: id, ``end_pos``, and ``start_pos`` of the unit.

    Texts of one chunk (nearly all) are solved where they are read, and move no more.  Longer ones are
    cut in the JVM and their chunks spread over the cluster; what comes together is the functions and unit ends
    of ``block`` chunks, and for a whole document one function (124 bytes) for each block.
    """
    id_type = dict(docs.dtypes)[id_col]
    n = F.ceil(F.length("text") / F.lit(float(chunk))).cast("int")
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null and text rlike '\\\\S'").withColumn("row", F.monotonically_increasing_id())
    cut = read.select("id", "row", n.alias("n"), F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(
        k.alias("k"), F.substring("text", F.greatest(k * chunk - LEFT, F.lit(0)) + 1, F.least(k * chunk, F.lit(LEFT)) + chunk + RIGHT).alias("piece")))).alias("c"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, row, count, k, piece in zip(b["id"], b["row"], b["n"], b["k"], b["piece"]):
                view = piece.translate(_WIDE)
                if count == 1:
                    out.append((i, row, k, count, b"", 0, sorted({*_single(view), _last_visible(view, len(view), 0)} - {0}), []))
                    continue
                off = min(k * chunk, LEFT)
                fn, seen, got = chunk_function(view, off, min(off + chunk, len(view)), k * chunk - off)
                ends, masks = [p for p, _ in got], [m.to_bytes(16, "little") for _, m in got]
                if k == count - 1:
                    ends.append(seen)
                    masks.append(_ALL)
                out.append((i, row, k, count, fn, seen, ends, masks))
            yield pd.DataFrame(out, columns=["id", "row", "k", "n", "fn", "seen", "ends", "masks"])

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row, number, chunks in zip(b["row"], b["block"], b["chunks"]):
                fn, seen = bytes(range(N_STATES)), 0
                for c in chunks:
                    fn, seen = fn.translate(c["fn"] + bytes(256 - N_STATES)), c["seen"] or seen
                out.append((row, number, fn, seen))
            yield pd.DataFrame(out, columns=["row", "block", "fn", "seen"])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row, blocks in zip(b["row"], b["blocks"]):
                state = visible = 0
                for x in blocks:
                    out.append((row, x["block"], state, visible))
                    state, visible = x["fn"][state], x["seen"] or visible
            yield pd.DataFrame(out, columns=["row", "block", "state", "visible"])

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, row, number, chunks, state, visible in zip(b["id"], b["row"], b["block"], b["chunks"], b["state"], b["visible"]):
                told = ((c["fn"], c["seen"], [(p, int.from_bytes(m, "little")) for p, m in zip(c["ends"], c["masks"])]) for c in chunks)
                ends = sorted(set(_entered(state, visible, told)[2]) - {0})
                out.append((i, row, number, ends))
            yield pd.DataFrame(out, columns=["id", "row", "block", "ends"])

    solved = checkpointed(cut.select("id", "row", "n", "c.k", "c.piece").mapInPandas(run, f"id {id_type}, row bigint, k int, n int, fn binary, seen int, ends array<int>, masks array<binary>"))
    short = solved.where("n = 1").select("id", "ends", F.lit(0).alias("last"))
    long = solved.where("n > 1").groupBy("id", "row", F.floor(F.col("k") / block).cast("int").alias("block")).agg(F.array_sort(F.collect_list(F.struct("k", "fn", "seen", "ends", "masks"))).alias("chunks"))
    composed = long.mapInPandas(compose, "row bigint, block int, fn binary, seen int")
    entries = composed.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("block", "fn", "seen"))).alias("blocks")).mapInPandas(scan, "row bigint, block int, state int, visible int")
    ended = long.join(entries, ["row", "block"]).mapInPandas(enter, f"id {id_type}, row bigint, block int, ends array<int>")
    before = Window.partitionBy("row").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ended = ended.withColumn("last", F.coalesce(F.max(F.array_max("ends")).over(before), F.lit(0))).select("id", F.filter("ends", lambda e: e > F.col("last")).alias("ends"), "last")
    units = short.unionByName(ended).select("id", F.explode(F.arrays_zip(F.concat(F.array("last"), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0)))).alias("start"), F.col("ends").alias("end"))).alias("u")).where("u.end is not null")
    return units.select(F.col("id").alias(id_col), (F.col("u.start") + 1).alias("start_pos"), F.col("u.end").alias("end_pos"))
