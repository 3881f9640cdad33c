"""Visually identical text with different characters (problem 5).

Method: for each token the sets of scripts that its characters may belong to are
intersected; an empty intersection is a mixed-script confusable, a token all of
whose letters have doubles in the script of the document is a whole-script one.
Either is spelt anew in the script that can spell all of it (of several, the
document's main one), and the remaining forms (width, combining accents, invisible
characters, spaces) are normalised.  The key of a text's look comes from the same
intersection: each token is spelt in the first script that can spell all of it, whatever
the document's main one, and only a token that no script can spell goes letter by letter;
texts with one key read the same and texts that differ visibly have different keys.

Scale: one pass over the texts; then 128-bit digests move.  Copies of a text are combined before
they meet other spellings of it, and a text with more than ``HOT`` copies is spread over tasks by its ids.

Defined results for odd input: a null text has a null form and look and is in no
class; blank texts get a form but belong to no pair; very long texts are handled
whole; repeated equal texts form one member of a class with several documents;
an empty table gives an empty table; only the id and text columns are read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import md5

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import checkpointed

# Letters that look the same, one class per group, as Latin, Cyrillic, Greek
# (a dot where a script has none).
DOUBLES = (
    "aа. bЬ. cсϲ eе. iі. jјϳ oоο pрρ sѕ. xх. yу. hһ. qԛ. wԝ. dԁ. lӏ. vѵν "
    "AАΑ BВΒ CСϹ EЕΕ HНΗ IІΙ JЈ. KКΚ MМΜ OОΟ PРΡ SЅ. TТΤ XХΧ YҮΥ ZꓜΖ N.Ν GԌ. QԚ. WԜ. "
    ".ГΓ .ПΠ .ФΦ .Лᴧ ëё. ËЁ. ïї. ÏЇΪ èѐ. ÈЀ. ..."
).split()
DOUBLES = tuple(g for g in DOUBLES if len(g) == 3 and g not in ("bЬ.", "..."))
SCRIPTS = ("Latin", "Cyrillic", "Greek")
#: Copies of one text that one task pairs; texts that have more are at most ``MAX_HOT``, as the bound rises with the rows.
HOT, MAX_HOT = 50_000, 20_000

_SPELT: dict[str, dict[str, str]] = {s: {} for s in SCRIPTS}  # script -> letter -> its double there
_LOOK: dict[int, str] = {}
for _g in DOUBLES:
    _first = next(c for c in _g if c != ".")
    for _c in _g:
        if _c != ".":
            if _c != _first:
                _LOOK[ord(_c)] = _first
            for _s, _d in zip(SCRIPTS, _g):
                if _d != ".":
                    _SPELT[_s][_c] = _d

_SPACES = "               　"
_INVISIBLE = "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩⁪⁫⁬⁭⁮⁯︀︁︂︃︄︅︆︇︈︉︊︋︌︍︎️﻿\r"
#: One pass over the characters: width forms, spaces and invisible characters.
_FORMS = {ord(c): " " for c in _SPACES} | {ord(c): None for c in _INVISIBLE}
_FORMS |= {c: unicodedata.normalize("NFKC", chr(c)) for c in [*range(0xFF01, 0xFFE7)] if unicodedata.name(chr(c), "").startswith(("FULLWIDTH", "HALFWIDTH"))}
_FORMS[0xFF9E], _FORMS[0xFF9F] = "゙", "゚"  # voiced marks join the letter before
_TOUCHED = re.compile("[" + "".join(map(re.escape, map(chr, sorted(_FORMS)))) + "]")
_COMBINING = re.compile("[̀-ͯ҃-֑҇-ׇً-़゙゚ٰٕKÅΩ]")
_MIXABLE = re.compile("[A-Za-zËÏëïÈèͰ-Ͽ]")
_CYR = re.compile("[Ѐ-ԯ]")
_GREEK = re.compile("[Ͱ-Ͽ]")
_LATIN = re.compile("[A-Za-zÀ-ɏ]")


#: Tokens with a letter that is not of the document's main script.
_JOINED = r"(?:[^\W\d_]|['’ʼ-](?=[^\W\d_]))*"
_FOREIGN = {s: re.compile(rf"(?<![^\W\d_])[^\W\d_]*[{f}]{_JOINED}") for s, f in (("Latin", "Ͱ-ԯ"), ("Cyrillic", "A-Za-zÀ-ɏͰ-Ͽ"), ("Greek", "A-Za-zÀ-ɏЀ-ԯ"))}


def _script_counts(text: str) -> dict[str, int]:
    return {"Latin": len(_LATIN.findall(text)), "Cyrillic": len(_CYR.findall(text)), "Greek": len(_GREEK.findall(text))}


def _possible(token: str) -> set[str] | None:
    """Intersection of the scripts in which each letter of a token can be spelt; None: letters of other scripts."""
    left = set(SCRIPTS)
    for c in token:
        if c in "'’ʼ-":
            continue
        own = "Latin" if _LATIN.match(c) else "Cyrillic" if _CYR.match(c) else "Greek" if _GREEK.match(c) else None
        if own is None:
            return None
        left &= {own, *(s for s in SCRIPTS if c in _SPELT[s])}
    return left


@lru_cache(maxsize=1 << 16)
def _spell(token: str, order: tuple[str, ...]) -> str:
    """A token in the script that its letters have in common; of several, the first in ``order``."""
    possible = _possible(token)
    if not possible:
        return token
    own = {s for s, pattern in (("Latin", _LATIN), ("Cyrillic", _CYR), ("Greek", _GREEK)) if pattern.search(token)}
    script = next(s for s in order if s in possible)
    if own == {script} or len(own) == 1 and script != order[0]:
        return token
    return "".join(_SPELT[script].get(c, c) for c in token)


def normal_form(text: str | None) -> str | None:
    """One form of a text under which texts that look the same are equal (up to ``look``)."""
    if text is None:
        return None
    if not text.isascii() and _TOUCHED.search(text) or "\r" in text:
        text = text.translate(_FORMS)
    if text.isascii():
        return text
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    if not _MIXABLE.search(text) or not (_CYR.search(text) or _GREEK.search(text)):
        return text
    counts = _script_counts(text)
    order = tuple(sorted(SCRIPTS, key=lambda s: (-counts[s], s)))
    return _FOREIGN[order[0]].sub(lambda m: _spell(m.group(), order), text)


def look(form: str | None) -> str | None:
    """The normal form with each letter replaced by the first of its look-alikes."""
    return None if form is None else form if form.isascii() else form.translate(_LOOK)


_TOKEN = re.compile(r"[^\W\d_]+")
_DOUBLED = re.compile(rf"(?<![^\W\d_])[{''.join(map(chr, _LOOK))}]+(?![^\W\d_])")


@lru_cache(maxsize=1 << 16)
def _spell_first(token: str) -> str:
    possible = _possible(token)
    if possible is None:
        return token
    if not possible:
        return token.translate(_LOOK)
    script = next(s for s in SCRIPTS if s in possible)
    return "".join(_SPELT[script].get(c, c) for c in token)


def resolved_look(form: str | None) -> str | None:
    """A normal form with each token in the first script that can spell it; equal for two forms just where they look the same."""
    if form is None or form.isascii():
        return form
    # of letters of one script only tokens whose letters all have doubles can be spelt in an earlier one
    tokens = _TOKEN if _GREEK.search(form) or _LATIN.search(form) else _DOUBLED
    return tokens.sub(lambda m: _spell_first(m.group()), form)


def normalise_lookalikes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_form: bool = True) -> DataFrame:
    """One row for each document: id, ``form`` (its consistent spelling), ``look_key`` and ``text_key``.

    Row-local; the keys are 128-bit digests, so no later step moves texts.
    """
    id_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            forms = [normal_form(t) for t in b["text"]]
            keys = [None if f is None else md5(resolved_look(f).encode("utf-8", "surrogatepass")).hexdigest() for f in forms]
            out = pd.DataFrame({"id": b["id"], "look_key": keys, "text_key": b["text_key"], "visible": [f is not None and not f.isspace() and f != "" for f in forms]})
            if keep_form:
                out.insert(1, "form", forms)
            yield out

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.md5(F.col(text_col)).alias("text_key"))
    form = "form string, " if keep_form else ""
    return read.mapInPandas(run, f"id {id_type}, {form}look_key string, text_key string, visible boolean").withColumnRenamed("id", id_col)


def lookalike_classes(forms: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(spellings, members) of the looks that have two or more different texts.

    spellings: look_key, text_key, copies and the least id of the text (``first``).  members: id, look_key, text_key, and
    ``part`` of ``parts``, by which the copies of one text are spread.
    """
    spelt = checkpointed(forms.where("look_key is not null and visible").select(id_col, "look_key", "text_key"))
    texts = spelt.groupBy("look_key", "text_key").agg(F.count("*").alias("copies"), F.min(id_col).alias("first"))
    several = texts.groupBy("look_key").agg(F.count("*").alias("spellings")).where("spellings > 1").select("look_key")
    texts = checkpointed(texts.join(several, "look_key", "left_semi"))
    hot = max(HOT, spelt.count() // MAX_HOT)
    parts = F.greatest(F.ceil(F.col("copies") / F.lit(hot)), F.lit(1)).cast("int").alias("parts")
    heavy = F.broadcast(texts.where(F.col("copies") > hot).select("look_key", "text_key", parts))  # at most MAX_HOT rows
    light = texts.where(F.col("copies") <= hot).select("look_key", "text_key", F.lit(1).alias("parts"))
    keys = ["look_key", "text_key"]
    members = spelt.join(heavy, keys).unionByName(spelt.join(heavy, keys, "left_anti").join(light, keys))
    return texts.select(*keys, "copies", "first", parts), members.withColumn("part", F.pmod(F.xxhash64(id_col), F.col("parts")).cast("int"))


def class_members(forms: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each document that looks like a different text: id, its class (least id of the look), and its spelling (least id of the text)."""
    texts, members = lookalike_classes(forms, id_col)
    classes = texts.groupBy("look_key").agg(F.min("first").alias("class"), F.count("*").alias("spellings"))
    told = texts.join(classes, "look_key").select("look_key", "text_key", F.col("first").alias("spelling"), "class", "spellings", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return members.join(told, ["look_key", "text_key", "part"]).select(id_col, "class", "spelling", "spellings")


def lookalike_pairs(forms: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """All pairs of documents of one look with different texts, the smaller id first.

    Different spellings are paired first, each once however many copies it has; then either side's copies are put
    in, part by part.  The result is by definition all such pairs; exact copies are never paired with each other.
    """
    texts, members = lookalike_classes(forms, id_col)
    a, b = (texts.select("look_key", F.col("text_key").alias(f"text_{x}"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(f"part_{x}")) for x in "ab")
    pairs = a.join(b, "look_key").where("text_a < text_b").drop("look_key")
    for x in "ab":
        pairs = pairs.join(members.select(F.col("text_key").alias(f"text_{x}"), F.col("part").alias(f"part_{x}"), F.col(id_col).alias(f"id_{x}")), [f"text_{x}", f"part_{x}"])
    return pairs.select(F.least("id_a", "id_b").alias(f"{id_col}_a"), F.greatest("id_a", "id_b").alias(f"{id_col}_b"))
