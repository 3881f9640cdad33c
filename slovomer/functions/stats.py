"""Counts, ratios and readability of one text, as expressions over its words and sentences."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import COMPLEX_SYLLABLES, LONG_WORD, PUNCTUATIONS, RU_LETTERS, RU_VOWELS, SPACES


@dataclass(frozen=True)
class Alphabet:
    """The letters that count as vowels and as letters."""

    vowels: str = RU_VOWELS
    letters: str = RU_LETTERS
    punctuations: str = PUNCTUATIONS
    spaces: str = SPACES


RU = Alphabet()
LATIN = Alphabet("aeiouyAEIOUYäöüÄÖÜáàâéèêëíîïóôúûùœæ", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZäöüßÄÖÜáàâçéèêëíîïñóôúûùœæ")


def safe_divide(numerator: Column, denominator: Column, default: float | None = 0.0) -> Column:
    """The quotient, or the default where the denominator is 0 or null."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(default).cast("double"))


def count_in(text: Column, characters: str) -> Column:
    """How many characters of a text are in a set."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def count_syllables(word: Column, alphabet: Alphabet = RU) -> Column:
    return count_in(word, alphabet.vowels)


COUNTS = ("n_sents", "n_words", "n_unique_words", "n_long_words", "n_complex_words", "n_simple_words", "n_monosyllable_words", "n_polysyllable_words", "n_chars", "n_letters", "n_spaces", "n_syllables", "n_punctuations")
WORD_RATIOS = ("unique_words", "long_words", "complex_words", "simple_words", "monosyllable_words", "polysyllable_words")
CHAR_RATIOS = ("letters", "spaces", "punctuations")
RATIOS = tuple(f"p_{x}" for x in (*WORD_RATIOS, *CHAR_RATIOS))
READABILITY = ("flesch_kincaid_grade", "flesch_reading_easy", "coleman_liau_index", "smog_index", "automated_readability_index", "lix")


def basic_counts(text: Column, words: Column, sents: Column, syllables: Column, alphabet: Alphabet = RU) -> dict[str, Column]:
    """The thirteen counts; ``syllables`` is the array of each word's vowels, so they are counted once."""

    def size(cond) -> Column:
        return F.size(F.filter(syllables, cond))

    return {
        k: v.cast("bigint")
        for k, v in {
            "n_sents": F.size(sents),
            "n_words": F.size(words),
            "n_unique_words": F.size(F.array_distinct(F.transform(words, F.lower))),
            "n_long_words": F.size(F.filter(words, lambda w: F.length(w) >= LONG_WORD)),
            "n_complex_words": size(lambda s: s >= COMPLEX_SYLLABLES),
            "n_simple_words": size(lambda s: (s > 0) & (s < COMPLEX_SYLLABLES)),
            "n_monosyllable_words": size(lambda s: s == 1),
            "n_polysyllable_words": size(lambda s: s > 1),
            "n_chars": F.length(F.replace(text, F.lit("\n"), F.lit(""))),
            "n_letters": count_in(text, alphabet.letters),
            "n_spaces": count_in(text, alphabet.spaces),
            "n_syllables": F.aggregate(syllables, F.lit(0), lambda a, s: a + s),
            "n_punctuations": count_in(text, alphabet.punctuations),
        }.items()
    }


def ratios(count=F.col) -> dict[str, Column]:
    """The nine shares, of words and of characters."""
    of_words = {f"p_{x}": F.try_divide(count(f"n_{x}").cast("double"), count("n_words").cast("double")) for x in WORD_RATIOS}
    return of_words | {f"p_{x}": F.try_divide(count(f"n_{x}").cast("double"), count("n_chars").cast("double")) for x in CHAR_RATIOS}


def _per(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def calc_flesch_kincaid_grade(n_syllables: Column, n_words: Column, n_sents: Column, a: float = 0.49, b: float = 7.3, c: float = 16.59) -> Column:
    return a * _per(n_words, n_sents) + b * _per(n_syllables, n_words) - c


def calc_flesch_reading_easy(n_syllables: Column, n_words: Column, n_sents: Column, a: float = 1.3, b: float = 60.1, c: float = 206.835) -> Column:
    return c - a * _per(n_words, n_sents) - b * _per(n_syllables, n_words)


def calc_coleman_liau_index(n_letters: Column, n_words: Column, n_sents: Column, a: float = 0.055, b: float = 0.35, c: float = 20.33) -> Column:
    return a * _per(n_letters, n_words) * 100 - b * _per(n_sents, n_words) * 100 - c


def calc_smog_index(n_complex: Column, n_sents: Column, a: float = 1.1, b: float = 64.6, c: float = 0.05) -> Column:
    return a * F.sqrt(b * _per(n_complex, n_sents)) + c


def calc_automated_readability_index(n_letters: Column, n_words: Column, n_sents: Column, a: float = 6.26, b: float = 0.2805, c: float = 31.04) -> Column:
    return a * _per(n_letters, n_words) + b * _per(n_words, n_sents) - c


def calc_lix(n_long_words: Column, n_words: Column, n_sents: Column) -> Column:
    return _per(n_words, n_sents) + 100 * _per(n_long_words, n_words)


def readability(count=F.col) -> dict[str, Column]:
    """The six indices from the counts; null where there is no sentence or word."""
    syl, words, sents, letters, hard, long = map(count, ("n_syllables", "n_words", "n_sents", "n_letters", "n_complex_words", "n_long_words"))
    return {
        "flesch_kincaid_grade": calc_flesch_kincaid_grade(syl, words, sents),
        "flesch_reading_easy": calc_flesch_reading_easy(syl, words, sents),
        "coleman_liau_index": calc_coleman_liau_index(letters, words, sents),
        "smog_index": calc_smog_index(hard, sents),
        "automated_readability_index": calc_automated_readability_index(letters, words, sents),
        "lix": calc_lix(long, words, sents),
    }
