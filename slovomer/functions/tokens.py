"""Sentences, words and n-grams of a text as array columns.

A spec is a frozen description, checked when it is made; ``column`` turns it into one
expression over a text column, so Catalyst plans it and no row leaves the JVM, except
where a Python function is the tokenizer.
"""

from __future__ import annotations

import re
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .patterns import BOUNDARY_RE, PUNCTUATIONS, TOKEN_RE

Tokenizer = re.Pattern | Callable[[str], Iterable[str]] | None
_MARK = "\x01"


def java_pattern(pattern: re.Pattern) -> str:
    """A compiled Python pattern for Java's engine, with Unicode classes as in Python."""
    flags = "U" if not pattern.flags & re.ASCII else ""
    flags += "".join(f for f, bit in (("iu", re.IGNORECASE), ("s", re.DOTALL), ("m", re.MULTILINE), ("x", re.VERBOSE)) if pattern.flags & bit)
    return f"(?{flags}){pattern.pattern}" if flags else pattern.pattern


def by_function(tokenizer: Callable[[str], Iterable[str]]) -> Callable[[Column], Column]:
    """A Python tokenizer as a vectorised column function; whatever it raises ends the query as a TypeError."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[str] | None:
            if text is None:
                return None
            try:
                return [str(x) for x in tokenizer(text)]
            except Exception as e:
                raise TypeError(f"the tokenizer failed: {e}") from e

        return texts.map(one, na_action="ignore")

    return cut.asNondeterministic()  # else it is moved into generators, where no Python runs


def _checked(tokenizer: Tokenizer) -> None:
    if tokenizer is not None and not isinstance(tokenizer, re.Pattern) and not callable(tokenizer):
        raise TypeError("a tokenizer is a compiled pattern or a function")


def _lengths(words: Column, low: int, high: int) -> Column:
    if low:
        words = F.filter(words, lambda w: F.length(w) >= low)
    return F.filter(words, lambda w: F.length(w) <= high) if high else words


class Extractor(ABC):
    """Base of all extractors: something that turns a text column into an array column."""

    @abstractmethod
    def column(self, text: Column) -> Column: ...


@dataclass(frozen=True)
class SentSpec(Extractor):
    """Sentences: by the default boundaries, by a separator pattern (empty pieces stay), or by a function."""

    tokenizer: Tokenizer = None
    min_len: int = 0
    max_len: int = 0

    def __post_init__(self) -> None:
        _checked(self.tokenizer)
        if self.min_len and self.max_len and self.min_len > self.max_len:
            raise ValueError("min_len is greater than max_len")

    def column(self, text: Column) -> Column:
        if self.tokenizer is None:
            cut = F.split(F.regexp_replace(text, F.lit(BOUNDARY_RE), F.lit(f"$1{_MARK}$2")), _MARK, -1)
            sents = F.when(text.rlike("\\S"), cut).otherwise(F.when(text.isNotNull(), F.array().cast("array<string>")))
        elif isinstance(self.tokenizer, re.Pattern):
            sents = F.split(text, java_pattern(self.tokenizer), -1)
        else:
            sents = by_function(self.tokenizer)(text)
        return _lengths(sents, self.min_len, self.max_len)


@dataclass(frozen=True)
class WordSpec(Extractor):
    """Words: tokenize, drop punctuation, numbers, map to lemmas, drop stop words, lower, by length, n-grams, in this order.

    ``lemmas`` is a small dictionary (word in lower case to lemma); a lexicon table is
    joined by ``operators.words.extract_words`` instead.
    """

    tokenizer: Tokenizer = None
    filter_punct: bool = True
    filter_nums: bool = False
    use_lexemes: bool = False
    stopwords: tuple[str, ...] = ()
    lowercase: bool = False
    min_len: int = 0
    max_len: int = 0
    ngram_range: tuple[int, int] = (1, 1)
    lemmas: dict[str, str] | None = field(default=None, hash=False)

    def __post_init__(self) -> None:
        _checked(self.tokenizer)
        if self.min_len and self.max_len and self.min_len > self.max_len:
            raise ValueError("min_len is greater than max_len")
        if self.ngram_range[0] > self.ngram_range[1]:
            raise ValueError("the n-gram range goes down")

    def tokens(self, text: Column) -> Column:
        """The words up to the filters that come before lemmas."""
        if self.tokenizer is None:
            words = F.regexp_extract_all(text, F.lit(TOKEN_RE), F.lit(0))
        elif isinstance(self.tokenizer, re.Pattern):
            words = F.split(text, java_pattern(self.tokenizer), -1)
        else:
            words = by_function(self.tokenizer)(text)
        if self.filter_punct:
            words = F.filter(words, lambda w: ~F.lit(PUNCTUATIONS).contains(w))
        if self.filter_nums:
            words = F.filter(words, lambda w: ~w.rlike(r"^\p{N}+$"))
        return words

    def finish(self, words: Column) -> Column:
        """The steps that come after lemmas."""
        if self.stopwords:
            stop = F.array(*map(F.lit, self.stopwords))
            words = F.filter(words, lambda w: ~F.array_contains(stop, w))
        if self.lowercase:
            words = F.transform(words, F.lower)
        words = _lengths(words, self.min_len, self.max_len)
        return words if tuple(self.ngram_range) == (1, 1) else ngrams(words, *self.ngram_range)

    def column(self, text: Column) -> Column:
        words = self.tokens(text)
        if self.use_lexemes and self.lemmas:
            table = F.create_map(*(F.lit(x) for kv in self.lemmas.items() for x in kv))
            words = F.transform(words, lambda w: F.coalesce(F.element_at(table, F.lower(w)), F.lower(w)))
        elif self.use_lexemes:
            words = F.transform(words, F.lower)
        return self.finish(words)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: inside other lambdas an expression would be computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def span(words: Column, start: Column, size: Column | int) -> Column:
    """``size`` elements from a start counted from 0, each got by its place: a slice would copy the whole array first."""
    return F.transform(F.sequence(F.lit(0), F.lit(size) - 1 if isinstance(size, int) else size - 1), lambda j: F.get(words, start + j))


def ngrams(words: Column, low: int, high: int) -> Column:
    """All n-grams of low to high words, joined by "_", shorter ones first."""

    def grams(w: Column, n: int) -> Column:
        one = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.concat_ws("_", *(F.get(w, i + k) for k in range(n))))
        return F.when(F.size(w) >= n, one).otherwise(F.array().cast("array<string>"))

    def of(w: Column) -> Column:
        return F.when(w.isNotNull(), F.concat(*(grams(w, n) for n in range(max(low, 1), high + 1))))

    return bound(words, of)
