"""Sizes of texts in tokens, for the operators that fill and mix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import TOKEN_RE
from ..sources.shared import checkpointed


def token_size(text: Column) -> Column:
    """Number of tokens of a text: matches of the token pattern; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN_RE)), F.lit(0)).cast("bigint")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Callable[[Column], Column] = token_size) -> DataFrame:
    """(id, source, size) of each document, written once to the shared folder: texts are read and cut into tokens a single time.

    ``size`` may be any column function of the text, so another public tokenizer can stand in.
    """
    return checkpointed(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size(F.col(text_col)).alias("size")))
