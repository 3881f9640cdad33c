"""Corpora of text files with a header: parsing, reading and filtering.

A file has header lines "Name: value", a blank line and a body without blank lines.
Its path is ``<root>/<label>/<number>``.  Fields are taken by position: names are ignored,
a value ends at its second colon, the character after the colon is dropped.
"""

from __future__ import annotations

import os
from abc import ABC, abstractmethod
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import download_file, extract_archive, to_path

# The kinds of texts.
PRIMER_TYPES = ("Рассказ", "Стихотворение", "Сказка", "Пословица", "Загадка", "Песня", "Басня")
WORKS_TYPES = (
    "Протокол", "Прошение", "Стихотворение", "Телеграмма", "Доклад", "Приказ", "Статья", "Выступление", "Беседа",
    "Записка", "Отчет", "Письмо", "Брошюра", "Прокламация", "Постановление", "Резолюция", "Комментарий",
)
N_HEADERS = 7


def _stripped(content: Column) -> Column:
    """As Python's strip: white space of any kind at both ends."""
    return F.regexp_replace(content, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


@dataclass(frozen=True)
class Layout:
    """The seven header fields of a corpus in order, with their types."""

    fields: tuple[tuple[str, str], ...]

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.fields]

    def parse(self, content: Column) -> dict[str, Column]:
        """Columns of a file's content; all null, with ``ok`` false, if it is malformed."""
        parts = F.split(_stripped(content), "\n\n", -1)
        heads = F.split(F.get(parts, F.lit(0)), "\n", -1)
        # the text between the first and second colon, without its first character; null without a colon
        values = F.transform(heads, lambda h: F.substring(F.get(F.split(h, ":", -1), F.lit(1)), 2, 1 << 30))
        usable = (F.size(parts) == 2) & (F.size(heads) >= N_HEADERS)
        raw = {n: F.get(values, F.lit(k)) for k, (n, _) in enumerate(self.fields)}
        typed = {}
        for n, t in self.fields:
            v = raw[n]
            if t == "int":
                v = F.when(_stripped(v).rlike(r"^[+-]?[0-9]+(?:_[0-9]+)*$"), F.replace(_stripped(v), F.lit("_"), F.lit("")).try_cast("int"))
            elif t == "boolean":
                number = F.when(_stripped(v).rlike(r"^[+-]?[0-9]+$"), _stripped(v).try_cast("bigint"))
                v = number != 0
            typed[n] = v
        good = usable
        for n in self.names:
            good = good & raw[n].isNotNull() & typed[n].isNotNull()
        good = F.coalesce(good, F.lit(False))
        out = {n: F.when(good, v) for n, v in typed.items()}
        return out | {"text": F.when(good, F.get(parts, F.lit(1))), "ok": good}


PRIMER = Layout((("grade", "int"), ("book", "string"), ("year", "int"), ("category", "string"), ("type", "string"), ("subject", "string"), ("author", "string")))
WORKS = Layout((("volume", "int"), ("year", "int"), ("type", "string"), ("is_translation", "boolean"), ("source", "string"), ("subject", "string"), ("topic", "string")))


def parse_files(files: DataFrame, layout: Layout = PRIMER, path_col: str = "path", content_col: str = "content", malformed: str = "error") -> DataFrame:
    """Records of a table of files: those whose name begins with a digit, parsed; malformed ones end the query, or are dropped or kept (``ok`` false)."""
    if malformed not in ("error", "drop", "keep"):
        raise ValueError("malformed is error, drop or keep")
    name = F.element_at(F.split(F.col(path_col), "/"), -1)
    named = files.where(name.rlike("^[0-9]"))
    p = layout.parse(F.col(content_col))
    rows = named.select(*(p[n].alias(n) for n in (*layout.names, "text")), F.col(path_col).alias("file"), p["ok"].alias("ok"))
    if malformed == "keep":
        return rows
    if malformed == "drop":
        return rows.where("ok").drop("ok")
    checked = F.when(~F.col("ok"), F.raise_error(F.concat(F.lit("malformed file "), F.col("file")))).otherwise(F.col("text"))
    return rows.withColumn("text", checked).drop("ok")


def filter_records(
    records: DataFrame, *, grade: int | None = None, volume: int | None = None, year: int | None = None, category: str | None = None, text_type: str | None = None, is_translation: bool | None = None,
    book: str | None = None, subject: str | None = None, author: str | None = None, source: str | None = None, topic: str | None = None,
    min_len: int | None = None, max_len: int | None = None, limit: int | None = None, types: tuple[str, ...] | None = None, order: tuple[str, ...] = ("file",),
) -> DataFrame:
    """The conjunction of the given filters; a false value (but for ``is_translation``) is off.

    Checked at once: grade 1-11, volume 1-16, a known type, lengths that aren't negative and in order.
    Equalities and lengths are plain predicates, so those on stored columns reach the scan.
    """
    if grade and not 1 <= grade <= 11:
        raise ValueError("the grade is from 1 to 11")
    if volume and not 1 <= volume <= 16:
        raise ValueError("the volume is from 1 to 16")
    known = types or (PRIMER_TYPES if "grade" in records.columns else WORKS_TYPES)
    if text_type and text_type not in known:
        raise ValueError(f"the type is one of {', '.join(known)}")
    if (min_len or 0) < 0 or (max_len or 0) < 0:
        raise ValueError("lengths aren't negative")
    if min_len and max_len and min_len > max_len:
        raise ValueError("min_len is greater than max_len")
    for name, value in (("grade", grade), ("volume", volume), ("year", year), ("category", category), ("type", text_type)):
        if value:
            records = records.where(F.col(name) == value)
    if is_translation is not None:
        records = records.where(F.col("is_translation") == is_translation)
    for name, pattern in (("book", book), ("subject", subject), ("author", author), ("source", source), ("topic", topic)):
        if pattern:
            records = records.where(F.col(name).rlike(f"(?iu)^.*(?:{pattern}).*"))
    if min_len:
        records = records.where(F.length("text") >= min_len)
    if max_len:
        records = records.where(F.length("text") <= max_len)
    if limit is not None:
        records = records.orderBy(*order).limit(limit)
    return records


class Corpus(ABC):
    """A named corpus with texts and records."""

    def __init__(self, name: str, meta: dict[str, str] | None = None):
        self.name, self.meta = name, meta or {}

    def __repr__(self) -> str:
        return f"Набор данных('{self.name}')"

    @property
    def info(self) -> dict[str, str]:
        return {"Наименование": self.name, **self.meta}

    @abstractmethod
    def check_data(self) -> bool: ...

    @abstractmethod
    def df(self, spark: SparkSession) -> DataFrame: ...

    @abstractmethod
    def get_texts(self, spark: SparkSession, **filters) -> DataFrame: ...

    @abstractmethod
    def get_records(self, spark: SparkSession, **filters) -> DataFrame: ...

    @abstractmethod
    def download(self, force: bool = False) -> None: ...


@dataclass
class FileCorpus(Corpus):
    """A corpus of header-and-body files in one folder for each label."""

    name: str
    layout: Layout
    labels: tuple[str, ...]
    root: str | Path = "data/texts"
    url: str | None = None
    meta: dict[str, str] = field(default_factory=dict)
    malformed: str = "error"

    __repr__ = Corpus.__repr__

    @property
    def folder(self) -> Path:
        return to_path(self.root) / self.name

    @property
    def filepath(self) -> str | None:
        """Path of the downloaded archive, None if there is none."""
        path = to_path(self.root) / f"{self.name}.tar.xz"
        return str(path) if path.is_file() else None

    def check_data(self) -> bool:
        for label in self.labels:
            if not os.path.isdir(self.folder / label):
                raise OSError(f"{self.folder / label} is missing")
        return True

    def download(self, force: bool = False) -> None:
        if not self.url:
            raise RuntimeError("the corpus has no address")
        download_file(self.url, f"{self.name}.tar.xz", self.root, force)
        if self.filepath:
            extract_archive(self.filepath, self.root)
        self.check_data()

    def files(self, spark: SparkSession, labels: tuple[str, ...] | None = None) -> DataFrame:
        """(path, content) of the files under the labels; only the folders asked for are listed."""
        paths = [str(self.folder / label) for label in labels or self.labels]
        return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))

    def df(self, spark: SparkSession, labels: tuple[str, ...] | None = None) -> DataFrame:
        self.check_data()
        return parse_files(self.files(spark, labels), self.layout, malformed=self.malformed)

    def get_records(self, spark: SparkSession, **filters) -> DataFrame:
        labels = None
        for key in ("grade", "volume"):  # a label is read alone if the filter names it
            if filters.get(key) and f"{key}_{filters[key]}" in self.labels:
                labels = (f"{key}_{filters[key]}",)
        return filter_records(self.df(spark, labels), **filters)

    def get_texts(self, spark: SparkSession, **filters) -> DataFrame:
        return self.get_records(spark, **filters).select("text")


def primer_corpus(root: str | Path = "data/texts", url: str | None = None, labels: tuple[str, ...] = ("grade_1",)) -> FileCorpus:
    return FileCorpus("primer", PRIMER, labels, root, url)


def works_corpus(root: str | Path = "data/texts", url: str | None = None) -> FileCorpus:
    return FileCorpus("works", WORKS, tuple(f"volume_{k}" for k in range(1, 17)), root, url)
