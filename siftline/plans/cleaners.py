"""The cleaners as lifted functions for table models; results are flat, with failures flagged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import admin, dates, geo, numbers, people, taxon, urls, vocab
from ..functions.flags import Staging
from ..operators.rows import mark_duplicates
from .dsl import ifunc, is_reference, sfunc, tfunc


@sfunc
def DateTime(stage: Staging, text: Column, style: str = "num", timezone: str = "+08:00", mark: bool = True, as_of: Column | None = None) -> Column:
    return dates.format_date(stage, text, style, timezone, mark, as_of).shown()


@sfunc
def Number(stage: Staging, low: Column, high: Column | None = None, kind: str = "float", least: float = -423, most: float = 8848, mark: bool = True) -> Column | list[Column]:
    if high is None:
        return numbers.number(stage, low, kind, least, most, mark).shown()
    return [end.shown() for end in numbers.number_range(stage, low, high, kind, least, most, mark)]


@sfunc
def GeoCoordinate(stage: Staging, text: Column) -> list[Column]:
    return [part.shown() for part in geo.coordinates(stage, text)]


@sfunc
def HumanName(stage: Staging, text: Column, separator: str = "，") -> Column:
    return people.person_names(stage, text, separator).shown()


@sfunc
def BioName(stage: Staging, text: Column, style: str = "scientificName") -> list[Column]:
    return taxon.styled_name(stage, text, style)


def RadioInput(text, vocabulary: vocab.Vocabulary | DataFrame, on_unmatched: str = "keep"):
    """Values by a vocabulary; one of many entries is joined as a table, and so is one given as a table (standard, alias, ord)."""
    if is_reference(text) and (isinstance(vocabulary, DataFrame) or len(vocab.lookup(vocabulary)) > vocab.LITERAL_ENTRIES):
        return _joined_vocabulary(text, vocabulary=vocabulary, on_unmatched=on_unmatched)
    return _literal_vocabulary(text, vocabulary, on_unmatched)


@ifunc
def _literal_vocabulary(text: Column, vocabulary: vocab.Vocabulary, on_unmatched: str) -> Column:
    return vocab.standardised(text, vocabulary, on_unmatched)


@tfunc
def _joined_vocabulary(df: DataFrame, inputs: Sequence[str], outputs: Sequence[str], vocabulary: vocab.Vocabulary | DataFrame, on_unmatched: str) -> DataFrame:
    table = vocabulary if isinstance(vocabulary, DataFrame) else vocab.as_table(df.sparkSession, vocabulary)
    out = df if outputs[0] == inputs[0] else df.withColumn(outputs[0], F.col(inputs[0]))
    return vocab.standardise_by_table(out, outputs[0], table, on_unmatched)


@ifunc
def FillNa(text: Column, value: str = "") -> Column:
    return F.coalesce(text, F.lit(value).cast("string")) if value is not None else text


@ifunc
def Url(text: Column) -> Column:
    return urls.urls(text)


@tfunc
def AdminDiv(df: DataFrame, inputs: Sequence[str], outputs: Sequence[str], gazetteer: Sequence[str] | DataFrame = ()) -> DataFrame:
    return admin.match_divisions(df, inputs[0], gazetteer, outputs)


@tfunc
def UniqueID(df: DataFrame, inputs: Sequence[str], outputs: Sequence[str]) -> DataFrame:
    return mark_duplicates(df, inputs).withColumnRenamed(inputs[0], outputs[0])
