"""Controlled vocabularies: {standard: [aliases]}, the first standard with an alias winning."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .flags import looked_up

Vocabulary = Mapping[str, Sequence[str]]
#: Up to so many entries a vocabulary is constant arrays that a row is compared with; beyond, a table to join.
LITERAL_ENTRIES = 300


def load_vocabularies(path: str) -> dict[str, Vocabulary]:
    """Vocabularies by name, from a JSON file on the driver."""
    with open(path, encoding="utf-8") as source:
        return json.load(source)


def lookup(vocabulary: Vocabulary) -> dict[str, str]:
    """Each alias and standard value to its standard value."""
    out = {standard: standard for standard in vocabulary}
    for standard, aliases in vocabulary.items():
        for alias in aliases:
            out.setdefault(alias, standard)
    return out


def as_table(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    """The vocabulary as a table (standard, alias, ord); a standard term without aliases is its own."""
    pairs = [(standard, alias) for standard, aliases in vocabulary.items() for alias in aliases or [standard]]
    return spark.createDataFrame([(s, a, k) for k, (s, a) in enumerate(pairs)], "standard string, alias string, ord long")


def _unmatched(raw: Column, known: Column, on_unmatched: str) -> Column:
    if on_unmatched not in ("keep", "flag", "null"):
        raise ValueError(f"on_unmatched is keep, flag or null, not {on_unmatched}")
    missing = {"keep": raw, "flag": F.concat(F.lit("!"), raw), "null": F.lit(None).cast("string")}[on_unmatched]
    return F.coalesce(known, missing)


def standardised(text: Column, vocabulary: Vocabulary, on_unmatched: str = "keep") -> Column:
    """Values by a vocabulary of at most LITERAL_ENTRIES entries."""
    entries, raw = lookup(vocabulary), text.cast("string")
    if len(entries) > LITERAL_ENTRIES:
        raise ValueError("join a vocabulary of this size with standardise_by_table(); RadioInput in a model does")
    known = looked_up(raw, entries) if entries else F.lit(None).cast("string")
    return _unmatched(raw, known, on_unmatched)


def standardise_by_table(df: DataFrame, column: str, vocabulary: DataFrame, on_unmatched: str = "keep") -> DataFrame:
    """df with its column, read as text, standardised by a table (standard, alias, ord) of any size; an alias may repeat."""
    pairs = vocabulary.select(F.col("standard").alias("__std"), F.col("alias").alias("__alias"), F.col("ord").alias("__ord"))
    pairs = pairs.unionByName(vocabulary.select(F.col("standard").alias("__std"), F.col("standard").alias("__alias"), F.lit(-1).cast("long").alias("__ord")))
    first = pairs.groupBy("__alias").agg(F.min_by("__std", "__ord").alias("__std"))
    raw = F.col(column).cast("string")
    joined = df.join(first, raw == F.col("__alias"), "left")
    shown = _unmatched(raw, F.col("__std"), on_unmatched)
    return joined.select(*[shown.alias(c) if c == column else F.col(c) for c in df.columns])


def unmatched_values(df: DataFrame, column: str, vocabulary: Vocabulary) -> DataFrame:
    """Values that the vocabulary lacks, and how often they occur."""
    known = list(lookup(vocabulary))
    rest = df.where(F.col(column).isNotNull() & ~F.col(column).isin(*known))
    return rest.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def with_aliases(vocabulary: Vocabulary, learned: Mapping[str, str]) -> dict[str, list[str]]:
    """The vocabulary with further aliases {alias: standard}, for the caller to keep."""
    out = {k: list(v) for k, v in vocabulary.items()}
    for alias, standard in learned.items():
        out.setdefault(standard, []).append(alias)
    return out
