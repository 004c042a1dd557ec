"""Cleaned values that keep what could not be cleaned, and projections that compute each part once.

A cleaner takes a ``Staging`` and the columns to clean.  It puts its intermediate columns there, one
projection after another, and gives cells, each a value and an issue: the raw text where cleaning
failed, else null.  Nothing is computed twice, and hardly anything is interpreted.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping
from types import SimpleNamespace
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLAG = "!"
#: All decimal digits that are not ASCII, and the ASCII digits they stand for.
DIGITS = "".join(chr(c) for c in range(128, 0x110000) if unicodedata.category(chr(c)) == "Nd")
PLAIN_DIGITS = "".join(str(unicodedata.digit(c)) for c in DIGITS)


def _apart(level: dict[str, Column]) -> dict[str, Column]:
    """The columns of a projection that is not compiled together with its neighbours.

    The method of a compiled stage is not optimised by the JVM beyond 8000 bytes, which a few cleaners
    reach.  A projection with a lambda, here an idle one over one value, is a method group of its own.
    """
    name, column = next(iter(level.items()))
    return level | {name: F.get(F.transform(F.array(column), lambda x: x), F.lit(0))}


class Cell(NamedTuple):
    """A cleaned value, and the raw text where there is none though there should be."""

    value: Column
    issue: Column

    def struct(self) -> Column:
        return F.struct(self.value.alias("value"), self.issue.alias("issue"))

    def shown(self) -> Column:
        """The flat view, in which a failure is the raw text after an exclamation mark."""
        return F.coalesce(self.value.cast("string"), F.concat(F.lit(FLAG), self.issue))


class Staging:
    """Projections in order; the columns of each may read those of the ones before."""

    def __init__(self, prefix: str = "__clean", cut: int = 6):
        self.prefix, self.levels, self.cut = prefix, [], cut

    def keep(self, **columns: Column) -> SimpleNamespace:
        """One more projection; gives its columns by their names."""
        names = {k: f"{self.prefix}_{len(self.levels)}_{k}" for k in columns}
        self.levels.append({names[k]: v for k, v in columns.items()})
        return SimpleNamespace(**{k: F.col(n) for k, n in names.items()})

    def one(self, column: Column) -> Column:
        return self.keep(x=column).x

    def select(self, df: DataFrame, *columns: Column | str) -> DataFrame:
        """Columns of df, by name, and columns made from the projections.

        The made ones pass through inline(), which filters on them do not cross: pushed down, a filter
        would repeat all steps inside itself.  Filters on columns of df do cross it.
        """
        for k, level in enumerate(self.levels, 1):
            df = df.withColumns(_apart(level) if k % self.cut == 0 else level)
        made = [c for c in columns if not isinstance(c, str)]
        if not made:
            return df.select(*columns)
        given = [c for c in columns if isinstance(c, str)]
        out = df.select(*given, F.inline(F.array(F.struct(*made))))
        names = iter(out.columns[len(given) :])
        return out.select(*[f"`{c.strip('`')}`" if isinstance(c, str) else f"`{next(names)}`" for c in columns])


def flagged(value: Column, failed: Column, raw: Column, mark: bool = True) -> Cell:
    """value, or the raw text as an issue where failed (and marks are wanted)."""
    bad = F.coalesce(failed, F.lit(False)) & raw.isNotNull()
    return Cell(F.when(~bad, value), F.when(bad, raw) if mark else F.lit(None).cast("string"))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern, as an array."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def ascii_digits(text: Column) -> Column:
    """Digits of other scripts, full-width ones too, as ASCII digits."""
    return F.when(text.rlike(r"[\p{Nd}&&[^0-9]]"), F.translate(text, DIGITS, PLAIN_DIGITS)).otherwise(text)


def looked_up(key: Column, table: Mapping[str, object]) -> Column:
    """The value of a key in a small table, null where it is not there.

    Two constant arrays; a map of literals would become a CASE of as many branches, too long to be compiled.
    """
    place = F.array_position(F.array(*[F.lit(k) for k in table]), key).cast("int")
    return F.get(F.array(*[F.lit(v) for v in table.values()]), place - 1)
