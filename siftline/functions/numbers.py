"""Numbers and numeric ranges in free text."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .flags import Cell, Staging, ascii_digits, flagged, found

_FIGURES = r"[0-9]+(?:\.[0-9]+)?"
#: A sign counts at the start of the text alone.
NUMBER = rf"^[+-]?{_FIGURES}|{_FIGURES}"


class Range(NamedTuple):
    low: Cell
    high: Cell


class _Numbers(NamedTuple):
    """How many numbers texts hold, and the first two."""

    count: Column
    first: Column
    second: Column


def _numbers(stage: Staging, *texts: Column) -> _Numbers:
    plain = [F.coalesce(ascii_digits(t.cast("string")), F.lit("")) for t in texts]
    each = stage.keep(**{f"n{k}": found(t, NUMBER) for k, t in enumerate(plain)})
    tokens = [getattr(each, f"n{k}") for k in range(len(texts))]
    every = stage.one(F.concat(*tokens)) if len(tokens) > 1 else tokens[0]
    got = stage.keep(count=F.size(every), first=F.get(every, F.lit(0)).try_cast("double"), second=F.get(every, F.lit(1)).try_cast("double"))
    return _Numbers(got.count, got.first, got.second)


def _typed(value: Column, kind: str) -> Column:
    return value.try_cast("long") if kind == "int" else value


def number(stage: Staging, text: Column, kind: str = "float", least: float = -423, most: float = 8848, mark: bool = True) -> Cell:
    """The one number of a text; several, none or one out of range is an issue."""
    n = _numbers(stage, text)
    good = stage.one(F.coalesce((n.count == 1) & (n.first >= least) & (n.first <= most), F.lit(False)))
    return flagged(_typed(n.first, kind), ~good, text.cast("string"), mark)


def number_range(stage: Staging, low: Column, high: Column, kind: str = "float", least: float = -423, most: float = 8848, mark: bool = True) -> Range:
    """The ends of the numbers in two columns together.

    Two numbers are put in order, but a zero after a larger number only repeats that number; one
    number is both ends.  A column that fails keeps its own raw text.
    """
    n = _numbers(stage, low, high)
    inside = [F.coalesce((v >= least) & (v <= most), F.lit(False)) for v in (n.first, n.second)]
    k = stage.keep(one=(n.count == 1) & inside[0], two=(n.count == 2) & inside[0] & inside[1])
    same = k.one | (k.two & (n.second == 0) & (n.second < n.first))
    ends = stage.keep(
        low=F.when(same, n.first).when(k.two, F.least(n.first, n.second)), high=F.when(same, n.first).when(k.two, F.greatest(n.first, n.second)), failed=~(k.one | k.two),
    )
    return Range(*[flagged(_typed(v, kind), ends.failed, raw.cast("string"), mark) for v, raw in ((ends.low, low), (ends.high, high))])
