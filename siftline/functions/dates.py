"""Partial dates in free text."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .flags import Cell, Staging, flagged, found, looked_up

#: Texts that stand for an unknown date.
UNKNOWN = ("0000-01-01 00:00:02", "9999-01-01 00:00:00", "1970-01-01 00:00:00", "0000-01-01 00:00:00")
#: English month names, and Roman numerals.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII")
STYLES = ("num", "date", "datetime", "utc")
_ISO = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2})(:\d{2})?(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?$"
#: One number that is not zero among zeros.
_LONELY = r"^[^A-Za-z0-9]*(?:0+[^A-Za-z0-9]+)*+([0-9]+)(?:[^A-Za-z0-9]+0+)*[^A-Za-z0-9]*$"


class _Parts(NamedTuple):
    """Year, month and day so far (null where missing), and whether the elements make no date."""

    year: Column
    month: Column
    day: Column
    bad: Column


def _month_numbers() -> dict[str, int]:
    out: dict[str, int] = {}
    for k, (name, roman) in enumerate(zip(MONTHS, ROMAN), 1):
        out |= {name: k, name[:3]: k, name[:3].upper(): k, roman: k}
    return out | {"APRI": 4, "Apri": 4, "SEPT": 9, "Sept": 9}


def _elements(stage: Staging, text: Column) -> tuple[Column, list[Column]]:
    """How many elements there are (null: none that could be a date), and the first three, as int."""
    tokens = stage.one(found(text, "[A-Za-z]+|[0-9]+"))
    many = stage.keep(size=F.size(tokens), t0=F.get(tokens, F.lit(0)), t1=F.get(tokens, F.lit(1)), t2=F.get(tokens, F.lit(2)))
    digits = stage.keep(length=F.when(many.size == 1, F.length(many.t0)))
    split = digits.length.isin(6, 8)
    cut = stage.keep(
        size=F.when(many.size.isin(2, 3), many.size).when(many.size == 6, 3).when(many.size == 1, F.when(digits.length == 4, 1).when(digits.length == 6, 2).when(digits.length == 8, 3)).when(many.size > 0, 1),
        t0=F.when(split, F.substring(many.t0, 1, 4)).when(~many.size.isin(1, 2, 3, 6), F.regexp_extract(text, _LONELY, 1)).otherwise(many.t0),
        t1=F.when(split, F.substring(many.t0, 5, 2)).otherwise(many.t1), t2=F.when(digits.length == 8, F.substring(many.t0, 7, 2)).otherwise(many.t2),
    )
    value = lambda t: F.when(t < ":", t.try_cast("int")).otherwise(looked_up(t, _month_numbers()))
    whole = stage.keep(v0=value(cut.t0), v1=value(cut.t1), v2=value(cut.t2))
    return cut.size, [whole.v0, whole.v1, whole.v2]


def _role(s: _Parts, k: int, value: Column, size: Column, values: Sequence[Column], this_year: Column) -> Column:
    """What the element at place k is, given those before it: year, short year, month, day, none or bad."""
    second, third = values[1], values[2]
    if k == 1:
        of_three = F.when(value < 13, "month").otherwise("bad")
    else:
        of_three = F.when(s.year.isNotNull() | F.coalesce(third > 31, F.lit(False)), "day").otherwise("bad")
    of_two = (
        F.when(value > 12, F.when(s.year.isNull() & (s.month.isNotNull() | (second < 13)), "short year").otherwise("bad"))
        .when(s.year.isNotNull() | (second > 12), "month")
        .otherwise("bad")
    )
    first_year = F.when(s.year.isNull(), F.when(value > 1599, "year").otherwise("short year")).otherwise("bad")
    return (
        F.when(s.bad | value.isNull() | (value > this_year), "bad")
        .when(value > 1599, first_year)
        .when(value > 99, "bad")
        .when(value > 31, first_year)
        .when(value == 0, "none")
        .when(size == 3, of_three)
        .when(size == 2, of_two)
        .otherwise("bad")
    )


def _classified(stage: Staging, size: Column, values: Sequence[Column], this_year: Column) -> _Parts:
    """Each element in turn becomes the year, the month or the day."""
    none = F.lit(None).cast("int")
    so_far = _Parts(none, none, none, F.coalesce(size, F.lit(0)) == 0)
    for k, value in enumerate(values):
        there = size > k
        role = stage.one(F.when(there, _role(so_far, k, value, size, values, this_year)))
        now = stage.keep(
            year=F.when(role == "year", value).when(role == "short year", value + 1900).otherwise(so_far.year),
            month=F.when(role == "month", value).otherwise(so_far.month),
            day=F.when(role == "day", value).otherwise(so_far.day),
            bad=F.coalesce(role == "bad", F.lit(False)) | so_far.bad,
        )
        so_far = _Parts(now.year, now.month, now.day, now.bad)
    return so_far


def _real(p: _Parts) -> Column:
    """Whether a full date is in the calendar."""
    leap = (p.year % 4 == 0) & ((p.year % 100 != 0) | (p.year % 400 == 0))
    last = F.when(p.month.isin(4, 6, 9, 11), 30).when(p.month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    return p.month.between(1, 12) & p.day.between(1, last)


def _written(p: _Parts, style: str, timezone: str) -> Column:
    text = lambda c: c.cast("string")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    year, no_month, no_day = text(p.year), p.month.isNull(), p.day.isNull()
    if style == "num":
        zero = F.lit("00")
        return F.concat(year, F.coalesce(two(p.month), zero), F.when(no_month, zero).otherwise(F.coalesce(two(p.day), zero)))
    shown = two if style == "utc" else text
    mark = {"date": ("", "", ""), "datetime": (" 00:00:00", " 00:00:01", " 00:00:02"), "utc": tuple(f"T00:00:0{k}{timezone}" for k in range(3))}[style]
    dash = F.lit("-")
    whole = F.concat(year, dash, shown(p.month), dash, shown(p.day), F.lit(mark[0]))
    return F.when(no_month, F.concat(year, F.lit("-01-01" + mark[2]))).when(no_day, F.concat(year, dash, shown(p.month), F.lit("-01" + mark[1]))).otherwise(whole)


def format_date(stage: Staging, text: Column, style: str = "num", timezone: str = "+08:00", mark: bool = True, as_of: Column | None = None) -> Cell:
    """A date in one of STYLES.

    Missing days and months are allowed; in the styles datetime and utc the seconds 00, 01 and 02
    tell a full date, one without day and one without month.  as_of bounds the date (default: today).
    """
    if style not in STYLES:
        raise ValueError(f"style is one of {', '.join(STYLES)}, not {style}")
    as_of = F.current_date() if as_of is None else as_of
    raw = text.cast("string")
    shown = stage.one(F.when(~raw.isin(*UNKNOWN), raw))
    long = F.length(shown) > 15
    iso = stage.keep(**{n: F.when(long, F.regexp_extract(shown, _ISO, k)) for k, n in enumerate(("day", "minutes", "seconds"), 1)})
    with_time = F.try_to_date(F.when(iso.day != "", iso.day)).isNotNull() & ~iso.minutes.startswith("00") & (F.substring(iso.minutes, 1, 2) < "24")
    clock = F.concat(iso.minutes, F.when(iso.seconds == "", F.lit(":00")).otherwise(iso.seconds))
    known = {"num": F.replace(iso.day, F.lit("-"), F.lit("")), "date": iso.day, "datetime": F.concat(iso.day, F.lit(" "), clock), "utc": F.concat(iso.day, F.lit("T"), clock, F.lit(timezone))}[style]
    has_time = stage.one(F.coalesce(with_time, F.lit(False)))
    size, values = _elements(stage, F.when(~has_time, shown))
    p = _classified(stage, size, values, F.year(as_of))
    before = p.year * 10000 + p.month * 100 + p.day <= F.year(as_of) * 10000 + F.month(as_of) * 100 + F.dayofmonth(as_of)
    full = p.month.isNotNull() & p.day.isNotNull()
    good = stage.one(F.coalesce(~p.bad & p.year.isNotNull() & (~full | (_real(p) & before)), F.lit(False)))
    value = stage.one(F.when(has_time, known).when(good, _written(p, style, timezone)))
    return flagged(value, value.isNull(), shown, mark)


def to_utc(text: Column, zone: str) -> Column:
    """The instant of a local date and time."""
    return F.to_utc_timestamp(F.try_to_timestamp(text), zone)
