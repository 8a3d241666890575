"""Dates: units, NaT as NULL, and business days by closed formulas over a week mask and a short list of holidays."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ieee import int_floor_divide
from .strings import _c


def isnat(x) -> Column:
    return _c(x).isNull()


# Ticks of each unit in nanoseconds.
NANOSECONDS = {"ns": 1, "us": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "D": 86400 * 10**9}


def rescale(ticks, unit: str, to: str) -> Column:
    """Whole ticks of another unit; a coarser one takes the floor."""
    a, b = NANOSECONDS[unit], NANOSECONDS[to]
    t = _c(ticks).cast("long")
    return t * (a // b) if a >= b else int_floor_divide(t, F.lit(b // a))


def promoted(a: str, b: str) -> str:
    """The finer of two units."""
    return a if NANOSECONDS[a] <= NANOSECONDS[b] else b


def add_ticks(a, a_unit: str, b, b_unit: str) -> tuple[Column, str]:
    """Sum of two counts of ticks (a date or a difference, and a difference), in the finer unit; NULL is NaT."""
    unit = promoted(a_unit, b_unit)
    return rescale(a, a_unit, unit) + rescale(b, b_unit, unit), unit


def subtract_ticks(a, a_unit: str, b, b_unit: str) -> tuple[Column, str]:
    unit = promoted(a_unit, b_unit)
    return rescale(a, a_unit, unit) - rescale(b, b_unit, unit), unit


def shift(ts, ticks, unit: str) -> Column:
    """A timestamp some whole ticks on; ticks under a microsecond take the floor."""
    us = rescale(ticks, unit, "us")
    return F.timestamp_add("MICROSECOND", us, _c(ts))


def truncate(ts, unit: str) -> Column:
    names = {"s": "second", "m": "minute", "h": "hour", "D": "day", "M": "month", "Y": "year", "W": "week"}
    return F.date_trunc(names[unit], _c(ts))


def difference(a, b, unit: str = "us") -> Column:
    """a - b in whole ticks."""
    us = F.timestamp_diff("MICROSECOND", _c(b), _c(a))
    return rescale(us, "us", unit)


def weekday(x) -> Column:
    """Monday is 0."""
    return F.weekday(_c(x))


MASK = "1111100"
_MONDAY = dt.date(1970, 1, 5)


class Calendar:
    """Which days are business days: a week mask from Monday on, and holidays (a short list that a plan holds as an array).

    Every date has an ordinal, the number of business days before it; counting and stepping are arithmetic on ordinals."""

    def __init__(self, weekmask: str = MASK, holidays: list[dt.date] | None = None):
        self.mask = [c == "1" for c in weekmask]
        if len(self.mask) != 7 or not any(self.mask) or set(weekmask) - {"0", "1"}:
            raise ValueError(f"week mask {weekmask!r}: seven of 0 and 1, with a 1")
        self.work = sum(self.mask)
        self.holidays = sorted({d for d in holidays or [] if self.mask[d.weekday()]})

    def _masked_days(self, day: Column) -> Column:
        """Days of the mask from the first Monday of the epoch up to a date, exclusive."""
        n = F.datediff(day, F.lit(_MONDAY))
        before = F.array(*[F.lit(sum(self.mask[:k])) for k in range(7)])
        return F.floor(n / 7) * self.work + F.get(before, F.pmod(n, F.lit(7)))

    def _off(self) -> Column:
        return F.array(*[F.lit(d) for d in self.holidays]).cast("array<date>")

    def ordinal(self, day: Column) -> Column:
        n = self._masked_days(day)
        return n - F.size(F.filter(self._off(), lambda h: h < day)) if self.holidays else n

    def date_of(self, ordinal: Column) -> Column:
        """The business day with an ordinal."""
        if self.holidays:
            # a holiday pushes on every ordinal from its own place on
            places = [self._place(d) - k for k, d in enumerate(self.holidays)]
            ordinal = ordinal + F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in places]), lambda x: x <= ordinal))
        days = F.array(*[F.lit(k) for k in range(7) if self.mask[k]])
        week = F.floor(ordinal / self.work)
        return F.date_add(F.lit(_MONDAY), (week * 7 + F.get(days, F.pmod(ordinal, F.lit(self.work)).cast("int"))).cast("int"))

    def _place(self, day: dt.date) -> int:
        week, rest = divmod((day - _MONDAY).days, 7)
        return week * self.work + sum(self.mask[:rest])

    def open(self, day: Column) -> Column:
        return self.ordinal(F.date_add(day, 1)) > self.ordinal(day)


def is_busday(x, holidays: list[dt.date] | None = None, weekmask: str = MASK) -> Column:
    return Calendar(weekmask, holidays).open(_c(x).cast("date"))


def busday_count(a, b, holidays: list[dt.date] | None = None, weekmask: str = MASK) -> Column:
    """Business days in [a, b); with b before a those of (b, a], negative."""
    calendar, a, b = Calendar(weekmask, holidays), _c(a).cast("date"), _c(b).cast("date")
    back = calendar.ordinal(F.date_add(a, 1)) - calendar.ordinal(F.date_add(b, 1))
    return F.when(a <= b, calendar.ordinal(b) - calendar.ordinal(a)).otherwise(-back).cast("long")


ROLLS = ("forward", "following", "backward", "preceding", "modifiedfollowing", "modifiedpreceding", "nat", "raise")


def busday_offset(x, n, roll: str = "forward", holidays: list[dt.date] | None = None, weekmask: str = MASK) -> Column:
    """The date n business days on, after rolling a day that is none: on, back, on or back within the month, to NULL
    (``nat``), or not at all (``raise``)."""
    if roll not in ROLLS:
        raise ValueError(f"roll {roll!r} is none of {ROLLS}")
    calendar, x = Calendar(weekmask, holidays), _c(x).cast("date")
    n = _c(n) if not isinstance(n, int) else F.lit(n)
    on, back = calendar.ordinal(x), calendar.ordinal(F.date_add(x, 1)) - 1
    inside = lambda k: F.trunc(calendar.date_of(k), "month") == F.trunc(x, "month")
    start = {
        "forward": on, "following": on, "backward": back, "preceding": back,
        "modifiedfollowing": F.when(inside(on), on).otherwise(back), "modifiedpreceding": F.when(inside(back), back).otherwise(on),
        "nat": F.when(calendar.open(x), on), "raise": F.when(calendar.open(x), on).otherwise(F.raise_error(F.lit("not a business day")).cast("long")),
    }[roll]
    return calendar.date_of(start + n)


def as_string(ts, unit: str = "s") -> Column:
    forms = {"D": "yyyy-MM-dd", "h": "yyyy-MM-dd'T'HH", "m": "yyyy-MM-dd'T'HH:mm", "s": "yyyy-MM-dd'T'HH:mm:ss", "ms": "yyyy-MM-dd'T'HH:mm:ss.SSS", "us": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    return F.date_format(_c(ts), forms[unit])
