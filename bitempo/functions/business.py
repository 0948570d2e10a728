"""Business days: how many open days lie between two dates, and the date some open days away.

Both are closed forms. Weekdays are numbered without gaps, so a difference is a subtraction; holidays are one
sorted array of such numbers, at most one per weekday of the calendar, searched in a number of steps that is
the logarithm of its length. No row is expanded into its days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 1970-01-01 was a Thursday: day -3 is the Monday that starts week 0.
_MONDAY = 3


def weekdays_before(day: Column) -> Column:
    """Weekdays before a date, counted from week 0; for a weekday its own number."""
    shifted = F.unix_date(day) + _MONDAY
    return (F.floor(shifted / 7) * 5 + F.least(F.pmod(shifted, F.lit(7)), F.lit(5))).cast("long")


def weekday_date(number: Column) -> Column:
    """The date of a weekday number."""
    days = F.floor(number / 5) * 7 + F.pmod(number, F.lit(5)) - _MONDAY
    return F.date_from_unix_date(days.cast("int"))


def how_many(ordered: Column, below: Column, steps: Column) -> Column:
    """How many elements of an ascending array are less than ``below``: halving steps, largest first."""

    def step(found: Column, width: Column) -> Column:
        probed = F.get(ordered, (found + width - 1).cast("int"))
        return F.when(F.coalesce(probed < below, F.lit(False)), found + width).otherwise(found)

    return F.aggregate(steps, F.lit(0).cast("long"), step)


def numbers(values: list[int]) -> Column:
    """A constant array of whole numbers."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


class BusinessCalendar:
    """Monday to Friday without the holidays in a column of dates (null, repeated and weekend ones are ignored).

    The distinct holidays are fetched once, at most one number per weekday of the calendar (260 a year), and
    become constants: a subquery may not be used inside the search.
    """

    def __init__(self, holidays: DataFrame | None = None, column: str = "holiday"):
        self._arrays = None
        if holidays is not None:
            day = F.col(column).cast("date")
            rows = holidays.filter(F.weekday(day) < 5).select(weekdays_before(day).alias("number")).distinct()
            closed = sorted(r["number"] for r in rows.collect())
            if closed:
                # A holiday's number less the holidays before it: what an open day's count is compared with.
                opened = [number - i for i, number in enumerate(closed)]
                powers = [1 << k for k in reversed(range(len(closed).bit_length()))]
                self._arrays = {"closed": numbers(closed), "opened": numbers(opened), "steps": numbers(powers)}

    def _passed(self, kind: str, below: Column) -> Column:
        if self._arrays is None:
            return F.lit(0).cast("long")
        return how_many(self._arrays[kind], below, self._arrays["steps"])

    def open_before(self, day: Column) -> Column:
        """Open days before a date, from a fixed origin: differences of it are gaps."""
        number = weekdays_before(day.cast("date"))
        return number - self._passed("closed", number)

    def gap(self, start: Column, end: Column) -> Column:
        """Open days from ``start`` on and before ``end``; negative where ``end`` is earlier. Null for null."""
        return self.open_before(end) - self.open_before(start)

    def add(self, day: Column, days: Column | int) -> Column:
        """The date ``days`` open days after a date; zero gives the first open day from the date on.

        From a closed day the count starts at the next open one; negative numbers go back.
        """
        count = days if isinstance(days, Column) else F.lit(days)
        wanted = self.open_before(day) + count
        return weekday_date(wanted + self._passed("opened", wanted + 1))
