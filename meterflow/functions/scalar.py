"""Column expressions: parsing, rounding, ratios and calendar parts. No UDFs."""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import FUELS, RENEWABLE


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def period(c: Column | str) -> Column:
    """``2024-01-20T01`` and full ISO forms to a naive timestamp; NULL if it is neither."""
    return col(c).try_cast("timestamp_ntz")


def strict_period(c: Column | str) -> Column:
    """As ``period``, but only for the exact ``yyyy-MM-ddTHH`` form."""
    return F.when(col(c).rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}$"), period(c))


def any_timestamp(c: Column | str, patterns: Iterable[str] = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd", "MM/dd/yyyy HH:mm")) -> Column:
    """The first pattern that fits, as a naive timestamp; NULL if none does."""
    return F.coalesce(*[F.try_to_timestamp(col(c), F.lit(p)) for p in patterns]).cast("timestamp_ntz")


def hour_of_day(date: Column | str, hour: Column | str, same_day_24: bool = False) -> Column:
    """Date and hour ending 1-24 to the start of that hour.

    With ``same_day_24`` hour h is taken as h o'clock and 24 as 0 o'clock of the same day.
    """
    h = col(hour).try_cast("int")
    at = F.pmod(h, F.lit(24)) if same_day_24 else h - 1
    return (F.to_date(col(date)).cast("timestamp_ntz") + F.make_dt_interval(hours=F.coalesce(at, F.lit(0)))).cast("timestamp_ntz")


def number(c: Column | str) -> Column:
    """Text to double; NULL for anything but a plain number (suffixes such as ``12d`` too)."""
    text = F.trim(col(c).cast("string"))
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def hour_bucket(c: Column | str) -> Column:
    return F.date_trunc("hour", col(c)).cast("timestamp_ntz")


def day_bucket(c: Column | str) -> Column:
    return F.date_trunc("day", col(c)).cast("timestamp_ntz")


def iso_weekday(c: Column | str) -> Column:
    """Monday 1 to Sunday 7."""
    return (F.weekday(col(c)) + 1).cast("int")


def cyclic(x: Column, cycle: float) -> tuple[Column, Column]:
    angle = x * (2 * math.pi / cycle)
    return F.sin(angle), F.cos(angle)


def row_sum(*columns: Column | str) -> Column:
    """Horizontal sum that reads NULL as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(col(c), F.lit(0.0)) for c in columns], F.lit(0.0))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b; NULL where b is 0 or either is NULL."""
    return F.try_divide(col(a), col(b))


def percent(a: Column | str, b: Column | str, places: int = 2) -> Column:
    """100 a / b, rounded half to even; 0 where b is 0."""
    return F.coalesce(F.bround(ratio(a, b) * 100, places), F.lit(0.0))


def clip(c: Column | str, low: float | None = None, high: float | None = None) -> Column:
    out = col(c)
    if low is not None:
        out = F.greatest(out, F.lit(low))
    return out if high is None else F.least(out, F.lit(high))


def fuel_name(code: Column | str) -> Column:
    pairs = [F.lit(x) for item in FUELS.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.upper(col(code))), F.lower(col(code)))


def is_renewable(name: Column | str) -> Column:
    return F.lower(col(name)).isin(*RENEWABLE)


def load_factor(average: Column | str, peak: Column | str) -> Column:
    return F.coalesce(ratio(average, peak), F.lit(0.0))


def stress(average: Column | str, peak: Column | str) -> Column:
    """How far the peak lies above the average, relative to it; never below 0."""
    return F.greatest(F.lit(0.0), F.coalesce(ratio(col(peak) - col(average), average), F.lit(0.0)))


def file_signature(name: Column | str, size: Column | str, modified: Column | str) -> Column:
    return F.md5(F.concat_ws(":", col(name), col(size).cast("string"), col(modified).cast("string")))
