"""Expressions that settle null, zero and calendar semantics once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import FIRST_HOUR


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b as double; null if b is zero or either is null."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def total(x: str | Column, where: Column | None = None) -> Column:
    """Sum as double over the rows of a group for which `where` holds; 0 if there are none."""
    own = col(x).cast("double")
    return F.coalesce(F.sum(own if where is None else F.when(where, own)), F.lit(0.0))


def tally(where: Column) -> Column:
    """Number of rows of a group for which `where` holds."""
    return F.count(F.when(where, F.lit(1)))


def in_band(hour: str | Column, band: tuple[int, int]) -> Column:
    """Half-open band of hours."""
    return (col(hour) >= band[0]) & (col(hour) < band[1])


def chosen_day(date: str | Column, weekdays: list[int], excluded: list | None = None) -> Column:
    """Weekday (0 = Monday) among those asked for, and the date not excluded."""
    keep = F.weekday(col(date)).isin(weekdays)
    return keep & ~col(date).isin(excluded) if excluded else keep


def has_flag(flags: str | Column, bits: int) -> Column:
    return col(flags).bitwiseAND(F.lit(bits)) != 0


def set_flag(flags: str | Column, bits: int, where: Column) -> Column:
    return F.when(where, col(flags).bitwiseOR(F.lit(bits))).otherwise(col(flags))


def service_date(date: str | Column, hour: str | Column, first: int = FIRST_HOUR) -> Column:
    """The date that a clock hour of a calendar date is filed under: hours before `first` belong to the day before."""
    return F.when(col(hour) < first, F.date_sub(col(date), 1)).otherwise(col(date))


def service_hour(hour: str | Column, first: int = FIRST_HOUR) -> Column:
    return F.when(col(hour) < first, col(hour) + 24).otherwise(col(hour))


def service_window(date: str | Column, zone: str, first: int = FIRST_HOUR, last: int = 3) -> tuple[Column, Column]:
    """Bounds of a service day in epoch seconds, both included."""
    at = lambda d, h: F.unix_timestamp(F.to_utc_timestamp(F.to_timestamp(F.concat(d.cast("string"), F.lit(f" {h:02d}:00:00"))), zone))
    return at(col(date), first), at(F.date_add(col(date), 1), last)


def local_midnight(date: str | Column, zone: str) -> Column:
    """Epoch seconds of a date's start in a zone; on a day when it comes twice, the first."""
    return F.unix_timestamp(F.to_utc_timestamp(col(date).cast("timestamp"), zone))


def nearest_rank(values: Column, q: float) -> Column:
    """The element of an array at rank int(q (n - 1) + 0.5) of its ascending order."""
    at = F.floor(q * (F.size(values) - 1) + 0.5).cast("int") + 1
    return F.when(F.size(values) > 0, F.element_at(F.sort_array(values), F.greatest(at, F.lit(1))))


def let(value: Column, body) -> Column:
    """body of a value that is worked out once: a chain of such steps stays small where nested expressions would double."""
    return F.element_at(F.transform(F.array(value), body), 1)


def easter(year: str | Column) -> Column:
    """Easter Sunday of a Gregorian year, by the completed Gaussian form: the full moon by the golden number, then the Sunday after."""
    div = lambda a, b: F.floor(a / b).cast("int")

    def sunday(y: Column, century: Column, moon: Column) -> Column:
        weekday = (y + div(y, F.lit(4)) + moon + 2 - century + div(century, F.lit(4))) % 7
        return F.date_add(F.make_date(y, F.lit(3), F.lit(1)), moon - weekday + 27)

    def moon(y: Column, century: Column, epact: Column) -> Column:
        late = 1 - div(F.lit(29), epact + 1) * div(21 - y % 19, F.lit(11))
        return let(epact - div(epact, F.lit(28)) * late, lambda m: sunday(y, century, m))

    def epact(y: Column, century: Column) -> Column:
        days = (century - div(century, F.lit(4)) - div(8 * century + 13, F.lit(25)) + 19 * (y % 19) + 15) % 30
        return let(days, lambda e: moon(y, century, e))

    return let(col(year).cast("int"), lambda y: let(div(y, F.lit(100)), lambda c: epact(y, c)))


def title_case(name: str | Column) -> Column:
    """Every run of letters begins with a capital and goes on in lower case; hyphens and apostrophes part runs."""
    parts = F.split(F.lower(col(name)), "(?<=[\\s'’-])")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), "")


def route_mode(route_type: str | Column) -> Column:
    return F.when(col(route_type) == 0, "tram").when(col(route_type) == 1, "metro").otherwise("bus")
