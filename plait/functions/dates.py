"""Dates, times and spans. A date-time is timestamp_ntz, a date a date; a time
of day and a span are microseconds in a bigint (a time wraps at a day)."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from plait.functions.sem import col

MICROS = {"ticks": 0.1, "microseconds": 1, "milliseconds": 1_000, "seconds": 1_000_000, "minutes": 60_000_000, "hours": 3_600_000_000, "days": 86_400_000_000}
DAY = MICROS["days"]
#: Ticks (100 ns) and days from 0001-01-01 to 1970-01-01.
EPOCH_TICKS, EPOCH_DAYS = 621_355_968_000_000_000, 719_162
UNITS = {"year": "YEAR", "month": "MONTH", "day": "DAY", "hour": "HOUR", "minute": "MINUTE", "second": "SECOND", "microsecond": "MICROSECOND"}


def micros(ts: Any) -> Column:
    """Microseconds since 1970 of a timestamp_ntz."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col(ts).cast("timestamp_ntz"))


def from_micros(us: Any) -> Column:
    return F.timestamp_add("MICROSECOND", col(us).cast("bigint"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


year, month, day = F.year, F.month, F.dayofmonth
hour, minute, second = F.hour, F.minute, F.second


def millisecond(ts: Any) -> Column:
    return F.floor(F.pmod(micros(ts), F.lit(1_000_000)) / 1_000).cast("int")


def microsecond(ts: Any) -> Column:
    return F.pmod(micros(ts), F.lit(1_000)).cast("int")


def nanosecond(ts: Any) -> Column:
    """Of the microsecond: timestamps have none."""
    return F.when(col(ts).isNotNull(), F.lit(0))


def ticks(ts: Any) -> Column:
    return micros(ts) * 10 + EPOCH_TICKS


def day_of_week(ts: Any) -> Column:
    """Sunday is 0."""
    return F.dayofweek(col(ts)) - 1


day_of_year = F.dayofyear


def date_part(ts: Any) -> Column:
    return F.date_trunc("DAY", col(ts)).cast("timestamp_ntz")


def time_of_day(ts: Any) -> Column:
    return F.pmod(micros(ts), F.lit(DAY))


def add(ts: Any, unit: str, n: Any) -> Column:
    """n units later; years and months end at the month's last day and keep the time."""
    ts, n = col(ts), col(n)
    if unit in ("years", "months"):
        return F.timestamp_add(unit[:-1].upper(), n.cast("int"), ts)
    return F.timestamp_add("MICROSECOND", span(unit, n), ts)


def subtract(a: Any, b: Any) -> Column:
    """The span from b to a."""
    return micros(a) - micros(b)


# spans


def span(unit: str, n: Any) -> Column:
    size = MICROS[unit]
    return F.round(col(n) * (F.lit(size) if unit == "ticks" else F.lit(size).cast("bigint"))).cast("bigint")


def span_part(us: Any, unit: str) -> Column:
    """Whole days, or hours, minutes, seconds, milliseconds, microseconds within; truncated to zero."""
    us = col(us)
    size = int(MICROS[unit])
    within = {"days": None, "hours": 24, "minutes": 60, "seconds": 60, "milliseconds": 1000, "microseconds": 1000}[unit]
    whole = F.expr("1") * (us - us % size) / size
    whole = F.round(whole).cast("bigint")
    return whole if within is None else whole % within


def negate(us: Any) -> Column:
    return -col(us)


def duration(us: Any) -> Column:
    """A span without its sign."""
    return F.abs(col(us))


def span_total(us: Any, unit: str) -> Column:
    return col(us) / F.lit(float(MICROS[unit]))


# dates and times of day


def day_number(d: Any) -> Column:
    return F.unix_date(col(d)) + EPOCH_DAYS


def add_time(t: Any, us: Any) -> Column:
    return F.pmod(col(t) + col(us), F.lit(DAY))


# date functions with modifiers

_FORMATS = {
    "Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "y": "yy",
}


def modify(when: Any, *modifiers: str) -> Column:
    """when (a timestamp, text, or with 'unixepoch' seconds) changed by modifiers in turn."""
    ts, rest = col(when), list(modifiers)
    if rest and rest[0] == "unixepoch":
        ts, rest = from_micros(F.round(ts * 1_000_000)), rest[1:]
    else:
        ts = ts.cast("timestamp_ntz")
    for m in rest:
        m = m.strip().lower()
        if got := re.fullmatch(r"([+-]?\d+(?:\.\d+)?)\s*(year|month|day|hour|minute|second)s?", m):
            n, unit = got[1], got[2]
            if unit in ("year", "month"):
                # an overlong day runs into the next month
                first = F.date_trunc("MONTH", ts).cast("timestamp_ntz")
                moved = F.timestamp_add(unit.upper(), F.lit(int(float(n))), first)
                ts = F.timestamp_add("MICROSECOND", micros(ts) - micros(first), moved)
            else:
                ts = add(ts, unit + "s", F.lit(float(n)))
        elif m.startswith("start of "):
            ts = F.date_trunc(m[9:].upper(), ts).cast("timestamp_ntz")
        elif got := re.fullmatch(r"weekday\s+([0-6])", m):
            ahead = F.pmod(F.lit(int(got[1])) - day_of_week(ts), F.lit(7))
            ts = add(ts, "days", ahead)
        elif m == "localtime":
            ts = F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts)
        elif m == "utc":
            ts = F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts)
        elif m in ("auto", "subsec"):
            continue
        else:
            raise ValueError(f"unknown modifier {m!r}")
    return ts


def date_text(when: Any, *modifiers: str) -> Column:
    return F.date_format(modify(when, *modifiers), "yyyy-MM-dd")


def time_text(when: Any, *modifiers: str) -> Column:
    return F.date_format(modify(when, *modifiers), "HH:mm:ss")


def datetime_text(when: Any, *modifiers: str) -> Column:
    return F.date_format(modify(when, *modifiers), "yyyy-MM-dd HH:mm:ss")


def julian_day(when: Any, *modifiers: str) -> Column:
    return micros(modify(when, *modifiers)) / F.lit(float(DAY)) + F.lit(2440587.5)


def unix_epoch(when: Any, *modifiers: str) -> Column:
    return F.floor(micros(modify(when, *modifiers)) / F.lit(1_000_000.0)).cast("bigint")


def strftime(fmt: str, when: Any, *modifiers: str) -> Column:
    ts = modify(when, *modifiers)
    two = lambda n: F.lpad(F.floor(n).cast("string"), 2, "0")
    # a week belongs to the year of its Thursday
    iso_year = lambda: F.year(F.date_add(ts.cast("date"), 3 - F.pmod(day_of_week(ts) + 6, F.lit(7))))
    special = {
        "j": lambda: F.lpad(F.dayofyear(ts).cast("string"), 3, "0"),
        "w": lambda: day_of_week(ts).cast("string"),
        "u": lambda: (F.pmod(day_of_week(ts) + 6, F.lit(7)) + 1).cast("string"),
        "s": lambda: F.floor(micros(ts) / F.lit(1_000_000.0)).cast("bigint").cast("string"),
        "f": lambda: F.date_format(ts, "ss.SSS"),
        "J": lambda: (micros(ts) / F.lit(float(DAY)) + F.lit(2440587.5)).cast("string"),
        "e": lambda: F.lpad(F.dayofmonth(ts).cast("string"), 2, " "),
        "k": lambda: F.lpad(F.hour(ts).cast("string"), 2, " "),
        "I": lambda: F.lpad((F.pmod(F.hour(ts) + 11, F.lit(12)) + 1).cast("string"), 2, "0"),
        "l": lambda: F.lpad((F.pmod(F.hour(ts) + 11, F.lit(12)) + 1).cast("string"), 2, " "),
        "p": lambda: F.when(F.hour(ts) < 12, "AM").otherwise("PM"),
        "P": lambda: F.when(F.hour(ts) < 12, "am").otherwise("pm"),
        "W": lambda: two((F.dayofyear(ts) + 6 - F.pmod(day_of_week(ts) + 6, F.lit(7))) / 7),
        "U": lambda: two((F.dayofyear(ts) + 6 - day_of_week(ts)) / 7),
        "V": lambda: two(F.weekofyear(ts)),
        "G": lambda: iso_year().cast("string"),
        "g": lambda: two(F.pmod(iso_year(), F.lit(100))),
        "%": lambda: F.lit("%"),
    }
    parts = []
    for p in re.split(r"(%.)", fmt):
        if not p:
            continue
        if p[0] != "%":
            parts.append(F.lit(p))
        elif p[1] in _FORMATS:
            parts.append(F.date_format(ts, _FORMATS[p[1]]))
        else:
            parts.append(special[p[1]]())
    return F.concat(*parts) if parts else F.lit("")


def time_diff(a: Any, b: Any) -> Column:
    """a - b as +YYYY-MM-DD HH:MM:SS.SSS: whole months, then days and time."""
    a, b = col(a).cast("timestamp_ntz"), col(b).cast("timestamp_ntz")
    late, early = F.greatest(a, b), F.least(a, b)
    months = F.timestamp_diff("MONTH", early, late).cast("int")
    left = micros(late) - micros(F.timestamp_add("MONTH", months, early))
    days, rest = F.floor(left / F.lit(float(DAY))), F.pmod(left, F.lit(DAY))
    clock = F.date_format(from_micros(rest), "HH:mm:ss.SSS")
    return F.concat(
        F.when(a < b, "-").otherwise("+"), F.lpad(F.floor(months / 12).cast("string"), 4, "0"), F.lit("-"),
        F.lpad((months % 12).cast("string"), 2, "0"), F.lit("-"), F.lpad(days.cast("string"), 2, "0"), F.lit(" "), clock,
    )
