"""Time parsing and time differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text forms of times found in logger and field files.
MONTH_FIRST = "M/d/yyyy H:mm"
MONTH_FIRST_SHORT = "M/d/yy H:mm"
DAY_FIRST = ("d/M/yyyy H:mm:ss", "d-M-yyyy H:mm:ss", "d.M.yyyy H:mm:ss")
DAY_FIRST_SHORT = ("d/M/yy H:mm:ss", "d-M-yy H:mm:ss", "d.M.yy H:mm:ss")


def parse_month_first(text: Column | str) -> Column:
    """``M/d/yyyy H:mm`` to timestamp, NULL when it does not parse.

    Years of two digits, as spreadsheets write them, are those from 2000 on.
    """
    return F.coalesce(*[F.try_to_timestamp(_col(text), F.lit(p)) for p in (MONTH_FIRST, MONTH_FIRST_SHORT)])


def parse_iso(text: Column | str) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` with or without a fraction, NULL otherwise."""
    return F.try_to_timestamp(F.nullif(F.trim(_col(text)), F.lit("")))


def parse_day_first(text: Column | str) -> Column:
    """Day-first times with any of the usual separators, years of four or two digits."""
    return F.coalesce(*[F.try_to_timestamp(_col(text), F.lit(p)) for p in (*DAY_FIRST, *DAY_FIRST_SHORT)])


def parse_either(text: Column | str) -> Column:
    """Month-first when the text holds a slash, ISO when it does not."""
    text = _col(text)
    return F.when(text.contains("/"), parse_month_first(text)).otherwise(parse_iso(text))


def to_utc(local: Column | str, offset_hours: Column | str) -> Column:
    """Local clock time to UTC, given the hours the local clock is ahead."""
    micros = F.unix_micros(_col(local)) - (_col(offset_hours) * 3_600_000_000).cast("long")
    return F.timestamp_micros(micros)


def seconds_between(earlier: Column | str, later: Column | str) -> Column:
    """Seconds from ``earlier`` to ``later`` as a double."""
    return (F.unix_micros(_col(later)) - F.unix_micros(_col(earlier))) / F.lit(1e6)


def shift_seconds(moment: Column, seconds: float) -> Column:
    """The time ``seconds`` after ``moment``."""
    return F.timestamp_micros(F.unix_micros(moment) + F.lit(round(seconds * 1e6)))


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
