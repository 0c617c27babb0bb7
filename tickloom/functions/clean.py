"""Column helpers shared by the operators: tickers, instants, New York dates. The session's time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEW_YORK = "America/New_York"


def ticker(c: Column | str) -> Column:
    """Trimmed of white space (blanks, tabs, line ends) and in upper case; an empty ticker is null."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.upper(F.btrim(c, F.lit(" \t\r\n")))
    return F.when(t != "", t)


def source(c: Column | str) -> Column:
    """Trimmed and in lower case; an empty name is null."""
    c = F.col(c) if isinstance(c, str) else c
    s = F.lower(F.btrim(c, F.lit(" \t\r\n")))
    return F.when(s != "", s)


def micros(c: Column | str) -> Column:
    """Microseconds since 1970-01-01 UTC of a timestamp with or without zone."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp"))


def ny_date(c: Column | str) -> Column:
    """The date in New York of an instant."""
    c = F.col(c) if isinstance(c, str) else c
    return F.from_utc_timestamp(c.cast("timestamp"), NEW_YORK).cast("date")


def ny_minutes(c: Column | str) -> Column:
    """Minutes since midnight in New York."""
    c = F.col(c) if isinstance(c, str) else c
    et = F.from_utc_timestamp(c.cast("timestamp"), NEW_YORK)
    return F.hour(et) * 60 + F.minute(et)


def half_even(x: Column, digits: int) -> Column:
    """x rounded half to even as a decimal would be: what lies within 0.0001 units of a tie counts as one."""
    unit = float(10**digits)
    return F.bround(F.round(x * unit, 4), 0) / unit
