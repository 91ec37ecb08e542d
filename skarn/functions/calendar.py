"""ISO weeks, in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_of(ts: Column) -> Column:
    """2026-W53 and the like."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def monday(ts: Column) -> Column:
    return F.to_date(F.date_trunc("week", ts))


def details(ts: Column) -> Column:
    """struct of week, monday, sunday and the range as text."""
    m = monday(ts)
    s = F.date_add(m, 6)
    text = F.concat(F.date_format(m, "yyyy-MM-dd"), F.lit(" ~ "), F.date_format(s, "yyyy-MM-dd"))
    return F.struct(week_of(ts).alias("week"), m.alias("monday"), s.alias("sunday"), text.alias("date_range"))


def stamp(ts: Column) -> Column:
    """2026-08-05 12:30:00 UTC (in a session whose time zone is UTC)."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def previous_week(ts: Column) -> Column:
    return week_of(F.date_sub(monday(ts), 7))


def range_of(week: Column) -> Column:
    """struct of monday and sunday of a week written YYYY-Www; null if it is not written so."""
    year, number = F.regexp_extract(week, r"^(\d{4})-W(\d{2})$", 1), F.regexp_extract(week, r"^(\d{4})-W(\d{2})$", 2)
    ok = year != ""
    first = monday(F.make_date(F.when(ok, year).cast("int"), F.lit(1), F.lit(4)))
    m = F.date_add(first, (F.when(ok, number).cast("int") - 1) * 7)
    return F.when(ok, F.struct(m.alias("monday"), F.date_add(m, 6).alias("sunday")))
