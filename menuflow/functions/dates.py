"""Date columns: dates without a year, dates in keys, display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_of(year: Column, month: Column, day: Column) -> Column:
    """The date, or null where there is no such day."""
    return F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(day.cast("string"), 2, "0")).try_cast("date")


def yearless_date(month: Column, day: Column, reference: Column, reach: int = 200) -> Column:
    """The date of a month and day near ``reference``: in its year, moved by one year if more than ``reach`` days off.

    29 February moved into a common year, and days that don't exist, give null.
    """
    year = F.year(reference)
    same = day_of(year, month, day)
    off = F.datediff(same, reference)
    return F.when(off > reach, day_of(year - 1, month, day)).when(off < -reach, day_of(year + 1, month, day)).otherwise(same)


def headline_date(title: Column, reference: Column, reach: int = 200) -> Column:
    """The first ``M月D日`` of a headline near its date; 本日 is the date itself; else null."""
    m, d = (F.nullif(F.regexp_extract(title, r"([0-9]{1,2})月([0-9]{1,2})日", i), F.lit("")).cast("int") for i in (1, 2))
    return F.when(title.contains("本日"), reference).otherwise(yearless_date(m, d, reference, reach))


def key_date(c: Column, century: int = 2000) -> Column:
    """The date in a key's suffix ``_yymmdd``; null where there is none or no such day."""
    part = lambda i: F.nullif(F.regexp_extract(c, r"_([0-9]{2})([0-9]{2})([0-9]{2})(?:$|[^0-9])", i), F.lit("")).cast("int")
    return day_of(part(1) + century, part(2), part(3))


def month_of(c: Column) -> Column:
    """``yyyy-MM``."""
    return F.date_format(c, "yyyy-MM")


def ja_date(c: Column) -> Column:
    """``2026年3月1日``."""
    return F.concat(F.year(c).cast("string"), F.lit("年"), F.month(c).cast("string"), F.lit("月"), F.dayofmonth(c).cast("string"), F.lit("日"))


def effective_date(launch: Column, reappeared: Column, first_seen: Column) -> Column:
    """When the present season of an item began: its launch, else its last return, else when it was first seen."""
    return F.coalesce(launch, reappeared, F.to_date(first_seen))


def period_text(start: Column, end: Column, past: Column) -> Column:
    """``start〜end`` in display form, with a remark where the end is past."""
    return F.concat(F.coalesce(ja_date(start), F.lit("")), F.lit("〜"), F.coalesce(F.concat(ja_date(end), F.when(past, F.lit("(終了)")).otherwise("")), F.lit("")))


def compact_date(c: Column, open_end: str = "99991231") -> Column:
    """The day of ``yyyymmdd``; null for the sign of an open end and for what isn't a day."""
    part = lambda i, n: F.substring(c, i, n)
    return F.when(c.rlike("^[0-9]{8}$") & (c != open_end), F.concat(part(1, 4), F.lit("-"), part(5, 2), F.lit("-"), part(7, 2)).try_cast("date"))


def is_dated(c: Column, pattern: str = r"20[0-9]{6}") -> Column:
    """Whether a key is a date as a whole: by default ``20`` and six digits."""
    return c.rlike(f"^(?:{pattern})$")
