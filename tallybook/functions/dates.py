"""Dates written in mixed local formats. The reference date is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beginnings of English and Polish month names (fixed values).
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
    "sty": 1, "lut": 2, "kwi": 4, "maj": 5, "cze": 6, "lip": 7, "sie": 8, "wrz": 9, "paź": 10, "lis": 11, "gru": 12,
}


def _date(y: Column, m: Column, d: Column) -> Column:
    """The date of texts of year, month and day within 1990 and 2100, or null."""
    made = F.try_make_date if hasattr(F, "try_make_date") else None
    text = F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    date = made(y.try_cast("int"), m.try_cast("int"), d.try_cast("int")) if made else text.try_cast("date")
    return F.when(F.year(date).between(1990, 2100), date)


def _groups(s: Column, pattern: str, order: str) -> Column:
    part = {k: F.regexp_extract(s, pattern, i + 1) for i, k in enumerate(order)}
    return F.when(s.rlike(pattern), _date(part["y"], part["m"], part["d"]))


def _named_month(s: Column) -> Column:
    pattern = r"(?i)\b([0-9]{1,2})[\s.\-]+(\p{L}{3,})[\s.,\-]+([0-9]{4})\b"
    number = F.create_map(*(F.lit(x) for p in MONTHS.items() for x in p))
    month = F.try_element_at(number, F.lower(F.substring(F.regexp_extract(s, pattern, 2), 1, 3))).cast("string")
    return F.when(s.rlike(pattern), _date(F.regexp_extract(s, pattern, 3), month, F.regexp_extract(s, pattern, 1)))


def parse_date(s: Column) -> Column:
    """The first reading that is a date: year first, then day.month.year, then slashes and dashes, then month names.

    With slashes or dashes the day comes first unless only the other order is a date.
    """
    t = F.trim(s)
    last = r"\b([0-9]{1,2})%s([0-9]{1,2})%s([0-9]{4})\b"
    readings = [_groups(t, r"\b([0-9]{4})%s([0-9]{1,2})%s([0-9]{1,2})\b" % (c, c), "ymd") for c in ("-", "/", r"\.")]
    readings.append(_groups(t, last % (r"\.", r"\."), "dmy"))
    for c in ("/", "-"):
        readings += [_groups(t, last % (c, c), "dmy"), _groups(t, last % (c, c), "mdy")]
    return F.coalesce(*readings, _named_month(t))


def date_candidates(s: Column) -> Column:
    """All dates that a text may mean: with slashes or dashes also day and month exchanged; sorted."""
    t = F.trim(s)
    whole = r"^([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})$"
    every = F.array(parse_date(s), _groups(t, whole, "dmy"), _groups(t, whole, "mdy"))
    return F.array_sort(F.array_distinct(F.filter(every, lambda d: d.isNotNull())))


def dates_possibly_equal(a: Column, b: Column) -> Column:
    return F.arrays_overlap(date_candidates(a), date_candidates(b))


def parse_event_date(s: Column) -> Column:
    """A date at a text's start: ISO, or day first with slashes or dots."""
    t = F.trim(s)
    return F.coalesce(_groups(t, r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})", "ymd"), _groups(t, r"^([0-9]{1,2})[/.]([0-9]{1,2})[/.]([0-9]{4})", "dmy"))


def sortable_time(s: Column) -> Column:
    """DD.MM.YYYY HH:MM[:SS] as YYYY-MM-DD HH:MM:SS; anything else as its first 32 characters."""
    pattern = r"^([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})\s+([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?"
    g = [F.regexp_extract(s, pattern, k) for k in range(1, 7)]
    two = [F.lpad(x, 2, "0") for x in g]
    made = F.concat(g[2], F.lit("-"), two[1], F.lit("-"), two[0], F.lit(" "), two[3], F.lit(":"), g[4], F.lit(":"), F.coalesce(F.nullif(g[5], F.lit("")), F.lit("00")))
    return F.when(s.rlike(pattern), made).otherwise(F.substring(s, 1, 32))


def gs1_date(s: Column, today: Column) -> Column:
    """YYMMDD of a barcode: day 00 is the month's end; years over twenty ahead of ``today`` are last century's."""
    year = F.substring(s, 1, 2).try_cast("int") + 2000
    year = F.when(year > F.year(today) + 20, year - 100).otherwise(year)
    day = F.substring(s, 5, 2)
    text = F.concat_ws("-", year.cast("string"), F.substring(s, 3, 2), F.when(day == "00", "01").otherwise(day))
    date = text.try_cast("date")
    return F.when(s.rlike("^[0-9]{6}$"), F.when(day == "00", F.last_day(date)).otherwise(date))


def stamp(order_ref: Column, mrn: Column, company: Column, when: Column) -> Column:
    """A stamp's text; blank parts are left out."""
    return F.concat_ws(" | ", F.nullif(company, F.lit("")), F.nullif(order_ref, F.lit("")), F.nullif(mrn, F.lit("")), F.date_format(when, "dd.MM.yyyy"))
