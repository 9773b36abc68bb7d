"""Date and number expressions that give null, not an error, for what they can't read."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days before an optional time, tried in this order; of formats that differ in day and month order only month-first ones exist.
FORMATS = ("yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "M-d-yyyy")

#: What models write besides.
WORDED = ("MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d yyyy", "M.d.yyyy")


def _try(t: Column, form: str) -> Column:
    """The date of t in a format, tried only on texts of its outline: a text that fails in the parser costs an exception."""
    outline = re.sub(r"M{3,}", lambda _: r"\p{L}+", re.sub(r"y+|d|(?<!M)M(?!M)", r"[-+]?\\d+", form.replace(".", r"\.")))
    return F.when(t.rlike(f"^{outline}$"), F.try_to_date(t, form))


def parse_date(text: Column) -> Column:
    """The date of an ISO date or timestamp, of one of FORMATS with or without a time of day, or of eight digits. A time that isn't one is no date."""
    t = F.trim(text.cast("string"))
    clock = r"(?:[01]?\d|2[0-3]):[0-5]?\d(?::[0-5]?\d)?"
    iso = F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}([T ]([01]?\d|2[0-3])(:[0-5]\d(:[0-5]\d([.,]\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.regexp_extract(t, r"^(\d{4}-\d{1,2}-\d{1,2})", 1))
    cut = F.coalesce(F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}T\d{2}:\d{2}"), F.regexp_extract(t, r"^(\d{4}-\d{1,2}-\d{1,2})", 1)), F.regexp_replace(t, f" {clock}$", ""))
    eight = F.when(t.rlike(r"^\d{8}$"), F.try_to_date(t, "yyyyMMdd"))
    return F.when(t.rlike(r"[-/][^-/]*[-/]"), F.coalesce(F.try_to_date(iso, "yyyy-M-d"), *[_try(cut, f) for f in FORMATS])).otherwise(eight)


def parse_model_date(text: Column) -> Column:
    """parse_date, or one of WORDED."""
    t = F.trim(text.cast("string"))
    return F.coalesce(parse_date(text), *[_try(t, f) for f in WORDED])


def normal_date(text: Column, read: Callable[[Column], Column] = parse_date) -> Column:
    """yyyy-MM-dd where the text is a date, else the trimmed text."""
    return F.coalesce(F.date_format(read(text), "yyyy-MM-dd"), F.trim(text.cast("string")))


def date_sort_key(text: Column) -> Column:
    """(normalised, raw): an order of texts that may be dates; null as two empty texts."""
    return F.struct(F.coalesce(F.date_format(parse_date(text), "yyyy-MM-dd"), F.lit("")).alias("day"), F.coalesce(F.trim(text.cast("string")), F.lit("")).alias("raw"))


def parse_number(text: Column) -> Column:
    return F.regexp_replace(text.cast("string"), r"[\s,]", "").try_cast("double")


def epoch_day(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date"))


def off_hours(ts: Column, zone: str = "America/New_York", start: int = 22, end: int = 6) -> Column:
    """Whether a UTC timestamp is at a weekend, or from `start` to `end` o'clock in the zone."""
    local = F.from_utc_timestamp(ts, zone)
    return F.dayofweek(local).isin(1, 7) | (F.hour(local) >= start) | (F.hour(local) < end)


def off_hours_wait(ts: Column, zone: str = "America/New_York", start: int = 22, end: int = 6) -> Column:
    """Seconds from a UTC timestamp to the next off-hours moment: 0 in off hours, else until `start` o'clock of that day."""
    local = F.from_utc_timestamp(ts, zone)
    at = F.date_trunc("day", local) + F.make_dt_interval(F.lit(0), F.lit(start))
    return F.when(off_hours(ts, zone, start, end), F.lit(0).cast("long")).otherwise(F.unix_timestamp(at) - F.unix_timestamp(local))
