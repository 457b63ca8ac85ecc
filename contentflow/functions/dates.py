"""Date column expressions. All give ISO text; unknown dates never fail the job."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from contentflow.functions.binding import let

MISSING = "N/A"

# Accepted formats and what text in that format looks like.  The look comes first: a failed parse
# costs an exception, and most text fits one look only.
DATE_FORMATS = {
    "yyyy-MM-dd": r"^\d{4}-\d\d-\d\d$",
    "yyyyMMdd": r"^\d{8}$",
    "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$",
    "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "MMMM d, yyyy": r"^[A-Za-z]{3,9} \d{1,2}, \d{4}$",
    "MMM d, yyyy": r"^[A-Za-z]{3} \d{1,2}, \d{4}$",
    "d MMMM yyyy": r"^\d{1,2} [A-Za-z]{3,9} \d{4}$",
    "d MMM yyyy": r"^\d{1,2} [A-Za-z]{3} \d{4}$",
    "MMM d yyyy": r"^[A-Za-z]{3} \d{1,2} \d{4}$",
    "MMMM d yyyy": r"^[A-Za-z]{4,9} \d{1,2} \d{4}$",
}
# A time of day, with or without seconds, fractions and zone, and a day of the week before the date.
_TIME = r"(?:[T ]\d\d:\d\d(?::\d\d(?:[.,]\d+)?)?)? ?(?:Z|[A-Z]{1,5}|[+-]\d\d:?\d\d)?$"
_WEEKDAY = r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,? "


def short_us_date(c: Column) -> Column:
    """``m/d/yy`` as a date. Years 69 to 99 belong to the last century."""
    parsed = F.try_to_date(c, "M/d/yy")
    return let(parsed, lambda d: F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d))


def parse_us_date(c: Column) -> Column:
    """``m/d/yy`` to ISO text; anything else is 'N/A'."""
    return F.coalesce(F.date_format(short_us_date(c), "yyyy-MM-dd"), F.lit(MISSING))


def standardize_date(c: Column, formats: dict[str, str] = DATE_FORMATS) -> Column:
    """Any date in a known format to ISO text, otherwise NULL.

    The day is the one written; a time of day and a zone do not change it.
    """
    has_time = c.rlike(r"\d\d:\d\d")
    c = F.regexp_replace(F.when(has_time, F.regexp_replace(c, _TIME, "")).otherwise(c), _WEEKDAY, "")
    tried = [F.when(c.rlike(look), F.try_to_date(c, f)) for f, look in formats.items()]
    short = F.when(c.rlike(r"^\d{1,2}/\d{1,2}/\d\d$"), short_us_date(c))
    return F.date_format(F.coalesce(*tried, short), "yyyy-MM-dd")


def iso_date(c: Column) -> Column:
    """ISO text to a date; 'N/A' and other non-dates are NULL."""
    return F.try_to_date(c, "yyyy-MM-dd")
