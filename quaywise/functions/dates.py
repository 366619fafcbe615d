"""Dates: printed forms, months, free time counted in working days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import _col

#: Printed forms in order of trial; month first where a date reads both ways.
FORMS = ["yyyy-M-d", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "M/d/yyyy", "d/M/yyyy", "d.M.yyyy", "d-MMM-yyyy", "d-MMM-yy", "yyyy/M/d"]


def parse_date(x: Column | str, day_first: bool = False) -> Column:
    """The date that a text prints, by the first form that fits; null if none does. ``day_first`` swaps the ambiguous two."""
    text = F.regexp_replace(F.trim(_col(x)), "[.,]+$", "")
    forms = list(FORMS)
    if day_first:
        i, j = forms.index("M/d/yyyy"), forms.index("d/M/yyyy")
        forms[i], forms[j] = forms[j], forms[i]
    return F.coalesce(*[F.try_to_date(text, f) for f in forms])


def variants(x: Column | str) -> Column:
    """Ways a date may be printed."""
    forms = ["yyyy-MM-dd", "dd MMM yyyy", "dd MMMM yyyy", "MMM dd, yyyy", "MMMM dd, yyyy", "MM/dd/yyyy", "dd/MM/yyyy", "dd.MM.yyyy", "dd-MMM-yyyy", "dd-MMM-yy", "yyyy/MM/dd", "d MMM yyyy", "M/d/yyyy"]
    return F.array_sort(F.array_distinct(F.array(*[F.date_format(_col(x), f) for f in forms])))


def month_start(x: Column | str) -> Column:
    return F.trunc(_col(x), "month")


def local_day(ts: Column | str, zone: Column | str) -> Column:
    """The day that a UTC timestamp falls on in a zone."""
    return F.to_date(F.from_utc_timestamp(_col(ts), zone))


def whole_days(since: Column, until: Column) -> Column:
    """Whole periods of 24 hours."""
    return F.floor((F.unix_timestamp(until.cast("timestamp")) - F.unix_timestamp(since.cast("timestamp"))) / 86400)


def last_free_day(start: Column | str, days: Column | str, weekends: Column | str, holidays: Column | None = None) -> Column:
    """The last free day if free time begins the day after ``start``: the n-th counted day, or ``start`` for none.

    Every day counts if ``weekends``; else Monday to Friday without ``holidays`` (an array of dates). The days are found
    in a sequence that is long enough for any mix of weekends and holidays.
    """
    s, n = _col(start), _col(days)
    off = F.lit(0) if holidays is None else F.size(holidays)
    ahead = F.sequence(F.date_add(s, 1), F.date_add(s, (F.floor(n / 5) * 7 + 8 + off * 3).cast("int")))

    def counted(d: Column) -> Column:
        working = F.weekday(d) < 5
        return working if holidays is None else working & ~F.array_contains(holidays, d)

    nth = F.try_element_at(F.filter(ahead, counted), n.cast("int"))
    return F.when(n == 0, s).when(_col(weekends), F.date_add(s, n.cast("int"))).otherwise(nth)


#: Wordings of free time in calendar and in working days.
CALENDAR = r"(?i)calendar|including (?:saturdays|weekends)|incl\.? weekends|7 days"
WORKING = r"(?i)working|business|excluding|excl\.|not counted|monday"


def counts_weekends(wording: Column | str, default: Column) -> Column:
    """Whether a notice counts calendar days: by its wording, else the organisation's setting."""
    text = F.coalesce(_col(wording), F.lit(""))
    return F.when(text.rlike(CALENDAR), F.lit(True)).when(text.rlike(WORKING), F.lit(False)).otherwise(default)
