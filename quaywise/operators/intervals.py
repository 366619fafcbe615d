"""Days and periods of validity that meet by equal keys: an index of periods for joins on valid-from and valid-to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A bucket of the lowest level holds 64 days, one of each next level four of the level below; six levels span 179 years from FIRST.
SHIFT, STEP, LEVELS, FIRST = 6, 2, 6, "1900-01-01"
_LAST = (1 << SHIFT + STEP * (LEVELS - 1)) - 1
#: The key of rows without a day, which every period meets.
NO_DAY = -1


#: An index of single days, in buckets of 1, 4, 16, ... of them, spans the calendar from the year 1 to 9999.
DAY_LEVELS, DAY_FIRST, _DAY_LAST, _DAY_ROOM = 11, "0001-01-01", (1 << STEP * 11) - 1, 22


def _number(day: Column, origin: str = FIRST, most: int = _LAST) -> Column:
    """Days since ``origin``, null for null; those outside of the index count as its first or last day, so order holds."""
    return F.when(day.isNotNull(), F.least(F.greatest(F.datediff(day, F.lit(origin).cast("date")), F.lit(0)), F.lit(most)))


def _key(level: int, bucket: Column, room: int = 16) -> Column:
    return bucket + F.lit(level << room)


def keys_of(day: Column) -> Column:
    """The buckets that hold a day, one a level; NO_DAY alone for null."""
    return _keys_of(_number(day))


def _keys_of(number: Column) -> Column:
    return F.when(number.isNull(), F.array(F.lit(NO_DAY))).otherwise(F.array(*[_key(k, F.shiftright(number, SHIFT + STEP * k)) for k in range(LEVELS)]))


def cover(start: Column, end: Column, undated: bool = False) -> Column:
    """The fewest buckets that cover a period (null: open at that end): at most six a level, and none within another.

    Only the two at the ends, of the lowest level, hold days that the period doesn't. ``undated`` adds NO_DAY.
    """
    return _cover(*_ends(start, end), undated)


def _ends(start: Column, end: Column) -> tuple[Column, Column]:
    """First and last bucket of the lowest level."""
    return F.shiftright(F.coalesce(_number(start), F.lit(0)), SHIFT), F.shiftright(F.coalesce(_number(end), F.lit(_LAST)), SHIFT)


def day_number(day: Column) -> Column:
    """A day as a number of its own, NO_DAY for null."""
    return F.coalesce(_number(day, DAY_FIRST, _DAY_LAST), F.lit(NO_DAY))


def buckets_at(number: Column) -> Column:
    """The buckets of single days that hold a day, given by its number; NO_DAY alone for that."""
    return F.when(number == NO_DAY, F.array(F.lit(NO_DAY))).otherwise(F.array(*[_key(k, F.shiftright(number, STEP * k), _DAY_ROOM) for k in range(DAY_LEVELS)]))


def buckets_within(first: Column, last: Column) -> Column:
    """The buckets, and NO_DAY, that together hold just the days of a period, each day once, given by numbers; NO_DAY is an open end.

    What periods say can be added up a bucket, and a day's buckets together then have what the periods that hold it say.
    """
    return _cover(F.greatest(first, F.lit(0)), F.when(last == NO_DAY, F.lit(_DAY_LAST)).otherwise(last), True, DAY_LEVELS, _DAY_ROOM)


def _cover(first: Column, last: Column, undated: bool, levels: int = LEVELS, room: int = 16) -> Column:
    none = F.array().cast("array<int>")

    def bounds(level: int) -> tuple[Column, Column]:
        """First and last bucket of a level that lie within [first, last]."""
        width = 1 << STEP * level
        return F.floor((first + (width - 1)) / width).cast("int"), F.floor((last + 1) / width).cast("int") - 1

    def run(level: int, a: Column, b: Column) -> Column:
        return F.when(a <= b, F.transform(F.sequence(a, b), lambda x: _key(level, x, room))).otherwise(none)

    parts = []
    for level in range(levels):
        a, b = bounds(level)
        if level == levels - 1:
            parts.append(run(level, a, b))
            continue
        up_a, up_b = bounds(level + 1)
        held = up_a <= up_b  # the level above takes the middle
        parts += [run(level, a, F.when(held, F.least(b, up_a * (1 << STEP) - 1)).otherwise(b)), F.when(held, run(level, F.greatest(a, (up_b + 1) * (1 << STEP)), b)).otherwise(none)]
    return F.concat(*parts, F.array(F.lit(NO_DAY)) if undated else none)


def meet(rows: DataFrame, periods: DataFrame, on: list[str], day: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Pairs of ``rows`` and ``periods`` with equal ``on`` whose period holds the day; a null day lies in every period, a null end is open.

    Rows meet periods under equal keys and buckets, so a key with many periods is met period by period and a hot key is dealt over its
    buckets; pairs beyond the result are those of the buckets at the ends of a period. Other columns must have different names.
    """
    # days are numbered in columns of their own, which the many places that read them share
    a = rows.withColumn("_number", _number(F.col(day))).withColumn("_bucket", F.explode(_keys_of(F.col("_number")))).drop("_number")
    first, last = _ends(F.col(start), F.col(end))
    b = periods.withColumns({"_first": first, "_last": last}).withColumn("_bucket", F.explode(_cover(F.col("_first"), F.col("_last"), True))).drop("_first", "_last")
    return a.join(b, [*on, "_bucket"]).filter(holds(F.col(day), start, end)).drop("_bucket")


def holds(day: Column, start: str, end: str) -> Column:
    return day.isNull() | ((F.col(start).isNull() | (F.col(start) <= day)) & (F.col(end).isNull() | (day <= F.col(end))))
