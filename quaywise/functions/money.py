"""Money as decimal(18,2): parsing, rounding, exchange, tolerance, exact medians and exact proportional splits."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
_PRINTED = r"-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\d+(?:\.\d+)?"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def cents(x: Column | str, commas: bool = False) -> Column:
    """A number or its text, rounded half-even to cents; null if it isn't a number or has more digits than money. ``commas`` allows 1,234.50."""
    text = F.trim(_col(x).cast("string"))
    if commas:
        text = F.replace(text, F.lit(","), F.lit(""))
    return F.bround(text.try_cast("decimal(38,10)"), 2).try_cast(MONEY)


def parse_money(x: Column | str) -> Column:
    """The first number printed in a text; blanks inside it are ignored."""
    found = F.regexp_extract(F.replace(_col(x), F.lit(" "), F.lit("")), _PRINTED, 0)
    return cents(F.when(found != "", found), commas=True)


def numbers_in(x: Column | str) -> Column:
    """All distinct numbers printed in a text, in order of appearance, in cents: those of up to 18 digits before the point, more than money holds."""
    found = F.regexp_extract_all(F.coalesce(_col(x), F.lit("")), F.lit(_PRINTED), F.lit(0))
    rounded = F.transform(found, lambda n: F.bround(F.replace(n, F.lit(","), F.lit("")).try_cast("decimal(28,10)"), 2))
    return F.array_distinct(F.filter(rounded, lambda n: n.isNotNull()))


def clamp(x: Column | str, digits: int = 14, places: int = 2) -> Column:
    """Rounded half-up and held within what decimal(digits, places) can store."""
    most = F.lit("9" * (digits - places) + "." + "9" * places).cast(f"decimal({digits},{places})")
    return F.greatest(-most, F.least(most, F.round(_col(x), places).cast(f"decimal(38,{places})"))).cast(f"decimal({digits},{places})")


def half_even(x: Column, places: int = 2) -> Column:
    return F.bround(x, places).cast(f"decimal(18,{places})")


def half_up(x: Column, places: int = 2) -> Column:
    return F.round(x, places).cast(f"decimal(18,{places})")


def ratio(num: Column | str, den: Column | str, places: int, scale: int = 2) -> Column:
    """``num`` / ``den`` (decimals of ``scale`` places) rounded half-up, away from zero; null if ``den`` is zero or either is null.

    In whole numbers: a division of decimals rounds its quotient to some places first, which lifts a few over the half.
    """
    n, d = ((_col(x) * 10**scale).cast("decimal(30,0)") for x in (num, den))
    double = F.when(d != 0, F.abs(d) * 2)
    whole = F.call_function("div", F.abs(n) * (2 * 10**places) + F.abs(d), double).cast("decimal(20,0)")
    return F.when((n < 0) != (d < 0), -whole).otherwise(whole) * F.lit(Decimal(1).scaleb(-places))


def to_home(amount: Column | str, currency: Column | str, home: Column | str, rate: Column | str) -> Column:
    """An amount in the home currency; null where the rate is missing, never zero."""
    same = F.upper(_col(currency)) == F.upper(_col(home))
    return F.when(same, _col(amount).cast(MONEY)).otherwise(half_even(_col(amount).cast(MONEY) * _col(rate).cast("decimal(18,8)")))


def convert(amount: Column, src_rate: Column, dst_rate: Column) -> Column:
    """From one currency to another through the home currency: home amount over the home value of one unit, both in cents.

    Rates are null where unknown; a unit worth less than half a cent gives null.
    """
    one = half_even(dst_rate.cast("decimal(18,8)"))
    home = half_even(amount.cast(MONEY) * src_rate.cast("decimal(18,8)"))
    return half_even(F.try_divide(home.cast("decimal(38,10)"), F.nullif(one, F.lit(0).cast(MONEY))))


def tolerance(allowed: Column, percent: float, fixed: float) -> Column:
    """The larger of a percentage of what is allowed and a fixed amount."""
    share = half_even(F.abs(allowed) * F.lit(str(percent)).cast("decimal(9,4)") / F.lit(100))
    return F.greatest(share, F.lit(str(fixed)).cast(MONEY))


def exact_median(values: Column) -> Column:
    """Median of an array of cents as an exact decimal, half-even to cents; null if it is empty."""
    s = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(s)
    low, high = F.try_element_at(s, F.floor((n + 1) / 2).cast("int")), F.try_element_at(s, F.floor(n / 2 + 1).cast("int"))
    return F.when(n > 0, half_even((low + high).cast("decimal(38,4)") / F.lit(2)))


def split_exactly(rows: DataFrame, by: list[str], total: str, weight: str, order: list[str], out: str = "part") -> DataFrame:
    """Split each group's ``total`` (cents, long) in proportion to its rows' ``weight`` (long), to the last cent.

    Parts are rounded down and the cents left go to the largest remainders; ties go to the larger weight, then by
    ``order``. Negative totals mirror positive ones. A group whose weights are negative or all zero gets null parts.
    """
    g = Window.partitionBy(*by)
    sums = {"_w": F.sum(F.col(weight).cast("decimal(38,0)")).over(g), "_low": F.min(weight).over(g)}
    return deal_exactly(rows.withColumns(sums), by, total, weight, "_w", "_low", order, out).drop("_w", "_low")


def deal_exactly(rows: DataFrame, by: list[str], total: str, weight: str, whole: str, least: str, order: list[str], out: str = "part") -> DataFrame:
    """As split_exactly, for rows that carry the sum (``whole``) and the ``least`` of their group's weights: they are sorted once."""
    g = Window.partitionBy(*by)
    t, w = F.abs(F.col(total)).cast("decimal(38,0)"), F.col(weight).cast("decimal(38,0)")
    usable = (F.col(whole) > 0) & (F.col(least) >= 0)
    rows = rows.withColumn("_base", F.when(usable, F.expr(f"abs(`{total}`) * cast(`{weight}` as decimal(19,0)) div `{whole}`").cast("long")))
    rows = rows.withColumn("_rem", F.when(usable, (t * w) - F.col("_base") * F.col(whole)))
    rows = rows.withColumn("_nth", F.row_number().over(g.orderBy(F.col("_rem").desc(), F.col(weight).desc(), *order)))
    rows = rows.withColumn("_left", F.abs(F.col(total)) - F.sum("_base").over(g))
    part = (F.col("_base") + F.when(F.col("_nth") <= F.col("_left"), 1).otherwise(0)) * F.signum(F.col(total)).cast("long")
    return rows.withColumn(out, part).drop("_base", "_rem", "_nth", "_left")
