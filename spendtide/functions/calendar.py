"""ISO weeks and dates."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: form of a week key.
WEEK_KEY = r"^\d{4}-W(0[1-9]|[1-4]\d|5[0-3])$"


def iso_week_key(day: Column) -> Column:
    """Date -> `YYYY-Www`, with the ISO year (2024-12-30 is in 2025-W01)."""
    year = F.extract(F.lit("YEAROFWEEK"), day).cast("string")
    week = F.lpad(F.weekofyear(day).cast("string"), 2, "0")
    return F.concat(F.lpad(year, 4, "0"), F.lit("-W"), week)


def week_monday(key: Column) -> Column:
    """`YYYY-Www` -> Monday of that week; null for any other text."""
    week1 = F.trunc(F.try_to_date(F.concat(F.substring(key, 1, 4), F.lit("-01-04"))), "week")
    monday = F.date_add(week1, (F.substring(key, 7, 2).try_cast("int") - 1) * 7)
    return F.when(key.rlike(WEEK_KEY), monday)


def week_year(key: Column) -> Column:
    """ISO year of a week key: the partition column `yr` of the tables."""
    return F.substring(key, 1, 4)


def lenient_date(text: Column) -> Column:
    """Date of a text; null when it is no date."""
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def from_epoch_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms)
