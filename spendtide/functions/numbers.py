"""Money, percentages and their text forms."""

from pyspark.sql import Column
from pyspark.sql import functions as F


# Spend is added up in whole millionths.
UNITS = 1_000_000
# Amounts of one row that are believed; what lies beyond counts as missing.
MOST = 1e12


def believed(x: Column) -> Column:
    """The amount, or null where it is NaN, infinite or beyond +-MOST."""
    x = x.cast("double")
    return F.when(F.abs(x) <= MOST, x)


def exact(x: Column) -> Column:
    """Spend as a whole number of units, so that sums do not depend on row order.

    Missing amounts (see `believed`) count as 0. A row's units fit a bigint; as a decimal
    of no places their sum holds any number of rows.
    """
    return F.rint(F.coalesce(believed(x), F.lit(0.0)) * UNITS).cast("bigint").cast("decimal(19,0)")


def amount(units: Column) -> Column:
    """Units back to a double."""
    return units.cast("double") / F.lit(float(UNITS))


def pct_change(new: Column, base: Column) -> Column:
    """Percent change, guarded against a zero base by a fixed small term."""
    return (new - base) / (base + F.lit(1e-9)) * 100


def share(part: Column, total: Column) -> Column:
    """part / total, 0 when there is no total."""
    return F.coalesce(F.try_divide(part, total), F.lit(0.0))


def long_or_zero(text: Column) -> Column:
    return F.coalesce(text.try_cast("bigint"), F.lit(0).cast("bigint"))


def double_or_zero(text: Column) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def clamp_round(x: Column, places: int = 2) -> Column:
    """No negative spend; rounded."""
    return F.round(F.greatest(F.lit(0.0), x), places)


def _tenths(x: Column) -> Column:
    """|x| in tenths, rounded as the exact binary value demands (ties to even).

    Formatting a double with Java rounds its shortest decimal form, so 12.35
    becomes 12.4 although the double lies below the tie. Here 20 * fraction is
    formed as an exact sum of two doubles, and the rest term settles ties.
    """
    a = F.abs(x)
    frac = a - F.floor(a)
    hi, lo = frac * 16, frac * 4
    s = hi + lo
    back = s - hi
    rest = (hi - (s - back)) + (lo - back)
    k = F.floor(s)
    up = F.floor((k + 1) / 2)
    tie = (s == k) & (k % 2 == 1)
    n = (
        F.when(tie & (rest < 0), up - 1)
        .when(tie & (rest == 0) & (up % 2 == 1), up - 1)
        .when((s == k) & (k % 2 == 0), F.floor(k / 2))
        .otherwise(up)
    )
    return (F.floor(a) * 10 + n).cast("bigint")


def fixed1(x: Column, signed: bool = False) -> Column:
    """Text with one decimal; with `signed`, a leading + on values from 0 up."""
    t = _tenths(x)
    digits = F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit("+" if signed else ""))
    return F.concat(sign, digits)


def dollars(x: Column) -> Column:
    """`$1,234,568`: whole dollars, ties to even."""
    return F.concat(F.lit("$"), F.format_number(F.bround(x, 0), 0))


def signed_pct(x: Column) -> Column:
    """`+3.2%` / `-3.2%`."""
    return F.concat(fixed1(x, signed=True), F.lit("%"))
