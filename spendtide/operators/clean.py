"""From documents as read to rows ready to aggregate."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendtide.functions.calendar import iso_week_key
from spendtide.functions.numbers import amount, believed, exact
from spendtide.functions.text import sanitize

# Columns to fill and what to fill them with.
FILL_ZERO = ["impression_lower", "impression_upper", "spend_lower", "spend_upper", "spend_midpoint"]
FILL_UNKNOWN = ["region", "platform", "cta"]
UNKNOWN = "unknown"


def cast_dates(df: DataFrame) -> DataFrame:
    """Text dates to date and timestamp. A bad text becomes null; its row stays. What is a date or timestamp already is not read again."""
    types = dict(df.dtypes)
    casts = {c: F.try_to_date(F.col(c).cast("string")) for c in ("started_running", "stopped_running") if types[c] != "date"}
    if types["ingested_at"] != "timestamp":
        casts["ingested_at"] = F.try_to_timestamp(F.col("ingested_at").cast("string"))
    return df.withColumns(casts) if casts else df


def bad_dates(df: DataFrame) -> DataFrame:
    """How many date texts `cast_dates` could not read, per column."""
    unread = [
        F.count_if(F.col(c).isNotNull() & F.try_to_date(F.col(c).cast("string")).isNull()).alias(c)
        for c in ("started_running", "stopped_running")
    ]
    at = F.col("ingested_at")
    unread.append(
        F.count_if(at.isNotNull() & F.try_to_timestamp(at.cast("string")).isNull()).alias("ingested_at")
    )
    return df.agg(*unread)


def clean_nulls(df: DataFrame) -> DataFrame:
    """Null numbers to 0 and null labels to 'unknown', where the column exists."""
    fills = {c: 0 for c in FILL_ZERO if c in df.columns}
    fills |= {c: UNKNOWN for c in FILL_UNKNOWN if c in df.columns}
    return df.fillna(fills) if fills else df


def add_spend_midpoint(df: DataFrame) -> DataFrame:
    """Middle of the spend range per row; a missing bound counts as 0."""
    both = exact(F.col("spend_lower")) + exact(F.col("spend_upper"))
    return df.withColumn("spend_midpoint", amount(both) / 2)


def sanitize_texts(df: DataFrame) -> DataFrame:
    """Remove invisible code points from ad text, call to action and themes.

    A call to action of which nothing is left is none. Themes that are all ASCII are not taken one by one.
    """
    cta, themes = sanitize(F.col("cta")), F.array_join("creative_themes", "")
    return df.withColumns({
        "ad_text": sanitize(F.col("ad_text")),
        "cta": F.when(F.trim(cta) != "", cta),
        "creative_themes": F.when(F.octet_length(themes) == F.length(themes), F.col("creative_themes")).otherwise(F.transform("creative_themes", sanitize)),
    })


def derive_week(df: DataFrame) -> DataFrame:
    """The ISO week of the start date where a document states no week."""
    stated = F.when(F.trim("week_key") != "", F.col("week_key"))
    return df.withColumn("week_key", F.coalesce(stated, iso_week_key(F.col("started_running"))))


def drop_absurd_amounts(df: DataFrame) -> DataFrame:
    """Amounts that cannot be meant become null; `bad_amounts` counts them."""
    return df.withColumns({c: believed(F.col(c)) for c in ("spend_lower", "spend_upper")})


def bad_amounts(df: DataFrame) -> DataFrame:
    """How many amounts are NaN, infinite or out of range, per column."""
    return df.agg(*[
        F.count_if(F.col(c).isNotNull() & believed(F.col(c)).isNull()).alias(c) for c in ("spend_lower", "spend_upper")
    ])


def clean_creatives(df: DataFrame) -> DataFrame:
    """All row-level steps, in the order that makes a missing bound count as 0."""
    return add_spend_midpoint(clean_nulls(sanitize_texts(derive_week(drop_absurd_amounts(cast_dates(df))))))


def filter_brand_channels(df: DataFrame, brand: str | None = None, channels: list[str] | None = None) -> DataFrame:
    """Rows of one brand and a channel list. None means all; an empty list means none."""
    if brand is not None:
        df = df.filter(F.col("brand") == brand)
    if channels is not None:
        df = df.filter(F.col("channel").isin(channels) if channels else F.lit(False))
    return df
