"""Brand slugs, display names, channels and platforms."""

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Publisher platform -> channel.
PLATFORM_CHANNEL = {
    "facebook": "social",
    "instagram": "social",
    "audience_network": "display",
    "messenger": "social",
    "video": "video",
}
DEFAULT_PLATFORM = "facebook"
DEFAULT_CHANNEL = "social"

# Channels bought through search, and their platform labels.
SEARCH_CHANNELS = ["search", "video", "display"]
SEARCH_PLATFORMS = ["google_search", "youtube", "google_display"]


def brand_slug(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("-"))


def title_case(name: Column) -> Column:
    """First letter of every run of letters in upper case, the rest in lower case.

    `initcap` starts words at blanks only: 'coca-cola' would give 'Coca-cola'.
    """
    runs = F.regexp_extract_all(name, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))),
        "",
    )


def first_platform(platforms: Column) -> Column:
    """First platform of the list; the default for an empty or missing list."""
    return F.coalesce(F.get(platforms, F.lit(0)), F.lit(DEFAULT_PLATFORM))


def channel_of_platform(platform: Column) -> Column:
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(PLATFORM_CHANNEL.items())])
    return F.coalesce(F.try_element_at(table, platform), F.lit(DEFAULT_CHANNEL))


def search_platform(source_id: Column) -> Column:
    """A platform label chosen by the id, so that a rerun gives the same one."""
    bucket = F.conv(F.substring(F.md5(source_id), 1, 8), 16, 10).cast("bigint") % len(SEARCH_PLATFORMS)
    return F.get(F.array(*[F.lit(p) for p in SEARCH_PLATFORMS]), bucket.cast("int"))
