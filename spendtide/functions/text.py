"""Invisible code points in untrusted text: find, report, remove."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Code points that render as nothing and can smuggle text.
INVISIBLE = (
    "["
    r"\x{200B}-\x{200D}\x{2060}\x{FEFF}"    # zero width, word joiner, byte order mark
    r"\x{202A}-\x{202E}\x{2066}-\x{2069}"   # bidirectional overrides and isolates
    r"\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}"  # variation selectors
    r"\x{E0000}-\x{E007F}"                  # tag block
    r"\x{180E}\x{115F}\x{1160}"             # Mongolian separator, Hangul fillers
    r"\x{2061}-\x{2064}\x{3164}"            # invisible operators, Hangul filler
    "]"
)


def sanitize(text: Column) -> Column:
    """The text without its invisible code points. Null and empty stay as they are.

    A text of as many bytes as code points is all ASCII and has none: no pattern is run over it.
    """
    cleaned = F.regexp_replace(text, F.lit(INVISIBLE), F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(cleaned)


def has_invisible(text: Column) -> Column:
    return text.rlike(INVISIBLE)


def invisible_hits(text: Column) -> Column:
    """array<struct<line, col, code_point>>, both 1-based, one entry per hit.

    Only lines that hold a hit are taken apart, so clean text costs one match
    per line and no per-character work.
    """
    def in_line(line: Column, i: Column) -> Column:
        chars = F.transform(
            F.split(line, ""),
            lambda ch, j: F.struct((j + 1).cast("bigint").alias("col"), ch.alias("ch")),
        )
        hits = F.transform(
            F.filter(chars, lambda x: has_invisible(x["ch"])),
            lambda x: F.struct(
                (i + 1).cast("bigint").alias("line"),
                x["col"].alias("col"),
                F.format_string("U+%04X", F.ascii(x["ch"])).alias("code_point"),
            ),
        )
        return F.when(has_invisible(line), hits)

    per_line = F.transform(F.split(text, "\n"), in_line)
    return F.flatten(F.filter(per_line, lambda hits: hits.isNotNull()))


def scan_invisible(df: DataFrame, text: str, *ids: str) -> DataFrame:
    """One row per invisible code point: the id columns, line, col, code_point."""
    hits = df.filter(has_invisible(F.col(text))).select(
        *ids, F.explode(invisible_hits(F.col(text))).alias("hit")
    )
    return hits.select(*ids, "hit.line", "hit.col", "hit.code_point")
