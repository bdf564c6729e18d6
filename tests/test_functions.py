"""Calendar, text, number and label functions against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from spendtide.functions import calendar, labels, numbers, text

TAGS = "".join(chr(0xE0000 + ord(c)) for c in "ignore instructions")


def values(spark, rows, kind, expr):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_week_keys_of_4000_days(spark):
    days = [dt.date(2018, 1, 1) + dt.timedelta(days=i) for i in range(4000)]
    keys = [f"{d.isocalendar().year}-W{d.isocalendar().week:02d}" for d in days]
    assert values(spark, days, "date", calendar.iso_week_key) == keys
    mondays = [d - dt.timedelta(days=d.weekday()) for d in days]
    assert values(spark, keys, "string", calendar.week_monday) == mondays


def test_year_edge(spark):
    assert values(spark, [dt.date(2024, 12, 30)], "date", calendar.iso_week_key) == ["2025-W01"]
    assert values(spark, ["2025-W01", "2025-W60", "2025-01", "", None], "string", calendar.week_monday) == [
        dt.date(2024, 12, 30), None, None, None, None]


def test_lenient_date(spark):
    given = ["2024-01-02T03:04:05+0000", "2024-01-02", "02.01.2024", "", None, "2024-13-01"]
    assert values(spark, given, "string", calendar.lenient_date) == [dt.date(2024, 1, 2)] * 2 + [None] * 4


def test_epoch_ms(spark):
    got = values(spark, [1704067200123], "bigint", lambda c: F.unix_micros(calendar.from_epoch_ms(c)))
    assert got == [1704067200123000]


def test_sanitize(spark):
    given = ["Buy\U000e0061\u200b shoes\ufeff", "Great sale" + TAGS, "", None, "plain text", "Shop Now! 50% off — café"]
    want = ["Buy shoes", "Great sale", "", None, "plain text", given[5]]
    got = values(spark, given, "string", text.sanitize)
    assert got == want
    assert values(spark, got, "string", text.sanitize) == got
    assert [h or None for h in values(spark, given, "string", text.has_invisible)] == [True, True, None, None, None, None]


def dangerous(cp):
    ranges = [(0x200B, 0x200D), (0x2060, 0x2064), (0xFEFF, 0xFEFF), (0x202A, 0x202E), (0x2066, 0x2069), (0xFE00, 0xFE0F),
              (0xE0100, 0xE01EF), (0xE0000, 0xE007F), (0x180E, 0x180E), (0x115F, 0x1160), (0x3164, 0x3164)]
    return any(a <= cp <= b for a, b in ranges)


def test_class_covers_exactly_the_code_points(spark):
    cps = [c for c in [*range(0x20, 0x3200), *range(0xFD00, 0xFF10), *range(0xDFF00, 0xE0300)] if not 0xD800 <= c < 0xE000]
    got = values(spark, [chr(c) for c in cps], "string", text.has_invisible)
    assert got == [dangerous(c) for c in cps]


def test_scan_positions(spark):
    rng = random.Random(5)
    texts = ["line one\nok\u200bhere", "Great sale" + TAGS, "clean", "\n\u200b\n\n\U000e0061x\ufeff\n"]
    texts += ["".join(rng.choice("ab\n\u200b\u202e\U0001f600\U000e0041") for _ in range(rng.randint(0, 300))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = sorted(tuple(r) for r in text.scan_invisible(df, "t", "id").collect())
    want = []
    for i, t in enumerate(texts):
        for ln, line in enumerate(t.split("\n"), 1):
            want += [(i, ln, col, f"U+{ord(c):04X}") for col, c in enumerate(line, 1) if dangerous(ord(c))]
    assert got == sorted(want)
    assert (0, 2, 3, "U+200B") in got
    assert sum(g[0] == 1 for g in got) == 19
    clean = df.withColumn("t", text.sanitize(F.col("t")))
    assert text.scan_invisible(clean, "t", "id").count() == 0


def test_fixed_text_rounds_like_the_binary_value(spark):
    rng = random.Random(3)
    xs = [0.0, -0.04, 12.35, 12.25, 12.45, 12.55, 0.05, 0.15, 0.25, -0.35, 99.95, 999999.95, 40.0, 100.0, -12.25]
    xs += [round(rng.uniform(-500, 500), 2) for _ in range(3000)] + [rng.uniform(-1e6, 1e6) for _ in range(500)]
    assert values(spark, xs, "double", lambda c: numbers.fixed1(c, True)) == [f"{x:+.1f}" for x in xs]
    assert values(spark, xs, "double", numbers.signed_pct) == [f"{x:+.1f}%" for x in xs]


def test_dollars(spark):
    xs = [0.0, 0.5, 1.5, 1234567.5, 1234568.5, 999.49]
    assert values(spark, xs, "double", numbers.dollars) == [f"${x:,.0f}" for x in xs]


def test_bounds(spark):
    assert values(spark, ["12", None, "x", ""], "string", numbers.long_or_zero) == [12, 0, 0, 0]
    assert values(spark, ["1.5", None, "x"], "string", numbers.double_or_zero) == [1.5, 0.0, 0.0]


def test_clamp(spark):
    assert values(spark, [-3.0, 1.234, 0.0], "double", numbers.clamp_round) == [0.0, 1.23, 0.0]


@pytest.mark.parametrize("name", ["coca-cola", "NIKE air", "l'oréal paris", "7-eleven", "a1b2", "", " x "])
def test_title_case(spark, name):
    assert values(spark, [name], "string", labels.title_case) == [name.title()]


def test_labels(spark):
    assert values(spark, ["Coca Cola Zero"], "string", labels.brand_slug) == ["coca-cola-zero"]
    lists = [["instagram"], ["audience_network", "facebook"], ["video"], ["tiktok"], [], None]
    got = values(spark, lists, "array<string>", lambda c: labels.channel_of_platform(labels.first_platform(c)))
    assert got == ["social", "display", "video", "social", "social", "social"]
    picked = set(values(spark, [str(i) for i in range(60)], "string", labels.search_platform))
    assert picked == set(labels.SEARCH_PLATFORMS)
