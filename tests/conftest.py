import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from pyspark.sql import types as T  # noqa: E402

from spendtide.schemas import RAW_CREATIVES, WEEKLY_SIGNALS  # noqa: E402
from spendtide.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        "tests", "local[*]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="4g",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def creatives(spark):
    """Creatives from short dicts; what a row leaves out has a default."""
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in RAW_CREATIVES.fields])
    base = dict(
        source="meta", brand="acme", channel="social", region="US", is_active=True,
        impression_lower=0, impression_upper=0, spend_lower=0.0, spend_upper=0.0,
        week_key="2024-W01", ingested_at="2024-01-01 00:00:00", creative_themes=[],
    )

    def make(rows):
        full = [{**{f.name: None for f in schema}, **base, "source_id": str(i), **r} for i, r in enumerate(rows)]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def signals(spark):
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in WEEKLY_SIGNALS.fields])
    base = dict(
        brand="acme", channel="social", region="US", ad_count=1, active_ad_count=1,
        impression_lower_sum=0, impression_upper_sum=0, spend_lower_sum=0.0, spend_upper_sum=0.0,
        spend_midpoint=0.0, top_ctas=[], top_themes=[], channel_share=1.0,
    )

    def make(rows):
        full = [{**{f.name: None for f in schema}, **base, **r} for r in rows]
        return spark.createDataFrame(full, schema)

    return make


def weeks(n, start=dt.date(2024, 1, 1)):
    out = []
    for i in range(n):
        y, w, _ = (start + dt.timedelta(weeks=i)).isocalendar()
        out.append(f"{y}-W{w:02d}")
    return out


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()
