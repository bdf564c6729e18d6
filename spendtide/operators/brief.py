"""Brief texts: the context per brand, the call of a caller-supplied writer, the
flat response row."""

import hashlib
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendtide.functions.numbers import fixed1
from spendtide.functions.text import sanitize
from spendtide.session import open_store, task_count

# Headings that readers look for, and the texts of failures.
HEAD = "SIGNAL DATA (%d weeks of observations):"
REQUIREMENTS_HEAD = "BRIEF REQUIREMENTS:"
NO_ANOMALY = "none detected"
NO_DATA = "Insufficient data for %s: %s"
WRITER_ERROR = "[LLM Error: {}]"

CONTEXT = HEAD + "\n* direction: %s\n* Channel mix, last weeks: %s\n* by channel: %s\n* unusual weeks: %s\n* themes: %s"
NO_TREND = NO_THEME = "not enough rows"
N_LAST_ANOMALIES = 3


def _or(text: Column, missing: str) -> Column:
    return F.when(F.length(text) > 0, text).otherwise(F.lit(missing))


def mix_text(mix: Column) -> Column:
    """`search: 40.2%, social: 31.0%`, largest first, ties by channel."""
    entries = F.transform(F.map_entries(mix), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))
    parts = F.transform(F.array_sort(entries), lambda e: F.concat(e["k"], F.lit(": "), fixed1(-e["v"]), F.lit("%")))
    return F.array_join(parts, ", ")


def trends_text(forecasts: Column) -> Column:
    """`search: flat (+1.2%) | social: increasing (+14.0%)`, by channel."""
    parts = F.transform(
        F.array_sort(F.map_entries(forecasts)),
        lambda e: F.concat(
            e["key"], F.lit(": "), e["value"]["trend_direction"],
            F.lit(" ("), fixed1(e["value"]["trend_pct_change"], signed=True), F.lit("%)"),
        ),
    )
    return F.array_join(parts, " | ")


def last_weeks_text(weeks: Column) -> Column:
    """The newest flagged weeks, oldest of them first."""
    size = F.size(weeks)
    start = F.greatest(size - N_LAST_ANOMALIES + 1, F.lit(1))
    return F.array_join(F.slice(weeks, start, N_LAST_ANOMALIES), ", ")


def brief_context(summary: DataFrame, task: str = "%s", requirements: str = "") -> DataFrame:
    """brand, status, context, prompt. A brand without data gets its notice instead.

    What a writer is asked for is the caller's: `task`, with %s for the brand in capitals, opens the
    prompt, and `requirements` close it.
    """
    ok = F.col("status") == "ok"
    context = F.format_string(
        CONTEXT,
        F.col("weeks_analysed"),
        F.col("dominant_trend"),
        F.coalesce(mix_text(F.col("channel_mix_pct")), F.lit("")),
        _or(trends_text(F.col("channel_forecasts")), NO_TREND),
        _or(last_weeks_text(F.col("anomaly_weeks")), NO_ANOMALY),
        sanitize(_or(F.array_join("top_themes", ", "), NO_THEME)),
    )
    notice = F.format_string(NO_DATA, F.col("brand"), F.col("status"))
    text = F.when(ok, context).otherwise(notice)
    prompt = F.concat_ws(
        "\n\n", F.format_string(task, F.upper("brand")), context, F.lit(f"{REQUIREMENTS_HEAD} {requirements}".strip())
    )
    return summary.select("brand", "status", text.alias("context"), F.when(ok, prompt).alias("prompt"))


def generate_briefs(contexts: DataFrame, writer: Callable[[str, str], str], role: str = "") -> DataFrame:
    """brand, brief: `writer(prompt, role)` called once per brand with data.

    A failed call becomes a text that says so. Brands without data keep their notice
    and cause no call. Calls are slow, so brands are spread over all tasks.
    """
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(prompt: str | None, context: str) -> str:
            if prompt is None:
                return context
            try:
                return (writer(prompt, role) or "").strip()
            except Exception as e:  # any failure of a caller's function
                return WRITER_ERROR.format(e)

        for b in batches:
            briefs = [one(p, c) for p, c in zip(b["prompt"], b["context"], strict=True)]
            yield pd.DataFrame({"brand": b["brand"], "brief": briefs})

    spaced = contexts.select("brand", "prompt", "context").repartition(task_count(contexts.sparkSession), "brand")
    return spaced.mapInPandas(write, "brand string, brief string")


def answered_briefs(
    contexts: DataFrame, answers: str, writer: Callable[[str, str], str], role: str = "", attempts: int = 3, parallel: int = 4, pause: float = 1.0
) -> DataFrame:
    """As `generate_briefs`, with each answer kept in the folder `answers` as soon as it is there.

    A task asks for up to `parallel` brands at a time and for each up to `attempts` times, waiting `pause` seconds, then twice
    as long, and so on. An answer is a file of its own, named by a hash of brand, role and prompt, and appears whole; whoever is
    asked for it again, be it a task that runs a second time or a run after a crash, reads it and calls nobody. A
    brand for which every attempt failed gets the text that says so, which is not kept.
    """
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = open_store(answers)
        fs.create_dir(base, recursive=True)

        def one(brand: str, prompt: str | None, context: str) -> str:
            if prompt is None:
                return context
            at = f"{base}/{hashlib.sha256(chr(0).join([str(brand), role, prompt]).encode()).hexdigest()}"
            if fs.get_file_info(at).is_file:
                with fs.open_input_stream(at) as f:
                    return f.read().decode("utf-8", "surrogatepass")
            for k in range(attempts):
                try:
                    text = (writer(prompt, role) or "").strip()
                    break
                except Exception as e:  # any failure of a caller's function
                    text = WRITER_ERROR.format(e)
                    if k + 1 == attempts:
                        return text
                    time.sleep(pause * 2**k)
            with fs.open_output_stream(hidden := f"{base}/_{uuid.uuid4().hex}") as f:
                f.write(text.encode("utf-8", "surrogatepass"))
            fs.move(hidden, at)
            return text

        with ThreadPoolExecutor(parallel) as pool:
            for b in batches:
                briefs = list(pool.map(one, b["brand"], b["prompt"], b["context"]))
                yield pd.DataFrame({"brand": b["brand"], "brief": briefs})

    spaced = contexts.select("brand", "prompt", "context").repartition(task_count(contexts.sparkSession), "brand")
    return spaced.mapInPandas(ask, "brand string, brief string")


def brief_response(summary: DataFrame, briefs: DataFrame) -> DataFrame:
    """The flat public row of every brand with data."""
    empty = F.array().cast("array<string>")
    return summary.filter(F.col("status") == "ok").join(briefs, "brand").select(
        "brand", "brief", "dominant_trend",
        F.coalesce("anomaly_weeks", empty).alias("anomaly_weeks"),
        F.coalesce("top_themes", empty).alias("top_themes"),
        "weeks_analysed",
    )
