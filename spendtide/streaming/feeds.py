"""Streams of creatives: weekly sums, deduplication, insert-only load, new documents.

Every sink writes a micro-batch below `feed=<query id>/batch_id=N`, replacing what an interrupted
run of the same batch left. The id comes from the checkpoint, so neither another feed into the same
folder nor a feed that starts over can replace stored rows.
"""

import json
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from spendtide.functions.calendar import iso_week_key
from spendtide.functions.numbers import amount, exact
from spendtide.operators.clean import UNKNOWN, clean_creatives
from spendtide.operators.dedup import KEY, complete
from spendtide.session import Stages, children, path_exists, remove, shuffles_freed
from spendtide.sources import loads
from spendtide.sources.loads import home
from spendtide.sources.tables import overwrite_weeks, rejects

# Seven-day windows; the offset from 1970-01-01, a Thursday, to a Monday.
WEEK, TO_MONDAY = "7 days", "4 days"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SUMS = ["impression_lower_sum", "impression_upper_sum", "spend_lower_sum", "spend_upper_sum"]


def landed(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Stream of Parquet files as they land; a large backlog can be cut into batches."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def feed_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps as long as its checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def _start(
    stream: DataFrame, each: Callable[[DataFrame, str, int], None], checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """State, where the stream has any, is kept by RocksDB: on the executors' disks, with a bounded part in memory."""
    def named(batch: DataFrame, batch_id: int) -> None:
        each(batch, feed_id(batch.sparkSession, checkpoint), batch_id)

    conf = stream.sparkSession.conf
    before = conf.get(STATE_STORE, None)
    conf.set(STATE_STORE, ROCKSDB)
    try:  # the query takes a copy of the settings when it starts
        with shuffles_freed(stream.sparkSession):
            return (
                stream.writeStream.foreachBatch(named).outputMode(mode)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            )
    finally:
        conf.unset(STATE_STORE) if before is None else conf.set(STATE_STORE, before)


def _grain(event_time: Column) -> list[Column]:
    """`event_time` is a timestamp: a cast here would hide a watermark from Spark, and nothing would ever be forgotten."""
    window = F.window(event_time, WEEK, WEEK, TO_MONDAY)
    return [window.alias("window"), F.col("brand"), F.col("channel"), F.coalesce("region", F.lit(UNKNOWN)).alias("region")]


def _partial_sums() -> list[Column]:
    return [
        F.count("*").alias("ad_count"),
        F.count_if("is_active").alias("active_ad_count"),
        F.sum(F.coalesce("impression_lower", F.lit(0)).cast("bigint")).alias("impression_lower_sum"),
        F.sum(F.coalesce("impression_upper", F.lit(0)).cast("bigint")).alias("impression_upper_sum"),
        F.sum(exact(F.col("spend_lower"))).alias("spend_lower_sum"),
        F.sum(exact(F.col("spend_upper"))).alias("spend_upper_sum"),
    ]


def _measures() -> list[Column]:
    monday = F.to_date("window.start")
    return [
        monday.alias("monday"), iso_week_key(monday).alias("week_key"), F.col("brand"), F.col("channel"), F.col("region"),
        F.col("ad_count"), F.col("active_ad_count"), F.col("impression_lower_sum"), F.col("impression_upper_sum"),
        amount(F.col("spend_lower_sum")).alias("spend_lower_sum"),
        amount(F.col("spend_upper_sum")).alias("spend_upper_sum"),
        (amount(F.col("spend_lower_sum") + F.col("spend_upper_sum")) / 2).alias("spend_midpoint"),
    ]


def count_weeks(creatives: DataFrame, event_time: Column, path: str, checkpoint: str) -> StreamingQuery:
    """Add every micro-batch's weekly sums to the folder `path`; read them with `weekly_windows`.

    Sums add up, so no window ever closes and no row is too late; no state is kept either. Each row of
    the stream counts once, however often a batch is run again. Copies count: load them
    through `upsert_to_tables` where they must not.
    """
    def each(batch: DataFrame, feed: str, batch_id: int) -> None:
        sums = batch.groupBy(*_grain(event_time.cast("timestamp"))).agg(*_partial_sums())
        sums.write.mode("overwrite").parquet(home(path, feed, batch_id))

    return _start(creatives, each, checkpoint)


def weekly_windows(spark: SparkSession, path: str) -> DataFrame:
    """All that `count_weeks` has added, per Monday-to-Sunday window, brand, channel and region."""
    parts = spark.read.parquet(path)
    keys = ["window", "brand", "channel", "region"]
    totals = [F.sum(c).alias(c) for c in ("ad_count", "active_ad_count", *SUMS)]
    return parts.groupBy(*keys).agg(*totals).select(*_measures())


def close_weeks(creatives: DataFrame, event_time: Column, delay_days: int, path: str, checkpoint: str) -> StreamingQuery:
    """Weekly windows that close `delay_days` behind the newest row, and a way for what comes after.

    Before a batch, windows that ended at least that long before the newest row of all earlier batches are closed. The batch's rows of
    open windows are added to those; rows of closed ones, and rows without a time, are corrections. After the batch
    windows that the new newest row closes are summed and written, once each. So
    closed windows, open ones and corrections hold every row once (`corrected_weeks`), and a reader of closed windows
    sees none change.

        path/clock/feed=F/batch_id=N         the newest time up to the batch
        path/open/feed=F/week=W/batch_id=N   sums of rows in time; a week's folder goes a batch after the week closed
        path/closed, path/late /feed=F/batch_id=N

    What is kept between batches is the clock and the sums of open weeks: bounded by the delay, not by the stream. A batch
    that runs again reads the clock of the batch before and replaces its own folders, so it comes to the same.
    """
    def each(batch: DataFrame, feed: str, batch_id: int) -> None:
        spark = batch.sparkSession
        was = None
        if batch_id and path_exists(spark, home(f"{path}/clock", feed, batch_id - 1)):
            was = spark.read.parquet(home(f"{path}/clock", feed, batch_id - 1)).first()["newest"]
        shut = _shut(was, delay_days)
        opened = f"{path}/open/feed={feed}"
        for (week,) in children(spark, opened, "week=*"):
            if shut is not None and _week_end(week) <= shut:
                remove(spark, f"{opened}/{week}")
        with Stages(spark) as stages:
            day = F.to_date(event_time)
            monday = F.date_trunc("week", day).cast("date")
            in_time = monday.isNotNull() if shut is None else F.coalesce(F.date_add(monday, 7) > F.lit(shut), F.lit(False))
            grain = [monday.alias("monday"), "brand", "channel", F.coalesce("region", F.lit(UNKNOWN)).alias("region"), in_time.alias("in_time")]
            sums = stages.write(batch.groupBy(*grain).agg(*_partial_sums(), F.max(day).alias("newest")), "sums")
            now = sums.agg(F.max("newest")).first()[0]
            newest = max((t for t in (was, now) if t is not None), default=None)
            kept = sums.drop("in_time", "newest")
            kept.filter(sums["in_time"]).withColumns({"week": F.col("monday").cast("string"), "batch_id": F.lit(batch_id)}).hint("rebalance", F.col("week")).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic").partitionBy("week", "batch_id").parquet(opened)
            kept.filter(~sums["in_time"]).write.mode("overwrite").parquet(home(f"{path}/late", feed, batch_id))
            until = _shut(newest, delay_days)
            closing = [w for (w,) in children(spark, opened, "week=*") if until is not None and _week_end(w) <= until]
            schema = kept.schema
            whole = T.StructType(list(schema.fields)).add("week", T.StringType()).add("batch_id", T.LongType())
            parts = spark.read.schema(whole).option("basePath", opened).parquet(*[f"{opened}/{w}" for w in closing]) if closing else spark.createDataFrame([], whole)
            _summed(parts, WEEK_GRAIN).write.mode("overwrite").parquet(home(f"{path}/closed", feed, batch_id))
            spark.createDataFrame([(newest, until)], "newest date, shut date").write.mode("overwrite").parquet(home(f"{path}/clock", feed, batch_id))

    return _start(creatives, each, checkpoint)


WEEK_GRAIN = ["monday", "brand", "channel", "region"]


def _shut(newest: date | None, delay_days: int) -> date | None:
    """Windows that end up to this day are closed."""
    return None if newest is None else newest - timedelta(days=delay_days)


def _week_end(folder: str) -> date:
    return date.fromisoformat(folder.removeprefix("week=")) + timedelta(days=7)


def _summed(parts: DataFrame, keys: list[str]) -> DataFrame:
    money = [F.sum(c).cast(parts.schema[c].dataType).alias(c) for c in SUMS[2:]]
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("ad_count", "active_ad_count", *SUMS[:2])], *money)


def corrected_weeks(spark: SparkSession, path: str) -> DataFrame:
    """All rows of `close_weeks` per week and group: whether the week is closed for all feeds, and how many ads came too late for it.

    Rows without a time stand under a null week. Sums hold all ads, late ones too.
    """
    clock = spark.read.parquet(f"{path}/clock").groupBy("feed").agg(F.max_by("shut", "batch_id").alias("shut"))
    shut = clock.agg(F.min("shut"), F.count_if(F.col("shut").isNull())).first()
    until = None if shut[1] else shut[0]
    done = spark.read.parquet(f"{path}/closed")
    own = [*WEEK_GRAIN, "ad_count", "active_ad_count", *SUMS]
    # Declared, as a folder of open weeks may hold no file.
    schema = T.StructType([*done.select(*own).schema.fields, T.StructField("feed", T.StringType()), T.StructField("batch_id", T.LongType())])
    parts = None
    for name in ("closed", "open", "late"):
        whole = T.StructType(list(schema.fields)).add("week", T.StringType()) if name == "open" else schema
        rows = spark.read.schema(whole).parquet(f"{path}/{name}").withColumn("late", F.lit(name == "late"))
        if name == "open":  # a closed week's folder stays for a batch
            rows = rows.join(done.select("feed", "monday").distinct(), ["feed", "monday"], "left_anti")
        rows = rows.select(*own, "late")
        parts = rows if parts is None else parts.unionByName(rows)
    totals = [F.sum(c).alias(c) for c in ("ad_count", "active_ad_count", *SUMS)]
    late = F.coalesce(F.sum(F.when(F.col("late"), F.col("ad_count"))), F.lit(0)).alias("late_ads")
    closed = F.lit(False) if until is None else F.coalesce(F.date_add("monday", 7) <= F.lit(until), F.lit(False))
    out = parts.groupBy(*WEEK_GRAIN).agg(*totals, late).withColumn("window", F.struct(F.col("monday").alias("start")))
    return out.select(*_measures(), closed.alias("closed"), "late_ads")


def stream_weekly_signals(creatives: DataFrame, event_time: Column, delay: str) -> DataFrame:
    """The same sums as a stateful aggregation that forgets windows `delay` behind the newest row.

    In append mode a window is given once, when the newest row is `delay` past its end; in update mode whenever it changes.
    A row is lost, and Spark keeps no record of it, when its window had ended `delay` before the newest row of the batches
    up to the last but one. `close_weeks` keeps such rows, `count_weeks` never closes a window.
    """
    rows = creatives.withColumn("event_time", event_time.cast("timestamp")).withWatermark("event_time", delay)
    return rows.groupBy(*_grain(F.col("event_time"))).agg(*_partial_sums()).select(*_measures())


def stream_dedup(docs: DataFrame, event_time: str | None = None, delay: str | None = None, keys: list[str] = KEY) -> DataFrame:
    """The first row of every key, over all batches.

    Without `delay` every key is remembered for good: no copy passes and nothing is lost. The state
    grows with the keys; it is partitioned by them, so use a state store on disk (RocksDB) for many.
    With `delay`, a key is forgotten when the newest row is twice that past the key's: so the state holds the keys of two delays
    and no more. A later copy passes again, and a row, copy or not, that is `delay` or more behind the newest row of the
    batches up to the last but one is lost.
    """
    if delay is None:
        return docs.dropDuplicates(keys)
    return docs.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def to_changelog(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Write every batch's rows below the feed's folder of `path`."""
    def each(batch: DataFrame, feed: str, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(home(path, feed, batch_id))

    return _start(stream, each, checkpoint, mode)


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest row per key of one feed's changelog; partial aggregation, no sort of the history."""
    log = spark.read.parquet(path)
    if log.select("feed").distinct().limit(2).count() > 1:
        raise ValueError("rows of two feeds: their aggregates cannot be told apart; keep one folder per feed")
    values = [c for c in log.columns if c not in keys and c not in ("batch_id", "feed")]
    newest = F.max(F.struct("batch_id", *values)).alias("row")
    return log.groupBy(*keys).agg(newest).select(*keys, *[f"row.{c}" for c in values])


def new_docs_since(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Count what arrived since the checkpoint: one row (new_docs) per batch.

    The checkpoint is the cursor, and it is exact per row: no count is compared, so
    a deletion elsewhere cannot hide new documents.
    """
    def each(batch: DataFrame, feed: str, batch_id: int) -> None:
        batch.agg(F.count("*").alias("new_docs")).write.mode("overwrite").parquet(home(path, feed, batch_id))

    return _start(docs, each, checkpoint)


def upsert_to_tables(
    creatives: DataFrame, raw: str, signals: str, checkpoint: str, rejected: str | None = None
) -> StreamingQuery:
    """Clean every batch, load its new documents, and refresh the weeks that they are in.

    A batch is a load of the raw table (`sources.loads`), beside those of runs (`weekly_run`) and of other feeds, which are
    to run one after the other. A batch that runs again ignores what its own
    first run stored, so it computes the same rows and replaces them. Weeks with new rows are made anew
    from the partial aggregates of all loads, which also gives the channel share; so a document
    counts however late it comes. Rows that cannot be stored go to `rejected`, if that is named.
    Intermediate tables are deleted when the batch is done.
    """
    def each(batch: DataFrame, feed: str, batch_id: int) -> None:
        spark = batch.sparkSession
        with Stages(spark) as stages:
            cleaned = stages.write(clean_creatives(batch), "batch")
            if rejected is not None:
                rejects(cleaned).write.mode("overwrite").parquet(home(rejected, feed, batch_id))
            good = cleaned.filter(complete(["brand", "week_key"]))
            touched = loads.store(good, raw, (feed, batch_id), loads.buckets_in(good))
            weeks = stages.write(loads.partial_rows(spark, raw, touched).select("brand", "yr", "week_key").distinct(), "weeks")
            overwrite_weeks(loads.facts_of(spark, raw, weeks), signals)
            loads.finish(spark, raw, touched)

    return _start(creatives, each, checkpoint)
