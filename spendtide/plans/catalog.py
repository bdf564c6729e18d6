"""The registered queries: name -> function of (session, data folder).

Each runs one operator over whole tables. Lists and maps are shown as joined text,
dates and timestamps as text, so that two engines can be compared by value.
"""

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendtide import schemas
from spendtide.functions import calendar, labels, numbers, text
from spendtide.operators import anomaly, brief, clean, dedup, forecast, report, summary, trend, weekly
from spendtide.plans.briefs import saved_briefs as briefs_of_snapshot
from spendtide.plans.starschema import CHANNEL, creatives, table
from spendtide.plans.weekly_run import weekly_run
from spendtide.session import children, shared_dir, staged
from spendtide.sources import archive, loads, pagewalk, snapshots, tables, textfiles
from spendtide.sources import creatives as docs
from spendtide.streaming import feeds

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the registered queries; the SQL texts use the same.
BRAND = "building"
CHANNELS = ["search", "video"]
SPLIT_WEEK = "1998-W01"
RECENT = 1000
AS_OF = "2001-01-01"
BATCH_TS = "2001-01-01 00:00:00"
COMMITS = [datetime(2001, 1, 1), datetime(2001, 1, 2)]
ZWSP, TAG_A = "\u200b", "\U000e0061"

# A stream source wants a folder or a pattern; the pattern matches one name, be it a
# file or a folder of files.
LANDED = "{}/{}.parque[t]"

QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# ---- shared inputs and forms of output ------------------------------------------------


def day_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def time_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def shown(df: DataFrame) -> DataFrame:
    """Creatives with lists, dates and timestamps as text."""
    types = dict(df.dtypes)
    out = []
    for c in df.columns:
        kind = types[c]
        col = F.col(c)
        if kind.startswith("array"):
            col = F.array_join(col, "|")
        elif kind == "date":
            col = day_text(col)
        elif kind.startswith("timestamp"):
            col = time_text(col)
        out.append(col.alias(c))
    return df.select(*out)


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """Fact rows without the top lists."""
    return weekly.weekly_measures(creatives(spark, sf))


def full_signals(spark: SparkSession, sf: str) -> DataFrame:
    """The fact table reads its input three times, so that is written first."""
    return weekly.weekly_signals(staged(creatives(spark, sf).select(*weekly.INPUT), "creatives"))


def placed(df: DataFrame) -> DataFrame:
    """With each row's place, so that the order of a sorted result is compared too."""
    by_row = Window.orderBy(F.monotonically_increasing_id())
    return df.withColumn("place", F.row_number().over(by_row).cast("bigint"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Creatives as text documents: dates and timestamps are text."""
    return creatives(spark, sf).withColumns({
        "started_running": day_text(F.col("started_running")),
        "stopped_running": day_text(F.col("stopped_running")),
        "ingested_at": time_text(F.col("ingested_at")),
    })


def smuggled(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, whole, with invisible code points behind every comma and full stop."""
    t = F.replace(F.replace(F.col("text"), F.lit(", "), F.lit(f",{ZWSP} ")), F.lit(". "), F.lit(f".{TAG_A} "))
    return table(spark, sf, "documents").select("doc_id", t.alias("text"))


def ad_structs(spark: SparkSession, sf: str) -> DataFrame:
    """One archive ad per order line, with the gaps and bad dates such ads have."""
    part = F.col("l_partkey")
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    lines = table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    lower = (F.col("l_quantity") * 1000).cast("bigint")
    ad = F.struct(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"),
        F.concat(F.col("c_name"), F.lit(ZWSP), F.lit(" offer")).alias("ad_creative_body"),
        F.when(part % 7 == 0, "soon").when(part % 11 != 0, F.concat(day_text(F.col("o_orderdate")), F.lit("T00:00:00+0000")))
        .alias("ad_delivery_start_time"),
        F.when(F.col("l_linestatus") == "F", day_text(F.col("l_shipdate"))).alias("ad_delivery_stop_time"),
        F.when(part % 13 != 0, F.struct(
            lower.cast("string").alias("lower_bound"), (lower + 500).cast("string").alias("upper_bound"),
            F.lit(None).cast("string").alias("currency"),
        )).alias("impressions"),
        F.when(part % 17 != 0, F.struct(
            F.col("l_quantity").cast("string").alias("lower_bound"),
            (F.col("l_quantity") * 2).cast("string").alias("upper_bound"),
            F.when(part % 3 == 0, "EUR").alias("currency"),
        )).alias("spend"),
        F.when(part % 5 == 0, F.array().cast("array<string>"))
        .when(part % 5 == 1, F.array(F.lit("instagram"), F.lit("video")))
        .when(part % 5 == 2, F.array(F.lit("audience_network")))
        .when(part % 5 == 3, F.array(F.lit("video")))
        .alias("publisher_platforms"),
    )
    return lines.select(
        F.concat(F.initcap("c_mktsegment"), F.lit(" co-op")).alias("brand"),
        ((F.col("l_linenumber") - 1) * 3).cast("bigint").alias("page_index"),
        ad.cast(archive.ARCHIVE_AD).alias("ad"),
    )


def ads(spark: SparkSession, sf: str) -> DataFrame:
    """The same ads as JSON."""
    return ad_structs(spark, sf).withColumn("json", F.to_json("ad")).drop("ad")


def normalised(spark: SparkSession, sf: str) -> DataFrame:
    return archive.normalise_ads(
        archive.parse_ads(ads(spark, sf), "json"), F.lit(AS_OF).cast("date"), F.lit(BATCH_TS).cast("timestamp")
    )


def old(df: DataFrame) -> DataFrame:
    return df.filter(F.col("week_key") < SPLIT_WEEK)


def new(df: DataFrame) -> DataFrame:
    return df.filter(F.col("week_key") >= SPLIT_WEEK)


def batch_and_target(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All creatives, written, and the keys of a target that was loaded with the old weeks; each once, as loading leaves it."""
    batch = staged(creatives(spark, sf), "batch")
    return batch, old(batch).select(*dedup.KEY).distinct()


def steps(df: DataFrame) -> DataFrame:
    """Forecast lists as rows."""
    return df.select("brand", "channel", F.posexplode("forecast").alias("pos", "value")).select(
        "brand", "channel", (F.col("pos") + 1).cast("bigint").alias("step"), "value"
    )


# ---- sources and sinks ----------------------------------------------------------------


@query
def load_creatives(spark, sf):
    lacking = documents(spark, sf).drop("brand_display", "currency")
    json = lacking.select(F.to_json(F.struct(*lacking.columns)).alias("doc"))
    return shown(docs.parse_documents(json, "doc"))


@query
def scan_all(spark, sf):
    path = shared_dir(spark, "landing")
    documents(spark, sf).write.json(path, compression="gzip")
    return shown(docs.scan_all(spark, path))


def cut_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as JSON lines, of which some were cut off and some have a word for a number."""
    d = documents(spark, sf)
    n = F.col("impression_lower")
    line = F.to_json(F.struct(*d.columns))
    odd = F.regexp_replace(line, '"impression_lower":[0-9]+', '"impression_lower":"many"')
    return d.select(F.when(n % 7000 == 0, F.substring(line, 1, 60)).when(n % 11000 == 0, odd).otherwise(line).alias("value"))


def told(good: DataFrame, bad: DataFrame) -> DataFrame:
    id_ = F.regexp_extract("text", '"source_id":"([^"]*)"', 1)
    return good.select("source_id", "impression_lower", F.lit("kept").alias("state")).unionByName(
        bad.select(id_.alias("source_id"), F.lit(None).cast("bigint").alias("impression_lower"), F.col("reason").alias("state"))
    )


@query
def quarantine(spark, sf):
    """Documents of a landing folder with unreadable lines, and the lines."""
    path = shared_dir(spark, "landing")
    cut_lines(spark, sf).write.text(path, compression="gzip")
    return told(*docs.scan_documents(spark, path))


@query
def quarantine_column(spark, sf):
    """The same of a column of JSON texts."""
    lines = staged(cut_lines(spark, sf), "lines")
    good = docs.parse_documents(lines, "value").filter("source_id is not null")
    return told(good, docs.unreadable_documents(lines, "value").withColumnRenamed("value", "text"))


@query
def brand_recent_creatives(spark, sf):
    return placed(shown(docs.brand_recent_creatives(creatives(spark, sf), BRAND, RECENT)))


@query
def normalise_ads(spark, sf):
    return shown(normalised(spark, sf))


def ad_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every ad twice, in a page of its own."""
    paging = F.struct(F.lit(None).cast("string").alias("next"))
    return ad_structs(spark, sf).select("brand", "page_index", F.array("ad", "ad").alias("data"), paging.alias("paging"))


def ads_of(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    return archive.explode_ad_pages(pages, max_pages).select(
        "brand", "page_index", F.col("ad.id").alias("id"), F.size("ad.publisher_platforms").cast("bigint").alias("n_platforms")
    )


@query
def explode_ad_pages(spark, sf):
    return ads_of(ad_pages(spark, sf))


@query
def explode_first_pages(spark, sf):
    return ads_of(ad_pages(spark, sf), 16)


@query
def read_pages(spark, sf):
    """Landed as packed JSON files, one envelope per line, and read back."""
    path = shared_dir(spark, "pages")
    ad_pages(spark, sf).write.json(path, compression="gzip")
    return ads_of(archive.read_pages(spark, path))


def landed_walks(spark: SparkSession, sf: str) -> DataFrame:
    """A page per order and a walk per segment and nation; some chains are broken, lead back, or were landed twice."""
    key = F.col("o_orderkey")
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    walk = F.concat_ws("/", F.lower("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("brand")
    along = Window.partitionBy("brand").orderBy("o_orderkey")
    def named(c):
        return F.concat(F.lit("c"), c.cast("string"))

    pages = orders.select(walk, "o_orderkey").select(
        "brand", "o_orderkey", F.when(F.lag(key).over(along).isNotNull(), named(key)).alias("cursor"),
        F.when(key % 997 == 0, F.concat(F.lit("lost-"), key.cast("string")))
        .when(key % 1499 == 0, named(F.lag(key, 3).over(along))).otherwise(named(F.lead(key).over(along))).alias("next"),
    )
    ads = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id")))).alias("data")
    )
    landed = pages.join(ads, key == F.col("l_orderkey"), "left")
    times = F.when(key % 251 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return landed.select("brand", "cursor", F.struct("next").alias("paging"), "data", F.explode(times).alias("time")).drop("time")


@query
def walk_pages(spark, sf):
    """Pages in the order of their cursors, with what becomes of those off the walks."""
    ordered, _ = pagewalk.ordered_pages(landed_walks(spark, sf), F.col("paging.next"))
    return ordered.select(
        "brand", "cursor", "page_index", "state", F.coalesce(F.size("data"), F.lit(0)).cast("bigint").alias("n_ads")
    )


@query
def walk_report(spark, sf):
    return pagewalk.ordered_pages(landed_walks(spark, sf), F.col("paging.next"))[1]


@query
def explode_walked_pages(spark, sf):
    """The ads of each walk's first 16 pages."""
    ads = archive.explode_ad_pages(pagewalk.walked_pages(landed_walks(spark, sf), 16))
    return ads.select("brand", "page_index", F.col("ad.id").alias("id"))


@query
def relabel_search_source(spark, sf):
    out = docs.relabel_search_source(creatives(spark, sf))
    return out.select("source_id", "source", "channel", "platform", "week_key")


@query
def insert_only_upsert(spark, sf):
    return shown(dedup.new_rows(*batch_and_target(spark, sf)))


def with_keyless(spark: SparkSession, sf: str) -> DataFrame:
    """Creatives of which some lack an id, some a week, and some state absurd amounts."""
    n = F.col("impression_lower")
    return creatives(spark, sf).withColumns({
        "source_id": F.when(n % 9000 != 0, F.col("source_id")),
        "week_key": F.when(n % 5000 != 0, F.col("week_key")),
        "started_running": F.when(n % 25000 != 0, F.col("started_running")),
        "spend_upper": F.when(n % 11000 == 0, 1e300).otherwise(F.col("spend_upper")),
    })


@query
def insert_only_rerun(spark, sf):
    """The same documents, some without id, loaded twice."""
    path = shared_dir(spark, "raw")
    batch = staged(with_keyless(spark, sf).drop("week_key").withColumn("week_key", F.lit("2001-W01")))
    for _ in range(2):
        loads.insert_only(batch, path, written=True)
    return tables.read_table(spark, path, batch.schema).groupBy("source").agg(F.count("*").alias("stored"))


@query
def load_rejects(spark, sf):
    return tables.rejects(clean.clean_creatives(with_keyless(spark, sf))).groupBy("reason").agg(F.count("*").alias("n"))


@query
def week_key_derived(spark, sf):
    cleaned = clean.clean_creatives(with_keyless(spark, sf))
    return shown(cleaned.select("source_id", "source", "impression_lower", "week_key", "spend_upper", "spend_midpoint"))


@query
def bad_amounts(spark, sf):
    return clean.bad_amounts(with_keyless(spark, sf))


@query
def bad_dates(spark, sf):
    return clean.bad_dates(with_bad_dates(spark, sf))


@query
def upsert_counts(spark, sf):
    return dedup.upsert_counts(*batch_and_target(spark, sf))


@query
def upsert_counts_by_brand(spark, sf):
    return dedup.upsert_counts(*batch_and_target(spark, sf), ["brand"])


@query
def new_docs_since(spark, sf):
    events = table(spark, sf, "events")
    log, mark = shared_dir(spark, "new-docs"), shared_dir(spark, "new-docs-mark")
    for _ in range(2):  # the second run finds nothing new
        stream = feeds.landed(spark, LANDED.format(sf, "events"), events.schema)
        feeds.new_docs_since(stream, log, mark).awaitTermination()
    return spark.read.parquet(log).agg(F.sum("new_docs").alias("new_docs"))


@query
def append_raw(spark, sf):
    c = staged(creatives(spark, sf))
    path = shared_dir(spark, "raw")
    tables.append_rows(old(c), path)
    tables.append_rows(new(c), path)
    return shown(tables.read_table(spark, path, c.schema))


@query
def overwrite_partitions(spark, sf):
    s = signals(spark, sf)
    path = shared_dir(spark, "signals")
    tables.overwrite_weeks(s, path)
    some = tables.read_table(spark, path, s.schema).filter(F.col("week_key").between("1998-W10", "1998-W20"))
    tables.overwrite_weeks(some.withColumn("ad_count", F.col("ad_count") + 1000), path)
    return rounded(tables.read_table(spark, path, s.schema))


@query
def overwrite_or_append(spark, sf):
    s = staged(signals(spark, sf).select("brand", "week_key", "channel", "region", "ad_count", "spend_midpoint"))
    path = shared_dir(spark, "signals")
    for mode in ("append", "overwrite", "append"):
        tables.overwrite_or_append(s, path, mode)
    return tables.read_table(spark, path, s.schema)


@query
def conform(spark, sf):
    s = signals(spark, sf)
    odd = s.select(F.col("ad_count").cast("string").alias("ad_count"), *reversed([c for c in s.columns if c != "ad_count"]))
    return rounded(shown(schemas.conform(odd, schemas.WEEKLY_SIGNALS)))


@query
def create_table(spark, sf):
    path = shared_dir(spark, "catalog")
    name = f"signals_{path[-32:]}"
    facts = schemas.conform(full_signals(spark, sf), schemas.WEEKLY_SIGNALS)
    tables.append_rows(facts, path)
    tables.create_table(spark, name, schemas.WEEKLY_SIGNALS, path, by="year")
    spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return spark.table(name).groupBy("brand", "yr").agg(F.count("*").alias("n"), F.sum("ad_count").alias("ads"))


def committed(spark: SparkSession, sf: str) -> str:
    """Two snapshots of the fact table: the old weeks, then the rest appended."""
    s = staged(signals(spark, sf))
    root = shared_dir(spark, "snapshots")
    snapshots.commit(old(s), root, "overwrite", COMMITS[0])
    snapshots.commit(new(s), root, "append", COMMITS[1])
    return root


@query
def list_snapshots(spark, sf):
    return placed(snapshots.list_snapshots(spark, committed(spark, sf), "brand_weekly_signals"))


@query
def read_as_of(spark, sf):
    root = committed(spark, sf)
    first = snapshots.snapshot_at(spark, root, COMMITS[0])
    return rounded(snapshots.read_as_of(spark, root, first).select(*signals(spark, sf).columns))


@query
def snapshot_diff(spark, sf):
    root = committed(spark, sf)
    out = snapshots.snapshot_diff(snapshots.read_as_of(spark, root, 1), snapshots.read_as_of(spark, root, 2))
    return out.withColumns({"delta": F.round("delta", 4), "pct": F.round("pct", 2)})


@query
def snapshot_full_outer(spark, sf):
    root = committed(spark, sf)
    return snapshots.snapshot_full_outer(snapshots.read_as_of(spark, root, 1), snapshots.read_as_of(spark, root, 2))


@query
def snapshot_changes(spark, sf):
    """What three commits changed: new weeks appended, a brand's weeks replaced, and a compaction in between."""
    s = staged(signals(spark, sf))
    root = shared_dir(spark, "snapshots")
    snapshots.commit(old(s), root, "overwrite", COMMITS[0])
    snapshots.commit(new(s), root, "append", COMMITS[1])
    snapshots.compact(spark, root, COMMITS[1])
    some = s.filter((F.col("brand") == BRAND) & F.col("week_key").between("1997-W10", "1997-W20"))
    some = some.filter(F.col("channel") != "ctv").withColumn("spend_midpoint", F.col("spend_midpoint") + 100)
    snapshots.commit(some, root, "replace", COMMITS[1])
    return snapshots.changes(spark, root, 1, 4)


@query
def scan_text_files(spark, sf):
    path = shared_dir(spark, "tree")
    textfiles.write_texts(smuggled(spark, sf), path, "doc_id", "text")
    hits = textfiles.scan_text_files(spark, path)
    return hits.withColumn("doc_id", F.regexp_extract("file", "doc_id=([0-9]+)", 1).cast("bigint")).drop("file")


# ---- projections and filters ----------------------------------------------------------


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("channel_share", F.round("channel_share", 6))


def with_bad_dates(spark: SparkSession, sf: str) -> DataFrame:
    bad = F.col("impression_lower") % 7000 == 0
    return documents(spark, sf).withColumns({
        "started_running": F.when(bad, "garbage").otherwise(F.col("started_running")),
        "ingested_at": F.when(bad, "").otherwise(F.col("ingested_at")),
    })


@query
def cast_dates(spark, sf):
    return shown(clean.cast_dates(with_bad_dates(spark, sf)).select("source_id", "source", "started_running", "stopped_running", "ingested_at"))


def with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Creatives with a missing lower bound, region or platform on some rows."""
    c = creatives(spark, sf)
    return c.withColumns({
        "spend_lower": F.when(F.col("impression_lower") % 7000 != 0, F.col("spend_lower")),
        "region": F.when(F.col("region") != "ASIA", F.col("region")),
        "platform": F.when(F.col("platform") != "Brand#13", F.col("platform")),
    })


@query
def spend_midpoint(spark, sf):
    return clean.add_spend_midpoint(with_gaps(spark, sf)).select("source_id", "source", "spend_lower", "spend_upper", "spend_midpoint")


@query
def clean_nulls(spark, sf):
    return clean.clean_nulls(with_gaps(spark, sf)).select(
        "source_id", "source", "cta", "region", "platform", "spend_lower", "spend_upper", "impression_lower"
    )


@query
def brand_slug(spark, sf):
    return table(spark, sf, "part").select("p_partkey", labels.brand_slug(F.initcap("p_name")).alias("slug"))


@query
def filter_brand_channels(spark, sf):
    return rounded(clean.filter_brand_channels(signals(spark, sf), BRAND, CHANNELS))


@query
def min_history_guard(spark, sf):
    return trend.history_guard(signals(spark, sf))


@query
def signal_projection(spark, sf):
    return rounded(report.signal_projection(signals(spark, sf)))


@query
def fill_features(spark, sf):
    s = signals(spark, sf).withColumn("channel_share", F.when(F.col("week_key") >= SPLIT_WEEK, F.col("channel_share")))
    return rounded(anomaly.fill_features(anomaly.brand_weekly_features(s)))


# ---- joins ----------------------------------------------------------------------------


@query
def recent_weeks_semi(spark, sf):
    return rounded(trend.recent_weeks(signals(spark, sf), 4))


@query
def anti_existing(spark, sf):
    return dedup.new_keys(*batch_and_target(spark, sf))


@query
def attach_total(spark, sf):
    out = weekly.attach_total(signals(spark, sf)).select(*weekly.GRAIN, "spend_midpoint", "brand_week_spend", "channel_share", "channel_share_total")
    return rounded(out.withColumn("channel_share_total", F.round("channel_share_total", 6)))


@query
def anomaly_flag_join(spark, sf):
    s = staged(signals(spark, sf))
    return rounded(anomaly.anomaly_flag_join(s, anomaly.robust_anomaly(s)))


def checked_summary(spark: SparkSession, sf: str, **options) -> DataFrame:
    return summary.signal_summary(staged(full_signals(spark, sf)), forecaster="linear", detector="robust", **options)


def asked_brands(spark: SparkSession, sf: str) -> DataFrame:
    """Every brand, and one that has no rows."""
    nobody = spark.createDataFrame([("nobody",)], "brand string")
    return table(spark, sf, "customer").select(F.lower("c_mktsegment").alias("brand")).unionAll(nobody)


@query
def summary_assemble(spark, sf):
    return assembled(checked_summary(spark, sf, brands=asked_brands(spark, sf)))


@query
def summary_filtered(spark, sf):
    return assembled(checked_summary(spark, sf, channels=CHANNELS, brands=asked_brands(spark, sf)))


def assembled(s: DataFrame) -> DataFrame:
    return s.select(
        "brand", "status", "dominant_trend", "n_anomalies", "weeks_analysed",
        F.size("channel_forecasts").cast("bigint").alias("n_channels"),
        F.array_join("top_themes", "|").alias("top_themes"),
    )


# ---- aggregations ---------------------------------------------------------------------


@query
def weekly_signals(spark, sf):
    return rounded(shown(full_signals(spark, sf)))


@query
def top_ctas(spark, sf):
    return weekly.top_ctas(creatives(spark, sf))


@query
def top_themes(spark, sf):
    return weekly.top_themes(creatives(spark, sf))


@query
def active_count(spark, sf):
    return weekly.active_count(creatives(spark, sf))


@query
def brand_weekly_features(spark, sf):
    return rounded(anomaly.brand_weekly_features(signals(spark, sf)))


@query
def channel_mix(spark, sf):
    return report.channel_mix(signals(spark, sf))


@query
def weekly_totals(spark, sf):
    return report.weekly_totals(signals(spark, sf))


@query
def brand_top_themes(spark, sf):
    return report.brand_listed_themes(weekly.listed_themes(creatives(spark, sf)))


@query
def dominant_trend(spark, sf):
    return report.dominant_trend(signals(spark, sf))


@query
def kpis(spark, sf):
    return report.kpis(signals(spark, sf), asked_brands(spark, sf))


@query
def kpis_filtered(spark, sf):
    return report.kpis(clean.filter_brand_channels(signals(spark, sf), channels=CHANNELS), asked_brands(spark, sf))


@query
def weeks_analysed(spark, sf):
    return report.weeks_analysed(signals(spark, sf))


@query
def trend_series(spark, sf):
    return report.trend_series(signals(spark, sf))


@query
def trend_wide(spark, sf):
    return report.trend_wide(signals(spark, sf), sorted(CHANNEL.values()))


@query
def fill_weeks(spark, sf):
    """On a series that lacks every third week."""
    some = signals(spark, sf).filter(F.substring("week_key", 7, 2).cast("int") % 3 != 0)
    return trend.fill_weeks(some)


@query
def sorted_dims(spark, sf):
    return placed(report.sorted_dims(signals(spark, sf)))


@query
def load_counts(spark, sf):
    counts = weekly_run(docs.load_creatives(documents(spark, sf)), shared_dir(spark, "raw"), shared_dir(spark, "signals"))
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{k} bigint" for k in counts))


@query
def snapshot_run(spark, sf):
    """Two runs, the second over later documents; the newest state of the history they leave."""
    raw, facts, history = (shared_dir(spark, n) for n in ("raw", "signals", "history"))
    every = staged(creatives(spark, sf))
    for part, at in ((old(every), COMMITS[0]), (every, COMMITS[1])):
        weekly_run(part, raw, facts, snapshots=history, committed_at=at)
    return rounded(shown(snapshots.read_as_of(spark, history)))


# ---- windows --------------------------------------------------------------------------


@query
def channel_share(spark, sf):
    return rounded(signals(spark, sf).select(*weekly.GRAIN, "spend_midpoint", "channel_share"))


@query
def trend_pct(spark, sf):
    return trend.trend(signals(spark, sf)).select("brand", "channel", "n_weeks", "trend_pct_change")


@query
def trend_direction(spark, sf):
    return trend.trend(signals(spark, sf)).select("brand", "channel", "trend_direction")


@query
def weekly_actuals(spark, sf):
    t = trend.trend(signals(spark, sf))
    return t.select("brand", "channel", F.explode(F.arrays_zip("weekly_dates", "weekly_actuals")).alias("e")).select(
        "brand", "channel", F.col("e.weekly_dates").alias("week_key"), F.col("e.weekly_actuals").alias("spend")
    )


@query
def wow_delta(spark, sf):
    out = report.wow_delta(signals(spark, sf))
    return out.withColumns({c: F.round(c, 4) for c in ("spend_pct", "ads_pct")})


@query
def recent_n(spark, sf):
    return trend.week_ranks(signals(spark, sf)).filter(F.col("recency") <= 12).withColumn("recency", F.col("recency").cast("bigint"))


@query
def last_anomalies(spark, sf):
    return anomaly.last_anomalies(anomaly.robust_anomaly(signals(spark, sf)))


@query
def dedup_first(spark, sf):
    return shown(dedup.first_per_key(creatives(spark, sf)))


# ---- sort, limit, top-k, sets ---------------------------------------------------------


@query
def signals_query(spark, sf):
    return placed(rounded(report.signals_query(signals(spark, sf), BRAND)))


@query
def top_n_per_key(spark, sf):
    themes = creatives(spark, sf).select("brand", "channel", F.explode("creative_themes").alias("theme"))
    return weekly.top_n_per_key(themes, ["brand", "channel"], "theme", 3)


@query
def mix_desc(spark, sf):
    return report.mix_desc(signals(spark, sf))


@query
def tail_weeks(spark, sf):
    return placed(report.tail_weeks(signals(spark, sf), BRAND))


@query
def union_sources(spark, sf):
    c = creatives(spark, sf)
    parts = [
        c.filter(F.col("source") == "meta").drop("platform"),
        c.filter(F.col("source") == "google").drop("currency"),
        c.filter(F.col("source") == "synthetic"),
    ]
    every = dedup.union_sources(*parts).select(*c.columns)
    return dedup.first_per_key(every).select("source_id", "source", "platform", "currency", "week_key")


# ---- scalar functions -----------------------------------------------------------------


def order_days(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))


@query
def iso_week_key(spark, sf):
    return order_days(spark, sf).select("o_orderkey", calendar.iso_week_key(F.col("d")).alias("week_key"))


@query
def week_key_to_monday(spark, sf):
    key = calendar.iso_week_key(F.col("d"))
    return order_days(spark, sf).select("o_orderkey", day_text(calendar.week_monday(key)).alias("monday"))


@query
def monday_to_key(spark, sf):
    days = trend.week_days(signals(spark, sf))
    return days.select("week_key", day_text(F.col("monday")).alias("monday"), calendar.iso_week_key(F.col("monday")).alias("key_of_monday"))


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    return archive.parse_ads(ads(spark, sf), "json")


@query
def channel_of_platform(spark, sf):
    p = labels.first_platform(F.col("ad.publisher_platforms"))
    return parsed(spark, sf).select(F.col("ad.id").alias("id"), p.alias("platform"), labels.channel_of_platform(p).alias("channel"))


@query
def safe_date_prefix(spark, sf):
    d = calendar.lenient_date(F.col("ad.ad_delivery_start_time"))
    return parsed(spark, sf).select(F.col("ad.id").alias("id"), day_text(F.coalesce(d, F.lit(AS_OF).cast("date"))).alias("started"))


@query
def range_bounds(spark, sf):
    return parsed(spark, sf).select(
        F.col("ad.id").alias("id"),
        numbers.long_or_zero(F.col("ad.impressions.lower_bound")).alias("impression_lower"),
        numbers.long_or_zero(F.col("ad.impressions.upper_bound")).alias("impression_upper"),
        numbers.double_or_zero(F.col("ad.spend.lower_bound")).alias("spend_lower"),
        numbers.double_or_zero(F.col("ad.spend.upper_bound")).alias("spend_upper"),
    )


@query
def is_active(spark, sf):
    return normalised(spark, sf).groupBy("brand", "is_active").agg(F.count("*").alias("n"))


@query
def title_case(spark, sf):
    name = F.replace(F.upper("p_name"), F.lit(" "), F.lit("-"))
    return table(spark, sf, "part").select("p_partkey", labels.title_case(F.concat(name, F.lit(" & co"))).alias("display"))


@query
def sanitize_text(spark, sf):
    return smuggled(spark, sf).select("doc_id", text.sanitize(F.col("text")).alias("text"))


@query
def has_invisible(spark, sf):
    return smuggled(spark, sf).select("doc_id", text.has_invisible(F.col("text")).alias("hit"))


@query
def scan_invisible(spark, sf):
    return text.scan_invisible(smuggled(spark, sf), "text", "doc_id")


@query
def money_format(spark, sf):
    pct = F.round((F.col("l_discount") - F.col("l_tax")) * 137, 2)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        numbers.dollars(F.col("l_extendedprice")).alias("money"), numbers.signed_pct(pct).alias("pct"),
    )


@query
def array_ops(spark, sf):
    lists = F.array(F.col("creative_themes"), F.array("cta"), F.col("creative_themes"))
    return creatives(spark, sf).select(
        "source_id", "source", "week_key",
        F.array_join(F.slice(F.array_distinct(F.flatten(lists)), 1, 3), "|").alias("values"),
    )


@query
def clamp_forecast(spark, sf):
    x = F.col("l_extendedprice") - 40000
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", numbers.clamp_round(x).alias("y"))


@query
def epoch_ms(spark, sf):
    ms = F.unix_micros(F.col("ts").cast("timestamp"))
    ms = (ms - ms % 1000) / 1000
    return table(spark, sf, "events").select(
        "event_id", F.date_format(calendar.from_epoch_ms(ms.cast("bigint")), "yyyy-MM-dd HH:mm:ss.SSS").alias("at")
    )


# ---- models ---------------------------------------------------------------------------


@query
def linear_forecast(spark, sf):
    out = trend.linear_forecast(signals(spark, sf))
    return out.select("brand", "channel", "trend_direction", "trend_pct_change", F.posexplode("forecast").alias("pos", "value")).select(
        "brand", "channel", "trend_direction", "trend_pct_change", (F.col("pos") + 1).cast("bigint").alias("step"), "value"
    )


@query
def trend_forecast(spark, sf):
    return steps(forecast.trend_forecast(staged(signals(spark, sf))))


@query
def trend_forecast_shape(spark, sf):
    """All of the fitted forecast that does not depend on fitted numbers."""
    out = forecast.trend_forecast(staged(signals(spark, sf)))
    return out.select(
        "brand", "channel", "n_weeks", "trend_direction", "trend_pct_change", "converged",
        F.size("forecast").cast("bigint").alias("n_steps"), F.forall("forecast", lambda v: v >= 0).alias("none_below_0"),
        F.array_join("weekly_dates", "|").alias("weeks"),
        F.array_join(F.transform("weekly_actuals", lambda v: F.round(v * 100).cast("bigint").cast("string")), "|").alias("cents"),
    )


@query
def isolation_counts(spark, sf):
    """Per brand: weeks scored, weeks flagged, and whether scores lie in their range."""
    return anomaly.isolation_scores(signals(spark, sf)).groupBy("brand").agg(
        F.count("score").alias("n_scored"), F.count_if("is_anomaly").alias("n_flagged"),
        F.bool_and((F.col("score") < 0) & (F.col("score") >= -1)).alias("in_range"),
    )


@query
def anomaly_result(spark, sf):
    out = anomaly.anomaly_result(anomaly.robust_anomaly(signals(spark, sf)))
    return out.select(
        "brand", F.array_join("anomaly_weeks", "|").alias("anomaly_weeks"), "n_anomalies",
        F.size("anomaly_scores").cast("bigint").alias("n_scores"), F.array_join("features_used", "|").alias("features_used"),
    )


@query
def ols_forecast(spark, sf):
    return steps(trend.ols_forecast(signals(spark, sf)))


@query
def forecast_all(spark, sf):
    out = summary.forecast_all(staged(signals(spark, sf)), [*CHANNEL.values(), "radio"], "linear")
    return out.select("brand", "channel", "n_weeks", "trend_direction", "trend_pct_change", F.size("forecast").cast("bigint").alias("n_steps"))


@query
def isolation_scores(spark, sf):
    return anomaly.isolation_scores(signals(spark, sf))


@query
def contamination_cut(spark, sf):
    scores = anomaly.robust_anomaly(signals(spark, sf)).withColumn("score", -F.col("score"))
    return anomaly.contamination_cut(scores).select("brand", "week_key", "is_anomaly")


@query
def robust_anomaly(spark, sf):
    return anomaly.robust_anomaly(signals(spark, sf)).drop("spend_midpoint")


def in_cents(totals: Column) -> Column:
    """Week totals as `week=cents` text."""
    return F.array_join(
        F.transform(F.array_sort(F.map_entries(totals)), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 100).cast("bigint").cast("string"))),
        "|",
    )


@query
def signal_summary(spark, sf):
    return checked_summary(spark, sf).select(
        "brand", "status", "dominant_trend", "n_anomalies", "weeks_analysed",
        brief.mix_text(F.col("channel_mix_pct")).alias("mix"),
        brief.trends_text(F.col("channel_forecasts")).alias("trends"),
        in_cents(F.col("weekly_deltas")).alias("totals"),
        F.array_join("anomaly_weeks", "|").alias("anomaly_weeks"),
        F.array_join("top_themes", "|").alias("top_themes"),
        F.array_join("recent_weeks", "|").alias("recent_weeks"),
    )


@query
def signal_summary_models(spark, sf):
    """With the fitted trend and the forest instead of their SQL forms."""
    s = summary.signal_summary(staged(full_signals(spark, sf)))
    return s.select(
        "brand", "status", "dominant_trend", "n_anomalies", "weeks_analysed",
        brief.trends_text(F.col("channel_forecasts")).alias("trends"),
        F.array_join("anomaly_weeks", "|").alias("anomaly_weeks"),
    )


@query
def signal_summary_models_shape(spark, sf):
    """The same without fitted numbers: with the fit's own trends, and the forest's counts."""
    s = summary.signal_summary(staged(full_signals(spark, sf)), brands=asked_brands(spark, sf))
    return s.select(
        "brand", "status", "dominant_trend", "n_anomalies", "weeks_analysed",
        brief.trends_text(F.col("channel_forecasts")).alias("trends"),
        F.size("anomaly_weeks").cast("bigint").alias("n_weeks_listed"),
    )


TASK = "On %s, in brief."


@query
def brief_context(spark, sf):
    return brief.brief_context(checked_summary(spark, sf), TASK).select("brand", "status", "context")


def stub_writer(prompt: str, role: str) -> str:
    """Stands in for a text service: repeats the task line; refuses one brand."""
    first = prompt.split("\n")[0]
    if "MACHINERY" in first:
        raise RuntimeError("refused")
    return f"  Brief: {first}\n"


@query
def generate_briefs(spark, sf):
    return brief.generate_briefs(brief.brief_context(checked_summary(spark, sf), TASK), stub_writer)


@query
def brief_response(spark, sf):
    s = staged(checked_summary(spark, sf), "summary")
    out = brief.brief_response(s, brief.generate_briefs(brief.brief_context(s, TASK), stub_writer))
    return shown(out)


@query
def saved_briefs(spark, sf):
    """Written once; a second call for the same snapshot asks no writer, so nothing fails."""
    s = staged(checked_summary(spark, sf), "summary")
    path = shared_dir(spark, "briefs")
    briefs_of_snapshot(s, path, 1, stub_writer, task=TASK, attempts=1)
    return shown(briefs_of_snapshot(s, path, 1, broken_writer, task=TASK))


def broken_writer(prompt: str, role: str) -> str:
    raise RuntimeError("not to be called")


# ---- streams --------------------------------------------------------------------------


def land(batches: list[DataFrame]) -> tuple[str, int]:
    """(folder, files a batch): the batches landed one after the other, so that a stream of that many files a batch takes them as they are.

    Tasks write the parts that they read: no batch passes one task, and its files grow in number with the table. A part
    without rows of a batch writes no file, so the batch gets an empty one instead.
    """
    spark = batches[0].sparkSession
    path = shared_dir(spark, "arrivals")
    n = max(1, *[b.rdd.getNumPartitions() for b in batches])
    for k, batch in enumerate(batches, 1):
        batch.write.mode("append").parquet(path)
        for _ in range(k * n - len(children(spark, path, "part-*"))):
            spark.createDataFrame([], batch.schema).coalesce(1).write.mode("append").parquet(path)
    return path, n


def arrivals(df: DataFrame, key: str, n: int = 4) -> tuple[str, int]:
    """The rows as `n` batches in an order that has nothing to do with their dates; a key's rows are in one."""
    return land([df.filter(F.pmod(F.xxhash64(key), F.lit(n)) == k) for k in range(n)])


def creative_stream(spark: SparkSession, sf: str, part: Column | None = None) -> DataFrame:
    """Order lines arriving in several micro-batches, shuffled; or the lines that `part` picks."""
    lines = table(spark, sf, "lineitem")
    path, files = arrivals(lines if part is None else lines.filter(part), "l_orderkey")
    return creatives(spark, sf, feeds.landed(spark, path, lines.schema, files))


@query
def stream_weekly_signals(spark, sf):
    path, mark = shared_dir(spark, "windows"), shared_dir(spark, "windows-mark")
    feeds.count_weeks(creative_stream(spark, sf), F.col("started_running"), path, mark).awaitTermination()
    return feeds.weekly_windows(spark, path).withColumn("monday", day_text(F.col("monday")))


@query
def stream_dedup(spark, sf):
    """Every event twice, in other micro-batches."""
    events = table(spark, sf, "events")
    path, mark = shared_dir(spark, "dedup"), shared_dir(spark, "dedup-mark")
    twice = events.unionAll(events).withColumn("_n", F.monotonically_increasing_id())
    path_in, files = arrivals(twice, "_n")
    stream = feeds.landed(spark, path_in, events.schema, files)
    once = feeds.stream_dedup(stream, keys=["event_id", "event_type"])
    feeds.to_changelog(once, path, mark, mode="append").awaitTermination()
    return spark.read.parquet(path).select("event_id", "event_type", "user_id", "value")


def in_order(batches: DataFrame, number: str) -> tuple[str, int]:
    """A batch per number, landed in that order (`land`)."""
    rows = staged(batches, "numbered")
    numbers = [k for (k,) in rows.select(number).distinct().orderBy(number).collect()]
    return land([rows.filter(F.col(number) == k).drop(number) for k in numbers])


# Days that an arrival slot spans, and how far behind the newest row a window or key is given up.
EVENT_SLOT, EVENT_DELAY = 5, 6
ORDER_SLOT, ORDER_DELAY = 800, 300


def resent_events(spark: SparkSession, sf: str) -> DataFrame:
    """Every event twice, in numbered batches: late ones, copies a batch later, and events sent again with a time 20 days on."""
    events = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    lag = F.when(F.col("event_id") % 10 == 1, 1).when(F.col("event_id") % 10 == 2, 3).otherwise(0)
    slot = F.floor((F.dayofmonth("ts") - 1) / EVENT_SLOT)
    first = events.select("event_id", "ts", F.lit(1).alias("time"), (slot + lag).alias("batch"))
    again = F.col("event_id") % 3 == 0
    second = events.select(
        "event_id", F.when(again, F.col("ts") + F.expr("INTERVAL 20 DAYS")).otherwise(F.col("ts")).alias("ts"), F.lit(2).alias("time"),
        F.when(again, slot + 4).otherwise(slot + lag + 1).alias("batch"),
    )
    return first.unionAll(second)


@query
def stream_dedup_within(spark, sf):
    """Ten micro-batches and a delay that bites: what passes, once or again, and what is lost as late."""
    path, mark = shared_dir(spark, "dedup"), shared_dir(spark, "dedup-mark")
    events = resent_events(spark, sf)
    path_in, files = in_order(events, "batch")
    stream = feeds.landed(spark, path_in, events.drop("batch").schema, files)
    once = feeds.stream_dedup(stream, "ts", f"{EVENT_DELAY} days", ["event_id"])
    feeds.to_changelog(once, path, mark, mode="append").awaitTermination()
    return spark.read.parquet(path).select("event_id", F.col("time").cast("bigint").alias("time"))


def late_creatives(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as a stream of some batches in the order of their dates, but for a fifth that comes one or three batches later."""
    lines = table(spark, sf, "lineitem")
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    lag = F.when(F.col("l_orderkey") % 10 == 1, 1).when(F.col("l_orderkey") % 10 == 2, 3).otherwise(0)
    numbered = lines.join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        *lines.columns, (F.floor(days / ORDER_SLOT) + lag).alias("batch")
    )
    path, files = in_order(numbered, "batch")
    return creatives(spark, sf, feeds.landed(spark, path, lines.schema, files))


@query
def stream_windows_closed(spark, sf):
    """Spark's own event-time windows: each given once, when the watermark has passed it, without the rows that came after."""
    path, mark = shared_dir(spark, "windows"), shared_dir(spark, "windows-mark")
    sums = feeds.stream_weekly_signals(late_creatives(spark, sf), F.col("started_running"), f"{ORDER_DELAY} days")
    feeds.to_changelog(sums, path, mark, mode="append").awaitTermination()
    return spark.read.parquet(path).drop("feed", "batch_id").withColumn("monday", day_text(F.col("monday")))


@query
def stream_windows_corrected(spark, sf):
    """Windows that close, and corrections for what came after: together every row, late ones counted."""
    path = shared_dir(spark, "weeks")
    feeds.close_weeks(late_creatives(spark, sf), F.col("started_running"), ORDER_DELAY, path, shared_dir(spark, "weeks-mark")).awaitTermination()
    return feeds.corrected_weeks(spark, path).withColumn("monday", day_text(F.col("monday")))


@query
def stream_upsert_sink(spark, sf):
    return upserted(spark, sf, [None])


@query
def stream_two_feeds(spark, sf):
    """Two feeds with checkpoints of their own into the same tables, one after the other."""
    odd = F.col("l_orderkey") % 2 == 1
    return upserted(spark, sf, [odd, ~odd])


def third(spark: SparkSession, sf: str, k: int) -> DataFrame:
    return creatives(spark, sf, table(spark, sf, "lineitem").filter(F.col("l_orderkey") % 3 == k))


def run_and_stream(spark: SparkSession, sf: str, first: str) -> DataFrame:
    """A run over a third of the documents and a stream of the rest in four batches, then a run over all, into one raw table."""
    raw, sink, mark = (shared_dir(spark, n) for n in ("raw", "signals", "sink-mark"))
    rest = creative_stream(spark, sf, F.col("l_orderkey") % 3 > 0)
    steps = [
        lambda: weekly_run(third(spark, sf, 0), raw, sink),
        lambda: feeds.upsert_to_tables(rest, raw, sink, mark).awaitTermination(),
    ]
    for step in steps if first == "run" else reversed(steps):
        step()
    weekly_run(creatives(spark, sf), raw, sink)
    return rounded(shown(tables.read_table(spark, sink, weekly.weekly_signals(creatives(spark, sf)).schema)))


@query
def run_then_stream(spark, sf):
    return run_and_stream(spark, sf, "run")


@query
def stream_then_run(spark, sf):
    return run_and_stream(spark, sf, "stream")


def upserted(spark: SparkSession, sf: str, parts: list) -> DataFrame:
    raw, sink = shared_dir(spark, "raw"), shared_dir(spark, "signals")
    for part in parts:
        feeds.upsert_to_tables(creative_stream(spark, sf, part), raw, sink, shared_dir(spark, "sink-mark")).awaitTermination()
    facts = tables.read_table(spark, sink, weekly.weekly_signals(creatives(spark, sf)).schema)
    return rounded(shown(facts))
