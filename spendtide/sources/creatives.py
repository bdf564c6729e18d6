"""Creative documents as a 20-column frame."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendtide.functions.labels import SEARCH_CHANNELS, brand_slug, search_platform
from spendtide.schemas import RAW_CREATIVES, conform
from spendtide.session import PACKED, shared_dir, staged


def nullable(schema: T.StructType) -> T.StructType:
    """Untrusted input may lack any field, whatever the target promises."""
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])


def scan_all(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Every document of a folder of JSON or Parquet files. No limit, no inference."""
    if fmt == "json":
        return spark.read.schema(nullable(RAW_CREATIVES)).json(path)
    return load_creatives(spark.read.format(fmt).load(path))


UNREADABLE = "_unreadable"


def scan_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, quarantine) of a folder of JSON lines, from one scan.

    A line that is no JSON object of these fields is no document: it is in the quarantine alone, with reason 'document'. One
    in which a value has another type is a document that lacks the value, and its text is in the quarantine too, with
    reason 'value'. Quarantine: file, text, reason. Both frames read a table that is written once, in parts by reason, so
    each reads its own part. Blank lines are nothing.
    """
    fields = nullable(RAW_CREATIVES)
    schema = T.StructType(list(fields.fields)).add(UNREADABLE, T.StringType())
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", UNREADABLE).json(path)
    rows = rows.withColumns({"file": F.col("_metadata.file_path"), "reason": _reason(fields.names, F.col(UNREADABLE))})
    at = shared_dir(spark, "scanned")
    rows.write.option("compression", PACKED).partitionBy("reason").parquet(at)
    written = spark.read.schema(rows.schema).parquet(at)
    bad = written.filter(F.col("reason") != "none")
    return written.filter(F.col("reason") != "document").select(*fields.names), bad.select("file", F.col(UNREADABLE).alias("text"), "reason")


def _reason(names: list[str], unreadable: Column) -> Column:
    found = F.coalesce(*[F.col(c).cast("string") for c in names])
    return F.when(unreadable.isNull(), "none").when(found.isNull(), "document").otherwise("value")


def load_creatives(df: DataFrame) -> DataFrame:
    """Any frame of documents -> the 20 columns in order; absent ones null, NaN null."""
    return conform(df, RAW_CREATIVES)


def parse_documents(df: DataFrame, json: str) -> DataFrame:
    """A column of JSON documents -> the 20 columns. What cannot be read is null; `unreadable_documents` has those texts."""
    doc = F.from_json(F.col(json), nullable(RAW_CREATIVES))
    return load_creatives(df.select(doc.alias("doc")).select("doc.*"))


def unreadable_documents(df: DataFrame, json: str) -> DataFrame:
    """The rows whose JSON `parse_documents` cannot read as a whole, with the reason: 'document' or 'value'."""
    fields = nullable(RAW_CREATIVES)
    schema = T.StructType(list(fields.fields)).add(UNREADABLE, T.StringType())
    doc = F.from_json(F.col(json), schema, {"columnNameOfCorruptRecord": UNREADABLE})
    found = F.coalesce(*[F.col(f"doc_.{c}").cast("string") for c in fields.names])
    bad = df.withColumn("doc_", doc).filter(F.col(f"doc_.{UNREADABLE}").isNotNull())
    return bad.withColumn("reason", F.when(found.isNull(), "document").otherwise("value")).drop("doc_")


def brand_recent_creatives(df: DataFrame, brand: str, limit: int) -> DataFrame:
    """The brand's `limit` newest documents, newest first, ties by id.

    A plain limit would send that many rows of every input split to one task. Here the brand's rows are written once,
    their times alone are counted, a day at a time, to find the day that the limit ends in, and rows of older
    days are dropped where they are read. Only the rest is sorted.
    """
    first = ("ingested_at", "source_id", "source")
    order = [F.desc_nulls_last("ingested_at"), F.asc("source_id"), F.asc("source")]
    order += [F.asc(c) for c in df.columns if c not in first]
    mine = staged(df.filter(F.col("brand") == brand_slug(F.lit(brand))), "brand")
    day = F.substring(F.col("ingested_at").cast("string"), 1, 10)
    days = mine.groupBy(day.alias("_day")).agg(F.count("*").alias("n"))
    later = Window.orderBy(F.desc_nulls_last("_day")).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(later), F.lit(0))
    wanted = days.withColumn("before", before).filter(F.col("before") < limit).select(F.col("_day").alias("_wanted"))
    return mine.withColumn("_day", day).join(
        wanted, F.col("_day").eqNullSafe(F.col("_wanted")), "left_semi"
    ).drop("_day").orderBy(*order).limit(limit)


def relabel_search_source(df: DataFrame, platform: Column | None = None) -> DataFrame:
    """Rows of search-bought channels get that source and one of its platforms."""
    bought = F.col("channel").isin(SEARCH_CHANNELS)
    label = search_platform(F.col("source_id")) if platform is None else platform
    return df.withColumns({
        "platform": F.when(bought, label).otherwise(F.col("platform")),
        "source": F.when(bought, "google").otherwise(F.col("source")),
    })
