"""What several operators of this package share."""

import threading
from collections.abc import Callable
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendtide import session

# White space between words, and the words' pattern.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# While a stage is written: shuffle files go when it is done, and Python gets batches of so many texts.
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_running = threading.local()


def scratch(operator: Callable) -> Callable:
    """Deletes the tables that the operator has staged, when it returns, but for those it keeps.

    Its result may read kept tables only. Within another such operator those go when that one returns.
    """
    @wraps(operator)
    def run(*args, **options):
        scopes = _running.__dict__.setdefault("scopes", [])
        scopes.append(([], []))
        try:
            return operator(*args, **options)
        finally:
            temporary, kept = scopes.pop()
            if scopes:
                scopes[-1][0].extend(kept)
            for fs, path in temporary:
                fs.delete(path, True)

    return run


def shared_folder(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new folder that every executor reaches; it goes as `scratch` says."""
    at = session.shared_dir(spark, name)
    if scopes := getattr(_running, "scopes", []):
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        scopes[-1][keep].append((path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path))
    return at


def staged(df: DataFrame, name: str = "llm", keep: bool = False) -> DataFrame:
    """Written once in the shared folder and read back, so a lost executor loses nothing of it."""
    spark = df.sparkSession
    at = shared_folder(spark, name, keep)
    with _while_writing(spark):
        df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


_lock, _writers, _before = threading.Lock(), 0, {}


@contextmanager
def _while_writing(spark: SparkSession):
    """The settings of WRITING while anybody writes; the last of several threads restores what the first has found."""
    global _writers
    with _lock:
        if not _writers:
            _before.update({k: spark.conf.get(k) for k in WRITING})
            for k, v in WRITING.items():
                spark.conf.set(k, v)
        _writers += 1
    try:
        yield
    finally:
        with _lock:
            _writers -= 1
            if not _writers:
                for k, v in _before.items():
                    spark.conf.set(k, v)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once per row, also where a lambda reads it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), GAP), "")


def has_word(c: Column) -> Column:
    return F.translate(c, SPACES, "") != ""


def running_total(rows: DataFrame, group: str, order: list[str], value: Column, name: str) -> DataFrame:
    """`rows` with the sum of `value` over the rows before, by `order` within the group.

    Rows are dealt out by ranges of (group, `order`); ranges are summed apart and shifted by the
    totals before them, so a group is never in one task.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn("value_", value.cast("bigint")).repartitionByRange(parts, group, *order)
    ranged = staged(ranged.withColumn("range_", F.spark_partition_id()), "ranges", keep=True)
    totals = ranged.groupBy(group, "range_").agg(F.sum("value_").alias("total_"))
    def before(w):
        return w.rowsBetween(Window.unboundedPreceding, -1)

    over = before(Window.partitionBy(group).orderBy("range_"))
    shifts = staged(totals.select(group, "range_", F.coalesce(F.sum("total_").over(over), F.lit(0)).alias("shift_")), "shifts", keep=True)
    own = F.coalesce(F.sum("value_").over(before(Window.partitionBy(group, "range_").orderBy(*order))), F.lit(0))
    out = ranged.withColumn("own_", own).join(shifts, [group, "range_"])
    return out.withColumn(name, F.col("shift_") + F.col("own_")).drop("range_", "shift_", "own_", "value_")


def carried(docs: DataFrame, **needed: Column) -> DataFrame:
    """Each row as one value `row_`, beside the columns an operator works on, so that no name can clash."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row_"), *[v.alias(k) for k, v in needed.items()])


def restored(df: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of `docs` again, some of them with new values."""
    return df.select(*[new.get(c, F.col(f"row_.`{c}`")).alias(c) for c in docs.columns])
