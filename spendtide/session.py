"""Session settings, shipping the package to workers, and written intermediate tables."""

import functools
import os
import tempfile
import threading
import uuid
import zipfile
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))


def build_session(app: str = "spendtide", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the engine relies on.

    The number of shuffle partitions is left to adaptive execution unless given.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        b = b.master(master)
    for key, value in conf.items():
        b = b.config(key.replace("__", "."), value)
    spark = b.getOrCreate()
    ship(spark)
    return spark


@functools.cache
def _shipped(application: str) -> str:
    """An archive of the package's sources, made once per application."""
    path = os.path.join(tempfile.mkdtemp(prefix="spendtide-"), "spendtide.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
    return path


def ship(spark: SparkSession) -> None:
    """Give workers the package, so that Python steps run where it is not installed.

    Spark hands the archive from the driver to every executor. Calling it again does nothing.
    """
    path = _shipped(spark.sparkContext.applicationId)
    if not any(f.endswith(os.path.basename(path)) for f in spark.sparkContext.listFiles):
        spark.sparkContext.addPyFile(path)


@functools.cache
def _local_root(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"{application}-")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder every executor can reach, below `spark.checkpoint.dir`.

    Only a local session, one process, may do without that setting: it gets a scratch folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = _local_root(spark.sparkContext.applicationId)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


_made: dict[str, list[str]] = {}


def release(spark: SparkSession) -> int:
    """Delete every folder that this application has taken from `shared_dir`, when its results are no longer needed.

    What a query returns may read written tables, which live until then. Returns how many folders there were.
    """
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        remove(spark, path)
    return len(paths)


#: Packing of written tables: a third less on disk than the default.
PACKED = "zstd"


#: Removes the shuffle files of a query when it ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_writers: dict[str, list] = {}


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Shuffle files of what runs in here go when it is done.

    Else they stay until the driver happens to collect its garbage, and a run of many steps holds the files of all of them.
    The last of several threads restores what the first has found.
    """
    session = spark._jsparkSession.sessionUUID()
    with _lock:
        state = _writers.setdefault(session, [0, spark.conf.get(FREED, None)])
        state[0] += 1
        spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        with _lock:
            state[0] -= 1
            if not state[0]:
                del _writers[session]
                spark.conf.unset(FREED) if state[1] is None else spark.conf.set(FREED, state[1])


def _write(df: DataFrame, path: str, by: str | None) -> DataFrame:
    writer = df.write.option("compression", PACKED)
    with shuffles_freed(df.sparkSession):
        (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(df: DataFrame, name: str = "stage", by: str | None = None) -> DataFrame:
    """Write once, read back; in parts by the column `by`, if that is named.

    For a table that several branches of one plan use: the work above it runs
    once, a lost executor loses nothing, and every reader prunes columns. The
    size of the files, or of the parts that are read, also gives the planner a checked size for its joins.
    """
    return _write(df, shared_dir(df.sparkSession, name), by)


class Stages:
    """Staged tables that go when their work is committed. Shuffle files go with each step of it.

        with Stages(spark) as stages:
            batch = stages.write(df, "batch")
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.freed = spark, [], shuffles_freed(spark)

    def write(self, df: DataFrame, name: str = "stage", by: str | None = None) -> DataFrame:
        path = shared_dir(self.spark, name)
        self.paths.append(path)
        return _write(df, path, by)

    def __enter__(self) -> "Stages":
        self.freed.__enter__()
        return self

    def __exit__(self, *error) -> None:
        self.freed.__exit__(*error)
        for path in self.paths:
            remove(self.spark, path)


def _file(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store holds it."""
    fs, at = _file(spark, path)
    fs.delete(at, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file(spark, path)
    return fs.exists(at)


def open_store(root: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path, for tasks that read or write single files, and the path in it."""
    if "://" in root or root.startswith("file:"):
        return pafs.FileSystem.from_uri(root)
    return pafs.LocalFileSystem(), root


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Give a folder another name; the folders above it are made. The store decides whether that is one step."""
    fs, at = _file(spark, old)
    to = spark._jvm.org.apache.hadoop.fs.Path(new)
    fs.mkdirs(to.getParent())
    if not fs.rename(at, to):
        raise OSError(f"cannot rename {old} to {new}")


def touch(spark: SparkSession, path: str) -> None:
    """An empty file."""
    fs, at = _file(spark, path)
    fs.create(at, True).close()


def children(spark: SparkSession, path: str, *patterns: str) -> list[list[str]]:
    """Names below a folder, level by level as the patterns ask; none where there is no such folder."""
    fs, at = _file(spark, "/".join([path, *patterns]))
    found = fs.globStatus(at)
    return [str(f.getPath().toString()).rsplit("/", len(patterns))[1:] for f in (found or [])]


def task_count(spark: SparkSession) -> int:
    """Tasks for a step whose cost is time per row, not bytes.

    Adaptive execution merges partitions by size, which would leave such a step with
    few tasks; a stated number is kept.
    """
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
