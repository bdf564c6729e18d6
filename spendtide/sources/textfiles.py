"""Scan a tree of text files for invisible code points.

Spark's own file sources skip names that begin with `_` or `.`, which would hide
such files from a safety scan. So tasks list the tree, one level at a time, and the files are then
dealt over the cluster by path and read there, in parts. Neither names nor contents pass
through the driver.
"""

import itertools
import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendtide.functions.text import INVISIBLE
from spendtide.session import Stages, open_store, staged, task_count

# File extensions to scan and folders to leave out.
TEXT_EXTENSIONS = [
    ".py", ".md", ".mdx", ".txt", ".json", ".toml", ".yml", ".yaml",
    ".sh", ".bash", ".zsh", ".cfg", ".ini", ".js", ".ts",
]
IGNORED_DIRS = [
    ".git", ".venv", "venv", "node_modules", "__pycache__", ".web", ".states",
    ".mypy_cache", ".pytest_cache", ".ruff_cache", "dist", ".dagster", "assets",
]

#: Bytes read at a time.
PART = 1 << 20

#: Folders that `write_texts` deals its files to.
FOLDERS = 512

ENTRY = "path string, kind string, error string"
HIT = "file string, line bigint, col bigint, code_point string, error string"


def _wanted(path: str) -> bool:
    return os.path.splitext(path)[1].lower() in TEXT_EXTENSIONS


def _lister(root: str):
    """A row per entry of each folder: kind dir, file, or error where it could not be listed."""
    def entries(fs: pafs.FileSystem, folder: str) -> Iterator[tuple]:
        local = isinstance(fs, pafs.LocalFileSystem)
        try:
            found = fs.get_file_info(pafs.FileSelector(folder))
        except OSError as e:
            yield folder, "error", str(e)[:500]
            return
        for i in found:
            is_dir = i.type == pafs.FileType.Directory
            # A folder that is a link would be walked again, or for ever.
            if is_dir and i.base_name not in IGNORED_DIRS and not (local and os.path.islink(i.path)):
                yield i.path, "dir", None
            elif not is_dir and _wanted(i.path):
                yield i.path, "file", None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = open_store(root)
        rows = (row for b in batches for folder in b["path"] for row in entries(fs, folder))
        yield from _frames(rows, ["path", "kind", "error"])

    return run


def _frames(rows: Iterator[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of many rows: one per file or folder would cost more than its scan."""
    while some := list(itertools.islice(rows, 10_000)):
        yield pd.DataFrame(some, columns=names)


def _scanner(root: str, found: str):
    """Hits of each file, read in parts; a file that cannot be read or decoded gives an error row."""
    import codecs
    import re

    pattern = re.compile(found)

    def hits(fs: pafs.FileSystem, path: str, name: str) -> Iterator[tuple]:
        line, col, after_cr = 1, 0, False
        try:
            decode = codecs.getincrementaldecoder("utf-8")()
            with fs.open_input_stream(path) as f:
                while True:
                    data = f.read(PART)
                    text = decode.decode(data, final=not data)
                    if after_cr and text:
                        text, after_cr = text.removeprefix("\n"), False
                    after_cr = after_cr or text.endswith("\r")
                    # An editor ends a line at CR, LF or both.
                    parts = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
                    for k, part in enumerate(parts):
                        if k:
                            line, col = line + 1, 0
                        for m in pattern.finditer(part):
                            yield name, line, col + m.start() + 1, f"U+{ord(m[0]):04X}", None
                        col += len(part)
                    if not data:
                        break
        except (OSError, UnicodeDecodeError) as e:
            yield name, None, None, None, f"{type(e).__name__}: {e}"[:500]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = open_store(root)
        base = base.rstrip("/")
        rows = (row for b in batches for path in b["path"] for row in hits(fs, path, os.path.relpath(path, base)))
        yield from _frames(rows, ["file", "line", "col", "code_point", "error"])

    return run


def write_texts(texts: DataFrame, root: str, key: str, text: str) -> None:
    """A tree of text files, `<folder>/<key>=<value>-<task>.txt`: one per value and task, a line end behind every text.

    A table partitioned by the key would be a folder per value, all of them committed by the driver one by one.
    Here tasks write the files where they belong, below FOLDERS folders; a task that runs again replaces its own.
    """
    rows = texts.select(
        F.pmod(F.xxhash64(key), F.lit(FOLDERS)).alias("folder"), F.col(key).cast("string").alias("value"),
        F.col(text).cast("binary").alias("text"), F.spark_partition_id().alias("task"),
    )
    rows.sortWithinPartitions("folder", "value").mapInArrow(_writer(root, key), "files bigint").write.format("noop").mode("overwrite").save()


def _writer(root: str, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_store(root)
        fs.create_dir(base, recursive=True)
        rows = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns]))
        last, n = None, 0
        for (folder, value, task), same in itertools.groupby(rows, key=lambda r: (r[0], r[1], r[3])):
            at = f"{base.rstrip('/')}/{folder}"
            if folder != last:
                fs.create_dir(at)
                last = folder
            with fs.open_output_stream(f"{at}/{key}={value}-{task}.txt") as f:
                for row in same:
                    f.write((row[2] or b"") + b"\n")
            n += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})

    return run


def text_paths(spark: SparkSession, root: str, stages: Stages | None = None) -> DataFrame:
    """(path, kind, error): every file to scan, and every folder that could not be listed.

    One job per level of folders, each folder listed by some task. Links to folders are not followed.
    """
    write = stages.write if stages else staged
    _, base = open_store(root)
    n = task_count(spark)
    folders = spark.createDataFrame([(base.rstrip("/"),)], "path string")
    out = None
    while True:
        level = write(folders.repartition(n, "path").mapInPandas(_lister(root), ENTRY), "listing")
        leaves = level.filter("kind <> 'dir'")
        out = leaves if out is None else out.unionByName(leaves)
        folders = level.filter("kind = 'dir'").select("path")
        if folders.isEmpty():
            return out


def scan_all_text(spark: SparkSession, root: str) -> DataFrame:
    """file, line, col, code_point, error: hits, and one row with `error` for what could not be read."""
    paths = text_paths(spark, root)
    base = open_store(root)[1].rstrip("/")
    failed = paths.filter("kind = 'error'").select(
        F.expr(f"substring(path, {len(base) + 2})").alias("file"), F.lit(None).cast("bigint").alias("line"),
        F.lit(None).cast("bigint").alias("col"), F.lit(None).cast("string").alias("code_point"), "error",
    )
    files = paths.filter("kind = 'file'").select("path").repartition(task_count(spark), "path")
    return files.mapInPandas(_scanner(root, _as_python(INVISIBLE)), HIT).unionByName(failed)


def _as_python(pattern: str) -> str:
    """The class of code points in Python's spelling."""
    import re

    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08X}", pattern)


def scan_text_files(spark: SparkSession, root: str) -> DataFrame:
    """One row per hit: file, line, col, code_point. `scan_all_text` also tells what could not be read."""
    return scan_all_text(spark, root).filter("error is null").drop("error")
