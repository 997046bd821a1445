"""Many small files, written, listed and read in tasks: neither a listing nor a file passes through the driver.

A write puts its files below a hidden folder, a folder a task; what lost attempts left there is dropped, and then all of it becomes visible by one rename. A listing goes down level by level, a job a level, so that
folders are listed side by side; files are dealt out to tasks that read many of them each, and hand them on in batches of a bounded size.
Paths are uris of stores that pyarrow opens, in Hadoop's form and without escapes (file:/a b).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.sources.tables import scratch
from quirelake.sources.writers import _fs

LISTED = "path string, folder boolean, modified timestamp, size bigint"
#: Files that a task reads before there are four tasks a core, and after; characters and rows of a batch.
AT_ONCE, TASK_FILES, TASK_BYTES, BATCH_BYTES, BATCH_ROWS = 16, 2000, 64_000_000, 4_000_000, 2000


@cache
def _root(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root)


def at(uri: str) -> tuple[pafs.FileSystem, str]:
    """A store and the path in it, which is taken as it is: nothing in it is an escape."""
    scheme, host, path = re.fullmatch(r"(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/]*))?(/.*)", uri, re.DOTALL).groups()
    store, top = _root(f"{scheme or 'file'}://{host or ''}/")
    return store, top.rstrip("/") + path


def _shown(name: str) -> bool:
    """As Spark's own readers have it."""
    return not (name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_"))


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, n = f"task={uuid.uuid4().hex}", 0
        store, root = at(f"{folder}/{name}")
        for b in batches:
            if not n:
                store.create_dir(root)
            for file, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_output_stream(f"{root}/{file}", compression=None) as out:
                    out.write(value or b"")
            n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([n], pa.int64())], ["task", "n"])

    return run


def write_files(rows: DataFrame, folder: str) -> int:
    """Write rows(name string, value string or binary), a file each, below a new folder; returns their number. All files are there together, or none is."""
    spark = rows.sparkSession
    staged = f"{folder}/.staging-{uuid.uuid4().hex}"
    fs, top, jvm = _fs(spark, staged)
    top = fs.makeQualified(top)
    fs.mkdirs(top)
    told = scratch(rows.select("name", F.col("value").cast("binary").alias("value")).mapInArrow(_write(top.toString()), "task string, n bigint"), "written").where("n > 0").collect()  # a row a task
    good = {r.task for r in told}
    for s in fs.listStatus(top):
        if s.getPath().getName() not in good:
            fs.delete(s.getPath(), True)
    if not fs.rename(top, jvm.org.apache.hadoop.fs.Path(f"{folder}/job={uuid.uuid4().hex}")):
        raise RuntimeError(f"{folder} cannot be renamed into")
    return sum(r.n for r in told)


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for folder in b.column(0).to_pylist():
            store, path = at(folder)
            found = [f for f in store.get_file_info(pafs.FileSelector(path)) if _shown(f.base_name)]
            for k in range(0, len(found), 10_000):
                part = found[k : k + 10_000]
                columns = [f"{folder}/{f.base_name}" for f in part], [f.type == pafs.FileType.Directory for f in part], [f.mtime for f in part], [f.size or 0 for f in part]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.timestamp("us", "UTC"), pa.int64()), strict=True)], ["path", "folder", "modified", "size"])


def files_below(spark: SparkSession, path: str, nested: bool = True) -> DataFrame:
    """The files below a folder, or a pattern's folders and files: path, modified, size. Unless nested, folders are gone into only where their names are of the form key=value."""
    fs, p, jvm = _fs(spark, path)
    found = fs.globStatus(p)
    if not found:
        raise FileNotFoundError(path)
    top = [(s.getPath().toString(), s.isDirectory(), s.getModificationTime(), s.getLen()) for s in found]
    level = spark.createDataFrame(top, "path string, folder boolean, ms bigint, size bigint").select("path", "folder", F.timestamp_millis("ms").alias("modified"), "size")
    out, folders = level.where("not folder"), level.where("folder")
    while n := folders.count():
        level = scratch(folders.select("path").repartition(min(n, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(_children, LISTED), "listed")
        out, folders = out.unionByName(level.where("not folder")), level.where("folder")
        if not nested:
            folders = folders.where(F.element_at(F.split("path", "/"), -1).contains("="))
    return out.drop("folder")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = ["path", "content"], (pa.string(), pa.binary())
    held, size = [], 0
    for b in batches:
        for path in b.column(0).to_pylist():
            store, file = at(path)
            with store.open_input_stream(file, compression=None) as f:
                held.append((path, f.read()))
            size += len(held[-1][1])
            if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def contents(files: DataFrame) -> DataFrame:
    """The bytes of files(path, size): path, content."""
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    few = 4 * files.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(-(-n // AT_ONCE), max(few, -(-n // TASK_FILES))), min(n, -(-size // TASK_BYTES)))
    return files.select("path").repartition(tasks).mapInArrow(_read, "path string, content binary")


def texts(spark: SparkSession, path: str, nested: bool = True) -> DataFrame:
    """The whole texts of the files below a path: path (of the form file:///), value."""
    rows = contents(files_below(spark, path, nested))
    return rows.select(F.regexp_replace("path", "^file:/(?!/)", "file:///").alias("path"), F.col("content").cast("string").alias("value"))


def json_rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Files of one JSON object, or of a list of them, by a schema: path and its columns; a file that does not parse is one row of nulls."""
    value = F.col("value")
    many = F.from_json(F.when(F.ltrim(value).startswith("["), value), f"array<struct<{kind}>>")
    one = F.array(F.from_json(F.when(~F.ltrim(value).startswith("["), value), f"struct<{kind}>"))
    rows = texts(spark, path, False).select("path", F.explode_outer(F.when(F.ltrim(value).startswith("["), many).otherwise(one)).alias("r"))
    return rows.select("path", "r.*")
