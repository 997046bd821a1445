"""Sinks. A write goes to a new path and becomes visible by one step that makes a new small pointer, so readers never see half of it, nor nothing."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.operators.store import META, existing_wins, newest_wins


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def pointers(spark: SparkSession, root: str) -> list[int]:
    """The numbers of a store's pointers, lowest first; the highest one counts."""
    fs, p, _ = _fs(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.removeprefix("CURRENT-")) for n in names if n.startswith("CURRENT-"))


def pointed(spark: SparkSession, root: str, number: int) -> str:
    """The text of a pointer (small)."""
    fs, p, jvm = _fs(spark, f"{root}/CURRENT-{number}")
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(spark: SparkSession, root: str, number: int, text: str) -> bool:
    """Make a pointer with its whole text in one step; False where another writer has made that one.

    On a local file system the step is a hard link, which fails where the name is there. Elsewhere it is a rename, which must not overwrite (as in HDFS and stores with its semantics).
    """
    fs, p, jvm = _fs(spark, f"{root}/.{uuid.uuid4().hex}")
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    target = jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT-{number}")
    try:
        if fs.getScheme() != "file":
            return not fs.exists(target) and fs.rename(p, target)
        link, held = (jvm.java.io.File(x.toUri().getPath()).toPath() for x in (target, p))
        try:
            jvm.java.nio.file.Files.createLink(link, held)
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        return True
    finally:
        fs.delete(p, False)


def snapshot(spark: SparkSession, root: str, number: int | None = None) -> DataFrame | None:
    """The store's present table, or that of a pointer; None before the first write."""
    number = last_number(spark, root) if number is None else number
    return spark.read.parquet(f"{root}/{pointed(spark, root, number)}") if number else None


def write_snapshot(df: DataFrame, root: str, after: int | None = None) -> str:
    """Write a table and point to it; the one before stays until it is deleted by vacuum().

    Each write makes a pointer of its own, numbered one higher, in one step. Nothing is deleted on the way, so a crash at any step leaves the pointer before in force.
    after is the number that the caller has read; where another writer has come in between, the write fails instead of losing that one's rows.
    """
    spark = df.sparkSession
    after = last_number(spark, root) if after is None else after
    name = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{name}")
    if not publish(spark, root, after + 1, name):
        raise RuntimeError(f"another writer has written {root}")
    return name


def last_number(spark: SparkSession, root: str) -> int:
    """The number of the pointer in force; 0 before the first write."""
    return max(pointers(spark, root), default=0)


def merge_store(new: DataFrame, root: str, policy: str = "newest") -> None:
    """Merge rows (hash, META) into the store by `newest`, `existing` or `replace`."""
    number = last_number(new.sparkSession, root)
    now = snapshot(new.sparkSession, root, number)
    rows = new.select("hash", *META)
    if now is not None and policy != "replace":
        rows = newest_wins(now, rows, ["hash"]) if policy == "newest" else existing_wins(now, rows, ["hash"])
    write_snapshot(rows, root, number)


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> None:
    """Delete all pointers but the newest ones, and then the tables that those do not name."""
    fs, p, jvm = _fs(spark, root)
    numbers = pointers(spark, root)
    named = {pointed(spark, root, n) for n in numbers[-keep:]}
    for n in numbers[:-keep]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT-{n}"), False)
    for s in fs.listStatus(p) if numbers else ():
        if s.getPath().getName().startswith("v-") and s.getPath().getName() not in named:
            fs.delete(s.getPath(), True)


def json_documents(df: DataFrame, value: str, path: str) -> None:
    """One JSON text a row, as lines."""
    df.select(F.to_json(value)).write.mode("overwrite").text(path)


def fix_items(expected: DataFrame, checked: DataFrame) -> DataFrame:
    """Units still to be done: expected(unit_id, en) without a usable row in checked(unit_id, zh, problem): unit_id, en, previous, problem."""
    return expected.select("unit_id", "en").join(checked, "unit_id", "left").where("zh is null or problem is not null").select("unit_id", "en", F.col("zh").alias("previous"), F.coalesce("problem", F.lit("")).alias("problem"))


def table_csv(df: DataFrame, path: str) -> None:
    """A small report as CSV with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)
