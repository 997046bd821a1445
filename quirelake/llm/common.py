"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory, by Spark's own reader (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Let Python workers import this library where they do not find it by themselves."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def scratch_root(spark: SparkSession) -> str:
    """The application's own folder in one that all executors share: spark.checkpoint.dir, or, where that is unset, the warehouse.

    A warehouse on a machine's own disk serves where all tasks run on that machine; elsewhere this refuses it.
    """
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir")
        if not spark.sparkContext.master.startswith("local[") and (root.startswith("file:") or "://" not in root):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/quirelake-scratch/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again.

    This cuts the lineage: a lost executor costs only tasks of later stages, and Python work above is not
    done twice. The tables stay until clear_scratch().
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the table that written() made for df. Only for tables that nothing reads any more."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries planned inside remove their shuffle files when they end, not when the driver happens to collect them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all tables made by written(). Call it when no returned DataFrame is in use any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(col: Column | str) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


def quoted(name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names like the given ones that are not taken (in any case of letters)."""
    low, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in low:
            name += "_"
        low.add(name.lower())
        out.append(name)
    return out


def keep_rows(docs: DataFrame, key: Column, stay: DataFrame) -> DataFrame:
    """The rows of docs that stay(doc_id, key) names, one for each; key is the expression over docs that stay.key holds.

    Of rows that repeat id and text the one whose columns hash lowest stays. Columns of docs may have any names.
    """
    stay = written(stay, "stay")
    k, n, h = fresh(docs.columns, "key", "n", "hash")
    rows = docs.withColumn(k, key)
    kept = rows.alias("r").join(stay.alias("s"), F.expr(f"r.`{k}` = s.key and r.doc_id <=> s.doc_id"), "left_semi")
    if rows.select("doc_id", k).groupBy("doc_id", k).count().where("count > 1").limit(1).count():  # rows that repeat id and text
        whole = [F.to_json(F.struct(quoted(c).alias("v"))) for c in docs.columns if c not in ("doc_id", "text")]
        kept = kept.withColumn(h, F.xxhash64(*whole, F.lit(0)))
        kept = kept.withColumn(n, F.row_number().over(Window.partitionBy("doc_id", k).orderBy(h, *whole))).where(F.col(n) == 1).drop(n, h)
    return kept.drop(k)


def crc_mod(col: Column | str, mod: int) -> Column:
    """crc32 of the value's text, modulo mod; null values give null."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")) if isinstance(col, str) else F.crc32(col.cast("string").cast("binary")), F.lit(mod))


def held_out(col: str, mod: int, rest: int) -> Column:
    """Whether a row is held out: the crc32 of its id as text leaves the remainder; false for null ids."""
    return F.coalesce(crc_mod(col, mod) == rest, F.lit(False))


def small(batch: pa.RecordBatch, column: int, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most limit bytes of text each (or one row), to bound what Python holds at once."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, before + limit, "right")))
        yield batch.slice(start, end - start)
        start = end


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def pieces(data: bytes, limit: int = 4_000_000) -> Iterator[bytes]:
    """data in pieces of some limit bytes that end before white space, so that no word is cut."""
    start = 0
    while start < len(data):
        cut = _SPACE.search(data, start + limit) if start + limit < len(data) else None
        end = cut.start() if cut else len(data)
        yield data[start:end] if end - start < len(data) else data
        start = end


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file; operators take any path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)
