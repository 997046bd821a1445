"""Zip archives of parses: entries are listed where the archives are, the wanted one is picked by its name, and each is read by a task of its own.

Listing reads the ends of archives only (their directory of entries), in tasks; what is picked is dealt out again, so that one large archive does not hold up the others that its task has listed.
Tasks hand on what they read in batches of a bounded size, so that many small archives cost neither a task nor a batch each.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake import schemas as S
from quirelake.sources.folders import opened

# The names that the list of content items may have; its second version (content_list_v2.json) has another shape.
CONTENT_LIST = r"(^|/)([^/]*_)?content_list\.json\z"

#: Entries that a task reads once all cores have some, and rows and characters that a batch holds before it is handed on.
TASK_ENTRIES, BATCH_ROWS, BATCH_CHARS = 1000, 1000, 4_000_000
#: Archives that a task lists at least.
LIST_AT_ONCE = 64


def archives_in(spark: SparkSession, folder: str) -> DataFrame:
    """The archives below a folder: (path). Their contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(folder).select("path")


class _File:
    """A file of pyarrow that, like Python's own, tells a place before its start as an OSError."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file = file

    def seek(self, place: int, whence: int = 0) -> int:
        try:
            return self.file.seek(place, whence)
        except ValueError as e:
            raise OSError(str(e)) from e

    def __getattr__(self, name: str):
        return getattr(self.file, name)


def _batched(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], chars: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows as batches of BATCH_ROWS at most, that end where the texts of column chars come to BATCH_CHARS."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[chars] or "") if chars is not None else 0
        if len(held) >= BATCH_ROWS or size >= BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for path in b.column(0).to_pylist():
            store, file = opened(path)
            try:
                with store.open_input_file(file) as f, zipfile.ZipFile(_File(f)) as z:
                    found, problem = z.infolist(), None
            except (zipfile.BadZipFile, OSError) as e:
                found, problem = [], str(e)
            yield from [(path, n, x.filename, x.file_size, None) for n, x in enumerate(found)] or [(path, None, None, None, problem)]


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _batched(_listed(batches), ["path", "nth", "entry", "size", "problem"], [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string()])


def zip_entries(paths: DataFrame) -> DataFrame:
    """The entries of archives paths(path), in their order: path, nth, entry, size, problem. An archive without entries, or that cannot be read, is one row without an entry."""
    paths = paths.select("path")
    return paths.repartition(reading_tasks(paths, paths.count(), LIST_AT_ONCE)).mapInArrow(_list, "path string, nth int, entry string, size bigint, problem string")


def picked(entries: DataFrame, pattern: str = CONTENT_LIST) -> DataFrame:
    """Of each archive the last entry whose name fits: path, entry (null where none does), problem."""
    fits = F.col("entry").rlike(pattern)
    return entries.groupBy("path").agg(F.max_by("entry", F.when(fits, F.col("nth"))).alias("entry"), F.max("problem").alias("problem"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for path, entry in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            store, file = opened(path)
            text, problem = None, None
            try:
                with store.open_input_file(file) as f, zipfile.ZipFile(_File(f)) as z:
                    text = z.read(entry).decode()
            except (zipfile.BadZipFile, OSError, ValueError, KeyError, EOFError) as e:
                problem = str(e)
            yield path, entry, text, problem


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _batched(_texts(batches), ["path", "entry", "value", "problem"], [pa.string()] * 4, 2)


def zip_texts(entries: DataFrame, at_once: int = 4) -> DataFrame:
    """The texts of entries(path, entry): path, entry, value, problem. A task reads some at_once entries, one after another; where that were more tasks than four a core, some TASK_ENTRIES."""
    entries = entries.select("path", "entry").where("entry is not null")
    return entries.repartition(reading_tasks(entries, entries.count(), at_once)).mapInArrow(_read, "path string, entry string, value string, problem string")


def reading_tasks(df: DataFrame, n: int, at_once: int) -> int:
    """Tasks that read n files: at_once files each, but no more than four a core while a task has under TASK_ENTRIES."""
    few = 4 * df.sparkSession.sparkContext.defaultParallelism
    return max(1, min(-(-n // at_once), max(few, -(-n // TASK_ENTRIES))))


def content_items(texts: DataFrame) -> DataFrame:
    """The content items of lists (path, value): path, ord and the item's columns."""
    kind = ", ".join(f"{n}: {t}" for n, t in (part.strip().split(" ", 1) for part in S.ITEM_FILE.split(", ")))
    rows = texts.select("path", F.from_json("value", f"array<struct<{kind}>>").alias("items"))
    return rows.select("path", F.posexplode("items").alias("ord", "i")).select("path", F.col("ord").cast("bigint").alias("ord"), "i.*")


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        store.create_dir(root)
        for b in batches:
            done = []
            for name, entries in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                path, body = f"{root}/{name}-{uuid.uuid4().hex}.zip", io.BytesIO()
                with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as z:
                    for e in entries:
                        z.writestr(zipfile.ZipInfo(e["entry"]), e["value"] or "", zipfile.ZIP_DEFLATED)
                with store.open_output_stream(path, compression=None) as out:
                    out.write(body.getvalue())
                done.append(path if "://" not in folder else f"{folder.split('://')[0]}://{path}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.string())], ["name", "path"])

    return run


def write_zips(rows: DataFrame, folder: str) -> DataFrame:
    """Write rows(name string, entries array<struct<entry, value>>), an archive each; returns their table (name, path). Write that table before it is read twice: each run makes archives of its own."""
    return rows.select("name", "entries").mapInArrow(_write(folder), "name string, path string")
