"""Streams: folders and write logs as they grow, merged into stores that are written behind.

A file source sees each path once, so a producer that rewrites a file uses a new name. Each micro-batch adds one delta with its number, so a batch that runs again after a failure changes nothing, and
costs what it brings; buckets with many deltas are merged on the way. A job over a folder keeps what it waits for beside its store: it can be stopped by a marker, and taken up again from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quirelake.operators.store import META, later_file_wins
from quirelake.sources.deltas import append_delta, compact, current
from quirelake.sources.readers import entries
from quirelake.sources.writers import _fs

#: Deltas a bucket may have before a trigger merges them.
DELTAS = 8
STOPPED = "the folder's job was stopped by its marker"
_RESULTS = (["unit_id"], ("file", "pos"))
_LOG = (["hash"], ("t",))


def _started(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str, every: str | None) -> StreamingQuery:
    out = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def watch_folder(spark: SparkSession, path: str, expected: DataFrame, root: str, checkpoint: str, every: str | None = "3 seconds", files_at_once: int | None = None) -> StreamingQuery:
    """Results of a task folder: each new file's entries of expected units(unit_id, en, math) go to the store at root; see folder_results().

    every: the trigger; None takes what is there and ends. While the job's stop marker is there no batch is taken.
    """
    reader = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True)
    reader = reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader
    files = reader.load(path).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))

    def merge(batch: DataFrame, number: int) -> None:
        if _marked(batch.sparkSession, root):
            raise RuntimeError(STOPPED)
        rows = entries(batch).select("unit_id", "file", "pos", "zh").join(expected.select("unit_id"), "unit_id", "left_semi")
        append_delta(rows, root, *_RESULTS, writer=checkpoint, batch=number)
        compact(batch.sparkSession, root, *_RESULTS, most=DELTAS)

    return _started(files, merge, checkpoint, every)


def folder_results(spark: SparkSession, root: str, expected: DataFrame) -> DataFrame | None:
    """What a folder has delivered of expected units(unit_id, en, math): unit_id, zh, problem, file, pos; the later file wins. None before the first batch."""
    rows = current(spark, root, *_RESULTS)
    return rows if rows is None else later_file_wins(rows, expected).join(rows.select("unit_id", "file", "pos"), "unit_id")


def watch_log(log: DataFrame, root: str, checkpoint: str, generation: int | None = None, every: str | None = "5 seconds") -> StreamingQuery:
    """A stream of store rows (hash, META; with a column generation where one is given) into the store at root, newest wins. Rows of other generations are results of cancelled work, and are dropped."""
    rows = log.where(F.col("generation") == generation) if generation is not None else log

    def merge(batch: DataFrame, number: int) -> None:
        append_delta(batch.select("hash", *META), root, *_LOG, writer=checkpoint, batch=number)
        compact(batch.sparkSession, root, *_LOG, most=DELTAS)

    return _started(rows, merge, checkpoint, every)


def logged(spark: SparkSession, root: str) -> DataFrame | None:
    """The rows that a log has led to: hash, META; None before the first batch."""
    rows = current(spark, root, *_LOG)
    return rows if rows is None else rows.select("hash", *META)


# ---- jobs over a folder ------------------------------------------------------


def _marked(spark: SparkSession, root: str) -> bool:
    fs, p, _ = _fs(spark, f"{root}/STOP")
    return fs.exists(p)


def stop_job(spark: SparkSession, root: str) -> None:
    """Put the marker that each batch reads first: what is merged stays, what is not yet merged waits."""
    fs, p, _ = _fs(spark, f"{root}/STOP")
    fs.create(p, True).close()


def start_job(units: DataFrame, root: str) -> None:
    """Keep the ids that a job waits for: units(unit_id)."""
    units.select("unit_id").distinct().write.parquet(f"{root}/todo")


def expected_of(spark: SparkSession, root: str, source: DataFrame) -> DataFrame | None:
    """Of a source's units(unit_id, en, math) those that the job waits for; None where there are none, as for another source than the job was made from."""
    units = source.join(spark.read.parquet(f"{root}/todo"), "unit_id", "left_semi")
    return None if units.isEmpty() else units


def resume_job(spark: SparkSession, path: str, root: str, source: DataFrame, every: str | None = "3 seconds", files_at_once: int | None = None) -> StreamingQuery | None:
    """Watch a job's folder from where the job stood: its checkpoint lies beside its store. None where the source has none of its units. Takes the stop marker away."""
    expected = expected_of(spark, root, source)
    if expected is None:
        return None
    fs, p, _ = _fs(spark, f"{root}/STOP")
    fs.delete(p, False)
    return watch_folder(spark, path, expected, root, f"{root}/checkpoint", every, files_at_once)


def ended(query: StreamingQuery) -> str:
    """Wait for a query's end: `done`, or `stopped` where the marker ended it. Other failures are raised."""
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        if STOPPED in str(e):
            return "stopped"
        raise
    return "done"


def job_state(spark: SparkSession, root: str, source: DataFrame) -> DataFrame:
    """One row: todo, delivered, bad (with a problem), stopped, finished."""
    expected = expected_of(spark, root, source)
    expected = source.where("false") if expected is None else expected
    found = folder_results(spark, root, expected)
    done = expected.select("unit_id", F.lit(False).alias("here"), F.lit(False).alias("bad")).where("false") if found is None else found.select("unit_id", F.lit(True).alias("here"), F.col("problem").isNotNull().alias("bad"))
    both = expected.select("unit_id").join(done, "unit_id", "left")
    out = both.agg(F.count("*").alias("todo"), F.count_if(F.expr("here and not bad")).alias("delivered"), F.count_if("bad").alias("bad"))
    return out.select("*", F.lit(_marked(spark, root)).alias("stopped"), F.expr("todo > 0 and delivered = todo").alias("finished"))


# ---- queues ------------------------------------------------------------------


def pending(units: DataFrame, cached: DataFrame, in_flight: DataFrame, failed: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """Units(unit_id, hash) that still need work: not in flight, not failed, and not cached unless forced. Three anti-joins."""
    rows = units.join(in_flight.select("unit_id"), "unit_id", "left_anti").join(failed.select("unit_id"), "unit_id", "left_anti")
    fresh = rows.join(cached.select("hash").distinct(), "hash", "left_anti").select(*units.columns)
    return fresh if forced is None else fresh.unionByName(rows.join(forced.select("unit_id"), "unit_id", "left_semi")).distinct()


def retried(failed: DataFrame, blocks: DataFrame) -> DataFrame:
    """Failed units(unit_id, block_id) after blocks are asked for again: only theirs leave."""
    return failed.join(blocks.select("block_id"), "block_id", "left_anti")
