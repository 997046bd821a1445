"""A store that is written behind: every write adds a delta in hash buckets, reads merge, and compaction rewrites single buckets.

A numbered pointer (see writers.publish) holds the list of segments: for each its name, its place in the order of writes and the buckets that still count. A write costs its own rows and one
pointer, whatever the store holds. Data is there before the pointer that names it, so a crash between the two leaves files that nothing reads; a micro-batch that runs again finds its number in the
pointer and adds nothing. Writers that meet do not lose rows: the one that comes second takes the newer list and adds its segment to that.

Rows have key columns, columns that say which of two is newer (t, where null counts as 0, unless others are given) and others. Of rows with one key the newest wins, of equally new ones the earlier
write, within a write the greatest row. A row whose `gone` is true takes its key out of the store.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.sources.writers import _fs, last_number, pointed, pointers, publish

BUCKETS = 64
#: Attempts to publish when other writers come first.
ATTEMPTS = 50


def _state(spark: SparkSession, root: str) -> tuple[int, dict]:
    number = last_number(spark, root)
    return number, json.loads(pointed(spark, root, number)) if number else {"buckets": None, "segments": [], "batches": {}}


def _commit(spark: SparkSession, root: str, change) -> bool:
    """Publish change(state) as the next state, again on the newer state where another writer was first; False where change gives None."""
    for _ in range(ATTEMPTS):
        number, state = _state(spark, root)
        new = change(state)
        if new is None:
            return False
        if publish(spark, root, number + 1, json.dumps(new)):
            return True
    raise RuntimeError(f"too many writers at {root}")


def _order(by: tuple[str, ...]) -> list[Column]:
    return [F.coalesce("t", F.lit(0)) if c == "t" else F.col(c) for c in by]


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, root: str) -> str:
    """Rows with a bucket, dealt out by it, as a segment, a file a bucket."""
    name = f"d-{uuid.uuid4().hex}"
    rows.write.partitionBy("bucket").parquet(f"{root}/data/segment={name}")
    return name


def _present(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows with a bucket: one a key, the greatest by order; ties go to the greatest row. A bucket holds all rows of its keys, so that rows are dealt out by it once, for this and for the write."""
    rest = [c for c in rows.columns if c not in (*keys, "bucket")]
    best = F.max(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.struct(*rest).alias("r"))).alias("best")
    return rows.repartition("bucket").groupBy("bucket", *keys).agg(best).select("bucket", *keys, "best.r.*")


def _newest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of segments: one a key, the greatest by order, which differs between the rows of a key. Columns that nobody reads are neither read nor shuffled."""
    by = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    return rows.groupBy(*keys).agg(*[F.max_by(c, by).alias(c) for c in rows.columns if c not in keys])


def append_delta(new: DataFrame, root: str, keys: list[str], by: tuple[str, ...] = ("t",), buckets: int = BUCKETS, writer: str | None = None, batch: int | None = None, replace: bool = False) -> bool:
    """Add rows (keys, by, others) to the store; returns whether they were added.

    buckets counts for the first write only. Of a writer's batches each is added once: one with a number that the store has is left out. replace makes the rows the whole store.
    """
    spark = new.sparkSession
    _, state = _state(spark, root)

    def known(s: dict) -> bool:
        return writer is not None and s["batches"].get(writer, -1) >= batch

    if known(state):
        return False
    n = state["buckets"] or buckets
    rows = new if "gone" in new.columns else new.withColumn("gone", F.lit(False))
    rows = _present(rows.withColumn("bucket", _bucket(keys, n)), keys, _order(by))
    name = _write(rows, root)

    def change(s: dict) -> dict | None:
        if known(s) or s["buckets"] not in (None, n):
            return None
        seq = 1 + max((x["seq"] for x in s["segments"]), default=0)
        segments = [] if replace else s["segments"]
        return {"buckets": n, "segments": [*segments, {"name": name, "seq": seq, "buckets": list(range(n))}], "batches": s["batches"] | ({writer: batch} if writer is not None else {})}

    return _commit(spark, root, change)


def _rows(spark: SparkSession, root: str, segments: list[dict], only: set[int] | None = None) -> DataFrame:
    """All rows of segments (of some buckets), with seq and bucket. Which folders are read is settled by their names."""
    n = 1 + max(max(s["buckets"], default=0) for s in segments)
    some = F.lit(False)
    for s in segments:
        mine = sorted(set(s["buckets"]) & only if only is not None else s["buckets"])
        at = F.col("segment") == s["name"]
        some = some | (at if len(mine) == n else at & F.col("bucket").isin(mine))
    seq = F.create_map(*[F.lit(x) for s in segments for x in (s["name"], s["seq"])])
    paths = [f"{root}/data/segment={s['name']}" for s in segments]
    return spark.read.option("basePath", f"{root}/data").parquet(*paths).where(some).withColumn("seq", seq[F.col("segment")]).drop("segment")


def current(spark: SparkSession, root: str, keys: list[str], by: tuple[str, ...] = ("t",)) -> DataFrame | None:
    """The store as it is: one row a key, without bucket and gone; None before the first write."""
    _, state = _state(spark, root)
    if not state["segments"]:
        return None
    rows = _newest(_rows(spark, root, state["segments"]), keys, [*_order(by), -F.col("seq")])
    return rows.where("not gone").drop("gone", "bucket", "seq")


def compact(spark: SparkSession, root: str, keys: list[str], by: tuple[str, ...] = ("t",), most: int = 8) -> list[int]:
    """Merge the segments of each bucket that more than `most` of them hold; returns those buckets. Other buckets are not read, nor written.

    Writes that come in meanwhile stay; where another compaction has taken some of the segments, this one gives way.
    """
    _, state = _state(spark, root)
    held = Counter(b for s in state["segments"] for b in s["buckets"])
    full = {b for b, n in held.items() if n > most}
    if not full:
        return []
    rows = _present(_rows(spark, root, state["segments"], full), keys, [*_order(by), -F.col("seq")])
    name = _write(rows.where("not gone").drop("seq"), root)
    taken = {s["name"]: set(s["buckets"]) & full for s in state["segments"]}

    def change(s: dict) -> dict | None:
        now = {x["name"]: set(x["buckets"]) for x in s["segments"]}
        if any(not b <= now.get(k, set()) for k, b in taken.items()):
            return None
        left = [x | {"buckets": sorted(set(x["buckets"]) - taken.get(x["name"], set()))} for x in s["segments"]]
        merged = {"name": name, "seq": min(x["seq"] for x in state["segments"]), "buckets": sorted(full)}
        return s | {"segments": [merged, *[x for x in left if x["buckets"]]]}

    return sorted(full) if _commit(spark, root, change) else []


def sweep(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Delete all pointers but the newest ones, and then the folders that those do not name; returns how many folders went. Not while a write runs: its segment has no name yet."""
    fs, p, jvm = _fs(spark, f"{root}/data")
    numbers = pointers(spark, root)
    states = [json.loads(pointed(spark, root, n)) for n in numbers[-keep:]]
    for n in numbers[:-keep]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT-{n}"), False)
    counting: dict[str, set[int]] = {}
    for x in states:
        for s in x["segments"]:
            counting.setdefault(f"segment={s['name']}", set()).update(s["buckets"])
    gone = 0
    for segment in fs.listStatus(p) if fs.exists(p) else ():
        name = segment.getPath().getName()
        if name not in counting:
            gone += bool(fs.delete(segment.getPath(), True))
            continue
        for folder in fs.listStatus(segment.getPath()):
            b = folder.getPath().getName()
            if b.startswith("bucket=") and int(b.removeprefix("bucket=")) not in counting[name]:
                gone += bool(fs.delete(folder.getPath(), True))
    return gone
