"""Exact dedup by content-defined chunk recipes.

A text is cut where a rolling hash of its last 16 bytes has a given form, so equal passages give equal chunks
wherever they stand. Each chunk is named by its SHA-256; one shuffle brings every distinct chunk's bytes (each
task sends a chunk once, told by its name, length and a second hash) beside those of the same name and so proves that a name stands for one byte string.
From then on only the ordered lists of names move, never the documents.

Cases: null text counts as empty (an empty list); texts are compared after lower-casing A-Z only; of equal
texts the row with the largest doc_id stays (null ids are smallest; of rows that repeat the id too, exactly
one stays); very long texts are read whole, a chunk never exceeds MAX bytes; an empty table gives an empty result; other columns of the input are ignored,
or kept by distinct_documents(), whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.llm.common import ascii_lower, importable, keep_rows, small, table, written

#: Sizes in bytes: no cut before MIN, always one at MAX, and on average one in 2**BITS bytes between them.
MIN, MAX, BITS = 1024, 32768, 12

_GEAR = np.random.default_rng(16).integers(0, 2**32, 256, dtype=np.uint32)


def cut_points(data: bytes, least: int = MIN, most: int = MAX, bits: int = BITS) -> list[int]:
    """Ends of the chunks of data, the last one being len(data); no chunk for empty data."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for width in (1, 2, 4, 8):  # sums over 2, 4, 8 and 16 bytes, each byte shifted by its distance
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width)
        h = wider
    ends, start = [], 0
    for i in (np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1).tolist() + [n]:
        while i - start > most:
            start += most
            ends.append(start)
        if i - start >= least and i < n:
            ends.append(i)
            start = i
    if start < n:
        ends.append(n)
    return ends


def chunks(data: bytes) -> list[bytes]:
    """The chunks of data in order; joined they give data again."""
    ends = cut_points(data)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _normal(texts: pa.Array) -> Iterator[bytes]:
    for t in texts.to_pylist():
        yield (t or "").encode().lower()  # bytes.lower() changes A-Z only


def _recipes(key_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for whole in batches for s in small(whole, 1)):
            recipes, digests = [], []
            for data in _normal(b.column(1)):
                recipes.append(b"".join(hashlib.sha256(c).digest()[:key_bytes] for c in chunks(data)))
                digests.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(recipes, pa.binary()), pa.array(digests, pa.string())], ["doc_id", "recipe", "text_sha256"])

    return run


def _chunk_rows(key_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[int, int]] = {}
        for b in (s for whole in batches for s in small(whole, 0)):
            keys, parts, size = [], [], 0
            for data in _normal(b.column(0)):
                for c in chunks(data):
                    full = hashlib.sha256(c).digest()
                    other = len(c), xxhash.xxh3_64_intdigest(c)
                    if seen.get(full) == other and key_bytes == 32:
                        continue
                    seen[full] = other
                    if len(seen) > 500_000:  # a bound for memory only: a chunk sent twice changes nothing
                        seen.clear()
                    keys.append(full[:key_bytes])
                    parts.append(c)
                    size += len(c)
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(parts, pa.binary())], ["key", "bytes"])
                        keys, parts, size = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(parts, pa.binary())], ["key", "bytes"])

    return run


def ambiguous_keys(docs: DataFrame, key_bytes: int = 32) -> DataFrame:
    """Chunk names that stand for more than one byte string: (key). Every distinct chunk's bytes are compared."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("text").mapInArrow(_chunk_rows(key_bytes), "key binary, bytes binary")
    # dealt by name only, so that both steps below run where the rows are
    return rows.repartition(n, "key").distinct().groupBy("key").count().where("count > 1").select("key")


def exact_dedup(docs: DataFrame, key_bytes: int = 32) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    key_bytes shortens the names of chunks; any value gives the same result (tests use it to force names to clash).
    """
    importable(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    recipes = written(docs.mapInArrow(_recipes(key_bytes), "doc_id bigint, recipe binary, text_sha256 string"), "recipes")
    clashes = written(ambiguous_keys(docs, key_bytes), "clashes")
    same = ["recipe"]
    if clashes.limit(1).count():  # names that clash prove nothing: documents holding one are compared by their whole text
        names = F.expr(f"transform(sequence(1, length(recipe), {key_bytes}), i -> substring(recipe, i, {key_bytes}))")
        holders = recipes.where("length(recipe) > 0").select("recipe", F.explode(names).alias("key")).join(clashes, "key", "left_semi").select("recipe").distinct()
        whole = docs.select("doc_id", F.coalesce(ascii_lower("text"), F.lit("")).alias("whole")).withColumn("text_sha256", F.sha2("whole", 256)).distinct()
        odd = recipes.join(holders, "recipe", "left_semi").join(whole.select(F.col("doc_id").alias("d"), F.col("text_sha256").alias("s"), "whole"), F.expr("doc_id <=> d and text_sha256 = s")).drop("d", "s")
        recipes = recipes.join(holders, "recipe", "left_anti").withColumn("whole", F.lit("")).unionByName(odd)
        same.append("whole")
    groups = written(recipes.groupBy(*same).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    joined = recipes.join(groups, same)
    one = F.row_number().over(Window.partitionBy("doc_id", "text_sha256").orderBy(F.lit(1)))  # such rows are equal in all columns here, so any of them will do
    return joined.select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (one == 1)).alias("kept"), "text_sha256",
        (F.length("recipe") / key_bytes).cast("int").alias("n_chunks"),
    )


def distinct_documents(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) with one row of each group of equal texts: the one with the largest doc_id."""
    stay = exact_dedup(docs).where("kept").select("doc_id", F.col("text_sha256").alias("key"))
    return keep_rows(docs, F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256), stay)


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's query over the whole documents table."""
    return exact_dedup(table(spark, sf_dir, "documents")).drop("n_chunks")


ORACLE_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256 FROM n WINDOW w AS (PARTITION BY t)
"""
