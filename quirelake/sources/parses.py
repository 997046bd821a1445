"""The store of parses and what is built from them.

A parse is kept under the SHA-256 of its contents and of the file that was parsed; whatever is built from a parse carries that key. A new parse of an attachment takes the old one's place, and makes exactly what carries
another key stale: nothing is rebuilt where the parse came out the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.sources.deltas import append_delta, compact, current

_KEYS, _BY = ["attachment"], ("completed_at",)
COLUMNS = ("attachment", "parse_key", "provider", "pdf_sha", "content", "completed_at")


def parse_key(parses: DataFrame) -> DataFrame:
    """parses(attachment, provider, pdf_sha, content JSON, completed_at) with their key."""
    return parses.withColumn("parse_key", F.sha2(F.concat_ws("\n", F.coalesce("pdf_sha", F.lit("")), F.coalesce("content", F.lit(""))), 256)).select(*COLUMNS)


def store_parses(parses: DataFrame, root: str, buckets: int = 64, writer: str | None = None, batch: int | None = None) -> bool:
    """Add parses to the store; of an attachment the one that was completed last counts."""
    return append_delta(parse_key(parses), root, _KEYS, _BY, buckets, writer, batch)


def tidy(spark: SparkSession, root: str, most: int = 8) -> list[int]:
    """Merge buckets with many writes."""
    return compact(spark, root, _KEYS, _BY, most)


def parses(spark: SparkSession, root: str) -> DataFrame | None:
    """The present parses: COLUMNS; None before the first."""
    rows = current(spark, root, _KEYS, _BY)
    return rows if rows is None else rows.select(*COLUMNS)


def stale(built: DataFrame, present: DataFrame) -> DataFrame:
    """Rows of built(attachment, parse_key, ...) whose attachment has another parse now, or none."""
    return built.join(present.select("attachment", "parse_key"), ["attachment", "parse_key"], "left_anti")


def to_build(built: DataFrame, present: DataFrame) -> DataFrame:
    """Present parses that nothing is built from yet: COLUMNS. They meet the keys of what is built by attachment, as they are dealt out already."""
    known = built.where("parse_key is not null").groupBy("attachment").agg(F.collect_set("parse_key").alias("known"))
    return present.join(known, "attachment", "left").where(~F.coalesce(F.array_contains("known", F.col("parse_key")), F.lit(False))).select(*COLUMNS)


def refreshed(built: DataFrame, present: DataFrame, build) -> DataFrame:
    """What is built, brought up to date: rows that are not stale, and build(parses) of those that lack theirs. Only the latter are computed."""
    kept = built.join(present.select("attachment", "parse_key"), ["attachment", "parse_key"], "left_semi")
    return kept.unionByName(build(to_build(built, present)).select(*built.columns))
