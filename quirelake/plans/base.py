"""What the queries share: driver tables as document tables, and literal fixtures for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake import schemas as S
from quirelake.functions import text as T

HEADING_CHARS = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-empty lines of documents: doc_id, ord, text."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    return rows.where("text <> ''").select("doc_id", F.col("ord").cast("bigint").alias("ord"), "text")


def as_blocks(rows: DataFrame, kind=None) -> DataFrame:
    """Lines as blocks: those of at most 12 characters are headings."""
    kind = F.when(F.length("text") <= HEADING_CHARS, "heading").otherwise("paragraph") if kind is None else kind
    return rows.select(
        "doc_id", "ord", F.concat(F.lit("b"), F.col("ord").cast("string")).alias("block_id"), kind.alias("kind"), F.lit(1).alias("level"), F.lit(None).cast("string").alias("role"), "text",
        F.col("text").contains("$").alias("inline_math"), F.array().cast(f"array<{S.RECT}>").alias("rects"),
    )


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_blocks(lines(spark, sf_dir))


LINES = "lines AS (SELECT doc_id, i - 1 AS ord, s AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE s <> '')"
BLOCKS = f"{LINES}, blocks AS (SELECT doc_id, ord, 'b' || ord AS block_id, CASE WHEN length(text) <= {HEADING_CHARS} THEN 'heading' ELSE 'paragraph' END AS kind, text FROM lines)"


def line_nodes(spark: SparkSession, sf_dir: str, kinds: int = 4) -> DataFrame:
    """Lines as text nodes, five a page, with a text map for all characters but white space: doc_id, ord, node_key, text, n, text_map. Of `kinds` of maps every second lacks its last character, and every third and fourth is upright."""
    rows = lines(spark, sf_dir).where(F.col("text").rlike(f"[^{T.WS[1:]}")).withColumn("n", T.solid(F.col("text")))
    text_map = F.expr(f"concat('[[', ord % {kinds}, ',', floor(ord / 5), ',', ord, ',2,', ord + n, ',12,[2,1]', repeat(',1', n - 1), ']]')")
    return rows.select("doc_id", "ord", F.col("ord").cast("string").alias("node_key"), "text", "n", text_map.alias("text_map"))


def line_nodes_sql() -> str:
    """The same with the number of their boxes, and the number of characters but white space in their first half."""
    all_, half = (f"length(regexp_replace({x}, '{T.WS}', '', 'g'))" for x in ("text", "substr(text, 1, length(text) // 2)"))
    return f"{LINES}, nodes AS (SELECT doc_id, ord, text, {all_} AS n, {all_} - ord % 2 AS boxes, ord // 5 AS page, {half} AS half FROM lines WHERE {all_} > 0)"


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(literal, v)) + "]"
    if isinstance(v, dict):
        return "{" + ", ".join(f"'{k}': {literal(x)}" for k, x in v.items()) + "}"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def values(rows: list[tuple], columns: str) -> str:
    """A VALUES list as a named relation: columns is 'name type, ...' with SQL types."""
    names = [c.strip().split(" ", 1) for c in columns.split(", ")]
    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    cast = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in names)
    return f"(SELECT {cast} FROM (VALUES {body}) AS v({', '.join(n for n, _ in names)}))"


def frame(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)
