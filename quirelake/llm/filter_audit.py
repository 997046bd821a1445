"""Filter interaction audit: what each filter of a chain removes, in every order of the filters, by a subset-zeta transform.

Each document gets a mask with a bit for each filter that it fails. Documents are counted by part and mask, which is all
that any order can depend on. The zeta transform (sums over subsets, one bit at a time) of a part's counts tells how many documents fail nothing
outside a set; read for the complement of a set of filters, those are the survivors of that set. A step of an order is then the difference between two neighbouring
sets, for labelled documents likewise, and a filter's Shapley sum is the weighted sum of its differences.

A document fails as a copy (the last filter) where a smaller doc_id has the same text. Rows are counted by text and id, and then by text, part, mask and labels, before rows
of one text meet, so a text that a third of all documents share costs no more than others.

Cases: null text counts as empty (it has no words, is under the least number of words, and equals other empty texts); null source is the part of the empty string; null
doc_ids are neither copies nor smaller than others, and have no labels; of rows that repeat the smallest doc_id of a text none is a copy; where labels repeat a doc_id a label is set if one
of the rows sets it, null labels set nothing; texts of any length are read whole, in pieces; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.llm.common import importable, pieces, small, table, written

#: Failure conditions over the columns of text_stats(), by the filter's letter. COPIES is decided over the whole table.
FILTERS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_capitals > 2 * n_chars",
    "D": "n_marks > 0",
}
COPIES = "E"

_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = b"#$%&*|"
_LATER_BYTES = bytes(range(0x80, 0xC0))  # all bytes of a character but its first
_STATS = "n_words bigint, n_distinct bigint, n_capitals bigint, n_chars bigint, n_marks bigint"


def text_numbers(data: bytes) -> tuple[int, int, int, int, int]:
    """Words, distinct words, capitals, code points and marks of a text in UTF-8."""
    n, words = 0, set()
    for piece in pieces(data):
        found = piece.split()  # bytes.split() cuts at runs of 0x20 and 0x09-0x0D only
        n += len(found)
        words.update(found)
    size = len(data)
    return n, len(words), size - len(data.translate(None, _CAPITALS)), len(data.translate(None, _LATER_BYTES)), size - len(data.translate(None, _MARKS))


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split(" ")[0] for c in _STATS.split(", ")]
    for b in (s for whole in batches for s in small(whole, 3)):
        numbers = [text_numbers(t) for t in b.column(3).to_pylist()]
        columns = [pa.array([x[i] for x in numbers], pa.int64()) for i in range(len(names))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *columns], ["doc_id", "part", "key", *names])


def text_stats(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, source, text): doc_id, part, key (the text's SHA-256) and the numbers that filters judge."""
    importable(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("key"), text.cast("binary").alias("text"))
    return rows.mapInArrow(_stats, f"doc_id bigint, part string, key binary, {_STATS}")


def mask_counts(docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS) -> DataFrame:
    """Documents by part and mask: part, mask, n, good (quality 1), toxic (toxic 1). Bit i is the i-th filter's, the last bit that of copies."""
    copy_bit = 1 << len(filters)
    mask = sum((F.expr(f"int({condition})") * (1 << i) for i, condition in enumerate(filters.values())), F.lit(0))
    # null ids match no label; they are dealt by their text, so that they do not meet in one task
    dealt = F.when(F.col("doc_id").isNull(), F.xxhash64("key")).otherwise(0)
    rows = text_stats(docs).select("doc_id", dealt.alias("dealt"), "part", "key", mask.alias("mask"))
    set_ = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.expr("quality <=> 1")).alias("good"), F.max(F.expr("toxic <=> 1")).alias("toxic"))
    rows = rows.join(set_.withColumn("dealt", F.lit(0).cast("bigint")), ["doc_id", "dealt"], "left")
    rows = rows.select("doc_id", "dealt", "key", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    kind = ["key", "part", "mask", "good", "toxic"]
    ids = rows.groupBy("doc_id", "dealt", *kind).agg(F.count("*").alias("n"))  # a row for each id: the same partitioning as the join's
    has_id = F.col("doc_id").isNotNull()
    kinds = ids.groupBy(*kind).agg(F.sum("n").alias("n"), F.sum(F.when(has_id, F.col("n")).otherwise(0)).alias("named"), F.min(F.when(has_id, F.struct("doc_id", "n"))).alias("least"))
    first = F.min("least.doc_id").over(Window.partitionBy("key"))
    copies = F.col("named") - F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0)
    split = kinds.select("part", "mask", "good", "toxic", "n", copies.alias("copies")).select(
        "part", "good", "toxic", F.inline(F.array(F.struct((F.col("mask") + copy_bit).alias("mask"), F.col("copies").alias("n")), F.struct("mask", (F.col("n") - F.col("copies")).alias("n")))))
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.expr("if(good, n, 0)")).alias("good"), F.sum(F.expr("if(toxic, n, 0)")).alias("toxic"))


def zeta(counts: Column, bits: int) -> Column:
    """The subset-zeta transform of an array of 2**bits numbers: at s the sum over all subsets of s."""
    steps = F.array(*[F.lit(1 << i) for i in range(bits)])
    places = F.sequence(F.lit(0), F.lit((1 << bits) - 1))
    return F.aggregate(steps, counts, lambda z, b: F.transform(places, lambda s: F.get(z, s) + F.when(s.bitwiseAND(b) != 0, F.get(z, s - b)).otherwise(0)))


def audit(counts: DataFrame, letters: str, orders: list[str] | None = None) -> DataFrame:
    """Each step of each order of filters in each part, from counts(part, mask, n, good, toxic): one row per part, filter_order and step.

    letters name the bits of the mask, the lowest first; orders are all permutations unless given.
    """
    k = len(letters)
    places, whole = F.sequence(F.lit(0), F.lit((1 << k) - 1)), (1 << k) - 1
    # a part has 2**k masks at most
    parts = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("at"))

    def survivors(measure: str) -> Column:
        found = F.transform(places, lambda s: F.coalesce(F.try_element_at("at", s).getField(measure), F.lit(0).cast("bigint")))
        return F.reverse(zeta(found, k))  # the complement of s is whole - s: reversed, the survivors of the filters s stand at s

    parts = parts.select("part", *[survivors(c).alias(f"{c}_left") for c in ("n", "good", "toxic")])
    orders = ["".join(o) for o in permutations(letters)] if orders is None else orders
    steps = parts.select("part", "n_left", "good_left", "toxic_left", F.explode(F.array(*map(F.lit, orders))).alias("filter_order"))
    steps = steps.select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter")).where("letter <> ''")
    bit = F.element_at(F.create_map(*[x for i, c in enumerate(letters) for x in (F.lit(c), F.lit(1 << i))]), F.col("letter"))
    before = sum((F.when(F.instr("filter_order", c) <= F.col("at"), 1 << i).otherwise(0) for i, c in enumerate(letters)), F.lit(0))
    steps = steps.withColumns({"bit": bit, "before": before})
    # how many orders have a given set of m filters before one: m! of it times (k - 1 - m)! of the rest
    ways = F.array(*[F.lit(factorial(m) * factorial(k - 1 - m)).cast("bigint") for m in range(k)])
    left = F.col("n_left")
    shapley = F.aggregate(places, F.lit(0).cast("bigint"), lambda t, s: t + F.when(
        s.bitwiseAND(F.col("bit")) == 0, F.get(ways, F.bit_count(s)) * (F.get(left, s) - F.get(left, s + F.col("bit")))).otherwise(0))

    def removed(c: str) -> Column:
        return F.get(c, F.col("before")) - F.get(c, F.col("before") + F.col("bit"))

    return steps.select(
        "part", "filter_order", (F.col("at") + 1).alias("step"), F.get(left, F.col("before") + F.col("bit")).alias("kept"), removed("n_left").alias("removed"),
        (F.get(left, F.lit(0)) - F.get(left, F.col("bit")) - removed("n_left")).alias("redundant"), (F.get(left, whole - F.col("bit")) - F.get(left, F.lit(whole))).alias("unique_fails"),
        removed("good_left").alias("good_lost"), removed("toxic_left").alias("toxic_lost"), shapley.alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS, orders: list[str] | None = None) -> DataFrame:
    """The audit of filters and of the filter for copies over docs(doc_id, source, text) with labels(doc_id, quality, toxic)."""
    return audit(written(mask_counts(docs, labels, filters), "masks"), "".join(filters) + COPIES, orders)


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    """The contract's query over the whole documents and labels tables."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
masked AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails
  FROM w LEFT JOIN l USING (doc_id)),
kinds AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masked GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (SELECT a.c || b.c || x.c || y.c || z.c AS filter_order FROM letters a, letters b, letters x, letters y, letters z WHERE len(list_distinct([a.c, b.c, x.c, y.c, z.c])) = 5),
steps AS (SELECT filter_order, s AS step, substr(filter_order, s, 1) AS letter, list_transform(string_split(substr(filter_order, 1, s - 1), ''), lambda c: ascii(c) - 64) AS before FROM orders, range(1, 6) AS r(s)),
failing AS (
  SELECT part, filter_order, step, letter, n, good, toxic, fails[ascii(letter) - 64] AS fail, step > 1 AND len(list_filter(before, lambda i: fails[i])) > 0 AS gone,
    fails[ascii(letter) - 64] AND len(list_filter(fails, lambda f: f)) = 1 AS alone
  FROM steps, kinds),
summed AS (
  SELECT part, filter_order, step, letter, sum(n) FILTER (NOT gone AND NOT fail) AS kept, sum(n) FILTER (fail AND NOT gone) AS removed, sum(n) FILTER (fail AND gone) AS redundant,
    sum(n) FILTER (alone) AS unique_fails, sum(good) FILTER (fail AND NOT gone) AS good_lost, sum(toxic) FILTER (fail AND NOT gone) AS toxic_lost
  FROM failing GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley
FROM summed
"""
