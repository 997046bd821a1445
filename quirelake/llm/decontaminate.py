"""Benchmark decontamination by greedy string tiling.

Words are runs of `\\w`, lower-cased. A document and a benchmark item that share a seed of MIN_MATCH words are compared by
greedy string tiling with running Karp-Rabin hashes: the longest common run of words not yet covered becomes a
tile, again and again, until no run of MIN_MATCH words is left, so passages that were taken apart and put in another order
count in full. A document is contaminated where tiles cover COVERAGE of an item's words.

The items go to the tasks in blocks of BLOCK_WORDS words; documents never move, and are read once for each block (once,
for any ordinary set of benchmarks).

Cases: null texts count as empty and are clean; items without a word match nothing, items of fewer than MIN_MATCH words must appear whole;
items with null ids count, but are not listed in item_ids; very long texts are read whole, in slices of rows;
repeated items and documents are rows of their own; ties between items give all of them; empty tables give
clean documents or an empty result; other columns are ignored, or kept by without_leaks(), whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import importable, small, table, written

MIN_MATCH, COVERAGE, BLOCK_WORDS = 5, 0.6, 1_000_000
_words = re.compile(r"\w+").findall
_PRIME, _BASE = (1 << 61) - 1, 1_000_003


def words(text: str | None) -> list[str]:
    """The words of a text."""
    return _words((text or "").lower())


def _rolling(seq: list[int], free: bytearray, n: int) -> Iterator[tuple[int, int]]:
    """(start, Karp-Rabin hash) of each run of n words that no tile covers; negative words are in none."""
    top = pow(_BASE, n - 1, _PRIME)
    h = have = 0
    for i, w in enumerate(seq):
        if not free[i] or w < 0:
            h = have = 0
            continue
        if have == n:
            h = (h - (seq[i - n] + 1) * top) % _PRIME
            have -= 1
        h = (h * _BASE + w + 1) % _PRIME
        have += 1
        if have == n:
            yield i - n + 1, h


def _runs(item: list[int], doc: list[int], free_i: bytearray, free_d: bytearray, n: int) -> list[tuple[int, int, int]]:
    """(length, start in doc, start in item) of the common runs of n or more free words, as far as they go to both sides."""
    at: dict[int, list[int]] = {}
    for i, h in _rolling(item, free_i, n):
        at.setdefault(h, []).append(i)
    found = []
    for d, h in _rolling(doc, free_d, n) if at else ():
        for i in at.get(h, ()):
            if i and d and item[i - 1] == doc[d - 1] >= 0 and free_i[i - 1] and free_d[d - 1]:
                continue  # part of the run that began a word before
            k = 0
            while i + k < len(item) and d + k < len(doc) and item[i + k] == doc[d + k] >= 0 and free_i[i + k] and free_d[d + k]:
                k += 1
            if k >= n:  # else two runs have one hash
                found.append((k, d, i))
    return found


def tiles(item: list[int], doc: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in doc, length), longest first; of equal ones the earliest in the document, then in the item."""
    free_i, free_d = bytearray(b"\1") * len(item), bytearray(b"\1") * len(doc)
    out, n = [], max(least, min(len(item), len(doc), 20))
    while True:
        found = _runs(item, doc, free_i, free_d, n)
        if not found:
            if n == least:
                return out
            n = max(least, n // 2)
            continue
        longest = max(k for k, _, _ in found)
        for k, d, i in sorted(f for f in found if f[0] == longest):
            if all(free_i[i : i + k]) and all(free_d[d : d + k]):
                free_i[i : i + k] = free_d[d : d + k] = bytes(k)
                out.append((i, d, k))


class Items:
    """A block of benchmark items, ready to be compared."""

    def __init__(self, items: list[tuple[int, str]], least: int = MIN_MATCH, coverage: float = COVERAGE):
        self.least, self.coverage = least, coverage
        self.vocab: dict[str, int] = {}
        self.items = [(k, [self.vocab.setdefault(w, len(self.vocab)) for w in words(t)]) for k, t in items]
        self.seeds: dict[tuple[int, ...], list[int]] = {}
        for n, (_, ids) in enumerate(self.items):
            size = min(least, len(ids))
            for s in {tuple(ids[i : i + size]) for i in range(len(ids) - size + 1)} if size else ():
                self.seeds.setdefault(s, []).append(n)
        self.sizes = sorted({len(s) for s in self.seeds})

    def matches(self, text: str | None) -> list[tuple[int, float]]:
        """(item, share of its words that tiles cover) for each item of which the text holds enough seeds to reach the threshold."""
        found = words(text)
        ids = np.fromiter(map(self.vocab.get, found, repeat(-1)), np.int64, len(found))
        known = ids >= 0
        hits: dict[int, dict[int, int]] = {}  # by item: where in the text its seeds stand, with their sizes
        for size in self.sizes:
            if len(ids) < size:
                break
            run = known[: len(ids) - size + 1].copy()
            for k in range(1, size):
                run &= known[k : len(ids) - size + 1 + k]
            for i in np.flatnonzero(run).tolist():
                for n in self.seeds.get(tuple(ids[i : i + size].tolist()), ()):
                    hits.setdefault(n, {})[i] = size
        out = []
        for n, places in hits.items():
            item_id, item = self.items[n]
            least = min(self.least, len(item))
            if len(places) * least < self.coverage * len(item):
                continue  # so few seeds cannot cover it
            # tiles consist of seeds, so only words under seeds matter; a gap keeps apart what is not adjacent
            doc, end = [], -1
            for i, size in sorted(places.items()):
                if i > end:
                    doc.append(-1)
                doc += ids[max(i, end) : i + size].tolist()
                end = max(end, i + size)
            out.append((item_id, sum(k for _, _, k in tiles(item, doc, least)) / len(item)))
        return out

    def judged(self, text: str | None) -> tuple[float, list[int]]:
        """The largest coverage, and the items (null ids apart) that reach the threshold."""
        found = self.matches(text)
        return max((c for _, c in found), default=0.0), sorted({k for k, c in found if c >= self.coverage - 1e-12 and k is not None})


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, str]]]:
    """The items of benchmark(item_id, text) in lists of about block_words words, each fetched alone."""
    size = F.size(F.split(F.coalesce("text", F.lit("")), r"\W+"))
    rows = benchmark.select("item_id", "text").where("text is not null")
    n = -(-(rows.agg(F.sum(size)).first()[0] or 1) // block_words)
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def _run(items, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, least = items.value.judged, items.value.coverage - 1e-12
        for whole in batches:
            for b in small(whole, 0):
                found = [judge(t) for t in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c > 0 and c >= least for c, _ in found], pa.bool_()), pa.array([c for c, _ in found], pa.float64()), pa.array([i for _, i in found], pa.list_(pa.int64())), *b.columns[1:]],
                    ["contaminated", "coverage", "item_ids", *keep],
                )

    return run


def _pass(docs: DataFrame, items: list[tuple[int, str]], keep: list[str], least: int, coverage: float) -> DataFrame:
    spark = docs.sparkSession
    importable(spark)
    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    shared = spark.sparkContext.broadcast(Items(items, least, coverage))
    return docs.select(F.col("text").alias("__text"), *keep).mapInArrow(_run(shared, keep), f"contaminated boolean, coverage double, item_ids array<bigint>{kept}")


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, contaminated, coverage (the largest of any item with enough seeds, else 0), item_ids (of the items found)."""
    each = blocks(benchmark, block_words)
    first, second = next(each, []), next(each, None)
    if second is None:
        return _pass(docs, first, ["doc_id"], least, coverage).select("doc_id", "contaminated", "coverage", "item_ids")
    keyed = written(docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("__key")), "texts")  # read once a block
    found = None
    for items in chain((first, second), each):  # a block is in the driver while its own pass runs; only the first two are there together
        hits = written(_pass(keyed, items, ["doc_id", "__key"], least, coverage).where("coverage > 0"), "hits").distinct()
        found = hits if found is None else found.unionByName(hits)
    found = found.groupBy("doc_id", "__key").agg(F.max("coverage").alias("c"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("i"))
    rows = keyed.select("doc_id", "__key").alias("d").join(found.alias("f"), F.expr("d.doc_id <=> f.doc_id and d.__key = f.__key"), "left")
    return rows.selectExpr("d.doc_id", f"coalesce(c >= {coverage - 1e-12!r}D, false) as contaminated", "coalesce(c, 0D) as coverage", "coalesce(i, cast(array() as array<bigint>)) as item_ids")


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs(text, ...) without the contaminated documents, all columns kept; each block of items is one pass over what the blocks before left."""
    names = docs.columns
    at = [f"c{i}" for i in range(len(names))]
    rows = docs.toDF(*at)
    for k, items in enumerate(blocks(benchmark, block_words)):
        if k:  # one block at a time: its pass is done before the next block goes to the tasks
            rows = written(rows, "clean")
        judged = _pass(rows.withColumn("text", F.col(at[names.index("text")])), items, at, least, coverage)
        rows = judged.where("not contaminated").select(*at)
    return rows.toDF(*names)


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """The query over the whole documents table and the whole benchmark."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
