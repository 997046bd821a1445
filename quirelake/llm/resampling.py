"""Target-distribution importance resampling over hashed word n-grams, on a persisted sparse matrix.

Each document is a row of counts by bucket. Rows are kept as CSR blocks (ids, row starts, buckets, counts), one block a few hundred
documents, written once as a Parquet table in the shared folder. The column sums of the blocks of the documents and of the target give the two distributions and with them each bucket's
gain; the product of a block with the vector of gains gives its documents' weights. Ranks come from a histogram of the scores, which are whole numbers in a narrow range: a drawn
document's rank is the number of documents with a higher score and its place among those with the same one.

Cases: null and empty texts have no features, weight 0 and no rank, like all texts under the least number of words; a null doc_id counts as an empty one in the random part and
comes before others among equal scores; rows that repeat a doc_id are documents of their own, equal ones ranked one after another; texts of any length are read in pieces (a row of the matrix never has
more entries than there are buckets); an empty documents table gives an empty result, an empty target a distribution that is flat; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.llm.common import importable, pieces, small, table, written

#: Hash buckets, words a feature has at most, the seed of the draw, the percentage drawn and the least number of words of a document that may be drawn.
BUCKETS, NGRAM, SEED, PERCENT, LEAST_WORDS = 10_000, 1, 2024, 10, 20
#: Documents and entries of a block at most (one document may have more entries).
BLOCK_ROWS, BLOCK_ENTRIES = 512, 400_000
#: Buckets that a worker remembers, by feature.
REMEMBERED = 300_000

#: A-Z lower-cased; digits, letters and all bytes of other characters stand for themselves, the rest separates words.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BLOCKS = "doc_id array<bigint>, n_words array<bigint>, starts array<int>, buckets array<int>, counts array<bigint>"


class Features:
    """Counts a text's features by bucket."""

    def __init__(self, buckets: int = BUCKETS, ngram: int = NGRAM) -> None:
        self.buckets, self.ngram, self.known = buckets, ngram, {}

    def bucket(self, feature: bytes) -> int:
        at = self.known.get(feature)
        if at is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            at = self.known[feature] = crc32(feature) % self.buckets
        return at

    def row(self, text: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        """The number of words, the buckets in order and their counts."""
        n_words, sums, tail = 0, Counter(), []  # tail: the last words of the pieces before
        for piece in pieces(text.translate(_WORD_BYTES)):
            words = piece.split()
            n_words += len(words)
            found = Counter(words)
            for k in range(2, self.ngram + 1):  # all runs that end in this piece
                run = tail[1 - k :] + words
                found.update(map(b" ".join, zip(*[run[i:] for i in range(k)], strict=False)))
            tail = (tail + words)[1 - self.ngram :] if self.ngram > 1 else []
            for feature, n in found.items():
                sums[self.bucket(feature)] += n
        at = np.fromiter(sums.keys(), np.int32, len(sums))
        order = np.argsort(at)
        return n_words, at[order], np.fromiter(sums.values(), np.int64, len(sums))[order]


def _block(ids: list, words: list, rows: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    starts = np.cumsum([0, *(len(at) for at, _ in rows)])
    columns = [
        pa.array([ids], pa.list_(pa.int64())), pa.array([words], pa.list_(pa.int64())), pa.array([starts], pa.list_(pa.int32())),
        pa.array([np.concatenate([at for at, _ in rows])], pa.list_(pa.int32())), pa.array([np.concatenate([n for _, n in rows])], pa.list_(pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in _BLOCKS.split(", ")])


def _to_blocks(buckets: int, ngram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, ids, words, rows, entries = Features(buckets, ngram), [], [], [], 0
        for b in (s for whole in batches for s in small(whole, 1)):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n_words, at, n = features.row(text or b"")
                if rows and (len(rows) == BLOCK_ROWS or entries + len(at) > BLOCK_ENTRIES):
                    yield _block(ids, words, rows)
                    ids, words, rows, entries = [], [], [], 0
                ids.append(doc_id)
                words.append(n_words)
                rows.append((at, n))
                entries += len(at)
        if rows:
            yield _block(ids, words, rows)

    return run


def csr_blocks(docs: DataFrame, buckets: int = BUCKETS, ngram: int = NGRAM, id_column: str = "doc_id") -> DataFrame:
    """The count matrix of docs(doc_id, text) as CSR blocks: doc_id, n_words, starts, buckets, counts, all arrays. Row i has the entries from starts[i] to starts[i + 1]."""
    importable(docs.sparkSession)
    return docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(_to_blocks(buckets, ngram), _BLOCKS)


def _rows(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[np.ndarray]:
    for b in batches:
        for x in b.column(b.schema.get_field_index(name)):
            yield x.values.to_numpy(zero_copy_only=False)


def _sums(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for at, n in zip(_rows([b], "buckets"), _rows([b], "counts"), strict=True):
                np.add.at(total, at, n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    return run


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The sum of each column of the matrix: a number a bucket, added up in tasks first."""
    sums = np.zeros(buckets, np.int64)
    for r in blocks.select("buckets", "counts").mapInArrow(_sums(buckets), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket at most
        sums[r.bucket] = r.n
    return sums


def gains_of(sums: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain: 1000 times the log of the smoothed target share over the smoothed share, rounded down."""
    k, s_all, t_all = len(sums), int(sums.sum()), int(target.sum())
    return np.array([floor(1000 * log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(sums.tolist(), target.tolist(), strict=True)], np.int64)


def chance(doc_id: int | None, seed: int = SEED) -> int:
    """The random part of a document's score: 1000 times a Gumbel number that its id decides, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return floor(-1000 * log(-log((h + 0.5) / 4294967296)))


def _product(gains: np.ndarray, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, n_words, starts, at, n = (b.column(c)[i].values for c in range(5))
                starts, at, n = (c.to_numpy(zero_copy_only=False) for c in (starts, at, n))
                gained, found = (np.concatenate([[0], np.cumsum(c)])[starts] for c in (n * gains[at], n))
                gained, found = np.diff(gained), np.diff(found)
                weight = np.where(found > 0, gained // np.maximum(found, 1), 0)
                score = weight + np.array([chance(d, seed) for d in ids.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids, n_words, pa.array(found, pa.int64()), pa.array(weight, pa.int64()), pa.array(score, pa.int64())], ["doc_id", "n_words", "n_features", "weight", "score"])

    return run


def scores(blocks: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    """The sparse matrix times the gains: doc_id, n_words, n_features, weight (the mean gain, rounded down), score."""
    return blocks.mapInArrow(_product(gains, seed), "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored with rank: 1, 2, 3 ... for the highest percent of scores among documents with least_words words, ties to the smaller doc_id; null for the others.

    The histogram that goes through the driver has a row for each different score. Gains lie within 1000 ln(S * buckets) of 0 and the random part between -3,200 and 23,000, so
    that there are some 10**5 at most, however many documents there are.
    """
    spark, fit = scored.sparkSession, F.col("n_words") >= least_words
    tally = sorted(((r.score, r.n) for r in scored.where(fit).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    draw = percent * sum(n for _, n in tally) // 100
    above, before = [], 0
    for score, n in tally:
        if before >= draw:
            break
        above.append((score, before))
        before += n
    cut = above[-1][0] if above else None
    drawn = fit & (F.col("score") >= cut) if above else F.lit(False)
    higher = F.broadcast(spark.createDataFrame(above, "score bigint, above bigint"))
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_first(), "n_features", "weight")) + F.col("above")
    top = scored.where(drawn).join(higher, "score").withColumn("rank", place).select(*scored.columns, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank"))
    return top.unionByName(scored.where(~drawn).withColumn("rank", F.lit(None).cast("bigint")))


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, ngram: int = NGRAM, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per row of docs(doc_id, text), drawn towards the distribution of target(text): doc_id, n_words, n_features, weight, score, rank."""
    blocks = written(csr_blocks(docs, buckets, ngram), "csr")
    wanted = csr_blocks(target.select(F.lit(0).alias("doc_id"), "text"), buckets, ngram)
    gains = gains_of(column_sums(blocks, buckets), column_sums(wanted, buckets))
    return ranked(written(scores(blocks, gains, seed), "scores"), percent, least_words)


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """The contract's query over the whole documents and benchmark tables."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


#: DuckDB has no crc32: the SQL makes its table and folds the bytes of each distinct word.
ORACLE_SQL = r"""
WITH RECURSIVE
crc(byte, value, turn) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) AS r(i)
  UNION ALL SELECT byte, CASE WHEN value & 1 = 1 THEN xor(value >> 1, 3988292384::BIGINT) ELSE value >> 1 END, turn + 1 FROM crc WHERE turn < 8),
steps AS (SELECT list(value ORDER BY byte) AS t FROM crc WHERE turn = 8),
found AS (
  SELECT d.doc_id, unnest(regexp_extract_all(translate(d.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark) d),
counted AS (SELECT doc_id, word, count(*) AS n FROM found GROUP BY ALL),
words AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM counted)),
hashed AS (
  SELECT word, xor(list_reduce(
    list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket
  FROM words, steps),
bucketed AS (SELECT doc_id, bucket, sum(n)::BIGINT AS n FROM counted JOIN hashed USING (word) GROUP BY ALL),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (doc_id >= 0), 0)::BIGINT AS s, coalesce(sum(n) FILTER (doc_id < 0), 0)::BIGINT AS t FROM bucketed GROUP BY bucket),
totals AS (SELECT sum(s)::BIGINT AS s_all, sum(t)::BIGINT AS t_all FROM sums),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM sums, totals),
weights AS (
  SELECT d.doc_id, coalesce(sum(n), 0)::BIGINT AS n_features, CASE WHEN sum(n) > 0 THEN floor(sum(n * gain) / sum(n))::BIGINT ELSE 0 END AS weight
  FROM documents d LEFT JOIN (SELECT doc_id, n, gain FROM bucketed JOIN gains USING (bucket)) b ON d.doc_id = b.doc_id GROUP BY d.doc_id),
scored AS (
  SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score, n_features >= 20 AS fit FROM weights),
placed AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY fit) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 10 * n // 100 THEN place END AS rank FROM placed
"""
