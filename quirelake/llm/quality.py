"""A quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into chunks of CHUNK bytes that overlap by OVERLAP and cover the whole text. Learned byte vectors go
through FILTERS filters of WIDTH bytes, which step by STRIDE; each filter's responses are max-pooled over a chunk and joined
to one log-odds; the mean over all chunks gives the text's probability. Training is by backpropagation in numpy on
a bounded sample: about PER_CLASS documents of each label (twice as many at most), CHUNKS chunks of each.

Cases: null counts as empty, an empty text as one chunk of padding; texts of any length are read whole, in slices; without labels of both
kinds the score is the share of label 1 (0.5 without labels); ids may be null or repeat: null ids have no label, repeated rows are rows of their own (and are
learned from once); a score at the threshold counts as 1; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.llm.common import held_out, importable, small, table

CHUNK, OVERLAP = 256, 32
WIDTH, STRIDE, BYTE, FILTERS = 8, 4, 4, 24
PER_CLASS, CHUNKS, EPOCHS, BATCH = 1200, 4, 20, 64
PLACES = (CHUNK - WIDTH) // STRIDE + 1
PAD = 0


class ByteCnn:
    """p: byte vectors, filters with biases, and the weights that join the pooled responses."""

    def __init__(self, seed: int = 10):
        r = np.random.default_rng(seed)
        self.p = {
            "e": r.normal(0, 0.5, (256, BYTE)), "w": r.normal(0, (WIDTH * BYTE) ** -0.5, (WIDTH * BYTE, FILTERS)), "c": np.zeros(FILTERS),
            "v": r.normal(0, FILTERS**-0.5, FILTERS), "b": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.base: float | None = None  # a fixed score, where there was nothing to tell apart

    def patches(self, chunks: np.ndarray) -> np.ndarray:
        """What the filters see: (chunks, places, WIDTH * BYTE)."""
        x = self.p["e"].take(chunks, axis=0).reshape(len(chunks), CHUNK // STRIDE, STRIDE * BYTE)
        return np.concatenate([x[:, :-1], x[:, 1:]], axis=2)  # WIDTH is twice STRIDE

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        y = self.patches(chunks).reshape(-1, WIDTH * BYTE) @ self.p["w"]
        y = y.reshape(len(chunks), PLACES, FILTERS).max(1) + self.p["c"]
        return np.maximum(y, 0, out=y)

    def odds(self, chunks: np.ndarray) -> np.ndarray:
        """The log-odds of each chunk."""
        return self.pooled(chunks) @ self.p["v"] + self.p["b"]

    def gradient(self, chunks: np.ndarray, owner: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients of documents with labels y; owner is the document of each chunk."""
        p, n = self.p, len(y)
        seen = self.patches(chunks)
        out = (seen.reshape(-1, WIDTH * BYTE) @ p["w"]).reshape(len(chunks), PLACES, FILTERS)
        best = out.argmax(1)
        top = np.take_along_axis(out, best[:, None], 1)[:, 0] + p["c"]
        act = np.maximum(top, 0)
        share = 1 / np.bincount(owner, minlength=n)
        prob = 1 / (1 + np.exp(-np.bincount(owner, act @ p["v"] + p["b"], n) * share))
        loss = float(-np.mean(np.log(np.where(y == 1, prob, 1 - prob) + 1e-9)))
        d = (((prob - y) / n) * share)[owner].astype(np.float32)
        dtop = d[:, None] * p["v"] * (top > 0)
        at = np.take_along_axis(seen, best[:, :, None], 1)  # (chunks, filters, width): what made each maximum
        gw = np.einsum("cf,cfk->kf", dtop, at)
        gat = (dtop[:, :, None] * p["w"].T).reshape(len(chunks), FILTERS, WIDTH, BYTE)
        bytes_at = chunks[np.arange(len(chunks))[:, None, None], best[:, :, None] * STRIDE + np.arange(WIDTH)]
        ge = np.stack([np.bincount(bytes_at.ravel(), gat[..., k].ravel(), 256) for k in range(BYTE)], 1)
        return loss, {"e": ge, "w": gw, "c": dtop.sum(0), "v": d @ act, "b": d.sum(keepdims=True)}

    def fit(self, docs: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = 0.01, seed: int = 10) -> list[float]:
        """Adam over shuffled batches of documents (each an array of chunks)."""
        r = np.random.default_rng(seed)
        m1, m2, step, losses = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0, []
        for e in range(epochs):
            order, sums = r.permutation(len(docs)), []
            for i in range(0, len(order), batch):
                at = order[i : i + batch]
                owner = np.repeat(np.arange(len(at)), [len(docs[k]) for k in at])
                loss, g = self.gradient(np.concatenate([docs[k] for k in at]), owner, y[at])
                step += 1
                sums.append(loss)
                for k, v in g.items():
                    m1[k] = 0.9 * m1[k] + 0.1 * v
                    m2[k] = 0.99 * m2[k] + 0.01 * v * v
                    self.p[k] -= (rate * 0.9**e * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(sums)))
        return losses

    def scores(self, texts: list[bytes], group: int = 512) -> np.ndarray:
        """The probability of label 1 for each text."""
        if self.base is not None:
            return np.full(len(texts), self.base)
        cut = [chunked(t) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
        rows = np.concatenate(cut) if cut else np.empty((0, CHUNK), np.uint8)
        odds = np.concatenate([self.odds(rows[i : i + group]) for i in range(0, len(rows), group)] or [np.empty(0)])
        mean = np.bincount(owner, odds, len(texts)) / np.maximum(np.bincount(owner, minlength=len(texts)), 1)
        return 1 / (1 + np.exp(-np.clip(mean, -30, 30)))


def chunked(data: bytes) -> np.ndarray:
    """The chunks of a text, (chunks, CHUNK); the last one is padded."""
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(data) - OVERLAP) // step))
    padded = np.frombuffer(data.ljust((n - 1) * step + CHUNK, b"\0"), np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ByteCnn:
    """Fit on docs(doc_id, text) and labels(doc_id, quality). The sample has at most 2 * per_class documents of each label, chosen by a hash of the id."""
    known = labels.select("doc_id", "quality").where("doc_id is not null and quality in (0, 1)")
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    model = ByteCnn()
    if len(counts) < 2:
        model.base = float(next(iter(counts), 0.5))
        return model
    rate = F.when(F.col("quality") == 1, min(1.0, per_class / counts[1])).otherwise(min(1.0, per_class / counts[0]))
    first = lambda *order: F.row_number().over(Window.partitionBy("quality").orderBy(*order))
    some = known.where((F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 20)) / (1 << 20)) < rate).distinct()
    some = some.withColumn("n", first(F.xxhash64("doc_id", F.lit("order")), "doc_id")).where(f"n <= {2 * per_class}").drop("n")
    place = f"1 + pmod(xxhash64(h, i), greatest(length(text) - {CHUNK} + 1, 1))"
    rows = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(some), "doc_id")  # at most 4 * per_class rows
        .withColumn("h", F.xxhash64("text"))
        .selectExpr("quality", f"transform(sequence(1, {CHUNKS}), i -> substring(text, cast({place} as int), {CHUNK})) as pieces", "h")
        .distinct()  # rows that repeat an id, or share a text
        .withColumn("n", first(F.xxhash64("h", F.lit("order")), "h")).where(f"n <= {2 * per_class}")
        .collect()
    )
    if len({r["quality"] for r in rows}) < 2:
        model.base = 0.5 if not rows else float(rows[0]["quality"])
        return model
    rows.sort(key=lambda r: (r["h"], r["quality"]))
    model.fit([np.concatenate([chunked(p.encode()[:CHUNK]) for p in r["pieces"]]) for r in rows], np.array([r["quality"] for r in rows]))
    return model


def _run(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for whole in batches:
            for b in small(whole, 1, 2_000_000):
                scores = net.scores([(t or "").encode() for t in b.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def quality_scores(docs: DataFrame, model: ByteCnn) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, score. The model (some 10 kB) is broadcast."""
    spark = docs.sparkSession
    importable(spark)
    return docs.select("doc_id", "text").mapInArrow(_run(spark.sparkContext.broadcast(model)), "doc_id bigint, score double")


def op10_quality(spark, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """The contract's query over the whole documents table; it learns from labels of rows that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out("doc_id", 5, 0)))
    return quality_scores(docs, model).select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")
    )
