"""Language ID by a bidirectional gated recurrent network over bytes.

The network reads windows of WINDOW bytes, forwards and backwards, labels every position with a distribution over
the languages, and a document's probabilities are the mean over all positions of all its windows, which tile the
whole text. It is trained in numpy by backpropagation through time, with the document's language as the label of each position,
on a bounded sample: PER_LANG documents of each language (expected number), WINDOWS windows of each (more of each where documents are few).

Cases: null texts and texts without a letter are `und` with score 0; ties go to the language that sorts first; texts of any
length are read whole, in slices; ids may be null or repeat, a repeated row is a row of its own (and is learned from once); if there is nothing to learn
from, every text is `und`; an empty table gives an empty result; other columns are ignored, or kept by in_some_language(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.llm.common import held_out, importable, small, table

WINDOW = 64
PER_LANG, WINDOWS = 300, 4
HIDDEN, EPOCHS, BATCH = 8, 8, 128
#: Passes over the sample go on until there were so many batches.
LEAST_BATCHES = 300
UNKNOWN = "und"
#: How far the mean probability of a document's language must lie above that of the next one for it to stay in a corpus. Both are means of the same
#: softmax, so the margin means the same for any number of languages; with one language it is the score itself. Chosen on held-out rows (README).
LEAST_MARGIN = 0.1


def _letter(text: str) -> bool:
    """Whether the text has a letter (Unicode categories L*)."""
    return any(map(str.isalpha, text))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


class BiGru:
    """Two gated recurrent layers, one for each direction, and a softmax at each position. Arrays are (features, batch)."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 2):
        r = np.random.default_rng(seed)
        self.langs, self.h = langs, hidden
        self.p: dict[str, np.ndarray] = {"b": np.zeros((len(langs), 1), np.float32)}
        for d in "fb":
            self.p[f"x{d}"] = r.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)  # what a byte adds to update, reset, candidate
            self.p[f"ug{d}"] = r.normal(0, hidden**-0.5, (2 * hidden, hidden)).astype(np.float32)
            self.p[f"un{d}"] = r.normal(0, hidden**-0.5, (hidden, hidden)).astype(np.float32)
            self.p[f"o{d}"] = r.normal(0, hidden**-0.5, (len(langs), hidden)).astype(np.float32)

    def states(self, data: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """The states at each position of data (positions, batch) in direction d; keep collects what the way back needs."""
        n, m = data.shape
        h, x = self.h, np.ascontiguousarray(self.p[f"x{d}"].T)
        ug, un = self.p[f"ug{d}"], self.p[f"un{d}"]
        out = np.empty((n, h, m), np.float32)
        s = np.zeros((h, m), np.float32)
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            add = x.take(data[t], axis=1)
            gates = _sigmoid(add[: 2 * h] + ug @ s)
            z, r = gates[:h], gates[h:]
            rec = un @ s
            cand = np.tanh(add[2 * h :] + r * rec)
            new = cand + z * (s - cand)
            if keep is not None:
                keep.append((t, s, gates, rec, cand))
            out[t] = s = new
        return out

    def probabilities(self, hf: np.ndarray, hb: np.ndarray) -> np.ndarray:
        """The distribution at each position: (positions, languages, batch)."""
        y = self.p["of"] @ hf + self.p["ob"] @ hb + self.p["b"]
        y -= y.max(1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(1, keepdims=True)
        return y

    def label(self, data: np.ndarray) -> np.ndarray:
        return self.probabilities(self.states(data, "f"), self.states(data, "b"))

    def gradient(self, data: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients, by backpropagation through time; mask has 1 at positions that count."""
        kept: dict[str, list] = {"f": [], "b": []}
        states = {d: self.states(data, d, kept[d]) for d in "fb"}
        prob = self.probabilities(states["f"], states["b"])
        total = max(float(mask.sum()), 1.0)
        each = np.take_along_axis(prob, np.broadcast_to(y[None, None, :], (len(data), 1, len(y))), 1)[:, 0]
        loss = float(-(np.log(each + 1e-9) * mask).sum() / total)
        err = prob
        err[:, y, np.arange(len(y))] -= 1
        err *= (mask / total)[:, None, :]
        g = {"b": err.sum((0, 2))[:, None]}
        h = self.h
        for d in "fb":
            g[f"o{d}"] = np.einsum("tkm,thm->kh", err, states[d], optimize=True)
            back = self.p[f"o{d}"].T @ err
            gx, gug, gun = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(self.p[f"ug{d}"]), np.zeros_like(self.p[f"un{d}"])
            ds = np.zeros((h, data.shape[1]), np.float32)
            sent, at = [], []
            for t, s, gates, rec, cand in reversed(kept[d]):
                ds = ds + back[t]
                z, r = gates[:h], gates[h:]
                dcand = ds * (1 - z) * (1 - cand * cand)
                drec = dcand * r
                dgates = np.concatenate([ds * (s - cand), dcand * rec]) * gates * (1 - gates)
                gug += dgates @ s.T
                gun += drec @ s.T
                sent.append(np.concatenate([dgates, dcand]))
                at.append(data[t])
                ds = ds * z + self.p[f"ug{d}"].T @ dgates + self.p[f"un{d}"].T @ drec
            np.add.at(gx, np.concatenate(at), np.concatenate(sent, 1).T)
            g |= {f"x{d}": gx, f"ug{d}": gug, f"un{d}": gun}
        return loss, g

    def fit(self, data: np.ndarray, mask: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = 0.02, seed: int = 2) -> list[float]:
        """Adam over shuffled batches; data and mask are (positions, windows). Returns the loss of each epoch."""
        r = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, losses = 0, []
        epochs = max(epochs, -(-LEAST_BATCHES * batch // max(data.shape[1], 1)))
        for e in range(epochs):
            order, sums = r.permutation(data.shape[1]), []
            for i in range(0, len(order), batch):
                at = order[i : i + batch]
                loss, g = self.gradient(data[:, at], mask[:, at], y[at])
                step += 1
                sums.append(loss)
                for k, v in g.items():
                    m1[k] += 0.1 * (v - m1[k])
                    m2[k] += 0.01 * (v * v - m2[k])
                    self.p[k] -= (rate * 0.06 ** (e / epochs) * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(sums)))
        return losses

    def predict(self, texts: list[bytes], group: int = 2048) -> np.ndarray:
        """Pooled probabilities of each text (texts, languages); zeros for empty ones."""
        sums = np.zeros((len(texts), len(self.langs)))
        size = np.array([len(t) for t in texts], np.int64)
        count = -(-size // WINDOW)
        owner = np.repeat(np.arange(len(texts)), count)
        padded = b"".join(t + bytes(-len(t) % WINDOW) for t in texts)
        rows = np.frombuffer(padded, np.uint8).reshape(-1, WINDOW)
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        for i in range(0, len(rows), group):
            own = owner[i : i + group]
            left = size[own] - (np.arange(i, i + len(own)) - first[own]) * WINDOW
            prob = self.label(np.ascontiguousarray(rows[i : i + group].T))
            prob *= (np.arange(WINDOW)[:, None] < left)[:, None, :]
            per = prob.sum(0)
            for k in range(len(self.langs)):
                sums[:, k] += np.bincount(own, per[k], len(texts))
        return sums / np.maximum(size, 1)[:, None]


def windows(rows: list[tuple[str, list[str]]], langs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Training arrays from (lang, pieces of text): bytes and mask (positions, windows), and the label of each window."""
    kept = [(p.encode()[:WINDOW], langs.index(lang)) for lang, pieces in rows for p in pieces if _letter(p)]
    data = np.frombuffer(b"".join(p.ljust(WINDOW, b"\0") for p, _ in kept), np.uint8).reshape(-1, WINDOW).T
    mask = (np.arange(WINDOW)[:, None] < np.array([len(p) for p, _ in kept])).astype(np.float32)
    return np.ascontiguousarray(data), mask, np.array([k for _, k in kept])


def train(docs: DataFrame, per_lang: int = PER_LANG) -> BiGru | None:
    """Fit on docs(doc_id, text, lang). The sample has about per_lang distinct texts of each language, twice as many at most, drawn by a hash of the text."""
    known = docs.select("text", "lang").where("text is not null and lang is not null")
    # rows are drawn by a hash of text and language, so null or repeated ids change nothing
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    pieces = min(32, max(WINDOWS, -(-PER_LANG * WINDOWS // min(per_lang, *counts.values(), PER_LANG))))
    place = f"1 + pmod(xxhash64(h, i), greatest(length(text) - {WINDOW} + 1, 1))"
    wanted = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_lang / n))])
    drawn = known.withColumn("h", F.xxhash64("text", "lang")).where((F.pmod(F.xxhash64("h", F.lit("sample")), F.lit(1 << 20)) / (1 << 20)) < wanted[F.col("lang")])
    # equal texts teach nothing new, so one of each stays, and at most twice the expected number of a language: what a hot text is drawn for cannot fill the driver
    drawn = drawn.dropDuplicates(["h"]).withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("h", F.lit("order")), "h"))).where(f"n <= {2 * per_lang}")
    rows = drawn.selectExpr("lang", f"transform(sequence(1, {pieces}), i -> substring(text, cast({place} as int), {WINDOW})) as pieces", "h").collect()
    langs = sorted(counts)
    data, mask, y = windows([(r["lang"], r["pieces"]) for r in sorted(rows, key=lambda r: r["h"])], langs)
    if not len(y):
        return None
    model = BiGru(langs)
    model.fit(data, mask, y)
    return model


def _run(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for whole in batches:
            for b in small(whole, 1, 2_000_000):
                texts = b.column(1).to_pylist()
                letters = [bool(net and t and _letter(t)) for t in texts]
                langs, scores, margins = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
                at = [i for i, x in enumerate(letters) if x]
                if at:
                    prob = net.predict([texts[i].encode() for i in at])
                    best = prob.argmax(1)
                    scores[at] = np.clip(prob.max(1), 0, 1)
                    margins[at] = scores[at] - (np.partition(prob, -2, 1)[:, -2] if prob.shape[1] > 1 else 0)
                    for i, k in zip(at, best.tolist(), strict=True):
                        langs[i] = net.langs[k]
                yield pa.RecordBatch.from_arrays([*b.columns[:1], pa.array(langs, pa.string()), pa.array(scores), pa.array(margins), *b.columns[2:]], ["doc_id", "lang_pred", "score", "margin", *b.schema.names[2:]])

    return run


def language_id(docs: DataFrame, model: BiGru | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs(doc_id, text, kept columns): doc_id, lang_pred, score, margin (over the next language), kept columns. The model (some 20 kB) is broadcast."""
    spark = docs.sparkSession
    importable(spark)
    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select("doc_id", "text", *keep).mapInArrow(_run(spark.sparkContext.broadcast(model)), f"doc_id bigint, lang_pred string, score double, margin double{kept}")


def in_some_language(docs: DataFrame, model: BiGru | None, least: float = LEAST_MARGIN) -> DataFrame:
    """docs(text, ...) without those that language ID rejects, all columns kept: `und`, or a language whose score is not least above that of the next one."""
    names = docs.columns
    at = [f"c{i}" for i in range(len(names))]
    rows = docs.toDF(*at).withColumns({"text": F.col(f"c{names.index('text')}"), "doc_id": F.lit(None).cast("bigint")})
    judged = language_id(rows, model, tuple(at))
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("margin") >= least)).select(*at).toDF(*names)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """The contract's query over the whole documents table; it learns from rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out("doc_id", 4, 2)))
    return language_id(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
