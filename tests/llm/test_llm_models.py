"""The models' scores against plain loops over their parameters, the contract's split of rows, and the pipeline on odd tables."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quirelake.llm import brown_lm, language_id, quality
from quirelake.llm.common import table


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def plain_language(model, data):
    """Mean probabilities of a text's bytes, one number at a time; states start anew in each window."""
    h, langs, sums = model.h, len(model.langs), [0.0] * len(model.langs)
    p = {k: v.astype(float).tolist() for k, v in model.p.items()}

    def walk(window, d):
        s, out = [0.0] * h, [None] * len(window)
        for t in range(len(window)) if d == "f" else reversed(range(len(window))):
            x, ug, un = p[f"x{d}"][window[t]], p[f"ug{d}"], p[f"un{d}"]
            gates = [sigmoid(x[i] + sum(ug[i][j] * s[j] for j in range(h))) for i in range(2 * h)]
            z, r = gates[:h], gates[h:]
            cand = [math.tanh(x[2 * h + i] + r[i] * sum(un[i][j] * s[j] for j in range(h))) for i in range(h)]
            s = [z[i] * s[i] + (1 - z[i]) * cand[i] for i in range(h)]
            out[t] = s
        return out

    for at in range(0, len(data), language_id.WINDOW):
        part = data[at : at + language_id.WINDOW]
        window = part + bytes(language_id.WINDOW - len(part))  # the last window is padded
        f, b = walk(window, "f"), walk(window, "b")
        for t in range(len(part)):
            y = [sum(p["of"][k][i] * f[t][i] + p["ob"][k][i] * b[t][i] for i in range(h)) + p["b"][k][0] for k in range(langs)]
            e = [math.exp(v - max(y)) for v in y]
            for k in range(langs):
                sums[k] += e[k] / sum(e)
    return [v / len(data) for v in sums]


def test_language_scores_equal_plain_loops(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs)
    texts = ["a", "Kurze Wege, lange Nächte.", "été " * 40, "x" * 64, "y" * 65] + [r.text[:300] for r in docs.where("length(text) > 50").limit(6).collect()]
    got = language_id.language_id(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).orderBy("doc_id").collect()
    for r, text in zip(got, texts, strict=True):
        want = plain_language(model, text.encode())
        best = sorted(want)
        assert abs(r.score - best[-1]) < 1e-4 and abs(r.margin - (best[-1] - best[-2])) < 1e-4 and want[model.langs.index(r.lang_pred)] > best[-1] - 1e-4


def plain_quality(model, data):
    """The log-odds of overlapping chunks, averaged, one filter and place at a time."""
    p = {k: v.astype(float).tolist() for k, v in model.p.items()}
    step, odds, at = quality.CHUNK - quality.OVERLAP, [], 0
    while True:
        chunk = data[at : at + quality.CHUNK].ljust(quality.CHUNK, b"\0")
        total = p["b"][0]
        for k in range(quality.FILTERS):
            best = max(
                sum(p["e"][chunk[place + i]][d] * p["w"][i * quality.BYTE + d][k] for i in range(quality.WIDTH) for d in range(quality.BYTE))
                for place in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE)
            )
            total += p["v"][k] * max(0.0, best + p["c"][k])
        odds.append(total)
        at += step
        if at + quality.OVERLAP >= len(data):
            return sigmoid(sum(odds) / len(odds))


def test_quality_scores_equal_plain_loops(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels)
    texts = ["", "a", "z" * quality.CHUNK, "z" * (quality.CHUNK + 1)] + [r.text[:600] for r in docs.where("length(text) > 700").limit(3).collect()]
    got = quality.quality_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).orderBy("doc_id").collect()
    for r, text in zip(got, texts, strict=True):
        assert abs(r.score - plain_quality(model, text.encode())) < 1e-4


def plain_brown(train, texts):
    """log10 probabilities with all training words in one class, from counts of pairs.

    Tokens are the end of a text, words of the class, and new words, for which words seen once stand.
    """
    words = [t.lower().split() for t in train]
    counts = Counter(w for ws in words for w in ws)
    kinds, once = ("end", "class", "new"), {w for w, n in counts.items() if n == 1}
    n = {(a, b): 0.0 for a in kinds for b in kinds}
    fresh = dict.fromkeys(kinds, 0.0)
    for ws in words:
        before = None
        for w in [*ws, None]:
            second = "end" if w is None else "class"
            first = "end" if before is None else "class"
            for kind in (first, "new") if before in once else (first,):  # what follows a word seen once follows a new one
                n[kind, second] += 1
                if w in once:
                    fresh[kind] += 1
            before = w
    vocabulary, emitted = len(counts) + 1, sum(counts.values())
    prior = {b: sum(n[a, b] for a in ("end", "class")) + 0.01 for b in ("end", "class")}
    prior = {b: v / sum(prior.values()) for b, v in prior.items()} | {"new": 0.0}

    def step(a, b):
        total = sum(n[a, x] for x in kinds)
        new = (fresh[a] + 0.5) / (total + 1)
        return new if b == "new" else (1 - new) * (n[a, b] + brown_lm.SMOOTH * prior[b]) / (total + brown_lm.SMOOTH)

    out = []
    for text in texts:
        score, before = 0.0, "end"
        for w in [*text.lower().split(), None]:
            kind = "end" if w is None else "class" if w in counts else "new"
            score += math.log10(step(before, kind))
            score += {"end": 0.0, "new": -math.log10(vocabulary + 1)}.get(kind, math.log10(counts[w] / emitted) if kind == "class" else 0.0)
            before = kind
        out.append(score)
    return out


def test_brown_scores_equal_counts_of_pairs(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    train = [" ".join(r.choices(words, k=r.randrange(3, 15))) for _ in range(40)] + [f"w1 rare{i} w2" for i in range(6)] + ["w3 twice twice w4"]
    held = ["w1 w2 w3", "", "unseen words w1", "RARE1 w2 other", "w5 " * 50]
    rows = [(i, t) for i, t in enumerate(train + held)]
    got = brown_lm.brown_scores(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), F.col("doc_id") < len(train), classes=1).collect()
    want = plain_brown(train, train + held)
    assert len(got) == len(rows)
    for x in got:
        assert x.score == pytest.approx(want[x.doc_id], rel=1e-6, abs=1e-6), x.doc_id


def test_held_out_rows_are_those_of_the_contract(spark, sf_dir):
    for op, mod, rest in ((language_id.op2_language_id, 4, 2), (quality.op10_quality, 5, 0), (brown_lm.op3_brown_lm, 7, 2)):
        got = {r.doc_id: r.held_out for r in op(spark, sf_dir).select("doc_id", "held_out").collect()}
        assert got == {d: zlib.crc32(str(d).encode()) % mod == rest for d in got} and 0 < sum(got.values()) < len(got)


def test_no_held_out_row_is_learned_from(spark, sf_dir, tmp_path):
    """Other texts, languages and labels of held-out rows leave the models as they are."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    mine = lambda mod, rest: F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(mod)) == rest
    a = language_id.train(docs.where(~language_id.held_out("doc_id", 4, 2)))
    other = docs.withColumns({"text": F.when(mine(4, 2), "wholly other").otherwise(F.col("text")), "lang": F.when(mine(4, 2), "xx").otherwise(F.col("lang"))})
    b = language_id.train(other.where(~language_id.held_out("doc_id", 4, 2)))
    assert a.langs == b.langs and all((a.p[k] == b.p[k]).all() for k in a.p)
    c = quality.train(docs, labels.where(~quality.held_out("doc_id", 5, 0)))
    d = quality.train(docs.withColumn("text", F.when(mine(5, 0), "wholly other").otherwise(F.col("text"))), labels.withColumn("quality", F.when(mine(5, 0), 0).otherwise(F.col("quality"))).where(~quality.held_out("doc_id", 5, 0)))
    assert all((c.p[k] == d.p[k]).all() for k in c.p)


def test_pipeline_on_odd_tables(spark, sf_dir, tmp_path):
    """Nulls, repeated rows, long texts, odd names and no rows at all."""
    docs = table(spark, sf_dir, "documents").limit(60)
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    texts = [r.text for r in docs.where("lang = 'en' and length(text) > 200").limit(3).collect()]
    back = " ".join(reversed(texts[0].split()))
    odd = [(1000, None, "en", None, None), (1001, "", None, "s", 0), (1002, "½ ② 12", "de", "s", 6), (None, back, "en", "s", 5), (None, back, "en", "s", 5), (1003, texts[1], None, None, None), (1003, texts[1], None, None, None), (1004, texts[2] * 200, "en", "s", 1)]
    both = docs.unionByName(spark.createDataFrame(odd, kind)).withColumn("a`b.c", F.lit(7)).withColumn("key", F.lit("k")).withColumn("hash", F.lit(1))
    both.write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, sf_dir, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, columns = table(spark, str(tmp_path), "documents"), both.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == columns, name
        now = corpus_pipeline.written(now, name)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r.doc_id for r in out]
    assert not {1000, 1001, 1002} & set(ids) and ids.count(None) == 1 and ids.count(1003) == 1 and 1004 in ids
    assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in now.select("doc_id").collect())
    both.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    table(spark, sf_dir, "benchmark").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
