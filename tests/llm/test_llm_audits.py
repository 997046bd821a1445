"""Filter audit, importance resampling and archives against plain versions, on odd tables; and the odd names and letters that other operators must stand."""

import base64
import hashlib
import io
import itertools
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.fs as pafs
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from quirelake.llm import bpe, common, decontaminate, exact_dedup, filter_audit, language_id, ngram_join, resampling, warc
from quirelake.llm.common import table, tokenizer_path

LONG = "Word " * 40_000 + "x" * 50_000
ROWS = [
    (1, None, "a"), (2, "", None), (3, "A b $", "a"), (4, "A b $", "b"), (4, "A b $", "b"), (None, "A b $", "a"), (None, None, ""), (7, LONG, "a"), (8, LONG, "a"), (9, "\0\x85x　y", "b"), (5, "HELLO WORLD", "b"),
    (6, " ".join(f"w{i}" for i in range(230)), "a"), (11, " ".join(f"w{i}" for i in range(230)), "c"), (10, " ".join(f"w{i % 7}" for i in range(300)) + "#", "c"), (12, "tab\tand\x0bmore\x1cwords" * 60, "c"),
]
LABELS = [(3, 1, 0), (4, None, 1), (4, 1, None), (6, 1, 1), (6, 0, 0), (None, 1, 1), (99, 1, 1), (8, 1, 0), (11, 0, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, s, 1, True, "k") for d, t, s in ROWS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_words int, good boolean, key string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int").withColumn("part", F.lit("x"))


def slow_audit(rows, labels):
    texts = [(d, t or "", s or "") for d, t, s in rows]
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    failing = []
    for d, t, _ in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = d is not None and any(e is not None and e < d and u == t for e, u, _ in texts)
        failing.append({c for c, x in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), copy), strict=True) if x})
    out = {}
    for part in {s for _, _, s in texts}:
        own = [(d, f) for (d, _, s), f in zip(texts, failing, strict=True) if s == part]
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for k, c in enumerate(order, 1):
                gone = [x for x in left if c in x[1]]
                left = [x for x in left if c not in x[1]]
                shapley[c] += len(gone)
                out[part, order, k] = [len(left), len(gone), sum(c in f for _, f in own) - len(gone), sum(f == {c} for _, f in own), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
        for p, order, k in [x for x in out if x[0] == part]:
            out[p, order, k].append(shapley[order[k - 1]])
    return out


def test_filter_audit(docs, labels):
    got = {tuple(r[:3]): list(r[3:]) for r in filter_audit.filter_audit(docs, labels).collect()}
    want = slow_audit(ROWS, LABELS)
    assert len(want) == 4 * 600 and got == want
    assert filter_audit.filter_audit(docs.where("false"), labels).count() == 0
    alone = {tuple(r[:3]): list(r[3:]) for r in filter_audit.filter_audit(docs, labels.where("false"), orders=["EDCBA"]).collect()}
    assert {k: v[:4] for k, v in alone.items()} == {k: v[:4] for k, v in want.items() if k[1] == "EDCBA"} and not any(v[4] or v[5] for v in alone.values())


def test_zeta(spark):
    values = [3, 1, 4, 1, 5, 9, 2, 6]
    got = spark.range(1).select(filter_audit.zeta(F.array(*[F.lit(v) for v in values]), 3)).first()[0]
    assert got == [sum(v for t, v in enumerate(values) if t & s == t) for s in range(8)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "$", " ", "\t", "\x0b", "\x1c", "é", "　", "\x85", "😀"]), max_size=60), st.integers(1, 9))
def test_text_numbers_in_pieces(chars, limit):
    text = "".join(chars)
    assert b"".join(common.pieces(text.encode(), limit)) == text.encode()
    assert [w for p in common.pieces(text.encode(), limit) for w in p.split()] == text.encode().split()
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    assert filter_audit.text_numbers(text.encode()) == (len(w), len(set(w)), sum(c == "B" for c in text), len(text), text.count("$"))


def slow_row(text, buckets, ngram):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, ngram + 1) for i in range(len(w) - k + 1))


def slow_resample(rows, target, buckets=10_000, ngram=1, percent=10, least=20):
    counts = [slow_row(t, buckets, ngram) for _, t in rows]
    s, t = sum((c for _, c in counts), Counter()), sum((slow_row(x, buckets, ngram)[1] for x in target), Counter())
    a, b = s.total(), t.total()
    gain = {k: math.floor(1000 * math.log((t[k] + 1) * (a + buckets) / ((s[k] + 1) * (b + buckets)))) for k in range(buckets)}
    out = []
    for (d, _), (n_words, c) in zip(rows, counts, strict=True):
        weight = sum(n * gain[k] for k, n in c.items()) // c.total() if c else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n_words])
    fit = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], -1 if x[0] is None else x[0], x[1], x[2]))
    ranks = Counter()
    for place, x in enumerate(fit[: percent * len(fit) // 100], 1):
        ranks[tuple(x[:4]), place] += 1
    return sorted(map(repr, (tuple(x[:4]) for x in out))), sorted(map(repr, ranks))


def resampled(df):
    got = df.collect()
    return sorted(repr((r.doc_id, r.n_features, r.weight, r.score)) for r in got), sorted(repr(((r.doc_id, r.n_features, r.weight, r.score), r.rank)) for r in got if r["rank"])


@pytest.mark.parametrize("buckets,ngram,percent", [(10_000, 1, 10), (50, 3, 60), (7, 2, 100)])
def test_resampling(spark, sf_dir, docs, buckets, ngram, percent):
    pages = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").limit(60).collect()]
    rows = [(d, t) for d, t, _ in ROWS] + pages + pages[:9]  # repeated rows
    target = ["Alpha beta", None, "", "alpha  GAMMA 12"]
    target += [t[:300] for _, t in pages[:5] if t]
    mine = spark.createDataFrame([(*r, 0.5, 3) for r in rows], "doc_id bigint, text string, score double, rank int").repartition(5)
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = resampling.resample(mine, wanted, buckets, ngram, percent=percent)
    assert resampled(got) == slow_resample(rows, target, buckets, ngram, percent)
    assert resampling.resample(mine.where("false"), wanted).count() == 0
    flat = resampling.resample(docs, wanted.where("false")).collect()
    assert len(flat) == len(ROWS) and sum(r["rank"] is not None for r in flat) == sum(slow_row(t, 9, 1)[0] >= 20 for _, t, _ in ROWS) // 10


def test_csr_blocks(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 5))) for i in range(1300)]
    blocks = resampling.csr_blocks(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), 64).collect()
    assert len(blocks) == 3 and sum((b.doc_id for b in blocks), []) == [i for i, _ in rows]
    for b in blocks:
        assert b.starts[0] == 0 and b.starts[-1] == len(b.buckets) == len(b.counts) and len(b.starts) == len(b.doc_id) + 1
        for i, d in enumerate(b.doc_id):
            at = slice(b.starts[i], b.starts[i + 1])
            assert dict(zip(b.buckets[at], b.counts[at], strict=True)) == slow_row(rows[d][1], 64, 1)[1]
    sums = resampling.column_sums(spark.createDataFrame(blocks, resampling._BLOCKS), 64)
    assert np.array_equal(sums, [sum(slow_row(t, 64, 1)[1][k] for _, t in rows) for k in range(64)])


PAGES = [
    (1, "http://a.b/c d", "<p>x</p>"), (2, None, "<p>x</p>"), (2, "http://z", "<p>x</p>"), (2, "http://z", "<p>x</p>"), (3, "http://é/\r\nX: y", None), (None, "u", ""), (None, None, "only"), (None, None, "only"), (5, "", "\r\n\r\nWARC/1.1\r\n"),
    (6, "http://long", "ä" * 700_000), (-7, "http://minus", "Ab\0"), (8, "http://a", "ab\0"),
]


def slow_warc(rows, least=0):
    groups = defaultdict(list)
    for i, (p, _, h) in enumerate(rows):
        if len((h or "").encode()) >= least:
            groups[h or ""].append((p if p is not None else -(2**63), i))
    out = []
    for _, (p, _, h) in enumerate(rows):
        body = (h or "").encode()
        top = max(groups[h or ""])[0] if len(groups[h or ""]) else None
        out.append([p, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), top is not None and (p if p is not None else -(2**63)) != top, None if top in (None, -(2**63)) else top])
    tops = Counter()
    result = []
    for p, n, d, again, top in out:
        key = d
        if n >= least and not again:
            tops[key] += 1
            again = tops[key] > 1  # of rows that repeat the id one is the response
        result.append((p, n, d, "revisit" if again else "response", top if again else None))
    return sorted(map(repr, result))


@pytest.mark.parametrize("least,size", [(0, 10**9), (9, 1)])
def test_archives(spark, tmp_path, least, size):
    pages = spark.createDataFrame([(*r, "f", 1) for r in PAGES], "page_id bigint, url string, html string, record_type string, payload_bytes int").repartition(3)
    archives = warc.write_archives(pages, f"file://{tmp_path}", least, size)
    found = warc.read_archives(archives)
    got = sorted(repr(tuple(r)) for r in warc.pages_of(found).collect())
    assert got == slow_warc(PAGES, least)
    rows = found.collect()
    assert all(r.problem is None for r in rows) and warc.dangling(found).count() == 0
    held = {r.record_id: bytes(r.payload).decode() for r in rows if r.record_type == "response" and r.record_id != warc.record_id(2)}
    assert held[warc.record_id(6)] == PAGES[9][2] and held[warc.record_id(5)] == PAGES[8][2]
    assert {r.target_uri for r in rows} >= {"http://a.b/c%20d", "http://é/%0D%0AX:%20y", ""}
    if size == 1:
        assert archives.where("records = 1").count() == len(PAGES)
    listed = warc.archives_in(spark, str(tmp_path))
    assert warc.read_archives(listed, payload=False).where("payload is null").count() == len(PAGES)
    none = warc.write_archives(pages.where("false"), f"file://{tmp_path}/none")
    assert none.count() == 0 and warc.read_archives(none).count() == 0


def test_archives_of_a_table(spark, sf_dir, tmp_path):
    pages = table(spark, sf_dir, "pages")
    archives = warc.write_archives(pages, f"file://{tmp_path}")
    got = sorted(repr(tuple(r)) for r in warc.pages_of(warc.read_archives(archives)).collect())
    assert got == slow_warc([(r.page_id, r.url, r.html) for r in pages.collect()])
    store, path = pafs.FileSystem.from_uri(archives.first().path)
    data = store.open_input_file(path).read()
    assert struct.unpack("<I", data[:4])[0] == warc.SKIPPABLE  # a dictionary leads
    size = struct.unpack("<I", data[4:8])[0]
    raw = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    assert zstandard.ZstdCompressionDict(raw).dict_id() != 0


def archive(*frames, dictionary=b""):
    zip_ = zstandard.ZstdCompressor(write_checksum=True, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    return warc.dictionary_frame(dictionary) + b"".join(map(zip_.compress, frames))


def test_reader_reports_what_is_wrong():
    good = warc.record(1, "http://a", b"body")
    one = lambda data: list(warc.records(io.BytesIO(data)))
    assert [r["problem"] for r in one(archive(good, good))] == [None, None]
    cases = {
        "version": good.replace(b"WARC/1.1", b"WARC/9.9", 1), "no warc-date": good.replace(b"WARC-Date", b"X-Date"), "shorter": good.replace(b"Content-Length: 83", b"Content-Length: 99")[:-4],
        "end of the record": good + b"x", "digest": good.replace(b"body", b"BODY"), "no number": re.sub(rb"Content-Length: \d+\r\n\r\nHTTP", b"Content-Length: -1\r\n\r\nHTTP", good), "without a name": good.replace(b"WARC-Date: 2024-01-01T00:00:00Z", b"WARC-Date"),
        "HTTP head": re.sub(rb"(Content-Length: )4", rb"\g<1>5", good), "with a payload": good.replace(b"Type: response", b"Type: revisit"), "two": good + good,
    }
    for why, data in cases.items():
        (r,) = one(archive(data))
        assert r["problem"] and (why in r["problem"] or why in ("shorter", "two")), (why, r["problem"])
    whole = archive(good, good)
    assert [r["problem"] for r in one(whole[:-3])] == [None, "the last frame is cut off"]
    flipped = bytearray(archive(good))
    flipped[-2] ^= 1  # the checksum
    assert "cannot be decoded" in one(bytes(flipped))[0]["problem"]
    assert one(b"nonsense")[0]["problem"] == "bytes that are no frame" and one(b"") == []
    assert one(struct.pack("<II", warc.SKIPPABLE, 100) + b"x")[0]["problem"] == "a skippable frame is cut off"
    skip = struct.pack("<II", 0x184D2A50, 3) + b"abc"
    assert [r["problem"] for r in one(archive(good) + skip + archive(good))] == [None, None]


def test_dictionaries_plain_and_compressed():
    samples = [f"<html><body><h1>Title {i}</h1><p>Some text about {i * 7} things</p></body></html>".encode() for i in range(400)]
    dictionary = zstandard.train_dictionary(2000, samples).as_bytes()
    records = [warc.record(i, f"http://x/{i}", s) for i, s in enumerate(samples)]
    data = archive(*records, dictionary=dictionary)
    assert [r["payload"] for r in warc.records(io.BytesIO(data))] == samples
    lead = len(warc.dictionary_frame(dictionary))
    plain = struct.pack("<II", warc.SKIPPABLE, len(dictionary)) + dictionary + data[lead:]
    assert [r["payload"] for r in warc.records(io.BytesIO(plain))] == samples
    assert "cannot be decoded" in list(warc.records(io.BytesIO(data[lead:])))[0]["problem"]  # without its dictionary


def test_a_bad_record_ends_the_query(spark, tmp_path):
    (tmp_path / "x.warc.zst").write_bytes(archive(warc.record(1, "u", b"a").replace(b"WARC/1.1", b"WARC/7", 1)))
    found = warc.read_archives(warc.archives_in(spark, str(tmp_path)))
    assert found.first().problem == "no WARC version line"
    with pytest.raises(Exception, match="no WARC version line"):
        warc.pages_of(found).collect()


ODD_NAME = "a`b.c d"


def test_names_with_backticks(spark):
    rows = [(1, "one two three four five six", 1), (2, "One two three four five six", 2), (2, "One two three four five six", 2), (3, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, x int").withColumnRenamed("x", ODD_NAME)
    kept = exact_dedup.distinct_documents(docs)
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.collect()) == [2, 3]
    got = bpe.bpe_encode(docs, tokenizer_path("word_bpe_49k.json"), keep=("doc_id", ODD_NAME))
    assert sorted(r[1] for r in got.collect()) == [1, 2, 2, 3] and got.columns[1] == ODD_NAME


def test_only_letters_have_a_language(spark):
    model = language_id.BiGru(["de", "en"])
    rows = [(1, "½ ² ① 12_3"), (2, "ß"), (3, None), (4, ""), (5, "　…١"), (6, "中")]
    got = {r.doc_id: r.lang_pred for r in language_id.language_id(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()}
    assert {k for k, v in got.items() if v == "und"} == {1, 3, 4, 5}


def test_items_in_blocks_are_one_pass_each(spark, monkeypatch):
    """Blocks of a few words give what one block gives, and no block is fetched before the one before last is done."""
    items = [(i, " ".join(f"q{i}x{j}" for j in range(12))) for i in range(6)]
    rows = [(i, f"some words {t} and more") for i, t in items] + [(20, "clean text of other words"), (None, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, coverage string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    events, fetch, run = [], decontaminate.blocks, decontaminate._pass
    monkeypatch.setattr(decontaminate, "blocks", lambda *a: (events.append("block") or b for b in fetch(*a)))
    monkeypatch.setattr(decontaminate, "_pass", lambda *a: events.append("pass") or run(*a))
    got = sorted(map(repr, decontaminate.decontaminate(docs, bench, block_words=20).collect()))
    assert all(events[:k].count("block") - events[:k].count("pass") <= 2 for k in range(len(events)))
    assert got == sorted(map(repr, decontaminate.decontaminate(docs, bench).collect())) and sum("contaminated=True" in r for r in got) == 6


def test_scratch_must_be_shared(spark):
    root = common.scratch_root(spark)
    assert spark.sparkContext.applicationId in root

    class Elsewhere:
        conf = spark.conf

        class sparkContext:  # noqa: N801
            master, applicationId = "spark://host:7077", "app"

    if not spark.conf.get("spark.checkpoint.dir", ""):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.scratch_root(Elsewhere)


def test_last_stage_of_the_pipeline_equals_the_library(spark, sf_dir):
    import tokenizers

    library = tokenizers.Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    docs = table(spark, sf_dir, "documents").limit(40).unionByName(spark.createDataFrame([(-1, "", None, None, 0), (-2, "½ ÄÖ 中 \0", None, None, 4)], "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in corpus_pipeline.encoded(spark, docs, sf_dir).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_recall_of_near_copies_just_over_the_threshold(spark):
    """Pairs with a similarity of 0.80 to 0.85, by exact sets: at least 0.99 of them link, and nothing below 0.8 does."""
    import random

    r, rows, want = random.Random(11), [], {}
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    while len(want) < 250:
        w = [f"{r.choice('abcdefgh')}{r.randrange(4000)}" for _ in range(r.randrange(60, 160))]
        v = w[:]
        for _ in range(r.randrange(1, 4)):
            v[r.randrange(len(v))] = f"z{r.randrange(4000)}"
        a, b = shingles(w), shingles(v)
        similarity = len(a & b) / len(a | b)
        if 0.77 <= similarity < 0.85:
            k = len(rows)
            rows += [(k, " ".join(w)), (k + 1, " ".join(v))]
            if similarity >= 0.8:
                want[k] = similarity
    got = {x.doc_id: x.n_links for x in ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    found = sum(got[k] == got[k + 1] == 1 for k in want)
    print(f"recall at 0.80 to 0.85: {found} of {len(want)}")
    assert found >= 0.99 * len(want) and all(not got[k] for k in range(0, len(rows), 2) if k not in want)
