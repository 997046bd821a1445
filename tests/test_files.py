"""Task folders, archives, part chains, places on pages, one-shot requests and parses: odd inputs, failures on the way, and plain versions."""

import json
import random
import zipfile
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirelake.operators import geometry as G
from quirelake.operators import once
from quirelake.operators import protocol as P
from quirelake.operators import tasks as K
from quirelake.operators import views as V
from quirelake.plans.derived_queries import sentence_lines
from quirelake.sources import archives as A
from quirelake.sources import files, folders, parses
from quirelake.sources import readers as R
from quirelake.sources.tables import scratch

# ---- task folders -------------------------------------------------------------


def rows_of(spark, root):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.units, r.task, r.job) for r in spark.read.format("taskfolders").load(root).collect())


@pytest.fixture
def tasks(spark):
    spark.dataSource.register(folders.TaskFolders)
    return lambda ids: spark.createDataFrame([(i, f'{{"u": "é{i}"}}', f"# task\n{i}", "{}") for i in ids], folders.SCHEMA).repartition(3)


def test_task_folders_come_back(spark, tmp_path, tasks):
    root = str(tmp_path / "tasks")
    tasks([3, 1, -2]).write.format("taskfolders").mode("append").save(root)
    assert [r[0] for r in rows_of(spark, root)] == [-2, 1, 3] and rows_of(spark, root)[2] == (3, '{"u": "é3"}', "# task\n3", "{}")
    tasks([None, 7]).write.format("taskfolders").mode("append").save(root)
    assert [r[0] for r in rows_of(spark, root)] == [-2, -1, 1, 3, 7]
    tasks([9]).write.format("taskfolders").mode("overwrite").save(root)
    assert [r[0] for r in rows_of(spark, root)] == [9]
    assert sorted(p.name for p in Path(root).glob("job-*/*/9/*")) == ["TASK.md", "job.json", "units.json"]
    tasks([9]).where("false").write.format("taskfolders").mode("overwrite").save(root)
    assert rows_of(spark, root) == [] and not list(Path(root).iterdir())


def test_a_failed_write_leaves_no_folder(spark, tmp_path, tasks):
    root = str(tmp_path / "tasks")
    tasks([1]).write.format("taskfolders").mode("append").save(root)
    bad = tasks(range(20)).withColumn("task", F.when(F.col("doc_id") == 13, F.raise_error(F.lit("no task"))).otherwise(F.col("task")))
    with pytest.raises(Exception, match="no task"):
        bad.write.format("taskfolders").mode("append").save(root)
    assert [r[0] for r in rows_of(spark, root)] == [1]
    assert all(p.name.startswith("job-") for p in Path(root).iterdir())


def test_lost_attempts_are_dropped_at_commit(tmp_path):
    writer = folders.FolderWriter(str(tmp_path), False)
    row = lambda i: type("R", (dict,), {"doc_id": i})({"units": "{}", "task": "t", "job": "{}"})
    lost, kept = writer.write(iter([row(1)])), writer.write(iter([row(1), row(2)]))
    assert lost.documents == 1 and not [p for p in tmp_path.iterdir() if not p.name.startswith(".")]
    writer.commit([kept, None])
    assert sorted(p.name for p in tmp_path.glob("*/*/*")) == ["1", "2"]

    def broken():
        yield row(5)
        raise MemoryError

    other = folders.FolderWriter(str(tmp_path), False)
    with pytest.raises(MemoryError):
        other.write(broken())
    assert not list(tmp_path.glob(".staging*/*"))
    other.abort([])
    assert sorted(p.name for p in tmp_path.glob("*/*/*")) == ["1", "2"] and not list(tmp_path.glob(".*"))


def test_tasks_that_outlive_their_write_leave_nothing(tmp_path):
    row = lambda i: type("R", (dict,), {"doc_id": i})({"units": "{}", "task": "t", "job": "{}"})

    def outlived(writer, end):
        yield row(1)
        end(writer)
        yield row(2)

    for end in (lambda w: w.abort([]), lambda w: w.commit([None])):
        writer = folders.FolderWriter(str(tmp_path), False)
        with pytest.raises(OSError):
            writer.write(outlived(writer, end))
        with pytest.raises(OSError):
            writer.write(iter([row(3)]))
        assert not list(tmp_path.iterdir())


def test_texts_of_task_folders_are_shuffled_once(spark):
    """Odd rows too: blocks without an order or twice there, sentences without a block, other types of orders. All of it goes by document in one shuffle."""
    blocks = [(1, None, "x", "heading", 1, "X"), (1, 0, "a", "paragraph", None, "A"), (1, 2, "b", "heading", 1, "B"), (1, 2, "b2", "paragraph", 1, "B2"), (1, 3, "c", "heading", 2, "C"), (1, 4, "d", "heading", 1, None), (1, 5, "e", "paragraph", 1, "E"), (2, 0, "a", None, 1, "A"), (None, 0, "a", "heading", 1, "A"), (3, 0, "a", "heading", 1, "A")]
    units = [(1, 5, 1, "e:1", "e1", "z"), (1, 5, 0, "e:0", "e0", None), (1, 0, 0, "a:0", None, None), (1, 2, 0, "b:0", "b", None), (1, 3, 0, "c:0", "c", "z"), (1, 9, 0, "n:0", "n", None), (1, None, 0, "x:0", "x", None), (2, 0, 0, "a:0", "$a$", None), (None, 0, 0, "a:0", "a", None), (4, 0, 0, "a:0", "a", None)]
    left = spark.createDataFrame(blocks, "doc_id int, ord int, block_id string, kind string, level int, text string").repartition(3)
    right = spark.createDataFrame(units, "doc_id bigint, ord bigint, idx int, unit_id string, text string, zh string").repartition(3)
    out = V.sections(left, right)
    assert dict(out.dtypes)["doc_id"] == "int" and dict(out.dtypes)["paragraphs"].startswith("array<struct<ord:int,block:string,kind:string,units:array<struct<id:string,en:string,zh:string>>>>")
    got = {(r.doc_id, r.section_no): (r.heading, [(p.ord, p.block, p.kind, [tuple(u) for u in p.units]) for p in r.paragraphs]) for r in out.collect()}
    end = [(5, "e", "paragraph", [("e:0", "e0", None), ("e:1", "e1", "z")])]
    b = [(2, "b", "heading", [("b:0", "b", None)]), (2, "b2", "paragraph", [("b:0", "b", None)])]
    apart = {(1, 1): ("X", [(0, "a", "paragraph", [("a:0", None, None)]), b[1]]), (1, 2): ("B", [b[0], (3, "c", "heading", [("c:0", "c", "z")])])}  # which of two blocks of one order is first is open
    joined = {(1, 1): ("X", [(0, "a", "paragraph", [("a:0", None, None)])]), (1, 2): ("B", [*b, (3, "c", "heading", [("c:0", "c", "z")])])}
    rest = {(1, 3): ("B", end), (2, 0): ("(front matter)", [(0, "a", None, [("a:0", "$a$", None)])])}
    assert got in (apart | rest, joined | rest)
    plan = K.task_folders(V.sections(left.withColumn("doc_id", F.col("doc_id").cast("bigint")), right), "r")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


# ---- archives -----------------------------------------------------------------


def test_the_right_list_is_picked(spark, tmp_path):
    def archive(name, entries):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for k, v in entries:
                z.writestr(k, v)

    one = json.dumps([{"type": "text", "text": "é one", "page_idx": 2}, {"type": "table", "table_caption": ["T"]}])
    archive("a.zip", [("content_list.json", "[]"), ("x/y_content_list.json", one), ("x/y_content_list_v2.json", "{}"), ("xcontent_list.json", "no")])
    archive("b.zip", [("b_content_list_v2.json", "[]"), ("content_list.json.txt", "[]")])
    archive("c.zip", [])
    archive("e.zip", [("content_list.json", b"\xff\xfe")])
    (tmp_path / "d.zip").write_bytes(b"no archive")
    (tmp_path / "f.txt").write_text("x")
    entries = A.zip_entries(A.archives_in(spark, str(tmp_path)))
    got = {r.path.rsplit("/", 1)[1]: (r.entry, r.problem is not None) for r in A.picked(entries).collect()}
    assert got == {"a.zip": ("x/y_content_list.json", False), "b.zip": (None, False), "c.zip": (None, False), "d.zip": (None, True), "e.zip": ("content_list.json", False)}
    texts = A.zip_texts(A.picked(entries), at_once=1)
    assert {r.path.rsplit("/", 1)[1]: (r.value, r.problem is not None) for r in texts.collect()} == {"a.zip": (one, False), "e.zip": (None, True)}
    items = [(r.ord, r.type, r.text, r.page_idx, r.table_caption) for r in A.content_items(texts).orderBy("ord").collect()]
    assert items == [(0, "text", "é one", 2, None), (1, "table", None, None, ["T"])]


def test_many_small_archives_take_few_tasks_and_batches(spark, tmp_path):
    rows = spark.range(2500).selectExpr("cast(id as string) as name", "array(struct('content_list.json' as entry, concat('[', id, ']') as value)) as entries").repartition(2)
    made = scratch(A.write_zips(rows, f"file://{tmp_path}/zips"), "archives")
    entries = scratch(A.zip_entries(made), "entries")
    texts = A.zip_texts(A.picked(entries))
    assert texts.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    got = texts.join(made, "path").select("name", "value", "problem").collect()
    assert sorted((int(r.name), r.value, r.problem) for r in got) == [(n, f"[{n}]", None) for n in range(2500)]
    assert A.reading_tasks(rows, 10**6, 4) == 1000 and A.reading_tasks(rows, 3, 4) == 1
    table = pa.table({"path": made.toPandas()["path"], "entry": ["content_list.json"] * 2500})
    sizes = [b.num_rows for b in A._read(iter(table.to_batches()))]
    assert sum(sizes) == 2500 and max(sizes) == A.BATCH_ROWS and len(sizes) == 3


# ---- part chains -----------------------------------------------------------------


def plain_chains(heads, link):
    out = []
    for doc, head in heads:
        seen, at = {}, head
        while (doc, at) in link and at not in seen:
            seen[at] = len(seen)
            at = link[doc, at]
        out += [(doc, head, n, k) for k, n in seen.items()]
    return sorted(out)


def chains(spark, heads, link):
    nodes = spark.createDataFrame([(d, k, False, v) for (d, k), v in link.items()], "doc_id int, key string, is_text boolean, next_part string")
    found = R.part_chains(spark.createDataFrame(heads, "doc_id int, key string"), nodes)
    return sorted((r.doc_id, r.head, r.hop, r.key) for r in found.collect())


def test_part_chains_equal_plain_walks(spark):
    r, link = random.Random(3), {}
    for doc in range(3):
        for k in range(30):
            link[doc, str(k)] = r.choice([None, "", "gone", str(r.randrange(30)), str(k + 1), str(k + 1)])
    heads = [(d, str(k)) for d in range(3) for k in range(0, 30, 3)]
    assert chains(spark, heads, link) == plain_chains(heads, link)


def test_a_chain_of_a_hundred_thousand_parts(spark):
    n = 100_000
    nodes = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").cast("string").alias("key"), F.lit(False).alias("is_text"), (F.col("id") + 1).cast("string").alias("next_part"))
    found = R.part_chains(spark.createDataFrame([(1, "0"), (1, "99990")], "doc_id int, key string"), nodes)
    assert found.where("head = '0' and hop = cast(key as int)").count() == n and found.count() == n + 10


# ---- places on pages ----------------------------------------------------------------


def plain_offset(doc, block, start, segments, nodes):
    """The rules once more, character by character."""
    chars = {k: [c[0] for c in G.decoded(m)] for k, (_, m) in nodes[doc].items()}
    mine = sorted((s for s in segments if s[:2] == (doc, block)), key=lambda s: s[3])
    solid = lambda t: sum(not c.isspace() for c in t)
    boxes = []
    for _, _, key, at, node_start, length in mine:
        text = nodes[doc][key][0]
        first = max(start - at, 0)
        if first < length:
            boxes += chars[key][solid(text[: node_start + first]) : solid(text[: node_start + length])]
    if not boxes:
        return 0
    page, before, order = boxes[0], {}, 0
    seen = {}
    for key in nodes[doc]:
        for p in set(chars[key]):
            before[key, p] = seen.get(p, 0)
        for p in chars[key]:
            seen[p] = seen.get(p, 0) + 1
    for _, _, key, at, node_start, length in mine:
        if start >= at + length:
            continue
        order = node_start + max(0, start - at)
        if (key, page) not in before:
            return 0
        return before[key, page] + sum(p == page for p in chars[key][: solid(nodes[doc][key][0][:order])])
    return 0


def test_page_offsets_equal_a_plain_count(spark):
    r, nodes, segments, places = random.Random(5), {}, [], []
    for doc in range(4):
        nodes[doc] = {}
        for k in range(8):
            text = "".join(r.choice("ab c") for _ in range(r.randrange(0, 9)))
            n = sum(not c.isspace() for c in text)
            cut = r.randrange(0, n + 1)
            runs = [[0, p, 0, 0, 9, 9, *[1] * m] for p, m in ((r.randrange(2), cut), (r.randrange(3), n - cut)) if m]
            nodes[doc][f"{k}"] = (text, json.dumps(runs) if r.random() < 0.85 else None)
        keys = list(nodes[doc])
        for b in range(4):
            at = 0
            for key in keys[2 * b : 2 * b + 2]:
                text = nodes[doc][key][0]
                start = r.randrange(0, len(text) + 1)
                length = r.randrange(0, len(text) - start + 1)
                segments.append((doc, f"b{b}", key, at, start, length))
                at += length + r.randrange(2)
            places += [(doc, f"b{b}", x) for x in range(at + 2)]
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    got = G.position_offsets(
        frame(places, "doc_id int, block_id string, start int"), frame(segments, "doc_id int, block_id string, node_key string, start int, node_start int, length int"),
        frame([(d, i, k, t, m) for d, x in nodes.items() for i, (k, (t, m)) in enumerate(x.items())], "doc_id int, ord int, node_key string, text string, text_map string"),
    )
    have = {(x.doc_id, x.block_id, x.start): x.offset for x in got.collect()}
    assert have == {p: plain_offset(*p, segments, nodes) for p in places} and max(have.values()) > 5


# ---- requests that are made once -------------------------------------------------------


def test_each_document_is_asked_for_once(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()

    def engine(prompt):
        import uuid

        (log / uuid.uuid4().hex).write_text(prompt)
        if prompt == "p2":
            raise OSError("down")
        return '{"terms": []}' if prompt == "p3" else f'{{"terms": [{{"en": "{prompt}", "zh": "甲"}}]}}'

    docs = spark.createDataFrame([(i, f"p{i}") for i in range(6)] + [(None, "p9")], "doc_id int, prompt string")
    stored = spark.createDataFrame([(0, "have = 有"), (1, "")], "doc_id int, glossary string")
    root = f"file://{tmp_path}/run1"
    runs = [{r.doc_id: (r.glossary, r.asked, r.error is not None) for r in once.glossaries_once(docs, stored, engine, root).collect()} for _ in range(3)]
    assert runs[0] == {1: ("p1 = 甲", True, False), 2: (None, True, True), 3: (None, True, False), 4: ("p4 = 甲", True, False), 5: ("p5 = 甲", True, False), None: ("p9 = 甲", True, False)}
    assert runs[1] == runs[2] == {k: (g, False, e) for k, (g, _, e) in runs[0].items()}
    assert sorted(p.read_text() for p in log.iterdir()) == ["p1", "p2", "p3", "p4", "p5", "p9"]
    again = once.glossaries_once(docs, stored, engine, f"file://{tmp_path}/run2").where("asked").count()  # another opening asks again
    assert again == 6 and len(list(log.iterdir())) == 12


def test_a_task_that_runs_again_does_not_ask_again(spark, tmp_path):
    """The claim of an attempt that was lost before its answer stands."""
    docs = spark.createDataFrame([(1, "p1")], "doc_id bigint, prompt string")
    store, root = folders.opened(f"file://{tmp_path}/c")
    import hashlib

    name = hashlib.sha256(b"1").hexdigest()
    store.create_dir(f"{root}/{name[:2]}")
    assert once.claimed(store, f"{root}/{name[:2]}/{name}.claim") and not once.claimed(store, f"{root}/{name[:2]}/{name}.claim")
    (r,) = once.ask_once(docs, lambda p: 1 / 0, f"file://{tmp_path}/c").collect()
    assert (r.response, r.asked) == (None, False) and "before" in r.error


def test_self_test_of_engines(spark):
    def down(prompt):
        raise TimeoutError("no route")

    P.register_engine("good", P.mock_engine)
    P.register_engine("down", down)
    P.register_engine("mute", lambda prompt: "?")
    try:
        got = {r.engine: (r.zh is not None, r.problem) for r in once.self_test(spark, ["good", "down", "mute", "none"]).collect()}
    finally:
        for n in ("good", "down", "mute"):
            P.unregister_engine(n)
    assert got["good"] == (True, None) and got["down"] == (False, "no route") and got["none"] == (False, "no such engine") and got["mute"][0] is False


# ---- parses ------------------------------------------------------------------------------


def test_a_new_parse_makes_only_its_own_stale(spark, tmp_path):
    root, kind = str(tmp_path / "p"), "attachment string, provider string, pdf_sha string, content string, completed_at bigint"
    assert parses.parses(spark, root) is None
    put = lambda *rows: parses.store_parses(spark.createDataFrame([(a, "p", s, c, t) for a, s, c, t in rows], kind), root)
    put(("a", "1", "x", 1), ("b", "1", "x", 1), ("c", None, None, 1))
    built = parses.parses(spark, root).select("attachment", "parse_key", F.lit(1).alias("v"))
    built.write.parquet(f"{root}/built")
    built = spark.read.parquet(f"{root}/built")
    put(("a", "1", "x", 2), ("b", "1", "y", 2), ("d", "2", "z", 2), ("c", "9", "late", 0))  # a the same, b another, d new, c an older one
    now, asked = parses.parses(spark, root), []

    def build(lacking):
        asked.extend(sorted(r.attachment for r in lacking.collect()))
        return lacking.select("attachment", "parse_key", F.lit(2).alias("v"))

    assert [r.attachment for r in parses.stale(built, now).collect()] == ["b"]
    assert sorted((r.attachment, r.v) for r in parses.refreshed(built, now, build).collect()) == [("a", 1), ("b", 2), ("c", 1), ("d", 2)] and asked == ["b", "d"]


# ---- many small files -------------------------------------------------------------


def test_files_are_written_listed_and_read_in_tasks(spark, tmp_path):
    import hashlib

    rows = spark.range(500).selectExpr("concat('a b%20', id, '.txt') as name", "if(id = 7, '', concat('é', id)) as value").repartition(3)
    assert files.write_files(rows, str(tmp_path / "x")) == 500
    folders_ = list((tmp_path / "x").glob("*/*"))
    assert len(folders_) <= 3 and not list((tmp_path / "x").glob(".staging*"))  # no folder a file
    (folders_[0] / "_hidden").write_text("no")
    (folders_[0] / "sub").mkdir()
    (folders_[0] / "sub" / "deep.txt").write_text("deep")
    listed = {r.path.rsplit("/", 1)[1]: r.size for r in R.listed(spark, str(tmp_path / "x")).collect()}
    want = {f"a b%20{i}.txt": "" if i == 7 else f"é{i}" for i in range(500)}
    assert listed == {k: len(v.encode()) for k, v in want.items()} | {"deep.txt": 4}
    hashes = R.file_hashes(spark, str(tmp_path / "x"))
    assert {r.path.rsplit("/", 1)[1]: r.sha for r in hashes.collect()} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}  # a folder that is no key=value is not gone into
    texts = files.texts(spark, f"{tmp_path}/x/job=*/task=*")
    assert {r.path.rsplit("/", 1)[1]: r.value for r in texts.collect()} == want | {"deep.txt": "deep"}
    found = R.listed(spark, f"{folders_[0]}/sub/deep.txt").collect()
    assert [(r.path, r.modified.timestamp() > 0) for r in found] == [(f"file:{folders_[0]}/sub/deep.txt", True)]
    with pytest.raises(FileNotFoundError):
        R.listed(spark, str(tmp_path / "none"))


def test_a_failed_write_of_files_shows_none(spark, tmp_path):
    rows = spark.range(10).selectExpr("concat('f', id) as name", "if(id = 9, raise_error('x'), 'v') as value").repartition(2)
    with pytest.raises(Exception, match="x"):
        files.write_files(rows, str(tmp_path / "y"))
    (tmp_path / "y").mkdir(exist_ok=True)
    assert R.listed(spark, str(tmp_path / "y")).count() == 0


def test_json_files_of_objects_lists_and_nonsense(spark, tmp_path):
    for name, text in (("a.json", '{"spec": "a", "requests": 1}'), ("b.json", ' [{"spec": "b"},\n {"spec": "c"}]'), ("c.json", "bad"), ("d.json", "")):
        (tmp_path / name).write_text(text)
    got = sorted((r.path.rsplit("/", 1)[1], r.spec or "", r.requests or 0) for r in files.json_rows(spark, str(tmp_path), "spec: string, requests: int").collect())
    assert got == [("a.json", "a", 1), ("b.json", "b", 0), ("b.json", "c", 0), ("c.json", "", 0), ("d.json", "", 0)]


def test_text_maps_as_columns_equal_one_at_a_time():
    r = random.Random(5)
    maps = [None, "", "bad", "{}", "[1, [2]]", "[[0,1,0,0,9,9]]", "[[1,1,0,0,9,9]]", "[[0,1,0,0,9,9,1,[2,3],NaN,1]]", "[[3,2,0,0,9,9,0.1,0.2,[0.3,0.7]],[0,3,1,1,2,2,5]]", '[["0",1,0,0,9,9,1]]', "[[0,1,0,0,9,9,Infinity,1]]"]
    for _ in range(200):
        maps.append(json.dumps([[r.randrange(8), r.randrange(4), *[r.uniform(0, 9) for _ in range(4)], *[r.choice([r.uniform(0, 3), r.randrange(4), [r.uniform(-1, 1), r.uniform(0, 2)]]) for _ in range(r.randrange(9))]] for _ in range(r.randrange(4))]))
    for m in maps:
        assert list(zip(*[c.tolist() for c in G.decoded_columns(m)], strict=True)) == [(p, *map(float, c)) for p, *c in G.decoded(m)], m


def test_decoded_boxes_leave_in_bounded_batches():
    long = json.dumps([[0, 0, 0, 0, 1, 1, *[1] * 30_000]])
    sizes = [len(a.flatten()) for a in G._in_batches(G.decoded_columns(long) for _ in range(20))]
    assert sum(sizes) == 600_000 and max(sizes) <= G.BATCH_BOXES + 30_000


def test_sentences_keep_text_maps_until_their_lines(spark):
    nodes = spark.createDataFrame([(1, "a", "ab cd", "[[0,0,0,0,4,10,1,1,1,1]]"), (1, "b", "ef", "[[0,0,4,0,6,10,1,1]]"), (1, "c", "gh", None), (1, "d", "ij", "[]")], "doc_id bigint, node_key string, text string, text_map string")
    segments = spark.createDataFrame([(1, "x", "b", 5, 0, 2), (1, "x", "a", 0, 0, 5), (1, "x", "c", 7, 0, 2), (1, "y", "d", 0, 0, 2)], "doc_id bigint, block_id string, node_key string, start int, node_start int, length int")
    units = spark.createDataFrame([(1, "x", "x:0", 3, 9), (1, "x", "x:1", 2, 3), (1, "x", "x:2", 7, 9), (1, "y", "y:0", 0, 2)], "doc_id bigint, block_id string, unit_id string, start int, end int")
    out = G.sentence_boxes(units, segments, nodes)
    assert {r.unit_id: [tuple(x) for x in r.lines] for r in out.collect()} == {"x:0": [(0, 2.0, 0.0, 6.0, 10.0)], "x:1": []}  # white space has a place, but no box
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "decode_text_map" not in plan  # no box is shuffled


def test_sentences_are_merged_once(spark, sf_dir):
    """Also where their lines are exploded, which looks for empty ones first."""
    plan = sentence_lines(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Generate posexplode" in plan


PARTS = pa.list_(pa.struct([("seg_start", pa.int32()), ("text_map", pa.string()), ("before", pa.int32()), ("n", pa.int32())]))


def test_sentences_of_one_line_are_merged_together(monkeypatch):
    """No character of theirs is looked at alone, and no text map is read alone."""
    maps = [f"[[{i % 2},{i // 5},{i},2,{i + 90},12,[2,1]{',1' * 89}]]" for i in range(40)]
    rows = [[(0, m, k, 45)] for m in maps for k in (0, 45)]
    for name in ("lines_of", "decoded", "decoded_columns"):
        monkeypatch.setattr(G, name, None)
    got = [x for b in G.merge_parts.func(iter([pa.array(rows, PARTS)])) for x in b.to_pylist()]
    assert [tuple(x.values()) for (x,) in got] == [(i // 5, i + 2.0 + k, 2.0, i + 2.0 + k + 45 - (k > 0 and i % 2), 12.0) for i in range(40) for k in (0, 45)]


def test_sentences_merged_together_equal_those_one_at_a_time(monkeypatch):
    r = random.Random(6)
    odd = ["", "bad", "[]", "[1,[2]]", "[[0,1,0,0,9,9]]", "[[1,0,0,0,9,9,3]]", "[[0,1,0,0,9,9,1,[2,3],NaN,1]]", "[[0,1,0,0,9,Infinity,1]]", "[[0,1,0,0,9,9,1e400,2]]", "[[0,1,0,0,9,9,1e308,1e308,1]]", "[[0,1,0,0,9,9,01]]", "[[0,1,0,0,9,9,1]]\n", "[[0,1,0,0,9,9,1]]x", '[["0",1,0,0,9,9,1]]', "[[0,1,0,0,9,9,true]]"]

    def width():
        return r.choice([1, 1, 1, 0.1, r.uniform(-1, 3), [r.choice([0, 40, r.uniform(-9, 9)]), r.uniform(0, 2)]])

    def run():
        return [r.choice([0, 0, 1, 2, 5]), r.randrange(2), r.uniform(0, 9), r.choice([0, 3, 10]), r.uniform(0, 99), r.choice([10, 10, 13, 3]), *[width() for _ in range(r.choice([1, 2, 60]))]]

    def text_map():
        return r.choice(odd) if r.random() < 0.1 else json.dumps([run() for _ in range(r.randrange(1, 4))], separators=r.choice([(",", ":"), (",", ":"), (", ", ": ")]))

    def plain(parts):
        found = sorted((start, c[before : before + n]) for start, m, before, n in parts if (c := [(p, *map(float, x)) for p, *x in G.decoded(m)]))
        return G.lines_of([c for _, chars in found for c in chars]) if found else None

    rows = [[(r.choice([9 * i, -i, 0]), text_map(), r.choice([0, 0, 4, 99]), r.choice([0, 3, 50, 500])) for i in range(r.choice([1, 1, 2, 3]))] for _ in range(1500)]
    want = [[(-1, None)] if x is None else x for x in map(plain, rows)]
    for size in (1, 3000, 250_000):
        monkeypatch.setattr(G, "MAP_BYTES", size)
        got = [[tuple(y.values()) for y in x] for b in G.merge_parts.func(iter([pa.array(rows, PARTS)])) for x in b.to_pylist()]
        assert [[(-1, None)] if [y[0] for y in x] == [-1] else x for x in got] == want
    assert list(G.merge_parts.func(iter([pa.array([], PARTS)]))) == []


def test_lines_of_columns_equal_those_of_characters():
    r = random.Random(9)
    for _ in range(300):
        chars = []
        for _ in range(r.randrange(1, 5)):
            page, x, y, h = r.randrange(2), r.uniform(-20, 20), r.choice([0, 1, 2.5]), r.choice([1, 2, 0, -1])
            for _ in range(r.choice([1, 40, 150])):
                chars.append((page, x, y, x + 0.5, y + h))
                x += r.choice([1, 1, 1, 1, -30, 40, -1])
        assert G.merged_lines(G._boxes(chars)) == G.lines_of(chars)


def test_units_under_annotations_of_two_pages_once_and_in_blocks(spark, monkeypatch):
    rect = "array<struct<page:int,x1:double,y1:double,x2:double,y2:double>>"
    r = random.Random(8)

    def boxes(page, n):
        return [(page, x := r.uniform(0, 9), y := r.uniform(0, 9), x + r.uniform(0, 5), y + r.uniform(0, 5)) for _ in range(n)]

    units = [(d, f"u{i}", boxes(i % 3, 2) + boxes(i % 3 + 1, r.randrange(3))) for d in range(2) for i in range(40)] + [(0, "none", [])]
    notes = [(i, i % 2, i % 4, boxes(i % 4, 2), boxes(i % 4 + 1, 2) if i % 3 else None) for i in range(30)] + [(3, 1, 2, boxes(2, 1), None)]
    cut = lambda a, b: max(0.0, min(a[3], b[3]) - max(a[1], b[1])) * max(0.0, min(a[4], b[4]) - max(a[2], b[2]))
    want = set()
    for a, d, _, _, _ in notes:
        quads = [(p, q) for b, e, page, now, then in notes if (b, e) == (a, d) for p, qs in ((page, now), (page + 1, then or [])) for q in qs]
        for doc, u, ls in units:
            for page in {x[0] for x in ls} if doc == d else ():
                here = [x for x in ls if x[0] == page]
                total = sum((x[3] - x[1]) * (x[4] - x[2]) for x in here)
                if total > 0 and sum(cut(x, q) for x in here for p, q in quads if p == page) / total >= 0.3:
                    want.add((a, d, u))
    left = spark.createDataFrame(units, f"doc_id bigint, unit_id string, lines {rect}")
    right = spark.createDataFrame(notes, f"annotation_id bigint, doc_id bigint, page int, rects {rect}, next_rects {rect}")
    for size in (10_000, 3):
        monkeypatch.setattr(G, "UNITS_AT_ONCE", size)
        out = G.units_under(left, right)
        assert sorted(tuple(x) for x in out.collect()) == sorted(want) and len(want) > 50
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")  # nothing is grouped after the pairs have met


def test_part_chains_broadcast_nothing(spark, monkeypatch):
    seen = []
    from quirelake.sources import tables

    def noted(df, name, write=tables.scratch):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(tables, "scratch", noted)
    link = {(0, str(k)): str(k + 1) for k in range(20)}
    assert chains(spark, [(0, "0")], link) == plain_chains([(0, "0")], link)
    assert seen and not any("BroadcastHashJoin" in p for p in seen)


def test_trees_are_read_once(spark):
    """What the blocks of structured text need of its trees is read on the walk; the plan that is left joins parts once, with their texts and boxes together."""
    tree = '{"catalog":{"outline":[{"ref":[0]}]},"content":[{"type":"heading","content":[{"text":"A"}]},{"type":"paragraph","content":[]}]}'
    out = R.sdt_blocks(spark.sql(f"select 1 as doc_id, parse_json('{tree}') as doc"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 3
    assert [(r.kind, r.level, r.text, r.segments and len(r.segments)) for r in out.orderBy("ord").collect()] == [("heading", 1, "A", 1), ("paragraph", None, "", None)]
