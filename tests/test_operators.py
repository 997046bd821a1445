"""Operators against sequential models, under any partitioning, and on empty input."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.operators import align, blocks as B, geometry as G, protocol as P, store as S, tasks as K, views as V
from quirelake.schemas import BLOCKS
from quirelake.streaming import watch


def blocks_of(spark, rows):
    return spark.createDataFrame([(1, i, f"b{i}", k, None, r, t, False, []) for i, (k, r, t) in enumerate(rows)], BLOCKS)


def joined(rows, only=False):
    """Join open paragraphs one after another, as a reader would."""
    out, at = [], None
    for i, (k, r, t) in enumerate(rows):
        if k in ("image", "table", "caption") or r == "footnote":
            out.append([i, t])
            continue
        if at is not None and k == "paragraph" and r is None and (not only or t.lstrip()[:1].islower()):
            left = at[1]
            at[1] += ("" if left[-1:] in (" ", "-") else " ") + t
        else:
            at = [i, t]
            out.append(at)
        tail = at[1].rstrip()
        ends = tail[-1:] in tuple(".?!:;") or (tail[-1:] in tuple("\"')]") and tail[-2:-1] in tuple(".?!:;"))
        if k != "paragraph" or r is not None or ends:
            at = None
    return sorted(map(tuple, out))


@pytest.mark.parametrize("only", [False, True])
def test_split_paragraphs(spark, only):
    rng = random.Random(5)
    frames, want = [], []
    for d in range(60):
        rows = [(rng.choice(["paragraph"] * 4 + ["heading", "caption", "image"]), rng.choice([None] * 5 + ["footnote"]), rng.choice(["open end", "Closed end.", "x-", 'said."', "Upper open", "tail "])) for _ in range(rng.randint(1, 9))]
        rows = [(k, r if k == "paragraph" else None, t) for k, r, t in rows]
        frames += [(d, i, f"b{i}", k, None, r, t, False, []) for i, (k, r, t) in enumerate(rows)]
        want += [(d, *x) for x in joined(rows, only)]
    df = spark.createDataFrame(frames, BLOCKS)
    for n in (1, 3, 8):
        got = B.merge_split_paragraphs(df.repartition(n), only).select("doc_id", "ord", "text").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_packing(spark):
    rng = random.Random(6)
    rows, want = [], []
    for d in range(40):
        chars = units = batch = 0
        for o in range(rng.randint(1, 12)):
            c, u = rng.randint(0, 60), rng.randint(0, 3)
            rows.append((d, o, c, u))
            if not u:
                continue
            if units and (chars + c > 100 or units + u > 5):
                chars = units = 0
                batch += 1
            chars, units = chars + c, units + u
            want.append((d, o, batch))
    got = P.pack(spark.createDataFrame(rows, "doc_id int, ord bigint, chars int, units int").repartition(5), ["doc_id"], 100, 5).collect()
    assert sorted(map(tuple, got)) == want


def test_alignment_recovers_a_text():
    """Blocks in another order, with other white space: every sentence is found whole."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9)))
    base, other, want = [], [], []
    for b in range(6):
        parts = [" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(3)]
        places, wide, at, there = [], [], 0, 0
        for i, p in enumerate(parts):
            places.append((at, at + len(p)))
            wide.append((there, there + len(p) + 1))
            want.append((f"m{b}:{i}", 0, f"b{b}:{i}", f"b{b}", *places[-1]))
            at, there = at + len(p) + 1, there + len(p) + 2
        base.append((f"b{b}", " ".join(parts), places))
        other.insert(0, (f"m{b}", " ".join(p.replace(" ", "  ", 1) for p in parts), wide))
    found = align.aligned(base, other)
    assert sorted(r for r in found if r[1] >= 0) == sorted(want)
    assert sorted((r[0], r[2]) for r in found if r[1] < 0) == sorted((w[0], w[2]) for w in want)


def test_alignment_of_a_document_from_its_parts(spark):
    """Sentences of ever other cuts: a sentence of the other parse spans those parts of base's sentences that hold its letters, formulas apart; what has none takes the gap between its neighbours."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("klmnopqrst") for _ in range(rng.randint(4, 9)))
    for _ in range(40):
        words = [word() for _ in range(60)]
        text, starts = "", []
        for w in words:
            starts.append(len(text))
            text += w + " "
        cut = lambda: [0, *sorted(rng.sample(range(6, 55, 7), rng.randint(1, 5))), 60]
        ours, theirs = cut(), cut()
        place = lambda a, z: (starts[a], starts[z - 1] + len(words[z - 1]))
        base = [("b", text, [place(a, z) for a, z in zip(ours, ours[1:], strict=False)])]
        other = [("m", text, [place(a, z) for a, z in zip(theirs, theirs[1:], strict=False)])]
        want = set()
        for k, (a, z) in enumerate(zip(theirs, theirs[1:], strict=False)):
            shared = [(u, max(a, x), min(z, y)) for u, (x, y) in enumerate(zip(ours, ours[1:], strict=False)) if max(a, x) < min(z, y)]
            want |= {(f"m:{k}", f"b:{u}", *place(x, y)) for u, x, y in shared}
        assert {(r[0], r[2], r[4], r[5]) for r in align.aligned(base, other) if r[1] >= 0} == want
    formula = "$a+b$ $c$"
    both = [("b", "Alpha beta gamma delta. x y z. Epsilon zeta eta theta.", [(0, 23), (24, 30), (31, 54)])], [("m", f"Alpha beta gamma delta. {formula} Epsilon zeta eta theta.", [(0, 23), (24, 33), (34, 57)])]
    assert [r for r in align.aligned(*both) if r[0] == "m:1"] == [("m:1", 0, "b:1", "b", 24, 30)]


def test_alignment_in_spark_equals_the_kernel(spark):
    rows = [(d, o, f"b{o}", "heading" if o == 0 else "paragraph", f"Words of part {d} {o} stand here alone. And more of {o}{d} follows them.") for d in (1, None) for o in range(3)]
    frame = spark.createDataFrame(rows, "doc_id bigint, ord bigint, block_id string, kind string, text string")
    other = frame.where("ord <> 1").withColumn("block_id", F.concat(F.lit("m"), "ord"))
    got = sorted(tuple(r)[1:] for r in align.align_blocks(frame, other).where("doc_id = 1").collect())
    cut = lambda name, text, kind: (name, text, [(0, len(text))] if kind == "heading" else T.sentence_ranges(text))
    kernel = align.aligned([cut(b, t, k) for d, _, b, k, t in rows if d == 1], [cut(f"m{o}", t, k) for d, o, _, k, t in rows if d == 1 and o != 1])
    assert got == sorted(kernel) and len(got) > 5
    assert align.align_blocks(frame, other).where("doc_id is null").count() > 5 and align.align_blocks(frame, other.where("false")).count() == 0


def test_alignment_runs_over_sorted_partitions(spark):
    """Documents share batches of rows: none costs a group of its own, and both parses come in one shuffle."""
    frame = spark.createDataFrame([(1, 0, "b0", "paragraph", "Some words of a text.")], "doc_id bigint, ord bigint, block_id string, kind string, text string")
    plan = align.align_blocks(frame, frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroups" not in plan and plan.count("RepartitionByExpression") == 1


def test_matched_equals_single_anchors():
    """Anchors one after another, each grown a character at a time."""
    rng = random.Random(11)
    for _ in range(300):
        s = [rng.randrange(rng.choice((2, 36))) for _ in range(rng.randint(0, 60))]
        m = s[rng.randint(0, 9) :] + s[: rng.randint(0, 30)] + [rng.randrange(3) for _ in range(rng.randint(0, 9))]
        runs = [[tuple(x[i : i + 3]) for i in range(len(x) - 2)] for x in (m, s)]
        to, back = [-1] * len(m), [-1] * len(s)
        for a, run in enumerate(runs[0]):
            if runs[0].count(run) != 1 or runs[1].count(run) != 1:
                continue
            b = runs[1].index(run)
            if to[a] >= 0 or back[b] >= 0:
                continue
            for step, x, y in ((-1, a - 1, b - 1), (1, a, b)):
                while 0 <= x < len(m) and 0 <= y < len(s) and m[x] == s[y] and to[x] < 0 and back[y] < 0:
                    to[x], back[y], x, y = y, x, x + step, y + step
        assert align.matched(np.array(m, np.int64), np.array(s, np.int64), 3).tolist() == to


def test_lines():
    line = [(0, float(x), 10.0, float(x + 5), 20.0) for x in (0, 6, 12)]
    assert G.lines_of([*line, (0, 100.0, 10.0, 105.0, 20.0), (1, 0.0, 0.0, 5.0, 5.0), (0, 18.0, 11.0, 22.0, 20.0)]) == [(0, 0.0, 10.0, 22.0, 20.0), (0, 100.0, 10.0, 105.0, 20.0), (1, 0.0, 0.0, 5.0, 5.0)]
    assert G.decoded("[[6,0,0,0,10,10,2,[1,2]]]") == [(0, 0, 0, 10, 2), (0, 0, 3, 10, 5)]


def test_boxes_are_matched_as_by_plain_loops(spark, monkeypatch):
    """Many equal scores, several rectangles a block, and pages whose items meet in small blocks: the first rectangle and item of the largest score count. Pairs are in no window."""
    monkeypatch.setattr(G, "ITEMS_AT_ONCE", 3)
    rng = random.Random(5)
    box = lambda: (rng.randrange(2), *(float(x) for x in (lambda x, y: (x, y, x + rng.choice((10, 20)), y + 10))(10 * rng.randrange(4), 10 * rng.randrange(3))))
    blocks = [(d, o, f"b{o}", rng.choice(("math", "table", "paragraph")), "short", [box() for _ in range(rng.randint(0, 3))]) for d in range(3) for o in range(15)]
    items = [(d, o, rng.choice(("table", "equation")), box()) for d in range(3) for o in range(20)]

    def score(a, b):
        w, h = min(a[3], b[3]) - max(a[1], b[1]), min(a[4], b[4]) - max(a[2], b[2])
        return max(w, 0) * max(h, 0) / min((r[3] - r[1]) * (r[4] - r[2]) for r in (a, b)) if a[0] == b[0] else 0.0

    top = {}
    for d, o, name, kind, _, rects in blocks:
        pairs = [(-score(a, b), k, io) for k, a in enumerate(rects) for e, io, ik, b in items if e == d and ik == ("table" if kind == "table" else "equation") and score(a, b) > 0]
        if pairs:
            top[d, o] = (min(pairs), name, kind)
    owner, want = {}, []
    for (d, _), ((s, _, io), name, kind) in sorted(top.items()):
        if kind != "paragraph" and -s >= 0.5:
            owner.setdefault((d, io), name)
    for (d, _), ((s, _, io), name, kind) in top.items():
        o = owner.get((d, io))
        if kind != "paragraph" and -s >= 0.5 or kind == "paragraph" and -s >= 0.8 and o:
            want.append((d, name, io if o == name else None, None if o == name else o))
    rect = "struct<page:int,x1:double,y1:double,x2:double,y2:double>"
    out = G.match_boxes(spark.createDataFrame(blocks, f"doc_id bigint, ord bigint, block_id string, kind string, text string, rects array<{rect}>"), spark.createDataFrame(items, f"doc_id bigint, ord bigint, kind string, rect {rect}"))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr) and len(want) > 20
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1


def test_policies_differ(spark):
    kind = "hash string, zh string, t bigint"
    mine, theirs = spark.createDataFrame([("a", "1", 5), ("b", "1", 5), ("c", "1", 5)], kind), spark.createDataFrame([("a", "2", 6), ("b", "2", 5), ("d", "2", None)], kind)
    newest = {r.hash: r.zh for r in S.newest_wins(mine, theirs, ["hash"]).collect()}
    kept = {r.hash: r.zh for r in S.existing_wins(mine, theirs, ["hash"]).collect()}
    assert newest == {"a": "2", "b": "1", "c": "1", "d": "2"} and kept == {"a": "1", "b": "1", "c": "1", "d": "2"}
    assert S.cleared(mine).count() == 0


def test_empty_input(spark):
    none = spark.createDataFrame([], BLOCKS)
    for step in (B.mark_references, B.mark_front_matter, B.merge_drop_caps, B.merge_split_paragraphs, B.to_sentences, V.section_titles):
        assert step(none).count() == 0


def test_retries_ask_only_for_what_is_missing(spark):
    import json

    def forgetful(prompt):
        payload = json.loads(prompt[prompt.index("\n{") + 1 :])
        units = [u for p in payload["paragraphs"] for u in p["units"]]
        return json.dumps({"translations": [{"id": u["id"], "zh": "好" + u["id"]} for u in units[:2]]})

    rows = spark.createDataFrame([(1, f"b:{i}", "paragraph", f"Text {i}.", "whole", 7, False) for i in range(7)], "batch int, unit_id string, kind string, en string, full_text string, total_units int, math boolean")
    got = {r.unit_id: r.attempt for r in P.run_batches(rows, forgetful, retries=2, parallel=2).collect()}
    assert sorted(x for x in got.values() if x) == [1, 1, 2, 2, 3, 3] and list(got.values()).count(None) == 1


def test_folder_stream(spark, tmp_path):
    box, root = tmp_path / "box", str(tmp_path / "store")
    box.mkdir()
    expected = spark.createDataFrame([("u1", "One.", False), ("u2", "Two.", False)], "unit_id string, en string, math boolean")

    def step():
        watch.watch_folder(spark, str(box), expected, root, str(tmp_path / "cp"), every=None).awaitTermination()
        now = watch.folder_results(spark, root, expected)
        return {r.unit_id: r.zh for r in now.collect()} if now is not None else {}

    (box / "1.json").write_text('{"u1": "一", "x": "?"}')
    assert step() == {"u1": "一"}
    (box / "2.json").write_text('{"translations": [{"id": "u1", "zh": "壹"}, {"id": "u2", "zh": "二"}]}')
    (box / "3.json").write_text('{"half')
    assert step() == {"u1": "壹", "u2": "二"}


def test_log_stream_drops_old_generations(spark, tmp_path):
    from quirelake.sources.deltas import sweep

    kind = "hash string, zh string, engine string, prompt string, glossary string, t bigint, generation int"
    log, root = str(tmp_path / "log"), str(tmp_path / "store")
    for part in ([("a", "1", "", "", "", 1, 1), ("a", "2", "", "", "", 2, 1), ("b", "x", "", "", "", 9, 0)], [("a", "0", "", "", "", 1, 1), ("c", "3", "", "", "", 1, 1)]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(log)
        watch.watch_log(spark.readStream.schema(kind).parquet(log), root, str(tmp_path / "cp"), 1, every=None).awaitTermination()
    assert {r.hash: r.zh for r in watch.logged(spark, root).collect()} == {"a": "2", "c": "3"}
    sweep(spark, root)
    assert watch.logged(spark, root).count() == 2


def test_sources(spark, tmp_path):
    import hashlib
    import json

    from quirelake.operators.store import META
    from quirelake.sources import readers as R

    pdf = b"%PDF x"
    sha = hashlib.sha256(pdf).hexdigest()
    for key, state in (("K1", {"status": "complete", "pdfSha256": sha}), ("K2", {"status": "failed"}), ("K3", {"pdfSha256": "other"})):
        (tmp_path / key / "raw").mkdir(parents=True)
        (tmp_path / key / "parse.json").write_text(json.dumps(state))
        (tmp_path / key / "raw" / "content_list.json").write_text(json.dumps([{"type": "text", "text": "T", "page_idx": 0, "bbox": [1, 2, 3, 4]}, {"type": "list", "list_items": ["a"]}]))
    (tmp_path / "a.pdf").write_bytes(pdf)
    items = R.content_lists(spark, str(tmp_path))
    assert {(r.key, r.ord, r.type) for r in items.collect()} == {(k, o, t) for k in ("K1", "K3") for o, t in ((0, "text"), (1, "list"))}
    assert {r.key for r in R.content_lists(spark, str(tmp_path), strict=True).collect()} == {"K1"}
    hashes = R.file_hashes(spark, str(tmp_path / "a.pdf"))
    assert {r.key for r in items.join(hashes, "sha", "left_semi").collect()} == {"K1"}
    (tmp_path / "cache").mkdir()
    unit = {"zh": "一", "engine": "e", "prompt": "p4", "glossary": "", "t": 5}
    (tmp_path / "cache" / "1-K1.json").write_text(json.dumps({"version": 1, "libraryID": 1, "attachmentKey": "K1", "units": {"h1": unit}}))
    (tmp_path / "cache" / "1-K2.json").write_text(json.dumps({"version": 2, "units": {"h2": unit}}))
    assert [(r.attachment, r.hash, *[r[c] for c in META]) for r in R.caches(spark, str(tmp_path / "cache")).collect()] == [("K1", "h1", "一", "e", "p4", "", 5)]
    (tmp_path / "sdt").mkdir()
    (tmp_path / "sdt" / "x.json").write_text('{"content": []}')
    (tmp_path / "sdt" / "y.bin").write_text("packed")
    assert R.structured_text(spark, str(tmp_path / "sdt")).count() == 1
    assert R.listed(spark, str(tmp_path / "K1")).count() == 2


def test_models_runs_and_text_runs(spark, tmp_path):
    import json

    from quirelake.functions import text as T
    from quirelake.operators import tasks as K
    from quirelake.sources import readers as R

    rows = [("g", '{"models":{"a":{"info":{"id":"m1","name":"One","reasoning_efforts":[{"value":"low"}]}},"b":{"info":{"id":"m2","hidden":true}}}}'), ("c", '{"models":[{"slug":"s1","visibility":"list","description":"d"},{"slug":"s2","visibility":"hide"}]}'), ("x", "bad")]
    got = {(r.tool, r.model, r.label, tuple(r.efforts or ())) for r in R.tool_models(spark.createDataFrame(rows, "tool string, value string")).collect()}
    assert got == {("g", "m1", "One", ("low",)), ("c", "s1", "s1 · d", ())}
    (tmp_path / "r.json").write_text(json.dumps({"spec": "e:m", "seconds": 2.0, "requests": 1, "translations": {"u1": {"en": "a", "zh": None}}}))
    (tmp_path / "blind-key.json").write_text(json.dumps({"u1": {"A": "e:m"}}))
    assert [tuple(r) for r in R.bench_runs(spark, str(tmp_path)).collect()] == [("e:m", 2.0, 1, "u1", "a", None)]
    assert [tuple(r) for r in R.blind_key(spark, str(tmp_path / "blind-key.json")).collect()] == [("u1", "A", "e:m")]
    runs = spark.createDataFrame([("a $x$ b$y$",), ("$z$",), ("no",), ("$$",)], "t string").select(T.rich_runs(F.col("t"))).collect()
    assert [[(x.math, x.text) for x in r[0]] for r in runs] == [[(False, "a "), (True, "x"), (False, " b"), (True, "y")], [(True, "z")], [(False, "no")], [(False, "$$")]]
    text = spark.range(1).select(K.task_text(F.lit("/d"), F.lit(3), F.lit(True), F.lit(True), F.lit("a = b"))).first()[0]
    assert "/d" in text and "3 others" in text and "a = b" in text and "dollar" in text
    assert K.merged_settings({"a": 1, "b": 2}, {"a": None, "b": 3}, {"c": 4}) == {"a": 1, "b": 3, "c": 4} and K.free_id(["p1", "p3"]) == "p4"


def test_snapshot_survives_a_crash_at_any_step_and_loses_no_other_writer(spark, tmp_path, monkeypatch):
    from quirelake.sources import writers

    root, kind = str(tmp_path / "store"), "hash string, zh string, engine string, prompt string, glossary string, t bigint"
    row = lambda k, t: spark.createDataFrame([(k, "z", "", "", "", t)], kind)
    assert writers.snapshot(spark, root) is None
    writers.merge_store(row("a", 1), root)
    (tmp_path / "store" / ".v-half").write_text("v-half")  # a crash before the rename leaves a table and a hidden file
    assert [r.hash for r in writers.snapshot(spark, root).collect()] == ["a"]
    writers.merge_store(row("b", 1), root)
    assert sorted(r.hash for r in writers.snapshot(spark, root).collect()) == ["a", "b"]
    with pytest.raises(RuntimeError):
        writers.write_snapshot(row("c", 1), root, after=1)  # what was read is not the newest any more
    assert sorted(r.hash for r in writers.snapshot(spark, root).collect()) == ["a", "b"]
    writers.vacuum(spark, root)
    assert sorted(r.hash for r in writers.snapshot(spark, root).collect()) == ["a", "b"]
    writers.merge_store(row("c", 1), root)
    assert writers.snapshot(spark, root).count() == 3


def test_annotations_skip_what_they_cannot_place(spark):
    raw = [
        (1, "highlight", '{"pageIndex": 2, "rects": [[1, 2, 3, 4.5]]}'), (2, "underline", '{"pageIndex": 0, "rects": []}'), (3, "ink", '{"pageIndex": 0, "rects": []}'), (4, "highlight", None),
        (5, "highlight", ""), (6, "highlight", "{"), (7, "highlight", '{"pageIndex": "1", "rects": []}'), (8, "highlight", '{"pageIndex": 1, "rects": null}'), (9, None, '{"pageIndex": 1, "rects": []}'), (10, "highlight", "null"),
    ]
    frame = spark.createDataFrame([(i, t, "c", None, "t", None, p) for i, t, p in raw], "annotation_id int, type string, color string, comment string, text string, page_label string, position string")
    assert {r.annotation_id: (r.page, r.rects) for r in K.annotations(frame).collect()} == {1: (2, [[1.0, 2.0, 3.0, 4.5]]), 2: (0, [])}


def test_busy_paragraphs_end_with_their_answers_or_the_run(spark):
    waiting = spark.createDataFrame([("a", "a:0"), ("a", "a:1"), ("b", "b:0")], "block_id string, unit_id string")
    answered = spark.createDataFrame([("a:0",), ("b:0",), ("c:0",)], "unit_id string")
    assert [tuple(r) for r in K.still_busy(waiting, answered).collect()] == [("a", 1)]
    assert K.still_busy(waiting, answered, running=False).count() == 0


def test_selected_units_need_a_covered_character(spark):
    blocks = spark.createDataFrame([(1, 0, "One.  Two."), (1, 1, ""), (1, 2, "Three.")], "doc_id int, ord int, text string")
    spans = spark.createDataFrame([(1, 0, "x:0", 0, 6), (1, 0, "x:1", 6, 10), (1, 1, "y:0", 0, 0), (1, 2, "z:0", 0, 6)], "doc_id int, ord int, unit_id string, start int, end int")
    # the first takes only spaces of x:0; the second has no length; the third runs backwards
    picks = spark.createDataFrame([(1, 0, 0, 4, 2, 1), (1, 1, 0, 2, 0, 2), (1, 2, 2, 0, 0, 3)], "doc_id int, sel_id int, from_ord int, from_at int, to_ord int, to_at int")
    assert sorted(tuple(r) for r in V.selected_units(picks, spans, blocks).collect()) == [(1, 0, "x:1"), (1, 0, "z:0")]


def test_clearing_by_scope(spark):
    store = spark.createDataFrame([(h, h, "e", "p4", "", 1) for h in "abc"], "hash string, zh string, engine string, prompt string, glossary string, t int")
    groups = spark.createDataFrame([("g", "a"), ("g", "b")], "grp string, hash string")
    active = spark.createDataFrame([("a",), ("a",)], "hash string")
    assert [r.hash for r in S.cleared(store, active, groups).collect()] == ["c"]
    assert S.cleared(store, active.where("false"), groups).count() == 3
