"""Stores that are written behind, the feed of annotation changes, and jobs over folders: against plain replays, crashes and restarts."""

import json
import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quirelake.sources import deltas, writers
from quirelake.streaming import changes, watch

KIND = "hash string, zh string, t bigint"


def rows(df):
    return sorted((r.hash, r.zh, r.t) for r in df.select("hash", "zh", "t").collect())


def merged(batches):
    """Newest wins; of equal t the earlier write, within a write the greatest row."""
    out = {}
    for batch in batches:
        best = {}
        for h, zh, t in batch:
            if h not in best or (t or 0, zh) > (best[h][1] or 0, best[h][0]):
                best[h] = (zh, t)
        for h, (zh, t) in best.items():
            if h not in out or (t or 0) > (out[h][1] or 0):
                out[h] = (zh, t)
    return sorted((h, zh, t) for h, (zh, t) in out.items())


def test_deltas_merge_on_read_and_compact_by_bucket(spark, tmp_path):
    root, r = str(tmp_path / "store"), random.Random(4)
    assert deltas.current(spark, root, ["hash"]) is None and deltas.compact(spark, root, ["hash"]) == []
    batches = [[(f"k{r.randrange(40)}", f"v{i}.{j}", r.choice([None, *range(5)])) for j in range(r.randrange(1, 30))] for i in range(7)]
    for i, batch in enumerate(batches):
        assert deltas.append_delta(spark.createDataFrame(batch, KIND), root, ["hash"], buckets=4)
        assert rows(deltas.current(spark, root, ["hash"])) == merged(batches[: i + 1])
        if i == 4:
            assert deltas.compact(spark, root, ["hash"], most=3) == [0, 1, 2, 3]
            assert rows(deltas.current(spark, root, ["hash"])) == merged(batches[: i + 1])
            assert deltas.sweep(spark, root) == 5 and rows(deltas.current(spark, root, ["hash"])) == merged(batches[: i + 1])
    assert deltas.append_delta(spark.createDataFrame([("z", "only", 1)], KIND), root, ["hash"], replace=True)
    assert rows(deltas.current(spark, root, ["hash"])) == [("z", "only", 1)]
    assert deltas.append_delta(spark.createDataFrame([("z", "", 2, True), ("y", "n", 1, False)], KIND + ", gone boolean"), root, ["hash"])
    assert rows(deltas.current(spark, root, ["hash"])) == [("y", "n", 1)]
    deltas.compact(spark, root, ["hash"], most=1)
    assert rows(deltas.current(spark, root, ["hash"])) == [("y", "n", 1)]


def test_a_write_costs_its_own_rows(spark, tmp_path):
    """The bytes of a small write do not grow with the store, and compaction leaves other buckets as they are."""
    root = tmp_path / "store"
    deltas.append_delta(spark.range(20_000).select(F.col("id").cast("string").alias("hash"), F.sha2(F.col("id").cast("string"), 256).alias("zh"), F.lit(1).cast("bigint").alias("t")), str(root), ["hash"], buckets=8)

    def parts():
        return {p: p.stat().st_size for p in root.glob("data/**/*.parquet")}

    before = parts()
    for t in (2, 3):
        deltas.append_delta(spark.createDataFrame([("5", "new", t)], KIND), str(root), ["hash"])
    new = {p: n for p, n in parts().items() if p not in before}
    assert len(new) == 2 and sum(new.values()) < sum(before.values()) / 50
    (bucket,) = {p.parent.name for p in new}
    assert len(deltas.compact(spark, str(root), ["hash"], most=2)) == 8  # each bucket of each delta counts until it is merged
    assert deltas.current(spark, str(root), ["hash"]).count() == 20_000
    assert {r.zh for r in deltas.current(spark, str(root), ["hash"]).where("hash = '5'").collect()} == {"new"} and bucket


def test_a_crash_before_the_pointer_loses_and_doubles_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    one = lambda k, t: spark.createDataFrame([(k, f"{k}{t}", t)], KIND)
    assert deltas.append_delta(one("a", 1), root, ["hash"], writer="w", batch=0)
    real = deltas.publish
    monkeypatch.setattr(deltas, "publish", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        deltas.append_delta(one("b", 1), root, ["hash"], writer="w", batch=1)
    monkeypatch.setattr(deltas, "publish", real)
    assert rows(deltas.current(spark, root, ["hash"])) == [("a", "a1", 1)]
    assert deltas.append_delta(one("b", 1), root, ["hash"], writer="w", batch=1)
    assert not deltas.append_delta(one("b", 9), root, ["hash"], writer="w", batch=1)  # the batch runs again after its pointer was made
    assert rows(deltas.current(spark, root, ["hash"])) == [("a", "a1", 1), ("b", "b1", 1)]
    assert deltas.sweep(spark, root) == 1


def test_writers_that_meet_lose_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    one = lambda k: spark.createDataFrame([(k, k, 1)], KIND)
    deltas.append_delta(one("a"), root, ["hash"], buckets=2)
    real, met = deltas.publish, []

    def late(*args):
        if not met:
            met.append(1)
            deltas.append_delta(one("other"), root, ["hash"])
        return real(*args)

    monkeypatch.setattr(deltas, "publish", late)
    deltas.append_delta(one("mine"), root, ["hash"])
    assert rows(deltas.current(spark, root, ["hash"])) == [(k, k, 1) for k in ("a", "mine", "other")]
    met.clear()
    assert deltas.compact(spark, root, ["hash"], most=1) == [0, 1]
    met.append(1)
    assert rows(deltas.current(spark, root, ["hash"])) == [(k, k, 1) for k in ("a", "mine", "other")]
    assert not writers.publish(spark, root, 1, "{}")  # a pointer is made once


def test_what_nobody_reads_of_a_store_is_not_shuffled(spark, tmp_path):
    """Keys and small columns of a store are read without its texts, and what is to be built meets what is built without another shuffle of texts."""
    from quirelake.sources import parses

    root = str(tmp_path / "store")
    rows = spark.createDataFrame([(i, "p", f"s{i}", "long text", 1) for i in range(20)], "attachment bigint, provider string, pdf_sha string, content string, completed_at bigint")
    parses.store_parses(rows, root, 2)
    parses.store_parses(rows.where("attachment < 5").withColumn("content", F.lit("new")).withColumn("completed_at", F.lit(2).cast("bigint")), root)
    now = parses.parses(spark, root)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by(content" in plan(now) and "max_by(content" not in plan(now.select("attachment", "parse_key"))
    built = now.select("attachment", "parse_key").where("attachment > 2")
    assert sorted(r.attachment for r in parses.to_build(built, now).collect()) == [0, 1, 2]
    assert sorted((r.attachment, r.content) for r in now.where("attachment in (1, 9)").collect()) == [(1, "new"), (9, "long text")]


# ---- the feed of changes -------------------------------------------------------

EVENTS = "attachment bigint, annotation string, time timestamp, seq bigint, content string"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def plain_feed(events, quiet, known):
    """What the feed must tell of (attachment, annotation, ms, seq, content) once all events up to known are there."""
    out = []
    for a in sorted({e[0] for e in events}):
        mine = sorted((e for e in events if e[0] == a), key=lambda e: e[2:4])
        now, last = {}, None
        for e, after in zip(mine, [*mine[1:], None], strict=True):
            if e[4] is None:
                now.pop(e[1], None)
            else:
                now[e[1]] = e[4]
            if e[2] + quiet <= known and (after is None or after[2] - e[2] >= quiet):
                h = changes.content_hash(now)
                if h != last:
                    out.append((a, e[2], len(now), h))
                last = h
    return out


def some_events(n, seed):
    r, ms, out = random.Random(seed), 0, []
    for seq in range(n):
        ms += r.choice([0, 10, 100, 299, 300, 301, 2000])
        out.append((r.choice([1, 1, 1, 2, 3]), f"n{r.randrange(4)}", ms, seq, r.choice([None, "x", "y"])))
    return out


def write_feed(spark, events, folder):
    frame = spark.createDataFrame([(a, n, START + timedelta(milliseconds=ms), s, c) for a, n, ms, s, c in events], EVENTS)
    frame.coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("cuts", [[120], [30, 31, 75, 120]])
def test_change_feed_equals_a_plain_replay_across_restarts(spark, tmp_path, cuts):
    events, at = some_events(120, 7), int(START.timestamp() * 1000)
    box, out, cp = (str(tmp_path / x) for x in ("box", "out", "cp"))
    done = 0
    for cut in cuts:  # every run is a new query on the old checkpoint
        part = events[done:cut]
        random.Random(cut).shuffle(part)
        write_feed(spark, part, box)
        changes.replayed(spark.readStream.schema(EVENTS).parquet(box), out, cp, 300, "1 seconds")
        done = cut
        got = sorted(tuple(r) for r in spark.read.schema(changes.TOLD).parquet(out).collect())
        want = [(a, at + ms, n, h) for a, ms, n, h in plain_feed(events[:cut], 300, max(e[2] for e in events[:cut]) - 1000)]
        assert got == sorted(want)
    changes.replayed(spark.readStream.schema(EVENTS).parquet(box), out, cp, 300, "1 seconds")  # nothing new
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == got
    assert len(got) > 20 and len(got) < sum(1 for _ in events)


def test_events_out_of_order_within_the_delay(spark, tmp_path):
    events = [(1, "a", 0, 0, "x"), (1, "b", 700, 1, "y"), (1, "a", 250, 2, "z"), (2, "c", 5000, 3, "q"), (1, "d", 9000, 4, "w")]
    box, out, cp = (str(tmp_path / x) for x in ("box", "out", "cp"))
    for e in events:
        write_feed(spark, [e], box)
        changes.replayed(spark.readStream.schema(EVENTS).parquet(box), out, cp, 300, "2 seconds")
    at = int(START.timestamp() * 1000)
    got = sorted((r.attachment, r.at - at, r.annotations, r.hash) for r in spark.read.parquet(out).collect())
    assert got == plain_feed(events, 300, 7000) and [g[1] for g in got] == [250, 700, 5000]


class Counted:
    """The states and timers of one attachment in memory, and how often they are called."""

    def __init__(self):
        self.calls, self.timers, self.rows = 0, set(), {}

    def getListState(self, name, schema):  # noqa: N802
        return State(self, name)

    getMapState = getValueState = getListState  # noqa: N815

    def registerTimer(self, ms):  # noqa: N802
        self.calls += 1
        self.timers.add(ms)


class State:
    def __init__(self, handle, name):
        self.handle, self.name = handle, name
        handle.rows[name] = []

    def __getattr__(self, call):
        def run(*args):
            self.handle.calls += 1
            held = self.handle.rows[self.name]
            if call == "get":
                return iter(held) if self.name != "told" else held or None
            self.handle.rows[self.name] = [] if call == "clear" else held + args[0] if call == "appendList" else args[0]

        return run


def test_the_feed_takes_few_calls_however_many_events(spark):
    """One attachment with 400 events in 200 bursts: some ten calls to its state, and what is told equals a plain replay."""
    from types import SimpleNamespace

    from pyspark.sql import Row

    events = [(1, f"n{i % 3}", 1000 * (i // 2), i, "xyz"[i % 7 % 3] if i % 5 else None) for i in range(400)]
    handle, feed, got = Counted(), changes.Feed(300), []
    feed.init(handle)
    feed.handleInputRows((1,), iter([Row(ms=e[2], seq=e[3], annotation=e[1], content=e[4]) for e in events]), None)
    for known in (50_300, 199_300):
        assert min(handle.timers) <= known
        handle.timers = {t for t in handle.timers if t > known}
        got += [tuple(r) for r in feed.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda known=known: known), None)]
    assert got == plain_feed(events, 300, 199_300) and handle.calls < 20 and handle.rows["pending"] == []


# ---- jobs over a folder --------------------------------------------------------


@pytest.fixture
def job(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    source = spark.createDataFrame([(f"u{i}", f"Sentence {i}.", False) for i in range(6)], "unit_id string, en string, math boolean")
    root = str(tmp_path / "job")
    watch.start_job(source.where("unit_id <> 'u5'"), root)
    return box, root, source


def state(spark, root, source):
    return watch.job_state(spark, root, source).first().asDict()


def test_job_is_stopped_killed_and_taken_up_again(spark, job, monkeypatch):
    box, root, source = job
    run = lambda: watch.ended(watch.resume_job(spark, str(box), root, source, every=None, files_at_once=1))
    for i in range(3):
        (box / f"{i}.json").write_text(json.dumps({f"u{i}": f"译{i}", "u5": "not asked for"}))
    assert state(spark, root, source) == {"todo": 5, "delivered": 0, "bad": 0, "stopped": False, "finished": False}
    # killed in the second batch, after its rows are there and before the stream knows
    real, calls = watch.compact, Counter()

    def killed(*a, **k):
        calls["n"] += 1
        if calls["n"] == 2:
            raise MemoryError("killed")
        return real(*a, **k)

    monkeypatch.setattr(watch, "compact", killed)
    with pytest.raises(Exception, match="killed"):
        run()
    monkeypatch.setattr(watch, "compact", real)
    watch.stop_job(spark, root)
    query = watch.watch_folder(spark, str(box), source, root, f"{root}/checkpoint", None, 1)
    assert watch.ended(query) == "stopped" and state(spark, root, source)["stopped"]
    assert run() == "done"
    (box / "3.json").write_text(json.dumps({"u3": "译3", "u4": "", "u1": "later"}))
    assert run() == "done"
    got = {r.unit_id: r.zh for r in watch.folder_results(spark, root, watch.expected_of(spark, root, source)).where("problem is null").collect()}
    assert got == {"u0": "译0", "u1": "later", "u2": "译2", "u3": "译3"}
    assert state(spark, root, source) == {"todo": 5, "delivered": 4, "bad": 1, "stopped": False, "finished": False}
    (box / "4.json").write_text(json.dumps({"u4": "译4"}))
    assert run() == "done" and state(spark, root, source)["finished"]


def test_job_refuses_another_source(spark, job):
    box, root, source = job
    other = source.withColumn("unit_id", F.concat(F.lit("m"), "unit_id"))
    assert watch.resume_job(spark, str(box), root, other, every=None) is None
    assert state(spark, root, other) == {"todo": 0, "delivered": 0, "bad": 0, "stopped": False, "finished": False}
