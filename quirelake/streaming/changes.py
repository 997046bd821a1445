"""The feed of annotation changes: when the annotations of an attachment have been quiet for a while, their content is told, if it differs from what was told last.

Events come in any order within the watermark's delay; each sets or removes one annotation of an attachment. The state of an attachment is its annotations, the events that are not settled yet and the
hash told last. Time is the events' own, so that a replay, in batches of any size and across restarts, tells the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: How long no event may come, in milliseconds, for a change to be told.
QUIET = 300
TOLD = "attachment bigint, at bigint, annotations int, hash string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def content_hash(annotations: dict[str, str]) -> str:
    """The MD5 of the annotations as lines `key=content`, by key."""
    return hashlib.md5("\n".join(f"{k}={v}" for k, v in sorted(annotations.items())).encode()).hexdigest()


class Feed(StatefulProcessor):
    """One attachment: pending events, annotations, and the hash told last. Each state is read and written whole, in one call a batch, and of the ends of bursts only the first has a timer."""

    def __init__(self, quiet: int = QUIET) -> None:
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "ms bigint, seq bigint, annotation string, content string")
        self.content = handle.getListState("content", "annotation string, content string")
        self.told = handle.getValueState("told", "hash string")

    def _ends(self, events: list[tuple]) -> Iterator[int]:
        """Which events, in order, end a burst: no other follows within the quiet time."""
        return (i for i, e in enumerate(events) if i + 1 == len(events) or events[i + 1][0] - e[0] >= self.quiet)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = sorted(((r.ms, r.seq, r.annotation, r.content) for r in rows), key=lambda x: x[:2])
        self.pending.appendList(new)
        # an end of all pending events is one of the new events, or was one before them, so none comes before the first of either
        self.handle.registerTimer(new[next(self._ends(new))][0] + self.quiet)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = timerValues.getCurrentWatermarkInMs()  # no event at or before it can come any more
        events = [(*k, *v) for k, v in sorted({tuple(e[:2]): tuple(e[2:]) for e in self.pending.get()}.items())]
        if not events:
            return iter([])
        every = list(self._ends(events))
        ends = [i for i in every if events[i][0] + self.quiet <= known]
        if len(ends) < len(every):
            self.handle.registerTimer(events[every[len(ends)]][0] + self.quiet)
        if not ends:
            return iter([])
        now = dict(tuple(e) for e in self.content.get())
        last, out, at = (self.told.get() or [None])[0], [], 0
        for end in ends:
            for _, _, annotation, content in events[at : end + 1]:
                if content is None:
                    now.pop(annotation, None)
                else:
                    now[annotation] = content
            at = end + 1
            h = content_hash(now)
            if h != last:
                out.append(Row(attachment=key[0], at=events[end][0], annotations=len(now), hash=h))
                last = h
        for state, left in ((self.pending, events[at:]), (self.content, list(now.items()))):
            if left:
                state.put(left)
            else:
                state.clear()
        if out:
            self.told.update((last,))
        return iter(out)

    def close(self) -> None:
        pass


def change_feed(events: DataFrame, quiet: int = QUIET, delay: str = "10 seconds") -> DataFrame:
    """A stream of events(attachment, annotation, time, seq, content) → TOLD: what is told, with the time (in ms) of the last event that it holds.

    seq orders events of one time, and is theirs alone within it; null content removes the annotation. delay is how late events may come. The state of an attachment lies in one task, in RocksDB (set
    spark.sql.streaming.stateStore.providerClass to STORE): what it costs there is its annotations and what has come since it was last quiet.
    """
    rows = events.withWatermark("time", delay).select("attachment", "annotation", "time", F.unix_millis("time").alias("ms"), "seq", "content")
    return rows.groupBy("attachment").transformWithState(statefulProcessor=Feed(quiet), outputStructType=TOLD, outputMode="Append", timeMode="EventTime")


def replayed(events: DataFrame, out: str, checkpoint: str, quiet: int = QUIET, delay: str = "10 seconds") -> None:
    """Run the feed over what is there, from its checkpoint on, into a Parquet folder; each emission is there once, whatever is repeated."""
    conf, name = events.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, STORE)
    try:
        change_feed(events, quiet, delay).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.unset(name) if before is None else conf.set(name, before)
