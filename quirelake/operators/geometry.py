"""Boxes: matching, character positions, lines, and what lies under an annotation."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import reduce
from itertools import islice, pairwise
from operator import and_, itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.schemas import RECTS_TYPE, RUNS_TYPE


def area(r: Column) -> Column:
    """Of a rectangle; 0 where it is inside out."""
    return F.greatest(F.lit(0.0), r["x2"] - r["x1"]) * F.greatest(F.lit(0.0), r["y2"] - r["y1"])


def common_area(a: Column, b: Column) -> Column:
    """Of what two rectangles share."""
    return F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])) * F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))


def overlap(a: Column, b: Column) -> Column:
    """The shared area as a share of the smaller rectangle; 0 without one."""
    both = common_area(a, b)
    return F.when(both > 0, both / F.least(area(a), area(b))).otherwise(0.0)


def match_boxes(blocks: DataFrame, items: DataFrame, least: float = 0.5, fragment: float = 0.8, fragment_chars: int = 60) -> DataFrame:
    """Attach content items to blocks by overlap on a page: doc_id, block_id, item_ord, covered_by.

    blocks(doc_id, ord, block_id, kind, text, rects) and items(doc_id, ord, kind 'equation' | 'table', rect) share their coordinates. A formula block takes the equation,
    a table or image block the table of the largest overlap of at least `least`; the first block to take an item owns it, later ones are covered
    by the owner. Short text that lies in an owned equation is covered too. The join is by document and page, where items meet in blocks of about ITEMS_AT_ONCE. Pairs are judged where they meet, and
    neither kept, sorted nor shuffled: the first time they give each rectangle's largest score, the second time the first item that reaches it.
    """
    want = F.when(F.col("kind").isin("table", "image"), "table").otherwise("equation")
    rects = blocks.where(F.col("kind").isin("math", "table", "image") | (F.length("text") <= fragment_chars)).select(
        "doc_id", F.col("ord").alias("block_ord"), "block_id", F.col("kind").alias("block_kind"), want.alias("item_kind"), F.posexplode("rects").alias("rect_ord", "a")
    )
    rects = rects.withColumn("page", F.col("a.page"))
    things = items.select("doc_id", F.col("ord").alias("item_ord"), F.col("kind").alias("item_kind"), F.col("rect").alias("b"), F.col("rect.page").alias("page"))
    place, rect = ["doc_id", "page", "item_kind"], ["doc_id", "block_id", "block_ord", "block_kind", "rect_ord"]
    parts = things.groupBy(*place).agg(F.ceil(F.count("*") / ITEMS_AT_ONCE).cast("int").alias("parts"))
    dealt = things.join(parts, place).withColumn("part", F.pmod(F.xxhash64("item_ord"), "parts").cast("int")).drop("parts").hint("merge")
    body = F.col("block_kind").isin("math", "table", "image")

    def scored(some: DataFrame) -> DataFrame:
        spread = some.join(parts, place).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        enough = F.col("score") >= F.when(body, least).otherwise(fragment)  # what is below counts nowhere
        return spread.join(dealt, [*place, "part"]).withColumn("score", overlap(F.col("a"), F.col("b"))).where((F.col("score") > 0) & enough)

    best = scored(rects).groupBy(*rect).agg(F.max("score").alias("best")).toDF(*[f"of_{c}" for c in rect], "best")
    again = rects.join(best, reduce(and_, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in rect])).drop(*best.columns[:-1])
    first = scored(again).where(F.col("score") == F.col("best")).groupBy(*rect, "best").agg(F.min("item_ord").alias("item_ord"))
    top = first.groupBy("doc_id", "block_id").agg(F.max(F.struct(F.col("best").alias("score"), -F.col("rect_ord"), -F.col("item_ord"), "block_ord", "block_kind", "item_ord")).alias("t")).select("doc_id", "block_id", "t.block_ord", "t.block_kind", "t.item_ord", "t.score")
    owns = F.first(F.when(body & (F.col("score") >= least), F.col("block_id")), ignorenulls=True).over(
        Window.partitionBy("doc_id", "item_ord").orderBy("block_ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    kept = top.withColumn("owner", owns).where((body & (F.col("score") >= least)) | (~body & (F.col("score") >= fragment) & F.col("owner").isNotNull()))
    own = body & (F.col("owner") == F.col("block_id"))
    return kept.select("doc_id", "block_id", F.when(own, F.col("item_ord")).alias("item_ord"), F.when(~own, F.col("owner")).alias("covered_by"))


#: Items of a page that a join's group holds.
ITEMS_AT_ONCE = 10_000


def crop_rect(rects: Column, pad: float = 3.0) -> Column:
    """The padded union of a block's rectangles on the page of its first; null without rectangles."""
    first = F.get(rects, F.lit(0))["page"]
    same = F.filter(rects, lambda r: r["page"] == first)

    def edge(name: str, pick, by: float) -> Column:
        return (pick(F.transform(same, lambda r: r[name])) + by).alias(name)

    union = F.struct(first.alias("page"), edge("x1", F.array_min, -pad), edge("y1", F.array_min, -pad), edge("x2", F.array_max, pad), edge("y2", F.array_max, pad))
    return F.when(F.size(rects) > 0, union)


def page_markers(blocks: DataFrame) -> DataFrame:
    """Blocks before which a page starts: doc_id, ord, page. A block without box stays on the page so far."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    page = F.get("rects", F.lit(0))["page"]
    before = F.coalesce(F.max(page).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    return blocks.withColumns({"page": page, "__b": before}).where("page > __b").select("doc_id", "ord", "page")


# ---- characters ------------------------------------------------------------


def decoded(text_map: str | None) -> list[tuple[int, float, float, float, float]]:
    """(page, x1, y1, x2, y2) of each positioned character of a run-length text map; [] for anything that is none.

    A run is [flags, page, x1, y1, x2, y2, widths...]; a width is a number or [gap, width]; flag 1 drops the last character (a soft hyphen), flags 2 and 4 give the
    direction, whose odd values run upwards or downwards.
    """
    try:
        runs = json.loads(text_map or "")
    except ValueError:
        return []
    out = []
    for run in runs if isinstance(runs, list) else ():
        if not isinstance(run, list) or len(run) < 6:
            continue
        flags, page, box = int(run[0]), run[1], run[2:6]
        upright = flags >> 1 & 1
        at, spans = box[upright], []
        for w in run[6:]:
            gap, width = w if isinstance(w, list) else (0, w)
            at += gap
            spans.append((at, at + width))
            at += width
        spans = spans if run[6:] else [(box[upright], box[upright + 2])]
        for a, b in spans[: len(spans) - (flags & 1)]:
            if math.isfinite(a) and math.isfinite(b):
                out.append((page, box[0], a, box[2], b) if upright else (page, a, box[1], b, box[3]))
    return out


#: Of the boxes of one text map: their pages, and x1, y1, x2, y2.
Boxes = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]
#: Boxes that a batch holds before it is handed on.
BATCH_BOXES = 100_000
_PLAIN = {int, float}


def _boxes(chars: list[tuple]) -> Boxes:
    columns = list(zip(*chars, strict=True)) or [()] * 5
    return np.array(columns[0], np.int32), *(np.array(c, np.float64) for c in columns[1:])


def decoded_columns(text_map: str | None) -> Boxes:
    """decoded() as columns. Runs of numbers are summed as arrays, in the same order; maps with anything else go through decoded()."""
    try:
        runs = json.loads(text_map or "")
    except ValueError:
        return _boxes([])
    out = []
    for run in runs if isinstance(runs, list) else ():
        if not isinstance(run, list) or len(run) < 6:
            continue
        widths = run[6:]
        if type(run[0]) is not int or type(run[1]) is not int or not set(map(type, run[2:6])) <= _PLAIN:
            return _boxes(decoded(text_map))
        steps = np.zeros(2 * len(widths) + 1)
        if pairs := [i for i, w in enumerate(widths) if type(w) is list]:
            given = [widths[i] for i in pairs]
            if not all(len(w) == 2 and type(w[0]) in _PLAIN and type(w[1]) in _PLAIN for w in given):
                return _boxes(decoded(text_map))
            for i, w in zip(pairs, given, strict=True):
                steps[2 * i + 1], widths[i] = w
        plain = np.asarray(widths)
        if plain.ndim != 1 or plain.dtype.kind not in "if":
            return _boxes(decoded(text_map))
        steps[2::2] = plain
        upright = run[0] >> 1 & 1
        x1, y1, x2, y2 = map(float, run[2:6])
        steps[0] = (x1, y1)[upright]
        places = np.cumsum(steps)
        a, b = (places[1::2], places[2::2]) if widths else (np.array([(x1, y1)[upright]]), np.array([(x2, y2)[upright]]))
        n = len(a) - (run[0] & 1)
        a, b = a[:n], b[:n]
        if not (np.isfinite(a).all() and np.isfinite(b).all()):
            kept = np.isfinite(a) & np.isfinite(b)
            a, b = a[kept], b[kept]
        full = lambda v: np.full(len(a), v)  # noqa: B023, E731
        out.append((np.full(len(a), run[1], np.int32), *((full(x1), a, full(x2), b) if upright else (a, full(y1), b, full(y2)))))
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else _boxes([])


def _rects(rows: list[Boxes]) -> pa.Array:
    """The boxes of each row as an array of rectangles."""
    offsets = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])]).astype(np.int32)
    columns = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else _boxes([])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(c) for c in columns], ["page", "x1", "y1", "x2", "y2"]))


def _in_batches(rows: Iterator[Boxes]) -> Iterator[pa.Array]:
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += len(r[0]) + 1
        if n >= BATCH_BOXES:
            yield _rects(held)
            held, n = [], 0
    if held:
        yield _rects(held)


@F.arrow_udf(RECTS_TYPE)
def decode_text_map(maps: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """decoded() over a column, handed on in batches of a bounded number of boxes."""
    for s in maps:
        yield from _in_batches(decoded_columns(t.as_py()) for t in s)


def solid_range(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """The characters other than white space before start and in [start, end) of a text; these own a text map's boxes in order."""
    return T.solid(F.substring(text, F.lit(1), start)), T.solid(F.substring(text, start + 1, end - start))


def lines_of(chars: list[tuple]) -> list[tuple]:
    """Character boxes (page, x1, y1, x2, y2) in order, merged to lines: each joins the first line of its page at its height and not far off."""
    pages: dict[int, list[list[float]]] = {}
    for page, x1, y1, x2, y2 in chars:
        h, lines = y2 - y1, pages.setdefault(page, [])
        for line in lines:
            if max(abs(line[1] - y1), abs(line[3] - y2)) < h / 2 and max(x1 - line[2], line[0] - x2) < 2 * h:
                line[:] = min(line[0], x1), min(line[1], y1), max(line[2], x2), max(line[3], y2)
                break
        else:
            lines.append([x1, y1, x2, y2])
    return [(p, *line) for p in sorted(pages) for line in pages[p]]


def _tuples(boxes: Boxes, start: int = 0, end: int | None = None) -> list[tuple]:
    return list(zip(*(c[start:end].tolist() for c in boxes), strict=True))


@F.arrow_udf(RECTS_TYPE)
def merge_lines(chars: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """lines_of() over a column of array<rect>: pages ascending, lines in the order in which they began."""
    for s in chars:
        yield from _in_batches(_boxes(lines_of([tuple(c.values()) for c in row.as_py() or ()])) for row in s)


#: Characters that are tried against a line at once, at first and at most.
STRETCH, LONGEST = 32, 8192


def merged_lines(boxes: Boxes) -> list[tuple]:
    """lines_of() of columns: neighbours of one page, top and bottom are tried together against the line that takes the first of them.

    Which lines are at the height of such neighbours doesn't change while they are dealt out, but for those that they begin; only how far lines reach does.
    """
    page, x1, y1, x2, y2 = boxes
    starts = np.flatnonzero((page[1:] != page[:-1]) | (y1[1:] != y1[:-1]) | (y2[1:] != y2[:-1])) + 1
    if 8 * len(starts) >= len(page) or not all(np.isfinite(c).all() for c in boxes[1:]):
        return lines_of(_tuples(boxes))
    pages: dict[int, list[list[float]]] = {}
    for start, end in pairwise([0, *starts.tolist(), len(page)]):
        lines, top, bottom = pages.setdefault(int(page[start]), []), float(y1[start]), float(y2[start])
        h = bottom - top
        if h <= 0:  # at no height, not even that of their own
            lines += [[a, top, b, bottom] for a, b in zip(x1[start:end].tolist(), x2[start:end].tolist(), strict=True)]
            continue
        level = [line for line in lines if max(abs(line[1] - top), abs(line[3] - bottom)) < h / 2]
        n = STRETCH
        while start < end:
            a, b = float(x1[start]), float(x2[start])
            for k, line in enumerate(level):
                if max(a - line[2], line[0] - b) < 2 * h:
                    break
            else:
                k, line = len(level), [a, top, b, bottom]
                lines.append(line)
                level.append(line)
            left, right = x1[start : min(end, start + n)], x2[start : min(end, start + n)]
            lows, highs = np.minimum.accumulate(np.minimum(left, line[0])), np.maximum.accumulate(np.maximum(right, line[2]))
            fits = np.ones(len(left), bool)
            fits[1:] = np.maximum(left[1:] - highs[:-1], lows[:-1] - right[1:]) < 2 * h
            for other in level[:k]:
                fits[1:] &= ~(np.maximum(left[1:] - other[2], other[0] - right[1:]) < 2 * h)
            m = len(fits) if fits.all() else int(fits.argmin())
            line[:] = float(lows[m - 1]), min(line[1], top), float(highs[m - 1]), max(line[3], bottom)
            start, n = start + m, min(2 * n, LONGEST) if m == n else STRETCH
    return [(p, *line) for p in sorted(pages) for line in pages[p]]


def lines_of_parts(parts: list[tuple]) -> list[tuple] | None:
    """The lines of a sentence's parts (seg_start, text_map, before, n): n characters of each text map, from the one after `before` on, in the order of seg_start; None without any positioned text."""
    found = []
    for seg_start, text_map, before, n in parts:
        boxes = decoded_columns(text_map)
        if len(boxes[0]):
            found.append((seg_start, tuple(c[before : before + n] for c in boxes)))
    if not found:
        return None
    if len(found) == 1:
        return merged_lines(found[0][1])
    alone = len({f[0] for f in found}) == len(found)
    found.sort(key=itemgetter(0) if alone else lambda f: (f[0], _tuples(f[1])))
    return merged_lines(tuple(map(np.concatenate, zip(*[f[1] for f in found], strict=True))))


_NUMBER = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
_RUN = rf"\[[0-7],(?:0|[1-9][0-9]{{0,8}})(?:,{_NUMBER}){{4}}(?:,{_NUMBER}|,\[{_NUMBER},{_NUMBER}\])+\]"
#: Text maps of which numbers can be read side by side: runs of numbers and pairs, with a width at least, without spaces.
_PLAIN_MAP = rf"\A\[{_RUN}(?:,{_RUN})*\]\z"
#: Bytes of text maps that are read side by side.
MAP_BYTES = 250_000
_BRACKETS = np.zeros(256, np.int8)
_BRACKETS[list(b",[]")] = 3, 1, -1


def _read_maps(maps: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Boxes, np.ndarray, np.ndarray, np.ndarray]:
    """The characters of maps that _PLAIN_MAP fits, one after the other: from where to where each goes, and its run; of runs their boxes, and which are upright; how many characters each map has, and which maps
    have numbers that are not finite, so that decoded_columns() has to read them. Widths are summed run by run, in their order."""
    offsets = np.frombuffer(maps.buffers()[1], np.int32)[maps.offset : maps.offset + len(maps) + 1]
    data = np.frombuffer(maps.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    marks = _BRACKETS[data]
    digit = marks == 0
    edges = np.flatnonzero(digit[1:] != digit[:-1]) + 1  # a map begins and ends with a bracket, so starts and ends of numbers take turns
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    numbers = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.py_buffer(data[digit]))
    v = numbers.cast(pa.float64()).to_numpy()
    at = np.flatnonzero((marks == 1) | (marks == -1))
    turns = marks[at].astype(np.int64)
    depth = np.cumsum(turns)
    runs_at = at[(turns > 0) & (depth == 2)]
    runs, pairs = np.searchsorted(starts, runs_at), np.searchsorted(starts, at[(turns > 0) & (depth == 3)])
    flags, page, box = v[runs].astype(np.int64), v[runs + 1].astype(np.int32), [v[runs + k] for k in range(2, 6)]
    upright, ends = (flags >> 1 & 1).astype(bool), np.append(runs[1:], len(v))
    width = np.ones(len(v), bool)
    width[runs[:, None] + np.arange(6)] = False
    width[pairs] = False
    width[ends[(flags & 1).astype(bool)] - 1] = False
    steps, places = v.copy(), np.zeros(len(v))
    steps[runs + 5] = np.where(upright, box[1], box[0])
    with np.errstate(over="ignore", invalid="ignore"):
        for i, j in zip((runs + 5).tolist(), ends.tolist(), strict=True):
            np.add.accumulate(steps[i:j], out=places[i:j])
    map_of = np.searchsorted(offsets - offsets[0], runs_at, "right") - 1
    endless = np.zeros(len(maps), bool)
    endless[map_of[np.searchsorted(ends, np.flatnonzero(~np.isfinite(places)), "right")]] = True
    endless[map_of[~np.isfinite(box).all(0)]] = True
    i = np.flatnonzero(width)
    n = np.diff(np.searchsorted(i, np.append(runs, len(v))))
    return places[i - 1], places[i], np.repeat(np.arange(len(runs)), n), (page, *box), upright, np.bincount(map_of, n, len(maps)).astype(np.int64), endless


def _merged(size: np.ndarray, parts: pa.StructArray) -> pa.Array:
    """lines_of_parts() of sentences of `size` parts each, as rectangles; _NONE where there is no positioned text. Sentences whose characters stand in one line are told from all of theirs at once."""
    seg_start, maps, before, n = parts.flatten()
    of, first = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
    plain = pc.match_substring_regex(maps, _PLAIN_MAP).fill_null(False).to_numpy(zero_copy_only=False)
    odd, slow = np.bincount(of, ~plain, len(size)) > 0, {}
    order = np.arange(len(of))
    if len(of) > len(size):  # some have several parts, which go by where they start
        start = seg_start.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.lexsort((start, of))
        odd[of[order][1:][(np.diff(of[order]) == 0) & (np.diff(start[order]) == 0)]] = True
        odd[of[seg_start.is_null().to_numpy(zero_copy_only=False)]] = True
    used = order[~odd[of[order]]]
    lines, found = np.zeros(len(size), np.int64), np.zeros(len(size), bool)
    table = [np.empty(0)] * 5
    ones = np.empty(0, np.int64)
    if len(used):
        a, b, run, boxes, upright, count, endless = _read_maps(maps.take(pa.array(used)))
        odd[of[used][endless]] = True
        found = np.bincount(of[used], count, len(size)) > 0
        low, take = (c.to_numpy(zero_copy_only=False).astype(np.int64)[used] for c in (before, n))
        low = np.minimum(low, count)
        length = np.where(odd[of[used]], 0, np.minimum(low + take, count) - low)
        ends = np.cumsum(length)
        picked = np.repeat(np.cumsum(count) - count + low - ends + length, length) + np.arange(ends[-1])
        a, b, run, owner = a[picked], b[picked], run[picked], np.repeat(of[used], length)
        if len(owner):
            other = owner[1:] != owner[:-1]
            h = boxes[4] - boxes[2]
            near = np.where((h > 0) & ~upright, 2 * h, -np.inf)
            beside = np.maximum(a[1:] - b[:-1], a[:-1] - b[1:]) < near[run[1:]]
            turn = np.flatnonzero(run[1:] != run[:-1])
            beside[turn] &= np.all([boxes[k][run[turn]] == boxes[k][run[turn + 1]] for k in (0, 2, 4)], 0) & ~upright[run[turn]]
            several = np.zeros(len(size), bool)
            several[owner[1:][~(beside | other)]] = True
            heads = np.append(0, np.flatnonzero(other) + 1)
            ones, tails, first_run = owner[heads], np.append(heads[1:], len(owner)), run[heads]
            several[ones[upright[first_run]]] = True
            for k in np.flatnonzero(several[ones]).tolist():
                own = slice(heads[k], tails[k])
                page, x1, y1, x2, y2 = (c[run[own]] for c in boxes)
                up = upright[run[own]]
                slow[int(ones[k])] = merged_lines((page, np.where(up, x1, a[own]), np.where(up, a[own], y1), np.where(up, x2, b[own]), np.where(up, b[own], y2)))
            alone = ~several[ones]
            table = [c[alone] for c in (boxes[0][first_run], np.minimum.reduceat(a, heads), boxes[2][first_run], np.maximum.reduceat(b, heads), boxes[4][first_run])]
            ones = ones[alone]
    lines[ones] = 1
    for i in np.flatnonzero(odd).tolist():
        r = lines_of_parts([tuple(p.values()) for p in parts.slice(int(first[i]), int(size[i])).to_pylist()])
        found[i] = r is not None
        slow[i] = r or []
    for i, r in slow.items():
        lines[i] = len(r)
    lines[~found] = 1
    offsets = np.concatenate([[0], np.cumsum(lines)])
    columns = [np.empty(offsets[-1], np.int32), *(np.empty(offsets[-1]) for _ in range(4))]
    for c, one, none in zip(columns, table, _NONE, strict=True):
        c[offsets[:-1][~found]] = none[0]
        c[offsets[ones]] = one
    for i, r in slow.items():
        if r:
            for c, values in zip(columns, _boxes(r), strict=True):
                c[offsets[i] : offsets[i + 1]] = values
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.StructArray.from_arrays([pa.array(c) for c in columns], ["page", "x1", "y1", "x2", "y2"]))


@F.arrow_udf(RECTS_TYPE)
def merge_parts(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """lines_of_parts() over a column; where there is no positioned text, one box without a page (null). Sentences are merged some MAP_BYTES of their text maps at a time."""
    for s in parts:
        size, flat = s.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), s.flatten()
        ends = np.cumsum(size)
        weight = np.concatenate([[0], np.cumsum(pc.binary_length(flat.flatten()[1]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))])[ends]
        i = 0
        while i < len(size):
            j = max(i + 1, int(np.searchsorted(weight, (weight[i - 1] if i else 0) + MAP_BYTES, "right")))
            yield _merged(size[i:j], flat.slice(ends[i] - size[i], ends[j - 1] - ends[i] + size[i]))
            i = j


#: Else a filter on the lines is planned below them, with lines of its own.
merge_parts = merge_parts.asNondeterministic()


#: Stands for a sentence without positioned text.
_NONE = _boxes([(-1, math.nan, 0.0, 0.0, 0.0)])


def sentence_boxes(sentences: DataFrame, segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """Lines of each sentence: doc_id, unit_id, lines. segments(doc_id, block_id, node_key, start, node_start, length), nodes(doc_id, node_key, text, text_map).

    Characters stay in their text maps through both shuffles, by node and by sentence; boxes are made where they are merged, and only lines leave the task.
    """
    s = sentences.select("doc_id", "block_id", "unit_id", "start", "end").alias("s")
    g = segments.withColumnRenamed("start", "seg_start").alias("g")
    parts = s.join(g, ["doc_id", "block_id"]).withColumns({"a": F.greatest("start", "seg_start"), "b": F.least("end", F.col("seg_start") + F.col("length"))}).where("a < b")
    placed = parts.join(nodes, ["doc_id", "node_key"])
    shift = F.col("node_start") - F.col("seg_start")
    before, n = solid_range(F.col("text"), F.col("a") + shift, F.col("b") + shift)
    found = placed.select("doc_id", "unit_id", "seg_start", "text_map", before.alias("before"), n.alias("n")).where("text_map is not null and before is not null and n is not null")
    maps = found.groupBy("doc_id", "unit_id").agg(F.collect_list(F.struct("seg_start", "text_map", "before", "n")).alias("p"))
    lines = maps.select("doc_id", "unit_id", merge_parts("p").alias("lines"))
    return lines.where((F.size("lines") != 1) | ~F.isnan(F.col("lines")[0]["x1"]))


def units_under(boxes: DataFrame, annotations: DataFrame, least: float = 0.3) -> DataFrame:
    """Sentences under annotations: annotation_id, doc_id, unit_id, where the shared area reaches a share of the sentence's lines on that page.

    boxes(doc_id, unit_id, lines); annotations(annotation_id, doc_id, page, rects, next_rects): next_rects continue on the next page.
    A pair is judged in the row where the two meet, with all their rectangles of the page, and told on the first page that suffices: no pair is kept, sorted or grouped. The sentences of a page meet in
    blocks of about UNITS_AT_ONCE, so that a page of any size is dealt out. The pairs themselves are the result.
    """
    lines = boxes.select("doc_id", "unit_id", F.explode("lines").alias("r")).withColumn("page", F.col("r.page"))
    parts = annotations.select("annotation_id", "doc_id", "page", F.explode("rects").alias("r")).unionByName(
        annotations.where("next_rects is not null").select("annotation_id", "doc_id", (F.col("page") + 1).alias("page"), F.explode("next_rects").alias("r"))
    )
    lines, parts = _by_page(lines, "unit_id"), _by_page(parts, "annotation_id")
    blocks = lines.groupBy("doc_id", "page").agg(F.ceil(F.count("*") / UNITS_AT_ONCE).cast("int").alias("blocks"))
    units = lines.join(blocks, ["doc_id", "page"]).select("doc_id", "page", F.pmod(F.xxhash64("unit_id"), "blocks").cast("int").alias("block"), "unit_id", F.col("here").alias("l"), F.col("earlier").alias("l0"))
    notes = parts.join(blocks, ["doc_id", "page"]).select("doc_id", "page", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "annotation_id", F.col("here").alias("q"), F.col("earlier").alias("q0"))

    def enough(ls: Column, qs: Column) -> Column:
        total = F.aggregate(ls, F.lit(0.0), lambda x, r: x + area(r))
        shared = F.aggregate(ls, F.lit(0.0), lambda x, r: F.aggregate(qs, x, lambda y, q: y + common_area(r, q)))
        return (total > 0) & (shared / total >= least)

    told = F.exists("l0", lambda a: F.exists("q0", lambda b: (a["page"] == b["page"]) & enough(a["here"], b["here"])))
    met = notes.join(units.hint("merge"), ["doc_id", "page", "block"]).where(enough(F.col("l"), F.col("q"))).where(~told)
    return met.select("annotation_id", "doc_id", "unit_id")


#: Sentences of a page that a join's group holds.
UNITS_AT_ONCE = 10_000


def _by_page(rects: DataFrame, name: str) -> DataFrame:
    """rects(doc_id, name, page, r) as a row a page: here, and earlier, the rectangles of the pages before it by page."""
    pages = rects.where("page is not null").groupBy("doc_id", name, "page").agg(F.collect_list("r").alias("here"))
    whole = pages.groupBy("doc_id", name).agg(F.collect_list(F.struct("page", "here")).alias("all")).select("doc_id", name, "all", F.explode("all").alias("p"))
    return whole.select("doc_id", name, "p.page", "p.here", F.filter("all", lambda a: a["page"] < F.col("p.page")).alias("earlier"))


def rounded(c: Column) -> Column:
    """To three decimals, halves upwards also below zero."""
    return F.floor(c * 1000 + 0.5) / 1000


def sort_index(page: Column, offset: Column, top: Column) -> Column:
    """page|offset|top with leading zeros, each clamped to its width."""

    def pad(c: Column, n: int) -> Column:
        return F.lpad(F.greatest(F.lit(0), F.least(c, F.lit(10**n - 1))).cast("string"), n, "0")

    return F.concat_ws("|", pad(page, 5), pad(offset, 6), pad(top, 5))


@F.arrow_udf(RUNS_TYPE)
def page_runs(maps: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The pages of decoded() characters, in order, as runs (page, n)."""
    for s in maps:
        offsets, pages, numbers = [0], [], []
        for t in s:
            page = decoded_columns(t.as_py())[0]
            starts = np.flatnonzero(np.concatenate([[True], page[1:] != page[:-1]])) if len(page) else np.empty(0, np.int64)
            pages.append(page[starts])
            numbers.append(np.diff(np.append(starts, len(page))))
            offsets.append(offsets[-1] + len(starts))
        pages, numbers = (pa.array(np.concatenate(x or [[]]).astype(np.int32)) for x in (pages, numbers))
        yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pages, numbers], ["page", "n"]))


def page_offsets(nodes: DataFrame) -> DataFrame:
    """Before each text node, the positioned characters of its page: nodes(doc_id, ord, node_key, text_map) → doc_id, node_key, page, before."""
    return _offsets(nodes.select("doc_id", "ord", "node_key", page_runs("text_map").alias("runs")))


def _offsets(runs: DataFrame) -> DataFrame:
    per = runs.select("doc_id", "ord", "node_key", F.inline("runs")).groupBy("doc_id", "ord", "node_key", "page").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("doc_id", "page").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("doc_id", "node_key", "page", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))


def position_offsets(positions: DataFrame, segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """How many positioned characters of its page stand before a position: positions(doc_id, block_id, start) → doc_id, block_id, start, page, offset.

    The page is that of the first positioned character at or after the position in its block; offset is 0 where there is none, and where the position's own text node has no character on that page.
    segments(doc_id, block_id, node_key, start, node_start, length), nodes(doc_id, ord, node_key, text, text_map). Characters stay runs in the row of their node: pages are counted by node, summed over the
    nodes of a page, and what stands before a position in its own node is counted in its row. Text maps are read once, and only their runs of pages are written.
    """
    from quirelake.sources.tables import scratch

    runs = scratch(nodes.select("doc_id", "ord", "node_key", page_runs("text_map").alias("runs")), "runs")

    def solid(c: Column) -> Column:
        return F.length(F.regexp_replace(c, T.WS, ""))

    seg = segments.withColumnRenamed("start", "at").join(nodes.select("doc_id", "node_key", "text"), ["doc_id", "node_key"]).join(runs.drop("ord"), ["doc_id", "node_key"])
    seg = seg.withColumns({"a": solid(F.expr("substring(text, 1, node_start)")), "b": solid(F.expr("substring(text, 1, node_start + length)"))})

    def page_at(i: Column) -> Column:
        start = F.struct(i.cast("bigint").alias("left"), F.lit(None).cast("int").alias("page"))
        step = lambda x, r: F.when(x["page"].isNotNull(), x).when(x["left"] < r["n"], F.struct(x["left"].alias("left"), r["page"].alias("page"))).otherwise(F.struct((x["left"] - r["n"]).alias("left"), x["page"].alias("page")))
        return F.aggregate("runs", start, step, lambda x: x["page"])

    def before_in_node(i: Column, page: Column) -> Column:
        start = F.struct(i.cast("bigint").alias("left"), F.lit(0).cast("bigint").alias("n"))
        step = lambda x, r: F.struct(F.greatest(F.lit(0).cast("bigint"), x["left"] - r["n"]).alias("left"), (x["n"] + F.when(r["page"] == page, F.least(x["left"], r["n"].cast("bigint"))).otherwise(0)).alias("n"))
        return F.aggregate("runs", start, step, lambda x: x["n"])

    later = Window.partitionBy("doc_id", "block_id").orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    seg = seg.withColumn("first", F.when(F.col("a") < F.col("b"), page_at(F.col("a")))).withColumn("next", F.first("first", ignorenulls=True).over(later))
    own = positions.join(seg, ["doc_id", "block_id"]).where("start < at + length").groupBy("doc_id", "block_id", "start").agg(F.min_by(F.struct("at", "node_key", "text", "node_start", "runs", "b", "next"), "at").alias("s"))
    own = own.select("doc_id", "block_id", "start", "s.*").withColumn("i", solid(F.expr("substring(text, 1, node_start + greatest(0, start - at))")))
    own = own.withColumn("page", F.coalesce(F.when(F.col("i") < F.col("b"), page_at(F.col("i"))), "next")).withColumn("within", before_in_node(F.col("i"), F.col("page")))
    found = own.join(_offsets(runs), ["doc_id", "node_key", "page"], "left").select("doc_id", "block_id", "start", "page", F.coalesce(F.col("before") + F.col("within"), F.lit(0)).alias("offset"))
    return positions.select("doc_id", "block_id", "start").distinct().join(found, ["doc_id", "block_id", "start"], "left").withColumn("offset", F.coalesce("offset", F.lit(0)))
