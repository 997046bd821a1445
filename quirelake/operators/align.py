"""Alignment of two parses of one document by runs of characters.

Which 12-character runs stand exactly once in each text is a join; how runs grow from them depends on what earlier runs took, so that part
runs in a kernel, one document at a time, over partitions that are sorted by document. A document's text bounds what a task holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions import text as T

K = 12
SPANS = "doc_id bigint, unit_id string, nth int, other_unit string, other_block string, start int, end int"
_formula = re.compile(r"\$[^$]+\$")
_tail = re.compile(r"[\s.,;:!?)\]]+$")


def kept_text(c: Column) -> Column:
    """Lower-case letters and digits without formulas."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"\$[^$]+\$", "")), "[^a-z0-9]", "")


def unique_grams(rows: DataFrame) -> DataFrame:
    """Runs of K characters that stand once in a text: rows(id of any type, text of letters a-z and digits) → id, gram (its number in base 36), pos. A text's runs are counted where it is, so nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, grams, at, held = [], [], [], 0
            for n, text in enumerate(b.column(1).to_pylist()):
                g, i = once(_DIGIT[np.minimum(np.frombuffer((text or "").encode("ascii", "ignore"), np.uint8), 128)])
                own.append(np.full(len(g), n, np.int64))
                grams.append(g.view(np.int64))
                at.append(i)
                held += len(g)
                if held > 500_000:
                    yield _gram_batch(b.column(0), own, grams, at)
                    own, grams, at, held = [], [], [], 0
            if own:
                yield _gram_batch(b.column(0), own, grams, at)

    return rows.select("id", "text").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, gram bigint, pos bigint")


def _gram_batch(ids: pa.Array, own: list, grams: list, at: list) -> pa.RecordBatch:
    own, grams, at = (pa.array(np.concatenate(x).astype(np.int64)) for x in (own, grams, at))
    return pa.RecordBatch.from_arrays([ids.take(own), grams, at], ["id", "gram", "pos"])


def gram_anchors(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of texts that share unique runs: left_id, right_id, anchors, first_left, first_right."""
    a = unique_grams(left).selectExpr("id as left_id", "gram", "pos as a")
    b = unique_grams(right).selectExpr("id as right_id", "gram", "pos as b")
    return a.join(b, "gram").groupBy("left_id", "right_id").agg(F.count("*").alias("anchors"), F.min("a").alias("first_left"), F.min("b").alias("first_right"))


#: A block as the kernel takes it: its id, its text, and the ranges of its sentences.
Block = tuple[str, str, list[tuple[int, int]]]


class Stream:
    """The kept characters of a document's sentences as digits in base 36, with the unit and offset of each. All blocks are turned into digits at once."""

    def __init__(self, blocks: list[Block], drop_math: bool):
        self.ids, self.blocks, self.math = [], [], {}
        texts, places, counts, bounds, place = [], [], [], [], 0
        inside: list[tuple[int, int]] = []
        for name, text, ranges in blocks:
            if not ranges:
                continue
            if drop_math and "$" in text:
                formulas = [m.span() for m in _formula.finditer(text)]
                inside += [(place + a, place + b) for a, b in formulas]
                for k, (start, end) in enumerate(ranges if formulas else []):
                    part = text[start:end]
                    first, last = start + len(part) - len(part.lstrip()), start + len(_tail.sub("", part)) - 1
                    self.math[len(self.ids) + k] = tuple(any(a <= x < b for a, b in formulas) for x in (first, last))
            self.ids += [f"{name}:{k}" for k in range(len(ranges))]
            self.blocks += [name] * len(ranges)
            bounds += ranges
            places.append(place)
            counts.append(len(ranges))
            texts.append(text)
            place += len(text)
        # a byte a character, "?" for those beyond Latin-1
        d = np.frombuffer("".join(texts).encode("latin-1", "replace").translate(_DIGITS), np.int8)
        if inside:
            d = d.copy()
            for a, b in inside:
                d[a:b] = -1
        begins, limits = (np.repeat(np.array(x, np.int64), counts) for x in (places, [len(t) for t in texts]))
        self.start, self.end = np.fromiter(chain.from_iterable(bounds), np.int64, 2 * len(bounds)).reshape(-1, 2).T
        # a character is of the last sentence that starts at or before it, if it ends behind it
        at = np.flatnonzero(d >= 0)
        low = np.searchsorted(at, begins + self.start)
        self.length = np.maximum(np.minimum(np.searchsorted(at, begins + np.minimum(self.end, limits)), np.append(low[1:], len(at))) - low, 0)
        self.first = np.cumsum(self.length) - self.length
        self.unit = np.repeat(np.arange(len(low)), self.length)
        if len(self.unit) < len(at):
            at = at[np.arange(len(self.unit)) + (low - self.first)[self.unit]]
        self.digits, self.at, self.begins = d[at], at, begins

    def offset(self, places: np.ndarray) -> np.ndarray:
        """Where characters of the stream stand in their blocks."""
        return self.at[places] - self.begins[self.unit[places]]


_DIGIT = np.array([int(chr(c), 36) if c < 128 and chr(c).isalnum() else -1 for c in range(129)])
_DIGITS = _DIGIT.astype(np.int8)[np.minimum(np.arange(256), 128)].tobytes()


def _runs(digits: np.ndarray, k: int) -> np.ndarray:
    """Runs of k digits as numbers (in base 36, which fit 64 bits for k up to 12), by doubling."""
    d = digits.astype(np.uint64)
    h, size = d, 1
    for bit in f"{k:b}"[1:]:
        h, size = h[: max(len(h) - size, 0)] * np.uint64(36**size) + h[size:], 2 * size
        if bit == "1":
            h, size = h[: max(len(h) - 1, 0)] * np.uint64(36) + d[size:], size + 1
    return h


def once(digits: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Runs of k characters that stand once, as numbers, and where they begin."""
    if len(digits) < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = _runs(digits, k)
    order = np.argsort(h)
    gram = h[order]
    new = np.concatenate([[True], gram[1:] != gram[:-1], [True]])
    lone = new[1:] & new[:-1]
    return gram[lone], order[lone]


def _anchors(m: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs begin that stand once in m and once in s, by their place in m: of the runs of both in order, those that come exactly twice, once from either."""
    if min(len(m), len(s)) < k:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    n = len(m) - k + 1
    h = np.concatenate([_runs(m, k), _runs(s, k)])
    # a sort of hashes with their places in the low bits is faster than one of places; where two runs share a hash, the runs themselves are sorted
    bits = np.uint64(len(h).bit_length())
    mixed = h * np.uint64(0x9E3779B97F4A7C15) >> bits << bits | np.arange(len(h), dtype=np.uint64)
    mixed.sort()
    order = (mixed & (np.uint64(1) << bits) - np.uint64(1)).astype(np.int64)
    mixed >>= bits
    new = np.concatenate([[True], mixed[1:] != mixed[:-1], [True]])
    other = h[order]
    if (new[1:-1] != (other[1:] != other[:-1])).any():
        order = np.argsort(h)
        other = h[order]
        new[1:-1] = other[1:] != other[:-1]
    pair = np.flatnonzero(new[:-2] & ~new[1:-1] & new[2:])
    i, j = order[pair], order[pair + 1]
    i, j = np.minimum(i, j), np.maximum(i, j)
    both = (i < n) & (j >= n)
    there = np.full(n, -1)
    there[i[both]] = j[both] - n
    at = np.flatnonzero(there >= 0)
    return at, there[at]


def matched(m: np.ndarray, s: np.ndarray, k: int = K) -> np.ndarray:
    """For each character of m the one of s that it is matched to, or -1; anchors claim from the left, and grow both ways over what is free and equal."""
    to, back = np.full(len(m), -1), np.full(len(s), -1)
    ours, theirs = _anchors(m, s, k)
    at = 0
    while at < len(ours):
        a, b = int(ours[at]), int(theirs[at])
        if to[a] >= 0 or back[b] >= 0:
            at += 1
            continue
        left = _agree(m[:a][::-1], s[:b][::-1], to[:a][::-1], back[:b][::-1])
        n = left + _agree(m[a:], s[b:], to[a:], back[b:])
        a, b = a - left, b - left
        to[a : a + n], back[b : b + n] = np.arange(b, b + n), np.arange(a, a + n)
        at = int(np.searchsorted(ours, a + n))  # anchors before are taken
    return to


def _agree(m: np.ndarray, s: np.ndarray, to: np.ndarray, back: np.ndarray) -> int:
    """How many characters from the start are equal and free."""
    n, step = 0, 64
    size = min(len(m), len(s))
    while n < size:
        e = min(n + step, size)
        bad = (m[n:e] != s[n:e]) | (to[n:e] >= 0) | (back[n:e] >= 0)
        if bad.any():
            return n + int(bad.argmax())
        n, step = e, step * 4
    return n


def aligned(base: list[Block], other: list[Block]) -> list[tuple[str, int, str, str, int, int]]:
    """Spans in base's sentences for each unit of other: unit_id, nth, other_unit, other_block, start, end; rows with nth = -1 map units of base back (other_unit is base's)."""
    s, m = Stream(base, False), Stream(other, True)
    units = len(s.ids)
    to = matched(m.digits, s.digits)
    hit = np.flatnonzero(to >= 0)
    if not len(hit):
        return []
    to = to[hit]
    taken = np.zeros(len(s.digits) + 1, np.int64)
    taken[to + 1] = 1
    taken = np.cumsum(taken)  # characters before each place that are matched
    first, length = s.first, s.length
    # one row for each pair of units that share characters: their number, and the places of the first and last in base's stream
    key = m.unit[hit] * units + s.unit[to]
    if (key[1:] < key[:-1]).any():
        order = np.argsort(key, kind="stable")
        key, to = key[order], to[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    mu, su = np.divmod(key[at], units)
    low, high, number = np.minimum.reduceat(to, at), np.maximum.reduceat(to, at), np.diff(np.append(at, len(key)))
    total = np.bincount(m.unit[hit])[mu]
    kept = number >= np.minimum(8, total / 2)
    mu, su, low, high, number, total = (x[kept] for x in (mu, su, low, high, number, total))
    if not len(mu):
        return []
    a, z = first[su], first[su] + length[su]
    new = np.concatenate([[True], mu[1:] != mu[:-1], [True]])
    # a span takes the unit's ends where little is left there, or a formula of its own opens or closes it, unless others hold more than two of those characters
    opens, closes = low - a <= 12, z - high <= 13
    if m.math:
        formula = np.zeros((len(m.ids), 2), bool)
        formula[list(m.math)] = list(m.math.values())
        opens, closes = opens | new[:-1] & formula[mu, 0], closes | new[1:] & formula[mu, 1]
    start = np.where(opens & (taken[low] - taken[a] <= 2), s.start[su], s.offset(low)).tolist()
    end = np.where(closes & (taken[z] - taken[high + 1] <= 2), s.end[su], s.offset(high) + 1).tolist()
    mostly = (number >= total / 2) | (number >= length[su] / 2)
    back = zip(mu[mostly].tolist(), su[mostly].tolist(), strict=True)
    spans: dict[int, list[tuple[int, int, int]]] = {}
    for i, u, x, y in zip(mu.tolist(), su.tolist(), start, end, strict=True):
        spans.setdefault(i, []).append((u, x, y))
    if len(spans) < len(m.ids):
        _fill(spans, s, m, base)
    out = [(m.ids[i], k, s.ids[u], s.blocks[u], x, y) for i in sorted(spans) for k, (u, x, y) in enumerate(spans[i])]
    return out + [(m.ids[i], -1, s.ids[u], s.blocks[u], 0, 0) for i, u in back]


def _fill(spans: dict[int, list[tuple[int, int, int]]], s: Stream, m: Stream, base: list[Block]) -> None:
    """Give units without a span the gap between their neighbours, where that lies in one block and is not wide."""
    by_block: dict[str, list[int]] = {}
    for u, b in enumerate(s.blocks):
        by_block.setdefault(b, []).append(u)
    text = {name: t for name, t, _ in base}
    later: list[int | None] = [None] * (len(m.ids) + 1)
    for i in range(len(m.ids) - 1, -1, -1):
        later[i] = i if i in spans else later[i + 1]
    previous = None
    for i in range(len(m.ids)):
        following = later[i]
        if i not in spans and previous is not None and following is not None:
            (pu, _, p_end), (nu, n_start, _) = spans[previous][-1], spans[following][0]
            block = s.blocks[pu]
            if s.blocks[nu] == block and n_start - p_end <= 400:
                gap = [(u, max(int(s.start[u]), p_end), min(int(s.end[u]), n_start)) for u in by_block[block]]
                gap = [(u, a, b) for u, a, b in gap if a < b and text[block][a:b].strip()]
                if gap:
                    spans[i] = gap
        if i in spans:
            previous = i


def align_blocks(base: DataFrame, other: DataFrame) -> DataFrame:
    """Both are blocks(doc_id, ord, block_id, kind, text) that have sentences (see blocks.with_sentences) → SPANS: where each unit of other stands in base (nth 0, 1, ...), and the units of base that it mostly covers (nth -1).

    Blocks are shuffled once, by document; they are split and aligned in one task, document after document of a sorted partition, and no sentence leaves it but as a span. Null doc_ids are one document.
    """
    columns = ("ord", "block_id", "kind", "text")
    rows = [side.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(second).alias("second"), *columns) for second, side in enumerate((base, other))]
    return rows[0].unionByName(rows[1]).repartition("doc_id").sortWithinPartitions("doc_id", "second", "ord").mapInArrow(_align_documents, SPANS)


#: Spans that a batch holds, but for those of its last document.
SPANS_AT_ONCE = 20_000


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple], list[tuple]]]:
    """Sorted rows (doc_id, second, ord, block_id, kind, text) as documents: id, blocks of the first parse, blocks of the second."""
    known, mine, parts = False, None, ([], [])
    for b in batches:
        for doc, second, name, kind, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "second", "block_id", "kind", "text")), strict=True):
            if not known or doc != mine:
                if known:
                    yield mine, *parts
                known, mine, parts = True, doc, ([], [])
            parts[second].append((name, kind, text or ""))
    if known:
        yield mine, *parts


def _align_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())
    names = [c.split(" ")[0] for c in SPANS.split(", ")]
    ids, found = [], []

    def batch() -> pa.RecordBatch:
        columns = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    for doc, first, second in _documents(batches):
        if not (first and second):
            continue
        cut: dict[str, list[tuple[int, int]]] = {}  # blocks that are equal in both parses are split once

        def ranges(kind: str, text: str) -> list[tuple[int, int]]:
            if kind == "heading":
                return [(0, len(text))]
            if text not in cut:
                cut[text] = T.sentence_ranges(text)
            return cut[text]

        spans = aligned(*([(name, text, ranges(kind, text)) for name, kind, text in blocks] for blocks in (first, second)))
        ids += [doc] * len(spans)
        found += spans
        if len(found) >= SPANS_AT_ONCE:
            yield batch()
            ids.clear()
            found.clear()
    if found:
        yield batch()
