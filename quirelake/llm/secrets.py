"""Secret scans: three base patterns, and sliding-window Shannon entropy over candidate strings.

A candidate is a maximal run of `[A-Za-z0-9+/_=-]` of at least WINDOW characters. A window of that many
characters slides over it; the counts of its characters, and with them the sum of n*log2(n), are changed by the
character that leaves and the one that enters, so a step costs the same for any window. A window is judged
by the least class that holds all its characters (hex, alphanumeric, base64), each class with its own
threshold; windows over the threshold join into spans. The allow list suppresses candidates and spans that look random but are
not secret (UUIDs, digits only, paths of words and numbers) or that carry no digit at all (long words), and single windows that hold an ordered alphabet or
one character eight times over; the rest of such a candidate is still judged.

Cases: null text counts as empty; very long texts are scanned whole; of base spans that start together all stay, in the order of their kinds; repeated
rows are rows of their own; an empty table gives an empty result; other columns are ignored, whatever their names.
Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame

from quirelake.llm.common import importable, small, table

#: The base patterns and the least lengths of what they must match. Only A-Z has another case (a: no long s, no Kelvin sign).
ASSIGN = r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
#: The entropy in bits a character from which a window of 20 counts as random: (class, characters, threshold).
CLASSES = (
    ("hex", frozenset("0123456789abcdefABCDEF"), 2.9),
    ("alnum", frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), 3.6),
    ("base64", frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"), 3.8),
)
ALLOW = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"[0-9_+/=-]*",
    r"[^0-9]*",
    r"0123456789|abcdefghij|ABCDEFGHIJ|(?P<one>.)(?P=one){7}",
    r"(?:[A-Za-z]{2,}[/_=-]|[0-9]{1,4}[/_=-])*(?:[A-Za-z]{2,}|[0-9]{1,4})",
)

_assign = re.compile(ASSIGN)
_access = re.compile(r"AKIA[A-Z0-9]{%d,}" % (LEAST["access"] - 4))  # a run's first AKIA starts the longest match in it
_hex = re.compile(r"[0-9a-f]{%d,}" % LEAST["hex"])
_candidate = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
_allowed = re.compile("|".join(f"(?:{p})" for p in ALLOW[:3] + ALLOW[4:]))
_ordered = re.compile(f"(?=(?P<all>{ALLOW[3]}))")


@lru_cache(None)
def _nlogn(n: int) -> float:
    return n * log2(n) if n > 1 else 0.0


def windows_over(s: str, width: int = WINDOW, skip: bytearray | None = None) -> list[tuple[int, int]]:
    """Spans of s made of windows whose entropy reaches the threshold of their class; overlapping ones are joined. Windows that start where skip is set do not count."""
    n = len(s)
    if n < width:
        return []
    counts: dict[str, int] = {}
    outside = [0] * len(CLASSES)  # of each class, the window's characters that it lacks
    total, spans = 0.0, []
    top = log2(width)
    for i, c in enumerate(s):
        k = counts.get(c, 0)
        total += _nlogn(k + 1) - _nlogn(k)
        counts[c] = k + 1
        for j, (_, chars, _t) in enumerate(CLASSES):
            outside[j] += c not in chars
        if i >= width:
            o = s[i - width]
            k = counts[o]
            total += _nlogn(k - 1) - _nlogn(k)
            counts[o] = k - 1
            for j, (_, chars, _t) in enumerate(CLASSES):
                outside[j] -= o not in chars
        if i >= width - 1 and not (skip and skip[i - width + 1]):
            least = next((t for j, (_, _c, t) in enumerate(CLASSES) if not outside[j]), None)
            if least is not None and top - total / width >= least - 1e-9:
                a = i - width + 1
                if spans and a <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], i + 1)
                else:
                    spans.append((a, i + 1))
    return spans


def ordered_windows(s: str, width: int = WINDOW) -> bytearray | None:
    """Which windows hold an ordered alphabet or one character eight times over; None if none does."""
    out = None
    for m in _ordered.finditer(s):
        out = out or bytearray(len(s))
        lo, hi = max(0, m.end("all") - width), m.start() + 1  # the windows that hold the whole match
        out[lo:hi] = b"\1" * (hi - lo) if hi > lo else b""
    return out


def allowed(s: str) -> bool:
    """Whether the allow list suppresses the whole of s."""
    return bool(_allowed.fullmatch(s))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base patterns' spans, by start and then kind."""
    found = []
    if "=" in text or ":" in text:
        found += [("assign", *m.span()) for m in _assign.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _access.finditer(text)]
    found += [("hex", *m.span()) for m in _hex.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def entropy_spans(text: str) -> list[tuple[str, int, int]]:
    """What the sliding window finds beyond the allow list."""
    out = []
    for m in _candidate.finditer(text):
        if not allowed(m[0]):
            out += [("entropy", m.start() + a, m.start() + b) for a, b in windows_over(m[0], skip=ordered_windows(m[0])) if not allowed(m[0][a:b])]
    return out


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text, by start and then kind."""
    text = text or ""
    return sorted(base_spans(text) + entropy_spans(text), key=lambda x: (x[1], KINDS.index(x[0])))


SPANS = "array<struct<kind:string,start:int,end:int>>"


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for b in (s for whole in batches for s in small(whole, 1)):
        spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in scan(t)] for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], ["doc_id", "found"])


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, found (the spans, in order)."""
    importable(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_run, f"doc_id bigint, found {SPANS}")


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The contract's query over the whole documents table."""
    digest = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    base = "filter(found, s -> s.kind <> 'entropy')"
    count = "cast(size(filter(found, s -> s.kind = '{}')) as bigint)"
    return secret_spans(table(spark, sf_dir, "documents")).selectExpr(
        "doc_id", *(f"{count.format(k)} as n_{k}" for k in KINDS[:3]),
        f"sha2({digest.format(base)}, 256) as base_sha256", f"{digest.format('found')} as spans",
    )

