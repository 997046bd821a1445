"""Text functions as columns. Offsets and lengths count code points.

White space is the set that the data's producers strip: ASCII space and TAB to CR, NBSP, the Unicode space separators, line and
paragraph separators, and the byte order mark. It is spelled out, since `\\s` means less to Java and RE2.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quirelake.schemas import RANGES_TYPE

WS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_PY_WS = "[\t\n\x0b\f\r \xa0  -     　﻿]"
_WHITE = "\t\n\x0b\f\r \xa0                　﻿"
#: An inline formula; its inside may hold escaped dollar signs.
INLINE_MATH = r"\$((?:\\\$|[^$])+?)\$"
CITATION = r"\[\d+(?:\s*[-–]\s*\d+)?(?:\s*,\s*\d+(?:\s*[-–]\s*\d+)?)*\]"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"^{WS}+|{WS}+\z", "")


def collapsed(c: Column) -> Column:
    """Each run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def solid(c: Column) -> Column:
    """How many characters other than white space; plain ASCII needs no look at each."""
    plain = reduce(lambda x, w: F.replace(x, F.lit(w), F.lit("")), [w for w in _WHITE if w.isascii()], c)
    return F.when(F.octet_length(c) == F.length(c), F.length(plain)).otherwise(F.length(F.translate(c, _WHITE, "")))


def loose_key(c: Column) -> Column:
    """The key under which two parses know a sentence: its letters and digits without a leading table or figure number; null with formulas or under six."""
    k = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]", ""), r"^(table|figure|fig)\d+", "")
    return F.when(~c.contains("$") & (F.length(k) >= 6), k)


def letters(c: Column) -> Column:
    """Lower-case letters and digits without formulas."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"\$[^$]*\$", ""), "[^a-z0-9]", "")


def search_form(c: Column) -> Column:
    """What search compares."""
    return F.regexp_replace(F.lower(c), f"{WS}+", " ")


def snippet(c: Column, n: int = 60) -> Column:
    """The first n characters, with an ellipsis where something follows."""
    t = collapsed(c)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("…"))).otherwise(t)


def block_of(unit_id: Column) -> Column:
    """The block of a unit id: what stands before its last colon."""
    return F.regexp_extract(unit_id, r"(?s)^(.*):[^:]*\z", 1)


def clean_latex(c: Column) -> Column:
    """Without white space and a pair of $$ around."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), rf"^\$\${WS}*", ""), rf"{WS}*\$\$\z", ""))


def citation_numbers(c: Column) -> Column:
    """The numbers inside numeric citation marks, in order; none that starts with 0."""
    plain = F.translate(c, "［］", "[]")
    marks = F.regexp_extract_all(plain, F.lit(CITATION), F.lit(0))
    return F.filter(F.flatten(F.transform(marks, lambda m: F.regexp_extract_all(m, F.lit(r"\d+"), F.lit(0)))), lambda n: ~n.startswith("0"))


def lost_citations(source: Column, target: Column) -> Column:
    """Distinct citation numbers of source that target lacks."""
    return F.array_except(citation_numbers(source), citation_numbers(target))


def lost_math(source: Column, target: Column) -> Column:
    """Inline formulas of source that target lacks, compared without white space."""

    def bare(m: Column) -> Column:
        return F.regexp_replace(m, f"{WS}+", "")

    have = F.transform(F.regexp_extract_all(target, F.lit(INLINE_MATH), F.lit(1)), bare)
    own = F.regexp_extract_all(source, F.lit(INLINE_MATH), F.lit(0))
    return F.filter(own, lambda m: ~F.array_contains(have, bare(F.substring(m, F.lit(2), F.length(m) - 2))))


def is_name_list(c: Column) -> Column:
    """An author line: two or more parts of one to five capitalised words each, with marks, digits and formulas left out."""
    word = r"(?<![A-Za-z0-9_]){}(?![A-Za-z0-9_])"
    plain = F.regexp_replace(F.regexp_replace(c, r"\$[^$]*\$", " "), r"[\\*†‡§¶#]|\d+|" + word.format("iD"), " ")
    parts = F.filter(F.transform(F.split(plain, ",|;|" + word.format("and")), strip), lambda p: p != "")
    return (F.size(parts) >= 2) & F.forall(parts, lambda p: p.rlike(rf"^([A-Z][\p{{L}}'’.\-]*\.?{WS}*){{1,5}}\z"))


def unit_problem(source: Column, target: Column, math: Column) -> Column:
    """Why a rendering of a sentence is unusable; null if it is fine. math: formulas are marked by dollar signs."""
    words = F.size(F.filter(F.split(source, f"{WS}+"), lambda w: w.rlike(r"^[A-Za-z][a-z]+[,.;:]?\z")))
    lost, formulas = lost_citations(source, target), lost_math(source, target)
    return (
        F.when(strip(target) == "", "empty translation")
        .when(~target.rlike("[㐀-鿿]") & (words >= 4) & (F.length(source) > 25) & ~is_name_list(source), "not translated")
        .when(F.size(lost) > 0, F.concat(F.lit("lost citation ["), F.array_join(lost, ","), F.lit("]")))
        .when(math & (F.size(formulas) > 0), F.concat(F.lit("lost inline math "), F.array_join(formulas, " ")))
    )


# ---- sentences -------------------------------------------------------------

# Abbreviations that end in a dot without ending a sentence.
ABBREVIATIONS = frozenset(
    "al e.g i.e etc cf vs viz approx resp ca fig figs eq eqs ref refs sec secs tab tabs no nos vol vols pp p ch chap app appx alg thm def lem prop cor ex "
    "dr mr mrs ms prof st jr sr inc ltd co corp dept univ jan feb mar apr jun jul aug sep sept oct nov dec u.s u.k ph.d m.sc b.sc".split()
)
SHORT = 6
_stops = re.compile(rf"""[.!?][.!?"'”’)\]}}]*+(?={_PY_WS}|\Z)""")
_math = re.compile(INLINE_MATH)
_gap = re.compile(f"{_PY_WS}+")
_WORD = string.ascii_letters + "."


def _ends_sentence(text: str, stop: int, following: str) -> bool:
    """Whether the full stop at an offset may end a sentence that a given character follows."""
    before = text[max(0, stop - 40) : stop]
    word = before[len(before.rstrip(_WORD)) :].lower()
    if word.removesuffix(".") in ABBREVIATIONS and not (word == "etc" and "A" <= following <= "Z"):
        return False
    last = text[stop - 1 : stop]
    if len(word) == 1 and "A" <= last <= "Z":
        return False  # an initial
    return not (stop < 6 and last.isdecimal() and last.isascii() and text[max(0, stop - 4) : stop].strip().isdecimal())  # the number of a heading or list item


def sentence_ranges(source: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text; formulas hold no sentence ends, and fragments join a neighbour."""
    text = _math.sub(lambda m: "$" + "x" * (len(m[0]) - 2) + "$", source) if "$" in source else source
    cuts = [0]
    for m in _stops.finditer(text):
        end = m.end()
        gap = _gap.match(text, end)
        following = text[gap.end() : gap.end() + 1] if gap else ""
        if following and ("a" <= following <= "z" or "!" not in m[0] and "?" not in m[0] and not any(c == "." and _ends_sentence(text, m.start() + k, following) for k, c in enumerate(m[0]))):
            continue
        cuts.append(end)
    if cuts[-1] < len(text):
        cuts.append(len(text))
    out: list[tuple[int, int]] = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = text[a:b].lstrip(_WHITE)
        a = b - len(part)
        b = a + len(part.rstrip(_WHITE))
        if a == b:
            continue
        if out and (b - a < SHORT or out[-1][1] - out[-1][0] < SHORT):
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


@F.pandas_udf(RANGES_TYPE)
def sentences(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """sentence_ranges() over a column."""
    for s in texts:
        yield pd.Series([[{"start": a, "end": b} for a, b in sentence_ranges(t)] if t else [] for t in s], dtype=object)


# ---- the 53-bit hash -------------------------------------------------------

# Seeds and multipliers of the hash.
SEEDS = (0xDEADBEEF, 0x41C6CE57)
STEPS = (2654435761, 1597334677)
LAST = (2246822507, 3266489909)
_M32 = np.uint64(0xFFFFFFFF)


def hash53_values(texts: list[str]) -> np.ndarray:
    """The 53-bit hashes of texts, all of them one UTF-16 unit further in each step."""
    data = [np.frombuffer(t.encode("utf-16-le", "surrogatepass"), "<u2") for t in texts]
    size = np.array([len(d) for d in data], np.int64)
    order = np.argsort(-size, kind="stable")
    flat = np.concatenate(data).astype(np.uint64) if size.sum() else np.empty(0, np.uint64)
    start = (np.cumsum(size) - size)[order]
    left = np.bincount(size, minlength=int(size.max(initial=0)) + 1)
    h = [np.full(len(texts), s, np.uint64) for s in SEEDS]
    active = len(texts)
    for k in range(int(size.max(initial=0))):
        active -= int(left[k])
        unit = flat[start[:active] + k]
        for x, m in zip(h, STEPS, strict=True):
            x[:active] = (x[:active] ^ unit) * np.uint64(m) & _M32

    def mixed(a: np.ndarray, shift: int, m: int) -> np.ndarray:
        return (a ^ (a >> np.uint64(shift))) * np.uint64(m) & _M32

    a, b = h
    a = mixed(a, 16, LAST[0]) ^ mixed(b, 13, LAST[1])
    b = mixed(b, 16, LAST[0]) ^ mixed(a, 13, LAST[1])
    out = np.empty(len(texts), np.uint64)
    out[order] = (b & np.uint64(2097151)) << np.uint64(32) | a
    return out


@F.pandas_udf(LongType())
def _hash53(texts: pd.Series) -> pd.Series:
    return pd.Series(hash53_values([t or "" for t in texts]).astype(np.int64))


def hash53(c: Column) -> Column:
    """The hash as text in base 36, eleven characters."""
    return F.when(c.isNotNull(), F.lpad(F.lower(F.conv(_hash53(c).cast("string"), 10, 36)), 11, "0"))


def text_hash(c: Column) -> Column:
    """The hash of a text without regard to its white space: the key of its translation."""
    return hash53(collapsed(c))


def rich_runs(c: Column) -> Column:
    """A text as runs of plain text and formulas: array<struct<math, text>>, in order; formulas without their dollar signs."""
    parts = F.split(c, INLINE_MATH)
    found = F.regexp_extract_all(c, F.lit(INLINE_MATH), F.lit(1))
    pairs = F.transform(parts, lambda p, i: F.array(F.struct(F.lit(False).alias("math"), p.alias("text")), F.struct(F.lit(True).alias("math"), F.coalesce(F.get(found, i), F.lit("")).alias("text"))))
    return F.filter(F.flatten(pairs), lambda r: r["text"] != "")
