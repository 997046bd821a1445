"""BPE encoding and decoding by a pair occurrence index.

The distinct new pre-tokens of a slice of a partition lie behind one another in one list of symbols. An index maps the rank
of each pair that can merge to all its positions. Ranks are taken from a heap in ascending order: all
positions of a rank merge from left to right, and the pairs that this makes beside them join the lists of
their ranks. No merge may make a pair of lower rank; this is verified when a vocabulary is loaded, and is why
the order equals merging text by text. Results are remembered by pre-token within bounds.

It reads tokenizer files with a BPE model, a byte-level alphabet, an end-of-word suffix, and the normalizers and
splitting that the file names (NFC, white space to one space, lower case); other files are refused.

Cases: null text counts as empty (no ids, empty text); special strings in texts give their own ids; texts of any length are
encoded whole, in slices; repeated rows are rows of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache, cached_property
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import fresh, importable, quoted, small, table, tokenizer_path

#: Entries of the memory of encoded pre-tokens in a Python worker; beyond it only those of the slice at hand stay.
REMEMBERED = 350_000


@cache
def classes() -> tuple[dict[str, str], str]:
    """Letters, numbers and white space as the installed tokenizers library knows them, as the insides of character classes; and the characters
    that the regex module puts elsewhere, or that Python lower-cases otherwise or (up to U+FFFF) does not know or normalizes to one beyond.

    Unicode versions differ in what is a letter; asking the library about every code point is the only rule that holds for all of them.
    """
    from tokenizers import Regex, normalizers

    text = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    insides, odd = {}, set()
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        ours = normalizers.Replace(Regex(f"[^{name}]+"), "").normalize_str(text)
        runs, last = [], -2
        for c in map(ord, ours):
            if c != last + 1:
                runs.append([c, c])
            runs[-1][1] = last = c
        insides[name] = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)
        odd |= set(ours) ^ set(regex.findall(name, text))
    lower = normalizers.Lowercase().normalize_str
    odd |= {c for c in text if c < "\U00010000" and (unicodedata.category(c) == "Cn" or unicodedata.normalize("NFC", c) >= "\U00010000")}
    for lo in range(0, len(text), 4096):
        part = text[lo : lo + 4096].replace("Σ", "")
        if lower(part) != part.lower():
            odd |= {c for c in part if lower(c) != c.lower()}
    return insides, "".join(sorted(odd))


def _ranges(inside: str) -> list[tuple[str, str]]:
    """The first and last characters of the runs of a character class as classes() writes it."""
    points = [chr(int(x, 16)) for x in re.findall(r"U([0-9a-f]{8})", inside)]
    return list(zip(points[::2], points[1::2], strict=True))


def _spelled(pattern: str, insides: dict[str, str]) -> str:
    """A pattern with the classes' insides in place of their names."""
    for name, inside in insides.items():
        pattern = pattern.replace(f"[{name}]", f"[{inside}]").replace(name, inside)
    return pattern


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in printable else next(rest)) for b in range(256)]


class Bpe:
    """A loaded vocabulary with the memory of one Python worker."""

    def __init__(self, spec: dict, kinds: tuple[dict[str, str], str] | None = None):
        self.spec, self.classes = spec, kinds or classes()
        model, self.suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not self.suffix or steps != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None or spec["post_processor"] is not None:
            raise ValueError("not a tokenizer file of the kind that this module reads")
        vocab = model["vocab"]
        self.token = {i: t for t, i in vocab.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merge = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        self.rank = {a << 20 | b: r for r, (a, b, _) in enumerate(self.merge)}
        made: dict[int, int] = {}
        for r, (_, _, c) in enumerate(self.merge):
            made.setdefault(c, r)
        last = {c: r for r, (_, _, c) in enumerate(self.merge)}
        if any(last.get(a, -1) >= r or last.get(b, -1) >= r for r, (a, b, _) in enumerate(self.merge)):
            raise ValueError("a merge comes before one that makes its parts")
        chars = byte_alphabet()
        self.inner, self.final = [vocab[c] for c in chars], [vocab[c + self.suffix] for c in chars]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if not self.pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"):  # no pre-token holds white space, so runs of it need not be made one
            raise ValueError("not a splitting that leaves out white space")
        insides, odd = self.classes
        narrow = {k: "".join(f"\\u{ord(a):04x}-\\u{ord(min(b, chr(0xFFFF))):04x}" for a, b in _ranges(v) if a < chr(0x10000)) for k, v in insides.items()}
        self.plain = re.compile(_spelled(self.pattern, narrow)).findall
        self.wide = regex.compile(self.pattern, regex.V0).findall
        self.odd = frozenset(odd)
        self.may_differ = re.compile(f"[{re.escape(''.join(c for c in odd if c < chr(0x10000)))}\U00010000-\U0010ffff]").search
        self.base = np.array(self.inner + self.final, object)  # each id is one object, so that texts share them
        self.first = np.full((512, 512), -1, np.int32)  # the ranks of pairs of bytes
        place = {t: i for i, t in enumerate(self.base.tolist())}
        for r, (x, y, _) in enumerate(self.merge):
            if x in place and y in place:
                self.first[place[x], place[y]] = r
        self.first[256:] = -1
        self.known: dict[str, tuple[int, ...]] = {}

    def __reduce__(self):
        return Bpe, (self.spec, self.classes)

    @cached_property
    def exact(self):
        """The pattern with the library's classes, and the library's own normalizer: for texts on which Python and the regex module differ."""
        from tokenizers import Regex, normalizers

        normal = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
        return regex.compile(_spelled(self.pattern, self.classes[0]), regex.V0).findall, normal.normalize_str

    def pretokens(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings.

        Classes spelled out are quick up to U+FFFF and slow beyond; so texts with characters beyond use the regex module's own classes,
        unless a character stands elsewhere in them.
        """
        if text.isascii():
            return self.plain(text.lower())
        if not self.may_differ(text):
            # lower-casing is by character: a final sigma is none of its own
            return self.plain(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        if self.odd.isdisjoint(text) and "Cn" not in map(unicodedata.category, text):
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            if self.odd.isdisjoint(text):
                return self.wide(text)
        find, normal = self.exact
        return find(normal(text))

    def learn(self, words: list[str]) -> None:
        """Encode distinct pre-tokens through one pair occurrence index, into the memory."""
        if not words:
            return
        data = [w.encode() for w in words]
        ends = np.cumsum([len(d) for d in data])
        kind = np.frombuffer(b"".join(data), np.uint8).astype(np.int64)
        kind[ends - 1] += 256
        sym = self.base[kind].tolist()
        found = self.first[kind[:-1], kind[1:]]
        at = np.flatnonzero(found >= 0)
        at = at[np.argsort(found[at], kind="stable")]
        ranks, starts = np.unique(found[at], return_index=True)
        index: dict[int, list[int]] = {r: x.tolist() for r, x in zip(ranks.tolist(), np.split(at, starts[1:]), strict=True)} if len(at) else {}
        links = np.arange(1, len(kind) + 1)
        links[ends - 1] = -1
        after = links.tolist()
        links = np.arange(-1, len(kind) - 1)
        links[ends[:-1]] = -1
        before, rank = links.tolist(), self.rank
        active = list(index)
        heapify(active)
        while active:
            r = heappop(active)
            a, b, c = self.merge[r]
            for i in sorted(index.pop(r)):
                j = after[i]
                if sym[i] != a or j < 0 or sym[j] != b:
                    continue  # a part has gone into another merge
                k, p = after[j], before[i]
                sym[i], sym[j], after[i] = c, -1, k
                if k >= 0:
                    before[k] = i
                    s = rank.get(c << 20 | sym[k])
                    if s is not None:
                        if s in index:
                            index[s].append(i)
                        else:
                            index[s] = [i]
                            heappush(active, s)
                if p >= 0:
                    s = rank.get(sym[p] << 20 | c)
                    if s is not None:
                        if s in index:
                            index[s].append(p)
                        else:
                            index[s] = [p]
                            heappush(active, s)
        keep = np.array(sym) >= 0
        cuts = np.concatenate([[0], np.cumsum(keep)[ends - 1]]).tolist()
        left = tuple([s for s in sym if s >= 0])
        self.known.update((w, left[a:b]) for w, (a, b) in zip(words, pairwise(cuts), strict=True))

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text."""
        split = []
        for t in texts:
            parts = self.split_special(t) if t and "<" in t else [t or ""]
            split.append([[p] if k % 2 else self.pretokens(p) for k, p in enumerate(parts)])
        words = set(chain.from_iterable(p for parts in split for p in parts[::2]))
        if len(self.known) + len(words) > REMEMBERED:
            self.known = {w: self.known[w] for w in words if w in self.known}
        new = [w for w in words if w not in self.known]
        self.learn(new)
        known = self.known
        return [list(chain.from_iterable([self.special[p[0]]] if k % 2 else chain.from_iterable(map(known.__getitem__, p)) for k, p in enumerate(parts))) for parts in split]

    def decode(self, ids: list[int]) -> str:
        """The text of ids. The file names no decoder, so tokens stand as in the vocabulary, a space between them."""
        return " ".join(map(self.token.__getitem__, ids))


def load(path: str) -> Bpe:
    """Read a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        return Bpe(json.load(f))


def _encode(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model.value
        for whole in batches:
            for b in small(whole, 0, 2_000_000):
                ids = bpe.encode(b.column(0).to_pylist())
                text = pa.array(map(bpe.decode, ids), pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(ids, pa.list_(pa.int32())), text], [*b.schema.names[1:], "ids", "decoded"])

    return run


def bpe_encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of docs: the kept columns (one named like a result gets an underscore), ids (array<int>) and decoded (the text that decoding the ids gives).

    The vocabulary (of fixed size) is broadcast.
    """
    spark = docs.sparkSession
    importable(spark)
    at = [f"c{i}" for i in range(len(keep))]  # kept columns may have any names
    kept = "".join(f"{a} {docs.schema[c].dataType.simpleString()}, " for a, c in zip(at, keep, strict=True))
    rows = docs.select(quoted(text).alias("body"), *[quoted(c).alias(a) for a, c in zip(at, keep, strict=True)])
    out = rows.mapInArrow(_encode(spark.sparkContext.broadcast(load(path))), f"{kept}ids array<int>, decoded string")
    names = fresh(["ids", "decoded"], *keep)
    return out.toDF(*names, "ids", "decoded")


def digests(encoded: DataFrame) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 in place of ids and decoded."""
    return encoded.select(
        *[c for c in encoded.columns if c not in ("ids", "decoded")], F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    """The contract's query over the whole documents table."""
    return digests(bpe_encode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))
