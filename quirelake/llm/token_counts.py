"""Token counts with the whole-token shortcut, for sentencepiece BPE models with an identity normalizer.

Such a model marks spaces by U+2581 and puts one before the text. Where no piece holds that mark behind
another character, no merge crosses from a word into the next mark, so a text falls into pre-tokens that encode
alone; a line feed that stands in no longer piece is a pre-token too. Both are verified when a model is loaded.

Loading also proves which vocabulary strings encode alone as one token, by merging each of them
(a string may be in the vocabulary and still be out of reach of the merges). Pre-tokens found there count one;
the rest are merged by rank and remembered. Characters outside the vocabulary count their UTF-8 bytes.

Cases: null text counts as empty (0 tokens); texts of any length are counted whole, in slices; ids may be null
or repeat, each row is a row of its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quirelake.llm.common import importable, small, table, tokenizer_path

MARK = "▁"
#: Entries of the memory of merged pre-tokens in a Python worker; beyond it the memory is emptied.
REMEMBERED = 1_000_000
NONE = 1 << 30


class Counter(dict):
    """Tokens by pre-token, filled as pre-tokens come. Pre-tokens have spaces for the mark."""

    def __init__(self, rank: dict[str, int], whole: frozenset[str]):
        super().__init__()
        self.rank, self.whole = rank, whole

    def __reduce__(self):
        return Counter, (self.rank, self.whole)

    def __missing__(self, word: str) -> int:
        n = 1 if word in self.whole else self.merged(word)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = n
        return n

    def merged(self, word: str) -> int:
        """Tokens of a pre-token, by merging the pair of least rank (the leftmost of equal ones) until none is left."""
        rank, parts = self.rank, list(word)
        parts = self._heap(parts) if len(parts) > 100 else self._short(parts)
        return sum([1 if p in rank else len(p.encode()) for p in parts])

    def _short(self, parts: list[str]) -> list[str]:
        get = self.rank.get
        ranks = [get(a + b, NONE) for a, b in pairwise(parts)]
        while ranks:
            r = min(ranks)
            if r == NONE:
                break
            i = ranks.index(r)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(parts[i] + parts[i + 1], NONE)
            if i:
                ranks[i - 1] = get(parts[i - 1] + parts[i], NONE)
        return parts

    def _heap(self, parts: list[str | None]) -> list[str]:
        """The same for long pre-tokens, in n*log(n) steps."""
        get, n = self.rank.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a + b) for i, (a, b) in enumerate(pairwise(parts)) if (r := get(a + b)) is not None]
        heapify(heap)
        while heap:
            _, i, both = heappop(heap)
            if parts[i] is None or after[i] >= n or parts[i] + parts[after[i]] != both:
                continue
            j = after[i]
            parts[i], parts[j], after[i] = both, None, after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n and (r := get(s := parts[left] + parts[after[left]])) is not None:
                    heappush(heap, (r, left, s))
        return [p for p in parts if p is not None]

    def count(self, text: str) -> int:
        """Tokens of a text."""
        if not text:
            return 0
        return sum(map(self.__getitem__, _pre(" " + text.replace(MARK, " "))))


_pre = re.compile(r" +[^ \n]*|[^ \n]+|\n").findall


def load(path: str) -> Counter:
    """Read a model, verify what the pre-tokens rest on and prove the whole tokens."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = [i for i in range(len(m)) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
    pieces = [m.id_to_piece(i) for i in normal]
    if any(MARK in p.lstrip(MARK) or ("\n" in p and len(p) > 1) for p in pieces) or m.encode("  a \nÅÅ", out_type=str)[-2:] == ["Å", "Å"]:
        raise ValueError("not a model whose words encode alone and that leaves texts as they are")
    order = sorted(normal, key=lambda i: (-m.get_score(i), i))
    rank = {m.id_to_piece(i).replace(MARK, " "): k for k, i in enumerate(order)}
    c = Counter(rank, frozenset())
    return Counter(rank, frozenset(p for p in rank if _pre(p) == [p] and c.merged(p) == 1))


def _run(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = model.value.count
        for whole in batches:
            for b in small(whole, 1):
                n = [count(t) if t else 0 for t in b.column(1).to_pylist()]
                size = pc.cast(pc.fill_null(pc.binary_length(b.column(1)), 0), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_bytes, n_tokens.

    The model (a vocabulary of fixed size) is broadcast.
    """
    spark = docs.sparkSession
    importable(spark)
    return docs.select("doc_id", "text").mapInArrow(_run(spark.sparkContext.broadcast(load(path))), "doc_id bigint, n_bytes bigint, n_tokens bigint")


def op4_token_counts(spark, sf_dir: str, limit: int = 4096) -> DataFrame:
    """The contract's query over the whole documents table."""
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model")).selectExpr("*", f"n_tokens > {limit} as over_limit")
