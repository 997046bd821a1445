"""LM scoring with Brown classes.

Words belong to classes; a text's probability is the product of class transitions and word emissions. All counts cover the whole
training corpus:

1. Each task codes its documents in blocks: a block has its own list of words (some 45,000), and documents are numbers in it, two bytes a token.
   Words are dealt to SLICES slices by hash; a slice numbers its words and counts them. Words cross the network once, texts never.
2. The TOP most frequent words get first classes by exchange clustering on their bigram counts (a table of at most
   (TOP + 2)**2 numbers): words move, one at a time, to the class that raises the likelihood of the class bigrams most, ROUNDS times at most; the parallel steps go on from there.
3. Then all words, the top ones too, make exchange steps in parallel: the counts of the present classes of ALL neighbours are gathered by word,
   and a word moves to the class that raises the likelihood most (to first order). A word without a class joins as soon as a neighbour has
   one. In a step every SHARE-th word may move, so that neighbours do not swap; a step that lowers the likelihood is taken back. It ends when SHARE steps
   one after another gain less than GAIN each.
4. From the training documents' classes come the class transitions; from them and the classes the scores.

The number of classes grows with the fourth root of the vocabulary (classes_for()). The driver and each worker hold the classes of all words, one
byte a word.

The end of a text is a token and a class of its own. Words seen once stand for unseen ones: what follows and precedes them
gives the probability of a new word, which is then spread evenly over as many words as are known.

Cases: null texts count as empty (only the end token); documents of any length are read whole; repeated ids and texts are rows of
their own; without training documents all counts are 0 and each token has probability 1 over V + 1 = 1; ties between classes go to
the lower number; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from math import log10
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import drop_written, held_out, importable, shuffles_removed, small, table, written

TOP, CLASSES, ROUNDS = 768, 20, 8
#: Codes of tokens: the end, an unknown word (or one without a class yet), then the classes; ONCE is added for words seen once.
END, NEW, FIRST, ONCE = 0, 1, 2, 128
SMOOTH = 1.0
#: Slices of the vocabulary; distinct words or documents at which a task closes a block; numbers that a task holds before it adds them up.
SLICES, BLOCK_WORDS, BLOCK_DOCS, HELD = 256, 45_000, 20_000, 1_000_000
#: A parallel step moves one in SHARE of the words, and small gains are under this share of the log-likelihood.
SHARE, GAIN = 3, 1e-4


def classes_for(vocabulary: int) -> int:
    """The number of classes: the fourth root of the vocabulary, CLASSES at least; a byte has room for ONCE - FIRST (252 million words)."""
    return min(ONCE - FIRST, max(CLASSES, round(vocabulary**0.25)))


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of texts in UTF-8: their distinct words by first appearance, each token as its word's place there, and where each text's tokens end.

    Arrow's ascii_lower changes A-Z only, and its white space is 0x20 and 0x09-0x0D. Null is empty.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, b"").view(pa.string())))
    words, ends = lists.flatten(), lists.offsets.to_numpy()[1:]
    full = pc.not_equal(pc.binary_length(words), 0)  # white space at an end of a text leaves an empty word there
    ends = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[ends]
    coded = words.filter(full).dictionary_encode()
    return coded.dictionary.view(pa.binary()), coded.indices.to_numpy(), ends


def _lists(words: pa.Array, ends: np.ndarray) -> pa.Array:
    """Words up to each end as one value, a line end between them (no word holds one)."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), words), b"\n")


CODED = "block bigint, slice int, doc_id bigint, training boolean, body binary, n binary"


def _arrow(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


def _width(words: int) -> type:
    return np.uint16 if words <= 1 << 16 else np.uint32


def _binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column: the values up to the first end, from there to the second, and so on."""
    offsets = np.concatenate([[0], ends * (values.nbytes // max(len(values), 1))]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())])


def _coded(slices: int, block_words: int):
    """Documents as numbers of their block's words (slice -1), and each block's words by slice with their training counts; words of a slice have adjacent numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, blocks = TaskContext.get().partitionId(), count()
        # of the documents that no block has yet: their words by first appearance, the slices of these, tokens as places among them, where documents end
        words, part, x, ends = pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        doc_ids: list[int | None] = []
        training: list[bool] = []

        def out(m: int) -> pa.RecordBatch:
            nonlocal words, part, x, ends, doc_ids, training
            end = int(ends[m - 1])
            size = int(x[:end].max(initial=-1)) + 1
            order = np.argsort(part[:size], kind="stable")
            place = np.empty(size, _width(size))
            place[order] = np.arange(size)
            bounds = np.searchsorted(part[order], np.arange(slices), "right")
            have = np.flatnonzero(np.diff(bounds, prepend=0))
            learned = np.repeat(np.array(training[:m], bool), np.diff(ends[:m], prepend=0))
            n = np.bincount(x[:end][learned], minlength=size)[order].astype(np.int64)
            block, none = task << 32 | next(blocks), len(have)
            rows = pa.RecordBatch.from_arrays([
                pa.array(np.full(m + none, block), pa.int64()), pa.array(np.concatenate([np.full(m, -1), have]), pa.int32()), pa.array(doc_ids[:m] + [None] * none, pa.int64()), pa.array(training[:m] + [None] * none, pa.bool_()),
                pa.concat_arrays([_binaries(place[x[:end]], ends[:m]), _lists(words.take(pa.array(order)), bounds[have])]), pa.concat_arrays([pa.nulls(m, pa.binary()), _binaries(n, bounds[have])]),
            ], ["block", "slice", "doc_id", "training", "body", "n"])
            rest, first = x[end:], np.full(len(words), -1)
            first[rest[::-1]] = np.arange(len(rest))[::-1]
            left = np.flatnonzero(first >= 0)
            left = left[np.argsort(first[left])]
            first[left] = np.arange(len(left))
            words, part, x, ends, doc_ids, training = words.take(pa.array(left)), part[left], first[rest], ends[m:] - end, doc_ids[m:], training[m:]
            return rows

        for whole in batches:
            for b in small(whole, 2):
                new, codes, stops = tokens(b.column(2))
                both = pa.concat_arrays([words, new]).dictionary_encode()
                added = _lists(both.dictionary.slice(len(words)), np.array([len(both.dictionary) - len(words)]))[0].as_py()
                if len(both.dictionary) > len(words):
                    part = np.concatenate([part, np.fromiter(map(crc32, added.split(b"\n")), np.int64) % slices])
                x, ends = np.concatenate([x, both.indices.to_numpy()[len(words) :][codes]]), np.concatenate([ends, stops + len(x)])
                words = both.dictionary
                doc_ids, training = doc_ids + b.column(0).to_pylist(), training + b.column(1).to_pylist()
                while len(words) >= block_words or len(ends) >= BLOCK_DOCS:
                    m = min(len(ends), BLOCK_DOCS)
                    if len(words) >= block_words:  # the document that has the last of so many words is the block's last
                        m = min(m, int(np.searchsorted(ends, np.argmax(x == block_words - 1), "right")) + 1)
                    yield out(m)
        if len(ends):
            yield out(len(ends))

    return run


INDEXED = "slice int, block bigint, number binary, n binary, words bigint, known bigint, total bigint"


def _indexed(top: int):
    """A slice's words get numbers; each block's words of the slice as numbers and whole counts. Block -1 has the slice's most frequent words and its sums. Rows come sorted by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, held = None, defaultdict(count().__next__), []

        def out() -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(ids), np.int64)
            for _, x, n in held:
                np.add.at(total, x, n)
            best = np.lexsort((np.arange(len(total)), -total))[:top]
            best = best[total[best] > 0].astype(np.int32)
            yield _arrow({
                "slice": ([at], pa.int32()), "block": ([-1], pa.int64()), "number": ([best.tobytes()], pa.binary()), "n": ([total[best].tobytes()], pa.binary()),
                "words": ([len(total)], pa.int64()), "known": ([int((total > 0).sum())], pa.int64()), "total": ([int(total.sum())], pa.int64()),
            })
            for lo in range(0, len(held), 500):
                part = held[lo : lo + 500]
                null = [None] * len(part)
                yield _arrow({
                    "slice": ([at] * len(part), pa.int32()), "block": ([b for b, _, _ in part], pa.int64()), "number": ([x.tobytes() for _, x, _ in part], pa.binary()),
                    "n": ([total[x].tobytes() for _, x, _ in part], pa.binary()), "words": (null, pa.int64()), "known": (null, pa.int64()), "total": (null, pa.int64()),
                })

        for b in batches:
            for k, block, body, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != at:
                    if held:
                        yield from out()
                    at, ids, held = k, defaultdict(count().__next__), []
                w = body.split(b"\n")
                held.append((block, np.fromiter(map(ids.__getitem__, w), np.int32, len(w)), np.frombuffer(n, np.int64)))
        if held:
            yield from out()

    return run


BLOCKS = "number binary, n binary, seen binary, slices binary, doc_ids array<bigint>, learned binary, others binary"


def _lines(docs: list[bytes], words: int) -> bytes:
    """Documents one after another, with an end (the number after the words') after each."""
    size = _width(words)().itemsize
    tokens = np.frombuffer(b"".join(docs), _width(words))
    x = np.full(len(tokens) + len(docs), words, _width(words + 1))
    inside = np.ones(len(x), bool)
    inside[np.cumsum([len(d) // size + 1 for d in docs], dtype=np.int64) - 1] = False
    x[inside] = tokens
    return x.tobytes()


def _joined(starts, types: tuple[type, type]):
    """One row a block: its words' numbers and counts (and the counts up to 2, a byte each) and the slices' ends among them, and its documents, learned ones first. Rows come sorted by block and slice, documents first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = starts.value
        at, docs, words = None, [], []

        def out() -> pa.RecordBatch:
            slices, size = np.array([k for k, _, _ in words], np.int64), np.array([len(x) // 4 for _, x, _ in words], np.int64)
            number = np.frombuffer(b"".join(x for _, x, _ in words), np.int32) + np.repeat(first[slices], size)
            n = np.frombuffer(b"".join(n for _, _, n in words), np.int64)
            ends = np.zeros(len(first), np.int64)
            ends[slices] = size
            learned, others = ([x for x in docs if bool(x[1]) == t] for t in (True, False))
            return _arrow({
                "number": ([number.astype(types[0]).tobytes()], pa.binary()), "n": ([n.astype(types[1]).tobytes()], pa.binary()), "seen": ([np.minimum(n, 2).astype(np.uint8).tobytes()], pa.binary()),
                "slices": ([np.cumsum(ends).tobytes()], pa.binary()), "doc_ids": ([[d for d, _, _ in learned + others]], pa.list_(pa.int64())),
                "learned": ([_lines([x for _, _, x in learned], len(number))], pa.binary()), "others": ([_lines([x for _, _, x in others], len(number))], pa.binary()),
            })

        for whole in batches:
            for b in small(whole, 4):
                for block, k, d, t, body, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if block != at:
                        if docs:
                            yield out()
                        at, docs, words = block, [], []
                    if k < 0:
                        docs.append((d, t, body))
                    else:
                        words.append((k, body, n))
        if docs:
            yield out()

    return run


class _Block:
    """A row of the blocks: what its columns hold, of those that were read; tokens are its documents, an end after each."""

    def __init__(self, row: dict, types: tuple[type, type]):
        self.number = np.frombuffer(row["number"], types[0])
        if "n" in row:
            self.n = np.frombuffer(row["n"], types[1])
        if "seen" in row:
            self.seen = np.frombuffer(row["seen"], np.uint8)
        if "slices" in row:
            self.slices = np.frombuffer(row["slices"], np.int64)
        self.ids = row.get("doc_ids")
        self.end = len(self.number)
        self.tokens = np.frombuffer(row["learned"] + row.get("others", b""), _width(self.end + 1))

    def line(self, values: np.ndarray) -> np.ndarray:
        """Each token as its word's value, ends as 0."""
        return np.append(values, values.dtype.type(0))[self.tokens]


def _rows(batches: Iterator[pa.RecordBatch], types: tuple[type, type]) -> Iterator[_Block]:
    for b in batches:
        for i in range(b.num_rows):
            yield _Block(b.slice(i, 1).to_pylist()[0], types)


def _before(x: np.ndarray) -> np.ndarray:
    """What stands before each place of a line (the end of a text before the first)."""
    return np.concatenate([np.zeros(min(1, len(x)), x.dtype), x[:-1]])


def _pair_counts(of, size: int, types: tuple[type, type]):
    """Counts of pairs of values that stand side by side in the training documents; of(block) gives the values of its words, under size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros(size * size, np.int64), []

        def add() -> None:
            nonlocal total, held
            total += np.bincount(np.concatenate(held), minlength=size * size)
            held = []

        for block in _rows(batches, types):
            x = block.line(of(block).astype(np.int32))
            held.append(_before(x) * np.int32(size) + x)
            if sum(map(len, held)) > HELD:
                add()
        if held:
            add()
        at = np.flatnonzero(total)
        yield _arrow({"pair": (at, pa.int64()), "n": (total[at], pa.int64())})

    return run


def _tops(top):
    """Numbers from 1 of the top words; others have len(top) + 1."""

    def of(block: _Block) -> np.ndarray:
        numbers, rank = top.value
        i = np.minimum(np.searchsorted(numbers, block.number), len(numbers) - 1)
        return np.where(numbers[i] == block.number, rank[i] + 1, len(numbers) + 1)

    return of


def _codes(own):
    """The codes of a block's words: their classes, ONCE added for words seen once; words not learned are NEW."""
    return lambda block: np.where(block.seen > 0, own.value[block.number] + np.where(block.seen == 1, ONCE, 0).astype(np.uint8), NEW).astype(np.uint8)


def _contexts(own, size: int, step: int, types: tuple[type, type]):
    """By slice and block, of the words that may move in this step: their numbers and counts, and the codes before and after them, a byte each; a table of counts instead for frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _rows(batches, types):
            codes = own.value[block.number]
            may = (block.number + step) % SHARE == 0
            may |= codes == NEW
            x = block.line(codes)
            at = np.flatnonzero(np.append(may, False)[block.tokens])
            word = block.tokens[at]
            order = np.argsort(word, kind="stable")
            at, word = at[order], word[order]
            pair = np.stack([x[at - 1], x[at + 1]], 1)  # a line ends with the end of a text, which so stands before its first word too
            n = np.bincount(word, minlength=len(codes))
            often = n > 4 * size
            rare = ~often & (n > 0)
            frequent = np.flatnonzero(often)
            row = np.cumsum(often) - 1
            inside = often[word]
            cells = row[word[inside]][:, None] * (2 * size) + pair[inside] + [0, size]
            tables = np.bincount(cells.reshape(-1), minlength=len(frequent) * 2 * size).astype(np.uint32)
            kept = np.cumsum(np.where(often, 0, n))

            def upto(sums: np.ndarray, ends=block.slices) -> np.ndarray:
                return np.concatenate([[0], sums])[ends]

            have = np.flatnonzero(np.diff(upto(np.cumsum(n)), prepend=0))
            words, tokens, tabled = upto(np.cumsum(rare))[have], upto(kept)[have], upto(np.cumsum(often))[have]
            columns = [
                pa.array(have, pa.int32()), _binaries(block.number[rare], words), _binaries(n[rare].astype(np.uint16), words), _binaries(pair[~inside].reshape(-1), 2 * tokens),
                _binaries(block.number[frequent], tabled), _binaries(tables, 2 * size * tabled),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["slice", "number", "n", "beside", "often", "table"])

    return run


def moves(hist: np.ndarray, weights: np.ndarray, own: np.ndarray) -> np.ndarray:
    """New codes of words. hist: (words, 2 * size) counts of the codes before and after them; weights: what one neighbour adds to each class.

    A word without any neighbour in a class stays as it is; a word moves only where that betters its score.
    """
    score = hist @ weights
    best = score.argmax(1)
    here = score[np.arange(len(own)), np.maximum(own.astype(np.int64) - FIRST, 0)]
    some = hist.sum(1) > hist[:, NEW] + hist[:, hist.shape[1] // 2 + NEW]
    move = some & ((own == NEW) | (score.max(1, initial=-np.inf) > here + 1e-6))
    return np.where(move, best + FIRST, own).astype(np.uint8)


def _steps(own, weights, starts, sizes, types: tuple[type, type]):
    """The words' new codes, a row for each slice. Rows come sorted by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        wide = len(w)
        at, hist = None, None

        def out() -> pa.RecordBatch:
            first, size = starts.value[at], sizes.value[at]
            old = own.value[first : first + size]
            return _arrow({"slice": ([at], pa.int32()), "codes": ([moves(hist, w, old).tobytes()], pa.binary())})

        for b in batches:
            slices = b.column(0).to_numpy()
            ends = [*(np.flatnonzero(np.diff(slices)) + 1).tolist(), len(slices)]
            for lo, hi in zip([0, *ends], ends, strict=False):
                if lo == hi:
                    continue
                k = int(slices[lo])
                if k != at:
                    if at is not None:
                        yield out()
                    at, hist = k, np.zeros((int(sizes.value[k]), wide), np.float32)
                first = starts.value[k]
                for i in range(lo, hi, 100):  # rows of one slice, so many at a time
                    number, n, beside, often, table = (b"".join(c.slice(i, min(hi - i, 100)).to_pylist()) for c in b.columns[1:])
                    word = np.repeat(np.frombuffer(number, types[0]) - first, np.frombuffer(n, np.uint16))
                    pair = np.frombuffer(beside, np.uint8).reshape(-1, 2)
                    for c in (0, 1):
                        np.add.at(hist.reshape(-1), word * wide + pair[:, c] + c * (wide // 2), np.float32(1))
                    np.add.at(hist, np.frombuffer(often, types[0]) - first, np.frombuffer(table, np.uint32).reshape(-1, wide).astype(np.float32))
        if at is not None:
            yield out()

    return run


def class_pairs(pairs: np.ndarray, size: int) -> np.ndarray:
    """Counts of code pairs without ONCE."""
    once = len(pairs) // 2
    return (pairs[:once, :once] + pairs[once:, :once] + pairs[:once, once:] + pairs[once:, once:])[:size, :size]


def log_likelihood(n: np.ndarray) -> float:
    """Of the class bigrams; words without a class are one more class."""
    f = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    return f(n) - f(n.sum(0)) - f(n.sum(1))


def weights_of(n: np.ndarray) -> np.ndarray:
    """What a neighbour of each code, before and after a word, adds to the likelihood with the word in each class: (2 * size, classes)."""
    x = n + 0.1
    before = np.log(x) - np.log(x.sum(0))
    after = (np.log(x) - np.log(x.sum(1))[:, None]).T
    out = np.concatenate([before[:, FIRST:], after[:, FIRST:]])
    out[[NEW, len(n) + NEW]] = 0
    return out


def exchange(big: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Exchange clustering. big: bigram counts, (end, words by falling frequency, other) on both sides; the end and other keep classes of their own.

    Returns the class of each row: 0 the end, 1 to classes the words', classes + 1 other.
    """
    n = len(big)
    k = min(classes, max(n - 2, 0))
    own = np.zeros(n, np.int64)
    own[1:-1] = 1 + np.arange(n - 2) % max(k, 1)
    own[-1] = classes + 1
    size = classes + 2
    big = big.astype(np.float64)

    def xlogx(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)

    sums = np.zeros((size, size))
    np.add.at(sums, (own[:, None], own[None, :]), big)
    left, right = sums.sum(1), sums.sum(0)
    onehot = np.eye(size)
    for _ in range(rounds):
        moved = 0
        for w in range(1, n - 1):
            # what the word's bigrams add to each class, to the right and to the left, and with itself
            after, before = big[w] @ onehot[own], big[:, w] @ onehot[own]
            self_n = big[w, w]
            a = own[w]
            after[a] -= self_n
            before[a] -= self_n
            base = sums.copy()
            base[a, :] -= after
            base[:, a] -= before
            base[a, a] -= self_n
            nl, nr = after.sum() + self_n, before.sum() + self_n
            lo, ro = left.copy(), right.copy()
            lo[a] -= nl
            ro[a] -= nr
            cand = slice(1, k + 1)
            gain = (xlogx(base + after[None, :]) - xlogx(base)).sum(1) + (xlogx(base + before[:, None]) - xlogx(base)).sum(0)
            d = np.diagonal(base)
            # the diagonal cell takes all three
            gain += xlogx(d + after + before + self_n) + xlogx(d) - xlogx(d + after) - xlogx(d + before)
            gain -= xlogx(lo + nl) - xlogx(lo) + xlogx(ro + nr) - xlogx(ro)
            b = 1 + int(np.argmax(gain[cand]))
            if b != a and gain[b] > gain[a] + 1e-9:
                moved += 1
                own[w] = b
            else:
                b = a
            sums = base
            sums[b, :] += after
            sums[:, b] += before
            sums[b, b] += self_n
            left, right = lo, ro
            left[b] += nl
            right[b] += nr
        if not moved:
            break
    return own


def probabilities(pairs: np.ndarray, classes: int, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """From counts of code pairs (2 * once, 2 * once): log10 of transitions by code (2 * once, 2 * once), and log10 of what each code's class emits in all.

    A token of a new word gets log10 of 1 / (vocabulary + 1) besides its transition.
    """
    size, once = FIRST + classes, len(pairs) // 2
    code = np.arange(2 * once)
    cls = np.where(code >= once, code - once, code)
    cls = np.where(cls < size, cls, NEW)
    into = np.zeros((2 * once, size))
    np.add.at(into.T, cls, pairs.T)  # by the class of the second
    n = np.zeros((size, size))
    np.add.at(n, cls, into)
    n[NEW] += into[code >= once].sum(0)  # words seen once stand for new ones, as what comes first
    new = np.zeros(size)
    np.add.at(new, cls, pairs[:, code >= once].sum(1))
    new[NEW] += pairs[code >= once][:, code >= once].sum()
    total = n.sum(1)
    p_new = (new + 0.5) / (total + 1)
    prior = n[np.arange(size) != NEW].sum(0) + 0.01
    prior[NEW] = 0
    prior /= prior.sum()
    trans = (1 - p_new)[:, None] * (n + SMOOTH * prior) / (total + SMOOTH)[:, None]
    trans[:, NEW] = p_new
    emitted = np.zeros(size)
    np.add.at(emitted, cls, pairs.sum(0))
    logs = np.log10(np.maximum(trans, 1e-300))
    give = -np.log10(np.maximum(emitted, 1))
    give[END], give[NEW] = 0, -log10(vocabulary + 1)
    return logs[cls][:, cls], give[cls]


def _scored(own, model, types: tuple[type, type]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trans, give = model.value
        of = _codes(own)
        for block in _rows(batches, types):
            x = block.line(of(block))
            ends = block.tokens == block.end
            docs = len(block.ids)
            place = np.cumsum(ends) - ends

            def sums(values: np.ndarray, place=place, docs=docs, tokens=block.tokens) -> np.ndarray:
                return np.bincount(place, np.append(values, 0)[tokens], docs)

            score = np.bincount(place, trans[_before(x), x] + give[x], docs) + sums(np.log10(np.maximum(block.n, 1)))
            yield _arrow({
                "doc_id": (block.ids, pa.int64()), "n_tokens": (np.bincount(place, ~ends, docs).astype(np.int64), pa.int64()), "n_known": (sums(block.n > 0).astype(np.int64), pa.int64()),
                "base": (sums(np.log10(block.n + 1.0)), pa.float64()), "score": (score, pa.float64()),
            })

    return run


def brown_scores(docs: DataFrame, *args, **kwargs) -> DataFrame:
    """See _brown_scores(); the shuffle files of its steps go as each step ends."""
    with shuffles_removed(docs.sparkSession):
        return _brown_scores(docs, *args, **kwargs)


def _brown_scores(docs: DataFrame, is_training: Column, block: Column | None = None, top: int = TOP, classes: int | None = None, report: list | None = None) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 probability).

    is_training tells (by doc_id) which rows are learned from. classes is classes_for() the vocabulary where it is not given. block changes
    nothing: blocks are what a task reads. report collects a dict for each state of the classes (log-likelihood, words moved, words without a class).
    """
    spark = docs.sparkSession
    importable(spark)
    bc = spark.sparkContext.broadcast
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce(is_training, F.lit(False)).alias("training"), F.col("text").cast("binary").alias("text"))  # spares Python the decoding
    coded = written(rows.mapInArrow(_coded(SLICES, BLOCK_WORDS), CODED), "coded")
    n_docs, n_blocks, tasks = coded.where("slice < 0").agg(F.count_if("training"), F.countDistinct("block"), F.max(F.shiftright("block", 32)) + 1).first()
    words = coded.where("slice >= 0").select("slice", "block", "body", "n").repartition(parts, "slice").sortWithinPartitions("slice", "block")
    indexed = written(words.mapInArrow(_indexed(top), INDEXED), "indexed")
    sizes, best, v_all, n_all = np.zeros(SLICES, np.int64), [], 0, 0
    for r in indexed.where("block < 0").collect():  # a row for each slice
        sizes[r["slice"]] = r["words"]
        v_all, n_all = v_all + r["known"], n_all + r["total"]
        best += zip(np.frombuffer(r["n"], np.int64).tolist(), [r["slice"]] * top, np.frombuffer(r["number"], np.int32).tolist(), strict=False)
    starts = np.cumsum(sizes) - sizes
    classes = classes or classes_for(v_all)
    size = FIRST + classes
    v_known = v_all
    v_all, n_all = v_all + (1 if n_docs else 0), n_all + n_docs
    entries = indexed.where("block >= 0").selectExpr("block", "slice", "cast(null as bigint) as doc_id", "cast(null as boolean) as training", "number as body", "n")
    # blocks are dealt one after another, not by hash, and some four to a task at most, so that no task gets many and none grows with the input
    at = F.shiftright("block", 32) + (F.col("block").bitwiseAND((1 << 32) - 1)) * int(tasks or 1)
    dealt = max(parts, -(-n_blocks // 4))
    both = coded.where("slice < 0").unionByName(entries).repartitionById(dealt, F.pmod(at, F.lit(dealt)).cast("int")).sortWithinPartitions("block", "slice")
    # four bytes a number and count, wherever they fit
    types = (np.uint32 if sizes.sum() < 1 << 31 else np.int64, np.uint32 if n_all < 1 << 32 else np.int64)
    blocks = written(both.mapInArrow(_joined(bc(starts), types), BLOCKS), "blocks")
    drop_written(coded)
    drop_written(indexed)

    def counted(of, size: int) -> np.ndarray:
        out = np.zeros(size * size, np.int64)
        found = blocks.select("number", "seen", "learned").mapInArrow(_pair_counts(of, size, types), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
        for r in found.collect():  # at most size**2 rows
            out[r["pair"]] = r["n"]
        return out.reshape(size, size)

    own = np.full(int(sizes.sum()), NEW, np.uint8)
    best = sorted(best, key=lambda x: (-x[0], *x[1:]))[:top]
    if best:
        first = np.array([starts[k] + i for _, k, i in best])
        order = np.argsort(first)
        own[first] = 1 + exchange(counted(_tops(bc((first[order], order))), len(first) + 2), classes)[1:-1]
    pairs = counted(_codes(bc(own)), 2 * ONCE)
    now, step, moved, small_gains = log_likelihood(class_pairs(pairs, size)), 0, 0, 0

    def note() -> None:
        if report is not None:
            report.append({"step": step, "likelihood": now, "moved": moved, "without": v_known - int((own != NEW).sum()), "known": v_known, "classes": classes})

    note()
    while v_known and small_gains < SHARE:
        step += 1
        weights = bc(weights_of(class_pairs(pairs, size)).astype(np.float32))
        beside = blocks.select("number", "slices", "learned").mapInArrow(_contexts(bc(own), size, step, types), "slice int, number binary, n binary, beside binary, often binary, table binary")
        steps = beside.repartition(parts, "slice").sortWithinPartitions("slice").mapInArrow(_steps(bc(own), weights, bc(starts), bc(sizes), types), "slice int, codes binary")
        new = own.copy()
        for r in steps.collect():  # a byte a word
            new[starts[r["slice"]] : starts[r["slice"]] + sizes[r["slice"]]] = np.frombuffer(r["codes"], np.uint8)
        moved = int((new != own).sum())
        if not moved:
            small_gains += 1
            continue
        joined = bool(((own == NEW) & (new != NEW)).any())  # kept whatever the likelihood: it is not that of the same words
        then = counted(_codes(bc(new)), 2 * ONCE)
        better = log_likelihood(class_pairs(then, size))
        small_gains = 0 if joined or better - now > GAIN * abs(now) else small_gains + 1
        if joined or better > now:
            own, pairs, now = new, then, better
        note()
    chances = probabilities(pairs, classes, v_all)
    base = F.col("base") + log10(n_docs + 1) - F.col("n_tokens") * log10(n_all + v_all + 1)
    scored = blocks.select("number", "n", "seen", "doc_ids", "learned", "others").mapInArrow(_scored(bc(own), bc(chances), types), "doc_id bigint, n_tokens bigint, n_known bigint, base double, score double")
    scored = scored.selectExpr("doc_id", "n_tokens + 1 as n_tokens", f"n_known + {1 if n_docs else 0} as n_known", "base", "score")
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(int(n_all)).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score")


def op3_brown_lm(spark, sf_dir: str) -> DataFrame:
    """The contract's query over the whole documents table; it learns from rows that are not held out."""
    held = held_out("doc_id", 7, 2)
    out = brown_scores(table(spark, sf_dir, "documents"), ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
