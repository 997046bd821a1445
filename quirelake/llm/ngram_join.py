"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Equal texts are one node. A node's set is its shingles of N words (lower-cased, split at white space). Each of TREES
trees keeps LONGEST minima of the set, a byte of each, as one integer. All integers are sorted by tree; that order is the trees' prefix
tries, and one walk along it finds the branches, at any depth, that hold several nodes.

Matching starts at the longest prefix and shortens it for every node until pairs at the threshold are found with the target recall (recall_at()).
Nodes that then still have no link shorten it further, a byte at a time, down to SHORTEST. Two nodes are compared when they share a
branch at the depth that one of them has reached; that rule is the same for groups of any size. A branch gives one
edge a node, and connected groups of branches are compared exactly: within a group that fits a task by products of its document-shingle matrix,
and in larger groups block by block, for the pairs of blocks that share a branch. Links are counted where they are
found and passed on as spanning trees, so no list of pairs is ever made.

Cases: null texts count as empty; texts without words link to nothing, copies of them are one class; texts of fewer than N
words have one shingle, all their words; very long texts are compared whole; repeated ids and rows are rows of their own; a class takes the largest
of its ids (null ids are smallest); an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.llm.common import importable, keep_rows, small, table, written
from quirelake.llm.components import components

N, THRESHOLD = 5, 0.8
TREES, LONGEST, SHORTEST, RECALL = 24, 8, 5, 0.999
#: Words and nodes that one side of a comparison holds in a task (about: blocks are dealt by hash).
BLOCK_WORDS, BLOCK_NODES = 1_000_000, 400
REMEMBERED = 300_000

_rng = np.random.default_rng(8)
_MULTIPLY = _rng.integers(0, 2**63, TREES * LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(N)], np.uint64)


def words(text: str | None) -> list[str]:
    """The words that shingles are made of."""
    return (text or "").lower().split()


def recall_at(similarity: float, depth: int, trees: int = TREES) -> float:
    """The share of pairs of a similarity that match in a prefix of that length in some tree (a byte can match by chance too, which only adds)."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_length(threshold: float = THRESHOLD, target: float = RECALL, trees: int = TREES, longest: int = LONGEST) -> int:
    """From the longest prefix down, the first that reaches the target recall; 1 if none does."""
    depth = longest
    while depth > 1 and recall_at(threshold, depth, trees) < target:
        depth -= 1
    return depth


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def signatures(lists: list[list[str]]) -> np.ndarray:
    """The trees' integers of word lists, none of which is empty: (texts, TREES), unsigned."""
    spans = [max(len(w), N) for w in lists]  # shorter lists are padded and give one shingle
    flat = np.zeros(sum(spans) + N, np.uint64)
    at = 0
    for w, n in zip(lists, spans, strict=True):
        flat[at : at + len(w)] = np.fromiter(map(_hashes.__getitem__, w), np.uint64, len(w))
        at += n
    h = sum(flat[k : k + at] * _STEP[k] for k in range(N))
    h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    ends = np.cumsum(spans)
    inside = np.ones(at, bool)
    for k in range(1, N):
        inside[ends - k] = False
    h = h[inside]
    starts = np.concatenate([[0], np.cumsum([n - N + 1 for n in spans])[:-1]])
    out = np.zeros((len(lists), TREES), np.uint64)
    for j in range(TREES * LONGEST):
        least = np.minimum.reduceat(h * _MULTIPLY[j], starts)
        out[:, j // LONGEST] |= (least * _MIX >> np.uint64(56)) << np.uint64(8 * (LONGEST - 1 - j % LONGEST))
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in small(whole, 2, 1_000_000):
            lists = [words(t) for t in b.column(2).to_pylist()]
            full = [w for w in lists if w]
            sig = signatures(full).view(np.int64) if full else np.empty((0, TREES), np.int64)
            offsets = np.concatenate([[0], np.cumsum([TREES if w else 0 for w in lists])]).astype(np.int32)
            trees = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sig.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(w) for w in lists], pa.int64()), trees], ["doc_id", "key", "n_words", "trees"])


class Numbers(dict):
    """Numbers of words from 1 on, in the order in which they come."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self) + 1
        return n

    def of(self, text: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, text), np.int32, len(text))


def shingle_rows(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sets of lists of word numbers as distinct (text, shingle) numbers; shingles have one number exactly where all their words are equal."""
    spans = np.array([max(len(x), N) if len(x) else 0 for x in lists], np.int64)  # shorter lists are padded: 0 is no word
    total = int(spans.sum())
    if not total:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    flat, ends = np.zeros(total + N, np.int64), np.cumsum(spans)
    for x, end, n in zip(lists, ends.tolist(), spans.tolist(), strict=True):
        flat[end - n : end - n + len(x)] = x
    inside = np.ones(total, bool)
    for k in range(1, N):
        inside[ends[spans > 0] - k] = False
    s, size = flat[:total].copy(), int(flat.max()) + 1
    for k in range(1, N):  # numbers of pairs stay exact: each step renumbers
        s *= size
        s += flat[k : k + total]
        s = np.unique(s, return_inverse=True)[1].reshape(-1)
    del flat
    s = s[inside]
    width = int(s.max()) + 1
    s += np.repeat(np.arange(len(lists)) * width, spans)[inside]
    s = np.unique(s)
    return s // width, s % width


def shared(trees: np.ndarray, i: np.ndarray, j: np.ndarray, depth: int) -> np.ndarray:
    """Whether nodes i and j share a branch of that depth in some tree; trees: (nodes, TREES), unsigned."""
    out = np.zeros(len(i), bool)
    for lo in range(0, len(i), 100_000):
        at = slice(lo, lo + 100_000)
        out[at] = ((trees[i[at]] ^ trees[j[at]]) >> np.uint64(64 - 8 * depth) == 0).any(1)
    return out


def compare(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float = THRESHOLD, meet=None) -> tuple[np.ndarray, np.ndarray]:
    """Links of lists of word numbers among each other, or between the left and the right ones: (number of links, smallest member of its component) of each.

    meet(i, j) tells which pairs of places may link at all.
    """
    lists = left + (right or [])
    m, a = len(lists), len(left)
    own, s = shingle_rows(lists)
    size = np.bincount(own, minlength=m).astype(np.float64)
    several = np.bincount(s) > 1 if len(s) else np.empty(0, bool)
    keep = several[s] if len(s) else np.empty(0, bool)
    own, s = own[keep], (np.cumsum(several) - 1)[s[keep]] if len(s) else s
    order = np.argsort(s, kind="stable")
    own, s = own[order], s[order]
    rows, cols = (slice(0, a), slice(a, m)) if right is not None else (slice(0, m), slice(0, m))
    both = np.zeros((rows.stop - rows.start, cols.stop - cols.start))
    step = max(256, min(8192, 4_000_000 // max(m, 1)))
    for lo in range(0, int(s[-1]) + 1 if len(s) else 0, step):
        i, j = np.searchsorted(s, [lo, lo + step])
        x = np.zeros((m, step), np.float32)
        x[own[i:j], s[i:j] - lo] = 1
        both += x[rows] @ x[cols].T
    similar = both >= threshold * (size[rows][:, None] + size[cols][None, :] - both) - 1e-9
    similar &= both > 0
    i, j = np.nonzero(similar)
    i, j = i + rows.start, j + cols.start
    keep = i < j
    if meet is not None:
        keep[keep] = meet(i[keep], j[keep])
    i, j = i[keep], j[keep]
    links = np.bincount(i, minlength=m) + np.bincount(j, minlength=m)
    root = np.arange(m)
    while len(i):  # the smaller root of an edge wins, then roots are followed up
        old = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        np.minimum.at(root, old, root)
        root = root[root]
        if np.array_equal(root, old):
            break
    return links, root


def _walk(depths: tuple[int, ...]):
    """Along the sorted integers (tree, x, node) of a partition: of branches with several nodes their members as (depth, tree, node, hub), hub being the first of them.

    The branches at both ends of a partition, which may go on in the next one, come besides as (depth, tree, prefix, hub, alone).
    """
    kinds = {"depth": pa.int32(), "tree": pa.int32(), "inner": pa.int32(), "node": pa.int64(), "hub": pa.int64(), "prefix": pa.int64(), "alone": pa.bool_()}

    def rows(n: int, **columns) -> pa.RecordBatch:
        arrays = [pa.nulls(n, t) if k not in columns else pa.array([columns[k]] * n if np.isscalar(columns[k]) else columns[k], t) for k, t in kinds.items()]
        return pa.RecordBatch.from_arrays(arrays, list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of each depth the branch at hand: tree, prefix, first node and its next byte, whether it is alone, whether it is the partition's first
        at: dict[int, tuple] = {}

        def border(d: int) -> pa.RecordBatch:
            tree, prefix, hub, _, alone, _ = at[d]
            return rows(1, depth=d, tree=[tree], prefix=[prefix], hub=[hub], alone=[alone])

        for b in batches:
            if not b.num_rows:
                continue
            tree, x, node = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            for d in depths:
                prefix = x >> np.int64(64 - 8 * d)
                inner = ((x >> np.int64(56 - 8 * d)) & 255 if d < LONGEST else np.zeros_like(x)).astype(np.int32)
                start = np.ones(len(x), bool)
                start[1:] = (tree[1:] != tree[:-1]) | (prefix[1:] != prefix[:-1])
                if d in at:
                    start[0] = at[d][:2] != (tree[0], prefix[0])
                if d in at and start[0]:
                    if at[d][5]:
                        yield border(d)
                first = np.flatnonzero(start)
                # the branch that comes from the batch before, if it goes on, has number 0
                number = np.cumsum(start) - (1 if start[0] else 0)
                hubs = node[first] if start[0] else np.concatenate([[at[d][2]], node[first]])
                size = np.bincount(number, minlength=len(hubs))
                many = size > 1
                if not start[0]:
                    many[0] = True
                    if at[d][4]:
                        yield rows(1, depth=d, tree=[at[d][0]], inner=[at[d][3]], node=[at[d][2]], hub=[at[d][2]])
                keep = many[number]
                if keep.any():
                    yield rows(int(keep.sum()), depth=d, tree=tree[keep], inner=inner[keep], node=node[keep], hub=hubs[number[keep]])
                last = len(hubs) - 1
                if not start[0]:
                    if last:
                        at[d] = (*at[d][:4], False, at[d][5])
                        if at[d][5]:
                            yield border(d)
                elif last and d not in at:  # the partition's first branch ends in its first batch
                    at[d] = (int(tree[0]), int(prefix[0]), int(hubs[0]), int(inner[0]), not many[0], True)
                    yield border(d)
                is_first = d not in at or (at[d][5] and not last and not start[0])
                if last or start[0]:
                    k = first[-1]
                    at[d] = (int(tree[k]), int(prefix[k]), int(node[k]), int(inner[k]), not many[last], is_first)
                else:
                    at[d] = (*at[d][:4], False, at[d][5])
        for d in at:
            yield border(d)

    return run


def branches(nodes: DataFrame, depths: tuple[int, ...]) -> DataFrame:
    """Of nodes(node, trees), the members of trie branches that hold several: (depth, tree, inner, node, hub).

    hub is one of the branch's nodes and stands for it; inner is the member's next byte, which tells the branches below it apart.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = nodes.select("node", F.posexplode("trees").alias("tree", "x")).select("tree", "x", "node")
    # the node is in the order so that a branch with any number of nodes can be dealt to several tasks
    sorted_keys = keys.repartitionByRange(parts, "tree", "x", "node").sortWithinPartitions("tree", "x", "node")
    walked = written(sorted_keys.mapInArrow(_walk(depths), "depth int, tree int, inner int, node bigint, hub bigint, prefix bigint, alone boolean"), "branches")
    ends = walked.where("prefix is not null")
    over = ends.groupBy("depth", "tree", "prefix").agg(F.min("hub").alias("top"), F.count("*").alias("n")).where("n > 1").drop("n")
    # at most two rows a depth and partition
    over = F.broadcast(ends.join(F.broadcast(over), ["depth", "tree", "prefix"]).select("depth", "tree", "hub", "top", "alone", "prefix"))
    whole = walked.where("prefix is null").join(over.drop("alone", "prefix"), ["depth", "tree", "hub"], "left").select("depth", "tree", "inner", "node", F.coalesce("top", "hub").alias("hub"))
    lone = over.where("alone").join(nodes.select(F.col("node").alias("hub"), "trees"), "hub")
    inner = F.expr(f"cast(case when depth < {LONGEST} then shiftrightunsigned(trees[tree], 56 - 8 * depth) & 255 else 0 end as int)")
    return written(whole.unionByName(lone.select("depth", "tree", inner.alias("inner"), F.col("hub").alias("node"), F.col("top").alias("hub"))), "members")


def _verify(threshold: float, depth: int, again: bool):
    """Rows come sorted by (grp, bi, bj, side, node): the texts of a comparison one after another.

    Pairs link that share a branch of that depth. In a later round (again) those are left out that shared one a byte longer, and those of two nodes that are not open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, sides, opened, trees, lists, number = None, [], [], [], [], [], Numbers()
        out: list[tuple[int, int, int]] = []

        def close() -> None:
            if not nodes:
                return
            t, o, a = np.array(trees, np.int64).view(np.uint64).reshape(len(nodes), -1), np.array(opened), sides.count(0)

            def meet(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                ok = shared(t, i, j, depth)
                return ok & (o[i] | o[j]) & ~shared(t, i, j, depth + 1) if again else ok

            one = at[1] == at[2]
            links, root = compare(lists if one else lists[:a], None if one else lists[a:], threshold, meet)
            out.extend((n, k, nodes[r]) for n, k, r in zip(nodes, links.tolist(), root.tolist(), strict=True) if k)

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["node", "links", "root"])

        for whole in batches:
            for b in small(whole, 7):
                for g, bi, bj, side, node, is_open, tree, text in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 3, 4, 5, 6, 7)), strict=True):
                    if (g, bi, bj) != at:
                        close()
                        at, nodes, sides, opened, trees, lists, number = (g, bi, bj), [], [], [], [], [], Numbers()
                    if nodes and node == nodes[-1] and side == sides[-1]:
                        continue  # a repeated row of the text's own document
                    nodes.append(node)
                    sides.append(side)
                    opened.append(is_open)
                    trees.append(tree)
                    lists.append(number.of(words(text)))  # four bytes a word while the comparison is gathered
                if len(out) > 50_000:
                    yield batch()
                    out.clear()
        close()
        yield batch()

    return run


def _compared(members: DataFrame, held: DataFrame, threshold: float, depth: int, again: bool, block_words: int, block_nodes: int) -> DataFrame:
    """Links between nodes that share a branch of members(tree, node, hub, open): (node, links, root), a row for each comparison that found some.

    held(node, mark, n_words, trees, text) has the texts; mark is a hash of the text, so that blocks do not rest on the order of rows.
    """
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = written(components(members.selectExpr("node as a", "hub as b")), "candidates").withColumnRenamed("root", "grp")
    opened = members.groupBy("node").agg(F.max("open").alias("open"), F.collect_list(F.struct("tree", "hub")).alias("at"))  # a branch for each tree at most
    # groups too large for a task fall into blocks: nodes of one branch of the first tree stay together, unless the branch alone is too large
    about = held.select("node", "mark", "n_words", F.shiftrightunsigned(F.col("trees")[0], 64 - 8 * depth).alias("branch")).dropDuplicates(["node"])
    weight = written(grouped.join(opened, "node").join(about, "node"), "weights")
    parts_of = F.greatest(F.ceil(F.sum("n_words") / block_words), F.ceil(F.count("*") / block_nodes)).cast("int")
    sizes = written(weight.groupBy("grp").agg(parts_of.alias("blocks")).where("blocks > 1"), "sizes")
    zero, columns = F.lit(0).cast("bigint"), ("grp", "bi", "bj", "side", "node", "open")
    roles = weight.join(sizes, "grp", "left_anti").select("grp", zero.alias("bi"), zero.alias("bj"), F.lit(0).alias("side"), "node", "open")
    if sizes.limit(1).count():
        grown = written(weight.join(sizes, "grp", "left_semi").groupBy("grp", "branch").agg(parts_of.alias("salts")), "salts")
        by_branch = F.when(F.col("salts") > 1, F.xxhash64("branch", F.pmod("mark", F.col("salts")))).otherwise(F.pmod(F.xxhash64("branch"), 2 * F.col("blocks")))
        # nodes that only others look for have blocks of their own, which need not meet each other
        block = F.xxhash64(by_branch.cast("bigint"), F.col("open")).alias("block") if again else by_branch.cast("bigint").alias("block")
        placed = written(weight.join(sizes, "grp").join(grown, ["grp", "branch"]).select("node", "grp", block, "open", "at"), "placed")
        # pairs of blocks that share a branch; every block meets itself besides
        touched = placed.select("grp", "block", "open", F.inline("at")).groupBy("tree", "hub", "grp", "block").agg(F.max("open").alias("open"))
        met = touched.groupBy("tree", "hub", "grp").agg(F.collect_set(F.struct("block", "open")).alias("bs"))
        met = met.select("grp", F.explode("bs").alias("i"), "bs").select("grp", "i", F.explode("bs").alias("j")).where("i.block < j.block and (i.open or j.open)")
        pairs = written(met.selectExpr("grp", "i.block as bi", "j.block as bj").distinct(), "pairs")
        alone = placed.where("open") if again else placed
        roles = roles.unionByName(alone.select("grp", F.col("block").alias("bi"), F.col("block").alias("bj"), F.lit(0).alias("side"), "node", "open"))
        for side, name in ((0, "bi"), (1, "bj")):
            both = placed.drop("at").join(pairs.withColumnRenamed(name, "block"), ["grp", "block"]).withColumnRenamed("block", name)
            roles = roles.unionByName(both.withColumn("side", F.lit(side)).select(*columns))
    sent = roles.join(held.select("node", "trees", "text"), "node").select(*columns, "trees", "text")
    sent = sent.repartition(parts, "grp", "bi", "bj").sortWithinPartitions("grp", "bi", "bj", "side", "node")
    return written(sent.mapInArrow(_verify(threshold, depth, again), "node bigint, links bigint, root bigint"), "found")


def similar_groups(
    docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block_words: int = BLOCK_WORDS, block_nodes: int = BLOCK_NODES, shortest: int = SHORTEST
) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, key (SHA-256 of the text), class_id, class_docs, n_copies, n_links, root (a number of the class).

    class_id is the largest doc_id of the documents that links join, class_docs their number, n_copies the number of documents with this very
    text, n_links the number of other texts with a Jaccard similarity of at least the threshold.
    """
    spark = docs.sparkSession
    importable(spark)
    docs = docs.select("doc_id", "text")
    key = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("key")
    rows = written(docs.select("doc_id", key, "text").mapInArrow(_sketch, "doc_id bigint, key binary, n_words bigint, trees array<bigint>"), "sketches")
    nodes = written(
        rows.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("n_copies"), F.first("n_words").alias("n_words"), F.first("trees").alias("trees"))
        .withColumn("node", F.monotonically_increasing_id()), "nodes",
    )
    depth = prefix_length(threshold, recall)
    depths = tuple(range(depth, max(1, min(shortest, depth)) - 1, -1))
    members = branches(nodes, depths)
    candidates = members.select("node").distinct().join(nodes, "node").select("node", "doc_id", "key", "n_words", "trees")
    texts = docs.select(F.col("doc_id").alias("d"), key.alias("k"), "text")
    held = written(candidates.join(texts, F.expr("key = k and doc_id <=> d")).select("node", F.xxhash64("key").alias("mark"), "n_words", "trees", "text"), "held")
    found = None
    for d in depths:
        own = members.where(F.col("depth") == d).select("tree", "inner", "node", "hub")
        if found is None:
            found = _compared(own.withColumn("open", F.lit(True)), held, threshold, d, False, block_words, block_nodes)
            continue
        # branches that hold more than one branch of the depth before, and a node without a link
        linked = found.select("node").distinct().withColumn("closed", F.lit(True))
        own = own.join(linked, "node", "left").select("tree", "inner", "node", "hub", F.col("closed").isNull().alias("open"))
        grown = own.groupBy("tree", "hub").agg(F.min("inner").alias("lo"), F.max("inner").alias("hi"), F.max("open").alias("some")).where("lo < hi and some").select("tree", "hub")
        more = written(own.join(grown, ["tree", "hub"], "left_semi"), "shorter")
        if more.limit(1).count():
            found = written(found.unionByName(_compared(more, held, threshold, d, True, block_words, block_nodes)), "links")
    roots = components(found.selectExpr("node as a", "root as b"))
    single = found.groupBy("node").agg(F.sum("links").alias("links")).join(roots, "node", "left").select("node", "links", F.coalesce("root", "node").alias("root"))
    linked = written(nodes.select("node", "key", "doc_id", "n_copies").join(single, "node", "left").select("key", "doc_id", "n_copies", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("root", "node").alias("root")), "linked")
    classes = written(linked.groupBy("root").agg(F.max("doc_id").alias("class_id"), F.sum("n_copies").alias("class_docs")), "classes")
    info = written(linked.drop("doc_id").join(classes, "root").select("key", "root", "class_id", "class_docs", "n_copies", "n_links"), "info")
    return rows.select("doc_id", "key").join(info, "key").select("doc_id", F.lower(F.hex("key")).alias("key"), "class_id", "class_docs", "n_copies", "n_links", "root")


def op8_ngram_join(spark, sf_dir: str) -> DataFrame:
    """The query over the whole documents table: one row per document with its class and number of links."""
    return similar_groups(table(spark, sf_dir, "documents")).drop("key", "root")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) with one document of each class: the one with the largest doc_id (of several such, the first by its text's hash)."""
    groups = similar_groups(docs)
    first = F.row_number().over(Window.partitionBy("root").orderBy("key"))
    stay = groups.where("doc_id <=> class_id").select("doc_id", "key", first.alias("n")).where("n = 1").drop("n")
    return keep_rows(docs, F.sha2(F.coalesce("text", F.lit("")), 256), stay)
