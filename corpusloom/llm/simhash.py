"""SimHash near-duplicates by a binary trie's join with itself.

Fingerprints are made where the texts lie; only ``(doc_id, fingerprint)`` moves on. Equal fingerprints are
one class, so a group of copies of any size is one row in the join.

The join walks pairs of nodes of a binary trie over the fingerprints, adds up differing bits, and prunes a
pair of nodes once the budget is exceeded. To deal the walk out, the 64 bits are cut into blocks: two
fingerprints within the budget of ``k`` bits agree on all but ``k`` blocks, so for each choice of the other
blocks the fingerprints are permuted to put those first, and the trie's subtrees below that prefix are
joined, each with itself. The number of blocks grows with the number of fingerprints, so that subtrees stay
small; the answer is the same for any number. A subtree that many near copies share is walked further before it is
dealt out: its next bits, in the order that splits it most evenly, tell nodes, and each pair of nodes whose bits differ
within the budget is a task's work, while all other pairs are pruned. Every task reports only a spanning forest of the
links it finds, never all pairs of a group, and components are found by distributed star contraction.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, materialize, partitions, read, shielded
from .components import connected_components

SHINGLE, SEED, BUDGET = 4, 42, 4
#: Fingerprints that a subtree holds on average before more blocks are used, and before it is split by nodes.
SUBTREE, SPLIT = 64, 4096
#: Bits at most by which a large subtree is told into nodes.
NODE_BITS = 16
#: Fingerprints that a task of the join takes, over all of its subtrees.
TASK = 100_000
#: Pairs of nodes walked at once, and the largest product of two nodes' sizes that is compared outright.
FRONTIER, OUTRIGHT = 1 << 16, 64


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash: a bit is 1 if it is set in over half the XXH64 of the shingles, repeats included.

    bytes.lower() changes A-Z alone, and bytes.split() splits at space and TAB to CR alone.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()[shingle - 1 :] or [len(joined)]
    counts, n, digest = np.zeros(64, np.int64), len(ends), xxhash.xxh64_digest
    for i in range(0, n, 1 << 15):  # long texts by pieces
        got = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + (1 << 15)], ends[i : i + (1 << 15)], strict=False)])
        counts += np.unpackbits(np.frombuffer(got, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``fp``, the fingerprint as a signed long."""

    def make(texts: list[str | None]) -> dict[str, np.ndarray]:
        return {"fp": np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)}

    return map_texts(docs, make, "fp long", keep)


def choices(n: int, budget: int = BUDGET) -> list[tuple[list[tuple[int, int]], tuple[int, ...]]]:
    """The blocks of bits, as ``(first, width)``, and for each table the blocks that must be equal.

    ``budget + 1`` blocks at least, more as ``n`` grows: a prefix of log2(n / SUBTREE) bits is wanted.
    """
    want = math.log2(max(2, n / SUBTREE))
    blocks = budget + 1
    while blocks < 4 * budget and (blocks - budget) * (64 // blocks) < want:
        blocks += 1
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    spans = [(a, b - a) for a, b in itertools.pairwise(edges)]
    return [(spans, keep) for keep in itertools.combinations(range(blocks), blocks - budget)]


def permute(fp: np.ndarray, spans: list[tuple[int, int]], keep: tuple[int, ...]) -> tuple[np.ndarray, int]:
    """The fingerprints with the blocks ``keep`` first, and how many bits those have."""
    out = np.zeros_like(fp)
    for first, width in [spans[i] for i in keep] + [s for i, s in enumerate(spans) if i not in keep]:
        out = (out << np.uint64(width)) | ((fp >> np.uint64(64 - first - width)) & np.uint64((1 << width) - 1))
    return out, sum(spans[i][1] for i in keep)


class Forest:
    """Union-find over ``n`` nodes, by arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.root[x]
            if (up == x).all():
                return x
            x = self.root[up]

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Hooks larger roots under smaller ones until all of the pairs agree."""
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))


def trie_join(keys: np.ndarray, depth: int, budget: int, forest: Forest, starts: np.ndarray, ends: np.ndarray, others: tuple[np.ndarray, np.ndarray] | None = None) -> None:
    """Walks pairs of trie nodes; links the places of all keys within ``budget`` bits of each other.

    ``keys`` are sorted within each of the ranges ``starts:ends``, which are subtrees that share their first
    ``depth`` bits. With ``others``, subtrees are joined with those ranges in place of themselves; ``depth`` bits
    of the two may differ. A node is a range of keys, and its children meet where the next bit turns 1.
    Pairs of nodes whose keys are in one component already are dropped: nothing could come of them.
    """
    ones: dict[int, np.ndarray] = {}

    def cut(d: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if d not in ones:
            ones[d] = np.concatenate([[0], np.cumsum((keys >> np.uint64(63 - d)) & np.uint64(1), dtype=np.int32)])
        return hi - (ones[d][hi] - ones[d][lo])

    if others is None:
        stack = [(depth, starts, ends, starts, ends, np.zeros(len(starts), np.int8))]
    else:
        high = (keys[starts] ^ keys[others[0]]) >> np.uint64(64 - depth) if depth else np.zeros(len(starts), np.uint64)
        stack = [(depth, starts, ends, *others, np.bitwise_count(high).astype(np.int8))]
    while stack:
        d, a0, a1, b0, b1, diff = stack.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack += [(d, *(x[s] for x in (a0, a1, b0, b1, diff))) for s in (slice(half), slice(half, None))]
            continue
        same = (a0 == b0) & (a1 == b1)
        live = (diff <= budget) & (a0 < a1) & (b0 < b1) & ~(same & (a1 - a0 < 2))
        a0, a1, b0, b1, diff, same = (x[live] for x in (a0, a1, b0, b1, diff, same))
        if not len(a0):
            continue
        live = ~joined(forest, a0, a1, b0, b1)
        small = live & (((a1 - a0) * (b1 - b0) <= OUTRIGHT) | (d == 64))
        if small.any():
            compare(keys, budget, forest, *(x[small] for x in (a0, a1, b0, b1)))
        live &= ~small
        a0, a1, b0, b1, diff, same = (x[live] for x in (a0, a1, b0, b1, diff, same))
        if not len(a0):
            continue
        am, bm = cut(d, a0, a1), cut(d, b0, b1)
        cross = ~same
        new = [np.concatenate(x) for x in zip(
            (am, a1, bm, b1, diff), (a0, am, bm, b1, diff + 1), (a0, am, b0, bm, diff),
            tuple(x[cross] for x in (am, a1, b0, bm, diff + 1)), strict=True)]
        stack.append((d + 1, *new))


def joined(forest: Forest, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
    """Which pairs of nodes have all their keys in one component."""
    roots = forest.roots(np.arange(len(forest.root)))
    forest.root = roots
    turns = np.concatenate([[0], np.cumsum(roots[1:] != roots[:-1])])
    return (turns[a0] == turns[a1 - 1]) & (turns[b0] == turns[b1 - 1]) & (roots[a0] == roots[b0])


def compare(keys: np.ndarray, budget: int, forest: Forest, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> None:
    """All pairs of two small nodes' keys (or of large nodes whose keys are all equal)."""
    wide = b1 - b0
    count = (a1 - a0) * wide
    for part in np.array_split(np.arange(len(count)), max(1, int(count.sum()) // (FRONTIER * 8) + 1)):
        n = count[part]
        which = np.repeat(part, n)
        k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        i, j = a0[which] + k // wide[which], b0[which] + k % wide[which]
        near = (i != j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
        forest.link(i[near], j[near])


def forest_of(fp: np.ndarray, prefix: int, key: np.ndarray, chunk: np.ndarray, pair: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one task's rows: ``fp`` permuted, subtrees told apart by ``key``, by their first ``prefix`` bits.

    Of a subtree that is split, the rows of ``pair`` (nodes ``i`` and ``j`` as ``i << 32 | j``) are one joint: those of
    node ``i`` (``chunk``) with those of ``j``, or with themselves. Subtrees that aren't split have one node, 0.
    """
    order = np.lexsort((fp, chunk, pair, key))
    fp, key, chunk, pair = fp[order], key[order], chunk[order], pair[order]
    new = (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])
    at = np.flatnonzero(np.concatenate([[True], new | (chunk[1:] != chunk[:-1])]))
    end = np.concatenate([at[1:], [len(fp)]])
    forest = Forest(len(fp))
    self_joined = (pair[at] >> 32) == (pair[at] & 0xFFFFFFFF)
    trie_join(fp, prefix, budget, forest, at[self_joined], end[self_joined])
    first = np.flatnonzero(~self_joined[:-1] & ~self_joined[1:] & (key[at[:-1]] == key[at[1:]]) & (pair[at[:-1]] == pair[at[1:]]))
    if len(first):
        trie_join(fp, prefix, budget, forest, at[first], end[first], (at[first + 1], end[first + 1]))
    roots = forest.roots(np.arange(len(fp)))
    far = np.flatnonzero(roots != np.arange(len(fp)))
    return order[far], order[roots[far]]


def links(classes: DataFrame, n: int, budget: int = BUDGET, split: int = SPLIT) -> DataFrame:
    """``(a, b)``: links between fingerprints within ``budget`` bits, enough of them to connect all that are linked.

    Subtrees of more than ``split`` fingerprints are told into nodes, and each pair of nodes that isn't pruned is a task's
    work. With w bits a fingerprint goes to as many pairs as there are nodes within the budget of its own: all of them for
    few bits, but for many a small part.
    """
    tables = choices(n, budget)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy().view(np.uint64)
            for t, (spans, keep) in enumerate(tables):
                moved, bits = permute(fp, spans, keep)
                yield pd.DataFrame({"t": np.int32(t), "prefix": (moved >> np.uint64(64 - bits)).view(np.int64), "moved": moved.view(np.int64)})

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b for b in batches if len(b)]
        if not got:
            return
        rows = pd.concat(got, ignore_index=True)
        for t, mine in rows.groupby("t"):
            spans, keep = tables[t]
            moved = mine["moved"].to_numpy().view(np.uint64)
            a, b = forest_of(moved, sum(spans[i][1] for i in keep), mine["prefix"].to_numpy(), mine["chunk"].to_numpy(), mine["pair"].to_numpy(), budget)
            yield pd.DataFrame({"a": restore(moved[a], spans, keep).view(np.int64), "b": restore(moved[b], spans, keep).view(np.int64)})

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of large subtrees, once for each pair of nodes that they are in."""
        for b in batches:
            for order, mine in b.groupby(b["bits"].map(tuple)):
                moved = mine["moved"].to_numpy().view(np.uint64)
                node = node_of(moved, order)
                for flips in within(len(order), budget):
                    other = node ^ flips
                    pair = (np.minimum(node, other) << 32) | np.maximum(node, other)
                    yield pd.DataFrame({"t": mine["t"], "prefix": mine["prefix"], "moved": mine["moved"], "chunk": node, "pair": pair})

    dealt = materialize(classes.select("fp").mapInPandas(spread, "t int, prefix long, moved long"), "simhash_tables")
    large = dealt.groupBy("t", "prefix").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > split).select("t", "prefix", "size")
    large = materialize(large, "simhash_large")
    if large.isEmpty():
        each = dealt.withColumns({"chunk": F.lit(0).cast("long"), "pair": F.lit(0).cast("long")})
    else:
        ones = [F.sum(F.shiftrightunsigned("moved", 63 - i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(64)]
        told = dealt.join(large, ["t", "prefix"]).groupBy("t", "prefix", "size").agg(*ones)
        even = F.array(*(F.struct(F.abs(F.col(f"b{i}") * 2 - F.col("size")).alias("odd"), F.lit(i).alias("bit")) for i in range(64)))
        many = F.least(F.lit(NODE_BITS), F.ceil(F.log2(F.col("size") / split)).cast("int"))
        told = materialize(told.select("t", "prefix", F.transform(F.slice(F.array_sort(even), F.lit(1), many), lambda x: x["bit"]).alias("bits")), "simhash_nodes")
        dealt = dealt.join(told, ["t", "prefix"], "left")
        small = dealt.where("bits is null").select("t", "prefix", "moved", F.lit(0).cast("long").alias("chunk"), F.lit(0).cast("long").alias("pair"))
        each = small.unionByName(dealt.where("bits is not null").mapInPandas(nodes, "t int, prefix long, moved long, chunk long, pair long"))
    parts = max(partitions(classes.sparkSession), n * len(tables) // TASK)
    return each.repartition(parts, "t", "prefix", "pair").mapInPandas(join, "a long, b long")


def node_of(moved: np.ndarray, order: tuple[int, ...]) -> np.ndarray:
    """The node that each fingerprint is in: its bits at the places in ``order``."""
    node = np.zeros(len(moved), np.int64)
    for bit in order:
        node = (node << 1) | ((moved >> np.uint64(63 - bit)) & np.uint64(1)).astype(np.int64)
    return node


def within(bits: int, budget: int) -> Iterator[int]:
    """All patterns of ``bits`` bits with ``budget`` ones at most."""
    for k in range(min(bits, budget) + 1):
        for places in itertools.combinations(range(bits), k):
            yield sum(1 << p for p in places)


def restore(moved: np.ndarray, spans: list[tuple[int, int]], keep: tuple[int, ...]) -> np.ndarray:
    """The inverse of ``permute``."""
    out, left = np.zeros_like(moved), 64
    for first, width in [spans[i] for i in keep] + [s for i, s in enumerate(spans) if i not in keep]:
        left -= width
        out |= ((moved >> np.uint64(left)) & np.uint64((1 << width) - 1)) << np.uint64(64 - first - width)
    return out


def components(prints: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``(fp, component, component_id)`` of all classes of ``prints`` (``doc_id``, ``fp``).

    ``component`` is the component's smallest fingerprint as a long, ``component_id`` its smallest doc_id.
    """
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash_classes")
    stars = connected_components(links(classes, classes.count(), budget))
    joined = classes.join(stars, classes["fp"] == stars["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    return joined.join(least, "component").select("fp", "component", "component_id")


def simhash_components(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row of ``docs`` (``doc_id``, ``text``; other columns are left out).

    Null, empty or blank text has fingerprint zero and is linked as any other. A text of fewer than four words
    is one shingle. Rows that share a doc_id are rows of their own. A null doc_id is no component's id unless
    all of its component's are null. Empty table: empty result.
    """
    prints = materialize(fingerprints(docs), "simhash_prints")
    of = components(prints, budget).withColumnRenamed("fp", "_fp")
    return prints.join(of, F.col("fp") == F.col("_fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(rows: DataFrame, of: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of one row of ``rows`` (``doc_id``, ``fp`` and others) for each component that ``of`` (``_fp``, ``component``) puts its ``fp`` in."""
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp"))
    stay = rows.select("doc_id", "fp").distinct().join(of, F.col("fp") == F.col("_fp")).groupBy("component").agg(first.alias("x"))
    # a join by one key that isn't a semi-join, which would be pushed below it: it deals rows out as the last step needs them, so that texts move once
    kept = rows.withColumn("_key", F.struct("doc_id", "fp")).join(stay.select(F.struct("x.doc_id", "x.fp").alias("_stay")).hint("merge"), F.col("_key") == F.col("_stay"))
    return kept.dropDuplicates(["_key"]).select(*columns)


def near_deduplicated(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One row of ``docs`` for each component, with its columns as they were: that of the smallest doc_id (null last).

    Of rows that share that doc_id, the one with the smallest fingerprint stays, and one of those that share both.
    """
    plain = shielded(docs, "doc_id", "text")
    prints = materialize(fingerprints(plain, tuple(plain.columns)), "simhash_rows")
    of = components(prints.select("doc_id", "fp"), budget).withColumnRenamed("fp", "_fp")
    return one_of_each(prints, of, plain.columns).toDF(*docs.columns)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read(spark, sf_dir, "documents"))
