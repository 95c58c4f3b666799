"""SimHash near-duplicates through a binary trie self-join.

A fingerprint has 64 bits. Two that differ in at most `bits` of them agree wholly on `n_blocks - bits` of any `n_blocks`
blocks of bits. So for each choice of that many blocks the distinct fingerprints are dealt by the chosen blocks, and
the binary trie over the remaining bits is joined with itself in each deal: pairs of nodes descend together, the
differing bits above them add up, and a pair goes as soon as they exceed the budget. A trie is a sorted array here, a
node a range of it; pairs of nodes descend as vectors. Links become a spanning forest on the spot: a pair of nodes whose
leaves are all connected already isn't followed, so a group of near copies costs links in proportion to its size, not to
its square. Components then grow over the forest's edges by alternating stars, with a checkpoint each round.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table, text_bytes

SHINGLE, BITS, SEED, BLOCKS = 4, 4, 42, 6
#: Fingerprints that a task joins at once (a deal is never split), and node pairs that descend at once.
HELD, PAIRS = 100_000, 1 << 18


def simhash(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of a text: A-Z lower-cased, shingles of `width` words, XXH64, bits set in over half."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], "<u8")
    out, half = 0, len(hashes) / 2
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        total += np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    for bit in np.flatnonzero(total > half):
        out |= 1 << int(bit)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. Null and blank texts have fingerprint zero."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.array([simhash(x, width, seed) for x in text_bytes(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(fingerprint, f"doc_id {id_type}, fp long")


def block_masks(n_blocks: int, bits: int) -> list[tuple[int, int]]:
    """(agreeing mask, remaining mask) for each choice of the n_blocks - bits blocks that agree."""
    if not bits < n_blocks <= 64:
        raise ValueError("n_blocks must be over bits and 64 at most")
    edges = [round(64 * k / n_blocks) for k in range(n_blocks + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    full = (1 << 64) - 1
    return [(m, full ^ m) for m in (sum(c) for c in combinations(blocks, n_blocks - bits))]


class _Forest:
    """Connected leaves of a sorted array: a label for each leaf, and where labels change along the array."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)
        self._refresh()

    def _refresh(self) -> None:
        while not np.array_equal(up := self.parent[self.parent], self.parent):
            self.parent = up
        self.label = self.parent
        self.changes = np.concatenate(([0], np.cumsum(self.label[1:] != self.label[:-1])))

    def link(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Connects a[i] with b[i]; the pairs that joined two trees."""
        new, parent = [], self.parent
        apart = np.flatnonzero(self.label[a] != self.label[b])
        for i, j in zip(a[apart].tolist(), b[apart].tolist()):
            x, y = i, j
            while parent[x] != x:
                x = parent[x]
            while parent[y] != y:
                y = parent[y]
            if x != y:
                parent[max(x, y)] = min(x, y)
                new.append((i, j))
        if new:
            self._refresh()
        return new

    def connected(self, l1, r1, l2, r2) -> np.ndarray:
        """Where all leaves of both ranges are connected."""
        c = self.changes
        return (c[r1 - 1] == c[l1]) & (c[r2 - 1] == c[l2]) & (self.label[l1] == self.label[l2])


def trie_self_join(keys: np.ndarray, rest: np.ndarray, bits: int, forest_only: bool = True, held: int = PAIRS) -> list[tuple[int, int]]:
    """Pairs (i, j) of equal key whose `rest` differ in `bits` bits or fewer; rows are sorted by (key, rest), distinct.

    With `forest_only` just enough pairs to connect what all pairs connect; otherwise all of them.
    """
    n = len(keys)
    if n < 2:
        return []
    forest, found = _Forest(n), []
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    ends = np.append(starts[1:], n)
    many = ends - starts > 1
    starts, ends = starts[many], ends[many]
    # A frontier: the bit to look at next, and for each pair of nodes their ranges and their differing bits so far.
    stack = [(63, starts, ends, starts, ends, np.zeros(len(starts), np.int8))] if len(starts) else []
    while stack:
        bit, l1, r1, l2, r2, errors = stack.pop()
        if len(l1) > held:
            for k in range(0, len(l1), held):
                stack.append((bit, l1[k : k + held], r1[k : k + held], l2[k : k + held], r2[k : k + held], errors[k : k + held]))
            continue
        if forest_only:
            go = ~forest.connected(l1, r1, l2, r2)
            go |= (l1 == l2) & (r1 - l1 > 1) & (forest.changes[r1 - 1] != forest.changes[l1])
        else:
            go = np.ones(len(l1), bool)
        go &= (l1 != l2) | (r1 - l1 > 1)
        # Two single leaves: count what is left of them at once.
        leaf = go & (r1 - l1 == 1) & (r2 - l2 == 1)
        if leaf.any():
            a, b = l1[leaf], l2[leaf]
            near = np.bitwise_count(rest[a] ^ rest[b]) <= bits
            a, b = a[near], b[near]
            found += forest.link(a, b) if forest_only else list(zip(a.tolist(), b.tolist()))
        go &= ~leaf
        if not go.any() or bit < 0:
            continue
        l1, r1, l2, r2, errors = l1[go], r1[go], l2[go], r2[go], errors[go]
        m1, m2 = _split(rest, l1, r1, bit), _split(rest, l2, r2, bit)
        same = l1 == l2
        parts = []
        for (a, b), (c, d), cost in (((l1, m1), (l2, m2), 0), ((m1, r1), (m2, r2), 0), ((l1, m1), (m2, r2), 1), ((m1, r1), (l2, m2), 1)):
            keep = (b > a) & (d > c) & (errors + cost <= bits)
            if cost and a is m1:
                keep &= ~same  # a node with itself: its two halves meet once
            parts.append((a[keep], b[keep], c[keep], d[keep], (errors + cost)[keep].astype(np.int8)))
        # Equal bits go on top of the stack, so near leaves are connected before far ones are compared.
        for own in (parts[2:], parts[:2]):
            joined = [np.concatenate(x) for x in zip(*own)]
            if len(joined[0]):
                stack.append((bit - 1, *joined))
    return found


def _split(rest: np.ndarray, left: np.ndarray, right: np.ndarray, bit: int) -> np.ndarray:
    """For each range the first place whose `bit` is set, by bisection of all ranges at once."""
    lo, hi = left.copy(), right.copy()
    mask = np.uint64(1 << bit)
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        high = np.zeros(len(lo), bool)
        high[open_] = (rest[mid[open_]] & mask) != 0
        hi = np.where(open_ & high, mid, hi)
        lo = np.where(open_ & ~high, mid + 1, lo)
    return lo


def links(nodes: DataFrame, bits: int = BITS, n_blocks: int = BLOCKS, forest_only: bool = True) -> DataFrame:
    """(a, b): ids of `nodes` (node, fp; fingerprints distinct) that link. See trie_self_join() for `forest_only`."""
    masks = block_masks(n_blocks, bits)
    signed = [m - (1 << 64) if m >> 63 else m for m, _ in masks]
    deals = F.explode(F.array(*[F.struct(F.lit(k).alias("deal"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for k, m in enumerate(signed)]))
    rows = nodes.select("node", "fp", deals.alias("x")).select("node", "fp", "x.deal", "x.key")
    rows = rows.repartition("deal", "key").sortWithinPartitions("deal", "key", "fp")
    agree = np.array([m for m, _ in masks], np.uint64)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(node: np.ndarray, fp: np.ndarray, deal: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
            rest = fp.view(np.uint64) & ~agree[deal]
            group = np.cumsum(np.concatenate(([0], (deal[1:] != deal[:-1]) | (key[1:] != key[:-1]))))
            order = np.lexsort((rest, group))
            pairs = np.array(trie_self_join(group[order], rest[order], bits, forest_only), np.int64).reshape(-1, 2)
            a, b = node[order[pairs[:, 0]]], node[order[pairs[:, 1]]]
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        rest: list[np.ndarray] | None = None
        for batch in batches:
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            rest = new if rest is None else [np.concatenate(x) for x in zip(rest, new)]
            if len(rest[0]) < HELD:
                continue
            deal, key = rest[2], rest[3]
            cuts = np.flatnonzero((deal[1:] != deal[:-1]) | (key[1:] != key[:-1])) + 1
            if len(cuts):
                yield joined(*[x[: cuts[-1]] for x in rest])
                rest = [x[cuts[-1] :] for x in rest]
        if rest is not None and len(rest[0]):
            yield joined(*rest)

    return rows.mapInArrow(join, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for each node that has an edge (a, b).

    Alternating stars: each node's larger neighbours move to its least neighbour, then its smaller ones do, until no
    edge changes. Every round is checkpointed; the driver gets two numbers a round.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    member = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return member.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, n_blocks: int = BLOCKS, width: int = SHINGLE, seed: int = SEED
) -> DataFrame:
    """(doc_id, fp, component_id) for each row of `docs`.

    component_id is the smallest doc_id reachable over links, the document's own included; fingerprints link at `bits`
    differing bits or fewer, equal ones and zero ones too. Null and blank texts have fingerprint zero. Rows of equal
    doc_id each come back, in the component of their own fingerprint. A null doc_id is kept and never names a
    component, unless all ids of the component are null. An empty table gives an empty one.
    """
    fps = cut(fingerprints(docs, id_col, text_col, width, seed))
    groups = _groups(fps, bits, n_blocks)
    whole = groups.join(_least(groups), "component").select("fp", "component_id")
    return fps.join(cut(whole), "fp", "left").select("doc_id", "fp", "component_id")


def leaders(fps: DataFrame, bits: int = BITS, n_blocks: int = BLOCKS) -> DataFrame:
    """(component_id): the smallest doc_id of each component of `fps` (doc_id, fp), null where all of them are."""
    return _least(_groups(fps, bits, n_blocks)).select("component_id")


def _groups(fps: DataFrame, bits: int, n_blocks: int) -> DataFrame:
    """(fp, least, component) for each fingerprint: its smallest doc_id, and the smallest fingerprint reachable.

    Fingerprints are their own nodes: an id can be the smallest of several that aren't linked, or be null.
    """
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(nodes.select(F.col("fp").alias("node"), "fp"), bits, n_blocks))
    return cut(nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component")))


def _least(groups: DataFrame) -> DataFrame:
    return groups.groupBy("component").agg(F.min("least").alias("component_id"))


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of `documents`, by near_duplicates(), which states the odd cases."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
