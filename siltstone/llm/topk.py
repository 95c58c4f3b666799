"""Exact top-k by inner product over a bit-sliced index.

Vectors are quantised to integers. A block of rows is held as bitmaps: for each attribute and each bit, which rows have
that bit (values are moved by the attribute's least one, so none is negative). The score of a query over all rows of a
block is a sum of shifted bitmaps, done by carry-save adders on whole bitmaps: attributes go in groups of eight, the
sums of all subsets of a group are added once for a block, and a bit of the query's eight attributes picks one of them.
A query's sign bit picks a complement. The sum's slices are then walked from the most significant downward: rows that
must be in, and rows still tied; when the slices end, the tied rows have equal scores and those of least vec_id are taken.

Scores are exact integers of any size. Vectors are indexed apart by how many bits their largest component takes, in steps,
so a few huge ones don't widen the bitmaps of all others; blocks have fewer rows where they have more bits or attributes.
Queries meet the index in tiles: a task holds some blocks and as many queries as their components' number allows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions, table

SCALE, K, EVERY = 256, 5, 50
#: Rows to a block of the index at most, and bytes that its sums may take; blocks to a tile, and query components to one.
BLOCK_ROWS, SUM_BYTES, TILE_BLOCKS, TILE_QUERIES = 8192, 1 << 25, 16, 1 << 20
#: Attributes to a group; steps of bits by which vectors are indexed apart.
GROUP, STEP = 8, 24

_PAYLOAD = "block long, dims int, bits int, ids binary, lows binary, slices binary"
_FOUND = "query_id long, vec_id long, score long, beyond binary"
_MOST, _LEAST = (1 << 63) - 1, -(1 << 63)


def quantised(lists: list[list[float]], scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of each component: rows of equal length, short ones with zeros behind; Python integers where longs don't hold them."""
    out = np.zeros((len(lists), max(map(len, lists), default=0)))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    if not out.size or np.abs(out).max() < float(1 << 62) / scale:
        return np.floor(out * scale).astype(np.int64)
    whole = [[int(x) * scale if abs(x) >= 1 << 53 else math.floor(x * scale) for x in row] for row in out.tolist()]
    return np.array(whole, object)


def _beyond(score: int) -> bytes | None:
    """Bytes in the order of scores, for those at the bounds of a long and past them."""
    if _LEAST < score < _MOST:
        return None
    n = (abs(score).bit_length() + 7) // 8
    return (32768 + n).to_bytes(2) + score.to_bytes(n) if score > 0 else (32768 - n).to_bytes(2) + ((1 << 8 * n) + score).to_bytes(n)


def _bitmaps(bits: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1 as rows of 64-bit words, the first row lowest."""
    n = bits.shape[-1]
    padded = np.zeros((*bits.shape[:-1], -(-n // 64) * 64), np.uint8)
    padded[..., :n] = bits
    return np.packbits(padded, axis=-1, bitorder="little").view("<u8")


class BitSliced:
    """The index of a block: slices[attribute, bit] is a bitmap over rows in ascending order of id."""

    def __init__(self, ids: np.ndarray, lows: np.ndarray, slices: np.ndarray) -> None:
        self.ids, self.lows, self.slices = ids, lows, slices
        self.dims, self.bits, self.words = slices.shape
        self.low_bits = max((abs(int(x)).bit_length() for x in lows), default=0)
        self._sums: np.ndarray | None = None

    @classmethod
    def build(cls, ids: np.ndarray, values: np.ndarray) -> BitSliced:
        order = np.argsort(ids, kind="stable")
        ids, values = ids[order], values[order]
        lows = values.min(axis=0) if len(values) else np.zeros(values.shape[1], np.int64)
        moved = (values - lows).T if values.dtype == object else (values.astype(np.uint64) - lows.astype(np.uint64)).T
        bits = max(1, int(moved.max()).bit_length()) if moved.size else 1
        one, shift = (1, int) if moved.dtype == object else (np.uint64(1), np.uint64)
        return cls(ids, lows, np.stack([_bitmaps((moved >> shift(b) & one).astype(np.uint8)) for b in range(bits)], axis=1))

    @classmethod
    def unpack(cls, row: dict) -> BitSliced:
        """The index that pack() packed."""
        lows = np.array([int(x) for x in row["lows"].split()], object)
        return cls(np.frombuffer(row["ids"], "<i8"), lows, np.frombuffer(row["slices"], "<u8").reshape(row["dims"], row["bits"], -1))

    def pack(self) -> dict:
        lows = " ".join(str(int(x)) for x in self.lows).encode()
        return {"dims": self.dims, "bits": self.bits, "ids": self.ids.tobytes(), "lows": lows, "slices": self.slices.tobytes()}

    @property
    def sums(self) -> np.ndarray:
        """sums[group, subset, bit]: bitmaps of the sum of a subset of a group's attributes."""
        if self._sums is None:
            n_groups, wide = -(-self.dims // GROUP), self.bits + GROUP.bit_length()
            out = np.zeros((n_groups, 1 << GROUP, wide, self.words), np.uint64)
            for g in range(n_groups):
                for j, attribute in enumerate(range(g * GROUP, min(self.dims, (g + 1) * GROUP))):
                    base, own = out[g, : 1 << j], self.slices[attribute]
                    carry = np.zeros((1 << j, self.words), np.uint64)
                    for b in range(wide):
                        x = base[:, b]
                        y = own[b] if b < self.bits else np.uint64(0)
                        half = x ^ y
                        out[g, 1 << j : 2 << j, b] = half ^ carry
                        carry = x & y | half & carry
            self._sums = out
        return self._sums

    def scores(self, query: np.ndarray) -> tuple[np.ndarray, int]:
        """Slices of the score of every row, least bit first, and what is to be added to what they say."""
        sums = self.sums
        n_groups, _, wide, words = sums.shape
        q = np.zeros(n_groups * GROUP, query.dtype)
        own = min(len(query), self.dims)
        q[:own] = query[:own]
        q_bits = max(int(q.max()), -int(q.min()) - 1, 0).bit_length() + 1 if len(q) else 1
        total = wide + q_bits + n_groups.bit_length()
        shifts = np.arange(q_bits).astype(q.dtype)[:, None, None]
        picked = (q.reshape(n_groups, GROUP) >> shifts & 1).astype(np.int64) @ (1 << np.arange(GROUP))
        s, c = np.zeros((total, words), np.uint64), np.zeros((total, words), np.uint64)
        for bit in range(q_bits):
            top = bit == q_bits - 1
            for g in range(n_groups):
                subset = picked[bit, g]
                if not subset and not top:
                    continue
                x = np.zeros((total, words), np.uint64)
                x[bit : bit + wide] = ~sums[g, subset] if top else sums[g, subset]
                half = s ^ c
                carry = s & c | half & x
                s = half ^ x
                c[1:], c[0] = carry[:-1], 0
        out, carry = np.empty_like(s), np.zeros(words, np.uint64)
        for b in range(total):
            half = s[b] ^ c[b]
            out[b] = half ^ carry
            carry = s[b] & c[b] | half & carry
        # A complement of `wide` slices is 2^wide - 1 less the sum, so the sign bits' groups added so much too much.
        if q_bits + self.low_bits + own.bit_length() < 63:
            least = int(q[:own].astype(np.int64) @ self.lows[:own].astype(np.int64))
        else:
            least = sum(int(x) * int(y) for x, y in zip(q[:own], self.lows[:own]))
        return out, -n_groups * ((1 << wide) - 1 << q_bits - 1) + least

    def top(self, query: np.ndarray, k: int, own_id: int | None = None) -> list[tuple[int, int]]:
        """(id, score) of the k rows of highest score, ties to smaller ids; without rows of `own_id`."""
        n = len(self.ids)
        slices, offset = self.scores(query)
        tied = _bitmaps(np.ones((1, n), np.uint8))[0] if n else np.zeros(self.words, np.uint64)
        if own_id is not None:
            for at in range(*np.searchsorted(self.ids, [own_id, own_id + 1])):
                tied[at >> 6] &= ~np.uint64(1 << (at & 63))
        sure, n_sure = np.zeros_like(tied), 0
        for row in slices[::-1]:
            high = tied & row
            n_high = int(np.bitwise_count(high).sum())
            if n_sure + n_high > k:
                tied = high
                continue
            sure, n_sure = sure | high, n_sure + n_high
            tied = tied & ~row
            if n_sure == k:
                tied = np.zeros_like(tied)
                break
        at = np.concatenate((_places(sure), _places(tied)[: k - n_sure]))
        bits = slices[:, at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)
        score = [offset + sum(1 << b for b in np.flatnonzero(col).tolist()) for col in bits.T]
        return sorted(zip(self.ids[at].tolist(), score), key=lambda x: (-x[1], x[0]))


def _places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int, k: int, beyond_long: bool) -> DataFrame:
    """(vec_id, x, step, copies): vectors that take part, as doubles, and how often each is there, k times at most.

    No query needs more than k of several rows alike in id and vector, however many there are.
    """
    x = F.col(vector_col).cast("array<double>")
    picked = rows.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where("vec_id IS NOT NULL AND x IS NOT NULL")
    bound = math.inf if beyond_long else 2.0**63 / scale
    picked = picked.where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < bound)))
    size = F.array_max(F.transform("x", F.abs))
    bits = F.greatest(F.coalesce(F.log2(F.greatest(size, F.lit(2.0**-1000))), F.lit(0.0)) + math.log2(scale), F.lit(1.0))
    met = picked.groupBy("vec_id", "x").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("copies"))
    return met.select("vec_id", "x", F.ceil(bits / STEP).cast("int").alias("step"), "copies")


def _blocks(vectors: DataFrame, block_rows: int) -> tuple[DataFrame, int]:
    """`vectors` with a column block, and how many blocks there are. The driver gets a row for each step of bits: 50 at most."""
    steps = vectors.groupBy("step").agg(F.sum("copies").alias("n"), F.max(F.size("x")).alias("dims")).orderBy("step").collect()
    block, first = F.lit(None).cast("long"), 0
    for step, n, dims in steps:
        words = SUM_BYTES // (8 * (-(-max(1, dims) // GROUP) << GROUP) * (step * STEP + 1 + GROUP.bit_length()))
        n_blocks = -(-n // min(block_rows, 64 * max(1, words)))
        # The vector counts for the block too, so rows of one id are no block of their own.
        block = F.when(F.col("step") == step, first + F.pmod(F.xxhash64("vec_id", "x"), F.lit(n_blocks))).otherwise(block)
        first += n_blocks
    return vectors.withColumn("block", block), first


def build_index(vectors: DataFrame, block_rows: int = BLOCK_ROWS, scale: int = SCALE) -> tuple[DataFrame, int]:
    """A row to each block of `vectors` (vec_id, x, step, copies), block and what BitSliced needs; and the number of blocks."""

    def build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        values = quantised(rows["x"].to_pylist(), scale)
        copies = rows["copies"].to_numpy()
        index = BitSliced.build(np.repeat(rows["vec_id"].to_numpy(), copies), np.repeat(values, copies, axis=0))
        return pa.Table.from_pylist([{"block": key[0].as_py()} | index.pack()], schema=_arrow(_PAYLOAD))

    blocks, n = _blocks(vectors, block_rows)
    return blocks.select("block", "vec_id", "x", "copies").groupBy("block").applyInArrow(build, _PAYLOAD), n


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))])


def search(queries: DataFrame, index: DataFrame, n_blocks: int, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of `index` for each row of `queries` (vec_id, x, copies), its own id left out.

    Queries are dealt to ways, blocks to tiles; each way meets each tile in a group of its own, so a tile is sent once a
    way and a query once a tile. A meeting yields k rows a query at most, and the best k of those are the result.
    """
    spark = queries.sparkSession
    components, n_queries = queries.agg(F.sum(F.size("x")), F.count(F.lit(1))).first()
    tasks = 2 * partitions(spark)
    ways = max(1, -(-(components or 0) // TILE_QUERIES), min(n_queries, -(-tasks // max(1, n_blocks))))
    n_tiles = max(1, -(-n_blocks // TILE_BLOCKS), min(n_blocks, -(-tasks // ways)))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    asked = queries.select(spread(n_tiles).alias("tile"), F.pmod(F.xxhash64("vec_id", "x"), F.lit(ways)).alias("way"), "vec_id", "x", "copies")
    dealt = index.select("*", (F.col("block") % n_tiles).alias("tile"), spread(ways).alias("way"))

    def best(asked: pa.Table, blocks: pa.Table) -> pa.Table:
        ids, copies, rows = asked["vec_id"].to_pylist(), asked["copies"].to_pylist(), asked["x"].to_pylist()
        out = []
        if ids:
            vectors = [quantised([x], scale)[0] for x in rows]
            for row in range(blocks.num_rows):
                block = BitSliced.unpack({name: blocks[name][row].as_py() for name in ("dims", "bits", "ids", "lows", "slices")})
                for query, vector, times in zip(ids, vectors, copies):
                    found = block.top(vector, k, query)
                    out += [(query, v, min(max(s, _LEAST), _MOST), _beyond(s)) for v, s in found for _ in range(times)]
        columns = list(zip(*out)) or [()] * 4
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _arrow(_FOUND))], schema=_arrow(_FOUND))

    found = asked.groupBy("tile", "way").cogroup(dealt.groupBy("tile", "way")).applyInArrow(best, _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    every: int = EVERY,
    scale: int = SCALE,
    block_rows: int = BLOCK_ROWS,
    beyond_long: bool = False,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, the k other rows of highest score.

    Rows take no part where the id or vector is null, or a component is null or not finite. Rows of equal id are
    candidates each, but not of one another; where they are queries, the best of all their scores count. Vectors of other
    lengths are met as if the shorter one went on with zeros. Ranks follow the exact scores; `score` stops at the bounds
    of a long where one passes them. With `beyond_long` components of any finite size take part, as op3_topk has it;
    otherwise vectors with a scaled component that no long holds are left out. An empty table gives an empty one; other columns don't matter.
    """
    vectors = cut(_vectors(rows, id_col, vector_col, scale, k, beyond_long))
    index, n_blocks = build_index(vectors, block_rows, scale)
    return search(vectors.where(F.col("vec_id") % every == 0), cut(index), n_blocks, k, scale)


def op3_topk(spark, sf_dir: str) -> DataFrame:
    """(query_id, rank, vec_id, score) over the whole of `embeddings`, every finite vector in, by top_k(), which states the odd cases."""
    return top_k(table(spark, sf_dir, "embeddings"), beyond_long=True)


OP3_SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
