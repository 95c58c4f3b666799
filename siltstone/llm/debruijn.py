"""Substring dedup on the compacted de Bruijn graph of token k-mers.

Nodes are runs of k - 1 words, edges are windows of k words. A node doesn't branch where all its occurrences, in all
documents, have the same word before and the same word behind. Edges that meet in such a node occur in the same places,
so paths between branching nodes compact to one: its first edge speaks for all. Only compacted paths are joined: each
with the least (doc_id, place) of its occurrences, its source. Two occurrences join where their first edge has the same
hash and the words of the whole span, read at both coordinates, have the same XXH3. That digest is taken of the bytes
of the words themselves, by a function that has nothing in common with the edge's hash.

Work is in blocks of whole documents, dealt by a hash of doc_id and text; one exchange of the texts serves every pass.
  1. sketch: each block sends its distinct node hashes, cut short, sorted and packed; buckets answer which of them
     another block has too. That spares sending what stands in one block alone.
  2. ends: each block sends (node, neighbours) of the shared nodes; buckets answer which of them branch.
  3. paths: each block cuts its documents at branching nodes and emits the distinct paths that begin at one, with their
     least coordinate in the block. So a passage that many documents share is a row to each block, not to each document.
  4. sources: the blocks' rows of a path meet, and each block learns the least coordinate of all.
  5. cover: each block cuts its documents again; paths with a source in a smaller doc_id cover words, which go.
Words are hashed eight bytes at a time, mixed between. Hashes of runs of words are vectors: with powers of a base, a
run's hash is a difference of running sums, divided by a power, all modulo the prime 2^61 - 1, so no run of words collides
with another for what the base is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, distinct, partitions, table, text_bytes

WINDOW = 13
#: Text to a block, and nodes to a bucket, at which to aim.
BLOCK_CHARS, BUCKET_NODES = 4_000_000, 4_000_000
#: Bits of a sketched hash beyond those that count all words: one node in 2^SPARE is sent for nothing.
SPARE = 11

_PRIME = (1 << 61) - 1
_BASE = 0x1D3F84A5B7C6E295 % _PRIME
_powers: list[np.ndarray] = []
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Words of more bytes are hashed by XXH3, not in vectors.
_LONG_WORD = 256
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2^61 - 1."""
    x = (x & _U(_PRIME)) + (x >> _U(61))
    return np.where(x >= _U(_PRIME), x - _U(_PRIME), x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1, of numbers under it: by halves of a of 31 bits and of b of 30."""
    a_low, a_high, b_low, b_high = a & _U(0x7FFFFFFF), a >> _U(31), b & _U(0x3FFFFFFF), b >> _U(30)
    high = _reduced(a_high * b_high)  # times 2^61, which is 1
    by_31, by_30 = a_high * b_low, a_low * b_high  # times 2^31 and 2^30
    mid = ((by_31 & _U(0x3FFFFFFF)) << _U(31)) + (by_31 >> _U(30)) + ((by_30 & _U(0x7FFFFFFF)) << _U(30)) + (by_30 >> _U(31))
    return _reduced(high + _reduced(mid) + _reduced(a_low * b_low))


def _base_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, from the zeroth to the nth at least."""
    if not _powers or len(_powers[0]) <= n:
        size = 1 << max(16, n.bit_length())
        _powers.clear()
        for b in (_BASE, pow(_BASE, -1, _PRIME)):
            own = np.ones(1, np.uint64)
            while len(own) < size:
                own = np.concatenate((own, _times(own, _U(pow(b, len(own), _PRIME)))))
            _powers.append(own)
    return _powers[0], _powers[1]


class RunHashes:
    """Hashes of runs of `values`, the same wherever a run stands."""

    def __init__(self, values: np.ndarray) -> None:
        power, self.inverse = _base_powers(len(values) + 1)
        terms = _times(_reduced(values), power[: len(values)])
        # Running sums of 30 low and 31 high bits, each exact in 64 bits.
        low, high = (np.cumsum(x, dtype=np.uint64) for x in (terms & _U(0x3FFFFFFF), terms >> _U(30)))
        high = _reduced(high)
        sums = _reduced(_reduced(((high & _U(0x7FFFFFFF)) << _U(30)) + (high >> _U(31))) + _reduced(low))
        self.sums = np.concatenate((np.zeros(1, np.uint64), sums))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash, of 64 bits, of values[start:end] for each run."""
        run = _times(_reduced(self.sums[ends] + _U(_PRIME) - self.sums[starts]), self.inverse[starts])
        return _mix(run + (ends - starts).astype(np.uint64) * _U(0x632BE59BD9B4E019))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash, of 64 bits, of raw[start:end] for each word; `raw` goes on for eight bytes behind the last."""
    size = ends - starts
    lanes = np.lib.stride_tricks.as_strided(raw.view(np.uint8), (max(0, len(raw) - 7), 8), (1, 1))
    out = _mix(size.astype(np.uint64) + _U(0x9E3779B97F4A7C15))
    long = np.flatnonzero(size > _LONG_WORD)
    open_ = np.flatnonzero((size > 0) & (size <= _LONG_WORD))
    done = 0
    while len(open_):
        lane = lanes[starts[open_] + done].copy().view("<u8").reshape(-1)
        spare = np.maximum(8 - (size[open_] - done), 0).astype(np.uint64) * _U(8)
        lane = lane << spare >> spare
        out[open_] = _mix((out[open_] ^ lane) * _U(0xD1342543DE82EF95) + _U(done))
        done += 8
        open_ = open_[size[open_] > done]
    for i in long.tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]], 1)
    return out


class Words:
    """The words of some texts: each word's text and hash, and the runs of `window` and `window` - 1 words."""

    def __init__(self, texts: list[bytes], window: int = WINDOW) -> None:
        self.window = window
        raw = np.frombuffer(b"\n".join(texts) + b"\n" * 9, np.uint8)
        space = _SPACE[raw]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(raw) and not space[0]:
            edge = np.concatenate(([0], edge))
        self.starts, self.ends = edge[0::2], edge[1::2]
        begins = np.cumsum([0, *(len(x) + 1 for x in texts)])
        self.doc = np.searchsorted(begins, self.starts, "right") - 1
        self.hashes = word_hashes(raw, self.starts, self.ends)
        self.raw, self.space, self._runs = raw, space, RunHashes(self.hashes)
        #: Place of each document's first word, and the end of its last.
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))

    def runs(self, size: int) -> np.ndarray:
        """Places where a run of `size` words of one document begins."""
        n = len(self.doc) - size + 1
        return np.flatnonzero(self.doc[:n] == self.doc[size - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def nodes(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of runs of window - 1 words, of documents that have a whole window."""
        size = self.window - 1
        at = self.runs(size)
        at = at[(self.first[1:] - self.first[:-1])[self.doc[at]] > size]
        return at, self._runs.of(at, at + size)

    def edges(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the windows that begin at these places."""
        return self._runs.of(at, at + self.window)

    def digests(self, at: np.ndarray, behind: np.ndarray) -> np.ndarray:
        """XXH3 of the words of each span [at, behind), joined by one space: of their own bytes."""
        keep = ~self.space
        keep[self.ends] = True  # one space behind each word
        text = np.where(self.space, np.uint8(32), self.raw)[keep].tobytes()
        ends = np.cumsum(self.ends - self.starts + 1)
        starts = (ends - (self.ends - self.starts + 1))[at].tolist()
        digest, view = xxhash.xxh3_64_intdigest, memoryview(text)
        return np.fromiter((digest(view[a:b]) for a, b in zip(starts, (ends[behind - 1] - 1).tolist())), np.uint64, len(at))

    def neighbours(self, at: np.ndarray) -> np.ndarray:
        """A hash, of 48 bits, of the words around each node; zero where the document begins or ends there."""
        behind = at + self.window - 1
        inside = (at > self.first[self.doc[at]]) & (behind < self.first[self.doc[at] + 1])
        before, after = self.hashes[np.maximum(at - 1, 0)], self.hashes[np.minimum(behind, len(self.hashes) - 1)]
        out = _mix(before * _U(0xD1342543DE82EF95) + _mix(after + _U(0x9E3779B97F4A7C15))) >> _U(16)
        out[out == 0] = 1
        return np.where(inside, out, np.uint64(0))


def summarised(hashes: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes ascending, each one's neighbours (zero where they differ or one is zero), and how often it occurs."""
    order = np.argsort(hashes)
    hashes, around = hashes[order], around[order]
    first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.zeros(0, np.int64)
    if not len(first):
        return hashes, around, first
    same = np.minimum.reduceat(around, first) == np.maximum.reduceat(around, first)
    return hashes[first], np.where(same, around[first], np.uint64(0)), np.diff(np.append(first, len(hashes)))


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit values as differences, each in as few bytes as the largest needs."""
    if not len(values):
        return b""
    steps = np.diff(values, prepend=np.uint64(0))
    first, steps = int(values[0]), steps[1:]
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + first.to_bytes(8, "little") + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    """What pack_sorted() packed."""
    if not data:
        return np.zeros(0, np.uint64)
    width = data[0]
    steps = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    wide = np.zeros((len(steps) + 1, 8), np.uint8)
    wide[1:, :width] = steps
    wide = wide.view("<u8").reshape(-1)
    wide[0] = int.from_bytes(data[1:9], "little")
    return np.cumsum(wide, dtype=np.uint64)


def pack_ends(nodes: np.ndarray, around: np.ndarray) -> bytes:
    """Ascending node hashes and what is around each, in 6 bytes."""
    packed = pack_sorted(nodes)
    return len(packed).to_bytes(4, "little") + packed + around.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack_ends(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """What pack_ends() packed."""
    end = 4 + int.from_bytes(data[:4], "little")
    nodes = unpack_sorted(data[4:end])
    wide = np.zeros((len(nodes), 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8, offset=end).reshape(-1, 6)
    return nodes, wide.view("<u8").reshape(-1)


def _by_bucket(hashes: np.ndarray, n_buckets: int) -> Iterator[tuple[int, slice]]:
    """(bucket, where its hashes stand) of ascending hashes; buckets are their leading bits."""
    bucket = (hashes >> np.uint64(64 - n_buckets.bit_length() + 1)).astype(np.int64) if n_buckets > 1 else np.zeros(len(hashes), np.int64)
    at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else []
    for a, b in zip(at, [*at[1:], len(bucket)]):
        yield int(bucket[a]), slice(int(a), int(b))


_SENT = "bucket long, block long, data binary"
_SENT_ARROW = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("data", pa.binary())])
_PATHS = "block long, edge long, path_hash long, doc_id long, start long"
_PATHS_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in _PATHS.split(", ")])


class Paths:
    """The compacted paths of a block's documents that begin at a branching node, an occurrence a row.

    `doc` is the place of the document in the block, `start` counts its words, `length` the path's edges; `edge` is a
    hash of the first edge, `whole` the digest of all words. `told` are nodes that branch over all blocks.
    """

    def __init__(self, words: Words, told: np.ndarray) -> None:
        window = words.window
        at, hashes = words.nodes()
        nodes, around, times = summarised(hashes, words.neighbours(at))
        cuts = among(hashes, distinct(np.concatenate((nodes[(around == 0) & (times > 1)], told))))
        # Edges begin at nodes that aren't the document's last; a path begins at a branching node or a document's first.
        edge = at + window <= words.first[words.doc[at] + 1]
        start, cut_here = at[edge], cuts[edge]
        head = np.flatnonzero(cut_here | (start == words.first[words.doc[start]]))
        length = np.diff(np.append(head, len(start)))
        head, self.length = head[cut_here[head]], length[cut_here[head]]
        begin = start[head]
        self.doc = words.doc[begin]
        self.start = begin - words.first[self.doc]
        self.edge = words.edges(begin).view(np.int64)
        self.whole = words.digests(begin, begin + window - 1 + self.length).view(np.int64)

    def least(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, first): rows by path, id and start, and where in that order each path begins."""
        order = np.lexsort((self.start, ids[self.doc], self.whole, self.edge))
        edge, whole = self.edge[order], self.whole[order]
        new = np.concatenate(([True], (edge[1:] != edge[:-1]) | (whole[1:] != whole[:-1]))) if len(order) else np.zeros(0, bool)
        return order, np.flatnonzero(new)


#: Stands for a null doc_id, which is no source.
_NO_ID = np.int64((1 << 63) - 1)


def _ids(rows: pa.Table) -> np.ndarray:
    return rows["doc_id"].fill_null(int(_NO_ID)).to_numpy()


def _told(blobs: list[bytes | None]) -> np.ndarray:
    return np.concatenate([*(np.frombuffer(x, "<u8") for x in blobs if x), np.zeros(0, np.uint64)])


def _answers(sent: DataFrame, judge: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """(block, bucket, data): for each bucket the answers of `judge` to what the blocks sent it."""

    def answer(rows: pa.Table) -> pa.Table:
        return pa.table({"bucket": rows["bucket"], "block": rows["block"], "data": pa.chunked_array([pa.array(judge(rows["data"].to_pylist()), pa.binary())])}, schema=_SENT_ARROW)

    return sent.groupBy("bucket").applyInArrow(answer, _SENT)


def _shared(sketches: list[bytes]) -> list[bytes]:
    """For each sketch a bitmap of those of its hashes that another sketch has too."""
    own = [unpack_sorted(x) for x in sketches]
    whole = np.sort(np.concatenate(own))
    more = distinct(whole[1:][whole[1:] == whole[:-1]])
    return [np.packbits(among(x, more)).tobytes() for x in own]


def _branching(ends: list[bytes]) -> list[bytes]:
    """For each block's (node, neighbours) the nodes that branch over all blocks."""
    parts = [unpack_ends(x) for x in ends]
    nodes, around, _ = summarised(*(np.concatenate([p[k] for p in parts]) for k in (0, 1)))
    branch = nodes[around == 0]
    return [branch[among(branch, p[0])].tobytes() for p in parts]


def _sourced(blocks: DataFrame, n_words: int, window: int, bucket_nodes: int) -> DataFrame:
    """(block, data, edge, path_hash, doc_id, start): what each block is told of its branching nodes (data) and of the
    least coordinate of each path that another block has too."""
    # As many buckets as tasks at least, so that none of them holds several.
    n_buckets = 1 << max(0, math.ceil(math.log2(max(1, n_words / bucket_nodes, partitions(blocks.sparkSession)))))
    kept_bits = min(64, max(32, n_words.bit_length() + SPARE))
    short = np.uint64(64 - kept_bits)
    texts = blocks.groupBy("block")

    def sketched(hashes: np.ndarray) -> np.ndarray:
        return distinct(hashes >> short << short)

    def sketch(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        hashes = sketched(Words(text_bytes(rows["text"]), window).nodes()[1])
        sent = [{"bucket": b, "block": key[0].as_py(), "data": pack_sorted(hashes[at] >> short)} for b, at in _by_bucket(hashes, n_buckets)]
        return pa.Table.from_pylist(sent, schema=_SENT_ARROW)

    def ends(key: tuple[pa.Scalar, ...], rows: pa.Table, shared: pa.Table) -> pa.Table:
        words = Words(text_bytes(rows["text"]), window)
        at, hashes = words.nodes()
        short_hashes = sketched(hashes)
        answer = dict(zip(shared["bucket"].to_pylist(), shared["data"].to_pylist()))
        more = [short_hashes[s][np.unpackbits(np.frombuffer(answer[b], np.uint8), count=s.stop - s.start).astype(bool)] for b, s in _by_bucket(short_hashes, n_buckets)]
        more = np.concatenate([*more, np.zeros(0, np.uint64)])
        known = among(hashes >> short << short, more)
        nodes, around, _ = summarised(hashes[known], words.neighbours(at[known]))
        sent = [{"bucket": b, "block": key[0].as_py(), "data": pack_ends(nodes[s], around[s])} for b, s in _by_bucket(nodes, n_buckets)]
        return pa.Table.from_pylist(sent, schema=_SENT_ARROW)

    def paths(key: tuple[pa.Scalar, ...], rows: pa.Table, branching: pa.Table) -> pa.Table:
        own, ids = Paths(Words(text_bytes(rows["text"]), window), _told(branching["data"].to_pylist())), _ids(rows)
        order, first = own.least(ids)
        best = order[first]
        best = best[ids[own.doc[best]] != _NO_ID]
        columns = [np.full(len(best), key[0].as_py()), own.edge[best], own.whole[best], ids[own.doc[best]], own.start[best]]
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in columns], schema=_PATHS_ARROW)

    shared = _answers(texts.applyInArrow(sketch, _SENT), _shared)
    sent = texts.cogroup(shared.groupBy("block")).applyInArrow(ends, _SENT)
    branching = _answers(sent, _branching).select("block", "data")
    found = texts.cogroup(branching.groupBy("block")).applyInArrow(paths, _PATHS)
    # Aggregated before the exchange and joined back: a path that every block has is no group that one task must hold.
    source = F.min(F.struct("doc_id", "start")).alias("source")
    met = found.groupBy("edge", "path_hash").agg(source, F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    sources = found.select("block", "edge", "path_hash").join(met, ["edge", "path_hash"])
    sources = sources.select("block", F.lit(None).cast("binary").alias("data"), "edge", "path_hash", "source.doc_id", "source.start")
    none = [F.lit(None).cast("long").alias(c) for c in ("edge", "path_hash", "doc_id", "start")]
    return branching.select("block", "data", *none).unionByName(sources)


class _Cover:
    """The occurrences of a block's paths, each with its source: the least (doc_id, start) in this block or another."""

    def __init__(self, rows: pa.Table, told: pa.Table, window: int) -> None:
        self.ids = _ids(rows)
        own = self.paths = Paths(Words(text_bytes(rows["text"]), window), _told(told["data"].to_pylist()))
        order, first = own.least(self.ids)
        times = np.diff(np.append(first, len(order)))
        best = order[first]
        source, start = self.ids[own.doc[best]], own.start[best].copy()
        self.times = times.copy()
        known = told.filter(told["data"].is_null())
        edge, whole, doc, at = (known[c].to_numpy() for c in ("edge", "path_hash", "doc_id", "start"))
        by = np.lexsort((whole, edge))
        keys = {k: i for i, k in enumerate(zip(own.edge[best].tolist(), own.whole[best].tolist()))} if len(by) else {}
        for i in by.tolist():
            j = keys[int(edge[i]), int(whole[i])]
            self.times[j] += 1
            if (doc[i], at[i]) < (source[j], start[j]):
                source[j], start[j] = doc[i], at[i]
        of = np.repeat(np.arange(len(first)), times)
        back = np.empty(len(order), np.int64)
        back[order] = of
        self.source, self.source_start, self.times = source[back], start[back], self.times[back]


def blocked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> tuple[DataFrame, int]:
    """(block, doc_id, text) of `docs` in blocks of about `block_chars`, and a bound on the number of words.

    The text counts for the block too, so rows of one doc_id, or without one, are no block of their own; only rows alike
    in both stay together.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    block = F.pmod(F.xxhash64(id_col, text), F.lit(max(1, chars // block_chars)))
    return docs.select(block.alias("block"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text")), chars // 2 + 1


def repeated_spans(docs: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS, bucket_nodes: int = BUCKET_NODES) -> DataFrame:
    """(doc_id, start, n_words, source_doc_id, source_start): each compacted path of `docs` that occurs more than once.

    start counts words from 0. An occurrence that is its path's source names itself.
    """
    blocks, n_words = blocked(docs, block_chars=block_chars)

    def spans(key: tuple[pa.Scalar, ...], rows: pa.Table, told: pa.Table) -> pa.Table:
        cover = _Cover(rows, told, window)
        own, again = cover.paths, cover.times > 1
        columns = [cover.ids[own.doc], own.start, own.length + (window - 1), cover.source, cover.source_start]
        names = ["doc_id", "start", "n_words", "source_doc_id", "source_start"]
        return pa.table([pa.array(x[again], pa.int64()) for x in columns], names=names)

    told = _sourced(blocks, n_words, window, bucket_nodes)
    schema = "doc_id long, start long, n_words long, source_doc_id long, source_start long"
    out = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(spans, schema)
    return out.withColumns({c: F.nullif(F.col(c), F.lit(int(_NO_ID))) for c in ("doc_id", "source_doc_id")})


def remove_repeats(docs: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS, bucket_nodes: int = BUCKET_NODES) -> DataFrame:
    """(doc_id, text, n_words, n_removed) of each row of `docs` (doc_id, text): its kept words, joined by one space.

    A word goes where a window of `window` words covers it that also starts in a document of smaller doc_id. Windows are
    judged on the input. Null and blank texts have no words; texts under `window` words stay. Rows of equal doc_id come
    back each and don't count against each other; a null doc_id is neither source nor cleaned. An empty table gives an
    empty one. Other columns of `docs` are left out.
    """
    blocks, n_words = blocked(docs, block_chars=block_chars)

    def clean(key: tuple[pa.Scalar, ...], rows: pa.Table, told: pa.Table) -> pa.Table:
        cover = _Cover(rows, told, window)
        own = cover.paths
        gone_at = np.flatnonzero((cover.source < cover.ids[own.doc]) & (cover.ids[own.doc] != _NO_ID))
        gone_at = gone_at[np.argsort(own.doc[gone_at], kind="stable")]
        starts, stops = own.start[gone_at], own.start[gone_at] + own.length[gone_at] + window - 1
        edges = np.searchsorted(own.doc[gone_at], np.arange(rows.num_rows + 1)).tolist()
        kept, total, gone = [], [], []
        for k, text in enumerate(text_bytes(rows["text"])):
            words = text.split()
            total.append(len(words))
            if edges[k] < edges[k + 1]:
                turn = np.zeros(len(words) + 1, np.int64)
                np.add.at(turn, starts[edges[k] : edges[k + 1]], 1)
                np.add.at(turn, stops[edges[k] : edges[k + 1]], -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(turn[:-1]) == 0).tolist()]
            gone.append(total[-1] - len(words))
            kept.append(b" ".join(words))
        texts = pa.chunked_array([pa.array(kept, pa.binary()).cast(pa.string())])
        return pa.table({"doc_id": rows["doc_id"], "text": texts, "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64())})

    told = _sourced(blocks, n_words, window, bucket_nodes).groupBy("block")
    return blocks.groupBy("block").cogroup(told).applyInArrow(clean, "doc_id long, text string, n_words long, n_removed long")


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of `documents`, by remove_repeats(), which states the odd cases."""
    rows = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
g AS (SELECT n.doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM n JOIN d USING (doc_id)),
f AS (SELECT g, min(doc_id) AS first_doc FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT g.doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN f USING (g) WHERE first_doc < g.doc_id),
x AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce(array_to_string(list_filter(w, lambda x, k: NOT list_contains(gone, k)), ' '), '') END) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)
"""
