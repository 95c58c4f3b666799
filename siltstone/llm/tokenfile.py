"""Token ids in binary files: frequency-ranked ids, byte-aligned, with separate control bytes.

Ids are renumbered by frequency over the whole corpus (most frequent first, ties to the smaller id), so that common ids
take one byte. A rank takes 1 to 4 bytes; a control byte holds the lengths, less one, of four ranks, two bits each, the
first lowest. Controls and data stand in separate blocks of a file, and a file is decoded with a 256-row numpy table.

File (little-endian): magic `SILTIDS1`, five u64 (ranks, documents, ids, control bytes, data bytes), then the id of each
rank (u32), doc_ids (i64), a byte for each document that is 1 where its id is null, ids to each document (u64), control
bytes, data bytes. Files hold ascending doc_ids, in the order of (part, seq) in the manifest.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_chars
from .common import cut, partitions, passing, shared_dir, stored, table, text_bytes

TOKENIZER, END_ID = public_tokenizers.path("word_bpe_49k.json"), 1
MAGIC, HEAD = b"SILTIDS1", struct.Struct("<8s5Q")
#: Ids to a file at most, unless one document has more; runs to a generation of those remembered, and the longest of them.
FILE_IDS, CACHE, CACHE_LEN = 8_000_000, 400_000, 48
#: Marks that are a pre-token of their own behind a letter.
MARKS = ".,;:!?"
#: The normaliser and pre-tokeniser, as a tokenizer file has them, for which WordTokenizer's short ways hold.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: The lengths of the four ranks behind each control byte.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


class WordTokenizer:
    """Encodes with the tokenizers library, each run between ASCII white space by itself, and remembers runs.

    The tokenizer's normaliser and pre-tokeniser never look across white space, so the runs' ids, joined, are the text's.
    A run of plain Latin letters, perhaps with one mark behind it, needs no normaliser but lower case and goes straight to
    the library's BPE model; any other run goes through all of the tokenizer. Runs are remembered in two generations: as
    the younger is full it becomes the older, whose runs return to the younger as they are met. All this holds for the
    normaliser and pre-tokeniser above; with a file that has others, each whole text goes through the library.
    """

    _loaded: dict[str, WordTokenizer] = {}

    def __init__(self, path: str = TOKENIZER) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.by_runs = splits_at_space(json.load(file))
        self.model = self.whole.model
        #: Whether two bytes hold any id.
        self.narrow = self.whole.get_vocab_size() <= 1 << 16
        self.chars = dict(enumerate(byte_chars()))
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _letters(self, word: str) -> bytes:
        """The ids of lower-case Latin letters."""
        key = word.encode()
        ids = self.young.get(key) or self.old.get(key)
        if ids is None:
            text = word if word.isascii() else key.decode("latin-1").translate(self.chars)
            ids = self.young[key] = array("H" if self.narrow else "I", [t.id for t in self.model.tokenize(text)]).tobytes()
        return ids

    def _run(self, run: bytes) -> bytes:
        """The ids of a run that isn't in the younger generation."""
        ids = self.old.get(run)
        if ids is None:
            text = run.decode("utf-8", "replace")
            core = text[:-1] if text[-1] in MARKS else text
            if core.isalpha() and (core.isascii() or max(core) <= "\u017f" and "\u0130" not in core):
                ids = self._letters(core if core.islower() else core.lower())
                if core is not text:
                    mark = run[-1:]
                    ids += self.young.get(mark) or self._run(mark)
            else:
                ids = np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u2" if self.narrow else "<u4").tobytes()
        if len(run) <= CACHE_LEN:
            self.young[run] = ids
        return ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """For each text its ids as little-endian unsigned integers, of two bytes each if `narrow`, else four."""
        if not self.by_runs:
            kind = "<u2" if self.narrow else "<u4"
            return [np.array(self.whole.encode(x.decode("utf-8", "replace"), add_special_tokens=False).ids, kind).tobytes() for x in texts]
        out, run_ids = [], self._run
        for text in texts:
            if len(self.young) > CACHE:
                self.young, self.old = {}, self.young
            runs = text.split()
            ids = list(map(self.young.get, runs))
            if None in ids:
                young, at, index = self.young, -1, ids.index
                with suppress(ValueError):  # index() finds no more
                    while True:
                        at = index(None, at + 1)
                        w = runs[at]
                        ids[at] = young.get(w) or run_ids(w)
            out.append(b"".join(ids))
        return out


def splits_at_space(file: dict) -> bool:
    """Whether the tokenizer of this file gives a text the ids of its runs between ASCII white space, joined."""
    tokens = [t for t in file.get("added_tokens") or [] if t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or t["content"].split() != [t["content"]]]
    return file["normalizer"] == NORMALIZER and file["pre_tokenizer"] == PRE_TOKENIZER and file["model"]["type"] == "BPE" and not file.get("truncation") and not tokens


def _packed_token_ids(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int | None) -> DataFrame:
    """(doc_id, wide, packed): ids of four bytes each where wide, else of two; `end_id` last."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokenizer.of(path)
        end = b"" if end_id is None else struct.pack("<H" if words.narrow else "<I", end_id)
        for batch in batches:
            ids = pa.array([x + end for x in words.encode(text_bytes(batch.column(1)))], pa.binary())
            wide = pa.array(np.full(batch.num_rows, not words.narrow))
            yield pa.RecordBatch.from_arrays([batch.column(0), wide, ids], names=["doc_id", "wide", "packed"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(encode, "doc_id long, wide boolean, packed binary")


def token_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER, end_id: int | None = END_ID) -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers, `end_id` last. A null text has the end id alone."""

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array([x.astype("<u4").tobytes() for x in _unpack(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return _packed_token_ids(docs, id_col, text_col, path, end_id).mapInArrow(widen, "doc_id long, ids binary")


def _narrow(ids: DataFrame) -> DataFrame:
    """(doc_id, wide, packed): ids in two bytes each where all of a document's fit."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide, packed = [], []
            for x in batch.column(1).to_pylist():
                own = np.frombuffer(x or b"", "<u4")
                wide.append(bool(own.size and own.max() > 0xFFFF))
                packed.append(x if wide[-1] else own.astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(wide), pa.array(packed, pa.binary())], names=["doc_id", "wide", "packed"])

    return ids.mapInArrow(pack, "doc_id long, wide boolean, packed binary")


def _unpack(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u4" if w else "<u2") for w, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]


def frequency_ranks(packed: DataFrame) -> np.ndarray:
    """The ids that occur, most frequent first. The driver gets a row for each distinct id: the vocabulary bounds it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            own = _unpack(batch)
            n = np.bincount(np.concatenate([*own, np.zeros(0, np.uint16)]), minlength=len(total))
            n[: len(total)] += total
            total = n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    rows = packed.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = rows["id"].to_numpy(), rows["n"].to_numpy()
    return ids[np.lexsort((ids, -n))].astype("<u4")


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of `ranks`."""
    ranks = np.asarray(ranks).astype("<u4")
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    for least in (1 << 8, 1 << 16, 1 << 24):
        codes[: len(ranks)] += ranks >= least
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    size = codes[: len(ranks)] + np.uint8(1)
    ends = np.cumsum(size, dtype=np.int64)
    at, own = ends - size, ranks.view(np.uint8).reshape(-1, 4)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[at] = own[:, 0]
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[at[more] + k] = own[more, k]
    return control.tobytes(), out.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The `n` ranks behind `control` and `data`, by table lookup."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    raw = np.frombuffer(data, np.uint8)
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def file_bytes(doc_ids: list[int | None], ids: list[np.ndarray], ranked: np.ndarray) -> bytes:
    """A file of these documents; `ranked` has the ids in order of rank."""
    whole = np.concatenate([*ids, np.zeros(0, np.uint16)])
    rank_of = np.zeros(int(ranked.max()) + 1 if len(ranked) else 1, np.uint32)
    rank_of[ranked] = np.arange(len(ranked))
    control, data = encode_ranks(rank_of[whole])
    head = HEAD.pack(MAGIC, len(ranked), len(doc_ids), len(whole), len(control), len(data))
    keys = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + bytes(x is None for x in doc_ids)
    return head + ranked.astype("<u4").tobytes() + keys + np.array([len(x) for x in ids], "<u8").tobytes() + control + data


def read_file(raw: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """The doc_ids and ids that file_bytes() put in a file."""
    magic, n_ranks, n_docs, n_ids, n_control, n_data = HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEAD.size
    ranked, at = np.frombuffer(raw, "<u4", n_ranks, at), at + 4 * n_ranks
    keys, at = np.frombuffer(raw, "<i8", n_docs, at).tolist(), at + 8 * n_docs
    null, at = raw[at : at + n_docs], at + n_docs
    count, at = np.frombuffer(raw, "<u8", n_docs, at).astype(np.int64), at + 8 * n_docs
    ranks = decode_ranks(raw[at : at + n_control], raw[at + n_control : at + n_control + n_data], n_ids)
    whole = ranked[ranks] if n_ids else np.zeros(0, "<u4")
    return [None if gone else x for x, gone in zip(keys, null, strict=True)], np.split(whole, np.cumsum(count)[:-1]) if n_docs else []


def write_token_files(ids: DataFrame, folder: str | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes (doc_id, ids), or (doc_id, wide, packed), in ascending order of doc_id (nulls first) and returns the manifest.

    The manifest has a row for each file: part, seq, path, n_docs, n_ids. Tasks write under names of their own, so a task
    that runs twice leaves a file that no manifest names. `folder` is one that driver and executors share; by default a
    new one in the checkpoint folder, which goes as the application ends. Rows of equal doc_id are kept, in any order. An empty table writes no file.
    """
    spark = ids.sparkSession
    own, folder = folder is None, folder or f"{shared_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    packed = stored(_narrow(ids) if "ids" in ids.columns else ids)
    ranked = frequency_ranks(packed)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(folder)
        part, made, keys, rows, held = TaskContext.get().partitionId(), [], [], [], 0

        def flush() -> None:
            name = f"{part:08d}-{len(made):06d}-{uuid.uuid4().hex}.ids"
            fs.create_dir(base, recursive=True)
            with fs.open_output_stream(f"{base}/{name}.part") as out:
                out.write(file_bytes(keys, rows, ranked))
            fs.move(f"{base}/{name}.part", f"{base}/{name}")
            made.append({"part": part, "seq": len(made), "path": f"{folder}/{name}", "n_docs": len(keys), "n_ids": held})

        for batch in batches:
            for key, own in zip(batch.column(0).to_pylist(), _unpack(batch), strict=True):
                if keys and held + len(own) > file_ids:
                    flush()
                    keys, rows, held = [], [], 0
                keys.append(key)
                rows.append(own)
                held += len(own)
        if keys:
            flush()
        schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
        yield pa.RecordBatch.from_pylist(made, schema=schema)

    order = F.col("doc_id").asc_nulls_first()
    dealt = packed.repartitionByRange(partitions(spark), order).sortWithinPartitions(order)
    manifest = cut(dealt.mapInArrow(write, "part long, seq long, path string, n_docs long, n_ids long"))
    if own:
        passing(spark, folder)
    return manifest


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids): the documents of the files that `manifest` names; start counts the ids of all before.

    The offsets come from a window over the manifest, which has one row for each file of some million ids.
    """
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).select("path", "start")
    spread = files.repartition(max(1, partitions(manifest.sparkSession)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, at = pa.fs.FileSystem.from_uri(path)
                with fs.open_input_stream(at) as raw:
                    keys, rows = read_file(raw.read())
                starts = start + np.cumsum([0, *map(len, rows)])[:-1]
                for k in range(0, len(keys), 1000):
                    blobs = [x.astype("<u4").tobytes() for x in rows[k : k + 1000]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[k : k + 1000], pa.int64()), pa.array(starts[k : k + 1000], pa.int64()), pa.array(blobs, pa.binary())],
                        names=["doc_id", "start", "ids"],
                    )

    return spread.mapInArrow(read, "doc_id long, start long, ids binary")


def write_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER, end_id: int | None = END_ID) -> DataFrame:
    """Encodes `docs` and writes their ids; returns the manifest, as write_token_files() does. A null text has the end id alone."""
    return write_token_files(_packed_token_ids(docs, id_col, text_col, path, end_id))


def op9_token_file(spark, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row of `documents`, read back from the files that write_documents() wrote.

    A null text has the end id alone. Null doc_ids come first; rows of equal doc_id stay each. An empty table gives an empty one.
    """
    read = read_token_files(write_documents(table(spark, sf_dir, "documents")))
    return read.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def crc32_of(ids: list[int]) -> int:
    """What op9's ids_crc32 holds for `ids`."""
    return zlib.crc32(np.array(ids, "<u4").tobytes())
