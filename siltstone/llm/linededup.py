"""Line dedup over levelled sorted runs of line hashes.

A run is a table (key_hash, n_docs) dealt and sorted by hash: for each line key, in how many documents of its batches it
was seen. Runs stand in levels. A new batch is dealt and sorted the same way, merge-anti-joined with the runs of keys that
are settled (they have reached the threshold, so nothing is left to count of them), and becomes a run of level 0; `fanout`
runs of a level are merged into one of the next, where keys that reach the threshold are settled. So a hash is rewritten
once a level however many batches come. Runs live in the shared checkpoint folder, which keeps how they are dealt and
sorted: only the batch's own keys are ever exchanged.

Keys are lines with ASCII white space stripped at both ends and A-Z lower-cased, hashed to 128 bits (XXH3): among 10^12
distinct lines the odds of any collision are about 10^-15.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, cut, extended, fresh, stored, table, text_bytes

MIN_DOCS, MIN_CHARS, BATCHES, FANOUT = 10, 1, 4, 2


def line_hash(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The hash of a line's key, or None where the key has fewer than `min_chars` code points."""
    key = line.strip(ASCII_SPACE).lower()
    if len(key) < min_chars or min_chars > 1 and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


@contextmanager
def dealt_alike(spark: SparkSession) -> Iterator[None]:
    """Plans made and run inside keep how their inputs are dealt: adaptive plans, which don't tell, are off.

    What runs inside aggregates by a 128-bit hash before it is dealt, so no partition is hot.
    """
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


class LineRuns:
    """Levelled sorted runs of line hashes with the number of documents that hold each.

    With `min_docs`, keys that as many documents hold are settled: they move to runs of their own and later batches are
    rid of them before they are counted.
    """

    def __init__(self, fanout: int = FANOUT, min_docs: int | None = None) -> None:
        if fanout < 2:
            raise ValueError("fanout must be 2 or more")
        self.fanout, self.min_docs = fanout, min_docs
        self.levels: list[list[DataFrame]] = []
        self.settled: list[DataFrame] = []

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """The runs as one, without settled keys. All are dealt alike, so this exchanges nothing."""
        rows = reduce(DataFrame.unionByName, runs)
        rows = rows.groupBy("key_hash").agg(F.sum("n_docs").alias("n_docs")) if len(runs) > 1 else rows
        return self._open(rows).sortWithinPartitions("key_hash")

    def _open(self, rows: DataFrame) -> DataFrame:
        """`rows` without settled keys: the merge anti-join. The settled side is sorted already."""
        for run in self.settled:
            run = run.select(F.col("key_hash").alias("settled_hash")).hint("merge")
            rows = rows.hint("merge").join(run, F.col("key_hash") == F.col("settled_hash"), "left_anti")
        return rows

    def _settle(self, run: DataFrame) -> DataFrame:
        """The run without the keys that have reached `min_docs`, which are settled now."""
        if self.min_docs is None:
            return run
        self.settled.append(cut(run.where(F.col("n_docs") >= self.min_docs).select("key_hash")))
        if len(self.settled) > self.fanout:
            self.settled = [cut(reduce(DataFrame.unionByName, self.settled).sortWithinPartitions("key_hash"))]
        return run.where(F.col("n_docs") < self.min_docs)

    def add(self, lines: DataFrame) -> None:
        """Adds a batch: `lines` has a row (key_hash) for each distinct key of each document."""
        with dealt_alike(lines.sparkSession):
            batch = lines.groupBy("key_hash").agg(F.count(F.lit(1)).alias("n_docs")).sortWithinPartitions("key_hash")
            run, level = self._settle(cut(self._open(batch))), 0
            while True:
                if level == len(self.levels):
                    self.levels.append([])
                self.levels[level].append(run)
                if len(self.levels[level]) < self.fanout:
                    return
                run, self.levels[level] = self._settle(cut(self._merged(self.levels[level]))), []
                level += 1

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def frequent(self, min_docs: int) -> DataFrame | None:
        """(key_hash) of the keys that `min_docs` documents or more hold over all runs; None where there is no run."""
        if self.min_docs not in (None, min_docs):
            raise ValueError(f"keys are settled at {self.min_docs} documents")
        runs = self.runs()
        if not runs:
            return None
        with dealt_alike(runs[0].sparkSession):
            late = self._merged(runs).where(F.col("n_docs") >= min_docs).select("key_hash")
            return cut(reduce(DataFrame.unionByName, self.settled, late))

    def unseen(self, lines: DataFrame) -> DataFrame:
        """`lines` without those whose key_hash stands in a run: the merge anti-join of an incremental feed."""
        for run in [*self.settled, *self.runs()]:
            lines = lines.hint("merge").join(run.select("key_hash").hint("merge"), "key_hash", "left_anti")
        return lines

    def ingest(self, lines: DataFrame) -> DataFrame:
        """The rows of a batch whose key no earlier batch had, as an incremental feed keeps them; the batch joins the runs."""
        lines = cut(lines)
        new = cut(self.unseen(lines))
        self.add(lines)
        return new


def document_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, key_hash): each distinct line key of each row of `docs`."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, hashes = [], []
            for i, text in enumerate(text_bytes(batch.column(1))):
                own = {h for line in text.split(b"\n") if (h := line_hash(line, min_chars))}
                at += [i] * len(own)
                hashes += own
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(hashes, pa.binary())], names=["doc_id", "key_hash"])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(keys, f"doc_id {id_type}, key_hash binary")


def frequent_lines(lines: DataFrame, min_docs: int, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(key_hash) of keys in `min_docs` documents or more, by feeding `lines` (batch, key_hash) to LineRuns batch by batch."""
    runs = LineRuns(fanout, min_docs)
    for k in range(batches):
        runs.add(lines.where(F.col("batch") == k))
    return runs.frequent(min_docs)


def drop_frequent_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
) -> DataFrame:
    """`docs` with its texts rid of lines whose key stands in `min_docs` documents or more; adds n_lines, n_dropped.

    Every row counts as a document, repeated rows and null ids too, and comes back as a row of its own. A null or empty
    text has one empty line, which has no key and stays, so it comes back as an empty text. Other columns pass through.
    An empty table gives an empty one. Where `docs` already has a column n_lines or n_dropped, the added one gets a
    leading underscore.
    """
    lines_col, dropped_col, hits_col, row_col = fresh(docs, "n_lines", "n_dropped", "line_hits", "line_row")
    # Rows meet their own lines by a hash of id and text. Should two rows share it, each gets the other's frequent keys
    # too, which changes nothing: they are frequent wherever they stand.
    docs = docs.withColumn(row_col, F.xxhash64(id_col, text_col))
    lines = document_lines(docs, row_col, text_col, min_chars)
    # A batch is a folder of its own, so feeding it reads nothing else; whole documents fall in a batch.
    lines = stored(lines.withColumn("batch", F.pmod("doc_id", F.lit(batches))), by="batch")
    frequent = frequent_lines(lines, min_docs, batches, fanout)
    # Both sides of this join are plain exchanges, so a line that a third of the documents hold is split by AQE.
    frequent = frequent.withColumnRenamed("key_hash", "hit_hash")
    hits = lines.join(frequent, F.col("key_hash") == F.col("hit_hash")).groupBy("doc_id").agg(F.collect_set("key_hash").alias(hits_col))
    hits = hits.withColumnRenamed("doc_id", f"{row_col}_")
    left = docs.join(hits, docs[row_col] == hits[f"{row_col}_"], "left").drop(row_col, f"{row_col}_")
    docs = docs.drop(row_col)
    names = [*docs.columns, lines_col, dropped_col]
    schema = extended(docs, (lines_col, "long"), (dropped_col, "long"))
    t = docs.columns.index(text_col)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n, gone = [], [], []
            for text, hit in zip(text_bytes(batch.column(t)), batch.column(len(names) - 2).to_pylist(), strict=True):
                rows = text.split(b"\n")
                stay = [x for x in rows if line_hash(x, min_chars) not in own] if hit and (own := set(hit)) else rows
                kept.append(b"\n".join(stay))
                n.append(len(rows))
                gone.append(len(rows) - len(stay))
            columns = batch.columns[: len(names) - 2]
            columns[t] = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=names)

    return left.mapInArrow(drop, schema)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row of `documents`, by drop_frequent_lines(), which states the odd cases.

    OP10_SQL takes a doc_id for one document; `documents` has each once. Rows of one doc_id are documents of their own here.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_frequent_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM d),
s AS (SELECT doc_id, line, k, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare FROM l),
n AS (SELECT doc_id, line, k, translate(bare, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM s),
f AS (SELECT key FROM n WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(n.line, chr(10) ORDER BY k) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM n LEFT JOIN f ON n.key = f.key GROUP BY doc_id
"""
