"""What the operators of this package share: tables, checkpoints, word splitting and order of documents."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word, as in the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The same six bytes; bytes.split() with no argument splits at exactly these.
ASCII_SPACE = b" \t\n\r\x0b\x0c"
#: Rows in an Arrow batch. Documents may be long, so Spark's 10,000 is too many.
BATCH_ROWS = 1000


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package and keeps their Arrow batches small."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset and all runs in one process, as in tests, a temporary one; on a cluster that is an error, for
    executors couldn't see it.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="siltstone-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in the shared folder, so that later reads survive lost executors."""
    spark = df.sparkSession
    where = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    out = df.checkpoint()
    passing(spark, spark.sparkContext.getCheckpointDir())
    return out


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """`df` as a compressed Parquet table in the shared folder: for wide rows, which a checkpoint would keep uncompressed.

    With `by`, rows of one value of that column are in a folder of their own, which a filter on it reads alone.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    passing(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def passing(spark: SparkSession, path: str) -> None:
    """Has an existing folder of intermediate rows removed as the application ends; its rows can be read till then."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Python bytes of a string column, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values, ascending. Sorting is far faster than numpy's hashing unique()."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values stand in `known`, which is ascending."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names starting as `names` that `df` doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def in_order(df: DataFrame, *keys: str, part: str = "part") -> DataFrame:
    """`df` dealt to partitions by ranges of `keys` and sorted in each, with the partition's number as column `part`.

    The rows are checkpointed, so the numbers stay as they are when a task runs again.
    """
    spark = df.sparkSession
    order = [F.col(k).asc_nulls_first() for k in keys]
    dealt = df.repartitionByRange(partitions(spark), *order)
    return cut(dealt.withColumn(part, F.spark_partition_id()))


def extended(df: DataFrame, *added: tuple[str, str]) -> T.StructType:
    """The schema of `df` with columns (name, type) after its own; DataFrame.schema itself is shared and stays as it is."""
    out = T.StructType(list(df.schema.fields))
    for name, kind in added:
        out.add(name, kind)
    return out
