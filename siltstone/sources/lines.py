"""Files of lines in and out. A line ends at a line feed alone; its bytes, carriage returns too, stay as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str | list[str], pattern: str = "*", recursive: bool = False, limit: int | None = None) -> DataFrame:
    """(stream_id, line_no, raw): each file is a stream, its lines numbered from 0; `limit` keeps the first lines of sorted files.

    A file may be read in many tasks: lines are numbered within each block and blocks offset by the counts before them.
    """
    reader = spark.read.option("lineSep", "\n").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    paths = [path] if isinstance(path, str) else list(path)
    rows = reader.text(paths).select(
        F.col("_metadata.file_path").alias("stream_id"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seen"),
        F.col("value").cast("binary").alias("raw"),
    )
    blocks = rows.groupBy("stream_id", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("stream_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("stream_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("stream_id", "block").orderBy("seen")) - 1
    out = rows.withColumn("inside", inside).join(offsets, ["stream_id", "block"]).select("stream_id", (F.col("offset") + F.col("inside")).cast("long").alias("line_no"), "raw")
    return out if limit is None else out.orderBy("stream_id", "line_no").limit(limit)


def write_templates(events: DataFrame, path: str) -> None:
    """Text of one template to each line, empty where a line had no event, in order within and over the files."""
    ordered = events.orderBy("stream_id", "line_no").select(F.coalesce("template_str", F.lit("")).alias("value"))
    ordered.write.mode("errorifexists").text(path)


def write_projection(projected: DataFrame, path: str) -> None:
    """Projected events as text, cells parted by tabs, in order within and over the files."""
    cells = F.concat_ws("\t", *[c for c in projected.columns if c not in ("stream_id", "line_no")])
    projected.orderBy("stream_id", "line_no").select(cells.alias("value")).write.mode("errorifexists").text(path)
