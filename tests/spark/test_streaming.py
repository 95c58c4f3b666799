from pyspark.sql import functions as F

from siltstone.operators import canonical
from siltstone.streaming.canonical import canonicalize_stream, windowed_levels

COLUMNS = ["stream_id", "line_no", "id", "timestamp_ns", "level", "format", "template_str", "template_id"]


def test_micro_batches_agree_with_the_batch(spark, tmp_path):
    lines = [(s, n, f"2026-01-15T10:{n:02d}:00Z h app: step {n} failed" if n % 3 == 0 else f"Jan 15 10:{n:02d}:30 h app: step {n}" if n % 3 == 1 else '{"message":"m"}') for s in "ab" for n in range(30)]
    schema = "stream_id string, line_no long, raw string"
    source = tmp_path / "in"
    for k in range(3):
        part = [x for x in lines if k * 10 <= x[1] < k * 10 + 10]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = canonicalize_stream(stream).writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.table("streamed").select(*COLUMNS).collect()))
    want = sorted(map(tuple, canonical.canonicalize(spark.createDataFrame(lines, schema), mode="stream").select(*COLUMNS).collect()))
    assert got == want
    windows = windowed_levels(spark.table("streamed"), "10 minutes").agg(F.sum("n")).first()[0]
    assert windows == sum(r[3] is not None for r in want)
