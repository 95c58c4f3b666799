import duckdb
import pytest
from pyspark.sql import functions as F

from siltstone.llm import mixing


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(2, 1, 0), (2, 0, 0), (3, 0, 1), (9, None, 0), (None, 1, 1), (11, 1, None)], "doc_id long, quality int, toxic int")


def test_same_as_sql(docs, labels):
    con = duckdb.connect()
    for name, df in (("documents", docs), ("labels", labels)):
        con.register(name, df.toPandas().astype({"doc_id": "Int64"}))
    got = mixing.mix(mixing.weighed(docs, labels)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
    want = con.execute(mixing.OP2_SQL).fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_targets_are_filled_like_water(spark):
    sizes = {"a": 100, "b": 5, "c": 3, None: 40, "d": 0}
    slim = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(slim).collect()}
    left, open_, want = sum(sizes.values()), dict(zip(["a", "b", "c", "d", None], [1, 2, 3, 1, 2])), {}
    while over := [s for s, w in open_.items() if left * w / sum(open_.values()) >= 3 * sizes[s]]:
        for s in over:
            want[s] = 3 * sizes[s]
            del open_[s]
        left = sum(sizes.values()) - sum(want.values())
    want |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
    assert got == pytest.approx(want)


def test_sampling_follows_weights(spark):
    slim = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"), F.lit(10).cast("long").alias("size"), F.when(F.col("id") % 4 < 2, 4.0).otherwise(1.0).alias("weight"))
    got = mixing.mix(slim)
    share = {(r.source, r.weight): r.c for r in got.groupBy("source", "weight").agg(F.avg("copies").alias("c")).collect()}
    assert share["a", 4.0] > 0.8 and share["a", 1.0] < 0.55  # source a is left at two thirds of its size
    taken = {r.source: (r.t, r.target) for r in got.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("t"), F.first("target").alias("target")).collect()}
    assert all(abs(t - target) <= 5 for t, target in taken.values())


def test_documents_come_as_often_as_taken(docs, labels, no_docs):
    got = mixing.mix_documents(docs, labels)
    assert got.columns == docs.columns
    copies = mixing.mix(mixing.weighed(docs, labels)).agg(F.sum("copies")).first()[0]
    assert got.count() == copies
    assert mixing.mix_documents(no_docs, labels).count() == 0
