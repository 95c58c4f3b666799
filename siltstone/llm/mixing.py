"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame expressions alone.

Each source has a target: a weighted share of all words, at most `cap` times its own. A source goes whole as often as
its target holds it (epochs); what is left of the target is filled in order of exponential keys -ln(u) / weight, least
first, which draws without replacement with chances in proportion to the weights. u is a hash of the doc_id, so runs
agree. The order within a source is never sorted in one task: keys fall in about sqrt(rows) buckets that keep their order,
sums of buckets say in which one the budget runs out, and only that one is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words, table

#: Weights of sources in order of code points, repeating; a target's bound in multiples of its source.
CYCLE, CAP = (1, 2, 3), 3
#: Weights of documents by labels.quality (1, 0, not labelled), and the seed of their keys.
GOOD, POOR, UNKNOWN, SEED = 2.0, 0.5, 1.0, "mix-1"
#: Up to so many sources their table is broadcast (a row of under 200 bytes each); beyond, it is joined by shuffle.
BROADCAST_SOURCES = 10_000


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(slim: DataFrame) -> DataFrame:
    """(source, n, source_size, target, epochs, budget), one row to each source of `slim` (source, size).

    Weighted shares are filled like water: sources in order of bound to weight, each stopped at its bound where the level
    of those that are left would pass it. The windows here have no keys: they see one row for each source.
    """
    rows = slim.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, CYCLE)), (rank % len(CYCLE) + 1).cast("int"))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select("*", weight.alias("w"), F.sum("source_size").over(everything).alias("total"), (CAP * F.col("source_size")).alias("bound"))
    filling = Window.orderBy(F.col("bound") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("bound").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(filling.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.select("*", before.alias("before"), rest.alias("rest"))
    rows = rows.withColumn("full", F.col("bound") * F.col("rest") <= (F.col("total") - F.col("before")) * F.col("w"))
    stopped = F.coalesce(F.sum(F.when(F.col("full"), F.col("bound"))).over(everything), F.lit(0))
    open_w = F.sum(F.when(~F.col("full"), F.col("w"))).over(everything)
    level = (F.col("total") - stopped).cast("double") * F.col("w") / open_w
    rows = rows.withColumn("target", F.when(F.col("full"), F.col("bound").cast("double")).otherwise(level))
    size = F.col("source_size")
    epochs = F.when(F.col("full"), F.when(size > 0, F.lit(CAP)).otherwise(F.lit(0))).otherwise(F.floor(F.col("target") / size)).cast("long")
    rows = rows.withColumn("epochs", epochs)
    return rows.select("source", "n", "source_size", "target", "epochs", (F.col("target") - F.col("epochs") * size).alias("budget"))


def _with_sources(rows: DataFrame, sources: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """`rows` joined with a table of a row to each source; a hot source is split by AQE where the table isn't broadcast."""
    named = sources.withColumnRenamed("source", "source_")
    return rows.join(F.broadcast(named) if few else named, F.col("source").eqNullSafe(F.col("source_")), how).drop("source_")


def mix(slim: DataFrame) -> DataFrame:
    """`slim` (doc_id, source, size, weight) with source_size, target, copies: how often the mix takes the row.

    Weights are positive. Documents go whole; the last one in is the one that brings its source nearest its target. Rows
    of equal doc_id have equal keys and stay rows of their own; null sources are a source of their own, last in order.
    Texts without a word are taken no time. An empty table gives an empty one.
    """
    lightest = slim.agg(F.min("weight")).first()[0] or 1.0
    sources = cut(source_targets(slim))
    few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    key = -F.log(uniform(F.col("doc_id"))) / F.col("weight")
    rows = _with_sources(slim.withColumn("key", key), sources, few)
    n_buckets = F.ceil(F.sqrt("n"))
    rows = rows.withColumn("bucket", F.least(F.floor(n_buckets * (1 - F.exp(-F.col("key") * lightest))), n_buckets - 1))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("size"), F.first("budget").alias("budget"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
    buckets = buckets.withColumn("upto", upto).where("upto > budget")
    ends = buckets.groupBy("source").agg(F.min("bucket").alias("end"), F.min(F.struct("bucket", F.col("upto") - F.col("size")))["col2"].alias("base"))
    rows = _with_sources(rows, cut(ends), few, "left")
    inside = rows.where("bucket = end")
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size")
    ahead = F.col("base") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    inside = inside.withColumn("extra", (2 * ahead + F.col("size") <= 2 * F.col("budget")).cast("long"))
    outside = rows.where("end IS NULL OR bucket <> end").withColumn("extra", (F.col("end").isNull() | (F.col("bucket") < F.col("end"))).cast("long"))
    both = inside.unionByName(outside)
    return both.select(*slim.columns, "source_size", "target", (F.col("epochs") + F.when(F.col("size") > 0, F.col("extra")).otherwise(0)).alias("copies"))


def weighed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, size, weight) of `docs`, computed once: size in words, weight by the best label of the doc_id."""
    best = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    weight = F.when(F.col("quality") >= 1, GOOD).when(F.col("quality") <= 0, POOR).otherwise(UNKNOWN)
    slim = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return cut(slim.join(best, "doc_id", "left").select("doc_id", "source", "size", weight.alias("weight")))


def mix_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it, with the columns of `docs`.

    A null or blank text has no words and isn't taken. Rows alike in doc_id, source and size are taken alike.
    """
    rows = mix(weighed(docs, labels)).where("copies > 0").groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies"))
    rows = rows.select(*[F.col(c).alias(f"mix_{c}") for c in rows.columns])
    size = n_words(docs["text"])
    on = docs["doc_id"].eqNullSafe(rows["mix_doc_id"]) & docs["source"].eqNullSafe(rows["mix_source"]) & (size == rows["mix_size"])
    taken = docs.join(rows, on).select(*[docs[c] for c in docs.columns], "mix_copies")
    return taken.withColumn("mix_copies", F.explode(F.sequence(F.lit(1), "mix_copies"))).drop("mix_copies")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of `documents`, by mix(), which states the odd cases."""
    slim = weighed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mix(slim).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP2_SQL = r"""
WITH best AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT d.doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  CASE WHEN quality >= 1 THEN 2.0 WHEN quality <= 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS weight,
  (('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w, (sum(source_size) OVER ())::BIGINT AS total, 3 * source_size AS bound FROM s),
f AS (SELECT *, coalesce(sum(bound) OVER (ORDER BY bound / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
  (sum(w) OVER (ORDER BY bound / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest FROM w),
g AS (SELECT *, bound * rest <= (total - before) * w AS is_full FROM f),
h AS (SELECT *, CASE WHEN is_full THEN bound::DOUBLE ELSE
  (total - coalesce((sum(bound) FILTER (WHERE is_full) OVER ())::BIGINT, 0))::DOUBLE * w / (sum(w) FILTER (WHERE NOT is_full) OVER ())::BIGINT END AS target FROM g),
t AS (SELECT source, source_size, target, CASE WHEN is_full THEN CASE WHEN source_size > 0 THEN 3 ELSE 0 END ELSE floor(target / source_size) END::BIGINT AS epochs FROM h),
o AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.epochs, t.target - t.epochs * t.source_size AS budget,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(u) / weight, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN 2 * ahead + size <= 2 * budget THEN 1 ELSE 0 END))::BIGINT AS taken FROM o
"""
