"""The corpus pipeline: language ID, line dedup, near-dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame; all but the
last return the columns of `documents`. Written as Parquet, a stage's rows are the next one's `docs`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import bpe, langid, linededup, mixing, simhash
from siltstone.llm.common import cut, ready, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tells each document's language, which becomes its `lang`, and rejects those that it can't tell.

    Rejected are null texts, texts without a letter, and texts whose score is under one in the number of languages
    learned, so no better than a guess. A text in any of the languages stays, whatever `lang` said. Rows count each,
    repeated ones and null ids too. Where no row has a `lang` nothing is learned and all are rejected; an empty table
    gives an empty one. Columns beyond those of `documents` are left out.
    """
    ready(spark)
    model = langid.train(docs.select("doc_id", "text", "lang"))
    told = langid.identify(docs.select(*COLUMNS), model).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= model.guess))
    return told.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that ten documents or more hold. A document that loses all its lines stays, with an empty text.

    Every row is a document, repeated ones and null ids too; a null text becomes an empty one. n_chars counts what is left.
    An empty table gives an empty one.
    """
    ready(spark)
    kept = linededup.drop_frequent_lines(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicate texts: that of smallest doc_id, null ids last.

    Rows of one doc_id count by their own texts: unlinked ones stay each. Where several rows of a group have its smallest
    doc_id, or where it has null ids only, the one of least text digest stays, then of least other columns.
    Near-duplicates are those of op4_simhash at its defaults: shingles of 4 words, 4 of 64 bits. That isn't five words at
    a similarity of 0.8; recall at that similarity isn't measured.
    """
    ready(spark)
    # True or null, so that the type is the same on both sides of the join and no cast hides how the texts are dealt.
    no_id = F.when(F.col("doc_id").isNull(), True).alias("no_id")
    row = F.struct(no_id, "doc_id", F.unhex(F.md5("text")).alias("digest"), "lang", "source", "n_chars")
    docs = docs.select(*COLUMNS).withColumn("row", row)
    fps = cut(simhash.fingerprints(docs, "row"))
    keep = simhash.leaders(fps).withColumnRenamed("component_id", "kept_row")
    # Rows alike in every column are one. The join has dealt the texts by row already, so this doesn't deal them again.
    return docs.join(keep, F.col("row") == F.col("kept_row"), "left_semi").dropDuplicates(["row"]).select(*COLUMNS)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes sources to their targets: documents that the mix leaves out go, those it takes more than once come as often.

    Documents weigh by the labels table. Null sources are a source of their own; texts without a word aren't taken. Rows
    alike in doc_id, source and size are taken alike. An empty table gives an empty one.
    """
    return mixing.mix_documents(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and digests of ids and decoded bytes; a null text is an empty one. Rows stay each."""
    ready(spark)
    return bpe.digests(bpe.encode_texts(docs.select("doc_id", "text")))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing_weights),
    ("byte_bpe", byte_bpe),
]

#: Language ID learns, SimHash links transitively and BPE merges: SQL can't express those stages. tests/llm/test_pipeline.py
#: holds the stages, and all of them together, to plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. A stage's rows are a Parquet table in the shared folder, which the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
