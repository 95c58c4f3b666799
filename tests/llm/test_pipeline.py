import hashlib

from test_simhash import plain_components, plain_fingerprint

import corpus_pipeline as pipeline

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, DATA).cache()
        kept[name] = docs.count()
        if name != "byte_bpe":
            assert docs.columns == columns
    assert kept["language_id"] == kept["line_dedup"] > kept["near_dedup"] > 0 and kept["mixing"] == kept["byte_bpe"]
    assert pipeline.run(spark, DATA).count() == kept["byte_bpe"]


def least_rows(rows):
    """The row of smallest doc_id of each group, null ids last; ties by text digest, then by the other columns, nulls first."""
    groups = {}
    for r, root in zip(rows, plain_components([plain_fingerprint(r.text) for r in rows], 4)):
        groups.setdefault(root, []).append(r)
    digest = lambda r: b"" if r.text is None else hashlib.md5(r.text.encode()).digest()
    order = lambda r: (r.doc_id is None, r.doc_id or 0, digest(r), r.lang or "", r.source or "", -1 if r.n_chars is None else r.n_chars)
    return sorted((min(g, key=order) for g in groups.values()), key=repr)


def test_near_dedup_keeps_one_row_a_group(spark, docs, no_docs):
    prose = lambda seed: " ".join(f"{seed}w{k}" for k in range(40))
    own = [(None, "nobody's duplicate"), (None, "nobody's duplicate"), (None, "another one alone"), (None, prose("n")), (None, prose("n").upper())]
    own += [(70, prose("a")), (70, prose("b")), (65, prose("a")), (80, prose("n2")), (None, prose("n2"))]
    more = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in own], "doc_id long, text string, lang string, source string, n_chars long")
    whole = docs.select(*pipeline.COLUMNS).union(more)
    want = least_rows(whole.collect())
    assert {r.doc_id for r in want} >= {None, 65, 70, 80}
    for broadcast in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        try:
            got = pipeline.near_dedup(spark, whole.repartition(5), DATA)
            assert sorted(got.collect(), key=repr) == want and got.columns == pipeline.COLUMNS
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert pipeline.near_dedup(spark, no_docs, DATA).count() == 0
