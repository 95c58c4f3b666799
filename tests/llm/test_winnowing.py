import hashlib
import re

import pytest
from pyspark.sql import functions as F

from siltstone.llm import winnowing


def plain_fingerprint(grams, window):
    """Distinct (hash, place) of each window's least hash, rightmost on ties."""
    out = []
    for i in range(max(1, len(grams) - window + 1)) if grams else []:
        own = list(enumerate(grams))[i : i + window]
        least = min(h for _, h in own)
        place = max(p for p, h in own if h == least)
        if (least, place) not in out:
            out.append((least, place))
    return out


@pytest.mark.parametrize(("gram", "window"), [(5, 8), (1, 1), (2, 3), (3, 7)])
def test_rightmost_minimum_of_every_window(spark, docs, gram, window):
    grams = F.transform(winnowing.gram_hashes(winnowing.words(F.col("text")), gram), lambda x: F.shiftright(x, 31))
    prints = winnowing.selected(winnowing.fingerprint(F.col("text"), gram, window))
    for r in docs.select("text", grams.alias("grams"), prints.alias("prints")).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        assert len(r.grams) == (max(1, len(words) - gram + 1) if words else 0)
        assert [(p.hash, p.position) for p in r.prints] == plain_fingerprint(r.grams, window)


def test_shared_run_shares_a_fingerprint(spark):
    run = " ".join(f"w{i}" for i in range(12))
    rows = spark.createDataFrame([(f"a b c {run} d e f",), (f"x {run} y",)], "text string")
    a, b = [{p.hash for p in r.p} for r in rows.select(winnowing.selected(winnowing.fingerprint(F.col("text"))).alias("p")).collect()]
    assert a & b


def test_compare_edits(docs, no_docs):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    after = rows[1:] + rows[:1]
    edited = [x[: len(x) - len(x) // 4] + y[: len(x) // 4] for (_, x), (_, y) in zip(rows, after)]
    got = winnowing.compare_edits(docs.select("doc_id", "text")).collect()
    got.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [(r.doc_id, r.n_chars, r.edited) for r in got] == [(d, len(x), e) for (d, x), e in zip(rows, edited)]
    own = [{p >> 31 for p in r.prints} for r in got]
    for r, a, b in zip(got, own, own[1:] + own[:1]):
        c = {p >> 31 for p in r.edited_prints}
        assert r.near_edited == (len(a & c) / len(a | c) if a | c else 1)
        assert r.near_next == (len(a & b) / len(a | b) if a | b else 1)
    assert winnowing.compare_edits(no_docs.select("doc_id", "text")).count() == 0


def test_next_over_far_ids(spark):
    ids = [3, 70, 71, 5000, 1 << 40, -7, (1 << 62) + 1]
    rows = winnowing.with_next(spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")).collect()
    order = sorted(ids)
    assert {r.doc_id: r.next_text for r in rows} == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1])}


def test_with_fingerprints_keeps_columns(docs):
    got = winnowing.with_fingerprints(docs)
    assert got.columns == [*docs.columns, "fingerprint"] and got.count() == docs.count()
    assert hashlib.sha256(b"").hexdigest() == docs.select(winnowing.digest(winnowing.fingerprint(F.lit(None).cast("string"))).alias("d")).first().d


def test_rolling_hash(spark):
    rows = spark.createDataFrame([(" ".join(f"w{i % 13}" for i in range(n)),) for n in (0, 1, 2, 3, 4, 5, 6, 9, 40)], "text string")
    for gram in (1, 2, 3, 5, 6, 7, 8, 13):
        one = F.transform(winnowing.words(F.col("text")), lambda w: F.pmod(F.xxhash64(w), F.lit(winnowing.PRIME)))
        grams = winnowing.gram_hashes(winnowing.words(F.col("text")), gram)
        for r in rows.select(one.alias("one"), grams.alias("grams")).collect():
            runs = [r.one[i : i + gram] for i in range(max(1, len(r.one) - gram + 1))] if r.one else []
            want = [sum(h * winnowing.BASE ** (len(x) - 1 - k) for k, h in enumerate(x)) % winnowing.PRIME for x in runs]
            assert [x >> 31 for x in r.grams] == want and [(1 << 31) - 1 - (x & (1 << 31) - 1) for x in r.grams] == list(range(len(want)))


def test_many_rows_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(winnowing, "SPLIT_ROWS", 8)
    rows = [(None, f"n{k}") for k in range(60)] + [(5, f"f{k}") for k in range(40)] + [(6, f"s{k % 9}") for k in range(40)] + [(70, "last")]
    placed = winnowing.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({(r.block.ids, r.block.part) for r in placed}) > 12
    order = sorted(placed, key=lambda r: (r.block.ids, r.block.part, r.row))
    assert [r.next_text for r in order] == [r.text for r in order[1:] + order[:1]]
    assert [r.doc_id for r in order if r.doc_id is not None] == sorted(d for d, _ in rows if d is not None)
    assert sorted((str(r.doc_id), r.text) for r in placed) == sorted((str(d), t) for d, t in rows)
