import re
from collections import Counter

from siltstone.llm.linededup import LineRuns, dealt_alike, document_lines, drop_frequent_lines


def plain(rows, least):
    key = lambda line: re.sub(r"^[ \t-\r]+|[ \t-\r]+\Z", "", line).translate({c: c + 32 for c in range(65, 91)})
    seen = Counter(k for r in rows for k in {key(x) for x in (r.text or "").split("\n")} if k)
    for r in rows:
        lines = (r.text or "").split("\n")
        kept = [x for x in lines if seen[key(x)] < least]
        yield r.doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)


def test_same_as_plain(docs):
    rows = docs.collect()
    for least in (2, 10, 25):
        got = drop_frequent_lines(docs, min_docs=least)
        assert got.columns == [*docs.columns, "_n_lines", "n_dropped"]
        found = [(r["doc_id"], r["text"], r["_n_lines"], r["n_dropped"]) for r in got.collect()]
        assert sorted(found, key=repr) == sorted(plain(rows, least), key=repr)


def test_empty_table(no_docs):
    assert drop_frequent_lines(no_docs).count() == 0


def test_levels_and_anti_join(docs):
    lines, runs = document_lines(docs).cache(), LineRuns(fanout=2)
    for k in range(5):
        runs.add(lines.where(f"pmod(doc_id, 5) = {k}"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    known = {bytes(r.key_hash) for r in lines.where("doc_id is not null").collect()}
    assert {bytes(r.key_hash) for r in runs.unseen(lines).collect()} == {bytes(r.key_hash) for r in lines.collect()} - known


def test_incremental_feed(docs):
    lines, runs, seen = document_lines(docs.where("doc_id IS NOT NULL")).cache(), LineRuns(fanout=2), set()
    for k in range(3):
        batch = lines.where(f"pmod(doc_id, 3) = {k}")
        own = {bytes(r.key_hash) for r in batch.collect()}
        assert {bytes(r.key_hash) for r in runs.ingest(batch).collect()} == own - seen
        seen |= own
    assert sum(r.count() for r in runs.runs()) >= len(seen)


def test_settled_keys_leave_later_batches(spark, docs):
    lines, runs = document_lines(docs.where("doc_id IS NOT NULL")).cache(), LineRuns(fanout=2, min_docs=3)
    counts = Counter(bytes(r.key_hash) for r in lines.collect())
    for k in range(6):
        runs.add(lines.where(f"pmod(doc_id, 6) = {k}"))
    found = [bytes(r.key_hash) for r in runs.frequent(3).collect()]
    assert sorted(found) == sorted(k for k, n in counts.items() if n >= 3)
    settled = {bytes(r.key_hash) for run in runs.settled for r in run.collect()}
    assert settled and settled <= set(found)
    assert not settled & {bytes(r.key_hash) for r in runs._open(lines.select("key_hash")).collect()}


def test_batches_meet_the_runs_without_an_exchange_of_theirs(spark, docs, capsys):
    lines, runs = document_lines(docs).cache(), LineRuns(fanout=2, min_docs=2)
    runs.add(lines)
    with dealt_alike(spark):
        runs._open(lines.groupBy("key_hash").count()).explain()
        runs._merged([runs.runs()[0], runs.runs()[0]]).explain()
    met, merged = capsys.readouterr().out.split("== Physical Plan ==")[1:]
    assert "SortMergeJoin" in met and "LeftAnti" in met and met.count("Exchange") == 1
    assert "Exchange" not in merged


def test_rows_without_or_with_one_id(spark):
    shared = "a line that all have"
    rows = [(None, f"{shared}\nn{k}") for k in range(6)] + [(7, f"{shared}\ns{k}") for k in range(5)] + [(8, "own\n" + shared.upper())] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in drop_frequent_lines(df).collect()), key=repr)
    assert got == sorted(plain(df.collect(), 10), key=repr) and all(r[3] == 1 for r in got)
