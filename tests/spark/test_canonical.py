import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from siltstone.functions import columns, identity, lines
from siltstone.operators import canonical, reports
from siltstone.operators.stream import CELLS, Declaration, Reader, State, project
from siltstone.plans import walkers
from siltstone.plans.packages import all_rules
from siltstone.sources.lines import read_lines, write_templates
from siltstone.streaming.canonical import canonicalize_stream

RAW = [
    b"2026-01-15T10:00:00Z web01 app: user 5 failed\r",
    b"Jan 15 10:00:01 web01 app[7]: \x1b[31mok\x1b[0m 12ms",
    b'{"message":"took 5ms","level":"warn","latency_ms":5}',
    b"",
    b" \t",
    b"caf\xc3\xa9 \xff 10.0.0.1",
    b'{"traceId":"ab","spanId":"cd","name":"op","startTimeUnixNano":"17","links":[{"spanId":"x"}]}',
    b"##[error]bad thing 7",
    None,
]


@pytest.fixture
def stream_lines(spark):
    rows = [(s, n, raw, "extra") for s in ("a", "b") for n, raw in enumerate(RAW)]
    return spark.createDataFrame(rows, "stream_id string, line_no long, raw binary, level string").repartition(5)


def by_hand(declaration=Declaration()):
    rules, state = all_rules(), State()
    reader = Reader(rules, declaration)
    return [reader.read((raw or b"").decode("latin-1"), state) for raw in RAW]


def test_stream_mode_is_the_reader(stream_lines):
    declaration = {"b": Declaration("github")}
    projected = canonical.projection(canonical.canonicalize(stream_lines, all_rules(), declaration, mode="stream"))
    got = defaultdict(list)
    for r in projected.orderBy("stream_id", "line_no").collect():
        got[r.stream_id].append([r[c] for c in CELLS])
    for stream, d in (("a", Declaration()), ("b", Declaration("github"))):
        want = [[canonical.utf8(c) for c in project(e)] for e, _ in by_hand(d) if e]
        assert got[stream] == want


def test_stateless_mode_and_counters(stream_lines):
    events = canonical.canonicalize(stream_lines)
    assert events.count() == 2 * len(RAW) and {r.id for r in events.select("id").collect()} == {None}
    assert {tuple(r) for r in canonical.counters(events).collect()} == {(s, 6, 0, 3, 6, 0) for s in "ab"}
    assert canonical.canonicalize(stream_lines.where("false")).count() == 0
    with pytest.raises(ValueError):
        canonical.canonicalize(stream_lines, mode="x")
    with pytest.raises(ValueError, match="dialect"):
        canonical.canonicalize(stream_lines, declarations=Declaration("nope"))


def test_digests(stream_lines):
    projected = canonical.projection(canonical.canonicalize(stream_lines, mode="stream"))
    cells = [r["template_str"] for r in projected.where("stream_id = 'a'").orderBy("line_no").collect()]
    want = hashlib.sha256("".join(c + "\n" for c in cells).encode()).hexdigest()[:32]
    row = reports.digests(projected).where("stream_id = 'a' AND member = 'template_str'").first()
    assert (row.digest, row.events) == (want, len(cells))


def test_counts_and_entropy(spark, stream_lines):
    counts = reports.template_counts(canonical.canonicalize(stream_lines))
    assert counts.agg(F.sum("n")).first()[0] == 12 and {r.n for r in counts.collect()} == {2}
    assert reports.entropy_bits(counts).first().bits == pytest.approx(2.584962500721156, abs=1e-9)
    exact = counts.agg(reports.weighted_log2(F.col("n"), F.col("n"))).first()[0]
    assert int(exact) == 6 * 2 * identity.log2_fixed(2)
    one = spark.createDataFrame([(7,)], "n long")
    assert reports.entropy_bits(one).first().bits == 0


def test_column_rules_agree_with_walkers(spark):
    view = all_rules().for_stream("github", "annotated")
    contents = [r.prefix.replace("{n}", "5.5") for r in view.roles] + [r.prefix + "x" for r in (*view.lifts, *view.markers)] + [r.shape for r in view.stops]
    contents += ["", "Received 1. of 2 (3%), 4 MBs/sec", "Updating files: 5% (1/20) ", "plain"]
    rows = spark.createDataFrame([(c,) for c in contents], "c string")
    c = F.col("c")
    got = rows.select("c", columns.role_column(c, view), columns.lift_column(c, view), columns.stop_column(c, view), columns.opener_column(c, view), columns.closer_column(c, view)).collect()
    for r in got:
        said = (walkers.role_of(r[0], view), walkers.lifted_level(r[0], view), walkers.announces_stop(r[0], view), walkers.opener_of(r[0], view), walkers.closes(r[0], view))
        assert tuple(r)[1:] == said


def test_simple_templates_agree_with_the_kernel(spark):
    contents = ["a 1 b", "  x=5 y 7ms", "took +3 -4.5 ~6", "k.v-w=10 z=a", "", "1", "word"]
    rows = spark.createDataFrame([("s", k, c) for k, c in enumerate(contents)], "stream_id string, line_no long, raw string")
    kernel = canonical.canonicalize(rows, pinned="").where("format = 'RawText'").select("line_no", "template_str", "content")
    both = kernel.select("template_str", columns.simple_template(F.regexp_replace("content", " +", " ")).alias("e"))
    assert all(r.template_str == r.e for r in both.collect()) and both.count() == 4


def test_line_columns(spark):
    raws = [b"a\x1b[1mb\x1b]0;t\x07c\r\r", b"2026-01-15T10:00:00.1234567Z x", b"[2026-01-15T10:00:00Z] y", b"\xef\xbb\xbfz", b"\x1b", b"plain"]
    rows = spark.createDataFrame([(r,) for r in raws], "raw binary")
    latin = lines.latin_column(F.col("raw"))
    stack = lines.transport_stack(list(lines.TRANSFORMS))
    content, seen = lines.peel_column(latin, stack)
    for r in rows.select("raw", lines.normalize_column(latin), content, seen).collect():
        text = bytes(r.raw).decode("latin-1")
        assert r[1] == lines.normalize(text) and r[2] == lines.peel(text, stack)[0]


def test_run_outcomes(spark):
    rows = [("a", 0, "Finished: SUCCESS"), ("a", 1, "x\rFinished: FAILURE"), ("a", 2, "Finished: nice try"), ("b", 0, "nothing"), ("c", 0, "Finished: ODD"), ("d", 0, "Finished: ABORTED")]
    df = spark.createDataFrame(rows, "stream_id string, line_no long, raw string")
    got = {r.stream_id: r for r in reports.run_outcomes(df, all_rules(), Declaration("jenkins"), {"a": ("jenkins", "UNSTABLE"), "b": ("github", "nope"), "d": ("github", "timed_out")}).collect()}
    assert (got["a"].outcome, got["a"].console, got["a"].divergent) == ("UNSTABLE", "FAILURE", True)
    assert got["b"].outcome == "UNKNOWN" and "nope" in got["b"].note and "ODD" in got["c"].note
    assert (got["d"].outcome, got["d"].authoritative, got["d"].divergent) == ("ABORTED", True, False)


def test_files(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/a.log").write_bytes(b"one 1\r\ntwo\rx\n\nlast")
    (tmp_path / "in/deep/b.log").write_bytes(b"b 2\n" * 50)
    (tmp_path / "in/c.txt").write_bytes(b"no\n")
    got = read_lines(spark, str(tmp_path / "in"), "*.log", recursive=True)
    rows = {(r.stream_id.rpartition("/")[2], r.line_no): bytes(r.raw) for r in got.collect()}
    assert [rows["a.log", k] for k in range(4)] == [b"one 1\r", b"two\rx", b"", b"last"] and len(rows) == 54
    assert read_lines(spark, str(tmp_path / "in"), "*.log", recursive=True, limit=3).count() == 3
    write_templates(canonical.canonicalize(got), str(tmp_path / "out"))
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.split("\n")[:4] == ["one <*>", "two\rx", "", "last"]


def test_exports(spark):
    document = '{"resourceSpans":[{"scopeSpans":[{"spans":[{"name":"a","startTimeUnixNano":"1"},{"name":"b","startTimeUnixNano":"2"}]}]}]}'
    rows = spark.createDataFrame([("s", 0, document), ("s", 1, "plain")], "stream_id string, line_no long, raw string")
    got = canonical.unpack_exports(rows)
    assert sorted((r.line_no, r.sub_no) for r in got.collect()) == [(0, 0), (0, 1), (1, 0)]


def test_split_streams_agree_with_whole_ones(spark):
    import random

    rng = random.Random(4)
    kinds = [
        lambda n: f"2025-12-{1 + n % 28:02d}T10:00:00Z h app: step {n}",
        lambda n: f"{rng.choice(['Jan', 'Dec', 'Jun'])} {1 + n % 28:2d} 10:00:00 h app: step {n} failed",
        lambda n: '{"message":"m"}',
        lambda n: '{"logGroup":"g","message":"m"}',
        lambda n: "  " * (n % 2),
        lambda n: f"a={n} b=2",
        lambda n: f"plain {n}",
        lambda n: f"26011{n % 10} 100000 12 INFO dfs.Node: block {n}",
        lambda n: f"26/01/1{n % 10} 10:00:00 INFO dfs.Node: block {n}",
        lambda n: '{"resourceSpans":[]}',
    ]
    rows = []
    for stream in range(6):
        own = rng.sample(kinds, rng.randrange(2, 7))
        n, undated = 0, stream == 5
        for _ in range(rng.randrange(5, 25)):
            kind = kinds[1] if undated else rng.choice(own)
            for _ in range(rng.randrange(1, 12)):
                rows.append((f"s{stream}", n, kind(n)))
                n += rng.randrange(1, 3)
    df = spark.createDataFrame(rows, "stream_id string, line_no long, raw string").repartition(7)
    order = ["stream_id", "line_no"]
    whole = canonical.canonicalize(df, all_rules(), mode="stream").orderBy(*order).collect()
    for chunk in (1, 7, 1000):
        assert canonical.canonicalize(df, all_rules(), mode="split", chunk_lines=chunk).orderBy(*order).collect() == whole


def test_contexts_within_a_stream(spark, tmp_path):
    rules, declared = all_rules(), Declaration("github", context=(("pull_request", "11111"),))
    said = {0: {"a": {"run_id": "1234567890"}}, 7: {"a": {"pull_request": "22222"}, "b": {"pull_request": "33333"}}, 12: {"a": {}}, 14: {"a": {"pull_request": "44444"}}, 40: {"b": {}}}
    text = lambda n: f"Jan 15 10:{n:02d}:00 h app: PR#11111 PR#22222 PR#33333 PR#44444 run 1234567890" if n % 4 else f"2026-01-15T10:{n:02d}:00Z h app: PR#22222"
    lines = [(s, n, text(n)) for s in "ab" for n in range(20)]
    changes = [(s, n, c) for n, own in said.items() for s, c in own.items()]
    want = []
    for s in "ab":
        reader, state = Reader(rules, declared), State()
        for n in range(20):
            if s in said.get(n, {}):
                reader, state.year_reference = Reader(rules, Declaration("github", context=tuple(said[n][s].items()))), None
            e, _ = reader.read(text(n), state)
            want.append((s, n, e.id, e.timestamp_ns, e.template))
    assert len({w[4] for w in want}) > 4 and any(w[3] is None for w in want if w[1] == 7)
    schemas = ("stream_id string, line_no long, raw string", "stream_id string, line_no long, context map<string,string>")
    frames = [spark.createDataFrame(rows, schema).repartition(3) for rows, schema in zip((lines, changes), schemas)]
    columns_ = ["stream_id", "line_no", "id", "timestamp_ns", "template_str"]
    for mode, chunk in (("stream", 1), ("split", 3), ("split", 50)):
        got = canonical.canonicalize(frames[0], rules, declared, mode=mode, contexts=frames[1], chunk_lines=chunk).select(*columns_).collect()
        assert sorted(map(tuple, got)) == want, mode
    got = canonical.canonicalize(frames[0], rules, declared, contexts=frames[1]).select("stream_id", "line_no", "template_str", "context").collect()
    assert sorted((r.stream_id, r.line_no, r.template_str) for r in got) == [(w[0], w[1], w[4]) for w in want]
    assert {r.line_no: r.context for r in got if r.stream_id == "a"}[13] == {}
    for batch in (range(10), range(10, 50)):
        for rows, schema, name in zip((lines, changes), schemas, "lc"):
            spark.createDataFrame([r for r in rows if r[1] in batch], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    streams = [spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)) for schema, name in zip(schemas, "lc")]
    out = canonicalize_stream(streams[0], rules, declared, contexts=streams[1]).writeStream.format("memory").queryName("declared")
    out.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(map(tuple, spark.table("declared").select(*columns_).collect())) == want


DECLARATIONS = "stream_id string, dialect string, channel string, transports array<string>, context map<string,string>"


def test_declarations_as_a_table(spark, tmp_path):
    rules, text = all_rules(), "2026-01-15T10:00:00.1234567Z merge PR-4711 into refs/heads/fix-it"
    by_name = {
        "a": Declaration("github", context=(("pull_request", "4711"),)),
        "b": Declaration("github", context=(("head_ref", "fix-it"), ("pull_request", "1"))),
        "c": Declaration("github", transports=("api-rfc3339-line-prefix",), context=(("pull_request", "4711"),)),
    }
    lines_ = [(s, n, text) for s in ("a", "b", "c", "d", None) for n in range(5)]
    rows = [(s, d.dialect, d.channel, list(d.transports), dict(d.context)) for s, d in by_name.items()]
    # Repeated rows change nothing; a null stream_id names no stream; null members declare nothing.
    rows += [rows[0], (None, "github", None, None, {"pull_request": "4711"}), ("d", None, None, None, None)]
    schema = "stream_id string, line_no long, raw string"
    df, table = spark.createDataFrame(lines_, schema).repartition(3), spark.createDataFrame(rows, DECLARATIONS)
    columns_ = ["stream_id", "line_no", "id", "timestamp_ns", "template_str", "content"]
    read = lambda declarations, **more: sorted(map(tuple, canonical.canonicalize(df, rules, declarations, **more).select(*columns_).collect()), key=repr)
    want = read(by_name, mode="stream")
    assert len(want) == len(lines_) and len({w[4] for w in want}) == 4
    for limit in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            assert read(table, mode="stream") == want and read(table, mode="split", chunk_lines=2) == want
            assert read(table) == read(by_name) and read(table.where("false")) == read({})
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    changes = spark.createDataFrame([("a", 2, {"head_ref": "fix-it"})], "stream_id string, line_no long, context map<string,string>")
    for mode in ("stateless", "stream", "split"):
        assert read(table, mode=mode, contexts=changes) == read(by_name, mode=mode, contexts=changes)
    spark.createDataFrame([x for x in lines_ if x[0]], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = canonicalize_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), rules, table).writeStream.format("memory").queryName("by_table")
    out.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    got = spark.table("by_table").select(*columns_[:5]).collect()
    assert sorted(map(tuple, got), key=repr) == [w[:5] for w in want if w[0]]
    with pytest.raises(Exception, match="nope"):
        canonical.canonicalize(df, rules, spark.createDataFrame([("a", "nope", None, None, None)], DECLARATIONS)).count()


def test_side_inputs_as_a_table(spark):
    rows = [("a", 0, "Finished: SUCCESS"), ("a", 1, "x\rFinished: FAILURE"), ("b", 0, "nothing"), ("c", 0, "Finished: ODD"), ("d", 0, "Finished: ABORTED"), ("e", 0, "Finished: ABORTED")]
    df = spark.createDataFrame(rows, "stream_id string, line_no long, raw string")
    inputs = {"a": ("jenkins", "UNSTABLE"), "b": ("github", "nope"), "d": ("github", "timed_out")}
    by_name = {s: Declaration("jenkins") for s in "abcd"}
    want = sorted(map(tuple, reports.run_outcomes(df, all_rules(), by_name, inputs).collect()))
    declared = spark.createDataFrame([(s, "jenkins", None, None, None) for s in "abcd"], DECLARATIONS)
    given = [(s, *x) for s, x in inputs.items()] + [("a", "jenkins", "UNSTABLE"), ("c", None, "SUCCESS"), ("e", "jenkins", None), (None, "jenkins", "SUCCESS"), ("z", "jenkins", "SUCCESS")]
    side = spark.createDataFrame(given, "stream_id string, vocabulary string, token string")
    assert sorted(map(tuple, reports.run_outcomes(df, all_rules(), declared, side).collect())) == want
    assert [r[1] for r in want] == ["UNSTABLE", "UNKNOWN", "UNKNOWN", "ABORTED", "UNKNOWN"]
    none = reports.run_outcomes(df, all_rules(), declared, side.where("false"))
    assert sorted(map(tuple, none.collect())) == sorted(map(tuple, reports.run_outcomes(df, all_rules(), by_name).collect()))
