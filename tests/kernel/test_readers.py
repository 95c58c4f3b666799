import random

import pytest

from siltstone.functions import identity, lines, records, times
from siltstone.functions.formats import Detector, Format, Parsed, candidates
from siltstone.functions.levels import infer_level, is_error_type, level_of, level_of_severity_number
from siltstone.operators.stream import Declaration, Reader, State, project
from siltstone.plans import walkers
from siltstone.plans.packages import all_rules, github, jenkins
from siltstone.plans.rules import Declared, Marker, Package, Role, compose, shape_well_formed

JAN = 1_768_471_200  # 2026-01-15T10:00:00Z


@pytest.mark.parametrize(
    ("text", "seconds"),
    [
        ("2026-01-15T10:00:00", JAN),
        ("2026-01-15 10:00:00.123456Z", JAN),
        ("2026-01-15T10:00:00+02:00", JAN - 7200),
        ("2026-01-15T10:00:00-0130", JAN + 5400),
        ("2026-01-15T10:00:00+1", None),
        ("2026-01-15T10:00:00+25:00", None),
        ("2026-02-29T10:00:00", None),
        ("2024-02-29T10:00:00", 1_709_200_800),
        ("1677-01-01T00:00:00", None),
        ("2026-01-15", None),
    ],
)
def test_iso(text, seconds):
    assert times.iso8601(text) == (None if seconds is None else seconds * times.SECOND)


def test_other_stamps():
    at = JAN * times.SECOND
    assert times.clf("15/Jan/2026:12:00:00 +0200") == at
    assert times.short_year("26/01/15 10:00:00") == times.compact("260115", "100000") == at
    assert times.apache_error("Thu Jan 15 10:00:00.123 2026") == times.nginx_error("2026/01/15 10:00:00") == at
    assert times.health_app("20260115-10:0:0:5") == times.log4j("2026-01-15 10:00:00,1") == at
    assert times.epoch("1768471200") == at and times.epoch("x") is None and times.epoch("1" * 13) is None
    assert times.unix_nano("17") == 17 and times.unix_nano("9" * 19) is None
    assert times.bsd_syslog("Jan  5 10:00:01") == (1, 5, 36_001_000) and times.bsd_syslog("Foo  5 10:00:01") is None
    assert times.logcat("01-15 10:00:00.250").ms == 36_000_250 and times.proxifier("[01.15 10:00:00]").day == 15
    assert times.rfc3339_length("x2026-01-15T10:00:00.5Zy", 1) == 22 and times.rfc3339_length("2026-01-15T10:00:00.") == 0


def test_years_follow_from_the_line_before():
    reader, state = Reader(), State()
    seen = []
    for line in ("2025-12-31T23:59:58Z h app: x", "Dec 31 23:59:59 h app: x", "Jan  1 00:00:01 h app: x", "Feb 29 00:00:00 h app: x"):
        seen.append(reader.read(line, state)[0].timestamp_ns)
    # No year around 2026 has that last day.
    assert seen == [1_767_225_598 * times.SECOND, 1_767_225_599 * times.SECOND, 1_767_225_601 * times.SECOND, None]


@pytest.mark.parametrize(
    ("line", "level"),
    [
        ("all is well", "Unknown"),
        ("error: cannot open", "Error"),
        ("an error occurred here", "Unknown"),
        ("ERROR in module", "Error"),
        ("[warn] careful", "Warn"),
        ("2 errors, 1 failed", "Warn"),
        ("0 failed tests", "Unknown"),
        ("build failed after all", "Error"),
        ("ok build failed after all", "Unknown"),
        ("passed: retry after a timeout failed", "Unknown"),
        ("\u2713 handles error: cases".encode().decode("latin-1"), "Unknown"),
        ("\u2717 does it".encode().decode("latin-1"), "Error"),
        ("x.c:3:4: note: error: here", "Error"),
        ("x.c:3:4: note: it failed here", "Unknown"),
        ("NotFoundError: gone", "Error"),
        ("NoError: fine", "Unknown"),
        ("this is only a warning", "Warn"),
        ("Segmentation fault (core dumped)", "Error"),
        ("one two three four five six seven eight FATAL", "Error"),
        ("info nothing else", "Unknown"),
        ("it ends with info", "Info"),
    ],
)
def test_levels(line, level):
    assert infer_level(line) == level


def test_level_words():
    assert [level_of(w) for w in ("ERR", "emergency", "Notice", "dbg", "x")] == ["Error", "Fatal", "Info", "Debug", "Unknown"]
    assert [level_of_severity_number(n) for n in (-1, 1, 5, 9, 13, 17, 21, 99)] == ["Trace", "Trace", "Debug", "Info", "Warn", "Error", "Fatal", "Fatal"]
    assert is_error_type("IOError") and is_error_type("valueError") and not is_error_type("NotError") and not is_error_type("Error")


def test_detector():
    assert candidates('{"a":1}') == ["SystemdJournal", "CloudWatch", "JSON"] and candidates("  ") == []
    d = Detector()
    assert d.detect("a=1 b=2 c=3").name == "KeyValue" and d.detect("words").name == "RawText" and d.detect(" \t") is None
    assert d.detect_batch(["a=1", "a=1 b=2", "words"]).name == "KeyValue" and d.detect_batch(["", " "]) is None


def test_sticky_format_and_failed_lines():
    reader, state = Reader(), State()
    assert reader.read('{"message":"m"}', state)[0].parsed.format == "JSON"
    assert reader.read('{"logGroup":"g","message":"m"}', state)[0].parsed.format == "JSON"
    assert reader.read('{"resourceSpans":[]}', state)[1].startswith("JSON")
    assert reader.read("", state)[1] == "empty line" and reader.read(" ", state)[1] == "blank line"
    assert reader.read("plain", state)[0].id == 2
    assert Reader(pinned="JSON").read("plain", State())[0] is None


def test_escapes_and_endings():
    esc = "\x1b"
    for raw, clean in [
        (f"{esc}[1;31mred{esc}[0m\r\r", "red"),
        (f"a{esc}]0;title\x07b{esc}]8;;x{esc}\\c", "abc"),
        (f"a{esc}(b{esc}", "ab"),
        ("a\rb\r", "a\rb"),
        (f"{esc}]open", ""),
    ]:
        assert lines.normalize(raw) == clean


def test_transports():
    stack = lines.transport_stack(["utf8-bom-line-prefix", "api-rfc3339-line-prefix"])
    assert lines.peel("\xef\xbb\xbf2026-01-15T10:00:00.1234567Z  x", stack) == ("x", JAN * times.SECOND)
    assert lines.peel("2026-01-15T10:00:00.123Z x", stack) == ("2026-01-15T10:00:00.123Z x", None)
    bracket = lines.transport_stack(["bracket-rfc3339-line-prefix"])
    rendered = lines.render_transport("bracket-rfc3339-line-prefix", JAN * times.SECOND + 7_000_000)
    assert rendered == "[2026-01-15T10:00:00.007Z] " and lines.peel(rendered + "x", bracket) == ("x", JAN * times.SECOND)
    assert lines.render_transport("bracket-rfc3339-line-prefix", -1).startswith("[1969-12-31T23:59:59.999Z]")
    with pytest.raises(ValueError, match="unknown transport"):
        lines.transport_stack(["x"])
    assert lines.well_formed_prefix(b"a\xc3\xa9\xff") == 3 and lines.replace_ill_formed(b"a\xff") == "a\ufffd"


def test_records():
    r = records.read_record('{"msg":"a","message":"b","fields":{"component":"c"},"latency_ms":1.5,"size_bytes":-1}')
    assert (r.content, r.component, r.ordinals) == ("b", "c", [("latency_ms", records.DURATION, 1_500_000)])
    assert records.read_record('{"message":"a\\u00e9\\n"').content == "a\xc3\xa9\n"
    assert records.read_record('{"message":"unclosed') is None and records.read_record("[1]") is None
    assert records.scaled_decimal("1e3", 1) is None and records.scaled_decimal("9" * 19, 10) is None and records.scaled_decimal(".5", 1000) == 500
    assert records.telemetry_id("") == 0xCBF29CE484222325 and records.first_key(' {"k":1}') == "k"
    document = '{"resourceSpans":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"s"}}]},"scopeSpans":[{"spans":[{"name":"n","kind":3,"status":{"code":2},"startTimeUnixNano":"5","endTimeUnixNano":"9"}]}]}]}'
    (flat,) = records.unpack_export(document)
    span = records.read_record(flat)
    assert (span.content, span.component, span.span_level, span.ordinals[0][2], span.trace.is_span) == ("n", "s", "Error", 4, True)
    assert '"kind":"SPAN_KIND_CLIENT"' in flat and records.unpack_export("{}") == []


def test_units():
    for name, cls, what in [
        ("build v1.2 (x) 34", "build vX (M) N", "v1.2 (x) 34"),
        ("  a1b 2 ", "a1b 2", ""),
        ("py3.11 of 12", "py3.N of N", "11 of 12"),
        ("v1.2.3x", "vX.2.3x", "v1"),
        ("v3", "vX", "v3"),
    ]:
        assert (identity.unit_class(name), identity.discriminant(name)) == (cls, what)
    assert identity.unit_class("acme/tool@v4", "v4") == "acme/tool@vX" and identity.discriminant("acme/tool@v4", "v4") == "v4"
    assert identity.one_token_version("a/b@main", "@") == "main" and identity.one_token_version("a b@c", "@") == ""
    assert identity.template_id(b"Compiling module auth") == "h:06fe41380ed2377179650eb4edff1f31"
    assert identity.parse_template_id("h:" + "0" * 32) == bytes(16) and identity.parse_template_id("h:0") is None
    a, b = bytes(16), bytes(range(16))
    assert identity.sequence_id([a, b]) != identity.sequence_id([b, a])


def test_fixed_point():
    import math

    rng = random.Random(3)
    for v in [1, 2, 3, 1 << 63, (1 << 64) - 1, *(rng.randrange(1, 1 << 50) for _ in range(200))]:
        assert abs(identity.to_float(identity.log2_fixed(v)) - math.log2(v)) < 1e-9
    assert identity.log2_fixed(8) == 3 << 40 and identity.round_div(-5, 2) == -3 and identity.round_div(5, 2) == 3
    assert abs(identity.to_float(identity.ln_fixed(10)) - math.log(10)) < 1e-9


def test_rules():
    rules = all_rules()
    assert rules.identity == compose(*reversed(rules.packages)).identity and len(rules.identity) == 32
    view = rules.for_stream("github", "annotated")
    for content, role in [("##[group]x", "GroupBegin"), ("Received 1 of 2 (50.5%), 1 MBs/sec  ", "Progress"), ("Updating files: 5% (1/20), done.", "Progress"), ("x", "None")]:
        assert walkers.role_of(content, view) == role
    unit = walkers.unit_of("##[start-action id=job.build_2;display=Build it]", view)
    assert (unit.kind, unit.name, unit.display, unit.rank) == ("InnerStep", "build", "Build it", 1)
    assert walkers.unit_of("##[start-action id=a.__run_3;display=Say hi]", view).name == "Say hi"
    assert walkers.unit_of("Run x", view).kind == "None" and walkers.unit_of("Run a/b@v2", rules.for_stream("github", "stripped")).version == "v2"
    assert walkers.unit_of("[Pipeline] stage", rules.for_stream("jenkins")).kind == "None"
    assert walkers.unit_of("[Pipeline] { (Deploy 12)", rules.for_stream("jenkins")).name == "Deploy 12"
    assert walkers.unit_of("section_start:170:build[x=1]\rBuild", rules.for_stream("gitlab")).name == "build"
    assert walkers.test_location("at (src/a.spec.ts:3)", rules) == "src/a.spec.ts" and walkers.test_location("x_test.gox", rules) == ""
    assert rules.for_stream("github").withholds_markers_for("stripped")
    for bad in (lambda: rules.for_stream("x"), lambda: rules.for_stream("", "x"), lambda: walkers.outcome_of_token_in("a", "", rules), lambda: view.declared_runs({"x": "1"})):
        with pytest.raises(ValueError):
            bad()
    assert "leading zeros" in view.check_context({"run_id": "01"}) and view.check_context({"pull_request": "7"}) == ""


def test_bad_packages():
    for package in (
        Package(""),
        Package("a", roles=(Role("x", "Progress"),)),
        Package("a", roles=(Role("x", "GroupBegin", "b"),)),
        Package("a", markers=(Marker("x", "InnerStep"),)),
        Package("a", markers=(Marker("x", "Step", channel="c"),)),
        Package("a", declared=(Declared("k", ("m1",)),)),
        Package("a", declared=(Declared("k", min_digits=3),)),
    ):
        with pytest.raises(ValueError):
            compose(package)
    with pytest.raises(ValueError, match="conflict"):
        compose(Package("a", roles=(Role("x", "GroupBegin"),)), Package("b", roles=(Role("x", "GroupEnd"),)))
    with pytest.raises(ValueError, match="named"):
        compose(github, github)
    assert shape_well_formed("a {n} b") and not any(map(shape_well_formed, ("", "a ", "{n}{n}", "1{n}", "{n}.{n}", "{x}")))


def test_writers_and_readers_pair():
    rules = all_rules()
    for package in rules.packages:
        for channel in ("", *package.channels):
            view = rules.for_stream(package.name, channel)
            for row in view.markers:
                if row.role == "Names":
                    assert walkers.unit_of(walkers.render_unit(row, "alpha", "beta"), view).name == "alpha"
            for outcome in ("SUCCESS", "FAILURE", "ABORTED"):
                if line := walkers.render_outcome(view, outcome):
                    _, said, token = walkers.console_verdict(line, view)
                    assert (said or walkers.outcome_of_token(token, view)) == outcome
    assert walkers.is_incomplete("ABORTED") and walkers.is_regression("SUCCESS", "FAILURE") and not walkers.is_regression("SUCCESS", "ABORTED")


def test_dialect_gates_hold():
    """Rows of a dialect never fire under another, or under none."""
    rules = all_rules()
    plain = rules.for_stream()
    assert not plain.markers and not plain.lifts and not plain.outcome_tokens
    assert all(m.gate == "jenkins" for m in rules.for_stream("jenkins").markers)
    event = Reader(rules, Declaration("github")).read("##[error]bad", State())[0]
    assert (event.parsed.level, event.parsed.declared_level, event.role) == ("Error", True, "Terminator")
    assert Reader(rules).read("##[error]bad", State())[0].parsed.declared_level is False
    assert jenkins.name == "jenkins"


def test_projection_cells():
    event = Reader().read("a|b\tc 12", State())[0]
    cells = project(event)
    assert cells[8] == r"a\|b\tc <*>" and cells[9] == "1|12" and cells[0] == "0" and cells[11] == "0,0,0,0,0,0"


def test_decoder_and_member_reader_agree():
    """Whole JSON and the same members read one by one say the same."""
    rng = random.Random(7)
    names = ["message", "msg", "level", "a.level", "latency_ms", "x", "service", "timeUnixNano", "b.c.d", ""]

    def value(depth):
        pick = rng.randrange(7 if depth else 5)
        plain = [f'"{rng.choice(["m", "warn", "caf\xc3\xa9", "q\\\"q", ""])}"', str(rng.randrange(99)), "-1.5e3", "true", "null"]
        if pick < 5:
            return plain[pick]
        return "[1,{}]" if pick == 6 else "{" + ",".join(f'"{rng.choice(names)}" : {value(0)}' for _ in range(rng.randrange(3))) + "}"

    for _ in range(2000):
        text = " {" + ", ".join(f'"{rng.choice(names)}":{value(1)}' for _ in range(rng.randrange(6))) + "}"
        by_member = records._branches(text, records.members(text))
        whole = records.tree(text)
        flat = lambda own: [(n, k, [(a, b) for a, b in v if isinstance(b, str) and not isinstance(b, records._Number)] if k == "object" else v) for n, k, v in own if k != "array"]
        assert flat(whole) == flat(by_member)


def test_batches_know_registered_formats():
    mine = Format("Mine", lambda line: 0.9 if line.startswith("@@") else 0.0, lambda line: Parsed(line))
    d = Detector([mine])
    assert d.order()[-1] == "Mine" and d.detect_batch(["@@ a", "@@ b", "a=1"]).name == "Mine"
    tied = Detector([Format("Other", lambda line: Detector().scores(line).get("KeyValue", 0.0), lambda line: Parsed(line))])
    assert tied.detect_batch(["a=1 b=2"]).name == "KeyValue"
