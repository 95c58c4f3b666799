"""Templates: values that vary from run to run become `<*>`, one line at a time and from that line alone."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from .chars import CLOSE, OPEN, OPEN_SET, PAIRS, TAIL_SET, TRAIL, WILDCARD, shell_core
from .levels import lower
from .times import rfc3339_length

# Words before a kept status and its digits; least length of a hash; group counts of hardware addresses.
STATUS_WORDS, STATUS_DIGITS, HASH_LEN, HARDWARE_GROUPS = frozenset(("code", "status", "exit", "signal")), 3, 16, (6, 8, 12)
# Folders whose contents are made anew; whether they must open the path, and whether all below them goes.
ROOTS = (
    (("tmp",), True, True),
    (("var", "tmp"), True, True),
    (("var", "folders"), True, True),
    (("private", "var", "folders"), True, True),
    (("private", "tmp"), True, True),
    (("nix", "store"), True, False),
    ((".conan2", "p", "b"), False, False),
    (("global", "v11"), False, False),
    (("AppData", "Local", "Temp"), False, True),
)
_H, _AN = "[0-9A-Fa-f]", "[0-9A-Za-z]"
_IPV4 = re.compile(rf"{OPEN_SET}?[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}(?::[0-9]*)?{TAIL_SET}{{0,2}}\Z")
_HEXTET = re.compile(rf"{_H}{{1,4}}\Z")
_QUAD = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}\Z")
_PAIR_GROUPS = {s: re.compile(rf"{_H}{{2}}(?:{s}{_H}{{2}})+\Z") for s in ":-"}
_CISCO = re.compile(rf"{_H}{{4}}\.{_H}{{4}}\.{_H}{{4}}\Z")
_RUN = re.compile(rf"(?<!{_AN}){_H}{{1,4}}(?::{_H}{{1,4}}(?!{_AN}))+")
_IDENTITY = re.compile(
    rf"{_H}{{8}}(?:-{_H}{{4}}){{3}}-{_H}{{12}}"
    rf"|(?<!{_AN})[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{6}}Z(?!{_AN})"
    rf"|(?<!{_H}){_H}{{{HASH_LEN},}}"
)
_UUID_OR_HASH = re.compile(rf"(?:{_H}{{8}}(?:-{_H}{{4}}){{3}}-{_H}{{12}}|{_H}{{{HASH_LEN},}})\Z")
_DIGIT_LED = re.compile(r"[+~-]?[0-9]")
_SEPARATOR = re.compile(rf"[:/#\-=@{re.escape(OPEN + CLOSE)}]")
_PATH_LEAD = re.compile(rf"{OPEN_SET}*(?:[0-9A-Za-z_.-]+={OPEN_SET}*)?(?:file://)?(?:/|\\+)")
_STEP = re.compile(r"/|\\+")
_VERSIONED = re.compile(r"(.*/)([0-9][0-9.]*)([^0-9A-Za-z/]*)\Z", re.S)
_INDEX = re.compile(r"([^\[]*\[[A-Za-z]*)([0-9]+)(\].*)", re.S)
_COUNTER = re.compile(r"#[0-9]+([^0-9A-Za-z]*)\Z")
_MONEY = re.compile(r"\$[0-9]+(?:\.[0-9]+|(?!\.))([^0-9A-Za-z]*)\Z")
_PID = re.compile(r"==[0-9]+(==(?:[A-Za-z].*)?)\Z", re.S)
_KEY = re.compile(r"[A-Za-z_][0-9A-Za-z_.-]*\Z")
_EXTENT = re.compile(r"(?:<\*>|[0-9A-Za-z._+%~-]|[,:/](?=[0-9]|<\*>))*")
_TAIL_ONLY = re.compile(rf"{TAIL_SET}*\Z")


#: Numbers, and numbers under a key, too short for a hash: what most tokens that vary are.
_BARE = re.compile(r"[0-9]{1,15}\Z")
_BARE_VALUE = re.compile(r"([A-Za-z_]{1,15})=[0-9]{1,15}\Z")
_DIGIT = re.compile("[0-9]")
#: Tokens, and lines without a digit, whose forms a masker remembers.
REMEMBERED = 50_000


def is_status_word(word: str) -> bool:
    return 4 <= len(word) <= 6 and lower(word) in STATUS_WORDS


def _digits(text: str) -> bool:
    return text.isascii() and text.isdigit()


def _kept_status(value: str, before: str) -> bool:
    return _digits(value) and len(value) <= STATUS_DIGITS and is_status_word(before)


# --- addresses


def _ipv6(core: str) -> tuple[bool, bool, bool, int] | None:
    """(compressed, dotted tail, a group with a leading zero, groups) of an IPv6 text, or None."""
    core, mark, zone = core.partition("%")
    if mark and not re.fullmatch(r"[0-9A-Za-z._~-]+", zone):
        return None
    sides = core.split("::")
    if len(sides) > 2 or ":::" in core:
        return None
    last = len(sides) - 1 if sides[-1] else 0
    units, dotted, zero = 0, False, False
    for k, side in enumerate(sides):
        if not side and len(sides) == 2:
            continue
        groups = side.split(":")
        for j, group in enumerate(groups):
            if k == last and j == len(groups) - 1 and "." in group:
                if not _QUAD.match(group) or any(int(x) > 255 for x in group.split(".")):
                    return None
                units, dotted = units + 2, True
            elif _HEXTET.match(group):
                units, zero = units + 1, zero or len(group) > 1 and group[0] == "0"
            else:
                return None
    compressed = len(sides) == 2
    return (compressed, dotted, zero, units) if (units < 8 if compressed else units == 8) else None


def _admitted(found: tuple[bool, bool, bool, int]) -> bool:
    compressed, dotted, zero, units = found
    return compressed and (dotted or units >= 2 and not zero)


def _core_is_address(core: str, colon_shed: bool) -> bool | None:
    """Whether a token without its wrappers is an IPv6 or hardware address; None where it may yet be one, cut shorter."""
    if found := _ipv6(core):
        return found[1] or not colon_shed and (not found[0] or _admitted(found))
    head, _, port = core.rpartition(":")
    if len(port) == 5 and _digits(port) and int(port) <= 65535 and (found := _ipv6(head)) and _admitted(found):
        return True
    if _PAIR_GROUPS[":"].match(core) and (groups := (len(core) + 1) // 3) >= 4:
        return groups in HARDWARE_GROUPS
    if _PAIR_GROUPS["-"].match(core) and len(core) >= 8 or _CISCO.match(core):
        return False
    return None


_PORTED = re.compile(rf":([0-9]+)({TAIL_SET}{{0,2}})\Z")


def is_address(token: str) -> bool:
    """Whether a token is an IPv4, IPv6 or hardware address, in a wrapper and with trailing marks perhaps."""
    if _IPV4.match(token):
        return True
    if ":" not in token:
        return False
    if token[0] == "[" and (at := token.find("]:")) > 0 and (m := _PORTED.match(token, at + 1)) and len(m[1]) <= 5 and _ipv6(token[1:at]):
        return True
    start, shed = int(token[0] in OPEN), False
    for trail in range(3):
        if len(token) <= start + trail:
            return False
        if trail:
            mark = token[-trail]
            if mark not in CLOSE + TRAIL:
                return False
            shed = shed or mark == ":"
        verdict = _core_is_address(token[start : len(token) - trail], shed)
        if verdict is not None:
            return verdict
    return False


def address_runs(token: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the colon-joined addresses inside a token."""
    for m in _RUN.finditer(token):
        groups = m[0].split(":")
        if len(groups) < 3 or m[0] == token:
            continue
        if all(len(g) == 2 for g in groups):
            if len(groups) in HARDWARE_GROUPS:
                yield m.span()
        elif len(groups) == 8:
            yield m.span()
        elif len(groups) == 9 and _digits(groups[-1]):
            yield m.start(), m.end() - len(groups[-1]) - 1


# --- paths


@dataclass
class _Steps:
    """The last components of a path: text, the byte before it, whether it opens the path."""

    seen: list[tuple[str, str, bool]] = field(default_factory=list)

    def add(self, text: str, before: str, opens: bool) -> None:
        self.seen = [*self.seen[-2:], (text, before, opens)]

    def root(self) -> bool | None:
        """Whether all below goes, if the components end in a root (the longest counts); else None."""
        best, length = None, 0
        for names, opens, subtree in ROOTS:
            n = len(names)
            own = self.seen[-n:]
            if n > length and len(own) == n and all(o[0] == name and o[1] in ("/", "\\") for o, name in zip(own, names)) and (own[0][2] or not opens):
                best, length = subtree, n
        return best


def _path_start(token: str) -> int:
    m = _PATH_LEAD.match(token)
    return m.end() if m else -1


def _ephemeral_root(token: str) -> str | None:
    steps, start, opening = _Steps(), 0, _path_start(token)
    for m in _STEP.finditer(token):
        steps.add(token[start : m.start()], token[start - 1 : start], start == opening)
        subtree = steps.root()
        start = m.end()
        if subtree is not None:
            if start >= len(token) or token[start] in "/\\":
                return None
            if subtree:
                return token[:start] + WILDCARD
            rest = re.search(r"[/\\]", token[start:])
            return token[:start] + WILDCARD + (token[start + rest.start() :] if rest else "")
    return None


# --- composites


def _core_span(text: str) -> tuple[int, int]:
    m = re.search(rf"{_AN}(?:.*{_AN})?", text, re.S)
    return m.span() if m else (len(text), len(text))


def _walk_runs(token: str) -> list[tuple[int, int, bool]]:
    """Address runs as a walk over `:` and `/` sees them: wider where digits touch them, joined where they then overlap."""
    out: list[tuple[int, int, bool]] = []
    for start, end in address_runs(token):
        opening = max(token.rfind(":", 0, start), token.rfind("/", 0, start)) + 1
        first_colon = token.index(":", start)
        lead = opening + _core_span(token[opening:first_colon])[0]
        groups = [start, *(k + 1 for k in range(start, end) if token[k] == ":")]
        named = token[lead].isalpha() or any(token[g].isalpha() for g in groups[1:])
        wide_start = lead if token[lead].isdigit() else start
        stop = re.compile("[:/]|$").search(token, end).start()
        trail = groups[-1] + _core_span(token[groups[-1] : stop])[1]
        wide_end = trail if token[groups[-1]].isdigit() and trail > end else end
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], wide_end), out[-1][2] or named)
        else:
            out.append((wide_start, wide_end, named))
    return out


def _diagnostic(token: str) -> str | None:
    """`file.cc:12:7`, `[pid:time:LEVEL:file(9)]`: digit-led segments go, where a letter-led one says what they are of."""
    if not re.search(":[0-9]", token):
        return None
    out: list[str] = []
    steps, opening = _Steps(), _path_start(token)
    masked = named = below_root = False
    before = ""

    def put(text: str, start: int, core: tuple[int, int], mask: bool) -> None:
        nonlocal masked, below_root
        out.append(text[: core[0]] + WILDCARD + text[core[1] :] if mask else text)
        masked = masked or mask
        steps.add(text, token[start - 1 : start], start == opening)
        below_root = steps.root() is not None

    def segment(start: int, end: int) -> None:
        nonlocal before, named
        text = token[start:end]
        span = _core_span(text)
        core = text[slice(*span)]
        if not core:
            out.append(text)
            before = ""
            return
        if below_root:
            put(text, start, span, True)
        elif core[0].isalpha():
            named = True
            if "\\" not in text:
                put(text, start, span, False)
            else:
                at = 0
                for m in re.finditer(r"\\+|\Z", text):
                    part = text[at : m.start()]
                    own = _core_span(part)
                    if own[0] == own[1]:
                        out.append(part)
                    else:
                        put(part, start + at, own, below_root)
                    out.append(m[0])
                    at = m.end()
        else:
            put(text, start, span, not _kept_status(core, before))
        before = core

    at = 0
    runs = iter(_walk_runs(token))
    run = next(runs, None)
    pos = 0
    while pos < len(token):
        if run and pos == run[0]:
            segment(at, pos)
            out.append(WILDCARD)
            masked, named, before = True, named or run[2], ""
            steps.add(token[run[0] : run[1]], token[pos - 1 : pos] if pos else "", pos == opening)
            below_root = steps.root() is not None
            at = pos = run[1]
            run = next(runs, None)
        elif token[pos] in ":/":
            segment(at, pos)
            out.append(token[pos])
            pos += 1
            at = pos
        else:
            pos += 1
    segment(at, len(token))
    return "".join(out) if masked and named else None


def instance_spans(token: str) -> tuple[str, bool, bool]:
    """A token with its UUIDs, long hashes, compact instants and addresses masked; whether one of the first, or of the last, was."""
    if len(token) < HASH_LEN and ":" not in token:
        return token, False, False
    out, at, found, ran = [], 0, False, False
    runs = address_runs(token)
    run = next(runs, None)
    while True:
        m = _IDENTITY.search(token, at)
        if run and run[0] >= at and (not m or run[0] <= m.start()):
            out += [token[at : run[0]], WILDCARD]
            at, ran, run = run[1], True, next(runs, None)
        elif m:
            out += [token[at : m.start()], WILDCARD]
            at, found = m.end(), True
        else:
            return "".join([*out, token[at:]]), found, ran


def _is_value(token: str, before: str) -> bool:
    """Whether a whole token is a value: hash, number, or number in a wrapper that isn't a kept status."""
    if not token or _UUID_OR_HASH.match(token) or _DIGIT_LED.match(token):
        return True
    core = shell_core(token)
    if core is not None and core[0].isdigit() and core[0].isascii():
        return not _kept_status(core, before)
    if len(token) > 1 and token[0] in OPEN and token[1] in "0123456789" and PAIRS[token[0]] not in token[1:]:
        value = token[1:]
        for _ in range(2):
            if len(value) > 1 and value[-1] in TRAIL:
                value = value[:-1]
        return not _kept_status(value, before)
    return False


def _embedded(token: str) -> str | None:
    form, found, ran = instance_spans(token)
    return form if found or ran and not _is_value(token, "") else None


def _reference_declines(token: str) -> bool:
    """A name of digits and hashes before the version: the whole token is a value, and no composite reads it."""
    lead = re.match(f"{OPEN_SET}*", token).end()
    slash = token.rfind("/")
    if slash <= lead or not re.match(_H, token[lead]) or not _VERSIONED.match(token):
        return False
    name = instance_spans(token[lead:slash])[0]
    return name[0].isdigit() and not re.search("[A-Za-z]", name) and _is_value(token, "")


def _value_masked(key: str, head: str, raw: str) -> str | None:
    """`head` and its value with the number masked, or None where it isn't one or is a kept status."""
    mark = int(raw[:1] == "$" and len(raw) > 1)
    value = raw[mark:]
    if not _DIGIT_LED.match(value):
        return None
    end = _EXTENT.match(value).end()
    if _kept_status(value[:end], key):
        return None
    rest = value[end:]
    return head + raw[:mark] + WILDCARD + ("" if _TAIL_ONLY.match(rest) else rest)


def _key_value(token: str) -> str | None:
    key, mark, value = token.partition("=")
    return _value_masked(key, key + "=", value) if key and mark else None


def _segments(form: str) -> str:
    """`a=1;b=2`: each segment's number."""
    if ";" not in form or "=" not in form:
        return form
    out = []
    for k, segment in enumerate(form.split(";")):
        name, mark, value = segment.partition("=")
        key = name.lstrip(OPEN) if k == 0 else name
        new = _value_masked(key, name + "=", value) if mark and name and _KEY.match(key) else None
        out.append(segment if new is None else new)
    return ";".join(out)


def _bracket_time(token: str) -> str | None:
    return f"[{WILDCARD}]" if len(token) > 2 and token[0] == "[" and token[-1] == "]" and rfc3339_length(token, 1) == len(token) - 2 else None


def _counter(token: str) -> str | None:
    if m := _COUNTER.match(token):
        return f"#{WILDCARD}{m[1]}"
    core = shell_core(token)
    if core and (m := _COUNTER.match(core)):
        return f"{token[0]}#{WILDCARD}{m[1]}{token[1 + len(core) :]}"
    return None


def _by(pattern: re.Pattern, form: str):
    return lambda token: m.expand(form) if (m := pattern.match(token)) else None


#: Composite rules in order: name, what the token becomes (None: not this rule's), whether reading stops undecided, and
#: bytes of which the token must have one for the rule to be asked.
COMPOSITES = (
    ("diagnostic_composite", _diagnostic, None, ":"),
    ("ephemeral_root", _ephemeral_root, None, "/\\"),
    ("versioned_ref", _by(_VERSIONED, r"\1<*>\3"), _reference_declines, "/"),
    ("bracket_timestamp", _bracket_time, None, "["),
    ("bracket_index", _by(_INDEX, r"\1<*>\3"), None, "["),
    ("hash_counter", _counter, None, "#"),
    ("marker_number", _by(_MONEY, r"$<*>\1"), None, "$"),
    ("embedded_identity", _embedded, None, ""),
    ("sanitizer_pid", _by(_PID, r"==<*>\1"), None, "="),
    ("kv_value", _key_value, None, "="),
)


def composite(token: str) -> tuple[str, str] | None:
    """(rule, normal form) of the first composite rule that claims the token."""
    if not _SEPARATOR.search(token) and not (token[0] == "$" and len(token) > 1):
        return None
    for name, rule, declines, marks in COMPOSITES:
        if marks and not (marks[0] in token or marks[-1] in token):
            continue
        if declines and declines(token):
            return None
        form = rule(token)
        if form is not None:
            return name, form
    return None


# --- values that a stream declares, and forms that a dialect does


@dataclass(frozen=True)
class DeclaredRun:
    """A declared value: digits behind one of `markers` (or `min_digits` of them anywhere), or text behind `prefixes`."""

    value: str
    markers: tuple[str, ...] = ()
    min_digits: int = 0
    text: bool = False
    prefixes: tuple[str, ...] = ()


@dataclass(frozen=True)
class InstanceValue:
    """form `line`: a quoted value behind `prefix`; `shape`: a number in it; `argument`: values of flags and keys of a command."""

    form: str
    prefix: str
    flags: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _text_spans(form: str, run: DeclaredRun) -> list[tuple[int, int]]:
    if re.fullmatch("[A-Za-z]*", run.value):
        return []
    offset, region = 0, form
    core = shell_core(form)
    if core is not None:
        offset, region = 1, core
    elif len(form) > 1 and form[0] in OPEN and PAIRS[form[0]] not in form[1:]:
        offset, region = 1, form[1:]
    for lead in ("", *run.prefixes):
        if region.startswith(lead + run.value) and re.fullmatch("[,;:.]{0,2}", region[len(lead) + len(run.value) :]):
            at = offset + len(lead)
            return [(at, at + len(run.value))]
    return []


def declared_spans(form: str, runs: Sequence[DeclaredRun]) -> list[tuple[int, int]]:
    """Where a form holds values that the stream declares."""
    out = []
    for run in runs:
        if run.value not in form:
            continue
        if run.text:
            out += _text_spans(form, run)
            continue
        if run.min_digits and len(run.value) >= run.min_digits:
            out += [m.span() for m in re.finditer(rf"(?<![0-9]){re.escape(run.value)}(?![0-9])", form)]
        if run.markers:
            names = "|".join(map(re.escape, run.markers))
            found = re.finditer(rf"(?<!{_AN})(?:{names})([0-9]+)(?![0-9A-Za-z])", form)
            out += [m.span(1) for m in found if m[1] == run.value]
    return _merged(out)


def shape_spans(form: str, values: Sequence[InstanceValue]) -> list[tuple[int, int]]:
    """Where a form has the number of a declared shape."""
    out = []
    for value in values:
        if value.form == "shape":
            before, _, after = value.prefix.partition("{n}")
            out += [m.span(1) for m in re.finditer(rf"{re.escape(before)}([0-9]+)(?={re.escape(after)})(?![0-9])", form)]
    return _merged(out)


def replace_spans(form: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in spans:
        out += [form[at:a], WILDCARD]
        at = b
    return "".join([*out, form[at:]])


# --- a whole line


class Masker:
    """Templates under the declared values of a stream and the instance forms of its dialect."""

    def __init__(self, runs: Sequence[DeclaredRun] = (), values: Sequence[InstanceValue] = ()) -> None:
        self.runs, self.values = tuple(runs), tuple(values)
        self.seen: dict[str, str] = {}
        self.lines: dict[str, tuple[str, list[str]]] = {}

    def _steps(self, form: str) -> str:
        form = _segments(instance_spans(form)[0])
        if self.runs:
            form = replace_spans(form, declared_spans(form, self.runs))
        return replace_spans(form, shape_spans(form, self.values)) if self.values else form

    def form(self, token: str, before: str) -> str:
        """What a token becomes; `before` is the token before it. Forms that don't hang on that are remembered."""
        if is_status_word(before):
            return self._form(token, before)
        if _BARE.match(token) and not (self.runs or self.values):
            return WILDCARD
        if (m := _BARE_VALUE.match(token)) and not (self.runs or self.values or is_status_word(m[1])):
            return f"{m[1]}={WILDCARD}"
        form = self.seen.get(token)
        if form is None:
            form = self._form(token, "")
            if len(token) <= 64:
                if len(self.seen) >= REMEMBERED:
                    self.seen.clear()
                self.seen[token] = form
        return form

    def _form(self, token: str, before: str) -> str:
        if _kept_status(token, before):
            return token
        if is_address(token):
            return WILDCARD
        found = composite(token)
        if found:
            return self._steps(found[1])
        return WILDCARD if _is_value(token, before) else self._steps(token)

    def _line_value(self, line: str) -> tuple[str, str]:
        """(prefix, quote) of the line form that the line is of."""
        for value in self.values:
            if value.form == "line" and line.startswith(value.prefix):
                rest = line[len(value.prefix) :]
                if len(rest) >= 3 and rest[0] in "'\"" and rest[-1] == rest[0] and rest[0] not in rest[1:-1]:
                    return value.prefix, rest[0]
        return line, ""

    @staticmethod
    def _keyed(token: str, value: InstanceValue) -> tuple[int, int] | None:
        lead = len(token) - len(token.lstrip(OPEN))
        tail = max(lead, len(token.rstrip(CLOSE + TRAIL)))
        for key in value.keys:
            if token.startswith(key, lead) and lead + len(key) < tail:
                return lead + len(key), tail
        return None

    def template(self, content: str) -> tuple[str, list[str]]:
        """(template, params): tokens joined by one space; a token that goes whole is a param, in order."""
        constant = len(content) <= 200 and not _DIGIT.search(content)
        if constant and (known := self.lines.get(content)):
            return known
        out = self._template(content)
        if constant:
            if len(self.lines) >= REMEMBERED:
                self.lines.clear()
            self.lines[content] = out
        return out

    def _template(self, content: str) -> tuple[str, list[str]]:
        line = member_order(content) if content.lstrip(" \t\r\n")[:1] in ("{", "[") else content
        line, quote = self._line_value(line)
        argument = next((v for v in self.values if v.form == "argument" and line.startswith(v.prefix)), None)
        tokens = [t for t in line.split(" ") if t]
        repeated: set[str] = set()
        if argument:
            for before, token in zip(["", *tokens], tokens):
                if before in argument.flags:
                    repeated.add(token)
                if span := self._keyed(token, argument):
                    repeated.add(token[slice(*span)])
        out, params, before = [], [], ""
        for token in tokens:
            if argument and (before in argument.flags or ":" in token and token.split(":", 1)[0] in repeated):
                form = WILDCARD
            else:
                form = self.form(token, before)
                if form != WILDCARD and argument and (span := self._keyed(token, argument)):
                    out.append(replace_spans(token, [span]))
                    before = token
                    continue
            if form == WILDCARD:
                params.append(token)
            out.append(form)
            before = token
        if quote:
            out.append(quote + WILDCARD + quote)
        return " ".join(out), params


def mask_instances(text: str) -> str:
    """UUIDs, hashes, instants and addresses masked in each token; all else, spaces too, as it was."""
    return " ".join(instance_spans(t)[0] if t else t for t in text.split(" "))


# --- members of JSON in order of name

_BLANK = re.compile(r"[ \t\n\r]*")
_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*"')
_SCALAR = re.compile(r"true|false|null|-?(?:0|[0-9]+)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})(?:\\u([Dd][C-Fc-f][0-9A-Fa-f]{2}))?|(.))")
MAX_DEPTH = 128


def unescaped(body: str) -> str:
    """The bytes that a JSON string's body stands for, as Latin-1."""

    def one(m: re.Match) -> str:
        if m[3]:
            return {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}.get(m[3], m[3])
        code = int(m[1], 16)
        if m[2] and 0xD800 <= code < 0xDC00:
            return chr(0x10000 + (code - 0xD800 << 10) + int(m[2], 16) - 0xDC00).encode().decode("latin-1")
        tail = chr(int(m[2], 16)).encode("utf-8", "surrogatepass").decode("latin-1") if m[2] else ""
        return chr(code).encode("utf-8", "surrogatepass").decode("latin-1") + tail

    return _ESCAPE.sub(one, body) if "\\" in body else body


class _NotJson(ValueError):
    pass


def _ordered(text: str, at: int, depth: int) -> tuple[str, int]:
    """The value at `at` with members in order of name, and its end. Repeated names and bad JSON raise."""
    opened = text[at : at + 1]
    if opened not in ("{", "["):
        m = (_STRING if opened == '"' else _SCALAR).match(text, at)
        if not m:
            raise _NotJson
        return m[0], m.end()
    if depth >= MAX_DEPTH:
        raise _NotJson
    closing = "}" if opened == "{" else "]"
    start = _BLANK.match(text, at + 1).end()
    head = text[at:start]
    if text[start : start + 1] == closing:
        return head + closing, start + 1
    members: list[tuple[str, str]] = []
    gaps: list[str] = []
    at = start
    while True:
        name = lead = ""
        if opened == "{":
            m = _STRING.match(text, at)
            if not m:
                raise _NotJson
            name, colon = unescaped(m[0][1:-1]), _BLANK.match(text, m.end()).end()
            if text[colon : colon + 1] != ":":
                raise _NotJson
            value_at = _BLANK.match(text, colon + 1).end()
            lead, at = text[at:value_at], value_at
        value, end = _ordered(text, at, depth + 1)
        members.append((name, lead + value))
        after = _BLANK.match(text, end).end()
        mark = text[after : after + 1]
        if mark == closing:
            gaps.append(text[end:after])
            break
        if mark != ",":
            raise _NotJson
        at = _BLANK.match(text, after + 1).end()
        gaps.append(text[end:at])
    if opened == "{":
        members.sort(key=lambda x: x[0])
        if any(a[0] == b[0] for a, b in zip(members, members[1:])):
            raise _NotJson
    return head + "".join(m + g for (_, m), g in zip(members, gaps)) + closing, after + 1


def member_order(content: str) -> str:
    """Content that is one JSON object or array with members sorted by name at every depth; any other content as it is.

    What stands between members keeps its place, arrays keep their order. Repeated names, over 128 levels and text behind
    the value leave the content alone.
    """
    start = _BLANK.match(content).end()
    if content[start : start + 1] not in ("{", "["):
        return content
    try:
        value, end = _ordered(content, start, 0)
    except (_NotJson, RecursionError):
        return content
    return content[:start] + value + content[end:] if _BLANK.match(content, end).end() == len(content) else content
