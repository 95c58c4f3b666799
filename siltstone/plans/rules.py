"""Vocabularies of dialects as data, composed into one set of rules, and views of it for a stream.

A package is a set of rows. A row fires under its own package's dialect alone, or under any where its gate is empty; a
marker may be held to one channel as well. Composition checks every row, refuses duplicates and orders packages by name,
so equal packages give equal rules and one identity, whatever order they come in.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import asdict, dataclass, field, replace
from functools import cache, cached_property

from ..functions.formats import Format
from ..functions.masks import DeclaredRun, InstanceValue
from ..session import logger

#: Generations of the rules that results must agree with, and of the rows' grammar.
CANONICALIZATION, GRAMMAR = "stateless-masks-20", "semantic-grammar-9"
MIN_FLOOR = 5
HOLE = "{n}"


@dataclass(frozen=True)
class Role:
    """A structural role by prefix, or by the shape of the whole line."""

    prefix: str
    role: str
    gate: str = ""
    shape: bool = False
    since: str = ""


@dataclass(frozen=True)
class Fields:
    """Names of the fields of a keyed marker."""

    name: str = ""
    display: str = ""
    segment: str = ""
    ordinal: str = ""
    anonymous: str = ""
    outcome: str = ""
    propagated: str = ""


@dataclass(frozen=True)
class Marker:
    """A line that names, opens, closes or ends a unit. extract: none, rest, paren, numbered or keyed."""

    prefix: str
    kind: str
    role: str = "Names"
    extract: str = "none"
    order: str = "Ordered"
    gate: str = ""
    channel: str = ""
    excludes: tuple[str, ...] = ()
    introducer: str = ""
    fields: Fields = field(default_factory=Fields)
    since: str = ""


@dataclass(frozen=True)
class Lift:
    prefix: str
    level: str
    gate: str = ""


@dataclass(frozen=True)
class Location:
    """Test files: kind `infix`, `affix` or `suffix`."""

    kind: str
    infixes: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()


@dataclass(frozen=True)
class OutcomeToken:
    token: str
    outcome: str
    gate: str = ""


@dataclass(frozen=True)
class OutcomeMarker:
    """A console line that says the outcome: the prefix itself where `outcome` is set, else the token behind it."""

    prefix: str
    gate: str = ""
    outcome: str = ""


@dataclass(frozen=True)
class Declared:
    """A value that a stream may declare under `key`: digits behind markers or in a floor's number, or text behind prefixes."""

    key: str
    markers: tuple[str, ...] = ()
    min_digits: int = 0
    text: bool = False
    prefixes: tuple[str, ...] = ()
    gate: str = ""
    extends: bool = False


@dataclass(frozen=True)
class Stop:
    shape: str
    gate: str = ""


@dataclass(frozen=True)
class Instance:
    """See InstanceValue; gated."""

    form: str
    prefix: str
    flags: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()
    gate: str = ""


@dataclass(frozen=True)
class Package:
    name: str
    version: str = "1.0.0"
    roles: tuple[Role, ...] = ()
    markers: tuple[Marker, ...] = ()
    lifts: tuple[Lift, ...] = ()
    locations: tuple[Location, ...] = ()
    outcome_tokens: tuple[OutcomeToken, ...] = ()
    outcome_markers: tuple[OutcomeMarker, ...] = ()
    declared: tuple[Declared, ...] = ()
    stops: tuple[Stop, ...] = ()
    instances: tuple[Instance, ...] = ()
    channels: tuple[str, ...] = ()
    revisions: tuple[str, ...] = ("v1",)
    format: Format | None = None
    echoed_source: Callable[[str], bool] | None = None


_GATED = ("roles", "markers", "lifts", "outcome_tokens", "outcome_markers", "declared", "stops", "instances")


def shape_well_formed(shape: str) -> bool:
    """Holes apart from digits, braces and each other, nothing blank at the end: so a shape reads one way only."""
    if not shape or shape[-1] in " \t\r\n\v\f" or re.search("[{}]", shape.replace(HOLE, "")):
        return False
    return not re.search(r"\{n\}\{n\}|[0-9]\{n\}|[0-9]\.\{n\}|\{n\}[0-9]|\{n\}\.(?:[0-9]|\{n\}|\Z)", shape)


def shape_regex(shape: str) -> str:
    """A shape as a regular expression over a whole line, blanks behind it aside (both Java's and Python's)."""
    number = r"[0-9]++(?:\.[0-9]++)?+"
    parts = ["".join("\\" + c if c in r"\.^$|?*+()[]{}#&-~" else c for c in part) for part in shape.split(HOLE)]
    return "(?s)^" + number.join(parts) + r"[ \t\r\n\x0b\f]*\z"


@cache
def _compiled(shape: str) -> re.Pattern:
    return re.compile(shape_regex(shape).replace(r"\z", r"\Z"))


def matches_shape(shape: str, content: str) -> bool:
    return content.startswith(shape.partition(HOLE)[0]) and bool(_compiled(shape).match(content))


def _require(ok: bool, package: Package, what: str, row: object) -> None:
    if not ok:
        raise ValueError(f"package {package.name!r}: bad {what}: {row}")


def _check(package: Package) -> None:
    if not package.name:
        raise ValueError("a package needs a name")
    if not package.revisions or len(set(package.revisions)) != len(package.revisions) or not all(package.revisions):
        raise ValueError(f"package {package.name!r}: revisions must be named, each once")
    for kind in _GATED:
        for row in getattr(package, kind):
            _require(row.gate in ("", package.name), package, f"gate in {kind}", row)
            _require(getattr(row, "since", "") in ("", *package.revisions), package, f"revision in {kind}", row)
    for row in package.roles:
        own = HOLE in row.prefix and shape_well_formed(row.prefix) if row.shape else row.role != "Progress"
        _require(bool(row.prefix) and own, package, "role", row)
    for row in package.stops:
        _require(shape_well_formed(row.shape), package, "stop", row)
    for row in package.markers:
        _require(bool(row.prefix) and row.channel in ("", *package.channels) and _marker_admitted(row), package, "marker", row)
    for row in package.declared:
        if row.text:
            ok = not (row.markers or row.min_digits or row.extends) and bool(row.prefixes) and all(row.prefixes)
        else:
            ok = not row.prefixes and bool(row.markers or row.min_digits) and not 0 < row.min_digits < MIN_FLOOR
            ok = ok and all(m and not m[-1].isdigit() for m in row.markers)
        _require(bool(row.key) and ok, package, "declared value", row)
    for row in package.instances:
        ok = bool(row.prefix) and all(row.flags) and all(row.keys)
        if row.form == "shape":
            ok = ok and row.prefix.count(HOLE) == 1 and not row.prefix.startswith(HOLE) and not row.flags and not row.keys
        elif row.form == "argument":
            ok = ok and bool(row.flags or row.keys)
        _require(ok and row.form in ("line", "shape", "argument"), package, "instance value", row)


def _marker_admitted(row: Marker) -> bool:
    keyed, bare = row.extract == "keyed", row.extract == "none" and not row.introducer and not row.excludes
    if (row.kind == "InnerStep") != keyed:
        return False
    if not keyed:
        if row.fields != Fields():
            return False
        return {"Names": True, "Opens": bare and row.kind in ("Job", "Step"), "Closes": bare and row.kind == "Step"}.get(row.role, False)
    f = row.fields
    if row.introducer or row.excludes:
        return False
    if row.role == "Names":
        return all((f.name, f.display, f.segment, f.ordinal, f.anonymous)) and not f.outcome and not f.propagated
    return row.role == "Ends" and bool(f.outcome and f.propagated) and not f.name


def _meet(a: str, b: str) -> bool:
    return not a or not b or a == b


def _conflict(packages: Sequence[Package]) -> str:
    """The first two rows that say the same under gates that can both be open, as text; empty where there are none."""
    names = [p.name for p in packages]
    if twice := next((n for n in names if names.count(n) > 1), None):
        return f"two packages are named {twice!r}"
    keys = {
        "roles": lambda r: (r.prefix, r.shape),
        "markers": lambda r: (r.prefix, r.role),
        "lifts": lambda r: r.prefix,
        "outcome_tokens": lambda r: r.token,
        "outcome_markers": lambda r: r.prefix,
        "declared": lambda r: None if r.extends else r.key,
    }
    for kind, key in keys.items():
        seen: dict[object, list] = {}
        for row in (r for p in packages for r in getattr(p, kind)):
            if (k := key(row)) is None:
                continue
            for other in seen.get(k, ()):
                if _meet(row.gate, other.gate) and _meet(getattr(row, "channel", ""), getattr(other, "channel", "")):
                    return f"{kind}: {other} and {row}"
            seen.setdefault(k, []).append(row)
    return ""


@dataclass(frozen=True)
class Rules:
    """Composed rows, as one stream sees them. `packages` and `identity` are those of the whole composition."""

    packages: tuple[Package, ...]
    identity: str
    dialect: str = ""
    channel: str = ""
    notes: tuple[str, ...] = ()

    def _rows(self, kind: str) -> tuple:
        rows = (r for p in self.packages for r in getattr(p, kind))
        return tuple(r for r in rows if r.gate in ("", self.dialect) and getattr(r, "channel", "") in ("", self.channel))

    @cached_property
    def roles(self) -> tuple:
        return self._rows("roles")

    @cached_property
    def role_heads(self) -> tuple[str, ...]:
        """What a content must begin with for any role."""
        return tuple({r.prefix.partition(HOLE)[0] if r.shape else r.prefix for r in self.roles})

    @cached_property
    def lift_heads(self) -> tuple[str, ...]:
        return tuple(r.prefix for r in self.lifts)

    @cached_property
    def markers(self) -> tuple:
        return self._rows("markers")

    @cached_property
    def lifts(self) -> tuple:
        return self._rows("lifts")

    @cached_property
    def outcome_tokens(self) -> tuple:
        return self._rows("outcome_tokens")

    @cached_property
    def outcome_markers(self) -> tuple:
        return self._rows("outcome_markers")

    @cached_property
    def declared(self) -> tuple:
        return self._rows("declared")

    @cached_property
    def stops(self) -> tuple:
        return self._rows("stops")

    @cached_property
    def instances(self) -> tuple:
        return self._rows("instances")

    @cached_property
    def locations(self) -> tuple:
        return tuple(r for p in self.packages for r in p.locations)

    @cached_property
    def formats(self) -> tuple:
        return tuple(p.format for p in self.packages if p.format)

    @cached_property
    def hooks(self) -> tuple:
        return tuple(p.echoed_source for p in self.packages if p.echoed_source)

    def revision_rank(self, marker: Marker) -> int:
        owner = next(p for p in self.packages if marker in p.markers)
        return owner.revisions.index(marker.since) if marker.since else 0

    @property
    def canonicalization_version(self) -> str:
        return f"{CANONICALIZATION}:{self.identity}"

    def for_stream(self, dialect: str = "", channel: str = "") -> Rules:
        """The view of a stream. An unknown dialect or channel is an error; none opens rows of any dialect alone."""
        names = [p.name for p in self.packages]
        if dialect and dialect not in names:
            raise ValueError(f"unknown dialect {dialect!r}; composed are {names}")
        channels = [c for p in self.packages for c in p.channels]
        if channel and channel not in channels:
            raise ValueError(f"unknown channel {channel!r}; declared are {channels}")
        return replace(self, dialect=dialect, channel=channel)

    def withholds_markers_for(self, channel: str) -> bool:
        """Whether the dialect has markers that `channel` doesn't open."""
        return any(m.gate in ("", self.dialect) and m.channel not in ("", channel) for p in self.packages for m in p.markers)

    def check_context(self, context: dict[str, str]) -> str:
        """What is wrong with values that a stream declares; empty where nothing is."""
        whole = [r for p in self.packages for r in p.declared]
        for key, value in context.items():
            rows = [r for r in whole if r.key == key]
            if not rows:
                return f"unknown context key {key!r}; declared are {sorted({r.key for r in whole})}"
            if rows[0].text:
                if not value:
                    return f"context value of {key!r} is empty"
                continue
            if not re.fullmatch("0|[1-9][0-9]*", value):
                return f"context value {value!r} of {key!r} isn't a decimal number without leading zeros"
            floor = 0 if any(r.markers for r in rows) else min(r.min_digits for r in rows)
            if len(value) < floor:
                return f"context value {value!r} of {key!r} has under {floor} digits"
        return ""

    def declared_runs(self, context: dict[str, str]) -> tuple[DeclaredRun, ...]:
        if wrong := self.check_context(context):
            raise ValueError(wrong)
        return tuple(DeclaredRun(context[r.key], r.markers, r.min_digits, r.text, r.prefixes) for r in self.declared if r.key in context)

    def instance_values(self) -> tuple[InstanceValue, ...]:
        return tuple(InstanceValue(r.form, r.prefix, r.flags, r.keys) for r in self.instances)


def _plain(package: Package) -> dict:
    own = {k: v for k, v in package.__dict__.items() if k not in ("format", "echoed_source")}
    rows = {k: [asdict(x) if hasattr(x, "__dataclass_fields__") else x for x in v] if isinstance(v, tuple) else v for k, v in own.items()}
    return rows | {"format": package.format is not None, "echoed_source": package.echoed_source is not None}


def _shadows(packages: Iterable[Package]) -> tuple[str, ...]:
    """Prefixes that open other prefixes of the same kind under gates that meet; the longer wins, so this is a note."""
    out = []
    for kind in ("roles", "markers", "outcome_markers"):
        rows = [r for p in packages for r in getattr(p, kind) if not getattr(r, "shape", False)]
        out += [f"{kind}: {a.prefix!r} opens {b.prefix!r}" for a in rows for b in rows if a.prefix != b.prefix and b.prefix.startswith(a.prefix) and _meet(a.gate, b.gate)]
    return tuple(out)


def compose(*packages: Package) -> Rules:
    """Rules of these packages. Bad rows and rows that contradict each other are errors."""
    for package in packages:
        _check(package)
    ordered = tuple(sorted(packages, key=lambda p: (p.name, p.version)))
    if conflict := _conflict(ordered):
        raise ValueError(f"conflict between packages: {conflict}")
    keys = {d.key: d for p in ordered for d in p.declared if not d.extends}
    extended = tuple(
        replace(p, declared=tuple(replace(d, gate=d.gate or keys[d.key].gate, text=keys[d.key].text) if d.extends and d.key in keys else d for d in p.declared))
        for p in ordered
    )
    said = json.dumps([GRAMMAR, *map(_plain, extended)], sort_keys=True).encode()
    rules = Rules(extended, hashlib.sha256(said).hexdigest()[:32], notes=_shadows(extended))
    logger("rules").info("composed %d packages, %d shadows noted", len(extended), len(rules.notes))
    return rules
