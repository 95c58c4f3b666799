"""Checks that a package keeps to what a package may be; each gives the faults that it finds, none for a good package."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import fields

from . import walkers
from .rules import HOLE, Package, Rules, compose

#: Lines on which a package's code must answer alike twice, whatever is in them.
PROBES = ("", " ", "plain words 12", "\x1b[31mred\x1b[0m", "\xef\xbb\xbfx", "2026-01-15T10:00:00.000000Z 00O x", '{"a":1}', "\xff\xfe\x00", "x" * 5000)


def _rows(package: Package) -> Iterable[object]:
    for f in fields(package):
        value = getattr(package, f.name)
        if isinstance(value, tuple):
            yield from value


def determinism(package: Package) -> list[str]:
    """Code and composition answer alike when asked again."""
    out = [] if compose(package).identity == compose(package).identity else ["composition isn't repeatable"]
    for line in PROBES:
        if package.echoed_source and package.echoed_source(line) != package.echoed_source(line):
            out.append(f"echoed_source wavers on {line!r}")
        if package.format and (package.format.confidence(line), package.format.parse(line)) != (package.format.confidence(line), package.format.parse(line)):
            out.append(f"format wavers on {line!r}")
    return out


def ascii_rows(package: Package) -> list[str]:
    return [f"row isn't ASCII: {row}" for row in _rows(package) if not repr(row).isascii() or not str(row).isascii()]


def probe(row) -> str:
    """A line that the row fires on."""
    text = getattr(row, "prefix", None) or getattr(row, "shape", None) or getattr(row, "token", "")
    return text.replace(HOLE, "7")


def gate_honesty(package: Package) -> list[str]:
    """A gated row is silent where its dialect isn't declared, or its channel, and in a view of its own fires."""
    rules, plain, out = compose(package), compose(package).for_stream(), []
    for kind in ("roles", "markers", "lifts", "outcome_tokens", "outcome_markers", "declared", "stops", "instances"):
        out += [f"{kind}: {row} leaks into undeclared streams" for row in getattr(plain, kind) if row.gate]
    for channel in ("", *package.channels):
        view = rules.for_stream(package.name, channel)
        out += [f"{m} leaks into channel {channel!r}" for m in view.markers if m.channel not in ("", channel)]
        out += [f"{r} doesn't fire" for r in view.roles if walkers.role_of(probe(r), view) == "None"]
        out += [f"{r} doesn't fire" for r in view.lifts if walkers.lifted_level(probe(r), view) is None]
        out += [f"{r} doesn't fire" for r in view.stops if not walkers.announces_stop(probe(r), view)]
    return out


def round_trips(package: Package) -> list[str]:
    """What a marker's writer renders, its reader reads back, for names that the row admits."""
    out = []
    for channel in ("", *package.channels):
        view = compose(package).for_stream(package.name, channel)
        for row in view.markers:
            if row.role == "Names" and walkers.unit_of(walkers.render_unit(row, "alpha", "beta"), view).name != "alpha":
                out.append(f"{row} doesn't read back what it writes")
        for outcome in {t.outcome for t in view.outcome_tokens} - {"UNKNOWN"}:
            line = walkers.render_outcome(view, outcome)
            if line:
                _, said, token = walkers.console_verdict(line, view)
                if (said or walkers.outcome_of_token(token, view)) != outcome:
                    out.append(f"{outcome} doesn't read back from {line!r}")
    return out


def run(package: Package) -> list[str]:
    """All faults of a package."""
    return [*determinism(package), *ascii_rows(package), *gate_honesty(package), *round_trips(package)]


def differences(a: Package, b: Package) -> list[str]:
    """Where two packages differ, member by member and row by row."""
    out = []
    for f in fields(Package):
        x, y = getattr(a, f.name), getattr(b, f.name)
        if callable(x) or callable(y):
            x, y = x is not None, y is not None
        if isinstance(x, tuple) and f.name != "format":
            out += [f"{f.name}: only the first has {row}" for row in x if row not in y] + [f"{f.name}: only the second has {row}" for row in y if row not in x]
            if not out and x != y:
                out.append(f"{f.name}: rows stand in another order")
        elif x != y:
            out.append(f"{f.name}: {x!r} and {y!r}")
    return out


def shadows(rules: Rules) -> tuple[str, ...]:
    return rules.notes
