"""Ids of templates and of sequences of them, names of units without what varies, and logarithms in fixed point."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .masks import declared_spans, replace_spans, shape_spans

_ID = re.compile(r"h:[0-9a-f]{32}\Z")


def template_id(template: bytes) -> str:
    """`h:` and the first 16 bytes of the SHA-256."""
    return "h:" + hashlib.sha256(template).hexdigest()[:32]


def template_id_column(latin: Column) -> Column:
    return F.concat(F.lit("h:"), F.substring(F.sha2(F.encode(latin, "ISO-8859-1"), 256), 1, 32))


def parse_template_id(text: str) -> bytes | None:
    return bytes.fromhex(text[2:]) if _ID.match(text) else None


def sequence_id(ids: list[bytes]) -> bytes:
    """A 128-bit key of a sequence of 16-byte ids, in that order."""
    # Starts and factors of the two lanes.
    a, b = 0xCBF29CE484222325, 0x9E3779B97F4A7C15
    p, q = 0x100000001B3, 0xFF51AFD7ED558CCD
    for x in ids:
        low, high = (int.from_bytes(x[k : k + 8], "little") for k in (0, 8))
        a = ((a ^ low) * p % (1 << 64) ^ high) * p % (1 << 64)
        b = ((b ^ high) * q % (1 << 64) ^ low) * q % (1 << 64)
    return a.to_bytes(8, "little") + b.to_bytes(8, "little")


# --- names of units

_VARYING = re.compile(r"\([^)]*\)|(?<![0-9A-Za-z_])(?:v?[0-9]++(?:\.[0-9]++)++|v[0-9]++|[0-9]{2,}+)(?![0-9A-Za-z_])")


def trimmed(name: str) -> str:
    return name.strip(" \t")


def _mask(text: str) -> str:
    return "(M)" if text[0] == "(" else "N" if text.isdigit() else "vX"


def unit_class(name: str, version: str = "") -> str:
    """A unit's name with parentheses as (M), versions as vX, numbers of two digits or more as N; `version` goes whole."""
    name = trimmed(name)
    tail = version if version and len(version) <= len(name) else ""
    head = trimmed(name[: len(name) - len(tail)])
    return _VARYING.sub(lambda m: _mask(m[0]), head) + ("vX" if tail else "")


def unit_id(name: str) -> str:
    return template_id(unit_class(name).encode("latin-1"))


def unit_class_column(name: Column) -> Column:
    """unit_class() of names without a version, as a Column."""
    out = F.trim(name, F.lit(" \t"))
    word, edge = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
    # One kind at a time: what a parenthesis becomes has no digit, and a version's mask has none either.
    for pattern, mask in ((r"\([^)]*\)", "(M)"), (rf"{word}(?:v?[0-9]++(?:\.[0-9]++)++|v[0-9]++){edge}", "vX"), (rf"{word}[0-9]{{2,}}+{edge}", "N")):
        out = F.regexp_replace(out, pattern, mask)
    return out


def _envelope(name: str, version: str) -> tuple[int, int] | None:
    """From the first varying part of a trimmed name to the end of the last; a version is one, at the end."""
    tail = version if version and len(version) <= len(name) else ""
    head = name[: len(name) - len(tail)]
    lead = len(head) - len(head.lstrip(" \t"))
    spans = [(lead + m.start(), lead + m.end()) for m in _VARYING.finditer(trimmed(head))]
    if tail:
        return (spans[0][0] if spans else len(head)), len(name)
    return (spans[0][0], spans[-1][1]) if spans else None


def discriminant(name: str, version: str = "") -> str:
    """What tells a unit from others of its class."""
    name = trimmed(name)
    span = _envelope(name, version)
    return name[slice(*span)] if span else ""


def one_token_version(name: str, introducer: str) -> str:
    """What follows the last introducer of a name of one token."""
    name = trimmed(name)
    if not introducer or re.search("[ \t]", name) or introducer not in name:
        return ""
    return name.rpartition(introducer)[2]


def identity_spans(name: str, runs=(), values=()) -> list[tuple[int, int]]:
    """Where a name holds declared values or instance shapes, token by token."""
    out = []
    for m in re.finditer("[^ ]+", name):
        for a, b in [*declared_spans(m[0], runs), *shape_spans(m[0], values)]:
            out.append((m.start() + a, m.start() + b))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(out):
        if merged and a <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(b, merged[-1][1])
        else:
            merged.append((a, b))
    return merged


def masked_name(name: str, version: str = "", runs=(), values=()) -> str:
    """A name with its declared values masked, its version aside."""
    name = trimmed(name)
    head = name[: len(name) - len(version)] if version and len(version) <= len(name) else name
    return replace_spans(head, identity_spans(head, runs, values)) + name[len(head) :]


def declared_discriminant(name: str, version: str = "", runs=(), values=()) -> str:
    """discriminant() with declared values masked in it."""
    name = trimmed(name)
    span = _envelope(name, version)
    if not span:
        return ""
    first, last = span
    tail = min(last, len(name) - len(version) if version and len(version) <= len(name) else len(name))
    spans = [(max(a, first) - first, min(b, tail) - first) for a, b in identity_spans(name, runs, values) if max(a, first) < min(b, tail)]
    return replace_spans(name[first:last], spans)


# --- logarithms in fixed point, 40 bits behind the point

FRACTION = 40
#: ln 2 in that form.
LN2 = 762123384786
_GUARD = 2


def log2_fixed(value: int) -> int:
    """log2 of a whole number, rounded to the nearest; 0 and 1 give 0."""
    if value <= 1:
        return 0
    top = value.bit_length() - 1
    work = FRACTION + _GUARD
    mantissa, fraction = (value << work) >> top, 0
    for _ in range(work):
        mantissa = mantissa * mantissa >> work
        over = mantissa >> (work + 1)
        fraction = fraction << 1 | (1 if over else 0)
        mantissa >>= 1 if over else 0
    return (top << FRACTION) + (fraction + (1 << _GUARD - 1) >> _GUARD)


def ln_fixed(value: int) -> int:
    return log2_fixed(value) * LN2 + (1 << FRACTION - 1) >> FRACTION


def round_div(num: int, den: int) -> int:
    """num / den to the nearest, halves away from zero."""
    return (num + den // 2) // den if num >= 0 else -((-num + den // 2) // den)


def to_float(fixed: int) -> float:
    return fixed / (1 << FRACTION)


